"""The training-data operators against brute force on small tables."""

import functools
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loxodrome.llm import op01_imatch, op02_quality, op03_bpe, op04_jaccard, op05_packing, op06_lines, op07_pst, op08_suffix, op09_toxicity, op10_debruijn
from loxodrome.llm.bpe import TrieBpe
from loxodrome.llm.graph import components, contracted
from loxodrome.llm.spans import merged, merged_lists

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=60, seed=1):
    """Random prose with exact and near copies, shared passages and lines, nulls, empty, short and long texts."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéß", k=r.randint(2, 6))) for _ in range(400)]
    prose = lambda k: " ".join(r.choices(words, k=k))
    texts = [None, "", " \n\t ", "one", "one two three", prose(3000), "x" * 5000, "a " * 300]
    base, passage, line = prose(200), prose(70), [prose(6) for _ in range(5)]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            own = base.split(" ")
            own[r.randrange(len(own))] = f"edit{i}"
            texts.append(" ".join(own))
        elif kind == 2:
            texts.append(f"{prose(40)} {passage} {prose(30)}")
        elif kind == 3:
            texts.append("\n".join([prose(8), *line[: r.randint(2, 5)], "", prose(5)]))
        else:
            texts.append("\n".join(prose(r.randint(3, 20)) for _ in range(r.randint(1, 6))))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def words(t):
    return (t or "").encode().split()


def repeated(rows, size, later=False):
    """Word numbers of each row covered by windows that occur elsewhere; with `later`, only by those that aren't the first."""
    seen = defaultdict(list)
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - size + 1):
            seen[tuple(w[a : a + size])].append((i, a))
    out = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, a in sorted(places)[1 if later else 0 :]:
                out[i].update(range(a, a + size))
    return out


# 3: BPE


def test_trie_bpe_equals_the_library():
    r = random.Random(5)
    library, own = Tokenizer.from_file(BPE), TrieBpe(BPE)
    parts = [" ", "  ", "\n", "\t", "a", "the", "123", "'s", "é", "日本", "😀", "\xa0", "!", "<|endoftext|>", "zz" * 40, "=" * 90, "\x1c", "\x85"]
    texts = [None, "", *("".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(1500)), *(t for _, t in corpus())]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert own.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_bpe_operator(docs, rows):
    out = {r["doc_id"]: r for r in op03_bpe.bpe_round_trip(docs, BPE).collect()}
    assert {i: r["decoded"] for i, r in out.items()} == {i: t or "" for i, t in rows}
    assert op03_bpe.bpe_digests(docs.where("false"), BPE).count() == 0


# 5: packing


def test_packing(spark, docs, rows):
    library = Tokenizer.from_file(BPE)
    got = op05_packing.pack(docs, BPE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= 2048
    assert op05_packing.pack(docs.where("false"), BPE).count() == 0


def test_packing_plan_covers_every_rank_once():
    counts = {1: 5, 3: 1, 100: 40, 256: 3, 412: 9, 612: 9, 700: 30, 1500: 8, 2048: 4}
    plan = op05_packing.plan_packing(counts)
    for n, c in counts.items():
        ranks = sorted(x for length, first, k, *_ in plan if length == n for x in range(first, first + k))
        assert ranks == list(range(c))
    totals = Counter()
    for n, _, k, sequence, _, _ in plan:
        for j in range(k):
            totals[sequence + j] += n
    assert max(totals.values()) <= 2048 and sum(totals.values()) == sum(n * c for n, c in counts.items())
    assert op05_packing.plan_packing({}) == []


def test_fast_encoder_equals_the_library(rows):
    library = Tokenizer.from_file(BPE)
    texts = [t for _, t in rows] + ["x <|endoftext|> y", "日本 a"]
    for t, ids in zip(texts, op05_packing.encode_texts(BPE, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


# 8 and 10: repeated passages


def test_debruijn(docs, rows):
    gone = repeated(rows, 35)
    for r in op10_debruijn.debruijn_dedup(docs).collect():
        w = words(rows[r["doc_id"]][1])
        assert r["n_words"] == len(w) and r["n_removed"] == len(gone[r["doc_id"]])
        assert r["kept_text"].encode() == b" ".join(x for i, x in enumerate(w) if i not in gone[r["doc_id"]])


def test_suffix_array(spark, docs, rows):
    later, every = repeated(rows, 50, later=True), repeated(rows, 50)
    got, first = defaultdict(set), defaultdict(set)
    for r in op08_suffix.suffix_dedup(docs).collect():
        (got if r["removed"] else first)[r["doc_id"]].update(range(r["start"], r["end"]))
    assert {i: s for i, s in got.items() if s} == {i: s for i, s in later.items() if s}
    assert all(got[i] | first[i] == every[i] for i, _ in rows)
    for r in op08_suffix.stage(spark, docs, "").collect():
        assert words(r["text"]) == [x for i, x in enumerate(words(rows[r["doc_id"]][1])) if i not in later[r["doc_id"]]]


def test_spans_are_merged_before_a_worker_holds_them(spark):
    text = " ".join(f"w{i}" for i in range(4000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, f"{text} end"), (4, "short")], "doc_id bigint, text string")
    own = op08_suffix.repeated_spans(docs.withColumnRenamed("doc_id", "rid")).collect()
    assert [[[len(r[c]) for c in ("later", "first")] for r in sorted(own)]] == [[[0, 1], [1, 0], [1, 0]]]
    assert not any(op08_suffix.suffix_dedup(docs)._jdf.queryExecution().toString().count(x) for x in ("MapInArrow", "ArrowEvalPython"))


def test_merged_lists_equal_the_union_of_each_row():
    r = random.Random(4)
    lists = [[(a := r.randrange(300), a + r.randint(1, 30)) for _ in range(r.randrange(12))] for _ in range(200)] + [[], [(0, 5), (5, 9)]]
    kind = pa.list_(pa.struct({"a": pa.int32(), "b": pa.int32()}))
    array = pa.array([[{"a": a, "b": b} for a, b in own] for own in lists], kind)
    for own, want in ((array, lists), (array.slice(7, 50), lists[7:57]), (array.slice(0, 0), [])):
        assert [[(x["start"], x["end"]) for x in row] for row in merged_lists(own).to_pylist()] == [merged(x) for x in want]


@pytest.mark.parametrize("module, made", [(op08_suffix, op08_suffix._suffixes), (op08_suffix, op08_suffix._with_windows), (op10_debruijn, op10_debruijn._occurrences)])
def test_a_worker_takes_minimisers_of_a_bounded_slice(monkeypatch, module, made):
    class Rows:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    taken, make = [], module.Minimisers
    monkeypatch.setattr(module, "Minimisers", lambda texts, *rest: taken.append(sum(map(len, texts))) or make(texts, *rest))
    texts = [f"word{i} other{i} " * 6000 for i in range(30)]
    batch = pa.RecordBatch.from_pydict({"rid": list(range(30)), "text": texts, "ps": [[0]] * 30})
    assert sum(out.num_rows for out in made(Rows(), 8, 50)([batch]))
    assert sum(taken) == sum(map(len, texts)) and max(taken) <= 1_000_000


@pytest.mark.parametrize("copies", [2, 3])
def test_repeated_and_null_ids(spark, copies):
    text = " ".join(f"w{i}" for i in range(60))
    twice = spark.createDataFrame([(7, text)] * copies + [(None, "short"), (None, text)], "doc_id bigint, text string")
    out = op10_debruijn.debruijn_dedup(twice).collect()
    assert sorted(r["n_removed"] for r in out) == [0] + [60] * (copies + 1)
    spans = op08_suffix.suffix_dedup(twice).collect()
    assert sum(r["removed"] for r in spans) == copies
    assert op10_debruijn.debruijn_dedup(twice.where("false")).count() == op08_suffix.suffix_dedup(twice.where("false")).count() == 0
    linked = op04_jaccard.jaccard_join(twice).collect()
    assert sorted(r["n_copies"] for r in linked) == [1] + [copies + 1] * (copies + 1)


# 6: lines


def test_lines(spark, docs, rows):
    seen, gone = set(), defaultdict(set)
    for i, t in rows:
        own = [k for k, x in enumerate((t or "").split("\n")) if x.split()]
        lines = (t or "").split("\n")
        for a, b, c in zip(own, own[1:], own[2:], strict=False):
            key = (lines[a], lines[b], lines[c])
            if key in seen:
                gone[i].update((a, b, c))
            seen.add(key)
    assert any(gone.values())
    for r in op06_lines.line_dedup(docs).collect():
        i, t = rows[r["doc_id"]]
        assert r["n_removed"] == len(gone[i])
        assert r["kept_text"] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]))
    clash = docs.selectExpr("*", "1 AS rid", "2 AS later", "3 AS row")
    assert op06_lines.stage(spark, clash, "").columns == clash.columns


# 4: Jaccard join


def test_jaccard(spark, docs, rows):
    sets, first = {}, {}
    for i, t in rows:
        w = tuple(words(t))
        if w and first.setdefault(w, i) == i:
            sets[i] = {w[k : k + 5] for k in range(max(1, len(w) - 4))}
    links = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(links) > 20
    top = {i: i for i in sets}
    for _ in rows:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    degree = Counter(x for pair in links for x in pair)
    for r in op04_jaccard.jaccard_join(docs).collect():
        i = r["doc_id"]
        rep = first.get(tuple(words(rows[i][1])), i)
        assert (r["text_id"], r["n_links"], r["class_id"]) == (rep, degree[rep], top.get(rep, i))
    kept = {r["doc_id"] for r in op04_jaccard.stage(spark, docs, "").collect()}
    assert kept == {i for i, t in rows if top.get(first.get(tuple(words(t)), i), i) == i}
    assert op04_jaccard.jaccard_join(docs.where("false")).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op04_jaccard, "BLOCK", 4)
    base = [f"w{i}" for i in range(120)]
    texts = [(i, " ".join(base[:i] + [f"e{i}"] + base[i + 1 :])) for i in range(30)]
    out = op04_jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert all(r["n_links"] == 29 and r["class_id"] == 0 for r in out)


def test_forest_depth():
    d = op04_jaccard.depth_for(0.8, 0.9995)
    assert 1 - (1 - 0.8**d) ** op04_jaccard.TREES >= 0.9995 > 1 - (1 - 0.8 ** (d + 1)) ** op04_jaccard.TREES


def test_prefixes_are_shortened_until_the_target_is_reached():
    shorter = op04_jaccard.next_depth
    assert shorter({1000: 50}, 8, 0.99999) == 8
    assert shorter({800: 50}, 8, 0.99999) == op04_jaccard.depth_for(0.8, 0.99999) == 5
    assert shorter({800: 50, 1000: 5000}, 8, 0.99999) == 7  # most links are surer
    assert shorter({}, 8, 0.99999) == 8


def test_sorted_tries_connect_the_texts_of_every_node(spark):
    random = np.random.default_rng(1)
    names = random.integers(0, 2, (150, op04_jaccard.TREES, op04_jaccard.DEPTH), np.uint64)  # two symbols: prefixes of every length
    sig = (names << (np.arange(op04_jaccard.DEPTH - 1, -1, -1, dtype=np.uint64) * np.uint64(op04_jaccard.SYMBOL))).sum(2, dtype=np.uint64)
    reps = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(sig)], "rep bigint, sig array<bigint>").repartition(7)
    edges = [tuple(r) for r in op04_jaccard._edges(reps, 5).collect()]
    for depth in range(5, op04_jaccard.DEPTH + 1):
        meets = op04_jaccard._meeting(sig, depth)
        top, own = np.arange(150), np.arange(150)
        for _ in range(150):
            for a, b, d in edges:
                if d >= depth:
                    top[a] = top[b] = min(top[a], top[b])
            own = np.where(meets, own[None, :], 150).min(1)
        assert (top == own).all()
        assert all(meets[a, b] for a, b, d in edges if d >= depth)


def test_recall_of_planted_pairs(spark):
    texts = []
    for i in range(600):  # k changed words of 400, five or more apart, change 5 k of 396 shingles
        words_ = [f"t{i}w{j}" for j in range(400)]
        texts.append((2 * i, " ".join(words_)))
        for k in range(i % 5 + 4):
            words_[20 + 40 * k] = "x"
        texts.append((2 * i + 1, " ".join(words_)))
    out = {r["doc_id"]: r for r in op04_jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    alike = {k: (396 - 5 * k) / (396 + 5 * k) for k in range(4, 9)}
    assert min(alike.values()) < 0.82 and max(alike.values()) > 0.9
    assert all(out[i]["n_links"] == 1 and out[i]["class_id"] == i - i % 2 for i in range(1200))


def test_a_text_goes_to_the_blocks_in_which_it_meets_another(spark, monkeypatch):
    monkeypatch.setattr(op04_jaccard, "BLOCK", 8)
    base = [f"w{i}" for i in range(4200)]
    texts = [(i, " ".join(base[4 * i : 4 * i + 100])) for i in range(1000)]  # each like the next ones alone: one group
    rows = spark.createDataFrame(texts, "rid bigint, text string")
    reps = op04_jaccard._signed(rows).withColumnRenamed("rid", "rep")
    groups = components(op04_jaccard._edges(reps, 6).select("a", "b"))
    assert groups.select("component").distinct().count() < 20
    assert op04_jaccard._dealt(groups, reps, 6, None).count() < 40 * 1000  # all blocks: 125 for each text
    out = op04_jaccard.jaccard_join(rows.withColumnRenamed("rid", "doc_id")).collect()
    want = {d for d in range(1, 24) if 5 * (96 - 4 * d) >= 4 * (96 + 4 * d)}
    assert all(r["n_links"] == sum((r["doc_id"] + d < 1000) + (r["doc_id"] >= d) for d in want) for r in out)


@pytest.mark.parametrize("most", [5, 1000])
def test_components(spark, most):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (102, 103), (7, 7)]
    table_ = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(table_, most=most).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
    assert components(table_.limit(0), most=most).count() == 0


def test_contraction():
    random_ = np.random.default_rng(2)
    a, b = random_.integers(0, 400, (2, 260))
    top = np.arange(400)
    for _ in range(400):
        for x, y in zip(a, b, strict=True):
            top[x] = top[y] = min(top[x], top[y])
    nodes, roots = contracted(a, b)
    assert dict(zip(nodes, roots, strict=True)) == {i: t for i, t in enumerate(top) if i != t}
    assert [x.tolist() for x in contracted(nodes, roots)] == [nodes.tolist(), roots.tolist()]


# 1: fingerprints


def test_fingerprints(spark, docs, rows):
    out = {r["doc_id"]: r for r in op01_imatch.fingerprints(docs, band=(0.0, 0.9)).collect()}
    order = sorted(rows, reverse=True)
    prints = defaultdict(set)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
        prints[t].add(out[i]["fingerprint"])
        prints[edited].add(out[i]["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefgh", k=7)) for _ in range(3000)]
    other = [(i, " ".join(r.choices(vocabulary, k=150))) for i in range(80)]
    likeness = op01_imatch.fingerprints(spark.createDataFrame(other, "doc_id bigint, text string"), band=(0.0, 0.9)).collect()
    assert sum(x["near_edited"] for x in likeness) > 5 * sum(x["near_next"] for x in likeness)
    assert "Python" not in op01_imatch.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert op01_imatch.fingerprints(docs.where("false")).count() == 0
    assert op01_imatch.fingerprints(docs.where("doc_id = 5")).first()["near_next"] == 1.0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None), (None, "d e f")], "doc_id bigint, text string")
    assert op01_imatch.fingerprints(twice).count() == 4


def test_every_band_term_of_a_long_text_counts(spark):
    own = [f"term{i}" for i in range(2000)]
    texts = [(3, " ".join(own)), (2, " ".join([*own[:-1], "other"])), (1, f"{own[-1]} other")]
    out = {r["doc_id"]: r["near_next"] for r in op01_imatch.fingerprints(spark.createDataFrame(texts, "doc_id bigint, text string"), band=(0.0, 1.0)).collect()}
    assert 0.99 < out[3] < 1


def test_families_are_found_by_one_pass_over_the_terms(spark):
    r = random.Random(3)
    own = spark.createDataFrame([(sorted(r.randrange(-(2**63), 2**63) for _ in range(100)),), ([],)], "found array<bigint>")
    made = own.select("found", op01_imatch.subsets(F.col("found")).alias("sets"), F.transform("found", lambda t: F.xxhash64(F.array(t))).alias("single"))
    assert made._jdf.queryExecution().analyzed().toString().count("shiftright") == 1
    full, none = made.collect()
    cells = Counter(t >> 58 for t in full["found"])
    assert [len(x) > 0 for x in full["sets"]] == [c in cells for c in range(-32, 32)]
    alone = {t >> 58: h for t, h in zip(full["found"], full["single"], strict=True) if cells[t >> 58] == 1}
    assert all(full["sets"][c + 32][0] == h for c, h in alone.items())
    assert not any(none["sets"])


# 2: quality


def test_base_columns(docs, rows):
    for r in op02_quality.measures(docs).collect():
        t = rows[r["doc_id"]][1] or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.split()]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), len(covered))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))


def test_exact_bounds():
    for n, p, k in ((50, 0.1, 3), (400, 0.01, 0), (30, 0.5, 29)):
        assert op02_quality.binomial_cdf(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert op02_quality.chosen([3.0, 2.0, 1.0], [0, 1, 60], 1000, 0.02, 0.01) == 2.0
    assert op02_quality.chosen([3.0], [0], 10, 0.02, 0.01) == math.inf
    assert op02_quality.chosen([3.0], [0], 0, 0.02, 0.01) == math.inf


def test_quality_learns_a_rule(spark):
    r = random.Random(2)
    text = lambda junk: " ".join("".join(r.choices("abcdefgh", k=5)) + ("$$$" if junk else "") for _ in range(80))
    data = [(i, text(i % 10 == 0), "en") for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(3000)], "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x["kept"] for x in op02_quality.quality(docs, labels).collect()}
    assert not any(got[i] for i in range(0, 3000, 10))
    assert sum(not k for i, k in got.items() if i % 10) <= 0.05 * 2700
    none = op02_quality.quality(docs.limit(5), labels.where("false"))
    assert all(x["kept"] for x in none.collect())


def test_the_exact_test_decides_where_cutoffs_stop(spark):
    names = op02_quality.MEASURES
    measured = spark.range(80_000).selectExpr("id AS doc_id", "'en' AS lang", f"pmod(xxhash64(id), 1000003) / 1000003D AS {names[0]}", *[f"0D AS {m}" for m in names[1:]])
    (found,) = op02_quality.cutoffs_of(measured, spark.range(80_000).selectExpr("id AS doc_id", "1 AS quality")).values()
    assert 1 - op02_quality.RISK / len(names) < found[0] < 0.995
    assert op02_quality.tails_of(0.01)[-1] == 1


# 7: language model


def test_suffix_tree(docs, rows):
    train = docs.where("doc_id % 5 <> 1")
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    c = Counter(w for i, own in tokens.items() if i % 5 != 1 for w in own)
    n, v = sum(c.values()), len(c)
    out = {r["doc_id"]: r for r in op07_pst.scores(docs, train).collect()}
    for i, own in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert out[i]["base_score"] == pytest.approx(base) and out[i]["train_tokens"] == n
        assert (out[i]["n_tokens"], out[i]["n_known"]) == (len(own), sum(c[w] > 0 for w in own))
    assert op07_pst.scores(docs, train.where("false")).count() == len(rows)
    assert op07_pst.scores(docs.where("false"), train).count() == 0


def test_suffix_tree_is_a_distribution(docs):
    tree, _ = op07_pst.learn(docs.where("doc_id >= 8"))
    assert tree.size and len(tree.contexts)
    rare = tree.v - tree.size
    for past in ([], [0], [1, 0]):
        ids = np.concatenate([[*past, x] for x in range(tree.size)]).astype(np.int64)
        start = np.repeat(np.arange(tree.size) * (len(past) + 1), len(past) + 1)
        p = 10 ** tree.log10(ids, start)[len(past) :: len(past) + 1]
        left = 10 ** tree.log10(np.array([*past, -1]), np.zeros(len(past) + 1, np.int64))[-1]
        # words without a number have one occurrence each
        rest = left * (rare * (1 - tree.root_discount) / tree.n + tree.root_discount * tree.v / tree.n)
        assert p.sum() + rest == pytest.approx(1, abs=1e-6)


def test_suffix_tree_keeps_rare_states_of_a_large_corpus(spark):
    filler = " ".join(f"f{i % 50}" for i in range(2000))
    data = [(i, filler) for i in range(500)] + [(500 + i, f"alpha beta x{i}") for i in range(20)]
    asked = spark.createDataFrame([(0, "alpha beta"), (1, "beta alpha")], "doc_id bigint, text string")
    out = {r["doc_id"]: r["score"] for r in op07_pst.scores(asked, spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)).collect()}
    assert out[0] > out[1] + 3


def brute_score(tokens, i, train, depth):
    """log10 probability of token i by the definition: recursive, over exact counts of all training sequences."""
    n, v, n1, n2, counts = train
    root = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    @functools.cache
    def follow(ctx):
        return {s[-1]: c for s, c in counts.items() if len(s) == len(ctx) + 1 and s[:-1] == ctx and c >= 2}

    def varied(ctx):
        seen = follow(ctx)
        return bool(seen) and max(seen.values()) < counts[ctx] and (len(ctx) == 1 or varied(ctx[1:]))

    @functools.cache
    def state(ctx):
        """What a state leaves to its suffix, None where the context is none."""
        total, seen = counts.get(ctx, 0), follow(ctx)
        if total < 2 or not seen or (len(ctx) > 1 and not varied(ctx[1:])):
            return None
        d, rest, rest_q = 0.0, 1.0, 1.0
        for w, c in seen.items():
            q = p(w, ctx[1:])
            d += c / total * math.log(c / total / q)
            rest, rest_q = rest - c / total, rest_q - q
        rest, rest_q = max(rest, 1e-12), max(rest_q, 1e-12)
        return max(1 - sum((c - 0.5) / total for c in seen.values()), 1e-12) if d + rest * math.log(rest / rest_q) >= op07_pst.LEAST_DIVERGENCE else None

    def p(w, ctx):
        if not ctx:
            return (counts[(w,)] - root) / n if (w,) in counts else root * v / n
        left = state(ctx)
        if left is None:
            return p(w, ctx[1:])
        return (follow(ctx)[w] - 0.5) / counts[ctx] + left * p(w, ctx[1:]) if w in follow(ctx) else left * p(w, ctx[1:])

    return math.log10(p(tokens[i], tuple(tokens[max(0, i - depth) : i])))


def test_suffix_tree_scores_equal_the_definition(spark):
    r = random.Random(6)
    phrase = r.choices("abcdef", k=12)
    data = [(i, " ".join([*r.choices("abcdefgh", k=r.randint(0, 12)), *phrase[: r.randint(0, 12)]])) for i in range(40)] + [(40, None), (41, "a b zz a b"), (41, "a b zz a b")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    train = [(t or "").split() + [""] for i, t in data if i % 4]
    counts = Counter(tuple(own[a : a + k]) for own in train for k in range(1, 6) for a in range(len(own) - k + 1))
    single = [c for s, c in counts.items() if len(s) == 1]
    stats = (sum(single), len(single), single.count(1), single.count(2), counts)
    out = {x["doc_id"]: x["score"] for x in op07_pst.scores(docs, docs.where("doc_id % 4 <> 0")).collect()}
    for i, t in data:
        own = (t or "").split() + [""]
        assert out[i] == pytest.approx(sum(brute_score(own, k, stats, op07_pst.DEPTH) for k in range(len(own))))
    inside = [x["score"] for x in op07_pst.scores(docs, F.col("doc_id") % 4 != 0).collect()]
    assert sorted(inside) == pytest.approx(sorted(out[i] for i, _ in data))


def test_suffix_tree_states_do_not_depend_on_the_filter(spark, monkeypatch):
    r = random.Random(3)
    phrases = [[f"w{r.randrange(60)}" for _ in range(6)] for _ in range(12)]
    data = [(i, " ".join(w for _ in range(8) for w in r.choice(phrases)[: r.randint(2, 6)])) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    exact = {x["doc_id"]: x["score"] for x in op07_pst.scores(docs, F.lit(True)).collect()}
    monkeypatch.setattr(op07_pst, "passes", lambda bits, grams: np.ones(len(grams), bool))
    full = {x["doc_id"]: x["score"] for x in op07_pst.scores(docs, F.lit(True)).collect()}
    assert full == pytest.approx(exact)


def test_suffix_tree_learns_from_packed_buckets(spark):
    r = random.Random(4)
    data = [(" ".join(f"w{r.randrange(400)}" for _ in range(3000)),) for _ in range(40)]
    tokens = op07_pst.written(op07_pst.tokenised(spark.createDataFrame(data, "text string").selectExpr("0 AS rid", "text", "true AS learned")))
    tree, known = op07_pst.learned_from(tokens)
    assert tree.entries.count() > 20_000 and known.count() <= 4


def test_a_level_has_two_rows_for_each_bucket_at_most(spark, monkeypatch):
    levels, run = [], op07_pst.grown
    monkeypatch.setattr(op07_pst, "grown", lambda *given: levels.append(run(*given)) or levels[-1])
    monkeypatch.setattr(op07_pst, "discard", lambda *tables: None)
    op07_pst.learn(spark.createDataFrame([(f"a b c d x{i % 5} a b x{i % 3} c",) for i in range(200)], "text string").repartition(8))
    assert levels[0] is not None
    assert all(x.groupBy("bucket", "kind").count().where("count > 1").count() == 0 for x in levels if x is not None)


def test_a_part_of_the_slices_asks_at_a_time(spark, monkeypatch):
    data = [(i, f"alpha beta gamma x{i % 7} delta") for i in range(64)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(16)
    asking, run = [], op07_pst._asked

    def counted(tokens, *rest):
        asking.append(tokens.count())
        return run(tokens, *rest)

    monkeypatch.setattr(op07_pst, "_asked", counted)
    assert op07_pst.scores(docs, F.lit(True)).count() == 64
    assert sum(asking) >= 8 and max(asking) <= sum(asking) / 2


def test_a_filter_grows_with_its_entries(spark, monkeypatch):
    monkeypatch.setattr(op07_pst, "MOST_BITS", 15)
    bits = op07_pst.filter_of(spark.range(20_000).select(F.xxhash64("id").alias("g")))
    assert np.unpackbits(bits).mean() < 0.3
    asked = np.array([x["g"] for x in spark.range(20_000).select(F.xxhash64("id").alias("g")).collect()], np.int64).view(np.uint64)
    assert op07_pst.passes(bits, asked).all()


# 9: toxicity


def test_chain_equals_enumeration():
    r = np.random.default_rng(1)
    scores, trans = r.normal(size=7), r.normal(size=(2, 2))
    lengths = np.array([4, 0, 3])
    marginal, expected, log_z = op09_toxicity.chain(scores, lengths, trans)
    at, pairs = 0, np.zeros((2, 2))
    for k, n in enumerate(lengths):
        weight = {}
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            s = sum(scores[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)) + (trans[0, 1] * y[0] if n else 0)
            weight[tuple(y)] = math.exp(s)
        z = sum(weight.values())
        for i in range(n):
            assert marginal[at + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)
        if n:
            assert log_z[k] == pytest.approx(math.log(z))
        for y, w in weight.items():
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += w / z
        at += n
    assert expected == pytest.approx(pairs)


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(3)
    plain = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    data = []
    for i in range(600):
        own = r.choices(plain, k=60)
        if i % 4 == 0:
            own[r.randrange(60)] = r.choice(["grumsh,", "Grumshy", "vlakka", "vlakkan!"])
        data.append((i, " ".join(own)))
    data += [(600, None), (601, "")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    model = op09_toxicity.train([t for i, t in data[:400]], [int(i % 4 == 0) for i, _ in data[:400]])
    out = {x["doc_id"]: x for x in op09_toxicity.toxicity(docs, model).collect()}
    assert all((out[i]["score"] >= 0.5) == (i % 4 == 0) for i in range(400, 600))
    assert out[600]["score"] == out[601]["score"] < 0.5
    for i in range(400, 600, 4):
        assert [data[i][1][s["start"] : s["end"]].lower().strip(",!y")[:6] for s in out[i]["spans"]][0] in ("grumsh", "vlakka")
    assert op09_toxicity.toxicity(docs.where("false"), model).count() == 0


# pipeline


def test_pipeline_stages(spark, rows, tmp_path):
    import corpus_pipeline

    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == corpus_pipeline.run(spark, str(tmp_path)).count() > 0
