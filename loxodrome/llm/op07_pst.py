"""Language-model scores by a probabilistic suffix tree over words.

The tree's root is a smoothed distribution of words. A context of one to DEPTH preceding words becomes a state if the words after it
are distributed otherwise than after its own suffix (a divergence test; where the suffix was always followed by one
word, so is the context, which then is no state). A word's probability is taken in the longest
suffix of its past that is a state; what a state hasn't seen often enough it leaves to its suffix. Counts are exact, and a
context takes part from its second occurrence on, at any size of corpus, so states grow with it: states and the words after them are
written tables. Their rows are packed columns of a bucket of hashes, which workers merge and look up as numbers.

Scoring looks sequences up in those tables: a slice of texts asks each bucket of the tables once for every distinct sequence, and
the answers come back to the slice's plan. A part of the slices asks at a time, so that disk
holds no more than a part of them. Workers hold the most frequent entries and a bit filter of all longer ones,
both bounded; these save lookups and don't change results.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fan_out, gathered, in_fold, released, slices, table, written
from .spans import keyed, mixed

ORACLE_SQL = None
#: The longest contexts, in words.
DEPTH = 4
#: Least counts of a context and of a context with the word after it.
CONTEXT_COUNT, PAIR_COUNT = 2, 2
#: Entries of at least this share of the training tokens are held by workers; all others are looked up.
HOT_SHARE = 5e-7
#: Bits of a filter: at least so many for each entry, up to 2**27 in all (16 MB); beyond that LEAST_BITS for each entry, up to four times as many
#: in all (64 MB). A fuller filter only lets more lookups through.
FILTER_BITS, MOST_BITS, LEAST_BITS = 16, 27, 4
#: Training tokens for each bucket of the counting and of the lookups, and buckets that a small table has at most. Pairs travel from every bucket to every other.
BUCKET_TOKENS, FEW_BUCKETS = 1_000_000, 12
#: Share of the training tokens from which the pairs of one context are dealt to many buckets; there are at most 4000 such contexts a length.
HOT_CONTEXT = 1 / 4000
#: Parts in which slices look sequences up, and parts in which levels are put together, one after the other.
ROUNDS, JOINS = 4, 2
#: Least divergence (nats) of a state from its suffix, and the count that is left over from each stored word.
LEAST_DIVERGENCE, DISCOUNT = 0.01, 0.5
HELD_OUT = 1


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens (words with A-Z in lower case, and the end, which is empty), all tokens as places among them, and the number of tokens of each text."""
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.array(texts, pa.large_string()).fill_null("")))
    words = pa.compute.list_flatten(split)
    is_word = pa.compute.binary_length(words).to_numpy() > 0  # white space at either end leaves an empty one
    lengths = np.bincount(pa.compute.list_parent_indices(split).to_numpy()[is_word], minlength=len(texts)) + 1
    coded = words.filter(pa.array(is_word)).dictionary_encode()
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, ["", *coded.dictionary.to_pylist()]), np.uint64, len(coded.dictionary) + 1)
    at = np.zeros(int(lengths.sum()), np.int64)
    inside = np.ones(len(at), bool)
    inside[np.cumsum(lengths) - 1] = False
    at[inside] = coded.indices.to_numpy() + 1
    return distinct, at, lengths


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys, where each distinct one begins in it, and how many there are of each."""
    order = np.argsort(keys)
    own = keys[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return order, first, np.diff(np.r_[first, len(own)])


def longer(grams: np.ndarray) -> np.ndarray:
    """Hashes of the sequences one word longer that end at each token but the first: from its own and from that of the token before it."""
    return _joined(grams[:-1], grams[1:])


def _joined(ctx: np.ndarray, up: np.ndarray) -> np.ndarray:
    return mixed(up * np.uint64(0x9E3779B97F4A7C15) + ctx)


def _blob(*arrays: np.ndarray, compressed: bool = True) -> bytes:
    """Arrays as one string, compressed or not."""
    raw = b"".join([np.array([x.nbytes for x in arrays], np.int64).tobytes(), *(x.tobytes() for x in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if compressed else bytes(8) + raw


def _arrays(blob: bytes, *types: str) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], size, codec="zstd", asbytes=True) if size else blob[8:]
    ends = np.cumsum(np.r_[8 * len(types), np.frombuffer(raw, np.int64, len(types))])
    return [np.frombuffer(raw[a:b], t) for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), types, strict=True)]


def _steps(sorted_hashes: np.ndarray) -> np.ndarray:
    """Steps between sorted hashes byte by byte, which compresses best."""
    return np.ascontiguousarray(np.diff(sorted_hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _from_steps(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _stacked(blobs: list[bytes], *types: str) -> list[np.ndarray]:
    """The arrays of all blobs, one blob after the other."""
    return [np.concatenate(x) for x in zip(*([np.zeros(0, t) for t in types], *(_arrays(b, *types) for b in blobs)), strict=True)]


def bucket_of(grams: np.ndarray, buckets: np.uint64) -> np.ndarray:
    """Buckets are ranges of the low half of a hash, so that each has a range of a filter's bits."""
    return ((grams & np.uint64(0xFFFFFFFF)) * buckets) >> np.uint64(32)


#: Of a slice of texts: their keys, their numbers of tokens, whether they are learned from, the distinct tokens (by their hashes, the most frequent
#: first), and the tokens as places among those, byte by byte, which compresses best.
_SLICE = ("i8", "i8", "u1", "u8", "u1")


def _sliced(blob: bytes) -> list[np.ndarray]:
    rid, lengths, learned, distinct, planes = _arrays(blob, *_SLICE)
    return [rid, lengths, learned, distinct, np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()]


def tokenised(rows: DataFrame) -> DataFrame:
    """(slice, n): slices of the texts of rows (rid, text, learned) and the number of their tokens that are learned from."""

    def run(batches):
        for part in slices(batches):
            distinct, at, lengths = encoded(part["text"])
            learned = np.array(part["learned"], np.uint8)
            order = np.argsort(-np.bincount(at, minlength=len(distinct)), kind="stable")
            number = np.empty(len(order), "<u4")
            number[order] = np.arange(len(order), dtype=np.uint32)
            planes = np.ascontiguousarray(number[at].view(np.uint8).reshape(-1, 4).T)
            blob = _blob(np.array(part["rid"], np.int64), lengths, learned, distinct[order], planes)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([blob], pa.binary()), "n": pa.array([int(lengths[learned > 0].sum())], pa.int64())})

    return rows.select("rid", "text", "learned").mapInArrow(run, "slice binary, n bigint")


def _tokens_in(batches):
    """Hashes of the distinct tokens, those that are learned from as places among them, and their places in their texts, slice by slice."""
    for batch in batches:
        for blob in batch.column("slice").to_pylist():
            _, lengths, learned, distinct, at = _sliced(blob)
            at = at[np.repeat(learned, lengths).astype(bool)]
            lengths = lengths[learned > 0]
            yield distinct, at, np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _parts(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the numbers of its rows."""
    most = int(buckets.max(initial=0))
    order = np.argsort(buckets.astype(np.uint16) if most < 1 << 16 else buckets, kind="stable")  # numbers of 16 bits are sorted by their digits
    edges = np.flatnonzero(np.r_[True, np.diff(buckets[order]) > 0, True]) if len(order) else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(buckets[order[i]]), order[i:j]


def _dealt(buckets: np.ndarray, pack) -> pa.RecordBatch:
    """Rows (bucket, pairs) of what belongs to each bucket, packed from the numbers of its rows."""
    rows = [(k, pack(at)) for k, at in _parts(buckets.astype(np.int64))]
    return pa.RecordBatch.from_pydict({"bucket": pa.array([k for k, _ in rows], pa.int64()), "pairs": pa.array([b for _, b in rows], pa.binary())})


#: Tokens that a worker holds before it sends their counts on.
HELD = 1_000_000


#: Of a level's sequences: hashes, counts, the probability of the last word after the others, what a state adds (NaN where the context is none), whether it
#: may be a context. Of words only the first two.
_GRAMS = ("u8", "i8", "f4", "f4", "u1")
#: Of states: hashes, counts, what is left to the suffix.
_CONTEXTS = ("u8", "i8", "f4")
#: Rows of a level: packed sequences (kind 0) or states (kind 1) of a bucket; the number of possible contexts of the next level or of states, and the largest count of one.
_LEVEL = "bucket bigint, kind int, n bigint, most bigint, blob binary"


def unigrams(tokens: DataFrame, buckets: np.uint64) -> DataFrame:
    """Rows of a level with how often each token occurs in slices, and the numbers `v` of tokens, `n1`, `n2` of those that occur once and twice; counted in the workers before the shuffle, and then by buckets."""

    def run(batches):
        held, room = [], 0

        def flush():
            g, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, first, _ = runs_of(g)
            g, c = g[order[first]], np.add.reduceat(c[order], first)
            return _dealt(bucket_of(g, buckets), lambda at: _blob(g[at], c[at]))

        for distinct, at, _ in _tokens_in(batches):
            c = np.bincount(at, minlength=len(distinct))
            held.append((distinct[c > 0], c[c > 0]))
            room += len(held[-1][0])
            if room > HELD:
                yield flush()
                room = 0
        if room:
            yield flush()

    def merge(own: pa.Table) -> pa.Table:
        g, c = _stacked(own["pairs"].to_pylist(), "u8", "i8")
        order, first, _ = runs_of(g)
        g, c = g[order[first]], np.add.reduceat(c[order], first)
        none = np.zeros(0, np.uint8)
        row = {"bucket": own["bucket"][0].as_py(), "kind": 0, "n": int((c >= CONTEXT_COUNT).sum()), "most": int(c.max()), "blob": _blob(g, c, none, none, none)}
        return pa.Table.from_pylist([row | {"v": len(g), "n1": int((c == 1).sum()), "n2": int((c == 2).sum())}], _UNIGRAMS)

    return tokens.mapInArrow(run, "bucket bigint, pairs binary").groupBy("bucket").applyInArrow(merge, f"{_LEVEL}, v bigint, n1 bigint, n2 bigint")


_ROWS = pa.schema({"bucket": pa.int64(), "kind": pa.int32(), "n": pa.int64(), "most": pa.int64(), "blob": pa.binary()})
_UNIGRAMS = pa.schema([*_ROWS, *((k, pa.int64()) for k in ("v", "n1", "n2"))])


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the sequences that may be contexts of the next level."""
    g, c, _, _, may = _arrays(blob, *_GRAMS)
    at = (c >= CONTEXT_COUNT) & (may > 0) if len(may) else c >= CONTEXT_COUNT
    return g[at], c[at]


def filter_of(entries: DataFrame, n: int | None = None, hashes=lambda batch: [batch.column("g").to_numpy().view(np.uint64)]) -> np.ndarray | None:
    """Bytes of a filter of the column g, or of the `n` hashes that `hashes` finds in a batch; None where there is none. Its size is bounded; made by parts in the workers."""
    n = entries.count() if n is None else n
    if not n:
        return None
    power = min(MOST_BITS, max(15, math.ceil(math.log2(FILTER_BITS * n))))
    power = min(MOST_BITS + 2, max(power, math.ceil(math.log2(LEAST_BITS * n))))

    def run(batches):
        for batch in batches:
            for g in hashes(batch):
                if not len(g):
                    continue
                at = np.unique((g & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - power)).astype(np.int64)
                parts, of = np.unique(at >> 15, return_inverse=True)
                bits = np.zeros((len(parts), 4096), np.uint8)
                first = np.flatnonzero(np.r_[True, np.diff(at >> 3) > 0])
                bits[of[first], at[first] >> 3 & 4095] = np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), first)
                yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int64()), "bits": pa.array([x.tobytes() for x in bits], pa.binary())})

    with released(entries.sparkSession):
        parts = entries.mapInArrow(run, "part bigint, bits binary").groupBy("part").agg(F.expr("bitmap_or_agg(bits)").alias("bits")).toArrow()
    out = np.zeros((1 << power - 15, 4096), np.uint8)
    out[parts["part"].to_numpy()] = np.frombuffer(b"".join(parts["bits"].to_pylist()), np.uint8).reshape(-1, 4096)
    return out.ravel()


def passes(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = (grams & np.uint64(0xFFFFFFFF)) >> np.uint64(30 - len(bits).bit_length())
    return (bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


_PAIRS = ("u1", "u4", "u1", "u1", "u4")


def _packed(ctx: np.ndarray, up: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts of pairs: distinct contexts and their runs, distinct suffixes and their numbers, counts."""
    order, first, runs = runs_of(ctx)
    ups = up[order]
    by, begin, sizes = runs_of(ups)
    number = np.empty(len(by), np.uint32)
    number[by] = np.repeat(np.arange(len(begin), dtype=np.uint32), sizes)
    planes = np.ascontiguousarray(number.view(np.uint8).reshape(-1, 4).T)
    return _blob(_steps(ctx[order[first]]), runs.astype(np.uint32), _steps(ups[by[begin]]), planes, counts[order].astype(np.uint32))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts, runs, suffixes, planes, counts = _arrays(blob, *_PAIRS)
    number = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    return np.repeat(_from_steps(contexts), runs), _from_steps(suffixes)[number], counts.astype(np.int64)


#: Of pairs on their way between buckets: contexts, suffixes with the word after the context, counts, counts of the contexts; then also the probability that the
#: suffix gives and whether the pair may be a context.
_ASKED = ("u8", "u8", "i8", "i8")
_FOUND = (*_ASKED, "f8", "u1")
_EXCHANGE = pa.schema({"of": pa.int64(), "to": pa.int64(), "blob": pa.binary()})


def followers(tokens: DataFrame, before: DataFrame, bits: np.ndarray, length: int, n: int, buckets: np.uint64) -> DataFrame:
    """Written table (of, to, blob): counts of the contexts of `length` words with the word after them, PAIR_COUNT or more, packed by the buckets of the context (`of`) and of its suffix with that word (`to`); and
    under `of` -1 the contexts that different words follow, by their own bucket: their largest count and their total.

    Pairs are dealt to buckets by their context; those of the contexts that hold a share of HOT_CONTEXT of all tokens by their
    own hash, with totals that `before` has. Workers count what they hold before. The filter only spares them pairs: a bucket takes the contexts that `before` has.
    """

    def hottest(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                g, c = _open(blob)
                yield pa.RecordBatch.from_pydict({"g": g[c >= share].view(np.int64), "c": c[c >= share]})

    share = max(2, HOT_CONTEXT * n)
    found = before.where((F.col("kind") == 0) & (F.col("most") >= share)).select("blob").mapInArrow(hottest, "g bigint, c bigint").toArrow()
    order = np.argsort(found["g"].to_numpy().view(np.uint64))
    shared = tokens.sparkSession.sparkContext.broadcast((bits, found["g"].to_numpy().view(np.uint64)[order], found["c"].to_numpy()[order]))

    def run(batches):
        bits, hot, _ = shared.value
        held: list[np.ndarray] = []
        room = 0

        def flush():
            ctx, up = np.concatenate(held, 1)
            held.clear()
            g = _joined(ctx, up)
            order, first, counts = runs_of(g)
            g, ctx, up = g[order[first]], ctx[order[first]], up[order[first]]
            return _dealt(bucket_of(np.where(held_in(hot, ctx)[1], g, ctx), buckets), lambda at: _packed(ctx[at], up[at], counts[at]))

        for distinct, at, place in _tokens_in(batches):
            if len(at) <= length:
                continue
            grams = distinct[at]
            for _ in range(length - 1):
                grams = longer(grams)
            at = np.flatnonzero(place[length:] >= length)
            at = at[passes(bits, grams[at])]
            held.append(np.stack([grams[at], grams[at + 1]]))
            room += len(at)
            if room > HELD:
                yield flush()
                room = 0
        if room:
            yield flush()

    def merge(own: pa.Table, before: pa.Table) -> pa.Table:
        _, hot, hot_totals = shared.value
        if not own.num_rows:
            return _EXCHANGE.empty_table()
        ctx, up, c = (np.concatenate(x) for x in zip(*map(_unpacked, own["pairs"].to_pylist()), strict=True))
        contexts = np.sort(_stacked(before["blob"].to_pylist(), "u8")[0])
        at = np.flatnonzero(held_in(contexts, ctx)[1] | held_in(hot, ctx)[1])
        order, first, _ = runs_of(_joined(ctx[at], up[at]))
        if not len(first):
            return _EXCHANGE.empty_table()
        order = at[order]
        ctx, up, c = ctx[order[first]], up[order[first]], np.add.reduceat(c[order], first)
        order, first, runs = runs_of(ctx)
        ctx, up, c = ctx[order], up[order], c[order]
        total, top = np.add.reduceat(c, first), np.maximum.reduceat(c, first)
        found, is_hot = held_in(hot, ctx[first])
        total[is_hot] = hot_totals[found[is_hot]]
        varied = (top >= PAIR_COUNT) & (top < total)
        own = [x[varied] for x in (ctx[first], top, total)]
        rows = [(-1, k, _blob(*(x[at] for x in own), compressed=False)) for k, at in _parts(bucket_of(own[0], buckets).astype(np.int64))]
        total = np.repeat(total, runs)
        kept = np.flatnonzero(c >= PAIR_COUNT)
        ctx, up, c, total = ctx[kept], up[kept], c[kept], total[kept]
        of, to = bucket_of(ctx, buckets).astype(np.int64), bucket_of(up, buckets).astype(np.int64)
        for _, mine in _parts(of):
            for k, at in _parts(to[mine]):
                at = mine[at]
                rows.append((int(of[at[0]]), k, _blob(ctx[at], up[at], c[at], total[at], compressed=False)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _EXCHANGE.types, strict=True)], _EXCHANGE) if rows else _EXCHANGE.empty_table()

    def contexts_of(batches):
        for batch in batches:
            blobs = [_blob(_open(b)[0], compressed=False) for b in batch.column("blob").to_pylist()]
            yield pa.RecordBatch.from_pydict({"bucket": batch.column("bucket"), "blob": pa.array(blobs, pa.binary())})

    counted = tokens.select("slice").mapInArrow(run, "bucket bigint, pairs binary")
    contexts = before.where("kind = 0 AND n > 0").select("bucket", "blob").mapInArrow(contexts_of, "bucket bigint, blob binary")
    out = written(counted.groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(merge, "of bigint, to bigint, blob binary"))
    shared.destroy()
    return out


def held_in(own: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted one is among own, which is sorted, and whether it is there."""
    at = np.minimum(np.searchsorted(own, wanted), max(len(own) - 1, 0))
    return at, own[at] == wanted if len(own) else np.zeros(len(wanted), bool)


def grown(tokens: DataFrame, before: DataFrame, length: int, tree: Tree, buckets: np.uint64) -> DataFrame | None:
    """The next level, None where no context is left: a written table of the sequences of its contexts with a word, and of the contexts that are states.

    Pairs ask the bucket of their suffix with the word for its probability `q`, and whether the suffix was followed by different words: then they
    may be contexts of the next level. What a state adds to log10 of its suffix's probability is `a`, log10 of what it leaves to it `b`.
    """
    n = before.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    bits = filter_of(before.where("kind = 0").select("blob"), n, lambda batch: (_open(b)[0] for b in batch.column("blob").to_pylist()))
    if bits is None:
        return None
    pairs = followers(tokens, before, bits, length, tree.n, buckets)
    discount, size = tree.root_discount, tree.n

    def find(pairs: pa.Table, before: pa.Table) -> pa.Table:
        g, r = _known(before, discount, size)
        of, blobs = pairs["of"].to_pylist(), pairs["blob"].to_pylist()
        varied, top, total = _stacked([b for k, b in zip(of, blobs, strict=True) if k < 0], "u8", "i8", "i8")
        order, first, _ = runs_of(varied)  # a context that many buckets count differs if its largest count does
        varied = varied[order[first]][np.maximum.reduceat(top[order], first) < total[order[first]]] if len(first) else varied
        rows = []
        for k, blob in zip(of, blobs, strict=True):
            if k < 0:
                continue
            ctx, up, c, total = _arrays(blob, *_ASKED)
            at, has = held_in(g, up)
            may = held_in(varied, up)[1].astype(np.uint8)
            rows.append((k, _blob(ctx[has], up[has], c[has], total[has], r[at[has]], may[has], compressed=False)))
        return pa.table({"of": pa.array([k for k, _ in rows], pa.int64()), "blob": pa.array([b for _, b in rows], pa.binary())})

    def states(own: pa.Table) -> pa.Table:
        ctx, up, c, total, q, may = _stacked(own["blob"].to_pylist(), *_FOUND)
        order, first, runs = runs_of(ctx)
        if not len(first):
            return _ROWS.empty_table()
        ctx, up, c, total, q, may = (x[order] for x in (ctx, up, c, total, q, may))
        of = np.repeat(np.arange(len(first)), runs)
        sums = lambda x: np.add.reduceat(x, first)
        seen, p = c / total, (c - DISCOUNT) / total
        rest, rest_q, left = (np.maximum(1 - sums(x), 1e-12) for x in (seen, q, p))
        is_state = sums(seen * np.log(seen / q)) + rest * np.log(rest / rest_q) >= LEAST_DIVERGENCE
        b = np.log10(left)
        r = np.where(is_state[of], p + left[of] * q, q)
        a = np.where(is_state[of], np.log10(r) - np.log10(q) - b[of], np.nan)
        g, r, a = _joined(ctx, up), r.astype(np.float32), a.astype(np.float32)
        rows = []
        for k, at in _parts(bucket_of(g, buckets).astype(np.int64)):
            open_ = c[at][(may[at] > 0) & (c[at] >= CONTEXT_COUNT)]
            rows.append((k, 0, len(open_), int(open_.max(initial=0)), _blob(g[at], c[at], r[at], a[at], may[at], compressed=False)))
        at = first[is_state]
        if len(at):
            rows.append((int(bucket_of(ctx[:1], buckets)[0]), 1, len(at), 0, _blob(ctx[at], total[at], b[is_state].astype(np.float32), compressed=False)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], _ROWS)

    found = pairs.groupBy("to").cogroup(before.where("kind = 0").groupBy("bucket")).applyInArrow(find, "of bigint, blob binary")
    level = written(found.groupBy("of").applyInArrow(states, _LEVEL).groupBy("bucket", "kind").applyInArrow(_compact, _LEVEL))
    discard(pairs)
    return level


def _compact(own: pa.Table) -> pa.Table:
    """One row of a bucket's rows of one kind."""
    row = own.slice(0, 1).drop_columns(["n", "most", "blob"]).to_pylist()[0]
    blob = _blob(*_stacked(own["blob"].to_pylist(), *(_CONTEXTS if row["kind"] else _GRAMS)))
    return pa.Table.from_pylist([row | {"n": pa.compute.sum(own["n"]).as_py(), "most": pa.compute.max(own["most"]).as_py(), "blob": blob}], _ROWS)


def _known(level: pa.Table, discount: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and probabilities of a level's sequences that occur often enough; those of words come from their counts."""
    found = [(np.zeros(0, np.uint64), np.zeros(0))]
    for blob in level["blob"].to_pylist():
        g, c, r, _, may = _arrays(blob, *_GRAMS)
        at = c >= PAIR_COUNT
        found.append((g[at], (r if len(may) else (c - discount) / n)[at].astype(np.float64)))
    g, r = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(g)
    return g[order], r[order]


class Tree:
    """Numbers of the root and all entries (g, words, c, a, b), read from their buckets.

    log10 of a token's probability is the sum of `a` of the sequences that end at it and of `b` of those that end before it, over
    all lengths: a state of a longer context corrects what the shorter ones add up to.
    """

    def __init__(self, n: int, v: int, n1: int, n2: int):
        self.n, self.v = max(n, 1), v
        self.root_discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.contexts: list[int] = []  # by length: the number of states
        self.entries: DataFrame | None = None
        self.buckets = 1

    def unknown(self) -> float:
        return math.log10(self.root_discount * self.v / self.n) if self.v else math.log10(0.5)

    @cached_property
    def words(self) -> np.ndarray:
        """Hashes of the words that occur twice or more, the most frequent first. On the driver: for looking into small trees alone."""
        return self.entries.where((F.col("words") == 1) & (F.col("c") >= 2)).orderBy(F.col("c").desc(), "g").toArrow()["g"].to_numpy().view(np.uint64)

    @property
    def size(self) -> int:
        return len(self.words)

    def log10(self, ids: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
        """log10 probability of each token (by its place in `words`) after its past; of -1 only what states leave to the root."""
        rows = self.entries.where((F.col("words") > 1) | (F.col("c") >= 2)).orderBy(F.expr("g")).toArrow()
        own, a, b = (rows[k].to_numpy() for k in ("g", "a", "b"))
        grams, place = np.where(ids >= 0, self.words[ids], np.uint64(0)), np.arange(len(ids)) - doc_start
        out = np.zeros(len(ids))
        for length in range(1, len(self.contexts) + 2):
            grams = longer(grams) if length > 1 else grams
            at = np.minimum(np.searchsorted(own, grams.view(np.int64)), len(own) - 1)
            has = (own[at] == grams.view(np.int64)) & (place[length - 1 :] >= length - 1)
            out[length - 1 :] += np.where(has, a[at], 0.0)
            after = np.where(has, b[at], 0.0)[:-1]
            out[length:] += np.where(place[length:] >= length, after, 0.0)
        return out


def learn(docs: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of `docs` and the written table of its entries in buckets."""
    tokens = written(tokenised(docs.select(F.lit(0).alias("rid"), "text", F.lit(True).alias("learned"))))
    out = learned_from(tokens)
    discard(tokens)
    return out


def learned_from(tokens: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of a written table of slices and the written table of its entries in buckets."""
    n = int(tokens.agg(F.sum("n")).first()[0] or 0)
    buckets = np.uint64(max(min(fan_out(tokens), FEW_BUCKETS), n // BUCKET_TOKENS + 1))
    counts = written(unigrams(tokens, buckets))
    tree = Tree(n, *(int(x or 0) for x in counts.agg(F.sum("v"), F.sum("n1"), F.sum("n2")).first()))
    before = counts.select(*_ROWS.names)
    tables, parts = [counts], [before.withColumn("level", F.lit(0))]
    for length in range(1, DEPTH + 1):
        before = grown(tokens, before, length, tree, buckets)
        if before is None:
            break
        tables.append(before)
        tree.contexts.append(before.where("kind = 1").agg(F.sum("n")).first()[0] or 0)
        parts.append(before.withColumn("level", F.lit(length)))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionAll(part)
    known = gathered(bucketed(together.where(F.col("bucket") % JOINS == k).select("bucket", "level", "kind", "blob"), tree) for k in range(JOINS))
    tree.buckets, tree.entries = int(buckets), unpacked(known)
    discard(*tables)
    return tree, known


_PLAN = ("i8", "i8", "i8", "f8", "f8", "i4", "i4", "u4", "u4")


def _asked(tokens: DataFrame, shared, deepest: int, low: float, buckets: int) -> DataFrame:
    """Rows (batch, bucket, blob) of slices of texts: what a slice asks each bucket (distinct sequences), and under bucket -1 its plan.

    A plan has of each text its key, tokens, known tokens and the two sums as far as workers know them, the numbers of its lookups of words and of
    longer sequences, and then the lookups as places among all distinct sequences of the slice. `shared` is the broadcast of what workers hold.
    """

    def planned(blob: bytes) -> pa.RecordBatch:
        own, counts, values, bits = shared.value
        rid, lengths, _, words, at = _sliced(blob)
        starts, n = np.cumsum(lengths) - lengths, len(lengths)
        place = np.arange(len(at)) - np.repeat(starts, lengths)
        of = np.repeat(np.arange(n, dtype=np.int32), lengths)
        # words: each distinct one is looked up once
        found, has = held_in(own, words)
        score, base, known = (np.zeros(len(words)) for _ in range(3))
        score[has], base[has], known[has] = values[found[has]], np.log10(counts[found[has]] + 0.5) - low, 1
        score = score[at]
        number = np.cumsum(~has, dtype=np.uint32) - np.uint32(1)
        cold = ~has[at]
        cold_words, words_of = number[at[cold]], of[cold]
        distinct = words[~has]
        # longer sequences: one can only be an entry if what comes before its last word is one, too
        grams, rest, rest_of = words[at], [], []
        start = np.arange(len(grams))
        for length in range(2, deepest + 1):
            grams = longer(grams)
            start = start[start < len(grams)]
            start = start[place[start + length - 1] >= length - 1]
            start = start[passes(bits, grams[start])] if bits is not None else start[:0]
            wanted = grams[start]
            found, has = held_in(own, wanted)
            to = start + length - 1
            score[to[has]] += values[found[has]]
            rest.append(wanted[~has])
            rest_of.append(of[to[~has]])
        further = np.concatenate(rest) if rest else np.zeros(0, np.uint64)
        further_of = np.concatenate(rest_of) if rest else np.zeros(0, np.int32)
        by, first, sizes = runs_of(further)
        places = np.empty(len(by), np.int64)
        places[by] = np.repeat(np.arange(len(first)), sizes)
        places = places[np.argsort(further_of, kind="stable")] + len(distinct)
        distinct = np.concatenate([distinct, further[by[first]]])
        bucket = bucket_of(distinct, np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        moved = np.empty(len(order), np.uint32)
        moved[order] = np.arange(len(order), dtype=np.uint32)
        sums = [np.add.reduceat(x, starts) for x in (known[at].astype(np.int64), base[at], score)]
        plan = _blob(rid, lengths, *sums, np.bincount(words_of, minlength=n).astype(np.int32), np.bincount(further_of, minlength=n).astype(np.int32), moved[cold_words], moved[places])
        distinct, bucket = distinct[order], bucket[order]
        edges = np.flatnonzero(np.r_[True, np.diff(bucket) > 0, True]) if len(bucket) else np.zeros(1, np.int64)
        blobs = [distinct[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        batch = int.from_bytes(os.urandom(8), "little", signed=True)
        return pa.RecordBatch.from_pydict({"batch": pa.array([batch] * (len(blobs) + 1), pa.int64()), "bucket": pa.array([-1, *bucket[edges[:-1]].tolist()], pa.int64()), "blob": pa.array([plan, *blobs], pa.binary())})

    def run(batches):
        for batch in batches:
            for blob in batch.column("slice").to_pylist():
                yield planned(blob)

    return tokens.mapInArrow(run, "batch bigint, bucket bigint, blob binary")


#: Of a bucket of entries, in the order of their hashes: steps between those byte by byte, words, counts, a, b.
_ENTRIES = ("u1", "u1", "i8", "f4", "f4")


def _entries(blob: bytes) -> list[np.ndarray]:
    planes, *rest = _arrays(blob, *_ENTRIES)
    return [_from_steps(planes), *rest]


def bucketed(levels: DataFrame, tree: Tree) -> DataFrame:
    """(bucket, n, most, known): the entries of each bucket in one string, the number of those longer than a word, and the largest count.

    `levels` has the rows of all levels. A sequence that is both an entry after its context and a context itself gets `a` and `b` of both.
    """
    discount, size = tree.root_discount, tree.n

    def pack(own: pa.Table) -> pa.Table:
        parts = []
        for level, kind, blob in zip(*(own[k].to_pylist() for k in ("level", "kind", "blob")), strict=True):
            if kind:
                g, c, b = _arrays(blob, *_CONTEXTS)
                a, words = np.zeros_like(b), level
            else:
                g, c, _, a, _ = _arrays(blob, *_GRAMS)
                a, words = a if level else np.log10((c - discount) / size).astype(np.float32), level + 1
                at = ~np.isnan(a)
                g, c, a = g[at], c[at], a[at]
                b = np.zeros_like(a)
            parts.append((g, np.full(len(g), words, np.uint8), c, a, b))
        g, words, c, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first, _ = runs_of(g)
        if not len(first):
            return _BUCKETS.empty_table()
        g = g[order[first]]
        words, c = (np.maximum.reduceat(x[order], first) for x in (words, c))
        a, b = (np.add.reduceat(x[order].astype(np.float64), first).astype(np.float32) for x in (a, b))
        row = {"bucket": own["bucket"][0].as_py(), "n": int((words > 1).sum()), "most": int(c.max()), "known": _blob(_steps(g), words, c, a, b)}
        return pa.Table.from_pylist([row], _BUCKETS)

    return levels.groupBy("bucket").applyInArrow(pack, "bucket bigint, n bigint, most bigint, known binary")


_BUCKETS = pa.schema({"bucket": pa.int64(), "n": pa.int64(), "most": pa.int64(), "known": pa.binary()})


def unpacked(known: DataFrame, least: float = 0) -> DataFrame:
    """(g, words, c, a, b): entries with a count of at least `least`."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("known").to_pylist():
                g, words, c, a, b = _entries(blob)
                at = c >= least
                yield pa.RecordBatch.from_pydict({"g": g[at].view(np.int64), "words": words[at].astype(np.int32), "c": c[at], "a": a[at], "b": b[at]})

    return known.where(F.col("most") >= least).select("known").mapInArrow(run, "g bigint, words int, c bigint, a float, b float")


def _answered(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Answers (batch, bucket, blob) to what is asked: count (of words; 0 for what is unknown) and value of each sequence, in the order of the question."""

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        own = np.zeros(0, np.uint64)
        for blob in known["known"].to_pylist():
            own, words, counts, a, b = _entries(blob)
            counts, values = np.where(words == 1, counts, 0), a + b
        blobs = []
        for blob in asks["blob"].to_pylist():
            wanted = np.frombuffer(blob, np.uint64)
            if not len(own):
                blobs.append(_blob(np.zeros(len(wanted), np.int64), np.full(len(wanted), np.nan, np.float32)))
                continue
            at, has = held_in(own, wanted)
            blobs.append(_blob(np.where(has, counts[at], 0), np.where(has, values[at], np.float32(np.nan))))
        return pa.table({"batch": asks["batch"], "bucket": asks["bucket"], "blob": pa.array(blobs, pa.binary())})

    return asked.where("bucket >= 0").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "batch bigint, bucket bigint, blob binary")


def scores(docs: DataFrame, training: DataFrame | Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`. `training` is a table of texts, or tells which rows of `docs` to learn from.

    A null or empty text is one token, its end. Repeated rows are scored alike; without training rows every token is unknown and
    probabilities come from the smoothing alone; an empty table gives no rows; other columns are not read. Entries of the tree that workers
    don't hold are looked up in its table by buckets of their hash; their values are kept with 24 bits.
    """
    inside = isinstance(training, Column)
    rows = keyed(docs.select("doc_id", "text"))
    tokens = tokenised(rows.withColumn("learned", F.coalesce(training, F.lit(False)) if inside else F.lit(False)))
    tokens = written(tokens.withColumn("part", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(ROUNDS))))
    tree, known = learned_from(tokens) if inside else learn(training)
    n, v = tree.n if tree.v else 0, tree.v
    low, unknown = math.log10(n + 0.5 * (v + 1)), tree.unknown()
    with released(docs.sparkSession):
        hot = unpacked(known, max(2, HOT_SHARE * n)).select("g", F.when(F.col("words") == 1, F.col("c")).otherwise(0).alias("c"), (F.col("a") + F.col("b")).cast("double").alias("value")).toArrow()
    order = np.argsort(hot["g"].to_numpy().view(np.uint64))
    bits = filter_of(known.select("known"), known.agg(F.sum("n")).first()[0] or 0, lambda batch: (e[0][e[1] > 1] for e in map(_entries, batch.column("known").to_pylist())))
    held = (hot["g"].to_numpy().view(np.uint64)[order], hot["c"].to_numpy()[order], hot["value"].to_numpy()[order], bits)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def total(own: pa.Table) -> pa.Table:
        blobs = dict(zip(own["bucket"].to_pylist(), own["blob"].to_pylist(), strict=True))
        rid, tokens, known, base, score, n_words, n_longer, words, further = _arrays(blobs.pop(-1), *_PLAN)
        got = [_arrays(blobs[b], "i8", "f4") for b in sorted(blobs)]
        counts, values = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0))
        known, base, score = known.copy(), base.copy(), score.copy()
        for places, of, rest in ((words, n_words, unknown), (further, n_longer, 0.0)):
            of = np.repeat(np.arange(len(rid)), of)
            value = values[places]
            score += np.bincount(of, np.where(np.isnan(value), rest, value), len(rid))
            if places is words:
                base += np.bincount(of, np.log10(counts[places] + 0.5) - low, len(rid))
                known += np.bincount(of, counts[places] > 0, len(rid)).astype(np.int64)
        return pa.table({"rid": pa.array(rid), "n_tokens": pa.array(tokens), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})

    def in_rounds() -> Iterator[DataFrame]:
        for k in range(ROUNDS):
            asked = written(_asked(tokens.where(F.col("part") == k).select("slice"), shared, len(tree.contexts) + 1, low, tree.buckets))
            answers = written(_answered(asked, known))
            yield asked.where("bucket < 0").unionByName(answers).groupBy("batch").applyInArrow(total, "rid bigint, n_tokens bigint, n_known bigint, base_score double, score double")
            discard(asked, answers)

    out = gathered(in_rounds())
    shared.destroy()
    discard(tokens, known)
    return rows.select("rid", "doc_id").join(out, "rid").select("doc_id", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, in_fold() != HELD_OUT)
    return out.select("doc_id", (in_fold() == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
