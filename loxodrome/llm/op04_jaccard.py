"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Every text has TREES signatures of DEPTH symbols, one for each prefix tree of the forest. The signatures are sorted, so that a
tree's nodes are stretches of the order, and neighbours' common prefixes give the nodes of every depth at once. Texts that share a
node of the greatest depth in some tree are compared exactly. A link of similarity s shares a node of depth d with the
probability 1 - (1 - s**d)**TREES, so that the links found tell how many were missed; matched prefixes are shortened to
the greatest depth at which the expected recall reaches the target, new pairs are compared, and so on until it is reached.

Texts meet in groups, connected by nodes; a large group is dealt to pairs of blocks, and a text goes to those alone in which it
shares a node with another text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, table, words_of, written
from .graph import components
from .spans import keyed, mixed, packed, word_hashes

SHINGLE, THRESHOLD, TARGET = 5, 0.8, 0.99999
#: Symbols have 8 bits, so that a signature is a 64-bit number and a prefix its upper bits.
TREES, DEPTH, SYMBOL = 32, 8, 8
#: Least probability with which a link at the threshold is found at the first depth.
FIRST = 0.9
#: Texts and characters of a block, on average; larger groups are dealt to pairs of blocks.
BLOCK, BLOCK_CHARS = 512, 16_000_000
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     g AS (SELECT array_to_string(ws, ' ') AS txt, min(doc_id) AS text_id, count(*) AS n_copies, any_value(ws) AS ws FROM w WHERE len(ws) > 0 GROUP BY 1),
     s AS (SELECT DISTINCT text_id, unnest(CASE WHEN len(ws) < 5 THEN [txt || chr(10)] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM g),
     c AS (SELECT text_id, count(*) AS n FROM s GROUP BY text_id),
     m AS (SELECT a.text_id AS a, b.text_id AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.text_id <> b.text_id GROUP BY ALL),
     l AS (SELECT a, b FROM m JOIN c x ON x.text_id = a JOIN c y ON y.text_id = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
     r AS (SELECT text_id AS node, text_id AS top FROM g UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node),
     k AS (SELECT node, min(top) AS class_id FROM r GROUP BY node),
     d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT w.doc_id, coalesce(g.text_id, w.doc_id) AS text_id, coalesce(k.class_id, w.doc_id) AS class_id, coalesce(n_copies, 1)::BIGINT AS n_copies, coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN g ON g.txt = array_to_string(w.ws, ' ') LEFT JOIN k ON k.node = g.text_id LEFT JOIN d ON d.a = g.text_id
"""
_RANDOM = np.random.default_rng(4)
_FACTORS = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def depth_for(threshold: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shorten the prefix from `depth` until texts at the threshold meet in some tree with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shingles(hashes: np.ndarray, lengths: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and the number of shingles of each. A text of fewer words is one shingle, one without words has none."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    width = np.minimum(lengths, size)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    each = np.repeat(width, counts)
    out = np.repeat(lengths.astype(np.uint64) * (lengths < size), counts)
    for i in range(size):
        inside = each > i
        out[inside] = mixed(out[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[inside] + i])
    return out, counts


def next_depth(links: dict[int, int], depth: int, target: float) -> int:
    """The greatest depth, `depth` at most, that reaches the target recall, as links found at `depth` tell: similarity in thousandths to their number."""

    def reached(s: int, d: int) -> float:
        return 1 - (1 - (s / 1000) ** d) ** TREES

    all_ = {s: n / reached(s, depth) for s, n in links.items()}
    while depth > 1 and sum(n * reached(s, depth) for s, n in all_.items()) < target * sum(all_.values()):
        depth -= 1
    return depth


def signatures(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signature of each text in each tree, the first symbol in the upper bits: texts x TREES."""
    out = np.zeros((len(counts), TREES), np.uint64)
    has = counts > 0
    starts = (np.cumsum(counts) - counts)[has]
    if not has.any():
        return out
    for t in range(TREES):
        name = np.zeros(len(starts), np.uint64)
        for d in range(DEPTH):
            i = t * DEPTH + d
            least = np.minimum.reduceat(found * _FACTORS[i] + _SHIFTS[i], starts)
            name = name << np.uint64(SYMBOL) | mixed(least) >> np.uint64(64 - SYMBOL)
        out[has, t] = name
    return out


def prefixes(names: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` symbols of signatures."""
    return names >> np.uint64(64 - SYMBOL * depth)


def _signed(rows: DataFrame) -> DataFrame:
    """(rid, k1, k2, chars, sig) of all rows; k1 and k2 name the word sequence and are null where there is no word."""

    def run(batches):
        for part in slices(batches):
            hashes, lengths = word_hashes(part["text"])
            names = signatures(*shingles(hashes, lengths))
            keys = [xxhash.xxh3_128_digest(b" ".join(w)) if (w := words_of(t)) else bytes(16) for t in part["text"]]
            pair = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            none = lengths == 0
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": pa.array(part["rid"], pa.int64()),
                    "k1": pa.array(pair[:, 0], mask=none),
                    "k2": pa.array(pair[:, 1], mask=none),
                    "chars": pa.array([len(t or "") for t in part["text"]], pa.int64()),
                    "sig": pa.ListArray.from_arrays(np.arange(len(names) + 1, dtype=np.int32) * TREES, names.view(np.int64).ravel()),
                }
            )

    return rows.select("rid", "text").mapInArrow(run, "rid bigint, k1 bigint, k2 bigint, chars bigint, sig array<bigint>")


def _combined(reps: DataFrame) -> DataFrame:
    """(rep, sig) to rows (tree, path, node, up): within a batch, `up` is the least text of the same signature; a row with up = node goes on to the sort."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.repeat(batch.column("rep").to_numpy(), TREES)
            path = batch.column("sig").flatten().to_numpy()
            tree = np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)
            order = np.lexsort((node, path, tree))
            tree, path, node = tree[order], path[order], node[order]
            heads = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (tree[1:] != tree[:-1])])
            up = np.repeat(node[heads], np.diff(np.r_[heads, len(node)]))
            yield pa.RecordBatch.from_pydict({"tree": pa.array(tree), "path": pa.array(path), "node": pa.array(node), "up": pa.array(up)})

    return reps.select("rep", "sig").mapInArrow(run, "tree int, path bigint, node bigint, up bigint")


def _shared(tree: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the row before; 0 where the tree is another, and for the first."""
    out = np.zeros(len(path), np.int32)
    both = path[1:].view(np.uint64) ^ path[:-1].view(np.uint64)
    for d in range(1, DEPTH + 1):
        out[1:] += prefixes(both, d) == 0
    out[1:][tree[1:] != tree[:-1]] = 0
    return out


def _walked(heads: DataFrame, floor: int) -> DataFrame:
    """Of sorted rows (tree, path, node): edges (a, b, depth) from a text to the first one of the deepest tree node that it shares with an earlier row.

    Each partition adds a row with its first and last row (depth null), as a tree node may go on in the next one.
    """
    outs = ("a", "b", "depth", "tree", "path", "last_tree", "last_path")

    def run(batches):
        first = last = None
        top = np.zeros(DEPTH + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, path, node = (batch.column(c).to_numpy() for c in ("tree", "path", "node"))
            if first is None:
                first = (int(tree[0]), int(path[0]), int(node[0]))
                top[:] = node[0]
            else:
                tree, path, node = np.r_[last[0], tree], np.r_[last[1], path], np.r_[last[2], node]
            shared = _shared(tree, path)
            up = node.copy()
            for d in range(floor, DEPTH + 1):
                at = np.maximum.accumulate(np.where(shared < d, np.arange(len(node)), 0))
                head = np.where(at > 0, node[at], top[d])
                up = np.where(shared == d, head, up)
                top[d] = head[-1]
            last = (tree[-1], path[-1], node[-1])
            edge = (shared >= floor) & (up != node)
            none = pa.nulls(int(edge.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[edge]), pa.array(up[edge]), pa.array(shared[edge].astype(np.int64)), none, none, none, none], outs)
        if first is not None:
            ends = (first[2], int(last[2]), None, first[0], first[1], int(last[0]), int(last[1]))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in ends], outs)

    return heads.mapInArrow(run, ", ".join(f"{c} bigint" for c in outs))


def _edges(reps: DataFrame, floor: int) -> DataFrame:
    """(a, b, depth), a written table: those of `depth` or more connect all texts that share a tree node of that depth; linear in the texts."""
    local = written(_combined(reps))
    order = ("tree", "path", "node")
    heads = local.where("node = up").select(*order)
    walked = written(_walked(heads.repartitionByRange(*order).sortWithinPartitions(*order), floor))
    ends = walked.where("depth IS NULL").orderBy("tree", "path", "a").collect()  # one for each partition
    across = []
    for x, y in zip(ends[:-1], ends[1:], strict=True):
        shared = _shared(np.array([x["last_tree"], y["tree"]]), np.array([x["last_path"], y["path"]]))[1]
        if shared >= floor:
            across.append((y["a"], x["b"], int(shared)))
    same = local.where("node <> up").select(F.col("node").alias("a"), F.col("up").alias("b"), F.lit(DEPTH).cast("bigint").alias("depth"))
    more = reps.sparkSession.createDataFrame(across, "a bigint, b bigint, depth bigint")
    found = walked.where("depth IS NOT NULL").select("a", "b", "depth").unionAll(same).unionAll(more).where("a <> b")
    out = written(found.groupBy("a", "b").agg(F.max("depth").alias("depth")))
    discard(local, walked)
    return out


def linked_pairs(found: list[np.ndarray], threshold: float) -> np.ndarray:
    """Jaccard similarities of sets (sorted arrays of distinct shingles): a square, 0 below the threshold and for a set with itself."""
    n = len(found)
    sizes = np.array([len(x) for x in found])
    codes, at = np.unique(np.concatenate(found), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    common = np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    step = max(1, 4_000_000 // n)
    edges = np.searchsorted(at, np.arange(0, len(codes) + step, step))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            grid = np.zeros((n, min(step, len(codes) - i * step)), np.float32)
            grid[owner[a:b], at[a:b] - i * step] = 1
            common += grid @ grid.T
    union = sizes[:, None] + sizes[None, :] - common
    return np.where((common + 1e-6 >= threshold * union) & ~np.eye(n, dtype=bool), common / np.maximum(union, 1), 0)


def _meeting(names: np.ndarray, depth: int) -> np.ndarray:
    """Which texts share a node of that depth in some tree: a square of booleans."""
    cut = prefixes(names, depth)
    out = np.zeros((len(cut), len(cut)), bool)
    for t in range(TREES):
        out |= cut[:, None, t] == cut[None, :, t]
    return out


def _verified(members: DataFrame, threshold: float, depth: int, before: int | None) -> DataFrame:
    """Of texts (grp, i, j, blk, rep, sig, text), sorted by (grp, i, j), those pairs that meet at `depth` and not at the depth `before`: rows (a, b, n).

    n links of the text a (b null), an edge (a, b) of a spanning forest of the links, or n links of a similarity of b thousandths (a null).
    """

    def links(rows: list[tuple]) -> tuple[list, list, list]:
        i, j = rows[0][1], rows[0][2]
        reps = [r[4] for r in rows]
        hashes, lengths = word_hashes([r[5] for r in rows])
        found, counts = shingles(hashes, lengths)
        ends = np.cumsum(counts)
        names = np.array([r[6] for r in rows], np.int64).view(np.uint64)
        asked = _meeting(names, depth)
        if before:
            asked &= ~_meeting(names, before)
        if i != j:
            block = np.array([r[3] for r in rows])
            asked &= block[:, None] != block[None, :]
        np.fill_diagonal(asked, False)
        if not asked.any():
            return [], [], []
        alike = linked_pairs([np.unique(found[e - c : e]) for e, c in zip(ends, counts, strict=True)], threshold) * asked
        linked = alike > 0
        total = linked.sum(1)
        a = [r for r, n in zip(reps, total, strict=True) if n]
        b, n = [None] * len(a), [int(x) for x in total if x]
        for s, c in Counter((np.minimum(alike[np.triu(linked)], 1) * 1000 + 1e-3).astype(int).tolist()).items():
            a.append(None)
            b.append(s)
            n.append(c)
        left = np.ones(len(reps), bool)
        for root in range(len(reps)):
            if left[root] and total[root]:
                left[root] = False
                heap = [root]
                while heap:
                    x = heap.pop()
                    new = np.flatnonzero(linked[x] & left)
                    left[new] = False
                    heap += new.tolist()
                    a += [reps[y] for y in new]
                    b += [reps[x]] * len(new)
                    n += [0] * len(new)
        return a, b, n

    def run(batches):
        rows: list[tuple] = []
        out = ([], [], [])

        def flush():
            if len(rows) > 1:
                for all_, new in zip(out, links(rows), strict=True):
                    all_.extend(new)
            rows.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "i", "j", "blk", "rep", "text", "sig")), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    flush()
                rows.append(row)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip("abn", out, strict=True)})
                for x in out:
                    x.clear()
        flush()
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip("abn", out, strict=True)})

    return members.mapInArrow(run, "a bigint, b bigint, n bigint")


def _dealt(groups: DataFrame, reps: DataFrame, depth: int, done: DataFrame | None) -> DataFrame:
    """(grp, i, j, blk, rep): the texts of each pair of blocks (i, j) of a group; a text goes where it meets another at `depth`.

    A group of two that met before (both in `done`) has nothing left to compare.
    """
    members = groups.join(reps.select(F.col("rep").alias("node"), "chars"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("chars") / BLOCK_CHARS)).cast("int")
    sized = members.join(members.groupBy("component").agg(blocks.alias("blocks"), F.count("*").alias("n")), "component")
    if done is not None:
        met = done.select("node", F.lit(True).alias("met"))
        sized = sized.join(met, "node", "left").where("n > 2 OR met IS NULL")
    dealt = sized.withColumn("blk", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int"))
    paths = dealt.join(reps.select(F.col("rep").alias("node"), "sig"), "node").select("component", "blk", "node", F.posexplode("sig").alias("tree", "path"))
    nodes = paths.withColumn("path", F.shiftrightunsigned("path", 64 - SYMBOL * depth))
    on = ["component", "tree", "path"]
    # a row for each text and tree node: the blocks of a node are one value, and a text's equal ones are counted once
    there = nodes.groupBy(*on).agg(F.sort_array(F.collect_set("blk")).alias("there"))
    met = nodes.join(there, on).groupBy("component", "blk", "node").agg(F.array_distinct(F.flatten(F.collect_set("there"))).alias("there"))
    at = [F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j")]
    return met.withColumn("o", F.explode("there")).select(F.col("component").alias("grp"), *at, "blk", F.col("node").alias("rep"))


def _checked(rows: DataFrame, reps: DataFrame, threshold: float, target: float) -> DataFrame:
    """(a, b, n), as _verified gives them, of all depths that the target recall takes."""
    floor = depth_for(threshold, target)
    edges = _edges(reps, floor)
    depth, before, done, out, links = max(floor, depth_for(threshold, FIRST)), None, None, None, Counter()
    while True:
        groups = written(components(edges.where(F.col("depth") >= depth).select("a", "b")))
        dealt = _dealt(groups, reps, depth, done).join(reps.select("rep", "sig"), "rep")
        # dealt out by a shuffle at every size: the members grow with the input, and texts aren't sorted
        members = rows.select(F.col("rid").alias("rep"), "text").join(dealt.hint("shuffle_hash"), "rep").select("grp", "i", "j", "blk", "rep", "sig", "text")
        new = written(_verified(members.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j"), threshold, depth, before))
        for s, n in new.where("a IS NULL").groupBy("b").agg(F.sum("n")).collect():  # thousandths of the similarity
            links[s] += n
        out = new if out is None else out.unionAll(new)
        if done is not None:
            discard(done)
        before, done = depth, groups
        depth = max(floor, next_depth(links, depth, target))
        if depth == before:
            discard(edges, groups)
            return out


def _joined(rows: DataFrame, threshold: float, target: float) -> DataFrame:
    """(rid, rep, class, n_copies, n_links) of all rows with rid and text."""
    signed = written(_signed(rows))
    texts = written(signed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("rid").alias("rep"), F.count("*").alias("n_copies")))
    reps = written(signed.join(texts.select(F.col("rep").alias("rid")), "rid").select(F.col("rid").alias("rep"), "chars", "sig"))
    checked = _checked(rows, reps, threshold, target)
    discard(reps)
    links = checked.where("a IS NOT NULL AND b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    classes = components(checked.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("class"))
    named = texts.join(links, "rep", "left").join(classes, "rep", "left")
    out = signed.select("rid", "k1", "k2").join(named, ["k1", "k2"], "left")
    rep = F.coalesce("rep", "rid")
    return out.select("rid", rep.alias("rep"), F.coalesce("class", rep).alias("class"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """doc_id, text_id, class_id, n_copies, n_links of each row of `docs`.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is `threshold` or more. text_id is the first
    document of the same words, n_copies how many have them, n_links how many different texts are linked, class_id the first
    document of those that links connect. A text of one to four words is one shingle. Null and empty texts
    have no words and link to nothing. Repeated rows are copies; where doc_ids repeat or are null, text_id and class_id are
    row numbers. An empty table gives no rows; other columns are not read.
    """
    rows = keyed(docs.select("doc_id", "text"))
    out = _joined(rows, threshold, target).join(rows.select("rid", "doc_id"), "rid")
    return out.select("doc_id", F.col("rep").alias("text_id"), F.col("class").alias("class_id"), "n_copies", "n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class; rows and columns stay as they are."""
    rows = keyed(packed(docs))
    kept = _joined(rows, THRESHOLD, TARGET).where("rid = class").select("rid")
    return rows.join(kept, "rid", "left_semi").select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
