"""Removal of repeated passages by compaction of a sparse De Bruijn graph of token k-mers.

Nodes are the k-mers that own a window (see Minimisers); an edge is the stretch of text from one owner to the next, known by
its words. An edge that occurs twice or more, always followed by the same edge that in turn always follows it, is no
branch. Such links compact into paths by joins that double the distance of each edge's pointer until it reaches the head of its
path. A path occurs as a whole wherever its head does, so the head's source coordinates and the path's length give
the repeated spans. Windows inside them are not counted any further, but for those of the first occurrence whose owner is also
found elsewhere. All other windows with a repeated owner are counted by their words at their source coordinates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, slices, table, words_of, written
from .spans import WINDOW_CHARS, Minimisers, confirmed, joined, keyed, merged, mixed, repeated_positions

K, WINDOW = 12, 35

ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w),
     g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM s),
     r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
     c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g JOIN r USING (h)),
     m AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(ps, x)), lambda x: ws[x]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN m USING (doc_id)
"""


def _occurrences(docs: DataFrame, k: int, window: int) -> DataFrame:
    """Owners (nh, rid, p) of all windows, each with the edge `eh` to the next owner of its text at `q`, if any."""

    def run(batches):
        for part in slices(batches, most=WINDOW_CHARS):
            m = Minimisers(part["text"], k, window)
            at = m.selected
            doc = m.doc[at]
            q = np.full(len(at), -1, np.int64)
            q[:-1] = np.where(doc[1:] == doc[:-1], at[1:], -1)
            has = q >= 0
            eh = np.zeros(len(at), np.uint64)
            eh[has] = m.rolling.stretch(at[has], q[has] + k)
            yield pa.RecordBatch.from_pydict(
                {
                    "nh": pa.array(m.kmers[at].view(np.int64)),
                    "eh": pa.array(eh.view(np.int64), mask=~has),
                    "rid": pa.array(np.array(part["rid"], np.int64)[doc]),
                    "p": pa.array((at - m.starts[doc]).astype(np.int32)),
                    "q": pa.array(np.where(has, q - m.starts[doc], -1).astype(np.int32)),
                }
            )

    return docs.select("rid", "text").mapInArrow(run, "nh bigint, eh bigint, rid bigint, p int, q int")


def _links(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: repeated edges (eh, n, w words long, first occurrence), and (eh, ptr, dist): the one edge before an edge, where both belong to one unbranched path."""
    edges = kept.where("eh IS NOT NULL")
    first = F.min(F.struct("rid", "p")).alias("first")
    out = edges.groupBy("eh").agg(F.count("*").alias("n"), F.max(F.col("q") - F.col("p")).alias("w"), F.min("next_eh").alias("n0"), F.max("next_eh").alias("n1"), F.count("next_eh").alias("n_next"), first).where("n > 1")
    back = edges.where("next_eh IS NOT NULL").groupBy(F.col("next_eh").alias("eh")).agg(F.min("eh").alias("p0"), F.max("eh").alias("p1"), F.count("*").alias("n_prev"))
    stats = written(out.join(back, "eh", "left"))
    ahead = stats.where("n0 = n1 AND n_next = n").select(F.col("eh").alias("ptr"), F.col("n0").alias("eh"), F.col("w").cast("bigint").alias("dist"))
    behind = stats.where("p0 = p1 AND n_prev = n").select("eh", "p0")
    return stats, written(ahead.join(behind, "eh").where("p0 = ptr").select("eh", "ptr", "dist", F.lit(True).alias("moved")))


def _compacted(kept: DataFrame) -> DataFrame:
    """Written table (eh, n, words, first): of each repeated edge the occurrences and words of its path and, at the path's head alone, its first occurrence.

    Every round joins the pointers with themselves, so they double in distance: a path of m edges takes log2(m) rounds. A
    path has no cycle, as its last edge in a text is followed by nothing.
    """
    stats, now = _links(kept)
    while now.where("moved").limit(1).count():
        ahead = now.select(F.col("eh").alias("ptr"), F.col("ptr").alias("to"), F.col("dist").alias("more"))
        jumped = now.join(ahead, "ptr", "left").select("eh", F.coalesce("to", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("to").isNotNull().alias("moved"))
        last, now = now, written(jumped)
        discard(last)
    head = F.coalesce("ptr", "eh").alias("head")
    members = written(stats.join(now.select("eh", "ptr", "dist"), "eh", "left").select("eh", "n", head, (F.coalesce("dist", F.lit(0)) + F.col("w")).alias("upto"), F.when(F.col("ptr").isNull(), F.col("first")).alias("first")))
    discard(stats, now)
    length = members.groupBy("head").agg(F.max("upto").cast("int").alias("words"), F.count("*").alias("edges"))
    sized = written(length)
    out = written(joined(members, sized, ["head"], "edges").select("eh", "n", "words", "first"))
    discard(members, sized)
    return out


def repeated_spans(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(rid, spans): arrays of the spans (a, b) of words covered by windows of `window` words that occur twice or more; `docs` has rid and text."""
    found = written(_occurrences(docs, k, window))
    positions, counts = repeated_positions(found)
    ahead = Window.partitionBy("rid").orderBy("p")
    follows = F.lead("p").over(ahead) == F.col("q")
    kept = positions.withColumn("next_eh", F.when(follows, F.lead("eh").over(ahead))).withColumn("eh", F.when(follows, F.col("eh")))
    kept = written(kept.select("rid", "p", "q", "eh", "next_eh", "nodes"))
    discard(found, counts)
    edges = _compacted(kept)
    # an edge of a path as long as a window; `words` at the path's head; `closed`: its start owns windows nowhere but on this path
    known = edges.where(F.col("words") + k >= window).withColumn("words", F.col("words") + k)
    on_path = joined(kept.where("eh IS NOT NULL").select("rid", "p", "eh", "nodes"), known, ["eh"])
    is_first = (F.col("first.rid") == F.col("rid")) & (F.col("first.p") == F.col("p"))
    on_path = on_path.select("rid", "p", F.when(F.col("first").isNotNull(), F.col("words")).otherwise(0).alias("words"), F.coalesce(is_first, F.lit(False)).alias("is_first"), (F.col("nodes") <= F.col("n")).alias("closed"))
    off_path = kept.select("rid", "p", F.lit(0).alias("words"), F.lit(False).alias("is_first"), F.lit(False).alias("closed"))
    owners = written(on_path.unionByName(off_path).groupBy("rid").agg(*[F.collect_list(c).alias(c) for c in ("p", "words", "is_first", "closed")]))
    discard(kept, edges)

    def run(batches):
        for part in slices(batches, most=WINDOW_CHARS):
            m = Minimisers(part["text"], k, window)
            h1 = m.rolling.stretch(m.window_at, m.window_at + window)
            sizes = [len(x) for x in part["p"]]
            flat = lambda c, t: np.fromiter((x for own in part[c] for x in own), t, sum(sizes))
            of = np.repeat(np.arange(len(sizes)), sizes)
            p, length, is_first = flat("p", np.int64), flat("words", np.int64), flat("is_first", bool)
            owned, closed = np.zeros(len(m.hashes) + 1, bool), np.zeros(len(m.hashes) + 1, bool)
            owned[m.starts[of] + p] = True
            closed[(m.starts[of] + p)[flat("closed", bool)]] = True
            heads = np.flatnonzero(length)
            begin = m.starts[of[heads]] + p[heads]
            inside = []  # windows inside a path, and those inside a path's first occurrence
            for some in (np.ones(len(heads), bool), is_first[heads]):
                edge = np.zeros(len(m.hashes) + 2, np.int64)
                np.add.at(edge, begin[some], 1)
                np.add.at(edge, begin[some] + length[heads][some] - window + 1, -1)
                inside.append(np.cumsum(edge)[m.window_at] > 0)
            known, first = inside
            take = owned[m.owner] & (~known | (first & ~closed[m.owner]))
            at = m.window_at[take]
            weight = np.where(first[take], 2, 1)
            rid = np.array(part["rid"], np.int64)
            doc = m.doc[at]
            h2 = mixed(h1[take] + m.hashes[at] * np.uint64(3) + m.hashes[at + window - 1] * np.uint64(5) + m.hashes[at + window // 2])
            yield pa.RecordBatch.from_pydict(
                {
                    "h1": pa.array(np.r_[h1[take].view(np.int64), np.zeros(len(heads), np.int64)]),
                    "h2": pa.array(np.r_[(h2 >> np.uint64(33)).astype(np.int32), np.zeros(len(heads), np.int32)]),
                    "rid": pa.array(np.r_[rid[doc], rid[of[heads]]]),
                    "at": pa.array(np.r_[at - m.starts[doc], p[heads]].astype(np.int32)),
                    "weight": pa.array(np.r_[weight, -length[heads]].astype(np.int32)),
                }
            )

    # a weight below 0 is the length of a path, of words known to repeat
    windows = written(docs.select("rid", "text").join(owners, "rid").mapInArrow(run, "h1 bigint, h2 int, rid bigint, at int, weight int"))
    discard(owners)
    counted, keys = confirmed(windows.where("weight > 0"))
    counted = counted.select("rid", F.col("at").alias("a"), (F.col("at") + window).alias("b"))
    spans = counted.unionByName(windows.where("weight < 0").select("rid", F.col("at").alias("a"), (F.col("at") - F.col("weight")).alias("b")))
    out = written(spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    discard(windows, keys)
    return out


def debruijn_dedup(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, spans (merged, of word numbers), kept_text.

    Removes each word that is covered by a window of `window` words whose words also start elsewhere. Null and
    empty texts, and texts shorter than a window, keep all their words. Repeated rows are occurrences of their own (so they remove
    each other's passages); an empty table gives no rows; other columns are not read.
    """
    docs = keyed(docs.select("doc_id", "text"))
    spans = repeated_spans(docs, k, window)

    def run(batches):
        for part in slices(batches):
            rows = []
            for doc, text, spans in zip(part["doc_id"], part["text"], part["spans"], strict=True):
                words = words_of(text)
                cut = merged([(s["a"], s["b"]) for s in spans or ()])
                kept, at = [], 0
                for a, b in cut:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append({"doc_id": doc, "n_words": len(words), "n_removed": len(words) - len(kept), "spans": [{"a": a, "b": b} for a, b in cut], "kept_text": b" ".join(kept).decode()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("kept_text", pa.string())])
    return docs.join(spans, "rid", "left").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<a:bigint,b:bigint>>, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = debruijn_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
