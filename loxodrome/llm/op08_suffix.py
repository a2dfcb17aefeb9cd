"""Removal of repeated passages by a sparse suffix array at content-selected minimiser positions.

Suffixes start at the k-mers that own a window (see Minimisers), so two equal windows have suffixes at the same offset. Those
whose k-mer repeats are sorted; neighbours are compared and matches extended to the left and to the right over the windows
that the suffix owns. A chain of neighbours that agree in a window passes on only its first occurrence, with the
chain's weight; windows of equal words that sorting left apart meet when those few are counted by their words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fan_out, slices, table, written
from .spans import WINDOW_CHARS, Minimisers, confirmed_in_order, keyed, merged_lists, packed, repeated_positions, unpacked

K, WINDOW = 8, 50
#: Words that one letter of a suffix stands for when suffixes are sorted, and letters in the sort key.
LETTER, LETTERS = 8, 7
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w),
     g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM s),
     r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS removed, count(*) OVER (PARTITION BY h) AS n FROM g),
     c AS (SELECT DISTINCT doc_id, removed, unnest(range(i, i + 50)) AS p FROM r WHERE n > 1),
     q AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, removed ORDER BY p) AS island FROM c)
SELECT doc_id, min(p) - 1 AS start, max(p) AS "end", removed FROM q GROUP BY doc_id, removed, island
"""
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _suffixes(docs: DataFrame, k: int, window: int) -> DataFrame:
    """Suffix positions (nh, rid, p) of all texts."""

    def run(batches):
        for part in slices(batches, most=WINDOW_CHARS):
            m = Minimisers(part["text"], k, window)
            at = m.selected
            doc = m.doc[at]
            yield pa.RecordBatch.from_pydict({"nh": pa.array(m.kmers[at].view(np.int64)), "rid": pa.array(np.array(part["rid"], np.int64)[doc]), "p": pa.array((at - m.starts[doc]).astype(np.int32))})

    return docs.select("rid", "text").mapInArrow(run, "nh bigint, rid bigint, p int")


def _with_windows(docs: DataFrame, k: int, window: int) -> DataFrame:
    """Of texts and their repeated positions `ps`: (key, rid, p, first window's offset, hashes of the windows owned)."""

    def run(batches):
        for part in slices(batches, most=WINDOW_CHARS):
            m = Minimisers(part["text"], k, window)
            rid = np.array(part["rid"], np.int64)
            wanted = np.zeros(len(m.hashes) + 1, bool)
            for start, ps in zip(m.starts.tolist(), part["ps"], strict=True):
                wanted[[start + p for p in ps]] = True
            h = m.rolling.stretch(m.window_at, m.window_at + window).view(np.int64)
            # windows of an owner are consecutive, and owners come in the order of their windows
            first = np.flatnonzero(np.r_[True, m.owner[1:] != m.owner[:-1]]) if len(m.owner) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(m.owner)] if len(first) else first
            own = wanted[m.owner[first]]
            first, last = first[own], last[own]
            at = m.owner[first]
            doc = m.doc[at]
            letters = np.zeros((len(at), LETTERS), ">u4")
            for i in range(LETTERS):  # beyond the text's end a letter is 0
                a = at + i * LETTER
                inside = a + LETTER <= m.ends[doc]
                letters[inside, i] = m.rolling.stretch(a[inside], a[inside] + LETTER) >> np.uint64(32)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([x.tobytes() for x in letters], pa.binary()),
                    "rid": pa.array(rid[doc]),
                    "p": pa.array((at - m.starts[doc]).astype(np.int32)),
                    "w0": pa.array((m.window_at[first] - at).astype(np.int32)),
                    "hashes": pa.array([h[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
                }
            )

    return docs.mapInArrow(run, "key binary, rid bigint, p int, w0 int, hashes binary")


def _compared(suffixes: DataFrame, window: int) -> DataFrame:
    """Of sorted suffixes: windows (h1, h2, rid, at, weight) to be counted, and stretches (rid, at, -words) of repeated windows that aren't the first in their chain.

    A stretch has its length, below 0, for a weight: matches of neighbours are extended over all windows that the suffix owns.
    """

    def run(batches):
        width = window + 1
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            rid, p, w0 = (batch.column(c).to_numpy() for c in ("rid", "p", "w0"))
            blobs = batch.column("hashes").to_pylist()
            counts = np.array([len(b) // 8 for b in blobs])
            flat = np.frombuffer(b"".join(blobs), np.int64)
            row = np.repeat(np.arange(n), counts)
            col = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(w0 + window, counts)
            grid, has = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
            grid[row, col], has[row, col] = flat, True
            same = np.zeros((n + 1, width), bool)  # the window agrees with that of the neighbour before
            same[1:n] = has[1:] & has[:-1] & (grid[1:] == grid[:-1])
            later = np.zeros((n, width + 1), bool)
            out: list[tuple] = []
            for c in np.flatnonzero(has.any(0)).tolist():
                rows = np.flatnonzero(has[:, c])
                heads = np.flatnonzero(~same[rows, c])
                at = p[rows].astype(np.int64) + (c - window)
                sizes = np.diff(np.r_[heads, len(rows)])
                order = np.lexsort((at, rid[rows], np.repeat(np.arange(len(heads)), sizes)))  # within a chain by row key and place
                first = rows[order[heads]]
                later[rows, c] = True
                later[first, c] = False
                out.append((grid[first, c], np.full(len(heads), c, np.int32), rid[first], at[order[heads]], sizes))
            edge = np.diff(later.astype(np.int8), axis=1, prepend=0)
            own, begin = np.nonzero(edge == 1)
            end = np.nonzero(edge == -1)[1]
            none = np.zeros(len(own), np.int64)
            out.append((none, none.astype(np.int32), rid[own], p[own] + begin - window, begin - end - window + 1))
            h1, h2, rid, at, weight = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict({"h1": pa.array(h1), "h2": pa.array(h2), "rid": pa.array(rid), "at": pa.array(at.astype(np.int32)), "weight": pa.array(weight.astype(np.int32))})

    return suffixes.mapInArrow(run, "h1 bigint, h2 int, rid bigint, at int, weight int")


def repeated_spans(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(rid, later, first): arrays of the merged spans (start, end) of windows of `window` words that occur twice or more; `docs` has rid and text.

    Windows are merged before they are stored, so that a text has at most one span for each window's length of its words.
    """
    found = written(_suffixes(docs, k, window))
    positions, counts = repeated_positions(found)
    ps = written(positions.groupBy("rid").agg(F.collect_list("p").alias("ps")))
    discard(found, counts)
    # written before they are dealt to ranges, which reads them twice
    suffixes = written(_with_windows(docs.select("rid", "text").join(ps, "rid").select("rid", "text", "ps"), k, window))
    discard(ps)
    ordered = suffixes.repartitionByRange(fan_out(docs), "key", "rid", "p").sortWithinPartitions("key", "rid", "p")
    windows = written(_compared(ordered, window))
    discard(suffixes)
    counted, keys = confirmed_in_order(windows.where("weight > 0"))
    counted = counted.select("rid", F.col("at").alias("a"), (F.col("at") + window).alias("b"), "is_first")
    later = windows.where("weight < 0").select("rid", F.col("at").alias("a"), (F.col("at") - F.col("weight")).alias("b"), F.lit(False).alias("is_first"))
    spans = counted.unionByName(later)
    own = spans.groupBy("rid").agg(F.collect_list(F.when(~F.col("is_first"), F.struct("a", "b"))).alias("later"), F.collect_list(F.when(F.col("is_first"), F.struct("a", "b"))).alias("first"))
    out = written(own.mapInArrow(_merged, "rid bigint, later array<struct<start bigint, end bigint>>, first array<struct<start bigint, end bigint>>"))
    discard(windows, keys)
    return out


def _merged(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("rid"), *(merged_lists(batch.column(c)) for c in ("later", "first"))], ["rid", "later", "first"])


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space before each; the rest stays as it is."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a - 1][1] if a else 0])
        at = places[b - 1][1]
    return "".join(out) + text[at:]


def suffix_dedup(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, start, end, removed) of the merged spans of words that repeat.

    A span consists of windows of `window` words that occur elsewhere, in the same document or another. The first occurrence of
    each, by doc_id and place, is kept (removed = false); the later ones are removed (true). Null and empty texts and texts
    shorter than a window have no spans. Repeated rows are occurrences of their own, in the order of the rows. An
    empty table gives no rows; other columns are not read.
    """
    docs = keyed(docs.select("doc_id", "text"))
    own = repeated_spans(docs, k, window)
    marked = lambda spans, removed: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(removed).alias("removed")))
    out = own.select("rid", F.inline(F.concat(marked("later", True), marked("first", False))))
    return out.join(docs.select("rid", "doc_id"), "rid").select("doc_id", "start", "end", "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of repeated passages; n_chars follows the text."""
    rows = keyed(packed(docs))
    own = repeated_spans(rows, K, WINDOW).select("rid", "later")
    cut = F.pandas_udf(_cut, "string")
    out = rows.join(own, "rid", "left").withColumn("changed", F.coalesce(F.size("later") > 0, F.lit(False)))
    # workers get the texts that change alone, and their spans as plain numbers
    edges = F.flatten(F.transform("later", lambda x: F.array(x["start"], x["end"])))
    text = F.when(F.col("changed"), cut(F.when(F.col("changed"), F.col("text")), edges)).otherwise(F.col("text"))
    return unpacked(out.withColumn("text", text), docs, F.col("text"), F.col("changed"))


def _cut(texts, edges):
    import pandas as pd

    return pd.Series([without_words(t, own.reshape(-1, 2).tolist()) if t is not None else None for t, own in zip(texts, edges, strict=True)], dtype=object)
