"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, discard, table, written
from .spans import confirmed_in_order, keyed, packed, unpacked

LINES = 3

ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
     n AS (SELECT doc_id, i, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
     w AS (SELECT doc_id, i AS i1, lead(i, 1) OVER p AS i2, lead(i, 2) OVER p AS i3,
                  line || chr(10) || lead(line, 1) OVER p || chr(10) || lead(line, 2) OVER p AS s
           FROM n WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
     r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i1) AS k FROM w WHERE s IS NOT NULL),
     g AS (SELECT doc_id, i1 AS i FROM r WHERE k > 1 UNION SELECT doc_id, i2 FROM r WHERE k > 1 UNION SELECT doc_id, i3 FROM r WHERE k > 1),
     t AS (SELECT l.doc_id, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS kept, count(g.i) AS n_removed
           FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


def _later(rows: DataFrame) -> DataFrame:
    """Of rows with rid and text: (rid, later), the numbers of the windows that are not the first with their lines.

    Lines without a word are left out, the others are compared unchanged; a window is known by two 64-bit hashes.
    """
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = rows.select("rid", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(LINES), x).alias("b"))).alias("h"))
    n = F.size("h")
    shifted = [F.slice("h", 1 + i, F.greatest(n - LINES + 1, F.lit(0))).alias(f"l{i}") for i in range(LINES)]
    each = hashed.where(n >= LINES).select("rid", F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    windows = each.select("rid", F.col("at").cast("bigint").alias("at"), *[F.xxhash64(*[F.col(f"w.l{i}.{c}") for i in range(LINES)]).alias(h) for h, c in (("h1", "a"), ("h2", "b"))], F.lit(1).alias("weight"))
    windows = written(windows)
    counted, keys = confirmed_in_order(windows)
    out = written(counted.where("NOT is_first").groupBy("rid").agg(F.collect_set("at").alias("later")))
    discard(windows, keys)
    return out


def kept_lines(text: str, later) -> tuple[str, int]:
    """The text without the lines that the given windows cover, and how many those are."""
    lines = text.split("\n")
    own = [i for i, x in enumerate(lines) if x.strip(WORD_SPACE)]
    gone = {own[j + k] for j in later for k in range(LINES)}
    return "\n".join([x for i, x in enumerate(lines) if i not in gone]), len(gone)


def _cut(texts, later):
    import pandas as pd

    rows = [kept_lines(t, own) if own is not None and len(own) else (t, 0) for t, own in zip(texts, later, strict=True)]
    return pd.DataFrame({"kept": [r[0] for r in rows], "n_removed": [r[1] for r in rows]})


def line_dedup(docs: DataFrame) -> DataFrame:
    """Rows of `docs` as doc_id, text, row, kept_text, n_lines, n_removed.

    Three consecutive lines with words that were seen before (in the order of doc_id, then place) are removed, overlapping windows
    together; lines without words stay. Null texts stay null and have one line, empty ones too; documents of
    fewer than three lines with words stay whole. Repeated rows are documents of their own, in the order of the rows; an
    empty table gives no rows. A window that a third of all
    documents share is counted before the shuffle, and then broadcast.
    """
    rows = keyed(packed(docs))
    out = rows.join(_later(rows), "rid", "left").withColumn("cut", F.pandas_udf(_cut, "kept string, n_removed bigint")("text", "later"))
    return out.select("doc_id", "text", "row", F.col("cut.kept").alias("kept_text"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"), F.col("cut.n_removed").alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines; n_chars follows the text."""
    return unpacked(line_dedup(docs), docs, F.col("kept_text"), F.col("n_removed") > 0)
