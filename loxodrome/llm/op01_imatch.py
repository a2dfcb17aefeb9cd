"""I-Match document fingerprints from randomised lexicon subsets, by DataFrame functions alone.

The lexicon holds the terms whose document frequency is in a band, each known by a hash. Its random subsets come in CELLS families, by the hash's upper
bits: the first subset of a family is a random part of the lexicon, and every further one a random half of the last, by the lower bits. A
text's distinct terms in the lexicon are sorted, and those in each subset are hashed, until a subset has none of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fan_out, table, written

#: The band of document frequency, as shares of all documents; terms of fewer than LEAST_DOCS documents are outside.
BAND = (0.0002, 0.02)
LEAST_DOCS = 2
#: Families of nested lexicon subsets (a power of two), and how many subsets are hashed beyond those that are expected to hold one of a text's terms.
CELL_BITS, BEYOND = 6, 5
CELLS = 1 << CELL_BITS
#: Lexicons of at most so many terms (16 bytes each) are broadcast. The band bounds them: terms of a share s of all
#: documents or more are at most a text's mean number of distinct terms divided by s, whatever the number of documents.
BROADCAST_TERMS = 1_000_000

ORACLE_SQL = None


def terms(text: Column) -> Column:
    """Distinct lower-case terms: runs of letters and digits."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Hashes `t` of the terms whose document frequency is in the band. Counts are combined before the shuffle."""
    n = docs.count()
    each = docs.select(F.explode(terms(F.col("text"))).alias("term")).where("term <> ''")
    counts = each.groupBy(F.xxhash64("term").alias("t")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n").between(max(LEAST_DOCS, band[0] * n), max(LEAST_DOCS, band[1] * n))).select("t")


def _range_of(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most x, looked up in two steps of about the square root of their number."""
    step = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    at_most = lambda own: F.size(F.filter(own, lambda b: b <= x))
    row = at_most(F.array(*[F.lit(r[0]) for r in rows]))
    within = F.element_at(F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows]), F.greatest(row, F.lit(1)))
    return F.when(row == 0, 0).otherwise((row - 1) * step + at_most(within))


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, place, copy, doc_id, text, following): the text of the next row in descending order of doc_id; the first follows the last.

    Rows are dealt to ranges of ids, each with a copy of the first row of the range that follows (copy = 1), so no range is
    larger than its share and a row's successor stands right after it. Null ids come last; rows of one id follow each other in the order of their texts.
    """
    parts = fan_out(docs)
    ids = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts)).alias("q")).first()["q"]
    bounds = sorted(set(ids or []))
    bucket = _range_of(F.col("doc_id"), bounds) if bounds else F.lit(0)
    rows = docs.select(F.when(F.col("doc_id").isNull(), -1).otherwise(bucket).cast("int").alias("bucket"), F.lit(0).alias("copy"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    most = rows.groupBy("bucket").agg(F.max("doc_id").alias("most"))
    order = Window.partitionBy("bucket").orderBy("text")
    heads = rows.join(F.broadcast(most.withColumnRenamed("bucket", "b")), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("most"))).withColumn("k", F.row_number().over(order)).where("k = 1").select("bucket", "text")
    used = sorted(r["bucket"] for r in most.select("bucket").collect())
    before = docs.sparkSession.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "bucket int, goes_to int")
    copies = heads.join(F.broadcast(before), "bucket").select(F.col("goes_to").alias("bucket"), F.lit(1).alias("copy"), F.lit(None).cast("bigint").alias("doc_id"), "text")
    own = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    return rows.unionByName(copies).withColumn("place", F.row_number().over(own)).withColumn("following", F.coalesce(F.lead("text").over(own), F.lit("")))


def once(value: Column, of) -> Column:
    """`of(value)` with the value computed once a row; an expression that a lambda mentions is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), of), 1)


def subsets(found: Column) -> Column:
    """Of sorted terms: for each family the hashes of the terms in its subsets, from the largest subset on until none is left."""
    half = CELLS // 2
    # sorted terms of one family stand together
    cells = F.sequence(F.lit(-half).cast("bigint"), F.lit(half - 1).cast("bigint"))
    place = lambda cell, c: F.struct(F.array_position(cell, c).cast("int").alias("at"), (F.size(cell) - F.size(F.array_remove(cell, c))).alias("n"))
    families = once(F.transform(found, lambda t: F.shiftright(t, 64 - CELL_BITS)), lambda cell: F.transform(cells, lambda c: place(cell, c)))

    def family(x: Column) -> Column:
        def step(state: Column, scale: Column) -> Column:
            left = F.filter(state.left, lambda t: F.call_function("getbit", t, scale) == 1)
            return F.when(F.size(state.left) == 0, state).otherwise(F.struct(left.alias("left"), F.array_append(state.hashes, F.xxhash64(state.left)).alias("hashes")))

        own = F.slice(found, x.at, x.n)
        scales = F.sequence(F.lit(0), F.floor(F.log2(x.n)).cast("int") + BEYOND)
        none = F.array().cast("array<bigint>")
        return F.when(x.n == 0, none).otherwise(F.aggregate(scales, F.struct(own.alias("left"), none.alias("hashes")), step, lambda state: state.hashes))

    return F.transform(families, family)


def _likeness(a: str, b: str) -> Column:
    """Estimate of the Jaccard similarity of the terms of two fingerprints; 1 for equal ones, 0 where one has no term of the lexicon.

    A family's subsets agree from the first one on that none of the differing terms is in. So how many disagree tells the number d of those
    terms: by the harmonic mean over the families, and by the number of families that agree as a whole where d is small. The relative
    error of d is 1.04 / sqrt(CELLS) = 0.13.
    """
    unequal = lambda x, y: F.greatest(F.size(x), F.size(y)) - F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e))
    each = F.zip_with(f"{a}_sets", f"{b}_sets", unequal)
    same = lambda each: F.size(F.filter(each, lambda m: m == 0))
    many = lambda each: 0.709 * CELLS * CELLS / F.aggregate(each, F.lit(0.0), lambda s, m: s + F.pow(F.lit(0.5), m))
    fewer = lambda x: F.when((x.many <= 2.5 * CELLS) & (x.same > 0), CELLS * F.log(CELLS / x.same)).otherwise(x.many)
    differing = once(once(each, lambda x: F.struct(many(x).alias("many"), same(x).alias("same"))), fewer)
    both = F.col(f"{a}_n") + F.col(f"{b}_n")
    estimate = F.greatest(F.lit(0.0), (both - differing) / (both + differing))
    return F.when(F.col(f"{a}_print") == F.col(f"{b}_print"), 1.0).when((F.col(f"{a}_n") == 0) | (F.col(f"{b}_n") == 0), 0.0).otherwise(F.coalesce(estimate, F.lit(0.0)))


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's text, and their likeness.

    A fingerprint has the hash of all sorted distinct terms in the lexicon and those of the subsets; a text without such terms has the hash of
    all its terms. Null texts are empty. A single row follows itself. Repeated rows are
    fingerprinted alike; an empty table gives no rows; other columns are not read. Texts are shuffled once, for the
    order of ids; all that follows stays within the ranges, so that nothing else of them is shuffled.
    """
    words = written(lexicon(docs, band))
    words = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.when(F.col("copy") == 1, "").otherwise(F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) AS int))"), F.left("following", third)))
    base = in_order(docs.select("doc_id", "text")).withColumn("edited", edited)
    base = base.select("bucket", "place", "copy", "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("edited"))
    whole = lambda c: F.xxhash64(F.sort_array(c)).alias(c)
    about = F.struct("copy", "doc_id", "n_chars", "edited_sha256", whole("own"), whole("edited"))
    # the entry "" stands for the row itself; no other one carries its columns
    sides = F.array(F.struct(F.lit(0).alias("side"), about.alias("about"), F.concat(F.array(F.lit("")), "own").alias("terms")), F.struct(F.lit(1).alias("side"), F.lit(None).cast(base.select(about.alias("x")).schema["x"].dataType).alias("about"), F.col("edited").alias("terms")))
    each = base.select("bucket", "place", F.explode(sides).alias("x")).select("bucket", "place", "x.side", "x.about", F.posexplode("x.terms").alias("pos", "term"))
    is_row = (F.col("side") == 0) & (F.col("pos") == 0)
    each = each.select("bucket", "place", "side", F.when(is_row, F.col("about")).alias("about"), F.when(F.col("term") != "", F.xxhash64("term")).alias("h"))
    found = each.join(words, each["h"] == words["t"], "left").where("t IS NOT NULL OR about IS NOT NULL")
    mine = lambda i: F.sort_array(F.collect_list(F.when(F.col("side") == i, F.col("t"))))
    out = found.groupBy("bucket", "place").agg(F.first("about", ignorenulls=True).alias("about"), mine(0).alias("own"), mine(1).alias("edited"))
    out = out.select("bucket", "place", "about", "own", "edited", subsets(F.col("own")).alias("own_sets"), subsets(F.col("edited")).alias("edited_sets"))
    sign = lambda s: F.concat_ws("-", F.lpad(F.hex(F.when(F.size(s) > 0, F.xxhash64(s)).otherwise(F.col(f"about.{s}"))), 16, "0"), F.hex(F.size(s)), F.array_join(F.transform(f"{s}_sets", lambda own: F.array_join(F.transform(own, lambda x: F.substring(F.hex(x), -8, 8)), ".")), "-"))
    out = out.select("bucket", "place", "about", *[c for s in ("own", "edited") for c in (F.size(s).alias(f"{s}_n"), f"{s}_sets", sign(s).alias(f"{s}_print"))])
    after = Window.partitionBy("bucket").orderBy("place")
    out = out.select("*", *[F.lead(f"own_{c}").over(after).alias(f"following_{c}") for c in ("n", "sets", "print")]).where("about.copy = 0")
    return out.select("about.doc_id", "about.n_chars", "about.edited_sha256", F.col("own_print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"), _likeness("own", "edited").alias("near_edited"), _likeness("own", "following").alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
