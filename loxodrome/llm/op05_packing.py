"""Hierarchical multi-length packing of tokenized documents."""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import BEYOND_LATIN, PATTERN, byte_chars, encoder
from .common import fan_out, slices, table, written

ORACLE_SQL = None
DEFAULT_FILE = "byte_bpe_50k.json"
LONGEST = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Sequences of one training step; every step gets the same mix of tiers.
STEP_SEQUENCES = 64

_FAST: dict[str, tiktoken.Encoding] = {}


def _fast(path: str) -> tiktoken.Encoding:
    """The same vocabulary in a faster library; equal to the trie encoder within Latin text (tests compare them)."""
    if path not in _FAST:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        chars, special = byte_chars(), {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(chars[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        _FAST[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _FAST[path]


def encode_texts(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
    fast, out = _fast(path), []
    beyond = [t for t in texts if t and BEYOND_LATIN.search(t)]
    exact = iter(encoder(path).encode_batch(beyond)) if beyond else iter(())
    for t in texts:
        if not t:
            out.append(b"")
        elif BEYOND_LATIN.search(t):
            out.append(next(exact))
        else:
            out.append(array("I", fast.encode(t, allowed_special="all", disallowed_special=())).tobytes())
    return out


def pieces_of(docs: DataFrame, path: str, longest: int = LONGEST) -> DataFrame:
    """Pieces of at most `longest` ids: whole windows from a document's start, then one remainder."""

    def run(batches):
        for part in slices(batches):
            rows = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            for doc, ids in zip(part["doc_id"], encode_texts(path, part["text"]), strict=True):
                ids += END_ID.to_bytes(4, "little")
                for at in range(0, len(ids), 4 * longest):
                    piece = ids[at : at + 4 * longest]
                    for key, value in zip(rows, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                        rows[key].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def plan_packing(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int, int]]:
    """Pack a histogram of lengths; rows (length, first rank, ranks, first sequence, offset, window).

    A length is routed to the smallest tier that holds it. From the longest tier down, a length first fills the gaps of long
    windows, best fit first; then it shares its own tier's window with a length that fills it exactly (a window
    that is a power of two has no padding); what is left opens windows of the longest tier, whose gaps the shorter tiers
    fill in turn. All work is per length, not per document: a few rows for each length, whatever the number of documents.
    """
    longest = tiers[-1]
    left = {n: c for n, c in counts.items() if c}
    groups: list[tuple[list[int], int, int]] = []  # lengths of a window, how many such windows, the window
    open_: dict[int, list[tuple[list[int], int]]] = {}  # by gap
    gaps: list[int] = []

    def put(gap: int, group: tuple[list[int], int]) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append(group)

    for n in tiers:  # a document that fills its tier's window
        if c := left.pop(n, 0):
            groups.append(([n], c, n))
    for n in sorted(left, reverse=True):
        count = left[n]
        while count and (i := bisect_left(gaps, n)) < len(gaps):  # the smallest gap that holds it
            gap = gaps[i]
            lengths, c = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(i)
            took = min(count, c)
            if c > took:
                put(gap, (lengths, c - took))
            if gap == n:
                groups.append(([*lengths, n], took, longest))
            else:
                put(gap - n, ([*lengths, n], took))
            count -= took
        tier = tiers[bisect_left(tiers, n)]
        if count and n > tier - n and (other := min(count, left.get(tier - n, 0))):  # two that fill the tier's window exactly
            groups.append(([n, tier - n], other, tier))
            left[tier - n] -= other
            count -= other
        if not count:
            continue
        fits = longest // n  # what is left opens windows of the longest tier, as many of this length in each as it holds
        full, rest = divmod(count, fits)
        for k, c in ((fits, full), (rest, 1)):
            if k and c:
                gap = longest - k * n
                if gap:
                    put(gap, ([n] * k, c))
                else:
                    groups.append(([n] * k, c, longest))
    groups += [(lengths, c, longest) for gap in gaps for lengths, c in open_[gap]]

    rows, used, sequence = [], {}, 0
    for lengths, c, _ in groups:
        total, offset = sum(lengths), 0
        window = total if total & (total - 1) == 0 else longest
        for n in lengths:
            rows.append((n, used.get(n, 0), c, sequence, offset, window))
            used[n] = used.get(n, 0) + c
            offset += n
        sequence += c
    return rows


def pack(docs: DataFrame, path: str, longest: int = LONGEST, buckets: int | None = None) -> DataFrame:
    """Sequences of at most `longest` ids; one row per piece of a document.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (the padded size), step_group.
    A null or empty text has one id, the end. Repeated rows are documents of their own; an empty table gives no rows; other
    columns are not read. The histogram of lengths (at most `longest` rows) is all that the driver sees. Ranks
    within a length are counted per bucket of ids, so a length that a third of all pieces share is dealt out.
    """
    spark = docs.sparkSession
    tiers = tuple(t for t in TIERS if t < longest) + (longest,)
    n = fan_out(docs, buckets)
    pieces = written(pieces_of(docs, path, longest).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)).cast("int")))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_packing(histogram, tiers), "length bigint, rank0 bigint, ranks bigint, sequence0 bigint, offset bigint, window bigint")
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(own) - 1)
        .join(firsts, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("first"))
        .withColumn("many", F.lit(max(1, sum(r[2] for r in plan_packing(histogram, tiers) if r[4] == 0) // STEP_SEQUENCES)))
    )
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["rank0"]) & (ranked["rank"] < plan["rank0"] + plan["ranks"])).drop(plan["length"])
    sequence = F.col("sequence0") + F.col("rank") - F.col("rank0")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset", "window", (sequence % F.col("many")).alias("step_group"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(DEFAULT_FILE))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path(DEFAULT_FILE))
