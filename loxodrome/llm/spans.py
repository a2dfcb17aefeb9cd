"""Word hashes, minimisers and the counting of repeated word windows, shared by the operators on repeated passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fan_out, written

#: Characters of text whose minimisers a worker holds at a time (a single longer text is a slice of its own).
WINDOW_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class WordHashes(dict):
    """64-bit hash of each word; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_MEMO = WordHashes()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text."""
    split = [t.encode().split() if t else [] for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    memo = _MEMO
    return np.fromiter((memo[w] for own in split for w in own), np.uint64, int(lengths.sum())), lengths


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n or more of each."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        size = max(n, 1 << 16)
        both = []
        for b in (_BASE, inverse):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _POWERS[0] = tuple(both)
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


class Rolling:
    """Hash of any stretch of a word sequence in constant time, by prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end)."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of each window of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, low, size = np.arange(len(values)), values, 1
    while size * 2 <= width:
        right = low[size:] < low[:-size]
        at = np.where(right, at[size:], at[:-size])
        low = np.where(right, low[size:], low[:-size])
        size *= 2
    if rest := width - size:  # two windows of `size` that overlap
        right = low[rest:] < low[:-rest]
        at = np.where(right, at[rest:], at[:-rest])
    return at[:n]


class Minimisers:
    """Windows of `window` words of a batch of texts, each owned by its leftmost least k-mer.

    The owner depends on the window's words alone, so equal windows have their owners at the same offset, and a
    window can only repeat if its owner's k-mer is owner elsewhere, too.
    """

    def __init__(self, texts: list[str | None], k: int, window: int):
        self.hashes, self.lengths = word_hashes(texts)
        self.rolling = Rolling(self.hashes)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.kmers = self.rolling.windows(k)
        at = sliding_argmin(self.kmers, window - k + 1)
        self.window_at = np.flatnonzero(doc[: len(at)] == doc[window - 1 :]) if len(at) else np.zeros(0, np.int64)
        self.owner = at[self.window_at]
        self.selected = np.unique(self.owner)
        self.doc = doc


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with `rid`, a key of the row that is ordered like doc_id.

    That is doc_id itself where it is a key. Where ids repeat or lack, it is the row's number in a written copy, ordered by
    doc_id (none last) and then by a hash of the text, so that it doesn't depend on how the rows are stored.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where((F.col("n") > 1) | F.col("doc_id").isNull()).limit(1).count():
        return docs.withColumn("rid", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return written(docs.repartitionByRange(fan_out(docs), *order).sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id()))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in the struct `row`, so that no name of theirs clashes."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(None).alias("none")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("row"))


def unpacked(rows: DataFrame, like: DataFrame, text, changed) -> DataFrame:
    """The columns of `like` with a new text, and n_chars to match where `changed`."""
    out = []
    for c in like.columns:
        if c == "doc_id":
            out.append(F.col("doc_id"))
        elif c == "text":
            out.append(text.alias("text"))
        elif c == "n_chars":
            out.append(F.when(changed, F.length(text)).otherwise(F.col("row.n_chars")).cast(like.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return rows.select(*out)


def joined(rows: DataFrame, sized: DataFrame, on: list[str], most: str = "n") -> DataFrame:
    """Inner join of `rows` with `sized`, a written table of distinct keys with the number of their rows in the column `most`.

    Keys with more rows than a quarter of a task's share, at most four for each task, are broadcast, so that their rows stay where
    they are; all others are shuffled.
    """
    parts = fan_out(rows)
    total = sized.agg(F.sum(most)).first()[0] or 0
    hot = sized.where(F.col(most) > max(1000, total // (4 * parts)))
    if not hot.limit(1).count():
        return rows.join(sized, on)
    here = rows.join(F.broadcast(hot), on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(sized.where(F.col(most) <= max(1000, total // (4 * parts))), on)
    return here.unionByName(cold)


def repeated_positions(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `found`, a written table, whose k-mer `nh` occurs more than once, with its count `nodes`; and the written table of those counts.

    Counts are combined before the shuffle, and k-mers that many rows share are broadcast.
    """
    counts = written(found.groupBy("nh").agg(F.count("*").alias("nodes")).where("nodes > 1"))
    return joined(found, counts, ["nh"], "nodes"), counts


def confirmed(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (h1, h2, rid, at, weight): the rows (rid, at) of windows with a joint weight over 1; and the written table of those.

    A row stands for `weight` occurrences. `windows` has to be a written table, as it is read twice.
    """
    keys = written(windows.groupBy("h1", "h2").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).where("w > 1").drop("w"))
    return joined(windows, keys, ["h1", "h2"]).select("rid", "at"), keys


def confirmed_in_order(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with `is_first`: whether the row is the first of its window, by rid and place."""
    first = F.min(F.struct("rid", "at")).alias("first")
    keys = written(windows.groupBy("h1", "h2").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), first).where("w > 1").drop("w"))
    out = joined(windows, keys, ["h1", "h2"])
    return out.select("rid", "at", ((F.col("rid") == F.col("first.rid")) & (F.col("at") == F.col("first.at"))).alias("is_first")), keys


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def merged_lists(lists: pa.ListArray) -> pa.ListArray:
    """The same of each row of an array of lists of spans (a, b), as lists of (start, end); no span becomes a Python object."""
    of, spans = pa.compute.list_parent_indices(lists).to_numpy(), pa.compute.list_flatten(lists)
    a, b = (pa.compute.struct_field(spans, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    base = of * (int(b.max(initial=0)) + 1)  # the rows one after the other, apart
    order = np.argsort(base + a, kind="stable")
    of, base, a = of[order], base[order], a[order]
    reach = np.maximum.accumulate(base + b[order])
    first = np.flatnonzero(np.r_[True, (base + a)[1:] > reach[:-1]]) if len(a) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(a)] - 1 if len(first) else first
    own = pa.StructArray.from_arrays([pa.array(a[first]), pa.array((reach - base)[last])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[first], np.arange(len(lists) + 1)).astype(np.int32)), own)
