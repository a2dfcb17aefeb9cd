"""Quality rules whose cutoffs come from labelled holdouts under exact binomial bounds.

Every rule rejects a document whose measure exceeds a cutoff. Labelled documents are split: quantiles of good documents in
the tuning quarter propose cutoffs, from lenient to strict; the holdout, the other three quarters, tests them in that order (fixed-sequence testing),
each by the exact binomial test of "at least `risk` of good documents are rejected". The last one that passes is used.
The level is shared by Bonferroni among all rules and strata, and a stratum's risk among its rules, so that with
probability 1 - `level` no stratum loses more than `risk` of its good documents to the rules.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, in_fold, slices, table

ORACLE_SQL = None
SYMBOLS = "#*$%&|<>"
RISK, LEVEL = 0.05, 0.05
#: Strata are languages, folded into so many groups, so that the table of cutoffs is bounded.
STRATA = 256
#: Shares of good tuning documents above the proposed cutoffs, in terms of a rule's risk, from lenient to strict: sixteenths up to
#: twice the risk, then doubled up to all documents (tails_of), so that the exact test decides where a stratum stops.
TAIL_STEPS = tuple(k / 16 for k in range(33))
MEASURES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "few_kinds")


def repeated_words(ids: np.ndarray, lengths: np.ndarray, kinds: int) -> np.ndarray:
    """Words of each text that lie in a window of three words that occurs twice or more in it. ids < kinds; kinds**3 must fit."""
    out = np.zeros(len(lengths), np.int64)
    n = len(ids)
    if n < 4:
        return out
    doc = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    if len(inside) < 2:
        return out
    if kinds < 1 << 21:
        code = (ids[inside] * kinds + ids[inside + 1]) * kinds + ids[inside + 2]
    else:  # number the pairs first, so that the codes fit
        pair = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
        code = pair[inside] * kinds + ids[inside + 2]
    order = np.argsort(code, kind="stable")  # equal codes stay in order of their texts
    code, of = code[order], doc[inside][order]
    same = (code[1:] == code[:-1]) & (of[1:] == of[:-1])
    twice = np.zeros(len(code), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    covered = np.zeros(n, bool)
    covered[at] = covered[at + 1] = covered[at + 2] = True
    np.add.at(out, doc[covered], 1)
    return out


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base columns and MEASURES of every row. A null text has no words. Narrow."""

    def run(batches):
        for part in slices(batches):
            texts = [t or "" for t in part["text"]]
            split = [t.encode().split() for t in texts]
            lengths = np.array([len(w) for w in split], np.int64)
            kinds: dict[bytes, int] = {}
            ids = np.fromiter((kinds.setdefault(w, len(kinds)) for own in split for w in own), np.int64, int(lengths.sum()))
            repeats = repeated_words(ids, lengths, max(1, len(kinds)))
            rows = defaultdict(list)
            for i, (t, words) in enumerate(zip(texts, split, strict=True)):
                chars = len(t) - sum(t.count(c) for c in WORD_SPACE)
                lines = [x for x in t.split("\n") if x.strip(WORD_SPACE)]
                n = len(words)
                symbols, dups = sum(t.count(c) for c in SYMBOLS), len(lines) - len(set(lines))
                upper = len(t) - len(t.translate(_NO_UPPER)) if t.isascii() else sum(map(str.isupper, t))
                for key, value in zip(
                    ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES),
                    (n, chars, symbols, dups, int(repeats[i]), symbols / max(1, chars), repeats[i] / max(1, n), dups / max(1, len(lines)), upper / max(1, chars), (t.count("!") + t.count("?")) / max(1, n), -len(set(words)) / max(1, n) ** 0.8),
                    strict=True,
                ):
                    rows[key].append(value)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(part["doc_id"], pa.int64()), "lang": pa.array(part["lang"], pa.string())}
                | {k: pa.array(rows[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                | {k: pa.array([float(x) for x in rows[k]], pa.float64()) for k in MEASURES}
            )

    longs = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    return docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id bigint, lang string, {longs}, " + ", ".join(f"{m} double" for m in MEASURES))


_NO_UPPER = {c: None for c in range(ord("A"), ord("Z") + 1)}


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, summed in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def chosen(cutoffs: list[float], rejected: list[int], n: int, risk: float, level: float) -> float:
    """The strictest cutoff of a sequence from lenient to strict that passes the exact test, infinity if the first fails."""
    best = math.inf
    for cutoff, k in zip(cutoffs, rejected, strict=True):
        if not n or binomial_cdf(k, n, risk) > level:
            break
        best = cutoff
    return best


def tails_of(risk: float) -> list[float]:
    """Tails to propose cutoffs at for a rule of that risk; the last one is everything."""
    tails = [k * risk for k in TAIL_STEPS if k * risk < 1]
    while 2 * tails[-1] < 1:
        tails.append(2 * tails[-1])
    return [*tails, 1.0]


def stratum_of():
    return F.pmod(F.crc32(F.coalesce(F.col("lang"), F.lit(""))), F.lit(STRATA)).cast("int")


def cutoffs_of(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[int, list[float]]:
    """Cutoffs by stratum, in the order of MEASURES. Only counts and quantiles of at most STRATA strata reach the driver."""
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    own = measured.join(good, "doc_id").select(stratum_of().alias("stratum"), (in_fold(folds=4) == 0).alias("tuning"), *MEASURES)
    tails = tails_of(risk / len(MEASURES))
    quantiles = own.where("tuning").groupBy("stratum").agg(*[F.percentile_approx(m, [1 - t for t in tails], 20_000).alias(m) for m in MEASURES]).collect()
    proposed = {r["stratum"]: {m: r[m] for m in MEASURES} for r in quantiles}
    if not proposed:
        return {}
    table_ = own.sparkSession.createDataFrame([(s, *[q[m] for m in MEASURES]) for s, q in proposed.items()], "stratum int, " + ", ".join(f"q_{m} array<double>" for m in MEASURES))
    held = own.where("NOT tuning").join(F.broadcast(table_), "stratum").groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col(m) > F.col(f"q_{m}")[i]).alias(f"{m}_{i}") for m in MEASURES for i in range(len(tails))]).collect()
    tests = len(held) * len(MEASURES)
    return {r["stratum"]: [chosen(proposed[r["stratum"]][m], [r[f"{m}_{i}"] for i in range(len(tails))], r["n"], risk / len(MEASURES), level / tests) for m in MEASURES] for r in held}


def quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Base columns, base_failed, kept and rejected_by (names of the rules that reject) of every row.

    A null or empty text has no words and fails the base rules. A null language is a stratum of its own; a stratum
    without enough labelled documents to prove any cutoff rejects nothing. Repeated rows are judged alike, an empty table gives no rows.
    Each of two passes measures the texts; only rows of labelled documents (without their texts) are shuffled.
    """
    found = cutoffs_of(measures(docs.join(F.broadcast(labels.where(F.col("quality") == 1).select("doc_id").distinct()), "doc_id", "left_semi")) if _small(labels) else measures(docs), labels, risk, level)
    out = measures(docs).withColumn("stratum", stratum_of())
    rows = [(s, *own) for s, own in found.items()]
    table_ = docs.sparkSession.createDataFrame(rows, "stratum int, " + ", ".join(f"c_{m} double" for m in MEASURES))
    out = out.join(F.broadcast(table_), "stratum", "left")
    by = F.array_compact(F.array(*[F.when(F.col(m) > F.col(f"c_{m}"), m) for m in MEASURES]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("rejected_by", by).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def _small(labels: DataFrame, most: int = 2_000_000) -> bool:
    """Whether the labelled ids are few enough (16 MB) to be broadcast; else all rows are measured and joined by shuffle."""
    return labels.limit(most + 1).count() <= most


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
