"""Toxicity by a linear-chain conditional random field over words.

Only whole documents are labelled, so token labels are derived: within toxic training documents, words with a feature that is
far more frequent in toxic than in clean documents are toxic tokens. A two-state chain is trained on
them by conditional likelihood; forward-backward marginals are aggregated to a document score by a small logistic model.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_CHARS, in_fold, slices, table

ORACLE_SQL = None
#: Bounds of the sample of labelled rows that the model is trained on, by class.
TRAIN_TOXIC, TRAIN_CLEAN = 1500, 2500
#: Documents with a feature, and how many times as frequent it is in toxic ones, for a word with it to be labelled.
LEAST_DOCS, LEAST_ODDS = 4, 12.0
EPOCHS, RATE, RIDGE = 25, 0.3, 1e-4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^\W+|\W+$")


def features_of(word: str) -> tuple[str, ...]:
    """Lower-case core of the word, its first four and five characters and its last four."""
    core = _EDGE.sub("", word.lower())
    return (f"w{core}", f"4{core[:4]}", f"5{core[:5]}", f"s{core[-4:]}") if len(core) > 3 else (f"w{core}",)


def chain(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once.

    scores: log-odds of the toxic state of all words, sequence after sequence. trans: 2x2 transition scores.
    Returns the marginals, the expected transitions and the log-normalisers (relative to clean emissions). Sequences are walked
    in lock step, longest first, so that step t works on those that have a word t.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths)
    first = (ends - lengths)[order]
    sorted_len = lengths[order]
    most = int(sorted_len[0]) if n else 0
    active = np.searchsorted(-sorted_len, -np.arange(most), side="left")  # sequences longer than t
    a = np.exp(trans)
    forward, marginal = np.empty((len(scores), 2)), np.empty(len(scores))
    emit = np.exp(np.clip(scores, -30, 30))
    log_z, expected = np.zeros(n), np.zeros((2, 2))
    state = np.empty((n, 2))
    for t in range(most):
        k = active[t]
        at = first[:k] + t
        if t:
            f0 = state[:k, 0] * a[0, 0] + state[:k, 1] * a[1, 0]
            f1 = (state[:k, 0] * a[0, 1] + state[:k, 1] * a[1, 1]) * emit[at]
        else:
            f0, f1 = np.ones(k), emit[at] * a[0, 1]
        z = f0 + f1
        log_z[:k] += np.log(z)
        state[:k, 0], state[:k, 1] = f0 / z, f1 / z
        forward[at] = state[:k]
    back = np.ones((n, 2))
    for t in range(most - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        f = forward[at]
        m0, m1 = f[:, 0] * back[:k, 0], f[:, 1] * back[:k, 1]
        marginal[at] = m1 / (m0 + m1)
        if t:
            b0, b1 = back[:k, 0], back[:k, 1] * emit[at]
            before = forward[at - 1]
            cells = np.stack([before[:, i] * a[i, j] * (b0, b1)[j] for i in (0, 1) for j in (0, 1)])
            expected += (cells / cells.sum(0)).sum(1).reshape(2, 2)
            n0, n1 = a[0, 0] * b0 + a[0, 1] * b1, a[1, 0] * b0 + a[1, 1] * b1
            s = n0 + n1
            back[:k, 0], back[:k, 1] = n0 / s, n1 / s
    out = np.zeros(n)
    out[order] = log_z
    return marginal, expected, out


def gathered(marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of a document: bias, log-odds of its largest marginal, log of the expected toxic words, their share."""
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1
    out[:, 1] = -8.0
    has = lengths > 0
    if has.any():
        starts = (np.cumsum(lengths) - lengths)[has]
        top = np.clip(np.maximum.reduceat(marginal, starts), 1e-6, 1 - 1e-6)
        total = np.add.reduceat(marginal, starts)
        out[has, 1] = np.maximum(-8, np.log(top / (1 - top)))
        out[has, 2] = np.log(total + 0.01)
        out[has, 3] = np.log((total + 0.01) / lengths[has])
    out[~has, 2:] = np.log(0.01)
    return out


def train(texts: list[str], labels: list[int]) -> dict:
    """Weights of the chain and of the document model from labelled texts."""
    y = np.array(labels, float)
    n_toxic, n_clean = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    number: dict[str, int] = {}  # of each distinct word; all per-word work is done once
    tokens, lengths = array("i"), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = [number.setdefault(w, len(number)) for w in WORD.findall(text or "")]
        tokens.extend(own)
        lengths[i] = len(own)
    words = np.frombuffer(tokens, np.int32) if tokens else np.zeros(0, np.int32)
    ends = np.cumsum(lengths)
    names: dict[str, int] = {}
    of_word = [[names.setdefault(f, len(names)) for f in features_of(w)] for w in number]
    seen = np.zeros((2, len(names)))
    for i, label in enumerate(labels):
        seen[label, list({f for w in set(words[ends[i] - lengths[i] : ends[i]].tolist()) for f in of_word[w]})] += 1
    strong = (seen[1] >= LEAST_DOCS) & (seen[1] / n_toxic >= LEAST_ODDS * (seen[0] + 0.5) / n_clean)
    known = seen.sum(0) >= LEAST_DOCS
    row = np.repeat(np.arange(len(number)), [len(x) for x in of_word])
    feature = np.array([f for x in of_word for f in x], np.int64)
    row, feature = row[known[feature]], feature[known[feature]]
    is_toxic = np.zeros(len(number), bool)
    is_toxic[row[strong[feature]]] = True
    gold = (is_toxic[words] & np.repeat(y > 0, lengths)).astype(float)
    weights, bias, trans = np.zeros(len(names)), -3.0, np.zeros((2, 2))
    g_w, g_b, g_t = np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    g = gold.astype(int)
    inner = np.ones(len(gold), bool)
    inner[(ends - lengths)[lengths > 0]] = False
    target = np.zeros((2, 2))
    if len(gold) > 1:
        np.add.at(target, (g[:-1][inner[1:]], g[1:][inner[1:]]), 1)
    for _ in range(EPOCHS if gold.any() else 0):
        scores = bias + np.bincount(row, weights[feature], len(number))[words]
        marginal, expected, _ = chain(scores, lengths, trans)
        miss = gold - marginal
        d_w = np.bincount(feature, np.bincount(words, miss, len(number))[row], len(names)) - RIDGE * len(gold) * weights * 1e-2
        d_b, d_t = miss.sum(), target - expected
        g_w += d_w**2
        g_b += d_b**2
        g_t += d_t**2
        weights += RATE * d_w / np.sqrt(g_w)
        bias += RATE * d_b / np.sqrt(g_b)
        trans += RATE * d_t / np.sqrt(g_t)
    scores = bias + np.bincount(row, weights[feature], len(number))[words] if len(words) else np.zeros(0)
    x = gathered(chain(scores, lengths, trans)[0], lengths)
    coef = np.array([-2.0, 0.5, 0.0, 0.0])
    for _ in range(30 if y.any() and not y.all() else 0):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(4)
        coef += np.linalg.solve(h, x.T @ (y - p) - coef)
    kept = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-3}
    return {"weights": kept, "bias": float(bias), "trans": trans, "coef": coef}


def model_of(docs: DataFrame, labels: DataFrame) -> dict:
    """Train on a bounded sample (TRAIN_TOXIC, TRAIN_CLEAN) of the labelled rows outside fold 0, by hash order of the id."""
    own = labels.where(F.col("toxic").isin(0, 1) & (in_fold() != 0)).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id", F.lit(9))
    picked = None
    for label, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        part = own.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("doc_id").select("text", "toxic").toArrow()
    return train(rows["text"].to_pylist(), rows["toxic"].to_pylist())


class _Words(dict):
    """Emission score of each word; forgets all when it is full."""

    def __init__(self, model: dict):
        self.weights, self.bias = model["weights"], model["bias"]

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        get = self.weights.get
        score = self[word] = self.bias + sum([get(f, 0.0) for f in features_of(word)])
        return score


def _scored(texts: list[str], model: dict, emission: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the texts, marginals of all their words, and the number of words of each."""
    words = [WORD.findall(t) if t else [] for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    scores = np.fromiter((emission[w] for own in words for w in own), float, int(lengths.sum()))
    marginal = chain(scores, lengths, model["trans"])[0]
    return 1 / (1 + np.exp(-np.clip(gathered(marginal, lengths) @ model["coef"], -30, 30))), marginal, lengths


def toxicity(docs: DataFrame, model: dict, with_spans: bool = True) -> DataFrame:
    """Columns doc_id, score (0 to 1), n_toxic_words, and spans: array of (start, end) code points of words whose marginal is 0.5 or more.

    Null and empty texts have no words and get the model's score for that. Repeated rows are scored alike; other columns
    are not read; an empty table gives no rows. Narrow: no shuffle; the model is bounded by the training sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        emission = _Words(model)
        for part in slices(batches):
            texts = [t or "" for t in part["text"]]
            p, marginal, lengths = _scored(texts, model, emission)
            ends = np.cumsum(lengths)
            hits = np.flatnonzero(marginal >= 0.5)
            of = np.searchsorted(ends, hits, side="right")
            by_doc = defaultdict(list)
            for doc, hit in zip(of.tolist(), hits.tolist(), strict=True):
                by_doc[doc].append(hit - int(ends[doc] - lengths[doc]))
            spans = [[] for _ in texts]
            if with_spans:
                for doc, own in by_doc.items():
                    wanted = set(own)
                    spans[doc] = [{"start": m.start(), "end": m.end()} for i, m in enumerate(WORD.finditer(texts[doc])) if i in wanted]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(part["doc_id"], pa.int64()),
                    "score": pa.array(p, pa.float64()),
                    "n_toxic_words": pa.array([len(by_doc.get(i, ())) for i in range(len(texts))], pa.int64()),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, n_toxic_words bigint, spans array<struct<start:bigint,end:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, model_of(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (in_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_words", "spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5. Rows and columns stay as they are; the filter runs over the same pass as the score."""
    model = model_of(docs, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts):
        import pandas as pd

        model = shared.value
        emission = _Words(model)
        out, at, room = [], 0, SLICE_CHARS
        texts = [t or "" for t in texts]
        for i, t in enumerate(texts):  # a bounded number of characters at a time
            if room < len(t) and i > at:
                out.append(_scored(texts[at:i], model, emission)[0])
                at, room = i, SLICE_CHARS
            room -= len(t)
        out.append(_scored(texts[at:], model, emission)[0])
        return pd.Series(np.concatenate(out))

    return docs.where(score(F.col("text")) < 0.5)
