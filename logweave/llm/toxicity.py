"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space collapsed, and every n-gram of N_MIN to N_MAX
characters (with the blanks at word borders) hashed into one of 2**BITS features, present or
absent. From labelled text each feature gets its log-count ratio r = log(p / q), p and q being
its smoothed shares among toxic and other texts. A logistic model is fitted to the present
features scaled by r, so features that don't separate the classes start near nothing. Weight
times ratio is kept per feature: scoring a text adds up one table over its distinct features.

Features seen in one labelled text only, or with a ratio within LEAST_RATIO of 0, have no weight.

The fit reads at most MAX_PER_CLASS distinct labels of each class, in the order of a hash of
doc_id, and one text for each (of several under a doc_id, that with the smallest hash). Texts are
hashed on the executors; the driver gets counts per feature and the sample's separating features.
Scoring reads every row and whole texts. The folds: rows whose crc32 of the decimal
doc_id leaves HELD_OUT modulo FOLDS are never learnt from. Labels, lang, source and doc_id are
never features.

Defined results: null text counts as empty; an empty text has no features and its score is that
of the intercept; repeated rows each get a score; without labels of both kinds every score is
the share of label 1 (0.5 without labels); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
N_MIN, N_MAX, BITS = 3, 6, 20
#: Bound of the training sample, for each class.
MAX_PER_CLASS = 1_500
#: Code points of the part of a text that is hashed at a time; parts overlap by N_MAX - 1.
PART = 1 << 18
EPOCHS, RATE, RIDGE, SMOOTH, LEAST_RATIO = 150, 0.5, 1e-4, 1.0, 0.5

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _distinct(idx: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """The distinct values of idx: one position per value is the last to stamp it."""
    at = np.arange(len(idx), dtype=np.int32)
    stamp[idx] = at
    return idx[stamp[idx] == at]


def _present(text: str | None, stamp: np.ndarray) -> np.ndarray:
    """Indices of the features of a whole text; stamp is a scratch table of 2**BITS int32."""
    t = f" {' '.join((text or '').lower().split())} "
    found = [np.empty(0, np.int64)]
    with np.errstate(over="ignore"):
        for at in range(0, len(t) - N_MIN + 1, PART):
            c = np.frombuffer(t[at : at + PART + N_MAX - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
            h, seen = np.zeros(len(c), np.uint64), []
            for n in range(1, min(N_MAX, len(c)) + 1):
                h = h[: len(c) - n + 1] * _MUL + c[n - 1 :] + np.uint64(n)
                if n >= N_MIN:
                    seen.append(((h ^ (h >> np.uint64(29))) * _MUL >> np.uint64(64 - BITS)).astype(np.int64))
            if seen:
                found.append(_distinct(np.concatenate(seen), stamp))
    return found[1] if len(found) == 2 else _distinct(np.concatenate(found), stamp)


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float

    def score(self, texts) -> np.ndarray:
        stamp = np.zeros(1 << BITS, np.int32)
        z = np.array([self.weights[_present(t, stamp)].sum(dtype=np.float64) for t in texts], dtype=float) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_ratios(p: np.ndarray, q: np.ndarray, toxic: int, other: int) -> np.ndarray:
    """Log-count ratio of every feature from its counts; 0 for those without a say."""
    p, q = p + SMOOTH, q + SMOOTH
    ratio = np.log(p / (toxic + 2 * SMOOTH)) - np.log(q / (other + 2 * SMOOTH))
    ratio[((p + q) < 2 * SMOOTH + 2) | (np.abs(ratio) <= LEAST_RATIO)] = 0
    return ratio


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, mean_features: float) -> Linear:
    """Full-batch gradient descent with per-feature step sizes, over the rows' features that have a ratio."""
    size = 1 << BITS
    if len(y) == 0 or y.min() == y.max():
        rate = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Linear(np.zeros(size, np.float32), float(np.log(rate / (1 - rate))))
    used = np.flatnonzero(ratio)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    col = place[np.concatenate(rows)]
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in rows])
    r = ratio[used].astype(np.float32)
    w, b = np.zeros(len(used), np.float32), float(np.log(y.mean() / (1 - y.mean())))
    scale = 1.0 / np.sqrt(max(1.0, mean_features))
    value = (r * np.float32(scale))[col]
    sq, sqb = np.full(len(used), 1e-8), 1e-8
    # both classes weigh the same, whatever their numbers
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    for _ in range(EPOCHS):
        z = np.bincount(row, w[col] * value, len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        e = e.astype(np.float32)
        g = np.bincount(col, e[row] * value, len(used)) / len(y) + RIDGE * w
        gb = float(e.mean())
        sq += g * g
        sqb += gb * gb
        w -= (RATE * g / np.sqrt(sq)).astype(np.float32)
        b -= RATE * gb / np.sqrt(sqb)
    out = np.zeros(size, np.float32)
    out[used] = w * r * scale
    return Linear(out, b)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def labelled_features(docs: DataFrame, labels: DataFrame, max_per_class: int) -> DataFrame:
    """(id, y, x): the features of the training sample, hashed on the executors."""
    key = F.col("doc_id").cast("long")
    lab = labels.select(key.alias("id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and id is not null").where(~held_out(F.col("id"))).distinct()
    picked = None
    for k in (0, 1):
        part = lab.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(max_per_class)
        picked = part if picked is None else picked.union(part)
    # bounded: two classes of at most max_per_class rows of two numbers
    rows = docs.select(key.alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("id", "y", "t.text")

    def run(batches):
        stamp = np.zeros(1 << BITS, np.int32)
        for p in batches:
            yield pd.DataFrame({"id": p["id"], "y": p["y"], "x": [np.sort(_present(t, stamp)).astype(np.int32) for t in p["text"]]})

    return rows.mapInPandas(run, "id long, y int, x array<int>")


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Linear:
    with scratch(docs.sparkSession):
        sample = materialize(labelled_features(docs, labels, max_per_class), "toxicity-sample")
        size = 1 << BITS

        def counted(batches):
            p, n = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for pdf in batches:
                for y, x in zip(pdf["y"], pdf["x"]):
                    n[x] += 1
                    p[x] += y
            f = np.flatnonzero(n)
            yield pd.DataFrame({"f": f, "p": p[f], "n": n[f]})

        # at most 2**BITS rows, whatever the texts
        counts = sample.mapInPandas(counted, "f long, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toPandas()
        p, n = np.zeros(size), np.zeros(size)
        p[counts["f"]], n[counts["f"]] = counts["p"], counts["n"]
        per = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
        ratio = log_ratios(p, n - p, per.get(1, 0), per.get(0, 0))
        says = ratio != 0

        def separating(batches):
            for pdf in batches:
                yield pdf.assign(x=[np.asarray(x, np.int32)[says[x]] for x in pdf["x"]])

        # only what separates the classes reaches the driver
        got = sample.mapInPandas(separating, sample.schema).toPandas().sort_values(["id", "y"], kind="stable")
    return fit([np.asarray(x, np.int64) for x in got["x"]], got["y"].to_numpy(float), ratio, n.sum() / max(1, len(got)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # one table of 2**BITS numbers

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.value.score(pdf["text"])})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
