"""Quality classifier: a generalised additive model with pairwise interactions.

Every document becomes a short vector of text statistics. Training bins each feature at
quantiles and cycles over the features: in each round a shallow tree (a few leaves over the
bins) is fitted to the gradient of the log loss and its leaves are added, damped, to the
feature's lookup table. Pairs of features that explain most of what is left then get tables
over their two bins, boosted the same way. A document's score is the sigmoid of the sum of its
table entries, looked up by vectorised bin numbers.

The fit reads at most MAX_LABELLED distinct labels, in the order of a hash of doc_id, and one text
for each (of several under a doc_id, that with the smallest features); scoring reads every row. The folds: rows whose crc32 of the decimal doc_id leaves HELD_OUT modulo FOLDS are
never learnt from. Labels, lang, source and doc_id are never features.

Defined results: null text counts as empty; empty texts are scored like others; repeated rows
each get a score; without labels of both kinds every score is the share of label 1 (0.5
without labels); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Bound of the training sample.
MAX_LABELLED = 12_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15

FEATURES = (
    "chars", "words", "mean_word", "upper_share", "upper_words", "digit_share", "symbol_share", "punct_per_word",
    "bang_share", "pipe_share", "repeat_share", "distinct_share", "top_word_share", "sentences_per_word", "line_words",
    "distinct_lines", "word_symbol_share", "long_word_share",
)
_UPPER = regex.compile(r"\p{Lu}")
_LETTER = regex.compile(r"\p{L}")
_DIGIT = regex.compile(r"\p{N}")
_SYMBOL = regex.compile(r"[^\p{L}\p{N}\p{White_Space}.,;:'\"()\-]")


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of FEATURES."""
    t = text or ""
    n = len(t) or 1
    words = t.split()
    k = len(words) or 1
    distinct = set(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = t.split("\n")
    letters = sum(map(len, _LETTER_RUNS.findall(t)))
    upper = len(_UPPER.findall(t))
    symbols = _SYMBOL.findall(t)
    return [
        float(np.log1p(len(t))),
        float(np.log1p(len(words))),
        letters / k,
        upper / (letters or 1),
        sum(map(str.isupper, words)) / k,
        len(_DIGIT.findall(t)) / n,
        len(symbols) / n,
        (t.count(".") + t.count(",") + t.count(";") + t.count(":")) / k,
        t.count("!") / k,
        t.count("|") / k,
        sum(a == b for a, b in zip(words, words[1:])) / k,
        len(distinct) / k,
        max(counts.values(), default=0) / k,
        sum(w[-1] in ".?" for w in words) / k,
        float(np.log1p(k / len(lines))),
        len(set(lines)) / len(lines),
        sum(1 for w in distinct if _WORD_SYMBOLS.search(w)) / (len(distinct) or 1),
        sum(len(w) > 14 for w in distinct) / (len(distinct) or 1),
    ]


_LETTER_RUNS = regex.compile(r"\p{L}+")
_WORD_SYMBOLS = regex.compile(r"[%*$&#@^~=<>{}\[\]\\|!]{2}")


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


@dataclass
class Gam:
    """Lookup tables over bins; edges[i] separates the bins of feature i."""

    edges: list[np.ndarray]
    base: float
    single: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for i, table in enumerate(self.single):
            z += table[np.searchsorted(self.edges[i], x[:, i], side="right")]
        if self.pairs:
            coarse = _binned(x, self.pair_edges)
            for i, j, table in self.pairs:
                z += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 2.0) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins, from their gradient and curvature sums."""
    out = np.empty(len(g))

    def grow(a: int, b: int, d: int) -> None:
        G, H = g[a:b].sum(), h[a:b].sum()
        if d and b - a > 1:
            cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gain = cg**2 / (ch + 1) + (G - cg) ** 2 / (H - ch + 1) - G**2 / (H + 1)
            gain[(ch < least) | (H - ch < least)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-6:
                grow(a, a + k + 1, d - 1)
                grow(a + k + 1, b, d - 1)
                return
        out[a:b] = G / (H + 1)

    grow(0, len(g), depth)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over a bin grid: one cut on an axis, then the best cut of each part on the other."""
    best, value = -1.0, np.full(g.shape, g.sum() / (h.sum() + 1))
    for axis in (0, 1):
        G, H = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, G.shape[0]):
            out = np.empty(G.shape)
            gain = 0.0
            for part in (slice(0, cut), slice(cut, None)):
                leaf = _tree(G[part].sum(0), H[part].sum(0), depth=1)
                out[part] = leaf
                gain += float((leaf * G[part].sum(0)).sum())
            if gain > best:
                best, value = gain, out if axis == 0 else out.T
    return value


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the single tables, then of the chosen pairs."""
    if len(y) == 0 or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        base = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
        return Gam([np.empty(0)] * x.shape[1], base, [np.zeros(1)] * x.shape[1])
    edges = _edges(x, BINS)
    bins = _binned(x, edges)
    rate = y.mean()
    model = Gam(edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges])
    z = np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, table in enumerate(model.single):
            g, h = slope()
            step = RATE * _tree(np.bincount(bins[:, i], g, len(table)), np.bincount(bins[:, i], h, len(table)))
            table += step
            z += step[bins[:, i]]
    model.pair_edges = _edges(x, PAIR_BINS)
    coarse = _binned(x, model.pair_edges)
    width = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, i] * width[j] + coarse[:, j], v, width[i] * width[j]).reshape(width[i], width[j])

    g, h = slope()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            G, H = grid(i, j, g), grid(i, j, h)
            gains.append((float((_pair_tree(G, H) * G).sum()), i, j))
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slope()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))
            table += step
            z += step[coarse[:, i], coarse[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Gam:
    """Fit on labelled rows outside the held-out fold."""
    key = F.col("doc_id").cast("long")
    lab = (
        labels.select(key.alias("id"), F.col("quality").cast("double").alias("y"))
        .where(F.col("y").isNotNull() & ~F.isnan("y") & F.col("id").isNotNull())
        .where(~held_out(F.col("id"))).distinct()
        .orderBy(F.xxhash64("id"), "id", "y")
        .limit(max_labelled)
    )
    # the labelled side is bounded by max_labelled rows of two numbers
    rows = docs.select(key.alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(lab), "id")

    def read(batches):
        for p in batches:
            yield pd.DataFrame({"id": p["id"], "y": p["y"], "x": [features(t) for t in p["text"]]})

    # of several texts of a doc_id the smallest vector counts, so there is one row per label
    got = rows.mapInPandas(read, "id long, y double, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x")).toPandas()
    got = got.sort_values(["id", "y"], kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Gam, column: str = "score") -> DataFrame:
    """docs (doc_id and text) with the score."""

    def run(batches):
        for pdf in batches:
            x = np.array([features(t) for t in pdf["text"]], dtype=float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], column: model.score(x)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id long, {column} double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the model accepts."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    # as Arrow batches, so that the other columns pass through as they are
    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(at).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
