"""Quality classifier: gradient-boosted trees over document statistics.

Trees are grown level by level on histograms of binned features and kept as
flat arrays (a complete binary tree each), which are walked for all rows
and trees at once.
"""

from __future__ import annotations

import operator
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, held_out, load, map_rows

FEATURES = ("log_words", "word_length", "word_length_sd", "upper", "symbols", "digits", "punctuation", "stops", "shouts", "distinct", "stutter", "single", "distinct_pairs", "log_lines", "line_words", "dup_lines", "non_ascii", "blanks")
_UPPER, _DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
_SYMBOLS, _PUNCTUATION = b"#*$%&|<>@~^=+_\\{}[]", string.punctuation.encode()


def statistics(text: str | None) -> list[float]:
    """FEATURES of one whole text, all zero for null and empty ones."""
    text = text or ""
    raw, words = text.encode("utf-8", "replace"), text.split()
    n, w = max(1, len(raw)), max(1, len(words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    return [
        np.log1p(len(words)), sizes.mean(), sizes.std(), share(_UPPER), share(_SYMBOLS), share(_DIGITS), share(_PUNCTUATION), raw.count(b".") / w, raw.count(b"!") / w,
        len(set(words)) / w, sum(map(operator.eq, words, words[1:])) / w, float((sizes == 1).sum()) / w, pairs if len(words) > 1 else 0.0,
        np.log1p(len(lines)), w / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), (len(raw) - len(text)) / n, 1 - sizes.sum() / max(1, len(text)),
    ]


class HistogramGBT:
    """Boosted trees for a 0/1 label with logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, min_rows: int = 10):
        self.trees, self.depth, self.bins, self.rate, self.ridge, self.min_rows = trees, depth, bins, rate, ridge, min_rows
        self.base = 0.0
        nodes, leaves = 2**depth - 1, 2**depth
        self.feature = np.zeros((trees, nodes), np.int32)
        self.threshold = np.full((trees, nodes), np.inf)
        self.value = np.zeros((trees, leaves))

    def fit(self, x: np.ndarray, y: np.ndarray) -> HistogramGBT:
        """No rows leave even odds."""
        n, width = x.shape
        if not n:
            return self
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        cuts = [np.unique(np.quantile(x[:, j], np.arange(1, self.bins) / self.bins)) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b: cuts[b-1] < x <= cuts[b]
        margin = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)  # within the level
            for level in range(self.depth):
                count, first = 2**level, 2**level - 1
                best = np.zeros(count)
                for j in range(width):
                    key = node * self.bins + binned[:, j]
                    g, h, c = (np.bincount(key, wt, count * self.bins).reshape(count, self.bins).cumsum(1) for wt in (grad, hess, None))
                    gr, hr, cr = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                    gain = g**2 / (h + self.ridge) + gr**2 / (hr + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                    gain[(c < self.min_rows) | (cr < self.min_rows)] = 0
                    gain[:, len(cuts[j]) :] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(count), at] > best + 1e-9
                    best = np.where(better, gain[np.arange(count), at], best)
                    rows = first + np.flatnonzero(better)
                    self.feature[t, rows] = j
                    self.threshold[t, rows] = cuts[j][at[better]]
                f, cut = self.feature[t, first + node], self.threshold[t, first + node]
                node = node * 2 + (x[np.arange(n), f] > cut)
            g, h = (np.bincount(node, wt, 2**self.depth) for wt in (grad, hess))
            self.value[t] = self.rate * g / (h + self.ridge)
            margin += self.value[t][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, all rows and trees walked together."""
        if not len(x):
            return np.zeros(0)
        tree, row = np.arange(self.trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), self.trees), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        leaf = node - (2**self.depth - 1)
        return 1 / (1 + np.exp(-(self.base + self.value[tree, leaf].sum(1))))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000, modulus: int = 4, left_out: int = 2, **options) -> HistogramGBT:
    """Trees fitted to at most ``max_rows`` labelled documents, those with the least md5 of doc_id.

    Rows whose crc32(doc_id) leaves left_out modulo modulus are never seen,
    nor are null doc_ids and null labels. A document with several labels
    counts with each, as do several documents of one doc_id, up to max_rows.
    """
    chosen = labels.filter((crc_remainder("doc_id", modulus) != left_out) & F.col("quality").isNotNull()).select(F.col("doc_id").alias("label_id"), "quality").orderBy(F.md5(F.col("label_id").cast("string")), "label_id", "quality").limit(max_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # max_rows pairs of numbers at most

    def make():
        return lambda got: [(str(r["doc_id"]), float(r["quality"]), statistics(r["text"])) for r in got]

    found = map_rows(rows.select("doc_id", "quality", "text"), make, "doc_id string, quality double, x array<double>")
    got = sorted(map(tuple, found.orderBy(F.md5("doc_id"), "doc_id", "quality", "x").limit(max_rows).collect()))
    x = np.array([r[2] for r in got]).reshape(-1, len(FEATURES))
    return HistogramGBT(**options).fit(x, np.array([r[1] for r in got]))


def classify(documents: DataFrame, model: HistogramGBT, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every document; null and empty texts are scored by their (zero) statistics. Extra columns are ignored, repeated rows scored one by one."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        def fn(rows):
            scores = model.score(np.array([statistics(r["text"]) for r in rows]))
            return [(r["doc_id"], float(s), int(s >= threshold)) for r, s in zip(rows, scores, strict=True)]

        return fn

    return map_rows(documents.select("doc_id", "text"), make, f"doc_id {kind}, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null doc_id isn't held out."""
    docs = load(spark, sf_dir, "documents")
    model = train(docs, load(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
