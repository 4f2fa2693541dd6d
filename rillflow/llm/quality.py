"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the whole text (``statistics``).  Trees are grown
level by level on binned columns with logistic loss (``fit``) and flattened
into arrays of features, thresholds and leaf values, so a batch of documents
goes down all trees at once by numpy indexing (``Forest.scores``).

The trees are fitted on labelled rows only, at most ``SAMPLE`` of them, drawn by
a hash of the id (a documented bound on what the driver holds: SAMPLE rows of
statistics).  Neither labels nor other columns are inputs of a score.  Without
usable labels all scores are 0.5; with one class only, its smoothed share.
Null text counts as empty and gets a score like any other; null labels are no
labels.  Repeated labels of an id all count; ids of more than ``OFTEN``
documents are not learned from, so what the driver holds stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep_rows, map_batches, texts_of

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 20_000
#: Ids that more documents have aren't learned from: their labels say little of any one of them.
OFTEN = 8
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 1.0, 2.0

_SYMBOLS = "|!&%$#*@=<>{}[]()_/\\~^+:;,.?-'\""
NAMES = ["log_bytes", "log_words", "word_length", "log_lines", "words_a_line", "upper", "lower", "digit", "space", "newline", "beyond_ascii", "distinct_words", "distinct_lines", "short_words", "longest_word", *(f"char_{ord(c)}" for c in _SYMBOLS)]


def statistics(text: str) -> list[float]:
    """One row of NAMES for a whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    w = max(1, len(words))
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        lengths.sum() / w,
        np.log1p(len(lines)),
        len(words) / max(1, len(lines)),
        counts[65:91].sum() / n,
        counts[97:123].sum() / n,
        counts[48:58].sum() / n,
        counts[32] / n,
        counts[10] / n,
        counts[128:].sum() / n,
        len(set(words)) / w,
        len(set(lines)) / max(1, len(lines)),
        (lengths <= 3).sum() / w,
        np.log1p(lengths.max(initial=0)),
        *(counts[ord(c)] / n for c in _SYMBOLS),
    ]


@dataclass
class Forest:
    """Complete trees of one depth as arrays: feature and threshold by tree and node, value by tree and leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        t = np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
        return 1 / (1 + np.exp(-(self.base + self.value[t, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees for labels 0/1.  Columns are binned at quantiles; at each level one histogram of gradients a node and column gives the best split."""
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    if len(y) < 2 or y.min() == y.max():
        return none
    n, columns = x.shape
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(columns)]
    binned = np.stack([np.searchsorted(cut, x[:, c], side="left") for c, cut in enumerate(cuts)], axis=1)
    feature, threshold, value = [], [], []
    score = np.full(n, none.base)
    at = binned + BINS * np.arange(columns)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        f, cut_at = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            width, first = 2**depth, 2**depth - 1
            local = (node - first)[:, None] * (BINS * columns) + at
            size = width * BINS * columns
            g = np.bincount(local.ravel(), np.repeat(grad, columns), size).reshape(width, columns, BINS).cumsum(axis=2)
            h = np.bincount(local.ravel(), np.repeat(hess, columns), size).reshape(width, columns, BINS).cumsum(axis=2)
            total_g, total_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
            gain[(h < LEAST) | (total_h - h < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                c, b = divmod(int(best[k]), BINS)
                if gain[k, c, b] > 1e-6 and b < len(cuts[c]):
                    f[first + k], cut_at[first + k] = c, cuts[c][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > cut_at[node])
        g, h = np.bincount(node - inner, grad, leaves), np.bincount(node - inner, hess, leaves)
        v = -RATE * g / (h + RIDGE)
        score += v[node - inner]
        feature.append(f)
        threshold.append(cut_at)
        value.append(v)
    return Forest(np.array(feature), np.array(threshold), np.array(value), none.base)


def _statistics_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["id", "y", "x"])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column, sample: int) -> DataFrame:
    """(id, text, y) of at most ``sample`` labelled rows for which train holds, drawn by a hash of the id.

    The rows are counted and thinned by the hash before the least are ordered, so
    a large table doesn't send ``sample`` rows from every partition to one task.
    The drawn labels are broadcast: their number is bounded.
    """
    drawn = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    total = drawn.count()
    if total > 2 * sample:
        share = int(1_000_000 * (1.1 * sample + 100) / total)
        drawn = drawn.where(F.pmod(F.xxhash64(F.lit(18), "id"), F.lit(1_000_000)) < share)
    drawn = F.broadcast(drawn.orderBy(F.xxhash64(F.lit(17), "id"), "id", "y").limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    often = texts.select("id").join(drawn.select("id").distinct(), "id").groupBy("id").count().where(F.col("count") > OFTEN).select("id")
    return texts.join(drawn, "id").join(F.broadcast(often), "id", "left_anti")


def train_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    rows = map_batches(labelled(docs, labels, id_col, text_col, label_col, train, SAMPLE), _statistics_kernel, "id long, y int, x array<double>").toPandas().sort_values(["id", "y"])
    if not len(rows):
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    return fit(np.array(rows["x"].tolist()), rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(x))], ["doc_id", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kernel, "doc_id long, score double")


def judged(scores: DataFrame, mod: int, rest: int, threshold: float) -> DataFrame:
    """Scores with the fold and the verdict."""
    return scores.select("doc_id", (crc_mod("doc_id", mod) == rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_poor(docs: DataFrame, forest: Forest, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, all columns as they are."""
    return keep_rows(docs, text_col, lambda: lambda texts: (forest.scores(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))) >= threshold).tolist())
