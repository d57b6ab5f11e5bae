"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes ``N_FEATURES`` statistics (sizes, character classes, repeated words, word
pairs and lines).  Trees are grown level by level on feature histograms, with the gradients of the
log-loss, on at most ``max_rows`` labelled documents -- the only bounded part, chosen by a hash of
the id -- and kept as flat arrays (feature, threshold, leaf value, heap order), so scoring is a few
vectorised numpy gathers per batch.

Scale: fitting joins the bounded sample to the documents (a broadcast of ``max_rows`` small rows),
keeps one row of statistics per doc_id (pre-aggregated in every task) and brings ``max_rows`` x ``N_FEATURES`` numbers to the driver; scoring is one pass without a
shuffle, the model a broadcast of some kilobytes.

Defined cases.  Null and empty texts have all statistics 0 and are scored like any text.  Without
labelled rows every score is 0.5; with one class it is that class's smoothed rate.  Repeated rows
are scored each; a repeated doc_id is fitted on once, by a hash of its statistics; a null doc_id passes through; other columns are never read.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import append_columns, fold, fresh, labelled_sample, table

MAX_ROWS = 20_000
BINS, DEPTH, TREES, RATE, RIDGE, MIN_HESSIAN = 64, 4, 60, 0.15, 1.0, 2.0
THRESHOLD = 0.7

_CLASSES = {
    "letter": bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)), "upper": bytes(range(65, 91)),
    "digit": b"0123456789", "blank": b" \t\n\r\v\f", "newline": b"\n", "pipe": b"|", "bang": b"!?", "stop": b".,;:",
    "sign": b"#$%&*@^~=+<>_\\", "bracket": b"()[]{}'\"`-/",
}
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes), _i] = 1.0
N_FEATURES = 3 + len(_CLASSES) + 9


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    if not text:
        return [0.0] * N_FEATURES
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    classes = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS_OF
    words = data.split()
    lines = data.split(b"\n")
    w, k = max(1, len(words)), len(lines)
    follow = words[1:]
    ends = sum(map(operator.not_, map(bytes.isalnum, words)))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(k), *(classes / n),
        n / w, len(set(words)) / w, sum(map(operator.eq, words, follow)) / w, len(set(zip(words, follow))) / w,
        max(map(len, words), default=0), len(set(lines)) / k, w / k, ends / w,
        len(set(map(len, words))) / w,
    ]


def statistics_of(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, N_FEATURES)


@dataclass
class Trees:
    """Heap-ordered complete trees: inner nodes (trees, 2^d - 1), leaves (trees, 2^d)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1] if len(self.feature) else 0
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.intp)
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for 0/1 labels ``y``; an inner node that gains nothing sends all rows left."""
    inner, empty = 2**DEPTH - 1, np.zeros((0, 0))
    if len(y) == 0:
        return Trees(0.0, empty, empty, empty)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return Trees(base, empty, empty, empty)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    # bin b holds values v with cuts[b-1] < v <= cuts[b]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    cells = np.arange(m) * BINS + binned
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.intp), np.full(inner, np.inf)
        at = np.zeros(n, np.intp)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            slot = ((at - first)[:, None] * (m * BINS) + cells).ravel()
            size = width * m * BINS
            g, h = (np.bincount(slot, np.repeat(v, m), size).reshape(width, m, BINS).cumsum(2) for v in (grad, hess))
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(h < MIN_HESSIAN) | (h_all - h < MIN_HESSIAN)] = 0.0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + RIDGE)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def _doubles(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))


def fit_quality(docs: DataFrame, labels: DataFrame, train, max_rows: int = MAX_ROWS) -> Trees:
    """Fit on at most ``max_rows`` rows of ``labels(doc_id, quality)`` for which ``train`` holds, with
    one document each."""
    sample = labelled_sample(labels, "quality", train, max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = (append_columns(texts, {"x": "array<double>"}, lambda: lambda t: [_doubles(statistics_of(t))])
            .groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x"))["x"].alias("x")).collect())
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([r.x for r in rows], float).reshape(-1, N_FEATURES)
    return fit_trees(x, np.array([r.label for r in rows], float))


def quality_scores(docs: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """``docs`` with a score in ``column``: 0 to 1, higher for better documents."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, {column: "double"},
                          lambda: lambda t: [pa.array(held.value.score(statistics_of(t)), pa.float64())])


def _train():
    return fold("doc_id", 4) != 2


def quality_model(spark, docs: DataFrame, sf_dir: str) -> Trees:
    return fit_quality(docs, table(spark, sf_dir, "labels"), _train())


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(~_train(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose score reaches the threshold, all columns kept."""
    score, = fresh(docs, "__quality_score")
    scored = quality_scores(docs, quality_model(spark, docs, sf_dir), score)
    return scored.filter(F.col(score) >= THRESHOLD).drop(score)
