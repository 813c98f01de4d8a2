"""Linear models on hashed n-gram indicators.

A naive Bayes log-count ratio scales each indicator; a linear hinge-loss model
is fitted to the scaled indicators by dual coordinate descent. Fitting takes a
bounded sample; scoring touches every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

#: rows of a slice of texts -> feature ids (with repeats) and their rows
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class LinearModel:
    """score = sigmoid(steepness * (sum of weights of present features + bias))."""

    weights: np.ndarray
    bias: float
    steepness: float = 2.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.steepness * np.clip(margin, -30, 30)))


def present(ids: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs in row order."""
    both = np.sort(rows.astype(np.int64) * size + ids)
    if len(both):
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return both % size, both // size


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of the smoothed shares of documents of either class that have a feature."""
    counts = np.full((2, size), smooth)
    for ids, y in zip(rows, labels, strict=True):
        counts[int(y > 0), ids] += 1
    total = np.array([(labels <= 0).sum(), (labels > 0).sum()], float) + 2 * smooth
    share = counts / total[:, None]
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 1, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """min 0.5 |w|^2 + cost * sum of hinge losses over features ``scale[j]`` (present) or 0.

    One dual variable at a time is set to its optimum within [0, cost]; the
    bias is one more feature, always 1.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    w, b = np.zeros(len(scale)), 0.0
    values = [scale[ids] for ids in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + b) - 1.0
            moved = min(max(alpha[i] - gradient / norms[i], 0.0), cost) - alpha[i]
            if moved:
                alpha[i] += moved
                w[rows[i]] += moved * y[i] * values[i]
                b += moved * y[i]
                worst = max(worst, abs(moved) * norms[i])
        if worst < tolerance:
            break
    return w, b


def fit_nbsvm(rows: list[np.ndarray], labels: np.ndarray, size: int, cost: float = 1.0, keep: float = 1.0, least_documents: int = 1) -> LinearModel:
    """Fit the model. ``keep`` interpolates between the mean weight size (0) and the
    fitted weights (1). Without two classes the score is the constant class."""
    if not len(rows) or len({bool(v > 0) for v in labels}) < 2:
        sure = 0.0 if not len(rows) else (20.0 if labels[0] > 0 else -20.0)
        return LinearModel(np.zeros(size, np.float32), sure)
    if least_documents > 1:
        seen = np.zeros(size, np.int64)
        for ids in rows:
            seen[ids] += 1
        rows = [ids[seen[ids] >= least_documents] for ids in rows]
    ratio = log_count_ratio(rows, labels, size)
    w, b = dual_coordinate_descent(rows, labels, ratio, cost)
    w = keep * w + (1 - keep) * np.abs(w).mean()
    return LinearModel((w * ratio).astype(np.float32), float(b))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most_rows`` labelled documents, first in hash order.

    ``allowed`` is a condition on ``doc_id``. Rows with a null id or label are
    left out; of several labels of one id the highest counts.
    """
    chosen = (
        labels.select(labels["doc_id"].alias("doc_id"), labels[label].cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & allowed)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    )
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def sample_features(sample: DataFrame, features: Features, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bring the features of a bounded sample to the driver, in id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, last, data, offsets in B.slices(batch["text"]):
                ids, rows = present(*features(data, offsets), size)
                cut = np.searchsorted(rows, np.arange(last - first + 1))
                out += [ids[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.string()), batch["y"], pa.array(out, pa.binary())], ["doc_id", "y", "ids"])

    got = sample.mapInArrow(run, "doc_id string, y int, ids binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["ids"])))
    return [np.frombuffer(bytes(r["ids"]), np.uint32).astype(np.int64) for r in got], np.array([r["y"] for r in got], dtype=np.int64)


def scored(docs: DataFrame, features: Features, model: LinearModel, held_out: Column, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get the bias's score."""
    size = len(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for first, last, data, offsets in B.slices(batch["text"]):
                ids, rows = present(*features(data, offsets), size)
                margin = np.bincount(rows, weights=own.weights[ids], minlength=last - first) + own.bias
                scores[first:last] = own.probability(margin)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores)], ["doc_id", "held_out", "score"])

    slim = docs.select("doc_id", held_out.alias("held_out"), docs["text"].cast("string").alias("text"))
    out = slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def selected(docs: DataFrame, features: Features, model: LinearModel, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, columns unchanged."""
    size, at = len(model.weights), docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, last, data, offsets in B.slices(batch.column(at)):
                ids, rows = present(*features(data, offsets), size)
                margin = np.bincount(rows, weights=own.weights[ids], minlength=last - first) + own.bias
                keep[first:last] = own.probability(margin) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
