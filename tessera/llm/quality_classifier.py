"""Quality classifier: naive Bayes support vectors on n-gram indicators.

The indicators are byte trigrams, words and the relation of neighbouring words
(same word again), hashed to ``FEATURES`` ids. Each is scaled by its class
log-count ratio; a linear hinge-loss model is fitted by dual coordinate descent.

Defined cases: null or empty texts have no features and get the bias's score;
very long texts are scored whole; repeated rows are scored each; an empty table
gives an empty result; labels of one class only give that class's score;
labels with a null id or value are not learned. Columns other than ``doc_id``
and ``text`` are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._linear import LinearModel, fit_nbsvm, sample_features, scored, selected, training_sample
from ._spark import crc, table

#: Number of hashed features.
FEATURES = 1 << 16
#: Labelled rows that the fit takes at most, first in hash order of the ids.
TRAIN_ROWS = 4000
#: A document is kept at this score or more.
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of a slice of texts, with repeats, and their rows."""
    rows = len(offsets) - 1
    shift = np.uint64(48)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(rows, dtype=np.int32), lengths)
    wide = data.astype(np.uint32)
    code = wide[:-2] | (wide[1:-1] << 8) | (wide[2:] << 16) if len(data) >= 3 else np.empty(0, np.uint32)
    grams = (code * np.uint32(2654435761)) >> np.uint32(16)
    whole = owner[: len(grams)] == owner[2:] if len(grams) else np.empty(0, bool)
    start, end, row = B.spans(data, offsets, B.IS_SPACE)
    words = B.span_hash(B.prefix_hash(data), start, end)
    same = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    ids = (grams[whole].astype(np.int64), (words >> shift).astype(np.int64), np.where(same, 1, 0)[same])
    return np.concatenate(ids), np.concatenate((owner[: len(grams)][whole], row, row[1:][same])).astype(np.int64)


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id's text modulo 5 is not 0."""
    return crc(doc_id) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> LinearModel:
    """Fit on at most ``train_rows`` labelled documents that are not held out."""
    sample = training_sample(docs, labels, label, learnable(F.col("doc_id")), train_rows)
    rows, y = sample_features(sample, features, FEATURES)
    return fit_nbsvm(rows, y, FEATURES, cost=0.1, least_documents=2)


def classify(docs: DataFrame, model: LinearModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held_out = F.coalesce(~learnable(docs["doc_id"]), F.lit(False))
    return scored(docs, features, model, held_out, threshold)


def keep_good(docs: DataFrame, model: LinearModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, columns unchanged."""
    return selected(docs, features, model, threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
