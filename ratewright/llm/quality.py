"""Quality of texts by ordinal cumulative-link regression over hashed text.

One weight per hashed feature is shared by all grades, and grades lie between ordered thresholds on the same line:
P(grade >= j) = sigmoid(w . x - b_j), with b_1 < b_2 < ... A text's expected grade is the sum of these tail
probabilities, and selection cuts one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ratewright.llm.common import slices, texts_of
from ratewright.llm.features import Adam, flat, form_features, sample_features

DIMS = 1 << 16
#: Most labelled rows that a fit reads; which ones is settled by a hash of the key.
SAMPLE = 4096
#: Least P(grade >= 1) of a text that selection keeps.
KEEP = 0.6


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    """Weights by hashed feature, and the ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... as columns."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit_ordinal(grade: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray, dims: int = DIMS, rounds: int = 300, rate: float = 0.1, l2: float = 1e-5) -> Ordinal:
    """Maximum likelihood with a small ridge. Thresholds are a first one and the logarithms of the gaps, so they stay in order."""
    n, top = len(grade), max(int(grade.max(initial=0)), 1)
    w = np.zeros(dims)
    share = np.array([np.clip((grade >= j).mean() if n else 0.5, 0.01, 0.99) for j in range(1, top + 1)])
    level = -np.log(share / (1 - share))
    free = np.concatenate([level[:1], np.log(np.maximum(np.diff(level), 0.1))])
    for_w, for_b = Adam(dims, rate), Adam(top, rate)
    for _ in range(rounds if n else 0):
        b = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        z = np.bincount(row, w[feature] * value, minlength=n)
        p = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - b[None, :]), np.zeros((n, 1))], axis=1)
        here, above = np.arange(n), grade + 1
        slope = p * (1 - p)
        chance = np.maximum(p[here, grade] - p[here, above], 1e-9)
        dz = -(slope[here, grade] - slope[here, above]) / chance / n
        db = np.zeros(top + 2)
        np.add.at(db, grade, slope[here, grade] / chance / n)
        np.add.at(db, above, -slope[here, above] / chance / n)
        behind = np.cumsum(db[1:-1][::-1])[::-1]
        w += for_w.step(np.bincount(feature, dz[row] * value, minlength=dims) + l2 * w)
        free += for_b.step(behind * np.concatenate([[1.0], np.exp(free[1:])]))
    return Ordinal(w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def fit(docs: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` rows of (key, grade int from 0) that have a text. Null grades and keys are left out."""
    rated = grades.where(F.col("grade").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("grade").cast("int").alias("mark"))
    few = rated.orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(few), key)
    mark, row, feature, count = flat(sample_features(rows, form_features, DIMS))
    # Each text's features are shares, so that length doesn't count.
    whole = np.maximum(np.bincount(row, count, minlength=len(mark)), 1)
    return fit_ordinal(mark.astype(np.int64), row, feature, count / whole[row])


def graded(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with expected_grade double and tails array<double>, P(grade >= 1), P(grade >= 2), ...

    A null or wordless text has nothing to grade: expected grade 0, tails 0. Repeated rows come out alike; an empty table
    gives an empty one. Columns of ``docs`` that have these names are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("expected_grade", "tails")])
    place = docs.columns.index(text)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = given.value
        for batch in slices(batches, text):
            texts = texts_of(batch.select([place]), text)
            of, feature = form_features(texts, DIMS)
            n = np.bincount(of, minlength=len(texts))
            score = np.bincount(of, ordinal.weights[feature], minlength=len(texts)) / np.maximum(n, 1)
            tails = ordinal.tails(score) * (n > 0)[:, None]
            cuts = np.arange(0, tails.size + 1, tails.shape[1], dtype=np.int32)
            new = [pa.array(tails.sum(axis=1)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(tails.ravel()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "expected_grade", "tails"])

    schema = StructType([*docs.schema.fields, StructField("expected_grade", DoubleType()), StructField("tails", ArrayType(DoubleType()))])
    return docs.mapInArrow(run, schema)


def label_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor, 1 good but toxic, 2 good. Rows without a quality label are left out."""
    good = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality is not null").select("doc_id", good.alias("grade"))
