"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic texts and from unlabelled ones, among which a known share is toxic too. The
risk of unlabelled texts as clean ones, less that share's, estimates the risk of clean texts; where it falls below zero
the fit is too close, and the step goes up that slope instead (the non-negative estimator).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import slices, texts_of
from ratewright.llm.features import Adam, flat, sample_features, word_features

DIMS = 1 << 18
#: Most confirmed and unlabelled texts that a fit reads; which ones is settled by a hash of the key.
POSITIVE, UNLABELLED = 2048, 6144
THRESHOLD = 0.3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Linear:
    """Weights by hashed feature, and the bias."""

    weights: np.ndarray
    bias: float


def fit_nnpu(positive: np.ndarray, row: np.ndarray, feature: np.ndarray, prior: float, dims: int = DIMS, rounds: int = 150, rate: float = 0.04, l1: float = 0.1, l2: float = 1e-4, least_texts: int = 8, least_z: float = 3.0) -> Linear:
    """Logistic loss over presence of features, ridge and shrinkage.

    Left out are features in fewer than ``least_texts`` texts, and those whose shares of confirmed and of unlabelled texts
    differ by less than ``least_z`` standard errors: with few confirmed texts, chance words would fit them.

    Steps shorten towards the end and the last half's weights are averaged, as the estimator swings about its floor.

    ``positive``: for each text whether it is a confirmed one, else it is unlabelled. ``prior``: the share of toxic texts.
    """
    n_p, n_u, n = int(positive.sum()), int((~positive).sum()), len(positive)
    bias = float(np.log(prior / (1 - prior)))
    in_p = np.bincount(feature[positive[row]], minlength=dims)
    both = np.bincount(feature, minlength=dims)
    share = both / max(n, 1)
    gap = in_p / max(n_p, 1) - (both - in_p) / max(n_u, 1)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    known = (both >= least_texts) & (np.abs(gap) >= least_z * error)
    w = np.zeros(dims)
    if not n_p or not n_u or not known.any():
        return Linear(w, bias)
    ids = np.flatnonzero(known)
    keep = known[feature]
    row, at = row[keep], (np.cumsum(known) - 1)[feature[keep]]
    v = np.zeros(len(ids))
    for_v, for_b = Adam(len(ids), rate), Adam(1, rate)
    as_p, as_u = np.where(positive, prior / n_p, 0.0), np.where(positive, 0.0, 1.0 / n_u)
    mean_v, mean_bias = np.zeros(len(ids)), 0.0
    for turn in range(rounds):
        for_v.rate = for_b.rate = rate * (1 - turn / rounds)
        z = np.bincount(row, v[at], minlength=n) + bias
        p, loss_clean = sigmoid(z), np.logaddexp(0, z)
        clean_risk = (as_u * loss_clean).sum() - (as_p * loss_clean).sum()
        slope_clean = (as_u - as_p) * p
        dz = as_p * (p - 1) + slope_clean if clean_risk >= 0 else -slope_clean
        v += for_v.step(np.bincount(at, dz[row], minlength=len(ids)) + l2 * v)
        v = np.sign(v) * np.maximum(np.abs(v) - for_v.rate * l1, 0)
        bias += float(for_b.step(np.array([dz.sum()]))[0])
        if turn >= rounds // 2:
            mean_v += v / (rounds - rounds // 2)
            mean_bias += bias / (rounds - rounds // 2)
    # What shrinkage held at zero most of the time has next to no weight on average either.
    w[ids] = np.where(np.abs(mean_v) > 1e-3, mean_v, 0)
    return Linear(w, mean_bias)


def held_out(key: Column) -> Column:
    """Whether a row's label is kept from every fit; a null key has no label."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", positives: int = POSITIVE, unlabelled: int = UNLABELLED) -> Linear:
    """Fit on confirmed rows of ``labels`` (key, toxic) and on texts of ``docs``, none of either held out.

    The prior is the toxic share of all labels that are not held out (0.01 to 0.5). Null keys and labels are left out.
    """
    open_labels = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(key, "toxic")
    share = open_labels.agg(F.avg("toxic")).first()[0]
    prior = min(max(share or 0.0, 0.01), 0.5)
    confirmed = open_labels.where("toxic = 1").select(key).distinct().orderBy(F.xxhash64(key), key).limit(positives)
    others = docs.where(F.col(key).isNotNull() & ~held_out(F.col(key))).select(key).orderBy(F.xxhash64(key, F.lit("unlabelled")), key).limit(unlabelled).distinct()
    few = confirmed.withColumn("mark", F.lit(1)).union(others.withColumn("mark", F.lit(0)))
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(few), key)
    mark, row, feature, _ = flat(sample_features(rows, word_features, DIMS))
    return fit_nnpu(mark == 1, row, feature, prior)


def toxicity(docs: DataFrame, model: Linear, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) of each row's whole text: the chance that it is toxic, and whether that reaches the threshold.

    Only words count. A null or wordless text scores what the bias gives. Repeated rows come out alike; an empty table
    gives an empty one; other columns are not read.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        used = model.weights != 0
        for batch in slices(batches):
            texts = texts_of(batch)
            of, feature = word_features(texts, DIMS)
            keep = used[feature]
            code = np.unique(of[keep] * DIMS + feature[keep])
            z = np.bincount(code // DIMS, model.weights[code % DIMS], minlength=len(texts)) + model.bias
            score = sigmoid(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["key", "score", "predicted"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
