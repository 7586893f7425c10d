"""What each filter of a chain removes, in every order, by wide packed counters.

A document's failures are a mask of five bits. Whatever happens to it in each of the 5! orders at each of the five steps
follows from the mask alone, so every mask (with the document's labels) stands for one big integer whose fields hold all
600 step outcomes. The integers of a part's documents are summed, and the sum is cut into its fields again. A field has 64
bits and counts documents, whose number is a 64-bit long: no field can run over into the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import slices, stored, texts_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Counters of a step, each a field of its own.
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BITS = 64

UPPER = bytes(range(65, 91))
MARKS = b"#$%&*|"
LEAST_WORDS = 200


def own_failures(raw: bytes) -> int:
    """Bits of the filters that one text decides: A short, B repetitive, C upper case, D marks."""
    words = raw.split()
    points = len(raw.decode("utf-8", "replace"))
    short = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * points
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return short | dull << 1 | loud << 2 | marked << 3


def outcomes(mask: int, good: bool, toxic: bool) -> np.ndarray:
    """One document's counters, 0 or 1, by order, step and counter."""
    out = np.zeros((len(ORDERS), len(FILTERS), len(COUNTERS)), dtype=np.uint64)
    for o, order in enumerate(ORDERS):
        gone = False
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            here = fails and not gone
            redundant = fails and gone
            gone = gone or fails
            out[o, s] = (not gone, here, redundant, mask == bit, here and good, here and toxic)
    return out


def packed(mask: int, good: bool, toxic: bool) -> int:
    """The counters as one integer, FIELD_BITS a field, the first lowest."""
    return int.from_bytes(outcomes(mask, good, toxic).astype("<u8").tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    shape = (len(ORDERS), len(FILTERS), len(COUNTERS))
    raw = total.to_bytes(int(np.prod(shape)) * FIELD_BITS // 8, "little")
    return np.frombuffer(raw, dtype="<u8").astype(np.int64).reshape(shape)


def failures(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, part, mask of A to D, digest of the text) of each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            masks = pa.array([own_failures(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, digests], names=["key", "part", "mask", "digest"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {dict(docs.dtypes)[key]}, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(part, mask of all five, good, toxic, n): few rows, whatever the number of documents.

    A row fails E unless its key is the smallest of all rows with its text, so the rows that do not are counted from one row
    a text: no row is joined to its copies, and a text's copies may be any share of the table.
    """
    label = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    per_key = failures(docs, key, text, part).groupBy("key", "digest", "mask", "part").agg(F.count(F.lit(1)).alias("n"))
    per_key = stored(per_key, "filter-masks")
    keyed = per_key.where("key is not null").join(label, "key", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    keyed = keyed.select("key", "digest", "mask", "part", *flags, "n")
    cell = ["part", "mask", "good", "toxic"]
    # A key is repeated at most by rows of other parts: these few stay together behind the key.
    together = keyed.groupBy("digest", "key").agg(F.collect_list(F.struct(*cell, "n")).alias("rows"))
    first = together.groupBy("digest").agg(F.min_by("rows", "key").alias("rows"))
    unique = first.select(F.inline("rows")).groupBy(*cell).agg(F.sum("n").alias("first"))
    nameless = per_key.where("key is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    all_of = keyed.select(*cell, "n").withColumn("e", F.lit(True)).union(nameless.withColumn("e", F.lit(False)))
    counts = all_of.groupBy(*cell, "e").agg(F.sum("n").alias("n"))
    fails_e = F.lit(1 << 4)
    passing = unique.select("part", "mask", "good", "toxic", F.col("first").alias("n"))
    # Taken from the failing ones, given to the passing ones.
    moves = counts.select("part", F.when(F.col("e"), F.col("mask").bitwiseOR(fails_e)).otherwise(F.col("mask")).alias("mask"), "good", "toxic", "n")
    moves = moves.union(passing).union(passing.select("part", F.col("mask").bitwiseOR(fails_e), "good", "toxic", -F.col("n")))
    return moves.groupBy(*cell).agg(F.sum("n").alias("n")).where("n > 0")


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _step_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """One part: the sum of its documents' integers, cut into the 600 steps. A part has 128 rows at most."""
    total = 0
    for mask, good, toxic, n in zip(rows["mask"], rows["good"], rows["toxic"], rows["n"], strict=True):
        total += packed(int(mask), bool(good), bool(toxic)) * int(n)
    fields = unpacked(total)
    removed = fields[:, :, COUNTERS.index("removed")]
    letters = np.array([list(o) for o in ORDERS])
    shapley = np.zeros(removed.shape, dtype=np.int64)
    for name in FILTERS:
        shapley[letters == name] = removed[letters == name].sum()
    out = pd.DataFrame({"part": rows["part"].iloc[0], "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS))})
    for i, name in enumerate(COUNTERS):
        out[name] = fields[:, :, i].ravel()
    out["shapley"] = shapley.ravel()
    return out


def audited(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, a null part the empty string. A row whose key is null fails E never and makes no other row fail it;
    all rows of a text's smallest key pass E. A key with several labels is good (toxic) if one of them says so; labels
    without a key are left out. Equal texts are those of equal SHA-256. An empty table gives an empty one; other columns are
    not read.
    """
    return mask_counts(docs, labels, key, text, part).groupBy("part").applyInPandas(_step_rows, AUDIT)
