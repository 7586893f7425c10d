"""Helpers shared by the operators: durable tables, Arrow text batches, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ratewright.session import new_folder

#: Word pattern of the operators: anything between ASCII white space, as ``bytes.split()`` has it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once in a task.
SLICE_BYTES = 1 << 21
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back; the shuffle files behind it are dropped at once."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about SLICE_BYTES of text, or one longer row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = np.asarray([len(x) if x is not None else 0 for x in col.cast(pa.large_binary()).to_pylist()], dtype=np.int64)
        group = np.cumsum(size) // SLICE_BYTES if len(size) else size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts in flat arrays: byte bounds, hashes, and each text's first word number."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"".join(texts)
        if lower:
            self.data = self.data.lower()
        raw = np.frombuffer(self.data, dtype=np.uint8)
        bounds = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        solid = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(len(raw), dtype=bool)
        after = np.empty(len(raw), dtype=bool)
        if len(raw):
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.raw, self.bounds = raw, bounds

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """64-bit polynomial hash of each word, or of its first ``longest`` bytes."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        length = ends - self.starts
        n = int(length.sum())
        at = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
        power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
        terms = (self.raw[at + np.repeat(self.starts, length)].astype(np.uint64) + np.uint64(1)) * power[at]
        return mix(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64))

    def text_of(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes."""
    if len(h) < k:
        return np.empty(0, dtype=np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)
