"""Exact k-means on whole-numbered vectors through dictionaries of subvectors.

Vectors are cut into blocks of a few dimensions. A chunk of vectors is encoded without loss: for each block a dictionary of
its distinct subvectors, and each vector as one code a block. In each round the squared distances of a dictionary's
subvectors to the centroids are computed once, and a vector's distance is the sum of its codes' partial distances. New
centroids come from counts of codes in the same way. All sums are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import stored

#: Dimensions of a block, and most vectors of a chunk (the bound of its dictionaries too).
WIDTH, CHUNK = 2, 4096
#: Whole-numbered components beyond this could make a squared distance leave 64 bits.
LARGEST = 1 << 27

ENCODED = "keys array<long>, codes binary, sizes array<int>, entries binary"


def whole_vectors(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, vec array<long>) with floor(scale * x) of rows with exactly ``dims`` components, none null or non-finite."""
    right = F.col(vector).isNotNull() & (F.size(vector) == dims)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(right).where(finite)
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    beyond = F.exists("vec", lambda x: F.abs(x) > LARGEST)
    rows = rows.select(F.col(key).cast("long").alias("id"), whole.alias("vec"))
    return rows.withColumn("vec", F.when(~beyond, F.col("vec")).otherwise(F.raise_error(F.lit("a component is too large for exact distances in 64 bits")).cast("array<long>")))


def encode(keys: list, vectors: np.ndarray, width: int) -> tuple[list, bytes, list[int], bytes]:
    """One chunk: its keys, codes (vector by vector, a code a block), dictionary sizes, and the dictionaries' entries."""
    codes, entries, count = [], [], []
    for a in range(0, vectors.shape[1], width):
        block = vectors[:, a : a + width]
        distinct, code = np.unique(block, axis=0, return_inverse=True)
        codes.append(code.ravel().astype(np.uint16))
        entries.append(distinct.astype(np.int32).ravel())
        count.append(len(distinct))
    return keys, np.stack(codes, axis=1).tobytes(), count, np.concatenate(entries).tobytes()


class Chunk:
    """A decoded chunk: codes by vector and block, and each block's dictionary."""

    def __init__(self, keys, codes: bytes, sizes: list[int], entries: bytes, dims: int, width: int):
        self.keys = keys
        self.codes = np.frombuffer(codes, dtype=np.uint16).reshape(-1, len(sizes))
        self.starts = list(range(0, dims, width))
        flat, at, self.books = np.frombuffer(entries, dtype=np.int32).astype(np.int64), 0, []
        for a, n in zip(self.starts, sizes, strict=True):
            w = min(width, dims - a)
            self.books.append(flat[at : at + n * w].reshape(n, w))
            at += n * w

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid (ties: the smaller number) and its squared distance."""
        total = np.zeros((len(self.codes), len(centroids)), dtype=np.int64)
        for b, (a, book) in enumerate(zip(self.starts, self.books, strict=True)):
            gap = book[:, None, :] - centroids[None, :, a : a + book.shape[1]]
            total += (gap * gap).sum(axis=2)[self.codes[:, b]]
        best = total.argmin(axis=1)
        return best, total[np.arange(len(best)), best]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of each cluster's vectors, from counts of codes."""
        parts = []
        for b, book in enumerate(self.books):
            n = np.bincount(cluster * len(book) + self.codes[:, b], minlength=k * len(book)).reshape(k, len(book))
            parts.append(n @ book)
        return np.concatenate(parts, axis=1)


def _chunks(batches: Iterator[pa.RecordBatch], dims: int, width: int) -> Iterator[Chunk]:
    for batch in batches:
        for keys, codes, sizes, entries in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            yield Chunk(keys, codes, sizes, entries, dims, width)


def encoded(rows: DataFrame, dims: int, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Rows (id, vec) as chunks of at most ``chunk`` vectors with their dictionaries; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("keys", pa.list_(pa.int64())), ("codes", pa.binary()), ("sizes", pa.list_(pa.int32())), ("entries", pa.binary())])
        keys, parts, n = [], [], 0

        def cut(upto):
            nonlocal keys, parts, n
            whole = np.concatenate(parts)
            row = encode(keys[:upto], whole[:upto], width)
            keys, parts, n = keys[upto:], [whole[upto:]], n - upto
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, kinds, strict=True)], schema=kinds)

        for batch in batches:
            if batch.num_rows:
                keys += batch.column(0).to_pylist()
                parts.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                n += batch.num_rows
            while n >= chunk:
                yield cut(chunk)
        if n:
            yield cut(n)

    return rows.select("id", "vec").mapInArrow(run, ENCODED)


def starts(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the ``k`` smallest sha256 of seed:key, in that order; equal keys in the order of their vectors."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").orderBy(place, "vec").limit(k).collect()
    return np.array([r.vec for r in first], dtype=np.int64)


def moved(chunks: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The floored means of each centroid's nearest vectors; one that has none stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for c in _chunks(batches, dims, width):
            cluster, _ = c.nearest(centroids)
            n += np.bincount(cluster, minlength=k)
            total += c.sums(cluster, k)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(n[has]), pa.array(list(total[has]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = chunks.mapInArrow(run, "cluster int, n long, total array<long>")
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"d{i}") for i in range(dims)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        out[row.cluster] = [int(row[f"d{i}"]) // row.n for i in range(dims)]
    return out


def clustered(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", key: str = "vec_id", vector: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row that has a whole vector.

    Left out are rows whose vector is null, has not ``dims`` components, or holds a null or non-finite one. Rows with a null
    key take part but start no centroid; with fewer keyed rows than ``k`` there are fewer centroids, with none no rows.
    Repeated rows count as often as they come. Other columns are not read. A component beyond 2^27 after scaling fails with
    a message, since distances would leave 64 bits.

    Only centroids (k x dims numbers) and per-cluster totals meet the driver.
    """
    spark = df.sparkSession
    rows = whole_vectors(df, key, vector, dims, scale)
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    chunks = stored(encoded(rows, dims, width), "subvectors")
    for _ in range(rounds):
        centroids = moved(chunks, centroids, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, dims, width):
            cluster, distance = c.nearest(centroids)
            yield pa.RecordBatch.from_arrays([pa.array(c.keys, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    placed = stored(chunks.mapInArrow(run, "id long, cluster int, distance long"), "clusters")
    totals = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    whole = sum(int(r.total) for r in totals)
    named = [(r.cluster, int(r.total), whole, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in totals]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a centroid: k of them at most.
    out = placed.join(F.broadcast(about), "cluster")
    return out.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
