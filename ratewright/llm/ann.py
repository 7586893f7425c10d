"""Nearest neighbours by collision counting over single projections (query-centred windows, virtual rehashing).

A block of vectors keeps one sorted array for each random projection. Around a query's own projections, windows as wide
as the search radius count which vectors they hold; a vector that collides in at least COLLISIONS of the projections is
verified by its exact cosine. If the nearest found so far are not within the radius, the windows are widened, counting
only what is new, until they are. A vector at the radius collides in a share 2 Phi(HALF) - 1 of the projections, 0.68,
so the threshold of 0.6 over 128 misses about 2 in 100 of the farthest ones wanted, and fewer of the nearer.

Blocks of vectors and chunks of queries are spread over the cluster; both are bounded, whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.vectors import common_size, lengths, matrix, usable

PROJECTIONS = 128
HALF = 1.0
COLLISIONS = 0.6
#: Search radii on the unit sphere; beyond the last every vector is verified.
RADII = (0.2, 0.5, 0.8, 0.97, 1.05, 1.12, 1.25, 1.45)
#: Queries whose windows are kept at once.
AT_ONCE = 256
BLOCK_ROWS, CHUNK_ROWS = 32_768, 4_096


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.norm = lengths(self.x)
        self.lines = np.random.default_rng(seed).standard_normal((x.shape[1], PROJECTIONS))
        h = (self.x / self.norm[:, None]) @ self.lines
        self.order = np.argsort(h, axis=0).T.copy()
        self.sorted = np.take_along_axis(h, self.order.T, axis=0).T.copy()

    def cosine(self, rows: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
        return ((self.x[rows] / self.norm[rows, None]) * (q / norm)).sum(axis=1)

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each query's windows on each projection, for every radius: arrays (query, radius, projection)."""
        at = (queries / lengths(queries)[:, None]) @ self.lines
        half = HALF * np.array(RADII)
        low = np.empty((len(queries), len(RADII), PROJECTIONS), dtype=np.int32)
        high = np.empty_like(low)
        for j, line in enumerate(self.sorted):
            low[:, :, j] = np.searchsorted(line, at[:, j, None] - half, "left")
            high[:, :, j] = np.searchsorted(line, at[:, j, None] + half, "right")
        return low, high

    def nearest(self, query_id: int, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k nearest found other than the query's own rows: (id, cosine), ties to smaller ids."""
        norm = float(lengths(q[None, :])[0])
        count = np.zeros(len(self.ids), dtype=np.int64)
        seen = self.ids == query_id
        rows, scores = np.empty(0, dtype=np.int64), np.empty(0)
        for level in range(len(RADII) + 1):
            if level == len(RADII):
                new = np.flatnonzero(~seen)
            else:
                # What the wider windows hold beyond the narrower ones, on either side.
                a, b = low[level].tolist(), high[level].tolist()
                if level == 0:
                    parts = [line[x:y] for line, x, y in zip(self.order, a, b, strict=True)]
                else:
                    parts = [line[x:y] for line, x, y in zip(self.order, a, low[level - 1].tolist(), strict=True)]
                    parts += [line[x:y] for line, x, y in zip(self.order, high[level - 1].tolist(), b, strict=True)]
                count += np.bincount(np.concatenate(parts), minlength=len(count))
                new = np.flatnonzero((count >= COLLISIONS * PROJECTIONS) & ~seen)
            seen[new] = True
            rows = np.concatenate([rows, new])
            scores = np.concatenate([scores, self.cosine(new, q, norm)])
            if len(rows) > k:
                best = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[best], scores[best]
            if len(rows) == k and level < len(RADII) and 2 - 2 * scores.min() <= RADII[level] ** 2:
                break
        best = np.lexsort((rows, -scores))
        return [(int(self.ids[r]), float(s)) for r, s in zip(rows[best], scores[best], strict=True)]


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k nearest other rows by cosine, fewer if there are fewer.

    Rank counts from 1, ties go to the smaller id. Vectors that are null, zero, of another size than most, or hold null or
    non-finite parts take no part, nor do rows with a null key. Rows that share the query's key are its own. Of rows that
    repeat a query's key one is asked; other repeated rows are candidates each. An empty table gives an empty one; columns not
    named are not read.
    """
    # One size for both: queries of another size than most rows take no part either.
    size = common_size(df, key, vector)
    marked = usable(df, key, vector, size)
    asked = usable(df.where(is_query), key, vector, size).groupBy("id").agg(F.min("vec").alias("vec"))
    # Both sizes settle how many bounded blocks and chunks there are; hashes of keys deal rows to them.
    blocks = max(1, -(-marked.count() // block_rows))
    chunks = max(1, -(-asked.count() // chunk_rows))
    base = marked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)))
    base = base.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    ask = asked.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), F.lit(chunks)))
    ask = ask.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(base: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(base) and len(ask):
            block = Block(base["id"].to_numpy(), matrix(base["vec"]))
            ids, queries = ask["id"].tolist(), matrix(ask["vec"])
            for at in range(0, len(ids), AT_ONCE):
                some = queries[at : at + AT_ONCE]
                for query_id, q, low, high in zip(ids[at : at + AT_ONCE], some, *block.windows(some), strict=True):
                    out += [(query_id, i, s) for i, s in block.nearest(query_id, q, low, high, k)]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    found = base.groupBy("block", "chunk").cogroup(ask.groupBy("block", "chunk")).applyInPandas(search, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
