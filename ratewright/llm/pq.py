"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

Coarse centroids and the codebooks of residual subspaces are fitted on a bounded sample; every vector is then coded.
Each vector has one home list and may also be sent, with its code, to every list that may hold a vector near enough: a
list's vectors lie beyond the plane midway between its centroid and the home one's, so a vector that lies farther than
the radius from that plane is near none of them. Lists are probed in groups of neighbours, each vector once a group, and of two
groups only one is probed by the other's vectors. In a
group every home vector makes its lookup tables and gets asymmetric distances to all coded ones; as each code's own error
is known, a coded vector can only be near enough if its distance is at most the radius plus that error. What passes is
reranked by exact cosine. Neither filter loses a pair, however the vectors lie.

Equal vectors are one vector with a count. A group that is full is cut in pieces that meet one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import stored
from ratewright.llm.links import components, forest
from ratewright.llm.vectors import lengths, matrix, usable

#: Most vectors that the fit reads, settled by a hash of the key.
SAMPLE = 16_384
#: Parts of a residual that one code holds, and codes of a subspace.
WIDTH, CODES = 4, 256
#: Rows of ``probed`` at once.
SLAB = 1024
HOME_ROWS, PROBE_ROWS = 2_048, 8_192
#: Coded and home vectors whose distances are summed at once, so that the sums stay in the processor's cache.
TILE, HOMES = 256, 64


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centers.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, dtype=np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    centers = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centers)
        n = np.bincount(at, minlength=len(centers))
        sums = np.stack([np.bincount(at, x[:, j], minlength=len(centers)) for j in range(x.shape[1])], axis=1)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


@dataclass
class Quantiser:
    centers: np.ndarray
    books: np.ndarray  # subspace, code, WIDTH
    groups: np.ndarray  # of each list
    cosine: float

    @property
    def probes(self) -> int:
        """Groups that one vector is sent to at most."""
        return int(self.groups.max()) + 1

    def probed(self, x: np.ndarray, home: np.ndarray) -> list[np.ndarray]:
        """The groups that hold the home lists of all vectors whose cosine with a row (of unit length) reaches the wanted one."""
        radius, out = np.sqrt(2 - 2 * self.cosine) + 1e-7, []
        size = (self.centers**2).sum(axis=1)
        for i in range(0, len(x), SLAB):
            at = home[i : i + SLAB]
            fit_of = x[i : i + SLAB] @ self.centers.T - size / 2
            apart = np.sqrt(np.maximum(size[at][:, None] + size - 2 * self.centers[at] @ self.centers.T, 0))
            meets = fit_of[np.arange(len(at)), at][:, None] - fit_of <= radius * apart + 1e-7
            meets[np.arange(len(at)), at] = True
            out += [np.unique(self.groups[row]) for row in meets]
        return out

    def parts(self, x: np.ndarray) -> np.ndarray:
        pad = self.books.shape[0] * WIDTH - x.shape[1]
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, WIDTH)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home lists, codes, and the coded vectors' distances from the vectors themselves."""
        home = _nearest(x, self.centers)
        rest = self.parts(x - self.centers[home])
        codes = np.stack([_nearest(rest[:, s], self.books[s]) for s in range(len(self.books))], axis=1).astype(np.uint8)
        left = rest - self.books[np.arange(len(self.books)), codes]
        return home, codes, np.sqrt((left**2).sum(axis=(1, 2)))


def fit(x: np.ndarray, total: int, cosine: float, seed: int = 11) -> Quantiser:
    """From unit vectors: about 2 sqrt(total) lists, at most a sixteenth of the sample, in groups of about HOME_ROWS vectors."""
    lists = int(np.clip(2 * np.sqrt(total), 1, max(len(x) // 16, 1)))
    centers = k_means(x, lists, 8, seed)
    rest = Quantiser(centers, np.zeros((-(-x.shape[1] // WIDTH), 1, WIDTH)), np.zeros(len(centers), dtype=np.int64), cosine).parts(x - centers[_nearest(x, centers)])
    books = np.stack([np.resize(k_means(rest[:, s], CODES, 6, seed + s), (CODES, WIDTH)) for s in range(rest.shape[1])])
    middles = k_means(centers, min(-(-total // HOME_ROWS), len(centers)), 8, seed)
    return Quantiser(centers, books, np.unique(_nearest(centers, middles), return_inverse=True)[1], cosine)


def links_in_list(homes: pd.DataFrame, probes: pd.DataFrame, model: Quantiser, cosine: float) -> pd.DataFrame:
    """Counts (a, null, n) and connecting links (a, b, null) of one group's piece; vectors from elsewhere are counted here too."""
    x, y = matrix(homes["own_vec"]), matrix(probes["vec"])
    x /= lengths(x)[:, None]
    y /= lengths(y)[:, None]
    codes = np.frombuffer(b"".join(probes["code"]), dtype=np.uint8).reshape(len(y), -1)
    uniq, which = np.unique(probes["home"].to_numpy(), return_inverse=True)
    coded = model.parts(model.centers[probes["home"].to_numpy()]) + model.books[np.arange(len(model.books)), codes]
    size = (coded**2).sum(axis=(1, 2)).astype(np.float32)
    reach = ((np.sqrt(2 - 2 * cosine) + probes["error"].to_numpy() + 1e-4) ** 2).astype(np.float32)
    bound, codes = 1 + size - reach, np.ascontiguousarray(codes.T, dtype=np.intp)
    own, other = homes["own"].to_numpy(), probes["id"].to_numpy()
    weight, own_weight, elsewhere = probes["copies"].to_numpy(), homes["own_copies"].to_numpy(), probes["elsewhere"].to_numpy(dtype=bool)
    counts, met, child, root = [], np.zeros(len(y)), [], []
    for i in range(0, len(x), HOMES):
        part = x[i : i + HOMES]
        dot = (model.centers[uniq] @ part.T).astype(np.float32)
        # A code's entries for all home vectors lie side by side.
        tables = np.ascontiguousarray(np.einsum("nsw,scw->scn", model.parts(part), model.books), dtype=np.float32)
        near, spare = np.empty((len(part), len(y)), dtype=bool), np.empty((TILE, len(part)), dtype=np.float32)
        for j in range(0, len(y), TILE):
            sums = dot[which[j : j + TILE]]
            for table, code in zip(tables, codes[:, j : j + TILE], strict=True):
                sums += np.take(table, code, axis=0, out=spare[: len(code)], mode="clip")
            near[:, j : j + TILE] = (2 * sums >= bound[j : j + TILE, None]).T
        rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        a, b = np.nonzero(near)
        if len(a) * 50 < len(rows) * len(cols):
            exact = np.concatenate([(part[a[j : j + 65536]] * y[b[j : j + 65536]]).sum(axis=1) for j in range(0, len(a), 65536)] or [np.empty(0)])
            keep = exact >= cosine
        else:
            found = np.zeros(near.shape, dtype=bool)
            found[np.ix_(rows, cols)] = part[rows] @ y[cols].T >= cosine
            keep = found[a, b]
        a, b = a[keep], b[keep]
        keep = own[i + a] != other[b]
        a, b = a[keep], b[keep]
        counts.append(np.bincount(a, weight[b], minlength=len(part)))
        met += np.bincount(b, own_weight[i + a], minlength=len(y))
        nodes, at = np.unique(np.concatenate([own[i + a], other[b]]), return_inverse=True)
        c, r = forest(len(nodes), at[: len(a)], at[len(a) :])
        child.append(nodes[c])
        root.append(nodes[r])
    own = np.concatenate([own, other[elsewhere]])
    n = np.concatenate([*counts, met[elsewhere]]).astype(np.int64)
    child, root = np.concatenate(child), np.concatenate(root)
    none = [pd.NA]
    return pd.DataFrame(
        {
            "a": pd.array(np.concatenate([own[n > 0], child]), dtype="Int64"),
            "b": pd.array(none * int((n > 0).sum()) + root.tolist(), dtype="Int64"),
            "n": pd.array(n[n > 0].tolist() + none * len(child), dtype="Int64"),
        }
    )


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """(key, n_links, component_id, kept) of each row.

    Rows link if their vectors' cosine is at least ``cosine``; ``n_links`` counts the other rows linked directly,
    component_id is the smallest key reachable, itself included, and kept says that it is the row's own. Vectors that
    are null, zero, of another size than most, or hold null or non-finite parts link with nothing, nor do rows with a
    null key (component_id null, kept true). Repeated rows link with one another. An empty table gives an empty one;
    columns not named are not read.
    """
    valid = usable(df, key, vector)
    once = stored(valid.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vectors")
    few = once.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column("vec").to_pylist()
    all_rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vec"))
    if not few:
        return all_rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    x = matrix(few)
    model = fit(x / lengths(x)[:, None], once.count(), cosine)
    given = df.sparkSession.sparkContext.broadcast(model)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = given.value
        for part in parts:
            if not len(part):
                continue
            x = matrix(part["vec"])
            x /= lengths(x)[:, None]
            home, codes, error = model.code(x)
            groups = model.probed(x, home)
            yield part.assign(home=home, code=[c.tobytes() for c in codes], error=error, group=model.groups[home], groups=groups)

    kind = dict(once.dtypes)["vec"]
    coded = stored(once.mapInPandas(place, f"vec {kind}, id long, copies long, home long, code binary, error double, group long, groups array<long>"), "coded")
    homes = coded.select("group", F.col("id").alias("own"), F.col("vec").alias("own_vec"), F.col("copies").alias("own_copies"))
    probes = coded.select(F.explode("groups").alias("group"), F.col("group").alias("from"), "id", "vec", "copies", "home", "code", "error")
    # Two near vectors each reach the other's group: of two groups one takes in the other's vectors, by turns the greater and the smaller.
    once_met = (F.col("group") < F.col("from")) == ((F.col("group") + F.col("from")) % 2 == 0)
    elsewhere = F.col("group") != F.col("from")
    probes = probes.where(~elsewhere | once_met).withColumn("elsewhere", elsewhere).drop("from")
    # A row for each group at most, so at most a sixteenth of the sample.
    home_cuts = homes.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / HOME_ROWS).cast("long").alias("h"))
    probe_cuts = probes.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / PROBE_ROWS).cast("long").alias("p"))
    cuts = F.broadcast(stored(home_cuts.join(probe_cuts, "group"), "cuts"))

    def pieces(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    homes = homes.join(cuts, "group").withColumn("hp", F.pmod(F.xxhash64("own"), "h")).withColumn("pp", pieces("p")).drop("h", "p")
    probes = probes.join(cuts, "group").withColumn("pp", F.pmod(F.xxhash64("id"), "p")).withColumn("hp", pieces("h")).drop("h", "p")

    def compare(homes: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if not len(homes) or not len(probes):
            return pd.DataFrame({c: pd.array([], dtype="Int64") for c in "abn"})
        return links_in_list(homes, probes, given.value, cosine)

    piece = ["group", "hp", "pp"]
    found = stored(homes.groupBy(*piece).cogroup(probes.groupBy(*piece)).applyInPandas(compare, "a long, b long, n long"), "links")
    counts = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    about = once.join(counts, "id", "left").join(joined, "id", "left")
    about = about.select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # Vectors that take no part are in no class: the join leaves them out, and they stand alone.
    out = all_rows.join(about, (all_rows.vec == about.vec) & all_rows.key.isNotNull(), "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "key").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(True)))
