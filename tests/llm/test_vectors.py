"""Nearest neighbours, embedding links and components against brute force."""

import numpy as np
import pandas as pd

from ratewright.llm import pq
from ratewright.llm.ann import nearest
from ratewright.llm.links import components, forest
from ratewright.llm.pq import near_duplicates
from ratewright.llm.vectors import lengths

from pyspark.sql import functions as F


def vectors(rng, n=1200, d=24):
    x = rng.standard_normal((n, d))
    for i in range(0, 300):
        x[300 + i] = x[i % 40] + rng.standard_normal(d) * rng.choice([0.02, 0.2, 0.3])
    x[700:760] = x[5]
    x[760:790] = 2 * x[6]
    return x.astype(np.float32)


def table(spark, x):
    rows = [(int(i * 7 % 10_007), v.tolist()) for i, v in enumerate(x)]
    d = x.shape[1]
    odd = [(20_000, None), (20_050, []), (20_100, [0.0] * d), (20_150, [float("nan")] + [1.0] * (d - 1)), (20_200, [float("inf")] * d), (20_250, [None] + [1.0] * (d - 1)), (20_300, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS vec", "3 AS block", "4 AS n_links", "5 AS label")
    return df, np.array([i for i, _ in rows]), len(odd)


def unit(x):
    x = x.astype(np.float64)
    return x / lengths(x)[:, None]


def test_nearest_finds_nearly_all(spark):
    x = vectors(np.random.default_rng(0))
    df, ids, _ = table(spark, x)
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, block_rows=500, chunk_rows=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    u = unit(x)
    hits = total = 0
    for q in ids[ids % 50 == 0].tolist():
        s = u @ u[ids == q][0]
        s[ids == q] = -2
        best = np.lexsort((ids, -np.round(s, 12)))[:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(score - s[ids == i][0]) < 1e-12 for _, i, score in found)
        assert [(-round(sc, 12), i) for _, i, sc in found] == sorted((-round(sc, 12), i) for _, i, sc in found)
        hits += len({i for _, i, _ in found} & set(ids[best].tolist()))
        total += 5
    assert hits / total > 0.97
    assert set(got) == set(ids[ids % 50 == 0].tolist())


def test_few_candidates_are_all_returned(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert [(q, rank, i) for q, rank, i, _ in got] == [(0, 1, 50), (0, 2, 50), (0, 3, 1), (0, 4, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_queries_of_another_size_take_no_part(spark):
    rows = [(i, [1.0, float(i), 2.0, 0.5]) for i in range(1, 20)] + [(50, [1.0, 2.0, 3.0]), (100, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert nearest(df, F.col("vec_id") % 50 == 0).collect() == []
    got = nearest(df, F.col("vec_id").isin(3, 50)).collect()
    assert {r.query_id for r in got} == {3} and len(got) == 5 and all(r.id < 20 for r in got)


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pq, "HOME_ROWS", 40)
    monkeypatch.setattr(pq, "PROBE_ROWS", 60)
    x = vectors(np.random.default_rng(1))
    df, ids, odd = table(spark, x)
    got = {r.vec_id: tuple(r)[1:] for r in near_duplicates(df).collect()}
    u = unit(x)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    order = np.argsort(ids)
    place = np.empty(len(ids), dtype=int)
    place[order] = np.arange(len(ids))
    a, b = np.nonzero(near)
    child, root = forest(len(ids), place[a], place[b])
    least = np.arange(len(ids))
    least[child] = root
    # The probes are measured so that next to nothing is missed; here nothing is.
    for i, key in enumerate(ids.tolist()):
        component = int(ids[order][least[place[i]]])
        assert got[key] == (int(near[i].sum()), component, component == key)
    for key in (20_000, 20_050, 20_100, 20_150, 20_200, 20_250, 20_300):
        assert got[key] == (0, key, True)
    assert got[None] == (0, None, True) and len(got) == len(ids) + odd
    assert near_duplicates(df.limit(0)).collect() == []


def test_codes_bound_distances():
    rng = np.random.default_rng(2)
    x = unit(rng.standard_normal((600, 10)))
    model = pq.fit(x, 600, 0.9)
    home, codes, error = model.code(x)
    coded = model.parts(model.centers[home]) + model.books[np.arange(len(model.books)), codes]
    assert np.allclose(np.sqrt(((model.parts(x) - coded) ** 2).sum(axis=(1, 2))), error)
    assert 1 <= model.probes <= len(model.centers)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    chain = np.arange(1000, 1060)
    a, b = np.concatenate([a, chain[:-1], [7, 7]]), np.concatenate([b, chain[1:], [7, 7]])
    hub = np.arange(2000, 2300)
    a, b = np.concatenate([a, np.full(300, 2300)]), np.concatenate([b, hub])
    got = {r.node: r.component for r in components(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long")).collect()}
    child, root = forest(2301, a, b)
    want = np.arange(2301)
    want[child] = root
    linked = {int(x) for x, y in zip(a, b, strict=True) if x != y} | {int(y) for x, y in zip(a, b, strict=True) if x != y}
    assert got == {x: int(want[x]) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_links_inside_a_hot_group_are_all_found(spark):
    # A third of all rows around one centre, their cosines about 0.9: lists inside the group are many.
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3600, 64))
    x[:1200] = 8 * x[0] / np.linalg.norm(x[0]) + 0.33 * x[:1200]
    u = unit(x)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert 0.2 < near[:1200, :1200].mean() < 0.8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_duplicates(df).collect()}
    assert [got[i] for i in range(len(x))] == near.sum(axis=1).tolist()


def test_a_piece_counts_the_links_of_vectors_from_elsewhere_too():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 16))
    x[200:230] = x[rng.integers(0, 20, 30)] + 0.1 * rng.standard_normal((30, 16))
    u = unit(x)
    model = pq.fit(u, 300, 0.9)
    home, codes, error = model.code(u[200:])
    homes = pd.DataFrame({"own": range(200), "own_vec": list(x[:200]), "own_copies": 2})
    probes = pd.DataFrame({"id": range(200, 300), "vec": list(x[200:]), "copies": 3, "home": home, "code": [c.tobytes() for c in codes], "error": error})
    near = u[:200] @ u[200:].T >= 0.9
    want = {i: 3 * n for i, n in enumerate(near.sum(axis=1).tolist()) if n}
    back = {200 + j: 2 * n for j, n in enumerate(near.sum(axis=0).tolist()) if n}
    assert want and back
    for elsewhere, counted in ((False, want), (True, {**want, **back})):
        found = pq.links_in_list(homes, probes.assign(elsewhere=elsewhere), model, 0.9)
        assert dict(found.dropna(subset="n")[["a", "n"]].itertuples(index=False)) == counted
