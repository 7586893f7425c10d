"""Operators against brute force on small fixtures, and the properties they promise."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.operators import bradley_terry as bt
from ratewright.operators import consensus as k
from ratewright.operators import panel as pn
from ratewright.operators import reports as rp
from ratewright.operators import resolve as rv
from ratewright.operators import settle as st
from ratewright.operators import tables as tb
from ratewright.operators.ordered import ordered_scan
from ratewright.plans import all_queries

DAY = dt.date(2024, 1, 1)


@pytest.fixture
def split(spark):
    """Make even small inputs span many blocks, so that borders are crossed."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def chain_rows(n=400, hot=0.6, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        team = "hot" if rng.random() < hot else rng.choice("abc")
        s = rng.choice([0.0, 0.5, 1.0])
        e = rng.uniform(0.05, 0.95)
        rows.append((i, DAY + dt.timedelta(days=i // 3), team, s, e, s - e, rng.uniform(1300, 1700), rng.choice([0.0, 0.08])))
    return rows


CHAIN = "fixture_id long, date date, team_id string, actual_score_s double, e_kr double, surprise double, target double, gamma double"


def test_ordered_scan_over_split_hot_key(spark, split):
    rows = [(r[2], r[0], float(r[0] % 7) if r[0] % 3 else None) for r in chain_rows()]
    df = spark.createDataFrame(rows, "team string, i long, v double")
    out = ordered_scan(
        df, ["team"], ["i"], sums={"s": F.coalesce("v", F.lit(0.0))}, lags={"p": "v"}, carries={"last": "v"}, numbers="n"
    ).toPandas()
    assert len(out) == len(rows)
    for _, g in pd.DataFrame(rows, columns=["team", "i", "v"]).groupby("team"):
        g = g.sort_values("i")
        got = out[out.team == g.team.iloc[0]].sort_values("i")
        assert np.allclose(got.s, g.v.fillna(0).cumsum())
        assert np.allclose(got.p.fillna(-1), g.v.shift().fillna(-1))
        assert np.allclose(got["last"].fillna(-1), g.v.ffill().fillna(-1))
        assert list(got.n) == list(range(1, len(g) + 1))


def test_descending_numbers(spark, split):
    df = spark.createDataFrame([(r[2], r[0]) for r in chain_rows()], "team string, i long")
    out = ordered_scan(df, ["team"], ["i"], numbers="n", descending=True).toPandas()
    for _, g in out.groupby("team"):
        assert list(g.sort_values("i", ascending=False).n) == list(range(1, len(g) + 1))


def test_v3_chain_over_split_hot_team(spark, split):
    rows = chain_rows(600)
    got = st.settle_v3(spark.createDataFrame(rows, CHAIN)).toPandas().set_index("fixture_id")
    b = {}
    for i, _, team, s, e, u, target, g in sorted(rows, key=lambda r: (r[1], r[0])):
        before = b.get(team, c.BASELINE_RATING)
        raw = 30 * u + g * (target - before)
        step = max(0.0, raw) if u > 0.001 else min(0.0, raw) if u < -0.001 else 0.0
        assert got.loc[i].b_before == pytest.approx(before, abs=1e-8)
        assert got.loc[i].delta_b == pytest.approx(step, abs=1e-8)
        assert step * u >= 0  # a better result never lowers B
        b[team] = before + step


def test_v2_chain_over_split_hot_league(spark, split):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        league = "big" if rng.random() < 0.7 else "small"
        h, a = rng.sample([f"{league}{j}" for j in range(5)], 2)
        if i % 25 == 0 and i > 100:
            # A cup: its teams bring their own league's B along, and take it home again.
            league, h, a = "cup", f"big{i % 5}", "small0"
        e = rng.uniform(0.1, 0.9)
        rows.append((i, DAY + dt.timedelta(days=i // 4), league, h, a, rng.choice([0.0, 0.5, 1.0]), e, 1 - e))
    df = spark.createDataFrame(rows, "fixture_id long, date date, league string, home_team string, away_team string, s_home double, e_home double, e_away double")
    got = st.settle_v2(df).toPandas().set_index("fixture_id")
    b = {}
    for i, _, _, h, a, s, eh, ea in rows:
        bh, ba = b.get(h, 1500.0), b.get(a, 1500.0)
        rh = ba + 400 * np.log10(eh / (1 - eh)) - 65
        ra = bh + 400 * np.log10(ea / (1 - ea)) + 65
        assert got.loc[i].home_b_before == pytest.approx(bh, abs=1e-7)
        assert got.loc[i].away_b_before == pytest.approx(ba, abs=1e-7)
        b[h] = bh + 30 * (s - eh) + 0.05 * (rh - bh)
        b[a] = ba + 30 * (1 - s - ea) + 0.05 * (ra - ba)


def test_settle_twice_is_settle_once(spark):
    rows = spark.createDataFrame([(1, "a", "v3"), (1, "b", "v3"), (2, "a", "v3")], "fixture_id long, team_id string, oracle_version string")
    log = rows.where("fixture_id = 1 and team_id = 'a'")
    new = st.append_log(log, rows)
    assert new.count() == 2
    assert st.append_log(log.unionByName(new), rows).count() == 0


def test_latest_does_not_depend_on_order(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(5), f"b{rng.randrange(3)}", dt.datetime(2024, 1, 1, rng.randrange(5)), 2.0 + rng.randrange(3), 3.0, 3.0) for _ in range(200)]
    schema = "fixture_id long, bookmaker string, snapshot_time timestamp_ntz, home_odds double, draw_odds double, away_odds double"
    a = sorted(map(tuple, tb.latest_quotes(spark.createDataFrame(rows, schema)).collect()))
    rng.shuffle(rows)
    assert a == sorted(map(tuple, tb.latest_quotes(spark.createDataFrame(rows, schema)).collect()))


def test_patch_keeps_guarded_and_other_columns(spark):
    state = spark.createDataFrame([("a", 1.0, 5.0, None), ("b", 2.0, 6.0, 1.0), ("c", 3.0, 7.0, None)], "team_id string, m double, p double, lock double")
    delta = spark.createDataFrame([("a", 9.0, 50.0), ("b", 8.0, 60.0)], "team_id string, m double, p double")
    out = {r.team_id: (r.m, r.p) for r in tb.patch(state, delta, ["team_id"], {"p": F.col("lock").isNotNull()}).collect()}
    assert out == {"a": (9.0, 50.0), "b": (8.0, 6.0), "c": (3.0, 7.0)}


def quote(f, book, ts, h=2.0, d=3.5, a=4.0):
    return (f, book, ts, h, d, a)


QUOTES = "fixture_id long, bookmaker string, snapshot_time timestamp_ntz, home_odds double, draw_odds double, away_odds double"
FIX = "fixture_id long, date date, commence_time timestamp_ntz, home_team string, away_team string, status string"


def test_window_degrades_and_single_book_gives_nothing(spark):
    ko = dt.datetime(2024, 1, 1, 15)
    early, late = ko - dt.timedelta(hours=20), ko - dt.timedelta(hours=1)
    rows = [quote(1, "a", late), quote(1, "b", early), quote(1, "c", early), quote(1, "d", early)]
    rows += [quote(2, "a", late), quote(2, "b", late), quote(2, "c", early)]
    rows += [quote(3, "a", late), quote(4, "a", ko), quote(4, "b", ko)]
    f = spark.createDataFrame([(i, DAY, ko, "h", "w", "finished") for i in (1, 2, 3, 4)], FIX)
    kr = {r.fixture_id: r for r in k.frozen_consensus(spark.createDataFrame(rows, QUOTES), f).collect()}
    assert set(kr) == {1, 2}
    assert (kr[1].bookmaker_count, kr[1].kr_degraded) == (4, True)
    assert (kr[2].bookmaker_count, kr[2].kr_degraded) == (2, False)
    assert kr[2].home_expected_score + kr[2].away_expected_score == pytest.approx(1.0, abs=2e-6)


def test_alternates_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, DAY + dt.timedelta(days=rng.randrange(15)), None, rng.choice("xy"), rng.choice("pq"), "upcoming") for i in range(120)]
    quoted = {i for i in range(120) if rng.random() < 0.5}
    f = spark.createDataFrame(rows, FIX)
    got = {r.fixture_id: r.alt_fixture_id for r in k.alternates(f, spark.createDataFrame([(i,) for i in quoted], "fixture_id long")).collect()}
    want = {}
    for r in rows:
        hits = [o[0] for o in rows if o[0] in quoted and o[0] != r[0] and o[3:5] == r[3:5] and abs((o[1] - r[1]).days) <= 3]
        if hits:
            want[r[0]] = min(hits)
    assert got == want


def test_fuzzy_alternates_equal_brute_force(spark):
    rng = random.Random(11)
    names = ["Inter", "Inter Milan", "Milan", "AC Milan", "Roma", "AS Roma", "Lazio"]
    rows = []
    for i in range(80):
        h, a = rng.sample(names, 2)
        rows.append((i, rng.choice(["L1", "L2"]), DAY + dt.timedelta(days=rng.randrange(12)), h, a))
    norm = {"AC Milan": "milan", "AS Roma": "roma"}
    n = lambda s: norm.get(s, s.lower())
    alike = lambda x, y: n(x) in n(y) or n(y) in n(x)
    want = {}
    for r in rows:
        hits = [o[0] for o in rows if o[0] != r[0] and o[1] == r[1] and abs((o[2] - r[2]).days) <= 3 and alike(o[3], r[3]) and alike(o[4], r[4])]
        if hits:
            want[r[0]] = min(hits)
    df = spark.createDataFrame(rows, "fixture_id long, league string, date date, home_team string, away_team string")
    assert {r.fixture_id: r.alt_fixture_id for r in rv.fuzzy_alternates(df).collect()} == want


def test_phantom_is_cancelled(spark):
    rows = [(1, DAY, None, "h", "a", "upcoming"), (9_000_001, DAY + dt.timedelta(days=2), None, "h", "a", "upcoming"), (9_000_002, DAY + dt.timedelta(days=9), None, "h", "a", "upcoming")]
    # Real fixtures may have large ids too: only the mark says which are synthetic.
    rows.append((12_000_000, DAY, None, "h", "b", "upcoming"))
    f = spark.createDataFrame(rows, FIX).withColumns({"score": F.lit("N/A"), "is_synthetic": F.col("fixture_id").isin(9_000_001, 9_000_002)})
    out = {r.fixture_id: (r.status, r.score) for r in rv.cancel(f, rv.phantom_duplicates(f)).collect()}
    assert out == {1: ("upcoming", "N/A"), 9_000_001: ("cancelled", "DUP"), 9_000_002: ("upcoming", "N/A"), 12_000_000: ("upcoming", "N/A")}


def test_map_solution_has_no_gradient(spark):
    rng = random.Random(2)
    teams = [f"t{i}" for i in range(6)]
    rows = [("L", *rng.sample(teams, 2), rng.uniform(0.2, 0.8), rng.uniform(0.3, 1.0)) for _ in range(60)]
    edges = spark.createDataFrame(rows, "league string, home_team string, away_team string, home_es double, weight double")
    priors = spark.createDataFrame([(t, 1450.0 + 20 * i) for i, t in enumerate(teams)], "team_id string, b_value double")
    out = bt.map_ratings(edges, priors).toPandas()
    r, mu = dict(zip(out.team, out.rating)), dict(zip(out.team, out.prior))
    grad = {t: -(r[t] - mu[t]) / 300.0**2 for t in r}
    for _, h, a, es, w in rows:
        g = w * (es - 1 / (1 + 10 ** (-(r[h] - r[a] + 65) / 400))) * np.log(10) / 400
        grad[h] += g
        grad[a] -= g
    assert max(abs(v) for v in grad.values()) < 1e-7
    assert out.converged.all() and (out.std_error > 0).all() and (out.std_error < 300).all()


def test_two_fixtures_are_too_few(spark):
    edges = spark.createDataFrame([("L", "a", "b", 0.5, 1.0)] * 2, "league string, home_team string, away_team string, home_es double, weight double")
    assert bt.map_ratings(edges, spark.createDataFrame([("a", 1500.0)], "team_id string, b_value double")).count() == 0



def test_snapshot_files_are_read_by_name(spark, tmp_path):
    import json

    from ratewright.sources import nested as ns

    event = {
        "id": "e", "home_team": "H", "away_team": "A", "commence_time": "2024-01-02T15:00:00",
        "bookmakers": [{"key": "bk", "markets": [{"key": "h2h", "outcomes": [{"name": "H", "price": 2.0}, {"name": "A", "price": 4.0}, {"name": "Draw", "price": 3.5}]}]}],
    }
    (tmp_path / "77_2024-01-02_d1.json").write_text(json.dumps({"timestamp": "2024-01-01T15:00:00", "data": [event]}))
    (tmp_path / "78_2024-01-02_d2.json").write_text("")
    (tmp_path / "79_2024-01-02_d3.json").write_text("{broken")
    rows = ns.read_snapshots(spark, str(tmp_path)).collect()
    assert [(r.fixture, r.day_offset, r.bookmaker, r.home_odds, r.draw_odds, r.away_odds) for r in rows] == [("77", 1, "bk", 2.0, 3.5, 4.0)]
    nested = ns.regroup(spark.createDataFrame(rows, ns.read_snapshots(spark, str(tmp_path)).schema)).collect()
    assert nested[0].snapshots[0].books[0].bookmaker == "bk"


def test_every_check_has_its_query():
    assert set(all_queries.CHECKS) <= set(all_queries.QUERIES)
    assert len(all_queries.QUERIES) > 100


@pytest.mark.parametrize("name", ["consensus_power", "settle_v1", "rankings"])
def test_queries_run_on_the_smallest_tables(spark, name):
    assert all_queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_pair_correlations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rp, "POSITIONS", 7)
    monkeypatch.setattr(rp, "TEAMS", 3)
    rng = random.Random(61)
    rows = []
    for league, n in (("A", 10), ("B", 2), ("C", 1)):
        for i in range(n):
            price = 50.0
            for day in range(rng.choice([2, 3, 25, 40])):
                price += rng.gauss(0, 1) if i != 3 else 0.0
                rows.append((f"{league}{i}", "m", league, DAY + dt.timedelta(days=day), price))
    df = spark.createDataFrame(rows, "team string, model string, league string, date date, dollar_price double")
    got = {r.league: r for r in rp.pair_correlation(df).collect()}
    frame = pd.DataFrame(rows, columns=["team", "model", "league", "date", "price"])
    for league, g in frame.groupby("league"):
        series = {t: np.diff(x.sort_values("date").price) for t, x in g.groupby("team")}
        found = []
        names = sorted(series)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                k = min(len(series[a]), len(series[b]))
                x, y = series[a][:k], series[b][:k]
                if k >= 3 and x.std() > 1e-9 and y.std() > 1e-9:
                    found.append(np.corrcoef(x, y)[0, 1])
        assert got[league].n_teams == len(names) and got[league].n_pairs == len(found)
        assert got[league].avg_correlation == pytest.approx(np.mean(found) if found else 0.0, abs=1e-9)


def test_quote_sources_own_then_exact_then_alike(spark):
    def f(i, day, home, away, league="L"):
        return (i, DAY + dt.timedelta(days=day), league, home, away)

    schema = "fixture_id long, date date, league string, home_team string, away_team string"
    wanted = [f(1, 0, "Ayr United", "Bury Town"), f(2, 0, "Cork City", "Dover Rovers"), f(3, 0, "Ely Rangers", "Fife Albion"), f(4, 0, "Gort", "Hythe"), f(5, 0, "Ipswich", "Kent")]
    others = [f(10, 2, "Cork City", "Dover Rovers"), f(9, 3, "Cork City", "Dover Rovers"), f(8, 4, "Cork City", "Dover Rovers"), f(20, 1, "Ely", "Fife Albion"), f(19, 1, "Ely", "Fife", "M"), f(30, 1, "Gort", "Kent")]
    fixtures = spark.createDataFrame(wanted + others, schema)
    having = spark.createDataFrame([(i,) for i in (1, 8, 9, 10, 19, 20, 30)], "fixture_id long")
    got = {r.fixture_id: r.source_id for r in rv.quote_sources(spark.createDataFrame(wanted, schema), fixtures, having).collect()}
    assert got == {1: 1, 2: 9, 3: 20}


def test_flattened_feeds_gather_odds_and_spread_one_market(spark, tmp_path):
    """What an event gathers per book is its odds, and no rows are made of markets that are not asked for."""
    from ratewright.plans import shapes
    from ratewright.plans import table_queries as tq

    for name in ("region", "nation", "customer", "orders", "lineitem"):
        spark.createDataFrame([], shapes.SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("flatten_h2h", "flatten_totals", "flatten_spreads"):
        plan = getattr(tq, name)(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(struct(bookmaker" in plan and "explode(filter(" in plan


def test_few_median_is_the_median_without_hash_tables(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0.25, rng.random()]) if i else None) for i in range(60) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "fixture_id long, p double")
    out = df.groupBy("fixture_id").agg(F.median("p").alias("want"), k.few_median("p").alias("got"))
    assert out.where(~F.col("want").eqNullSafe(F.col("got"))).count() == 0
    books = df.select("fixture_id", *[F.col("p").alias(n) for n in ("p_home", "p_draw", "p_away")], F.lit(dt.datetime(2020, 1, 1)).alias("snapshot_time"))
    assert "percentile" not in k.median_consensus(books)._jdf.queryExecution().optimizedPlan().toString()


def test_quote_drift_equals_brute_force_and_spreads_sums_only(spark):
    rng = random.Random(8)
    day = dt.date(2021, 3, 20)
    fx = [(i, day + dt.timedelta(days=i % 3), f"T{i % 4}", f"T{(i + 1) % 4}") for i in range(40)]
    fx += [fx[5], (41, None, "T0", "T1")]
    quotes = [
        (rng.randrange(43), f"b{rng.randrange(3)}", dt.datetime(2021, 3, 1) + dt.timedelta(hours=rng.randrange(500)), rng.choice([None, 0.0, 1.5, 2.0, 3.0]), 3.0, rng.choice([1.5, 2.5]))
        for _ in range(400)
    ]
    fixtures = spark.createDataFrame(fx, "fixture_id long, date date, home_team string, away_team string")
    q = spark.createDataFrame(quotes, "fixture_id long, bookmaker string, snapshot_time timestamp_ntz, home_odds double, draw_odds double, away_odds double")
    for book in (None, "b1"):
        want = {}
        starts = sorted({(f, d) for f, d, _, _ in fx if d})
        for f, start in starts:
            times = sum(1 for g in fx if g[:2] == (f, start))
            own = [x for x in quotes if x[0] == f and x[3] is not None and x[2].date() < start for _ in range(times)]
            for back in range(1, 15):
                on = start - dt.timedelta(days=back)
                seen = [x for x in own if x[2].date() <= on]
                liked = [x for x in seen if x[1] == book]
                used = sorted(liked if len(liked) >= 2 else seen, key=lambda x: (x[2], x[1], x[3], x[5], x[4]))
                weight = min(1.0, (back - 1) / c.DRIFT_FADE_DAYS)
                if len(seen) < 2 or not weight or (used[-1][2] - used[0][2]).total_seconds() < c.DRIFT_MIN_HOURS * 3600:
                    continue
                for g in fx:
                    for team, side in ((g[2], 3), (g[3], 5)) if g[0] == f else ():
                        early, late = used[0][side], used[-1][side]
                        if early > 0 and late > 0:
                            want[team, on] = want.get((team, on), 0.0) + c.DRIFT_SCALE * (1 / late - 1 / early) * weight
        drift = pn.quote_drift(fixtures, q, book)
        got = {(x.team, x.date): x.drift for x in drift.collect()}
        assert want and got.keys() == want.keys()
        assert all(abs(got[x] - want[x]) < 1e-6 for x in want)
        # Only sums per team and span are spread over days, never fixtures.
        plan = drift._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("explode(sequence") :].splitlines()[1:]
        assert "Aggregate [team" in next(x for x in below if "Aggregate" in x)
