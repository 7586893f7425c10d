"""Chains by composition, settlement into stored state, cycles and replay, against one update after the other."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.operators import bradley_terry as bt
from ratewright.operators import cycle as cy
from ratewright.operators import history as hs
from ratewright.operators import live as lv
from ratewright.operators import quality as ql
from ratewright.operators import replay as rp
from ratewright.operators import settle as st
from ratewright.operators import settlement as se
from ratewright.operators.chains import Clamped

DAY = dt.date(2024, 1, 1)
CHAIN = "fixture_id long, date date, team_id string, actual_score_s double, e_kr double, surprise double, target double, gamma double"


@pytest.fixture
def split(spark):
    """Make even small inputs span many blocks, so that borders are crossed."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def v3_step(b, u, target, g):
    raw = 30 * u + (g * (target - b) if g else 0.0)
    return max(0.0, raw) if u > 0.001 else min(0.0, raw) if u < -0.001 else 0.0


@given(
    st_.lists(st_.tuples(st_.floats(-1, 1), st_.floats(900, 2100), st_.sampled_from([0.0, 0.08, 0.5])), max_size=150),
    st_.lists(st_.floats(-1000, 4000), min_size=1, max_size=8),
)
def test_composed_steps_equal_walked_steps(steps, starts):
    f = Clamped()
    for u, target, g in steps:
        f.step(u, target, g)
    for b in starts:
        walked = b
        for u, target, g in steps:
            walked += v3_step(walked, u, target, g)
        assert f(b) == pytest.approx(walked, abs=1e-7)
    assert (f.slope >= 0).all() and (np.diff(f.borders) >= 0).all() and len(f.slope) == len(f.level) == len(f.borders) + 1


def test_long_composition_stays_small():
    rng, f, b = random.Random(1), Clamped(), 1500.0
    for _ in range(6000):
        u, target = rng.uniform(-0.9, 0.9), rng.gauss(1500, 150)
        f.step(u, target, 0.08)
        b += v3_step(b, u, target, 0.08)
    assert len(f.slope) < 400 and f(1500.0) == pytest.approx(b, abs=1e-7)


def test_v3_chain_without_gravity_over_many_blocks(spark):
    # Every block's start depends on all blocks before it, as nothing is forgotten.
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(8)
        rows = [(i, DAY + dt.timedelta(days=i), "hot" if i % 10 else "cold", 0.0, 0.0, rng.uniform(-0.9, 0.9), 1500.0, 0.0) for i in range(900)]
        got = st.settle_v3(spark.createDataFrame(rows, CHAIN)).toPandas().set_index("fixture_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    b = {}
    for i, _, team, _, _, u, _, _ in rows:
        assert got.loc[i].b_before == pytest.approx(b.get(team, 1500.0), abs=1e-8)
        b[team] = b.get(team, 1500.0) + v3_step(b.get(team, 1500.0), u, 1500.0, 0.0)


def settle_by_hand(state, log, fixtures, kr):
    """One fixture after the other, as the tables would be updated."""
    state, log, skipped, new = {k: dict(v) for k, v in state.items()}, set(log), {}, []
    for f, status, competition, h, a, score in sorted(fixtures):
        logged = [(f, t) in log for t in (h, a)]
        known = [t in state for t in (h, a)]
        e = kr.get(f)
        cup = competition == "cup"
        if status != "finished":
            skipped[f] = "not_finished"
        elif score is None or "-" not in score:
            skipped[f] = "unparseable_score"
        elif all(logged):
            skipped[f] = "already_settled"
        elif e is None:
            skipped[f] = "no_frozen_kr"
        elif min(e) < 0.02 or max(e) > 0.98:
            skipped[f] = "ekr_out_of_bounds"
        elif not any(known) or (not cup and not all(known)):
            skipped[f] = "missing_v3_state"
        elif not any(k and not done for k, done in zip(known, logged)):
            skipped[f] = "already_settled"
        else:
            hg, ag = map(int, score.split("-"))
            s = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
            for i, (t, s, e_kr) in enumerate(((h, s, e[0]), (a, 1 - s, e[1]))):
                if known[i] and not logged[i]:
                    row = state[t]
                    pull = row["frozen"] if row["frozen"] is not None else row["market"] if row["market"] is not None else row["b"]
                    gravity = 0.0 if cup else 0.08 * (pull - row["b"])
                    raw = 30 * (s - e_kr) + gravity
                    step = max(0.0, raw) if s > e_kr + 0.001 else min(0.0, raw) if s < e_kr - 0.001 else 0.0
                    new.append((f, t, row["b"], step))
                    row.update(b=row["b"] + step, frozen=None, last=f)
                    log.add((f, t))
    return state, new, skipped


def test_settle_state_is_one_update_after_the_other(spark, split):
    rng = random.Random(21)
    teams = [f"t{i}" for i in range(8)]
    state = {t: {"b": rng.gauss(1500, 100), "market": rng.choice([None, rng.gauss(1500, 100)]), "frozen": rng.choice([None, rng.gauss(1500, 100)]), "last": None} for t in teams[:6]}
    fixtures, kr = [], {}
    for f in range(300):
        h, a = rng.sample(teams, 2) if rng.random() < 0.5 else ("t0", rng.choice(teams[1:]))
        status = rng.choice(["finished"] * 6 + ["upcoming"])
        fixtures.append((f, status, rng.choice(["league", "league", "cup"]), h, a, rng.choice(["0-0", "2-1", "0-3", "1-1", "4-0", "abc", None])))
        if rng.random() < 0.85:
            e = rng.choice([rng.uniform(0.1, 0.9), 0.99])
            kr[f] = (e, 1 - e)
    log = {(f, t) for f, _, _, h, a, _ in fixtures for t in (h, a) if rng.random() < 0.15}
    frames = (
        spark.createDataFrame([(t, "L", v["b"], 3.0, 1.0, v["market"], v["frozen"], None if v["frozen"] is None else 3.0, 0.7) for t, v in state.items()],
            "team_id string, league string, b_value double, m1_value double, l_value double, r_market double, r_market_frozen double, m1_locked double, bt_std_error double").withColumn("published_index", F.col("b_value")),
        spark.createDataFrame([(f, t, "v3") for f, t in log] + [(0, "t0", "v1")], "fixture_id long, team_id string, oracle_version string"),
        spark.createDataFrame([(f, s, comp, h, a, score, DAY, "L") for f, s, comp, h, a, score in fixtures], "fixture_id long, status string, competition string, home_team string, away_team string, score string, date date, league string"),
        spark.createDataFrame([(f, *e, 3) for f, e in kr.items()], "fixture_id long, home_expected_score double, away_expected_score double, bookmaker_count int"),
    )
    out = se.settle_state(*frames, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    want_state, want_log, want_skipped = settle_by_hand(state, log, fixtures, kr)
    got = {(x.fixture_id, x.team_id): x for x in out.log.collect()}
    assert got.keys() == {(f, t) for f, t, _, _ in want_log}
    for f, t, before, step in want_log:
        assert got[f, t].b_before == pytest.approx(before, abs=2e-6) and got[f, t].delta_b == pytest.approx(step, abs=2e-6)
    assert {x.fixture_id: x.skipped_reason for x in out.skipped.collect()} == want_skipped
    rows = {x.team_id: x for x in out.state.collect()}
    assert rows.keys() == state.keys() and all(x.bt_std_error == 0.7 for x in rows.values())
    for t, v in want_state.items():
        assert rows[t].b_value == pytest.approx(v["b"], abs=1e-4) and rows[t].last_kr_fixture_id == v["last"]
        assert rows[t].r_market_frozen == (pytest.approx(v["frozen"]) if v["frozen"] is not None else None)
        if v["last"] is not None:
            assert rows[t].m1_locked is None and rows[t].l_value == 0.0 and rows[t].published_index == pytest.approx(v["b"] + 3.0, abs=1e-3)
    assert out.history.count() == len(want_log)
    again = se.settle_state(out.state, frames[1].unionByName(out.log.select(*frames[1].columns)), *frames[2:], F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    assert again.log.count() == 0 and again.history.count() == 0
    assert sorted(map(str, again.state.select(*out.state.columns).collect())) == sorted(map(str, out.state.collect()))


# --- whole cycles


def devigged(o):
    lo, hi = 0.01, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum((1 / x) ** mid for x in o) > 1 else (lo, mid)
    return [(1 / x) ** lo for x in o]


def consensus(rows):
    """Normalised medians of each book's last quote, or None below two books."""
    last = {}
    for q in rows:
        if q["book"] not in last or q["ts"] > last[q["book"]]["ts"]:
            last[q["book"]] = q
    if len(last) < 2:
        return None
    m = np.median([devigged(q["odds"]) for q in last.values()], axis=0)
    return m / m.sum()


def solved_by_hand(edges, prior):
    """Posterior mode by many small gradient steps."""
    teams = sorted({t for h, a, _, _ in edges for t in (h, a)})
    r = {t: prior.get(t, 1500.0) for t in teams}
    sigma, mu = 200.0 if len(edges) < 5 else 300.0, dict(r)
    q = np.log(10) / 400
    for _ in range(3000):
        g = {t: -(r[t] - mu[t]) / sigma**2 for t in teams}
        for h, a, es, w in edges:
            p = 1 / (1 + 10 ** (-(r[h] - r[a] + 65) / 400))
            g[h] += w * (es - p) * q
            g[a] -= w * (es - p) * q
        r = {t: r[t] + 5000 * g[t] for t in teams}
    return r


class Hand:
    """Solves and refreshes over plain dicts, as of one time."""

    def __init__(self, state, fixtures, kr, es, now):
        self.state, self.fixtures, self.kr, self.es, self.now = state, fixtures, kr, es, now

    def nexts(self, net):
        out = {}
        for t in net:
            mine = [f for f in self.fixtures if f["competition"] == "league" and f["status"] == "upcoming" and f["date"] >= self.now.date() and t in (f["home"], f["away"])]
            if mine:
                f = min(mine, key=lambda f: (f["date"], f["start"] or dt.datetime.min, f["id"]))
                other = f["away"] if t == f["home"] else f["home"]
                if f["id"] in self.es and other in net:
                    e = min(0.99, max(0.01, self.es[f["id"]] if t == f["home"] else 1 - self.es[f["id"]]))
                    out[t] = net[other] + 400 * np.log10(e / (1 - e)) + (-65 if t == f["home"] else 65)
        return out

    def overlay(self, net):
        nxt = self.nexts(net)
        for t in net:
            market = 0.85 * net[t] + 0.15 * nxt.get(t, net[t])
            yield t, market, max(-120.0, min(120.0, 0.4 * (market - self.state[t]["b"])))

    def solve(self, lg):
        now, edges = self.now, []
        inside = [f for f in self.fixtures if f["league"] == lg and f["competition"] == "league"]
        past = [f for f in inside if f["status"] == "finished" and f["date"] <= now.date()]
        near, wide = ([f for f in past if (now.date() - f["date"]).days <= n] for n in (30, 45))
        chosen = wide if len(near) < 5 and len(wide) > len(near) else near

        def age(f):
            return (now - (f["start"] or dt.datetime.combine(f["date"], dt.time(12)))).total_seconds() / 86400

        for f in chosen:
            e = self.kr[f["id"]][0] if f["id"] in self.kr else self.es.get(f["id"])
            if e is not None:
                edges.append((f["home"], f["away"], e, 1 / (1 + max(0.0, age(f)) / 14)))
        for f in inside:
            if f["status"] == "upcoming" and 0 <= (f["date"] - now.date()).days <= 30 and f["id"] in self.es:
                edges.append((f["home"], f["away"], self.es[f["id"]], 1 / (1 + max(0.0, -age(f)) / 7)))
        if len(edges) <= 2:
            for v in self.state.values():
                if v["league"] == lg:
                    v.update(m1=0.0, market=v["b"], published=round(v["b"], 4))
            return
        mode = solved_by_hand(edges, {t: v["b"] for t, v in self.state.items()})
        net = {t: x for t, x in mode.items() if t in self.state}
        for t, market, m1 in list(self.overlay(net)):
            v = self.state[t]
            was = v["locked"] is not None or v["frozen"] is not None
            v.update(network=net[t], market=market, m1=m1, published=v["published"] if was else v["b"] + m1)

    def refresh(self, lg):
        net = {t: v["network"] if v["network"] is not None else v["b"] for t, v in self.state.items() if v["league"] == lg}
        done = set()
        for t, market, m1 in list(self.overlay(net)):
            v = self.state[t]
            if v["locked"] is None and v["frozen"] is None:
                v.update(market=market, m1=m1, published=v["b"] + m1)
                done.add(t)
        return done


def settle_into(state, logged, due, kr):
    """Settle by hand into the full state; the new log rows."""
    hand = {t: {"b": v["b"], "market": v["market"], "frozen": v["frozen"], "last": None} for t, v in state.items()}
    hand, new, _ = settle_by_hand(hand, logged, due, kr)
    for t, v in hand.items():
        if v["last"] is not None:
            state[t].update(b=v["b"], frozen=None, locked=None, l=0.0, published=v["b"] + state[t]["m1"])
    return new


def cycle_by_hand(state, logged, fixtures, kr, quotes, now):
    """The four steps one after the other over plain dicts."""
    due = [(f["id"], f["status"], f["competition"], f["home"], f["away"], f["score"]) for f in fixtures if f["status"] == "finished"]
    new = settle_into(state, logged, due, kr)
    for v in state.values():
        v["b"] = round(v["b"], 4)
    by_id = {f["id"]: f for f in fixtures}
    leagues = {by_id[f]["league"] for f, *_ in new if by_id[f]["competition"] == "league"}
    es = {}
    for f in fixtures:
        kick = f["start"] or dt.datetime.combine(f["date"], dt.time(23, 59, 59))
        c3 = consensus([q for q in quotes if q["id"] == f["id"] and q["ts"] <= now and q["ts"] < kick])
        if c3 is not None:
            es[f["id"]] = min(0.99, max(0.01, c3[0] + 0.5 * c3[1]))
    hand = Hand(state, fixtures, kr, es, now)
    for lg in leagues:
        hand.solve(lg)
    for f in fixtures:
        if f["start"] and dt.timedelta(0) < now - f["start"] < dt.timedelta(hours=4) and f["status"] not in ("finished", "cancelled"):
            c3 = consensus([q for q in quotes if q["id"] == f["id"] and f["start"] < q["ts"] <= now and now - q["ts"] <= dt.timedelta(minutes=3)])
            for i, t in enumerate((f["home"], f["away"])):
                if t not in state:
                    continue
                v = state[t]
                if v["locked"] is None:
                    v.update(locked=v["m1"], frozen=round(v["market"] if v["market"] is not None else v["b"] + v["m1"], 4))
                if c3 is not None and f["id"] in kr:
                    raw = c3[2 * i] + 0.5 * c3[1]
                    live = 30 * (raw + c3[1] * (0.5 - raw) - kr[f["id"]][i])
                    v.update(l=live, published=0.6 * (v["b"] + live) + 0.4 * v["frozen"])
    refreshed = set()
    for lg in {v["league"] for v in state.values()} - leagues:
        refreshed |= hand.refresh(lg)
    logged |= {(f, t) for f, t, *_ in new}
    return new, leagues, refreshed


def test_cycles_are_the_four_steps_one_after_the_other(spark, tmp_path):
    rng = random.Random(31)
    leagues = {"A": [f"a{i}" for i in range(5)], "B": [f"b{i}" for i in range(4)], "C": ["c0", "c1"]}
    nows = [dt.datetime(2024, 2, 1, 18), dt.datetime(2024, 2, 9, 18), dt.datetime(2024, 2, 20, 18)]
    fixtures, quotes, kr = [], [], {}
    for i in range(170):
        lg = rng.choice("AAAABB") if i % 40 else "C"
        h, a = rng.sample(leagues[lg], 2) if i % 12 else (rng.choice(leagues["A"]), rng.choice([*leagues["B"], "stranger"]))
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(75))
        if lg == "B" and dt.date(2024, 2, 1) <= day < dt.date(2024, 2, 9):
            day += dt.timedelta(days=9)  # a league that the second cycle has nothing to settle for
        if i < 9:
            day = nows[i // 3].date()  # under way at a cycle
        start = None if i % 9 == 8 else dt.datetime.combine(day, dt.time(16 if i < 9 else rng.randrange(11, 20)))
        fixtures.append({"id": i, "date": day, "start": start, "league": "CUP" if i % 12 == 0 else lg, "competition": "league" if i % 12 else "cup", "home": h, "away": a, "final": f"{rng.randrange(4)}-{rng.randrange(4)}"})
        for book in "xyz"[: rng.choice([1, 2, 3, 3])]:
            for _ in range(2):
                ts = dt.datetime.combine(day, dt.time()) - dt.timedelta(hours=rng.randrange(1, 300))
                quotes.append({"id": i, "book": book, "ts": ts, "odds": [rng.uniform(1.6, 5), rng.uniform(2.8, 4), rng.uniform(1.6, 5)]})
        if i < 9 and i % 3 < 2:
            for book in "xy":
                quotes.append({"id": i, "book": book, "ts": nows[i // 3] - dt.timedelta(minutes=rng.randrange(1, 3)), "odds": [rng.uniform(1.6, 5), 3.2, rng.uniform(1.6, 5)]})
        if rng.random() < 0.9:
            e = round(rng.uniform(0.2, 0.8), 6)
            kr[i] = (e, round(1 - e, 6))
    state = {t: {"league": lg, "b": round(rng.gauss(1500, 80), 4), "m1": 0.0, "l": 0.0, "market": None, "network": None, "frozen": None, "locked": None} for lg, ts in leagues.items() for t in ts}
    for v in state.values():
        v["published"] = v["b"]

    frame = spark.createDataFrame([(f["id"], f["date"], f["start"], f["league"], f["competition"], f["home"], f["away"], f["final"], "finished") for f in fixtures],
        "fixture_id long, date date, commence_time timestamp_ntz, league string, competition string, home_team string, away_team string, score string, status string")
    offers = spark.createDataFrame([(q["id"], q["book"], q["ts"], *q["odds"]) for q in quotes], "fixture_id long, bookmaker string, snapshot_time timestamp_ntz, home_odds double, draw_odds double, away_odds double")
    frozen = spark.createDataFrame([(f, *e, 3) for f, e in kr.items()], "fixture_id long, home_expected_score double, away_expected_score double, bookmaker_count int")
    stored = cy.fresh_state(spark.createDataFrame([(t, v["league"], v["b"]) for t, v in state.items()], "team_id string, league string, b_value double"))
    recent = spark.createDataFrame([], "fixture_id long, team_id string, oracle_version string, date date")
    root, logged, idle = str(tmp_path / "cycles"), set(), set()
    for n, now in enumerate(nows):
        at = F.lit(str(now)).cast("timestamp_ntz")
        if n:
            stored, recent = (cy.committed(spark, root, n - 1, x) for x in ("state", "recent"))
        cy.commit(root, n, cy.run_cycle(stored, recent, cy.as_known(frame, at), frozen, offers, at), at)
        seen = [{**f, "status": "finished" if f["date"] < now.date() else "upcoming", "score": f["final"] if f["date"] < now.date() else "N/A"} for f in fixtures]
        new, solved, refreshed = cycle_by_hand(state, logged, seen, kr, quotes, now)
        idle |= refreshed
        log = cy.committed(spark, root, n, "log").collect()
        assert {(r.fixture_id, r.team_id) for r in log} == {(f, t) for f, t, *_ in new} and new
        assert {r.league for r in cy.committed(spark, root, n, "solves").collect()} == {lg for lg in solved if any(v["league"] == lg and v["network"] is not None for v in state.values())}
        got = {r.team_id: r for r in cy.committed(spark, root, n, "state").collect()}
        assert got.keys() == state.keys()
        for t, v in state.items():
            for name, key in (("b_value", "b"), ("m1_value", "m1"), ("r_market", "market"), ("r_network", "network"), ("r_market_frozen", "frozen"), ("m1_locked", "locked"), ("l_value", "l"), ("published_index", "published")):
                assert getattr(got[t], name) == (pytest.approx(v[key], abs=2e-2) if v[key] is not None else None), (n, t, name)
        reasons = {}
        for r in cy.committed(spark, root, n, "history").collect():
            reasons.setdefault(r.publish_reason, []).append(r)
        assert len(reasons["settlement_v3"]) == len(new) and len(reasons["live_update_v3"]) > 0
    assert idle and len({(r.fixture_id, r.team_id) for r in spark.read.parquet(f"{root}/log").collect()}) == spark.read.parquet(f"{root}/log").count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        cy.committed(spark, root, 9, "state")


# --- replay -------------------------------------------------------------------------------


def replay_by_hand(state, fixtures, kr, es, every):
    """Fixture after fixture in time order; solves after every ``every`` settlements, or daily with refreshes."""
    order = sorted((f for f in fixtures if f["status"] == "finished"), key=lambda f: (f["date"], f["start"] or dt.datetime.min, f["id"]))
    logged, log, history, leagues, settled, waiting = set(), [], [], set(), 0, []
    every_league = {v["league"] for v in state.values()}

    def close(step):
        day = waiting[-1]["date"] + dt.timedelta(days=1)
        now = dt.datetime.combine(day, dt.time())
        seen = [{**f, "status": ("finished" if f["date"] < day else "upcoming") if f["status"] == "finished" else f["status"]} for f in fixtures]
        hand = Hand(state, seen, kr, es, now)
        for v in state.values():
            v["b"] = round(v["b"], 4)
        for lg in every_league if every is None else leagues:
            (hand.solve if lg in leagues else hand.refresh)(lg)
            history.extend((step, t, v["published"]) for t, v in state.items() if v["league"] == lg)
        leagues.clear()
        waiting.clear()

    for f in order:
        if every is None and waiting and waiting[-1]["date"] != f["date"]:
            close((waiting[-1]["date"] - dt.date(1970, 1, 1)).days)
        new = settle_into(state, logged, [(f["id"], f["status"], f["competition"], f["home"], f["away"], f["score"])], kr)
        if not new:
            continue
        logged |= {(i, t) for i, t, *_ in new}
        log += new
        settled += 1
        waiting.append(f)
        if f["competition"] == "league":
            leagues.add(f["league"])
        if every is not None and settled % every == 0:
            close(settled // every - 1)
    if waiting:
        close(settled // every if every else (waiting[-1]["date"] - dt.date(1970, 1, 1)).days)
    return log, history


@pytest.mark.parametrize("every", [7, None])
def test_replay_is_a_loop_over_time(spark, tmp_path, monkeypatch, every):
    monkeypatch.setattr(rp, "EPOCH", 28)
    rng = random.Random(41)
    leagues = {"A": [f"a{i}" for i in range(5)], "B": [f"b{i}" for i in range(4)], "C": ["c0", "c1"]}
    fixtures, kr, es = [], {}, {}
    for i in range(150):
        lg = rng.choice("AAAABB") if i % 30 else "C"
        cup = i % 12 == 5
        h, a = (rng.choice(leagues["A"]), rng.choice([*leagues["B"], "stranger"])) if cup else rng.sample(leagues[lg], 2)
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(70) + (60 if i % 50 == 3 else 0))
        start = None if i % 9 == 8 else dt.datetime.combine(day, dt.time(rng.randrange(11, 20)))
        status = rng.choice(["finished"] * 8 + ["upcoming", "live"])
        fixtures.append({"id": i, "date": day, "start": start, "league": "CUP" if cup else lg, "competition": "cup" if cup else "league", "home": h, "away": a, "status": status, "score": f"{rng.randrange(4)}-{rng.randrange(4)}"})
        e = round(rng.uniform(0.2, 0.8), 6)
        if rng.random() < 0.9:
            kr[i] = (e, round(1 - e, 6))
        if rng.random() < 0.8:
            es[i] = rng.uniform(0.2, 0.8)
    state = {t: {"league": lg, "b": round(rng.gauss(1500, 80), 4), "m1": 0.0, "l": 0.0, "market": None, "network": None, "frozen": None, "locked": None, "published": None} for lg, ts in leagues.items() for t in ts}
    frame = spark.createDataFrame([(f["id"], f["date"], f["start"], f["league"], f["competition"], f["home"], f["away"], f["score"], f["status"]) for f in fixtures],
        "fixture_id long, date date, commence_time timestamp_ntz, league string, competition string, home_team string, away_team string, score string, status string")
    frozen = spark.createDataFrame([(f, *e, 3) for f, e in kr.items()], "fixture_id long, home_expected_score double, away_expected_score double, bookmaker_count int")
    current = spark.createDataFrame(list(es.items()), "fixture_id long, home_es double")
    start = spark.createDataFrame([(t, v["league"], v["b"]) for t, v in state.items()], "team_id string, league string, b_value double")
    for v in state.values():
        v["published"] = v["b"]
    root = str(tmp_path / "replay")
    out = rp.replay(frame, frozen, current, start, every, root)
    log, history = replay_by_hand(state, fixtures, kr, es, every)
    got = {(r.fixture_id, r.team_id): r for r in out["log"].collect()}
    assert got.keys() == {(f, t) for f, t, *_ in log} and len(log) > 150
    for f, t, before, step in log:
        assert got[f, t].b_before == pytest.approx(before, abs=2e-2) and got[f, t].delta_b == pytest.approx(step, abs=2e-2)
    steps = {(r.step, r.team_id): r.published_index for r in out["history"].collect()}
    assert steps.keys() == {(s, t) for s, t, _ in history}
    for s, t, published in history:
        assert steps[s, t] == pytest.approx(published, abs=3e-2), (s, t)
    for r in out["state"].collect():
        assert r.b_value == pytest.approx(state[r.team_id]["b"], abs=2e-2) and r.published_index == pytest.approx(state[r.team_id]["published"], abs=3e-2)
    # Several epochs were written; a later call reads them instead of walking them again.
    epochs = sorted(p.name for p in (tmp_path / "replay").iterdir())
    assert len(epochs) > 3
    stamp = {p: (tmp_path / "replay" / p / "_SUCCESS").stat().st_mtime_ns for p in epochs}
    again = rp.replay(frame, frozen, current, start, every, root)
    assert sorted(map(str, again["state"].collect())) == sorted(map(str, out["state"].collect()))
    assert stamp == {p: (tmp_path / "replay" / p / "_SUCCESS").stat().st_mtime_ns for p in epochs}


def test_replay_weighs_a_days_fixtures_once(monkeypatch):
    rng, weighed = random.Random(5), []
    own = rp._League._sums
    monkeypatch.setattr(rp._League, "_sums", lambda self, today: weighed.append(today) or own(self, today))
    teams, rows = ["a", "b", "c", "d"], []
    for i in range(200):
        (h, a), day, e = rng.sample(teams, 2), 100 + i // 40, rng.uniform(0.2, 0.8)
        rows.append({"kind": "fixture", "fixture_id": i, "team_id": h, "opponent": a, "day": day, "start": i, "at": day + 0.5, "e": e, "s": e, "status": "finished"})
        for team, x, score in ((h, e, 1.0), (a, 1 - e, 0.0)):
            rows.append({"kind": "side", "step": i, "fixture_id": i, "team_id": team, "is_home": team == h, "competition": "league", "day": day, "start": i, "e": x, "s": score})
        rows.append({"kind": "step", "step": i, "day": day + 1})
    rows += [{"kind": "state", "team_id": x, "v": [1500.0, None, None, None, 0.0, 1500.0]} for x in teams]
    out = rp._walk(False)(pd.DataFrame([{n.split()[0]: None for n in rp.ROWS.split(", ")} | r | {"league": "L"} for r in rows]))
    assert weighed == [101, 102, 103, 104, 105]
    assert out["kind"].value_counts().to_dict() == {"log": 400, "history": 800, "state": 4}


def test_small_leagues_reach_the_mode_that_newton_finds():
    rng = np.random.default_rng(3)
    home, away = map(np.array, zip(*[(i, j) for i in range(6) for j in range(6) if i != j]))
    w = rng.uniform(0.1, 2, len(home))
    ws, prior = w * rng.uniform(0.1, 0.9, len(home)), rng.normal(1500, 50, 6)
    sums = rp._Sums(len(home), np.arange(6), home, away, w, ws)
    assert rp._mode(sums, prior, 300.0) == pytest.approx(rp.newton(home, away, w, ws, prior, 300.0).rating, abs=1e-8)


def test_replay_of_nothing(spark):
    fixtures = spark.createDataFrame([], "fixture_id long, date date, commence_time timestamp_ntz, league string, competition string, home_team string, away_team string, score string, status string")
    kr = spark.createDataFrame([], "fixture_id long, home_expected_score double, away_expected_score double, bookmaker_count int")
    out = rp.replay(fixtures, kr, spark.createDataFrame([], "fixture_id long, home_es double"), spark.createDataFrame([("a", "L", 1500.0)], "team_id string, league string, b_value double"))
    assert out["log"].collect() == [] and [(r.team_id, r.published_index) for r in out["state"].collect()] == [("a", 1500.0)]


def long_walk(names, days, quiet):
    """Rows of leagues of four teams, a contest every day and a step of three contests but in ``quiet`` days, in the order in which a walk needs them."""
    rng, rows = random.Random(9), []
    for lg in names:
        teams, todo, at = [f"{lg}{i}" for i in range(4)], [], None
        rows += [{"league": lg, "kind": "state", "team_id": x, "v": [1500.0, None, None, None, 0.0, 1500.0]} for x in teams]
        for i in range(days):
            (h, a), e = rng.sample(teams, 2), rng.uniform(0.2, 0.8)
            todo.append((i - c.WINDOW_DAYS, -1, 0, {"kind": "fixture", "fixture_id": i, "team_id": h, "opponent": a, "day": i, "start": i, "at": i + 0.5, "e": e, "s": e, "status": "finished"}))
            until = i // 3 * 3 + 3
            if i in quiet:
                continue
            todo += [(until, i // 3, 0, {"kind": "side", "step": i // 3, "fixture_id": i, "team_id": x, "is_home": x == h, "competition": "league", "day": i, "start": i, "e": 0.5, "s": float(x == h)}) for x in (h, a)]
            todo += [(until, i // 3, 1, {"kind": "step", "step": i // 3, "day": until})] * (i % 3 == 2)
        last = {}
        for i in range(days):
            f = next(r for _, _, _, r in todo if r["kind"] == "fixture" and r["fixture_id"] == i)
            for team, other in ((f["team_id"], f["opponent"]), (f["opponent"], f["team_id"])):
                todo.append((last.get(team, -1) + 1, -1, 1, {"kind": "next", "team_id": team, "opponent": other, "is_home": team == f["team_id"], "day": i, "e": f["e"]}))
                last[team] = i
        rows += [r | {"league": lg} for _, _, _, r in sorted(todo, key=lambda x: x[:3])]
    return pd.DataFrame([{n.split()[0]: None for n in rp.ROWS.split(", ")} | r for r in rows])


def test_a_walk_holds_one_window_of_fixtures(monkeypatch):
    days, quiet, read, seen, most = 600, range(210, 510), [], [], []
    rows = long_walk(["L", "M"], days, quiet)
    own, keep = rp._League._sums, rp._League._keep
    monkeypatch.setattr(rp._League, "_sums", lambda self, today: seen.append(today) or own(self, today))
    monkeypatch.setattr(rp._League, "_keep", lambda self, today: most.append(len(self.held[0]) + self.new) or keep(self, today))
    monkeypatch.setattr(rp, "CHUNK", 50)

    def batches():
        for lo in range(0, len(rows), 20):
            read.append(lo)
            yield rows.iloc[lo : lo + 20].reset_index(drop=True)

    out, early = [], []
    for part in rp._walks(False)(batches()):
        out.append(part)
        early.append(read[-1])
    # As much again may come before what has passed is dropped, in the quiet days too.
    window = c.WINDOW_EXPANDED_DAYS + c.WINDOW_DAYS + 1
    assert len(seen) == 2 * (days - len(quiet)) // 3 and max(most) <= 2 * (window + 20)
    assert early[0] < len(rows) / 20 and max(map(len, out)) < 100
    # What comes out is the same, however the rows are cut and whether a league's come sorted or not.
    whole = pd.concat([rp._walk(False)(rows[rows["league"] == lg].sample(frac=1, random_state=4)) for lg in ("L", "M")])

    def plain(frame, kind):
        part = frame[frame["kind"] == kind].sort_values(["league", "step", "fixture_id", "team_id"])
        return part[["league", "step", "fixture_id", "team_id", "b_before", "delta_b"]].astype(object).where(lambda x: x.notna(), None).values.tolist(), np.array([x for x in part["v"] if x is not None])

    for kind, n in (("log", 4 * (days - len(quiet))), ("history", 8 * (days - len(quiet)) // 3), ("state", 8)):
        (got, v), (want, w) = plain(pd.concat(out), kind), plain(whole, kind)
        assert got == want and len(got) == n and np.array_equal(v, w, equal_nan=True)


def test_rows_come_in_the_order_of_the_walk(spark):
    rng, day = random.Random(2), lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    teams = {"A": ["a0", "a1", "a2"], "B": ["b0", "b1"]}
    games = [(i, lg, *rng.sample(teams[lg], 2), rng.randrange(200)) for i in range(120) for lg in [rng.choice("AAB")]]
    start = dt.datetime(2024, 1, 1)
    fixtures = spark.createDataFrame([(i, day(d), lg, h, a, "finished", start, float(d), 0.5, 0.5) for i, lg, h, a, d in games], "fixture_id long, date date, league string, home_team string, away_team string, status string, _start timestamp_ntz, _noon double, home_expected_score double, home_es double")
    sides = spark.createDataFrame([(d // 7, (day(d // 7 * 7 + 7) - dt.date(1970, 1, 1)).days, lg, i, x, x == h, "league", day(d), start, 0.5, 1.0) for i, lg, h, a, d in games for x in (h, a)], "step long, until int, league string, fixture_id long, team_id string, is_home boolean, competition string, date date, _start timestamp_ntz, e_kr double, actual_score_s double")
    state = spark.createDataFrame([(x, lg, *[1500.0] * 6) for lg, xs in teams.items() for x in xs], ["team_id", "league", *rp.STATE])
    lo, hi = ((day(x) - dt.date(1970, 1, 1)).days for x in (0, 199))
    nexts = rp._next_games(fixtures)
    rows = rp._sorted(rp._epoch_rows(sides, fixtures, nexts, state, sides.select("step", "until", "league").distinct(), lo, hi)).collect()
    assert len(rows) == 5 + 240 + 120 + nexts.where(F.unix_date("date") > lo).count() + len({(lg, d // 7) for _, lg, _, _, d in games})
    for lg, xs in teams.items():
        # All of a league's rows stand together, states first.
        at = [i for i, r in enumerate(rows) if r.league == lg]
        mine = [rows[i] for i in at]
        assert at == list(range(at[0], at[-1] + 1)) and [r.kind for r in mine[: len(xs)]] == ["state"] * len(xs)
        here = [(i, h, a, (day(d) - dt.date(1970, 1, 1)).days) for i, g, h, a, d in games if g == lg]
        came, awaited, settled = set(), {}, []
        for r in mine:
            if r.kind == "fixture":
                came.add(r.fixture_id)
            elif r.kind == "next":
                awaited.setdefault(r.team_id, []).append(r.day)
            elif r.kind == "side":
                settled.append((r.step, r.day, r.fixture_id, not r.is_home))
            elif r.kind == "step":
                # What a solve at this day looks at has come, and little else.
                assert {i for i, _, _, d in here if d <= r.day + c.WINDOW_DAYS} == came
                assert len([x for x in settled if x[0] == r.step]) == 2 * len([i for i, _, _, d in here if (d - lo) // 7 == r.step])
                for x in xs:
                    due = min((d for _, h, a, d in here if x in (h, a) and d >= r.day), default=None)
                    assert next((d for d in awaited.get(x, []) if d >= r.day), None) == due and (due is None or awaited[x][-1] == due)
        assert settled == sorted(settled)


def test_replay_hangs_on_no_borders_of_batches(spark):
    rng = random.Random(6)
    teams = {"A": ["a0", "a1", "a2", "a3"], "B": ["b0", "b1", "b2"]}
    rows = []
    for i in range(120):
        lg, day = rng.choice("AB"), dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(150))
        rows.append((i, day, dt.datetime.combine(day, dt.time(15)), lg, "league", *rng.sample(teams[lg], 2), f"{rng.randrange(3)}-{rng.randrange(3)}", rng.choice(["finished"] * 4 + ["upcoming", "live"])))
    fixtures = spark.createDataFrame(rows, "fixture_id long, date date, commence_time timestamp_ntz, league string, competition string, home_team string, away_team string, score string, status string")
    kr = spark.createDataFrame([(i, 0.3 + i % 5 / 10, 0.7 - i % 5 / 10, 3) for i in range(120)], "fixture_id long, home_expected_score double, away_expected_score double, bookmaker_count int")
    current = spark.createDataFrame([(i, 0.25 + i % 7 / 20) for i in range(0, 120, 2)], "fixture_id long, home_es double")
    state = spark.createDataFrame([(x, lg, 1500.0) for lg, xs in teams.items() for x in xs], "team_id string, league string, b_value double")
    seen = []
    for size in ("2000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            out = rp.replay(fixtures, kr, current, state, 5)
            seen.append({n: sorted(map(str, df.collect())) for n, df in out.items()})
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert seen[0] == seen[1] and len(seen[0]["log"]) > 100 and len(seen[0]["history"]) > 100


# --- solves of large leagues ----------------------------------------------------------------


def test_a_league_of_five_thousand_teams(spark):
    rng = np.random.default_rng(3)
    n, m = 5000, 30_000
    strength = rng.normal(1500, 120, n)
    h, a = rng.integers(0, n, m), rng.integers(0, n, m)
    keep = h != a
    h, a = h[keep], a[keep]
    es = np.clip(1 / (1 + 10 ** (-(strength[h] - strength[a] + 65) / 400)) + rng.normal(0, 0.05, len(h)), 0.02, 0.98)
    edges = spark.createDataFrame([(int(i), "big", f"t{x}", f"t{y}", float(e), 1.0) for i, (x, y, e) in enumerate(zip(h, a, es))], "fixture_id long, league string, home_team string, away_team string, home_es double, weight double")
    solved = bt.map_ratings(edges, spark.createDataFrame([], "team_id string, b_value double")).toPandas()
    solved = solved.assign(i=solved.team.str[1:].astype(int)).sort_values("i")
    assert len(solved) == len(set(h) | set(a)) and solved.converged.all()
    place = np.full(n, -1)
    place[solved.i] = np.arange(len(solved))
    h, a, r, k = place[h], place[a], solved.rating.to_numpy(), len(solved)
    p = 1 / (1 + 10 ** (-(r[h] - r[a] + 65) / 400))
    pull = (es - p) * bt.ELO
    gradient = np.bincount(h, pull, k) - np.bincount(a, pull, k) - (r - 1500) / 300**2
    assert np.abs(gradient).max() < 1e-7
    v = p * (1 - p) * bt.ELO**2
    dense = np.diag(np.bincount(h, v, k) + np.bincount(a, v, k) + 300.0**-2)
    np.add.at(dense, (h, a), -v)
    np.add.at(dense, (a, h), -v)
    some = np.arange(0, k, 500)
    unit = np.zeros((k, len(some)))
    unit[some, np.arange(len(some))] = 1
    want = np.sqrt(np.linalg.solve(dense, unit)[some, np.arange(len(some))])
    assert solved.std_error.to_numpy()[some] == pytest.approx(want, rel=1e-6)


def test_v2_chain_over_several_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(st, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(5)
        rows = []
        for i in range(400):
            h, a = rng.sample([f"t{j}" for j in range(7)], 2) if i % 8 else rng.sample([f"u{j}" for j in range(3)], 2)
            e = rng.uniform(0.1, 0.9)
            rows.append((i, DAY + dt.timedelta(days=i // 3), h, a, rng.choice([0.0, 0.5, 1.0]), e, 1 - e))
        df = spark.createDataFrame(rows, "fixture_id long, date date, home_team string, away_team string, s_home double, e_home double, e_away double")
        got = st.settle_v2(df).toPandas().set_index("fixture_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    b = {}
    for i, _, h, a, s, eh, ea in rows:
        bh, ba = b.get(h, 1500.0), b.get(a, 1500.0)
        assert got.loc[i].home_b_before == pytest.approx(bh, abs=1e-7) and got.loc[i].away_b_before == pytest.approx(ba, abs=1e-7)
        b[h] = bh + 30 * (s - eh) + 0.05 * (ba + 400 * np.log10(eh / (1 - eh)) - 65 - bh)
        b[a] = ba + 30 * (1 - s - ea) + 0.05 * (bh + 400 * np.log10(ea / (1 - ea)) + 65 - ba)
        assert got.loc[i].home_delta_b == pytest.approx(b[h] - bh, abs=1e-7)


# --- trailing mean prices and feedback -------------------------------------------------------


def test_trailing_mean_is_the_integral_of_the_steps(spark, split):
    rng = random.Random(51)
    t0 = dt.datetime(2024, 1, 1)
    points = [("hot" if rng.random() < 0.6 else rng.choice("abc"), t0 + dt.timedelta(seconds=10 * rng.randrange(400)), i, rng.uniform(90, 110)) for i in range(500)]
    asked = [(team, t0 + dt.timedelta(seconds=10 * rng.randrange(420))) for team in ("hot", "a", "b", "nobody") for _ in range(60)]
    frame = spark.createDataFrame(points, "team string, ts timestamp_ntz, event_id long, price double")
    requests = spark.createDataFrame(asked, "team string, at timestamp_ntz")
    got = {(r.team, r.at): r for r in hs.twap_at(frame, requests, 300).collect()}
    want = {}
    for team, at in set(asked):
        mine = sorted(p[1:] for p in points if p[0] == team)
        start, area, time = at - dt.timedelta(seconds=300), 0.0, 0.0
        for (a, _, price), b in zip(mine, [p[0] for p in mine[1:]] + [dt.datetime.max]):
            held = (min(b, at) - max(a, start)).total_seconds()
            if held > 0:
                area, time = area + price * held, time + held
        inside = [p for p in mine if start <= p[0] <= at]
        if len(inside) >= 3:
            want[team, at] = (len(inside), area / time if time else None)
    assert got.keys() == want.keys() and len(want) > 60
    for key, (n, price) in want.items():
        assert got[key].points == n and (price is None or got[key].twap_price == pytest.approx(price, abs=1e-9))
    assert hs.twap_at(frame.limit(0), requests, 300).collect() == []


def test_feedback_pass_moves_and_takes_back(spark):
    at = F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    noon = dt.datetime(2024, 1, 2, 12)
    state = spark.createDataFrame(
        [("live", 1500.0, 10.0, 2.0, 4.0, 0.0, 1506.0), ("soon", 1500.0, 10.0, 0.0, None, 0.0, 1510.0), ("far", 1500.0, 0.0, 0.0, None, 1.0, 1501.0), ("off", 1500.0, 0.0, 0.0, None, 3.0, 1503.0), ("same", 1500.0, 0.0, 0.0, None, 9.0, 1500.005)],
        "team_id string, b_value double, m1_value double, l_value double, m1_locked double, f_value double, published_index double",
    )
    fixtures = spark.createDataFrame(
        [(1, noon.date(), noon - dt.timedelta(hours=1), "live", "x", "live"), (2, noon.date(), noon + dt.timedelta(hours=2), "soon", "y", "upcoming"), (3, noon.date(), noon + dt.timedelta(hours=9), "far", "z", "upcoming"), (4, noon.date(), None, "off", "z", "upcoming")],
        "fixture_id long, date date, commence_time timestamp_ntz, home_team string, away_team string, status string",
    )
    twap = spark.createDataFrame([("live", 1546.0), ("soon", 1910.0), ("far", 1540.0), ("off", None)], "team_id string, twap_index double")
    out = {r.team_id: (r.regime, r.f_value, r.published_index) for r in lv.feedback_pass(state, twap, fixtures, ql.live_teams(fixtures, at), at).collect()}
    assert out == {"live": ("live", 6.0, 1512.0), "soon": ("prematch", 20.0, 1530.0), "far": ("between", 2.0, 1502.0), "off": ("offseason", 0.0, 1500.0), "same": ("offseason", 9.0, 1500.005)}


def test_settle_v3_works_its_rows_out_once(spark):
    """Sampling ranges read the rows a second time, with all that lies behind them."""
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.range(400).selectExpr(
        "id as fixture_id", "date_add(date'2024-01-01', cast(id div 4 as int)) as date", "concat('t', id % 3) as team_id", "0.1 as surprise", "1600.0 as target", "0.08 as gamma",
        "1.0 as actual_score_s", "0.9 as e_kr",
    ).selectExpr("fixture_id", "date", "team_id", "cast(surprise as double) surprise", "cast(target as double) target", "cast(gamma as double) gamma", "cast(actual_score_s as double) actual_score_s", "cast(e_kr as double) e_kr")
    done = st.settle_v3(rows.repartition(4).mapInPandas(told, rows.schema))
    assert done.count() == 400 and seen.value == 400
