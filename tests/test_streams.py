"""Streams over several files and several runs give what one batch gives."""

import datetime as dt
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratewright.operators import consensus as k
from ratewright.operators.tables import latest_quotes
from ratewright.plans.stream_queries import LANDED_UNTIL, landed_until
from ratewright.streaming import jobs
from ratewright.streaming.machines import KickoffFreeze, KickoffLocks

T0 = dt.datetime(2024, 1, 1)
QUOTES = "fixture_id long, bookmaker string, snapshot_time timestamp_ntz, home_odds double, draw_odds double, away_odds double"
FIXTURES = "fixture_id long, date date, commence_time timestamp_ntz, home_team string, away_team string, status string"


@pytest.fixture
def landed(spark, tmp_path):
    """Four files of quotes, of which two arrive late."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        h, d, a = (rng.uniform(1.5, 6) for _ in range(3))
        rows.append((i % 12, f"book{i % 5}", T0 + dt.timedelta(minutes=rng.randrange(0, 3000), seconds=i), h, d, a))
    quotes = spark.createDataFrame(rows, QUOTES)
    starts = [(i, T0.date(), T0 + dt.timedelta(hours=4 * i), f"h{i}", f"a{i}", "upcoming") for i in range(12)]
    fixtures = spark.createDataFrame(starts, FIXTURES)
    folder = tmp_path / "quotes"

    def land(part):
        quotes.where(F.pmod(F.xxhash64("snapshot_time"), F.lit(2)) == part).repartition(2).write.mode("append").parquet(str(folder))

    def stream():
        return spark.readStream.schema(QUOTES).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return quotes, fixtures, land, stream


def rows(df, *columns):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


def test_ingest_goes_on_where_it_ended(spark, landed, tmp_path):
    quotes, fixtures, land, stream = landed
    root = str(tmp_path / "run")
    land(0)
    first = jobs.ingest_quotes(stream(), fixtures, root=root)
    n = first["archive"].count()
    again = jobs.ingest_quotes(stream(), fixtures, root=root)
    assert again["archive"].count() == n and rows(again["latest"]) == rows(first["latest"])
    land(1)
    out = jobs.ingest_quotes(stream(), fixtures, root=root)
    assert rows(out["archive"]) == rows(quotes)
    assert rows(out["latest"]) == rows(latest_quotes(quotes).select(*out["latest"].columns))
    assert rows(out["preko"]) == rows(latest_quotes(k.pre_kickoff(quotes, fixtures).select(*quotes.columns)).select(*out["preko"].columns))


def test_frozen_once_over_all_runs(spark, landed, tmp_path):
    _, fixtures, land, stream = landed
    root = str(tmp_path / "run")
    as_of = F.to_timestamp_ntz(F.lit("2024-01-03 00:00:00"))
    land(0)
    first = rows(jobs.freeze_stream(stream(), fixtures, as_of, 48.0, root=root))
    land(1)
    second = rows(jobs.freeze_stream(stream(), fixtures, as_of, 48.0, root=root))
    assert first and set(first) <= set(second)
    ids = [r.fixture_id for r in jobs.freeze_stream(stream(), fixtures, as_of, 48.0, root=root).collect()]
    assert len(ids) == len(set(ids)) == len(second)


def test_locks_know_earlier_runs(spark, tmp_path):
    kinds = ["live_update", "live_update", "settlement", "live_update", "market_refresh", "settlement"]
    events = [(f"t{i % 3}", T0 + dt.timedelta(minutes=i), i, kinds[i // 3 % 6], float(i)) for i in range(36)]
    schema = "team string, ts timestamp, event_id long, publish_reason string, published_index double"
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(one)
    whole = rows(jobs.kickoff_locks(spark.readStream.schema(schema).parquet(one)))
    root = str(tmp_path / "run")
    for part in (events[:17], events[17:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(two)
        out = jobs.kickoff_locks(spark.readStream.schema(schema).parquet(two), root=root)
    assert rows(out) == whole and len(whole) > 6


def test_open_windows_are_emitted(spark, tmp_path):
    schema = "team string, ts timestamp, event_id long, published_index double"
    events = [("t", T0 + dt.timedelta(minutes=i), i, float(i)) for i in range(40)]
    folder = str(tmp_path / "events")
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = jobs.to_latest(jobs.downsample_stream(stream, 15), "down", ["team", "window_start"], ["ts", "event_id"])
    assert sorted(r.event_id for r in out.collect()) == [14, 29, 39]


def in_order(spark, folder, frame, parts, order):
    """Land a frame's rows by time, in as many parts, one after the other."""
    data = sorted(frame.collect(), key=lambda r: r[order])
    size = -(-len(data) // parts)
    for i in range(parts):
        spark.createDataFrame(data[i * size : (i + 1) * size], frame.schema).coalesce(1).write.mode("append").parquet(folder)
        yield spark.readStream.schema(frame.schema).parquet(folder)


@pytest.mark.parametrize("parts", [1, 4])
def test_freezing_at_kickoff_is_the_batch_consensus(spark, landed, tmp_path, parts):
    quotes, fixtures, _, _ = landed
    root, folder = str(tmp_path / "run"), str(tmp_path / "ordered")
    as_of = F.to_timestamp_ntz(F.lit("2024-01-03 00:00:00"))
    for stream in in_order(spark, folder, quotes, parts, "snapshot_time"):
        out = jobs.freeze_stream(stream, fixtures, as_of, 48.0, root=root)
    # Two more runs: one with a quote that comes too late, one with nothing new.
    late = quotes.where("fixture_id = 3").limit(1).withColumn("home_odds", F.lit(9.0)).withColumn("snapshot_time", F.lit(str(T0)).cast("timestamp_ntz"))
    late.coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):
        out = jobs.freeze_stream(spark.readStream.schema(QUOTES).parquet(folder), fixtures, as_of, 48.0, root=root)
    want = k.frozen_consensus(quotes, fixtures, 48.0).select(*out.columns)
    assert rows(out) == rows(want) and out.count() == 11


def test_fixtures_that_start_together_share_a_timer():
    calls = []

    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    held = Held()
    handle = SimpleNamespace(getValueState=lambda *_: held, registerTimer=calls.append)
    machine = KickoffFreeze()
    machine.init(handle)
    chunks = [pd.DataFrame({"kickoff_us": 9_000_000, "fixture_id": range(500), "bookmaker": "b", "snapshot_us": us, "home_odds": 2.0 + us, "draw_odds": 3.0, "away_odds": 4.0}) for us in (3, 5, 4)]
    assert list(machine.handleInputRows((9_000_000,), iter(chunks), None)) == [] and calls == [9000]
    assert list(machine.handleInputRows((9_000_000,), iter(chunks[:1]), None)) == [] and calls == [9000]
    (out,) = machine.handleExpiredTimer((9_000_000,), None, None)
    assert sorted(out["fixture_id"]) == list(range(500)) and set(out["home_odds"]) == {7.0}
    assert list(machine.handleInputRows((9_000_000,), iter(chunks), None)) == [] and held.value[0] and not held.value[1]


def test_a_teams_rows_are_walked_in_slabs(monkeypatch):
    monkeypatch.setattr(KickoffLocks, "SLAB", 10)
    held = SimpleNamespace(get=lambda: None, update=lambda value: None)
    machine = KickoffLocks()
    machine.init(SimpleNamespace(getValueState=lambda *_: held, registerTimer=lambda _: None))
    n = 40
    rows = pd.DataFrame({"us": range(n), "seq": range(n), "kind": ["kickoff", "settlement"] * (n // 2), "r_market": 1500.0, "m1_value": np.nan, "kickoff_us": np.nan})
    rows.loc[n - 1, "seq"] = None
    out = list(machine.handleInputRows(("t",), iter([rows[1::2], rows[::2]]), None))
    assert [len(x) for x in out] == [10] * 4 and pd.concat(out)["seq"].tolist()[:-1] == list(range(n - 1)) and pd.isna(out[-1]["seq"].iloc[-1])
    assert set(pd.concat(out)["event"]) == {"frozen", "cleared"}


def test_parts_of_the_feed_are_bounded():
    days = [(T0.date() + dt.timedelta(days=i), 10) for i in range(40)]
    ends = [x for x in landed_until(days, rows=300) if x.startswith("2024")]
    assert ends == [str(days[i][0]) for i in range(5, 40, 5)] and landed_until(days) == LANDED_UNTIL


def locks_by_hand(feed, last_time):
    """Events of one team: sorted rows, starts first among equal times."""
    starts = [(r.kickoff, -1, "start", None, None) for r in feed if r.kind == "fixture"]
    merged = sorted(starts + [(r.ts, r.seq, r.kind, r.r_market, r.m1_value) for r in feed], key=lambda e: (e[0], e[1]))
    newest = max(r.ts for r in feed)
    held, market, out = None, (None, None), []
    for ts, seq, kind, r_market, m1 in merged:
        if kind == "market" or (kind == "kickoff" and r_market is not None):
            market = (r_market, m1 if m1 is not None else market[1])
        if kind in ("start", "kickoff") and held is None and (kind == "kickoff" or ts <= max(last_time - dt.timedelta(minutes=3), newest)):
            held = market
            out.append((ts, seq, "frozen", *held))
        elif kind == "settlement" and held is not None:
            out.append((ts, seq, "cleared", *held))
            held = None
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_locks_at_kickoff_timers(spark, tmp_path, parts):
    rng = random.Random(9)
    feed = []
    for i in range(240):
        team, ts = rng.choice("ab") if i % 3 else "hot", T0 + dt.timedelta(hours=i, minutes=rng.randrange(60))
        kind = rng.choice(["market", "fixture", "settlement", "kickoff", "market"])
        market = rng.uniform(1400, 1600) if kind == "market" or (kind == "kickoff" and rng.random() < 0.5) else None
        feed.append((team, ts, i, kind, market, rng.uniform(-9, 9) if kind == "market" else None, ts + dt.timedelta(hours=rng.randrange(1, 60)) if kind == "fixture" else None))
    frame = spark.createDataFrame(feed, "team string, ts timestamp_ntz, seq long, kind string, r_market double, m1_value double, kickoff timestamp_ntz")
    root, folder = str(tmp_path / "run"), str(tmp_path / "feed")
    for stream in in_order(spark, folder, frame, parts, "ts"):
        out = jobs.lock_stream(stream, root=root)
    got, data = {}, frame.collect()
    for r in out.collect():
        got.setdefault(r.team, []).append((r.ts, r.seq, r.event, r.r_market_frozen, r.m1_locked))
    want = {t: locks_by_hand([r for r in data if r.team == t], max(r.ts for r in data)) for t in ("a", "b", "hot")}
    assert {t: sorted(v, key=lambda e: e[:3]) for t, v in got.items()} == {t: sorted(v, key=lambda e: e[:3]) for t, v in want.items()}
    state = spark.createDataFrame([(t, None, 7.0, 3.0) for t in ("a", "b", "hot", "idle")], "team_id string, m1_locked double, r_market_frozen double, l_value double")
    after = {r.team_id: r for r in jobs.locked_state(state, out).collect()}
    assert (after["idle"].r_market_frozen, after["idle"].l_value) == (7.0, 3.0)
    for t, events in want.items():
        frozen = events[-1][2] == "frozen"
        assert after[t].r_market_frozen == (events[-1][3] if frozen else None) and after[t].m1_locked == (events[-1][4] if frozen else None)
