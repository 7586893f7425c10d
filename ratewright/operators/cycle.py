"""One whole cycle: settle, solve the leagues that settled, publish teams under way, refresh the rest; its tables are committed together."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.operators import bradley_terry as bt
from ratewright.operators import consensus as k
from ratewright.operators import live as lv
from ratewright.operators import market as mk
from ratewright.operators import quality as ql
from ratewright.operators import settle as st
from ratewright.operators.settlement import settle_state
from ratewright.operators.tables import latest_quotes, patch
from ratewright.session import durable

REFRESH, LIVE = "market_refresh_v3", "live_update_v3"

#: A team's stored row; a cycle keeps further columns as they are.
STATE = (
    "team_id string, league string, b_value double, m1_value double, l_value double, r_network double, r_next double, r_market double, published_index double, confidence_score double, "
    "bt_std_error double, next_fixture_id long, m1_locked double, r_market_frozen double, last_kr_fixture_id long, last_settlement_ts timestamp_ntz, last_bt_solve_ts timestamp_ntz, "
    "last_market_refresh_ts timestamp_ntz, updated_at timestamp_ntz"
)


class Cycle(NamedTuple):
    """``state``: all teams. ``history``, ``log``, ``solves``, ``edges``: the cycle's new rows. ``recent``: log rows later cycles have to know."""

    state: DataFrame
    history: DataFrame
    log: DataFrame
    solves: DataFrame
    edges: DataFrame
    recent: DataFrame


def fresh_state(teams: DataFrame) -> DataFrame:
    """State rows of (team_id, league, b_value) that no market has been laid over yet."""
    given = {"m1_value": F.lit(0.0), "l_value": F.lit(0.0), "published_index": F.col("b_value")}
    columns = [x.split() for x in STATE.split(", ")]
    return teams.select([given.get(n, F.col(n) if n in teams.columns else F.lit(None)).cast(kind).alias(n) for n, kind in columns])


def as_known(fixtures: DataFrame, as_of: Column) -> DataFrame:
    """The fixtures as they stood at a day's time: results of that day and later are not in yet."""
    early = F.col("date") < as_of.cast("date")
    return fixtures.withColumns(
        {"status": F.when((F.col("status") == "finished") & ~early, "upcoming").otherwise(F.col("status")), "score": F.when(early, F.col("score")).otherwise("N/A")}
    )


def expected_at(quotes: DataFrame, fixtures: DataFrame, as_of: Column) -> DataFrame:
    """Current expected scores of the fixtures a cycle may ask for, from quotes that are in by then."""
    today = as_of.cast("date")
    near = F.col("date") >= F.date_sub(today, c.WINDOW_EXPANDED_DAYS)
    early = k.pre_kickoff(quotes.where(F.col("snapshot_time") <= as_of), fixtures.where(near)).where(F.least(*k.ODDS) >= 1.01)
    return k.current_expected(latest_quotes(early))


def _overlaid(ratings: DataFrame, fixtures: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """Overlay columns of teams (team_id, league, b_value, r_network and maybe bt_std_error), four places as stored."""
    nxt = mk.next_strength(mk.next_fixtures(fixtures, as_of, "league"), current, ratings)
    rows = mk.overlay_rows(ratings, nxt)
    numbers = [n for n in ("r_network", "r_next", "r_market", "m1_value", "published_index", "confidence_score", "bt_std_error") if n in rows.columns]
    return rows.withColumns({n: F.round(n, 4) for n in numbers})


def _history(rows: DataFrame, reason: str, as_of: Column, source: Column, competition: Column | None = None, confidence: bool = False) -> DataFrame:
    return rows.select(
        F.col("team_id").alias("team"), "league", as_of.alias("timestamp"), F.round("b_value", 4).alias("b_value"), "m1_value", "l_value", "published_index",
        (F.col("confidence_score") if confidence else F.lit(None)).cast("double").alias("confidence_score"), source.cast("long").alias("source_fixture_id"),
        F.lit(reason).alias("publish_reason"), (F.lit("league") if competition is None else competition).alias("competition"),
    )


def run_cycle(state: DataFrame, recent: DataFrame, fixtures: DataFrame, kr: DataFrame, quotes: DataFrame, as_of: Column, since: Column | None = None, fresh_minutes: float = c.FRESH_MINUTES) -> Cycle:
    """Settle what is finished and not settled yet, by fixture id; then solve, publish and refresh, in the order of the four steps.

    ``recent``: log rows of earlier cycles (fixture_id, team_id, oracle_version, date), from ``since`` on if that is given:
    older fixtures are left alone. Only leagues with a settlement are solved, from the B just reached; a league with two
    fixtures or fewer in its window loses its overlay. Teams under way are locked once and published from the live layer;
    locked teams keep their index through solves and refreshes. All other leagues keep their network rating and take the
    next fixture's quotes anew.
    """
    done = settle_state(state, recent, st.unsettled(fixtures, recent, "v3", since), kr, as_of)
    settled, log = durable(done.state), durable(done.log)
    history = [done.history]
    current = durable(expected_at(quotes, fixtures, as_of))

    triggers = log.join(fixtures.select("fixture_id", "league", "date"), "fixture_id").where("competition = 'league'").groupBy("league").agg(F.max("fixture_id").alias("trigger"))
    triggers = durable(triggers)
    edges = durable(bt.solve_edges(fixtures.join(triggers.select("league"), "league", "left_semi"), kr, current, as_of))
    solves = durable(bt.map_ratings(edges, settled.select("team_id", "b_value")))
    ratings = solves.select(F.col("team").alias("team_id"), "league", F.round("rating", 4).alias("r_network"), F.round("std_error", 4).alias("bt_std_error"))
    # As stored: a team that is rated in a league but has no state is not written.
    overlay = durable(_overlaid(ratings.join(settled.select("team_id", "b_value"), "team_id"), fixtures, current, as_of))
    few = triggers.join(solves.select("league").distinct(), "league", "left_anti")
    stamped = {"last_bt_solve_ts": as_of, "last_market_refresh_ts": as_of, "updated_at": as_of}
    after_solve = durable(mk.refresh_state(mk.zero_market(settled, few), overlay.withColumns(stamped)))
    solved_rows = overlay.withColumn("l_value", F.lit(0.0)).join(triggers, "league")
    history.append(_history(solved_rows, REFRESH, as_of, F.col("trigger"), confidence=True))

    under_way = ql.live_teams(fixtures, as_of)
    locked = lv.kickoff_freeze(after_solve, under_way)
    on_now = fixtures.join(under_way.select("fixture_id"), "fixture_id", "left_semi")
    layer = lv.live_layer(on_now, quotes, kr, as_of, fresh_minutes)
    live = lv.publish_live(locked, layer).withColumns({n: F.round(n, 4) for n in ("l_value", "published_index")})
    published = durable(patch(locked, live.withColumn("updated_at", as_of), ["team_id"]))
    source = under_way.groupBy("team_id").agg(F.max("fixture_id").alias("_source"))
    live_rows = published.join(live.select("team_id"), "team_id", "left_semi").join(source, "team_id")
    competition = F.when(F.col("league") == c.CUP_LEAGUE, "cup").otherwise("league")
    history.append(_history(live_rows.withColumn("m1_value", F.col("m1_locked")), LIVE, as_of, F.col("_source"), competition))

    idle = published.join(triggers.select("league"), "league", "left_anti")
    network = idle.select("team_id", "league", "b_value", F.coalesce("r_network", "b_value").alias("r_network"))
    fresh = _overlaid(network, fixtures, current, as_of).drop("r_network")
    free = idle.where("m1_locked is null and r_market_frozen is null").select("team_id")
    fresh = durable(fresh.join(free, "team_id", "left_semi"))
    final = mk.refresh_state(published, fresh.withColumns({"last_market_refresh_ts": as_of, "updated_at": as_of}))
    history.append(_history(fresh.withColumn("l_value", F.lit(0.0)), REFRESH, as_of, F.lit(None)))

    rows = history[0]
    for more in history[1:]:
        rows = rows.unionByName(more)
    dated = log.join(fixtures.select("fixture_id", "date"), "fixture_id").select("fixture_id", "team_id", "oracle_version", "date")
    known = recent.select("fixture_id", "team_id", "oracle_version", "date").unionByName(dated)
    timed = {"solve_timestamp": as_of, "trigger_type": F.lit("settlement")}
    solves = solves.join(triggers.withColumnRenamed("trigger", "trigger_fixture_id"), "league").withColumns(timed)
    used = edges.join(solves.select("league").distinct(), "league", "left_semi").withColumn("solve_timestamp", as_of)
    return Cycle(final, rows, log, solves, used, known if since is None else known.where(F.col("date") >= since))


# --- cycles that go on from each other ----------------------------------------


def commit(root: str, number: int, cycle: Cycle, as_of: Column) -> None:
    """Write a cycle's tables under its number, and then the mark that says they are whole.

    A cycle that is repeated after a failure replaces its own folders; without the mark nothing reads them.
    """
    for name, rows in cycle._asdict().items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
    cycle.state.sparkSession.range(1).select(as_of.alias("as_of")).write.mode("overwrite").parquet(f"{root}/commits/batch={number}")


def committed(spark: SparkSession, root: str, number: int, name: str) -> DataFrame:
    """A table of one committed cycle; fails if that cycle was not committed."""
    spark.read.parquet(f"{root}/commits/batch={number}")
    return spark.read.parquet(f"{root}/{name}/batch={number}")
