"""Settlement as a change of stored tables: state, log, history, and what was skipped and why."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import numeric as x
from ratewright.functions import text as tx
from ratewright.operators import settle as st
from ratewright.operators.tables import patch, pick_by
from ratewright.session import durable

REASON = "settlement_v3"


class Settled(NamedTuple):
    """``state``: all teams after the settlements. ``log``, ``history``: new rows only. ``skipped``: fixtures left, and why."""

    state: DataFrame
    log: DataFrame
    history: DataFrame
    skipped: DataFrame


def with_reasons(fixtures: DataFrame, kr: DataFrame, state: DataFrame, log: DataFrame, version: str) -> DataFrame:
    """Fixtures with goals, frozen scores, which sides can be settled (home_open, away_open), and the skip reason, null if any can.

    A side is open if it has a stored state and no log row of this version. League fixtures need both states, cup fixtures one.
    """
    home, away = tx.goals("score")
    frozen = kr.select("fixture_id", "home_expected_score", "away_expected_score", "bookmaker_count")
    logged = log.where(F.col("oracle_version") == version).groupBy("fixture_id").agg(F.collect_set("team_id").alias("_logged"))
    known = state.select("team_id").distinct()
    rows = fixtures.withColumns({"home_goals": home, "away_goals": away})
    rows = rows.join(frozen, "fixture_id", "left").join(logged, "fixture_id", "left")
    for side in ("home", "away"):
        has = known.select(F.col("team_id").alias(f"{side}_team"), F.lit(True).alias(f"_{side}_state"))
        rows = rows.join(has, f"{side}_team", "left").withColumn(f"_{side}_state", F.coalesce(f"_{side}_state", F.lit(False)))
        done = F.coalesce(F.array_contains("_logged", F.col(f"{side}_team")), F.lit(False))
        rows = rows.withColumns({f"_{side}_done": done, f"{side}_open": F.col(f"_{side}_state") & ~done})
    both = F.col("_home_state") & F.col("_away_state")
    sane = x.sane_expected("home_expected_score") & x.sane_expected("away_expected_score")
    nobody = ~F.col("_home_state") & ~F.col("_away_state")
    reason = (
        F.when(F.col("status") != "finished", "not_finished")
        .when(F.col("home_goals").isNull() | F.col("away_goals").isNull(), "unparseable_score")
        .when(F.col("_home_done") & F.col("_away_done"), "already_settled")
        .when(F.col("home_expected_score").isNull(), "no_frozen_kr")
        .when(~sane, "ekr_out_of_bounds")
        .when(nobody | ((F.col("competition") != "cup") & ~both), "missing_v3_state")
        .when(~F.col("home_open") & ~F.col("away_open"), "already_settled")
    )
    return rows.withColumn("skipped_reason", reason).drop("_logged", "_home_state", "_away_state", "_home_done", "_away_done")


def open_sides(reasoned: DataFrame, state: DataFrame, order: list[str]) -> DataFrame:
    """A row per side to settle, with S, E, B before the first of the team's rows, and what gravity pulls to.

    The first settlement of a team looks at the market rating frozen at kickoff, and clears it; later ones, or the first
    if none was frozen, look at the stored market rating; without one there is no pull. Cup fixtures never pull.
    """
    rows = st.team_rows(
        reasoned.where(F.col("skipped_reason").isNull()),
        {
            "own_goals": ("home_goals", "away_goals"), "other_goals": ("away_goals", "home_goals"),
            "e_kr": ("home_expected_score", "away_expected_score"), "_open": ("home_open", "away_open"),
        },
    ).where("_open")
    rows = rows.drop("_open").withColumn("actual_score_s", tx.result_score("own_goals", "other_goals"))
    # Fixtures come from joins and de-vigged quotes; written once, not worked out again for each use below.
    rows = durable(rows)
    first = rows.groupBy("team_id").agg(F.min(F.struct(*order)).alias("_first"))
    held = state.select("team_id", F.col("b_value").cast("double").alias("_b0"), F.coalesce("m1_value", F.lit(0.0)).alias("m1_value"), "r_market", "r_market_frozen")
    joined = rows.join(held.join(first, "team_id"), "team_id")
    pull = F.when(F.struct(*order) == F.col("_first"), F.coalesce("r_market_frozen", "r_market")).otherwise(F.col("r_market"))
    joined = joined.withColumns({"surprise": F.col("actual_score_s") - F.col("e_kr"), "target": pull})
    gamma = F.when((F.col("competition") == "cup") | F.col("target").isNull(), c.GRAVITY_CUP).otherwise(c.GRAVITY_V3)
    return joined.withColumn("gamma", gamma).withColumn("target", F.coalesce("target", F.lit(0.0))).drop("_first", "r_market", "r_market_frozen")


def settle_state(state: DataFrame, log: DataFrame, fixtures: DataFrame, kr: DataFrame, as_of: Column, order=("fixture_id",), version: str = "v3") -> Settled:
    """Settle fixtures into the stored state; given the log it returns, a second call settles nothing.

    ``state``: team_id, b_value, m1_value, l_value, r_market, r_market_frozen, m1_locked, published_index and any other
    columns, which stay. ``log``: fixture_id, team_id, oracle_version. ``order`` must be total over a team's fixtures; the
    live cycle goes by fixture_id, a replay by date. A team's next settlement starts from what its last one reached. M1 is
    carried, L and the locks of the kickoff are cleared. A fixture that is settled for one side alone completes the other.
    """
    order = list(order)
    reasoned = with_reasons(fixtures, kr, state, log, version)
    rows = durable(st.settle_v3(open_sides(reasoned, state, order), order=order, start="_b0"))
    published = F.round(F.col("b_after") + F.col("m1_value"), 4)
    new_log = rows.select(
        "fixture_id", "team_id", F.round("e_kr", 6).alias("e_kr"), "actual_score_s", F.round("delta_b", 6).alias("delta_b"), F.round("b_before", 6).alias("b_before"),
        F.round("b_after", 6).alias("b_after"), F.lit(version).alias("oracle_version"), (F.round("gravity_component", 6) + 0.0).alias("gravity_component"),
        "competition", "is_home", "score", "bookmaker_count", "clamp_applied",
    )
    history = rows.select(
        F.col("team_id").alias("team"), "league", as_of.alias("timestamp"), F.round("b_after", 4).alias("b_value"), F.round("m1_value", 4).alias("m1_value"),
        F.lit(0.0).alias("l_value"), published.alias("published_index"), F.lit(None).cast("double").alias("confidence_score"),
        F.col("fixture_id").alias("source_fixture_id"), F.lit(REASON).alias("publish_reason"), "competition",
    )
    none = F.lit(None).cast("double")
    last = pick_by(rows, ["team_id"], order, columns=["team_id", "fixture_id", "b_after", "m1_value", *[n for n in order if n != "fixture_id"]])
    delta = last.select(
        "team_id", F.round("b_after", 4).alias("b_value"), F.round("m1_value", 4).alias("m1_value"), F.lit(0.0).alias("l_value"), none.alias("m1_locked"),
        none.alias("r_market_frozen"), published.alias("published_index"), F.col("fixture_id").alias("last_kr_fixture_id"), as_of.alias("last_settlement_ts"), as_of.alias("updated_at"),
    )
    kept = {n: F.lit(None).cast(kind) for n, kind in (("last_kr_fixture_id", "long"), ("last_settlement_ts", "timestamp_ntz"), ("updated_at", "timestamp_ntz")) if n not in state.columns}
    skipped = reasoned.where(F.col("skipped_reason").isNotNull()).select("fixture_id", "league", "home_team", "away_team", "skipped_reason")
    return Settled(patch(state.withColumns(kept), delta, ["team_id"]), new_log, history, skipped)
