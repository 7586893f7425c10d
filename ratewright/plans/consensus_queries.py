"""Quotes, consensus and expected scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.operators import consensus as k
from ratewright.operators import tables as tb
from ratewright.plans.registry import query, rnd, sql
from ratewright.plans.shapes import KR_HOURS, fixtures, quotes


def r(col, n=6):
    return F.round(col, n)


def frozen(spark, d):
    """Frozen consensus of the shaped tables (window in days rather than hours, as the data is spread)."""
    return k.frozen_consensus(quotes(spark, d), fixtures(spark, d), KR_HOURS)


@query(
    "latest_prekickoff_quotes",
    sql(
        """SELECT fixture_id, bookmaker, snapshot_time, round(home_odds, 6) AS home_odds, round(draw_odds, 6) AS draw_odds,
                  round(away_odds, 6) AS away_odds FROM preko""",
        "preko",
    ),
)
def latest_prekickoff_quotes(spark, d):
    pre = k.pre_kickoff(quotes(spark, d), fixtures(spark, d)).where(x.valid_quote(*k.ODDS))
    return tb.latest_quotes(pre).select("fixture_id", "bookmaker", "snapshot_time", *[r(o).alias(o) for o in k.ODDS])


@query(
    "consensus_power",
    sql(
        f"""SELECT fixture_id, CAST(bookmaker_count AS INTEGER) AS bookmaker_count, {rnd('home_prob', 6)} AS home_prob,
                   {rnd('draw_prob', 6)} AS draw_prob, {rnd('away_prob', 6)} AS away_prob, home_expected_score,
                   away_expected_score, home_expected_score_raw, away_expected_score_raw, kr_degraded, bookmakers_used
            FROM kr""",
        "kr",
    ),
)
def consensus_power(spark, d):
    return frozen(spark, d).select(
        "fixture_id",
        "bookmaker_count",
        "home_prob",
        "draw_prob",
        "away_prob",
        "home_expected_score",
        "away_expected_score",
        "home_expected_score_raw",
        "away_expected_score_raw",
        "kr_degraded",
        F.array_join("bookmakers_used", ",").alias("bookmakers_used"),
    )
