"""Watch-dog checks over the tables, as of a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import calendar as t
from ratewright.operators.settle import team_rows


def stuck_matches(fixtures: DataFrame, as_of: Column, hours: float = 3.0) -> DataFrame:
    """Still upcoming though they started more than the given hours ago."""
    return fixtures.where((F.col("status") == "upcoming") & (t.hours_between("commence_time", as_of) > hours))


def expire_upcoming(fixtures: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    old = (F.col("status") == "upcoming") & (F.col("date") < F.date_sub(as_of.cast("date"), days))
    return fixtures.withColumn("status", F.when(old, "cancelled").otherwise(F.col("status")))


def never_settled(fixtures: DataFrame, log: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    done = fixtures.where(F.col("status") == "finished")
    if first is not None:
        done = done.where(F.col("date") >= first)
    if last is not None:
        done = done.where(F.col("date") <= last)
    return done.join(log.select("fixture_id").distinct(), "fixture_id", "left_anti")


def alert(rows: DataFrame, name: str, critical_over: int | None = None) -> DataFrame:
    """One row (check, count, severity) if there are any rows."""
    severity = F.when(F.col("n") > critical_over, "critical").otherwise("warning") if critical_over is not None else F.lit("warning")
    return rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0).select(F.lit(name).alias("check"), "n", severity.alias("severity"))


def overall(alerts: DataFrame) -> DataFrame:
    """ok, degraded or critical."""
    level = F.max(F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return alerts.agg(F.coalesce(level, F.lit(0)).alias("_l")).select(
        F.when(F.col("_l") == 2, "critical").when(F.col("_l") == 1, "degraded").otherwise("ok").alias("health_status")
    )


def live_teams(fixtures: DataFrame, as_of: Column, hours: float = c.LIVE_HOURS) -> DataFrame:
    """Teams whose match started within the last hours and is not over."""
    age = t.hours_between("commence_time", as_of)
    on = fixtures.where((age > 0) & (age < hours) & ~F.col("status").isin("finished", "cancelled"))
    return team_rows(on.select("fixture_id", "home_team", "away_team")).select("team_id", "fixture_id", "is_home")
