"""Report and table exports as CSV folders; Spark writes the parts in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.operators.tables import pick_by


#: Times in full: Spark's own CSV format ends at milliseconds.
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, folder: str) -> None:
    options = {"header": True, "quote": '"', "escape": '"', "timestampFormat": f"{TIME}XXX", "timestampNTZFormat": TIME}
    df.write.mode("errorifexists").options(**options).csv(folder)


def settlement_rows(log: DataFrame) -> DataFrame:
    """Settlement log with two fields of its JSON trace lifted out."""
    trace = F.col("trace_payload")
    return log.select(
        "fixture_id", "team_id", "oracle_version", "e_kr", "actual_score_s", "delta_b", "b_before", "b_after",
        F.get_json_object(trace, "$.score").alias("score"), F.get_json_object(trace, "$.bookmaker_count").cast("int").alias("bookmaker_count"),
    )


def match_rows(fixtures: DataFrame, kr: DataFrame) -> DataFrame:
    return fixtures.join(kr.select("fixture_id", "bookmaker_count", "method"), "fixture_id", "left").orderBy("date", "fixture_id")


def frozen_rows(kr: DataFrame) -> DataFrame:
    """Frozen consensus without its nested quotes, which have no place in a CSV."""
    return kr.select(*[c for c, kind in kr.dtypes if not kind.startswith(("array", "struct", "map"))])


def latest_outrights(outrights: DataFrame, newest: int | None = None) -> DataFrame:
    """Latest price per (league, team, book), of the newest rows only where a number is given."""
    rows = outrights if newest is None else outrights.orderBy(F.desc("snapshot_time"), "league", "team", "bookmaker").limit(newest)
    return pick_by(rows, ["league", "team", "bookmaker"], ["snapshot_time", "outright_odds"])


def trailing(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return rows.where((F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= as_of))
