"""Keyed tables: latest rows, upserts, write-once appends and partial updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick_by(df: DataFrame, keys: list[str], order: list, first: bool = False, columns: list[str] | None = None) -> DataFrame:
    """One whole row per key: the last (or first) under a total order.

    The partial aggregate runs before the exchange, so a hot key ships one row per task.
    """
    rest = [x for x in (columns or df.columns) if x not in keys]
    chooser = F.min_by if first else F.max_by
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{x}").alias(x) for x in rest])


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Latest quote per (fixture, book); ties fall to the larger odds, in home, draw, away order."""
    return pick_by(
        quotes, ["fixture_id", "bookmaker"], ["snapshot_time", "home_odds", "draw_odds", "away_odds"]
    )


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union where the new row wins over the old, and the later over the earlier new row."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return pick_by(both, keys, ["_new", *order]).drop("_new")


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table lacks; append them. Keys must be unique within ``rows``."""
    return rows.join(table.select(*keys).distinct(), keys, "left_anti")


def patch(state: DataFrame, delta: DataFrame, keys: list[str], guarded: dict[str, Column] | None = None) -> DataFrame:
    """Overwrite only the delta's columns of matching rows; a guard keeps a column's old value where true."""
    cols = [x for x in delta.columns if x not in keys]
    renamed = delta.select(*keys, *[F.col(x).alias(f"_d_{x}") for x in cols], F.lit(True).alias("_hit"))
    joined = state.join(renamed, keys, "left")
    out = {}
    for x in cols:
        hit = F.coalesce(F.col("_hit"), F.lit(False))
        if guarded and x in guarded:
            hit = hit & ~F.coalesce(guarded[x], F.lit(False))
        out[x] = F.when(hit, F.col(f"_d_{x}")).otherwise(F.col(x)) if x in state.columns else F.col(f"_d_{x}")
    return joined.withColumns(out).drop("_hit", *[f"_d_{x}" for x in cols])


def first_present(df: DataFrame, names: list[str]) -> Column:
    return F.coalesce(*[F.col(n) for n in names])


def match(preds: list[tuple]) -> Column:
    """Conjunction of (column, operator, value) filters, all of which reach the scan."""
    ops = {
        "eq": lambda x, v: x == v,
        "neq": lambda x, v: x != v,
        "gt": lambda x, v: x > v,
        "gte": lambda x, v: x >= v,
        "lt": lambda x, v: x < v,
        "lte": lambda x, v: x <= v,
        "in": lambda x, v: x.isin(*v),
        "not_in": lambda x, v: ~x.isin(*v),
        "is_null": lambda x, v: x.isNull() if v else x.isNotNull(),
        "ilike": lambda x, v: x.ilike(v),
        "any": lambda x, v: reduce(lambda a, b: a | b, [match([p]) for p in v]),
    }
    return reduce(lambda a, b: a & b, [ops[op](F.col(name) if name else None, value) for name, op, value in preds])


def scan(df: DataFrame, columns: list[str], preds: list[tuple] = (), order: list = (), limit: int | None = None) -> DataFrame:
    """Filtered, projected and optionally ordered and cut table scan."""
    out = df.where(match(list(preds))) if preds else df
    out = out.select(*columns)
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; Spark broadcasts the list only where its measured size allows."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
