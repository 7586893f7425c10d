"""Running sums, lags, carries and row numbers over keys of any size.

A window partitioned by a key puts all of that key's rows into one task. Here
rows are range-partitioned by (key, order), so a hot key spreads over many
blocks; each block is scanned alone, one summary row per (key, block) is
scanned across blocks, and what earlier blocks contribute is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.session import durable

BLOCK = "_block"


def in_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Sorted rows with a block number that rises along (keys, order).

    Durable, since sampling the ranges again would move the borders.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return durable(ranged.withColumn(BLOCK, F.spark_partition_id()))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lags: dict[str, str] | None = None,
    carries: dict[str, str] | None = None,
    numbers: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add running sums (inclusive), lags by one, last non-null up to and including the row, and row numbers.

    ``order`` must be total within a key. With ``descending``, numbers count from the end.
    """
    sums, lags, carries = sums or {}, lags or {}, carries or {}
    blocks = in_blocks(df.withColumns({f"_v_{n}": e for n, e in sums.items()}), keys, order)
    by_order = [F.col(x).desc() if descending else F.col(x).asc() for x in order]
    w = Window.partitionBy(*keys, BLOCK).orderBy(*by_order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_s_{n}": F.sum(f"_v_{n}").over(running) for n in sums}
    local |= {f"_l_{n}": F.lag(x).over(w) for n, x in lags.items()}
    local |= {f"_c_{n}": F.last(x, ignorenulls=True).over(running) for n, x in carries.items()}
    local["_n"] = F.row_number().over(w)
    scanned = blocks.withColumns(local)

    last_key = F.struct(*order)
    picker = F.min_by if descending else F.max_by
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums]
    aggs += [picker(F.struct(F.col(x).alias("x")), last_key).alias(f"_l_{n}") for n, x in lags.items()]
    aggs += [
        picker(F.when(F.col(x).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), last_key)).alias(f"_c_{n}")
        for n, x in carries.items()
    ]
    summary = blocks.groupBy(*keys, BLOCK).agg(*aggs)
    wb = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc() if descending else F.col(BLOCK).asc())
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_b_rows": F.sum("_rows").over(before)}
    carry |= {f"_b_s_{n}": F.sum(f"_s_{n}").over(before) for n in sums}
    carry |= {f"_b_l_{n}": F.lag(f"_l_{n}").over(wb) for n in lags}
    carry |= {f"_b_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(before) for n in carries}
    carried = summary.withColumns(carry).select(*keys, BLOCK, *carry)

    out = scanned.join(carried, [*keys, BLOCK], "left")
    final = {n: F.col(f"_s_{n}") + F.coalesce(F.col(f"_b_s_{n}"), F.lit(0.0)) for n in sums}
    final |= {n: F.when(F.col("_n") > 1, F.col(f"_l_{n}")).otherwise(F.col(f"_b_l_{n}.x")) for n in lags}
    final |= {n: F.coalesce(F.col(f"_c_{n}"), F.col(f"_b_c_{n}")) for n in carries}
    if numbers:
        final[numbers] = (F.col("_n") + F.coalesce(F.col("_b_rows"), F.lit(0))).cast("long")
    return out.withColumns(final).select(*df.columns, *final)


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows per key; Spark limits each task's rows per key before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
