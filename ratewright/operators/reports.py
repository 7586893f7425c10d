"""Accuracy, volatility, calibration and coverage reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.functions import text as tx
from ratewright.operators.ordered import ordered_scan
from ratewright.operators.settle import team_rows

SERIES = ["team", "model"]


def daily_changes(prices: DataFrame) -> DataFrame:
    """Day-over-day change per (team, model); a series holds one row per calendar day."""
    w = Window.partitionBy(*SERIES).orderBy("date")
    out = prices.withColumns({"change": F.col("dollar_price") - F.lag("dollar_price").over(w), "position": F.row_number().over(w) - 1})
    return out.where(F.col("change").isNotNull())


def zero_if_null(e: Column) -> Column:
    return F.coalesce(e, F.lit(0.0))


def volatility(prices: DataFrame, fixtures: DataFrame) -> DataFrame:
    days = team_rows(fixtures.select("date", "home_team", "away_team")).select(F.col("team_id").alias("team"), "date").distinct()
    ch = daily_changes(prices).withColumn("a", F.abs("change")).join(days.withColumn("_m", F.lit(True)), ["team", "date"], "left")
    on = F.col("_m").isNotNull()
    agg = ch.groupBy("model").agg(
        zero_if_null(F.avg("a")).alias("avg_daily_change"),
        zero_if_null(F.stddev_pop("a")).alias("daily_stdev"),
        zero_if_null(F.avg(F.when(on, F.col("a")))).alias("match_day_vol"),
        zero_if_null(F.avg(F.when(~on, F.col("a")))).alias("non_match_day_vol"),
        F.count(F.lit(1)).alias("n_changes"),
        F.count_if(on).alias("n_match_day"),
    )
    ratio = F.when(F.col("non_match_day_vol") > 0, F.col("match_day_vol") / F.col("non_match_day_vol")).otherwise(0.0)
    return agg.withColumn("vol_ratio", ratio)


def model_summary(prices: DataFrame) -> DataFrame:
    moves = daily_changes(prices).groupBy("model").agg(
        F.stddev_pop(F.abs("change")).alias("daily_stdev"), F.max(F.abs("change")).alias("max_move")
    )
    return prices.groupBy("model").agg(F.avg("dollar_price").alias("avg_price")).join(moves, "model")


def brier(probs: DataFrame, fixtures: DataFrame) -> DataFrame:
    home, away = tx.goals_lenient("score")
    actual = fixtures.select("fixture_id", home.alias("h"), away.alias("a")).where(F.col("h").isNotNull() & F.col("a").isNotNull())
    j = probs.join(actual, "fixture_id")
    sq = {
        "home": F.pow(F.col("implied_home_win") - (F.col("h") > F.col("a")).cast("double"), 2),
        "draw": F.pow(F.col("implied_draw") - (F.col("h") == F.col("a")).cast("double"), 2),
        "away": F.pow(F.col("implied_away_win") - (F.col("a") > F.col("h")).cast("double"), 2),
    }
    return j.groupBy("model").agg(
        F.avg(sq["home"] + sq["draw"] + sq["away"]).alias("brier"),
        *[F.avg(e).alias(f"brier_{n}") for n, e in sq.items()],
        F.count(F.lit(1)).alias("n_matches"),
    )


def _peak() -> Column:
    return F.greatest(F.abs("edge_home"), F.abs("edge_draw"), F.abs("edge_away"))


def edge_frequency(probs: DataFrame) -> DataFrame:
    p = probs.withColumn("peak", _peak())
    counts = [F.count_if(F.col("peak") > v).alias(f"edges_gt_{n}pct") for v, n in ((0.03, 3), (0.05, 5), (0.10, 10))]
    label = F.concat_ws("", "home_team", F.lit(" vs "), "away_team", F.lit(" ("), F.col("date").cast("string"), F.lit(")"))
    return p.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_matches"), *counts,
        (100.0 * F.avg((F.col("peak") > 0.03).cast("double"))).alias("pct_gt_3"),
        (100.0 * F.avg((F.col("peak") > 0.05).cast("double"))).alias("pct_gt_5"),
        (100.0 * F.max("peak")).alias("max_edge"),
        F.max_by(label, F.struct("peak", (-F.col("fixture_id")).alias("i"))).alias("max_edge_match"),
    )


def edge_rows(probs: DataFrame) -> DataFrame:
    parts = [F.struct(F.lit(s).alias("side"), F.abs(f"edge_{s}").alias("edge")) for s in ("home", "draw", "away")]
    return probs.select("fixture_id", "model", "date", "home_team", "away_team", F.inline(F.array(*parts)))


def edge_distribution(probs: DataFrame) -> DataFrame:
    """Mean, upper median, max and counts of absolute edges.

    Edges have four decimals, so they are counted per value first: at most 10 001 values
    per model reach the window that finds the median.
    """
    values = edge_rows(probs).groupBy("model", F.round("edge", 4).alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model")
    ranked = values.withColumns(
        {"_upto": F.sum("n").over(w.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(w)}
    )
    middle = F.floor(F.col("_all") / 2)
    out = ranked.groupBy("model").agg(
        (F.sum(F.col("edge") * F.col("n")) / F.sum("n")).alias("mean_edge"),
        F.min(F.when(F.col("_upto") > middle, F.col("edge"))).alias("median_edge"),
        F.max("edge").alias("max_edge"),
        F.sum(F.when(F.col("edge") > 0.03, F.col("n")).otherwise(0)).alias("gt_3pct"),
        F.sum(F.when(F.col("edge") > 0.05, F.col("n")).otherwise(0)).alias("gt_5pct"),
        F.sum("n").alias("outcomes"),
    )
    matches = probs.groupBy("model").agg(F.count_if(_peak() > 0.03).alias("matches_with_edge"))
    return out.join(matches, "model")


#: Positions and teams whose co-moments are worked out in one task.
POSITIONS, TEAMS = 512, 128
MOMENTS = ["n", "sa", "sb", "saa", "sbb", "sab"]


def _co_moments(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of positions for the pairs of two blocks of teams, the first team before the second."""
    wide = [x.pivot(index="position", columns="team", values="change") for x in (left, right)]
    at = wide[0].index.intersection(wide[1].index)
    (va, ha), (vb, hb) = ((np.nan_to_num(w.loc[at].to_numpy()), w.loc[at].notna().to_numpy().astype(float)) for w in wide)
    sums = [ha.T @ hb, va.T @ hb, ha.T @ vb, (va * va).T @ hb, ha.T @ (vb * vb), va.T @ vb]
    one, other = np.asarray(wide[0].columns, dtype=object), np.asarray(wide[1].columns, dtype=object)
    i, j = np.nonzero((sums[0] > 0) & (one[:, None] != other[None, :]))
    if key[3] == key[4]:
        keep = one[i] < other[j]
        i, j = i[keep], j[keep]
    out = pd.DataFrame({"league": key[0], "model": key[1], "a": one[i], "b": other[j]})
    return out.assign(**{n: m[i, j] for n, m in zip(MOMENTS, sums)})


def pair_correlation(prices: DataFrame) -> DataFrame:
    """Per (league, model): the mean Pearson correlation over its pairs of teams, each over the days both have.

    Changes lie in blocks of positions by blocks of teams; a task multiplies two team blocks of one position block, and the
    pairs' sums are added up afterwards. No task holds a league's whole table.
    """
    ch = daily_changes(prices).select("league", "model", "team", "position", "change")
    key = ["league", "model"]
    counts = ch.groupBy(*key).agg(F.countDistinct("team").cast("int").alias("n_teams"))
    cuts = counts.select(*key, F.ceil(F.col("n_teams") / TEAMS).cast("int").alias("_cuts"))
    placed = ch.join(cuts, key).withColumns({"_p": F.floor(F.col("position") / POSITIONS).cast("int"), "_t": F.pmod(F.xxhash64("team"), "_cuts").cast("int")})
    left = placed.select("*", F.col("_t").alias("_one"), F.explode(F.sequence(F.col("_t"), F.col("_cuts") - 1)).alias("_two"))
    right = placed.select(*[F.col(n).alias(n) for n in ("league", "model", "team", "position", "change", "_p")], F.explode(F.sequence(F.lit(0), F.col("_t"))).alias("_one"), F.col("_t").alias("_two"))
    by = [*key, "_p", "_one", "_two"]
    right = right.select(*[F.col(n).alias(f"r{n}") for n in by], "team", "position", "change")
    schema = "league string, model string, a string, b string, " + ", ".join(f"{n} double" for n in MOMENTS)
    parts = left.groupBy(*by).cogroup(right.groupBy(*[f"r{n}" for n in by])).applyInPandas(_co_moments, schema)
    # Two blocks give a pair in either order of its teams.
    swap = F.col("a") > F.col("b")
    twin = {"sa": "sb", "sb": "sa", "saa": "sbb", "sbb": "saa"}
    named = {"a": F.least("a", "b"), "b": F.greatest("a", "b")} | {n: F.when(swap, F.col(m)).otherwise(F.col(n)) for n, m in twin.items()}
    whole = parts.withColumns(named).groupBy(*key, "a", "b").agg(*[F.sum(n).alias(n) for n in MOMENTS])
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    spread = [F.greatest(F.col(s2) - F.col(s1) * F.col(s1) / F.col("n"), F.lit(0.0)) for s1, s2 in (("sa", "saa"), ("sb", "sbb"))]
    den = F.sqrt(spread[0] * spread[1])
    pairs = whole.withColumn("c", F.when((F.col("n") >= 3) & (den > 1e-12), cov / den))
    means = pairs.groupBy(*key).agg(F.count("c").cast("int").alias("n_pairs"), F.avg("c").alias("_mean"))
    return counts.join(means, key, "left").select(*key, "n_teams", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("_mean", F.lit(0.0)).alias("avg_correlation"))


def price_impact(prices: DataFrame, fixtures: DataFrame, model: str) -> DataFrame:
    """Price on the series' day before and after each scored match, from each side's view."""
    series = prices.where(F.col("model") == model).select("team", "date", "dollar_price")
    index = series.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))  # one row per day
    indexed = series.join(index, "date")
    home, away = tx.goals_lenient("score")
    f = fixtures.withColumns({"hg": home, "ag": away}).where(F.col("hg").isNotNull() & F.col("ag").isNotNull())
    rows = team_rows(f.select("fixture_id", "date", "league", "score", "home_team", "away_team", "hg", "ag"), {"own": ("hg", "ag"), "other": ("ag", "hg")})
    rows = rows.withColumnRenamed("team_id", "team").join(index, "date")
    before = indexed.select("team", (F.col("_i") + 1).alias("_i"), F.col("dollar_price").alias("price_before"))
    after = indexed.select("team", (F.col("_i") - 1).alias("_i"), F.col("dollar_price").alias("price_after"))
    s = tx.result_score("own", "other")
    joined = rows.join(before, ["team", "_i"]).join(after, ["team", "_i"])
    return joined.select(
        "fixture_id", "team", "opponent", "date", "league", "score", "is_home",
        F.when(s == 1.0, "win").when(s == 0.5, "draw").otherwise("loss").alias("result"),
        "price_before", "price_after", (F.col("price_after") - F.col("price_before")).alias("delta"),
    )


def impact_by_result(impacts: DataFrame) -> DataFrame:
    """Statistics per result. Prices have cents, so deltas are counted per value before the median."""
    values = impacts.groupBy("result", F.round("delta", 2).alias("delta")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("result")
    ranked = values.withColumns(
        {"_upto": F.sum("n").over(w.orderBy("delta").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(w)}
    )
    d, n = F.col("delta"), F.col("n")
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    stats = ranked.groupBy("result").agg(
        F.sum("n").alias("count"), (F.sum(d * n) / F.sum("n")).alias("avg_delta"),
        F.min(F.when(F.col("_upto") > low, d)).alias("_lo"), F.min(F.when(F.col("_upto") > high, d)).alias("_hi"),
        F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"),
        (F.sum(d * d * n) / F.sum("n")).alias("_sq"), (F.sum(F.abs(d) * n) / F.sum("n")).alias("avg_abs_delta"),
    )
    return stats.select(
        "result", "count", "avg_delta", ((F.col("_lo") + F.col("_hi")) / 2).alias("median_delta"), "min_delta", "max_delta",
        F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("avg_delta") * F.col("avg_delta"))).alias("stdev_delta"), "avg_abs_delta",
    )


def top_series(prices: DataFrame, model: str, n: int) -> DataFrame:
    """All series of the n teams with the highest latest price of one model."""
    latest = prices.where(F.col("model") == model).groupBy("team").agg(F.max_by("dollar_price", "date").alias("_p"))
    top = latest.orderBy(F.col("_p").desc(), "team").limit(n)
    return prices.join(top.select("team"), "team", "left_semi")


# --- settlement diagnostics ----------------------------------------------------------


def settlement_stats(log: DataFrame) -> DataFrame:
    u = F.col("actual_score_s") - F.col("e_kr")
    d, g = F.abs("delta_b"), F.abs("gravity_component")
    return log.agg(
        F.count(F.lit(1)).alias("total"), zero_if_null(F.avg(F.abs(u))).alias("mean_abs_surprise"), zero_if_null(F.avg(u * u)).alias("brier_score"),
        zero_if_null(F.avg(d)).alias("mean_delta"), zero_if_null(F.max(d)).alias("max_delta"),
        zero_if_null(F.avg(g)).alias("mean_gravity"), zero_if_null(F.max(g)).alias("max_gravity"),
        zero_if_null(F.when(F.sum(d) > 0, F.sum(g) / F.sum(d) * 100.0)).alias("gravity_pct_of_delta"),
    )


def calibration(log: DataFrame) -> DataFrame:
    bucket = F.least(F.lit(9), F.floor(F.col("e_kr") * 10)).cast("int")
    return log.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("actual_score_s").alias("actual"), F.first(bucket * 0.1 + 0.05).alias("expected")
    )


def histogram(rows: DataFrame, bin_index: Column, lo: int, hi: int, keep_empty: bool = True) -> DataFrame:
    """Counts per whole-numbered bin in [lo, hi]; others are dropped; empty bins stay where asked."""
    counts = rows.select(bin_index.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    if not keep_empty:
        return counts
    spine = rows.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def tag_league(rows: DataFrame, fixtures: DataFrame) -> DataFrame:
    f = fixtures.select("fixture_id", F.col("league").alias("_lg"))
    return rows.drop("league").join(f, "fixture_id", "left").withColumn("league", F.coalesce("_lg", F.lit("Unknown"))).drop("_lg")


def cup_stats(log: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Cup change per team: total, count, last change and its match."""
    names = fixtures.select("fixture_id", F.concat_ws(" vs ", "home_team", "away_team").alias("_m"))
    cup = log.where(F.col("competition") == "cup").join(names, "fixture_id", "left")
    last = F.struct("date", "fixture_id")
    return cup.groupBy("team_id").agg(
        F.sum("delta_b").alias("cl_delta_sum"), F.count(F.lit(1)).alias("cl_settled_count"),
        F.max_by("delta_b", last).alias("cl_last_delta"), F.max_by("_m", last).alias("cl_last_match"),
    )


def settled_pairs(log: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Both sides of a settled fixture in one row."""
    home = F.col("is_home")
    cols = [
        F.max(F.when(home if side == "home" else ~home, F.col(n))).alias(f"{side}_{n}")
        for side in ("home", "away")
        for n in ("delta_b", "gravity_component", "b_before", "b_after")
    ]
    pairs = log.groupBy("fixture_id").agg(*cols)
    return fixtures.select("fixture_id", "league", "home_team", "away_team", "score").join(pairs, "fixture_id")


def ranked(rows: DataFrame, by: str, tie: str = "team_id", league: str | None = None) -> DataFrame:
    """Position in the table by a key, missing last; within leagues where given."""
    keyed = rows.withColumn("_k", F.coalesce(-F.col(by), F.lit(float("inf"))))
    return ordered_scan(keyed, [league] if league else [], ["_k", tie], numbers="rank").drop("_k")


def sections(fixtures: DataFrame) -> DataFrame:
    """Fixtures in date sections with their place in the section; a crowded date is split over tasks."""
    rows = fixtures.select("date", F.coalesce("commence_time", F.col("date").cast("timestamp_ntz")).alias("starts"), "fixture_id", "home_team", "away_team")
    return ordered_scan(rows, ["date"], ["starts", "fixture_id"], numbers="place")


def analytics_blocks(prices: DataFrame, fixtures: DataFrame, probs: DataFrame, model: str = "oracle") -> dict[str, DataFrame]:
    """The blocks of the analytics document, each a small report; ``totals`` is one row, the others are lists."""
    impacts = price_impact(prices, fixtures, model)
    one, n = F.lit(1).alias("_k"), F.count(F.lit(1))
    totals = prices.agg(F.countDistinct("team").alias("teams"), n.alias("price_rows"), F.sort_array(F.collect_set("model")).alias("models"), F.sort_array(F.collect_set("league")).alias("leagues")).select("*", one)
    totals = totals.join(fixtures.agg(n.alias("matches")).select("*", one), "_k").join(probs.agg(n.alias("prediction_rows")).select("*", one), "_k").drop("_k")
    latest = prices.where(F.col("model") == model).groupBy("team").agg(F.max_by("league", "date").alias("league"), F.max_by("dollar_price", "date").alias("latest_price"))
    top = latest.orderBy(F.desc("latest_price"), "team").limit(5)
    point = [c for c in ("date", "dollar_price", "implied_elo") if c in prices.columns]
    # Five teams' series: a row per calendar day and model.
    series = prices.join(top.select("team"), "team", "left_semi").groupBy("team", "model").agg(F.sort_array(F.collect_list(F.struct(*point))).alias("prices"))
    series = series.groupBy("team").agg(F.sort_array(F.collect_list(F.struct("model", "prices"))).alias("models"))
    cents = {c: F.round(c, 2) for c in ("price_before", "price_after", "delta")}
    moves = impacts.orderBy(F.round(F.abs("delta"), 4).desc(), "fixture_id", "team").limit(10).withColumns(cents)
    side = F.when(F.col("is_home"), "home").otherwise("away").alias("home_away")
    return {
        "totals": totals, "volatility": volatility(prices, fixtures), "brier_scores": brier(probs, fixtures), "arb_frequency": edge_frequency(probs), "cross_team_correlations": pair_correlation(prices),
        "top5_teams_by_price": top.select("latest_price", "team", "league"), "top5_daily_prices": series, "price_impact_by_result": impact_by_result(impacts),
        "top10_price_moves": moves.select("fixture_id", "team", "opponent", "date", "league", side, "result", "score", "price_before", "price_after", "delta"),
    }


def analytics_document(blocks: dict[str, DataFrame], generated_at: Column, start: Column) -> DataFrame:
    """One row, one JSON document: when it was made, the days it covers, ``totals`` as an object and each other block as an array."""
    spark = next(iter(blocks.values())).sparkSession
    out = spark.range(1).select(F.lit(1).alias("_k"), generated_at.alias("generated_at"), F.struct(start.alias("start"), generated_at.cast("date").alias("end")).alias("data_range"))
    for name, df in blocks.items():
        rows = F.sort_array(F.collect_list(F.struct(*df.columns)))
        block = df.agg((rows[0] if name == "totals" else rows).alias(name)).withColumn("_k", F.lit(1))
        out = out.join(block, "_k")
    return out.select(F.to_json(F.struct("generated_at", "data_range", *blocks)).alias("document"))
