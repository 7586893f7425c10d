"""Published index history: downsampling, averages over time, windows around matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.operators.ordered import ordered_scan
from ratewright.operators.settle import team_rows
from ratewright.operators.tables import pick_by


def bucket_start(ts, seconds: int) -> Column:
    whole = F.floor(t.micros(ts) / (seconds * 1_000_000)) * seconds
    return F.timestamp_seconds(whole).cast("timestamp_ntz")


def downsample(history: DataFrame, seconds: int, order: list[str], reasons: tuple[str, ...] | None = None) -> DataFrame:
    """Latest row per (team, bucket); rows of other reasons are all kept where reasons are given."""
    thin = history if reasons is None else history.where(F.col("publish_reason").isin(*reasons))
    picked = pick_by(thin.withColumn("_b", bucket_start("ts", seconds)), ["team", "_b"], order).drop("_b")
    if reasons is None:
        return picked
    rest = history.where(~F.col("publish_reason").isin(*reasons))
    return rest.unionByName(picked.select(*rest.columns))


def twap(points: DataFrame, seconds: int, min_points: int = 3) -> DataFrame:
    """Time-weighted mean price per (team, window): each price holds until the window's next point.

    Points get their successor by a scan that splits busy teams; the sums are partial aggregates.
    """
    rows = points.withColumn("window_start", bucket_start("ts", seconds))
    keys = ["team", "window_start"]
    with_prev = ordered_scan(rows, keys, ["ts", "event_id"], lags={"_pp": "price", "_pt": "ts"})
    dt = t.hours_between("_pt", "ts")
    agg = with_prev.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.sum(F.col("_pp") * dt).alias("_ws"),
        F.sum(dt).alias("_w"),
        F.min_by("price", F.struct("ts", "event_id")).alias("_first"),
    )
    price = F.when(F.col("_w") > 0, F.col("_ws") / F.col("_w")).otherwise(F.col("_first"))
    return agg.where(F.col("points") >= min_points).select(
        *keys, "points", price.alias("twap_price"), x.price_to_index(price).alias("twap_index")
    )


def twap_at(points: DataFrame, requests: DataFrame, seconds: int, min_points: int = 3) -> DataFrame:
    """Time-weighted mean price of the ``seconds`` before each request (team, at): (team, at, points, twap_price, twap_index).

    A price holds until the next one, so the price before the window counts for its first part and the last one up to
    ``at``; before a team's first price nothing counts. Requests with fewer than ``min_points`` points in their window
    (both ends included) are left out. The mean is a difference of two running integrals of price over time, which the
    window's ends read off one ordered scan over points and ends together: no window of points is ever gathered.
    """
    stepped = ordered_scan(points.select("team", "ts", "event_id", "price"), ["team"], ["ts", "event_id"], lags={"_pp": "price", "_pt": "ts"})
    hours = F.coalesce(t.hours_between("_pt", "ts"), F.lit(0.0))
    marks = stepped.select(
        "team", "ts", F.lit(1).alias("_rank"), F.col("event_id").alias("_id"), (F.coalesce("_pp", F.lit(0.0)) * hours).alias("_area"), hours.alias("_time"), F.lit(1.0).alias("_one"),
        F.struct("ts", "price").alias("_last"), F.lit(None).cast("timestamp_ntz").alias("at"),
    )
    asked = requests.select("team", "at").distinct()
    none, zero = F.lit(None).cast("struct<ts:timestamp_ntz,price:double>").alias("_last"), F.lit(0.0)
    # An end at the window's start comes before points of the same time, one at its end after them.
    ends = [(F.col("at") - F.make_interval(secs=F.lit(seconds)), 0), (F.col("at"), 2)]
    both = marks
    for when, rank in ends:
        both = both.unionByName(asked.select("team", when.alias("ts"), F.lit(rank).alias("_rank"), F.unix_micros(F.col("at").cast("timestamp")).alias("_id"), zero.alias("_area"), zero.alias("_time"), zero.alias("_one"), none, "at"))
    run = ordered_scan(both, ["team"], ["ts", "_rank", "_id"], sums={"_a": F.col("_area"), "_t": F.col("_time"), "_n": F.col("_one")}, carries={"_held": "_last"})
    since = F.coalesce(t.hours_between("_held.ts", "ts"), F.lit(0.0))
    read = run.where("at is not null").withColumns({"_a": F.col("_a") + F.coalesce("_held.price", F.lit(0.0)) * since, "_t": F.col("_t") + since})
    sign = F.when(F.col("_rank") == 2, 1.0).otherwise(-1.0)
    out = read.groupBy("team", "at").agg(*[F.sum(sign * F.col(n)).alias(n) for n in ("_a", "_t", "_n")], F.max("_held.price").alias("_p"))
    price = F.when(F.col("_t") > 0, F.col("_a") / F.col("_t")).otherwise(F.col("_p"))
    kept = out.where(F.col("_n") >= min_points)
    return kept.select("team", "at", F.col("_n").cast("long").alias("points"), price.alias("twap_price"), x.price_to_index(price).alias("twap_index"))


def volume_change(rows: DataFrame, keys: list[str], order: list[str], value: str = "volume") -> DataFrame:
    """Difference to the key's previous snapshot, in cents; zero for the first."""
    seen = ordered_scan(rows, keys, order, lags={"_prev": value})
    return seen.withColumn("volume_delta", F.coalesce(x.half_up(F.col(value) - F.col("_prev"), 2), F.lit(0.0))).drop("_prev")


def around_matches(fixtures: DataFrame, history: DataFrame, order: list[str], hours: int = 24, seconds: int = 900) -> DataFrame:
    """Both teams' thinned history within +-hours of kickoff.

    History is thinned to one row per team and bucket first, and joined on (team, day):
    a fixture meets at most the buckets of its own three days. ``history``: team, ts, ...
    """
    thin = downsample(history, seconds, order).withColumn("_day", F.col("ts").cast("date"))
    rows = team_rows(fixtures.select("fixture_id", "date", "commence_time", "home_team", "away_team"))
    rows = rows.withColumn("kickoff", t.kickoff_or_default("commence_time", "date", "12:00:00"))
    span = (hours + 23) // 24
    day = F.col("kickoff").cast("date")
    probes = rows.select("fixture_id", F.col("team_id").alias("team"), "is_home", "kickoff", F.explode(F.sequence(F.date_sub(day, span), F.date_add(day, span))).alias("_day"))
    near = F.abs(t.hours_between("kickoff", "ts")) <= hours
    return probes.join(thin, ["team", "_day"]).where(near).drop("_day")


def chart_matches(fixtures: DataFrame, spans: DataFrame, minutes: int = 105) -> DataFrame:
    """Matches starting inside a team's chart span. ``spans``: team_id, span_start, span_end (one row per team)."""
    rows = team_rows(fixtures.select("fixture_id", "date", "commence_time", "home_team", "away_team"))
    rows = rows.withColumn("kickoff", t.kickoff_or_default("commence_time", "date", "00:00:00"))
    inside = rows.join(spans, "team_id").where(F.col("kickoff").between(F.col("span_start"), F.col("span_end")))
    return inside.select(
        "team_id", "fixture_id", "opponent", "kickoff", F.timestamp_add("MINUTE", F.lit(minutes), F.col("kickoff")).alias("full_time")
    )


def display_day(reason, match_date, first_match, ts) -> Column:
    """Day a history row is drawn at: match day for settlements, first match for bootstraps, else its own."""
    own = F.col(ts).cast("date") if isinstance(ts, str) else ts.cast("date")
    return (
        F.when(F.startswith(F.col(reason), F.lit("settlement")), F.coalesce(F.col(match_date), own))
        .when(F.startswith(F.col(reason), F.lit("bootstrap")), F.coalesce(F.col(first_match), own))
        .otherwise(own)
    )


def timeframe(points: DataFrame, start: Column, end: Column) -> DataFrame:
    """Points of a span per team, with an anchor at each border that the points leave open.

    Only the first and the last value per team are needed for the anchors.
    """
    inside = points.where(F.col("ts").between(start, end) & ~F.startswith("publish_reason", F.lit("bootstrap")))
    key = F.struct("ts", "event_id")
    ends = inside.groupBy("team").agg(
        F.min("ts").alias("_a"), F.max("ts").alias("_z"), F.min_by("published_index", key).alias("_fa"), F.max_by("published_index", key).alias("_fz")
    )
    anchors = [
        ends.where(F.col("_a") > start).select("team", start.alias("ts"), F.col("_fa").alias("published_index"), F.lit("_anchor").alias("publish_reason")),
        ends.where(t.hours_between("_z", end) > 1).select("team", end.alias("ts"), F.col("_fz").alias("published_index"), F.lit("_anchor").alias("publish_reason")),
    ]
    return inside.select("team", "ts", "published_index", "publish_reason").unionByName(anchors[0]).unionByName(anchors[1])


def staleness(history: DataFrame, as_of: Column, minutes: float = 30.0) -> DataFrame:
    """One row: newest write, its age, share of teams without a recent row, and the two alerts."""
    last = history.where(F.col("ts") <= as_of).groupBy("team").agg(F.max("ts").alias("last"))
    age = t.hours_between("last", as_of) * 60.0
    agg = last.agg(
        F.max("last").alias("newest"), F.count(F.lit(1)).alias("teams"), F.count_if(age > minutes).alias("stale_teams")
    )
    return agg.select(
        "newest", "teams", "stale_teams",
        (t.hours_between("newest", as_of) * 60.0 > minutes).alias("price_staleness"),
        (F.col("stale_teams") * 2 > F.col("teams")).alias("m1_staleness"),
    )
