"""From raw quotes to a margin-free consensus per fixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.operators.tables import latest_quotes, pick_by

ODDS = ["home_odds", "draw_odds", "away_odds"]


def pre_kickoff(quotes: DataFrame, fixtures: DataFrame, default: str = "23:59:59") -> DataFrame:
    """Quotes strictly before their fixture's start, with the start as ``kickoff``."""
    starts = fixtures.select("fixture_id", t.kickoff_or_default("commence_time", "date", default).alias("kickoff"))
    return quotes.join(starts, "fixture_id").where(F.col("snapshot_time") < F.col("kickoff"))


def in_play(quotes: DataFrame, fixtures: DataFrame, as_of, fresh_minutes: float, default: str = "00:00:00") -> DataFrame:
    """Quotes after the start and no older than the freshness bound at ``as_of``."""
    starts = fixtures.select("fixture_id", t.kickoff_or_default("commence_time", "date", default).alias("kickoff"))
    age = t.hours_between("snapshot_time", as_of) * 60.0
    return quotes.join(starts, "fixture_id").where(
        (F.col("snapshot_time") > F.col("kickoff")) & (age <= fresh_minutes) & (age >= 0)
    )


def prefer_recent(latest: DataFrame, hours: float = 6.0) -> DataFrame:
    """Keep a fixture's quotes of the last hours if two books are there; else all, flagged degraded."""
    recent = t.hours_between("snapshot_time", "kickoff") <= hours
    w = Window.partitionBy("fixture_id")  # one row per book
    counted = latest.withColumns({"_is": recent, "_recent": F.count_if(recent).over(w)})
    return (
        counted.where((F.col("_recent") < 2) | F.col("_is"))
        .withColumn("kr_degraded", F.col("_recent") < 2)
        .drop("_recent", "_is")
    )


def book_probs(latest: DataFrame) -> DataFrame:
    """Valid books with power de-vigged probabilities; those not strictly inside (0, 1) become null.

    Nulls leave every aggregate below, and no filter makes the solve run twice.
    """
    priced = x.with_power_probs(latest.where(x.valid_quote(*ODDS)))
    inside = x.inside_unit("p_home", "p_draw", "p_away")
    return priced.withColumns({p: F.when(inside, F.col(p)) for p in ("p_home", "p_draw", "p_away")})


def few_median(values) -> Column:
    """The exact median of a group of few values, nulls left out: sorted and read in the middle.

    ``F.median`` keeps a hash table of counts for each group, which costs far more than it saves where values hardly repeat.
    """
    ordered = F.sort_array(F.collect_list(values))
    n = F.size(ordered)

    def at(i):
        return F.get(ordered, i.cast("int"))

    return 0.5 * at(F.floor((n - 1) / 2)) + 0.5 * at(F.floor(n / 2))


def median_consensus(books: DataFrame, extra: list | None = None) -> DataFrame:
    """Per fixture: renormalised medians of at least two books. A fixture's group holds one row per book."""
    agg = books.groupBy("fixture_id").agg(
        few_median("p_home").alias("_h"),
        few_median("p_draw").alias("_d"),
        few_median("p_away").alias("_a"),
        F.count("p_home").alias("bookmaker_count"),
        F.max("snapshot_time").alias("latest_quote"),
        *(extra or []),
    )
    total = F.col("_h") + F.col("_d") + F.col("_a")
    return (
        agg.where(F.col("bookmaker_count") >= 2)
        .withColumns({"home_prob": F.col("_h") / total, "draw_prob": F.col("_d") / total, "away_prob": F.col("_a") / total})
        .drop("_h", "_d", "_a")
    )


def frozen_consensus(quotes: DataFrame, fixtures: DataFrame, window_hours: float = 6.0) -> DataFrame:
    """Write-once consensus at kickoff: draw-corrected expected scores, six decimals, one row per fixture."""
    latest = latest_quotes(pre_kickoff(quotes, fixtures).where(x.valid_quote(*ODDS)))
    chosen = prefer_recent(latest, window_hours)
    books = book_probs(chosen)
    extra = [
        F.max("kickoff").alias("kickoff"),
        F.bool_or("kr_degraded").alias("kr_degraded"),
        F.sort_array(F.collect_set(F.when(F.col("p_home").isNotNull(), F.col("bookmaker")))).alias("bookmakers_used"),
        F.sort_array(
            F.collect_list(
                F.struct(
                    "bookmaker",
                    F.round("p_home", 6).alias("home_prob"),
                    F.round("p_draw", 6).alias("draw_prob"),
                    F.round("p_away", 6).alias("away_prob"),
                    F.round("devig_k", 6).alias("k"),
                    "snapshot_time",
                )
            )
        ).alias("raw_snapshots"),
    ]
    agreed = median_consensus(books, extra)
    home_raw = x.expected_score("home_prob", "draw_prob", limit=False)
    away_raw = x.expected_score("away_prob", "draw_prob", limit=False)
    r6 = lambda e: F.round(e, 6)
    return agreed.select(
        "fixture_id",
        "kickoff",
        F.col("bookmaker_count").cast("int").alias("bookmaker_count"),
        "bookmakers_used",
        r6("home_prob").alias("home_prob"),
        r6("draw_prob").alias("draw_prob"),
        r6("away_prob").alias("away_prob"),
        r6(x.draw_corrected(home_raw, "draw_prob")).alias("home_expected_score"),
        r6(x.draw_corrected(away_raw, "draw_prob")).alias("away_expected_score"),
        r6(home_raw).alias("home_expected_score_raw"),
        r6(away_raw).alias("away_expected_score_raw"),
        "raw_snapshots",
        F.lit("power_devig_median_v1.5_draw_corrected").alias("method"),
        "kr_degraded",
    )


def current_expected(latest: DataFrame) -> DataFrame:
    """Home expected score from current serving quotes: not draw-corrected, limited to [0.01, 0.99]."""
    agreed = median_consensus(book_probs(latest))
    return agreed.select(
        "fixture_id",
        x.expected_score("home_prob", "draw_prob").alias("home_es"),
        "draw_prob",
        "home_prob",
        "away_prob",
        "bookmaker_count",
        "latest_quote",
    )


def days_out(quotes: DataFrame, fixtures: DataFrame, days: int = 1) -> DataFrame:
    """Quotes taken so many days before the start: what the daily batch models read, with ``days`` 1."""
    starts = fixtures.select("fixture_id", t.kickoff_or_default("commence_time", "date", "23:59:59").alias("kickoff"))
    return quotes.join(starts, "fixture_id").where(t.days_before("snapshot_time", "kickoff") == days)


def preferred_consensus(quotes: DataFrame, book: str | None) -> DataFrame:
    """Mean of the preferred book's reciprocal odds where it quotes, else the median of all books; margin removed.

    Several quotes of one book are distinct observations here. Equal values are counted
    first, so that a fixture's median works on its distinct odds.
    """
    valid = quotes.where(x.valid_quote(*ODDS, minimum=1.0, strict=True))
    sides = [("home_odds", "h"), ("draw_odds", "d"), ("away_odds", "a")]
    preferred = (F.col("bookmaker") == book) if book else F.lit(False)
    agg = []
    for odds, s in sides:
        agg.append(F.median(1.0 / F.col(odds)).alias(f"_m{s}"))
        agg.append(F.avg(F.when(preferred, 1.0 / F.col(odds))).alias(f"_p{s}"))
    merged = valid.groupBy("fixture_id").agg(*agg)
    probs = {s: F.coalesce(F.col(f"_p{s}"), F.col(f"_m{s}")) for _, s in sides}
    total = probs["h"] + probs["d"] + probs["a"]
    return merged.select(
        "fixture_id",
        (probs["h"] / total).alias("home_prob"),
        (probs["d"] / total).alias("draw_prob"),
        (probs["a"] / total).alias("away_prob"),
    )


def display_consensus(latest: DataFrame) -> DataFrame:
    """Mean proportional probability, median odds and book count per fixture, for display."""
    valid = latest.where(x.valid_quote(*ODDS, minimum=0.0, strict=True))
    p = x.proportional_probs(*ODDS)
    return (
        valid.withColumns({"_h": p[0], "_d": p[1], "_a": p[2]})
        .groupBy("fixture_id")
        .agg(
            F.avg("_h").alias("home_prob"),
            F.avg("_d").alias("draw_prob"),
            F.avg("_a").alias("away_prob"),
            F.median("home_odds").alias("home_odds"),
            F.median("draw_odds").alias("draw_odds"),
            F.median("away_odds").alias("away_odds"),
            F.count(F.lit(1)).alias("books"),
        )
    )


def alternates(fixtures: DataFrame, having: DataFrame, days: int = 3, among: DataFrame | None = None) -> DataFrame:
    """For each fixture, the alternate (of ``among``, else of the fixtures) with the same sides within +-days whose id is in ``having``.

    The lowest other id wins. Only the two lowest ids per (home, away, date) can
    matter, so those are kept first and each fixture probes its 2*days+1 dates:
    no pair of a crowded pairing is ever formed.
    """
    withq = (fixtures if among is None else among).join(having.select("fixture_id").distinct(), "fixture_id", "left_semi")
    first = withq.groupBy("home_team", "away_team", "date").agg(F.min("fixture_id").alias("_a"))
    lowest = first.select("home_team", "away_team", "date", "_a")
    rest = withq.join(lowest, ["home_team", "away_team", "date"]).where(F.col("fixture_id") > F.col("_a"))
    second = rest.groupBy("home_team", "away_team", "date").agg(F.min("fixture_id").alias("_b"))
    two = lowest.join(second, ["home_team", "away_team", "date"], "left")
    span = F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days)))
    probes = fixtures.select("fixture_id", "home_team", "away_team", span.alias("date"))
    best = F.when(F.col("_a") != F.col("fixture_id"), F.col("_a")).otherwise(F.col("_b"))
    return (
        probes.join(two, ["home_team", "away_team", "date"])
        .groupBy("fixture_id")
        .agg(F.min(best).alias("alt_fixture_id"))
        .where(F.col("alt_fixture_id").isNotNull())
    )


def quotes_cascade(fixtures: DataFrame, serving: DataFrame, archive: DataFrame) -> DataFrame:
    """Per fixture the first source that has quotes: serving table, own archive, alternate's serving, alternate's archive.

    Returns latest quotes per (fixture, book) with the ``source_rank`` used.
    """
    pre = latest_quotes(pre_kickoff(archive, fixtures))
    cols = ["fixture_id", "bookmaker", *ODDS, "snapshot_time"]
    srv, arc = serving.select(*cols), pre.select(*cols)

    def keyed(df):
        return df.select("fixture_id").distinct()

    have = keyed(srv).withColumn("_r", F.lit(1)).unionByName(keyed(arc).withColumn("_r", F.lit(2)))
    own = have.groupBy("fixture_id").agg(F.min("_r").alias("source_rank"))
    direct = own.withColumn("_src", F.col("fixture_id"))
    lacking = fixtures.join(own, "fixture_id", "left_anti")
    alt = alternates(fixtures, own).join(lacking.select("fixture_id"), "fixture_id", "left_semi")
    indirect = alt.join(own.withColumnRenamed("fixture_id", "alt_fixture_id"), "alt_fixture_id").select(
        "fixture_id", (F.col("source_rank") + 2).alias("source_rank"), F.col("alt_fixture_id").alias("_src")
    )
    plan = direct.unionByName(indirect)
    every = srv.withColumn("_kind", F.lit(1)).unionByName(arc.withColumn("_kind", F.lit(2)))
    every = every.withColumnRenamed("fixture_id", "_src")
    kind = F.when(F.col("source_rank") % 2 == 1, 1).otherwise(2)
    return plan.withColumn("_kind", kind).join(every, ["_src", "_kind"]).drop("_src", "_kind")


def first_per_fixture(df: DataFrame, order: list) -> DataFrame:
    return pick_by(df, ["fixture_id"], order, first=True)
