"""Finding the fixture an event belongs to, by names and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import text as tx
from ratewright.operators.consensus import alternates
from ratewright.session import durable


def canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace a name by its canonical form; unknown names stay. ``aliases``: source, canonical (unique source)."""
    a = aliases.select(F.col("source").alias(column), F.col("canonical").alias("_canonical"))
    joined = df.join(a, column, "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).drop("_canonical")


def _by_names(events: DataFrame, fixtures: DataFrame, days: int, norm: bool) -> DataFrame:
    """Lowest fixture id with the same sides (normalised if asked) within +-days, nearest day first."""
    name = tx.normal_name if norm else F.col
    best = fixtures.groupBy("home_team", "away_team", F.col("date").alias("_d")).agg(F.min("fixture_id").alias("fixture_id"))
    if norm:  # names are cleaned once per pairing and day, not per fixture
        cleaned = best.select(name("home_team").alias("_h"), name("away_team").alias("_a"), "_d", "fixture_id")
        best = cleaned.groupBy("_h", "_a", "_d").agg(F.min("fixture_id").alias("fixture_id"))
    else:
        best = best.withColumnsRenamed({"home_team": "_h", "away_team": "_a"})
    day = F.col("event_date")
    probes = events.select(
        "event_id", name("home_team").alias("_h"), name("away_team").alias("_a"), "event_date",
        F.explode(F.sequence(F.date_sub(day, days), F.date_add(day, days))).alias("_d"),
    )
    hits = probes.join(best, ["_h", "_a", "_d"])
    gap = F.abs(F.date_diff("_d", "event_date"))
    return hits.groupBy("event_id").agg(F.min_by("fixture_id", F.struct(gap, F.col("fixture_id"))).alias("fixture_id"))


def resolve_events(events: DataFrame, fixtures: DataFrame, aliases: DataFrame, days: int = 2) -> DataFrame:
    """Event -> fixture in stages: canonical exact names, then normalised names, else a synthetic id.

    ``events``: event_id (text), home_team, away_team, event_date. Every stage is an equi join on
    (home, away, day) with one candidate per key; later stages see only what is left.
    """
    named = canonical(canonical(events, "home_team", aliases), "away_team", aliases)
    exact = _by_names(named, fixtures, days, False).withColumn("stage", F.lit("exact"))
    left = named.join(exact.select("event_id"), "event_id", "left_anti")
    fuzzy = _by_names(left, fixtures, days, True).withColumn("stage", F.lit("normalised"))
    rest = left.join(fuzzy.select("event_id"), "event_id", "left_anti")
    made = rest.select("event_id", tx.synthetic_id("event_id").alias("fixture_id"), F.lit("synthetic").alias("stage"))
    return exact.unionByName(fuzzy).unionByName(made)


def contained_names(names: DataFrame) -> DataFrame:
    """Pairs (name, other) where one normalised name contains the other, itself included.

    ``names``: league, name. Each name lists its own substrings (their number is bounded by
    its length) and meets equal names; no pair of a league is formed to be tested.
    """
    n = names.select("league", "name", tx.normal_name("name").alias("n")).distinct().where(F.length("n") > 0)
    size = F.length("n")
    starts = F.sequence(F.lit(1), size)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda k: F.substr(F.col("n"), i, k))))
    subs = n.select("league", F.col("name").alias("outer_name"), F.explode(F.array_distinct(parts)).alias("n"))
    hits = subs.join(n.select("league", F.col("name").alias("inner_name"), "n"), ["league", "n"]).select("league", "outer_name", "inner_name")
    both = hits.unionByName(hits.select("league", F.col("inner_name").alias("outer_name"), F.col("outer_name").alias("inner_name")))
    return both.select("league", F.col("outer_name").alias("name"), F.col("inner_name").alias("other")).distinct()


def fuzzy_alternates(fixtures: DataFrame, days: int = 3, among: DataFrame | None = None) -> DataFrame:
    """Lowest other fixture (of ``among``, else of the fixtures) of the same league within +-days whose sides' names contain, or are contained in, ours.

    Candidates are the two lowest ids per (league, home, away, date), so the fixture itself can be passed over.
    """
    among = fixtures if among is None else among
    sides = [f.select("league", F.col(s).alias("name")) for f in (fixtures, among) for s in ("home_team", "away_team")]
    alike = contained_names(reduce(DataFrame.unionByName, sides))
    keys = ["league", "home_team", "away_team", "date"]
    low = among.groupBy(*keys).agg(F.min("fixture_id").alias("_a"))
    second = among.join(low, keys).where(F.col("fixture_id") > F.col("_a")).groupBy(*keys).agg(F.min("fixture_id").alias("_b"))
    two = low.join(second, keys, "left")
    days_near = F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days)))
    # days are spread per (league, home, away, date), not per fixture
    groups = fixtures.select(*keys).distinct()
    h = alike.select("league", F.col("name").alias("home_team"), F.col("other").alias("_oh"))
    a = alike.select("league", F.col("name").alias("away_team"), F.col("other").alias("_oa"))
    cand = two.select("league", F.col("home_team").alias("_oh"), F.col("away_team").alias("_oa"), F.col("date").alias("_d"), "_a", "_b")
    near = (
        groups.withColumn("_d", days_near)
        .join(h, ["league", "home_team"])
        .join(a, ["league", "away_team"])
        .join(cand, ["league", "_oh", "_oa", "_d"])
    )
    own = (F.col("_oh") == F.col("home_team")) & (F.col("_oa") == F.col("away_team")) & (F.col("_d") == F.col("date"))
    best = near.groupBy(*keys).agg(
        F.min(F.when(~own, F.col("_a"))).alias("_other"), F.max(F.when(own, F.col("_a"))).alias("_own1"), F.max(F.when(own, F.col("_b"))).alias("_own2")
    )
    pick = F.least("_other", F.when(F.col("_own1") != F.col("fixture_id"), F.col("_own1")).otherwise(F.col("_own2")))
    return fixtures.select("fixture_id", *keys).join(best, keys).select("fixture_id", pick.alias("alt_fixture_id")).where(F.col("alt_fixture_id").isNotNull())


def quote_sources(wanted: DataFrame, fixtures: DataFrame, having: DataFrame, days: int = 3) -> DataFrame:
    """(fixture_id, source_id): whose quotes to read for each wanted fixture.

    Its own where its id is in ``having``; else those of the lowest quoted fixture with the same sides within +-days; else
    of the lowest quoted one of its league whose sides' names contain, or are contained in, its own. Others have no row.
    """
    has = durable(having.select("fixture_id").distinct())
    quoted = fixtures.join(has, "fixture_id", "left_semi")
    found = wanted.join(has, "fixture_id", "left_semi").select("fixture_id", F.col("fixture_id").alias("source_id"))
    lacking = durable(wanted.join(has, "fixture_id", "left_anti"))
    exact = durable(alternates(lacking, has, days, quoted).select("fixture_id", F.col("alt_fixture_id").alias("source_id")))
    rest = lacking.join(exact, "fixture_id", "left_anti")
    fuzzy = fuzzy_alternates(rest, days, quoted).select("fixture_id", F.col("alt_fixture_id").alias("source_id"))
    return found.unionByName(exact).unionByName(fuzzy)


def relabelled(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources' quotes under the ids of the fixtures that read them."""
    return quotes.withColumnRenamed("fixture_id", "source_id").join(sources, "source_id").drop("source_id").select(*quotes.columns)


def phantom_duplicates(fixtures: DataFrame, days: int = 3) -> DataFrame:
    """Upcoming fixtures marked ``is_synthetic`` with a real one of the same sides within +-days."""
    real = fixtures.where(~F.col("is_synthetic") & (F.col("status") != "cancelled"))
    real = real.select("home_team", "away_team", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("date"))
    phantom = fixtures.where(F.col("is_synthetic") & (F.col("status") == "upcoming"))
    return phantom.join(real.distinct(), ["home_team", "away_team", "date"], "left_semi")


def cancel(fixtures: DataFrame, phantoms: DataFrame) -> DataFrame:
    """Mark listed fixtures cancelled and their score DUP."""
    hit = fixtures.join(phantoms.select("fixture_id").withColumn("_x", F.lit(True)), "fixture_id", "left")
    return hit.withColumns(
        {
            "status": F.when(F.col("_x"), "cancelled").otherwise(F.col("status")),
            "score": F.when(F.col("_x"), "DUP").otherwise(F.col("score")),
        }
    ).drop("_x")


def missing_teams(fixtures: DataFrame, state: DataFrame, frozen: DataFrame, aliases: DataFrame) -> DataFrame:
    """Teams that play but have no state, are not mid-match and are no alias of another name."""
    teams = fixtures.select(F.explode(F.array("home_team", "away_team")).alias("team_id")).distinct()
    for known in (state.select("team_id"), frozen.select("team_id"), aliases.select(F.col("source").alias("team_id"))):
        teams = teams.join(known.distinct(), "team_id", "left_anti")
    return teams
