"""Tables and pages as served to readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.functions import text as tx
from ratewright.operators.ordered import top_per_key
from ratewright.operators.resolve import canonical
from ratewright.operators.settle import team_rows
from ratewright.operators.tables import pick_by


def broken(log: DataFrame) -> DataFrame:
    """Log rows of failed settlements: a nonsensical B, or no change from nothing; with the flag."""
    bad = (F.col("b_before") < 100) | ((F.col("delta_b") == 0) & (F.col("b_before") == 0))
    return log.withColumn("broken", bad)


def current_prices(state: DataFrame, league: str | None = None) -> DataFrame:
    rows = state if league is None else state.where(F.col("league") == league)
    index = x.half_up("published_index", 2)
    return rows.select("team_id", "league", index.alias("index"), x.half_up(x.linear_price(index), 2).alias("price"))


def team_page(team: str, state: DataFrame, history: DataFrame, log: DataFrame, last: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current row, history and last settlements of one team."""
    mine = log.where(F.col("team_id") == team).orderBy(F.desc("date"), F.desc("fixture_id")).limit(last)
    return current_prices(state.where(F.col("team_id") == team)), history.where(F.col("team") == team), mine


def last_settlements(log: DataFrame, n: int = 5) -> DataFrame:
    return top_per_key(log, ["team_id"], [F.desc("date"), F.desc("fixture_id")], n)


def cup_teams(fixtures: DataFrame, log: DataFrame) -> DataFrame:
    """Teams of any cup fixture or cup settlement."""
    cup = fixtures.where(F.col("competition") == "cup").select(F.explode(F.array("home_team", "away_team")).alias("team_id"))
    return cup.unionByName(log.where(F.col("competition") == "cup").select("team_id")).distinct()


def board(fixtures: DataFrame, consensus: DataFrame, moneyline: DataFrame, as_of: Column) -> DataFrame:
    """Upcoming fixtures with display odds and the prediction market's three prices.

    One row per (home, away, date): a duplicate with quotes is preferred, then the lower id.
    ``moneyline``: fixture_id, outcomes, outcome_prices.
    """
    up = fixtures.where((F.col("status") == "upcoming") & (F.col("date") >= as_of.cast("date")))
    prices = tx.three_prices("outcome_prices", "outcomes")
    pm = moneyline.select("fixture_id", *[p.alias(n) for p, n in zip(prices, ("pm_home", "pm_draw", "pm_away"))])
    j = up.select("fixture_id", "league", "date", "home_team", "away_team").join(consensus, "fixture_id", "left").join(pm, "fixture_id", "left")
    j = j.withColumns({"_has": F.col("books").isNotNull(), "_low": -F.col("fixture_id")})
    return pick_by(j, ["home_team", "away_team", "date"], ["_has", "_low"]).drop("_has", "_low")


def link_markets(events: DataFrame, fixtures: DataFrame, aliases: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """Fixture of each unlinked "A vs. B" event, by cleaned and canonical names around the as-of day."""
    home, away = tx.title_sides("title")
    named = events.where(F.col("fixture_id").isNull()).select("event_id", "title").dropDuplicates(["event_id"])
    named = named.select("event_id", tx.market_name(home).alias("home_team"), tx.market_name(away).alias("away_team")).where(F.col("home_team") != "")
    named = canonical(canonical(named, "home_team", aliases), "away_team", aliases)
    near = fixtures.where(F.abs(F.date_diff("date", as_of.cast("date"))) <= days)
    first = pick_by(near.select("fixture_id", "home_team", "away_team", F.abs(F.date_diff("date", as_of.cast("date"))).alias("_g")), ["home_team", "away_team"], ["_g", "fixture_id"], first=True)
    return named.join(first.drop("_g"), ["home_team", "away_team"]).select("event_id", "fixture_id")


def common_fixtures(fixtures: DataFrame, home: str, away: str) -> DataFrame:
    """Ids of fixtures in which both names play."""
    rows = team_rows(fixtures.select("fixture_id", "home_team", "away_team"))
    ids = lambda n: rows.where(F.col("team_id") == n).select("fixture_id")
    return ids(home).intersect(ids(away))


def health(state: DataFrame, log: DataFrame, solves: DataFrame) -> DataFrame:
    """One row: teams, newest settlement and its fixture, newest refresh, newest solve."""
    a = state.agg(F.count(F.lit(1)).alias("teams"), F.max("updated_at").alias("latest_refresh")).withColumn("_k", F.lit(1))
    b = log.agg(F.max("date").alias("latest_settlement"), F.max_by("fixture_id", F.struct("date", "fixture_id")).alias("latest_fixture")).withColumn("_k", F.lit(1))
    s = solves.agg(F.max("solve_timestamp").alias("latest_solve")).withColumn("_k", F.lit(1))
    return a.join(b, "_k").join(s, "_k").drop("_k")


def solve_stats(solves: DataFrame) -> DataFrame:
    return solves.agg(
        F.count(F.lit(1)).alias("total"), F.max("solve_timestamp").alias("latest"), F.avg("iterations").alias("mean_iterations"), F.count_if(~F.col("converged")).alias("not_converged")
    )


def latest_solves(solves: DataFrame, edges: DataFrame, n: int = 50, league: str | None = None) -> DataFrame:
    """The newest solves, one row each with its parts: ratings, errors and priors by team, and the fixtures it used.

    The n newest are picked from (league, time) alone before any parts are gathered; a row holds one league's teams and the
    fixtures of one window.
    """
    key = ["league", "solve_timestamp"]
    mine = solves if league is None else solves.where(F.col("league") == league)
    newest = mine.select(*key).distinct().orderBy(F.desc("solve_timestamp"), "league").limit(n)
    facts = ["trigger_type", "trigger_fixture_id", "fixtures_used", "teams_count", "iterations", "max_step", "converged", "sigma_prior"]
    by_team = [F.map_from_entries(F.sort_array(F.collect_list(F.struct("team", F.round(x, 4).alias(x))))).alias(name) for x, name in (("rating", "ratings"), ("std_error", "std_errors"), ("prior", "prior_means"))]
    heads = mine.join(newest, key, "left_semi").groupBy(*key).agg(*[F.first(x).alias(x) for x in facts], *by_team)
    fixture = F.struct("fixture_id", F.col("home_team").alias("home"), F.col("away_team").alias("away"), F.round("home_es", 6).alias("home_es"), F.round("weight", 4).alias("weight"))
    used = edges.join(newest, key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(fixture)).alias("fixtures_detail"), F.max("window_days").alias("window_days"))
    return heads.join(used, key).withColumn("home_adv", F.lit(c.HOME_ADVANTAGE)).orderBy(F.desc("solve_timestamp"), "league")


def stalest(history: DataFrame, as_of: Column, n: int = 10) -> DataFrame:
    last = history.groupBy("team").agg(F.max("ts").alias("last_refresh"))
    return last.withColumn("hours_ago", t.hours_between("last_refresh", as_of)).orderBy(F.desc("hours_ago"), "team").limit(n)


def top_bottom(state: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n highest and the n lowest teams."""
    top = state.orderBy(F.desc(by), "team_id").limit(n).withColumn("end", F.lit("top"))
    return top.unionByName(state.orderBy(F.asc(by), "team_id").limit(n).withColumn("end", F.lit("bottom")))


def chart_points(history: DataFrame, log: DataFrame, fixtures: DataFrame) -> DataFrame:
    """History rows with the result, change and opponent of the settlement behind them.

    ``history``: team_id, source_fixture_id, ts, published_index, publish_reason.
    """
    done = log.select(F.col("fixture_id").alias("source_fixture_id"), "team_id", tx.result_label("actual_score_s").alias("result"), "delta_b")
    m = fixtures.select(F.col("fixture_id").alias("source_fixture_id"), "home_team", "away_team", "date")
    j = history.join(done, ["source_fixture_id", "team_id"], "left").join(m, "source_fixture_id", "left")
    return j.withColumn("opponent", F.when(F.col("home_team") == F.col("team_id"), F.col("away_team")).otherwise(F.col("home_team"))).drop("home_team", "away_team")


def impacts_displayed(fixtures: DataFrame, es: DataFrame, prices: DataFrame) -> DataFrame:
    """Per outcome and side: price change and its share of the side's price, from the given expected scores.

    ``es``: fixture_id, e_home, e_away (uncorrected, corrected or frozen). ``prices``: team_id, price.
    """
    j = fixtures.select("fixture_id", "home_team", "away_team").join(es, "fixture_id")
    for side in ("home", "away"):
        j = j.join(prices.select(F.col("team_id").alias(f"{side}_team"), F.col("price").alias(f"{side}_price")), f"{side}_team", "left")
    rows = j.select("fixture_id", "home_team", "home_price", "away_team", "away_price", F.inline(x.outcome_rows("e_home", "e_away")))
    share = lambda s: F.when(F.col(f"{s}_price") > 0, 100.0 * F.col(f"delta_price_{s}") / F.col(f"{s}_price"))
    return rows.withColumns({f"pct_{s}": share(s) for s in ("home", "away")})


def bounded(value: Column) -> Column:
    return x.clamp(value, -c.OVERLAY_CLAMP, c.OVERLAY_CLAMP)
