"""Overlaying what the market says about the next fixtures on the base ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.operators.consensus import book_probs, median_consensus
from ratewright.operators.resolve import quote_sources, relabelled
from ratewright.operators.settle import team_rows
from ratewright.operators.tables import patch, pick_by

UPCOMING = ("upcoming", "scheduled", "not_started", "tbd")


def next_fixtures(fixtures: DataFrame, as_of: Column, competition: str | None = None) -> DataFrame:
    """Earliest upcoming fixture per team: by date, unknown start first, then start and id."""
    ahead = fixtures.where(F.col("status").isin(*UPCOMING) & (F.col("date") >= as_of.cast("date")))
    if competition:
        ahead = ahead.where(F.col("competition") == competition)
    rows = team_rows(ahead.select("fixture_id", "date", "league", "commence_time", "home_team", "away_team"))
    early = F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))
    order = ["date", F.coalesce("commence_time", early), "fixture_id"]
    return pick_by(rows, ["team_id"], order, first=True)


def next_strength(next_rows: DataFrame, es: DataFrame, ratings: DataFrame) -> DataFrame:
    """Strength a team's next fixture implies: (team_id, next_fixture_id, r_next); only where it is quoted.

    ``es``: fixture_id, home_es. ``ratings``: team_id, r_network.
    """
    other = ratings.select(F.col("team_id").alias("opponent"), F.col("r_network").alias("_opp"))
    joined = next_rows.join(es.select("fixture_id", "home_es"), "fixture_id").join(other, "opponent", "left")
    own = F.when(F.col("is_home"), F.col("home_es")).otherwise(1.0 - F.col("home_es"))
    return joined.select("team_id", F.col("fixture_id").alias("next_fixture_id"), x.implied_strength(own, "_opp", "is_home").alias("_rn"))


def overlay_rows(ratings: DataFrame, nxt: DataFrame) -> DataFrame:
    """R_next, R_market, M1, published index and confidence per team.

    ``ratings``: team_id, league, b_value, r_network and, after a solve, bt_std_error.
    """
    joined = ratings.join(nxt, "team_id", "left").withColumn("r_next", F.coalesce("_rn", "r_network"))
    market = (1.0 - c.W_NEXT) * F.col("r_network") + c.W_NEXT * F.col("r_next")
    out = joined.withColumn("r_market", market).withColumn("m1_value", x.overlay("r_market", "b_value"))
    out = out.withColumn("published_index", F.col("b_value") + F.col("m1_value"))
    if "bt_std_error" in ratings.columns:
        out = out.withColumn(
            "confidence_score", x.sigma_confidence(F.coalesce("bt_std_error", F.lit(c.SIGMA_CEILING)))
        )
    return out.drop("_rn")


def refresh_state(state: DataFrame, overlay: DataFrame) -> DataFrame:
    """Write overlay columns into the state; teams frozen for a match keep their published index."""
    is_frozen = F.col("m1_locked").isNotNull() | F.col("r_market_frozen").isNotNull()
    cols = [n for n in overlay.columns if n not in ("b_value", "league")]
    return patch(state, overlay.select(*cols), ["team_id"], {"published_index": is_frozen})


def zero_market(state: DataFrame, leagues: DataFrame) -> DataFrame:
    """Leagues with too few fixtures: no overlay, market ratings fall back to B."""
    hit = state.join(leagues.select("league").distinct().withColumn("_z", F.lit(True)), "league", "left")
    z = F.coalesce("_z", F.lit(False))
    return hit.withColumns(
        {
            "m1_value": F.when(z, 0.0).otherwise(F.col("m1_value")),
            "r_market": F.when(z, F.col("b_value")).otherwise(F.col("r_market")),
            "r_next": F.when(z, F.col("b_value")).otherwise(F.col("r_next")),
            "published_index": F.when(z, F.round("b_value", 4)).otherwise(F.col("published_index")),
            "confidence_score": F.when(z, 0.0).otherwise(F.col("confidence_score")),
        }
    ).drop("_z")


def solve_audit(solved: DataFrame, edges: DataFrame, as_of: Column, trigger: str) -> DataFrame:
    """One audit row per solved league; ratings stay in long form beside it."""
    head = solved.groupBy("league").agg(
        F.max("iterations").alias("iterations"),
        F.max("max_step").alias("max_step"),
        F.bool_and("converged").alias("converged"),
        F.max("fixtures_used").alias("fixtures_used"),
        F.max("teams_count").alias("teams_count"),
        F.max("sigma_prior").alias("sigma_prior"),
    )
    windows = edges.groupBy("league").agg(
        F.max("window_days").alias("window_days"),
        F.count_if(~F.col("is_ahead")).alias("past_fixtures"),
        F.count_if("is_ahead").alias("upcoming_fixtures"),
    )
    return head.join(windows, "league").withColumns(
        {"solve_timestamp": as_of, "trigger_type": F.lit(trigger), "home_adv": F.lit(c.HOME_ADVANTAGE)}
    )


def single_fixture_overlay(state: DataFrame, next_rows: DataFrame, books: DataFrame, consensus: DataFrame, as_of: Column) -> DataFrame:
    """First-generation overlay: confidence x (fixture strength - B), bounded.

    Confidence multiplies book count, agreement on the team's win, quote age and
    distance to kickoff. Under two books, or without a next fixture, it is zero.
    """
    spread = books.groupBy("fixture_id").agg(
        (F.max("p_home") - F.min("p_home")).alias("_sh"), (F.max("p_away") - F.min("p_away")).alias("_sa")
    )
    opp = state.select(F.col("team_id").alias("opponent"), F.col("b_value").alias("_opp"))
    rows = (
        state.select("team_id", "b_value")
        .join(next_rows, "team_id", "left")
        .join(consensus, "fixture_id", "left")
        .join(spread, "fixture_id", "left")
        .join(opp, "opponent", "left")
    )
    own = F.when(F.col("is_home"), F.col("home_prob")).otherwise(F.col("away_prob"))
    es = x.expected_score(own, "draw_prob", limit=False)
    strength = x.implied_strength(es, F.coalesce("_opp", F.lit(0.0)), "is_home")
    conf = x.quote_confidence(
        "bookmaker_count", F.when(F.col("is_home"), F.col("_sh")).otherwise(F.col("_sa")), t.hours_between("latest_quote", as_of)
    )
    kick = t.kickoff_or_default("commence_time", "date", "23:59:59")
    eff = F.coalesce(conf * x.horizon_confidence(t.days_between(as_of, kick)), F.lit(0.0))
    m1 = x.clamp(F.coalesce(eff * (strength - F.col("b_value")), F.lit(0.0)), -c.OVERLAY_CLAMP, c.OVERLAY_CLAMP)
    return rows.select(
        "team_id", F.col("fixture_id").alias("next_fixture_id"), "b_value", eff.alias("confidence_score"), m1.alias("m1_value")
    ).withColumn("published_index", F.col("b_value") + F.col("m1_value"))


def season_overlay(state: DataFrame, fixtures: DataFrame, serving: DataFrame, futures: DataFrame, as_of: Column) -> DataFrame:
    """First- and second-generation overlay in and out of season: every team of the state has a row.

    A team's next fixture is priced by its own serving quotes, or those of an alternate fixture (``quote_sources``). A team
    without a next fixture takes confidence x (futures rating - B), bounded, where its futures are fresh; else zero.
    ``serving``: latest pre-kickoff quotes; ``futures``: rows of ``futures_table``.
    """
    nxt = next_fixtures(fixtures, as_of)
    only = fixtures.join(nxt.select("fixture_id").distinct(), "fixture_id", "left_semi")
    books = book_probs(relabelled(serving, quote_sources(only, fixtures, serving)))
    rows = single_fixture_overlay(state, nxt, books, median_consensus(books), as_of)
    fresh = futures.where(~F.col("stale") & (F.col("confidence") > 0)).select("team_id", "r_futures", F.col("confidence").alias("_c"))
    joined = rows.join(fresh, "team_id", "left")
    out = F.col("next_fixture_id").isNull() & F.col("_c").isNotNull()
    m1 = x.clamp(F.col("_c") * (F.col("r_futures") - F.col("b_value")), -c.OVERLAY_CLAMP, c.OVERLAY_CLAMP)
    joined = joined.withColumns({"confidence_score": F.when(out, F.col("_c")).otherwise(F.col("confidence_score")), "m1_value": F.when(out, m1).otherwise(F.col("m1_value"))})
    source = F.when(out, "futures").when(F.col("next_fixture_id").isNotNull(), "fixture").otherwise("none")
    return joined.withColumns({"published_index": F.col("b_value") + F.col("m1_value"), "overlay_source": source}).drop("_c", "r_futures")


def futures_table(futures: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """Latest futures per league within the tolerance, one row per team, with rating and confidence."""
    last = futures.groupBy("league").agg(F.max("snapshot_time").alias("_last"))
    fresh = futures.join(last, "league").where(
        t.hours_between("snapshot_time", "_last") * 60.0 <= c.FUTURES_TOLERANCE_MINUTES
    )
    rows = pick_by(fresh.drop("_last"), ["league", "team"], ["snapshot_time", "implied_prob", "volume"])
    base = state.select(F.col("team_id").alias("team"), "b_value")
    rows = rows.join(base, "team", "left")
    league = rows.groupBy("league").agg(
        F.count(F.lit(1)).alias("n_teams"), F.coalesce(F.avg("b_value"), F.lit(c.BASELINE_RATING)).alias("league_mean_b")
    )
    hours = t.hours_between("snapshot_time", as_of)
    stale = hours > c.FUTURES_STALE_HOURS
    return rows.join(league, "league").select(
        F.col("team").alias("team_id"), "league", "volume", "n_teams", "league_mean_b",
        F.col("implied_prob").alias("p_title"), stale.alias("stale"),
        F.when(stale, 0.0).otherwise(x.futures_rating("implied_prob", "n_teams", "league_mean_b")).alias("r_futures"),
        F.when(stale, 0.0).otherwise(x.futures_confidence("volume", hours)).alias("confidence"),
    )


def offseason_drift(state: DataFrame, futures: DataFrame, as_of: Column) -> DataFrame:
    """Daily pull of B to the futures rating, with the reason a team was left out.

    ``state``: team_id, league, b_value, m1_value, last_drift_at.
    """
    rows = state.join(
        futures.select("team_id", "league", "volume", "p_title", "stale", "r_futures", "confidence"), ["team_id", "league"], "left"
    )
    volume = F.when(F.coalesce("volume", F.lit(0.0)) == 0, F.col("confidence") * c.FUTURES_FULL_VOLUME).otherwise(F.col("volume"))
    step = x.clamp(c.DRIFT_LAMBDA * (F.col("r_futures") - F.col("b_value")), -c.DRIFT_CAP_PER_DAY, c.DRIFT_CAP_PER_DAY)
    reason = (
        F.when(t.hours_between("last_drift_at", as_of) < c.DRIFT_MIN_GAP_HOURS, "recent")
        .when(F.col("stale").isNull(), "no_data")
        .when(F.col("stale"), "stale")
        .when(volume < c.DRIFT_MIN_VOLUME, "volume")
        .when(F.abs(step) < c.DRIFT_TRIVIAL, "recent")
    )
    moved = rows.withColumn("skipped_reason", reason)
    delta = F.when(F.col("skipped_reason").isNull(), step).otherwise(0.0)
    return moved.withColumn("delta_b", delta).withColumns(
        {
            "b_after": F.col("b_value") + F.col("delta_b"),
            "published_index": F.col("b_value") + F.col("delta_b") + F.coalesce("m1_value", F.lit(0.0)),
        }
    )
