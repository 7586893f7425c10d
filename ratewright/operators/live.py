"""The in-play layer, kickoff locks in batch form, and one settle-solve-publish cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.operators import consensus as k
from ratewright.operators import settle as st
from ratewright.operators.resolve import relabelled
from ratewright.operators.tables import latest_quotes, pick_by
from ratewright.session import durable


def live_layer(fixtures: DataFrame, quotes: DataFrame, kr: DataFrame, as_of: Column, fresh_minutes: float, corrected: bool = True, among: DataFrame | None = None) -> DataFrame:
    """L = K(E_live - E_frozen) per side of each started fixture, with the reason where it stays zero.

    Third generation compares draw-corrected scores; earlier ones use uncorrected E_live. With ``among``, a fixture that
    nobody quotes reads the quotes of the lowest quoted one there with the same sides within three days.
    """
    if among is not None:
        ids = durable(quotes.select("fixture_id").distinct())
        own = fixtures.join(ids, "fixture_id", "left_semi").select("fixture_id", F.col("fixture_id").alias("source_id"))
        other = k.alternates(fixtures.join(ids, "fixture_id", "left_anti"), ids, among=among).select("fixture_id", F.col("alt_fixture_id").alias("source_id"))
        quotes = relabelled(quotes, own.unionByName(other))
    books = k.book_probs(latest_quotes(k.in_play(quotes, fixtures, as_of, fresh_minutes).where(x.valid_quote(*k.ODDS))))
    counts = books.groupBy("fixture_id").agg(F.count("p_home").alias("live_books"))
    agreed = k.median_consensus(books).select("fixture_id", F.col("home_prob").alias("_h"), F.col("draw_prob").alias("_d"), F.col("away_prob").alias("_a"))
    frozen = kr.select("fixture_id", "home_expected_score", "away_expected_score")
    joined = fixtures.join(frozen, "fixture_id", "left").join(counts, "fixture_id", "left").join(agreed, "fixture_id", "left")
    rows = st.team_rows(joined, {"e_kr": ("home_expected_score", "away_expected_score"), "_win": ("_h", "_a")})
    raw = x.expected_score("_win", "_d", limit=False)
    e_live = x.draw_corrected(raw, "_d") if corrected else raw
    books_n = F.coalesce("live_books", F.lit(0))
    reason = F.when(F.col("e_kr").isNull(), "no_kr_available").when(books_n < 2, "insufficient_live_books")
    live = F.when(reason.isNull(), x.live_term(e_live, "e_kr")).otherwise(0.0)
    return rows.select("fixture_id", "team_id", "is_home", "e_kr", F.when(reason.isNull(), e_live).alias("e_live"), books_n.alias("live_books"), reason.alias("freeze_reason"), live.alias("l_value"))


def kickoff_freeze(state: DataFrame, live: DataFrame) -> DataFrame:
    """Lock M1 and the market rating of teams going live, once per match."""
    on = live.select("team_id").distinct().withColumn("_on", F.lit(True))
    first = F.coalesce("_on", F.lit(False)) & F.col("m1_locked").isNull()
    market = F.round(F.coalesce("r_market", F.col("b_value") + F.coalesce("m1_value", F.lit(0.0))), 4)
    return (
        state.join(on, "team_id", "left")
        .withColumns(
            {
                "r_market_frozen": F.when(first, market).otherwise(F.col("r_market_frozen")),
                "m1_locked": F.when(first, F.coalesce("m1_value", F.lit(0.0))).otherwise(F.col("m1_locked")),
            }
        )
        .drop("_on")
    )


def publish_live(state: DataFrame, layer: DataFrame, weighted: bool = True) -> DataFrame:
    """Live index: 0.6(B+L)+0.4R_frozen, or B + locked M1 + L in earlier generations."""
    best = pick_by(layer.where(F.col("freeze_reason").isNull()), ["team_id"], ["fixture_id"]).select("team_id", "l_value")
    joined = state.drop("l_value").join(best, "team_id")
    index = x.live_index("b_value", "l_value", "r_market_frozen") if weighted else F.col("b_value") + F.coalesce("m1_locked", F.lit(0.0)) + F.col("l_value")
    return joined.select("team_id", "l_value", index.alias("published_index"))


def team_regimes(teams: DataFrame, fixtures: DataFrame, under_way: DataFrame, as_of: Column) -> DataFrame:
    """(team_id, is_live, regime): live while under way, else by the soonest upcoming fixture with a known start."""
    ahead = st.team_rows(fixtures.where("status = 'upcoming' and commence_time is not null").select("fixture_id", "commence_time", "home_team", "away_team"))
    soonest = ahead.groupBy("team_id").agg(F.min("commence_time").alias("_kick"))
    on = under_way.select("team_id").distinct().withColumn("_on", F.lit(True))
    joined = teams.select("team_id").join(soonest, "team_id", "left").join(on, "team_id", "left")
    is_live = F.coalesce("_on", F.lit(False))
    return joined.select("team_id", is_live.alias("is_live"), x.regime(is_live, t.hours_between(as_of, "_kick")).alias("regime"))


def feedback_pass(state: DataFrame, twap: DataFrame, fixtures: DataFrame, under_way: DataFrame, as_of: Column) -> DataFrame:
    """The state after the feedback of traded prices: F by regime where there is a mean price, a stale F taken back where not.

    ``state``: team_id, b_value, m1_value, l_value, m1_locked, f_value, published_index. ``twap``: team_id, twap_index. Rows
    whose index already is what it should be stay as they are.
    """
    rows = state.join(team_regimes(state, fixtures, under_way, as_of), "team_id").join(twap.select("team_id", "twap_index"), "team_id", "left")
    m1 = F.when(F.col("is_live"), F.coalesce("m1_locked", F.lit(0.0))).otherwise(F.coalesce("m1_value", F.lit(0.0)))
    rows = rows.withColumn("_naive", F.col("b_value") + m1 + F.coalesce("l_value", F.lit(0.0)))
    rows = rows.withColumn("_f", x.feedback("regime", "twap_index", "_naive"))
    moved, stale = F.col("_f") != 0, (F.col("_f") == 0) & (F.abs(F.col("published_index") - F.col("_naive")) > 0.01)
    out = {
        "f_value": F.when(moved, F.round("_f", 4)).when(stale, 0.0).otherwise(F.col("f_value")),
        "published_index": F.when(moved, F.round(F.col("_naive") + F.col("_f"), 4)).when(stale, F.round("_naive", 4)).otherwise(F.col("published_index")),
        "updated_at": F.when(moved | stale, as_of).otherwise(F.col("updated_at") if "updated_at" in state.columns else F.lit(None).cast("timestamp_ntz")),
    }
    return rows.withColumns(out).drop("is_live", "twap_index", "_naive", "_f")


def seed_state(old: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New generation's state from an older one: no overlay, every rating equal to B; and its first history rows."""
    b = F.round("b_value", 4)
    state = old.select(
        "team_id", "league", b.alias("b_value"), F.lit(0.0).alias("m1_value"), F.lit(0.0).alias("l_value"), b.alias("r_network"), b.alias("r_next"), b.alias("r_market"),
        b.alias("published_index"), F.lit(None).cast("double").alias("m1_locked"), F.lit(None).cast("double").alias("r_market_frozen"), as_of.alias("updated_at"),
    )
    rows = state.select(F.col("team_id").alias("team"), "league", as_of.alias("timestamp"), "b_value", "m1_value", "published_index", F.lit("bootstrap_v3").alias("publish_reason"))
    return state, rows


def bootstrap_rows(missing: DataFrame, futures: DataFrame) -> DataFrame:
    """Starting B of teams without a state: the futures rating where it is trusted, else the baseline."""
    j = missing.join(futures.select("team_id", "r_futures", "confidence"), "team_id", "left")
    return j.select("team_id", F.when(F.col("confidence") > 0.3, F.col("r_futures")).otherwise(c.BASELINE_RATING).alias("b_value"))
