"""The daily four-model price panel.

Everything per fixture is summed to (team, day) before a window or a spread
over days, so windows here hold at most one row per calendar day and team.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.functions import text as tx
from ratewright.operators.settle import team_rows
from ratewright.operators.tables import pick_by

MODELS = ("smooth", "reactive", "sharp", "oracle")


def days(start: str, end: str):
    return F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))


def grid(teams: DataFrame, start: str, end: str) -> DataFrame:
    """One row per team and day, by generating days on each team's row."""
    return teams.select("team", "league", days(start, end).alias("date"))


def home_advantage(fixtures: DataFrame) -> DataFrame:
    """Home-win rate and the rating difference it stands for."""
    home, away = tx.goals_lenient("score")
    scored = fixtures.select(home.alias("h"), away.alias("a")).where(F.col("h").isNotNull() & F.col("a").isNotNull())
    agg = scored.agg(F.avg((F.col("h") > F.col("a")).cast("double")).alias("_r"), F.count(F.lit(1)).alias("matches"))
    rate = F.coalesce("_r", F.lit(c.EMPTY_HOME_RATE))
    return agg.select("matches", rate.alias("home_win_rate"), x.elo_from_probability(rate).alias("home_adv"))


def shocks(fixtures: DataFrame, odds: DataFrame, priors: DataFrame, k: float) -> DataFrame:
    """Surprise in league points per side, weighted by the opponent's strength over its league's mean."""
    home, away = tx.goals_lenient("score")
    scored = fixtures.withColumns({"hg": home, "ag": away}).where(F.col("hg").isNotNull() & F.col("ag").isNotNull())
    means = priors.groupBy("league").agg(F.avg("prior").alias("_mean"))
    home_mean = priors.join(means, "league").select(F.col("team").alias("home_team"), "_mean")
    joined = scored.select("fixture_id", "date", "home_team", "away_team", "hg", "ag").join(
        odds.select("fixture_id", "home_prob", "draw_prob", "away_prob"), "fixture_id"
    )
    joined = joined.join(home_mean, "home_team", "left")
    rows = team_rows(
        joined.withColumnRenamed("home_team", "home_team"),
        {"own": ("hg", "ag"), "other": ("ag", "hg"), "p_win": ("home_prob", "away_prob")},
    ).join(priors.select(F.col("team").alias("opponent"), F.col("prior").alias("_opp")), "opponent", "left")
    base = F.lit(c.BASELINE_RATING)
    weight = k * (1.0 + (F.coalesce("_opp", base) - F.coalesce("_mean", base)) / 400.0)
    surprise = tx.league_points("own", "other") - (3.0 * F.col("p_win") + F.col("draw_prob"))
    return rows.select(
        "fixture_id", "date", F.col("team_id").alias("team"), "opponent", F.coalesce("_opp", base).alias("opp_elo"),
        F.coalesce("_mean", base).alias("league_mean"), weight.alias("k_weighted"),
        (k * surprise).alias("shock_flat"), (weight * surprise).alias("amount"),
    )


def decayed_sum(amounts: DataFrame, on_grid: DataFrame, half_life: float, name: str) -> DataFrame:
    """Sum of amount x 0.5^(age/half_life) over all days up to each grid day.

    A prefix sum of amounts scaled up from the start of a block of 500 half-lives and
    scaled down at the reading day; of earlier blocks only the last one is above the
    smallest double. ``amounts``: team, date, amount.
    """
    span = int(500 * half_life)
    number = F.date_diff("date", F.lit("1970-01-01").cast("date"))
    per_day = amounts.groupBy("team", "date").agg(F.sum("amount").alias("_amt"))
    both = (
        on_grid.select("team", "date", F.lit(0.0).alias("_amt"), F.lit(1).alias("_grid"))
        .unionByName(per_day.withColumn("_grid", F.lit(0)))
        .groupBy("team", "date")
        .agg(F.sum("_amt").alias("_amt"), F.max("_grid").alias("_grid"))
        .withColumns({"_b": F.floor(number / span), "_n": F.pmod(number, F.lit(span))})
    )
    up = F.col("_amt") * F.pow(F.lit(2.0), F.col("_n") / half_life)
    down = F.pow(F.lit(2.0), -F.col("_n") / half_life)
    w = Window.partitionBy("team", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_run", F.sum(up).over(w))
    ends = both.groupBy("team", (F.col("_b") + 1).alias("_b")).agg(
        F.sum(F.col("_amt") * F.pow(F.lit(2.0), (F.col("_n") - span) / half_life)).alias("_carry")
    )
    total = (F.col("_run") + F.coalesce("_carry", F.lit(0.0))) * down
    return inside.where(F.col("_grid") == 1).join(ends, ["team", "_b"], "left").select("team", "date", total.alias(name))


def quote_drift(fixtures: DataFrame, quotes: DataFrame, book: str | None) -> DataFrame:
    """Per (day, team): how far quotes of the fixtures of the next 14 days have moved.

    Quotes fall into at most 15 buckets per fixture (each of the last 14 days, and all
    earlier), whose first and last quotes run on from bucket to bucket. Between two
    buckets nothing moves, so fixtures are summed per team, match day and such a span of
    days before the span is spread over its days.
    """
    reach = c.DRIFT_LOOKAHEAD_DAYS
    q = quotes.where(F.col("home_odds").isNotNull() & F.col("away_odds").isNotNull() & F.col("snapshot_time").isNotNull())
    starts = fixtures.select("fixture_id", F.col("date").alias("match_date"))
    q = q.join(starts, "fixture_id").where(F.col("snapshot_time").cast("date") < F.col("match_date"))
    bucket = F.greatest(F.col("snapshot_time").cast("date"), F.date_sub("match_date", reach))
    row = F.struct("snapshot_time", "bookmaker", "home_odds", "away_odds", "draw_odds")
    preferred = (F.col("bookmaker") == book) if book else F.lit(False)
    pref_row = F.when(preferred, row)
    buckets = q.groupBy("fixture_id", "match_date", bucket.alias("_day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(preferred).alias("pn"),
        F.min(row).alias("f"), F.max(row).alias("l"), F.min(pref_row).alias("pf"), F.max(pref_row).alias("pl"),
    )
    by_day = Window.partitionBy("fixture_id", "match_date").orderBy("_day")  # 15 rows at most
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    folds = {"n": F.sum, "pn": F.sum, "f": F.min, "l": F.max, "pf": F.min, "pl": F.max}
    until = F.date_sub(F.coalesce(F.lead("_day").over(by_day), "match_date"), 1)
    upto = buckets.select("fixture_id", "match_date", "_day", until.alias("_until"), *[fold(name).over(so_far).alias(name) for name, fold in folds.items()])
    use = F.col("pn") >= 2
    first, last = F.when(use, F.col("pf")).otherwise(F.col("f")), F.when(use, F.col("pl")).otherwise(F.col("l"))
    moved = upto.where(F.col("n") >= 2).select("fixture_id", "match_date", "_day", "_until", first.alias("f"), last.alias("l"))
    moved = moved.where(t.hours_between("f.snapshot_time", "l.snapshot_time") >= c.DRIFT_MIN_HOURS)

    def shift(side):
        early, late = F.col(f"f.{side}"), F.col(f"l.{side}")
        return F.when((early > 0) & (late > 0), c.DRIFT_SCALE * (1.0 / late - 1.0 / early))

    span = ["match_date", "_day", "_until"]
    sides = moved.select("fixture_id", *span, shift("home_odds").alias("hd"), shift("away_odds").alias("ad"))
    named = sides.join(fixtures.select("fixture_id", "home_team", "away_team"), "fixture_id")
    rows = named.select(
        *span,
        F.inline(
            F.array(
                F.struct(F.col("home_team").alias("team"), F.col("hd").alias("shift")),
                F.struct(F.col("away_team").alias("team"), F.col("ad").alias("shift")),
            )
        ),
    )
    spans = rows.where(F.col("shift").isNotNull()).groupBy("team", *span).agg(F.sum("shift").alias("shift"))
    daily = spans.select("team", "match_date", "shift", F.explode(F.sequence("_day", "_until")).alias("date"))
    weight = t.fade(F.date_diff("match_date", "date"), c.DRIFT_FADE_DAYS)
    return daily.where(weight > 0).groupBy("team", "date").agg(F.sum(F.col("shift") * weight).alias("drift"))


def played_days(fixtures: DataFrame) -> DataFrame:
    """Matches per team and day."""
    rows = team_rows(fixtures.select("fixture_id", "date", "home_team", "away_team"))
    return rows.groupBy(F.col("team_id").alias("team"), "date").agg(F.count(F.lit(1)).alias("played"))


def carry_forward(on_grid: DataFrame, played: DataFrame) -> DataFrame:
    """Last match day within the run, the share of the league gap that is kept, and matches in the trailing window."""
    first = on_grid.groupBy("team").agg(F.min("date").alias("_from"))
    early = played.join(first, "team").where(F.col("date") >= F.date_sub("_from", c.PANEL_WINDOW_DAYS)).drop("_from")
    rows = on_grid.withColumn("_grid", F.lit(1)).join(early, ["team", "date"], "full")
    number = F.date_diff("date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("team").orderBy(number)
    recent = F.coalesce(F.sum("played").over(w.rangeBetween(-c.PANEL_WINDOW_DAYS, 0)), F.lit(0)).cast("int")
    in_run = F.when(F.col("played").isNotNull() & (F.col("_grid") == 1), F.col("date"))
    last = F.last(in_run, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumns({"matches_in_window": recent, "last_match": last}).where(F.col("_grid") == 1)
    since = F.date_diff("date", "last_match")
    keep = F.when(F.coalesce(since, F.lit(0)) == 0, 1.0).otherwise(F.greatest(F.lit(c.CARRY_FLOOR), 1.0 - c.CARRY_DECAY * since))
    return out.select("team", "league", "date", "last_match", keep.alias("keep"), "matches_in_window")


def ema(series: DataFrame, keys: list[str], value: str, span: int = c.EMA_SPAN, name: str = "ema") -> DataFrame:
    """Exponential average rounded to cents at every step; the fold runs over one key's calendar days."""
    a = 2.0 / (span + 1)
    rest = [n for n in series.columns if n not in keys]
    rows = F.sort_array(F.collect_list(F.struct("date", *[n for n in rest if n != "date"])))

    def step(acc, row):
        prev = acc[F.size(acc) - 1]
        nxt = F.when(F.size(acc) == 0, row[value]).otherwise(x.half_up(a * row[value] + (1 - a) * prev, 2))
        return F.concat(acc, F.array(nxt))

    folded = series.groupBy(*keys).agg(rows.alias("_r"))
    folded = folded.withColumn("_e", F.aggregate("_r", F.array().cast("array<double>"), step))
    pairs = folded.select(*keys, F.explode(F.arrays_zip("_r", "_e")).alias("_z"))
    return pairs.select(*keys, *[F.col(f"_z._r.{n}").alias(n) for n in rest], F.col("_z._e").alias(name))


def model_ratings(base: DataFrame, outright: DataFrame) -> DataFrame:
    """Per (team, day): the four models' ratings.

    ``base``: team, league, date, keep, matches_in_window, median_rating, sharp_rating, drift,
    boost_reactive, boost_oracle.
    """
    w = Window.partitionBy("league", "date")
    mean = F.avg("median_rating").over(w)
    settled = base.withColumn("_mean", mean)

    def pulled(col):
        return F.col("_mean") + (F.col(col) - F.col("_mean")) * F.col("keep")

    joined = settled.withColumns({"_med": pulled("median_rating"), "_shp": pulled("sharp_rating")}).join(
        outright.select("team", "title_elo"), "team", "left"
    )
    blended = F.when(
        F.col("title_elo").isNotNull(),
        (1.0 - c.OUTRIGHT_WEIGHT) * F.col("_shp") + c.OUTRIGHT_WEIGHT * F.col("title_elo"),
    ).otherwise(F.col("_shp"))
    elo = {
        "smooth": F.col("_med") + F.col("drift"),
        "reactive": F.col("_med") + F.col("boost_reactive") + F.col("drift"),
        "sharp": F.col("_shp") + F.col("drift"),
        "oracle": blended + F.col("boost_oracle") + F.col("drift"),
    }
    models = F.array(*[F.struct(F.lit(m).alias("model"), e.alias("elo")) for m, e in elo.items()])
    return joined.select("team", "league", "date", "drift", "matches_in_window", F.inline(models))


def prices(ratings: DataFrame) -> DataFrame:
    """Published panel rows: rating, price, averaged price, confidence."""
    raw = ratings.select(
        "team", "league", "model", "date",
        x.half_up("elo", 1).alias("implied_elo"),
        x.half_up(x.logistic_price("elo"), 2).alias("dollar_price"),
        F.least(F.lit(1.0), F.col("matches_in_window") / 10.0).alias("confidence"),
        "matches_in_window",
        x.half_up("drift", 1).alias("drift_elo"),
    )
    return ema(raw, ["team", "league", "model"], "dollar_price", name="ema_dollar_price")


def match_probabilities(fixtures: DataFrame, ratings: DataFrame, market: DataFrame, home_adv) -> DataFrame:
    """Blended three-way probabilities and edges for fixtures quoted on their day. ``ratings``: team, date, model, elo."""
    h = ratings.select(F.col("team").alias("home_team"), "date", "model", F.col("elo").alias("home_elo"))
    a = ratings.select(F.col("team").alias("away_team"), "date", "model", F.col("elo").alias("away_elo"))
    joined = (
        fixtures.select("fixture_id", "date", "home_team", "away_team")
        .join(market.select("fixture_id", "home_prob", "draw_prob", "away_prob"), "fixture_id")
        .join(h, ["home_team", "date"])
        .join(a, ["away_team", "date", "model"])
    )
    book = ["home_prob", "draw_prob", "away_prob"]
    mixed = x.blend(x.three_way("home_elo", "away_elo", home_adv), book)
    tags = ("home", "draw", "away")
    out = joined.withColumns({f"_{g}": m for g, m in zip(tags, mixed)})
    r4 = lambda e: x.half_up(e, 4)
    implied = {"home": "implied_home_win", "draw": "implied_draw", "away": "implied_away_win"}
    cols = [r4(f"_{g}").alias(implied[g]) for g in tags]
    cols += [r4(b).alias(implied[g].replace("implied", "bookmaker")) for g, b in zip(tags, book)]
    cols += [r4(F.col(f"_{g}") - F.col(b)).alias(f"edge_{g}") for g, b in zip(tags, book)]
    return out.select("fixture_id", "model", "date", "home_team", "away_team", *cols)


def title_ratings(outrights: DataFrame) -> DataFrame:
    """Latest title probability per team, scaled within its league, as a rating. ``outrights``: league, team, implied_prob, snapshot_time."""
    latest = pick_by(outrights, ["team"], ["snapshot_time", "implied_prob"])
    sums = latest.groupBy("league").agg(F.sum("implied_prob").alias("_t"), F.count(F.lit(1)).alias("_n"))
    joined = latest.join(sums.where(F.col("_t") > 0), "league")
    return joined.select("league", "team", x.title_rating(F.col("implied_prob") / F.col("_t"), "_n").alias("title_elo"))


def legacy_priors(teams: DataFrame, history: DataFrame, aliases: DataFrame) -> DataFrame:
    """Last rating of each team's older name, or the baseline. ``aliases``: team, legacy_name."""
    named = teams.join(aliases, "team", "left").withColumn("legacy_name", F.coalesce("legacy_name", "team"))
    last = pick_by(history, ["legacy_name"], ["date", "rating"])
    joined = named.join(last.select("legacy_name", "rating"), "legacy_name", "left")
    return joined.select(*teams.columns, F.coalesce("rating", F.lit(c.BASELINE_RATING)).alias("prior"))
