"""Reports: volatility, accuracy, diagnostics, rankings and served tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewright.functions import numeric as x
from ratewright.functions import text as tx
from ratewright.operators import panel as pn
from ratewright.operators import reports as rp
from ratewright.operators import settle as st
from ratewright.operators.ordered import top_per_key
from ratewright.operators import consensus as k
from ratewright.plans.consensus_queries import frozen
from ratewright.plans.panel_queries import BOOK, market, priors
from ratewright.plans.rating_queries import team_state
from ratewright.plans.registry import fragment, query, rnd, sql
from ratewright.plans.settle_queries import log_v3
from ratewright.plans.shapes import AS_OF, as_of, fixtures, quotes, table


def r(col, n=6):
    return F.round(col, n)


def rs(df, n, *names, keep=()):
    return df.select(*keep, *[r(c, n).alias(c) for c in names])


def daily_prices(spark, d):
    """Stored team prices: per team, day and model, from the order totals of that day's contests."""
    f = fixtures(spark, d).select("fixture_id", "date", "league", "home_team", "away_team")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("fixture_id"), "o_totalprice")
    rows = st.team_rows(f.join(o, "fixture_id"))
    per = rows.groupBy(F.col("team_id").alias("team"), "date").agg(F.avg("o_totalprice").alias("v"))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(i)).alias("i")) for i, m in enumerate(pn.MODELS)])
    out = per.select("team", "date", "v", F.inline(models)).join(priors(spark, d).select("team", "league"), "team")
    price = x.half_up(10.0 + F.col("v") / (6000.0 + 500.0 * F.col("i")), 2)
    return out.select("team", "league", "date", "model", price.alias("dollar_price"))


fragment(
    "dprices",
    ("fixtures", "priors"),
    """
    SELECT team, league, date, model, floor((10.0::DOUBLE + v / (6000.0::DOUBLE + 500.0::DOUBLE * i)) * 100 + 0.5) / 100 AS dollar_price FROM (
      SELECT team, date, avg(o_totalprice) AS v FROM (
        SELECT home_team AS team, date, o_totalprice FROM fixtures JOIN orders ON o_orderkey = fixture_id
        UNION ALL SELECT away_team, date, o_totalprice FROM fixtures JOIN orders ON o_orderkey = fixture_id) GROUP BY ALL)
    JOIN priors USING (team) CROSS JOIN (VALUES ('smooth', 0), ('reactive', 1), ('sharp', 2), ('oracle', 3)) m(model, i)
    """,
)
fragment(
    "changes",
    ("dprices",),
    """SELECT * FROM (SELECT *, dollar_price - lag(dollar_price) OVER w AS change, row_number() OVER w - 1 AS position FROM dprices
       WINDOW w AS (PARTITION BY team, model ORDER BY date)) WHERE change IS NOT NULL""",
)


def match_probs(spark, d):
    """Stored match probabilities of two models: prior ratings blended with the median, or the preferred book's, market."""
    p = priors(spark, d)
    models = F.array(F.struct(F.lit("smooth").alias("model"), F.lit(0.0).alias("b")), F.struct(F.lit("sharp").alias("model"), F.lit(40.0).alias("b")))
    ratings = p.select("team", F.col("prior"), F.inline(models)).select("team", "model", (F.col("prior") + F.col("b")).alias("elo"))
    f = fixtures(spark, d)
    h = ratings.select(F.col("team").alias("home_team"), "model", F.col("elo").alias("home_elo"))
    a = ratings.select(F.col("team").alias("away_team"), "model", F.col("elo").alias("away_elo"))
    j = f.select("fixture_id", "date", "home_team", "away_team").join(market(spark, d), "fixture_id").join(h, "home_team").join(a, ["away_team", "model"])
    tags, book = ("home", "draw", "away"), ["home_prob", "draw_prob", "away_prob"]
    j = j.withColumns({f"_{g}": e for g, e in zip(tags, x.blend(x.three_way("home_elo", "away_elo", 60.0), book))})
    names = ("implied_home_win", "implied_draw", "implied_away_win")
    return j.select(
        "fixture_id", "model", "date", "home_team", "away_team", *[x.half_up(f"_{g}", 4).alias(n) for g, n in zip(tags, names)],
        *[x.half_up(F.col(f"_{g}") - F.col(b), 4).alias(f"edge_{g}") for g, b in zip(tags, book)],
    )


fragment(
    "mprobs",
    ("fixtures", "priors", "medodds"),
    """
    SELECT fixture_id, model, date, home_team, away_team, floor(ch * 1e4 + 0.5) / 1e4 AS implied_home_win, floor(cd * 1e4 + 0.5) / 1e4 AS implied_draw,
           floor(ca * 1e4 + 0.5) / 1e4 AS implied_away_win, floor((ch - home_prob) * 1e4 + 0.5) / 1e4 AS edge_home,
           floor((cd - draw_prob) * 1e4 + 0.5) / 1e4 AS edge_draw, floor((ca - away_prob) * 1e4 + 0.5) / 1e4 AS edge_away
    FROM (SELECT *, (0.7 * e * (1 - dr) + 0.3 * home_prob) AS ch, (0.7 * dr + 0.3 * draw_prob) AS cd, (0.7 * (1 - e) * (1 - dr) + 0.3 * away_prob) AS ca
      FROM (SELECT *, greatest(0.05, least(0.35, 0.28 * (1 - pow(2 * abs(e - 0.5), 0.8)))) AS dr FROM (
        SELECT f.*, m.home_prob, m.draw_prob, m.away_prob, model, 1 / (1 + pow(10, (a.prior - h.prior - 60.0) / 400)) AS e
        FROM fixtures f JOIN medodds m USING (fixture_id) JOIN priors h ON h.team = home_team JOIN priors a ON a.team = away_team
        CROSS JOIN (VALUES ('smooth'), ('sharp')) v(model))))
    """,
)


@query(
    "volatility",
    sql(
        f"""SELECT model, {rnd('avg(a)', 6)} AS avg_daily_change, {rnd('stddev_pop(a)', 6)} AS daily_stdev, {rnd('avg(a) FILTER (m)', 6)} AS match_day_vol,
                   {rnd('coalesce(avg(a) FILTER (NOT m), 0)', 6)} AS non_match_day_vol, count(*) AS n_changes, count(*) FILTER (m) AS n_match_day,
                   {rnd('coalesce(avg(a) FILTER (m) / nullif(avg(a) FILTER (NOT m), 0), 0)', 4)} AS vol_ratio
            FROM (SELECT c.*, abs(change) AS a, f.team IS NOT NULL AS m FROM changes c LEFT JOIN (
              SELECT home_team AS team, date FROM fixtures WHERE status = 'finished' UNION SELECT away_team, date FROM fixtures WHERE status = 'finished') f USING (team, date))
            GROUP BY model""",
        "changes",
    ),
)
def volatility(spark, d):
    out = rp.volatility(daily_prices(spark, d), fixtures(spark, d).where(F.col("status") == "finished"))
    return out.select(
        "model", *[r(n).alias(n) for n in ("avg_daily_change", "daily_stdev", "match_day_vol", "non_match_day_vol")], "n_changes", "n_match_day", r("vol_ratio", 4).alias("vol_ratio")
    )


@query(
    "model_summary",
    sql(
        f"""SELECT model, {rnd('avg_price', 6)} AS avg_price, {rnd('s', 6)} AS daily_stdev, {rnd('m', 6)} AS max_move FROM
            (SELECT model, avg(dollar_price) AS avg_price FROM dprices GROUP BY 1) JOIN
            (SELECT model, stddev_pop(abs(change)) AS s, max(abs(change)) AS m FROM changes GROUP BY 1) USING (model)""",
        "changes",
    ),
)
def model_summary(spark, d):
    return rs(rp.model_summary(daily_prices(spark, d)), 6, "avg_price", "daily_stdev", "max_move", keep=("model",))


@query(
    "pair_correlation",
    sql(
        f"""SELECT league, model, n_teams, count(c) AS n_pairs, {rnd('coalesce(avg(c), 0)', 6)} AS avg_correlation FROM (
              SELECT league, model, a.team, b.team, CASE WHEN count(*) >= 3 THEN corr(a.change, b.change) END AS c
              FROM changes a JOIN changes b USING (league, model, position) WHERE a.team < b.team GROUP BY ALL)
            JOIN (SELECT league, model, count(DISTINCT team) AS n_teams FROM changes GROUP BY ALL) USING (league, model) GROUP BY ALL""",
        "changes",
    ),
)
def pair_correlation(spark, d):
    return rp.pair_correlation(daily_prices(spark, d)).select("league", "model", "n_teams", "n_pairs", r("avg_correlation").alias("avg_correlation"))


fragment(
    "impacts",
    ("dprices", "results"),
    """
    SELECT s.*, b.dollar_price AS price_before, a.dollar_price AS price_after, a.dollar_price - b.dollar_price AS delta FROM (
      SELECT fixture_id, date, home_team AS team, away_team AS opponent, league, score, TRUE AS is_home,
             CASE WHEN home_goals > away_goals THEN 'win' WHEN home_goals = away_goals THEN 'draw' ELSE 'loss' END AS result FROM results WHERE home_goals IS NOT NULL
      UNION ALL SELECT fixture_id, date, away_team, home_team, league, score, FALSE,
             CASE WHEN home_goals < away_goals THEN 'win' WHEN home_goals = away_goals THEN 'draw' ELSE 'loss' END FROM results WHERE home_goals IS NOT NULL) s
    JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM dprices)) t USING (date)
    JOIN (SELECT p.team, dollar_price, row_number AS i FROM dprices p JOIN (SELECT date, row_number() OVER (ORDER BY date) AS row_number FROM (SELECT DISTINCT date FROM dprices)) USING (date) WHERE model = 'oracle') b
      ON b.team = s.team AND b.i = t.i - 1
    JOIN (SELECT p.team, dollar_price, row_number AS i FROM dprices p JOIN (SELECT date, row_number() OVER (ORDER BY date) AS row_number FROM (SELECT DISTINCT date FROM dprices)) USING (date) WHERE model = 'oracle') a
      ON a.team = s.team AND a.i = t.i + 1
    """,
)


@query(
    "price_impact",
    sql(
        f"""SELECT result, count(*) AS count, {rnd('avg(delta)', 4)} AS avg_delta, {rnd('median(round(delta, 2))', 4)} AS median_delta, {rnd('min(delta)', 4)} AS min_delta,
                   {rnd('max(delta)', 4)} AS max_delta, {rnd('stddev_pop(delta)', 4)} AS stdev_delta, {rnd('avg(abs(delta))', 4)} AS avg_abs_delta FROM impacts GROUP BY result""",
        "impacts",
    ),
)
def price_impact(spark, d):
    out = rp.impact_by_result(rp.price_impact(daily_prices(spark, d), fixtures(spark, d), "oracle"))
    return rs(out, 4, "avg_delta", "median_delta", "min_delta", "max_delta", "stdev_delta", "avg_abs_delta", keep=("result", "count"))


@query(
    "top_moves",
    sql(
        """SELECT fixture_id, team, opponent, result, score, round(price_before, 2) AS price_before, round(price_after, 2) AS price_after, round(delta, 2) AS delta
           FROM impacts ORDER BY round(abs(delta), 4) DESC, fixture_id, team LIMIT 10""",
        "impacts",
    ),
)
def top_moves(spark, d):
    rows = rp.price_impact(daily_prices(spark, d), fixtures(spark, d), "oracle")
    top = rows.orderBy(F.round(F.abs("delta"), 4).desc(), "fixture_id", "team").limit(10)
    return rs(top, 2, "price_before", "price_after", "delta", keep=("fixture_id", "team", "opponent", "result", "score"))


@query(
    "top_series",
    sql(
        """SELECT team, model, date, dollar_price FROM dprices WHERE team IN (
             SELECT team FROM (SELECT team, arg_max(dollar_price, date) AS p FROM dprices WHERE model = 'oracle' GROUP BY 1) ORDER BY p DESC, team LIMIT 5)""",
        "dprices",
    ),
)
def top_series(spark, d):
    return rp.top_series(daily_prices(spark, d), "oracle", 5).select("team", "model", "date", "dollar_price")


@query(
    "brier",
    sql(
        f"""SELECT model, {rnd('avg(bh + bd + ba)', 6)} AS brier, {rnd('avg(bh)', 6)} AS brier_home, {rnd('avg(bd)', 6)} AS brier_draw, {rnd('avg(ba)', 6)} AS brier_away, count(*) AS n_matches
            FROM (SELECT model, pow(implied_home_win - CASE WHEN home_goals > away_goals THEN 1 ELSE 0 END, 2) AS bh, pow(implied_draw - CASE WHEN home_goals = away_goals THEN 1 ELSE 0 END, 2) AS bd,
                         pow(implied_away_win - CASE WHEN home_goals < away_goals THEN 1 ELSE 0 END, 2) AS ba FROM mprobs JOIN results USING (fixture_id) WHERE home_goals IS NOT NULL) GROUP BY model""",
        "mprobs",
        "results",
    ),
)
def brier(spark, d):
    return rs(rp.brier(match_probs(spark, d), fixtures(spark, d)), 6, "brier", "brier_home", "brier_draw", "brier_away", keep=("model", "n_matches"))


PEAK = "greatest(abs(edge_home), abs(edge_draw), abs(edge_away))"


@query(
    "edge_frequency",
    sql(
        f"""SELECT model, count(*) AS total_matches, count(*) FILTER (p > 0.03) AS edges_gt_3pct, count(*) FILTER (p > 0.05) AS edges_gt_5pct, count(*) FILTER (p > 0.10) AS edges_gt_10pct,
                   {rnd('100.0 * count(*) FILTER (p > 0.03) / count(*)', 2)} AS pct_gt_3, {rnd('100.0 * count(*) FILTER (p > 0.05) / count(*)', 2)} AS pct_gt_5, {rnd('100 * max(p)', 2)} AS max_edge,
                   arg_max(home_team || ' vs ' || away_team || ' (' || CAST(date AS VARCHAR) || ')', (p, -fixture_id)) AS max_edge_match
            FROM (SELECT *, {PEAK} AS p FROM mprobs) GROUP BY model""",
        "mprobs",
    ),
)
def edge_frequency(spark, d):
    out = rp.edge_frequency(match_probs(spark, d))
    return rs(out, 2, "pct_gt_3", "pct_gt_5", "max_edge", keep=("model", "total_matches", "edges_gt_3pct", "edges_gt_5pct", "edges_gt_10pct", "max_edge_match"))


@query(
    "edge_distribution",
    sql(
        f"""SELECT model, {rnd('avg(e)', 6)} AS mean_edge, {rnd('list_sort(list(e))[CAST(floor(count(*) / 2) AS BIGINT) + 1]', 4)} AS median_edge, {rnd('max(e)', 4)} AS max_edge,
                   count(*) FILTER (e > 0.03) AS gt_3pct, count(*) FILTER (e > 0.05) AS gt_5pct, count(*) AS outcomes, any_value(m) AS matches_with_edge
            FROM (SELECT model, unnest([abs(edge_home), abs(edge_draw), abs(edge_away)]) AS e FROM mprobs)
            JOIN (SELECT model, count(*) FILTER ({PEAK} > 0.03) AS m FROM mprobs GROUP BY 1) USING (model) GROUP BY model""",
        "mprobs",
    ),
)
def edge_distribution(spark, d):
    out = rp.edge_distribution(match_probs(spark, d))
    return out.select("model", r("mean_edge").alias("mean_edge"), "median_edge", "max_edge", "gt_3pct", "gt_5pct", "outcomes", "matches_with_edge")


@query(
    "top_edges",
    sql(
        """SELECT fixture_id, model, side, round(edge, 4) AS edge FROM (
             SELECT fixture_id, model, unnest(['home', 'draw', 'away']) AS side, unnest([abs(edge_home), abs(edge_draw), abs(edge_away)]) AS edge FROM mprobs)
           ORDER BY edge DESC, fixture_id, model, side LIMIT 5""",
        "mprobs",
    ),
)
def top_edges(spark, d):
    top = rp.edge_rows(match_probs(spark, d)).orderBy(F.col("edge").desc(), "fixture_id", "model", "side").limit(5)
    return top.select("fixture_id", "model", "side", r("edge", 4).alias("edge"))


@query(
    "dataset_totals",
    sql(
        """SELECT (SELECT count(*) FROM fixtures) AS matches, (SELECT count(*) FROM dprices) AS prices, (SELECT count(DISTINCT team) FROM dprices) AS teams,
                  (SELECT count(*) FROM mprobs) AS predictions, (SELECT count(DISTINCT league) FROM fixtures) AS leagues""",
        "dprices",
        "mprobs",
    ),
)
def dataset_totals(spark, d):
    one = F.count(F.lit(1))
    a = fixtures(spark, d).agg(one.alias("matches"), F.countDistinct("league").alias("leagues")).withColumn("k", F.lit(1))
    b = daily_prices(spark, d).agg(one.alias("prices"), F.countDistinct("team").alias("teams")).withColumn("k", F.lit(1))
    c = match_probs(spark, d).agg(one.alias("predictions")).withColumn("k", F.lit(1))
    return a.join(b, "k").join(c, "k").drop("k")


@query("analytics_document")
def analytics_document(spark, d):
    """All report blocks as one JSON document."""
    p = daily_prices(spark, d)
    start = F.lit("1995-01-01").cast("date")
    return rp.analytics_document(rp.analytics_blocks(p, fixtures(spark, d), match_probs(spark, d)), as_of(), start)


BLOCKS = ["volatility", "brier_scores", "arb_frequency", "cross_team_correlations", "top5_teams_by_price", "top5_daily_prices", "price_impact_by_result", "top10_price_moves"]


@query(
    "analytics_blocks",
    sql(
        f"""SELECT 'volatility' AS block, (SELECT count(DISTINCT model) FROM dprices) AS entries, NULL::DOUBLE AS value UNION ALL SELECT 'brier_scores', (SELECT count(DISTINCT model) FROM mprobs), NULL
            UNION ALL SELECT 'arb_frequency', (SELECT count(DISTINCT model) FROM mprobs), NULL UNION ALL SELECT 'cross_team_correlations', (SELECT count(*) FROM (SELECT DISTINCT league, model FROM dprices)), NULL
            UNION ALL SELECT 'top5_teams_by_price', 5, (SELECT {rnd('sum(p)', 4)} FROM (SELECT arg_max(dollar_price, date) AS p FROM dprices WHERE model = 'oracle' GROUP BY team ORDER BY p DESC LIMIT 5))
            UNION ALL SELECT 'top5_daily_prices', 5, (SELECT count(*) FROM dprices WHERE team IN (SELECT team FROM (SELECT team, arg_max(dollar_price, date) AS p FROM dprices WHERE model = 'oracle' GROUP BY 1 ORDER BY p DESC, team LIMIT 5)))
            UNION ALL SELECT 'price_impact_by_result', (SELECT count(DISTINCT result) FROM impacts), (SELECT count(*) FROM impacts)
            UNION ALL SELECT 'top10_price_moves', 10, (SELECT {rnd('sum(m)', 4)} FROM (SELECT round(abs(delta), 2) AS m FROM impacts ORDER BY round(abs(delta), 4) DESC LIMIT 10))
            UNION ALL SELECT 'totals', (SELECT count(*) FROM dprices), (SELECT count(*) FROM fixtures) + (SELECT count(*) FROM mprobs)""",
        "dprices",
        "mprobs",
        "impacts",
        "fixtures",
    ),
)
def analytics_blocks(spark, d):
    """What the document says, block by block: how many entries, and a sum over them."""
    doc = analytics_document(spark, d)

    def listed(name, kind, value):
        entries = F.from_json(F.get_json_object("document", f"$.{name}"), f"array<{kind}>")
        total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + value(e)) if value else F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("block"), F.size(entries).cast("long").alias("entries"), F.round(total, 4).alias("value"))

    values = {
        "top5_teams_by_price": ("struct<latest_price:double>", lambda e: e["latest_price"]),
        "top5_daily_prices": ("struct<models:array<struct<prices:array<struct<dollar_price:double>>>>>", lambda e: F.aggregate(e["models"], F.lit(0.0), lambda a, m: a + F.size(m["prices"]))),
        "price_impact_by_result": ("struct<count:double>", lambda e: e["count"]),
        "top10_price_moves": ("struct<delta:double>", lambda e: F.abs(e["delta"])),
    }
    rows = [listed(n, *values.get(n, ("struct<model:string>", None))) for n in BLOCKS]
    totals = F.from_json(F.get_json_object("document", "$.totals"), "struct<price_rows:long,matches:long,prediction_rows:long>")
    rows.append(F.struct(F.lit("totals").alias("block"), totals["price_rows"].alias("entries"), (totals["matches"] + totals["prediction_rows"]).cast("double").alias("value")))
    return doc.select(F.inline(F.array(*rows)))


# --- diagnostics on the settlement log ---------------------------------------------------


@query(
    "settlement_stats",
    sql(
        f"""SELECT count(*) AS total, {rnd('avg(abs(u))', 6)} AS mean_abs_surprise, {rnd('avg(u * u)', 6)} AS brier_score, {rnd('avg(abs(delta_b))', 6)} AS mean_delta,
                   {rnd('max(abs(delta_b))', 6)} AS max_delta, {rnd('avg(abs(gravity_component))', 6)} AS mean_gravity, {rnd('max(abs(gravity_component))', 6)} AS max_gravity,
                   {rnd('sum(abs(gravity_component)) / sum(abs(delta_b)) * 100', 5)} AS gravity_pct_of_delta FROM v3log""",
        "v3log",
    ),
)
def settlement_stats(spark, d):
    out = rp.settlement_stats(log_v3(spark, d))
    return out.select("total", *[r(n).alias(n) for n in ("mean_abs_surprise", "brier_score", "mean_delta", "max_delta", "mean_gravity", "max_gravity")], r("gravity_pct_of_delta", 5).alias("gravity_pct_of_delta"))


@query(
    "calibration",
    sql(
        f"""SELECT CAST(least(9, floor(e_kr * 10)) AS INTEGER) AS bucket, count(*) AS n, {rnd('avg(actual_score_s)', 6)} AS actual,
                   {rnd('any_value(least(9, floor(e_kr * 10))) * 0.1 + 0.05', 6)} AS expected FROM sides WHERE skipped_reason IS NULL GROUP BY 1""",
        "sides",
    ),
)
def calibration(spark, d):
    rows = st.settle_rows(fixtures(spark, d), frozen(spark, d))
    return rs(rp.calibration(rows), 6, "actual", "expected", keep=("bucket", "n"))


@query(
    "surprise_histogram",
    sql(
        """SELECT bin, count(u) AS n FROM (SELECT CAST(unnest(range(-10, 10)) AS INTEGER) AS bin) LEFT JOIN (
             SELECT actual_score_s - e_kr AS u FROM sides WHERE skipped_reason IS NULL) ON floor(u * 10) = bin GROUP BY bin""",
        "sides",
    ),
)
def surprise_histogram(spark, d):
    rows = st.settle_rows(fixtures(spark, d), frozen(spark, d))
    return rp.histogram(rows, F.floor((F.col("actual_score_s") - F.col("e_kr")) * 10), -10, 9)


def _hist(name, expr_sql, lo, hi, expr, where="TRUE", keep=True):
    body = (
        f"""SELECT bin, count(v) AS n FROM (SELECT CAST(unnest(range({lo}, {hi + 1})) AS INTEGER) AS bin) LEFT JOIN (SELECT {expr_sql} AS v FROM v3log WHERE {where}) ON v = bin GROUP BY bin"""
        if keep
        else f"SELECT CAST({expr_sql} AS INTEGER) AS bin, count(*) AS n FROM v3log WHERE {where} GROUP BY 1"
    )

    def fn(spark, d):
        log = log_v3(spark, d)
        if not keep:
            log = log.where(F.col("competition") == "cup")
        return rp.histogram(log, expr(), lo, hi, keep)

    query(name, sql(body, "v3log"))(fn)


_hist("gravity_histogram", "floor(gravity_component + 0.5)", -10, 10, lambda: F.floor(F.col("gravity_component") + 0.5))
_hist("delta_histogram", "floor(delta_b / 5)", -6, 5, lambda: F.floor(F.col("delta_b") / 5))
_hist("cup_delta_histogram", "floor(delta_b / 2 + 0.5)", 0, 0, lambda: F.floor(F.col("delta_b") / 2 + 0.5), "competition = 'cup'", False)


@query(
    "league_surprise",
    sql(f"SELECT league, count(*) AS n, {rnd('avg(actual_score_s - e_kr)', 6)} AS mean_surprise FROM sides WHERE skipped_reason IS NULL GROUP BY league", "sides"),
)
def league_surprise(spark, d):
    rows = rp.tag_league(st.settle_rows(fixtures(spark, d), frozen(spark, d)), fixtures(spark, d)).where(F.col("league") != "Unknown")
    return rows.groupBy("league").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("actual_score_s") - F.col("e_kr"))).alias("mean_surprise"))


@query(
    "biggest_upsets",
    sql("SELECT fixture_id, team_id, league, round(actual_score_s - e_kr, 6) + 0.0 AS surprise FROM sides WHERE skipped_reason IS NULL ORDER BY round(abs(actual_score_s - e_kr), 6) DESC, fixture_id, team_id LIMIT 10", "sides"),
)
def biggest_upsets(spark, d):
    u = F.col("actual_score_s") - F.col("e_kr")
    rows = st.settle_rows(fixtures(spark, d), frozen(spark, d)).withColumn("surprise", r(u))
    return rows.orderBy(F.abs("surprise").desc(), "fixture_id", "team_id").limit(10).select("fixture_id", "team_id", "league", "surprise")


@query(
    "gravity_corrections",
    sql("SELECT fixture_id, team_id, round(gravity_component, 4) + 0.0 AS gravity_component FROM v3log ORDER BY abs(round(gravity_component, 4)) DESC, fixture_id, team_id LIMIT 10", "v3log"),
)
def gravity_corrections(spark, d):
    rows = log_v3(spark, d).withColumn("gravity_component", r("gravity_component", 4))
    return rows.orderBy(F.abs("gravity_component").desc(), "fixture_id", "team_id").limit(10).select("fixture_id", "team_id", "gravity_component")


@query(
    "cup_stats",
    sql(
        f"""SELECT team_id, {rnd('sum(delta_b)', 5)} AS cl_delta_sum, count(*) AS cl_settled_count, {rnd('arg_max(delta_b, (date, fixture_id))', 5)} AS cl_last_delta,
                   arg_max(CASE WHEN is_home THEN team_id || ' vs ' || opponent ELSE opponent || ' vs ' || team_id END, (date, fixture_id)) AS cl_last_match,
                   count(*) FILTER (abs(gravity_component) > 0.001) AS non_zero_gravity, count(*) FILTER (actual_score_s = 1) AS wins, count(*) FILTER (actual_score_s = 0.5) AS draws,
                   count(*) FILTER (actual_score_s = 0) AS losses FROM v3log WHERE competition = 'cup' GROUP BY team_id""",
        "v3log",
    ),
)
def cup_stats(spark, d):
    log = log_v3(spark, d)
    s = F.col("actual_score_s")
    counts = log.where(F.col("competition") == "cup").groupBy("team_id").agg(
        F.count_if(F.abs("gravity_component") > 0.001).alias("non_zero_gravity"), F.count_if(s == 1).alias("wins"), F.count_if(s == 0.5).alias("draws"), F.count_if(s == 0).alias("losses")
    )
    out = rp.cup_stats(log, fixtures(spark, d)).join(counts, "team_id")
    return rs(out, 5, "cl_delta_sum", "cl_last_delta", keep=("team_id", "cl_settled_count", "cl_last_match", "non_zero_gravity", "wins", "draws", "losses"))


@query(
    "settled_pairs",
    sql(
        f"""SELECT f.fixture_id, f.league, f.home_team, f.away_team, f.score, {rnd('h.delta_b', 2)} AS home_delta_b, {rnd('a.delta_b', 2)} AS away_delta_b,
                   {rnd('h.b_after', 2)} AS home_b_after, {rnd('a.b_after', 2)} AS away_b_after, {rnd('h.gravity_component', 2)} AS home_gravity
            FROM fixtures f JOIN v3log h ON h.fixture_id = f.fixture_id AND h.is_home JOIN v3log a ON a.fixture_id = f.fixture_id AND NOT a.is_home""",
        "v3log",
    ),
)
def settled_pairs(spark, d):
    out = rp.settled_pairs(log_v3(spark, d), fixtures(spark, d))
    return rs(out.withColumnRenamed("home_gravity_component", "home_gravity"), 2, "home_delta_b", "away_delta_b", "home_b_after", "away_b_after", "home_gravity", keep=("fixture_id", "league", "home_team", "away_team", "score"))


@query(
    "rankings",
    sql(
        f"""SELECT *, row_number() OVER (ORDER BY b_value DESC, team_id) AS rank FROM (
              SELECT s.team_id, s.league, {rnd('s.b_value', 6)} AS b_value, coalesce(n, 0) AS settled_count, coalesce(trend, '') AS b_trend FROM state s LEFT JOIN (
                SELECT team_id, max(n) AS n, string_agg(printf('%.1f', b_after), ',' ORDER BY date, fixture_id) FILTER (rk <= 5) AS trend
                FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY date DESC, fixture_id DESC) AS rk, count(*) OVER (PARTITION BY team_id) AS n FROM v3log)
                GROUP BY team_id) USING (team_id))""",
        "state",
        "v3log",
    ),
)
def rankings(spark, d):
    log = log_v3(spark, d)
    counts = log.groupBy("team_id").agg(F.count(F.lit(1)).alias("settled_count"))
    last = top_per_key(log.select("team_id", "date", "fixture_id", "b_after"), ["team_id"], [F.desc("date"), F.desc("fixture_id")], 5)
    pieces = F.sort_array(F.collect_list(F.struct("date", "fixture_id", "b_after")))
    trend = last.groupBy("team_id").agg(F.array_join(F.transform(pieces, lambda z: F.format_string("%.1f", z["b_after"])), ",").alias("b_trend"))
    rows = team_state(spark, d).join(counts, "team_id", "left").join(trend, "team_id", "left")
    rows = rows.select("team_id", "league", r("b_value", 6).alias("b_value"), F.coalesce("settled_count", F.lit(0)).alias("settled_count"), F.coalesce("b_trend", F.lit("")).alias("b_trend"))
    return rp.ranked(rows, "b_value")


@query(
    "state_stats",
    sql(
        f"""SELECT count(*) AS teams, {rnd('avg(m1)', 6)} AS mean_m1, count(*) FILTER (abs(m1) >= 119) AS at_clamp, {rnd('corr(b_value, m1)', 4)} AS corr_b_m1,
                   {rnd('min(b_value + m1)', 6)} AS min_index, {rnd('max(b_value + m1)', 6)} AS max_index, {rnd('avg(b_value + m1)', 6)} AS mean_index FROM (
              SELECT *, greatest(-120.0, least(120.0, 1510 - b_value))::DOUBLE AS m1 FROM state)""",
        "state",
    ),
)
def state_stats(spark, d):
    s = team_state(spark, d).withColumn("m1", x.clamp(1510.0 - F.col("b_value"), -120.0, 120.0))
    idx = F.col("b_value") + F.col("m1")
    return s.agg(
        F.count(F.lit(1)).alias("teams"), r(F.avg("m1"), 6).alias("mean_m1"), F.count_if(F.abs("m1") >= 119).alias("at_clamp"), r(F.corr("b_value", "m1"), 4).alias("corr_b_m1"),
        r(F.min(idx), 6).alias("min_index"), r(F.max(idx), 6).alias("max_index"), r(F.avg(idx), 6).alias("mean_index"),
    )


@query(
    "league_range",
    sql(f"SELECT league, {rnd('min(b_value)', 6)} AS lo, {rnd('max(b_value)', 6)} AS hi, {rnd('avg(b_value)', 6)} AS mean, {rnd('max(b_value) - min(b_value)', 6)} AS spread FROM state GROUP BY league", "state"),
)
def league_range(spark, d):
    b = F.col("b_value")
    agg = team_state(spark, d).groupBy("league").agg(F.min(b).alias("lo"), F.max(b).alias("hi"), F.avg(b).alias("mean"), (F.max(b) - F.min(b)).alias("spread"))
    return rs(agg, 6, "lo", "hi", "mean", "spread", keep=("league",))


@query(
    "coverage",
    sql(
        """SELECT league, teams, coalesce(s, 0) AS settlements, coalesce(k, 0) AS kr_snapshots FROM (SELECT league, count(*) AS teams FROM state GROUP BY 1)
           LEFT JOIN (SELECT league, count(*) AS s FROM sides WHERE skipped_reason IS NULL GROUP BY 1) USING (league)
           LEFT JOIN (SELECT league, count(*) AS k FROM kr JOIN fixtures USING (fixture_id) GROUP BY 1) USING (league)""",
        "state",
        "sides",
        "kr",
    ),
)
def coverage(spark, d):
    f, kr = fixtures(spark, d), frozen(spark, d)
    one = F.count(F.lit(1))
    teams = team_state(spark, d).groupBy("league").agg(one.alias("teams"))
    s = st.settle_rows(f, kr).groupBy("league").agg(one.alias("settlements"))
    ks = rp.tag_league(kr.select("fixture_id"), f).groupBy("league").agg(one.alias("kr_snapshots"))
    out = teams.join(s, "league", "left").join(ks, "league", "left")
    return out.select("league", "teams", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("settlements", "kr_snapshots")])


@query(
    "consensus_quality",
    sql(
        f"""SELECT count(*) AS total, count(*) FILTER (kr_degraded) AS degraded, {rnd('avg(bookmaker_count)', 6)} AS mean_books,
                   count(*) FILTER (abs(home_expected_score - home_expected_score_raw) > 0.0001) AS raw_vs_corrected FROM kr""",
        "kr",
    ),
)
def consensus_quality(spark, d):
    gap = F.abs(F.col("home_expected_score") - F.col("home_expected_score_raw")) > 0.0001
    return frozen(spark, d).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("kr_degraded").alias("degraded"), r(F.avg("bookmaker_count")).alias("mean_books"), F.count_if(gap).alias("raw_vs_corrected")
    )


@query(
    "display_consensus",
    sql(
        f"""SELECT fixture_id, {rnd('avg(h / (h + d + a))', 6)} AS home_prob, {rnd('avg(d / (h + d + a))', 6)} AS draw_prob, {rnd('median(home_odds)', 6)} AS home_odds, count(*) AS books
            FROM (SELECT *, 1 / home_odds AS h, 1 / draw_odds AS d, 1 / away_odds AS a FROM preko) GROUP BY fixture_id""",
        "preko",
    ),
)
def display_consensus(spark, d):
    from ratewright.plans.rating_queries import serving

    return rs(k.display_consensus(serving(spark, d)), 6, "home_prob", "draw_prob", "home_odds", keep=("fixture_id", "books"))


@query(
    "team_leagues",
    sql(
        """SELECT team_id, arg_max(league, (n, league)) AS most_frequent, any_value(latest) AS latest, any_value(first_seen) AS first_seen, any_value(latest_league) AS latest_league, any_value(first_match) AS first_match
           FROM (SELECT team_id, league, count(*) AS n FROM sides GROUP BY ALL) JOIN (
             SELECT team_id, arg_max(league, (date, fixture_id)) AS latest, arg_min(league, (date, fixture_id)) AS first_seen,
                    arg_max(league, (date, fixture_id)) FILTER (competition <> 'cup') AS latest_league, min(date) AS first_match FROM sides GROUP BY 1) USING (team_id) GROUP BY team_id""",
        "sides",
    ),
)
def team_leagues(spark, d):
    rows = st.team_rows(fixtures(spark, d))
    key = F.struct("date", "fixture_id")
    most = rows.groupBy("team_id", "league").agg(F.count(F.lit(1)).alias("n")).groupBy("team_id").agg(F.max_by("league", F.struct("n", "league")).alias("most_frequent"))
    dom = F.col("competition") != "cup"
    rest = rows.groupBy("team_id").agg(
        F.max_by("league", key).alias("latest"), F.min_by("league", key).alias("first_seen"),
        F.max_by(F.when(dom, F.col("league")), F.when(dom, key)).alias("latest_league"), F.min("date").alias("first_match"),
    )
    return most.join(rest, "team_id")


@query("league_counts", sql("SELECT coalesce(league, 'All') AS league, coalesce(status, 'All') AS status, count(*) AS n FROM fixtures GROUP BY GROUPING SETS ((league, status), (league), ())", "fixtures"))
def league_counts(spark, d):
    return fixtures(spark, d).rollup("league", "status").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("league", F.lit("All")).alias("league"), F.coalesce("status", F.lit("All")).alias("status"), "n")


@query(
    "date_sections",
    sql("SELECT date, fixture_id, home_team, away_team, row_number() OVER (PARTITION BY date ORDER BY coalesce(commence_time, CAST(date AS TIMESTAMP)), fixture_id) AS place FROM fixtures", "fixtures"),
)
def date_sections(spark, d):
    return rp.sections(fixtures(spark, d)).select("date", "fixture_id", "home_team", "away_team", "place")


@query(
    "upcoming_with_impacts",
    sql(
        f"""SELECT f.fixture_id, f.league, outcome, {rnd('h.b_value', 2)} AS home_index, {rnd('(round(h.b_value, 2) - 800) / 5', 2)} AS home_price,
                   {rnd('a.b_value', 2)} AS away_index, {rnd('(round(a.b_value, 2) - 800) / 5', 2)} AS away_price,
                   floor(30 * (s - home_expected_score) / 5 * 100 + 0.5) / 100 AS delta_price_home, floor(30 * (1 - s - away_expected_score) / 5 * 100 + 0.5) / 100 AS delta_price_away
            FROM fixtures f JOIN kr USING (fixture_id) LEFT JOIN state h ON h.team_id = f.home_team LEFT JOIN state a ON a.team_id = f.away_team
            CROSS JOIN (VALUES ('home_win', 1.0::DOUBLE), ('draw', 0.5::DOUBLE), ('away_win', 0.0::DOUBLE)) o(outcome, s) WHERE f.status = 'upcoming' AND f.date >= DATE '{AS_OF[:10]}'""",
        "kr",
        "state",
    ),
)
def upcoming_with_impacts(spark, d):
    up = fixtures(spark, d).where((F.col("status") == "upcoming") & (F.col("date") >= as_of().cast("date")))
    j = up.join(frozen(spark, d), "fixture_id")
    for side in ("home", "away"):
        j = j.join(team_state(spark, d).select(F.col("team_id").alias(f"{side}_team"), r("b_value", 2).alias(f"{side}_index")), f"{side}_team", "left")
    sides = [c for s in ("home", "away") for c in (F.col(f"{s}_index"), r(x.linear_price(f"{s}_index"), 2).alias(f"{s}_price"))]
    rows = j.select("fixture_id", "league", *sides, F.inline(x.outcome_rows("home_expected_score", "away_expected_score")))
    return rows.withColumns({n: x.half_up(n, 2) for n in ("delta_price_home", "delta_price_away")})
