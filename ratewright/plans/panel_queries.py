"""The daily four-model panel and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.operators import bradley_terry as bt
from ratewright.operators import consensus as k
from ratewright.operators import panel as pn
from ratewright.operators import settle as st
from ratewright.plans.rating_queries import futures
from ratewright.plans.registry import fragment, query, rnd, sql
from ratewright.plans.shapes import fixtures, quotes, table
from ratewright.session import durable

START, END = "1995-01-01", "2001-08-31"
BOOK = "book_1"


def r(col, n=6):
    return F.round(col, n)


def priors(spark, d):
    """Team, league and prior rating; the league is the nation's region."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(
        F.col("n_name").alias("team"), F.col("r_name").alias("league"), (1400.0 + 8.0 * F.col("n_nationkey")).alias("prior")
    )


def pre_quotes(spark, d):
    return k.days_out(quotes(spark, d), fixtures(spark, d))


def market(spark, d, book=None):
    return k.preferred_consensus(pre_quotes(spark, d), book)


fragment(
    "priors",
    (),
    "SELECT n_name AS team, r_name AS league, 1400.0::DOUBLE + 8.0::DOUBLE * n_nationkey AS prior FROM nation JOIN region ON n_regionkey = r_regionkey",
)
fragment(
    "preq",
    ("starts", "quotes"),
    "SELECT q.*, s.kickoff FROM quotes q JOIN starts s USING (fixture_id) WHERE greatest(0, floor((epoch_us(s.kickoff) - epoch_us(q.snapshot_time)) / 8.64e10 + 0.5)) = 1",
)
for name, preferred in (("medodds", "FALSE"), ("prefodds", f"bookmaker = '{BOOK}'")):
    fragment(
        name,
        ("preq",),
        f"""
        SELECT fixture_id, h / (h + d + a) AS home_prob, d / (h + d + a) AS draw_prob, a / (h + d + a) AS away_prob FROM (
          SELECT fixture_id, coalesce(avg(1 / home_odds) FILTER ({preferred}), median(1 / home_odds)) AS h,
                 coalesce(avg(1 / draw_odds) FILTER ({preferred}), median(1 / draw_odds)) AS d,
                 coalesce(avg(1 / away_odds) FILTER ({preferred}), median(1 / away_odds)) AS a
          FROM preq WHERE home_odds > 1 AND draw_odds > 1 AND away_odds > 1 GROUP BY fixture_id)
        """,
    )
fragment(
    "homeadv",
    ("fixtures",),
    """
    SELECT n AS matches, rate AS home_win_rate, -400 * log10(1 / greatest(0.001, least(0.999, rate)) - 1) AS home_adv FROM (
      SELECT count(*) AS n, coalesce(avg(CASE WHEN h > a THEN 1.0 ELSE 0.0 END), 0.46)::DOUBLE AS rate
      FROM (SELECT TRY_CAST(split_part(score, '-', 1) AS INTEGER) AS h, TRY_CAST(split_part(score, '-', 2) AS INTEGER) AS a FROM fixtures)
      WHERE h IS NOT NULL AND a IS NOT NULL)
    """,
)
for name, source, kk in (("shocks_r", "medodds", 32), ("shocks_o", "prefodds", 20)):
    fragment(
        name,
        ("fixtures", "priors", source),
        f"""
        SELECT fixture_id, date, team, opponent, opp_elo, mean AS league_mean, {kk} * (1 + (opp_elo - mean) / 400) AS k_weighted,
               {kk} * s AS shock_flat, {kk} * (1 + (opp_elo - mean) / 400) * s AS amount
        FROM (SELECT x.*, po.prior AS opp_elo, m.mean,
                     CASE WHEN own > other THEN 3 WHEN own = other THEN 1 ELSE 0 END - (3 * pw + pd) AS s
              FROM (SELECT fixture_id, date, home_team AS team, away_team AS opponent, h AS own, a AS other, home_prob AS pw, draw_prob AS pd, home_team FROM sc
                    UNION ALL SELECT fixture_id, date, away_team, home_team, a, h, away_prob, draw_prob, home_team FROM sc) x
              JOIN priors po ON po.team = x.opponent JOIN priors ph ON ph.team = x.home_team
              JOIN (SELECT league, avg(prior) AS mean FROM priors GROUP BY 1) m ON m.league = ph.league)
        """.replace(
            "FROM sc",
            f"""FROM (SELECT f.*, home_prob, draw_prob, away_prob, TRY_CAST(split_part(score, '-', 1) AS INTEGER) AS h,
                             TRY_CAST(split_part(score, '-', 2) AS INTEGER) AS a FROM fixtures f JOIN {source} USING (fixture_id) WHERE status = 'finished')""",
        ),
    )
fragment(
    "grid",
    ("priors",),
    f"SELECT team, league, CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS date FROM priors",
)


@query("home_advantage", sql(f"SELECT matches, {rnd('home_win_rate', 6)} AS home_win_rate, {rnd('home_adv', 6)} AS home_adv FROM homeadv", "homeadv"))
def home_advantage(spark, d):
    return pn.home_advantage(fixtures(spark, d)).select(
        "matches", r("home_win_rate").alias("home_win_rate"), r("home_adv").alias("home_adv")
    )


@query("consensus_median", sql(f"SELECT fixture_id, {rnd('home_prob', 6)} AS home_prob, {rnd('draw_prob', 6)} AS draw_prob, {rnd('away_prob', 6)} AS away_prob FROM medodds", "medodds"))
def consensus_median(spark, d):
    return market(spark, d).select("fixture_id", *[r(p).alias(p) for p in ("home_prob", "draw_prob", "away_prob")])


@query("consensus_preferred_book", sql(f"SELECT fixture_id, {rnd('home_prob', 6)} AS home_prob, {rnd('draw_prob', 6)} AS draw_prob, {rnd('away_prob', 6)} AS away_prob FROM prefodds", "prefodds"))
def consensus_preferred_book(spark, d):
    return market(spark, d, BOOK).select("fixture_id", *[r(p).alias(p) for p in ("home_prob", "draw_prob", "away_prob")])


@query(
    "surprise_shocks",
    sql(f"SELECT fixture_id, team, opponent, {rnd('k_weighted', 6)} AS k_weighted, {rnd('shock_flat', 6)} AS shock_flat, {rnd('amount', 6)} AS amount FROM shocks_r", "shocks_r"),
)
def surprise_shocks(spark, d):
    rows = pn.shocks(fixtures(spark, d), market(spark, d), priors(spark, d), c.SHOCK_K_REACTIVE)
    return rows.select("fixture_id", "team", "opponent", r("k_weighted").alias("k_weighted"), r("shock_flat").alias("shock_flat"), r("amount").alias("amount"))


@query(
    "top_shock_examples",
    sql(
        f"""SELECT fixture_id, team, {rnd('k_weighted', 4)} AS k_weighted, {rnd('amount', 4)} AS amount FROM shocks_o WHERE abs(shock_flat) > 1
            ORDER BY round(abs(k_weighted - 20), 6) DESC, fixture_id, team LIMIT 5""",
        "shocks_o",
    ),
)
def top_shock_examples(spark, d):
    rows = pn.shocks(fixtures(spark, d), market(spark, d, BOOK), priors(spark, d), c.SHOCK_K_ORACLE)
    gap = F.round(F.abs(F.col("k_weighted") - c.SHOCK_K_ORACLE), 6)
    top = rows.where(F.abs("shock_flat") > 1).orderBy(gap.desc(), "fixture_id", "team").limit(5)
    return top.select("fixture_id", "team", r("k_weighted", 4).alias("k_weighted"), r("amount", 4).alias("amount"))


@query(
    "shock_decay",
    sql(
        f"""SELECT g.team, g.date, {rnd('coalesce(sum(amount * pow(0.5, date_diff(\'day\', s.date, g.date) / 7.0)), 0)', 4)} AS boost
            FROM grid g LEFT JOIN (SELECT team, date, sum(amount) AS amount FROM shocks_r GROUP BY ALL) s ON s.team = g.team AND s.date <= g.date
            GROUP BY g.team, g.date""",
        "grid",
        "shocks_r",
    ),
)
def shock_decay(spark, d):
    rows = pn.shocks(fixtures(spark, d), market(spark, d), priors(spark, d), c.SHOCK_K_REACTIVE)
    out = pn.decayed_sum(rows, pn.grid(priors(spark, d), START, END), c.SHOCK_HL_REACTIVE, "boost")
    return out.select("team", "date", r("boost", 4).alias("boost"))


fragment(
    "drift",
    ("fixtures", "quotes"),
    f"""
    SELECT team, date, sum(400 * w * (1 / l - 1 / e)) AS drift FROM (
      SELECT g.*, greatest(0.0, least(1.0, (date_diff('day', date, match_date) - 1) / 7.0)) AS w, home_team AS team, f.home_odds AS e, l2.home_odds AS l
      FROM dr g UNION ALL
      SELECT g.*, greatest(0.0, least(1.0, (date_diff('day', date, match_date) - 1) / 7.0)), away_team, f.away_odds, l2.away_odds FROM dr g)
    WHERE w > 0 AND e > 0 AND l > 0 GROUP BY team, date
    """.replace(
        "FROM dr g",
        f"""FROM (SELECT fixture_id, match_date, date, home_team, away_team,
                CASE WHEN count(*) FILTER (p) >= 2 THEN arg_min(rw, k) FILTER (p) ELSE arg_min(rw, k) END AS f,
                CASE WHEN count(*) FILTER (p) >= 2 THEN arg_max(rw, k) FILTER (p) ELSE arg_max(rw, k) END AS l2
              FROM (SELECT x.fixture_id, x.date AS match_date, x.home_team, x.away_team, CAST(x.date - n.n AS DATE) AS date, bookmaker = '{BOOK}' AS p,
                           {{'home_odds': home_odds, 'away_odds': away_odds, 'ts': snapshot_time}} AS rw,
                           (snapshot_time, bookmaker, home_odds, away_odds, draw_odds) AS k
                    FROM fixtures x CROSS JOIN (SELECT CAST(unnest(range(1, 15)) AS INTEGER) AS n) n JOIN quotes q USING (fixture_id)
                    WHERE CAST(q.snapshot_time AS DATE) <= x.date - n.n)
              GROUP BY ALL HAVING count(*) >= 2) g WHERE epoch_us(l2.ts) - epoch_us(f.ts) >= 12 * 3.6e9""",
    ),
)


@query("quote_drift", sql(f"SELECT team, date, {rnd('drift', 6)} AS drift FROM drift", "drift"))
def quote_drift(spark, d):
    return pn.quote_drift(fixtures(spark, d), quotes(spark, d), BOOK).select("team", "date", r("drift").alias("drift"))


fragment(
    "playdays",
    ("fixtures",),
    """SELECT team, date, count(*) AS played FROM (SELECT home_team AS team, date FROM fixtures UNION ALL SELECT away_team, date FROM fixtures) GROUP BY ALL""",
)
fragment(
    "carry",
    ("grid", "playdays"),
    """
    SELECT *, CASE WHEN coalesce(date_diff('day', last_match, date), 0) = 0 THEN 1.0::DOUBLE
                   ELSE greatest(0.5, 1 - 0.005 * date_diff('day', last_match, date))::DOUBLE END AS keep
    FROM (SELECT g.team, g.league, g.date,
                 last_value(CASE WHEN played IS NOT NULL THEN g.date END IGNORE NULLS) OVER (PARTITION BY g.team ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS last_match,
                 CAST(coalesce(sum(played) OVER (PARTITION BY g.team ORDER BY g.date RANGE BETWEEN INTERVAL 60 DAYS PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS matches_in_window
          FROM grid g LEFT JOIN playdays p ON p.team = g.team AND p.date = g.date)
    """,
)


@query("carry_forward", sql("SELECT team, league, date, coalesce(last_match, DATE '1900-01-01') AS last_match, round(keep, 6) AS keep, matches_in_window FROM carry", "carry"))
def carry_forward(spark, d):
    out = pn.carry_forward(pn.grid(priors(spark, d), START, END), pn.played_days(fixtures(spark, d)))
    never = F.lit("1900-01-01").cast("date")
    return out.select("team", "league", "date", F.coalesce("last_match", never).alias("last_match"), r("keep").alias("keep"), "matches_in_window")


def ema_series(spark, d):
    ev = table(spark, d, "events")
    daily = ev.groupBy(
        F.concat(F.lit("TEAM_"), F.col("user_id").cast("string")).alias("team"), F.col("ts").cast("date").alias("date")
    ).agg((F.floor(F.avg("value") * 100 + 0.5) / 100).alias("price"))
    return pn.ema(daily, ["team"], "price").select("team", "date", "price", "ema")


fragment(
    "emain",
    (),
    """SELECT *, row_number() OVER (PARTITION BY team ORDER BY date) AS rn FROM (
         SELECT 'TEAM_' || CAST(user_id AS VARCHAR) AS team, CAST(ts AS DATE) AS date, floor(avg(value) * 100 + 0.5) / 100 AS price FROM events GROUP BY ALL)""",
)
fragment(
    "emarun(team, rn, ema)",
    ("emain",),
    """SELECT team, rn, price FROM emain WHERE rn = 1 UNION ALL
       SELECT n.team, n.rn, floor((2.0::DOUBLE / 6 * n.price + (1 - 2.0::DOUBLE / 6) * p.ema) * 100 + 0.5) / 100 FROM emarun p JOIN emain n ON n.team = p.team AND n.rn = p.rn + 1""",
)
query("ema_series", sql("SELECT team, date, price, ema FROM emain JOIN emarun USING (team, rn)", "emarun"))(ema_series)


@query(
    "title_ratings",
    sql(
        f"""SELECT league, team, {rnd('1500 + 400 * log10(greatest(0.001, implied_prob / t) * n)', 6)} AS title_elo FROM (
              SELECT *, sum(implied_prob) OVER (PARTITION BY league) AS t, count(*) OVER (PARTITION BY league) AS n FROM (
                SELECT *, row_number() OVER (PARTITION BY team ORDER BY snapshot_time DESC, implied_prob DESC) AS rn FROM futures) WHERE rn = 1)""",
        "futures",
    ),
)
def title_ratings(spark, d):
    return pn.title_ratings(futures(spark, d)).select("league", "team", r("title_elo").alias("title_elo"))


# --- batch ratings -------------------------------------------------------------------


def observed(spark, d, book):
    f = fixtures(spark, d).select("fixture_id", "date", "home_team", "away_team")
    return f.join(market(spark, d, book).select("fixture_id", F.col("home_prob").alias("obs")), "fixture_id")


def batch(spark, d, book, passes=c.PANEL_PASSES):
    adv = pn.home_advantage(fixtures(spark, d)).first()["home_adv"]
    return bt.daily_ratings(observed(spark, d, book), priors(spark, d), START, END, adv, passes)


for name, source in (("btm", "medodds"), ("bts", "prefodds")):
    fragment(
        f"{name}_edges",
        ("fixtures", source),
        f"""
        SELECT as_of, home_team, away_team, sum(n * w) AS w, sum(o * w) AS ws FROM (
          SELECT CAST(unnest(generate_series(date, least(date + 60, DATE '{END}'), INTERVAL 1 DAY)) AS DATE) AS as_of, *, pow(0.5, date_diff('day', date, as_of) / 14.0) AS w
          FROM (SELECT date, home_team, away_team, count(*) AS n, sum(home_prob) AS o FROM fixtures JOIN {source} USING (fixture_id) GROUP BY ALL))
        GROUP BY ALL
        """,
    )
    fragment(
        f"{name}_run(i, as_of, team, r)",
        (f"{name}_edges", "grid", "priors", "homeadv"),
        f"""
        SELECT 0, as_of, team, prior FROM (SELECT DISTINCT as_of FROM {name}_edges) CROSS JOIN priors
        UNION ALL
        SELECT i + 1, as_of, team, u - avg(u) OVER (PARTITION BY as_of) + 1500 FROM (
          SELECT x.i, x.as_of, x.team, 0.85 * (x.r + CASE WHEN due > 0.001 THEN 40 * ln(seen / due) ELSE 0 END) + 0.15 * p.prior AS u
          FROM (SELECT c.i, c.as_of, c.team, c.r, coalesce(s.due, 0) AS due, s.seen FROM {name}_run c LEFT JOIN (
                  SELECT as_of, team, sum(due) AS due, sum(seen) AS seen FROM (
                    SELECT e.as_of, unnest([e.home_team, e.away_team]) AS team, unnest([w * q, w * (1 - q)]) AS due, unnest([ws, w - ws]) AS seen
                    FROM (SELECT e.*, 1 / (1 + pow(10, (v.r - h.r - (SELECT home_adv FROM homeadv)) / 400)) AS q FROM {name}_edges e
                          JOIN {name}_run h ON h.as_of = e.as_of AND h.team = e.home_team
                          JOIN {name}_run v ON v.as_of = e.as_of AND v.team = e.away_team) e)
                  GROUP BY ALL) s USING (as_of, team) WHERE c.i < 50) x
          JOIN priors p USING (team))
        """,
    )
    fragment(
        f"{name}",
        (f"{name}_run", "grid"),
        f"""SELECT g.date, g.team, g.league, coalesce(r.r, p.prior) AS rating FROM grid g JOIN priors p USING (team)
            LEFT JOIN {name}_run r ON r.as_of = g.date AND r.team = g.team AND r.i = 50""",
    )


@query("bt_batch", sql(f"SELECT date AS as_of, team, {rnd('rating', 4)} AS rating FROM btm", "btm"))
def bt_batch(spark, d):
    return batch(spark, d, None).select("as_of", "team", r("rating", 4).alias("rating"))


@query("league_means", sql(f"SELECT date AS as_of, league, {rnd('avg(rating)', 4)} AS mean_rating FROM btm GROUP BY ALL", "btm"))
def league_means(spark, d):
    rows = batch(spark, d, None).join(priors(spark, d).select("team", "league"), "team")
    return rows.groupBy("as_of", "league").agg(r(F.avg("rating"), 4).alias("mean_rating"))


def model_ratings(spark, d):
    adv = pn.home_advantage(fixtures(spark, d)).first()["home_adv"]
    f, p = fixtures(spark, d), priors(spark, d)
    # Five steps read the market: the quotes behind it are picked once.
    day_before = durable(pre_quotes(spark, d))
    med, pref = k.preferred_consensus(day_before, None), k.preferred_consensus(day_before, BOOK)
    on_grid = pn.grid(p, START, END)

    def rated(odds, name):
        obs = f.select("fixture_id", "date", "home_team", "away_team").join(
            odds.select("fixture_id", F.col("home_prob").alias("obs")), "fixture_id"
        )
        out = bt.daily_ratings(obs, p, START, END, adv)
        return out.select(F.col("as_of").alias("date"), "team", F.col("rating").alias(name))

    zero = F.lit(0.0)
    base = (
        pn.carry_forward(on_grid, pn.played_days(f))
        .join(rated(med, "median_rating"), ["team", "date"])
        .join(rated(pref, "sharp_rating"), ["team", "date"])
        .join(pn.quote_drift(f, quotes(spark, d), BOOK), ["team", "date"], "left")
        .join(pn.decayed_sum(pn.shocks(f, med, p, c.SHOCK_K_REACTIVE), on_grid, c.SHOCK_HL_REACTIVE, "boost_reactive"), ["team", "date"], "left")
        .join(pn.decayed_sum(pn.shocks(f, pref, p, c.SHOCK_K_ORACLE), on_grid, c.SHOCK_HL_ORACLE, "boost_oracle"), ["team", "date"], "left")
    )
    base = base.withColumns({n: F.coalesce(n, zero) for n in ("drift", "boost_reactive", "boost_oracle")})
    return pn.model_ratings(base, pn.title_ratings(futures(spark, d))), adv, med


fragment(
    "elos",
    ("btm", "bts", "carry", "drift", "shocks_r", "shocks_o", "futures"),
    """
    SELECT team, league, date, drift, matches_in_window, unnest(['smooth', 'reactive', 'sharp', 'oracle']) AS model,
           unnest([med + drift, med + br + drift, shp + drift, CASE WHEN title IS NULL THEN shp ELSE 0.85 * shp + 0.15 * title END + bo + drift]) AS elo
    FROM (SELECT c.team, c.league, c.date, c.matches_in_window, coalesce(dr.drift, 0) AS drift, coalesce(sr.b, 0) AS br, coalesce(so.b, 0) AS bo,
                 mean + (m.rating - mean) * keep AS med, mean + (s.rating - mean) * keep AS shp, tt.title
          FROM carry c JOIN (SELECT *, avg(rating) OVER (PARTITION BY league, date) AS mean FROM btm) m USING (team, date)
          JOIN bts s USING (team, date) LEFT JOIN drift dr USING (team, date)
          LEFT JOIN (SELECT g.team, g.date, sum(amount * pow(0.5, date_diff('day', s.date, g.date) / 7.0)) AS b FROM grid g
                     JOIN (SELECT team, date, sum(amount) AS amount FROM shocks_r GROUP BY ALL) s ON s.team = g.team AND s.date <= g.date GROUP BY ALL) sr USING (team, date)
          LEFT JOIN (SELECT g.team, g.date, sum(amount * pow(0.5, date_diff('day', s.date, g.date) / 10.0)) AS b FROM grid g
                     JOIN (SELECT team, date, sum(amount) AS amount FROM shocks_o GROUP BY ALL) s ON s.team = g.team AND s.date <= g.date GROUP BY ALL) so USING (team, date)
          LEFT JOIN (SELECT team, 1500 + 400 * log10(greatest(0.001, implied_prob / t) * n) AS title FROM (
              SELECT *, sum(implied_prob) OVER (PARTITION BY league) AS t, count(*) OVER (PARTITION BY league) AS n FROM (
                SELECT *, row_number() OVER (PARTITION BY team ORDER BY snapshot_time DESC, implied_prob DESC) AS rn FROM futures) WHERE rn = 1)) tt USING (team))
    """,
)
fragment(
    "pricerows",
    ("elos",),
    """SELECT *, floor(100 / (1 + exp(-(elo - 1500) / 220)) * 100 + 0.5) / 100 AS dollar_price, floor(elo * 10 + 0.5) / 10 AS implied_elo,
              least(1.0, matches_in_window / 10.0)::DOUBLE AS confidence, row_number() OVER (PARTITION BY team, model ORDER BY date) AS rn FROM elos""",
)
fragment(
    "emaprice(team, model, rn, ema)",
    ("pricerows",),
    """SELECT team, model, rn, dollar_price FROM pricerows WHERE rn = 1 UNION ALL
       SELECT n.team, n.model, n.rn, floor((2.0::DOUBLE / 6 * n.dollar_price + (1 - 2.0::DOUBLE / 6) * p.ema) * 100 + 0.5) / 100
       FROM emaprice p JOIN pricerows n ON n.team = p.team AND n.model = p.model AND n.rn = p.rn + 1""",
)


@query(
    "panel_prices",
    sql(
        """SELECT team, league, model, date, implied_elo, dollar_price, ema AS ema_dollar_price, confidence, matches_in_window
           FROM pricerows JOIN emaprice USING (team, model, rn)""",
        "emaprice",
    ),
)
def panel_prices(spark, d):
    ratings, _, _ = model_ratings(spark, d)
    return pn.prices(ratings).select(
        "team", "league", "model", "date", "implied_elo", "dollar_price", "ema_dollar_price", "confidence", "matches_in_window"
    )


@query(
    "panel_match_probabilities",
    sql(
        """SELECT fixture_id, model, floor(ch * 1e4 + 0.5) / 1e4 AS implied_home_win, floor(cd * 1e4 + 0.5) / 1e4 AS implied_draw,
                  floor(ca * 1e4 + 0.5) / 1e4 AS implied_away_win, floor((ch - home_prob) * 1e4 + 0.5) / 1e4 AS edge_home,
                  floor((cd - draw_prob) * 1e4 + 0.5) / 1e4 AS edge_draw, floor((ca - away_prob) * 1e4 + 0.5) / 1e4 AS edge_away
           FROM (SELECT *, 0.7 * e * (1 - dr) + 0.3 * home_prob AS ch, 0.7 * dr + 0.3 * draw_prob AS cd, 0.7 * (1 - e) * (1 - dr) + 0.3 * away_prob AS ca
                 FROM (SELECT *, greatest(0.05, least(0.35, 0.28 * (1 - pow(2 * abs(e - 0.5), 0.8)))) AS dr FROM (
                   SELECT f.fixture_id, h.model, m.home_prob, m.draw_prob, m.away_prob,
                          1 / (1 + pow(10, (a.elo - h.elo - (SELECT home_adv FROM homeadv)) / 400)) AS e
                   FROM fixtures f JOIN medodds m USING (fixture_id) JOIN elos h ON h.team = f.home_team AND h.date = f.date
                   JOIN elos a ON a.team = f.away_team AND a.date = f.date AND a.model = h.model)))""",
        "elos",
        "homeadv",
        "medodds",
    ),
)
def panel_match_probabilities(spark, d):
    ratings, adv, med = model_ratings(spark, d)
    rows = pn.match_probabilities(fixtures(spark, d), ratings, med, adv)
    return rows.select(
        "fixture_id", "model", "implied_home_win", "implied_draw", "implied_away_win", "edge_home", "edge_draw", "edge_away"
    )


@query(
    "legacy_priors",
    sql(
        f"""SELECT team, league, coalesce({rnd('rating', 4)}, 1500.0) AS prior FROM priors p LEFT JOIN (
              SELECT s_nationkey, arg_max(1500 + s_acctbal / 100, (s_suppkey, s_acctbal)) AS rating FROM supplier GROUP BY 1) s
            ON p.league <> 'ASIA' AND p.team = 'NATION_' || CAST(s_nationkey AS VARCHAR)""",
        "priors",
    ),
)
def legacy_priors(spark, d):
    from ratewright.sources.nested import last_ratings

    s = table(spark, d, "supplier")
    # history as a map of name to dated ratings, the shape it is delivered in
    entry = F.struct(F.lpad(F.col("s_suppkey").cast("string"), 12, "0").alias("date"), (1500 + F.col("s_acctbal") / 100).alias("rating"))
    maps = s.select(F.create_map(F.concat(F.lit("OLD_"), F.col("s_nationkey").cast("string")), F.array(entry)).alias("history"))
    teams = priors(spark, d).select("team", "league")
    # teams of one league were not rated under an older name
    aliases = teams.where(F.col("league") != "ASIA").select("team", F.regexp_replace("team", "NATION_", "OLD_").alias("legacy_name"))
    return pn.legacy_priors(teams, last_ratings(maps), aliases).select("team", "league", r("prior", 4).alias("prior"))
