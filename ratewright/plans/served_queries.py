"""Served tables, links and the remaining small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.operators import consensus as k
from ratewright.operators import market as mk
from ratewright.operators import reports as rp
from ratewright.operators import served as sv
from ratewright.operators import settle as st
from ratewright.plans import table_queries as tq
from ratewright.plans.consensus_queries import frozen
from ratewright.plans.rating_queries import serving, solve, stored_state, team_state
from ratewright.plans.registry import query, rnd, sql
from ratewright.plans.settle_queries import log_inputs, log_v3
from ratewright.plans.shapes import AS_OF, as_of, fixtures, history, quotes, table
from ratewright.session import new_folder
from ratewright.sources import export as ex
from ratewright.sources import nested as ns
from ratewright.streaming import jobs


def r(col, n=6):
    return F.round(col, n)


DAY = AS_OF[:10]


@query(
    "broken_settlements",
    sql(
        f"""SELECT has_error, broken, count(*) AS n FROM (SELECT e_kr IS NULL AS has_error, (b0 < 100) OR (delta_b = 0 AND b0 = 0) AS broken FROM (
              SELECT *, CASE WHEN e_kr IS NULL THEN 0.0 ELSE b_after - delta_b END AS b0 FROM v1log)) GROUP BY ALL""",
        "v1log",
    ),
)
def broken_settlements(spark, d):
    log = st.settle_v1(st.settle_rows(fixtures(spark, d), frozen(spark, d), (None, "no_frozen_kr")))
    lost = log.withColumn("b_before", F.when(F.col("has_error"), 0.0).otherwise(F.col("b_before")))
    return sv.broken(lost).groupBy("has_error", "broken").agg(F.count(F.lit(1)).alias("n"))


@query(
    "one_day_before",
    sql(
        """SELECT fixture_id, bookmaker, snapshot_time FROM quotes JOIN starts USING (fixture_id)
           WHERE greatest(0, floor((epoch_us(kickoff) - epoch_us(snapshot_time)) / 8.64e10 + 0.5)) = 1""",
        "quotes",
        "starts",
    ),
)
def one_day_before(spark, d):
    return k.days_out(quotes(spark, d), fixtures(spark, d)).select("fixture_id", "bookmaker", "snapshot_time")


@query(
    "history_by_reason",
    sql("SELECT league, publish_reason, count(*) AS n, max(ts) AS latest FROM history WHERE publish_reason IN ('settlement', 'bootstrap') AND ts >= greatest(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-23') GROUP BY ALL", "history"),
)
def history_by_reason(spark, d):
    at = lambda v: F.to_timestamp_ntz(F.lit(v))
    rows = history(spark, d).where(F.col("publish_reason").isin("settlement", "bootstrap") & (F.col("ts") >= F.greatest(at("2024-01-05 00:00:00"), at("2024-01-23 00:00:00"))))
    return rows.groupBy("league", "publish_reason").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@query("current_prices", sql("SELECT team_id, league, floor(b_value * 100 + 0.5) / 100 AS index, floor((floor(b_value * 100 + 0.5) / 100 - 800) / 5 * 100 + 0.5) / 100 AS price FROM state", "state"))
def current_prices(spark, d):
    return sv.current_prices(team_state(spark, d).withColumn("published_index", F.col("b_value")))


@query(
    "last_settlements",
    sql(
        f"""SELECT team_id, fixture_id, rank, {rnd('delta_b', 6)} AS delta_b FROM (SELECT team_id, fixture_id, delta_b, row_number() OVER (PARTITION BY team_id ORDER BY date DESC, fixture_id DESC) AS rank FROM v3log) WHERE rank <= 5""",
        "v3log",
    ),
)
def last_settlements(spark, d):
    return sv.last_settlements(log_v3(spark, d)).select("team_id", "fixture_id", "rank", r("delta_b").alias("delta_b"))


@query(
    "team_page",
    sql(
        f"""SELECT 'current' AS part, NULL::BIGINT AS id, NULL::VARCHAR AS opponent, floor(b_value * 100 + 0.5) / 100 AS value, floor((floor(b_value * 100 + 0.5) / 100 - 800) / 5 * 100 + 0.5) / 100 AS other
            FROM state WHERE team_id = 'NATION_7'
            UNION ALL SELECT 'history', event_id, NULL, {rnd('published_index', 6)}, {rnd('price', 6)} FROM history WHERE 'NATION_' || substr(team, 6) = 'NATION_7'
            UNION ALL SELECT 'settled', fixture_id, opponent, {rnd('delta_b', 6)}, {rnd('b_after', 6)} FROM (SELECT * FROM v3log WHERE team_id = 'NATION_7' ORDER BY date DESC, fixture_id DESC LIMIT 5)""",
        "state",
        "history",
        "v3log",
    ),
)
def team_page(spark, d):
    """Current row, history and last settlements of one team, told apart by ``part``."""
    state = team_state(spark, d).withColumn("published_index", F.col("b_value"))
    told = history(spark, d).withColumn("team", F.concat(F.lit("NATION_"), F.substring("team", 6, 20)))
    now, before, last = sv.team_page("NATION_7", state, told, log_v3(spark, d))
    none = F.lit(None)
    parts = [
        now.select(F.lit("current").alias("part"), none.cast("long").alias("id"), none.cast("string").alias("opponent"), F.col("index").alias("value"), F.col("price").alias("other")),
        before.select(F.lit("history"), "event_id", none.cast("string"), r("published_index"), r("price")),
        last.select(F.lit("settled"), "fixture_id", "opponent", r("delta_b"), r("b_after")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("cup_teams", sql("SELECT DISTINCT team_id FROM sides WHERE competition = 'cup'", "sides"))
def cup_teams(spark, d):
    return sv.cup_teams(fixtures(spark, d), log_inputs(spark, d))


@query(
    "cup_rankings",
    sql(
        f"""SELECT team_id, cl_delta_sum, row_number() OVER (ORDER BY cl_delta_sum DESC, team_id) AS rank FROM (
              SELECT s.team_id, {rnd('coalesce(c.x, 0)', 5)} AS cl_delta_sum FROM state s LEFT JOIN (SELECT team_id, sum(delta_b) AS x FROM v3log WHERE competition = 'cup' GROUP BY 1) c USING (team_id))""",
        "state",
        "v3log",
    ),
)
def cup_rankings(spark, d):
    cups = rp.cup_stats(log_v3(spark, d), fixtures(spark, d))
    rows = team_state(spark, d).join(cups, "team_id", "left").select("team_id", r(F.coalesce("cl_delta_sum", F.lit(0.0)), 5).alias("cl_delta_sum"))
    return rp.ranked(rows, "cl_delta_sum")


@query(
    "upcoming_board",
    sql(
        f"""SELECT arg_max(fixture_id, (has, -fixture_id)) AS fixture_id, home_team, away_team, date, CAST(arg_max(coalesce(books, 0), (has, -fixture_id)) AS BIGINT) AS books,
                   arg_max(coalesce(ph, -1.0), (has, -fixture_id)) AS pm_home
            FROM (SELECT f.*, books, books IS NOT NULL AS has, ph FROM fixtures f LEFT JOIN (SELECT fixture_id, count(*) AS books FROM preko GROUP BY 1) USING (fixture_id)
                  LEFT JOIN (SELECT o_orderkey AS fixture_id, floor(o_totalprice % 1000 / 1000 * 1e4 + 0.5) / 1e4 AS ph FROM orders WHERE o_orderkey % 3 <> 0) USING (fixture_id)
                  WHERE status = 'upcoming' AND date >= DATE '{DAY}') GROUP BY home_team, away_team, date""",
        "fixtures",
        "preko",
    ),
)
def upcoming_board(spark, d):
    ml = ns.moneyline(tq.prediction_events(spark, d), ["id"])
    rows = ml.select(F.col("id").alias("fixture_id"), F.array("home_team", F.lit("Draw"), "away_team").alias("outcomes"), F.array("home_prob", "draw_prob", "away_prob").alias("outcome_prices"))
    out = sv.board(fixtures(spark, d), k.display_consensus(serving(spark, d)), rows, as_of())
    return out.select("fixture_id", "home_team", "away_team", "date", F.coalesce("books", F.lit(0)).alias("books"), F.coalesce("pm_home", F.lit(-1.0)).alias("pm_home"))


@query(
    "link_markets",
    sql(
        f"""SELECT e.fixture_id AS event_id, x.fixture_id FROM fixtures e JOIN (
              SELECT home_team, away_team, arg_min(fixture_id, (abs(date_diff('day', DATE '{DAY}', date)), fixture_id)) AS fixture_id FROM fixtures WHERE abs(date_diff('day', DATE '{DAY}', date)) <= 2 GROUP BY ALL) x
            USING (home_team, away_team) WHERE e.fixture_id % 2 = 0""",
        "fixtures",
    ),
)
def link_markets(spark, d):
    ev = tq.prediction_events(spark, d).select(F.col("id").alias("event_id"), "title", F.when(F.col("id") % 2 == 1, F.col("id")).alias("fixture_id"))
    aliases = spark.createDataFrame([], "source string, canonical string")
    return sv.link_markets(ev, fixtures(spark, d), aliases, as_of())


@query("common_fixtures", sql("SELECT fixture_id FROM fixtures WHERE (home_team = 'NATION_2' AND away_team = 'NATION_7') OR (home_team = 'NATION_7' AND away_team = 'NATION_2')", "fixtures"))
def common_fixtures(spark, d):
    return sv.common_fixtures(fixtures(spark, d), "NATION_2", "NATION_7")


@query(
    "health",
    sql(
        f"""SELECT (SELECT count(*) FROM state) AS teams, TIMESTAMP '{AS_OF}' AS latest_refresh, (SELECT max(date) FROM sides WHERE skipped_reason IS NULL) AS latest_settlement,
                   (SELECT arg_max(fixture_id, (date, fixture_id)) FROM sides WHERE skipped_reason IS NULL) AS latest_fixture, TIMESTAMP '{AS_OF}' AS latest_solve""",
        "state",
        "sides",
    ),
)
def health(spark, d):
    edges, solved = solve(spark, d)
    state = team_state(spark, d).withColumn("updated_at", as_of())
    return sv.health(state, log_inputs(spark, d), mk.solve_audit(solved, edges, as_of(), "settlement"))


@query(
    "solve_stats",
    sql(f"SELECT count(*) AS total, TIMESTAMP '{AS_OF}' AS latest, 0::BIGINT AS not_converged FROM (SELECT league FROM edges GROUP BY 1 HAVING count(*) > 2)", "edges"),
)
def solve_stats(spark, d):
    edges, solved = solve(spark, d)
    return sv.solve_stats(mk.solve_audit(solved, edges, as_of(), "settlement")).select("total", "latest", "not_converged")


@query("sigma_histogram", sql("SELECT bin, count(v) AS n FROM (SELECT CAST(unnest(range(0, 15)) AS INTEGER) AS bin) LEFT JOIN (SELECT floor(sqrt(x) / 10) AS v FROM inverse WHERE i = 400 AND unit = team) ON v = bin GROUP BY bin", "inverse"))
def sigma_histogram(spark, d):
    _, solved = solve(spark, d)
    return rp.histogram(solved, F.floor(F.col("std_error") / 10), 0, 14)


@query(
    "overlay_histogram",
    sql("SELECT bin, count(v) AS n FROM (SELECT CAST(unnest(range(-6, 6)) AS INTEGER) AS bin) LEFT JOIN (SELECT floor(greatest(-120.0, least(120.0, 1510 - b_value)) / 20) AS v FROM state) ON v = bin GROUP BY bin", "state"),
)
def overlay_histogram(spark, d):
    return rp.histogram(team_state(spark, d), F.floor(sv.bounded(1510.0 - F.col("b_value")) / 20), -6, 5)


@query("stalest_teams", sql("SELECT team, max(ts) AS last_refresh FROM history GROUP BY team ORDER BY last_refresh, team LIMIT 10", "history"))
def stalest_teams(spark, d):
    return sv.stalest(history(spark, d), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))).select("team", "last_refresh")


@query(
    "top_bottom",
    sql(
        f"""SELECT team_id, {rnd('b_value', 6)} AS b_value, 'top' AS "end" FROM (SELECT * FROM state ORDER BY b_value DESC, team_id LIMIT 5) UNION ALL
            SELECT team_id, {rnd('b_value', 6)}, 'bottom' FROM (SELECT * FROM state ORDER BY b_value, team_id LIMIT 5)""",
        "state",
    ),
)
def top_bottom(spark, d):
    return sv.top_bottom(team_state(spark, d), "b_value").select("team_id", r("b_value").alias("b_value"), "end")


@query(
    "chart_points",
    sql(
        f"""SELECT s.fixture_id, s.team_id, s.opponent, s.date, CASE WHEN actual_score_s >= 0.9 THEN 'W' WHEN actual_score_s >= 0.4 THEN 'D' ELSE 'L' END AS result, {rnd('delta_b', 6)} AS delta_b
            FROM v3log s""",
        "v3log",
    ),
)
def chart_points(spark, d):
    log = log_v3(spark, d)
    hist = log.select("team_id", F.col("fixture_id").alias("source_fixture_id"), F.col("b_after").alias("published_index"), F.lit("settlement_v3").alias("publish_reason"))
    out = sv.chart_points(hist, log, fixtures(spark, d))
    return out.select(F.col("source_fixture_id").alias("fixture_id"), "team_id", "opponent", "date", "result", r("delta_b").alias("delta_b"))


@query(
    "displayed_impacts",
    sql(
        f"""SELECT fixture_id, outcome, {rnd('6 * (s - home_es)', 6)} AS delta_price_home, {rnd('CASE WHEN h.price > 0 THEN 100 * 6 * (s - home_es) / h.price END', 6)} AS pct_home,
                   {rnd('6 * (home_es - s)', 6)} AS delta_price_away, {rnd('CASE WHEN a.price > 0 THEN 100 * 6 * (home_es - s) / a.price END', 6)} AS pct_away
            FROM es JOIN fixtures USING (fixture_id) LEFT JOIN (SELECT team_id AS home_team, (b_value - 800) / 5 AS price FROM state) h USING (home_team)
            LEFT JOIN (SELECT team_id AS away_team, (b_value - 800) / 5 AS price FROM state) a USING (away_team) CROSS JOIN (VALUES ('home_win', 1.0::DOUBLE), ('draw', 0.5::DOUBLE), ('away_win', 0.0::DOUBLE)) o(outcome, s) WHERE status = 'upcoming'""",
        "es",
        "fixtures",
        "state",
    ),
)
def displayed_impacts(spark, d):
    f = fixtures(spark, d).where(F.col("status") == "upcoming")
    es = k.current_expected(serving(spark, d)).select("fixture_id", F.col("home_es").alias("e_home"), (1.0 - F.col("home_es")).alias("e_away"))
    prices = team_state(spark, d).select("team_id", x.linear_price("b_value").alias("price"))
    out = sv.impacts_displayed(f, es, prices)
    return out.select("fixture_id", "outcome", *[r(n).alias(n) for n in ("delta_price_home", "pct_home", "delta_price_away", "pct_away")])


@query(
    "countdowns",
    sql(
        f"""SELECT fixture_id, CAST(greatest(0, ceil((epoch_us(k) - epoch_us(TIMESTAMP '{AS_OF}')) / 8.64e10)) AS INTEGER) AS days_left, {rnd(f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(k)) / 3.6e9", 4)} AS hours_since
            FROM (SELECT *, coalesce(commence_time, CAST(date AS TIMESTAMP)) AS k FROM fixtures)""",
        "fixtures",
    ),
)
def countdowns(spark, d):
    start = t.kickoff_or_default("commence_time", "date", "00:00:00")
    return fixtures(spark, d).select("fixture_id", t.days_until(as_of(), start).alias("days_left"), r(t.hours_between(start, as_of()), 4).alias("hours_since"))


@query(
    "export_settlements",
    sql("SELECT fixture_id, team_id, score, bookmaker_count FROM sides WHERE skipped_reason IS NULL", "sides"),
)
def export_settlements(spark, d):
    kr = frozen(spark, d)
    log = log_v3(spark, d)
    full = log.drop("score", "bookmaker_count").join(st.trace(log, kr).withColumn("trace_payload", F.to_json("trace_payload")), ["fixture_id", "team_id"])
    folder = new_folder(spark, "export-settlements")
    ex.write_csv(ex.settlement_rows(full), folder)
    schema = "fixture_id long, team_id string, oracle_version string, e_kr double, actual_score_s double, delta_b double, b_before double, b_after double, score string, bookmaker_count int"
    return spark.read.option("header", True).schema(schema).csv(folder).select("fixture_id", "team_id", "score", "bookmaker_count")


@query("export_frozen", sql(f"SELECT fixture_id, bookmaker_count, {rnd('home_expected_score', 6)} AS home_expected_score, {rnd('away_expected_score', 6)} AS away_expected_score FROM kr", "kr"))
def export_frozen(spark, d):
    folder = new_folder(spark, "export-frozen")
    columns = ["fixture_id", "bookmaker_count", "home_expected_score", "away_expected_score"]
    ex.write_csv(ex.frozen_rows(frozen(spark, d)).select(*columns[:2], *[r(n).alias(n) for n in columns[2:]]), folder)
    schema = "fixture_id long, bookmaker_count int, home_expected_score double, away_expected_score double"
    return spark.read.option("header", True).schema(schema).csv(folder)


@query("export_history", sql(f"SELECT event_id, team, league, ts, publish_reason, {rnd('published_index', 6)} AS published_index, {rnd('price', 6)} AS price FROM history", "history"))
def export_history(spark, d):
    folder = new_folder(spark, "export-history")
    ex.write_csv(history(spark, d).select("event_id", "team", "league", "ts", "publish_reason", r("published_index").alias("published_index"), r("price").alias("price")), folder)
    schema = "event_id long, team string, league string, ts timestamp_ntz, publish_reason string, published_index double, price double"
    return spark.read.option("header", True).schema(schema).csv(folder)


@query("export_state", sql(f"SELECT team_id, league, {rnd('b_value', 6)} AS b_value FROM state", "state"))
def export_state(spark, d):
    folder = new_folder(spark, "export-state")
    ex.write_csv(team_state(spark, d).select("team_id", "league", r("b_value").alias("b_value")), folder)
    return spark.read.option("header", True).schema("team_id string, league string, b_value double").csv(folder)


@query("cycle_settles", sql("SELECT fixture_id, team_id, e_kr FROM sides WHERE skipped_reason IS NULL", "sides"))
def cycle_settles(spark, d):
    """Cycles over a stream of finished contests: each settles what its batch brings and no cycle settles twice."""
    from ratewright.plans.stream_queries import _Stream

    root = new_folder(spark, "cycle-log")
    f, kr = fixtures(spark, d), frozen(spark, d)
    schema = "fixture_id long, team_id string, oracle_version string, e_kr double"
    stream = table(_Stream(spark), d, "orders").select(F.col("o_orderkey").alias("fixture_id"))

    def step(batch, number):
        rows = st.settle_rows(f.join(batch.distinct(), "fixture_id", "left_semi"), kr).withColumn("oracle_version", F.lit("v3"))
        rows = rows.select("fixture_id", "team_id", "oracle_version", "e_kr")
        if number:
            rows = st.append_log(spark.read.schema(schema).parquet(*[f"{root}/batch={i}" for i in range(number)]), rows)
        rows.write.mode("overwrite").parquet(f"{root}/batch={number}")

    jobs.cycle(stream, step)
    return spark.read.schema(schema).parquet(root).select("fixture_id", "team_id", "e_kr")
