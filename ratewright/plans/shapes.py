"""The contest tables, shaped from the star-schema test tables, in Spark and in check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.plans.registry import fragment

AS_OF = "1998-06-01 00:00:00"


# Explicit schemas: no footer is read to plan a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def fixtures(spark: SparkSession, d: str) -> DataFrame:
    """Contests: one per order, between two nations of one region; every eleventh is a cup contest."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home_team"), "r_name")
    away = table(spark, d, "nation").select(F.col("n_nationkey").alias("_away"), F.col("n_name").alias("away_team"))
    key = F.col("o_orderkey")
    joined = (
        orders.join(customer, "o_custkey")
        .withColumn("_away", ((F.col("c_nationkey") + 5 * (1 + key % 4)) % 25).cast("int"))
        .join(home, "c_nationkey")
        .join(away, "_away")
    )
    finished = F.col("o_orderstatus") == "F"
    score = F.concat_ws(
        "-",
        (F.floor("o_totalprice") % 4).cast("int").cast("string"),
        (F.col("o_custkey") % 3).cast("int").cast("string"),
    )
    cup = key % 11 == 0
    return joined.select(
        key.alias("fixture_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(cup, c.CUP_LEAGUE).otherwise(F.col("r_name")).alias("league"),
        F.when(cup, "cup").otherwise("league").alias("competition"),
        "home_team",
        "away_team",
        F.when(finished, score).otherwise("N/A").alias("score"),
        F.when(finished, "finished").when(F.col("o_orderstatus") == "O", "upcoming").otherwise("live").alias("status"),
        F.when(
            key % 10 != 7, F.timestamp_add("HOUR", (12 + key % 8).cast("int"), F.col("o_orderdate"))
        ).alias("commence_time"),
    )


fragment(
    "fixtures",
    (),
    """
    SELECT o_orderkey AS fixture_id, CAST(o_orderdate AS DATE) AS date,
           CASE WHEN o_orderkey % 11 = 0 THEN 'CUP' ELSE r_name END AS league,
           CASE WHEN o_orderkey % 11 = 0 THEN 'cup' ELSE 'league' END AS competition,
           h.n_name AS home_team, a.n_name AS away_team,
           CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 4 AS VARCHAR) || '-' || CAST(o_custkey % 3 AS VARCHAR)
                ELSE 'N/A' END AS score,
           CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'upcoming' ELSE 'live' END AS status,
           CASE WHEN o_orderkey % 10 <> 7 THEN o_orderdate + to_hours(CAST(12 + o_orderkey % 8 AS BIGINT)) END AS commence_time
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation h ON h.n_nationkey = c_nationkey
    JOIN region ON r_regionkey = h.n_regionkey
    JOIN nation a ON a.n_nationkey = (c_nationkey + 5 * (1 + o_orderkey % 4)) % 25
    """,
)


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Bookmaker quotes: one per line item; one supplier in fifty quotes an invalid home price."""
    line = table(spark, d, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("fixture_id"),
        F.concat(F.lit("book_"), F.col("l_linenumber").cast("string")).alias("bookmaker"),
        F.timestamp_add("HOUR", (F.col("l_partkey") % 24).cast("int"), F.col("l_shipdate")).alias("snapshot_time"),
        F.when(F.col("l_suppkey") % 50 == 0, 1.005).otherwise(1.2 + F.col("l_quantity") / 10.0).alias("home_odds"),
        (2.5 + F.col("l_discount") * 20.0).alias("draw_odds"),
        (1.2 + (F.col("l_extendedprice") % 500.0) / 100.0).alias("away_odds"),
        F.concat(F.lit("feed_"), F.lower("l_returnflag")).alias("source"),
    )


fragment(
    "quotes",
    (),
    """
    SELECT l_orderkey AS fixture_id, 'book_' || CAST(l_linenumber AS VARCHAR) AS bookmaker,
           l_shipdate + to_hours(CAST(l_partkey % 24 AS BIGINT)) AS snapshot_time,
           CASE WHEN l_suppkey % 50 = 0 THEN 1.005::DOUBLE ELSE 1.2::DOUBLE + l_quantity / 10.0::DOUBLE END AS home_odds,
           2.5::DOUBLE + l_discount * 20.0::DOUBLE AS draw_odds,
           1.2::DOUBLE + (l_extendedprice % 500.0::DOUBLE) / 100.0::DOUBLE AS away_odds,
           'feed_' || lower(l_returnflag) AS source
    FROM lineitem
    """,
)


def history(spark: SparkSession, d: str) -> DataFrame:
    """Published index history: one row per event, the user being the team and the type the reason."""
    reason = F.create_map(*[F.lit(z) for kv in REASONS.items() for z in kv])
    return table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("TEAM_"), F.col("user_id").cast("string")).alias("team"),
        F.concat(F.lit("LEAGUE_"), (F.col("user_id") % 5).cast("string")).alias("league"),
        "ts",
        (1300.0 + F.col("value")).alias("published_index"),
        F.col("value").alias("price"),
        reason[F.col("event_type")].alias("publish_reason"),
    )


REASONS = {
    "click": "market_refresh",
    "view": "market_refresh",
    "purchase": "settlement",
    "signup": "bootstrap",
    "error": "live_update",
}
fragment(
    "history",
    (),
    """
    SELECT event_id, 'TEAM_' || CAST(user_id AS VARCHAR) AS team, 'LEAGUE_' || CAST(user_id % 5 AS VARCHAR) AS league,
           ts, 1300.0::DOUBLE + value AS published_index, value AS price,
           CASE event_type WHEN 'purchase' THEN 'settlement' WHEN 'signup' THEN 'bootstrap' WHEN 'error' THEN 'live_update'
                ELSE 'market_refresh' END AS publish_reason
    FROM events
    """,
)

# --- consensus fragments shared by many checks --------------------------------

fragment(
    "starts",
    ("fixtures",),
    "SELECT *, coalesce(commence_time, CAST(date AS TIMESTAMP) + INTERVAL '23 hours 59 minutes 59 seconds') AS kickoff FROM fixtures",
)
fragment(
    "preko",
    ("starts", "quotes"),
    """
    SELECT * EXCLUDE (rn) FROM (
      SELECT q.*, s.kickoff, row_number() OVER (PARTITION BY q.fixture_id, q.bookmaker
             ORDER BY q.snapshot_time DESC, q.home_odds DESC, q.draw_odds DESC, q.away_odds DESC, q.source DESC) AS rn
      FROM quotes q JOIN starts s USING (fixture_id)
      WHERE q.snapshot_time < s.kickoff AND q.home_odds >= 1.01 AND q.draw_odds >= 1.01 AND q.away_odds >= 1.01)
    WHERE rn = 1
    """,
)
# bisection on [0.01, 10] with proportional fallback
fragment(
    "bisect(fixture_id, bookmaker, h, d, a, lo, hi, i)",
    ("preko",),
    """
    SELECT fixture_id, bookmaker, 1 / home_odds, 1 / draw_odds, 1 / away_odds, 0.01::DOUBLE, 10.0::DOUBLE, 0 FROM preko
    UNION ALL
    SELECT fixture_id, bookmaker, h, d, a,
           CASE WHEN pow(h, (lo + hi) / 2) + pow(d, (lo + hi) / 2) + pow(a, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
           CASE WHEN pow(h, (lo + hi) / 2) + pow(d, (lo + hi) / 2) + pow(a, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END,
           i + 1
    FROM bisect WHERE i < 50
    """,
)
fragment(
    "books",
    ("bisect", "preko"),
    """
    SELECT p.*, CASE WHEN ok THEN pow(h, k) ELSE h / (h + d + a) END AS p_home,
           CASE WHEN ok THEN pow(d, k) ELSE d / (h + d + a) END AS p_draw,
           CASE WHEN ok THEN pow(a, k) ELSE a / (h + d + a) END AS p_away,
           CASE WHEN ok THEN k END AS devig_k
    FROM (SELECT *, (lo + hi) / 2 AS k,
                 pow(h, 0.01) + pow(d, 0.01) + pow(a, 0.01) >= 1 AND pow(h, 10) + pow(d, 10) + pow(a, 10) <= 1 AS ok
          FROM bisect WHERE i = 50) b
    JOIN preko p USING (fixture_id, bookmaker)
    """,
)
fragment(
    "es",
    ("books",),
    """
    SELECT fixture_id, n AS bookmaker_count, latest_quote, kickoff,
           mh / (mh + md + ma) AS home_prob, md / (mh + md + ma) AS draw_prob, ma / (mh + md + ma) AS away_prob,
           greatest(0.01, least(0.99, (mh + 0.5 * md) / (mh + md + ma))) AS home_es
    FROM (SELECT fixture_id, count(*) AS n, median(p_home) AS mh, median(p_draw) AS md, median(p_away) AS ma,
                 max(snapshot_time) AS latest_quote, max(kickoff) AS kickoff
          FROM books WHERE p_home > 0 AND p_home < 1 AND p_draw > 0 AND p_draw < 1 AND p_away > 0 AND p_away < 1
          GROUP BY fixture_id HAVING count(*) >= 2)
    """,
)
KR_HOURS = 2160.0
fragment(
    "kr",
    ("books",),
    f"""
    SELECT fixture_id, kickoff, bookmaker_count, bookmakers_used, kr_degraded,
           round(hp, 6) AS home_prob, round(dp, 6) AS draw_prob, round(ap, 6) AS away_prob,
           round(hp + 0.5 * dp + dp * (0.5 - hp - 0.5 * dp), 6) AS home_expected_score,
           round(ap + 0.5 * dp + dp * (0.5 - ap - 0.5 * dp), 6) AS away_expected_score,
           round(hp + 0.5 * dp, 6) AS home_expected_score_raw, round(ap + 0.5 * dp, 6) AS away_expected_score_raw
    FROM (SELECT *, mh / (mh + md + ma) AS hp, md / (mh + md + ma) AS dp, ma / (mh + md + ma) AS ap
          FROM (SELECT fixture_id, max(kickoff) AS kickoff, CAST(count(*) AS INTEGER) AS bookmaker_count,
                       string_agg(bookmaker, ',' ORDER BY bookmaker) AS bookmakers_used, bool_or(recent < 2) AS kr_degraded,
                       median(p_home) AS mh, median(p_draw) AS md, median(p_away) AS ma
                FROM (SELECT *, date_diff('second', snapshot_time, kickoff) <= {KR_HOURS} * 3600 AS is_recent,
                             count(*) FILTER (date_diff('second', snapshot_time, kickoff) <= {KR_HOURS} * 3600)
                               OVER (PARTITION BY fixture_id) AS recent FROM books)
                WHERE (recent < 2 OR is_recent) AND p_home > 0 AND p_home < 1 AND p_draw > 0 AND p_draw < 1
                  AND p_away > 0 AND p_away < 1
                GROUP BY fixture_id HAVING count(*) >= 2))
    """,
)
