"""Streams run over the whole tables to their end, and the in-play layer."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.operators import consensus as k
from ratewright.operators import live as lv
from ratewright.operators import market as mk
from ratewright.operators import quality as ql
from ratewright.operators import resolve as rv
from ratewright.operators import settle as st
from ratewright.plans import table_queries  # noqa: F401  (its SQL fragments are used below)
from ratewright.plans.consensus_queries import frozen
from ratewright.plans.rating_queries import futures, stored_state, team_state
from ratewright.plans.registry import fragment, query, rnd, sql
from ratewright.plans.shapes import AS_OF, KR_HOURS, SCHEMAS, as_of, fixtures, history, quotes, table
from ratewright.session import durable, new_folder
from ratewright.streaming import jobs


def r(col, n=6):
    return F.round(col, n)


class _Stream:
    """Lets the table shapes read a table, one file or a folder of files, as a stream."""

    def __init__(self, spark, files: int = 8):
        self.read = self
        self._spark, self._schema, self._files = spark, None, files

    def schema(self, s):
        self._schema = s
        return self

    def parquet(self, path):
        # As a pattern, the path may be a folder or a single file; as it stands a stream only takes a folder.
        pattern = f"{path[:-1]}[{path[-1]}]"
        return self._spark.readStream.schema(self._schema).option("maxFilesPerTrigger", self._files).parquet(pattern)


def stream_quotes(spark, d):
    return quotes(_Stream(spark), d)


def stream_history(spark, d):
    h = history(_Stream(spark), d)
    return h.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_latest", sql("SELECT fixture_id, bookmaker, snapshot_time, round(home_odds, 6) AS home_odds FROM latest_all", "latest_all"))
def stream_latest(spark, d):
    out = jobs.ingest_quotes(stream_quotes(spark, d), fixtures(spark, d))["latest"]
    return out.select("fixture_id", "bookmaker", "snapshot_time", r("home_odds").alias("home_odds"))


@query(
    "stream_preko",
    sql(
        """SELECT fixture_id, bookmaker, snapshot_time, round(home_odds, 6) AS home_odds FROM (SELECT q.*, row_number() OVER (PARTITION BY fixture_id, bookmaker
             ORDER BY snapshot_time DESC, home_odds DESC, draw_odds DESC, away_odds DESC) AS rn FROM quotes q JOIN starts USING (fixture_id) WHERE snapshot_time < kickoff) WHERE rn = 1""",
        "quotes",
        "starts",
    ),
)
def stream_preko(spark, d):
    out = jobs.ingest_quotes(stream_quotes(spark, d), fixtures(spark, d))["preko"]
    return out.select("fixture_id", "bookmaker", "snapshot_time", r("home_odds").alias("home_odds"))


@query(
    "stream_freeze",
    sql(
        f"""SELECT fixture_id, home_expected_score, away_expected_score, bookmaker_count FROM kr JOIN fixtures USING (fixture_id) WHERE coalesce(commence_time, CAST(date AS TIMESTAMP)) <= TIMESTAMP '{AS_OF}'""",
        "kr",
        "fixtures",
    ),
)
def stream_freeze(spark, d):
    return jobs.freeze_stream(stream_quotes(spark, d), fixtures(spark, d), as_of(), KR_HOURS)


@query("stream_distinct", sql("SELECT fixture_id, source, bookmaker, snapshot_time AS ts, 1::BIGINT AS n FROM quotes GROUP BY fixture_id, source, bookmaker, snapshot_time", "quotes"))
def stream_distinct(spark, d):
    s = stream_quotes(spark, d).select("fixture_id", "source", "bookmaker", F.col("snapshot_time").cast("timestamp").alias("ts"))
    out = jobs.to_table(jobs.distinct_quotes(s), "distinct")
    return out.groupBy("fixture_id", "source", "bookmaker", F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_downsample",
    sql(
        """SELECT team, time_bucket(INTERVAL 15 MINUTES, ts) AS window_start, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM history
           GROUP BY ALL""",
        "history",
    ),
)
def stream_downsample(spark, d):
    s = stream_history(spark, d).select("team", "ts", "event_id", "published_index")
    out = jobs.to_latest(jobs.downsample_stream(s), "downsample", ["team", "window_start"], ["ts", "event_id"])
    ntz = lambda n: F.col(n).cast("timestamp_ntz").alias(n)
    return out.select("team", ntz("window_start"), ntz("ts"), "event_id")


@query(
    "stream_live_window",
    sql(
        """SELECT fixture_id, bookmaker, count(*) AS windows, max(ts) AS latest FROM (
             SELECT DISTINCT fixture_id, bookmaker, ts, w FROM (SELECT user_id AS fixture_id, event_type AS bookmaker, ts, unnest([0, 1, 2]) AS i, time_bucket(INTERVAL 1 MINUTE, ts) + to_minutes(i + 1) AS w FROM events)
             QUALIFY row_number() OVER (PARTITION BY fixture_id, bookmaker, w ORDER BY ts DESC) = 1) GROUP BY ALL"""
    ),
)
def stream_live_window(spark, d):
    ev = table(_Stream(spark), d, "events").select(
        F.col("user_id").alias("fixture_id"), F.col("event_type").alias("bookmaker"), F.col("ts").cast("timestamp").alias("ts"),
        (1.2 + F.col("value") / 100).alias("home_odds"), F.lit(3.0).alias("draw_odds"), F.lit(3.0).alias("away_odds"),
    )
    out = jobs.to_latest(jobs.live_window(ev), "live-window", ["fixture_id", "bookmaker", "as_of"], ["ts", "home_odds", "draw_odds", "away_odds"])
    return out.groupBy("fixture_id", "bookmaker").agg(F.count(F.lit(1)).alias("windows"), F.max("ts").cast("timestamp_ntz").alias("latest"))


@query(
    "stream_kickoff_locks",
    sql(
        f"""SELECT team, ts, event_id, CASE WHEN publish_reason = 'live_update' THEN 'frozen' ELSE 'cleared' END AS event, {rnd('v', 6)} AS r_market_frozen FROM (
              SELECT *, last_value(CASE WHEN publish_reason = 'live_update' AND coalesce(prev, '') <> 'live_update' THEN published_index END IGNORE NULLS)
                        OVER (PARTITION BY team ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v
              FROM (SELECT *, lag(publish_reason) OVER (PARTITION BY team ORDER BY ts, event_id) AS prev FROM history WHERE publish_reason IN ('live_update', 'settlement')))
            WHERE (publish_reason = 'live_update' AND coalesce(prev, '') <> 'live_update') OR (publish_reason = 'settlement' AND prev = 'live_update')""",
        "history",
    ),
)
def stream_kickoff_locks(spark, d):
    s = stream_history(spark, d).select("team", "ts", "event_id", "publish_reason", "published_index")
    out = jobs.kickoff_locks(s)
    return out.select("team", "ts", "event_id", "event", r("r_market_frozen").alias("r_market_frozen"))


#: Team rows are landed in parts that end here, and more where these are large, each read by a run of its own that goes on from the last one's state.
LANDED_UNTIL = ["1998-06-01", "2100-01-01"]


def team_feed(spark, d):
    """What happens to teams, as rows in time: contests announced a week ahead, market values an hour before kickoff, settlements three hours after."""
    kick = t.kickoff_or_default("commence_time", "date", "23:59:59")
    rows = st.team_rows(
        fixtures(spark, d).join(frozen(spark, d).select("fixture_id", "home_expected_score", "away_expected_score"), "fixture_id", "left").withColumn("kickoff", kick),
        {"e_kr": ("home_expected_score", "away_expected_score")},
    )
    strength = F.round(x.implied_strength("e_kr", F.lit(1500.0), "is_home"), 4)
    none = F.lit(None).cast("double")

    def part(ts, rank, kind, r_market=none, m1=none):
        return F.struct(ts.alias("ts"), rank.alias("rank"), F.lit(kind).alias("kind"), r_market.alias("r_market"), m1.alias("m1_value"))

    parts = F.array(
        part(F.col("kickoff") - F.expr("INTERVAL 7 DAYS"), F.lit(1), "fixture"),
        part(F.col("kickoff") - F.expr("INTERVAL 1 HOUR"), F.when(strength.isNotNull(), 2), "market", strength, F.round(x.overlay(strength, F.lit(1500.0)), 4)),
        part(F.col("kickoff") + F.expr("INTERVAL 3 HOURS"), F.when(F.col("status") == "finished", 3), "settlement"),
    )
    exploded = rows.select(F.col("team_id").alias("team"), "fixture_id", "kickoff", F.inline(parts)).where(F.col("rank").isNotNull())
    return exploded.select("team", "ts", (F.col("fixture_id") * 4 + F.col("rank")).alias("seq"), "kind", "r_market", "m1_value", F.when(F.col("kind") == "fixture", F.col("kickoff")).alias("kickoff"))


#: Rows of one part, about: all of them may be one team's, which are put in order in memory.
LANDED_ROWS = 20_000_000


def landed_until(days, rows: int = LANDED_ROWS) -> list[str]:
    """Ends of the parts, from (date, contests) of each day: those above, and one before each day that would fill a part."""
    ends, held = set(LANDED_UNTIL), 0
    for day, n in sorted((x for x in days if x[0] is not None), key=lambda x: x[0]):
        # A contest is six rows: three for each side.
        held += 6 * n
        if held > rows:
            ends.add(str(day))
            held = 6 * n
    return sorted(ends)


def team_locks(spark, d):
    feed, staged, folder, root = team_feed(spark, d), new_folder(spark, "team-staged"), new_folder(spark, "team-feed"), new_folder(spark, "team-locks")
    ends = landed_until([tuple(x) for x in fixtures(spark, d).groupBy("date").count().collect()])
    part = sum((F.col("ts") >= F.lit(x).cast("timestamp_ntz")).cast("int") for x in ends)
    feed.withColumn("part", part).write.partitionBy("part").parquet(staged)
    parts = spark.read.schema(StructType([*feed.schema.fields, StructField("part", IntegerType())])).parquet(staged)
    for i in range(len(ends)):
        parts.where(F.col("part") == i).drop("part").write.mode("append").parquet(folder)
        events = jobs.lock_stream(spark.readStream.schema(feed.schema).parquet(folder), root=root)
    return events


fragment(
    "teamfeed",
    ("sides", "starts"),
    """
    SELECT team_id AS team, s.fixture_id, k.kickoff, s.status, CASE WHEN e_kr IS NOT NULL THEN round(1500.0::DOUBLE + 400.0::DOUBLE * log10(greatest(0.01, least(0.99, e_kr)) / (1 - greatest(0.01, least(0.99, e_kr))))
             + CASE WHEN is_home THEN -65.0 ELSE 65.0 END::DOUBLE, 4) END AS strength
    FROM sides s JOIN (SELECT fixture_id, kickoff FROM starts) k USING (fixture_id)
    """,
)
fragment(
    "lockrows",
    ("teamfeed",),
    """
    SELECT *, max(ts) OVER () AS latest, max(CASE WHEN kind <> 'start' THEN ts END) OVER (PARTITION BY team) AS team_latest FROM (
      SELECT team, kickoff - INTERVAL 7 DAYS AS ts, 1 AS rank, fixture_id * 4 + 1 AS seq, 'fixture' AS kind, NULL::DOUBLE AS r_market FROM teamfeed
      UNION ALL SELECT team, kickoff, 0, -1, 'start', NULL FROM teamfeed
      UNION ALL SELECT team, kickoff - INTERVAL 1 HOUR, 1, fixture_id * 4 + 2, 'market', strength FROM teamfeed WHERE strength IS NOT NULL
      UNION ALL SELECT team, kickoff + INTERVAL 3 HOURS, 1, fixture_id * 4 + 3, 'settlement', NULL FROM teamfeed WHERE status = 'finished')
    """,
)
fragment(
    "teamlocks",
    ("lockrows",),
    """
    SELECT team, ts, seq, CASE WHEN kind = 'start' THEN 'frozen' ELSE 'cleared' END AS event,
           last_value(CASE WHEN kind = 'start' AND coalesce(prev, '') <> 'start' THEN coalesce(market, -1) END IGNORE NULLS) OVER (PARTITION BY team ORDER BY ts, rank, seq ROWS UNBOUNDED PRECEDING) AS frozen
    FROM (SELECT *, lag(kind) OVER (PARTITION BY team ORDER BY ts, rank, seq) AS prev FROM (
      SELECT *, last_value(r_market IGNORE NULLS) OVER (PARTITION BY team ORDER BY ts, rank, seq ROWS UNBOUNDED PRECEDING) AS market FROM lockrows)
      WHERE kind = 'settlement' OR kind = 'start' AND (ts <= (SELECT max(ts) FROM lockrows WHERE kind <> 'start') - INTERVAL 3 MINUTES OR ts <= team_latest))
    QUALIFY kind = 'start' AND coalesce(prev, '') <> 'start' OR kind = 'settlement' AND prev = 'start'
    """,
)
M1_SQL = "greatest(-120.0, least(120.0, 0.4 * (frozen - 1500)))"


@query("stream_team_locks", sql(f"SELECT team, ts, seq, event, {rnd('nullif(frozen, -1)', 4)} AS r_market_frozen, {rnd(f'CASE WHEN frozen <> -1 THEN {M1_SQL} END', 4)} AS m1_locked FROM teamlocks", "teamlocks"))
def stream_team_locks(spark, d):
    """Kickoff timers lock a team's market rating and M1, settlements clear them: events of two runs."""
    return team_locks(spark, d).select("team", "ts", "seq", "event", (r("r_market_frozen", 4) + 0.0).alias("r_market_frozen"), (r("m1_locked", 4) + 0.0).alias("m1_locked"))


@query(
    "stream_locked_state",
    sql(
        f"""SELECT t.team_id, CASE WHEN event = 'frozen' AND frozen <> -1 THEN {rnd('frozen', 4)} END AS r_market_frozen, CASE WHEN event = 'frozen' AND frozen <> -1 THEN {rnd(M1_SQL, 4)} END AS m1_locked,
                   CASE WHEN event = 'cleared' THEN 0.0 ELSE 1.0 END::DOUBLE AS l_value
            FROM (SELECT DISTINCT team_id FROM sides WHERE competition = 'league') t LEFT JOIN (SELECT * FROM teamlocks QUALIFY row_number() OVER (PARTITION BY team ORDER BY ts DESC, seq DESC) = 1) e ON e.team = t.team_id""",
        "sides",
        "teamlocks",
    ),
)
def stream_locked_state(spark, d):
    """State rows once the stream has ended: locked while a contest is under way, cleared by its settlement."""
    none = F.lit(None).cast("double")
    teams = st.team_rows(fixtures(spark, d)).where("competition = 'league'").select("team_id").distinct()
    state = teams.withColumns({"m1_locked": none, "r_market_frozen": none, "l_value": F.lit(1.0)})
    out = jobs.locked_state(state, team_locks(spark, d))
    return out.select("team_id", (r("r_market_frozen", 4) + 0.0).alias("r_market_frozen"), (r("m1_locked", 4) + 0.0).alias("m1_locked"), "l_value")


fragment(
    "inplay",
    ("fixtures", "quotes"),
    f"""SELECT * EXCLUDE (rn) FROM (SELECT q.*, row_number() OVER (PARTITION BY fixture_id, bookmaker ORDER BY snapshot_time DESC, home_odds DESC, draw_odds DESC, away_odds DESC) AS rn
        FROM quotes q JOIN fixtures USING (fixture_id) WHERE snapshot_time > coalesce(commence_time, CAST(date AS TIMESTAMP)) AND snapshot_time <= TIMESTAMP '{AS_OF}'
          AND snapshot_time >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAYS AND least(home_odds, draw_odds, away_odds) >= 1.01) WHERE rn = 1""",
)
fragment(
    "ibis(fixture_id, bookmaker, h, d, a, lo, hi, i)",
    ("inplay",),
    """SELECT fixture_id, bookmaker, 1 / home_odds, 1 / draw_odds, 1 / away_odds, 0.01::DOUBLE, 10.0::DOUBLE, 0 FROM inplay UNION ALL
       SELECT fixture_id, bookmaker, h, d, a, CASE WHEN pow(h, (lo + hi) / 2) + pow(d, (lo + hi) / 2) + pow(a, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
              CASE WHEN pow(h, (lo + hi) / 2) + pow(d, (lo + hi) / 2) + pow(a, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM ibis WHERE i < 50""",
)
fragment(
    "ilive",
    ("ibis", "kr", "fixtures"),
    """
    SELECT fixture_id, CASE WHEN home THEN home_team ELSE away_team END AS team_id, CASE WHEN home THEN home_expected_score ELSE away_expected_score END AS e_kr, coalesce(n, 0) AS live_books,
           CASE WHEN CASE WHEN home THEN home_expected_score ELSE away_expected_score END IS NULL THEN 'no_kr_available' WHEN coalesce(n, 0) < 2 THEN 'insufficient_live_books' END AS freeze_reason,
           CASE WHEN home THEN mh ELSE ma END / t + 0.5 * md / t + md / t * (0.5 - CASE WHEN home THEN mh ELSE ma END / t - 0.5 * md / t) AS e_live
    FROM (SELECT *, unnest([true, false]) AS home FROM fixtures) f LEFT JOIN kr USING (fixture_id) LEFT JOIN (
      SELECT *, mh + md + ma AS t FROM (SELECT fixture_id, count(*) AS n, median(CASE WHEN ok THEN pow(h, k) ELSE h / (h + d + a) END) AS mh,
             median(CASE WHEN ok THEN pow(d, k) ELSE d / (h + d + a) END) AS md, median(CASE WHEN ok THEN pow(a, k) ELSE a / (h + d + a) END) AS ma
      FROM (SELECT *, (lo + hi) / 2 AS k, pow(h, 0.01) + pow(d, 0.01) + pow(a, 0.01) >= 1 AND pow(h, 10) + pow(d, 10) + pow(a, 10) <= 1 AS ok FROM ibis WHERE i = 50) GROUP BY fixture_id)) USING (fixture_id)
    """,
)


@query(
    "live_layer",
    sql(
        f"""SELECT fixture_id, team_id, live_books, coalesce(freeze_reason, 'live') AS state,
                   {rnd('CASE WHEN freeze_reason IS NULL THEN 30 * (e_live - e_kr) ELSE 0.0 END', 5)} AS l_value FROM ilive""",
        "ilive",
    ),
)
def live_layer(spark, d):
    out = lv.live_layer(fixtures(spark, d), quotes(spark, d), frozen(spark, d), as_of(), 400 * 24 * 60.0)
    return out.select("fixture_id", "team_id", "live_books", F.coalesce("freeze_reason", F.lit("live")).alias("state"), r("l_value", 5).alias("l_value"))


@query(
    "publish_live",
    sql(
        f"""SELECT team_id, {rnd('l_value', 4)} AS l_value, {rnd('0.6 * (b_value + l_value) + 0.4 * round(b_value, 4)', 3)} AS published_index FROM state JOIN (
              SELECT team_id, arg_max(30 * (e_live - e_kr), fixture_id) AS l_value FROM ilive WHERE freeze_reason IS NULL GROUP BY 1) USING (team_id)""",
        "state",
        "ilive",
    ),
)
def publish_live(spark, d):
    layer = lv.live_layer(fixtures(spark, d), quotes(spark, d), frozen(spark, d), as_of(), 400 * 24 * 60.0)
    none = F.lit(None).cast("double")
    state = stored_state(spark, d).withColumns({"m1_locked": none, "r_market_frozen": none})
    out = lv.publish_live(lv.kickoff_freeze(state, layer), layer)
    return out.select("team_id", r("l_value", 4).alias("l_value"), r("published_index", 3).alias("published_index"))


@query(
    "seed_state",
    sql(f"SELECT team_id, league, {rnd('round(b_value, 4)', 2)} AS b_value, {rnd('round(b_value, 4)', 2)} AS r_market, 0.0::DOUBLE AS m1_value, 'bootstrap_v3' AS publish_reason FROM state", "state"),
)
def seed_state(spark, d):
    state, rows = lv.seed_state(team_state(spark, d), as_of())
    j = state.join(rows.select(F.col("team").alias("team_id"), "publish_reason"), "team_id")
    return j.select("team_id", "league", r("b_value", 2).alias("b_value"), r("r_market", 2).alias("r_market"), "m1_value", "publish_reason")


@query(
    "bootstrap_teams",
    sql(
        f"""SELECT t.team_id, {rnd('CASE WHEN f.confidence > 0.3 THEN f.r_futures ELSE 1500 END', 3)} AS b_value FROM (SELECT DISTINCT team_id FROM sides WHERE team_id NOT IN (SELECT team_id FROM state WHERE b_value > 1500)) t
            LEFT JOIN futab f USING (team_id)""",
        "sides",
        "futab",
    ),
)
def bootstrap_teams(spark, d):
    f, state = fixtures(spark, d), team_state(spark, d)
    nobody = ql.live_teams(f, as_of() - F.expr("INTERVAL 40 YEARS"))
    missing = rv.missing_teams(f, state.where(F.col("b_value") > 1500), nobody, spark.createDataFrame([], "source string"))
    fut = mk.futures_table(futures(spark, d), state, as_of() + F.expr("INTERVAL 5 HOURS"))
    return lv.bootstrap_rows(missing, fut).select("team_id", r("b_value", 3).alias("b_value"))


# --- the in-play layer of earlier generations, with quotes of alternate fixtures -----------------

fragment("lquotes", ("quotes",), "SELECT * FROM quotes WHERE fixture_id % 4 <> 0")
fragment(
    "lsrc",
    ("fixtures", "lquotes"),
    """
    SELECT f.fixture_id, CASE WHEN bool_or(h.fixture_id = f.fixture_id) THEN f.fixture_id ELSE min(h.fixture_id) END AS source_id
    FROM fixtures f JOIN (SELECT * FROM fixtures WHERE fixture_id IN (SELECT fixture_id FROM lquotes)) h ON h.home_team = f.home_team AND h.away_team = f.away_team AND h.date BETWEEN f.date - 3 AND f.date + 3 GROUP BY 1
    """,
)
fragment(
    "linplay",
    ("lsrc", "lquotes", "fixtures"),
    f"""SELECT * EXCLUDE (rn) FROM (SELECT f.fixture_id, q.* EXCLUDE (fixture_id), row_number() OVER (PARTITION BY f.fixture_id, bookmaker ORDER BY snapshot_time DESC, home_odds DESC, draw_odds DESC, away_odds DESC) AS rn
        FROM lquotes q JOIN lsrc s ON s.source_id = q.fixture_id JOIN fixtures f ON f.fixture_id = s.fixture_id WHERE snapshot_time > coalesce(commence_time, CAST(date AS TIMESTAMP)) AND snapshot_time <= TIMESTAMP '{AS_OF}'
          AND snapshot_time >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAYS AND least(home_odds, draw_odds, away_odds) >= 1.01) WHERE rn = 1""",
)
fragment(
    "lbis(fixture_id, bookmaker, h, d, a, lo, hi, i)",
    ("linplay",),
    """SELECT fixture_id, bookmaker, 1 / home_odds, 1 / draw_odds, 1 / away_odds, 0.01::DOUBLE, 10.0::DOUBLE, 0 FROM linplay UNION ALL
       SELECT fixture_id, bookmaker, h, d, a, CASE WHEN pow(h, (lo + hi) / 2) + pow(d, (lo + hi) / 2) + pow(a, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
              CASE WHEN pow(h, (lo + hi) / 2) + pow(d, (lo + hi) / 2) + pow(a, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM lbis WHERE i < 50""",
)
fragment(
    "llive",
    ("lbis", "kr", "fixtures"),
    """
    SELECT fixture_id, CASE WHEN home THEN home_team ELSE away_team END AS team_id, CASE WHEN home THEN home_expected_score ELSE away_expected_score END AS e_kr, coalesce(n, 0) AS live_books,
           CASE WHEN CASE WHEN home THEN home_expected_score ELSE away_expected_score END IS NULL THEN 'no_kr_available' WHEN coalesce(n, 0) < 2 THEN 'insufficient_live_books' END AS freeze_reason,
           CASE WHEN home THEN mh ELSE ma END / t + 0.5 * md / t AS e_live
    FROM (SELECT *, unnest([true, false]) AS home FROM fixtures) f LEFT JOIN kr USING (fixture_id) LEFT JOIN (
      SELECT *, mh + md + ma AS t FROM (SELECT fixture_id, count(*) AS n, median(CASE WHEN ok THEN pow(h, k) ELSE h / (h + d + a) END) AS mh,
             median(CASE WHEN ok THEN pow(d, k) ELSE d / (h + d + a) END) AS md, median(CASE WHEN ok THEN pow(a, k) ELSE a / (h + d + a) END) AS ma
      FROM (SELECT *, (lo + hi) / 2 AS k, pow(h, 0.01) + pow(d, 0.01) + pow(a, 0.01) >= 1 AND pow(h, 10) + pow(d, 10) + pow(a, 10) <= 1 AS ok FROM lbis WHERE i = 50) GROUP BY fixture_id)) USING (fixture_id)
    """,
)


def earlier_layer(spark, d):
    f = fixtures(spark, d)
    return lv.live_layer(f, quotes(spark, d).where(F.col("fixture_id") % 4 != 0), frozen(spark, d), as_of(), 400 * 24 * 60.0, corrected=False, among=f)


@query(
    "live_layer_earlier",
    sql(
        f"""SELECT fixture_id, team_id, live_books, coalesce(freeze_reason, 'live') AS state, {rnd('CASE WHEN freeze_reason IS NULL THEN 30 * (e_live - e_kr) ELSE 0.0 END', 5)} AS l_value FROM llive""",
        "llive",
    ),
)
def live_layer_earlier(spark, d):
    """The layer without draw correction; fixtures that nobody quotes read an alternate's quotes."""
    out = earlier_layer(spark, d)
    return out.select("fixture_id", "team_id", "live_books", F.coalesce("freeze_reason", F.lit("live")).alias("state"), r("l_value", 5).alias("l_value"))


@query(
    "publish_live_earlier",
    sql(
        f"""SELECT team_id, {rnd('l_value', 4)} AS l_value, {rnd('b_value + CASE WHEN length(team_id) % 2 = 0 THEN 1.0 ELSE 0.0 END + l_value', 3)} AS published_index FROM state JOIN (
              SELECT team_id, arg_max(30 * (e_live - e_kr), fixture_id) AS l_value FROM llive WHERE freeze_reason IS NULL GROUP BY 1) USING (team_id)""",
        "state",
        "llive",
    ),
)
def publish_live_earlier(spark, d):
    """The earlier generations' live index: B, the M1 locked at kickoff, and L."""
    layer = earlier_layer(spark, d)
    out = lv.publish_live(lv.kickoff_freeze(stored_state(spark, d), layer), layer, weighted=False)
    return out.select("team_id", r("l_value", 4).alias("l_value"), r("published_index", 3).alias("published_index"))
