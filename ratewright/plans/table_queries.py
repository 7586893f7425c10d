"""Keyed tables, feeds, name resolution, history and watch-dog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.functions import text as tx
from ratewright.operators import consensus as k
from ratewright.operators import history as hs
from ratewright.operators import quality as ql
from ratewright.operators import resolve as rv
from ratewright.operators import settle as st
from ratewright.operators import tables as tb
from ratewright.plans.consensus_queries import frozen
from ratewright.plans.rating_queries import futures, serving, team_state
from ratewright.plans.registry import fragment, query, rnd, sql
from ratewright.plans.settle_queries import log_inputs
from ratewright.plans.shapes import AS_OF, as_of, fixtures, history, quotes, table
from ratewright.sources import export as ex
from ratewright.sources import nested as ns


def r(col, n=6):
    return F.round(col, n)


DAY = AS_OF[:10]
ODDS_ORDER = ["snapshot_time", "home_odds", "draw_odds", "away_odds"]

# --- scans and filters -------------------------------------------------------------------


@query(
    "filtered_scan",
    sql(
        """SELECT fixture_id, league, home_team, away_team, date FROM fixtures
           WHERE status IN ('finished', 'live') AND league NOT IN ('CUP') AND date >= DATE '1996-01-01' AND date < DATE '1999-01-01'
             AND commence_time IS NOT NULL AND home_team <> 'NATION_3' AND (home_team ILIKE 'nation_1%' OR away_team = 'NATION_7')""",
        "fixtures",
    ),
)
def filtered_scan(spark, d):
    day = lambda v: F.lit(v).cast("date")
    preds = [
        ("status", "in", ["finished", "live"]), ("league", "not_in", ["CUP"]), ("date", "gte", day("1996-01-01")), ("date", "lt", day("1999-01-01")),
        ("commence_time", "is_null", False), ("home_team", "neq", "NATION_3"),
        (None, "any", [("home_team", "ilike", "nation_1%"), ("away_team", "eq", "NATION_7")]),
    ]
    return tb.scan(fixtures(spark, d), ["fixture_id", "league", "home_team", "away_team", "date"], preds)


@query(
    "lookup_by_ids",
    sql("SELECT fixture_id, bookmaker, snapshot_time, source FROM quotes WHERE fixture_id IN (SELECT fixture_id FROM fixtures WHERE status = 'finished' AND league = 'ASIA')", "quotes", "fixtures"),
)
def lookup_by_ids(spark, d):
    ids = fixtures(spark, d).where((F.col("status") == "finished") & (F.col("league") == "ASIA"))
    return tb.lookup(quotes(spark, d), ids, "fixture_id").select("fixture_id", "bookmaker", "snapshot_time", "source")


@query(
    "quote_validity",
    sql(
        """SELECT bookmaker, count(*) AS n, count(*) FILTER (home_odds > 1 AND draw_odds > 1 AND away_odds > 1) AS over_one,
                  count(*) FILTER (home_odds >= 1.01 AND draw_odds >= 1.01 AND away_odds >= 1.01) AS usable,
                  count(*) FILTER (home_odds > 0 AND draw_odds > 0 AND away_odds > 0) AS shown FROM quotes GROUP BY 1""",
        "quotes",
    ),
)
def quote_validity(spark, d):
    v = lambda m, s: F.count_if(x.valid_quote(*k.ODDS, minimum=m, strict=s))
    return quotes(spark, d).groupBy("bookmaker").agg(
        F.count(F.lit(1)).alias("n"), v(1.0, True).alias("over_one"), v(1.01, False).alias("usable"), v(0.0, True).alias("shown")
    )


@query(
    "days_before_kickoff",
    sql(
        """SELECT days_before, count(*) AS n FROM (SELECT greatest(0, floor((epoch_us(kickoff) - epoch_us(snapshot_time)) / 8.64e10 + 0.5))::INTEGER AS days_before
           FROM quotes JOIN starts USING (fixture_id)) GROUP BY 1""",
        "quotes",
        "starts",
    ),
)
def days_before_kickoff(spark, d):
    starts = fixtures(spark, d).select("fixture_id", t.kickoff_or_default("commence_time", "date", "23:59:59").alias("kickoff"))
    days = t.days_before("snapshot_time", "kickoff").alias("days_before")
    return quotes(spark, d).join(starts, "fixture_id").select(days).groupBy("days_before").agg(F.count(F.lit(1)).alias("n"))


@query(
    "in_play_quotes",
    sql(
        f"""SELECT fixture_id, bookmaker, max(snapshot_time) AS latest, count(*) AS n FROM quotes JOIN (
              SELECT fixture_id, coalesce(commence_time, CAST(date AS TIMESTAMP)) AS k0 FROM fixtures) USING (fixture_id)
            WHERE snapshot_time > k0 AND snapshot_time <= TIMESTAMP '{AS_OF}' AND snapshot_time >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS GROUP BY ALL""",
        "quotes",
        "fixtures",
    ),
)
def in_play_quotes(spark, d):
    rows = k.in_play(quotes(spark, d), fixtures(spark, d), as_of(), 30 * 24 * 60.0)
    return rows.groupBy("fixture_id", "bookmaker").agg(F.max("snapshot_time").alias("latest"), F.count(F.lit(1)).alias("n"))


@query("season_labels", sql("SELECT printf('%d-%02d', y, (y + 1) % 100) AS season, count(*) AS n FROM (SELECT year(date) - CASE WHEN month(date) >= 7 THEN 0 ELSE 1 END AS y FROM fixtures) GROUP BY 1", "fixtures"))
def season_labels(spark, d):
    return fixtures(spark, d).groupBy(t.season_label("date").alias("season")).agg(F.count(F.lit(1)).alias("n"))


# --- keyed tables ------------------------------------------------------------------------

fragment(
    "latest_all",
    ("quotes",),
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id, bookmaker ORDER BY snapshot_time DESC, home_odds DESC, draw_odds DESC, away_odds DESC) AS rn FROM quotes) WHERE rn = 1""",
)


@query("upsert_latest", sql("SELECT fixture_id, bookmaker, snapshot_time, round(home_odds, 6) AS home_odds, round(away_odds, 6) AS away_odds FROM latest_all", "latest_all"))
def upsert_latest(spark, d):
    q = quotes(spark, d).select("fixture_id", "bookmaker", *ODDS_ORDER)
    cut = F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00"))
    old, new = q.where(F.col("snapshot_time") < cut), q.where(F.col("snapshot_time") >= cut)
    out = tb.upsert(tb.latest_quotes(old), new, ["fixture_id", "bookmaker"], ODDS_ORDER)
    return out.select("fixture_id", "bookmaker", "snapshot_time", r("home_odds").alias("home_odds"), r("away_odds").alias("away_odds"))


@query(
    "insert_absent",
    sql("SELECT fixture_id, bookmaker, snapshot_time FROM latest_all WHERE NOT (fixture_id, bookmaker) IN (SELECT fixture_id, bookmaker FROM quotes WHERE source = 'feed_a')", "latest_all"),
)
def insert_absent(spark, d):
    q = quotes(spark, d)
    have = q.where(F.col("source") == "feed_a")
    return tb.insert_absent(have, tb.latest_quotes(q), ["fixture_id", "bookmaker"]).select("fixture_id", "bookmaker", "snapshot_time")


@query(
    "dedup_last",
    sql(
        """SELECT fixture_id, source, bookmaker, snapshot_time, round(home_odds, 6) AS home_odds FROM (
             SELECT *, row_number() OVER (PARTITION BY fixture_id, source, bookmaker, snapshot_time ORDER BY home_odds DESC, draw_odds DESC, away_odds DESC) AS rn FROM quotes) WHERE rn = 1""",
        "quotes",
    ),
)
def dedup_last(spark, d):
    keys = ["fixture_id", "source", "bookmaker", "snapshot_time"]
    return tb.pick_by(quotes(spark, d), keys, k.ODDS).select(*keys, r("home_odds").alias("home_odds"))


@query(
    "serving_backfill",
    sql(
        """SELECT fixture_id, bookmaker, snapshot_time FROM (
             SELECT q.*, row_number() OVER (PARTITION BY fixture_id, bookmaker ORDER BY snapshot_time DESC, home_odds DESC, draw_odds DESC, away_odds DESC) AS rn
             FROM quotes q JOIN starts USING (fixture_id) WHERE snapshot_time < kickoff) WHERE rn = 1 AND bookmaker <> 'book_1'""",
        "quotes",
        "starts",
    ),
)
def serving_backfill(spark, d):
    pre = tb.latest_quotes(k.pre_kickoff(quotes(spark, d), fixtures(spark, d)))
    have = pre.where(F.col("bookmaker") == "book_1")
    return tb.insert_absent(have, pre, ["fixture_id", "bookmaker"]).select("fixture_id", "bookmaker", "snapshot_time")


@query(
    "quote_cascade",
    sql(
        """SELECT fixture_id, source_rank, count(*) AS books FROM (
             SELECT f.fixture_id, f.source_rank, a.bookmaker FROM (
               SELECT f.fixture_id, CASE WHEN s.fixture_id IS NOT NULL THEN 1 WHEN r.fixture_id IS NOT NULL THEN 2 WHEN xs.fixture_id IS NOT NULL THEN 3 ELSE 4 END AS source_rank,
                      coalesce(r.fixture_id, alt) AS src
               FROM fixtures f LEFT JOIN srv s USING (fixture_id) LEFT JOIN arc r USING (fixture_id)
               LEFT JOIN (SELECT f.fixture_id, min(g.fixture_id) AS alt FROM fixtures f JOIN fixtures g ON g.home_team = f.home_team AND g.away_team = f.away_team
                          AND g.date BETWEEN f.date - 3 AND f.date + 3 AND g.fixture_id <> f.fixture_id JOIN arc ON arc.fixture_id = g.fixture_id GROUP BY 1) x USING (fixture_id)
               LEFT JOIN srv xs ON xs.fixture_id = alt
               WHERE r.fixture_id IS NOT NULL OR alt IS NOT NULL) f JOIN pl a ON a.fixture_id = f.src AND (f.source_rank % 2 = 0 OR a.bookmaker < 'book_4'))
           GROUP BY ALL"""
        .replace("JOIN pl a", "JOIN (SELECT fixture_id, bookmaker FROM quotes JOIN starts USING (fixture_id) WHERE snapshot_time < kickoff GROUP BY ALL) a")
        .replace("LEFT JOIN srv s", "LEFT JOIN (SELECT DISTINCT fixture_id FROM quotes JOIN starts USING (fixture_id) WHERE snapshot_time < kickoff AND bookmaker < 'book_4') s")
        .replace("LEFT JOIN srv xs", "LEFT JOIN (SELECT DISTINCT fixture_id FROM quotes JOIN starts USING (fixture_id) WHERE snapshot_time < kickoff AND bookmaker < 'book_4') xs")
        .replace("LEFT JOIN arc r", "LEFT JOIN (SELECT DISTINCT fixture_id FROM quotes JOIN starts USING (fixture_id) WHERE snapshot_time < kickoff) r")
        .replace("JOIN arc ON", "JOIN (SELECT DISTINCT fixture_id FROM quotes JOIN starts USING (fixture_id) WHERE snapshot_time < kickoff) arc ON"),
        "quotes",
        "starts",
    ),
)
def quote_cascade(spark, d):
    f, q = fixtures(spark, d), quotes(spark, d)
    srv = tb.latest_quotes(k.pre_kickoff(q, f).where(F.col("bookmaker") < "book_4"))
    rows = k.quotes_cascade(f, srv, q)
    return rows.groupBy("fixture_id", "source_rank").agg(F.count(F.lit(1)).alias("books"))


@query(
    "alternate_fixtures",
    sql(
        """SELECT f.fixture_id, min(g.fixture_id) AS alt_fixture_id FROM fixtures f JOIN fixtures g ON g.home_team = f.home_team AND g.away_team = f.away_team
             AND g.date BETWEEN f.date - 3 AND f.date + 3 AND g.fixture_id <> f.fixture_id WHERE g.fixture_id IN (SELECT fixture_id FROM preko) GROUP BY 1""",
        "fixtures",
        "preko",
    ),
)
def alternate_fixtures(spark, d):
    return k.alternates(fixtures(spark, d), serving(spark, d))


# --- feeds -------------------------------------------------------------------------------


def events_json(spark, d):
    """Quote events as landed JSON text: one per order, its line items being books with three markets."""
    f = fixtures(spark, d).select("fixture_id", "home_team", "away_team", "commence_time")
    q = tb.latest_quotes(quotes(spark, d))
    # A book's odds are gathered as three numbers; its markets are spelled out once the event's row is there.
    books = q.join(f, "fixture_id").groupBy("fixture_id", "home_team", "away_team", "commence_time").agg(
        F.collect_list(F.struct("bookmaker", *k.ODDS)).alias("_books")
    )
    out = lambda n, p, pt=None: F.struct(n.alias("name"), p.alias("price"), (F.lit(None).cast("double") if pt is None else pt).alias("point"))
    mk = lambda key, *o: F.struct(F.lit(key).alias("key"), F.array(*o).alias("outcomes"))

    def book(b):
        home, draw, away = (b[o] for o in k.ODDS)
        half = F.floor(home) + 0.5
        markets = F.array(
            mk("h2h", out(F.col("home_team"), home), out(F.lit("Draw"), draw), out(F.col("away_team"), away)),
            mk("totals", out(F.lit("Over"), draw, half), out(F.lit("Under"), away, half)),
            mk("spreads", out(F.col("home_team"), home, -half), out(F.col("away_team"), away, half)),
        )
        return F.struct(b["bookmaker"].alias("key"), markets.alias("markets"))

    books = books.withColumn("bookmakers", F.transform("_books", book))
    return books.select("fixture_id", F.to_json(F.struct(F.col("fixture_id").cast("string").alias("id"), "commence_time", "home_team", "away_team", "bookmakers")).alias("body"))


def parsed(spark, d):
    return events_json(spark, d).select("fixture_id", F.from_json("body", ns.EVENT).alias("e"))


@query("flatten_h2h", sql("SELECT fixture_id, bookmaker, round(home_odds, 6) AS home_odds, round(draw_odds, 6) AS draw_odds, round(away_odds, 6) AS away_odds FROM latest_all", "latest_all"))
def flatten_h2h(spark, d):
    out = ns.flatten_h2h(parsed(spark, d), F.col("e"), ["fixture_id"])
    return out.select("fixture_id", "bookmaker", *[r(o).alias(o) for o in k.ODDS])


@query("flatten_totals", sql("SELECT fixture_id, bookmaker, floor(home_odds) + 0.5 AS point, round(draw_odds, 6) AS over_odds, round(away_odds, 6) AS under_odds FROM latest_all", "latest_all"))
def flatten_totals(spark, d):
    out = ns.flatten_totals(parsed(spark, d), F.col("e"), ["fixture_id"])
    return out.select("fixture_id", "bookmaker", "point", r("over_odds").alias("over_odds"), r("under_odds").alias("under_odds"))


@query("flatten_spreads", sql("SELECT fixture_id, bookmaker, -floor(home_odds) - 0.5 AS home_point, round(home_odds, 6) AS home_odds, floor(home_odds) + 0.5 AS away_point, round(away_odds, 6) AS away_odds FROM latest_all", "latest_all"))
def flatten_spreads(spark, d):
    out = ns.flatten_spreads(parsed(spark, d), F.col("e"), ["fixture_id"])
    return out.select("fixture_id", "bookmaker", "home_point", r("home_odds").alias("home_odds"), "away_point", r("away_odds").alias("away_odds"))


@query(
    "fixture_feed",
    sql(
        """SELECT o_orderkey AS fixture_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN m IN (0, 1) THEN 'finished' WHEN m = 2 THEN 'live' ELSE 'upcoming' END AS status,
                  CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE CAST(o_custkey % 4 AS VARCHAR) || '-' || CAST(o_custkey % 3 AS VARCHAR) END AS score,
                  CASE WHEN o_orderpriority = '5-LOW' THEN 'champions_league' ELSE 'league' END AS competition
           FROM (SELECT *, o_orderkey % 5 AS m FROM orders)"""
    ),
)
def fixture_feed(spark, d):
    o = table(spark, d, "orders")
    codes = F.element_at(F.array(*[F.lit(v) for v in ("FT", "PEN", "HT", "NS", "TBD")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    shown = F.col("o_orderkey") % 7 != 0
    name = lambda s: F.struct(F.lit(s).alias("name"))
    body = F.to_json(
        F.struct(
            F.struct(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date"), F.struct(codes.alias("short")).alias("status")).alias("fixture"),
            F.struct(F.col("o_orderpriority").alias("name")).alias("league"),
            F.struct(name("A").alias("home"), name("B").alias("away")).alias("teams"),
            F.struct(F.when(shown, F.col("o_custkey") % 4).alias("home"), F.when(shown, F.col("o_custkey") % 3).alias("away")).alias("goals"),
        )
    )
    feed = o.select(F.from_json(body, ns.FIXTURE_FEED).alias("j")).select("j.*")
    return ns.flatten_fixtures(feed, ("5-LOW",)).select("fixture_id", "date", "status", "score", "competition")


def prediction_events(spark, d):
    """Prediction-market events from orders: three binary markets each; every third is a side-market event."""
    f = fixtures(spark, d).select("fixture_id", "home_team", "away_team")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("fixture_id"), (F.col("o_totalprice") % 1000 / 1000).alias("p"), "o_totalprice")
    side = F.col("fixture_id") % 3 == 0
    title = F.concat("home_team", F.lit(" vs. "), "away_team", F.when(side, " - More Markets").otherwise(""))

    def market(i, question, item, price):
        yes, no = x.half_up(price, 4).cast("string"), x.half_up(1 - price, 4).cast("string")
        pair = F.concat(F.lit('["'), yes, F.lit('", "'), no, F.lit('"]'))
        bad = F.when((F.col("fixture_id") % 10 == 0) & F.lit(i == 1), "oops").otherwise(pair)
        return F.struct(
            F.lit(str(i)).alias("id"), question.alias("question"), F.lit('["Yes", "No"]').alias("outcomes"), F.when(side, bad).otherwise(pair).alias("outcomePrices"),
            (F.col("o_totalprice") / (i + 1)).alias("volumeNum"), item.alias("groupItemTitle"), F.lit(True).alias("active"), (F.lit(i == 2) & (F.col("fixture_id") % 4 == 0)).alias("closed"),
        )

    none = F.lit(None).cast("string")
    markets = F.array(
        market(0, F.concat(F.lit("Will "), "home_team", F.lit(" win?")), F.col("home_team"), F.col("p")),
        market(1, F.lit("Will it end in a draw?"), none, (1 - F.col("p")) / 2),
        market(2, F.concat(F.lit("Spread: "), "away_team"), F.col("away_team"), (1 - F.col("p")) / 3),
    )
    return f.join(o, "fixture_id").select(F.col("fixture_id").alias("id"), title.alias("title"), F.col("o_totalprice").alias("volume"), markets.alias("markets"))


@query(
    "moneyline",
    sql(
        """SELECT id, CASE WHEN greatest(h, dr, a) >= 0.99 OR least(h, dr, a) <= 0.001 THEN 'resolved' ELSE 'active' END AS market_status, floor(h * 1e4 + 0.5) / 1e4 AS home_prob,
                  floor(dr * 1e4 + 0.5) / 1e4 AS draw_prob, floor(a * 1e4 + 0.5) / 1e4 AS away_prob, floor(v * 100 + 0.5) / 100 AS volume
           FROM (SELECT o_orderkey AS id, floor(p * 1e4 + 0.5) / 1e4 AS h, floor((1 - p) / 2 * 1e4 + 0.5) / 1e4 AS dr,
                        CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE floor((1 - p) / 3 * 1e4 + 0.5) / 1e4 END AS a,
                        o_totalprice + o_totalprice / 2 + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice / 3 END AS v
                 FROM (SELECT *, o_totalprice % 1000 / 1000 AS p FROM orders) WHERE o_orderkey % 3 <> 0) WHERE greatest(h, dr, a) > 0"""
    ),
)
def moneyline(spark, d):
    return ns.moneyline(prediction_events(spark, d), ["id"]).select("id", "market_status", "home_prob", "draw_prob", "away_prob", "volume")


@query(
    "side_markets",
    sql(
        """SELECT id, market_type, count(*) AS n, round(sum(volume), 2) AS volume FROM (
             SELECT o_orderkey AS id, unnest(['moneyline', 'moneyline', 'spread']) AS market_type, unnest([1, 2, 3]) AS i,
                    unnest([floor(o_totalprice * 100 + 0.5) / 100, floor(o_totalprice / 2 * 100 + 0.5) / 100, floor(o_totalprice / 3 * 100 + 0.5) / 100]) AS volume
             FROM orders WHERE o_orderkey % 3 = 0) WHERE NOT (i = 2 AND id % 10 = 0) AND NOT (i = 3 AND id % 4 = 0) GROUP BY ALL"""
    ),
)
def side_markets(spark, d):
    out = ns.side_markets(prediction_events(spark, d), ["id"])
    return out.groupBy("id", "market_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("volume"), 2).alias("volume"))


@query(
    "fetch_plan",
    sql(
        """SELECT fixture_id, CAST(day_offset AS INTEGER) AS day_offset, 10.0::DOUBLE * row_number() OVER (ORDER BY date, fixture_id, day_offset) AS running_cost FROM (
             SELECT fixture_id, date, day_offset FROM (SELECT fixture_id, date, unnest([1, 2, 3]) AS day_offset FROM fixtures)
             WHERE NOT (fixture_id, day_offset) IN (SELECT fixture_id, CAST(bookmaker[6:] AS INTEGER) FROM quotes) ORDER BY date, fixture_id, day_offset LIMIT 50)""",
        "fixtures",
        "quotes",
    ),
)
def fetch_plan(spark, d):
    done = quotes(spark, d).select("fixture_id", F.substring("bookmaker", 6, 5).cast("int").alias("day_offset")).distinct()
    return ns.fetch_plan(fixtures(spark, d), done, 500.0).select("fixture_id", "day_offset", "running_cost")


# --- names -------------------------------------------------------------------------------


@query(
    "normal_names",
    sql(
        r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw),
              '\b(fc|cf|afc|sc|ssc|ss|ac|as|us|rc|rcd|ca|sv|vfb|tsg|1\.\s*fc|1\.\s*fsv|bsc|ud|cd|fk|bv|if|sk|nk|ogc|osc|aj|cfc)\b', '', 'g'), '\b(de|di)\b', '', 'g'), '\bcalcio\b', '', 'g'),
              '\b(1[89]\d{2}|0\d)\b', '', 'g'), '[''`.-]', ' ', 'g'), '\s+', ' ', 'g')) AS name,
              trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\s+\d{4}$', ''), '\s+(FC|AFC|SCO|CF|CFC)$', '', 'i'), '^AFC\s+', '', 'i'),
              '&', 'and', 'g'), '\s+de\s+', ' ', 'gi'), '\s+di\s+', ' ', 'gi'), '\s+Calcio$', '', 'i')) AS market
            FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'AFC ' ELSE '' END || p_name || CASE p_size % 3 WHEN 0 THEN ' de Vigo & Sons 1913' WHEN 1 THEN ' FC' ELSE '-Calcio' END AS raw FROM part)"""
    ),
)
def normal_names(spark, d):
    raw = F.concat(
        F.when(F.col("p_size") % 4 == 0, "AFC ").otherwise(""), "p_name",
        F.when(F.col("p_size") % 3 == 0, " de Vigo & Sons 1913").when(F.col("p_size") % 3 == 1, " FC").otherwise("-Calcio"),
    )
    return table(spark, d, "part").select("p_partkey", tx.normal_name(raw).alias("name"), tx.market_name(raw).alias("market"))


@query(
    "stripped_accents",
    sql("SELECT doc_id, length(strip_accents(text)) AS n, md5(strip_accents(text)) AS digest FROM documents"),
)
def stripped_accents(spark, d):
    plain = tx.strip_accents("text")
    return table(spark, d, "documents").select("doc_id", F.length(plain).alias("n"), F.md5(plain).alias("digest"))


@query(
    "synthetic_ids",
    sql(
        """SELECT s_name, 9000000 + abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 1000000 AS id FROM (
             SELECT s_name, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(s_name, ''), lambda ch: ascii(ch)::HUGEINT)), lambda a, v: (a * 31 + v) % 4294967296) AS BIGINT) AS h FROM supplier)"""
    ),
)
def synthetic_ids(spark, d):
    return table(spark, d, "supplier").select("s_name", tx.synthetic_id("s_name").alias("id"))


def feed_events(spark, d):
    """Events naming their sides exactly, with a club token, or by an alias; dates up to two days off."""
    f = fixtures(spark, d).where(F.col("competition") == "league")
    kind = F.col("fixture_id") % 4
    alias = lambda n: F.when(kind == 1, F.concat(n, F.lit(" FC"))).when(kind == 2, F.concat(F.lit("ALIAS "), n)).when(kind == 3, F.concat(F.lit("zz"), n)).otherwise(F.col(n))
    return f.select(
        F.concat(F.lit("ev"), F.col("fixture_id").cast("string")).alias("event_id"), alias("home_team").alias("home_team"), alias("away_team").alias("away_team"),
        F.date_add("date", (F.col("fixture_id") % 3 - 1).cast("int")).alias("event_date"),
    )


@query(
    "resolve_events",
    sql(
        """SELECT e.event_id, coalesce(b.stage, 'synthetic') AS stage, coalesce(b.fixture_id, 9000000 + abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 1000000) AS fixture_id
           FROM (SELECT 'ev' || CAST(fixture_id AS VARCHAR) AS event_id, home_team, away_team, CAST(date + CAST(fixture_id % 3 - 1 AS INTEGER) AS DATE) AS ed, fixture_id % 4 AS kind,
                        CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split('ev' || CAST(fixture_id AS VARCHAR), ''), lambda ch: ascii(ch)::HUGEINT)), lambda a, v: (a * 31 + v) % 4294967296) AS BIGINT) AS h
                 FROM fixtures WHERE competition = 'league') e
           LEFT JOIN (SELECT event_id, any_value(stage) AS stage, arg_min(fixture_id, (gap, fixture_id)) AS fixture_id FROM (
             SELECT 'ev' || CAST(e.fixture_id AS VARCHAR) AS event_id, CASE WHEN e.fixture_id % 4 = 1 THEN 'normalised' ELSE 'exact' END AS stage, f.fixture_id,
                    abs(date_diff('day', f.date, CAST(e.date + CAST(e.fixture_id % 3 - 1 AS INTEGER) AS DATE))) AS gap
             FROM fixtures e JOIN fixtures f ON f.home_team = e.home_team AND f.away_team = e.away_team WHERE e.competition = 'league' AND e.fixture_id % 4 <> 3) WHERE gap <= 2 GROUP BY 1) b USING (event_id)""",
        "fixtures",
    ),
)
def resolve_events(spark, d):
    n = table(spark, d, "nation")
    aliases = n.select(F.concat(F.lit("ALIAS "), "n_name").alias("source"), F.col("n_name").alias("canonical"))
    return rv.resolve_events(feed_events(spark, d), fixtures(spark, d), aliases).select("event_id", "stage", "fixture_id")


@query(
    "fuzzy_alternates",
    sql(
        """SELECT f.fixture_id, min(g.fixture_id) AS alt_fixture_id FROM fixtures f JOIN fixtures g ON g.league = f.league AND g.date BETWEEN f.date - 3 AND f.date + 3 AND g.fixture_id <> f.fixture_id
             AND (contains(g.home_team, f.home_team) OR contains(f.home_team, g.home_team)) AND (contains(g.away_team, f.away_team) OR contains(f.away_team, g.away_team)) GROUP BY 1""",
        "fixtures",
    ),
)
def fuzzy_alternates(spark, d):
    return rv.fuzzy_alternates(fixtures(spark, d))


@query(
    "phantom_duplicates",
    sql(
        """SELECT p.fixture_id + 9000001 AS fixture_id FROM fixtures p WHERE status = 'upcoming' AND EXISTS (SELECT 1 FROM fixtures f WHERE f.status <> 'cancelled'
             AND f.home_team = p.home_team AND f.away_team = p.away_team AND f.date BETWEEN p.date + 2 - 3 AND p.date + 2 + 3)""",
        "fixtures",
    ),
)
def phantom_duplicates(spark, d):
    f = fixtures(spark, d).withColumn("is_synthetic", F.lit(False))
    made = {"fixture_id": F.col("fixture_id") + 9000001, "date": F.date_add("date", 2), "is_synthetic": F.lit(True)}
    copies = f.where(F.col("status") == "upcoming").withColumns(made)
    return rv.phantom_duplicates(f.unionByName(copies)).select("fixture_id")


@query(
    "missing_teams",
    sql(f"SELECT DISTINCT team_id FROM sides WHERE team_id NOT IN (SELECT team_id FROM state WHERE b_value > 1500) AND team_id NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 7 = 0)", "sides", "state"),
)
def missing_teams(spark, d):
    f = fixtures(spark, d)
    al = table(spark, d, "nation").where(F.col("n_nationkey") % 7 == 0).select(F.col("n_name").alias("source"))
    frozen_teams = ql.live_teams(f, as_of() - F.expr("INTERVAL 40 YEARS"))
    return rv.missing_teams(f, team_state(spark, d).where(F.col("b_value") > 1500), frozen_teams, al)


# --- history -----------------------------------------------------------------------------

HKEY = ["ts", "event_id"]


@query(
    "downsample_15m",
    sql(
        """SELECT event_id, team, ts, publish_reason FROM history WHERE publish_reason <> 'market_refresh' UNION ALL
           SELECT arg_max(event_id, (ts, event_id)), team, max(ts), 'market_refresh' FROM history WHERE publish_reason = 'market_refresh' GROUP BY team, time_bucket(INTERVAL 15 MINUTES, ts)""",
        "history",
    ),
)
def downsample_15m(spark, d):
    return hs.downsample(history(spark, d), 900, HKEY, ("market_refresh",)).select("event_id", "team", "ts", "publish_reason")


@query(
    "downsample_hourly",
    sql(
        """SELECT event_id, team, ts FROM (SELECT *, row_number() OVER (PARTITION BY team, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM history) WHERE rn = 1""",
        "history",
    ),
)
def downsample_hourly(spark, d):
    return hs.downsample(history(spark, d), 3600, HKEY).select("event_id", "team", "ts")


@query("downsample_daily", sql("SELECT arg_max(event_id, (ts, event_id)) AS event_id, team, max(ts) AS ts FROM history GROUP BY team, date_trunc('day', ts)", "history"))
def downsample_daily(spark, d):
    return hs.downsample(history(spark, d), 86400, HKEY).select("event_id", "team", "ts")


@query(
    "volume_delta",
    sql("SELECT event_id, team, coalesce(floor((price - lag(price) OVER (PARTITION BY team, publish_reason ORDER BY ts, event_id)) * 100 + 0.5) / 100, 0.0) AS volume_delta FROM history", "history"),
)
def volume_delta(spark, d):
    return hs.volume_change(history(spark, d), ["team", "publish_reason"], HKEY, "price").select("event_id", "team", "volume_delta")


@query(
    "twap",
    sql(
        f"""SELECT team, w AS window_start, count(*) AS points, {rnd('sum(pp * dt) / sum(dt)', 6)} AS twap_price, {rnd('sum(pp * dt) / sum(dt) * 5 + 800', 6)} AS twap_index FROM (
             SELECT team, w, lag(price) OVER x AS pp, epoch_us(ts) - epoch_us(lag(ts) OVER x) AS dt FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS w FROM history)
             WINDOW x AS (PARTITION BY team, w ORDER BY ts, event_id)) GROUP BY ALL HAVING count(*) >= 3""",
        "history",
    ),
)
def twap(spark, d):
    out = hs.twap(history(spark, d), 86400)
    return out.select("team", "window_start", "points", r("twap_price").alias("twap_price"), r("twap_index").alias("twap_index"))


@query(
    "feedback",
    sql(
        f"""SELECT team, regime, {rnd('greatest(-20.0, least(20.0, CASE regime WHEN \'live\' THEN 0.15 WHEN \'prematch\' THEN 0.10 ELSE 0.05 END * (ti - idx)))', 4)} AS f_value FROM (
             SELECT t.team, t.ti, l.idx, CASE WHEN l.h % 4 = 0 THEN 'live' WHEN l.h % 4 = 1 THEN 'offseason' WHEN l.h % 4 = 2 THEN 'prematch' ELSE 'between' END AS regime FROM (
               SELECT team, sum(pp * dt) / sum(dt) * 5 + 800 AS ti FROM (SELECT team, lag(price) OVER x AS pp, epoch_us(ts) - epoch_us(lag(ts) OVER x) AS dt FROM history
                 WHERE ts >= TIMESTAMP '2024-01-30' WINDOW x AS (PARTITION BY team ORDER BY ts, event_id)) GROUP BY 1 HAVING count(*) >= 3) t
             JOIN (SELECT team, arg_max(published_index, (ts, event_id)) AS idx, length(team) + arg_max(event_id, (ts, event_id)) AS h FROM history GROUP BY 1) l USING (team))""",
        "history",
    ),
)
def feedback(spark, d):
    h = history(spark, d)
    tw = hs.twap(h.where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00"))), 86400)
    last = tb.pick_by(h, ["team"], HKEY).withColumn("k", (F.length("team") + F.col("event_id")) % 4)
    j = tw.join(last, "team")
    hours = F.when(F.col("k") == 2, 2.0).when(F.col("k") == 3, 9.0)
    j = j.withColumn("regime", x.regime(F.col("k") == 0, hours))
    return j.select("team", "regime", r(x.feedback("regime", "twap_index", "published_index"), 4).alias("f_value"))


@query(
    "around_matches",
    sql(
        """SELECT m.fixture_id, m.team, count(*) AS points, max(h.ts) AS latest FROM (
             SELECT l_orderkey * 10 + l_linenumber AS fixture_id, 'TEAM_' || CAST(l_suppkey % 150 AS VARCHAR) AS team, TIMESTAMP '2024-01-01' + to_hours(l_partkey % 700) AS k FROM lineitem) m
           JOIN (SELECT team, max(ts) AS ts FROM history GROUP BY team, time_bucket(INTERVAL 15 MINUTES, ts)) h ON h.team = m.team AND h.ts BETWEEN m.k - INTERVAL 24 HOURS AND m.k + INTERVAL 24 HOURS GROUP BY ALL""",
        "history",
    ),
)
def around_matches(spark, d):
    li = table(spark, d, "lineitem")
    kick = F.timestamp_add("HOUR", (F.col("l_partkey") % 700).cast("int"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    f = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fixture_id"), kick.cast("date").alias("date"), kick.alias("commence_time"),
        F.concat(F.lit("TEAM_"), (F.col("l_suppkey") % 150).cast("string")).alias("home_team"), F.lit("none").alias("away_team"),
    )
    out = hs.around_matches(f.distinct(), history(spark, d), HKEY)
    return out.join(f.groupBy("fixture_id", F.col("home_team").alias("team"), F.col("commence_time").alias("kickoff")).agg(F.count(F.lit(1)).alias("_n")), ["fixture_id", "team", "kickoff"]).groupBy("fixture_id", "team").agg(
        F.sum("_n").alias("points"), F.max("ts").alias("latest")
    )


@query(
    "timeframe",
    sql(
        """SELECT team, ts, round(published_index, 4) AS published_index, publish_reason FROM i UNION ALL
           SELECT team, TIMESTAMP '2024-01-10', round(arg_min(published_index, (ts, event_id)), 4), '_anchor' FROM i GROUP BY team HAVING min(ts) > TIMESTAMP '2024-01-10' UNION ALL
           SELECT team, TIMESTAMP '2024-01-20', round(arg_max(published_index, (ts, event_id)), 4), '_anchor' FROM i GROUP BY team HAVING max(ts) < TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR""".replace(
            "FROM i", "FROM (SELECT * FROM history WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AND publish_reason <> 'bootstrap')"
        ),
        "history",
    ),
)
def timeframe(spark, d):
    at = lambda v: F.to_timestamp_ntz(F.lit(v))
    out = hs.timeframe(history(spark, d), at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00"))
    return out.select("team", "ts", r("published_index", 4).alias("published_index"), "publish_reason")


@query(
    "display_days",
    sql(
        """SELECT event_id, CASE WHEN publish_reason = 'settlement' THEN coalesce(date, CAST(ts AS DATE)) WHEN publish_reason = 'bootstrap' THEN coalesce(first_match, CAST(ts AS DATE)) ELSE CAST(ts AS DATE) END AS day
           FROM history LEFT JOIN (SELECT fixture_id AS event_id, date FROM fixtures) USING (event_id) LEFT JOIN (SELECT replace(team_id, 'NATION', 'TEAM') AS team, min(date) AS first_match FROM sides GROUP BY 1) USING (team)""",
        "history",
        "fixtures",
        "sides",
    ),
)
def display_days(spark, d):
    f = fixtures(spark, d)
    first = st.team_rows(f).groupBy(F.regexp_replace("team_id", "NATION", "TEAM").alias("team")).agg(F.min("date").alias("first_match"))
    j = history(spark, d).join(f.select(F.col("fixture_id").alias("event_id"), "date"), "event_id", "left").join(first, "team", "left")
    return j.select("event_id", hs.display_day("publish_reason", "date", "first_match", "ts").alias("day"))


@query(
    "chart_matches",
    sql(
        f"""SELECT s.team_id, s.fixture_id, s.opponent, k AS kickoff, k + INTERVAL 105 MINUTES AS full_time FROM (SELECT *, coalesce(commence_time, CAST(date AS TIMESTAMP)) AS k FROM sides) s
            WHERE k BETWEEN TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' + INTERVAL 30 DAYS""",
        "sides",
    ),
)
def chart_matches(spark, d):
    f = fixtures(spark, d)
    spans = st.team_rows(f).select("team_id").distinct().withColumns({"span_start": as_of(), "span_end": as_of() + F.expr("INTERVAL 30 DAYS")})
    return hs.chart_matches(f, spans)


# --- watch-dog ---------------------------------------------------------------------------


@query(
    "staleness",
    sql(
        """SELECT max(last) AS newest, count(*) AS teams, count(*) FILTER (TIMESTAMP '2024-01-30 12:00:00' - last > INTERVAL 30 MINUTES) AS stale_teams,
                  TIMESTAMP '2024-01-30 12:00:00' - max(last) > INTERVAL 30 MINUTES AS price_staleness, count(*) FILTER (TIMESTAMP '2024-01-30 12:00:00' - last > INTERVAL 30 MINUTES) * 2 > count(*) AS m1_staleness
           FROM (SELECT team, max(ts) AS last FROM history WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1)""",
        "history",
    ),
)
def staleness(spark, d):
    return hs.staleness(history(spark, d), F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00")))


@query(
    "stuck_matches",
    sql(f"SELECT fixture_id, date, CASE WHEN date < DATE '{DAY}' - 2 THEN 'cancelled' ELSE status END AS status FROM fixtures WHERE status = 'upcoming' AND commence_time < TIMESTAMP '{AS_OF}' - INTERVAL 3 HOURS", "fixtures"),
)
def stuck_matches(spark, d):
    return ql.expire_upcoming(ql.stuck_matches(fixtures(spark, d), as_of()), as_of()).select("fixture_id", "date", "status")


@query(
    "health_alerts",
    sql(
        f"""SELECT "check", n, CASE WHEN "check" = 'settlement_backlog' AND n > 5 THEN 'critical' ELSE 'warning' END AS severity, 'critical' AS health_status FROM (
              SELECT 'settlement_backlog' AS "check", count(*) AS n FROM reasons WHERE status = 'finished' AND skipped_reason IS NOT NULL
              UNION ALL SELECT 'stuck_matches', count(*) FROM fixtures WHERE status = 'upcoming' AND commence_time < TIMESTAMP '{AS_OF}' - INTERVAL 3 HOURS) WHERE n > 0""",
        "reasons",
    ),
)
def health_alerts(spark, d):
    f = fixtures(spark, d)
    alerts = ql.alert(ql.never_settled(f, log_inputs(spark, d)), "settlement_backlog", 5).unionByName(ql.alert(ql.stuck_matches(f, as_of()), "stuck_matches"))
    return alerts.withColumn("_k", F.lit(1)).join(ql.overall(alerts).withColumn("_k", F.lit(1)), "_k").drop("_k")


@query(
    "live_teams",
    sql(f"SELECT DISTINCT team_id, fixture_id, is_home FROM sides WHERE commence_time < TIMESTAMP '{DAY} 20:00:00' AND commence_time > TIMESTAMP '{DAY} 16:00:00' AND status NOT IN ('finished', 'cancelled')", "sides"),
)
def live_teams(spark, d):
    return ql.live_teams(fixtures(spark, d), F.to_timestamp_ntz(F.lit(f"{DAY} 20:00:00")))


# --- exports -----------------------------------------------------------------------------


@query("export_matches", sql("SELECT fixture_id, date, league, score, coalesce(bookmaker_count, 0) AS bookmaker_count FROM results", "results"))
def export_matches(spark, d):
    from ratewright.session import new_folder

    folder = new_folder(spark, "export-matches")
    ex.write_csv(ex.match_rows(fixtures(spark, d), frozen(spark, d)).select("fixture_id", "date", "league", "score", "bookmaker_count"), folder)
    back = spark.read.option("header", True).schema("fixture_id long, date date, league string, score string, bookmaker_count int").csv(folder)
    return back.withColumn("bookmaker_count", F.coalesce("bookmaker_count", F.lit(0)))


@query(
    "export_outrights",
    sql(
        """SELECT league, team, bookmaker, snapshot_time, round(outright_odds, 6) AS outright_odds FROM (
             SELECT *, row_number() OVER (PARTITION BY league, team, bookmaker ORDER BY snapshot_time DESC, outright_odds DESC) AS rn FROM (
               SELECT league, team, 'book_' || CAST(CAST(volume * 10 AS BIGINT) % 3 AS VARCHAR) AS bookmaker, snapshot_time, 1 / implied_prob AS outright_odds FROM futures)) WHERE rn = 1""",
        "futures",
    ),
)
def export_outrights(spark, d):
    book = F.concat(F.lit("book_"), (F.round(F.col("volume") * 10).cast("long") % 3).cast("string"))
    rows = futures(spark, d).select("league", "team", book.alias("bookmaker"), "snapshot_time", (1.0 / F.col("implied_prob")).alias("outright_odds"))
    return ex.latest_outrights(rows).select("league", "team", "bookmaker", "snapshot_time", r("outright_odds").alias("outright_odds"))


@query("export_trailing_quotes", sql(f"SELECT fixture_id, bookmaker, snapshot_time FROM quotes WHERE snapshot_time BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS AND TIMESTAMP '{AS_OF}'", "quotes"))
def export_trailing_quotes(spark, d):
    return ex.trailing(quotes(spark, d), "snapshot_time", as_of(), 30).select("fixture_id", "bookmaker", "snapshot_time")


@query(
    "regroup_snapshots",
    sql(
        """SELECT fixture, day_offset, CAST(dense_rank() OVER (PARTITION BY fixture ORDER BY day_offset DESC) - 1 AS INTEGER) AS place, max(snapshot_time) OVER (PARTITION BY fixture, day_offset) AS taken, bookmaker,
                  round(home_odds, 6) AS home_odds, round(draw_odds, 6) AS draw_odds, round(away_odds, 6) AS away_odds FROM (
             SELECT *, row_number() OVER (PARTITION BY fixture, day_offset, bookmaker ORDER BY snapshot_time DESC, home_odds DESC, draw_odds DESC, away_odds DESC) AS rn FROM (
               SELECT *, fixture_id AS fixture, CAST(datediff('day', CAST(snapshot_time AS DATE), DATE '2002-01-01') % 3 + 1 AS INTEGER) AS day_offset FROM quotes)) WHERE rn = 1""",
        "quotes",
    ),
)
def regroup_snapshots(spark, d):
    """The nested document of each fixture, laid out again: a row for each snapshot's book, in the document's order."""
    q = quotes(spark, d).select(F.col("fixture_id").alias("fixture"), (F.datediff(F.lit("2002-01-01"), F.col("snapshot_time").cast("date")) % 3 + 1).alias("day_offset"), "snapshot_time", "bookmaker", *k.ODDS)
    shots = ns.regroup(q).select("fixture", F.posexplode("snapshots").alias("place", "s"))
    books = shots.select("fixture", "s.day_offset", "place", F.col("s.snapshot_time").alias("taken"), F.explode("s.books").alias("b"))
    return books.select("fixture", "day_offset", "place", "taken", "b.bookmaker", *[r(f"b.{o}").alias(o) for o in k.ODDS])
