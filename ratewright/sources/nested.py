"""Landed JSON feeds flattened into relational rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewright.functions import numeric as x
from ratewright.functions import text as tx
from ratewright.operators.tables import pick_by

OUTCOME = "struct<name:string,price:double,point:double>"
MARKET = f"struct<key:string,last_update:string,outcomes:array<{OUTCOME}>>"
EVENT = (
    "id string, sport_key string, commence_time timestamp_ntz, home_team string, away_team string, "
    f"bookmakers array<struct<key:string,title:string,markets:array<{MARKET}>>>"
)
_EVENT_STRUCT = "struct<" + ",".join(part.replace(" ", ":", 1) for part in EVENT.split(", ")) + ">"
SNAPSHOT_FILE = f"timestamp timestamp_ntz, previous_timestamp string, next_timestamp string, data array<{_EVENT_STRUCT}>"
FILE_NAME = r"([^/]+)_(\d{4}-\d{2}-\d{2})_d(\d+)\.json$"
FIXTURE_FEED = (
    "fixture struct<id:long,date:string,status:struct<short:string>>, league struct<name:string>, "
    "teams struct<home:struct<name:string>,away:struct<name:string>>, goals struct<home:int,away:int>"
)
PREDICTION_EVENT = (
    "id long, title string, volume double, markets array<struct<id:string,question:string,outcomes:string,"
    "outcomePrices:string,volumeNum:double,groupItemTitle:string,active:boolean,closed:boolean>>"
)


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes from a folder of snapshot files; fixture, day and offset come from the file name.

    Empty or malformed files give no rows.
    """
    raw = spark.read.schema(SNAPSHOT_FILE).option("multiLine", "true").option("mode", "PERMISSIVE").json(folder)
    path = F.input_file_name()
    named = raw.select(
        F.regexp_extract(path, FILE_NAME, 1).alias("fixture"),
        F.regexp_extract(path, FILE_NAME, 2).cast("date").alias("match_date"),
        F.regexp_extract(path, FILE_NAME, 3).try_cast("int").alias("day_offset"),
        F.col("timestamp").alias("snapshot_time"),
        "data",
    )
    events = named.where(F.col("data").isNotNull()).withColumn("e", F.explode("data")).drop("data")
    flat = flatten_h2h(events, F.col("e"), ["fixture", "match_date", "day_offset", "snapshot_time"])
    return flat


def regroup(quotes: DataFrame) -> DataFrame:
    """Fixture -> snapshots (latest offset first) -> books, the last quote of each.

    One row per (fixture, offset, book) is left before anything is collected, so a
    fixture's row is bounded by its few offsets times its books.
    """
    single = pick_by(quotes, ["fixture", "day_offset", "bookmaker"], ["snapshot_time", "home_odds", "draw_odds", "away_odds"])
    per = single.groupBy("fixture", "day_offset").agg(
        F.max("snapshot_time").alias("snapshot_time"),
        F.sort_array(F.collect_list(F.struct("bookmaker", "home_odds", "draw_odds", "away_odds"))).alias("books"),
    )
    return per.groupBy("fixture").agg(
        F.sort_array(F.collect_list(F.struct("day_offset", "snapshot_time", "books")), asc=False).alias("snapshots")
    )


def _markets(df: DataFrame, event: Column, keep: list[str], key: str) -> DataFrame:
    books = df.select(*keep, event.getField("home_team").alias("_h"), event.getField("away_team").alias("_a"), F.explode(event.getField("bookmakers")).alias("_b"))
    # Other markets go before rows are made of them.
    named = F.filter("_b.markets", lambda m: m["key"] == key)
    markets = books.select(*keep, "_h", "_a", F.col("_b.key").alias("bookmaker"), F.explode(named).alias("_m"))
    return markets.select(*keep, "_h", "_a", "bookmaker", F.col("_m.outcomes").alias("_o"))


def _outcome(name: Column) -> Column:
    """First outcome of that name; null if absent."""
    return F.get(F.filter("_o", lambda o: o["name"] == name), F.lit(0))


def _last_price(name: Column) -> Column:
    """Price of the last outcome of that name, as a later one overwrites an earlier."""
    return F.try_element_at(F.filter("_o", lambda o: o["name"] == name), F.lit(-1))["price"]


def flatten_h2h(df: DataFrame, event: Column, keep: list[str]) -> DataFrame:
    m = _markets(df, event, keep, "h2h")
    return m.select(
        *keep, "bookmaker",
        _last_price(F.col("_h")).alias("home_odds"), _last_price(F.lit("Draw")).alias("draw_odds"), _last_price(F.col("_a")).alias("away_odds"),
    )


def flatten_totals(df: DataFrame, event: Column, keep: list[str]) -> DataFrame:
    m = _markets(df, event, keep, "totals").withColumns({"_ov": _outcome(F.lit("Over")), "_un": _outcome(F.lit("Under"))})
    ok = F.col("_ov").isNotNull() & F.col("_un").isNotNull() & F.col("_ov.point").isNotNull()
    return m.where(ok).select(
        *keep, "bookmaker", F.col("_ov.point").alias("point"), F.col("_ov.price").alias("over_odds"), F.col("_un.price").alias("under_odds")
    )


def flatten_spreads(df: DataFrame, event: Column, keep: list[str]) -> DataFrame:
    m = _markets(df, event, keep, "spreads").withColumns({"_ho": _outcome(F.col("_h")), "_aw": _outcome(F.col("_a"))})
    ok = F.col("_ho.point").isNotNull() & F.col("_aw.point").isNotNull()
    return m.where(ok).select(
        *keep, "bookmaker", F.col("_ho.point").alias("home_point"), F.col("_ho.price").alias("home_odds"),
        F.col("_aw.point").alias("away_point"), F.col("_aw.price").alias("away_odds"),
    )


def flatten_fixtures(feed: DataFrame, cups: tuple[str, ...] = ()) -> DataFrame:
    """Fixture feed to matches: status by code, goals to score text, competition tag."""
    goals = F.col("goals")
    score = F.when(
        goals["home"].isNotNull() & goals["away"].isNotNull(), F.concat_ws("-", goals["home"].cast("string"), goals["away"].cast("string"))
    ).otherwise("N/A")
    start = F.col("fixture.date")
    return feed.select(
        F.col("fixture.id").alias("fixture_id"),
        F.substring(start, 1, 10).cast("date").alias("date"),
        F.col("league.name").alias("league"),
        F.col("teams.home.name").alias("home_team"),
        F.col("teams.away.name").alias("away_team"),
        score.alias("score"),
        tx.status_of("fixture.status.short").alias("status"),
        F.col("fixture.status.short").alias("status_code"),
        start.alias("commence_time"),
        F.when(F.col("league.name").isin(*cups), "champions_league").otherwise("league").alias("competition")
        if cups
        else F.lit("league").alias("competition"),
    )


def _first_price(prices: Column) -> Column:
    return F.coalesce(F.get(F.from_json(prices, "array<string>"), F.lit(0)).try_cast("double"), F.lit(0.0))


def moneyline(events: DataFrame, keep: list[str]) -> DataFrame:
    """Binary markets of a plain "A vs. B" event merged to one three-way row.

    A market is matched by its item title, else by the whole side names in its question text: the longer one of
    both, as one name may hold the other, else the one it has. Volumes add up.
    Events have a handful of markets, so each is resolved inside its own row.
    """
    home, away = tx.title_sides("title")
    suffixed = F.contains(F.col("title"), F.lit(" - "))
    base = events.withColumns({"_h": home, "_a": away}).where((F.col("_h") != "") & ~suffixed)
    live = F.filter("markets", lambda m: m["active"] & ~m["closed"])
    h, a = F.lower("_h"), F.lower("_a")

    def side(m):
        item, q = F.lower(F.coalesce(m["groupItemTitle"], F.lit(""))), F.lower(m["question"])
        return (
            F.when(F.startswith(item, F.lit("draw")), "draw")
            .when(item == h, "home")
            .when(item == a, "away")
            .when(F.contains(q, F.lit("draw")), "draw")
            .when(F.contains(q, h) & F.contains(q, a), F.when(F.length(h) >= F.length(a), "home").otherwise("away"))
            .when(F.contains(q, h), "home")
            .when(F.contains(q, a), "away")
        )

    tagged = F.transform("_live", lambda m: F.struct(side(m).alias("s"), _first_price(m["outcomePrices"]).alias("p"), F.coalesce(m["volumeNum"], F.lit(0.0)).alias("v")))
    rows = base.withColumn("_live", live).withColumn("_t", tagged)

    def prob(name):
        return F.coalesce(F.try_element_at(F.filter("_t", lambda z: z["s"] == name), F.lit(-1))["p"], F.lit(0.0))

    rows = rows.withColumns(
        {
            "home_prob": x.half_up(prob("home"), 4),
            "draw_prob": x.half_up(prob("draw"), 4),
            "away_prob": x.half_up(prob("away"), 4),
            "_raw": F.array(prob("home"), prob("draw"), prob("away")),
            "volume": x.half_up(F.aggregate("_t", F.lit(0.0), lambda acc, z: acc + z["v"]), 2),
        }
    )
    resolved = (F.array_max("_raw") >= 0.99) | (F.array_min("_raw") <= 0.001)
    return rows.where(F.array_max("_raw") > 0).select(
        *keep, F.col("_h").alias("home_team"), F.col("_a").alias("away_team"), F.lit("moneyline").alias("market_type"),
        F.when(resolved, "resolved").otherwise("active").alias("market_status"), "home_prob", "draw_prob", "away_prob", "volume",
    )


def side_markets(events: DataFrame, keep: list[str]) -> DataFrame:
    """Markets of suffixed events, with parsed outcomes and prices; unparseable ones are dropped."""
    home, _ = tx.title_sides("title")
    rows = events.where((home != "") & F.contains(F.col("title"), F.lit(" - ")))
    rows = rows.select(*keep, "title", F.explode("markets").alias("_m")).where(F.col("_m.active") & ~F.col("_m.closed"))
    outcomes = F.from_json("_m.outcomes", "array<string>")
    prices = F.transform(F.from_json("_m.outcomePrices", "array<string>"), lambda p: x.half_up(p.try_cast("double"), 4))
    rows = rows.withColumns({"outcomes": outcomes, "outcome_prices": prices}).where(F.col("outcomes").isNotNull() & F.col("outcome_prices").isNotNull())
    yes = F.coalesce(F.get("outcome_prices", F.lit(0)), F.lit(0.0))
    return rows.select(
        *keep, F.col("_m.question").alias("market_question"), tx.market_type("title", "_m.question").alias("market_type"), "outcomes", "outcome_prices",
        F.when((yes >= 0.995) | (yes <= 0.005), "resolved").otherwise("active").alias("market_status"),
        x.half_up(F.coalesce("_m.volumeNum", F.lit(0.0)), 2).alias("volume"),
    )


def last_ratings(maps: DataFrame, column: str = "history") -> DataFrame:
    """Map of name -> dated ratings to one row per name and map: its last entry."""
    rows = maps.select(F.explode(column).alias("legacy_name", "_v")).where(F.size("_v") > 0)
    return rows.select("legacy_name", F.try_element_at("_v", F.lit(-1))["date"].alias("date"), F.try_element_at("_v", F.lit(-1))["rating"].alias("rating"))


def fetch_plan(fixtures: DataFrame, done: DataFrame, budget: float, cost: float = 10.0, offsets: int = 3) -> DataFrame:
    """What is still to fetch: fixture x day offsets not on disk, in date order, while the cost fits the budget.

    The running cost is only needed for the queue's head, which the budget bounds.
    """
    every = fixtures.select("fixture_id", "date", F.explode(F.sequence(F.lit(1), F.lit(offsets))).alias("day_offset"))
    todo = every.join(done.select("fixture_id", "day_offset"), ["fixture_id", "day_offset"], "left_anti")
    head = todo.orderBy("date", "fixture_id", "day_offset").limit(int(budget // cost))
    w = Window.orderBy("date", "fixture_id", "day_offset").rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("running_cost", F.sum(F.lit(cost)).over(w))
