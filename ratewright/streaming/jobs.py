"""Streams over landed quotes and history; every sink is a folder under the shared one."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import calendar as t
from ratewright.functions import numeric as x
from ratewright.operators import consensus as k
from ratewright.operators.tables import patch, pick_by
from ratewright.session import durable, new_folder
from ratewright.streaming.machines import FROZEN_QUOTE, LOCK_EVENT, KickoffFreeze, KickoffLocks


def _root(spark: SparkSession, name: str, root: str | None) -> str:
    """The folder of a run. Given the folder of an earlier run, the stream goes on where that one ended."""
    return root.rstrip("/") if root else new_folder(spark, name)


def _run(writer, folder: str) -> None:
    _run_all([(writer, folder)])


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run_all(writers: list) -> None:
    """Start the queries together, each with its own checkpoint, and wait until all are at the end of their input."""
    running = [w.option("checkpointLocation", folder).trigger(availableNow=True).start() for w, folder in writers]
    for q in running:
        q.awaitTermination()


@contextmanager
def keyed_state(spark: SparkSession):
    """Timers and keyed values need the RocksDB state store; the caller's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


QUOTE = (
    "fixture_id long, bookmaker string, snapshot_time timestamp_ntz, home_odds double, draw_odds double, away_odds double"
)
NAMES = [f.split()[0] for f in QUOTE.split(", ")]
KEY = ["fixture_id", "bookmaker"]
ORDER = ["snapshot_time", "home_odds", "draw_odds", "away_odds"]


def _latest(stream: DataFrame) -> DataFrame:
    """The latest quote per (fixture, book), held in the state store; a batch gives out what it changed."""
    picked = stream.groupBy(*KEY).agg(F.max(F.struct(*ORDER)).alias("_row"))
    return picked.select(*KEY, *[F.col(f"_row.{n}").alias(n) for n in ORDER])


def ingest_quotes(stream: DataFrame, fixtures: DataFrame, name: str = "quotes", root: str | None = None) -> dict[str, DataFrame]:
    """Quotes to an archive, a latest table and a pre-kickoff latest table, as three queries over the stream.

    The pre-kickoff table refuses quotes at or after the start. Latest rows are aggregates in the state store; each batch
    writes the rows it changed under its own number. Run again on the same ``root``, the queries read only what has
    arrived since, and the tables of all runs are returned.
    """
    spark = stream.sparkSession
    root = _root(spark, name, root)
    rows = stream.select(*NAMES)
    early = k.pre_kickoff(rows, fixtures).select(*NAMES)
    archive = rows.writeStream.format("parquet").outputMode("append").option("path", f"{root}/archive")
    writers = [(archive, f"{root}/checkpoint/archive")]
    for table, source in (("latest", rows), ("preko", early)):
        writers.append((_changes(_latest(source), f"{root}/{table}"), f"{root}/checkpoint/{table}"))
    with keyed_state(spark):
        _run_all(writers)
    tables = {t: pick_by(spark.read.schema(QUOTE).parquet(f"{root}/{t}").select(*NAMES), KEY, ORDER) for t in ("latest", "preko")}
    return {"archive": spark.read.schema(QUOTE).parquet(f"{root}/archive"), **tables}


def _changes(df: DataFrame, folder: str):
    """A writer that keeps each batch's rows under its own number, so a repeated batch replaces its own rows."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    # So that there is a table to read even if nothing has arrived.
    df.sparkSession.createDataFrame([], df.schema).write.mode("ignore").parquet(f"{folder}/batch=-1")
    return df.writeStream.outputMode("update").foreachBatch(step)


FROZEN = "fixture_id long, home_expected_score double, away_expected_score double, bookmaker_count int"


def freeze_stream(stream: DataFrame, fixtures: DataFrame, as_of, hours: float, late_minutes: int = c.FRESH_MINUTES, root: str | None = None) -> DataFrame:
    """Write-once consensus: a timer at each kickoff gives out its fixtures' books' last quotes, and the batch's consensus is written.

    Followed are fixtures that start by ``as_of``. A timer fires when the stream's event time, less ``late_minutes``, has
    passed the kickoff; quotes that arrive after that change nothing. A batch works on the fixtures it freezes alone. A
    fixture listed with several starts is frozen once, at the last of them.
    """
    spark = stream.sparkSession
    root = _root(spark, "freeze", root)
    started = fixtures.where(F.coalesce("commence_time", F.col("date").cast("timestamp_ntz")) <= as_of).select("fixture_id", "date", "commence_time")
    # Written once, not worked out again for each batch.
    started = durable(started)
    starts = durable(started.groupBy("fixture_id").agg(F.max(t.kickoff_or_default("commence_time", "date", "23:59:59")).alias("kickoff")))
    # The stream's own time moves on with every quote, also those of other fixtures and of fixtures under way.
    timed = stream.select(*NAMES).withColumn("ts", F.col("snapshot_time").cast("timestamp")).withWatermark("ts", f"{late_minutes} minutes")
    usable = timed.where(x.valid_quote(*k.ODDS)).join(starts, "fixture_id").where(F.col("snapshot_time") < F.col("kickoff"))
    micros = {"snapshot_us": F.unix_micros("ts"), "kickoff_us": F.unix_micros(F.col("kickoff").cast("timestamp"))}
    columns = ["kickoff_us", "ts", "fixture_id", "bookmaker", "snapshot_us", *k.ODDS]
    given = usable.withColumns(micros).select(*columns).groupBy("kickoff_us").transformWithStateInPandas(KickoffFreeze(), FROZEN_QUOTE, "append", "EventTime")
    frozen_at = F.timestamp_micros("snapshot_us").cast("timestamp_ntz").alias("snapshot_time")

    def step(batch: DataFrame, number: int) -> None:
        quotes = batch.select("fixture_id", "bookmaker", frozen_at, *k.ODDS)
        frozen = k.frozen_consensus(quotes, started, hours).select(*[f.split()[0] for f in FROZEN.split(", ")])
        frozen.write.mode("overwrite").parquet(f"{root}/kr/batch={number}")

    spark.createDataFrame([], FROZEN).write.mode("ignore").parquet(f"{root}/kr/batch=-1")
    with keyed_state(spark):
        _run(given.writeStream.foreachBatch(step), f"{root}/checkpoint")
    return spark.read.schema(FROZEN).parquet(f"{root}/kr").select(*[f.split()[0] for f in FROZEN.split(", ")])


def distinct_quotes(stream: DataFrame, minutes: int = c.FRESH_MINUTES) -> DataFrame:
    """Drop repeats of (fixture, source, book, time) within the watermark; late repeats are dropped with their state."""
    return stream.withWatermark("ts", f"{minutes} minutes").dropDuplicatesWithinWatermark(
        ["fixture_id", "source", "bookmaker", "ts"]
    )


def downsample_stream(stream: DataFrame, minutes: int = 15) -> DataFrame:
    """Latest row per (team, tumbling window); in append mode emitted once the watermark passes the window."""
    row = F.struct("ts", "event_id", "published_index")
    return (
        stream.withWatermark("ts", f"{minutes} minutes")
        .groupBy("team", F.window("ts", f"{minutes} minutes"))
        .agg(F.max(row).alias("_r"))
        .select("team", F.col("window.start").alias("window_start"), "_r.ts", "_r.event_id", "_r.published_index")
    )


def live_window(stream: DataFrame, minutes: int = c.FRESH_MINUTES, slide_minutes: int = 1) -> DataFrame:
    """Latest quote per (fixture, book) in a sliding window of the freshness bound."""
    row = F.struct("ts", "home_odds", "draw_odds", "away_odds")
    return (
        stream.withWatermark("ts", f"{minutes} minutes")
        .groupBy("fixture_id", "bookmaker", F.window("ts", f"{minutes} minutes", f"{slide_minutes} minutes"))
        .agg(F.max(row).alias("_r"))
        .select("fixture_id", "bookmaker", F.col("window.end").alias("as_of"), "_r.ts", "_r.home_odds", "_r.draw_odds", "_r.away_odds")
    )


def lock_stream(rows: DataFrame, late_minutes: int = c.FRESH_MINUTES, root: str | None = None) -> DataFrame:
    """Lock events of a stream of (team, ts, seq, kind, r_market, m1_value, kickoff), see ``KickoffLocks``: (team, ts, seq, event, values)."""
    spark = rows.sparkSession
    root = _root(spark, "locks", root)
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late_minutes} minutes")
    micros = {"us": F.unix_micros("ts"), "kickoff_us": F.unix_micros(F.col("kickoff").cast("timestamp"))}
    ready = timed.withColumns(micros).select("team", "ts", "us", "seq", "kind", F.col("r_market").cast("double"), F.col("m1_value").cast("double"), "kickoff_us")
    events = ready.groupBy("team").transformWithStateInPandas(KickoffLocks(), LOCK_EVENT, "append", "EventTime")
    with keyed_state(spark):
        found = to_table(events, "locks", LOCK_EVENT, root)
    return found.select("team", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "seq", "event", "r_market_frozen", "m1_locked")


def kickoff_locks(stream: DataFrame, root: str | None = None) -> DataFrame:
    """Locks of a published history: the first in-play update of a match is its kickoff, with the value published there."""
    kinds = stream.where(F.col("publish_reason").isin("live_update", "settlement"))
    none = F.lit(None)
    kind = F.when(F.col("publish_reason") == "settlement", "settlement").otherwise("kickoff")
    rows = kinds.select(
        "team", "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("published_index").alias("r_market"), none.cast("double").alias("m1_value"), none.cast("timestamp").alias("kickoff")
    )
    found = lock_stream(rows, root=root)
    return found.select("team", "ts", F.col("seq").alias("event_id"), "event", "r_market_frozen")


def locked_state(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state rows after lock events: locked values of teams whose last event froze them, none where it cleared them."""
    last = pick_by(events.select("team", "ts", "seq", "event", "r_market_frozen", "m1_locked"), ["team"], ["ts", "seq"])
    on = F.col("event") == "frozen"
    delta = last.select(F.col("team").alias("team_id"), *[F.when(on, F.col(n)).alias(n) for n in ("m1_locked", "r_market_frozen")], F.lit(0.0).alias("l_value"))
    return patch(state, delta, ["team_id"], {"l_value": F.col("_d_m1_locked").isNotNull() | F.col("_d_r_market_frozen").isNotNull()})


def to_table(df: DataFrame, name: str, schema: str | None = None, root: str | None = None) -> DataFrame:
    """Run an append-mode stream over what is there to a parquet folder, and read it back."""
    spark = df.sparkSession
    root = _root(spark, name, root)
    writer = df.writeStream.format("parquet").outputMode("append").option("path", f"{root}/data")
    _run(writer, f"{root}/checkpoint")
    return spark.read.schema(df.schema if schema is None else schema).parquet(f"{root}/data")


def to_latest(df: DataFrame, name: str, keys: list[str], order: list[str], root: str | None = None) -> DataFrame:
    """Run a windowed stream in update mode, and read the newest row per key: windows still open at the end are there too.

    Each batch writes the windows it changed under its own number, so a repeated batch replaces its own rows.
    """
    spark = df.sparkSession
    root = _root(spark, name, root)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(f"{root}/data/batch=-1")
    _run(df.writeStream.outputMode("update").foreachBatch(step), f"{root}/checkpoint")
    return pick_by(spark.read.schema(df.schema).parquet(f"{root}/data").select(*df.columns), keys, order)


def cycle(stream: DataFrame, step: Callable[[DataFrame, int], None], name: str = "cycle", root: str | None = None) -> None:
    """One micro-batch, one cycle: the given batch operators run with the batch's own time. Given an earlier run's folder, it goes on there."""
    _run(stream.writeStream.foreachBatch(step), f"{_root(stream.sparkSession, name, root)}/checkpoint")
