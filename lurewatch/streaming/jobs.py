"""Structured Streaming jobs over the batch operators.

Each job writes one folder per micro-batch into its table, replacing it when a batch is run again, so a
restarted query neither loses nor repeats rows. State between batches is kept in tables too, and is
handled by the same operators as batch data: a key with very many rows is split in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.operators import anchored, reports, threats
from lurewatch.operators.joins import flag
from lurewatch.session import checkpointed, shared_folder
from lurewatch.sources import feeds
from lurewatch.sources.keyed import KeyedTable

BATCH = "batch_id"
THREATS = T.StructType([T.StructField(name, T.TimestampType() if name == "created_at" else T.StringType())
                        for name in threats.STORED])


def stream_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BATCH)


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def _write(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what has landed and stop; the caller's scheduler sets the pace."""
    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def threat_store(spark: SparkSession, path: str, digits: int = 2) -> KeyedTable:
    """The threat table in folders by URL hash."""
    return KeyedTable(spark, path, "url_hash", THREATS, digits)


def ingest(arriving: DataFrame, as_of: Column, table: str | None = None, checkpoint: str | None = None,
           digits: int = 2, compact_every: int = 50) -> KeyedTable:
    """Feed rows into the threat table, from ``feeds.read_raw`` or as threats with ``seq``; the first row
    per (url_hash, source) ever seen stays, first by where it stood in the landed files or by ``seq``. Of the stored table a batch reads only folders that
    may hold its URLs. Every ``compact_every`` batches those before the running one become one."""
    spark = arriving.sparkSession
    store = threat_store(spark, table or shared_folder(spark, "threats"), digits)

    def each(batch: DataFrame, number: int) -> None:
        if "feed" in batch.columns:
            batch = feeds.normalised(batch)
        elif "seq" not in batch.columns:  # rows of one batch without an order of their own
            batch = batch.withColumn("seq", F.struct("external_id", "threat_type"))
        rows = checkpointed(threats.first_per_key(threats.with_hash(batch)))
        known = store.lookup(rows.select("url_hash"), number).select(*threats.KEY)
        fresh = rows.join(known, threats.KEY, "left_anti").withColumn("created_at", as_of)
        store.append(fresh, number)
        if number and number % compact_every == 0:
            store.compact(number - 1)

    _run(arriving, each, checkpoint or shared_folder(spark, "ingest"))
    return store


def run_check(requests: DataFrame, check: Callable[[DataFrame], DataFrame],
              table: str | None = None, checkpoint: str | None = None) -> str:
    """Reports for a stream of requests. ``check`` is the batch check; it reads the threat and
    observation tables anew for every batch and checks again what may be broadcast."""
    spark = requests.sparkSession
    table = table or shared_folder(spark, "reports")

    def each(batch: DataFrame, number: int) -> None:
        _write(check(batch), table, number)

    _run(requests, each, checkpoint or shared_folder(spark, "check"))
    return table


def run_windows(events: DataFrame, key: str, time: str, order: str, seconds: int, delay_seconds: int = 0,
                table: str | None = None, checkpoint: str | None = None, ended: bool = False, **options) -> str:
    """Anchored windows over a stream by event time.

    The clock is the newest time seen less the delay. Rows up to the clock are placed; newer ones wait
    until it has passed them, so rows that arrive out of order within the delay get the windows of their
    order in time. Rows older than the clock already was are too late: they are in no window and are
    listed in ``<table>-late``. The state between batches is the waiting rows, the clock, and the windows
    that have not ended by it; an ended window is dropped. ``ended`` says that nothing follows, so no row
    waits. All of it is handled by the batch operators, so
    a key with very many rows is split as it is there."""
    spark = events.sparkSession
    table = table or shared_folder(spark, "windows")

    def state(name: str, number: int, schema) -> DataFrame:
        path = f"{table}-{name}/{BATCH}={number}"
        return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)

    def each(batch: DataFrame, number: int) -> None:
        arrived = checkpointed(batch)
        plain = arrived.schema
        seeds = arrived.select(key, F.col(time).alias("_start")).schema
        clock = state("clock", number - 1, "now timestamp").first()
        past = clock["now"] if clock else None
        newest = arrived.agg(F.timestamp_micros(F.max(F.unix_micros(time)) - delay_seconds * 1_000_000)).first()[0]
        now = max((t for t in (past, newest) if t is not None), default=None)
        until = None if ended else now
        is_late = flag(F.col(time) < F.lit(past)) if past is not None else F.lit(False)
        _write(arrived.where(is_late), f"{table}-late", number)
        rows = arrived.where(~is_late).unionByName(state("waiting", number - 1, plain))
        waits = flag(F.col(time) > F.lit(until)) if until is not None else F.lit(False)
        _write(rows.where(waits), f"{table}-waiting", number)

        opened = state("open", number - 1, seeds)
        # An open window enters as a row of its own; its order is NULL, which sorts first.
        both = rows.where(~waits).unionByName(opened.select(key, F.col("_start").alias(time)), allowMissingColumns=True)
        marked = anchored.window_starts(both, key, time, order, seconds, **options)
        _write(marked.where(F.col(order).isNotNull()), table, number)
        latest = spark.read.parquet(f"{table}/{BATCH}={number}").select(key, F.col("window_start").alias("_start"))
        end = F.timestamp_micros(F.unix_micros("_start") + seconds * 1_000_000)
        lasting = latest.unionByName(opened).where(end > F.lit(now)) if now is not None else opened
        _write(lasting.groupBy(key).agg(F.max("_start").alias("_start")), f"{table}-open", number)
        _write(spark.createDataFrame([(now,)], "now timestamp"), f"{table}-clock", number)

    _run(events, each, checkpoint or shared_folder(spark, "window-run"))
    return table


def late_rows(spark: SparkSession, table: str) -> DataFrame:
    """Rows that came too late for any window."""
    return read_table(spark, f"{table}-late")


def run_reports(requests: DataFrame, make: Callable[[DataFrame], DataFrame], allow: Callable[[DataFrame], DataFrame],
                seconds: int, store: KeyedTable | None = None, table: str | None = None, checkpoint: str | None = None,
                digits: int = 2, compact_every: int = 50, **options) -> str:
    """Requests in time order, answered from stored reports while these are valid. Every
    ``compact_every`` batches the stored batches become one without the reports that have expired."""
    spark = requests.sparkSession
    table = table or shared_folder(spark, "answers")
    store = store or reports.report_table(spark, f"{table}-store", digits)

    def each(batch: DataFrame, number: int) -> None:
        _write(reports.serve(batch, make, allow, store, number, seconds, **options), table, number)
        if number and number % compact_every == 0:
            oldest = spark.read.parquet(f"{table}/{BATCH}={number}").agg(F.min(options.get("time", "ts"))).first()[0]
            if oldest is not None:
                store.compact(number - 1, reports.unexpired(F.lit(oldest), seconds))

    _run(requests, each, checkpoint or shared_folder(spark, "answering"))
    return table
