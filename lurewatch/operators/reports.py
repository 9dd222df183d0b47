"""Stored reports with expiry: a request is answered from the store while a report of its URL is valid.

A report is valid from its ``computed_at`` for a fixed time. Requests are met with the stored versions of
their URL as of their own time; what no version covers is placed in windows, the first request of a
window has its report made and stored, and the others of the window share it. Allow-listed URLs are
answered anew each time and never stored.

Versions are found by equal keys only: a version is filed under the two spans of time, each as long as
reports are valid, that it reaches into, and a request asks in its own span.

Defined results: a request without a URL gets no report and is left out, as in the check; one without a
time is answered anew and not stored; equal requests share a report; a request older than all stored
versions of its URL starts a window of its own; of two valid versions the newer one counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.operators import anchored, threats
from lurewatch.session import checkpointed
from lurewatch.sources.keyed import KeyedTable

KEY = "url_hash"
SCHEMA = T.StructType().add(KEY, "string").add("computed_at", "timestamp").add("report", "string")


def report_table(spark: SparkSession, path: str, digits: int = 2) -> KeyedTable:
    return KeyedTable(spark, path, KEY, SCHEMA, digits)


def _span(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time) / (seconds * 1_000_000))


def covered(requests: DataFrame, versions: DataFrame, seconds: int, time: str = "ts") -> DataFrame:
    """Add ``computed_at`` of the newest version of ``url_hash`` that is valid at the request's time."""
    spans = F.explode(F.array(_span(F.col("computed_at"), seconds), _span(F.col("computed_at"), seconds) + 1))
    filed = versions.select(KEY, spans.alias("_span"), "computed_at").groupBy(KEY, "_span").agg(
        F.collect_set("computed_at").alias("_made"))  # those of one span and the one before
    found = requests.withColumn("_span", _span(F.col(time), seconds)).join(filed, [KEY, "_span"], "left")
    asked = F.unix_micros(time)
    valid = F.filter("_made", lambda made: (F.unix_micros(made) <= asked) & (asked < F.unix_micros(made) + seconds * 1_000_000))
    return found.withColumn("computed_at", F.array_max(valid)).drop("_span", "_made")


def serve(
    requests: DataFrame, make: Callable[[DataFrame], DataFrame], allow: Callable[[DataFrame], DataFrame],
    store: KeyedTable, batch: int, seconds: int, time: str = "ts", order: str = "event_id", **options,
) -> DataFrame:
    """``requests`` (url, time, order) with ``computed_at``, ``reused`` and ``report``; new reports are
    stored as ``batch``, which sees the batches before it only, so that it can run again.

    ``allow`` adds ``whitelisted`` to rows with a URL, ``make`` gives the ``report`` of each row's ``url``
    beside the other columns."""
    asked = checkpointed(threats.with_hash(requests.where(F.col("url") != "")))
    versions = checkpointed(store.lookup(asked.select(KEY), batch))
    met = checkpointed(covered(asked, versions, seconds, time))
    open_ = allow(met.where(F.col("computed_at").isNull()).drop("computed_at"))
    open_ = checkpointed(open_.select(*asked.columns, (F.col("whitelisted") | F.col(time).isNull()).alias("_alone")))
    fresh = checkpointed(anchored.report_reuse(
        open_.where(~F.col("_alone")).drop("_alone").withColumnRenamed(time, "ts"), seconds, key=KEY, order=order, **options
    ).withColumnRenamed("ts", time))

    alone = open_.where("_alone").drop("_alone")
    due = fresh.where(~F.col("reused")).select(F.col(KEY).alias("report_hash"), "computed_at", "url")
    once = alone.select(F.col(KEY).alias("report_hash"), F.lit(None).cast("timestamp").alias("computed_at"), "url")
    made = checkpointed(make(due.unionByName(once).distinct()).select(F.col("report_hash").alias(KEY), "computed_at", "report"))
    store.append(made.where("computed_at IS NOT NULL"), batch)
    anew = made.where("computed_at IS NULL").drop("computed_at")
    kept = versions.unionByName(store.batch(batch)).dropDuplicates([KEY, "computed_at"])
    timed = met.where(F.col("computed_at").isNotNull()).withColumn("reused", F.lit(True)).unionByName(fresh)
    columns = [*requests.columns, "computed_at", "reused", "report"]
    return timed.join(kept, [KEY, "computed_at"], "left").select(*columns).unionByName(
        alone.withColumns({"computed_at": F.col(time), "reused": F.lit(False)}).join(anew, KEY, "left").select(*columns))


def unexpired(now: Column, seconds: int) -> Column:
    """What a compaction keeps."""
    return F.unix_micros("computed_at") + seconds * 1_000_000 > F.unix_micros(now)
