"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lurewatch.session import shared_folder

# Rows of whole texts handed to a Python task at once; a text is a few KB on average.
TEXT_ROWS = 500

# A lookup side is broadcast only when its stored rows were counted and are at most this many.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, computed once and written to the shared folder; later reads need no lineage."""
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bound what a Python task holds at once while it reads whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Sent:
    """A value of classes of this package for tasks whose workers lack the package: Spark's own broadcast
    names classes by their module, this one brings them along."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self):
        return pickle.loads(self._sent.value)


def matched(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Join to a stored ``right`` side: broadcast when it was counted and is small, else by a
    shuffle whose large partitions adaptive execution splits."""
    if right.count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return left.join(right, on, how)


def ranked(frame: DataFrame, order: Column, into: str) -> DataFrame:
    """Add the position (from 0) in the order of ``order``, without one task seeing all rows.

    Rows are sorted in range partitions and stored; a row's position is its place in its partition
    plus the rows of the partitions before. Equal rows get positions in no particular order."""
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(
        frame.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return (cut.withColumn(into, inside).join(F.broadcast(starts), "_part")
            .withColumn(into, F.col(into) + F.col("_start")).drop("_part", "_start"))
