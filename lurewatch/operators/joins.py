"""Lookup joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """All keys with at least ``rows`` rows, with their ``copies``: the number of slices a key is cut
    into. Counting is partially done before the shuffle."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") >= rows)
    return hot.select(key, (F.ceil(F.col("_n") / rows) + 1).cast("int").alias("copies"))


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, spread: list[str],
    how: str = "left", hot_rows: int | None = None, broadcast: bool = False,
) -> DataFrame:
    """Join ``left`` to ``right``, which holds each key at most once.

    Nothing is run while the plan is built. Both sides are shuffled by the key; adaptive execution
    broadcasts a side that turns out small and splits the partitions of common keys, which copies
    only the one matching row. Rows with a NULL key match nothing and are spread by a hash of the
    ``spread`` columns. A caller who knows the size may ask for a broadcast. Where adaptive execution
    is off, ``hot_rows`` cuts keys of that many rows into slices; it reads ``left`` twice."""
    if broadcast:
        return left.join(F.broadcast(right), key, how)
    mixed = F.xxhash64(*spread)
    # The join columns are never NULL, so that rows without a key spread over partitions as well.
    slot = F.when(F.col(key).isNull(), mixed.bitwiseOR(F.lit(1).cast("bigint")))
    none = F.lit(0).cast("bigint")
    right = right.where(F.col(key).isNotNull())
    if hot_rows is None:
        sliced = left.withColumn("_slice", slot.otherwise(none))
        copies = right.withColumn("_slice", none)
    else:
        hot = hot_keys(left, key, hot_rows)
        cut = slot.when(F.col("copies").isNotNull(), -1 - F.pmod(mixed, F.col("copies").cast("bigint")))
        sliced = left.join(hot, key, "left").withColumn("_slice", cut.otherwise(none)).drop("copies")
        copies = right.join(hot, key, "left").withColumn("_slice", F.explode(
            F.when(F.col("copies").isNull(), F.array(none)).otherwise(F.transform(
                F.sequence(F.lit(1), "copies"), lambda i: -i.cast("bigint"))))).drop("copies")
    sliced = sliced.withColumns({"_key": F.coalesce(F.col(key), F.lit("")), "_null": F.col(key).isNull()})
    copies = copies.select("*", F.col(key).alias("_key"), F.lit(False).alias("_null")).drop(key)
    return sliced.join(copies, ["_key", "_null", "_slice"], how).drop("_key", "_null", "_slice")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))
