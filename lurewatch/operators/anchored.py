"""Fixed-length windows anchored at their first event, per key.

A window starts at a key's first event and lasts a fixed time; the first event after its end starts the
next one. Clock-aligned windows and session windows are something else. Two uses: a stored report is
reused until it expires, and a client may make so many requests per window.

Where the windows start depends on all earlier events of a key, which would put each key into one task.
Keys up to a stated number of rows are handled that way: sorted, streamed, with one value of state. The
windows of larger keys are found with joins instead, in a number of rounds that grows with the logarithm
of the number of windows, so no task ever sees such a key as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.operators.joins import hot_keys
from lurewatch.session import checkpointed

# A key with more rows than this is not streamed through one task.
LARGE_KEY_ROWS = 1_000_000
# Blocks per window length in which large keys are sorted, and blocks that are searched at once.
BLOCKS = 64


def window_starts(
    events: DataFrame, key: str, time: str, order: str, seconds: int,
    large_rows: int = LARGE_KEY_ROWS,
) -> DataFrame:
    """Add ``window_start`` (timestamp) and ``opens`` (true on the row that starts the window) to
    ``events``. Rows of equal time are taken in the order of ``order``."""
    small, big = _marked(events, key, time, order, seconds, large_rows)
    small = small.withColumn("opens", F.col("_position") == 1).drop("_position")
    return small if big is None else small.unionByName(big)


def _marked(
    events: DataFrame, key: str, time: str, order: str, seconds: int, large_rows: int,
) -> tuple[DataFrame, DataFrame | None]:
    """``events`` with their ``window_start``: rows of ordinary keys with their ``_position`` in the
    window, and rows of large keys, if there are any, with ``opens``. Rows without key or time are in
    no window; they come with the ordinary ones, with NULL in both columns."""
    length = seconds * 1_000_000
    timed = events.withColumn("_us", F.unix_micros(time))
    placed = F.col(key).isNotNull() & F.col("_us").isNotNull()
    outside = timed.where(~placed).withColumns({
        "_position": F.lit(None).cast("bigint"), "_start": F.lit(None).cast("bigint")})
    timed = timed.where(placed)

    def timestamps(df: DataFrame) -> DataFrame:
        return df.withColumn("window_start", F.timestamp_micros("_start")).drop("_us", "_start")

    large = hot_keys(timed.select(key), key, large_rows + 1)
    if large.isEmpty():
        return timestamps(_streamed(timed, key, order, length).unionByName(outside)), None
    names = checkpointed(large.select(key))
    small = _streamed(timed.join(names, key, "left_anti"), key, order, length).unionByName(outside)
    big = _by_doubling(timed.join(names, key, "left_semi"), key, order, length, large_rows)
    return timestamps(small), timestamps(big)


def _streamed(timed: DataFrame, key: str, order: str, length: int) -> DataFrame:
    """Keys are spread over tasks; each task passes once over its rows in key and time order."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in timed.schema]
                       + ["_position bigint", "_start bigint"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start, position = None, 0, 0  # the open window and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            moments = batch.column("_us").to_numpy()
            positions, starts = np.empty(len(moments), np.int64), np.empty(len(moments), np.int64)
            names = batch.column(key).dictionary_encode()
            codes = names.indices.to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]]))
            for at, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                name = names.dictionary[codes[at]].as_py()
                if name != current:
                    current, start, position = name, int(moments[at]), 0
                while at < end:
                    if moments[at] >= start + length:
                        start, position = int(moments[at]), 0
                    upto = at + int(np.searchsorted(moments[at:end], start + length))
                    starts[at:upto] = start
                    positions[at:upto] = np.arange(position + 1, position + 1 + upto - at)
                    position, at = position + upto - at, upto
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(positions), pa.array(starts)],
                [*batch.schema.names, "_position", "_start"])

    ordered = timed.repartition(key).sortWithinPartitions(key, "_us", order)
    return ordered.mapInArrow(mark, schema)


def _by_doubling(timed: DataFrame, key: str, order: str, length: int, large_rows: int) -> DataFrame:
    """Window starts of large keys. Each distinct moment points to the first moment at least a window
    length later; following the pointers from a key's first moment gives the starts. Pointers are
    doubled every round, so 2^n windows take n rounds."""
    moments = checkpointed(timed.groupBy(key, "_us").agg(F.min(order).alias("_first")))
    starts = moments.groupBy(key).agg(F.min("_us").alias("_us"))
    first, span = _ends(moments)
    hops = checkpointed(_next_moments(moments.select(key, "_us"), key, length, first, span))
    windows = span // length + 1
    reach = 1
    while reach <= windows:
        onward = starts.join(hops, [key, "_us"]).select(key, F.col("_next").alias("_us"))
        starts = checkpointed(starts.union(onward).distinct())
        reach *= 2
        if reach <= windows:
            further = hops.select(F.col(key), F.col("_us").alias("_next"), F.col("_next").alias("_far"))
            hops = checkpointed(hops.join(further, [key, "_next"]).select(
                key, "_us", F.col("_far").alias("_next")))
    # A window covers moments of two neighbouring cells of its own length at most, and a cell holds one
    # start at most: the window of an event is found by cell. Where a cell has many rows, they are dealt
    # to slices, and each slice gets its copy of the starts.
    cell = F.floor(F.col("_us") / length)
    fullest = timed.groupBy(key, cell.alias("_cell")).count().agg(F.max("count")).first()[0] or 0
    slices = max(1, -(-fullest // max(large_rows, 1)))
    known = starts.join(moments, [key, "_us"]).select(
        key, F.col("_us").alias("_start"), "_first", F.explode(F.array(cell, cell + 1)).alias("_cell"))
    known = known.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = timed.withColumns({"_cell": cell, "_slice": F.pmod(F.xxhash64(order), F.lit(slices)).cast("int")})
    located = dealt.join(known, [key, "_cell", "_slice"])
    located = located.where(F.col("_us").between(F.col("_start"), F.col("_start") + (length - 1)))
    opens = (F.col("_us") == F.col("_start")) & (F.col(order) == F.col("_first"))
    return located.withColumn("opens", opens).select(
        *timed.columns, "opens", "_start")


def _ends(moments: DataFrame) -> tuple[int, int]:
    """The first moment of all, and from there to the last."""
    ends = moments.agg(F.min("_us"), F.max("_us")).first()
    return ends[0] or 0, (ends[1] or 0) - (ends[0] or 0)


def _next_moments(moments: DataFrame, key: str, length: int, first: int | None = None, span: int | None = None) -> DataFrame:
    """``key, _us, _next``: the first moment at or after ``_us`` plus the length; rows without one are
    left out. Moments are sorted within small blocks of time; if none follows in the block, the next
    block with moments is searched level by level. ``first`` and ``span`` are those of ``_ends``."""
    if first is None or span is None:
        first, span = _ends(moments)
    width = max(length // BLOCKS, 1)

    def block(column: str) -> F.Column:
        return F.floor((F.col(column) - first) / width)

    points = moments.select(key, F.col("_us").alias("_at"), F.col("_us").alias("_seen"),
                            F.lit(None).cast("bigint").alias("_us"))
    probes = moments.select(key, (F.col("_us") + length).alias("_at"),
                            F.lit(None).cast("bigint").alias("_seen"), "_us")
    both = points.unionByName(probes).withColumn("_block", block("_at"))
    in_block = Window.partitionBy(key, "_block").orderBy(F.desc("_at"), F.col("_seen").desc())
    both = both.withColumn("_hit", F.last("_seen", ignorenulls=True).over(
        in_block.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = checkpointed(both.groupBy(key, "_block").agg(F.min("_seen").alias("_min")))
    levels = 0
    while BLOCKS ** (levels + 1) <= (span + length) // width:
        levels += 1
    probed = both.where(F.col("_us").isNotNull())
    joined = probed.join(_with_later(blocks, key, levels).select(key, "_block", "_later"), [key, "_block"])
    return joined.select(key, "_us", F.coalesce("_hit", "_later").alias("_next")).where(
        F.col("_next").isNotNull())


def _with_later(blocks: DataFrame, key: str, levels: int) -> DataFrame:
    """Add ``_later``, the ``_min`` of the next block that has one. It is in the same group of ``BLOCKS``
    blocks, or it is that of the next group with any, which is found in the same way; so no more than
    that many rows are sorted together, however long a key's time span is."""
    blocks = blocks.withColumn("_group", F.floor(F.col("_block") / BLOCKS))
    # In falling order the blocks before a row are the later ones; such a frame is extended row by row.
    later = Window.partitionBy(key, "_group").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    found = blocks.withColumn("_later", F.last("_min", ignorenulls=True).over(later))
    if not levels:  # block 0 is the first of all, so there is one group
        return found.drop("_group")
    groups = checkpointed(blocks.groupBy(key, F.col("_group").alias("_block")).agg(F.min("_min").alias("_min")))
    above = _with_later(groups, key, levels - 1).select(
        key, F.col("_block").alias("_group"), F.col("_later").alias("_above"))
    return found.join(above, [key, "_group"]).withColumn("_later", F.coalesce("_later", "_above")).drop("_group", "_above")


def report_reuse(requests: DataFrame, seconds: int = 600, key: str = "url", order: str = "event_id",
                 **options) -> DataFrame:
    """Each request with whether the report of an earlier request for the same key is reused, and when
    that report was made."""
    marked = window_starts(requests, key, "ts", order, seconds, **options)
    return marked.withColumnRenamed("window_start", "computed_at").withColumn(
        "reused", ~F.col("opens")).drop("opens")


def client_quota(
    requests: DataFrame, limit: int = 60, seconds: int = 60, large_rows: int = LARGE_KEY_ROWS,
) -> DataFrame:
    """Each request with its window and whether it is accepted: the first ``limit`` of a client's
    window are."""
    small, big = _marked(requests, "client", "ts", "event_id", seconds, large_rows)
    small = small.withColumn("accepted", F.col("_position") <= limit).drop("_position")
    return small if big is None else small.unionByName(_within_quota(big.drop("opens"), limit))


def _within_quota(marked: DataFrame, limit: int) -> DataFrame:
    """Only the request that uses up a window's quota is searched for, which Spark does with a limit
    per group before the shuffle; requests are then compared with it."""
    group = ["client", "window_start"]
    ranked = marked.select(*group, "ts", "event_id").withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*group).orderBy("ts", "event_id")))
    last = ranked.where(F.col("_rank") == limit).select(
        *group, F.col("ts").alias("_last_ts"), F.col("event_id").alias("_last_id"))
    joined = marked.join(last, group, "left")
    within = F.struct("ts", "event_id") <= F.struct(
        F.col("_last_ts").alias("ts"), F.col("_last_id").alias("event_id"))
    accepted = F.col("_last_ts").isNull() | within
    return joined.select(*marked.columns, accepted.alias("accepted"))
