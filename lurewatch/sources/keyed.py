"""A table of rows by hash key that grows batch by batch and is asked for a few keys at a time.

Rows lie in Parquet folders by batch and by the first digits of their key, so that a key's rows are in
one folder of each batch. Beside each folder stands a Bloom filter of its keys. A batch of keys is first
put to the filters; only folders that may hold one of them are read, and of a batch of new keys hardly
any. ``compact`` joins all batches up to one into a base, leaving out rows that have had their time;
readers take the newest whole base and the batches after it, so a compaction that breaks off changes
nothing, and a batch that runs again replaces its own rows.

A folder counts when its job has committed it. Superseded folders stay until ``drop_superseded``, so
that running readers can end.

Defined results: a null key is stored and never found; equal rows stay; a table without batches is empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.session import checkpointed

PREFIX = "_prefix"
# A block of a filter is a bitmap of 32,768 bits; keys set 8 bits in one block of about 24 bits a key,
# by which a key that is not there passes about once in 20,000 times.
BLOCK_BITS, BITS_A_KEY, BITS_SET = 32_768, 24, 8

FILTER = f"{PREFIX} string, _block long, _blocks long, _bits binary"


def _positions(key: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(1, BITS_SET + 1)])


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def bloom(keys: DataFrame, key: str) -> DataFrame:
    """The filter blocks of the keys under each prefix."""
    sizes = keys.groupBy(PREFIX).agg(F.ceil(F.count("*") * BITS_A_KEY / BLOCK_BITS).cast("long").alias("_blocks"))
    placed = keys.join(sizes, PREFIX).select(
        PREFIX, _block(F.col(key), F.col("_blocks")).alias("_block"), "_blocks", F.explode(_positions(F.col(key))).alias("_at"))
    return placed.groupBy(PREFIX, "_block", "_blocks").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def _may_hold(bits: Column, positions: Column) -> Column:
    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1

    return F.forall(positions, is_set)


def nothing(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, as a frame that the optimizer knows to be empty."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).limit(0)


class KeyedTable:
    """``digits`` sets the number of folders: 16 to its power."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, digits: int = 2):
        self.spark, self.path, self.key, self.schema, self.digits = spark, path.rstrip("/"), key, schema, digits
        self.stored = T.StructType([*schema.fields, T.StructField(PREFIX, T.StringType())])

    # -- folders --------------------------------------------------------------------------------------

    def _at(self, path: str):
        location = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return location.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), location

    def _committed(self, name: str) -> bool:
        files, location = self._at(f"{self.path}/{name}/_SUCCESS")
        return files.exists(location)

    def _named(self) -> list[tuple[str, int]]:
        """All kinds and numbers of batches and bases that are there, whole or not."""
        files, location = self._at(self.path)
        names = [s.getPath().getName() for s in files.listStatus(location)] if files.exists(location) else []
        found = [re.fullmatch(r"(batch|base)-(\d+)", name) for name in names]
        return sorted((m[1], int(m[2])) for m in found if m)

    def live(self, before: int | None = None) -> list[str]:
        """The folders that hold the table as of batch ``before``, that batch left out."""
        whole = [(kind, n) for kind, n in self._named()
                 if (before is None or n < before) and self._committed(f"{kind}-{n}") and self._committed(f"filter-{kind}-{n}")]
        base = max([n for kind, n in whole if kind == "base"], default=-1)
        return [f"base-{base}"] * (base >= 0) + [f"batch-{n}" for kind, n in whole if kind == "batch" and n > base]

    def _read(self, names: list[str]) -> DataFrame:
        frame = nothing(self.spark, self.schema)
        for name in names:
            rows = self.spark.read.schema(self.stored).parquet(f"{self.path}/{name}")
            frame = frame.unionByName(rows.select(*self.schema.names))
        return frame

    # -- writing --------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str) -> None:
        prefix = F.coalesce(F.substring(self.key, 1, self.digits), F.lit("none"))
        placed = rows.select(*self.schema.names).withColumn(PREFIX, prefix)
        placed.repartition(PREFIX).write.mode("overwrite").partitionBy(PREFIX).parquet(f"{self.path}/{name}")
        keys = self.spark.read.schema(self.stored).parquet(f"{self.path}/{name}").select(PREFIX, self.key)
        bloom(keys.dropna().distinct(), self.key).write.mode("overwrite").parquet(f"{self.path}/filter-{name}")

    def append(self, rows: DataFrame, batch: int) -> None:
        """The rows of a batch; those of an earlier attempt at it are replaced."""
        self._write(rows, f"batch-{batch}")

    def compact(self, upto: int, keep: Column | None = None) -> None:
        """One base of the batches up to ``upto``, of the rows that satisfy ``keep``."""
        rows = self._read(self.live(upto + 1))
        self._write(rows if keep is None else rows.where(keep), f"base-{upto}")

    def drop_superseded(self) -> list[str]:
        """Delete what the newest base has replaced; nobody may still be reading it."""
        live, gone = set(self.live()), []
        newest = max([int(n.split("-")[1]) for n in live if n.startswith("base-")], default=-1)
        for kind, n in self._named():
            if n <= newest and f"{kind}-{n}" not in live:
                gone.append(f"{kind}-{n}")
                for name in (f"{kind}-{n}", f"filter-{kind}-{n}"):
                    files, location = self._at(f"{self.path}/{name}")
                    files.delete(location, True)
        return gone

    # -- reading --------------------------------------------------------------------------------------

    def read(self, before: int | None = None) -> DataFrame:
        return self._read(self.live(before))

    def batch(self, number: int) -> DataFrame:
        return self._read([f"batch-{number}"])

    def candidates(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """``_folder``, prefix and key of the keys that a folder may hold."""
        live = self.live(before)
        wanted = keys.select(self.key).dropna().distinct().withColumn(PREFIX, F.substring(self.key, 1, self.digits))
        found = self.spark.createDataFrame([], f"_folder string, {PREFIX} string, {self.key} string")
        filters = None
        for name in live:
            one = self.spark.read.schema(FILTER).parquet(f"{self.path}/filter-{name}").withColumn("_folder", F.lit(name))
            filters = one if filters is None else filters.unionByName(one)
        if filters is None:
            return found
        sizes = filters.groupBy("_folder", PREFIX).agg(F.max("_blocks").alias("_blocks"))
        probes = wanted.join(sizes, PREFIX).withColumn("_block", _block(F.col(self.key), F.col("_blocks")))
        tested = probes.join(filters.select("_folder", PREFIX, "_block", "_bits"), ["_folder", PREFIX, "_block"])
        return tested.where(_may_hold(F.col("_bits"), _positions(F.col(self.key)))).select("_folder", PREFIX, self.key)

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The stored rows of the keys, read from the folders that may hold some."""
        hits = checkpointed(self.candidates(keys, before))
        folders = hits.select("_folder", PREFIX).distinct().collect()  # at most live batches times prefixes
        rows = nothing(self.spark, self.schema)
        for name in sorted({row["_folder"] for row in folders}):
            paths = [f"{self.path}/{name}/{PREFIX}={row[PREFIX]}" for row in folders if row["_folder"] == name]
            own = self.spark.read.schema(self.schema).parquet(*paths)
            asked = hits.where(F.col("_folder") == name).select(self.key)
            rows = rows.unionByName(own.join(asked, self.key, "left_semi").select(*self.schema.names))
        return rows
