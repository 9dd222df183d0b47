"""The threat table: first-wins upsert, accounting, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.url import url_hash
from lurewatch.operators.joins import lookup_join

KEY = ["url_hash", "source"]
STORED = ["url", "url_hash", "source", "external_id", "threat_type", "created_at"]


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("url_hash", url_hash(F.col("url")))


def first_per_key(threats: DataFrame, order: str = "seq") -> DataFrame:
    """The earliest row per (url_hash, source). An aggregate, not a window: copies are reduced before
    the shuffle, so a key with very many copies is no burden."""
    others = [c for c in threats.columns if c not in KEY]
    first = F.min_by(F.struct(*others), order)
    return threats.groupBy(*KEY).agg(first.alias("_first")).select(
        *KEY, *[F.col(f"_first.{c}").alias(c) for c in others])


def new_threats(existing: DataFrame, arriving: DataFrame, as_of: Column, order: str = "seq") -> DataFrame:
    """Rows to append: first arrivals whose (url_hash, source) is not stored, stamped ``as_of``."""
    fresh = first_per_key(with_hash(arriving), order).join(existing.select(*KEY), KEY, "left_anti")
    return fresh.withColumn("created_at", as_of).select(*STORED)


def ingest_stats(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """Rows read, inserted and skipped per source."""
    per_key = with_hash(arriving).groupBy(*KEY).agg(F.count("*").alias("rows"))
    known = existing.select(*KEY, F.lit(True).alias("known"))
    marked = per_key.join(known, KEY, "left")
    inserted = F.sum(F.when(F.col("known").isNull(), 1).otherwise(0))
    return marked.groupBy("source").agg(
        F.sum("rows").alias("total_read"), inserted.alias("inserted"),
        (F.sum("rows") - inserted).alias("skipped"))


def complete(threats: DataFrame) -> DataFrame:
    """Rows a lookup may return: those without a NULL in the text columns."""
    return threats.dropna(subset=["url", "source", "external_id", "threat_type"])


def by_hash(threats: DataFrame) -> DataFrame:
    """One row per url_hash: its listings, oldest first, and one signal text per listing. The table
    holds a (url_hash, source) pair once; pairs written twice are reduced to the oldest here, so the
    list is as long as the number of sources at most."""
    once = first_per_key(complete(threats), "created_at")
    listing = F.struct(
        "created_at", "source", F.col("external_id").alias("ext_id"),
        F.col("threat_type").alias("type"))
    grouped = once.groupBy("url_hash").agg(F.array_sort(F.collect_list(listing)).alias("_rows"))
    return grouped.select(
        "url_hash",
        F.transform("_rows", lambda r: F.struct(
            r["source"].alias("source"), r["ext_id"].alias("ext_id"), r["type"].alias("type"),
            F.date_format(r["created_at"], "yyyy-MM-dd").alias("first_seen"))).alias("blacklists"),
        F.transform("_rows", lambda r: F.concat(
            F.lit("Listed in "), r["source"], F.lit(" as "), r["type"])).alias("blacklist_signals"))


def blacklist_lookup(urls: DataFrame, threats: DataFrame, spread: list[str], **options) -> DataFrame:
    """Each URL row with its listings; NULL where it is not listed."""
    return lookup_join(with_hash(urls), by_hash(threats), "url_hash", spread, **options)


def listed(urls: DataFrame, threats: DataFrame) -> DataFrame:
    """URL rows whose hash is in the threat table. Only the distinct hashes take part."""
    hashes = threats.select("url_hash").distinct()
    return with_hash(urls).join(hashes, "url_hash", "left_semi")
