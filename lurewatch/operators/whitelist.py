"""The allow-list check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.url import dot_count, root_domain
from lurewatch.operators.joins import lookup_join

# Up to this many domains the list is written into the plan as a set; beyond it, it is joined.
INLINE_DOMAINS = 10_000


def inline_domains(whitelist: DataFrame) -> list[str] | None:
    """The listed domains when there are few enough, else None."""
    rows = whitelist.select("domain").distinct().limit(INLINE_DOMAINS + 1).collect()
    return [row["domain"] for row in rows] if len(rows) <= INLINE_DOMAINS else None


def root_candidate(host: Column) -> Column:
    """The parent domain that is looked up when the host itself is not listed."""
    return F.when(dot_count(host) >= 2, root_domain(host))


def with_whitelisted(
    df: DataFrame, whitelist: DataFrame | list[str], spread: list[str],
    host: str = "host", into: str = "whitelisted", **options,
) -> DataFrame:
    """Add whether the host or its last two labels are listed."""
    if isinstance(whitelist, DataFrame):
        inline = inline_domains(whitelist)
    else:
        inline = list(whitelist)
    if inline is not None:
        found = F.col(host).isin(inline) | root_candidate(F.col(host)).isin(inline)
        if not inline:
            found = F.lit(False)
        return df.withColumn(into, F.coalesce(found, F.lit(False)))
    listed = whitelist.select(F.col("domain").alias("_domain")).distinct()
    hosts = listed.select(F.col("_domain").alias(host), F.lit(True).alias("_by_host"))
    roots = listed.select(F.col("_domain").alias("_root"), F.lit(True).alias("_by_root"))
    df = df.withColumn("_root", root_candidate(F.col(host)))
    df = lookup_join(df, hosts, host, spread, broadcast=False, **options)
    df = lookup_join(df, roots, "_root", spread, broadcast=False, **options)
    found = F.coalesce(F.col("_by_host"), F.col("_by_root"), F.lit(False))
    return df.withColumn(into, found).drop("_root", "_by_host", "_by_root")
