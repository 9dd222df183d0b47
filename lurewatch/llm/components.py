"""Connected components of a link table, by joins that keep every step's rows near the links'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored, so that the join is one of two shuffles, whose partitions can be split at a large star.
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    inner = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """Rows ``a``, ``b``: every node but the smallest of its component, and that smallest node.

    ``links`` has columns ``a`` and ``b``; order, copies and loops don't matter. Stars are rewritten
    until nothing changes, which takes about as many rounds as the logarithm of the longest path;
    each round is written to the shared folder, so a lost executor repeats one round at most."""
    links = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        links = stored(_small_star(_large_star(links)).distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return links
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
