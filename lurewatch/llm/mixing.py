"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Every source has a weight. The mix aims at as many words as all documents have; a source's target is
its share by weight, but at most ``epochs`` times its own words. What a capped source cannot take is
shared again among the others by weight, until no target is above its cap.

A source whose target is k whole times its words and a rest takes every document k times. The rest
is filled with whole documents in a seeded order: a document goes in while at least half of it fits,
so a source misses its target by at most half a document.

Defined results: a null text has 0 words; a null source is a source of its own, ordered last; an
empty table gives an empty mix; sources without words have target 0; rows that agree in id and text
are taken alike. Columns of the input with the names added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lurewatch.llm.common import matched, ranked, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"

# The seeded order is cut into this many slices per source, so that no task sorts a whole source.
SLICE_DIGITS = 3


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Add ``size`` (words) and ``_key`` (place in the seeded order)."""
    text = F.coalesce(F.md5(F.col("text")), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumn(
        "size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    ).withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), name, text)))


def water_level(sources: DataFrame, epochs: int) -> float:
    """Words per unit of weight that sources below their cap get.

    Each round caps the sources that the last level would fill beyond their cap; the level only
    rises, so the rounds end. ``sources`` is stored; a round is one small aggregate."""
    cap = F.lit(epochs) * F.col("source_size")
    level, capped = -1.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, cap)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("full"),
        ).first()
        if row["full"] == capped or not row["open"]:
            return max(level, 0.0)
        capped = row["full"]
        level = float(row["total"] - (row["held"] or 0)) / row["open"]


def mixture(
    words: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
) -> DataFrame:
    """One row per source: size, target, whole repetitions and the last key of the partial one.

    ``words`` holds ``source``, ``size`` and ``_key`` of every document and is read several times,
    so it should be stored."""
    sums = words.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    cycle = F.array(*map(F.lit, weights))
    sources = stored(
        ranked(sums, order, "_rank").withColumn(
            "weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int"))), "sources")
    level = water_level(sources, epochs)
    cap = (F.lit(epochs) * F.col("source_size")).cast("double")
    target = F.least(cap, F.col("weight") * F.lit(level))
    whole = F.when(F.col("source_size") > 0,
                   F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = sources.withColumn("target", target).withColumn("whole", whole).withColumn(
        "_rest", F.col("target") - F.col("whole") * F.col("source_size"))

    # The slice of the seeded order in which a source's rest ends: sums by slice, then that slice.
    slices = words.groupBy("source", F.substring("_key", 1, SLICE_DIGITS).alias("_slice")).agg(
        F.sum("size").alias("_words"))
    so_far = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    upto = slices.withColumn("_upto", F.sum("_words").over(so_far))
    same = F.col("s.source").eqNullSafe(F.col("g.source"))
    last = upto.alias("s").join(goals.alias("g"), same).where(
        (F.col("_upto") - F.col("_words") <= F.col("_rest")) & (F.col("_rest") < F.col("_upto"))
    ).select("s.source", "_slice", (F.col("_rest") - F.col("_upto") + F.col("_words")).alias("_left"))
    inside = words.alias("w").join(
        F.broadcast(last.alias("l")) if sources.count() <= 20_000 else last.alias("l"),
        F.col("w.source").eqNullSafe(F.col("l.source"))
        & (F.substring("w._key", 1, SLICE_DIGITS) == F.col("l._slice")),
    ).groupBy("w.source", "_slice", "_left", "_key").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("size") / 2 <= F.col("_left")
    cuts = inside.withColumn("_fits", fits).groupBy("source", "_slice").agg(
        F.max(F.when(F.col("_fits"), F.col("_key"))).alias("_cut")
    ).select("source", F.coalesce("_cut", "_slice").alias("_cut"))
    return goals.alias("g").join(
        cuts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left"
    ).select("g.source", "source_size", "weight", "target", "whole", "_cut")


def taken(words: DataFrame, plan: DataFrame) -> DataFrame:
    """Add each document's ``source_size``, ``target``, ``repeats`` and ``taken`` words."""
    plan = plan.withColumnRenamed("source", "_source")
    joined = matched(words.drop("source_size", "weight", "target", "whole", "_cut"), plan,
                     F.col("source").eqNullSafe(F.col("_source")), "inner")
    extra = F.coalesce((F.col("_key") <= F.col("_cut")).cast("int"), F.lit(0))
    return joined.withColumn("repeats", F.col("whole") + extra).withColumn(
        "taken", F.col("size") * F.col("repeats")).drop("_source", "_cut", "_key", "whole", "weight")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
        seed: str = SEED) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``repeats`` and ``taken``."""
    words = sized(docs, seed)
    plan = stored(mixture(stored(words.select("source", "size", "_key"), "words"), weights, epochs), "mixture")
    return taken(words, plan)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    kept = [c for c in docs.columns]
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    chosen = mix(docs.select(F.struct(*kept).alias("_row"), "doc_id", "text", "source"), **options)
    return chosen.where(F.col("repeats") > 0).select("_row", copies).select("_row.*")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM words GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open,
         3 * coalesce(sum(source_size) OVER earlier, 0) AS held
  FROM sources
  WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce(max((total - held)::DOUBLE / open)
                  FILTER (3 * source_size > weight * ((total - held)::DOUBLE / open)), 0) AS level
  FROM filled),
goals AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * level) AS target
  FROM sources, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goals),
keyed AS (
  SELECT source, k, sum(size) AS size,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY k
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM words GROUP BY source, k)
SELECT w.doc_id, w.size, p.source_size, p.target,
       (w.size * (p.whole + (q.before + q.size / 2 <= p.target - p.whole * p.source_size)::INT))::BIGINT AS taken
FROM words w
JOIN parts p ON w.source IS NOT DISTINCT FROM p.source
JOIN keyed q ON w.source IS NOT DISTINCT FROM q.source AND w.k = q.k
"""
