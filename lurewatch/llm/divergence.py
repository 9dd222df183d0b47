"""How the sources of a language differ in their words, by single-pass in-memory indexing.

Each task counts the terms of its texts in memory, a list of counts for each language and source, until
``ENTRIES`` are held; then it spills them as a run sorted by term. Runs go to hash shards by language
and term, where Spark's external sort merges them, and one streaming pass adds up equal entries and
gives each term's occurrences by source and its number of documents. Terms in fewer than ``LEAST_DOCS``
documents of the language are dropped.

A group's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)) and its distance from q is
floor((p - q)^2 / q). Most sources lack most terms, so a pair of sources starts with the distance of two
absent terms times V, and terms are streamed for corrections: what differs where the one has the term,
then where the other has it. Terms are dealt to many groups per language, each of which gives one figure
for each pair; only figures are summed. All arithmetic is on integers.

The result names every pair of sources of a language, so a group's table of pairs is as large as that
part of the result.

Defined results: null text, language and source are empty strings; repeated rows count each time;
equal values are ranked by the item's UTF-8 bytes; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lurewatch.llm.common import matched, small_batches, stored

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
ENTRIES = 1_000_000  # terms a task holds before it spills a run
GROUP_TERMS = 4_000  # terms that one task corrects pairs for at once
CELLS = 2_000_000  # shares held at once while correcting

_FOLDED = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_RUN = "lang string, term string, source string, n long, docs long"
_POSTINGS = "lang string, term string, docs long, sources array<string>, counts array<long>"


def _indexed(most: int):
    """Runs of (lang, term, source, occurrences, documents), sorted by language, term and source."""

    def run(batches):
        block: dict[tuple, tuple[Counter, Counter]] = {}

        def spilled():
            parts = []
            for (lang, source), (counts, docs) in block.items():
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                same = [pa.array([x] * len(counts), pa.string()) for x in (lang, source)]
                parts.append(pa.table([same[0], terms, same[1], pa.array(list(counts.values()), pa.int64()),
                                       pa.array([docs[t] for t in counts], pa.int64())],
                                      names=["lang", "term", "source", "n", "docs"]))
            block.clear()
            if parts:
                table = pa.concat_tables(parts)
                yield from table.sort_by([(c, "ascending") for c in ("lang", "term", "source")]).to_batches(100_000)

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                       batch.column(2).cast(pa.binary()).to_pylist())
            for lang, source, data in rows:
                terms = data.translate(_FOLDED).split()
                if terms:
                    if (lang, source) not in block:
                        block[lang, source] = (Counter(), Counter())
                    counts, docs = block[lang, source]
                    counts.update(terms)
                    docs.update(set(terms))
            if sum(len(counts) for counts, _ in block.values()) >= most:
                yield from spilled()
        yield from spilled()

    return run


def _merged(least: int):
    """Equal entries of sorted rows added up; a row per term with its sources. What a batch's last term
    has so far is carried to the next batch."""

    def starts(columns) -> np.ndarray:
        new = np.zeros(len(columns[0]), dtype=bool)
        new[0] = True
        for c in columns:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def summed(table: pa.Table) -> pa.Table:
        lang, term, source = (table[c].combine_chunks() for c in ("lang", "term", "source"))
        first = starts([lang, term, source])
        return pa.table([lang.take(first), term.take(first), source.take(first),
                         np.add.reduceat(table["n"].to_numpy(), first), np.add.reduceat(table["docs"].to_numpy(), first)],
                        names=table.column_names)

    def postings(table: pa.Table) -> pa.RecordBatch:
        lang, term = (table[c].combine_chunks() for c in ("lang", "term"))
        first = starts([lang, term])
        docs = np.add.reduceat(table["docs"].to_numpy(), first)
        edges = pa.array(np.append(first, len(table)), pa.int32())
        made = pa.RecordBatch.from_arrays([
            lang.take(first), term.take(first), pa.array(docs),
            pa.ListArray.from_arrays(edges, table["source"].combine_chunks()),
            pa.ListArray.from_arrays(edges, table["n"].combine_chunks())],
            names=["lang", "term", "docs", "sources", "counts"])
        return made.filter(pa.array(docs >= least))

    def run(batches):
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = summed(pa.concat_tables([carried, table]) if carried else table)
            last = starts([table[c].combine_chunks() for c in ("lang", "term")])[-1]
            if last:
                yield postings(table.slice(0, last))
            carried = table.slice(last)
        if carried:
            yield postings(carried)

    return run


def postings(docs: DataFrame, least: int = LEAST_DOCS, most: int = ENTRIES) -> DataFrame:
    """The kept terms of each language with their documents and occurrences by source."""
    small_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    runs = texts.mapInArrow(_indexed(most), _RUN)
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = runs.repartition(shards, "lang", "term").sortWithinPartitions("lang", "term", "source")
    return merged.mapInArrow(_merged(least), _POSTINGS)


def share(count: str, total: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)) of two columns and ``terms``, exact for any counts."""
    return F.expr(f"1 + CAST({count} + 1 AS DECIMAL(20, 0)) * {SCALE} DIV ({total} + terms)")


def shares(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The same in numpy: three digits at a time, so that nothing overflows."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, base).shape, dtype=np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, base)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _corrections(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over the terms of how much each pair's distance differs from that of two absent terms."""
    names = ["lang", "source", "item", "value"]
    kinds = [pa.string()] * 3 + [pa.int64()]
    if not terms.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    sources = groups["source"].to_pylist()
    width = len(sources)
    place = {s: i for i, s in enumerate(sources)}
    base = groups["n"].to_numpy() + groups["terms"].to_numpy()
    absent = shares(np.zeros(width, dtype=np.int64), base)
    both = distance(absent[:, None], absent[None, :])
    value = np.zeros((width, width), dtype=np.int64)
    sizes = pc.list_value_length(terms["sources"]).to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.array([place[s] for s in pc.list_flatten(terms["sources"]).to_pylist()])
    counts = pc.list_flatten(terms["counts"]).to_numpy()
    step = max(1, CELLS // width)
    for low in range(0, len(sizes), step):
        inside = slice(*np.searchsorted(owner, [low, low + step]))
        rows, own, n = owner[inside] - low, at[inside], counts[inside]
        p = np.tile(absent, (min(step, len(sizes) - low), 1))
        p[rows, own] = shares(n, base[own])
        for g in np.unique(own):
            having = p[rows[own == g]]
            mine = having[:, g][:, None]
            value[g] += (distance(mine, having) - distance(absent[g], having)).sum(axis=0)
            value[:, g] += (distance(absent[None, :], mine) - both[:, g]).sum(axis=0)
    one, other = np.nonzero(~np.eye(width, dtype=bool))
    lang = [groups["lang"][0].as_py()] * len(one)
    named = np.array(sources, dtype=object)
    return pa.table([pa.array(lang, pa.string()), pa.array(named[one], pa.string()),
                     pa.array(named[other], pa.string()), pa.array(value[one, other])], names=names)


def audited(docs: DataFrame, top: int = TOP_TERMS, group_terms: int = GROUP_TERMS) -> DataFrame:
    """Ranked distances between sources, and the terms that set each source off from its language."""
    kept = stored(postings(docs), "postings")
    spread = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    entries = spread.select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    in_group = entries.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    in_lang = kept.groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("lang_n"))
    occurring = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    zero = F.lit(0).cast("long")
    groups = stored(occurring.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "terms", "lang_n")]), "groups")

    # Terms that a group has relatively more of than its language.
    with_lang = kept.select("lang", "term", "sources", "counts",
                            F.aggregate("counts", zero, lambda a, c: a + c).alias("lang_count"))
    each = with_lang.select("lang", "term", "lang_count", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", "lang_count", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    each = matched(each, groups, ["lang", "source"], "inner").select(
        "lang", "source", "term", share("count", "n").alias("p"),
        share("lang_count", "lang_n").alias("q"))
    each = each.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                      F.expr("(p - q) * (p - q) DIV q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Distances between sources: all terms absent, then the corrections.
    parts = max(1, -(-kept.count() // group_terms))
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).alias("_part")
    left = kept.select("lang", part, "sources", "counts").groupBy("lang", "_part")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"),
                          "source", "n", "terms").where("terms > 0").groupBy("lang", "_part")
    corrections = left.cogroup(right).applyInArrow(
        _corrections, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"))
    p0 = groups.select("lang", "source", "terms", F.when(F.col("terms") > 0, share("0", "n")).alias("p"))
    pairs = p0.join(p0.select("lang", F.col("source").alias("item"), F.col("p").alias("q")), "lang").where("source <> item")
    pairs = pairs.join(corrections, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        F.coalesce(F.expr("terms * ((p - q) * (p - q) DIV q)"), zero).alias("start"), F.coalesce("value", zero).alias("value"))
    pairs = pairs.select("lang", "source", "part", "item", (F.col("start") + F.col("value")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(best)


def oracle() -> str:
    """The audit in DuckDB's SQL, with every pair of sources over every kept term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def p(count: str, n: str) -> str:
        return f"1 + ({SCALE}::HUGEINT * ({count} + 1)) // ({n} + v)"

    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
occurrences AS MATERIALIZED (SELECT r, lang, source, unnest(ws) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM occurrences GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS MATERIALIZED (
  SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) USING (lang, source) LEFT JOIN sized USING (lang)),
shares AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c, 0) AS c, {p('coalesce(c, 0)', 'n')} AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
langs AS (
  SELECT lang, term, {p('sum(c)', 'any_value(n)')} AS q FROM counts
  JOIN sized USING (lang) JOIN (SELECT lang, sum(c) AS n FROM counts GROUP BY lang) USING (lang) GROUP BY lang, term, v),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM shares x JOIN shares y ON x.term = y.term AND x.lang = y.lang
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM shares JOIN langs USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
