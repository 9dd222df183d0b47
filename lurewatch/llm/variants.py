"""Spelling variants: words one edit apart, the commoner one being the form of the rarer.

A word is seen as the set of its numbered letters (its first e, its second e, ...), a binary vector.
One replaced letter changes two of its places, an inserted or deleted one changes one. The letters are
dealt to ``PARTS`` parts, so at most two (one) parts differ, and a signature is a choice of all parts
but two (one) with their contents: near words agree in at least one. A single edit also leaves the half
of the word before or behind it as it is, so each signature carries the length and one of the halves;
without it, words of the same syllables in another order would share most of their signatures. Equal
signatures are joined, and each candidate pair is compared exactly in the join.

Everything is DataFrame functions: counting words sums up before its shuffle, a word has 40 signatures
whatever the corpus, and roots are found by doubling the steps along forms.

Defined results: a null or empty text has no words; a null id is written as the empty string in the
hash; repeated rows count each time; an empty table gives no words.
"""

from __future__ import annotations

import string
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import stored

RUNS = "[A-Za-zÀ-ÿ]+"
DROP_EVERY = 97
SHORTEST, LEAST_COUNT = 5, 3
PARTS = 4
OUTWEIGHS = 2


def _lowered(run: Column) -> Column:
    """A-Z lower-cased and nothing else; only runs with other letters need the slow way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(
        F.translate(run, string.ascii_uppercase, string.ascii_lowercase))


def words(docs: DataFrame, drop_every: int = DROP_EVERY, shortest: int = SHORTEST,
          least: int = LEAST_COUNT) -> DataFrame:
    """The words of ``doc_id``, ``text`` and how often they occur; every ``drop_every``-th run by hash
    loses a letter."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"({RUNS})"), F.lit(1))).alias("run"))
    runs = runs.select("id", _lowered(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    gone = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    word = F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).where(F.length("word") >= shortest)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))


def dealt_letters(found: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters, dealt to parts of about equal weight; there are at most as many as ``RUNS`` allows."""
    letters = (found.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
               .groupBy("letter").count().collect())
    dealt, weight = [""] * parts, [0] * parts
    for row in sorted(letters, key=lambda r: (-r["count"], r["letter"])):
        lightest = weight.index(min(weight))
        dealt[lightest] += row["letter"]
        weight[lightest] += row["count"]
    return dealt


def _signatures(found: DataFrame, dealt: list[str], inserted: bool) -> DataFrame:
    """Words under each of their signatures. Words of one length meet by all parts but two; a word and
    one with a letter more meet by all but one, the longer one (``inserted``) giving the length and
    halves that it has without its letter."""
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    parted = found.select("word", "n", *[
        F.translate(letters, "".join(dealt[:i] + dealt[i + 1:]), "").alias(f"part{i}") for i in range(len(dealt))])
    length = F.length("word")

    def keys(kind: int, differing: int, base: Column, skipped: int) -> list[Column]:
        half = F.floor(base / 2).cast("int")
        sides = (F.substring("word", F.lit(1), half), F.substring("word", half + 1 + skipped, length))
        return [F.xxhash64(F.lit(kind), base, F.lit(side), sides[side], F.lit(",".join(map(str, kept))),
                           *[F.col(f"part{i}") for i in kept])
                for side in (0, 1) for kept in combinations(range(len(dealt)), len(dealt) - differing)]

    same = F.transform(F.array(*keys(0, 2, length, 0)), lambda k: F.struct(F.lit(0).alias("kind"), k.alias("key")))
    other = F.transform(F.array(*keys(1, 1, length - 1 if inserted else length, int(inserted))),
                        lambda k: F.struct(F.lit(1).alias("kind"), k.alias("key")))
    return parted.select("word", "n", F.explode(F.concat(same, other)).alias("s")).select("s.key", "s.kind", "word", "n")


def near_pairs(found: DataFrame, parts: int = PARTS) -> DataFrame:
    """Every pair of words that differ by one inserted, deleted or replaced letter, once."""
    dealt = dealt_letters(found, parts)
    left = _signatures(found, dealt, inserted=False).alias("l")
    right = _signatures(found, dealt, inserted=True).alias("r")
    near = ((F.col("l.key") == F.col("r.key")) & (F.col("l.kind") == F.col("r.kind"))
            & ((F.col("l.kind") == 1) | (F.col("l.word") < F.col("r.word")))
            & (F.levenshtein("l.word", "r.word", 1) == 1))
    return left.join(right, near).select(
        F.col("l.word").alias("a"), F.col("l.n").alias("n_a"),
        F.col("r.word").alias("b"), F.col("r.n").alias("n_b")).distinct()


def rooted(forms: DataFrame) -> DataFrame:
    """Add ``root``, the end of each word's chain of forms. Counts at least double from a word to its
    form, so chains are short, and each round doubles the steps that are behind a word."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(reached.join(onward, "root", "left"), "roots")
        if step.where("_next IS NOT NULL").isEmpty():
            return reached
        reached = step.select("word", F.coalesce("_next", "root").alias("root"))


def grouped(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """Every word with its form, root and numbers of occurrences and near words."""
    found = stored(words(docs), "words")
    pairs = stored(near_pairs(found, parts), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("n_other"))
    both = both.unionByName(pairs.select(
        F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.first("n").alias("n"),
        F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    outweighed = -F.col("best.less") >= OUTWEIGHS * F.col("n")
    near = stored(best.select("word", "n_near", F.when(outweighed, F.col("best.other")).alias("form"),
                              F.when(outweighed, -F.col("best.less")).alias("form_n")), "near")
    roots = rooted(near.where("form IS NOT NULL"))
    return (found.join(near, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def oracle() -> str:
    """The same in DuckDB's SQL: checksums byte by byte, near words by their strings without a letter."""
    return f"""
WITH RECURSIVE
crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_concat([b::BIGINT], [0::BIGINT FOR x IN range(8)]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))),
runs AS (
  SELECT doc_id, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(id || ':' || run)), '(..)', '\\1 ', 'g')[:-2], ' '),
      lambda x: ('0x' || x)::BIGINT)),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h
  FROM counted, crc_table),
words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % {DROP_EVERY} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS MATERIALIZED (
  SELECT word, n_near, CASE WHEN m >= {OUTWEIGHS} * n THEN other END AS form, CASE WHEN m >= {OUTWEIGHS} * n THEN m END AS form_n FROM (
    SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near) WHERE r = 1),
chain AS (
  SELECT word, form AS at FROM best WHERE form IS NOT NULL
  UNION SELECT c.word, b.form FROM chain c JOIN best b ON c.at = b.word WHERE b.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c LEFT JOIN best b ON c.at = b.word WHERE b.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN ends USING (word)
"""
