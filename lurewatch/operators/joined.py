"""The brand, keyword and hosting rules with their lists as tables, for lists too long for a plan.

The literal forms in ``lexical`` and ``infra`` write the lists into expressions and compare each text with
each entry. Here distinct hosts, tokens, paths and owners meet the entries by equal keys, and only what
meets is compared exactly; findings are then joined back to the rows.

*Look-alikes*: a token within k edits of a brand and the brand share a string that each becomes by
leaving out k characters at most; both sides are filed under all such strings.
*Containment*: an entry is filed under the rarest (in the texts) of its three-character pieces; a text is
filed under all of its own pieces that some entry is filed under.
The filed entries are stored, so that their size is known: those of a list of moderate length are sent to
the texts, whose many strings are then met where they are made and never moved. Texts are stored too,
because several rules read them, and dealt evenly, because each makes many strings.

Defined results are those of the literal forms: on a repeated keyword the entry with the highest id
counts, a repeated brand is found each time, an empty entry is in every text, a null entry or text in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.operators import lexical
from lurewatch.operators.infra import HOSTING_RULES
from lurewatch.operators.joins import lookup_join
from lurewatch.session import checkpointed, dealt
from lurewatch.sources.config import RuleConfig

PIECE = 3
HOST_RULES = ["Suspicious Keyword in Domain", "Typosquatting", "Brand Injection", "Fake Parent Domain"]
RULES = [*HOST_RULES, "Suspicious Keyword in Path"]


# -- look-alikes --------------------------------------------------------------------------------------


def _without(rows: DataFrame, name: str, most: Column) -> DataFrame:
    """Add ``key``, a hash of each string that ``name`` becomes without up to ``most`` (2 at most)
    characters; some come more than once. An empty text has none."""
    text, size, i, j = F.col(name), F.length(name), F.col("_i"), F.col("_j")
    # The places of the characters left out, the first before the second; 0 is none.
    firsts = F.when(size > 0, F.when(most >= 2, F.sequence(F.lit(0), size - 1)).otherwise(F.array(F.lit(0))))
    seconds = F.when(most < 1, F.array(F.lit(0))).otherwise(F.sequence(F.when(i == 0, 0).otherwise(i + 1), size))
    rows = rows.select("*", F.explode(firsts).alias("_i")).select("*", F.explode(seconds).alias("_j"))
    rest = F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, j - i - 1), F.substr(text, j + 1))
    return rows.withColumn("key", F.xxhash64(rest)).drop("_i", "_j")


def lookalikes(tokens: DataFrame, brands: DataFrame) -> DataFrame:
    """Distinct ``token`` rows with each brand ``id, name`` that they are an edit away from, or two edits
    from one of six bytes and more, but not equal to."""
    long = F.octet_length("name") >= lexical.LOOSE_BRAND_BYTES
    sized = brands.select("id", "name", F.when(long, 2).otherwise(1).alias("reach")).where("name IS NOT NULL")
    held = checkpointed(_without(sized, "name", F.col("reach")).distinct())
    spans = held.groupBy("reach").agg(F.min(F.length("name")).alias("least"), F.max(F.length("name")).alias("most")).collect()
    pairs = tokens.select("token", F.lit(None).cast(held.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("name")).limit(0)
    for reach, least, most in sorted(spans):
        asked = tokens.select("token").where((F.octet_length("token") >= lexical.LOOKALIKE_MIN_BYTES) & F.length("token").between(
            least - reach, most + reach))
        near = F.levenshtein("token", "name", 2).between(1, reach)
        met = _without(asked, "token", F.lit(reach)).join(held.where(F.col("reach") == reach), "key").where(near)
        pairs = pairs.unionByName(met.select("token", "id", "name"))
    return pairs.distinct()


# -- containment --------------------------------------------------------------------------------------


def _pieces(rows: DataFrame, name: str, size: str) -> DataFrame:
    """Add ``piece``: each string of ``size`` characters in ``name``, as often as it is there; the empty one
    once."""
    text, n, i = F.col(name), F.col(size), F.col("_i")
    starts = F.when(n == 0, F.array(F.lit(1))).when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
    return rows.select("*", F.explode(starts).alias("_i")).withColumn("piece", F.substr(text, i, n)).drop("_i")


def contained(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """``text`` and ``id`` of each distinct text and entry (``id, pattern``) that is part of it."""
    entries = entries.select("id", "pattern").where("pattern IS NOT NULL")
    size = F.least(F.length("pattern"), F.lit(PIECE)).alias("size")
    offered = checkpointed(_pieces(entries.select("id", "pattern", size), "pattern", "size").distinct())
    sizes = [row["size"] for row in offered.select("size").distinct().collect()]  # 0 to PIECE
    names = checkpointed(dealt(texts.select("text").where("text IS NOT NULL").distinct()))
    sized = names.select("text", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size"))
    filed = _pieces(sized, "text", "size").drop("size")
    often = filed.join(offered.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = F.min_by("piece", F.struct(F.coalesce("n", F.lit(0).cast("long")), "piece"))
    chosen = checkpointed(offered.join(often, "piece", "left").groupBy("id", "pattern").agg(rarest.alias("piece")))
    return filed.join(chosen, "piece").where(F.contains("text", "pattern")).select("text", "id", "pattern").distinct().drop("pattern")


def first_hosting(owners: DataFrame, hosting: DataFrame) -> DataFrame:
    """Distinct ``isp`` rows with the first hosting entry (by id) found in the name: ``match``."""
    known = hosting.where(F.col("type").isin(list(HOSTING_RULES)))
    titles = F.create_map(*[F.lit(x) for pair in HOSTING_RULES.items() for x in pair])
    shaped = known.select("id", F.lower("pattern").alias("pattern"), "score", F.element_at(titles, F.col("type")).alias("title"))
    names = owners.select("isp").where("isp <> 'Unknown'").distinct()
    first = contained(names.select(F.lower("isp").alias("text")), shaped).groupBy("text").agg(F.min("id").alias("id"))
    best = first.join(shaped, "id").select("text", F.struct("pattern", "score", "title").alias("match"))
    return names.withColumn("text", F.lower("isp")).join(best, "text").select("isp", "match")


# -- the rules ----------------------------------------------------------------------------------------


def _latest(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("word").agg(F.max_by("score", "id").alias("score"), F.max("id").alias("id"))


def host_findings(hosts: DataFrame, brands: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distinct ``clean_host`` rows (with ``tokens``) and their findings of ``HOST_RULES``."""
    rule, text = lexical.make_rule, F.lit
    each = hosts.select("clean_host", F.explode("tokens").alias("token"))
    tokens = checkpointed(dealt(each.select("token").distinct()))
    words = tokens.join(_latest(keywords).withColumnRenamed("word", "token"), "token").select("token", rule(
        "Suspicious Keyword in Domain", F.concat(text("Keyword '"), "token", text("'")), F.col("score")).alias("rule"))
    typos = lookalikes(tokens, brands).select("token", rule("Typosquatting", F.concat(
        text("Token '"), "token", text("' ~ '"), "name", text("'")), F.lit(55)).alias("rule"))
    found = each.join(words.unionByName(typos), "token").select("clean_host", "rule")

    named = brands.where("name IS NOT NULL")
    names = hosts.select(F.col("clean_host").alias("text"))
    beside = named.select("id", F.concat("name", text("-")).alias("pattern")).unionByName(
        named.select("id", F.concat(text("-"), "name").alias("pattern")))
    joined = contained(names, beside).distinct().join(named, "id")
    found = found.unionByName(joined.select(F.col("text").alias("clean_host"), rule(
        "Brand Injection", F.concat(text("Brand '"), "name", text("' injected")), F.lit(40)).alias("rule")))
    parent = contained(names, named.select("id", F.concat("name", text(".")).alias("pattern"))).join(named, "id")
    rest = F.substr(F.col("text"), F.length("name") + 2)
    own_site = F.startswith(F.col("text"), F.concat("name", text("."))) & ~rest.contains(".")
    found = found.unionByName(parent.where(~own_site).select(F.col("text").alias("clean_host"), rule(
        "Fake Parent Domain", F.concat(text("Subdomain uses '"), "name", text("'")), F.lit(65)).alias("rule")))
    return found.groupBy("clean_host").agg(F.collect_list("rule").alias("host_rules"))


def path_findings(paths: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distinct ``path`` rows and their keywords."""
    words = _latest(keywords).withColumnRenamed("word", "pattern")
    lowered = paths.select("path", F.lower("path").alias("text")).distinct()
    hits = contained(lowered.select("text"), words).join(words, "id").select("text", lexical.make_rule(
        "Suspicious Keyword in Path", F.concat(F.lit("Keyword '"), "pattern", F.lit("'")),
        F.least(F.col("score"), F.lit(lexical.PATH_KEYWORD_CAP))).alias("rule"))
    return lowered.join(hits, "text").groupBy("path").agg(F.collect_list("rule").alias("path_rules"))


def with_rules(df: DataFrame, tables: dict[str, DataFrame], config: RuleConfig, spread: list[str],
               age: Column | None = None, names: list[str] | None = None, into: str = "rules") -> DataFrame:
    """As ``lexical.with_rules``, with the tables ``brands`` and ``keywords`` joined instead of the lists
    in ``config``. ``spread`` names columns that tell rows of one host apart."""
    names = lexical.RULES if names is None else names
    kept = [c for c in df.columns if c != into]
    plain = [n for n in names if n not in RULES]
    df = lexical.with_rules(df, config, age, plain, into) if plain else df.withColumn(into, lexical.empty_rules())
    df = checkpointed(df)
    parsed = df.where("parsed")
    parts = [F.col(into)]
    wanted = [n for n in names if n in HOST_RULES]
    if wanted:
        hosts = checkpointed(parsed.select("clean_host", "tokens").dropDuplicates(["clean_host"]))
        df = lookup_join(df, host_findings(hosts, tables["brands"], tables["keywords"]), "clean_host", spread)
        parts.append(F.filter(F.coalesce("host_rules", lexical.empty_rules()), lambda r: r["name"].isin(wanted)))
    if "Suspicious Keyword in Path" in names:
        df = lookup_join(df, path_findings(parsed.select("path"), tables["keywords"]), "path", spread)
        parts.append(F.coalesce("path_rules", lexical.empty_rules()))
    return df.withColumn(into, F.when(F.col("parsed"), F.concat(*parts)).otherwise(lexical.empty_rules())).select(*kept, into)
