"""URL filters by dated lists: each capture is judged by the entries in force when it was fetched.

A list entry names a URL, a path prefix, a host or a domain, and blocks it, allows it or takes it off
the list from a moment on. An entry holds until the next one for the same name, which gives validity
intervals. A capture looks up all its names; for each the latest interval that began by the fetch
(as-of) counts if it has not ended. Of these, the most specific decides: URL before the longest
prefix before host before the longest domain.

No group grows with the tables. Intervals lie in one row per name and day; what is in force when a day
begins is carried from the days before, over at most as many rows as there are days. Captures are
reduced to distinct URLs and seconds and meet one row per name and day, in joins that adaptive
execution splits when a host is common.

Times are whole seconds. Defined results: captures without URL or time are kept without a match;
entries without kind, pattern, time or known action are passed over; of entries for one name and
second, blocking wins over allowing over taking off; repeated rows are judged alike; empty tables are
allowed on either side. Columns of the captures with the names added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400
KINDS = {"domain": 1, "host": 2, "prefix": 3, "url": 4}
ACTIONS = {"remove": 0, "allow": 1, "block": 2}
ADDED = ["decision", "matched", "valid_from"]


def _ranked(column: Column, ranks: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), column)


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def path(url: Column) -> Column:
    """The path without slashes at its ends."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")


def names(url: Column) -> Column:
    """The names of a URL: an array of (kind, pattern)."""
    labels, parts = F.split(host(url), r"\."), F.split(path(url), "/+")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    whole = F.concat(host(url), F.lit("/"), path(url))

    def named(kind: str, pattern: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))

    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: named(
        "domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.when(path(url) == "", F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: named(
            "prefix", F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))))
    return F.concat(domains, F.array(named("host", host(url))), prefixes,
                    F.array(named("url", F.concat(whole, query))))


def validity(entries: DataFrame) -> DataFrame:
    """One row per name and day with its intervals: valid_from, valid_to (null: open), action."""
    action = _ranked(F.col("action"), ACTIONS)
    usable = entries.select("kind", "pattern", F.col("listed_at").cast("long").alias("at"), action.alias("rank")).where(
        F.col("kind").isin(*KINDS) & F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("rank").isNotNull())
    points = usable.groupBy("kind", "pattern", "at").agg(F.max("rank").alias("rank"))
    daily = points.groupBy("kind", "pattern", F.floor(F.col("at") / DAY).alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("at", "rank"))).alias("points"))  # a day has DAY seconds
    following = F.lead(F.col("points")[0]["at"]).over(Window.partitionBy("kind", "pattern").orderBy("day"))
    return daily.withColumn("_next", following).select("kind", "pattern", "day", F.transform(
        "points", lambda p, i: F.struct(
            p["at"].alias("valid_from"),
            F.coalesce(F.get("points", i + 1)["at"], F.col("_next")).alias("valid_to"),
            p["rank"].alias("rank"))).alias("intervals"))


def decisions(points: DataFrame, entries: DataFrame) -> DataFrame:
    """The deciding entry of each distinct ``url`` and ``at``; points without one are left out."""
    asked = points.select("url", "at", F.floor(F.col("at") / DAY).alias("day"), F.explode(names(F.col("url"))).alias("n"))
    asked = asked.select("url", "at", "day", "n.kind", "n.pattern")
    days = asked.select("kind", "pattern", "day").distinct()
    listed = validity(entries)
    none = F.lit(None).cast(listed.schema["intervals"].dataType)
    rows = listed.union(days.select("kind", "pattern", "day", none)).groupBy("kind", "pattern", "day").agg(
        F.first("intervals", ignorenulls=True).alias("intervals"))
    before = Window.partitionBy("kind", "pattern").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.element_at("intervals", -1), ignorenulls=True).over(before)
    state = rows.withColumn("carried", carried).where("intervals IS NOT NULL OR carried IS NOT NULL")
    begun = F.filter("intervals", lambda i: i["valid_from"] <= F.col("at"))
    latest = F.coalesce(F.get(begun, F.size(begun) - 1), F.col("carried"))
    found = asked.join(state, ["kind", "pattern", "day"]).withColumn("hit", latest).where(
        (F.col("hit.rank") > ACTIONS["remove"])
        & (F.col("hit.valid_to").isNull() | (F.col("at") < F.col("hit.valid_to"))))
    best = F.max(F.struct(
        _ranked(F.col("kind"), KINDS).alias("level"), F.length("pattern").alias("size"), "kind", "pattern", "hit"))
    return found.groupBy("url", "at").agg(best.alias("best")).select(
        "url", "at", F.when(F.col("best.hit.rank") == ACTIONS["block"], "block").otherwise("allow").alias("decision"),
        F.concat_ws(":", "best.kind", "best.pattern").alias("matched"), F.col("best.hit.valid_from").alias("valid_from"))


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures with ``decision`` (block, allow, or null), ``matched`` and ``valid_from``.

    Captures have ``url`` and ``fetched_at``, entries ``kind``, ``pattern``, ``action`` and
    ``listed_at``; times are seconds since 1970."""
    kept = [c for c in captures.columns if c not in ADDED]
    rows = captures.select(F.struct(*kept).alias("_row"), F.col("url"), F.col("fetched_at").cast("long").alias("at"))
    points = rows.where("url IS NOT NULL AND at IS NOT NULL").select("url", "at").distinct()
    return rows.join(decisions(points, entries), ["url", "at"], "left").select("_row.*", *ADDED)


# -- the query's inputs, made from the page table ---------------------------------------------------

START, MINUTES = 1_672_531_200, 2 * 365 * 1440


def _digits(seed: str, first: int, count: int) -> Column:
    text = F.md5(F.concat(F.lit(seed), F.coalesce("url", F.lit("")), F.lit("|"),
                          F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(text, first, count), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    """Every page with a time of fetching in two years."""
    return pages.select("page_id", "url", (F.lit(START) + _digits("fetch:", 1, 6) % MINUTES * 60).alias("fetched_at"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated entry from every page: for its URL, first path part, host or domain."""
    kind, action, site = _digits("entry:", 1, 1), _digits("entry:", 2, 1), host(F.col("url"))
    part = F.split(path(F.col("url")), "/+")[0]
    return pages.select(
        F.when(kind < 8, "url").when(kind < 12, "prefix").when(kind < 15, "host").otherwise("domain").alias("kind"),
        F.when(kind < 8, F.concat(site, F.lit("/"), path(F.col("url")), F.regexp_extract("url", r"^[^?#]*(\?[^#]*)", 1)))
        .when(kind < 12, F.concat(site, F.lit("/"), part)).when(kind < 15, site)
        .otherwise(F.regexp_extract(site, r"[^.]+\.[^.]+\.[^.]+$", 0)).alias("pattern"),
        F.when(action < 6, "block").when(action < 9, "allow").otherwise("remove").alias("action"),
        (F.lit(START) + _digits("entry:", 3, 6) % MINUTES * 60).alias("listed_at"))


ORACLE = r"""
WITH pages1 AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path,
         regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query,
         md5('fetch:' || coalesce(url, '') || '|' || coalesce(page_id::VARCHAR, '')) AS f,
         md5('entry:' || coalesce(url, '') || '|' || coalesce(page_id::VARCHAR, '')) AS e
  FROM pages),
captures AS (
  SELECT page_id, url, host, path, query,
         1672531200 + ('0x' || f[1:6])::BIGINT % 1051200 * 60 AS fetched_at FROM pages1),
entries AS (
  SELECT CASE WHEN ('0x' || e[1:1])::INT < 8 THEN 'url' WHEN ('0x' || e[1:1])::INT < 12 THEN 'prefix'
              WHEN ('0x' || e[1:1])::INT < 15 THEN 'host' ELSE 'domain' END AS kind,
         CASE WHEN ('0x' || e[1:1])::INT < 8 THEN host || '/' || path || query
              WHEN ('0x' || e[1:1])::INT < 12 THEN host || '/' || string_split(path, '/')[1]
              WHEN ('0x' || e[1:1])::INT < 15 THEN host
              ELSE regexp_extract(host, '[^.]+\.[^.]+\.[^.]+$') END AS pattern,
         CASE WHEN ('0x' || e[2:2])::INT < 6 THEN 2 WHEN ('0x' || e[2:2])::INT < 9 THEN 1 ELSE 0 END AS rank,
         1672531200 + ('0x' || e[3:8])::BIGINT % 1051200 * 60 AS since
  FROM pages1),
points AS (SELECT kind, pattern, since, max(rank) AS rank FROM entries WHERE pattern IS NOT NULL GROUP BY ALL),
names AS (
  SELECT page_id, url, fetched_at, 'url' AS kind, 4 AS level, host || '/' || path || query AS pattern FROM captures
  UNION ALL SELECT page_id, url, fetched_at, 'host', 2, host FROM captures
  UNION ALL SELECT page_id, url, fetched_at, 'prefix', 3,
    host || '/' || array_to_string(parts[1:unnest(range(1, len(parts) + 1))], '/')
    FROM (SELECT *, string_split(path, '/') AS parts FROM captures WHERE path <> '')
  UNION ALL SELECT page_id, url, fetched_at, 'domain', 1,
    array_to_string(labels[unnest(range(1, len(labels) + 1)):], '.')
    FROM (SELECT *, string_split(host, '.') AS labels FROM captures)),
hits AS (
  SELECT n.page_id, n.url, n.fetched_at, n.kind, n.level, n.pattern, p.rank, p.since
  FROM names n ASOF JOIN points p ON n.kind = p.kind AND n.pattern = p.pattern AND n.fetched_at >= p.since),
best AS (
  SELECT page_id, url, fetched_at, max(struct_pack(level, size := length(pattern), kind, pattern, since, rank)) AS b
  FROM hits WHERE rank > 0 GROUP BY page_id, url, fetched_at)
SELECT c.page_id, c.url, c.fetched_at,
       CASE b.b.rank WHEN 2 THEN 'block' WHEN 1 THEN 'allow' END AS decision,
       b.b.kind || ':' || b.b.pattern AS matched, b.b.since AS valid_from
FROM captures c LEFT JOIN best b ON c.page_id = b.page_id AND c.url = b.url AND c.fetched_at = b.fetched_at
"""
