"""The query catalogue: one entry per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions import page as P
from lurewatch.functions import score as S
from lurewatch.functions import url as U
from lurewatch.functions.barrier import settled
from lurewatch.functions.dates import with_registration_age
from lurewatch.operators import anchored, geo, infra, joined, lexical, threats
from lurewatch.operators.whitelist import with_whitelisted
from lurewatch.plans import check as C
from lurewatch.plans import corpus
from lurewatch.session import shared_folder
from lurewatch.sources import config, feeds
from lurewatch.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CONFIG = config.RuleConfig()


def as_of() -> Column:
    return F.lit(corpus.AS_OF_SECONDS)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def urls(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.view(spark, sf, "url_corpus")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return U.with_url_parts(urls(spark, sf))


def ruled(spark: SparkSession, sf: str, names: list[str] | None = None) -> DataFrame:
    return lexical.with_rules(parts(spark, sf), CONFIG, domain_age(), names)


def domain_age() -> Column:
    """A domain age per corpus row, so that age-dependent rules and scores are exercised."""
    return F.when(F.col("url_id") % 4 == 0, (F.col("url_id") % 30).cast("int")).when(
        F.col("url_id") % 4 == 1, F.lit(400)).otherwise(F.lit(0))


def trust() -> Column:
    return F.col("url_id") % 3 == 0


# -- feeds ----------------------------------------------------------------------------------------

RAW_VIEWS = {"phishtank": "raw_phishtank", "urlhaus": "raw_urlhaus", "threatfox": "raw_threatfox"}


def raw_view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return corpus.view(spark, sf, RAW_VIEWS.get(name, "raw_lines"))


def _feed(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        raw = raw_view(spark, sf, name)
        if name in feeds.CSV_FEEDS:  # landed, so that its texts become lines
            folder = shared_folder(spark, "feed")
            raw.write.text(folder)
            return feeds.read_feed(spark, name, folder)
        return feeds.NORMALISERS[name](raw)

    return run


for _name in feeds.NORMALISERS:
    QUERIES[f"feed_{_name}"] = _feed(_name)


@query
def feeds_union(spark, sf):
    return feeds.union_feeds([QUERIES[f"feed_{name}"](spark, sf) for name in feeds.NORMALISERS])


# -- configuration ------------------------------------------------------------------------------------


@query
def scan_whitelist(spark, sf):
    hosts = U.with_lookup_host(urls(spark, sf)).groupBy("host").agg(F.count("*").alias("n"))
    listed = config.seed_tables(spark)["whitelist"]
    hits = hosts.select(U.root_domain(F.col("host")).alias("domain"), "n")
    counts = hits.groupBy("domain").agg(F.sum("n").alias("n_urls"))
    return listed.join(counts, "domain", "left").select(
        "domain", F.coalesce("n_urls", F.lit(0)).alias("n_urls"))


def _owner_usage(spark, sf):
    """Countries of the located hosts, and the hosting pattern each owner's name meets first."""
    located = facts(spark, sf).where(F.col("online"))
    pattern = infra.hosting_match(CONFIG, F.col("isp"))["pattern"]
    named = config.seed_tables(spark)["hosting"].select(F.lower("pattern").alias("lower"), F.col("pattern").alias("key"))
    return [
        located.select(F.lit(0).alias("url_id"), F.col("country").alias("key"), F.lit("geo_risk").alias("kind")),
        located.select(pattern.alias("lower")).join(named, "lower").select(
            F.lit(0).alias("url_id"), "key", F.lit("hosting").alias("kind")),
    ]


def _config_usage(spark, sf):
    """Entries of the exact-match tables with the number of corpus URLs that meet them."""
    tables = config.seed_tables(spark)
    p = parts(spark, sf)
    token = F.explode_outer(F.array_distinct("tokens")).alias("key")
    met = feeds.union_feeds([
        p.select("url_id", token).withColumn("kind", F.lit("brand")),
        p.select("url_id", token).withColumn("kind", F.lit("keyword")),
        p.select("url_id", U.top_level_domain(F.col("hostname")).alias("key"),
                 F.lit("tld").alias("kind")),
        p.select("url_id", F.col("clean_host").alias("key"), F.lit("shortener").alias("kind")),
        *_owner_usage(spark, sf),
    ])
    counts = met.groupBy("kind", "key").agg(F.count("*").alias("n_urls"))
    entries = feeds.union_feeds([
        tables["brands"].select(F.lit("brand").alias("kind"), F.col("name").alias("key"),
                                F.lit(None).cast("int").alias("score")),
        tables["keywords"].select(F.lit("keyword").alias("kind"), F.col("word").alias("key"), "score"),
        tables["tlds"].select(F.lit("tld").alias("kind"), F.col("tld").alias("key"), "score"),
        tables["shorteners"].select(
            F.lit("shortener").alias("kind"), F.col("domain").alias("key"), "score"),
        tables["geo_risks"].select(F.lit("geo_risk").alias("kind"), F.col("country").alias("key"), "score"),
        tables["hosting"].select(F.lit("hosting").alias("kind"), F.col("pattern").alias("key"), "score"),
    ])
    return entries.join(counts, ["kind", "key"], "left").select(
        "kind", "key", "score", F.coalesce("n_urls", F.lit(0)).alias("n_urls"))


@query
def scan_config(spark, sf):
    return _config_usage(spark, sf)


@query
def config_bundle(spark, sf):
    """The configuration entries in use, bundled into one row."""
    used = _config_usage(spark, sf).where(F.col("n_urls") > 0)

    def entries(kind: str) -> Column:
        found = F.collect_list(F.when(F.col("kind") == kind, F.concat_ws(
            "=", "key", F.col("score").cast("string"))))
        return F.array_join(F.array_sort(found), ",")

    return used.agg(entries("brand").alias("brands"), entries("keyword").alias("keywords"),
                    entries("tld").alias("tlds"), entries("shortener").alias("shorteners"),
                    entries("geo_risk").alias("geo_risks"), entries("hosting").alias("hostings"))


@query
def seed_merge(spark, sf):
    hosts = U.with_lookup_host(urls(spark, sf))
    existing = hosts.select(U.root_domain(F.col("host")).alias("domain")).distinct()
    return config.merge_seed(existing, config.seed_tables(spark)["whitelist"], "domain").select("domain")


# -- URL projections --------------------------------------------------------------------------------


@query
def url_hash(spark, sf):
    return urls(spark, sf).select("url_id", U.url_hash(F.col("url")).alias("url_hash"))


@query
def lookup_host(spark, sf):
    return U.with_lookup_host(urls(spark, sf)).select("url_id", "host")


@query
def url_parts(spark, sf):
    return parts(spark, sf).select(
        "url_id", "parsed", "scheme", "hostname", "path", "query", "has_userinfo", "port")


@query
def host_tokens(spark, sf):
    tokens = F.explode_outer("tokens").alias("token")
    return parts(spark, sf).select("url_id", "clean_host", tokens)


@query
def url_tld(spark, sf):
    return parts(spark, sf).select("url_id", U.top_level_domain(F.col("hostname")).alias("tld"))


@query
def root_domain(spark, sf):
    hosts = U.with_lookup_host(urls(spark, sf))
    return hosts.select("url_id", U.root_domain(F.col("host")).alias("root"))


@query
def host_entropy(spark, sf):
    return parts(spark, sf).select(
        "url_id", F.round(U.entropy(F.col("clean_host")), 9).alias("entropy"))


@query
def ip_host(spark, sf):
    return parts(spark, sf).select("url_id", U.is_ipv4_shaped(F.col("hostname")).alias("is_ip"))


@query
def encoded_payload(spark, sf):
    return parts(spark, sf).select("url_id", U.is_encoded_payload(F.col("path")).alias("encoded"))


@query
def hex_payload(spark, sf):
    return parts(spark, sf).select("url_id", U.is_hex_payload(F.col("path")).alias("hex"))


@query
def fetch_target(spark, sf):
    return urls(spark, sf).select("url_id", U.fetch_target(F.col("url")).alias("target"))


@query
def whitelist_check(spark, sf):
    hosts = U.with_lookup_host(urls(spark, sf))
    listed = config.seed_tables(spark)["whitelist"]
    return with_whitelisted(hosts, listed, ["url_id"]).select("url_id", "whitelisted")


@query
def reject_empty(spark, sf):
    emptied = corpus.view(spark, sf, "raw_lines").select(F.col("value").alias("url"))
    return C.reject_empty(emptied).groupBy("url").agg(F.count("*").alias("n_rejected"))


# -- dates, certificates, pages ----------------------------------------------------------------------


@query
def whois_age(spark, sf):
    whois = corpus.view(spark, sf, "whois_obs")
    return with_registration_age(whois, "created_raw", as_of()).select("host", "domain_age_days")


@query
def tls_facts(spark, sf):
    return corpus.view(spark, sf, "tls_obs").select("host", infra.tls_facts(as_of()).alias("t")).select(
        "host", "t.*")


@query
def page_title(spark, sf):
    return corpus.view(spark, sf, "http_obs").select(
        "page_id", P.page_title(F.col("html")).alias("title"))


@query
def page_forms(spark, sf):
    return corpus.view(spark, sf, "http_obs").select(
        "page_id", P.has_password_field(F.col("html")).alias("password_field"),
        P.has_card_field(F.col("html")).alias("card_field"))


# -- lexical rules ---------------------------------------------------------------------------------------

# Query names that are shorter than the rule's.
SHORT = {"suspicious_keyword_in": "keyword", "fake_parent_domain": "fake_parent", "query_parameter": "query",
         "url_shortener": "shortener", "registered_domain": "registered"}


def _rule_key(name: str) -> str:
    key = name.lower().replace(" ", "_")
    for long, short in SHORT.items():
        key = key.replace(long, short)
    return f"rule_{key}"


RULE_KEYS = {_rule_key(name): name for name in lexical.RULES}


def _rule(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = ruled(spark, sf, [name])
        return lexical.exploded(found, ["url_id"]).select("url_id", "desc", "score")

    return run


for _key, _rule_name in RULE_KEYS.items():
    QUERIES[_key] = _rule(_rule_name)


@query
def lexical_rules(spark, sf):
    return lexical.exploded(ruled(spark, sf), ["url_id"])


@query
def lexical_rules_sorted(spark, sf):
    found = lexical.with_sorted_rules(ruled(spark, sf))
    rows = found.select("url_id", F.posexplode_outer("rules").alias("pos", "r"))
    return rows.where(F.col("r").isNotNull()).select(
        "url_id", (F.col("pos") + 1).cast("int").alias("pos"), "r.name", "r.desc", "r.score")


@query
def severity_sums(spark, sf):
    found = ruled(spark, sf).select("url_id", S.severity_sums(F.col("rules")).alias("s"))
    return found.select("url_id", "s.*")


@query
def severity_counts(spark, sf):
    found = ruled(spark, sf).select("url_id", S.severity_counts(F.col("rules")).alias("s"))
    return found.select("url_id", "s.*")


@query
def severity(spark, sf):
    found = lexical.exploded(ruled(spark, sf), ["url_id"])
    return found.groupBy("name", S.severity(F.col("score")).alias("severity")).agg(
        F.count("*").alias("n"))


@query
def lexical_score(spark, sf):
    return lexical.with_lexical_score(ruled(spark, sf), domain_age(), trust()).select(
        "url_id", "lexical_score")


# -- threat table ----------------------------------------------------------------------------------------


def stored_threats(spark: SparkSession, sf: str) -> DataFrame:
    """The threat table after all of ``threat_raw`` arrived, spread over fifty days."""
    first = threats.first_per_key(threats.with_hash(corpus.view(spark, sf, "threat_raw")))
    stamp = F.timestamp_seconds(F.lit(corpus.AS_OF_SECONDS) - F.col("seq") % 50 * 86400)
    return first.withColumn("created_at", stamp).select(*threats.STORED)


def two_arrivals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    raw = corpus.view(spark, sf, "threat_raw")
    now = F.timestamp_seconds(as_of())
    earlier, later = raw.where(F.col("seq") % 4 == 0), raw.where(F.col("seq") % 4 > 0)
    nothing = threats.with_hash(earlier.limit(0))
    return threats.new_threats(nothing, earlier, now), later


@query
def threat_upsert(spark, sf):
    existing, arriving = two_arrivals(spark, sf)
    added = threats.new_threats(existing, arriving, F.timestamp_seconds(as_of()))
    return added.drop("created_at")


@query
def ingest_stats(spark, sf):
    return threats.ingest_stats(*two_arrivals(spark, sf))


@query
def blacklist_lookup(spark, sf):
    found = threats.blacklist_lookup(urls(spark, sf), stored_threats(spark, sf), ["url_id"])
    rows = found.select("url_id", F.posexplode_outer(
        F.arrays_zip("blacklists", "blacklist_signals")).alias("pos", "b")).where(F.col("b").isNotNull())
    return rows.select("url_id", (F.col("pos") + 1).cast("int").alias("pos"), "b.blacklists.*",
                       F.col("b.blacklist_signals").alias("signal"))


@query
def blacklist_exists(spark, sf):
    return threats.listed(urls(spark, sf), stored_threats(spark, sf)).select("url_id")


@query
def joined_rules(spark, sf):
    """The brand and keyword rules with their lists as tables."""
    rows = parts(spark, sf).select("url_id", "parsed", "path", "clean_host", "tokens")
    found = joined.with_rules(rows, config.seed_tables(spark), CONFIG, ["url_id"], names=joined.RULES)
    return lexical.exploded(found, ["url_id"])


# -- infrastructure ----------------------------------------------------------------------------------------


def observations(spark: SparkSession, sf: str) -> infra.Observations:
    def texts(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.array(name)).alias(name)

    dns = corpus.view(spark, sf, "dns_all").select("host", "ip", "resolve_ms", texts("mx"), texts("ns"))
    return infra.Observations(
        dns, corpus.view(spark, sf, "tls_obs"), corpus.view(spark, sf, "whois_obs"),
        corpus.view(spark, sf, "http_obs"), corpus.view(spark, sf, "asn_ranges"),
        corpus.view(spark, sf, "country_ranges"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return infra.host_facts(observations(spark, sf), CONFIG, as_of())


def _infra_hits(spark, sf, names: list[str]) -> DataFrame:
    found = lexical.exploded(facts(spark, sf), ["host"], "host_rules")
    return found.where(F.col("name").isin(names)).select("host", "name", "desc", "score")


@query
def trusted_isp(spark, sf):
    known = facts(spark, sf).where(F.col("online"))
    return known.select("host", "isp", S.trusted_isp(F.col("isp")).alias("trusted"))


@query
def infra_slow_dns(spark, sf):
    return _infra_hits(spark, sf, ["Slow DNS"])


@query
def infra_geo_risk(spark, sf):
    return _infra_hits(spark, sf, ["Risky Country"])


@query
def infra_hosting(spark, sf):
    return _infra_hits(spark, sf, ["Bulletproof Hosting", "Cloud Hosting"])


@query
def joined_hosting(spark, sf):
    """The hosting rules with the patterns as a table."""
    known = facts(spark, sf).select("host", "isp").where("isp IS NOT NULL")
    first = joined.first_hosting(known, config.seed_tables(spark)["hosting"])
    found = known.join(first, "isp").select("host", infra.hosting_rule(F.col("match"), F.col("isp")).alias("r"))
    return found.select("host", "r.name", "r.desc", "r.score")


@query
def infra_tls(spark, sf):
    return _infra_hits(spark, sf, [
        "No HTTPS", "Invalid SSL", "New SSL", "Fresh SSL", "Free SSL on New Site"])


@query
def infra_mx(spark, sf):
    return _infra_hits(spark, sf, ["No MX Records"])


@query
def infra_http(spark, sf):
    pages = infra.http_facts(corpus.view(spark, sf, "http_obs"))
    found = pages.withColumn("rules", infra.http_rules(F.col("http")))
    return lexical.exploded(found, ["url_hash"]).select("url_hash", "name", "desc", "score")


@query
def geo_lookup(spark, sf):
    dns = corpus.view(spark, sf, "dns_obs").select("host", "ip")
    return geo.geo_lookup(dns, corpus.view(spark, sf, "asn_ranges"),
                          corpus.view(spark, sf, "country_ranges"), ["host"])


@query
def geo_networks(spark, sf):
    """IPv6 and IPv4 addresses in nested networks given by prefix."""
    dns = corpus.view(spark, sf, "dns_v6").select("host", "ip")
    return geo.geo_lookup(dns, corpus.view(spark, sf, "asn_networks"), None, ["host"])


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.view(spark, sf, "check_targets")


def observed_targets(spark: SparkSession, sf: str) -> DataFrame:
    return C.observed(U.with_lookup_host(targets(spark, sf)), stored_threats(spark, sf), CONFIG,
                      observations(spark, sf), as_of(), ["url_id"])


@query
def observe_join(spark, sf):
    c = F.col
    return observed_targets(spark, sf).select(
        "url_id", "host", F.coalesce("online", F.lit(False)).alias("online"), "ip",
        c("tls").isNotNull().alias("has_tls"), c("whois.created_date").alias("created_raw"),
        c("http.n_redirects").alias("n_redirects"))


@query
def effective_age(spark, sf):
    online = F.coalesce("online", F.lit(False))
    return observed_targets(spark, sf).select("url_id", infra.effective_age(
        F.col("whois"), online, F.col("tls")).alias("age"))


@query
def infra_score(spark, sf):
    return C.with_scores(observed_targets(spark, sf), CONFIG).select(
        "url_id", "infra_raw", "infra_score")


# -- the check -----------------------------------------------------------------------------------------------


def reports(spark: SparkSession, sf: str, rows: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    loaded = config.load_config(config.seed_tables(spark))
    return C.check(targets(spark, sf) if rows is None else rows, stored_threats(spark, sf),
                   config.WHITELIST, loaded, observations(spark, sf), as_of(), distinct=distinct)


def scalars(report: DataFrame, key: str) -> DataFrame:
    counts = [F.coalesce(F.col(f"summary.{s}"), F.lit(0)).alias(f"n_{s}") for s in S.SEVERITIES]
    listings = F.when(F.col("blacklists").isNull(), 0).otherwise(F.size("blacklists"))
    return report.select(key, "target", "verdict", "risk_score", "reason", *counts,
                         listings.alias("n_lists"))


@query
def risk_score(spark, sf):
    return reports(spark, sf).select("url_id", "risk_score")


@query
def verdict(spark, sf):
    return reports(spark, sf).select("url_id", "verdict", "reason")


@query
def signals(spark, sf):
    rows = settled(reports(spark, sf).select("url_id", "signals"), "signals").select(
        "url_id", F.posexplode_outer("signals").alias("pos", "signal"))
    return rows.where(F.col("signal").isNotNull()).select(
        "url_id", (F.col("pos") + 1).cast("int").alias("pos"), "signal")


@query
def check_report(spark, sf):
    return scalars(reports(spark, sf), "url_id")


@query
def report_json(spark, sf):
    return C.report_json(reports(spark, sf))


# -- request windows and streams --------------------------------------------------------------------------------


@query
def report_reuse(spark, sf):
    requests = corpus.view(spark, sf, "check_requests")
    return anchored.report_reuse(requests, seconds=6 * 3600).select(
        "event_id", "url", "computed_at", "reused")


@query
def client_quota(spark, sf):
    requests = corpus.view(spark, sf, "check_requests")
    return anchored.client_quota(requests, limit=3, seconds=6 * 3600).select(
        "event_id", "client", "window_start", "accepted")


def landed(spark: SparkSession, frame: DataFrame, part: Column, kind: str, run: Callable[[str, bool], None]) -> None:
    """Land the rows in three parts, 0 to 2, and after each have ``run`` take up what has landed; every
    run starts anew from its checkpoint. ``run`` gets the folder and whether it is the last part."""
    folder = shared_folder(spark, "landed")
    rows = frame.withColumn("_part", F.coalesce(part, F.lit(0)))
    for number in range(3):
        rows.where(F.col("_part") == number).drop("_part").write.mode("append").format(kind).save(folder)
        run(folder, number == 2)


def in_thirds(frame: DataFrame, time: Column) -> Column:
    """0 to 2 by time, in equal spans."""
    low, high = frame.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    if low is None:
        return F.lit(0)
    return F.least(F.floor((F.unix_micros(time) - low) * 3 / max(high - low, 1)).cast("int"), F.lit(2))


def stored_raw(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The raw rows of each feed with their ``_part``, 0 to 2. Each view is made once and stored by part."""
    part = F.coalesce(F.pmod(F.xxhash64("value"), F.lit(3)), F.lit(0)).cast("int").alias("_part")
    stored = {}
    for name in feeds.NORMALISERS:
        view = RAW_VIEWS.get(name, "raw_lines")
        if view not in stored:
            folder = shared_folder(spark, view)
            raw_view(spark, sf, name).select("value", part).write.partitionBy("_part").parquet(folder)
            stored[view] = spark.read.schema("value string, _part int").parquet(folder)
    return {name: stored[RAW_VIEWS.get(name, "raw_lines")] for name in feeds.NORMALISERS}


@query
def stream_ingest(spark, sf):
    """All eight feeds landed as files in three parts and taken up as one stream."""
    store, checkpoint = shared_folder(spark, "threats"), shared_folder(spark, "ingest")
    folders = {name: shared_folder(spark, f"feed-{name}") for name in feeds.NORMALISERS}
    raw = stored_raw(spark, sf)
    for number in range(3):
        for name, folder in folders.items():
            raw[name].where(F.col("_part") == number).select("value").write.mode("append").text(folder)
        arriving = feeds.union_feeds([feeds.read_raw(spark, name, folder, stream=True, wholetext=False)
                                      for name, folder in folders.items()])
        jobs.ingest(arriving, F.timestamp_seconds(as_of()), store, checkpoint, digits=1, compact_every=2)
    return jobs.threat_store(spark, store, digits=1).read().select("url", "url_hash", "source", "threat_type")


@query
def stream_first_seen(spark, sf):
    """Which (url, client) pairs occur in the event stream, each kept once."""
    requests = corpus.view(spark, sf, "check_requests")
    arriving = requests.select("url", F.col("client").alias("source"), F.lit("").alias("external_id"),
                               F.lit("").alias("threat_type"), "ts")
    store, checkpoint = shared_folder(spark, "threats"), shared_folder(spark, "ingest")

    def run(folder: str, last: bool) -> None:
        stream = spark.readStream.schema(arriving.schema).parquet(folder).withColumnRenamed("ts", "seq")
        jobs.ingest(stream, F.timestamp_seconds(as_of()), store, checkpoint, digits=1)

    landed(spark, arriving, in_thirds(arriving, F.col("ts")), "parquet", run)
    return jobs.threat_store(spark, store, digits=1).read().select("url", "source")


@query
def stream_check(spark, sf):
    """The event stream as check requests; reports as the batch check gives them."""
    events = corpus.view(spark, sf, "check_requests", events=jobs.stream_table(spark, sf, "events"))
    table = jobs.run_check(events, lambda rows: reports(spark, sf, rows, distinct=True))
    return scalars(jobs.read_table(spark, table), "event_id")


@query
def stream_reuse(spark, sf):
    """The event stream with report reuse. A third of the events arrives one hour late, a third two; the
    rows wait until the clock has passed them."""
    requests = corpus.view(spark, sf, "check_requests")
    table, checkpoint = shared_folder(spark, "windows"), shared_folder(spark, "window-run")

    def run(folder: str, last: bool) -> None:
        stream = spark.readStream.schema(requests.schema).parquet(folder)
        jobs.run_windows(stream, "url", "ts", "event_id", 6 * 3600, delay_seconds=3 * 3600,
                         table=table, checkpoint=checkpoint, ended=last)

    arrival = F.timestamp_micros(F.unix_micros("ts") + F.pmod("event_id", F.lit(3)) * 3_600_000_000)
    landed(spark, requests, in_thirds(requests, arrival), "parquet", run)
    return jobs.read_table(spark, table).select(
        "event_id", "url", F.col("window_start").alias("computed_at"),
        (~F.col("opens")).alias("reused"))


@query
def report_store(spark, sf):
    """The event stream answered from stored reports for six hours; allow-listed URLs are never stored."""
    requests = corpus.view(spark, sf, "store_requests")
    table, checkpoint = shared_folder(spark, "answers"), shared_folder(spark, "answering")

    def make(rows: DataFrame) -> DataFrame:
        return C.report_json(reports(spark, sf, rows))

    def allow(rows: DataFrame) -> DataFrame:
        return with_whitelisted(U.with_lookup_host(rows), config.WHITELIST, ["event_id"])

    def run(folder: str, last: bool) -> None:
        stream = spark.readStream.schema(requests.schema).parquet(folder)
        jobs.run_reports(stream, make, allow, 6 * 3600, table=table, checkpoint=checkpoint, digits=1, compact_every=2)

    landed(spark, requests, in_thirds(requests, F.col("ts")), "parquet", run)
    answered = jobs.read_table(spark, table)
    return answered.select(
        "event_id", "computed_at", "reused", F.get_json_object("report", "$.target").alias("target"),
        F.get_json_object("report", "$.verdict").alias("verdict"),
        F.get_json_object("report", "$.risk_score").cast("int").alias("risk_score"),
        F.get_json_object("report", "$.reason").alias("reason"))
