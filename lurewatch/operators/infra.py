"""Infrastructure facts and rules, from observation tables.

Observations (the first row per host counts, by ``seq`` where given; one row per URL for pages):

* ``dns``: host, ip, resolve_ms, mx ARRAY, ns ARRAY; no row or a NULL ip means the host is offline
* ``tls``: host, has_cert, issuer, not_before_s, not_after_s; no row means no TLS connection
* ``whois``: host, registrar, created_raw, expires_raw
* ``http``: url, html, n_redirects and optionally status_code, content_type, redirect_chain
* ``asn_ranges`` / ``country_ranges``: start_ip, end_ip and asn, org / country
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import page as P
from lurewatch.functions import score as S
from lurewatch.functions.dates import whole_days, with_registration_age
from lurewatch.functions.url import url_hash
from lurewatch.operators.geo import geo_lookup
from lurewatch.operators.lexical import RULE_TYPE, empty_rules, make_rule
from lurewatch.sources.config import RuleConfig

# --- Fixed values: rules in emission order, and which of them add to the score ------------------

INFRA_RULES = [
    "Slow DNS", "Risky Country", "Bulletproof Hosting", "Cloud Hosting", "No HTTPS", "Invalid SSL",
    "New SSL", "Fresh SSL", "Free SSL on New Site", "No MX Records", "Password Field Detected",
    "Credit Card Field", "Multiple Redirects",
]
SCORING = [
    "Risky Country", "Bulletproof Hosting", "No HTTPS", "Invalid SSL", "New SSL", "Fresh SSL",
    "Free SSL on New Site", "No MX Records",
]
HOSTING_RULES = {"bulletproof": "Bulletproof Hosting", "cloud": "Cloud Hosting"}
FREE_ISSUERS = ["Let's Encrypt", "ZeroSSL"]
SLOW_DNS_MS = 500
MAX_REDIRECTS = 2

# -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Observations:
    dns: DataFrame
    tls: DataFrame
    whois: DataFrame
    http: DataFrame | None = None
    asn_ranges: DataFrame | None = None
    country_ranges: DataFrame | None = None


def infra_rule(name: str, desc: Column | str, points: Column | int) -> Column:
    return make_rule(name, desc if isinstance(desc, Column) else F.lit(desc),
                     points if isinstance(points, Column) else F.lit(points),
                     INFRA_RULES.index(name) + 1)


def certificate_issuer(organizations: Column, common_name: Column) -> Column:
    """The issuer's first organization, or its common name when it states none."""
    return F.coalesce(F.get(organizations, F.lit(0)), common_name, F.lit(""))


def tls_facts(as_of: Column) -> Column:
    """Struct valid, issuer, age_days, expires_in, is_https from the columns of ``tls``."""
    c = F.col
    shown = F.coalesce(c("has_cert"), F.lit(False))

    def fact(value: Column, absent) -> Column:
        return F.when(shown, value).otherwise(F.lit(absent))

    return F.struct(
        F.coalesce(fact((as_of > c("not_before_s")) & (as_of < c("not_after_s")), False),
                   F.lit(False)).alias("valid"),
        F.coalesce(fact(c("issuer"), ""), F.lit("")).alias("issuer"),
        F.coalesce(fact(whole_days(as_of - c("not_before_s")), 0), F.lit(0)).alias("age_days"),
        F.coalesce(fact(whole_days(c("not_after_s") - as_of), 0), F.lit(0)).alias("expires_in"),
        F.lit(True).alias("is_https"),
    )


def tls_rules(tls: Column) -> Column:
    """Rules on the facts of a TLS connection; NULL facts mean that there is none."""
    age = tls["age_days"]
    free = tls["issuer"].contains(FREE_ISSUERS[0])
    for issuer in FREE_ISSUERS[1:]:
        free = free | tls["issuer"].contains(issuer)
    return F.array_compact(F.array(
        F.when(tls.isNull(), infra_rule("No HTTPS", "No secure connection", 5)),
        F.when(~tls["valid"], infra_rule("Invalid SSL", "Expired or invalid", 25)),
        F.when(age < 1, infra_rule("New SSL", "Created today (<24h)", 30))
        .when(age < 2, infra_rule("Fresh SSL", "Created recently", 10))
        .when(age < 7, infra_rule("Fresh SSL", "Created this week", 5)),
        F.when(free & (age < 14), infra_rule("Free SSL on New Site", "Short-lived free cert", 5)),
    ))


def hosting_match(config: RuleConfig, isp: Column) -> Column:
    """The first hosting pattern found in the owner's name, NULL when there is none."""
    known = [(pattern, points, kind) for pattern, points, kind in config.hosting
             if kind in HOSTING_RULES]
    if not known:
        return F.lit(None).cast("struct<pattern:string,score:int,title:string>")
    patterns = F.array(*[
        F.struct(F.lit(pattern.lower()).alias("pattern"), F.lit(points).alias("score"),
                 F.lit(HOSTING_RULES[kind]).alias("title")) for pattern, points, kind in known])
    name = F.lower(isp)
    first = F.get(F.filter(patterns, lambda p: name.contains(p["pattern"])), F.lit(0))
    return F.when(isp != "Unknown", first)


def hosting_rule(match: Column, isp: Column) -> Column:
    return F.when(match.isNotNull(), F.struct(
        (-match["score"]).alias("rank"),
        F.when(match["title"] == HOSTING_RULES["bulletproof"], 3).otherwise(4).alias("ord"),
        isp.alias("desc"), match["title"].alias("name"), match["score"].alias("score")))


def country_rule(config: RuleConfig, country: Column) -> Column:
    names = list(config.geo_risks)
    if not names:
        return F.lit(None).cast(RULE_TYPE)
    table = F.create_map(*[F.lit(x) for item in config.geo_risks.items() for x in item])
    return F.when(country.isin(names), infra_rule(
        "Risky Country", country, F.try_element_at(table, country)))


def slow_dns_rule(resolve_ms: Column) -> Column:
    return F.when(resolve_ms > SLOW_DNS_MS,
                  infra_rule("Slow DNS", "Resolve time > 500ms", 5))


def no_mx_rule(mx: Column) -> Column:
    return F.when(F.coalesce(F.size(mx), F.lit(0)) <= 0, infra_rule(
        "No MX Records", "Domain cannot receive emails", 5))


def http_rules(http: Column) -> Column:
    """Rules on page facts; none when the page is unknown (NULL)."""
    rules = F.array_compact(F.array(
        F.when(http["has_password_field"], infra_rule(
            "Password Field Detected", "Page contains a password input field", 10)),
        F.when(http["has_credit_card_field"], infra_rule(
            "Credit Card Field", "Page requests payment details", 20)),
        F.when(http["n_redirects"] > MAX_REDIRECTS, infra_rule(
            "Multiple Redirects", "Chain of redirects detected", 15)),
    ))
    return F.when(http.isNotNull(), rules).otherwise(empty_rules())


def http_facts(http: DataFrame) -> DataFrame:
    """One row per url_hash with the facts of its page, read from the first 200 KiB."""

    def given(name: str, kind: str, default) -> Column:
        value = F.col(name) if name in http.columns else F.lit(default)
        return value.cast(kind).alias(name)

    facts = F.struct(
        given("status_code", "int", 200), P.page_title(F.col("html")).alias("page_title"),
        given("content_type", "string", None),
        given("redirect_chain", "array<string>", None),
        P.has_password_field(F.col("html")).alias("has_password_field"),
        P.has_card_field(F.col("html")).alias("has_credit_card_field"),
        F.lit(False).alias("is_suspicious_js"),
        F.col("n_redirects").cast("int").alias("n_redirects"))
    pages = http.select(url_hash(F.col("url")).alias("url_hash"), facts.alias("http"))
    # A page seen twice counts once.
    return pages.groupBy("url_hash").agg(F.min("http").alias("http"))


def infra_sum(rules: Column) -> Column:
    """The score of an array of infrastructure rules; some rules are reported without scoring."""
    return F.aggregate(rules, F.lit(0), lambda total, rule: total + F.when(
        rule["name"].isin(SCORING), rule["score"]).otherwise(0))


def _one_per_host(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first observation of each host: by ``seq`` where the table has it, else the smallest."""
    order = ["seq"] if "seq" in df.columns else []
    first = F.min(F.struct(*order, *columns)).alias("_first")
    return df.groupBy("host").agg(first).select("host", *[F.col(f"_first.{c}").alias(c) for c in columns])


def host_facts(obs: Observations, config: RuleConfig, as_of: Column) -> DataFrame:
    """Everything known about each observed host, one row per host.

    Columns: host, online, ip, country, isp, asn, tls, mx, ns, host_rules, whois. Every input is
    reduced to one row per host, so the joins here have no skew; only addresses may repeat, and those
    are looked up once per distinct address."""
    online = _one_per_host(obs.dns.where(F.col("ip").isNotNull()), ["ip", "resolve_ms", "mx", "ns"])
    located = geo_lookup(online, obs.asn_ranges, obs.country_ranges, spread=["host"])
    tls = _one_per_host(obs.tls, ["has_cert", "issuer", "not_before_s", "not_after_s"])
    tls = tls.select("host", tls_facts(as_of).alias("tls"))
    whois = obs.whois
    if "expires_raw" not in whois.columns:
        whois = whois.withColumn("expires_raw", F.lit(None).cast("string"))
    whois = _one_per_host(whois, ["registrar", "created_raw", "expires_raw"])
    expires = F.col("expires_raw")
    whois = with_registration_age(whois, "created_raw", as_of).select("host", F.struct(
        "registrar", F.col("created_raw").alias("created_date"), expires.alias("expires_date"),
        "domain_age_days").alias("whois"))
    df = located.join(tls, "host", "left")
    df = df.withColumn("_hosting", hosting_match(config, F.col("isp")))
    df = df.withColumn("host_rules", F.concat(
        F.array_compact(F.array(
            slow_dns_rule(F.col("resolve_ms")), country_rule(config, F.col("country")),
            hosting_rule(F.col("_hosting"), F.col("isp")))),
        tls_rules(F.col("tls")),
        F.array_compact(F.array(no_mx_rule(F.col("mx")))))).drop("_hosting")
    df = df.withColumn("online", F.lit(True)).drop("resolve_ms")
    return df.join(whois, "host", "full")


def infrastructure(c=F.col) -> Column:
    """The reported infrastructure record from the columns of ``host_facts`` and ``http``."""
    online = F.coalesce(c("online"), F.lit(False))

    def text(value: Column) -> Column:
        return F.when(value != "", value)

    geo = F.struct(
        c("country").alias("country"), F.lit(None).cast("string").alias("city"),
        c("isp").alias("isp"), F.when(c("asn") != 0, c("asn")).alias("asn"),
        text(F.when(c("isp") != "Unknown", c("isp"))).alias("organization"))
    found = (F.size("mx") > 0) | (F.size("ns") > 0)
    dns = F.when(found, F.struct(
        F.when(F.size("mx") > 0, c("mx")).alias("mx_records"),
        F.when(F.size("ns") > 0, c("ns")).alias("ns_records")))
    http = F.when(c("http").isNotNull(), c("http").dropFields("n_redirects"))
    return F.struct(
        F.when(online, "Online").otherwise("Offline").alias("status"),
        c("ip").alias("ip"),
        F.when(online, geo).alias("geolocation"),
        F.when(online, c("tls")).alias("ssl"),
        F.when(online, dns).alias("dns"),
        F.when(online, http).alias("http_scan"))


def effective_age(whois: Column, online: Column, tls: Column) -> Column:
    return S.effective_age(whois["domain_age_days"], F.when(online, tls["age_days"]))
