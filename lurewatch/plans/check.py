"""The full check: URLs in, one report per row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import score as S
from lurewatch.functions.barrier import settled
from lurewatch.functions.url import with_lookup_host, with_url_parts
from lurewatch.operators import infra, lexical, threats
from lurewatch.operators.infra import Observations
from lurewatch.operators.joins import flag, lookup_join
from lurewatch.operators.whitelist import with_whitelisted
from lurewatch.sources.config import RuleConfig

REPORT = ["target", "verdict", "risk_score", "reason", "summary", "signals", "blacklists",
          "heuristics", "infrastructure", "whois"]


def reject_empty(urls: DataFrame) -> DataFrame:
    """Rows the check refuses: those without a URL."""
    return urls.where(F.coalesce(F.col("url"), F.lit("")) == "")


def _filled(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def url_facts(threat_table: DataFrame, http: DataFrame | None) -> DataFrame:
    """What is known per URL hash: listings and page facts."""
    listings = threats.by_hash(threat_table)
    if http is None:
        shape = "struct<status_code:int,page_title:string,content_type:string," \
                "redirect_chain:array<string>,has_password_field:boolean," \
                "has_credit_card_field:boolean,is_suspicious_js:boolean,n_redirects:int>"
        return listings.withColumn("http", F.lit(None).cast(shape))
    return listings.join(infra.http_facts(http), "url_hash", "full")


def observed(
    urls: DataFrame, threat_table: DataFrame, config: RuleConfig, obs: Observations,
    as_of: Column, spread: list[str], **options,
) -> DataFrame:
    """URL rows that have ``host``, joined with everything known about URL and host. Two lookups,
    first by URL hash, then by host; rows are narrow while they are moved."""
    rows = threats.with_hash(urls)
    if "whitelisted" in urls.columns:  # these look nothing up: rows without a key match nothing
        for name in ("url_hash", "host"):
            rows = rows.withColumn(name, F.when(~F.col("whitelisted"), F.col(name)))
    df = lookup_join(rows, url_facts(threat_table, obs.http), "url_hash", spread, **options)
    df = df.withColumn("host", F.when(F.col("host") != "", F.col("host")))
    return lookup_join(df, infra.host_facts(obs, config, as_of), "host", spread, **options)


def with_scores(df: DataFrame, config: RuleConfig) -> DataFrame:
    """Add rules, ages and scores to ``observed`` rows."""
    c = F.col
    online = flag(c("online"))
    df = df.withColumns({
        "online": online,
        "blacklisted": c("blacklists").isNotNull(),
        "age": infra.effective_age(c("whois"), online, c("tls")),
        "trusted": online & S.trusted_isp(c("isp")),
        "infra_rules": F.when(online, F.concat("host_rules", infra.http_rules(c("http"))))
        .otherwise(lexical.empty_rules()),
    })
    df = with_url_parts(df)
    df = lexical.with_rules(df, config, c("age"), into="rules")
    df = lexical.with_sorted_rules(df)
    df = lexical.with_lexical_score(df, c("age"), c("trusted"))
    df = df.withColumn("infra_raw", infra.infra_sum(c("infra_rules")))
    df = df.withColumn("infra_score", S.infra_score(c("infra_raw"), c("age"), c("trusted")))
    return df.withColumn("risk_score", S.total_score(
        c("blacklisted"), c("infra_score"), c("lexical_score")).cast("int"))


def _report(keys: list[str], df: DataFrame) -> DataFrame:
    c = F.col
    df = df.withColumn("_all", lexical.public_rules(F.concat("infra_rules", "rules")))
    whois = F.when(c("whois").isNotNull(), F.struct(*[
        F.when(c(f"whois.{name}") != "", c(f"whois.{name}")).alias(name)
        for name in ("registrar", "created_date", "expires_date")
    ], c("whois.domain_age_days").alias("domain_age_days")))
    signals = F.concat(
        F.coalesce("blacklist_signals", F.array().cast("array<string>")),
        F.transform("_all", lambda rule: rule["name"]))
    return df.select(
        *keys,
        c("url").alias("target"),
        F.when(c("blacklisted"), "Dangerous").otherwise(S.verdict(c("risk_score"))).alias("verdict"),
        "risk_score",
        F.when(c("blacklisted"), "Found in Blacklist")
        .when(F.size("rules") > 0, "Suspicious Activity Detected").alias("reason"),
        S.severity_counts(c("_all")).alias("summary"),
        _filled(signals).alias("signals"),
        "blacklists",
        _filled(c("_all")).alias("heuristics"),
        F.when(c("host").isNotNull(), infra.infrastructure()).alias("infrastructure"),
        whois.alias("whois"),
    )


def check(
    urls: DataFrame, threat_table: DataFrame, whitelist: DataFrame | list[str], config: RuleConfig,
    obs: Observations, as_of: Column, spread: list[str] | None = None, distinct: bool = False, **options,
) -> DataFrame:
    """One report per row of ``urls`` (rows without a URL are left out, see ``reject_empty``).

    Columns of ``urls`` other than ``url`` are kept. Allow-listed rows have no key in the lookups.
    ``as_of`` is the moment of the check in epoch seconds; ``spread`` names columns that tell rows of one
    URL apart. Where URLs repeat a lot, ``distinct`` makes each report once and joins it to the rows."""
    keys = [name for name in urls.columns if name != "url"]
    spread = spread or urls.columns
    if distinct:
        rows = urls.where(F.col("url") != "")
        once = check(rows.select("url").distinct(), threat_table, whitelist, config, obs, as_of, ["url"], **options)
        once = once.withColumn("url", F.col("target"))
        return lookup_join(rows, once, "url", spread, "inner").select(*keys, *REPORT)
    rows = with_lookup_host(urls.where(F.col("url") != ""))
    rows = settled(with_whitelisted(rows, whitelist, spread), "whitelisted")
    scored = with_scores(observed(rows, threat_table, config, obs, as_of, spread, **options), config)
    reports = _report([*keys, "whitelisted"], scored)
    safe = {"target": F.col("target"), "verdict": F.lit("Safe"), "risk_score": F.lit(0),
            "reason": F.lit("Whitelisted Domain")}
    return settled(reports.select(*keys, *[
        F.when(F.col("whitelisted"), safe.get(name, F.lit(None))).otherwise(F.col(name)).alias(name)
        for name in REPORT]), *REPORT)


def report_json(reports: DataFrame) -> DataFrame:
    """Reports as JSON texts in which absent parts are left out."""
    keys = [name for name in reports.columns if name not in REPORT]
    return reports.select(*keys, F.to_json(F.struct(*REPORT)).alias("report"))
