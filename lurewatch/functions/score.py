"""Severity, verdict and score arithmetic.

All scaling is done in DOUBLE and cut toward zero, step by step, so that scores are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch.sources.config import TRUSTED_ISPS

# --- Fixed values: thresholds and weights -------------------------------------------------------

SEVERITY_FLOORS = [("critical", 40), ("high", 25), ("medium", 15)]
SEVERITIES = ["critical", "high", "medium", "low"]
WEIGHTS = {"critical": 1.5, "high": 1.0, "medium": 0.8, "low": 0.5}
OLD_DOMAIN_DAYS = 365
NEW_DOMAIN_DAYS = 14
TRUSTED_DISCOUNT = 10
SAFE_BELOW, DANGEROUS_FROM = 20, 60

# -----------------------------------------------------------------------------------------------


def severity(score: Column) -> Column:
    bucket = F
    for name, floor in SEVERITY_FLOORS:
        bucket = bucket.when(score >= floor, name)
    return bucket.otherwise("low")


def severity_sums(rules: Column) -> Column:
    """Score totals per severity as one struct, from an array of rules."""
    zero = F.struct(*[F.lit(0).alias(name) for name in SEVERITIES])

    def add(total: Column, rule: Column) -> Column:
        bucket = severity(rule["score"])
        return F.struct(*[
            (total[name] + F.when(bucket == name, rule["score"]).otherwise(0)).alias(name)
            for name in SEVERITIES
        ])

    return F.aggregate(rules, zero, add)


def severity_counts(rules: Column) -> Column:
    """Rule counts per severity as one struct; NULL when there is no rule."""

    def count(name: str) -> Column:
        return F.size(F.filter(rules, lambda rule: severity(rule["score"]) == name)).alias(name)

    return F.when(F.size(rules) > 0, F.struct(*[count(name) for name in SEVERITIES]))


def _cut(value: Column) -> Column:
    return value.cast("double").cast("int")


def _scaled(value: Column, factor: float) -> Column:
    return _cut(value.cast("double") * F.lit(factor))


def trusted_isp(isp: Column) -> Column:
    return F.coalesce(F.lower(isp).rlike("|".join(TRUSTED_ISPS)), F.lit(False))


def discounted(sums: dict[str, Column], age: Column, trusted: Column) -> dict[str, Column]:
    """Severity sums after the reductions for trusted networks and old domains."""
    old = age > OLD_DOMAIN_DAYS
    high = sums["high"]
    return {
        "critical": sums["critical"],
        "high": F.when(trusted, F.greatest(high - TRUSTED_DISCOUNT, F.lit(0))).otherwise(high),
        "medium": F.when(old, _scaled(sums["medium"], 0.6)).otherwise(sums["medium"]),
        "low": F.when(old, _scaled(sums["low"], 0.5)).otherwise(sums["low"]),
    }


def lexical_score(sums: dict[str, Column], age: Column, lookalike_idn: Column) -> Column:
    """0..100 from discounted sums; ``lookalike_idn`` marks look-alike tokens in punycode hosts."""
    factor = (
        F.lit(1.0)
        + F.when(sums["critical"] >= 50, 0.20).otherwise(0.0)
        + F.when(sums["critical"] >= 100, 0.30).otherwise(0.0)
        + F.when(lookalike_idn, 0.25).otherwise(0.0)
    )
    total = sum(
        (sums[name].cast("double") * WEIGHTS[name] for name in SEVERITIES[1:]),
        sums["critical"].cast("double") * WEIGHTS["critical"],
    )
    score = _cut(total * factor)
    minor_only = (sums["critical"] == 0) & (sums["high"] == 0)
    score = F.when((age > OLD_DOMAIN_DAYS) & minor_only, _scaled(score, 0.4)).otherwise(score)
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))


def infra_score(raw: Column, age: Column, trusted: Column) -> Column:
    halved = F.when(age > OLD_DOMAIN_DAYS, _scaled(raw, 0.5)).otherwise(raw)
    reduced = F.when(trusted, halved - TRUSTED_DISCOUNT).otherwise(halved)
    return F.greatest(reduced, F.lit(0))


def total_score(blacklisted: Column, infra: Column, lexical: Column) -> Column:
    both = F.when(infra < 100, infra + lexical).otherwise(infra)
    return F.when(blacklisted, 100).otherwise(F.least(both, F.lit(100)))


def verdict(score: Column) -> Column:
    return (
        F.when(score < SAFE_BELOW, "Safe")
        .when(score < DANGEROUS_FROM, "Suspicious")
        .otherwise("Dangerous")
    )


def effective_age(whois_days: Column, certificate_days: Column) -> Column:
    """Registration age; the certificate's age stands in only when it is unknown (exactly 0)."""
    known = F.coalesce(whois_days, F.lit(0))
    return F.when(known == 0, F.coalesce(certificate_days, F.lit(0))).otherwise(known)
