"""The 27 lexical rules, evaluated per row without any shuffle.

Every rule yields an array of rule structs, so that a URL's findings are one array built in one pass.
The struct's leading fields are the sort order of a report (highest score first, then rule order, then
description), which lets a plain ``array_sort`` order the findings.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import score as S
from lurewatch.functions import url as U
from lurewatch.functions.barrier import settled
from lurewatch.sources.config import RuleConfig

RULE_TYPE = "struct<rank:int,ord:int,desc:string,name:string,score:int>"

# --- Fixed values: rule names in emission order, with the score of the unconditional ones ---------

RULES = [
    "Insecure Protocol",
    "Unicode Spoof",
    "Suspicious Keyword in Domain",
    "Suspicious Keyword in Path",
    "Typosquatting",
    "Brand Injection",
    "Fake Parent Domain",
    "Punycode",
    "High Entropy Domain",
    "High Entropy Token",
    "Long Domain",
    "Oversized Token",
    "Excessive Hyphens",
    "Deep Subdomain",
    "IP Hostname",
    "Suspicious TLD",
    "Userinfo Abuse",
    "Suspicious Port",
    "Encoded Payload",
    "Hex Payload",
    "Open Redirect",
    "Sensitive Query Parameter",
    "Obfuscated URL",
    "URL Shortener",
    "IPFS Hosting",
    "Cloud Worker",
    "Newly Registered Domain",
]
PATH_KEYWORD_CAP = 15
DOMAIN_ENTROPY, TOKEN_ENTROPY = 4.2, 3.8
LOOKALIKE_MIN_BYTES, LOOSE_BRAND_BYTES = 4, 6

# -----------------------------------------------------------------------------------------------

ORDER = {name: i for i, name in enumerate(RULES, 1)}


def make_rule(name: str, desc: Column, points: Column, order: int | None = None) -> Column:
    return F.struct(
        (-points).cast("int").alias("rank"),
        F.lit(ORDER[name] if order is None else order).alias("ord"),
        desc.alias("desc"),
        F.lit(name).alias("name"),
        points.cast("int").alias("score"),
    )


def sql_text(value: str | int) -> str:
    """A Python value as an SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}L" if abs(value) > 1 << 31 else str(value)


def literal_structs(names: list[str], rows: list[tuple]) -> str:
    """SQL for an array of structs. Configuration goes into a plan as one parsed text: building it from
    thousands of single literals would take seconds per query."""
    return "array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {sql_text(v)}" for n, v in zip(names, row)) + ")"
        for row in rows) + ")"


def _strings(values: list[str]) -> Column:
    return F.expr(f"cast(array({', '.join(map(sql_text, values))}) as array<string>)")


def _scores(table: dict[str, int]) -> Column:
    pairs = ", ".join(f"{sql_text(k)}, {v}" for k, v in table.items())
    return F.expr(f"cast(map({pairs}) as map<string,int>)")


class LexicalRules:
    """Rule expressions over the columns of ``with_url_parts``; ``age`` is the domain age in days."""

    def __init__(self, config: RuleConfig, age: Column | None = None):
        self.config = config
        self.age = F.lit(0) if age is None else age
        c = F.col
        self.raw, self.scheme, self.host, self.path = c("raw"), c("scheme"), c("hostname"), c("path")
        self.query, self.port, self.user = c("query"), c("port"), c("has_userinfo")
        self.clean, self.tokens = c("clean_host"), c("tokens")
        host = self.host
        ip = U.is_ipv4_shaped(host)
        # name -> (condition, description, score)
        self.single: dict[str, tuple[Column, Column, Column]] = {
            name: (condition, desc if isinstance(desc, Column) else F.lit(desc),
                   points if isinstance(points, Column) else F.lit(points))
            for name, condition, desc, points in [
                ("Insecure Protocol", self.scheme != "https", "Non-HTTPS scheme", 10),
                ("Unicode Spoof", host.rlike(U.NON_ASCII), "Domain contains confusable chars", 60),
                ("Punycode", host.contains("xn--"), "IDN detected", 50),
                ("High Entropy Domain", U.entropy_above(self.clean, DOMAIN_ENTROPY),
                 "Random chars", 10),
                ("Long Domain", F.octet_length(self.clean) > 50, "Length > 50", 10),
                ("Excessive Hyphens", self._count(self.clean, "-") >= 4, "4+ hyphens", 10),
                ("Deep Subdomain", (self._count(host, ".") >= 4) & ~ip, "4+ levels", 15),
                ("IP Hostname", ip, "Direct IP access", 40),
                ("Suspicious TLD", *self._lookup(
                    config.tlds, U.top_level_domain(host), lambda tld: F.concat(
                        F.lit("Risky TLD: ."), tld))),
                ("Userinfo Abuse", self.user, "URL contains userinfo", 50),
                ("Suspicious Port", ~self.port.isin("", "80", "443"),
                 F.concat(F.lit("Port: "), self.port), 25),
                ("Encoded Payload", U.is_encoded_payload(self.path), "Base64 path", 25),
                ("Hex Payload", U.is_hex_payload(self.path), "Hex path", 15),
                ("Open Redirect", self._query_has("redirect=", "next=", "url="),
                 "Redirect param", 25),
                ("Sensitive Query Parameter", self._query_has("token=", "session=", "aff_id="),
                 "Session/Token param", 15),
                ("Obfuscated URL", self.raw.contains("@") & ~self.user, "Contains @", 25),
                ("URL Shortener", *self._lookup(
                    config.shorteners, self.clean, lambda _: F.lit("Short URL"))),
                ("IPFS Hosting", self.raw.contains("ipfs://") | host.contains("ipfs"),
                 "Decentralized storage", 35),
                ("Cloud Worker", host.endswith(".workers.dev") | host.endswith(".pages.dev"),
                 "Cloud worker", 25),
                ("Newly Registered Domain", self.age.between(1, S.NEW_DOMAIN_DAYS),
                 "Domain < 2 weeks old", 40),
            ]
        }
        self.many: dict[str, Callable[[], Column]] = {
            "Suspicious Keyword in Domain": self._domain_keywords,
            "Suspicious Keyword in Path": self._path_keywords,
            "Typosquatting": self._typosquatting,
            "Brand Injection": self._brand_injection,
            "Fake Parent Domain": self._fake_parent,
            "High Entropy Token": self._entropic_tokens,
            "Oversized Token": self._oversized_tokens,
        }

    def rules(self, names: list[str] | None = None) -> Column:
        """Array of the findings of the named rules (all by default), in no particular order;
        empty where the URL could not be parsed."""
        names = RULES if names is None else names
        fixed = [
            F.when(condition, make_rule(name, desc, points))
            for name in names if name in self.single
            for condition, desc, points in [self.single[name]]
        ]
        arrays = [self.many[name]() for name in names if name in self.many]
        if fixed:
            arrays.insert(0, F.array_compact(F.array(*fixed)))
        findings = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
        return F.when(F.col("parsed"), findings).otherwise(empty_rules())

    # -- helpers --------------------------------------------------------------------------------

    @staticmethod
    def _count(text: Column, char: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))

    @staticmethod
    def _lookup(table: dict[str, int], key: Column, desc) -> tuple[Column, Column, Column]:
        hit = key.isin(list(table)) if table else F.lit(False)
        return hit, desc(key), F.try_element_at(_scores(table), key)

    def _query_has(self, *names: str) -> Column:
        present = self.query.contains(names[0])
        for name in names[1:]:
            present = present | self.query.contains(name)
        return present

    def _domain_keywords(self) -> Column:
        words = list(self.config.keywords)
        if not words:
            return empty_rules()
        found = F.filter(self.tokens, lambda token: token.isin(words))
        return F.transform(found, lambda token: make_rule(
            "Suspicious Keyword in Domain", F.concat(F.lit("Keyword '"), token, F.lit("'")),
            F.element_at(_scores(self.config.keywords), token)))

    def _path_keywords(self) -> Column:
        words = list(self.config.keywords)
        if not words:
            return empty_rules()
        path = F.lower(self.path)
        found = F.filter(_strings(words), lambda word: path.contains(word))
        hits = F.transform(found, lambda word: make_rule(
            "Suspicious Keyword in Path", F.concat(F.lit("Keyword '"), word, F.lit("'")),
            F.least(F.element_at(_scores(self.config.keywords), word), F.lit(PATH_KEYWORD_CAP))))
        return F.when(path.rlike(any_of(words)), hits).otherwise(empty_rules())

    def _typosquatting(self) -> Column:
        """Tokens within one edit of a brand, or two edits of a brand of six bytes and more.

        Two exact bounds keep the edit distance off most pairs: an edit changes the length by at most
        one, so a token meets only the brands of similar length; and an edit changes the set of
        characters by at most two, so the letter sets must nearly agree."""
        by_length: dict[int, list[tuple]] = {}
        for brand in self.config.brands:
            reach = 2 if len(brand.encode()) >= LOOSE_BRAND_BYTES else 1
            for size in range(len(brand) - reach, len(brand) + reach + 1):
                by_length.setdefault(size, []).append((brand, str(letter_set(brand)), reach))
        if not by_length:
            return empty_rules()
        arrays = [f"{size}, {literal_structs(['name', 'letters', 'reach'], brands)}"
                  for size, brands in by_length.items()]
        shape = "map<int,array<struct<name:string,letters:bigint,reach:int>>>"
        candidates = F.expr(f"cast(map({', '.join(arrays)}) as {shape})")

        def matches(token: Column) -> Column:
            brands = F.filter(
                F.try_element_at(candidates, F.length(token["text"])),
                lambda brand: (F.bit_count(brand["letters"].bitwiseXOR(token["letters"]))
                               <= brand["reach"] * 2)
                & (token["text"] != brand["name"])
                & (F.levenshtein(token["text"], brand["name"], 2).between(1, brand["reach"])))
            return F.transform(brands, lambda brand: make_rule(
                "Typosquatting",
                F.concat(F.lit("Token '"), token["text"], F.lit("' ~ '"), brand["name"], F.lit("'")),
                F.lit(55)))

        eligible = F.filter(self.tokens, lambda token: (
            F.octet_length(token) >= LOOKALIKE_MIN_BYTES) & F.length(token).isin(list(by_length)))
        described = F.transform(eligible, lambda token: F.struct(
            token.alias("text"), letters_of(token).alias("letters")))
        return F.flatten(F.transform(described, matches))

    def _brand_injection(self) -> Column:
        hits = F.filter(self._brand_forms(), lambda brand: (
            self.clean.contains(brand["before"]) | self.clean.contains(brand["after"])))
        rules = F.transform(hits, lambda brand: make_rule(
            "Brand Injection", F.concat(F.lit("Brand '"), brand["name"], F.lit("' injected")),
            F.lit(40)))
        brands = any_of(self.config.brands)
        return F.when(self.clean.contains("-") & self.clean.rlike(f"{brands}-|-{brands}"),
                      rules).otherwise(empty_rules())

    def _fake_parent(self) -> Column:
        def used(brand: Column) -> Column:
            rest = F.substr(self.clean, F.length(brand["parent"]) + 1)
            own_site = self.clean.startswith(brand["parent"]) & ~rest.contains(".")
            return self.clean.contains(brand["parent"]) & ~own_site

        rules = F.transform(F.filter(self._brand_forms(), used), lambda brand: make_rule(
            "Fake Parent Domain", F.concat(F.lit("Subdomain uses '"), brand["name"], F.lit("'")),
            F.lit(65)))
        return F.when(self.clean.rlike(any_of(self.config.brands) + r"\."),
                      rules).otherwise(empty_rules())

    def _brand_forms(self) -> Column:
        """Each brand with the texts that betray it next to a hyphen or as a parent label."""
        if not self.config.brands:
            return F.expr(
                "cast(array() as array<struct<name:string,before:string,after:string,parent:string>>)")
        return F.expr(literal_structs(
            ["name", "before", "after", "parent"],
            [(b, f"{b}-", f"-{b}", f"{b}.") for b in self.config.brands]))

    def _entropic_tokens(self) -> Column:
        found = F.filter(self.tokens, lambda token: (F.octet_length(token) > 5)
                         & U.entropy_above(token, TOKEN_ENTROPY))
        return F.transform(found, lambda token: make_rule(
            "High Entropy Token", F.concat(F.lit("Token '"), token, F.lit("' looks random")),
            F.lit(15)))

    def _oversized_tokens(self) -> Column:
        found = F.filter(self.tokens, lambda token: F.octet_length(token) > 25)
        return F.transform(found, lambda _: make_rule(
            "Oversized Token", F.lit("Token > 25 chars"), F.lit(15)))


def any_of(words: list[str]) -> str:
    """A pattern matching any of the words, sharing their prefixes so that a text without any of them
    is rejected quickly. Used to decide whether the per-word checks are needed at all."""
    if not words:
        return "(?!)"
    branches: dict[str, list[str]] = {}
    for word in words:
        branches.setdefault(word[:1], []).append(word[1:])
    ends_here = branches.pop("", None) is not None
    if not branches:
        return ""
    longer = "(?:" + "|".join(
        re.escape(char) + any_of(rest) for char, rest in branches.items()) + ")"
    return longer + "?" if ends_here else longer


def letter_set(text: str) -> int:
    """The characters of a text as bits of a signed 64-bit number."""
    bits = 0
    for char in text:
        bits |= 1 << (ord(char) % 64)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def letters_of(text: Column) -> Column:
    """``letter_set`` of a column."""
    return F.aggregate(
        F.split(text, ""), F.lit(0).cast("bigint"),
        lambda bits, char: bits.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(char) % 64)))


def empty_rules() -> Column:
    return F.array().cast(f"array<{RULE_TYPE}>")


def with_rules(
    df: DataFrame, config: RuleConfig, age: Column | None = None,
    names: list[str] | None = None, into: str = "rules",
) -> DataFrame:
    """Add the array of findings to a frame that has URL parts."""
    return df.withColumn(into, LexicalRules(config, age).rules(names))


def with_sorted_rules(df: DataFrame, rules: str = "rules") -> DataFrame:
    return df.withColumn(rules, F.array_sort(rules))


def public_rules(rules: Column) -> Column:
    """The reported form of a rule array: name, description, score."""
    return F.transform(rules, lambda r: F.struct(
        r["name"].alias("name"), r["desc"].alias("desc"), r["score"].alias("score")))


def exploded(df: DataFrame, keys: list[str], rules: str = "rules") -> DataFrame:
    """One row per finding. The outer form is used because for the inner one the optimizer adds a
    filter on the array's size, which would evaluate all rules a second time."""
    rows = df.select(*keys, F.explode_outer(rules).alias("_r")).where(F.col("_r").isNotNull())
    return rows.select(
        *keys, F.col("_r.ord").alias("ord"), F.col("_r.name").alias("name"),
        F.col("_r.desc").alias("desc"), F.col("_r.score").alias("score"))


def with_lexical_score(
    df: DataFrame, age: Column, trusted: Column, rules: str = "rules", into: str = "lexical_score",
) -> DataFrame:
    """Add the 0..100 score of a rule array, given domain age and network trust."""
    kept = df.columns
    df = df.withColumns({"_sums": S.severity_sums(F.col(rules)), "_age": age, "_trusted": trusted})
    sums = S.discounted({name: F.col("_sums")[name] for name in S.SEVERITIES},
                        F.col("_age"), F.col("_trusted"))
    df = df.withColumns({f"_{name}": value for name, value in sums.items()})

    def present(name: str) -> Column:
        return F.exists(rules, lambda rule: rule["name"] == name)

    total = S.lexical_score(
        {name: F.col(f"_{name}") for name in S.SEVERITIES}, F.col("_age"),
        present("Typosquatting") & present("Punycode"))
    return settled(df.select(*[c for c in kept if c != into], total.alias(into)), into)
