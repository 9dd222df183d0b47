"""Rule configuration: seed tables, seed merge, and the bounded in-plan form."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: the seed configuration every deployment starts from -------------------------

BRANDS = """
google gmail microsoft office365 outlook onedrive
apple icloud appleid adobe dropbox amazon netflix
facebook instagram whatsapp telegram twitter linkedin
tiktok snapchat discord zoom spotify twitch
ameli assurance-maladie caf impots gouv france-connect
cpf moncompteformation laposte chronopost sncf oui-sncf
pole-emploi france-travail credit-agricole creditagricole ca-paris
societe-generale societegenerale bnp bnpparibas banquepostale
labanquepostale lcl credit-lyonnais bpce caisse-epargne
banque-populaire boursorama boursobank fortuneo hellobank
axa groupama maif macif leboncoin vinted cdiscount
fnac darty orange sfr bouygues free free-mobile
paypal stripe visa mastercard binance coinbase ledger
trezor metamask blockchain kraken revolut n26 wise
dhl fedex ups colissimo dpd sberbank tinkoff alpha
""".split()

KEYWORDS = {
    "login": 20, "signin": 20, "secure": 20, "security": 20,
    "account": 15, "verify": 20, "verification": 20, "auth": 15,
    "password": 20, "update": 15, "confirm": 15, "recovery": 20,
    "unlock": 20, "suspended": 20, "blocked": 20, "safe": 20,
    "wallet": 25, "bank": 25, "payment": 25, "billing": 20,
    "refund": 20, "support": 10, "service": 10, "admin": 20,
    "bonus": 15, "giveaway": 25, "winner": 20, "airdrop": 25, "claim": 20,
    "connexion": 20, "connecter": 20, "securite": 20, "securise": 20,
    "compte": 15, "verifier": 20, "motdepasse": 20, "mdp": 20,
    "identifiant": 20, "mise-a-jour": 15, "maj": 15, "confirmer": 15,
    "validation": 20, "debloquer": 20, "acces": 15, "espace-client": 20,
    "mon-espace": 20, "banque": 25, "bancaire": 25, "paiement": 25,
    "virement": 25, "remboursement": 20, "facture": 20, "impaye": 20,
    "livraison": 20, "colis": 20, "suivi": 20, "expedition": 20,
    "gendarmerie": 25, "police": 25, "amende": 25, "convocation": 25,
    "urgent": 15, "alerte": 15, "service-client": 10,
}

TLDS = dict.fromkeys(
    """
    xyz top gq tk ml cf ga cn buzz click country icu rest review site work link live
    store shop club vip pro info mobi kim best cyou monster quest beauty mom zip mov cam bond
    """.split(),
    10,
)

SHORTENERS = dict.fromkeys(
    """
    bit.ly goo.gl t.co tinyurl.com is.gd ow.ly buff.ly rebrand.ly bl.ink cutt.ly shorte.st bit.do
    x.co lnkd.in db.tt qr.ae adf.ly bc.vc snip.ly po.st q.gs v.gd tr.im
    """.split(),
    25,
)

GEO_RISKS = {
    "Russia": 15, "China": 15, "North Korea": 50, "Iran": 30, "Cote D'Ivoire": 25, "Benin": 25,
    "Cameroon": 20, "Senegal": 15, "Mali": 15, "Nigeria": 20, "Turkey": 10, "Brazil": 10,
    "Vietnam": 10,
}

HOSTING = [
    ("FlokiNET", 40, "bulletproof"), ("Shinjiru", 40, "bulletproof"),
    ("AbeloHost", 40, "bulletproof"), ("Offshore", 40, "bulletproof"),
    ("AnonymousSpeech", 40, "bulletproof"), ("Njalla", 40, "bulletproof"),
    ("Privex", 40, "bulletproof"), ("OrangeWebsite", 40, "bulletproof"),
    ("PrivateLayer", 40, "bulletproof"), ("Virtual Systems", 40, "bulletproof"),
    ("DigitalOcean", 5, "cloud"), ("Hetzner", 5, "cloud"),
    ("OVH", 5, "cloud"), ("Namecheap", 5, "cloud"),
    ("Hostinger", 5, "cloud"), ("Choopa", 5, "cloud"),
    ("Vultr", 5, "cloud"), ("Google LLC", 5, "cloud"),
    ("Amazon.com", 5, "cloud"), ("Cloudflare", 0, "cloud"),
]

WHITELIST = """
google.com youtube.com facebook.com instagram.com twitter.com wikipedia.org whatsapp.com amazon.com
vk.com yandex.ru sberbank.ru mail.ru t.me github.com stackoverflow.com microsoft.com apple.com
netflix.com linkedin.com chatgpt.com openai.com
""".split()

TRUSTED_ISPS = ["google", "amazon", "cloudflare", "microsoft", "fastly", "akamai"]

# -----------------------------------------------------------------------------------------------

# A configuration table is a curated list that is read by the driver and becomes literals in the plan.
# There is no limit on its entries; the allow-list, which may be long, can also be joined.

SCHEMAS = {
    "brands": "id int, name string",
    "keywords": "id int, word string, score int",
    "tlds": "id int, tld string, score int",
    "shorteners": "id int, domain string, score int",
    "geo_risks": "id int, country string, score int",
    "hosting": "id int, pattern string, score int, type string",
    "whitelist": "id int, domain string",
}


# Entries of all tables together that may become part of a plan.
MOST_ENTRIES = 20_000


@dataclass(frozen=True)
class RuleConfig:
    """The six configuration tables as plain values, ready to be written into expressions."""

    brands: list[str] = field(default_factory=lambda: list(BRANDS))
    keywords: dict[str, int] = field(default_factory=lambda: dict(KEYWORDS))
    tlds: dict[str, int] = field(default_factory=lambda: dict(TLDS))
    shorteners: dict[str, int] = field(default_factory=lambda: dict(SHORTENERS))
    geo_risks: dict[str, int] = field(default_factory=lambda: dict(GEO_RISKS))
    hosting: list[tuple[str, int, str]] = field(default_factory=lambda: list(HOSTING))


def seed_rows() -> dict[str, list[tuple]]:
    """Seed rows per table, ids counting from 1 in file order."""
    scored = {"keywords": KEYWORDS, "tlds": TLDS, "shorteners": SHORTENERS, "geo_risks": GEO_RISKS}
    rows = {name: [(i, key, score) for i, (key, score) in enumerate(table.items(), 1)]
            for name, table in scored.items()}
    rows["brands"] = list(enumerate(BRANDS, 1))
    rows["whitelist"] = list(enumerate(WHITELIST, 1))
    rows["hosting"] = [(i, *row) for i, row in enumerate(HOSTING, 1)]
    return rows


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in seed_rows().items()}


def merge_seed(existing: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Seed rows whose key is not stored yet; append these to initialise or extend a table."""
    return seed.join(existing.select(key), key, "left_anti").select(seed.columns)


def load_config(tables: dict[str, DataFrame], most: int = MOST_ENTRIES) -> RuleConfig:
    """Load all six tables in one job. A missing table aborts the load as a whole; on a repeated key the
    entry with the highest id counts. The entries become part of every plan, so there may be ``most`` at
    most; longer lists belong into ``operators.joined``, which joins them."""
    keys = {"brands": "name", "keywords": "word", "tlds": "tld", "shorteners": "domain", "geo_risks": "country", "hosting": "pattern"}
    listed = None
    for name, key in keys.items():
        table, every = tables[name], name in ("brands", "hosting")  # lists in the order of their ids
        row = table.selectExpr(
            f"'{name}' AS kind", "CAST(id AS BIGINT) AS id", f"{key} AS key", "CAST(id AS BIGINT) AS own" if every else "NULL AS own",
            "CAST(NULL AS INT) AS score" if name == "brands" else "score", "type" if name == "hosting" else "CAST(NULL AS STRING) AS type")
        listed = row if listed is None else listed.unionByName(row)
    latest = listed.groupBy("kind", "key", "own").agg(F.expr("max_by(struct(id, score, type), id) AS x"))
    rows = latest.selectExpr("kind", "key", "x.*").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} configuration entries: join them instead")
    rows.sort(key=lambda r: r["id"])
    of = {name: [r for r in rows if r["kind"] == name] for name in keys}
    scored = {name: {r["key"]: r["score"] for r in of[name]} for name in ("keywords", "tlds", "shorteners", "geo_risks")}
    return RuleConfig(brands=[r["key"] for r in of["brands"]], hosting=[(r["key"], r["score"], r["type"]) for r in of["hosting"]], **scored)
