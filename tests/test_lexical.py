from pyspark.sql import functions as F

from lurewatch.functions.url import with_lookup_host, with_url_parts
from lurewatch.operators import lexical
from lurewatch.sources.config import RuleConfig

# url, age, trusted, score
GOLDEN = [
    ("https://example.com/", 0, False, 0),
    ("http://example.com/", 0, False, 5),
    ("example.com:8080/x", 0, False, 30),
    ("http://secure-login-apple.com", 0, False, 100),
    ("https://paypa1.com/", 0, False, 99),
    ("https://paypal.co.uk/", 0, False, 100),
    ("https://apple.com/", 0, False, 99),
    ("https://groups.com/", 0, False, 100),
    ("https://creditagricole.fr/", 0, False, 99),
    ("https://bit.ly/abc", 0, False, 25),
    ("http://192.168.0.1/login", 0, False, 77),
    ("https://shop.example.xyz/verification?next=/a", 0, False, 42),
    ("https://a.example.com/aGVsbG8gd29ybGQgaGVsbG8=", 0, False, 25),
    ("https://a.example.com/aGVsbG8gd29ybGQgaGVsbG8", 0, False, 0),
    ("https://a.workers.dev/x?url=1", 0, True, 40),
    ("http://user:p@example.com/", 0, False, 96),
    ("https://example.com/a@b", 0, False, 25),
    ("http://example.com/account/update", 400, False, 6),
    ("https://example.com/", 7, False, 60),
    ("https://x.example.com/deadbeefdeadbeef", 0, False, 12),
    ("https://xn--pypal-4ve.com/", 0, False, 100),
    ("ipfs://QmX/y", 0, False, 40),
]


def test_golden_scores(spark):
    rows = spark.createDataFrame(GOLDEN, "url string, age int, trusted boolean, want int")
    found = lexical.with_rules(with_url_parts(rows), RuleConfig(), F.col("age"))
    scored = lexical.with_lexical_score(found, F.col("age"), F.col("trusted"))
    assert [r for r in scored.collect() if r["want"] != r["lexical_score"]] == []


def test_url_parts(spark):
    # url -> parsed, hostname, path, port, userinfo, lookup host
    cases = {
        "http://h:abc/": (True, "http", "//h:abc/", "", False, None),
        "https://h/%zz": (False, None, None, None, None, None),
        "//h/x": (True, "h", "/x", "", False, ""),
        "///h/x": (True, "", "///h/x", "", False, ""),
        "mailto:x": (False, None, None, None, None, None),
        "https://[::1]:80/x": (True, "::1", "/x", "80", False, "::1"),
        "http://a_b.com/%6Cogin+x?q#f": (True, "a_b.com", "/login+x", "", False, "a_b.com"),
        "http://caf%C3%A9.com/": (True, "café.com", "/", "", False, "café.com"),
        "  https://h.top/  ": (True, "h.top", "/", "", False, "h.top"),
        "HTTPS://WWW.H.COM/A": (True, "www.h.com", "/A", "", False, "h.com"),
        "ftp://google.com/x": (True, "google.com", "/x", "", False, "ftp"),
        "a@b.com:80": (True, "b.com", "", "80", True, "b.com"),
        "http://h\x01/": (False, None, None, None, None, None),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    got = with_lookup_host(with_url_parts(rows)).collect()
    assert {r["url"]: (r["parsed"], r["hostname"], r["path"], r["port"], r["has_userinfo"], r["host"])
            for r in got} == cases


def test_lookalikes_agree_with_plain_comparison(spark):
    """The length and letter-set bounds never lose a pair."""
    brands = RuleConfig().brands
    tokens = sorted({b[:i] + c + b[j:] for b in brands for i in range(0, len(b), 2)
                     for c in ("", "x", "é") for j in (i, i + 1)} - {""})
    tokens = [t for t in tokens if "-" not in t]
    rows = spark.createDataFrame([(f"https://{t}.zz/", t) for t in tokens], "url string, t string")
    found = lexical.exploded(lexical.with_rules(
        with_url_parts(rows), RuleConfig(), names=["Typosquatting"]), ["t"])
    names = spark.createDataFrame([(b,) for b in brands], "b string")
    edits = F.levenshtein("t", "b")
    plain = rows.crossJoin(names).where(
        (F.octet_length("t") >= 4) & (F.col("t") != F.col("b"))
        & ((edits == 1) | ((F.octet_length("b") >= 6) & (edits <= 2))))
    want = plain.select("t", F.concat(F.lit("Token '"), "t", F.lit("' ~ '"), "b", F.lit("'")).alias("desc"))
    assert sorted(found.select("t", "desc").collect()) == sorted(want.collect())
