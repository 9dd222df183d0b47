import datetime
import gzip
import json
import random

from pyspark.sql import functions as F

from lurewatch.operators import anchored, joins, threats
from lurewatch.plans import check as C
from lurewatch.plans import corpus, queries
from lurewatch.operators.infra import Observations
from lurewatch.operators.whitelist import with_whitelisted
from lurewatch.sources import config, feeds

AS_OF = 1764547200


def test_readers_on_files(spark, tmp_path):
    (tmp_path / "tank.json.gz").write_bytes(gzip.compress(json.dumps(
        [{"phish_id": 1, "url": "http://a"}, {"phish_id": "x", "url": "http://b"}, {"url": "c"}]).encode()))
    (tmp_path / "haus.csv").write_text('# c\n"7","d","http://x/""q""","on"\r\n8,short\n9,a,,z\n')
    (tmp_path / "spam.txt").write_text(" bad.com \n\n")
    got = {name: sorted((r["url"], r["external_id"]) for r in feeds.read_feed(
        spark, name, str(tmp_path / file)).collect())
        for name, file in [("phishtank", "tank.json.gz"), ("urlhaus", "haus.csv"), ("stopforumspam", "spam.txt")]}
    assert got == {"phishtank": [("c", "0"), ("http://a", "1")],
                   "urlhaus": [("", "9"), ('http://x/"q"', "7")],
                   "stopforumspam": [("http://bad.com", "")]}


def test_second_run_inserts_nothing(spark):
    rows = spark.createDataFrame(
        [("http://a", "s", "1", "t", 2), ("http://a", "s", "0", "t", 1), ("http://b", "s", "", "t", 3)],
        "url string, source string, external_id string, threat_type string, seq int")
    now = F.timestamp_seconds(F.lit(AS_OF))
    nothing = threats.with_hash(rows.limit(0))
    first = threats.new_threats(nothing, rows, now)
    assert sorted((r["url"], r["external_id"]) for r in first.collect()) == [("http://a", "0"), ("http://b", "")]
    assert threats.new_threats(first, rows, now).count() == 0


def test_salted_join_equals_plain_join(spark):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}") for i in range(500)]
    left = spark.createDataFrame(rows, "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("", 3)], "k string, v int")
    plain = left.join(right, "k", "left").select("id", "k", "v")
    salted = joins.lookup_join(left, right, "k", ["id"], hot_rows=20, broadcast=False).select("id", "k", "v")
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_allow_list_inline_and_joined_agree(spark, monkeypatch):
    hosts = spark.createDataFrame(
        [(i, h) for i, h in enumerate(["google.com", "docs.google.com", "x.y", None, "com", "agoogle.com"])],
        "id int, host string")
    listed = spark.createDataFrame([(w,) for w in config.WHITELIST], "domain string")
    inline = with_whitelisted(hosts, listed, ["id"]).select("id", "whitelisted").collect()
    monkeypatch.setattr("lurewatch.operators.whitelist.INLINE_DOMAINS", 3)
    joined = with_whitelisted(hosts, listed, ["id"], hot_rows=1).select("id", "whitelisted").collect()
    assert sorted(inline) == sorted(joined)
    assert [r["whitelisted"] for r in sorted(inline)] == [True, True, False, False, False, False]


def test_windows_of_large_keys_equal_streamed_ones(spark):
    chance = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, chance.choice(["a", "a", "b", "c"]), start + datetime.timedelta(seconds=chance.randrange(4000)))
            for i in range(600)]
    events = spark.createDataFrame(rows, "event_id int, k string, ts timestamp")
    want, last = {}, {}
    for i, k, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        opens = k not in last or (ts - last[k]).total_seconds() >= 60
        last[k] = ts if opens else last[k]
        want[i] = (last[k], opens)
    for large in (10**6, 200, 0):
        got = anchored.window_starts(events, "k", "ts", "event_id", 60, large_rows=large)
        assert {r["event_id"]: (r["window_start"], r["opens"]) for r in got.collect()} == want


def test_one_large_key_over_many_windows(spark):
    """10,000 windows of one key, with gaps from a second to weeks, equal to the streamed path."""
    chance = random.Random(2)
    at, rows = datetime.datetime(2024, 1, 1), []
    for window in range(10_000):
        at += datetime.timedelta(seconds=60 + (chance.randrange(2_000_000) if window % 500 == 0 else chance.randrange(3)))
        rows += [(len(rows) + i, "k", at + datetime.timedelta(milliseconds=chance.randrange(59_000) if i else 0)) for i in range(20)]
    rows += [(len(rows) + i, "k", at + datetime.timedelta(seconds=i // 1000)) for i in range(5_000)]  # one full window
    events = spark.createDataFrame(rows, "event_id int, k string, ts timestamp").repartition(4)
    small, big = (anchored.window_starts(events, "k", "ts", "event_id", 60, large_rows=large) for large in (10**6, 1_000))
    keyed = ["event_id", F.col("window_start").alias("w"), F.col("opens").alias("o")]
    both = small.select(*keyed).join(big.select("event_id", "window_start", "opens"), "event_id", "full")
    assert both.where("NOT (w <=> window_start AND o <=> opens)").count() == 0 and both.count() == len(rows)
    assert small.where("opens").count() >= 10_000


def test_golden_report(spark):
    urls = spark.createDataFrame(
        [(1, "http://zygospor.ru"), (2, "https://docs.google.com/x"), (3, "http://zygospor.ru"), (4, ""), (5, None)],
        "id int, url string")
    listed = threats.with_hash(spark.createDataFrame(
        [("http://zygospor.ru", "stopforumspam", "", "spam", datetime.datetime(2025, 12, 1))],
        "url string, source string, external_id string, threat_type string, created_at timestamp"))
    dns = spark.createDataFrame(
        [("zygospor.ru", "5.230.123.239", 20, ["mail.zygospor.ru."], ["ns1.zygospor.ru."])],
        "host string, ip string, resolve_ms int, mx array<string>, ns array<string>")
    tls = spark.createDataFrame(
        [], "host string, has_cert boolean, issuer string, not_before_s long, not_after_s long")
    whois = spark.createDataFrame(
        [("zygospor.ru", "MAXNAME-RU", "2023-09-25T18:37:09Z", "2026-09-25T18:37:09Z")],
        "host string, registrar string, created_raw string, expires_raw string")
    base = 5 * 2**24 + 230 * 2**16
    asn = spark.createDataFrame([(base, base + 65535, 12586, "GHOSTnet GmbH")],
                                "start_ip long, end_ip long, asn int, org string")
    country = spark.createDataFrame([(base, base + 65535, "Germany"), (0, 2**32 - 1, "China")],
                                    "start_ip long, end_ip long, country string")
    obs = Observations(dns, tls, whois, None, asn, country)
    for options in ({}, {"broadcast": False, "hot_rows": 1}, {"distinct": True}):
        reports = C.check(urls, listed, config.WHITELIST, config.RuleConfig(), obs, F.lit(AS_OF), **options)
        got = {r["id"]: json.loads(r["report"]) for r in C.report_json(reports).collect()}
        assert sorted(got) == [1, 2, 3] and got[3] == got[1]
        assert got[2] == {"target": "https://docs.google.com/x", "verdict": "Safe", "risk_score": 0,
                          "reason": "Whitelisted Domain"}
        assert got[1]["risk_score"] == 100 and got[1]["reason"] == "Found in Blacklist"
        assert got[1]["signals"] == ["Listed in stopforumspam as spam", "No HTTPS", "Insecure Protocol"]
        assert got[1]["summary"] == {"critical": 0, "high": 0, "medium": 0, "low": 2}
        assert got[1]["whois"]["domain_age_days"] == 797
        assert got[1]["infrastructure"]["geolocation"] == {
            "country": "Germany", "isp": "GHOSTnet GmbH", "asn": 12586, "organization": "GHOSTnet GmbH"}


def test_narrow_tables_are_dealt_and_views_made_once(spark, tmp_path):
    """A small file holds many keys, each of which causes much work."""
    spark.range(1, 3001).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, "http://a/"), (2, None), (None, "b")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    hosts = corpus.view(spark, str(tmp_path), "host_dim")
    assert sorted(r["n"] for r in hosts.collect()) == list(range(1, 3001))
    sizes = hosts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["n"] for r in sizes) < 1000
    stored = queries.stored_raw(spark, str(tmp_path))
    assert sorted(stored) == sorted(feeds.NORMALISERS) and len({tuple(f.inputFiles()) for f in stored.values()}) == 4
    for name, frame in stored.items():
        raw = queries.raw_view(spark, str(tmp_path), name)
        assert frame.select("value").exceptAll(raw).isEmpty() and raw.exceptAll(frame.select("value")).isEmpty()
        assert {r["_part"] for r in frame.select("_part").distinct().collect()} == {0, 1, 2}
