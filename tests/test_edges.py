import datetime
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from lurewatch.functions.dates import with_registration_age
from lurewatch.functions.url import with_url_parts
from lurewatch.operators import anchored, geo, infra, joins, lexical
from lurewatch.operators.infra import Observations
from lurewatch.plans import check as C
from lurewatch.session import checkpointed
from lurewatch.sources import config, feeds

AS_OF = 1764547200


def test_bracketed_dates_are_read_in_one_notation(spark):
    texts = ["2006-01-02 15:04:05 (MSK)", "02.01.2006 (MSK)", "2006.01.02 (x)", "2006-01-02", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, created string")
    ages = [r[0] for r in with_registration_age(df, "created", F.lit(AS_OF)).orderBy("id").select("domain_age_days").collect()]
    assert ages == [7273, 0, 0, 7273, 0]


def test_fractions_of_a_second_count(spark):
    texts = ["2025-11-30T00:00:00Z", "2025-11-30T00:00:00.000Z", "2025-11-30T00:00:00.001Z", "2025-11-29 23:59:59,9",
             "2025-12-01T00:00:00.5Z", "2025-12-02T00:00:00.5+00:00", "2025-11-30 0:00:00.25 +0000"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, created string")
    ages = [r[0] for r in with_registration_age(df, "created", F.lit(AS_OF)).orderBy("id").select("domain_age_days").collect()]
    assert ages == [1, 1, 0, 1, 0, -1, 0]


def test_ranges_by_prefixes_against_scanning(spark):
    ranges = [(0, 2**32 - 1, "all"), (5, 5, "one"), (3, 17, "odd"), (2**31 - 3, 2**31 + 9, "middle"),
              (2**32 - 1, 2**32 - 1, "last")] + [(10**6 + 16 * i, 10**6 + 16 * i + 9, f"r{i}") for i in range(300)]
    numbers = [0, 3, 4, 5, 17, 18, 2**31 - 4, 2**31 - 3, 2**31 + 9, 2**31 + 10, 2**32 - 2, 2**32 - 1,
               *range(10**6, 10**6 + 200, 7)]
    asked = spark.createDataFrame([(str(ipaddress.IPv4Address(n)),) for n in numbers], "ip string")
    held = spark.createDataFrame(ranges, "start_ip long, end_ip long, name string")
    got = {r["ip"]: r["name"] for r in geo.range_lookup(asked, held, ["name"]).collect()}
    assert got == {str(ipaddress.IPv4Address(n)): min((e - s, s, v) for s, e, v in ranges if s <= n <= e)[2] for n in numbers}
    wide = spark.createDataFrame([(0, 99, 4200000000, "big")], "start_ip long, end_ip long, asn long, org string")
    row = geo.geo_lookup(spark.createDataFrame([("0.0.0.7",)], "ip string"), wide, None, ["ip"]).first()
    assert row["asn"] == 4200000000


def test_two_addresses_of_a_host_give_one_report(spark):
    dns = spark.createDataFrame(
        [("h.net", "9.9.9.9", 1, ["m"], None, 2), ("h.net", "1.1.1.1", 1, ["m"], None, 1), ("h.net", None, 1, None, None, 0)],
        "host string, ip string, resolve_ms int, mx array<string>, ns array<string>, seq int")
    tls = spark.createDataFrame([("h.net", True, "x", 1, 2), ("h.net", True, "x", 0, 2)],
                                "host string, has_cert boolean, issuer string, not_before_s long, not_after_s long")
    whois = spark.createDataFrame([("h.net", "r", "2006-01-02"), ("h.net", "r", "2007-01-02")],
                                  "host string, registrar string, created_raw string")
    rows = infra.host_facts(Observations(dns, tls, whois), config.RuleConfig(), F.lit(AS_OF)).collect()
    assert len(rows) == 1 and rows[0]["ip"] == "1.1.1.1"


def test_rows_without_time_or_key_are_in_no_window(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, ("a", "b", None)[i % 3], None if i % 5 == 0 else start + datetime.timedelta(seconds=i)) for i in range(90)]
    events = spark.createDataFrame(rows, "event_id int, k string, ts timestamp")
    want = None
    for large in (10**6, 5):
        got = {r["event_id"]: (r["window_start"], r["opens"]) for r in anchored.window_starts(
            events, "k", "ts", "event_id", 30, large_rows=large).collect()}
        assert len(got) == 90
        for i, k, ts in rows:
            assert (got[i] == (None, None)) == (k is None or ts is None)
        want = want or got
        assert got == want
    clients = events.withColumnRenamed("k", "client")
    for large in (10**6, 5):
        quota = {r["event_id"]: r["accepted"] for r in anchored.client_quota(clients, 3, 30, large).collect()}
        assert [i for i, a in quota.items() if a is None] == [i for i, k, ts in rows if k is None or ts is None]


def test_next_moment_search_is_linear_in_the_blocks(spark):
    moments = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 10**6).alias("_us"))
    got = anchored._next_moments(checkpointed(moments), "k", 64).agg(F.count("*"), F.sum("_next")).first()
    assert tuple(got) == (19_999, sum(range(1, 20_000)) * 10**6)


def test_large_configuration_and_changed_scores(spark):
    tables = config.seed_tables(spark)
    many = spark.range(1000, 9000).select(F.col("id").cast("int"), F.concat(F.lit("zq"), "id").alias("tld"), F.lit(7).alias("score"))
    loaded = config.load_config(tables | {"tlds": tables["tlds"].union(many)})
    assert len(loaded.tlds) == len(config.TLDS) + 8000
    urls = with_url_parts(spark.createDataFrame([(1, "https://a.zq8999"), (2, "https://a.xyz"), (3, "https://a.zq5")], "id int, url string"))
    found = {r["id"]: r["score"] for r in lexical.exploded(
        lexical.with_rules(urls, loaded, F.lit(0), ["Suspicious TLD"]), ["id"]).collect()}
    assert found == {1: 7, 2: 10}
    try:
        config.load_config({k: v for k, v in tables.items() if k != "tlds"})
    except KeyError:
        return
    raise AssertionError("a missing table must stop the load")


def test_lookups_run_nothing_while_planned(spark):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("planning", "")
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    joined = joins.lookup_join(left, left.select("k", F.lit(1).alias("v")).distinct(), "k", ["id"])
    obs = Observations(*[spark.createDataFrame([], s) for s in (
        "host string, ip string, resolve_ms int, mx array<string>, ns array<string>",
        "host string, has_cert boolean, issuer string, not_before_s long, not_after_s long",
        "host string, registrar string, created_raw string")])
    threats = spark.createDataFrame([], "url string, url_hash string, source string, external_id string, threat_type string, created_at timestamp")
    urls = spark.createDataFrame([(1, "http://a.b"), (2, None), (3, "https://google.com")], "id int, url string")
    report = C.check(urls, threats, config.WHITELIST, config.RuleConfig(), obs, F.lit(AS_OF))
    assert len(tracker.getJobIdsForGroup("planning")) == 0
    context.setJobGroup("running", "")
    assert joined.where("v = 1").count() == 1000
    assert {r["id"]: r["verdict"] for r in report.collect()} == {1: "Safe", 3: "Safe"}


def test_broken_documents_give_their_whole_elements_or_an_error(spark):
    good = '{"phish_id":1,"url":"http://a/{x}\\"","details":[{"ip":"1"}]}'
    raw = spark.createDataFrame([(f'[{good},{{"phish_id":2,"url":"http://b"}},{{"phish_id":3,"ur',), (f"[{good}]",)], "value string")
    assert sorted((r["external_id"], r["url"]) for r in feeds.phishtank(raw).collect()) == [
        ("1", 'http://a/{x}"'), ("1", 'http://a/{x}"'), ("2", "http://b")]
    cut = spark.createDataFrame([('{"5":[{"ioc_value":"http://a","ioc_type":"url"',)], "value string")
    try:
        feeds.threatfox(cut).collect()
    except Exception as error:
        assert "threatfox" in str(error)
        return
    raise AssertionError("a broken document must not pass in silence")


def test_addresses_of_both_kinds_in_nested_networks(spark):
    """Against the standard library, with networks of all lengths."""
    rng = random.Random(8)
    texts = ["::", "::1", "1::", "2001:DB8::1", "2001:db8:0:0:0:0:0:1", "::ffff:1.2.3.4", "::FFFF:102:304", "64:ff9b::1.2.3.4", "1.2.3.4",
             "::1.2.3.4", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "12345::", "g::", "",
             "1.2.3", "1.2.3.400", "::1.2.3.400", "fe80::1%eth0", " ::1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", None]
    texts += [str(ipaddress.ip_address(rng.getrandbits(128) >> rng.choice([0, 0, 64, 96]))) for _ in range(60)]
    networks = [str(ipaddress.ip_network((rng.choice([int(ipaddress.ip_address(t)) for t in texts[27:]]), n), strict=False)) for n in range(129)]
    networks += ["0.0.0.0/0", "1.0.0.0/8", "1.2.3.4/32", "::ffff:0:0/33", "x/3", "1.2.3.0/33", "::/129", "::/x", "2001:db8::5/32"]

    def number(text):
        try:
            found = ipaddress.ip_address(text)
        except ValueError:
            return None
        if "%" in text:
            return None
        return int(getattr(found, "ipv4_mapped", None) or found)

    held = []
    for name in networks:
        base, _, bits = name.partition("/")
        if number(base) is not None and bits.isdigit() and int(bits) <= (128 if ":" in base else 32):
            held.append((int(bits) + (0 if ":" in base else 96), number(base), name))
    wanted = {}
    for text in texts:
        at = number(text) if text else None
        inside = [(-bits, name) for bits, base, name in held if at is not None and at >> (128 - bits) == base >> (128 - bits)]
        if inside:
            wanted[text] = min(inside)[1]
    asked = spark.createDataFrame([(t,) for t in texts], "ip string").distinct()
    table = spark.createDataFrame([(n, n) for n in networks], "network string, name string")
    assert {r["ip"]: r["name"] for r in geo.range_lookup(asked, table, ["name"]).collect()} == wanted


def test_long_configuration_is_not_collected(spark):
    tables = config.seed_tables(spark)
    assert config.load_config(tables) == config.RuleConfig()
    more = tables["keywords"].unionByName(spark.createDataFrame([(9999, "login", 1), (-1, "login", 2)], tables["keywords"].schema))
    assert config.load_config(tables | {"keywords": more}).keywords["login"] == 1
    with pytest.raises(ValueError):
        config.load_config(tables, most=100)


def test_only_odd_documents_are_cut_into_pieces(spark, monkeypatch):
    a, b = '{"phish_id":1,"url":"a"}', '{"phish_id":2,"url":"b}"}'
    whole = ["[]", f" [{a}, 5, {b}]\n", f"[[{a}]]", '[{"url":"\\u0022}"},null]']
    odd = [f"[{a}", f"[{a}],[{b}]", f"[{a},5] , [{b},{a}]", f'[{a}]],"all":[[5],[{b}]', f'[{a}],"all":[[1],[{b}]', f"[{a} {b}]", a, "null", "",
           f"[{{'phish_id':1,'url':'a}}'}},{b}]", f'[{{"url":"c","url":"d"}},{b}]', f"[{a}]]", f"[{a}] x", f"[{a},]"]
    frame = spark.createDataFrame([(d, d) for d in [*whole, *odd, None]], "value string, landed_path string").select(
        "value", F.lit(None).cast("timestamp").alias("landed_at"), "landed_path", *[F.lit(0).alias(c) for c in ("landed_block", "landed_place")])
    cut, quoted = [], feeds._with_quoted
    monkeypatch.setattr(feeds, "_with_quoted", lambda rows, *rest: cut.append(rows.count()) or quoted(rows, *rest))
    found = feeds.phishtank(frame).select("landed_path", "url", "external_id")
    assert cut == [sum(len(d.split("}")) for d in odd)]
    monkeypatch.setattr(feeds, "json_elements", feeds._pieced_elements)
    pieced = feeds.phishtank(frame).select("landed_path", "url", "external_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pieced.collect()))
    cut.clear()
    monkeypatch.undo()
    monkeypatch.setattr(feeds, "_with_quoted", lambda rows, *rest: cut.append(1) or quoted(rows, *rest))
    assert feeds.phishtank(frame.where(F.col("value").isin(whole))).count() == 3 and cut == []
