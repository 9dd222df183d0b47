from lurewatch.llm import urlfilters as U

ENTRIES = [
    ("domain", "example.com", "block", 100), ("domain", "example.com", "remove", 5_000_000),
    ("host", "good.example.com", "allow", 200), ("prefix", "good.example.com/bad", "block", 300),
    ("prefix", "good.example.com/bad/fine", "allow", 300), ("url", "x.org/a?b=1", "block", 86_400),
    ("url", "x.org/a?b=1", "allow", 86_400), ("url", "x.org/a?b=1", "remove", 86_401),
    ("host", "h.net", "block", 10), ("host", "h.net", "block", 20), ("host", "h.net", "allow", 30),
    (None, "h.net", "block", 1), ("host", None, "block", 1), ("host", "h.net", "block", None),
    ("host", "h.net", "other", 40), ("odd", "h.net", "block", 40),
] + [("host", "busy.net", ("block", "remove")[i % 2], 1000 + 40_000 * i) for i in range(200)]
URLS = ["http://example.com/", "https://user@Good.Example.com:80/bad/", "http://good.example.com/bad/fine/x#f",
        "http://good.example.com/badly", "http://x.org/a?b=1", "https://x.org//a/?b=1", "http://h.net", "h.net", None,
        "http://busy.net/p", "http://" + "a." * 60 + "example.com/" + "p/" * 300]
TIMES = [None, 0, 10, 25, 30, 99, 100, 250, 300, 86_400, 86_401, 4_999_999, 5_000_000, 7_900_000, 41_000, 40_999]


def judged(url, at):
    if url is None or at is None or "://" not in url:
        return None, None, None
    rest = url.split("://", 1)[1].split("#")[0]
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    host, path = host.split("@")[-1].split(":")[0].lower(), path.strip("/")
    labels, parts = host.split("."), path.split("/") if path else []
    names = [("domain", ".".join(labels[i:])) for i in range(len(labels))] + [("host", host)]
    names += [("prefix", host + "/" + "/".join(parts[:i])) for i in range(1, len(parts) + 1)]
    names.append(("url", f"{host}/{path}" + (f"?{query}" if query else "")))
    best = None
    for kind, pattern in names:
        dated = [(t, U.ACTIONS[a]) for k, p, a, t in ENTRIES
                 if (k, p) == (kind, pattern) and t is not None and t <= at and a in U.ACTIONS]
        if dated and max(dated)[1]:
            found = (U.KINDS[kind], len(pattern), kind, pattern, *max(dated))
            best = max(best, found) if best else found
    return (("block" if best[5] == 2 else "allow"), f"{best[2]}:{best[3]}", best[4]) if best else (None, None, None)


def tables(spark):
    rows = [(u, t, "mine") for u in URLS for t in TIMES] + [(URLS[0], 100, "mine")] * 3
    return rows, spark.createDataFrame(rows, "url string, fetched_at long, decision string"), spark.createDataFrame(
        ENTRIES, "kind string, pattern string, action string, listed_at long")


def test_decisions_against_python(spark):
    rows, captures, entries = tables(spark)
    found = U.filtered(captures, entries)
    assert found.columns == ["url", "fetched_at", *U.ADDED]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((u, t, *judged(u, t))) for u, t, _ in rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_intervals_touch_and_end(spark):
    _, _, entries = tables(spark)
    rows = [(i["valid_from"], i["valid_to"], i["rank"]) for r in U.validity(entries).where(
        "pattern = 'busy.net'").orderBy("day").collect() for i in r["intervals"]]
    assert len(rows) == 200 and rows[-1][1] is None
    assert all(a[1] == b[0] for a, b in zip(rows, rows[1:]))


def test_empty_sides(spark):
    _, captures, entries = tables(spark)
    assert U.filtered(captures.limit(0), entries).count() == 0
    assert U.filtered(captures, entries.limit(0)).where("decision IS NOT NULL").count() == 0
