import random

from pyspark.sql import functions as F

from lurewatch.functions.url import with_url_parts
from lurewatch.operators import infra, joined, lexical
from lurewatch.sources.config import RuleConfig

SMALL = "abcde"


def word(rng, low, high, letters=SMALL):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))


def hosts(rng, brands, words):
    urls = []
    for i in range(150):
        brand = rng.choice(brands)
        typo = brand[:2] + rng.choice(["", "x", brand[1:2]]) + brand[3:]
        urls.append("https://" + rng.choice([
            f"{typo}.com", f"www.{brand}-login.net", f"{brand}.com", f"{brand}.secure.org", f"a.{brand}.co.uk", f"x-{brand}.org",
            f"{typo}-{typo}.{rng.choice(words)}.de", word(rng, 3, 12) + ".com", "é" + typo + ".fr"])
            + "/" + rng.choice(["", rng.choice(words), "x/" + rng.choice(words).upper() + "/y", word(rng, 1, 30)]))
    return urls + ["", "ftp://", "http://a b", None]


def findings(frame):
    return sorted(map(tuple, lexical.exploded(frame, ["id"]).collect()))


def test_joined_rules_equal_literal_ones(spark):
    rng = random.Random(1)
    brands = sorted({word(rng, 1, 12) for _ in range(300)} | {"éclair", "ab", "abcdef"}) + ["abcdef"]
    words = sorted({word(rng, 1, 8) for _ in range(60)} | {"a", "ée"})
    scores = {w: i % 30 for i, w in enumerate(words)}
    urls = spark.createDataFrame(list(enumerate(hosts(rng, brands, words))), "id int, url string")
    df = with_url_parts(urls)
    tables = {"brands": spark.createDataFrame([*enumerate(brands), (9999, None)], "id int, name string"),
              "keywords": spark.createDataFrame([(i - 100, w, 77) for i, w in enumerate(words)] + [
                  (i, w, s) for i, (w, s) in enumerate(scores.items())] + [(5000, None, 1)], "id int, word string, score int")}
    config = RuleConfig(brands=brands, keywords=scores)
    wanted = findings(lexical.with_rules(df, config))
    assert findings(joined.with_rules(df, tables, config, ["id"])) == wanted
    assert {name for _, _, name, _, _ in wanted} >= set(joined.RULES)
    one = ["Typosquatting", "Insecure Protocol"]
    assert findings(joined.with_rules(df, tables, config, ["id"], names=one)) == findings(lexical.with_rules(df, config, names=one))
    none = {name: table.limit(0) for name, table in tables.items()}
    assert findings(joined.with_rules(df, none, config, ["id"], names=joined.RULES)) == []


def test_fifty_thousand_brands(spark):
    rng = random.Random(2)
    brands = sorted({word(rng, 5, 14, "abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)})
    table = spark.createDataFrame(list(enumerate(brands)), "id int, name string")
    typed = {b[:3] + "q" + b[4:]: b for b in brands[::500]}
    found = joined.lookalikes(spark.createDataFrame([(t,) for t in typed], "token string"), table).collect()
    pairs = {(r["token"], r["name"]) for r in found}
    assert {(t, b) for t, b in typed.items() if t != b} <= pairs

    def near(a, b, most):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1] <= most

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    assert all(near(t, b, 2 if len(b) >= 6 else 1) and t != b for t, b in pairs)
    texts = ["".join(rng.sample(brands, 3)) for _ in range(200)]
    inside = joined.contained(spark.createDataFrame([(t,) for t in texts], "text string"), table.withColumnRenamed("name", "pattern"))
    assert {(r["text"], r["id"]) for r in inside.collect()} == {(t, i) for t in texts for i, b in enumerate(brands) if b in t}


def test_first_hosting_pattern(spark):
    rows = [("ovh", 3, "bulletproof"), ("OV", 4, "cloud"), ("cloud", 5, "cloud"), ("x", 6, "other"), ("", 7, "cloud")]
    owners = ["OVH SAS", "Some Cloud", "Unknown", "none", "xx", ""]
    df = spark.createDataFrame([(o,) for o in owners] + [(None,)], "isp string")
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, pattern string, score int, type string")
    config = RuleConfig(hosting=rows)
    wanted = df.select("isp", infra.hosting_match(config, F.col("isp")).alias("m")).where("m IS NOT NULL")
    assert sorted(map(tuple, joined.first_hosting(df, table).collect())) == sorted(map(tuple, wanted.collect()))


def test_strings_of_texts_are_not_moved_to_a_short_list(spark, capsys):
    rows = [(1, "paypal"), (2, "ab"), (3, ""), (4, None), (5, "ébay😀"), (1, "paypal")]
    brands = spark.createDataFrame(rows, "id int, name string")
    texts = ["paypa1", "paypal", "xpaypalx", "ébay", "ébay😀", "a", "", "paypl-paypal", None]
    near = joined.lookalikes(spark.createDataFrame([(t,) for t in texts], "token string"), brands)
    inside = joined.contained(spark.createDataFrame([(t,) for t in texts], "text string"), brands.withColumnRenamed("name", "pattern"))
    for frame in (near, inside):
        capsys.readouterr()
        frame.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, near.collect())) == [("paypa1", 1, "paypal"), ("xpaypalx", 1, "paypal"), ("ébay", 5, "ébay😀")]
    assert sorted(map(tuple, inside.collect())) == sorted(
        (t, i) for t in texts if t is not None for i, b in dict(rows).items() if b is not None and b in t)
