import random
import re
from collections import Counter

import numpy as np

from lurewatch.llm import divergence as D


def plain(docs, least=3, top=200):
    """Every pair of sources over every kept term."""
    rows = [tuple(x or "" for x in row) for row in docs]
    terms = [re.findall("[a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(r[1], ts) for r, ts in zip(rows, terms) if r[0] == lang]
        spread = Counter(t for _, ts in mine for t in set(ts))
        kept = [t for t, n in spread.items() if n >= least]
        count = {}
        for source, ts in mine:
            count.setdefault(source, Counter()).update(t for t in ts if t in set(kept))
        whole = sum(count.values(), Counter())

        def shares(c):
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in count:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in count if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    stock = ["Alpha", "alpha", "beta", "gámma", "GÁmma", "漢字", "d", "e", "f", "g7h", "once" + str(seed)]
    docs = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None]),
             " ".join(rng.choice(stock[:rng.randrange(1, len(stock) + 1)]) + rng.choice(["", ",", "1"]) for _ in range(rng.randrange(0, 30))))
            for _ in range(80)]
    return docs + [("fr", "a", "no kept term"), ("fr", "b", None), ("it", "alone", "uno uno"), ("fr", "a", ""), docs[0], docs[0]]


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 5) for d in docs], "lang string, source string, text string, term string, n int")


def listed(found):
    return sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_against_all_pairs_and_terms(spark):
    for seed, group in ((1, 4000), (2, 3)):
        docs = made(seed)
        assert listed(D.audited(frame(spark, docs).repartition(3), group_terms=group)) == plain(docs)


def test_small_memory_spills_many_runs(spark):
    docs = made(3)
    kept = frame(spark, docs).repartition(4)
    one = sorted(map(tuple, D.postings(kept).collect()))
    assert one == sorted(map(tuple, D.postings(kept, most=1).collect())) and one
    top = D.audited(frame(spark, docs), top=2)
    assert listed(top) == plain(docs, top=2)


def test_shares_do_not_overflow():
    counts, base = np.array([0, 5, 10 ** 13, 9 * 10 ** 14], dtype=np.int64), np.array([10 ** 15 + 7], dtype=np.int64)
    assert D.shares(counts, base).tolist() == [1 + 10 ** 9 * (int(c) + 1) // int(base[0]) for c in counts]


def test_shares_in_sql_do_not_overflow(spark):
    row = spark.range(1).selectExpr("900000000000000 AS c", "1000000000000007 AS n", "0 AS terms").select(D.share("c", "n")).first()
    assert row[0] == 1 + 10 ** 9 * 900000000000001 // 1000000000000007


def test_empty_table(spark):
    assert D.audited(frame(spark, made(1)).limit(0)).count() == 0
