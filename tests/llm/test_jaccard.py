import random

from lurewatch.llm import components, jaccard


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, texts = {i: 0 for i in docs}, {i: set() for i in docs}
    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            same = (docs[i] or "") == (docs[j] or "")
            if same or sets[i] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                if not same:
                    texts[i].add(docs[j])
                    texts[j].add(docs[i])
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (top(i), links[i], len(texts[i])) for i in docs}


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    docs = {}
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(rng.choice([1, 3, 14])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs[len(docs) * 2] = " ".join(copy)
    docs |= {1001: None, 1003: "", 1005: "Two Words", 1007: "two words", 1009: "long " * 30000, 1011: "LONG " * 29000}
    return docs


def test_classes_and_links_against_all_pairs(spark):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs.items()] + [(0, docs[0], 1)],
                                  "doc_id long, text string, class_id int").repartition(4)
    wanted = brute(docs)
    for block in (1000, 5):  # with 5, groups are cut into blocks
        found = {r["node"]: (r["class_id"], r["n_links"], r["n_text_links"])
                 for r in jaccard.classes(frame, block=block).collect()}
        assert found == wanted
    kept = jaccard.representatives(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _, _ in wanted.values()})


def test_no_ids_and_empty(spark):
    schema = "doc_id long, text string"
    assert jaccard.classes(spark.createDataFrame([], schema)).count() == 0
    unnamed = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other"), (3, "other")], schema)
    assert jaccard.representatives(unnamed).count() == 2


def test_bounds_drop_only_unlikely_pairs():
    """Against the posterior integrated numerically."""
    bounds = jaccard.least_matches(0.8, 1e-6, 16, 128)
    steps = [(i + 0.5) / 20000 for i in range(20000)]
    for k, bound in enumerate(bounds, 1):
        n = 16 * k
        for m, stays in ((bound, True), (bound - 1, False)):
            if m >= 0:
                weights = [t ** m * (1 - t) ** (n - m) for t in steps]
                tail = sum(w for t, w in zip(steps, weights) if t >= 0.8) / sum(weights)
                assert (tail >= 1e-6) == stays


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (2, 1)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {i: 1 for i in range(2, 61)} | {i: 100 for i in range(101, 140)}


def test_repeated_ids_with_other_texts(spark):
    """Each text keeps its links, and none leaves the corpus."""
    one, other = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    docs = [(1, one), (1, other), (2, one + " end"), (3, other + " end"), (1, one), (None, one)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard.classes(frame).collect()
    assert len(rows) == 5 and len({r["node"] for r in rows}) == 5
    by = {}
    for r in rows:
        by.setdefault(r["class_id"], []).append((r["doc_id"] if r["doc_id"] > 0 else None, r["n_links"], r["n_text_links"]))
    assert sorted(sorted(map(str, g)) for g in by.values()) == [
        ["(1, 1, 1)", "(3, 1, 1)"], ["(1, 2, 1)", "(2, 2, 1)", "(None, 2, 1)"]]
    kept = [r["text"].split()[0] for r in jaccard.representatives(frame).collect()]
    assert sorted(kept) == ["a0", "b0"]
