import hashlib
import re

from lurewatch.llm import mixing

DOCS = "doc_id long, source string, text string, size string, target int"


def rows(spark):
    docs = [(i, f"s{i % 4}", " ".join(["w"] * (i % 7)), "x", 1) for i in range(60)]
    docs += [(100, None, "a b\x0bc", "x", 1), (101, "s1", None, "x", 1), (102, "empty", "", "x", 1),
             (103, "big", "long " * 5000, "x", 1), (None, "s2", "no id", "x", 1), (5, "s1", " ".join("w" * 5), "x", 1),
             (5, "s1", " ".join("w" * 5), "x", 1)]
    return docs, spark.createDataFrame(docs, DOCS)


def expected(docs):
    """Targets and repetitions by filling the sources one after the other."""
    sized = [(i, s, t, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t, *_ in docs]
    size = {}
    for _, s, _, n in sized:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:
        share = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if 3 * size[s] <= weight[s] * share}
        if not full:
            break
        target |= {s: 3 * size[s] for s in full}
        free -= full
    target |= {s: weight[s] * share for s in free}
    return sized, size, target


def test_mix_matches_filling_by_hand(spark):
    docs, frame = rows(spark)
    sized, size, target = expected(docs)
    found = mixing.mix(frame).collect()
    assert sorted(map(repr, ((r["doc_id"], r["size"], r["source_size"]) for r in found))) == sorted(
        map(repr, ((i, n, size[s]) for i, s, _, n in sized)))
    taken = {}
    for r in found:
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    longest = {s: max(n for _, t, _, n in sized if t == s) for s in size}
    for s in size:  # the three equal rows are taken alike
        assert abs(taken[s] - target[s]) <= 1.5 * longest[s] + 1e-6
    again = mixing.mix(frame.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_mixed_rows_repeat_documents_and_keep_columns(spark):
    docs, frame = rows(spark)
    taken = {}
    for r in mixing.mix(frame).collect():
        key = (r["doc_id"], hashlib.md5((r["text"] or "").encode()).digest())
        taken[key] = taken.get(key, 0) + r["repeats"]
    out = mixing.mixed_rows(frame)
    assert out.columns == frame.columns
    seen = {}
    for r in out.collect():
        key = (r["doc_id"], hashlib.md5((r["text"] or "").encode()).digest())
        seen[key] = seen.get(key, 0) + 1
    assert seen == {k: n for k, n in taken.items() if n}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0
    no_words = spark.createDataFrame([(1, "a", "", "x", 1), (2, None, None, "x", 1)], DOCS)
    assert [r["target"] for r in mixing.mix(no_words).collect()] == [0.0, 0.0]
