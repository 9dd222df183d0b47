import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import quality, textmodel, toxicity

BAD = ["idiotic", "scummy", "worthless"]


def corpus(n=400):
    """Clean, toxic and junk texts; ids divisible by 4 carry no label."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 60))
        toxic, junk = i % 5 == 1, i % 7 == 2
        if toxic:
            for b in rng.choice(BAD, 3):
                text.insert(int(rng.integers(60)), str(b))
        if junk:
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text), "x"))
        if i % 4:
            labels.append((i, 1 - junk, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "clean " * 50000, "x"), (None, "no id", "x"), docs[8], docs[8]]
    labels += [(None, 1, 0), (5000, None, 1), (1, 1, 1), (1000, 1, 0)]
    return (spark.createDataFrame([(i, t, x) for i, t, x in docs], "doc_id long, text string, p_toxic string"),
            spark.createDataFrame([(i, None if q is None else int(q), t) for i, q, t in labels],
                                  "doc_id long, quality int, toxic int"))


def test_toxic_documents_go_and_clean_ones_stay(tables):
    docs, labels = tables
    found = toxicity.judged(docs, labels).collect()
    assert len(found) == docs.count()
    unseen = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4 == 0]
    wrong = [r["doc_id"] for r in unseen if r["rejected"] != (r["doc_id"] % 5 == 1)]
    assert len(wrong) <= 2
    by_id = {r["doc_id"]: r for r in found}
    assert not any(by_id[i]["rejected"] for i in (1000, 1001, 1002))
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r["rejected"] for r in found)


def test_later_link_uses_earlier_probability():
    rng = np.random.default_rng(5)
    first = rng.random(600) < 0.4
    rows = [np.array([1 + 2 * int(a), 100 + int(rng.integers(30))]) for a in first]
    chain = toxicity.fit_chain(textmodel.Sample(rows), {"one": first.astype(int), "two": first.astype(int)})
    assert chain["two"].earlier[0] > 0
    p = [toxicity.probabilities(chain, r)[1] for r in rows]
    assert np.mean((np.array(p) > 0.5) == first) > 0.95


def test_grades_and_tails(tables):
    docs, labels = tables
    found = {r["doc_id"]: r for r in quality.graded(docs.drop("p_toxic"), labels).collect()}
    unseen = [i for i in range(0, 400, 4)]
    assert sum(found[i]["kept"] != (i % 7 != 2) for i in unseen) <= 2
    clean = [found[i]["expected_grade"] for i in unseen if i % 7 != 2 and i % 5 != 1]
    toxic = [found[i]["expected_grade"] for i in unseen if i % 7 != 2 and i % 5 == 1]
    junk = [found[i]["expected_grade"] for i in unseen if i % 7 == 2]
    assert np.mean(clean) > np.mean(toxic) > np.mean(junk)
    for r in found.values():
        assert r["p_ge_1"] >= r["p_ge_2"] and abs(r["expected_grade"] - r["p_ge_1"] - r["p_ge_2"]) < 1e-9


def test_without_labels_or_documents(spark, tables):
    docs, labels = tables
    assert toxicity.accepted(docs, labels.limit(0)).count() == docs.count()
    assert quality.graded(docs, labels.limit(0)).where("kept").count() == 0
    assert toxicity.judged(docs.limit(0), labels).count() == 0
    one_class = labels.where("toxic = 0 AND quality = 1")
    assert toxicity.judged(docs, one_class).where("rejected").count() == 0
    assert quality.graded(docs, one_class).where("kept").count() == docs.count()


def test_gradients_by_differences():
    rng = np.random.default_rng(7)
    rows = [np.unique(rng.integers(0, 6, 3)) for _ in range(80)]
    sample, grades = textmodel.Sample(rows), rng.integers(0, 3, 80)
    seen = {}
    original = textmodel.minimise
    for module, run in ((quality, lambda: quality.fit(sample, grades)),
                        (toxicity, lambda: toxicity.fit_chain(sample, {"a": grades > 0}))):
        module.minimise = lambda loss, start: seen.update(loss=loss, start=start) or original(loss, start)
        try:
            textmodel.LEAST_SCORE, least = 0.0, textmodel.LEAST_SCORE
            run()
        finally:
            textmodel.LEAST_SCORE, module.minimise = least, original
        point = seen["start"] + rng.normal(size=len(seen["start"])) * 0.3
        gradient = seen["loss"](point)[1]
        for i in range(len(point)):
            step = np.eye(len(point))[i] * 1e-5
            slope = (seen["loss"](point + step)[0] - seen["loss"](point - step)[0]) / 2e-5
            assert abs(slope - gradient[i]) < 1e-3 * max(1, abs(slope))


def test_held_out_accuracy_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.where(F.xxhash64("doc_id") % 4 == 0)
    known = labels.join(held.select("doc_id"), "doc_id", "left_anti")
    row = toxicity.judged(docs, known).join(held, "doc_id").agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("rejected").cast("int"))).alias("found"),
        F.avg(F.when(F.col("toxic") == 0, F.col("rejected").cast("int"))).alias("wrong")).first()
    assert row["found"] > 0.7 and row["wrong"] < 0.01
    row = quality.graded(docs, known).join(held, "doc_id").agg(
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("kept"),
        F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("wrong")).first()
    assert row["kept"] > 0.98 and row["wrong"] < 0.1


def features(text):
    return set(textmodel.Features().of(text).tolist())


def test_every_part_of_a_run_is_a_feature():
    words = features("so you idiot")
    named = {textmodel._hash(f"w:{w}") for w in ("so", "you", "idiot")}
    assert named <= words and named <= features("so,you,idiot") and named <= features("so-you9idiot_")
    assert textmodel._hash("4:idio") in features("x" * 30 + "idiot") & features("x" * 500 + "idiot")
    assert textmodel._hash("4:idio") in features("x," * 500 + "idiot") & features(textmodel.PIECE_BLOCK * "x" + "idiot")
    assert features("x" * (textmodel.PIECE_BLOCK - 2) + "idiot") >= {textmodel._hash(n) for n in ("4:idio", "4:diot", "5:idiot")}
    for tail in ("1", ".a", "bcd"):  # runs that agree in far more than 64 characters
        assert features("ab" * 2000) != features("ab" * 2000 + tail)
    assert textmodel._hash("2:\u4f60\u597d") in features("\u4eca\u5929\u4f60\u597d")


def test_toxic_word_at_the_end_of_an_unspaced_run_is_seen(tables):
    docs, labels = tables
    spark = docs.sparkSession
    clean, joined = "w" * 100, "".join(f"w{i}" for i in range(60))
    runs = {2000: clean, 2001: clean + "".join(BAD), 2002: joined, 2003: joined + "".join(BAD),
            2004: ",".join(["w7"] * 40 + BAD), 2005: ",".join(["w7"] * 40)}
    more = spark.createDataFrame([(i, t, "x") for i, t in runs.items()], docs.schema)
    found = {r["doc_id"]: r for r in toxicity.judged(docs.unionByName(more), labels).where("doc_id >= 2000").collect()}
    for bad, good in ((2001, 2000), (2003, 2002), (2004, 2005)):
        assert found[bad]["p_toxic"] > 0.5 > found[good]["p_toxic"], (bad, found[bad], found[good])
