"""Every stage of the pipeline against plain Python on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from lurewatch.llm import mixing, toxicity
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import spans

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        out.append(docs)
    return out


def rows(frame):
    return sorted(map(tuple, frame.select(COLUMNS).collect()))


def test_stages_return_documents(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    for frame in results[:-1]:
        assert frame.columns == COLUMNS


def test_toxic_documents_leave(spark, results):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    gone = {r["doc_id"] for r in toxicity.judged(results[0], labels).where("rejected").collect()}
    assert rows(results[1]) == [r for r in rows(results[0]) if r[0] not in gone]
    assert len(gone) < 0.2 * results[0].count()


def test_one_of_each_group_stays(results):
    docs = {r[0]: r[1] for r in rows(results[1])}
    kept = {c for c, _, _ in brute(docs).values()}
    assert rows(results[2]) == [r for r in rows(results[1]) if r[0] in kept]


def test_secrets_are_masked(results):
    before, after = rows(results[2]), rows(results[3])
    assert [r[0] for r in before] == [r[0] for r in after]
    for old, new in zip(before, after):
        assert (old == new) == (not spans(old[1]))
        assert new[4] == len(new[1])


def test_mix_takes_whole_documents(results):
    taken = Counter(r["doc_id"] for r in mixing.mix(results[3]).collect() for _ in range(r["repeats"]))
    assert Counter(r[0] for r in rows(results[4])) == taken
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows(results[3])}
    assert abs(sum(size[i] * n for i, n in taken.items()) / sum(size.values()) - 1) < 0.2


def test_pieces_hold_the_mix(results):
    pieces = results[5].collect()
    assert Counter(p["doc_id"] for p in pieces if p["piece"] == 0) == Counter(r[0] for r in rows(results[4]))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:]))
        assert sum(n for _, n in places) <= 2048
