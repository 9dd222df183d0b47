import hashlib
import random

import numpy as np
import pytest

from lurewatch.llm import repeats, suffixes


@pytest.mark.parametrize("symbols", [2, 4096])  # with 2, reduced strings are ordered by doubling
def test_suffix_array_and_prefixes(symbols, monkeypatch):
    monkeypatch.setattr(suffixes, "INDUCED_SYMBOLS", symbols)
    rng = random.Random(symbols)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 4, 30])) for _ in range(rng.randint(0, 60))] + [0]
        array = suffixes.suffix_array(np.array(text), 32)
        wanted = sorted(range(len(text)), key=lambda i: text[i:])
        assert array.tolist() == wanted
        lengths = suffixes.common_prefixes(np.array(text), array)
        for one, other in zip(wanted, wanted[1:]):
            n = 0
            while text[one + n] == text[other + n] != 0:
                n += 1
            assert lengths[other] == n


def brute(docs, length):
    seen, out = set(), []
    for doc_id in sorted({i for i, _ in docs}):
        own = []
        for data in [t for i, t in docs if i == doc_id]:
            gone = [False] * len(data)
            for k in range(len(data) - length + 1):
                if data[k:k + length] in seen:
                    gone[k:k + length] = [True] * length
                own.append(data[k:k + length])
            kept = bytes(b for b, g in zip(data, gone) if not g)
            spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
            out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        seen.update(own)
    return out


def corpus():
    rng = random.Random(8)
    letters = "abcdefgh ü🙂"
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice([20, 60, 200]))) for _ in range(10)]
    docs = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(70))
                 for _ in range(rng.randint(0, 4))]
        docs.append((i * 3, "".join(parts)))
    docs += [(1000, None), (1001, ""), (1002, "a" * 20000), (1003, "ab" * 40 + "a" * 300), (1004, docs[7][1]),
             (1005, "short"), (1006, "short"), (21, docs[7][1]), (21, docs[7][1])]
    return docs


def test_removal_against_brute_force(spark, monkeypatch):
    docs = corpus()
    wanted = brute([(i, (t or "").encode()) for i, t in docs], 50)
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_removed int").repartition(5)
    found = sorted(map(tuple, repeats.deduplicated(frame).collect()))
    assert found == sorted(wanted)
    # Many chunks, and names that count as common.
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(repeats, "SHARD_TEXT_BYTES", 3000)
    monkeypatch.setattr(repeats, "COMMON_CHUNKS", 3)
    monkeypatch.setattr(repeats, "COMMON_STRETCHES", 3)
    assert sorted(map(tuple, repeats.deduplicated(frame).collect())) == sorted(wanted)


def test_without_ids_and_empty(spark):
    schema = "doc_id long, text string"
    assert repeats.deduplicated(spark.createDataFrame([], schema)).count() == 0
    text = "0123456789" * 6
    rows = repeats.deduplicated(spark.createDataFrame([(None, text), (5, text), (None, "x")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (0, 60), (5, 0)]
