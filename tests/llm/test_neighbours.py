import heapq
import time

import numpy as np
import pyarrow as pa
import pytest

from lurewatch.llm import neighbours


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    points[700:1200] = points[700]  # one vector has a third of all rows
    rows = [(i, points[i].tolist(), 0) for i in range(len(points))]
    odd = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0] * 15 + [float("inf")], 0),
           (2080, [1.0, None] * 8, 0), (2100, [1.0, 2.0], 0), (None, [1.0] * 16, 0), (2120, [], 0), rows[40]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int").repartition(4)
    found = {}
    for r in neighbours.nearest(frame).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(found) == list(range(0, 1500, 20))
    recall = []
    for q, hits in found.items():
        score = (points * points[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(len(points)), -score)) if i != q][:20]
        assert sorted(hits) == list(range(1, 21))
        listed = [hits[k] for k in range(1, 21)]
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - score[i]) < 1e-9 for i, s in listed)
        recall.append(len({i for i, _ in listed} & set(best)) / 20)
    assert np.mean(recall) >= 0.9


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0])], schema)
    rows = sorted(map(tuple, neighbours.nearest(few).collect()))
    assert rows == [(0, 1, 2, 2.0), (0, 2, 3, 2.0), (0, 3, 1, 1.0)]


def exact(points, q, most=20):
    """The best (id, score) of the other rows by plain Python."""
    scores = sorted((-float(np.dot(points[i], points[q])), i) for i in range(len(points)) if i != q)
    return [(i, -s) for s, i in scores[:most]]


@pytest.mark.parametrize("n", [2, 5, 21, 22, 60])
def test_every_query_lists_all_it_should(spark, n):
    rng = np.random.default_rng(n)
    points = np.array([[1.0, 0.0], [-1.0, 0.0]]) if n == 2 else rng.integers(-9, 10, (n, 3)) + 0.5
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(frame, every=1).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(found) == list(range(n))
    for q, hits in found.items():
        assert sorted(hits) == list(range(1, min(20, n - 1) + 1))
        if n <= 21:  # all candidates: nothing is approximate
            assert [hits[k] for k in sorted(hits)] == exact(points, q)


def test_one_vector_against_copies_of_its_opposite(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [-1.0, 0.0]) for i in range(1, 3000)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0")
    assert sorted(map(tuple, found.collect())) == [(0, k, k, -1.0) for k in range(1, 21)]


def test_other_vectors_of_the_same_id_leave_room(spark):
    rows = [(0, [10.0 + i, 1.0]) for i in range(30)] + [(i, [1.0, float(i)]) for i in range(1, 41)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100)
    assert found.where("query_id = 0").count() == 20


def test_queue_visits_all_leaves_when_asked():
    rng = np.random.default_rng(2)
    sample = rng.standard_normal((200, 5))
    forest = [neighbours.Tree(sample, 4, rng) for _ in range(3)]
    assert sorted(neighbours.searched(forest, sample[0], 48)) == list(range(48))
    first = [t.leaves(sample[:1])[0] + 16 * k for k, t in enumerate(forest)]
    assert set(first) <= set(neighbours.searched(forest, sample[0], 12))


def queue_first(margins, depth, visits):
    """The leaves that a heap of branches gives out first, one by one."""
    inner, found = 2 ** depth - 1, []
    queue = [(0.0, number, 0) for number in range(len(margins))]
    while queue and len(found) < visits:
        away, number, node = heapq.heappop(queue)
        while node < inner:
            near = 2 * node + 1 + (margins[number][node] >= 0)
            heapq.heappush(queue, (max(away, abs(margins[number][node])), number, 4 * node + 3 - near))
            node = near
        found.append(number * (inner + 1) + node - inner)
    return set(found)


@pytest.mark.parametrize("grid", [False, True])  # on a grid many distances to hyperplanes are equal
def test_leaves_met_are_those_of_the_queue(grid):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((200, 4))
    points = np.round(points) if grid else points
    forest = [neighbours.Tree(points, 5, rng) for _ in range(3)]
    margins = [points[:40] @ t.planes.T - t.offsets for t in forest]
    for visits in (1, 2, 5, 20, 61, 95, 96):
        met = neighbours.visited(forest, points[:40], visits)
        for i in range(40):
            assert set(np.flatnonzero(met[i])) == queue_first([m[i] for m in margins], 5, visits)


@pytest.mark.parametrize("kind, scale", [("<f4", 1.0), ("<f8", 1.0), ("<f4", 1e17), ("<f4", 1e-17), ("<f8", 1e30)])
@pytest.mark.parametrize("share", [0.02, 0.5, None])
def test_a_shard_scores_a_pair_once_and_lists_the_best_met(monkeypatch, kind, scale, share):
    monkeypatch.setattr(neighbours, "FIRST_CHUNK", 64)
    monkeypatch.setattr(neighbours, "CHUNK", 256)
    rng = np.random.default_rng(4)
    points = rng.integers(-3, 4, (1200, 6)) + rng.choice([0.0, 0.5], (1200, 6))  # many equal scores
    points[0], points = 1.0, (points * rng.choice([1, 1, 20], (1200, 1)) * scale).astype(kind)
    points = np.unique(points[(points != 0).any(axis=1)], axis=0)
    ids = [sorted(rng.choice(300, rng.integers(1, 4), replace=False).tolist()) for _ in points]
    leaves = np.column_stack([rng.integers(0, 16, len(points)) + 16 * t for t in range(3)]).astype("<i4")
    shard = neighbours.Shard([pa.RecordBatch.from_arrays(
        [pa.array([p.tobytes() for p in points]), pa.array([x.tobytes() for x in leaves]), pa.array(ids, pa.list_(pa.int64()))],
        names=["vector", "leaves", "ids"])], kind, float(np.linalg.norm(points.astype(float), axis=1).max()))
    asked = rng.choice(len(points), 50, replace=False)
    own = np.array([ids[a][0] for a in asked])
    met = None if share is None else rng.random((50, 48)) < share
    scored = []
    merge = neighbours.Shard._merge
    monkeypatch.setattr(neighbours.Shard, "_merge", lambda self, *a: (scored.extend(zip(a[4].tolist(), a[5].tolist())), merge(self, *a)))
    got = {}
    for number, found, score in zip(*shard.best(own, points[asked], met, 7)):
        got.setdefault(number, []).append((-score, found))
    assert len(scored) == len(set(scored))
    for q, a in enumerate(asked):
        near = [v for v in range(len(points)) if met is None or met[q, leaves[v]].any()]
        score = (points[near].astype(float) * points[a].astype(float)).sum(axis=1)
        want = sorted({(-s, i) for s, v in zip(score.tolist(), near) for i in ids[v] if i != own[q]})[:7]
        assert got.get(q, []) == want


def test_time_does_not_grow_with_the_square_of_the_leaves_met(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 3)  # 8192 leaves, of which a query meets 1639
    rng = np.random.default_rng(6)
    points = rng.standard_normal((3000, 8))
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    began = time.monotonic()
    rows = neighbours.nearest(frame, every=1).collect()
    assert time.monotonic() - began < 60
    assert len(rows) == 3000 * 20
    near = {q: {i for i, _ in exact(points, q)} for q in range(0, 50, 2)}
    assert sum(r["vec_id"] in near[r["query_id"]] for r in rows if r["query_id"] in near) >= 0.9 * 25 * 20


def test_vectors_of_one_id_with_one_score_leave_room(spark):
    rows = [(0, [1.0, 0.0])] + [(5, [2.0, float(i)]) for i in range(1, 31)] + [(100 + i, [1.0, float(i)]) for i in range(1, 41)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1000).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 5, 2.0)] + [(0, k, 99 + k, 1.0) for k in range(2, 21)]
