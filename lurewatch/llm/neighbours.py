"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits space by hyperplanes between two sample vectors, at the sample's median. Trees are
fitted on at most ``SAMPLE`` vectors; every vector is then filed under its leaf in every tree. A query
walks all trees with one priority queue, nearest hyperplanes first, until it has met ``SHARE`` of all
leaves; the vectors of those leaves are scored exactly, in double precision, and the best are kept.
Queries that met fewer than they should list (few distinct vectors leave most leaves empty) are then
scored against all vectors, so every query gets ``most`` rows, or all candidates if fewer.

Largest inner products are found as nearest neighbours: every vector gets one more component that
brings it to the largest norm. Equal vectors are filed once, with their smallest ids.

Vectors are dealt to shards, queries to all shards; a task holds one shard and streams its queries,
ordered by their leaf in the first tree. A block of them is multiplied with the vectors that lie in any
leaf one of them met, each once, whatever the number of trees; what is above a query's bound and in a
leaf of its own is scored exactly. The best of a shard go on, ``most`` a query, so neither the shuffle
nor a task grows with the leaves that queries meet.

Vectors without direction (as in the test tables) leave little for trees to cut off: a recall of 0.9
takes more than half of all vectors. On such data the work grows with queries times vectors; data
with clusters allows a smaller ``share``.

Defined results: vectors that are null, empty, zero, of another dimension than most, or hold a null or
non-finite component take no part, nor do rows without id; an empty table gives no rows; rows that
agree in id and vector are one candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lurewatch.llm.common import Sent, stored

NEAREST = 20
TREES = 8
LEAST_DEPTH, MOST_DEPTH = 6, 16
LEAF_ROWS = 1_000
SHARE = 1 / 5
SAMPLE = 10_000
SEED = 7

# A shard has an eighth of the vectors, within these bounds; a task holds one.
SHARD_ROWS, SHARD_BYTES = 65_536, 128 << 20
# Queries multiplied at once, and the entries of what is kept for them by leaf.
BLOCK, BLOCK_LEAVES, SEARCH_LEAVES = 256, 1 << 25, 1 << 19
# Vectors multiplied at once, doubling from the first to the second while the bounds of the queries rise.
FIRST_CHUNK, CHUNK = 512, 8_192
# Components of the pairs scored exactly at once.
PAIRS_WIDE = 1 << 22


class Tree:
    """A full binary tree: hyperplanes in heap order, leaves numbered from left to right."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        planes, offsets, level = [], [], [np.arange(len(sample))]
        for _ in range(depth):
            below = []
            for rows in level:
                if len(rows) >= 2:
                    one, other = sample[rng.choice(rows, 2, replace=False)]
                    plane = one - other
                else:
                    plane = rng.standard_normal(sample.shape[1])
                length = np.linalg.norm(plane)
                plane = plane / length if length > 0 else rng.standard_normal(sample.shape[1])
                side = sample[rows] @ plane
                offset = float(np.median(side)) if len(rows) else 0.0
                planes.append(plane)
                offsets.append(offset)
                below += [rows[side < offset], rows[side >= offset]]
            level = below
        self.planes, self.offsets = np.array(planes), np.array(offsets)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            margin = (points * self.planes[node]).sum(axis=1) - self.offsets[node]
            node = 2 * node + 1 + (margin >= 0)
        return node - (2 ** self.depth - 1)


def visited(trees: list[Tree], points: np.ndarray, visits: int) -> np.ndarray:
    """For each point, which leaves (tree * leaves + leaf) one queue over all trees reaches first.

    A branch's priority is the largest distance to a hyperplane on the wrong side of which it lies; of
    equal ones, the smaller tree and the higher branch come first. The queue gives out leaves in that
    order, so those it reaches first are those before the leaf of place ``visits``."""
    depth, leaves, n = trees[0].depth, 2 ** trees[0].depth, len(points)
    margins = [points @ t.planes.T - t.offsets for t in trees]
    away = np.empty((n, len(trees), leaves))
    for number, margin in enumerate(margins):
        above = np.zeros((n, 1))
        for level in range(depth):
            here = margin[:, 2 ** level - 1:2 ** (level + 1) - 1]
            below = (away[:, number] if level == depth - 1 else np.empty((n, 2 ** (level + 1)))).reshape(n, -1, 2)
            np.maximum(above, here, out=below[:, :, 0])  # ``above`` itself if the point lies there
            np.maximum(above, -here, out=below[:, :, 1])
            above = below.reshape(n, -1)
    away = away.reshape(n, -1)
    if visits >= away.shape[1]:
        return np.ones(away.shape, dtype=bool)
    last = np.partition(away, visits - 1, axis=1)[:, visits - 1:visits]
    met = away <= last
    spare = np.count_nonzero(met, axis=1) - visits
    row, equal = np.divmod(np.flatnonzero(away == last), away.shape[1])
    row, equal = row[spare[row] > 0], equal[spare[row] > 0]
    number, node = equal // leaves, equal % leaves + leaves - 1
    branch, climbs = np.zeros(len(row), dtype=np.int64), np.arange(len(row))
    margins = np.stack(margins) if len(row) else None
    while len(climbs):  # to the last step that led away from the point
        parent = (node[climbs] - 1) // 2
        strays = node[climbs] != 2 * parent + 1 + (margins[number[climbs], row[climbs], parent] >= 0)
        branch[climbs[strays]] = node[climbs[strays]]
        node[climbs] = parent
        climbs = climbs[~strays & (parent > 0)]
    order = np.lexsort((-branch, -number, row))  # the last of a row first
    place = np.arange(len(row)) - np.searchsorted(row, row)
    drop = order[place < spare[row]]
    met[row[drop], equal[drop]] = False
    return met


def searched(trees: list[Tree], point: np.ndarray, visits: int) -> list[int]:
    """The leaves that the queue reaches first for one point, in ascending order."""
    return np.flatnonzero(visited(trees, point[None], visits)[0]).tolist()


def _native(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1)


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    return _native(column, kind).astype(np.float64)


def _raised(points: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that brings them to norm ``top``."""
    rest = np.sqrt(np.maximum(top * top - (points * points).sum(axis=1), 0.0))
    return np.column_stack([points, rest])


def _unit(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths."""
    peak = np.abs(points).max(axis=1, keepdims=True)
    length = np.linalg.norm(points / peak, axis=1, keepdims=True)
    return points / peak / length, (peak * length)[:, 0]


def _directed(points: np.ndarray, top: float) -> np.ndarray:
    """In the raised space a query is a direction; only its own last component is 0."""
    return np.column_stack([_unit(points)[0] * top, np.zeros(len(points))])


class Shard:
    """Some of the vectors, with their ids and the leaf that holds each in every tree."""

    def __init__(self, batches: list[pa.RecordBatch], kind: str, top: float):
        self.data = np.concatenate([_native(b.column("vector"), kind) for b in batches])
        self.leaves = np.concatenate([_native(b.column("leaves"), "<i4") for b in batches])
        lists = [b.column("ids") for b in batches]
        self.ids = np.concatenate([x.flatten().to_numpy() for x in lists])
        self.sizes = np.concatenate([x.value_lengths().to_numpy() for x in lists]).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.twice = len(self.ids) - len(np.unique(self.ids))  # may make equal rows, which count once
        # Rough scores are for bounds only; single precision neither overflows nor vanishes in this range.
        kept = kind == "<f8" or 1e-15 < top < 1e15
        self.rough = self.data if kept else self.data.astype(np.float64)
        self.norms = np.concatenate([
            np.linalg.norm(self.data[at:at + CHUNK].astype(np.float64), axis=1) for at in range(0, len(self.data), CHUNK)])

    def best(self, query_ids: np.ndarray, points: np.ndarray, met: np.ndarray | None, most: int):
        """Query number, id and score of the ``most`` best of each query, among the vectors that lie in a leaf
        which it met (all, if None)."""
        points, size, at = points.astype(np.float64), FIRST_CHUNK, 0
        rough_points, lengths = _unit(points)
        rough_points, single = rough_points.astype(self.rough.dtype), self.sizes == 1
        error = (points.shape[1] + 8) * np.finfo(self.rough.dtype).eps
        rows = np.arange(len(self.data))
        if met is not None:
            rows = rows[met.any(axis=0)[self.leaves].any(axis=1)]
        scores, ids = np.full((len(points), most), -np.inf), np.zeros((len(points), most), dtype=np.int64)
        pairs, due, step = [], FIRST_CHUNK, max(256, PAIRS_WIDE // points.shape[1])
        while at < len(rows):
            part = rows[at:at + size]
            whole = part[-1] - part[0] + 1 == len(part)
            rough = rough_points @ (self.rough[part[0]:part[-1] + 1] if whole else self.rough[part]).T
            slack = error * self.norms[part].max() + points.shape[1] * 1e-44
            least = scores[:, -1] / lengths - slack
            few = np.flatnonzero(scores[:, -1] == -np.inf)
            if len(few):  # no bound yet: that of this part alone
                out = single[part] & (self.ids[self.starts[part]] == query_ids[few, None])
                if met is not None:
                    own = met[few]
                    out |= ~np.logical_or.reduce([own[:, leaf] for leaf in self.leaves[part].T])
                rough[few] = np.where(out, -np.inf, rough[few])
                if len(part) >= (enough := most + self.twice):
                    least[few] = np.partition(rough[few], -enough, axis=1)[:, -enough] - 2 * slack
            least = np.nextafter(least.astype(rough.dtype), rough.dtype.type(-np.inf))
            above = rough >= np.maximum(least, np.finfo(rough.dtype).min)[:, None]
            query, place = np.divmod(np.flatnonzero(above), len(part))
            vector = part[place]
            if met is not None:
                own = met.ravel().take(query[:, None] * met.shape[1] + self.leaves[vector]).any(axis=1)
                query, vector = query[own], vector[own]
            pairs.append((query, vector))
            at += size
            size = min(CHUNK, at)
            if at >= min(due, len(rows)) or sum(len(x) for x, _ in pairs) > step:
                query, vector = map(np.concatenate, zip(*pairs))
                for first in range(0, len(query), step):
                    self._merge(scores, ids, query_ids, points, query[first:first + step], vector[first:first + step])
                pairs, due = [], 2 * at
        number, rank = np.nonzero(scores > -np.inf)
        return number, ids[number, rank], scores[number, rank]

    def _merge(self, scores, ids, query_ids, points, query, vector) -> None:
        """Scores the pairs and takes them up among the best, distinct ones by score and id."""
        score = (self.data[vector].astype(np.float64) * points[query]).sum(axis=1)
        size = self.sizes[vector]
        pair = np.repeat(np.arange(len(query)), size)
        found = self.ids[self.starts[vector][pair] + np.arange(len(pair)) - (np.cumsum(size) - size)[pair]]
        other = found != query_ids[query[pair]]
        pair, found = pair[other], found[other]
        old, rank = np.nonzero(scores > -np.inf)
        query = np.concatenate([old, query[pair]])
        lack = -np.concatenate([scores[old, rank], score[pair]])
        found = np.concatenate([ids[old, rank], found])
        order = np.lexsort((lack, query))
        if ((query[order[1:]] == query[order[:-1]]) & (lack[order[1:]] == lack[order[:-1]])).any():
            order = np.lexsort((found, lack, query))
        query, lack, found = query[order], lack[order], found[order]
        new = np.ones(len(query), dtype=bool)
        new[1:] = (query[1:] != query[:-1]) | (lack[1:] != lack[:-1]) | (found[1:] != found[:-1])
        query, lack, found = query[new], lack[new], found[new]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < scores.shape[1]
        scores[query[kept], rank[kept]], ids[query[kept], rank[kept]] = -lack[kept], found[kept]


def nearest(vectors: DataFrame, most: int = NEAREST, every: int = 20, trees: int = TREES,
            share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """The ``most`` nearest found of each query, a row whose id is divisible by ``every``.

    ``vectors`` has ``vec_id`` and ``embedding``. Returns query_id, rank, vec_id, score."""
    item = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if item == "float" else "<f8"
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull())

    def valid(rows: DataFrame) -> DataFrame:
        return rows.where(whole & F.exists("embedding", lambda x: x != 0))

    shapes = valid(vectors).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = shapes[0]["n"] if shapes else 1

    def packed(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            flat = flat + np.zeros(1, dtype=kind)  # -0.0 becomes 0.0
            data = [row.tobytes() for row in flat.reshape(-1, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["vec_id", "vector"])

    def points(rows: DataFrame) -> DataFrame:
        return valid(rows).where(F.size("embedding") == width).mapInArrow(
            packed, "vec_id long, vector binary").distinct()

    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    filed = stored(points(vectors).withColumn("_place", place).where(F.col("_place") <= most + 1).groupBy("vector").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")), "filed")  # at most ``most`` + 1 ids
    queries = stored(points(vectors.where(F.col("vec_id") % every == 0)).select(
        F.col("vec_id").alias("query_id"), "vector"), "queries")
    count, candidates = filed.agg(F.count("*"), F.sum(F.size("ids"))).first()

    def norms(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array((_matrix(batch.column(0), kind) ** 2).sum(axis=1))], names=["square"])

    top = float(np.sqrt(filed.select("vector").mapInArrow(norms, "square double").agg(F.max("square")).first()[0] or 0.0))
    seen = filed.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()
    depth = int(np.clip(np.ceil(np.log2(max(1, count) / LEAF_ROWS)), LEAST_DEPTH, MOST_DEPTH))
    rng = np.random.default_rng(SEED)
    fitted = _raised(np.frombuffer(b"".join(r["vector"] for r in seen), dtype=kind).astype(np.float64).reshape(-1, width), top)
    forest = Sent(vectors.sparkSession, [Tree(fitted, depth, rng) for _ in range(trees)])
    leaves = trees * 2 ** depth
    visits = max(1, int(np.ceil(leaves * share)))
    block, step = int(np.clip(BLOCK_LEAVES // leaves, 1, BLOCK)), max(16, SEARCH_LEAVES // leaves)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    most_rows = min(max(SHARD_ROWS, count // 8), max(1, SHARD_BYTES // (width * int(kind[-1]))))
    shards = int(max(1, np.ceil(count / most_rows), min(np.ceil(np.sqrt(2 * cores)), count // LEAF_ROWS)))

    def file(batches):
        grown = forest.load()
        for batch in batches:
            raised = _raised(_matrix(batch.column(0), kind), top)
            leaf = np.column_stack([tree.leaves(raised) + number * 2 ** depth for number, tree in enumerate(grown)])
            data = [row.tobytes() for row in leaf.astype("<i4")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["vector", "ids", "leaves"])

    def ask(batches):
        first = forest.load()[0]
        for batch in batches:
            leaf = first.leaves(_directed(_matrix(batch.column(1), kind), top))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(leaf, pa.int32())], names=["query_id", "vector", "spot"])

    def copied(number: int):
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    def best_of(asked: DataFrame, all_leaves: bool) -> DataFrame:
        """The best found of each query: query_id, rank, vec_id, score."""
        groups = int(np.clip(np.ceil(2 * cores / shards), 1, max(1, np.ceil(asked.count() / BLOCK))))

        def score(batches):
            grown, held, shard = forest.load(), [], None
            for batch in batches:
                start = int(np.searchsorted(batch.column("spot").to_numpy(), 0))
                if start:
                    held.append(batch.slice(0, start))
                if start < batch.num_rows and held:
                    shard, held = Shard(held, kind, top), []
                for at in range(start, batch.num_rows if shard else 0, block):
                    rows = batch.slice(at, block)
                    ids, points = rows.column("ids").flatten().to_numpy(), _native(rows.column("vector"), kind)
                    met = None if all_leaves else np.concatenate([
                        visited(grown, _directed(points[i:i + step].astype(np.float64), top), visits)
                        for i in range(0, len(points), step)])
                    number, found, scores = shard.best(ids, points, met, most)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[number]), pa.array(-scores), pa.array(found)], names=["query_id", "lack", "vec_id"])

        of_vector = F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")
        of_query = F.pmod(F.xxhash64("query_id", "vector"), F.lit(groups)).cast("int")
        index = filed.mapInArrow(file, "vector binary, ids array<long>, leaves binary").withColumn("_copy", copied(groups))
        asked = asked.mapInArrow(ask, "query_id long, vector binary, spot int").withColumn("_copy", copied(shards))
        units = index.select(
            (of_vector * groups + F.col("_copy")).alias("unit"), F.lit(-1).alias("spot"), "ids", "vector", "leaves"
        ).unionByName(asked.select(
            (F.col("_copy") * groups + of_query).alias("unit"), "spot", F.array("query_id").alias("ids"), "vector",
            F.lit(None).cast("binary").alias("leaves")))
        scored = units.repartitionById(shards * groups, "unit").sortWithinPartitions("spot").mapInArrow(
            score, "query_id long, lack double, vec_id long")
        # A query has ``most`` rows of each shard; equal rows are of several vectors with one id.
        rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("lack", "vec_id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= most).distinct().select(
            "query_id", "rank", "vec_id", (-F.col("lack")).alias("score"))

    met = stored(best_of(queries, all_leaves=False), "met")
    least = min(most, (candidates or 0) - 1)
    short = stored(queries.join(met.groupBy("query_id").agg(F.max("rank").alias("_met")), "query_id", "left").where(
        F.coalesce("_met", F.lit(0)) < least).select("query_id", "vector"), "short")
    if not short.isEmpty():
        met = met.join(short.select("query_id"), "query_id", "left_anti").unionByName(best_of(short, all_leaves=True))
    return met
