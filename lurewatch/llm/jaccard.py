"""Similarity join of texts by the Jaccard similarity of their word n-grams.

Texts that share a band of minimum hashes are linked to the smallest of them, which makes candidate
groups. Inside a group, every two texts are compared: minimum hashes are looked at a few at a time,
and a pair is dropped as soon as the posterior probability that its similarity reaches the threshold
(uniform prior, binomial matches) is below ``TOLERANCE``; the rest is verified on the whole sets.

Equal texts are one text with several documents. A candidate group of more than ``BLOCK`` texts is cut
into blocks, and every two blocks are compared in a task of their own.

Words are separated by white space and lower-cased. Defined results: a null text is empty; a text of
fewer words than an n-gram has one n-gram of all its words; texts without words are linked only to
equal texts; a document without id is known by its text; rows that agree in id and text are one document;
rows that agree in id only are documents of their own, of which the one whose text has the smallest MD5
goes by the id and the others by a number made from id and text; an empty table gives no rows.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import matched, small_batches, stored
from lurewatch.llm.components import components

WORDS = 5
SIMILARITY = 0.8
TOLERANCE = 1e-6

# At the threshold, two texts share no band with probability (1 - 0.8 ** 8) ** 64 < 1e-5.
BANDS, ROWS = 64, 8
STEP, MOST_HASHES = 16, 128

BLOCK = 1_000
CHUNK_TEXTS = 2_000
REMEMBERED_WORDS = 500_000


class Shingler:
    """Sorted 64-bit hashes of a text's n-grams, and their minimum hashes."""

    def __init__(self, words: int, hashes: int):
        rng = np.random.default_rng(20240611)
        self.words = words
        self.mix = (rng.integers(0, 1 << 63, words, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.factor = rng.integers(0, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32)[:, None]
        self.known: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(known) > REMEMBERED_WORDS:
                known.clear()
            for word in words:
                if word not in known:
                    known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, text: str) -> np.ndarray:
        words = self._hashes(text.lower().split())
        if not len(words):
            return words
        width = min(self.words, len(words))
        count = len(words) - width + 1
        total = np.full(count, width, dtype=np.uint64)
        for i in range(width):
            total += words[i:i + count] * self.mix[i]
            total ^= total >> np.uint64(29)
            total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
        return np.unique(total)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        folded = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        least = np.full(len(self.factor), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(folded), 512):
            np.minimum(least, (folded[None, at:at + 512] * self.factor + self.shift).min(axis=1), out=least)
        return least


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per text and band from the band's minimum hashes."""
    rng = np.random.default_rng(20240613)
    factors = (rng.integers(0, 1 << 63, rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    values = minima.reshape(len(minima), bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        keys = (keys ^ values[:, :, i]) * factors[i]
        keys ^= keys >> np.uint64(31)
    return keys


LINKED = 1
KEYED = 0


def _keyed(words: int, bands: int, rows: int):
    """Band keys of texts. Texts of one chunk that share a key are linked here; one goes on."""

    def emit(ids: list[int], minima: list[np.ndarray]) -> pa.RecordBatch:
        keys = band_keys(np.array(minima), bands, rows).ravel()
        nodes = np.repeat(np.array(ids, dtype=np.int64), bands)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        least = nodes[np.flatnonzero(first)[np.cumsum(first) - 1]]
        inside = ~first & (nodes != least)
        pairs = np.unique(np.column_stack([nodes[inside], least[inside]]), axis=0)
        kind = np.concatenate([np.full(first.sum(), KEYED), np.full(len(pairs), LINKED)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array(kind), pa.array(np.concatenate([keys[first].view(np.int64), pairs[:, 0]])),
            pa.array(np.concatenate([nodes[first], pairs[:, 1]]))], names=["kind", "a", "b"])

    def run(batches):
        shingler = Shingler(words, bands * rows)
        ids, minima = [], []
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shingles = shingler.shingles(text or "")
                if len(shingles):
                    ids.append(node)
                    minima.append(shingler.minima(shingles))
                if len(ids) >= CHUNK_TEXTS:
                    yield emit(ids, minima)
                    ids, minima = [], []
        if ids:
            yield emit(ids, minima)

    return run


def _stars(batches):
    """Rows sorted by key and node: every node but the first of a key is linked to the first."""
    last_key, last_node = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.concatenate([[last_key is None or keys[0] != last_key], keys[1:] != keys[:-1]])
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        least = np.where(run < 0, last_node if last_node is not None else 0, nodes[starts[run]] if len(starts) else 0)
        last_key, last_node = keys[-1], int(least[-1])
        far = nodes != least
        pairs = np.unique(np.column_stack([nodes[far], least[far]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def least_matches(similarity: float, tolerance: float, step: int, most: int) -> list[int]:
    """For 1, 2, ... steps of minimum hashes, how many must agree for a pair to stay.

    With a uniform prior, m agreements in n hashes give P(similarity >= t) as the probability of at
    most m successes in n + 1 trials of probability t."""
    bounds = []
    for n in range(step, most + 1, step):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * similarity ** m * (1 - similarity) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        bounds.append(m)
    return bounds


def candidates(one: np.ndarray, other: np.ndarray, bounds: list[int], same: bool):
    """Index pairs whose minimum hashes do not rule the threshold out."""
    matches = np.zeros((len(one), len(other)), dtype=np.uint8)
    for h in range(STEP):
        matches += one[:, h][:, None] == other[:, h][None, :]
    left, right = np.nonzero(matches >= bounds[0])
    if same:
        left, right = left[left < right], right[left < right]
    agreed = matches[left, right].astype(np.int32)
    for round_, bound in enumerate(bounds[1:], 1):
        part = slice(round_ * STEP, (round_ + 1) * STEP)
        for at in range(0, len(left), 100_000):  # bounds the compared copies
            span = slice(at, at + 100_000)
            agreed[span] += (one[left[span], part] == other[right[span], part]).sum(axis=1, dtype=np.int32)
        stays = agreed >= bound
        left, right, agreed = left[stays], right[stays], agreed[stays]
    return left, right


def verified(sets_one: list[np.ndarray], sets_other: list[np.ndarray], left: np.ndarray, right: np.ndarray,
             similarity: float) -> np.ndarray:
    """Which of the pairs reach the similarity, from the whole sets.

    Common n-grams are counted by products of membership matrices over the n-grams that occur in
    both sides, some thousand at a time."""
    if not len(left):
        return np.zeros(0, dtype=bool)
    rows_one, rows_other = np.unique(left), np.unique(right)
    flat_one = np.concatenate([sets_one[i] for i in rows_one])
    flat_other = np.concatenate([sets_other[i] for i in rows_other])
    both = np.intersect1d(flat_one, flat_other)
    common = np.zeros((len(rows_one), len(rows_other)), dtype=np.float32)

    def places(flat, sets, rows):
        at = np.searchsorted(both, flat)
        hit = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == flat) if len(both) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    at_one, row_one = places(flat_one, sets_one, rows_one)
    at_other, row_other = places(flat_other, sets_other, rows_other)
    width = 2048
    for begin in range(0, len(both), width):
        blocks = []
        for at, row, rows in ((at_one, row_one, rows_one), (at_other, row_other, rows_other)):
            span = slice(*np.searchsorted(at, [begin, begin + width]))
            block = np.zeros((len(rows), width), dtype=np.float32)
            block[row[span], at[span] - begin] = 1
            blocks.append(block)
        common += blocks[0] @ blocks[1].T
    shared = common[np.searchsorted(rows_one, left), np.searchsorted(rows_other, right)].astype(np.int64)
    size_one = np.array([len(s) for s in sets_one])[left]
    size_other = np.array([len(s) for s in sets_other])[right]
    return shared >= similarity * (size_one + size_other - shared) - 1e-9


def local_labels(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(count)
    while len(left):
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _compared(words: int, similarity: float, tolerance: float):
    bounds = least_matches(similarity, tolerance, STEP, MOST_HASHES)

    def compare(table: pa.Table) -> pa.Table:
        shingler = Shingler(words, MOST_HASHES)
        table = table.sort_by([("group", "ascending"), ("node", "ascending")])
        group, node = table["group"].to_numpy(), table["node"].to_numpy()
        keep = np.concatenate([[True], (node[1:] != node[:-1]) | (group[1:] != group[:-1])])
        at = np.flatnonzero(keep)
        group, node, block = group[at], node[at], table["block"].to_numpy()[at]
        copies = table["copies"].to_numpy()[at]
        texts = table["text"].take(pa.array(at)).to_pylist()
        sets = [shingler.shingles(t or "") for t in texts]
        minima = np.array([shingler.minima(s) for s in sets])
        out = []
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for begin, end in zip(edges[:-1], edges[1:]):
            blocks = np.unique(block[begin:end])
            one = np.arange(begin, end)[block[begin:end] == blocks[0]]
            if len(blocks) == 1:
                left, right = candidates(minima[one], minima[one], bounds, True)
                left, right = one[left], one[right]
            else:
                other = np.arange(begin, end)[block[begin:end] == blocks[1]]
                left, right = candidates(minima[one], minima[other], bounds, False)
                left, right = one[left], other[right]
            held = verified(sets, sets, left, right, similarity)
            left, right = left[held], right[held]
            n = end - begin
            label = local_labels(n, left - begin, right - begin) + begin
            linked = np.concatenate([left, right]) - begin
            texts_n = np.bincount(linked, minlength=n)
            docs_n = np.bincount(linked, weights=copies[np.concatenate([right, left])], minlength=n)
            out.append((node[begin:end], node[label], texts_n, docs_n.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"node": columns[0], "label": columns[1], "texts": columns[2], "docs": columns[3]})

    return compare


def identified(docs: DataFrame) -> DataFrame:
    """Add ``node``: the document's id, or a negative number made from its text where there is none or
    another text goes by it."""
    made = -1 - F.expr("xxhash64(coalesce(text, ''), doc_id) & 4611686018427387903")
    key = F.md5(F.coalesce("text", F.lit("")))
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"), key.alias("_key")).where("_id IS NOT NULL")
    several = ids.groupBy("_id").agg(F.min("_key").alias("_own"), F.max("_key").alias("_last")).where("_own <> _last")
    several = stored(several.select("_id", "_own"), "several")
    rows = docs.withColumn("_id", F.col("doc_id").cast("long"))
    if several.isEmpty():
        return rows.withColumn("node", F.coalesce("_id", made)).drop("_id")
    rows = matched(rows, several, "_id").withColumn("node", F.when(F.col("_own") != key, made).otherwise(F.coalesce("_id", made)))
    return rows.drop("_id", "_own")


def classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY,
            tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id`` (its node if it has none), ``node``, ``class_id`` (the smallest node
    of its class), ``n_links`` (other documents at the similarity or more) and ``n_text_links`` (of other
    texts). ``docs`` needs ``doc_id`` and ``text``."""
    return _classes(identified(docs.select("doc_id", "text")), words, similarity, tolerance, block)


def _classes(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY,
             tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    small_batches(rows.sparkSession)
    texts = rows.select("node", "text")
    given = F.coalesce(F.col("doc_id").cast("long"), F.col("node")).alias("doc_id")
    named = stored(rows.select(given, "node", F.md5(F.coalesce("text", F.lit(""))).alias("key")).distinct(), "texts")
    # Stored, so that the join below is one of two shuffles, which can be split at a common text.
    equal = stored(named.groupBy("key").agg(F.min("node").alias("text_node"), F.count("*").alias("copies")), "equal")
    members = stored(named.join(equal, "key").select("doc_id", "node", "text_node", "copies"), "members")

    keyed = texts.mapInArrow(_keyed(words, BANDS, ROWS), "kind int, a long, b long")
    keyed = stored(keyed, "band_keys")
    links = keyed.where(f"kind = {LINKED}").select("a", "b").union(
        keyed.where(f"kind = {KEYED}").select("a", "b").repartition("a").sortWithinPartitions(
            "a", "b").mapInArrow(_stars, "a long, b long"))
    groups = components(links)

    # Texts in groups of at least two. Large groups are cut into blocks, small ones share tasks.
    one_each = members.where("node = text_node").select("node", "copies").distinct()
    placed = one_each.join(groups.select(F.col("a").alias("node"), F.col("b").alias("group")), "node", "left")
    placed = stored(placed.withColumn("group", F.coalesce("group", "node")), "groups")
    # Stored for the same reason as the copies above: a large group's rows can then be split.
    sizes = stored(placed.groupBy("group").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    routed = placed.join(sizes, "group").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    routed = routed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    shared = F.pmod(F.xxhash64("group"), F.lit(max(1, total // block)))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least("block", other).alias("low"), F.greatest("block", other).alias("high"))))
    tasks = texts.join(routed, "node").select("*", pair.alias("pair")).withColumn(
        "task", F.when(F.col("blocks") == 1, shared).otherwise(F.xxhash64("group", "pair")))
    found = stored(tasks.groupBy("task").applyInArrow(
        _compared(words, similarity, tolerance), "node long, label long, texts long, docs long"), "verified")
    counts = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    same = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    solved = counts.join(same.select(F.col("a").alias("node"), F.col("b").alias("least")), "node", "left")
    return members.join(solved.withColumnRenamed("node", "text_node"), "text_node", "left").select(
        "doc_id", "node", F.coalesce("least", "text_node").alias("class_id"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with all columns: the one whose identity names the class."""
    rows = identified(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text"))
    chosen = _classes(rows.select("doc_id", "text", "node"), **options).where("node = class_id").select("node").distinct()
    return rows.join(chosen, "node", "left_semi").dropDuplicates(["node"]).select("_row.*")
