"""Lempel-Ziv phrase fingerprints of documents, and what an edit does to them.

A text's UTF-8 bytes are parsed from left to right into phrases, each the longest known phrase and
one more byte. The set of phrases is hashed and summed up by minimum hashes; the share of equal
minima estimates the Jaccard similarity of two phrase sets, which follows how well one text would
compress with the other's dictionary.

Documents are compared with the next one by id. Blocks of consecutive ids go to one task each, and
the first document of a block is also sent to the block before it, so texts are shuffled once.

Defined results: a null text is empty; an empty text has no phrases and the fingerprint of the empty
set, alike only to itself; the last document is followed by the first, a single one by itself; among
equal ids the order is that of the texts; a document without id has no neighbours and follows itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import small_batches

MINIMA = 64
BLOCK_ROWS = 4096
MOST_BLOCKS = 100_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


class Phrases:
    """A parse under way: ``lengths`` of its phrases, and the dictionary as a tree.

    A node is 256 times its number; node + byte leads to the child."""

    def __init__(self):
        self.tree: dict[int, int] = {}
        self.node, self.depth = 0, [0]
        self.lengths: list[int] = []

    def copy(self) -> Phrases:
        other = Phrases()
        other.tree, other.node = self.tree.copy(), self.node
        other.depth, other.lengths = self.depth.copy(), self.lengths.copy()
        return other

    def extend(self, data: bytes) -> Phrases:
        tree, depth, lengths, node = self.tree, self.depth, self.lengths, self.node
        child, number = tree.get, len(depth) << 8
        for byte in data:
            found = child(node + byte)
            if found:
                node = found
            else:
                tree[node + byte] = number
                number += 256
                length = depth[node >> 8] + 1
                depth.append(length)
                lengths.append(length)
                node = 0
        self.node = node
        return self


class Signer:
    """Minimum-hash signatures of phrase sets."""

    def __init__(self, minima: int):
        rng = np.random.default_rng(20240607)
        self.factor = (rng.integers(1, 1 << 32, minima, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
        self.shift = rng.integers(0, 1 << 32, minima, dtype=np.uint64).astype(np.uint32)[:, None]
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 2 * len(self.powers))
            step = np.full(size, _MULTIPLIER, dtype=np.uint64)
            back = np.full(size, pow(_MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
            step[0] = back[0] = 1
            self.powers, self.inverses = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def sign(self, data: bytes, lengths: list[int]) -> np.ndarray:
        """``data``'s phrases are the consecutive runs of ``lengths``; a rest is not a new phrase."""
        if not lengths:
            return np.full(len(self.factor), 0xFFFFFFFF, dtype=np.uint32)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        self._grow(len(data) + 1)
        values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values * self.powers[:len(data)], out=sums[1:])
        mixed = (sums[ends] - sums[starts]) * self.inverses[starts]  # polynomial of each phrase
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        folded = (mixed >> np.uint64(32)).astype(np.uint32)
        least = None
        for at in range(0, len(folded), 4096):
            part = (folded[None, at:at + 4096] * self.factor + self.shift).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        return least


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float(np.mean(one == other))


class Document:
    """A text's own fingerprint, and the parse of the part that an edit keeps."""

    def __init__(self, signer: Signer, text: str):
        self.signer, self.text = signer, text
        self.kept = text[:len(text) - len(text) // 2]
        data = text.encode("utf-8", "surrogatepass")
        self.head = Phrases().extend(self.kept.encode("utf-8", "surrogatepass"))
        rest = text[len(self.kept):].encode("utf-8", "surrogatepass")
        self.signature = signer.sign(data, self.head.copy().extend(rest).lengths)

    def row(self, doc_id, following: Document) -> tuple:
        taken = following.text[:len(self.text) // 2]
        edited = (self.kept + taken).encode("utf-8", "surrogatepass")
        phrases = self.head.extend(taken.encode("utf-8", "surrogatepass"))  # its last use
        signature = self.signer.sign(edited, phrases.lengths)
        return (doc_id, len(self.text), hashlib.sha256(edited).hexdigest(), as_text(self.signature),
                as_text(signature), likeness(self.signature, signature),
                likeness(self.signature, following.signature))


def _fingerprints(minima: int):
    """Rows come sorted by block and id; in a block the first document of the next block is last."""

    def run(batches):
        signer = Signer(minima)
        names = RESULT.split(", ")
        before, block = None, None
        for batch in batches:
            rows = []
            for at, role, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                document = Document(signer, text or "")
                if role == ALONE:
                    rows.append(document.row(doc_id, document))
                    continue
                if before is not None and at == block:
                    rows.append(before[1].row(before[0], document))
                before = (doc_id, document) if role == OWN else None
                block = at
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=[n.split()[0] for n in names])

    return run


OWN, FOLLOWER, ALONE = 0, 1, 2


def _in_blocks(bounds: list[int], follower_of: dict[int, int]):
    """Add block and role; the first document of a block is also the follower in the one before."""
    edges = np.array(bounds, dtype=np.int64)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            given = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy()
            block = np.searchsorted(edges, values, side="right").astype(np.int64)
            role = np.where(given, OWN, ALONE).astype(np.int32)
            alone = np.flatnonzero(~given)
            block[alone] = (alone * 7919 + 1) % (len(edges) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(role), ids, batch.column(1)], names=["block", "role", "doc_id", "text"])
            first = [i for i, v in enumerate(values.tolist()) if given[i] and v in follower_of]
            if first:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([follower_of[int(values[i])] for i in first], pa.int64()),
                     pa.array([FOLLOWER] * len(first), pa.int32()),
                     ids.take(pa.array(first)), batch.column(1).take(pa.array(first))],
                    names=["block", "role", "doc_id", "text"])

    return run


def fingerprinted(docs: DataFrame, minima: int = MINIMA, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document with its fingerprint and those of its edited text and neighbour."""
    small_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    blocks = min(MOST_BLOCKS, ids.count() // block_rows + 1)
    bounds: list[int] = []
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 100 * blocks)).first()[0]))

    def firsts(batches):  # the smallest id of each block in each batch
        edges = np.array(bounds, dtype=np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy()
            block = np.searchsorted(edges, values, side="right")
            seen = np.unique(block)
            least = [int(values[block == b].min()) for b in seen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.astype(np.int64)), pa.array(least, pa.int64())], names=["block", "first"])

    found = ids.mapInArrow(firsts, "block long, first long").groupBy("block").agg(
        F.min("first").alias("first")).orderBy("block").collect()  # one row per block
    follower_of = {row["first"]: found[i - 1]["block"] for i, row in enumerate(found)}
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _in_blocks(bounds, follower_of), "block long, role int, doc_id long, text string")
    # A task for each block: by a hash of the number several blocks would share one.
    return placed.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions(
        "block", "role", "doc_id", "text").mapInArrow(_fingerprints(minima), RESULT)
