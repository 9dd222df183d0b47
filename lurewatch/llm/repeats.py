"""Removal of repeated byte strings by suffix arrays.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller
id. Strings are judged on the whole input.

Where such strings can be is found first. Every window of ``LENGTH`` bytes is named by the smallest
hash of its k-byte substrings, so equal windows have equal names, and neighbouring windows mostly
share one. Only stretches of windows whose name occurs in two documents go on. A shard holds all
stretches of its names. Its suffix array is built by induced sorting, common prefixes follow in
text order, and suffixes that share ``LENGTH`` bytes form a group, whose smallest id decides.

Documents are dealt out in chunks by their text; a chunk's rows are shuffled once and read three
times (naming, cutting stretches, removing). Tasks hand on packed arrays per chunk and shard. Equal
texts meet in one chunk and are treated as one: all but the smallest id lose everything. Within a
task's input such copies already leave before the shuffle. A chunk sends a stretch once, however
often it holds it. A name that many chunks share has its stretches cut into single windows, which are
dealt out by their bytes, so that no shard gets all surroundings of a common passage.

Defined results: a null or empty text has no bytes; texts under ``LENGTH`` bytes stay; documents without
id count as later than all others, and not as earlier than one another; rows that agree in id are one
document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import small_batches
from lurewatch.llm.suffixes import common_prefixes, suffix_array

LENGTH = 50
GRAM = 25

# Target sizes, by which chunks and shards are counted; they follow from the bytes of all texts.
CHUNK_BYTES = 4 << 20
SHARD_TEXT_BYTES = 2 << 20

# A name is common when so many chunks, or so many stretches of one chunk, have it.
COMMON_CHUNKS = 1024
COMMON_STRETCHES = 256

NO_ID = (1 << 63) - 1
SLICE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15

ROWS = "chunk long, doc_id long, n_bytes long, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_FORWARD = _powers(_MULTIPLIER, SLICE + 4096)
_BACK = _powers(pow(_MULTIPLIER, -1, 1 << 64), SLICE + 4096)


def window_names(data: bytes, length: int, gram: int) -> np.ndarray:
    """The name of every window of ``length`` bytes: the smallest hash of its ``gram``-byte substrings."""
    total = max(0, len(data) - length + 1)
    names = np.empty(total, dtype=np.uint64)
    grams = length - gram + 1
    for at in range(0, total, SLICE):
        count = min(SLICE, total - at)
        piece = np.frombuffer(data, dtype=np.uint8, count=count + length - 1, offset=at)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _FORWARD[:len(piece)], out=sums[1:])
        least = (sums[gram:] - sums[:-gram]) * _BACK[:len(piece) - gram + 1]
        least ^= least >> np.uint64(31)
        least *= np.uint64(0xBF58476D1CE4E5B9)
        least ^= least >> np.uint64(29)
        width = 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[:len(least) - (grams - width)], least[grams - width:])
        names[at:at + count] = least
    return names


class Chunk:
    """The distinct texts of a chunk, one after the other, and their stretches of equal names."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        ids, sizes = table["doc_id"].to_numpy(), table["n_bytes"].to_numpy()
        data = table["data"].to_pylist()
        texts = sorted((i for i, d in enumerate(data) if d is not None), key=lambda i: (ids[i], data[i]))
        first: dict[bytes, int] = {}
        self.copies = [(int(ids[i]), int(sizes[i])) for i, d in enumerate(data) if d is None]
        rows = []
        for i in texts:
            if ids[first.setdefault(data[i], i)] < ids[i] and sizes[i] >= length:
                self.copies.append((int(ids[i]), int(sizes[i])))
            else:
                rows.append(i)
        self.ids = ids[rows]
        self.data = b"".join([data[i] for i in rows])
        self.ends = np.cumsum(np.array([len(data[i]) for i in rows], dtype=np.int64))
        self.starts = self.ends - np.array([len(data[i]) for i in rows], dtype=np.int64)
        self.length = length

        names = window_names(self.data, length, gram)
        cut = np.zeros(len(names) + 1, dtype=bool)
        cut[1:-1] = names[1:] != names[:-1]
        cut[0] = True
        cut[self.starts[self.starts < len(names)]] = True
        over = np.maximum(self.ends - length + 1, self.starts)  # the first window that would cross
        cut[over[over < len(names)]] = True
        begin = np.flatnonzero(cut[:-1])
        end = np.concatenate([begin[1:], [len(names)]]) if len(begin) else begin
        document = np.searchsorted(self.ends, begin, side="right")
        inside = begin + length <= self.ends[document] if len(begin) else np.zeros(0, dtype=bool)
        self.begin, self.end, self.document = begin[inside], end[inside], document[inside]
        # 46 bits name a stretch; two more are used for marks.
        self.name = names[self.begin] >> np.uint64(18)

    def owner(self, place: int) -> int:
        return int(self.ids[np.searchsorted(self.ends, place, side="right")])

    def stretches(self, shared: np.ndarray, common: np.ndarray, shards: int) -> Stretches:
        """The distinct strings of stretches with shared names; those of common names window by window."""
        at = np.minimum(np.searchsorted(shared, self.name), max(0, len(shared) - 1))
        hits = np.flatnonzero(shared[at] == self.name) if len(shared) else np.zeros(0, dtype=np.int64)
        out, data, length = Stretches(), self.data, self.length
        cut = common[at[hits]] if len(hits) else common
        for begin, end, name, single in zip(self.begin[hits].tolist(), self.end[hits].tolist(),
                                            self.name[hits].tolist(), cut.tolist()):
            if single:
                for place in range(begin, end):
                    string = data[place:place + length]
                    out.add(string, place, zlib.crc32(string) % shards)
            else:
                out.add(data[begin:end + length - 1], begin, (name >> 9) % shards)
        return out.ordered(self)


class Stretches:
    """Distinct strings by shard. The first place of a string is in its smallest document."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.shard: list[int] = []
        self.place: list[int] = []
        self.more: dict[int, list[int]] = {}

    def add(self, string: bytes, place: int, shard: int) -> None:
        number = self.index.setdefault(string, len(self.place))
        if number < len(self.place):
            self.more.setdefault(number, []).append(place)
        else:
            self.shard.append(shard)
            self.place.append(place)

    def ordered(self, chunk: Chunk) -> Stretches:
        self.strings = list(self.index)
        self.place = np.array(self.place, dtype=np.int64)
        self.owner = chunk.ids[np.searchsorted(chunk.ends, self.place, side="right")] if len(self.place) else self.place
        self.windows = np.array([len(s) for s in self.strings], dtype=np.int64) - chunk.length + 1
        shard = np.array(self.shard, dtype=np.int64)
        order = np.argsort(shard, kind="stable")
        held, first = np.unique(shard[order], return_index=True)
        self.by_shard = dict(zip(held.tolist(), np.split(order, first[1:])))
        return self


def _six(values: np.ndarray) -> bytes:
    """The low six bytes of each value."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def _dealt(chunks: int, length: int):
    """Rows with their chunk. Copies of a text with a smaller id in the same input lose the text."""

    def run(batches):
        least: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = NO_ID if doc_id is None else doc_id
                data = text or b""
                key = hashlib.md5(data).digest()
                if len(data) >= length and own > least.get(key, NO_ID):
                    rows.append((own % chunks, own, len(data), None))
                    continue
                least[key] = own
                rows.append((int.from_bytes(key[:7], "little") % chunks, own, len(data), data))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.binary()])],
                names=["chunk", "doc_id", "n_bytes", "data"])

    return run


def _named(length: int, gram: int, buckets: int):
    """A chunk's names by bucket, with marks for names of several documents and of many stretches."""

    def run(table: pa.Table) -> pa.Table:
        number = table["chunk"][0].as_py()
        chunk = Chunk(table, length, gram)
        order = np.lexsort((chunk.document, chunk.name))
        name, owner = chunk.name[order], chunk.ids[chunk.document[order]] if len(order) else order
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, int)
        sizes = np.diff(np.concatenate([first, [len(name)]]))
        values = name[first] << np.uint64(2)
        if len(first):
            values |= (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)).astype(np.uint64)
            values |= (sizes >= COMMON_STRETCHES).astype(np.uint64) << np.uint64(1)
        bucket = (name[first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        held = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        return pa.table({
            "bucket": pa.array(held, pa.int64()), "chunk": pa.array([number] * len(held), pa.int64()),
            "names": pa.array([_six(values[order[edges[b]:edges[b + 1]]]) for b in held], pa.binary())})

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The names of a bucket that several documents have, back to each chunk that has them."""
    parts = [_from_six(d) for d in table["names"].to_pylist()]
    chunks = table["chunk"].to_pylist()
    values = np.concatenate(parts)
    source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    name = values >> np.uint64(2)
    order = np.argsort(name, kind="stable")
    sorted_name = name[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_name[1:] != sorted_name[:-1]]))
    count = np.diff(np.concatenate([first, [len(order)]]))
    marks = np.bitwise_or.reduceat((values & np.uint64(3))[order], first)
    wanted = (count > 1) | (marks & np.uint64(1) > 0)
    common = (count >= COMMON_CHUNKS) | (marks & np.uint64(2) > 0)
    group = np.repeat(np.arange(len(first)), count)
    keep = wanted[group]
    answer = (sorted_name[keep] << np.uint64(2)) | common[group[keep]].astype(np.uint64)
    source = source[order][keep]
    by_source = np.argsort(source, kind="stable")
    edges = np.searchsorted(source[by_source], np.arange(len(parts) + 1))
    held = [i for i in range(len(parts)) if edges[i] < edges[i + 1]]
    return pa.table({
        "chunk": pa.array([chunks[i] for i in held], pa.int64()),
        "names": pa.array([_six(answer[by_source[edges[i]:edges[i + 1]]]) for i in held], pa.binary())})


def _shared_names(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [_from_six(d) for d in table["names"].to_pylist()]
    values = np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)
    return values >> np.uint64(2), (values & np.uint64(1)).astype(bool)


def _cut(length: int, gram: int, shards: int):
    """A chunk's stretches by shard: strings, their lengths and the smallest id that has each."""

    def run(table: pa.Table, names: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and names.num_rows:
            number, chunk = table["chunk"][0].as_py(), Chunk(table, length, gram)
            found = chunk.stretches(*_shared_names(names), shards)
            for shard, held in found.by_shard.items():
                strings = [found.strings[i] for i in held.tolist()]
                out.append((shard, number, b"".join(strings), np.array([len(s) for s in strings], "<u4").tobytes(),
                            found.owner[held].astype("<i8").tobytes()))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(
            ["shard", "chunk", "strings", "lengths", "owners"], columns, kinds)})

    return run


def least_owners(strings: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string, the smallest owner of an equal window among all strings.

    Returns the windows' values one string after the other, and where each string's begin."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.frombuffer(b"\0".join(strings) + b"\0\0", dtype=np.uint8).astype(np.int64) + 2
    text[begins[1:] - 1] = 1  # between strings
    text[-1] = 0
    array = suffix_array(text, 258, int(sizes.max()) + 1)
    # The order of suffixes is needed up to the end of their string only.
    prefixes = common_prefixes(np.where(text == 1, 0, text), array)
    owner = np.repeat(np.append(owners, NO_ID), np.append(sizes + 1, 1))
    group = np.flatnonzero(prefixes[array] < length)  # the first suffix of each group
    least = np.minimum.reduceat(owner[array], group)
    by_place = np.empty(len(text), dtype=np.int64)
    by_place[array] = np.repeat(least, np.diff(np.concatenate([group, [len(array)]])))
    windows = sizes - length + 1
    starts = np.concatenate([[0], np.cumsum(windows)])
    places = np.repeat(begins[:-1] - starts[:-1], windows) + np.arange(starts[-1])
    return by_place[places], starts


def _judged(length: int):
    """For each chunk's strings, which windows have an earlier owner than the chunk's own."""

    def run(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        numbers, owners = [], []
        for data, sizes, ids in zip(*(table[c].to_pylist() for c in ("strings", "lengths", "owners"))):
            ends = np.cumsum(np.frombuffer(sizes, dtype="<u4").astype(np.int64)).tolist()
            strings = [data[a:b] for a, b in zip([0, *ends], ends)]
            numbers.append(np.array([known.setdefault(s, len(known)) for s in strings], dtype=np.int64))
            owners.append(np.frombuffer(ids, dtype="<i8"))
        least = np.full(len(known), NO_ID, dtype=np.int64)
        np.minimum.at(least, np.concatenate(numbers), np.concatenate(owners))
        values, starts = least_owners(list(known), least, length)
        answers = []
        for number, own in zip(numbers, owners):
            windows = np.diff(starts)[number]
            begin = np.concatenate([[0], np.cumsum(windows)])
            places = np.repeat(starts[number] - begin[:-1], windows) + np.arange(begin[-1])
            answers.append(np.packbits(values[places] < np.repeat(own, windows)).tobytes())
        return pa.table({"chunk": table["chunk"], "shard": table["shard"], "earlier": pa.array(answers, pa.binary())})

    return run


def _removed(length: int, gram: int, shards: int):
    """Every document of a chunk without the bytes of its repeated windows."""

    def run(table: pa.Table, names: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            chunk = Chunk(table, length, gram)
            judged = names.filter(names["earlier"].is_valid()) if names.num_rows else names
            asked = names.filter(names["names"].is_valid()) if names.num_rows else names
            begins, ends = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]  # stretches that go
            if asked.num_rows:
                found = chunk.stretches(*_shared_names(asked), shards)
                for shard, earlier in zip(judged["shard"].to_pylist(), judged["earlier"].to_pylist()):
                    held = found.by_shard[shard]
                    windows = found.windows[held]
                    first = np.concatenate([[0], np.cumsum(windows)])
                    bits = np.unpackbits(np.frombuffer(earlier, dtype=np.uint8), count=int(first[-1])).astype(bool)
                    places = np.repeat(found.place[held] - first[:-1], windows) + np.arange(first[-1])
                    begins.append(places[bits])
                    ends.append(places[bits] + length)
                    for i, number in enumerate(held.tolist()):
                        for place in found.more.get(number, ()):
                            if chunk.owner(place) == found.owner[number]:
                                own = np.flatnonzero(bits[first[i]:first[i + 1]]) + place
                                begins.append(own)
                                ends.append(own + length)
                            else:
                                begins.append(np.array([place]))
                                ends.append(np.array([place + windows[i] - 1 + length]))
            size = len(chunk.data) + 1
            depth = np.bincount(np.concatenate(begins), minlength=size) - np.bincount(
                np.concatenate(ends), minlength=size)
            gone = np.cumsum(depth[:-1]) > 0
            data = np.frombuffer(chunk.data, dtype=np.uint8)
            for doc_id, begin, end in zip(chunk.ids.tolist(), chunk.starts.tolist(), chunk.ends.tolist()):
                mask = gone[begin:end]
                spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                kept = data[begin:end][~mask].tobytes() if spans else chunk.data[begin:end]
                rows.append((doc_id, end - begin, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
            for doc_id, size in chunk.copies:
                rows.append((doc_id, size, size, 1, NOTHING))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(RESULT.split(", "), columns, kinds)})

    return run


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: its bytes, what is removed, and the digest of what stays.

    ``docs`` has ``doc_id`` and ``text``."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    total = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    chunks = total // CHUNK_BYTES + 1
    buckets = total // CHUNK_BYTES // 4 + 1
    shards = total // SHARD_TEXT_BYTES + 1
    dealt = texts.mapInArrow(_dealt(chunks, length), ROWS)
    chunked = dealt.groupBy("chunk")
    named = chunked.applyInArrow(_named(length, gram, buckets), "bucket long, chunk long, names binary")
    shared = named.groupBy("bucket").applyInArrow(_shared, "chunk long, names binary")
    strings = chunked.cogroup(shared.groupBy("chunk")).applyInArrow(
        _cut(length, gram, shards), "shard long, chunk long, strings binary, lengths binary, owners binary")
    judged = strings.groupBy("shard").applyInArrow(_judged(length), "chunk long, shard long, earlier binary")
    both = shared.select("chunk", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("earlier"),
                         "names").union(judged.select("chunk", "shard", "earlier", F.lit(None).cast("binary")))
    found = chunked.cogroup(both.groupBy("chunk")).applyInArrow(_removed(length, gram, shards), RESULT)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
