"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

Every document becomes its token ids and a closing id; longer ones are cut into full pieces and a
last shorter one. Pieces are placed, longest first, where the sum over all gaps of the squared number
of open sequences with that gap becomes smallest; full pieces are sequences of their own.

Each task packs the pieces of its own input, at most ``ROUND`` at a time, so no row moves. Sequences
that stay open are then packed once more, as units, in groups of at most about ``ROUND``.

Defined results: a null or empty text is its closing id alone; a null id stays null; repeated rows are
packed each; an empty table gives no sequences.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import small_batches, stored

LENGTH = 2048
CLOSING_ID = 0
VOCABULARY = "word_bpe_49k.json"

# Pieces that one task packs together; bounds the arrays a task holds.
ROUND = 100_000

# Distinct words and parts of words whose ids a worker remembers.
REMEMBERED = 700_000

# How the vocabulary file splits lower-cased text, for ASCII and Latin-1 letters.
WORD_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
PLAIN_WORD = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
PYTHON_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python only

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "sequence_id long, offset long, unit_length long")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset of every item.

    ``count[f]`` is the number of open sequences filled to ``f``. Moving one from ``f`` to ``f + s``
    changes the sum of squares by 2 * (count[f + s] - count[f]) + 2; a new sequence or a full one
    leaves out the term of the empty or full side."""
    order = np.argsort(-lengths, kind="stable")
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    count = np.zeros(size + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    made = 0
    for item, s in zip(order.tolist(), lengths[order].tolist()):
        if s == size:
            sequence[item] = made
            made += 1
            continue
        # Over the fills f that leave room: new sequences (f = 0), then the open ones.
        top = size - s
        change = 2 * (count[s:size + 1] - count[:top + 1]) + 2
        change[0] = 2 * count[s] + 1
        change[top] = -2 * count[top] + 1
        change[1:top + 1][count[1:top + 1] == 0] = np.iinfo(np.int64).max
        fill = top - int(np.argmin(change[::-1]))  # ties to the fullest
        if fill:
            chosen = open_at[fill].pop()
            count[fill] -= 1
        else:
            chosen = made
            made += 1
        sequence[item], offset[item] = chosen, fill
        if fill + s < size:
            open_at[fill + s].append(chosen)
            count[fill + s] += 1
    return sequence, offset


class Remembered(dict):
    """Values made on first use; forgets everything when full, so its memory is bounded."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def word_ids(path: str):
    """A function from a text to its ids as little-endian bytes.

    The vocabulary splits at white space before anything else, so a text's ids are those of its
    words. Words of printable ASCII and Latin-1 letters are lower-cased and split here by the
    vocabulary's own rule and only their parts looked up; all others go to the tokenizer whole."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def packed_ids(ids) -> bytes:
        return array("I", ids).tobytes()  # little-endian on all machines that Spark runs on

    def of_part(part: str) -> bytes:
        symbols = part if part.isascii() else as_bytes(part)[0][0]
        return packed_ids([token.id for token in model.tokenize(symbols)])

    parts = Remembered(of_part)

    def of_word(word: str) -> bytes:
        if word.isascii():  # a word, perhaps with one sign behind it, needs no splitting
            if word.isalpha():
                return parts[word.lower()]
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return parts[word[:-1].lower()] + parts[word[-1]]
        if PLAIN_WORD.fullmatch(word) and "<|" not in word:
            return b"".join([parts[p] for p in WORD_PARTS.findall(word.lower())])
        return packed_ids(tokenizer.encode(word, add_special_tokens=False).ids)

    words = Remembered(of_word)

    def ids(text: str) -> bytes:
        if PYTHON_SPACE.search(text):
            return packed_ids(tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join([words[w] for w in text.split()])

    return ids


def _pieces(learnt, path: str, size: int, closing: int, round_: int):
    def pack(batches):
        if path not in learnt.value:  # the first task of this worker
            learnt.value[path] = word_ids(path)
        ids = learnt.value[path]
        close = np.array([closing], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        made = 0

        def flush():
            nonlocal made
            lengths = np.array([r[3] for r in rows], dtype=np.int64)
            sequence, offset = sum_of_squares(lengths, size)
            full = np.bincount(sequence, weights=lengths).astype(np.int64)
            doc, piece, start, length, crc = zip(*rows)
            out = pa.RecordBatch.from_arrays([
                pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                pa.array(sequence + (base + made)), pa.array(offset), pa.array(full[sequence]),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      "unit_length"])
            made += len(full)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = ids(text or "") + close
                for number, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at:at + 4 * size]
                    rows.append((doc, number, at // 4, len(part) // 4, zlib.crc32(part)))
                if len(rows) >= round_:
                    yield flush()
        if rows:
            yield flush()

    return pack


def _units(size: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("sequence_id")
        sequence, offset = sum_of_squares(table["unit_length"].to_numpy(), size)
        old = table["sequence_id"].to_numpy()
        first = np.full(sequence.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, sequence, old)  # named by the smallest of its units
        return pa.table({"sequence_id": old, "_into": first[sequence], "_at": offset})

    return pack


def packed(docs: DataFrame, size: int = LENGTH, closing: int = CLOSING_ID,
           vocabulary: str | None = None, round_: int = ROUND) -> DataFrame:
    """One row per piece with its sequence and place."""
    import public_tokenizers

    small_batches(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    # A worker loads a broadcast value once; its tasks share there the words they have looked up.
    learnt = docs.sparkSession.sparkContext.broadcast({})
    pieces = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _pieces(learnt, path, size, closing, round_), PIECES), "pieces")
    # A unit with room for the shortest unit may be joined with others.
    shortest = pieces.agg(F.min("unit_length")).first()[0] or 0
    units = pieces.where((F.col("offset") == 0) & (F.col("unit_length") + shortest <= size)).select(
        "sequence_id", "unit_length")
    groups = max(1, -(-units.count() // round_))
    spread = F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("_group")
    moved = units.withColumn("_group", spread).groupBy("_group").applyInArrow(
        _units(size), "sequence_id long, _into long, _at long")
    joined = pieces.join(moved, "sequence_id", "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("_into", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("_at", F.lit(0))).alias("offset"))
