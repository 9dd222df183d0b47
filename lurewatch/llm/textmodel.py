"""Hashed text features and small linear models on bounded labelled samples.

A run between white space is a feature as a whole and by its beginnings, and so is each of its letter
sequences if it holds other characters. What no spaces divide (runs over ``LONGEST`` characters, letter
sequences over ``LONG_WORD``, scripts without spaces) is a feature by all its overlapping pieces as well,
so every character of a text takes part, wherever it stands."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import small_batches

BITS = 20
PREFIXES = (4, 5)

# Longer runs count as several words of this length, and as overlapping pieces.
LONGEST = 64
# Letter sequences longer than this count as overlapping pieces as well.
LONG_WORD = 20
# Characters of a piece: as many as a word's beginnings have, so that pieces and beginnings share weights.
PIECES = PREFIXES
# From this character on most scripts have no spaces between words, and words are shorter.
UNSPACED, SHORT_PIECES = "\u0e00", (2, 3, 4, 5)
# Pieces of a long run are made from blocks of this many characters.
PIECE_BLOCK = 1 << 16

# Shares of a document's words at which a shape's density feature changes.
DENSITIES = (0.01, 0.05, 0.2, 0.5)

# Labelled documents a model is fitted on at most; which ones depends on a hash of their ids only.
SAMPLE = 8_000

# A feature needs this many sample documents to get a weight.
LEAST_DOCUMENTS = 3

# Features whose documents differ from the others by fewer standard errors get no weight.
LEAST_SCORE = 3.0

REMEMBERED_WORDS = 300_000

_EDGES = re.compile(r"^\W+|\W+$")
_RUNS = re.compile(r"(.)\1+")
_LETTERS = re.compile(r"[^\W\d_]+")


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _shape(word: str) -> str:
    marks = "".join("U" if c.isupper() else "l" if c.isalpha() else "9" if c.isdigit() else c
                    for c in word)
    return _RUNS.sub(r"\1", marks)[:6]


def _named(core: str) -> list[str]:
    """A word's own feature and those of its beginnings."""
    return [f"w:{core}"] + [f"{n}:{core[:n]}" for n in PREFIXES if len(core) > n]


def _pieces(core: str) -> set[int]:
    """The features of all overlapping pieces of a word or run."""
    found: set[int] = set()
    for n in SHORT_PIECES if max(core) >= UNSPACED else PIECES:
        for at in range(0, max(0, len(core) - n + 1), PIECE_BLOCK):
            block = core[at:at + PIECE_BLOCK + n - 1]
            found.update([_hash(f"{n}:{p}") for p in {block[i:i + n] for i in range(len(block) - n + 1)}])
    return found


def _whole(run: str) -> set[int]:
    """The features of a run's presence."""
    alphabetic = run.isalpha()
    core = run.lower() if alphabetic else _EDGES.sub("", run).lower()
    if not core:
        return set()
    names, long = _named(core), len(core) > LONGEST
    found = _pieces(core) if long else set()
    for part in [core] if alphabetic else _LETTERS.findall(core):
        if part != core:
            names += _named(part)
        if not long and (len(part) > LONG_WORD or not part.isascii() and max(part) >= UNSPACED):
            found |= _pieces(part)
    return found.union(map(_hash, names))


def _form(word: str) -> str:
    return "l" if word.isalpha() and word.islower() else "U" if word.isalpha() and word.isupper() else _shape(word)


class Features:
    """Distinct feature numbers of whole texts. Remembers words, within a bound.

    ``useful`` marks the features a model has weights for; words without any are passed quickly."""

    def __init__(self, useful: np.ndarray | None = None):
        self.words: dict[str, tuple] = {}
        self.useful = None if useful is None else set(np.flatnonzero(useful).tolist())

    def _known(self, found: set[int]) -> set[int]:
        return found if self.useful is None else found & self.useful

    def of(self, text: str) -> np.ndarray:
        words, found = text.split(), set()
        if words and len(max(words, key=len)) > LONGEST:
            for run in {w for w in words if len(w) > LONGEST}:
                found |= self._known(_whole(run))
            # Shapes and repetitions count the run's parts.
            words = [w[at:at + LONGEST] for w in words for at in range(0, len(w), LONGEST)]
            counts, runs = Counter(words), {w for w in text.split() if len(w) <= LONGEST}
        else:
            counts, runs = Counter(words), None
        known, shapes = self.words, Counter()
        for word, count in counts.items():
            if runs is not None and word not in runs:
                shapes[_form(word)] += count
                continue
            entry = known.get(word)
            if entry is None:
                entry = tuple(self._known(_whole(word))), _form(word)
                if len(known) >= REMEMBERED_WORDS:
                    known.clear()
                known[word] = entry
            if entry[0]:
                found.update(entry[0])
            shapes[entry[1]] += count
        total = max(1, len(words))
        for shape, count in shapes.items():
            found.add(_hash(f"s:{shape}:{np.searchsorted(DENSITIES, count / total)}"))
        repeated = sum(map(eq, words, words[1:])) / total
        found.add(_hash(f"r:{np.searchsorted(DENSITIES, repeated)}"))
        found.add(_hash(f"d:{int(10 * len(counts) / total)}:{len(words).bit_length()}"))
        return np.fromiter(found, dtype=np.int64, count=len(found))


class Sample:
    """Binary features of labelled documents, numbered anew so that only common ones are kept."""

    def __init__(self, rows: list[np.ndarray]):
        flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
        seen = np.bincount(flat, minlength=1 << BITS)
        self.kept = np.flatnonzero(seen >= min(LEAST_DOCUMENTS, max(1, len(rows))))
        place = np.full(1 << BITS, -1, dtype=np.int64)
        place[self.kept] = np.arange(len(self.kept))
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        column = place[flat]
        self.row, self.column = row[column >= 0], column[column >= 0]
        self.rows, self.width = len(rows), len(self.kept)
        self.scale = np.ones(self.width)

    def telling(self, target: np.ndarray, used: np.ndarray) -> Sample:
        """The sample with only the features whose rows' mean target stands out by ``LEAST_SCORE``
        standard errors, each scaled by that score, so that a penalty on weights favours features
        seen often over ones that are rare and fit by accident."""
        count = self.back(used)
        mean = float(used @ target) / max(1.0, used.sum())
        spread = float(np.sqrt(used @ (target - mean) ** 2 / max(1.0, used.sum()))) or 1.0
        score = np.abs(self.back(used * (target - mean))) / np.sqrt(np.maximum(count, 1)) / spread
        part = object.__new__(Sample)
        kept = np.flatnonzero(score >= LEAST_SCORE)
        place = np.full(self.width, -1, dtype=np.int64)
        place[kept] = np.arange(len(kept))
        inside = place[self.column] >= 0
        part.kept, part.scale = self.kept[kept], score[kept] / 10
        part.row, part.column = self.row[inside], place[self.column[inside]]
        part.rows, part.width = self.rows, len(kept)
        return part

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=(weights * self.scale)[self.column], minlength=self.rows)

    def back(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=residual[self.row], minlength=self.width) * self.scale

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """Weights by hashed number."""
        full = np.zeros(1 << BITS, dtype=np.float64)
        full[self.kept] = weights * self.scale
        return full


def minimise(loss, start: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking; ``loss`` gives value and gradient."""
    point = start.copy()
    value, gradient = loss(point)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, used = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            used.append(a)
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, float(np.linalg.norm(gradient)))
        for (s, y), a in zip(steps, reversed(used)):
            direction += (a - (y @ direction) / (s @ y)) * s
        slope, size = float(gradient @ direction), 1.0
        while True:
            nearer = point - size * direction
            new_value, new_gradient = loss(nearer)
            if new_value <= value - 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        s, y = nearer - point, new_gradient - gradient
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1:], (s, y)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        point, value, gradient = nearer, new_value, new_gradient
        if done:
            break
    return point


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _features_of(batches):
    features = Features()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([features.of(t or "").astype("<i4").tobytes() for t in texts], pa.binary())],
            names=["doc_id", "features"])


def labelled(docs: DataFrame, labels: DataFrame, wanted: dict[str, Column], most: int = SAMPLE):
    """Features and label arrays of a bounded sample of labelled documents.

    Rows without id or without one of the labels are passed over; of repeated ids the smallest
    labels count, and the text whose feature numbers sort first. The sample is the ``most`` smallest hashes of ids."""
    small_batches(docs.sparkSession)
    marks = labels.select("doc_id", *[c.alias(n) for n, c in wanted.items()]).dropna()
    marks = marks.groupBy("doc_id").agg(*[F.min(n).alias(n) for n in wanted])
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(
        F.broadcast(chosen.select(F.col("doc_id").cast("long"))), "doc_id")
    features = texts.mapInArrow(_features_of, "doc_id long, features binary").groupBy("doc_id").agg(
        F.min("features").alias("features"))
    rows = features.join(chosen, "doc_id").collect()  # at most ``most``
    rows.sort(key=lambda r: r["doc_id"])
    data = [np.frombuffer(r["features"], dtype="<i4").astype(np.int64) for r in rows]
    return Sample(data), {n: np.array([r[n] for r in rows]) for n in wanted}
