"""Benchmark decontamination: a generalised suffix automaton of the test items reads the training texts.

Items and texts become words: A-Z is lower-cased, ASCII letters, digits and everything beyond ASCII
belong to words. The automaton holds every run of words of any item; a text's words are streamed
through it while the longest run that ends at the word is tracked. A text word is hit when it lies in
an occurrence of a window: ``window`` consecutive words of an item, or all of an item with fewer.

Items are cut to pieces that overlap by a window's length less one, and dealt to blocks of about
``BLOCK_WORDS`` words. Each block's automaton is built in a task, and one at a time goes to the tasks
that read the texts, so its size is bounded; a larger benchmark costs one pass over the texts for each
block, whose hits are added to those before. Texts are never shuffled.

Defined results: a null or empty text has no words and no hits; an item without words is in no text; an
item without id is searched but not listed; repeated items with one id are one item; repeated documents
are judged each; without items nothing is hit; an empty table gives no rows. A column of the input with
the name of the result is replaced.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.llm.common import small_batches, stored

WINDOW = 10
BLOCK_WORDS = 400_000
PIECE_WORDS = 50_000

WORD = re.compile("[a-zA-Z0-9\x80-\U0010ffff]+")
_PLAIN = (string.ascii_lowercase + string.digits).encode()
_FOLDED = bytes(b if b >= 128 or b in _PLAIN else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))

FOUND = ("struct<n_words:bigint,n_hit:bigint,longest:bigint,"
         "spans:array<struct<start:bigint,end:bigint>>,items:array<string>>")
_PIECE = "item string, words array<binary>"
_BLOCK = ("words array<binary>, state array<int>, word array<int>, target array<int>, link array<int>, "
          "length array<int>, item_ids array<string>, full_state array<int>, full_item array<int>, "
          "short_state array<int>, short_item array<int>, short_length array<int>")


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(_FOLDED).split() if data else []


class Automaton:
    """The smallest automaton of all runs of words of several items."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, before: int, word: int) -> int:
        """The state for the runs of ``before`` and ``word``, split off if its state has longer ones."""
        there = self.next[before][word]
        if self.length[there] == self.length[before] + 1:
            return there
        own = self._state(self.length[before] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = own
        while before >= 0 and self.next[before].get(word) == there:
            self.next[before][word] = own
            before = self.link[before]
        return own

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:  # known from another item
                last = self._split(last, word)
                continue
            state, before = self._state(self.length[last] + 1, 0, {}), last
            while before >= 0 and word not in self.next[before]:
                self.next[before][word] = state
                before = self.link[before]
            if before >= 0:
                self.link[state] = self._split(before, word)
            last = state


class Reader:
    """Follows a text through a flattened automaton."""

    def __init__(self, block: dict, window: int):
        self.size = max(1, len(block["words"]))
        self.number = {w: i for i, w in enumerate(block["words"])}
        keys = np.asarray(block["state"], np.int64) * self.size + np.asarray(block["word"], np.int64)
        self.go = dict(zip(keys.tolist(), block["target"]))
        self.link, self.length, self.window = list(block["link"]), list(block["length"]), window
        self.item_ids = block["item_ids"]
        self.full: dict[int, list[int]] = {}
        for state, item in zip(block["full_state"], block["full_item"]):
            self.full.setdefault(state, []).append(item)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for state, item, length in zip(block["short_state"], block["short_item"], block["short_length"]):
            self.short.setdefault(state, []).append((length, item))
        shortest = min([length for found in self.short.values() for length, _ in found], default=window)
        self.least = min(window, shortest) if self.full or self.short else 0
        # For each state: where along its links the window's own state is, and the next one with a short item.
        self.at_window, self.at_short = [0] * len(self.link), [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[state]
            if self.length[state] >= window:
                self.at_window[state] = state if self.length[above] < window else self.at_window[above]
            self.at_short[state] = state if state in self.short else self.at_short[above]

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The state and length of the longest run that ends with ``word``."""
        go, size, link = self.go.get, self.size, self.link
        target = go(state * size + word)
        while target is None and state:
            state = link[state]
            length = self.length[state]
            target = go(state * size + word)
        return (0, 0) if target is None else (target, length + 1)

    def read(self, words: list[bytes]) -> tuple[list[list[int]], set[int], int]:
        """Hit spans of words (end exclusive), items with occurring windows, and the longest run."""
        number, go, size, link, lengths = self.number.get, self.go.get, self.size, self.link, self.length
        spans: list[list[int]] = []
        items: set[int] = set()
        seen: set[int] = set()
        state = length = longest = 0
        least = self.least
        if not least:
            return spans, items, longest
        for at, word in enumerate(map(number, words)):
            if word is None:
                state = length = 0
                continue
            target = go(state * size + word)
            while target is None and state:
                state = link[state]
                length = lengths[state]
                target = go(state * size + word)
            if target is None:
                continue
            state = target
            length += 1
            if length > longest:
                longest = length
            if length < least:
                continue
            reach = 0
            if length >= self.window:
                reach = self.window
                own = self.at_window[state]
                if own not in seen:
                    seen.add(own)
                    items.update(self.full[own])
            short = self.at_short[state]
            while short:
                for size_, item in self.short[short]:
                    if size_ <= length:
                        items.add(item)
                        reach = max(reach, size_)
                short = self.at_short[link[short]]
            if reach:
                spans.append([at + 1 - reach, at + 1])
                while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                    end = spans.pop()
                    spans[-1] = [min(spans[-1][0], end[0]), end[1]]
        return spans, items, longest


def _pieces(window: int, most: int):
    def run(batches):
        for batch in batches:
            ids, pieces = [], []
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(data)
                for at in range(0, max(len(words) - window, 0) + 1, most):
                    if words:
                        ids.append(item)
                        pieces.append(words[at:at + most + window - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(pieces, pa.list_(pa.binary()))], names=["item", "words"])

    return run


def _built(window: int):
    """One row: the automaton of a block's items, flattened."""

    def build(block: pa.Table) -> pa.Table:
        ids = block["item"].to_pylist()
        item_ids = sorted({i for i in ids if i is not None})
        item_number = {i: n for n, i in enumerate(item_ids)}
        number: dict[bytes, int] = {}
        items = [[number.setdefault(w, len(number)) for w in words] for words in block["words"].to_pylist()]
        automaton = Automaton()
        for words in items:
            automaton.add(words)
        moves = [(s, w, t) for s, following in enumerate(automaton.next) for w, t in following.items()]
        state, word, target = (list(c) for c in zip(*moves)) if moves else ([], [], [])
        flat = {"words": list(number), "state": state, "word": word, "target": target,
                "link": [max(x, 0) for x in automaton.link], "length": automaton.length, "item_ids": item_ids,
                "full_state": [], "full_item": [], "short_state": [], "short_item": [], "short_length": []}
        reader = Reader(flat, window)
        full, short = set(), set()
        for item, words in zip(ids, items):  # where each item's windows are; -1 for items without id
            name, at, length = item_number.get(item, -1), 0, 0
            for w in words:
                at, length = reader.step(at, length, w)
                if length >= window:
                    full.add((reader.at_window[at], name))
            if len(words) < window:
                short.add((at, name, len(words)))
        flat["full_state"], flat["full_item"] = [s for s, _ in sorted(full)], [i for _, i in sorted(full)]
        for column, key in enumerate(("short_state", "short_item", "short_length")):
            flat[key] = [entry[column] for entry in sorted(short)]
        names = [f.split()[0] for f in _BLOCK.split(", ")]
        kinds = {"words": pa.binary(), "item_ids": pa.string()}
        return pa.table([pa.array([flat[n]], pa.list_(kinds.get(n, pa.int32()))) for n in names], names=names)

    return build


def blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The automata of ``items`` (item_id, text), a row for each block."""
    pieces = stored(items.select(F.col("item_id").cast("string"), "text").mapInArrow(
        _pieces(window, PIECE_WORDS), _PIECE), "items")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    block = F.pmod(F.xxhash64("item", "words"), F.lit(-(-total // block_words) or 1))
    return stored(pieces.withColumn("_block", block).groupBy("_block").applyInArrow(_built(window), _BLOCK), "automata")


def _read(names: list[str], text_at: int, found_at: int, window: int, packed):
    """Append the hits in the texts, or add them to the hits of earlier blocks in column ``found_at``."""

    def run(batches):
        reader = Reader(packed.value, window) if packed else None
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            earlier = batch.column(found_at).to_pylist() if found_at >= 0 else [None] * len(texts)
            found = []
            for data, old in zip(texts, earlier):
                words = words_of(data)
                spans, items, longest = reader.read(words) if reader else ([], (), 0)
                ids = {reader.item_ids[i] for i in items if i >= 0}
                if old:
                    spans = _joined(spans + [[s["start"], s["end"]] for s in old["spans"]])
                    ids, longest = ids | set(old["items"]), max(longest, old["longest"])
                found.append({"n_words": len(words), "n_hit": sum(e - s for s, e in spans), "longest": longest,
                              "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(ids)})
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()),
                              ("spans", span), ("items", pa.list_(pa.string()))])
            columns = [c for i, c in enumerate(batch.columns) if i != found_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=names)

    return run


def _joined(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def scanned(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
            text: str = "text", into: str = "contamination") -> DataFrame:
    """The documents with column ``into``: number of words, of hit words, the longest run shared with an
    item, hit spans (by word, end exclusive) and the ids of items with occurring windows."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != into]
    out = docs.select(*kept)
    result = T.StructType([*out.schema.fields, T.StructField(into, T.StructType.fromDDL(f"x {FOUND}")["x"].dataType)])
    automata = blocks(items, window, block_words)
    rows = automata.toLocalIterator()  # one block at a time, of bounded size
    at, read = kept.index(text), 0
    for row in rows:
        packed = docs.sparkSession.sparkContext.broadcast(row.asDict())
        if read:
            out = stored(out, "scanned")  # so that no task holds two automata
        out = out.mapInArrow(_read(result.names, at, len(kept) if read else -1, window, packed), result)
        read += 1
    return out if read else out.mapInArrow(_read(result.names, at, -1, window, None), result)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_hit: float = 0.5,
                   longest_span: int = 0, block_words: int = BLOCK_WORDS, into: str = "contamination") -> DataFrame:
    """The documents without the hit spans of over ``longest_span`` words; documents of whose words more
    than the share ``most_hit`` is hit go as a whole. ``n_chars`` follows the new text."""
    found = scanned(docs, items, window, block_words, into=into)
    share = F.col(f"{into}.n_hit") / F.greatest(F.col(f"{into}.n_words"), F.lit(1))

    @F.pandas_udf("string")
    def cut(texts, spans):
        def without(text, own):
            places = [m.span() for m in WORD.finditer(text)]
            kept, at = [], 0
            for span in own:
                kept.append(text[at:places[span["start"]][0]])
                at = places[span["end"] - 1][1]
            return "".join(kept) + text[at:]

        import pandas as pd

        return pd.Series([without(t, s) if t and len(s) else t for t, s in zip(texts, spans)])

    long = F.filter(F.col(f"{into}.spans"), lambda s: s["end"] - s["start"] > longest_span)
    out = found.where(share <= most_hit).withColumn("text", F.when(F.size(long) > 0, cut("text", long)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[c for c in docs.columns if c != into], into)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts and a digest of the items of each document."""
    found = scanned(docs.select("doc_id", "text"), items).select("doc_id", "contamination.*")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def oracle() -> str:
    """The report in DuckDB's SQL, by joining all windows of all lengths that occur."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase

    def words(column: str) -> str:
        return f"regexp_extract_all(translate(coalesce({column}, ''), '{upper}', '{lower}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS ws FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, {words('text')} AS ws FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS k FROM (
    SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM (
      SELECT *, least(len(ws), {WINDOW}) AS m FROM items WHERE len(ws) > 0))),
places AS (
  SELECT r, m, i, array_to_string(ws[i:i + m - 1], ' ') AS k FROM (
    SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows))),
hits AS MATERIALIZED (SELECT r, m, i, item_id FROM places JOIN windows USING (m, k)),
counts AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS w FROM hits) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
           FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN counts USING (r) LEFT JOIN listed USING (r)
"""
