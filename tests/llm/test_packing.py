import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lurewatch.llm import packing

TEXTS = [
    (1, "Hello world, it's a test."), (2, None), (3, ""), (4, "word " * 5000), (5, "x" * 30000),
    (6, "Ünïcode É ß µ 漢字 🙂 don't'S"), (7, "a\x1cb \x00 c<|endoftext|>d"), (8, "é combining"),
    (None, "no id"), (1, "Hello world, it's a test."), (9, " \t\n "),
] + [(i, f"short text number {i} " * (i % 40)) for i in range(20, 120)]


def test_pieces_follow_the_tokenizer_and_fill_sequences(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = []
    for doc_id, text in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            wanted.append((doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    frame = spark.createDataFrame([(i, t, 7) for i, t in TEXTS], "doc_id long, text string, sequence_id int")
    found = packing.packed(frame.repartition(3), round_=40).collect()
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found))) == \
        sorted(map(repr, wanted))
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(w[3] for w in wanted)
    assert len(sequences) <= total / 2048 * 1.1 + 2


def test_sum_of_squares_by_hand():
    """Each placement against all choices tried out."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 13, 60)
    sequence, offset = packing.sum_of_squares(lengths, 12)
    fills, count = {}, [0] * 13

    def squares(changed):
        trial = count.copy()
        for f, d in changed:
            if 0 < f < 12:
                trial[f] += d
        return sum(c * c for c in trial)

    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        options = {f: squares([(f, -1), (f + s, 1)]) for f in range(13 - s) if f == 0 or count[f]}
        chosen = fills.get(sequence[i], 0)
        assert chosen == offset[i] and options[chosen] == min(options.values())
        if 0 < chosen:
            count[chosen] -= 1
        fills[sequence[i]] = chosen + s
        if chosen + s < 12:
            count[chosen + s] += 1


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
