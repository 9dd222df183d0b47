import hashlib

from lurewatch.llm import fingerprints


def phrases(data: bytes) -> set[bytes]:
    known, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in known:
            known.add(data[at:end])
            at = end
    return known


def test_parse_gives_the_dictionary_phrases():
    for data in (b"", b"a", b"aaaaaaaaaa", b"abracadabra" * 20, bytes(range(256)) * 3):
        parsed = fingerprints.Phrases().extend(data)
        at, found = 0, []
        for length in parsed.lengths:
            found.append(data[at:at + length])
            at += length
        assert set(found) == phrases(data) and len(found) == len(set(found))
        half = fingerprints.Phrases().extend(data[:7])
        assert half.copy().extend(data[7:]).lengths == parsed.lengths


def test_neighbours_and_edits_against_brute_force(spark):
    texts = {i * 3: f"text {i % 5} of many words " * (i % 9) for i in range(200)}
    texts |= {1000: None, 1001: "", 1002: "é🙂" * 301, 1003: "z" * 40000}
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, "without id", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    found = {r["doc_id"]: r for r in fingerprints.fingerprinted(frame, block_rows=16).collect()}
    assert len(found) == len(rows)
    order = sorted(texts)
    signer = fingerprints.Signer(fingerprints.MINIMA)

    def sign(text):
        data = text.encode()
        return signer.sign(data, fingerprints.Phrases().extend(data).lengths)

    for one, other in zip(order, [*order[1:], order[0]]):
        text, following, r = texts[one] or "", texts[other] or "", found[one]
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.as_text(sign(text))
        assert r["edited_fingerprint"] == fingerprints.as_text(sign(edited))
        assert r["near_edited"] == fingerprints.likeness(sign(text), sign(edited))
        assert r["near_next"] == fingerprints.likeness(sign(text), sign(following))
    assert found[None]["near_next"] == 1.0


def test_likeness_follows_the_phrase_sets():
    signer = fingerprints.Signer(2048)
    one, other = b"the quick brown fox " * 60, b"the quick brown fox " * 50 + b"jumps over dogs " * 20
    a, b = phrases(one), phrases(other)
    near = fingerprints.likeness(*(signer.sign(d, fingerprints.Phrases().extend(d).lengths) for d in (one, other)))
    assert abs(near - len(a & b) / len(a | b)) < 0.08


def test_single_and_empty(spark):
    schema = "doc_id long, text string"
    assert fingerprints.fingerprinted(spark.createDataFrame([], schema)).count() == 0
    row = fingerprints.fingerprinted(spark.createDataFrame([(4, "abcd")], schema)).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    twice = fingerprints.fingerprinted(spark.createDataFrame([(4, "abcd"), (4, "abcd")], schema)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
