import re
import zlib
from collections import Counter

from lurewatch.llm import variants

TEXTS = [
    (1, "Banana banana banane banaen bananas banana-Banana ananab"),
    (2, "banana BANANA bananes bananas bananas banane banane Éclair Éclair"),
    (None, "éclair Éclair Éclairs Éclairs Éclairs xbanana xbanana xbanana"), (3, None), (4, ""),
    (5, "y" * 5000 + " " + "y" * 5001), (5, "y" * 5000 + " " + "y" * 5001), (6, "y" * 5000 + " z" + "y" * 4999),
    (7, "yy " * 3 + ("w" + "y" * 4999 + " ") * 3),
] + [(i, "words wordy sword swords wrds " + "word " * (i % 3)) for i in range(10, 400)]


def plain(texts):
    """Counts, all pairs compared, chains followed one by one."""
    count = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    forms, found = {}, {}
    for word, n in words.items():
        close = sorted((-m, o) for o, m in words.items() if o != word and near(word, o))
        if close and -close[0][0] >= 2 * n:
            forms[word] = close[0][1]
        found[word] = (n, len(close))

    def root(word):
        while word in forms:
            word = forms[word]
        return word

    return sorted((w, forms.get(w), root(w), n, k, words.get(forms.get(w))) for w, (n, k) in found.items())


def listed(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_words_forms_and_roots(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, word string")
    wanted = plain(TEXTS)
    assert listed(variants.grouped(docs.repartition(3))) == wanted
    assert any(w[1] for w in wanted) and any(w[4] > 1 for w in wanted)


def test_dense_words(spark):
    """All strings of two letters and lengths 5 to 7: every word has many near ones, and many ties."""
    words = [f"{n:0{size}b}".replace("0", "a").replace("1", "b") for size in (5, 6, 7) for n in range(2 ** size)]
    texts = [(i, " ".join([w] * (3 + i % 9))) for i, w in enumerate(words)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for parts in (3, 4):
        assert listed(variants.grouped(docs, parts)) == plain(texts)


def test_chain_of_forms(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc"]
    docs = spark.createDataFrame([(i, " ".join([w] * (3 << i))) for i, w in enumerate(chain)], "doc_id long, text string")
    found = {r["word"]: r["root"] for r in variants.grouped(docs).collect()}
    assert set(found.values()) == {"bbbcc"}


def test_empty_table(spark):
    assert variants.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0
