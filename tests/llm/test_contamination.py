import hashlib
import random
import re

from lurewatch.llm import contamination as C

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window):
    """Every window of every item looked for at every place."""
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item_id, item in items:
            own = words(item)
            m = min(window, len(own))
            wins = {tuple(own[i:i + m]) for i in range(len(own) - m + 1)} if own else set()
            for i in range(len(ws) - m + 1):
                if tuple(ws[i:i + m]) in wins:
                    hit.update(range(i, i + m))
                    if item_id is not None:
                        found.add(str(item_id))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def digest(frame):
    found = frame.selectExpr("doc_id", "contamination.n_words", "contamination.n_hit", "size(contamination.items)",
                             "sha2(array_join(contamination.items, ','), 256)", "contamination.n_hit > 0")
    return sorted(map(tuple, found.collect()), key=repr)


def made(seed, n_items=30, n_docs=60):
    """A few words only, so that runs repeat inside and between items and documents."""
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice(["a", "b", "A", "É", "é9"]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    items = [(rng.choice([i, i, 3, None]), text(rng.randrange(0, 12))) for i in range(n_items)]
    docs = [(i, text(rng.randrange(0, 40))) for i in range(n_docs)]
    docs += [(100, None), (101, ""), (None, "a b"), (1, docs[1][1]), (102, items[-1][1] + " zz " + items[0][1])]
    return docs, items + [(7, None), (8, ""), (9, "!?")]


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, contamination string"),
            spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int"))


def test_counts_against_all_windows(spark):
    for seed, window, block in ((1, 4, 400_000), (2, 6, 400_000), (3, 5, 40)):  # the last in several blocks
        docs, items = made(seed)
        d, i = frames(spark, docs, items)
        assert digest(C.scanned(d.repartition(2), i, window, block)) == plain(docs, items, window)


def test_one_automaton_over_long_items():
    rng = random.Random(5)
    items = [[rng.randrange(3) for _ in range(rng.randrange(1, 60))] for _ in range(20)]
    automaton = C.Automaton()
    for item in items:
        automaton.add(item)
    runs = {tuple(item[i:j]) for item in items for i in range(len(item)) for j in range(i + 1, len(item) + 1)}
    walked, stack = set(), [(0, ())]
    while stack:
        state, run = stack.pop()
        for word, target in automaton.next[state].items():
            walked.add((*run, word))
            stack.append((target, (*run, word)))
    assert walked == runs


def test_long_item_in_pieces(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(50)}" for _ in range(300))
    docs = [(1, " ".join(long.split()[90:130])), (2, long), (3, "w1 w2 w3")]
    items = [(1, long), (2, long)]
    d, i = frames(spark, docs, items)
    kept, C.PIECE_WORDS = C.PIECE_WORDS, 25
    try:
        assert digest(C.scanned(d, i, 10, 120)) == plain(docs, items, 10)
    finally:
        C.PIECE_WORDS = kept


def test_spans_go_and_mostly_hit_documents_go(spark):
    item = "The quick brown fox jumps over the lazy dog today"
    docs = [(1, "before it: the QUICK brown fox -- jumps over the lazy dog today, and after it come many more words than that"),
            (2, item), (3, "nothing of it"), (4, None)]
    d, i = frames(spark, docs, [(1, item)])
    found = {r["doc_id"]: r["text"] for r in C.decontaminated(d, i, 10).collect()}
    assert found == {1: "before it: , and after it come many more words than that", 3: "nothing of it", 4: None}
    assert C.decontaminated(d, i, 10, most_hit=1.0, longest_span=10).where("doc_id = 2").first()["text"] == item


def test_empty_tables(spark):
    docs, items = made(4)
    d, i = frames(spark, docs, items)
    assert C.scanned(d.limit(0), i).count() == 0
    assert digest(C.scanned(d, i.limit(0))) == plain(docs, [], 10)
    assert C.report(d, i).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
