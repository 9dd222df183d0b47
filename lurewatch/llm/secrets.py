"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Patterns (``assign``, ``access``, ``hex``) give the base spans. A candidate string of at least
``WINDOW`` characters of one class is a secret as well when the Shannon entropy of some window of
it reaches the class's threshold. Counts are kept per character: moving the window by one changes
two of them, and the entropy follows from the sum of c * log2(c). Between slashes, what is listed or
looks like names, words or numbers (``allowed``) is passed over, and no window reaches across it; the
rest of the string is judged. Base spans are never passed over.

A candidate's characters are looked up once; counts are five bits each in a few numbers, and the sum is
kept in whole 2^-40ths, so a step costs the same at any length. Spans are code points, end exclusive;
positions are added up in blocks of about the square root of the number of matches.

Defined results: a null or empty text has no spans; spans of different kinds may overlap; repeated
rows are scanned each; an empty table gives no rows. Columns of the input with the names added here
are replaced.
"""

from __future__ import annotations

import string
from math import floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
KEYWORD = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
ASSIGN = KEYWORD + r"[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = KEYWORD + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same matches as one or more, then 20 characters at least
HEX = r"[0-9a-f]{24,}"
SHORTEST_VALUE = 6

# The method's own classes: characters, and the entropy in bits that a window must reach.
WINDOW = 20
CLASSES = {
    "entropy_hex": ("[0-9A-Fa-f]", string.digits + "ABCDEF" + "abcdef", 3.1),
    "entropy_base64": ("[A-Za-z0-9+/_-]", string.ascii_letters + string.digits + "+/_-", 3.85),
}
LISTED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"  # UUIDs
    r"|^[0-9_+-]+$"  # numbers and dates
    r"|EXAMPLE|example"
)
WORD_FORM = "(?:[A-Z]?[a-z]{1,24}(?:[A-Z][a-z]{2,24})*|[A-Z]{1,24})"
NAME = rf"^{WORD_FORM}(?:[_-]{WORD_FORM})*[_-]?[0-9]{{0,4}}$"  # words, perhaps joined or numbered
LONGEST_NAME = 256
KINDS = ["assign", "access", "hex", *CLASSES]
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; an expression used in a lambda is computed each time."""
    return F.get(F.transform(F.array(value), body), 0)


def _before(items: Column, start: Column, step) -> Column:
    """For each item, what ``step`` has made of ``start`` and the items before it; an array that grew by
    one an item would be copied each time, so it is made in blocks."""

    def in_blocks(items_: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items_))).cast("int"))
        return F.transform(F.sequence(F.lit(1), F.size(items_), width), lambda at: F.slice(items_, at, width))

    def begins(blocks: Column) -> Column:
        return F.aggregate(blocks, F.array(start), lambda out, block: F.concat(
            out, F.array(F.aggregate(block, F.element_at(out, -1), step))))

    def inside(block: Column, begin: Column) -> Column:
        return F.aggregate(F.slice(block, 1, F.size(block) - 1), F.array(begin), lambda out, item: F.concat(
            out, F.array(step(F.element_at(out, -1), item))))

    made = _let(items, lambda items_: _let(in_blocks(items_), lambda blocks: _let(begins(blocks), lambda first: F.flatten(
        F.transform(blocks, lambda block, i: inside(block, F.get(first, i)))))))
    return F.when(F.size(items) > 0, made).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of the pattern's matches, left to right; ``keep(match)`` drops some."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(
        m.alias("m"), F.length(gap).alias("gap"), F.length(m).alias("n")))

    def placed(pairs_: Column) -> Column:
        ends = _before(pairs_, F.lit(0), lambda at, pair: at + pair["gap"] + pair["n"])
        kept = F.filter(F.zip_with(pairs_, ends, lambda pair, at: F.struct(
            pair["m"].alias("m"), (at + pair["gap"]).alias("start"), (at + pair["gap"] + pair["n"]).alias("end"))),
            lambda span: keep(span["m"]))
        return F.transform(kept, lambda span: F.struct(
            F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end")))

    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(F.array().cast(SPAN))


def _weights(window: int) -> list[int]:
    """c * log2(c) in 2^-40ths for the counts 0 to ``window``."""
    return [round(c * log2(c) * 2 ** 40) if c else 0 for c in range(window + 1)]


def highest_window(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The smallest sum of c * log2(c), in 2^-40ths, over the windows of the candidate; null if it is
    shorter. The entropy in bits is log2(window) less the sum per character of the window.

    A step takes in a character and, once the window is full, lets one out, which changes two counts
    unless they are the same. Twelve counts share a number, five bits each."""
    letters, weights = F.lit(alphabet), F.array(*[F.lit(w).cast("long") for w in _weights(window)])
    numbers = -(-len(alphabet) // 12)
    zero = F.lit(0).cast("long")

    def steps(codes: Column) -> Column:
        def count(counts: Column, code: Column) -> Column:
            return F.call_function(
                "shiftright", F.get(counts, F.floor(code / 12).cast("int")), code % 12 * 5).bitwiseAND(F.lit(31)).cast("int")

        def moved(state: Column, i: Column) -> Column:
            entering = F.get(codes, i)
            leaving = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            return _let(F.struct(entering.alias("e"), leaving.alias("l")), lambda x: F.when(x["e"] == x["l"], state).otherwise(
                _let(F.struct(
                    count(state["counts"], x["e"]).alias("more"),
                    F.when(x["l"] >= 0, count(state["counts"], F.greatest(x["l"], F.lit(0)))).otherwise(F.lit(0)).alias("less")),
                    lambda c: F.struct(
                        F.transform(state["counts"], lambda n, k: n
                                    + F.when(k == F.floor(x["e"] / 12), F.call_function("shiftleft", F.lit(1).cast("long"), x["e"] % 12 * 5)).otherwise(zero)
                                    - F.when((x["l"] >= 0) & (k == F.floor(x["l"] / 12)),
                                             F.call_function("shiftleft", F.lit(1).cast("long"), x["l"] % 12 * 5)).otherwise(zero)).alias("counts"),
                        (state["sum"] + F.get(weights, c["more"] + 1) - F.get(weights, c["more"])
                         + F.when(x["l"] >= 0, F.get(weights, c["less"] - 1) - F.get(weights, c["less"])).otherwise(zero)).alias("sum"),
                        state["least"].alias("least")))))

        def step(state: Column, i: Column) -> Column:
            return _let(moved(state, i), lambda s: F.struct(
                s["counts"].alias("counts"), s["sum"].alias("sum"),
                F.when(i >= window - 1, F.least(s["least"], s["sum"])).otherwise(s["least"]).alias("least")))

        start = F.struct(F.array_repeat(zero, numbers).alias("counts"), zero.alias("sum"), F.lit(None).cast("long").alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["least"])

    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(letters, c) - 1)
    return F.when(F.length(candidate) >= window, _let(codes, steps))


def allowed(part: Column) -> Column:
    """Whether a string without slashes is passed over."""
    return part.rlike(LISTED) | ((F.length(part) <= LONGEST_NAME) & part.rlike(NAME))


def _suspicious(alphabet: str, threshold: float, window: int = WINDOW):
    # A sum at most this has an entropy of at least the threshold, up to 1e-9.
    most = floor((log2(window) - threshold + 1e-9) * window * 2 ** 40)

    def keep(candidate: Column) -> Column:
        judged = F.transform(F.split(candidate, "/"), lambda part: F.when(allowed(part), " ").otherwise(part))
        return F.exists(F.split(F.array_join(judged, "/"), " "),
                        lambda part: F.coalesce(highest_window(part, alphabet, window) <= most, F.lit(False)))

    return keep


def with_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """Add column ``into``: all spans by start, then kind in the order of ``KINDS``."""
    body = F.coalesce(F.col(text), F.lit(""))

    def assigned(match: Column) -> Column:
        return F.length(F.regexp_extract(match, ASSIGN_VALUE, 1)) >= SHORTEST_VALUE

    def any_match(match: Column) -> Column:
        return F.lit(True)

    found = [_spans(body, ASSIGN, "assign", assigned), _spans(body, ACCESS, "access", any_match),
             _spans(body, HEX, "hex", any_match)]
    for kind, (characters, alphabet, threshold) in CLASSES.items():
        found.append(_spans(body, f"{characters}{{{WINDOW},}}", kind,
                            _suspicious(alphabet, threshold)))
    order = F.array(*map(F.lit, KINDS))
    ranked = F.transform(F.concat(*found), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind")))
    return docs.withColumn(into, F.array_sort(ranked))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document."""
    scanned = with_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["rank"] <= 3)
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every secret replaced by ``mask``; ``n_chars`` follows the new text.

    Overlapping spans are masked together. Texts without secrets stay as they are."""
    def pieces(chars: Column, spans: Column) -> Column:
        done = _before(spans, F.lit(0), lambda at, span: F.greatest(at, span["end"]))
        gaps = F.zip_with(spans, done, lambda span, at: F.when(span["start"] >= at, F.concat(
            F.array_join(F.slice(chars, at + 1, span["start"] - at), ""), F.lit(mask))).otherwise(""))
        end = F.array_max(F.transform(spans, lambda span: span["end"]))
        return F.concat(F.array_join(gaps, ""), F.array_join(F.slice(chars, end + 1, F.size(chars)), ""))

    masked = _let(F.split("text", ""), lambda chars: pieces(chars, F.col("_secrets")))
    hit = F.size("_secrets") > 0
    out = with_secrets(docs, into="_secrets").withColumn("text", F.when(hit, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def oracle() -> str:
    """The report in DuckDB's SQL; entropies of all windows are computed afresh."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    kinds = [("assign", ASSIGN, f"length(regexp_extract(m, {quoted(ASSIGN_VALUE)}, 1)) >= {SHORTEST_VALUE}"),
             ("access", ACCESS, "true"), ("hex", HEX, "true")]
    for kind, (characters, _, threshold) in CLASSES.items():
        windows = (f"list_max(list_transform(range(1, length(p) - {WINDOW - 2}), "
                   f"lambda i: list_aggregate(string_split(p[i:i + {WINDOW - 1}], ''), 'entropy')))")
        parts = (f"string_split(array_to_string(list_transform(string_split(m, '/'), "
                 f"lambda x: CASE WHEN regexp_matches(x, {quoted(LISTED)}) OR (length(x) <= {LONGEST_NAME} AND regexp_matches(x, {quoted(NAME)})) THEN ' ' ELSE x END), '/'), ' ')")
        kinds.append((kind, f"{characters}{{{WINDOW},}}", f"len(list_filter({parts}, lambda p: "
                      f"length(p) >= {WINDOW} AND {windows} >= {threshold} - 1e-9)) > 0"))
    parts = "\nUNION ALL\n".join(
        f"""SELECT doc_id, n, {rank} AS rank, {quoted(kind)} AS kind, m, s, s + length(m) AS e FROM (
  SELECT doc_id, n, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, n, regexp_extract_all(t, {quoted(pattern)}) AS ms,
           string_split_regex(t, {quoted(pattern)}) AS gs FROM texts)))
WHERE {test}""" for rank, (kind, pattern, test) in enumerate(kinds, 1))
    name = "kind || ':' || s::BIGINT || ':' || e::BIGINT"
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
spans AS ({parts}),
found AS (
  SELECT n, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access,
         count(*) FILTER (rank = 3) AS n_hex,
         string_agg({name}, ',' ORDER BY s, rank) FILTER (rank <= 3) AS base,
         string_agg({name}, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (n)
"""
