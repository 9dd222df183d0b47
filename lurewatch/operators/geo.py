"""Range lookup: network owner and country of an IPv4 or IPv6 address.

Tables of ranges come in two forms: IPv4 numbers from ``start_ip`` to ``end_ip``, or a ``network`` such as
``2001:db8::/32`` or ``192.0.2.0/24``. Either way a range becomes prefixes of the 128-bit address, IPv4
being the lowest 32 bits, and an address meets them by equal keys: its prefix of each length that occurs
in the table. The narrowest range wins.

Defined results: an address that is neither IPv4 nor IPv6 is in no range; ``::ffff:a.b.c.d`` is the IPv4
address; a network with bits beyond its length is cut to it; one that cannot be read holds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.operators.joins import lookup_join

# Ranges of IPv4 numbers are cut into prefixes, as in address blocks: one has at most 62.
BITS, ALL_BITS = 32, 128
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


# Expressions are built as SQL texts: one parsed text is a single call, a tree of columns some hundred.


def ip_number(ip: str) -> str:
    """SQL for a dotted IPv4 address as a number; NULL for anything else."""
    return (f"CASE WHEN {ip} RLIKE r'^({OCTET}\\.){{3}}{OCTET}\\z' THEN aggregate("
            f"transform(split({ip}, '[.]'), part -> CAST(part AS BIGINT)), 0L, (total, part) -> total * 256 + part) END")


def ip_digits(ip: str) -> str:
    """SQL for an address as 32 hexadecimal digits, IPv4 with 24 zeros in front; NULL for anything else.

    An IPv4 tail is written as two groups first; the groups on both sides of ``::`` are padded, and
    zeros fill what is missing between them."""
    tail = f"regexp_extract({ip}, r'(?<=:)((?:{OCTET}\\.){{3}}{OCTET})\\z', 1)"
    tail_digits = f"lpad(lower(hex({ip_number(tail)})), 8, '0')"
    text = (f"CASE WHEN {tail} = '' THEN lower({ip}) ELSE concat(lower(substring({ip}, 1, length({ip}) - length({tail}))), "
            f"substring({tail_digits}, 1, 4), ':', substring({tail_digits}, 5, 4)) END")

    def groups(side: int) -> str:
        half = f"coalesce(get(x.halves, {side}), '')"
        return f"CASE WHEN {half} = '' THEN CAST(array() AS array<string>) ELSE split({half}, ':') END"

    def padded(part: str) -> str:
        return f"array_join(transform({part}, g -> lpad(g, 4, '0')), '')"

    given = "(size(y.left) + size(y.right))"
    whole = (f"((size(y.halves) = 1 AND {given} = 8) OR (size(y.halves) = 2 AND {given} <= 7)) "
             r"AND forall(concat(y.left, y.right), g -> g RLIKE r'^[0-9a-f]{1,4}\z')")
    # Each step's value is bound by a list of one element, so that it is computed once.
    halves = f"transform(array({text}), t -> named_struct('halves', split(t, '::')))"
    sides = f"transform({halves}, x -> named_struct('halves', x.halves, 'left', {groups(0)}, 'right', {groups(1)}))"
    digits = f"transform({sides}, y -> CASE WHEN {whole} THEN concat({padded('y.left')}, repeat('0000', 8 - {given}), {padded('y.right')}) END)"
    mapped = (f"get(transform({digits}, d -> CASE WHEN startswith(d, '{'0' * 20}ffff') "
              f"THEN concat('{'0' * 24}', substring(d, 25, 8)) ELSE d END), 0)")
    return f"coalesce(lpad(lower(hex({ip_number(ip)})), 32, '0'), {mapped})"


def _masked(digits: str, length: str) -> list[Column]:
    """The first ``length`` bits of an address, as the key columns ``_high`` and ``_low``."""

    def first(at: int, bits: str) -> str:
        half = f"CAST(conv(substring({digits}, {at}, 16), 16, -10) AS BIGINT)"
        return f"CASE WHEN {bits} <= 0 THEN 0L ELSE shiftright({half}, greatest(64 - ({bits}), 0)) END"

    return [F.expr(first(1, f"least({length}, 64)")).alias("_high"), F.expr(first(17, f"{length} - 64")).alias("_low")]


def _prefixes(ranges: DataFrame) -> DataFrame:
    """Each range once per prefix it consists of: ``_size`` (free bits) and ``_block``.

    From the shortest blocks up, an odd first block and an odd end are split off and the rest is
    halved."""
    block = "array<struct<_size:int,_block:bigint>>"
    first, last = "(s.low < s.high AND s.low % 2 = 1)", "(x.low < s.high AND s.high % 2 = 1)"

    def taken(use: str, at: str) -> str:
        return f"CASE WHEN {use} THEN array(named_struct('_size', size, '_block', {at})) ELSE CAST(array() AS {block}) END"

    raised = f"named_struct('low', s.low + CAST({first} AS BIGINT))"
    halved = f"""get(transform(array({raised}), x -> named_struct(
        'low', CASE WHEN s.low < s.high THEN x.low DIV 2 ELSE x.low END,
        'high', CASE WHEN s.low < s.high THEN (s.high - CAST({last} AS BIGINT)) DIV 2 ELSE s.high END,
        'found', concat(s.found, {taken(first, 's.low')}, {taken(last, 's.high - 1')}))), 0)"""
    start = f"named_struct('low', start_ip, 'high', end_ip + 1, 'found', CAST(array() AS {block}))"
    cut = ranges.withColumns({"start_ip": F.col("start_ip").cast("bigint"), "end_ip": F.col("end_ip").cast("bigint")})
    return cut.select("*", F.expr(f"inline(aggregate(sequence(0, {BITS}), {start}, (s, size) -> {halved}, s -> s.found))"))


def _keyed(ranges: DataFrame, values: list[str]) -> DataFrame:
    """Prefixes of the ranges: length and bits, ``_rank`` (narrow ranges first, then low ones), values."""
    if "network" in ranges.columns:
        base, given = "substring_index(network, '/', 1)", "try_cast(get(split(network, '/'), 1) AS INT)"
        most = f"CASE WHEN contains({base}, ':') THEN {ALL_BITS} ELSE {BITS} END"
        length = f"CASE WHEN {given} BETWEEN 0 AND {most} THEN {given} + {ALL_BITS} - {most} END"
        cut = ranges.select(*values, F.expr(ip_digits(base)).alias("_digits"), F.expr(length).alias("_length")).dropna(
            subset=["_digits", "_length"])
        rank = F.expr(f"named_struct('width', CAST({ALL_BITS} - _length AS BIGINT), 'low', 0L)").alias("_rank")
        return cut.select(*values, "_length", *_masked("_digits", "_length"), rank)
    return _prefixes(ranges.select("start_ip", "end_ip", *values)).select(
        *values, F.expr(f"{ALL_BITS} - _size AS _length"), F.expr("0L AS _high"), F.expr("_block AS _low"),
        F.expr("named_struct('width', end_ip - start_ip, 'low', start_ip) AS _rank"))


def range_lookup(addresses: DataFrame, ranges: DataFrame, values: list[str]) -> DataFrame:
    """For distinct ``ip`` rows, the values of the narrowest range holding the address. Addresses in no
    range are left out."""
    blocks = _keyed(ranges, values)
    lengths = blocks.agg(F.expr("collect_set(_length) AS lengths")).scalar()  # 129 at most
    asked = addresses.select("ip", F.expr(ip_digits("ip")).alias("_digits")).where("_digits IS NOT NULL")
    probes = asked.select("*", F.explode(lengths).alias("_length"))
    hits = probes.select("ip", "_length", *_masked("_digits", "_length")).join(blocks, ["_length", "_high", "_low"])
    names = ", ".join(values)
    best = F.expr(f"min_by(struct({names}), struct(_rank, {names}))").alias("_best")
    return hits.groupBy("ip").agg(best).select("ip", "_best.*")


def geo_lookup(
    df: DataFrame, asn_ranges: DataFrame | None, country_ranges: DataFrame | None,
    spread: list[str], ip: str = "ip", **options,
) -> DataFrame:
    """Add ``country, isp, asn`` for the address in ``ip``. Each distinct address is looked up once.

    Without a network table the owner is ``Unknown``; with one, an address it does not hold has the
    owner ``''``. Rows without an address get NULL throughout."""
    addresses = df.select(F.col(ip).alias("ip")).where(F.col("ip").isNotNull()).distinct()
    found = addresses
    no_text, no_number = F.lit(""), F.lit(0).cast("bigint")
    if country_ranges is not None:
        found = found.join(range_lookup(addresses, country_ranges, ["country"]), "ip", "left")
    else:
        found = found.withColumn("country", F.lit(None).cast("string"))
    if asn_ranges is not None:
        held = ["network"] if "network" in asn_ranges.columns else ["start_ip", "end_ip"]
        named = asn_ranges.select(*held, F.col("asn").cast("bigint").alias("asn"),
                                  F.col("org").alias("isp"))
        found = found.join(range_lookup(addresses, named, ["isp", "asn"]), "ip", "left")
        found = found.withColumn("isp", F.coalesce("isp", no_text))
    else:
        found = found.withColumns({"isp": F.lit("Unknown"), "asn": F.lit(None).cast("bigint")})
    found = found.select(F.col("ip").alias(ip), F.coalesce("country", no_text).alias("country"),
                         "isp", F.coalesce("asn", no_number).alias("asn"))
    return lookup_join(df, found, ip, spread, **options)
