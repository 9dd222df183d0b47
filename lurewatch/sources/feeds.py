"""Readers and normalisers for the eight threat feeds.

A reader turns landed files into a ``value STRING`` frame (one line, or one document for the two JSON
feeds); a normaliser turns such a frame, batch or streaming, into ``url, source, external_id,
threat_type``. Files are landed by the caller; compressed files are recognised by their extension.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurewatch.functions.barrier import settled
from lurewatch.functions.url import trimmed
from lurewatch.session import checkpointed

THREAT_COLUMNS = ["url", "source", "external_id", "threat_type"]

# --- Fixed values: threat types per feed, kept IOC types, shape of a CSV line ---------------------

KEPT_IOC_TYPES = ["url", "domain"]
CSV_TEXT = r'(?:[^"]++|"")*+'
CSV_FIELD = rf'(?:"{CSV_TEXT}"|[^",\n]*+)'
CSV_LINE = rf"^{CSV_FIELD}(?:,{CSV_FIELD})*+\z"

# -----------------------------------------------------------------------------------------------


# Where a row of a landed file stands: the file's time, its path, the block and the place in the block.
LANDED = ["landed_at", "landed_path", "landed_block", "landed_place"]


def _lines(raw: DataFrame) -> Column:
    return F.regexp_replace("value", r"\r\z", "")


def _carried(df: DataFrame) -> list[str]:
    return [c for c in LANDED if c in df.columns]


def _threats(df: DataFrame, url: Column, source: str, kind: Column | str,
             external_id: Column | str = "") -> DataFrame:
    def column(value):
        return value if isinstance(value, Column) else F.lit(value)

    return df.select(url.alias("url"), F.lit(source).alias("source"),
                     column(external_id).alias("external_id"), column(kind).alias("threat_type"), *_carried(df))


def _line_feed(source: str, kind: str, comments: bool = False, domains: bool = False,
               trim: bool = False) -> Callable[[DataFrame], DataFrame]:
    def normalise(raw: DataFrame) -> DataFrame:
        line = _lines(raw)
        df = raw.select((trimmed(line) if trim else line).alias("line"), *_carried(raw)).where(F.col("line") != "")
        if comments:
            df = df.where(~F.col("line").startswith("#"))
        url = F.concat(F.lit("http://"), "line") if domains else F.col("line")
        return _threats(df, url, source, kind)

    normalise.__doc__ = f"One {'domain' if domains else 'URL'} per line, typed {kind}."
    return normalise


openphish = _line_feed("openphish", "phishing")
github_phishing = _line_feed("github_phishing", "phishing", comments=True)
vxvault = _line_feed("vxvault", "malware")
stopforumspam = _line_feed("stopforumspam", "spam", domains=True, trim=True)
phishing_army = _line_feed("phishing_army", "phishing", comments=True, domains=True)


def phishtank(raw: DataFrame) -> DataFrame:
    """JSON arrays of ``{"phish_id": int, "url": string}``. An element of any other shape is skipped;
    an absent or null id reads as 0, an absent or null URL as the empty text. Of a document that is
    broken or cut off, the elements before the break are read."""
    items = json_elements(raw).select(
        "item", F.try_variant_get("item", "$.phish_id", "variant").alias("id"),
        F.try_variant_get("item", "$.url", "variant").alias("url"), *_carried(raw))
    # Only an object has fields; the shape of a whole element is costly to name.
    shaped = F.col("id").isNotNull() | F.col("url").isNotNull() | F.schema_of_variant("item").startswith("OBJECT")
    items = settled(items, "id", "url").where(shaped)

    def typed(name: str, wanted: str, default: str) -> Column:
        shape = F.coalesce(F.schema_of_variant(name), F.lit("VOID"))
        text = F.try_variant_get(name, "$", "string")
        return F.when(shape == "VOID", default).when(shape == wanted, text)

    df = items.select(typed("id", "BIGINT", "0").alias("id"), typed("url", "STRING", "").alias("url"), *_carried(raw))
    # Settled, so that the filter does not compute them a second time.
    return _threats(settled(df, "id", "url").dropna(subset=["id", "url"]), F.col("url"), "phishtank", "phishing", F.col("id"))


def urlhaus(raw: DataFrame) -> DataFrame:
    """CSV records with ``#`` comments: id first, URL third. Records of fewer than three fields and
    malformed ones (a bare quote, say) are skipped. See ``csv_records`` for records of several lines."""
    line = _lines(raw)
    df = raw.select(line.alias("line"), *_carried(raw)).where(
        (F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").rlike(CSV_LINE))
    # With a comma in front, every match has at least that.
    df = df.select(F.regexp_extract_all(
        F.concat(F.lit(","), "line"), F.lit(rf",({CSV_FIELD})"), F.lit(1)).alias("fields"), *_carried(raw))
    df = df.where(F.size("fields") >= 3)

    def field(index: int) -> Column:
        text = F.element_at("fields", index)
        inner = F.substr(text, F.lit(2), F.length(text) - 2)
        return F.when(text.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(text)

    return _threats(df, field(3), "urlhaus", "", field(1))


def threatfox(raw: DataFrame) -> DataFrame:
    """JSON objects ``id -> [{ioc_value, ioc_type, threat_type}]``; URL and domain entries are kept as
    they are written. A document that is not such an object stops the run."""
    shape = "map<string,array<struct<ioc_value:string,ioc_type:string,threat_type:string>>>"
    broken = F.col("_parsed").isNull() & (F.trim("value") != "")
    parsed = F.when(broken, F.raise_error(F.lit("threatfox: not a JSON object of lists")).cast(shape)).otherwise(F.col("_parsed"))
    # Settled, as each use of the parsed text would parse it once more.
    read = settled(raw.select("value", F.from_json("value", shape).alias("_parsed"), *_carried(raw)), "_parsed")
    entries = settled(read.select(parsed.alias("_parsed"), *_carried(raw)), "_parsed").select(
        F.explode("_parsed").alias("id", "items"), *_carried(raw))
    iocs = entries.select("id", F.inline("items"), *_carried(raw)).where(F.col("ioc_type").isin(KEPT_IOC_TYPES))
    return _threats(iocs, F.coalesce("ioc_value", F.lit("")), "threatfox",
                    F.coalesce("threat_type", F.lit("")), F.col("id"))


NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "phishtank": phishtank,
    "urlhaus": urlhaus,
    "openphish": openphish,
    "threatfox": threatfox,
    "github_phishing": github_phishing,
    "vxvault": vxvault,
    "stopforumspam": stopforumspam,
    "phishing_army": phishing_army,
}
DOCUMENT_FEEDS = {"phishtank", "threatfox"}  # one JSON document per file
CSV_FEEDS, ARRAY_FEEDS = {"urlhaus"}, {"phishtank"}


# -- scans over the blocks of files -------------------------------------------------------------------
#
# What holds before a row often follows from all rows before it in the file. It is found within each
# block of the file first, then over the blocks, of which a file has few; so no task sees a file whole.

BLOCK = ["landed_path", "landed_block"]


def _before(part: list[str], order: str):
    return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _with_sum(rows: DataFrame, value: Column, into: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before in the file."""
    rows = rows.withColumn("_value", value.cast("long"))
    inside = rows.withColumn("_inside_sum", F.coalesce(F.sum("_value").over(_before(BLOCK, "landed_place")), F.lit(0)))
    blocks = rows.groupBy(*BLOCK).agg(F.sum("_value").alias("_value"))
    offset = F.coalesce(F.sum("_value").over(_before(["landed_path"], "landed_block")), F.lit(0))
    blocks = blocks.select(*BLOCK, offset.alias("_offset"))
    return inside.join(blocks, BLOCK).withColumn(into, F.col("_inside_sum") + F.col("_offset")).drop(
        "_value", "_inside_sum", "_offset")


def _with_quoted(rows: DataFrame, opens: str, stays: str, into: str) -> DataFrame:
    """Add whether a row starts inside a quotation, which each row may open or close: ``opens`` says
    whether one is open behind the row if none was before it, ``stays`` if one was.

    So a row keeps the state, changes it, or ends inside or outside whatever was before. The state
    before a row is that behind the last row of the last two kinds, changed as often as rows in between
    change it."""

    def scanned(frame: DataFrame, part: list[str], order: str) -> DataFrame:
        """Add ``_ends`` and ``_turns``: what the rows before make of the state, whatever it was or not."""
        before = _before(part, order)
        frame = frame.withColumn("_all", F.coalesce(F.sum(F.col("_turn").cast("long")).over(before), F.lit(0)))
        last = F.last(F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_all")), ignorenulls=True).over(before)
        return frame.withColumn("_last", last).withColumns({
            "_ends": F.col("_last._fixed"), "_turns": F.col("_all") - F.coalesce("_last._all", F.lit(0))})

    def state(ends: Column, turns: Column, start: Column) -> Column:
        return F.coalesce(ends, start) != (turns % 2 == 1)

    kept = rows.columns
    rows = scanned(rows.withColumns({"_fixed": F.when(F.col(opens) == F.col(stays), F.col(opens)),
                                     "_turn": F.col(opens) & ~F.col(stays)}), BLOCK, "landed_place")
    last = F.max_by(F.struct("_ends", "_turns", "_fixed", "_turn"), "landed_place")
    turns = F.col("x._turns") + F.col("x._turn").cast("long")
    blocks = rows.groupBy(*BLOCK).agg(last.alias("x")).select(
        *BLOCK, F.coalesce("x._fixed", F.when(F.col("x._ends").isNotNull(), state(F.col("x._ends"), turns, F.lit(False)))).alias("_fixed"),
        (F.col("x._fixed").isNull() & F.col("x._ends").isNull() & (turns % 2 == 1)).alias("_turn"))
    entered = scanned(blocks, ["landed_path"], "landed_block").select(
        *BLOCK, state(F.col("_ends"), F.col("_turns"), F.lit(False)).alias("_entered"))
    return rows.join(entered, BLOCK).select(*kept, state(F.col("_ends"), F.col("_turns"), F.col("_entered")).alias(into))


def csv_records(lines: DataFrame) -> DataFrame:
    """Landed CSV lines as records: a quoted field may hold line breaks. Only records of several lines are
    moved."""
    line = F.regexp_replace("value", r"\r\z", "")
    outside, inside = rf'^(?:{CSV_FIELD},)*+"{CSV_TEXT}\z', rf'^{CSV_TEXT}\z|^{CSV_TEXT}",(?:{CSV_FIELD},)*+"{CSV_TEXT}\z'
    rows = checkpointed(_placed(lines).select(
        line.alias("value"), *LANDED, (line.rlike(outside) & ~line.startswith("#")).alias("_opens"), line.rlike(inside).alias("_stays")))
    rows = checkpointed(_with_quoted(rows, "_opens", "_stays", "_inside"))

    single = rows.where("NOT _inside AND NOT _opens").select("value", *LANDED)
    several = _with_sum(rows.where("_inside OR _opens"), ~F.col("_inside"), "_starts")
    # The lines of a record share the number of starts up to them.
    several = several.withColumn("_record", F.col("_starts") + (~F.col("_inside")).cast("long"))
    at = F.struct("landed_block", "landed_place")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "value"))), lambda x: x["value"]), "\n")
    joined = several.groupBy("landed_path", "_record").agg(text.alias("value"), F.min("landed_at").alias("landed_at"), F.min(at).alias("_at"))
    return single.unionByName(joined.select("value", "landed_at", "landed_path", "_at.landed_block", "_at.landed_place"))


JSON_TEXT = r'"(?:[^"\\]++|\\.)*+"'


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text of landed files up to each closing brace, as ``piece``; ``closes`` says whether the brace
    is there, which only a file's last piece may lack. Large files are read in blocks."""
    landed = ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"]
    rows = _placed(spark.read.text(path, lineSep="}").select(
        F.col("value").alias("piece"), *[F.col(source).alias(name) for source, name in zip(landed, LANDED)],
        F.col("_metadata.file_size").alias("_size")))
    rows = checkpointed(rows)
    at = F.struct("landed_block", "landed_place")
    ends = rows.groupBy("landed_path").agg(
        F.max(at).alias("_last"), F.max("_size").alias("_size"), F.sum(F.octet_length("piece") + 1).alias("_read"))
    # A compressed file's size says nothing; its last brace is taken to be there.
    ends = ends.select("landed_path", "_last", (F.col("_read") != F.col("_size") + 1).alias("_closed"))
    closes = (at != F.col("_last")) | F.col("_closed")
    return rows.join(ends, "landed_path").select("piece", closes.alias("closes"), *LANDED)


AT_ONCE = 1 << 20  # a document of up to so many bytes is parsed in one go


def _elements(text: Column) -> Column:
    """What the parser makes of a text between two seals: ``all`` has the seals and the text's elements if
    it is one array and nothing more, which ``_only_array`` tests. A text can't hold its own hash, so
    whatever it closes or opens, it does not pass for an array with something behind it."""
    seal = F.concat(F.lit("["), F.xxhash64(text).cast("string"), F.lit("]"))
    sealed = F.concat(F.lit('{"all":['), seal, F.lit(","), text, F.lit(","), seal, F.lit("]}"))
    options = {"columnNameOfCorruptRecord": "broken", "allowSingleQuotes": "false"}
    return F.when(F.octet_length(text) <= AT_ONCE, F.from_json(sealed, "all array<array<variant>>, broken string", options))


def _only_array(parsed: str, text: Column) -> Column:
    def sealed(part: int) -> Column:
        one = F.get(F.col(f"{parsed}.all"), part)
        return (F.size(one) == 1) & (F.try_variant_get(F.get(one, 0), "$", "bigint") == F.xxhash64(text))

    whole = F.col(f"{parsed}.broken").isNull() & (F.size(f"{parsed}.all") == 3) & sealed(0) & sealed(2)
    return F.when(whole, F.get(F.col(f"{parsed}.all"), 1))


def json_elements(raw: DataFrame) -> DataFrame:
    """The elements of JSON arrays as variants ``item``, up to the first break of each document; those that
    are no objects may be left out behind the last object.

    ``raw`` holds documents in ``value``, or ``json_pieces``. Of the documents those that are whole arrays
    of moderate size are parsed as they are; only the others are cut into pieces."""
    if "piece" in raw.columns:
        return _pieced_elements(raw)
    parsed = raw.withColumn("_parsed", _elements(F.col("value")))
    parsed = parsed.select(*raw.columns, _only_array("_parsed", F.col("value")).alias("_items"))
    texts = checkpointed(parsed.withColumn("_rest", F.col("_items").isNull() & F.col("value").isNotNull()))
    whole = texts.select(F.explode("_items").alias("item"), *_carried(raw))
    others = texts.where("_rest").drop("_items", "_rest")
    return whole if others.isEmpty() else whole.unionByName(_pieced_elements(others))


def _pieced_elements(raw: DataFrame) -> DataFrame:
    """The elements by pieces of the documents. Depth and quotation before a piece follow
    from the pieces before; an object of the array ends where a brace brings the depth back to one. What
    lies between two such ends is an array of its own once brackets are put around it."""
    if "piece" not in raw.columns:
        texts = checkpointed(raw.withColumn("_document", F.monotonically_increasing_id()))
        pieces = texts.select("_document", F.posexplode(F.split("value", r"\}")).alias("landed_place", "piece"), F.size(
            F.split("value", r"\}")).alias("_n"))
        pieces = pieces.select("piece", (F.col("landed_place") + 1 < F.col("_n")).alias("closes"), F.lit(0).alias("landed_block"),
                               "landed_place", F.col("_document").alias("landed_path"))
        carried = texts.select(F.col("_document").alias("landed_path"), *[F.col(c).alias(f"_{c}") for c in _carried(raw)])
    else:
        pieces, carried = raw, None

    def unquoted(text: Column) -> tuple[Column, Column]:
        """What is outside of strings, and whether one is open at the end."""
        rest = F.regexp_replace(text, JSON_TEXT, "")
        return F.regexp_replace(rest, r'"[\s\S]*\z', ""), rest.contains('"')

    quoted = F.regexp_extract(F.col("piece"), r'^(?:[^"\\]++|\\[\s\S])*+"([\s\S]*)\z', 1)
    closed = F.col("piece").rlike(r'^(?:[^"\\]++|\\[\s\S])*+"')
    plain, opens = unquoted(F.col("piece"))
    behind, again = unquoted(quoted)
    rows = pieces.withColumns({"_plain": plain, "_opens": opens, "_behind": F.when(closed, behind).otherwise(""),
                               "_stays": F.when(closed, again).otherwise(True)})
    rows = _with_quoted(checkpointed(rows), "_opens", "_stays", "_inside")
    outside = F.when(F.col("_inside"), F.col("_behind")).otherwise(F.col("_plain"))
    ends = F.col("closes") & ~F.when(F.col("_inside"), F.col("_stays")).otherwise(F.col("_opens"))
    deeper = F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))
    rows = checkpointed(rows.withColumns({"_ends": ends, "_deeper": deeper - ends.cast("int")}).drop("_plain", "_behind", "_opens", "_stays"))
    rows = _with_sum(rows, F.col("_deeper"), "_depth")
    whole = F.col("_ends") & (F.col("_depth") + F.col("_deeper") == 1)
    rows = _with_sum(checkpointed(rows.withColumn("_whole", whole)), F.col("_whole").cast("int"), "_element")

    at = F.struct("landed_block", "landed_place")
    part = F.concat("piece", F.when(F.col("closes"), "}").otherwise(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), part.alias("part")))), lambda x: x["part"]), "")
    times = [F.min("landed_at").alias("landed_at")] if "landed_at" in rows.columns else []
    groups = rows.groupBy("landed_path", "_element").agg(text.alias("text"), F.max("_whole").alias("_whole"), F.min(at).alias("_at"), *times)
    own = F.when(F.col("_element") == 0, F.col("text")).otherwise(F.regexp_replace("text", r"^\s*,", "["))
    parsed = F.from_json(F.concat(own, F.lit("]")), "array<variant>")
    groups = checkpointed(groups.where("_whole").withColumn("items", parsed))
    broken = groups.where("items IS NULL").groupBy("landed_path").agg(F.min("_element").alias("_break"))
    read = groups.join(broken, "landed_path", "left").where("_break IS NULL OR _element < _break")
    if carried is None:
        return read.select(F.explode("items").alias("item"), "landed_at", "landed_path", "_at.landed_block", "_at.landed_place")
    if not _carried(raw):
        return read.select(F.explode("items").alias("item"))
    return read.select("landed_path", F.explode("items").alias("item")).join(carried, "landed_path").select(
        "item", *[F.col(f"_{c}").alias(c) for c in _carried(raw)])


def read_raw(spark: SparkSession, feed: str, path: str, stream: bool = False, **options) -> DataFrame:
    """Landed files of one feed as ``value``, with where they stand: lines, or whole documents for the
    JSON feeds (``wholetext=False``: a document per line). ``feed`` names the feed."""
    reader = spark.readStream if stream else spark.read
    options = {"wholetext": feed in DOCUMENT_FEEDS, "lineSep": "\n"} | options
    landed = ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"]
    return reader.format("text").options(**options).load(path).select(
        "value", *[F.col(source).alias(name) for source, name in zip(landed, LANDED)], F.lit(feed).alias("feed"))


def _placed(rows: DataFrame) -> DataFrame:
    """Add the place in the block. Must come before anything that moves rows: those of one block of a file
    are then still in one partition in their order, which the growing row id keeps."""
    return rows if "landed_place" in rows.columns else rows.withColumn("landed_place", F.monotonically_increasing_id())


def normalised(raw: DataFrame) -> DataFrame:
    """Rows of ``read_raw``, of one feed or several, as threats with ``seq``, which sorts them by file time,
    path and place in the file. Not for a stream itself but for its batches."""
    raw = checkpointed(_placed(raw))
    threats = []
    for feed, normalise in NORMALISERS.items():
        own = raw.where(F.col("feed") == feed).drop("feed")
        threats.append(normalise(csv_records(own) if feed in CSV_FEEDS else own))
    return union_feeds(threats).withColumn("seq", F.struct(*LANDED)).drop(*LANDED)


def read_feed(spark: SparkSession, feed: str, path: str, **options) -> DataFrame:
    """Landed files of one feed as threats. Arrays of any size are read in blocks."""
    if feed in ARRAY_FEEDS and not options:
        return NORMALISERS[feed](json_pieces(spark, path)).drop(*LANDED)
    raw = read_raw(spark, feed, path, **options).drop("feed")
    return NORMALISERS[feed](csv_records(raw) if feed in CSV_FEEDS else raw).drop(*LANDED)


def union_feeds(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
