"""Ages in whole days, and the date notations of registration records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.barrier import settled
from lurewatch.functions.url import trimmed

DAY = 86_400

# --- Fixed values: accepted notations, tried in this order, and where year, month, day, time and zone
# --- of each are found -----------------------------------------------------------------------------

TIME = r"(\d{1,2}:\d{2}:\d{2})(?:[.,]\d+)?"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
MONTH = r"((?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec))"
WEEKDAY = r"(?i:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
NOTATIONS = [
    (rf"^(\d{{4}})-(\d\d)-(\d\d)T{TIME}(Z|[+-]\d\d:\d\d)\z", "$1-$2-$3 $4$5"),
    (rf"^(\d{{4}})-(\d\d)-(\d\d) +{TIME}\z", "$1-$2-$3 $4Z"),
    (r"^(\d{4})-(\d\d)-(\d\d)\z", "$1-$2-$3 0:00:00Z"),
    (r"^(\d\d)\.(\d\d)\.(\d{4})\z", "$3-$2-$1 0:00:00Z"),
    (rf"^(\d\d)-{MONTH}-(\d{{4}})\z", "$3-$2-$1 0:00:00Z"),
    (r"^(\d{4})\.(\d\d)\.(\d\d)\z", "$1-$2-$3 0:00:00Z"),
    (rf"^{WEEKDAY} +{MONTH} +(\d\d) +{TIME} +(\d{{4}})\z", "$4-$1-$2 $3Z"),
    (rf"^(\d{{4}})-(\d\d)-(\d\d) +{TIME} +\+0000\z", "$1-$2-$3 $4Z"),
]

CUT_NOTATION = NOTATIONS[2][0]  # the only one a text with a bracket is tried against

# -----------------------------------------------------------------------------------------------


def whole_days(seconds: Column) -> Column:
    """Seconds to days, cut toward zero."""
    return (seconds.cast("double") / DAY).cast("int")


def with_registration_age(
    df: DataFrame, created: str, as_of_seconds: Column, into: str = "domain_age_days",
) -> DataFrame:
    """Add the days since a registration date in any known notation; 0 when it is missing or cannot be
    read. A text with ``(`` is read by its first ten characters, as year, month and day. Without a zone the
    date is taken as UTC."""
    kept = [name for name in df.columns if name != into]
    text = trimmed(F.col(created))
    df = df.withColumn(
        "_text", F.when(text.contains("("), F.substr(text, F.lit(1), F.lit(10))).otherwise(text))
    iso = F
    for pattern, parts in NOTATIONS:
        fits = F.col("_text").rlike(pattern)
        if pattern != CUT_NOTATION:
            fits = fits & ~text.contains("(")
        iso = iso.when(fits, F.regexp_replace("_text", pattern, parts))
    df = df.withColumn("_iso", iso)
    position = F.instr(F.lit(MONTHS.lower()), F.lower(F.substring("_iso", 6, 3)))
    number = F.lpad(((position + 2) / 3).cast("int").cast("string"), 2, "0")
    numeric = F.concat(F.substring("_iso", 1, 5), number, F.substr("_iso", F.lit(9)))
    df = df.withColumn(
        "_iso", F.when(F.col("_iso").rlike("^.{5}[A-Za-z]"), numeric).otherwise(F.col("_iso")))
    moment = F.unix_seconds(F.try_to_timestamp("_iso", F.lit("yyyy-MM-dd H:mm:ssXXX")))
    fraction = F.concat(F.lit("0."), F.regexp_extract("_text", r"\d:\d{2}[.,](\d{1,15})", 1)).cast("double")
    age = F.coalesce(whole_days(as_of_seconds - moment - fraction), F.lit(0))
    return settled(df.select(*kept, age.alias(into)), into)
