"""Facts read from a page body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values --------------------------------------------------------------------------------

BODY_BYTES = 200 * 1024
TITLE = r"(?iu)<title>([^\n]*?)</title>"
PASSWORD_FIELD = r"""(?iu)type=["']?password["']?"""
CARD_FIELD = r"(?iu)(cc_number|card_number|cvv|cvc|credit_card)"

# -----------------------------------------------------------------------------------------------


def body(html: Column) -> Column:
    """The part of a page that is looked at: its first 200 KiB."""
    cut = F.substring(html.cast("binary"), 1, BODY_BYTES).cast("string")
    return F.when(F.octet_length(html) > BODY_BYTES, cut).otherwise(html)


def page_title(html: Column) -> Column:
    return F.regexp_extract(body(html), TITLE, 1)


def has_password_field(html: Column) -> Column:
    return body(html).rlike(PASSWORD_FIELD)


def has_card_field(html: Column) -> Column:
    return body(html).rlike(CARD_FIELD)
