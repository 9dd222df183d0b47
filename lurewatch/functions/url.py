"""URL parts as native expressions.

Spark's own ``parse_url`` is not used: it rejects hosts such as ``a_b.com`` or non-ASCII ones that
the rules must see. The two entry points add columns stage by stage, so that each intermediate value
is computed once per row inside one generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.barrier import settled

# --- Fixed values: character sets and patterns of the URL grammar ------------------------------

# Everything Unicode calls white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0            "
    "    　"
)
CONTROL = r"[\x00-\x1f\x7f]"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
# In a host only non-ASCII bytes and the percent sign itself may be escaped.
BAD_HOST_ESCAPE = r"%(?!25|[89A-Fa-f][0-9A-Fa-f])"
BAD_HOST_CHAR = r"[ \\^`{|}]"
USERINFO = r"^[A-Za-z0-9\-._:~!$&'()*+,;=%@]*\z"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
IPV6 = (
    r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?=(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9A-Fa-f]{0,4}|[0-9.]+)(?:%|\]))"
    r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"
    r"(?::?(?:\d{1,3}\.){3}\d{1,3})?"
    r"|(?:[0-9A-Fa-f]{1,4}:){6}(?:\d{1,3}\.){3}\d{1,3})"
)
BRACKETED = r"\[(" + IPV6 + r"(?:%25[^\]]+)?)\](:[0-9]*)?\z"
IPV4_SHAPE = r"^(\d{1,3}\.){3}\d{1,3}\z"
BASE64_SHAPE = r"^[A-Za-z0-9+/]{20,}={0,2}\z"
HEX_SHAPE = r"^[0-9a-fA-F]{16,}\z"
NON_ASCII = r"[^\x00-\x7F]"
UNPRINTABLE = r"[^\x20-\x7E\n\r\t]"

# -----------------------------------------------------------------------------------------------


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def url_hash(url: Column) -> Column:
    """Lower-case hex SHA-256 of the URL exactly as given."""
    return F.sha2(url, 256)


def _after(text: Column, head: Column, skip: int) -> Column:
    """What follows ``head`` at the front of ``text``, leaving out ``skip`` separator characters."""
    return F.substr(text, F.length(head) + F.lit(1 + skip))


def _without_escapes(text: Column) -> Column:
    """Percent-decoding in which ``+`` stays ``+``."""
    return F.when(
        text.contains("%"), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    ).otherwise(text)


def _hostport(authority: Column) -> Column:
    return F.substring_index(authority, "@", -1)


def _authority_ok(authority: Column) -> Column:
    hostport = _hostport(authority)
    port = F.substring_index(hostport, ":", -1)
    userinfo = F.substr(
        authority, F.lit(1), F.length(authority) - F.length(hostport) - F.lit(1))
    user_ok = ~authority.contains("@") | (userinfo.rlike(USERINFO) & ~userinfo.rlike(BAD_ESCAPE))
    plain_ok = (
        (~hostport.contains(":") | port.rlike(r"^[0-9]*\z"))
        & ~hostport.rlike(BAD_HOST_CHAR)
        & ~hostport.rlike(BAD_HOST_ESCAPE)
    )
    host_ok = F.when(hostport.contains("["), hostport.rlike(BRACKETED)).otherwise(plain_ok)
    return user_ok & host_ok


def _host(hostport: Column) -> Column:
    """Host of a valid host[:port], without brackets and port, still percent-encoded."""
    plain = F.when(
        hostport.contains(":"),
        F.substr(
            hostport,
            F.lit(1),
            F.length(hostport) - F.length(F.substring_index(hostport, ":", -1)) - F.lit(1),
        ),
    ).otherwise(hostport)
    return F.when(hostport.contains("["), F.regexp_extract(hostport, BRACKETED, 1)).otherwise(plain)


def _port(hostport: Column) -> Column:
    plain = F.when(hostport.contains(":"), F.substring_index(hostport, ":", -1)).otherwise(F.lit(""))
    bracketed = F.ltrim(F.regexp_extract(hostport, BRACKETED, 2), F.lit(":"))
    return F.when(hostport.contains("["), bracketed).otherwise(plain)


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``raw, parsed, scheme, hostname, path, query, has_userinfo, port, clean_host, tokens``.

    The URL is read as given; when that fails or yields no host it is read again as a schemeless
    ``host/path``. If both fail, ``parsed`` is false and the other parts are NULL.
    """
    c = F.col
    kept = df.columns
    df = df.withColumn("raw", trimmed(c(url)))
    df = df.withColumn("_head", F.substring_index("raw", "#", 1))
    df = df.withColumns(
        {
            "_line": F.substring_index("_head", "?", 1),
            "_head_ok": ~c("_head").rlike(CONTROL)
            & (~c("raw").contains("%") | ~_after(c("raw"), c("_head"), 1).rlike(BAD_ESCAPE)),
        }
    )
    df = df.withColumns(
        {
            "query": _after(c("_head"), c("_line"), 1),
            "_scheme": F.regexp_extract("_line", SCHEME, 1),
            "_authority2": F.substring_index("_line", "/", 1),
        }
    )
    df = df.withColumn(
        "_rest", F.when(c("_scheme") != "", _after(c("_line"), c("_scheme"), 1)).otherwise(c("_line"))
    )
    df = df.withColumn(
        "_authority1",
        F.when(
            c("_rest").startswith("//") & ((c("_scheme") != "") | ~c("_rest").startswith("///")),
            F.substring_index(F.substr(c("_rest"), F.lit(3)), "/", 1),
        ),
    )
    df = df.withColumns(
        {
            "_path1": F.substr(c("_rest"), F.length("_authority1") + F.lit(3)),
            "_path2": _after(c("_line"), c("_authority2"), 0),
        }
    )
    df = df.withColumn(
        "_as_given",
        F.coalesce(
            c("_head_ok")
            & _authority_ok(c("_authority1"))
            & ~c("_path1").rlike(BAD_ESCAPE)
            & (_host(_hostport(c("_authority1"))) != ""),
            F.lit(False),
        ),
    )
    df = df.withColumns(
        {
            "_authority": F.when(c("_as_given"), c("_authority1")).when(
                c("_head_ok") & _authority_ok(c("_authority2")) & ~c("_path2").rlike(BAD_ESCAPE),
                c("_authority2"),
            ),
        }
    )
    df = df.withColumns(
        {
            "parsed": c("_authority").isNotNull(),
            "_hostport": _hostport(c("_authority")),
            "_path": F.when(c("_as_given"), c("_path1")).otherwise(c("_path2")),
        }
    )
    df = df.withColumns(
        {
            "scheme": F.when(c("_as_given"), F.lower("_scheme")).when(c("parsed"), F.lit("http")),
            "hostname": F.lower(_without_escapes(_host(c("_hostport")))),
            "path": F.when(c("parsed"), _without_escapes(c("_path"))),
            "has_userinfo": c("_authority").contains("@"),
            "port": F.when(c("parsed"), _port(c("_hostport"))),
            "query": F.when(c("parsed"), c("query")),
        }
    )
    df = df.withColumn("clean_host", without_www(c("hostname")))
    df = df.withColumn("tokens", host_tokens(c("clean_host")))
    added = ["raw", "parsed", "scheme", "hostname", "path", "query", "has_userinfo", "port",
             "clean_host", "tokens"]
    return settled(df.select(*kept, *added), *added)


def with_lookup_host(df: DataFrame, url: str = "url", host: str = "host") -> DataFrame:
    """Add the host used for the allow-list and for observation tables: lower case, without one
    leading ``www.``. Only http and https count as schemes here, anything else is read as a host.
    NULL when the URL cannot be parsed."""
    c = F.col
    kept = [name for name in df.columns if name != host]
    df = df.withColumn("_text", trimmed(F.lower(url)))
    df = df.withColumn(
        "_text",
        F.when(c("_text").startswith("http://"), F.substr(c("_text"), F.lit(8)))
        .when(c("_text").startswith("https://"), F.substr(c("_text"), F.lit(9)))
        .otherwise(c("_text")),
    )
    df = df.withColumn("_head", F.substring_index("_text", "#", 1))
    df = df.withColumn("_line", F.substring_index("_head", "?", 1))
    df = df.withColumn("_authority", F.substring_index("_line", "/", 1))
    escapes_ok = (
        ~_after(c("_text"), c("_head"), 1).rlike(BAD_ESCAPE)
        & ~_after(c("_line"), c("_authority"), 0).rlike(BAD_ESCAPE)
    )
    df = df.withColumn(
        "_hostport",
        F.when(
            ~c("_head").rlike(CONTROL)
            & (~c("_text").contains("%") | escapes_ok)
            & _authority_ok(c("_authority")),
            _hostport(c("_authority")),
        ),
    )
    named = df.select(*kept, without_www(_without_escapes(_host(c("_hostport")))).alias(host))
    return settled(named, host)


def without_www(host: Column) -> Column:
    return F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(host)


def host_tokens(host: Column) -> Column:
    """Labels split further at hyphens; empty ones dropped."""
    return F.filter(F.split(host, "[.-]"), lambda token: token != "")


def top_level_domain(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def dot_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))


def root_domain(host: Column) -> Column:
    """The last two labels when there are more than two, otherwise the host itself."""
    return F.substring_index(host, ".", -2)


def is_ipv4_shaped(host: Column) -> Column:
    return host.rlike(IPV4_SHAPE)


def entropy(text: Column) -> Column:
    """Shannon entropy over characters, with the byte length as the denominator."""
    size = F.octet_length(text).cast("double")

    def add(total: Column, char: Column) -> Column:
        share = (F.length(text) - F.length(F.replace(text, char, F.lit("")))) / size
        return total - share * F.log2(share)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda char: char != ""))
    return F.when(text == "", F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), add))


def entropy_above(text: Column, limit: float) -> Column:
    """``entropy(text) > limit``. The entropy of n bytes is at most log2(n), so short texts are
    decided without counting characters."""
    shortest = int(2**limit) + 1
    return (F.octet_length(text) >= shortest) & (entropy(text) > limit)


def trimmed_path(path: Column) -> Column:
    return F.btrim(path, F.lit("/"))


def is_encoded_payload(path: Column) -> Column:
    """A strictly padded base64 path of which more than 70 % decodes to printable characters."""
    text = trimmed_path(path)
    bytes_ = F.try_to_binary(text, F.lit("base64"))
    printable = F.octet_length(
        F.regexp_replace(F.decode(bytes_, "ISO-8859-1"), UNPRINTABLE, "")
    ) / F.octet_length(bytes_)
    return F.coalesce(
        text.rlike(BASE64_SHAPE) & (F.length(text) % 4 == 0) & (printable > 0.7), F.lit(False)
    )


def is_hex_payload(path: Column) -> Column:
    return trimmed_path(path).rlike(HEX_SHAPE)


def fetch_target(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
