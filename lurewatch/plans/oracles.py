"""Checking SQL per catalogue entry, written for DuckDB and independent of the Spark expressions: one row
per finding and grouping, where the engine builds arrays per row."""

from __future__ import annotations

import re

from lurewatch.functions.score import SEVERITIES
from lurewatch.plans import corpus
from lurewatch.plans.corpus import AS_OF_SECONDS
from lurewatch.plans.queries import RULE_KEYS

TABLES = {name: name for name in corpus.DRIVER_TABLES}
BAD_ESC = "'%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)'"
AUTHORITY = r"'([A-Za-z0-9._:~!$&''()*+,;=%@-]*@)?[^ @\\^`{|}:%]*(:[0-9]*)?'"


def host_of(authority: str) -> str:
    return f"lower(regexp_extract({authority}, '^(?:.*@)?([^:]*)(?::[0-9]*)?$', 1))"


def no_www(host: str) -> str:
    return f"regexp_replace({host}, '^www[.]', '')"


def parts_body(source: str) -> str:
    return f"""
SELECT url_id, url, raw, ok1 OR ok2 AS parsed,
  CASE WHEN ok1 THEN lower(scheme) WHEN ok2 THEN 'http' END AS scheme,
  CASE WHEN ok1 THEN {host_of('a1')} WHEN ok2 THEN {host_of('a2')} END AS hostname,
  CASE WHEN ok1 THEN url_decode(p1) WHEN ok2 THEN url_decode(p2) END AS path,
  CASE WHEN ok1 OR ok2 THEN query END AS query,
  CASE WHEN ok1 THEN contains(a1, '@') WHEN ok2 THEN contains(a2, '@') END AS has_userinfo,
  CASE WHEN ok1 THEN regexp_extract(a1, ':([0-9]*)$', 1) WHEN ok2 THEN regexp_extract(a2, ':([0-9]*)$', 1) END AS port,
  {no_www(f"CASE WHEN ok1 THEN {host_of('a1')} WHEN ok2 THEN {host_of('a2')} END")} AS clean_host
FROM (
  SELECT *, head_ok AND a1 IS NOT NULL AND coalesce(regexp_full_match(a1, {AUTHORITY}), false) AND NOT regexp_matches(p1, {BAD_ESC})
      AND {host_of('a1')} <> '' AS ok1,
    head_ok AND regexp_full_match(a2, {AUTHORITY}) AND NOT regexp_matches(p2, {BAD_ESC}) AS ok2
  FROM (
    SELECT *, coalesce(substr(rest, 3 + length(a1)), '') AS p1, substr(line, 1 + length(a2)) AS p2 FROM (
      SELECT *, CASE WHEN starts_with(rest, '//') AND (scheme <> '' OR NOT starts_with(rest, '///')) THEN split_part(substr(rest, 3), '/', 1) END AS a1,
        split_part(line, '/', 1) AS a2 FROM (
        SELECT *, CASE WHEN scheme <> '' THEN substr(line, length(scheme) + 2) ELSE line END AS rest FROM (
          SELECT *, substr(head, length(line) + 2) AS query, regexp_extract(line, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme,
            NOT regexp_matches(head, '[\\x00-\\x1f\\x7f]') AND NOT regexp_matches(substr(raw, length(head) + 2), {BAD_ESC}) AS head_ok FROM (
            SELECT *, split_part(head, '?', 1) AS line FROM (
              SELECT *, split_part(raw, '#', 1) AS head FROM (
                SELECT url_id, url, trim(url, E' \\t\\r\\n') AS raw FROM {source})))))))) q"""


def host_body(source: str, key: str = "url_id") -> str:
    return f"""
SELECT {key}, url, CASE WHEN regexp_full_match(a, {AUTHORITY}) AND NOT regexp_matches(p, {BAD_ESC}) THEN {no_www(host_of('a'))} END AS host FROM (
  SELECT *, split_part(line, '/', 1) AS a, substr(line, length(split_part(line, '/', 1)) + 1) AS p FROM (
    SELECT {key}, url, split_part(split_part(regexp_replace(lower(trim(url)), '^https?://', ''), '#', 1), '?', 1) AS line FROM {source}))"""


def entropy_of(table: str, text: str, key: str) -> str:
    return f"""
SELECT {key}, {text} AS s, sum(-p * log2(p)) AS entropy FROM (
  SELECT {key}, {text}, ch, count(*)::DOUBLE / strlen({text}) AS p
  FROM (SELECT {key}, {text}, unnest(string_split({text}, '')) AS ch FROM {table}) WHERE ch <> '' GROUP BY {key}, {text}, ch)
GROUP BY {key}, {text}"""


def domain_age(key: str = "url_id") -> str:
    return f"CASE WHEN {key} % 4 = 0 THEN {key} % 30 WHEN {key} % 4 = 1 THEN 400 ELSE 0 END"


IPV4 = "regexp_full_match(hostname, '([0-9]{1,3}[.]){3}[0-9]{1,3}')"
PATH = "trim(path, '/')"


def hits_body(parts: str, tokens: str, ages: str) -> str:
    """One row per finding: url_id, ord, name, desc, score."""
    def single(ord_: int, name: str, desc: str, score: str, where: str, source: str = parts) -> str:
        return (f"SELECT url_id, {ord_} AS ord, '{name}' AS name, {desc} AS \"desc\", {score} AS score "
                f"FROM {source} WHERE parsed AND ({where})")

    plain = "regexp_replace(t, '[^\\x00-\\x7F]', '?', 'g')"
    enc = (f"regexp_full_match({PATH}, '[A-Za-z0-9+/]{{20,}}={{0,2}}') AND coalesce(TRY(len(list_filter(range(octet_length(from_base64({PATH}))::BIGINT), "
           f"lambda i: hex(from_base64({PATH}))[2*i+1:2*i+2] BETWEEN '20' AND '7E' OR hex(from_base64({PATH}))[2*i+1:2*i+2] IN ('09','0A','0D')))"
           f"::DOUBLE / octet_length(from_base64({PATH})) > 0.7), false)")
    return "\nUNION ALL ".join([
        single(1, "Insecure Protocol", "'Non-HTTPS scheme'", "10", "scheme <> 'https'"),
        single(2, "Unicode Spoof", "'Domain contains confusable chars'", "60", "strlen(hostname) <> length(hostname)"),
        single(3, "Suspicious Keyword in Domain", "concat('Keyword ''', t, '''')", "score",
               "true", f"(SELECT * FROM {tokens} JOIN config_keywords ON t = word)"),
        single(4, "Suspicious Keyword in Path", "concat('Keyword ''', word, '''')", "least(score, 15)",
               "contains(lower(path), word)", f"{parts}, config_keywords"),
        single(5, "Typosquatting", "concat('Token ''', t, ''' ~ ''', b.name, '''')", "55",
               f"strlen(t) >= 4 AND t <> b.name AND (levenshtein({plain}, b.name) = 1 OR (strlen(b.name) >= 6 AND levenshtein({plain}, b.name) <= 2))",
               f"{tokens}, config_brands b"),
        single(6, "Brand Injection", "concat('Brand ''', b.name, ''' injected')", "40",
               "contains(clean_host, b.name || '-') OR contains(clean_host, '-' || b.name)", f"{parts}, config_brands b"),
        single(7, "Fake Parent Domain", "concat('Subdomain uses ''', b.name, '''')", "65",
               "contains(clean_host, b.name || '.') AND NOT (starts_with(clean_host, b.name || '.') AND NOT contains(substr(clean_host, length(b.name) + 2), '.'))",
               f"{parts}, config_brands b"),
        single(8, "Punycode", "'IDN detected'", "50", "contains(hostname, 'xn--')"),
        single(9, "High Entropy Domain", "'Random chars'", "10", "entropy > 4.2",
               f"(SELECT p.*, entropy FROM {parts} p JOIN host_ent e USING (url_id))"),
        single(10, "High Entropy Token", "concat('Token ''', t, ''' looks random')", "15", "strlen(t) > 5 AND entropy > 3.8",
               f"(SELECT k.*, entropy FROM {tokens} k JOIN token_ent e ON e.s = k.t)"),
        single(11, "Long Domain", "'Length > 50'", "10", "strlen(clean_host) > 50"),
        single(12, "Oversized Token", "'Token > 25 chars'", "15", "strlen(t) > 25", tokens),
        single(13, "Excessive Hyphens", "'4+ hyphens'", "10", "len(string_split(clean_host, '-')) > 4"),
        single(14, "Deep Subdomain", "'4+ levels'", "15", f"len(string_split(hostname, '.')) > 4 AND NOT {IPV4}"),
        single(15, "IP Hostname", "'Direct IP access'", "40", IPV4),
        single(16, "Suspicious TLD", "concat('Risky TLD: .', tld)", "score", "contains(hostname, '.')",
               f"{parts} JOIN config_tlds ON tld = split_part(hostname, '.', -1)"),
        single(17, "Userinfo Abuse", "'URL contains userinfo'", "50", "has_userinfo"),
        single(18, "Suspicious Port", "concat('Port: ', port)", "25", "port NOT IN ('', '80', '443')"),
        single(19, "Encoded Payload", "'Base64 path'", "25", enc),
        single(20, "Hex Payload", "'Hex path'", "15", f"regexp_full_match({PATH}, '[0-9a-fA-F]{{16,}}')"),
        single(21, "Open Redirect", "'Redirect param'", "25", "regexp_matches(query, '(redirect|next|url)=')"),
        single(22, "Sensitive Query Parameter", "'Session/Token param'", "15", "regexp_matches(query, '(token|session|aff_id)=')"),
        single(23, "Obfuscated URL", "'Contains @'", "25", "contains(raw, '@') AND NOT has_userinfo"),
        single(24, "URL Shortener", "'Short URL'", "score", "true", f"{parts} JOIN config_shorteners ON domain = clean_host"),
        single(25, "IPFS Hosting", "'Decentralized storage'", "35", "contains(raw, 'ipfs://') OR contains(hostname, 'ipfs')"),
        single(26, "Cloud Worker", "'Cloud worker'", "25", "regexp_matches(hostname, '[.](workers|pages)[.]dev$')"),
        single(27, "Newly Registered Domain", "'Domain < 2 weeks old'", "40", "age > 0 AND age <= 14",
               f"(SELECT p.*, g.age FROM {parts} p JOIN {ages} g USING (url_id))"),
    ])


def sums_body(hits: str, ids: str) -> str:
    return f"""
SELECT i.url_id, coalesce(sum(score) FILTER (score >= 40), 0)::INT AS critical, coalesce(sum(score) FILTER (score >= 25 AND score < 40), 0)::INT AS high,
  coalesce(sum(score) FILTER (score >= 15 AND score < 25), 0)::INT AS medium, coalesce(sum(score) FILTER (score < 15), 0)::INT AS low,
  coalesce(bool_or(name = 'Typosquatting') AND bool_or(name = 'Punycode'), false) AS pair, count(name) AS n
FROM {ids} i LEFT JOIN {hits} h ON h.url_id = i.url_id GROUP BY i.url_id"""


def score_body(sums: str, ages: str) -> str:
    """url_id, n, lexical_score from severity sums and (url_id, age, trusted)."""
    return f"""
SELECT url_id, n, least(greatest(CASE WHEN age > 365 AND c = 0 AND h = 0 THEN trunc(s * 0.4::DOUBLE) ELSE s END, 0), 100)::INT AS lexical_score FROM (
  SELECT *, trunc((c * 1.5::DOUBLE + h * 1.0::DOUBLE + m * 0.8::DOUBLE + l * 0.5::DOUBLE)
    * (1.0::DOUBLE + CASE WHEN c >= 50 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN c >= 100 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN pair THEN 0.25::DOUBLE ELSE 0 END)) AS s FROM (
    SELECT url_id, n, age, pair, critical AS c, CASE WHEN trusted THEN greatest(high - 10, 0) ELSE high END AS h,
      CASE WHEN age > 365 THEN trunc(medium * 0.6::DOUBLE) ELSE medium END AS m, CASE WHEN age > 365 THEN trunc(low * 0.5::DOUBLE) ELSE low END AS l
    FROM {sums} JOIN {ages} USING (url_id)))"""


DAYS = "trunc(({}) / 86400.0::DOUBLE)::INT"


def _date(fmt: str, text: str = "c") -> str:
    return f"epoch(try_strptime({text}, '{fmt}'))"


WHOIS_SECONDS = "coalesce(" + ", ".join([
    "CASE WHEN contains(c, '(') THEN epoch(try_strptime(left(c, 10), '%Y-%m-%d')) END",
    "CASE WHEN regexp_matches(c, 'T.*Z$') THEN " + _date("%Y-%m-%dT%H:%M:%SZ") + " END",
    "CASE WHEN regexp_matches(c, 'T.*[+]05:00$') THEN " + _date("%Y-%m-%dT%H:%M:%S+05:00") + " - 18000 END",
    _date("%Y-%m-%d %H:%M:%S"), _date("%Y-%m-%d"), _date("%d.%m.%Y"), _date("%d-%b-%Y"), _date("%Y.%m.%d"),
    _date("%a %b %d %H:%M:%S %Y", "regexp_replace(c, '^[A-Z][a-z]{2} ', strftime(try_strptime(regexp_replace(c, '^[A-Z][a-z]{2} ', ''), '%b %d %H:%M:%S %Y'), '%a '))"),
    _date("%Y-%m-%d %H:%M:%S +0000")]) + ")"

IP_NUM = ("split_part(ip,'.',1)::BIGINT*16777216 + split_part(ip,'.',2)::BIGINT*65536 + split_part(ip,'.',3)::BIGINT*256 + split_part(ip,'.',4)::BIGINT")
TRUSTED = "regexp_matches(lower(isp), 'google|amazon|cloudflare|microsoft|fastly|akamai')"

SHARED: dict[str, str] = {
    "parts": parts_body("url_corpus"),
    "hosts": host_body("url_corpus"),
    "tokens": "SELECT * FROM (SELECT *, unnest(string_split_regex(clean_host, '[.-]')) AS t FROM parts) WHERE t <> ''",
    "host_ent": entropy_of("(SELECT * FROM parts WHERE parsed)", "clean_host", "url_id"),
    "token_ent": re.sub(r"\bk, ", "", entropy_of("(SELECT DISTINCT t, 0 AS z FROM tokens)", "t", "z")),
    "ages": f"SELECT url_id, {domain_age()} AS age, url_id % 3 = 0 AS trusted FROM url_corpus",
    "hits": hits_body("parts", "tokens", "ages"),
    "sums": sums_body("hits", "url_corpus"),
    "scores": score_body("sums", "ages"),
    "first_threats": """
SELECT * EXCLUDE (rn) FROM (SELECT *, sha256(url) AS url_hash, row_number() OVER (PARTITION BY url, source ORDER BY seq) AS rn FROM threat_raw) WHERE rn = 1""",
    "stored": f"SELECT *, strftime(to_timestamp({AS_OF_SECONDS} - seq % 50 * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d') AS first_seen, seq % 50 AS back FROM first_threats",
    "whois": f"SELECT host, created_raw, coalesce({DAYS.format(f'{AS_OF_SECONDS} - {WHOIS_SECONDS}')}, 0) AS age FROM (SELECT *, trim(created_raw) AS c FROM whois_obs)",
    "tls": f"""
SELECT host, has_cert AND {AS_OF_SECONDS} > not_before_s AND {AS_OF_SECONDS} < not_after_s AS valid, CASE WHEN has_cert THEN issuer ELSE '' END AS issuer,
  CASE WHEN has_cert THEN {DAYS.format(f'{AS_OF_SECONDS} - not_before_s')} ELSE 0 END AS age_days,
  CASE WHEN has_cert THEN {DAYS.format(f'not_after_s - {AS_OF_SECONDS}')} ELSE 0 END AS expires_in, true AS is_https FROM tls_obs""",
    "pages_seen": """
SELECT *, regexp_extract(html, '(?i)<title>([^\\n]*?)</title>', 1) AS title, regexp_matches(html, '(?i)type=["'']?password["'']?') AS password_field,
  regexp_matches(html, '(?i)(cc_number|card_number|cvv|cvc|credit_card)') AS card_field
FROM (SELECT page_id, url, n_redirects, CASE WHEN strlen(html) > 204800 THEN left(html, 204800) ELSE html END AS html FROM http_obs)""",
    "located": f"""
SELECT d.host, d.ip, d.resolve_ms, d.mx, d.ns, coalesce(c.country, '') AS country, coalesce(a.org, '') AS isp, coalesce(a.asn, 0)::BIGINT AS asn
FROM (SELECT *, CASE WHEN ip IS NOT NULL THEN {IP_NUM} END AS n FROM dns_all) d
LEFT JOIN asn_ranges a ON d.n BETWEEN a.start_ip AND a.end_ip LEFT JOIN country_ranges c ON d.n BETWEEN c.start_ip AND c.end_ip WHERE d.ip IS NOT NULL""",
    "host_hits": """
SELECT host, 1 AS ord, 'Slow DNS' AS name, 'Resolve time > 500ms' AS "desc", 5 AS score FROM located WHERE resolve_ms > 500
UNION ALL SELECT host, 2, 'Risky Country', g.country, g.score FROM located l JOIN config_geo_risks g ON g.country = l.country
UNION ALL SELECT host, CASE WHEN type = 'bulletproof' THEN 3 ELSE 4 END, CASE WHEN type = 'bulletproof' THEN 'Bulletproof Hosting' ELSE 'Cloud Hosting' END, isp, score FROM (
  SELECT host, isp, h.*, row_number() OVER (PARTITION BY host ORDER BY h.id) AS rn FROM located JOIN config_hosting h ON contains(lower(isp), lower(h.pattern))) WHERE rn = 1
UNION ALL SELECT host, 5, 'No HTTPS', 'No secure connection', 5 FROM located WHERE host NOT IN (SELECT host FROM tls)
UNION ALL SELECT host, 6, 'Invalid SSL', 'Expired or invalid', 25 FROM located JOIN tls USING (host) WHERE NOT valid
UNION ALL SELECT host, 7, 'New SSL', 'Created today (<24h)', 30 FROM located JOIN tls USING (host) WHERE age_days < 1
UNION ALL SELECT host, 8, 'Fresh SSL', 'Created recently', 10 FROM located JOIN tls USING (host) WHERE age_days = 1
UNION ALL SELECT host, 8, 'Fresh SSL', 'Created this week', 5 FROM located JOIN tls USING (host) WHERE age_days BETWEEN 2 AND 6
UNION ALL SELECT host, 9, 'Free SSL on New Site', 'Short-lived free cert', 5 FROM located JOIN tls USING (host) WHERE age_days < 14 AND regexp_matches(issuer, 'Let''s Encrypt|ZeroSSL')
UNION ALL SELECT host, 10, 'No MX Records', 'Domain cannot receive emails', 5 FROM located WHERE mx IS NULL""",
    "page_hits": """
SELECT url, 11 AS ord, 'Password Field Detected' AS name, 'Page contains a password input field' AS "desc", 10 AS score FROM pages_seen WHERE password_field
UNION ALL SELECT url, 12, 'Credit Card Field', 'Page requests payment details', 20 FROM pages_seen WHERE card_field
UNION ALL SELECT url, 13, 'Multiple Redirects', 'Chain of redirects detected', 15 FROM pages_seen WHERE n_redirects > 2""",
}


def check_ctes(prefix: str, source: str, key: str) -> dict[str, str]:
    """The full check over ``source`` (with ``key`` as the row id), in steps named by ``prefix``."""
    p = prefix
    fill = f"(SELECT {key} AS url_id, url FROM {source})"
    listed = f"(SELECT url, count(*) AS n_lists FROM stored GROUP BY url)"
    infra_names = "('Slow DNS', 'Cloud Hosting')"
    return {
        f"{p}rows": f"SELECT * FROM (SELECT {key} AS url_id, url FROM {source})",
        f"{p}hosts": host_body(f"{p}rows"),
        f"{p}white": f"""
SELECT url_id, url, host FROM {p}hosts WHERE host IN (SELECT domain FROM whitelist)
  OR (len(string_split(host, '.')) > 2 AND array_to_string(string_split(host, '.')[-2:], '.') IN (SELECT domain FROM whitelist))""",
        f"{p}facts": f"""
SELECT h.url_id, h.url, nullif(h.host, '') AS host, l.ip IS NOT NULL AS online, l.ip, l.isp, coalesce(w.age, 0) AS whois_age, w.created_raw,
  t.host IS NOT NULL AND l.ip IS NOT NULL AS has_tls, t.host IS NOT NULL AS any_tls, CASE WHEN l.ip IS NOT NULL THEN t.age_days END AS tls_age, coalesce(b.n_lists, 0) AS n_lists, ps.n_redirects
FROM {p}hosts h LEFT JOIN located l ON l.host = h.host LEFT JOIN whois w ON w.host = h.host LEFT JOIN tls t ON t.host = h.host
LEFT JOIN {listed} b ON b.url = h.url LEFT JOIN pages_seen ps ON ps.url = h.url""",
        f"{p}ages": f"""
SELECT url_id, CASE WHEN whois_age = 0 THEN coalesce(tls_age, 0) ELSE whois_age END AS age, online AND {TRUSTED} AS trusted FROM {p}facts""",
        f"{p}open": f"SELECT url_id, url FROM {p}rows WHERE url_id NOT IN (SELECT url_id FROM {p}white)",
        f"{p}parts": parts_body(f"{p}rows"),
        f"{p}tokens": f"SELECT * FROM (SELECT *, unnest(string_split_regex(clean_host, '[.-]')) AS t FROM {p}parts) WHERE t <> ''",
        f"{p}host_ent": entropy_of(f"(SELECT * FROM {p}parts WHERE parsed)", "clean_host", "url_id"),
        f"{p}token_ent": entropy_of(f"(SELECT DISTINCT t, 0 AS z FROM {p}tokens)", "t", "z"),
        f"{p}hits": hits_body(f"{p}parts", f"{p}tokens", f"{p}ages").replace("JOIN host_ent", f"JOIN {p}host_ent").replace("JOIN token_ent", f"JOIN {p}token_ent"),
        f"{p}sums": sums_body(f"{p}hits", f"{p}rows"),
        f"{p}scores": score_body(f"{p}sums", f"{p}ages"),
        f"{p}infra_hits": f"""
SELECT f.url_id, h.ord, h.name, h."desc", h.score FROM {p}facts f JOIN host_hits h ON h.host = f.host
UNION ALL SELECT f.url_id, h.ord, h.name, h."desc", h.score FROM {p}facts f JOIN page_hits h ON h.url = f.url WHERE f.online""",
        f"{p}infra": f"""
SELECT url_id, raw AS infra_raw, greatest(CASE WHEN age > 365 THEN trunc(raw * 0.5::DOUBLE)::INT ELSE raw END - CASE WHEN trusted THEN 10 ELSE 0 END, 0)::INT AS infra_score FROM (
  SELECT g.url_id, g.age, g.trusted, coalesce(sum(h.score) FILTER (h.ord BETWEEN 2 AND 10 AND h.name NOT IN {infra_names}), 0)::INT AS raw
  FROM {p}ages g LEFT JOIN {p}infra_hits h ON h.url_id = g.url_id GROUP BY g.url_id, g.age, g.trusted)""",
        f"{p}counts": f"""
SELECT url_id, count(*) FILTER (score >= 40)::INT AS n_critical, count(*) FILTER (score BETWEEN 25 AND 39)::INT AS n_high,
  count(*) FILTER (score BETWEEN 15 AND 24)::INT AS n_medium, count(*) FILTER (score < 15)::INT AS n_low
FROM (SELECT url_id, score FROM {p}hits UNION ALL SELECT url_id, score FROM {p}infra_hits) GROUP BY url_id""",
        f"{p}report": f"""
SELECT url_id, url AS target, CASE WHEN n_lists > 0 THEN 'Dangerous' WHEN risk_score < 20 THEN 'Safe' WHEN risk_score < 60 THEN 'Suspicious' ELSE 'Dangerous' END AS verdict,
  risk_score, CASE WHEN n_lists > 0 THEN 'Found in Blacklist' WHEN n > 0 THEN 'Suspicious Activity Detected' END AS reason,
  coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low, n_lists::INT AS n_lists
FROM (SELECT o.url, f.*, s.n, c.* EXCLUDE (url_id), CASE WHEN n_lists > 0 THEN 100 ELSE least(i.infra_score + CASE WHEN i.infra_score < 100 THEN s.lexical_score ELSE 0 END, 100) END::INT AS risk_score
  FROM {p}open o JOIN (SELECT * EXCLUDE (url) FROM {p}facts) f ON f.url_id = o.url_id JOIN {p}scores s ON s.url_id = o.url_id JOIN {p}infra i ON i.url_id = o.url_id LEFT JOIN {p}counts c ON c.url_id = o.url_id)
UNION ALL SELECT url_id, url, 'Safe', 0, 'Whitelisted Domain', 0, 0, 0, 0, 0 FROM {p}white""",
        f"{p}signals": f"""
SELECT url_id, row_number() OVER (PARTITION BY url_id ORDER BY part, k1, k2, k3, k4)::INT AS pos, signal FROM (
  SELECT o.url_id, 0 AS part, -back AS k1, 0 AS k2, source AS k3, '' AS k4, concat('Listed in ', source, ' as ', threat_type) AS signal FROM {p}open o JOIN stored b ON b.url = o.url
  UNION ALL SELECT url_id, 1, ord, 0, '', '', name FROM {p}infra_hits
  UNION ALL SELECT url_id, 2, -score, ord, "desc", '', name FROM {p}hits) WHERE url_id IN (SELECT url_id FROM {p}open)""",
    }


SHARED.update(check_ctes("t_", "check_targets", "url_id"))
SHARED.update(check_ctes("s_", "check_requests", "event_id"))
SHARED.update(check_ctes("r_", "store_requests", "event_id"))


def with_ctes(sql: str) -> str:
    """Prefix a statement with the definitions it needs, dependencies first."""
    done: list[str] = []
    text: list[str] = []

    def need(body: str) -> None:
        for name in [*corpus.VIEWS, *SHARED]:
            if name not in done and re.search(rf"\b{name}\b", body):
                add(name)

    def add(name: str) -> None:
        if name in done:
            return
        columns, body = corpus.VIEWS[name] if name in corpus.VIEWS else ("", SHARED[name])
        done.append(name)
        need(re.sub(rf"\b{name}\b", "", body) if name in corpus.VIEWS else body)
        for table in corpus.DRIVER_TABLES:
            body = body.replace("{" + table + "}", table)
        text.append(f"{name}{columns} AS ({body})")

    need(sql)
    return "WITH RECURSIVE " + ",\n".join(text) + "\n" + sql if text else sql


LINE = "regexp_replace(value, '\\r$', '')"
LINES = f"(SELECT {LINE} AS line FROM raw_lines)"


def _feed(url: str, source: str, kind: str, where: str, rows: str = LINES, ident: str = "''") -> str:
    return f"SELECT {url} AS url, '{source}' AS source, {ident} AS external_id, '{kind}' AS threat_type FROM {rows} WHERE {where}"


ITEM = "json_type(item, '$.{}')"
FEEDS = {
    "phishtank": f"""SELECT coalesce(item->>'$.url', '') AS url, 'phishtank' AS source, CASE WHEN {ITEM.format('phish_id')} IN ('BIGINT', 'UBIGINT') THEN item->>'$.phish_id' ELSE '0' END AS external_id, 'phishing' AS threat_type
FROM (SELECT unnest(from_json(value, '["JSON"]')) AS item FROM raw_phishtank) WHERE json_type(item) = 'OBJECT'
AND coalesce({ITEM.format('phish_id')}, 'NULL') IN ('NULL', 'BIGINT', 'UBIGINT') AND coalesce({ITEM.format('url')}, 'NULL') IN ('NULL', 'VARCHAR')""",
    "urlhaus": """SELECT CASE WHEN left(f[3], 1) = '"' THEN replace(f[3][2:-2], '""', '"') ELSE f[3] END AS url, 'urlhaus' AS source,
  CASE WHEN left(f[1], 1) = '"' THEN replace(f[1][2:-2], '""', '"') ELSE f[1] END AS external_id, '' AS threat_type
FROM (SELECT regexp_extract_all(concat(',', text), ',("([^"]|"")*"|[^",\n]*)', 1) AS f FROM (SELECT regexp_replace(replace(value, concat(chr(13), chr(10)), chr(10)), '\r$', '') AS text FROM raw_urlhaus)
  WHERE text <> '' AND left(text, 1) <> '#' AND regexp_full_match(text, '("([^"]|"")*"|[^",\n]*)(,("([^"]|"")*"|[^",\n]*))*')) WHERE len(f) >= 3""",
    "openphish": _feed("line", "openphish", "phishing", "line <> ''"),
    "threatfox": """SELECT item.ioc_value AS url, 'threatfox' AS source, e.id AS external_id, item.threat_type AS threat_type FROM (
SELECT kv.key AS id, unnest(kv.value) AS item FROM (SELECT unnest(map_entries(from_json(value, '{}'))) AS kv FROM raw_threatfox)) e WHERE item.ioc_type IN ('url', 'domain')""",
    "github_phishing": _feed("line", "github_phishing", "phishing", "line <> '' AND left(line, 1) <> '#'"),
    "vxvault": _feed("line", "vxvault", "malware", "line <> ''"),
    "stopforumspam": _feed("concat('http://', trim(line))", "stopforumspam", "spam", "trim(line) <> ''"),
    "phishing_army": _feed("concat('http://', line)", "phishing_army", "phishing", "line <> '' AND left(line, 1) <> '#'"),
}
FEEDS["threatfox"] = """SELECT unnest([url, concat('d', CAST(url_id AS VARCHAR), '.example')]) AS url, 'threatfox' AS source, CAST(url_id AS VARCHAR) AS external_id,
unnest(['botnet_cc', 'payload']) AS threat_type FROM url_corpus"""

CONFIG_USAGE = """(
SELECT kind, key, score, (SELECT count(*) FROM used u WHERE u.kind = e.kind AND u.key = e.key) AS n_urls FROM (
  SELECT 'brand' AS kind, name AS key, NULL::INT AS score FROM config_brands UNION ALL SELECT 'keyword', word, score FROM config_keywords
  UNION ALL SELECT 'tld', tld, score FROM config_tlds UNION ALL SELECT 'shortener', domain, score FROM config_shorteners
  UNION ALL SELECT 'geo_risk', country, score FROM config_geo_risks UNION ALL SELECT 'hosting', pattern, score FROM config_hosting) e)"""
SHARED["used"] = """
SELECT DISTINCT url_id, 'brand' AS kind, t AS key FROM tokens UNION ALL SELECT DISTINCT url_id, 'keyword', t FROM tokens
UNION ALL SELECT url_id, 'tld', CASE WHEN contains(hostname, '.') THEN split_part(hostname, '.', -1) ELSE '' END FROM parts UNION ALL SELECT url_id, 'shortener', clean_host FROM parts
UNION ALL SELECT 0, 'geo_risk', country FROM located
UNION ALL SELECT 0, 'hosting', pattern FROM (SELECT host, arg_min(h.pattern, h.id) AS pattern FROM located l
  JOIN config_hosting h ON contains(lower(l.isp), lower(h.pattern)) WHERE isp <> 'Unknown' GROUP BY host)"""

ROOT = "array_to_string(string_split(host, '.')[-2:], '.')"


def _windows(key: str, seconds: int, source: str = "check_requests", name: str = "w_") -> str:
    """Starts of windows anchored at their first event, found one after the other per key."""
    return f"""
SELECT {key} AS k, min(ts) AS st FROM {source} GROUP BY {key}
UNION ALL SELECT k, (SELECT min(ts) FROM {source} c WHERE c.{key} = k AND c.ts >= st + INTERVAL {seconds} SECOND) FROM {name}{key}
WHERE (SELECT min(ts) FROM {source} c WHERE c.{key} = k AND c.ts >= st + INTERVAL {seconds} SECOND) IS NOT NULL"""


SHARED["w_url"] = _windows("url", 21600)
SHARED["w_client"] = _windows("client", 21600)
SHARED["r_stored"] = "SELECT event_id, ts, url FROM store_requests WHERE url <> '' AND event_id NOT IN (SELECT url_id FROM r_white)"
SHARED["rw_url"] = _windows("url", 21600, "r_stored", "rw_")


def _placed(key: str, source: str = "check_requests", name: str = "w_") -> str:
    return f"""(SELECT c.*, st, row_number() OVER (PARTITION BY c.{key}, st ORDER BY ts, event_id) AS rn
FROM {source} c ASOF JOIN {name}{key} w ON w.k = c.{key} AND w.st <= c.ts)"""


REUSE = f"SELECT event_id, url, st::TIMESTAMPTZ AS computed_at, rn > 1 AS reused FROM {_placed('url')}"


# The report as JSON; merging into an empty object leaves absent parts out.
REPORT_JSON = """
SELECT r.url_id, json_merge_patch('{}', to_json(struct_pack(
  target := r.target, verdict := r.verdict, risk_score := r.risk_score, reason := r.reason,
  summary := CASE WHEN n_critical + n_high + n_medium + n_low > 0 THEN
    struct_pack(critical := n_critical, high := n_high, medium := n_medium, low := n_low) END,
  signals := s.signals, blacklists := b.blacklists, heuristics := h.heuristics,
  infrastructure := CASE WHEN f.host IS NOT NULL THEN struct_pack(
    status := CASE WHEN f.online THEN 'Online' ELSE 'Offline' END, ip := l.ip,
    geolocation := CASE WHEN f.online THEN struct_pack(country := l.country, isp := l.isp, asn := nullif(l.asn, 0), organization := nullif(l.isp, '')) END,
    ssl := CASE WHEN f.has_tls THEN struct_pack(valid := t.valid, issuer := t.issuer, age_days := t.age_days, expires_in := t.expires_in, is_https := true) END,
    dns := CASE WHEN f.online AND (l.mx IS NOT NULL OR l.ns IS NOT NULL) THEN struct_pack(
      mx_records := CASE WHEN l.mx IS NOT NULL THEN [l.mx] END, ns_records := CASE WHEN l.ns IS NOT NULL THEN [l.ns] END) END,
    http_scan := CASE WHEN f.online AND p.url IS NOT NULL THEN struct_pack(status_code := 200, page_title := p.title,
      has_password_field := p.password_field, has_credit_card_field := p.card_field, is_suspicious_js := false) END) END,
  whois := CASE WHEN w.host IS NOT NULL THEN struct_pack(registrar := 'MAXNAME', created_date := nullif(w.created_raw, ''), domain_age_days := w.age) END
)))::VARCHAR AS report
FROM t_report r
LEFT JOIN (SELECT * FROM t_facts WHERE url_id IN (SELECT url_id FROM t_open)) f ON f.url_id = r.url_id
LEFT JOIN located l ON l.host = f.host LEFT JOIN tls t ON t.host = f.host LEFT JOIN whois w ON w.host = f.host LEFT JOIN pages_seen p ON p.url = f.url
LEFT JOIN (SELECT url_id, list(signal ORDER BY pos) AS signals FROM t_signals GROUP BY url_id) s ON s.url_id = r.url_id
LEFT JOIN (SELECT url, list(struct_pack(source := source, ext_id := external_id, type := threat_type, first_seen := first_seen) ORDER BY back DESC, source) AS blacklists
  FROM stored GROUP BY url) b ON b.url = f.url
LEFT JOIN (SELECT url_id, list(struct_pack(name := name, "desc" := "desc", score := score) ORDER BY part, k1, k2, "desc") AS heuristics FROM (
  SELECT url_id, 1 AS part, ord AS k1, 0 AS k2, name, "desc", score FROM t_infra_hits
  UNION ALL SELECT url_id, 2, -score, ord, name, "desc", score FROM t_hits) WHERE url_id IN (SELECT url_id FROM t_open) GROUP BY url_id) h ON h.url_id = r.url_id"""


def all_sql() -> dict[str, str]:
    infra_hit = "SELECT host, name, \"desc\", score FROM host_hits WHERE ord {}"
    report_columns = "target, verdict, risk_score, reason, n_critical, n_high, n_medium, n_low, n_lists"
    sql = {f"feed_{name}": text for name, text in FEEDS.items()}
    sql["feeds_union"] = "\nUNION ALL ".join(f"({text})" for text in FEEDS.values())
    sql.update({key: f"SELECT url_id, \"desc\", score FROM hits WHERE name = '{name}'" for key, name in RULE_KEYS.items()})
    sql.update({
        "scan_whitelist": f"SELECT domain, (SELECT count(*) FROM hosts WHERE {ROOT} = domain) AS n_urls FROM whitelist",
        "scan_config": f"SELECT * FROM {CONFIG_USAGE}",
        "config_bundle": "SELECT " + ", ".join(
            f"coalesce(string_agg(concat_ws('=', key, score), ',' ORDER BY concat_ws('=', key, score)) FILTER (kind = '{k}'), '') AS {k}s"
            for k in ("brand", "keyword", "tld", "shortener", "geo_risk", "hosting")) + f" FROM {CONFIG_USAGE} WHERE n_urls > 0",
        "seed_merge": f"SELECT domain FROM whitelist WHERE domain NOT IN (SELECT {ROOT} FROM hosts WHERE host IS NOT NULL)",
        "url_hash": "SELECT url_id, sha256(url) AS url_hash FROM url_corpus",
        "lookup_host": "SELECT url_id, host FROM hosts",
        "url_parts": "SELECT url_id, parsed, scheme, hostname, path, query, has_userinfo, port FROM parts",
        "host_tokens": "SELECT p.url_id, p.clean_host, t AS token FROM parts p LEFT JOIN tokens k ON k.url_id = p.url_id",
        "url_tld": "SELECT url_id, CASE WHEN hostname IS NULL THEN '' WHEN contains(hostname, '.') THEN split_part(hostname, '.', -1) ELSE '' END AS tld FROM parts",
        "root_domain": f"SELECT url_id, CASE WHEN host IS NOT NULL THEN {ROOT} END AS root FROM hosts",
        "host_entropy": "SELECT url_id, CASE WHEN clean_host = '' THEN 0 ELSE round(entropy, 9) END AS entropy FROM parts LEFT JOIN host_ent USING (url_id)",
        "ip_host": f"SELECT url_id, {IPV4} AS is_ip FROM parts",
        "encoded_payload": "SELECT url_id, url_id IN (SELECT url_id FROM hits WHERE ord = 19) AS encoded FROM parts",
        "hex_payload": f"SELECT url_id, regexp_full_match({PATH}, '[0-9a-fA-F]{{16,}}') AS hex FROM parts",
        "fetch_target": "SELECT url_id, CASE WHEN url LIKE 'http%' THEN url ELSE 'https://' || url END AS target FROM url_corpus",
        "whitelist_check": f"""SELECT url_id, coalesce(host IN (SELECT domain FROM whitelist) OR (len(string_split(host, '.')) > 2
AND {ROOT} IN (SELECT domain FROM whitelist)), false) AS whitelisted FROM hosts""",
        "reject_empty": "SELECT value AS url, count(*) AS n_rejected FROM raw_lines WHERE value = '' GROUP BY value",
        "whois_age": "SELECT host, age AS domain_age_days FROM whois",
        "tls_facts": "SELECT * FROM tls",
        "page_title": "SELECT page_id, title FROM pages_seen",
        "page_forms": "SELECT page_id, password_field, card_field FROM pages_seen",
        "lexical_rules": "SELECT url_id, ord, name, \"desc\", score FROM hits",
        "joined_rules": "SELECT url_id, ord, name, \"desc\", score FROM hits WHERE ord BETWEEN 3 AND 7",
        "joined_hosting": infra_hit.format("IN (3, 4)"),
        "lexical_rules_sorted": "SELECT url_id, row_number() OVER (PARTITION BY url_id ORDER BY score DESC, ord, \"desc\")::INT AS pos, name, \"desc\", score FROM hits",
        "severity_sums": "SELECT url_id, critical, high, medium, low FROM sums",
        "severity_counts": "SELECT url_id, " + ", ".join(
            f"CASE WHEN n > 0 THEN {s} END::INT AS {s}" for s in SEVERITIES) + """ FROM (SELECT u.url_id, count(name) AS n,
count(*) FILTER (score >= 40) AS critical, count(*) FILTER (score BETWEEN 25 AND 39) AS high, count(*) FILTER (score BETWEEN 15 AND 24) AS medium,
count(*) FILTER (score < 15) AS low FROM url_corpus u LEFT JOIN hits h ON h.url_id = u.url_id GROUP BY u.url_id)""",
        "severity": "SELECT name, CASE WHEN score >= 40 THEN 'critical' WHEN score >= 25 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM hits GROUP BY 1, 2",
        "lexical_score": "SELECT url_id, lexical_score FROM scores",
        "threat_upsert": """SELECT url, sha256(url) AS url_hash, source, external_id, threat_type FROM (SELECT *, row_number() OVER (PARTITION BY url, source ORDER BY seq) AS rn
FROM threat_raw r WHERE seq % 4 > 0 AND NOT EXISTS (SELECT 1 FROM threat_raw e WHERE e.seq % 4 = 0 AND e.url = r.url AND e.source = r.source)) WHERE rn = 1""",
        "ingest_stats": """SELECT source, sum(n)::BIGINT AS total_read, sum(is_new)::BIGINT AS inserted, (sum(n) - sum(is_new))::BIGINT AS skipped FROM (
SELECT url, source, count(*) AS n, CASE WHEN (url, source) IN (SELECT (url, source) FROM threat_raw WHERE seq % 4 = 0) THEN 0 ELSE 1 END AS is_new
FROM threat_raw WHERE seq % 4 > 0 GROUP BY url, source) GROUP BY source""",
        "blacklist_lookup": """SELECT url_id, row_number() OVER (PARTITION BY url_id ORDER BY back DESC, source)::INT AS pos, source, external_id AS ext_id, threat_type AS type, first_seen,
concat('Listed in ', source, ' as ', threat_type) AS signal FROM url_corpus JOIN stored USING (url)""",
        "blacklist_exists": "SELECT url_id FROM url_corpus WHERE url IN (SELECT url FROM stored)",
        "trusted_isp": f"SELECT host, isp, {TRUSTED} AS trusted FROM located",
        "infra_slow_dns": infra_hit.format("= 1"), "infra_geo_risk": infra_hit.format("= 2"),
        "infra_hosting": infra_hit.format("IN (3, 4)"), "infra_tls": infra_hit.format("BETWEEN 5 AND 9"),
        "infra_mx": infra_hit.format("= 10"),
        "infra_http": "SELECT sha256(url) AS url_hash, name, \"desc\", score FROM page_hits",
        "geo_lookup": """SELECT host, ip, CASE WHEN ip IS NOT NULL THEN coalesce(country, '') END AS country, CASE WHEN ip IS NOT NULL THEN coalesce(isp, '') END AS isp,
CASE WHEN ip IS NOT NULL THEN coalesce(asn, 0) END AS asn FROM dns_obs LEFT JOIN (SELECT host, country, isp, asn FROM located) USING (host)""",
        "geo_networks": """SELECT host, ip, '' AS country, coalesce(CASE WHEN asn >= 200 THEN 'LAN' WHEN asn >= 100 THEN concat('SITE ', n_name) ELSE n_name END, '') AS isp, coalesce(asn, 0) AS asn
FROM (SELECT host, ip, CASE WHEN n % 5 IN (0, 1) THEN CASE WHEN n % 4 = 0 THEN 200 + n % 16 WHEN n % 2 = 0 THEN 100 + n % 16 ELSE 0 END
  WHEN n % 5 = 2 AND n % 223 = 0 THEN 2 WHEN n % 5 = 4 AND n % 8192 >= 4096 THEN 1 END AS asn FROM dns_v6) d LEFT JOIN nation ON n_nationkey = asn % 100""",
        "observe_join": "SELECT url_id, host, online, ip, has_tls, created_raw, n_redirects::INT AS n_redirects FROM t_facts",
        "effective_age": "SELECT url_id, age FROM t_ages",
        "infra_score": "SELECT url_id, infra_raw, infra_score FROM t_infra",
        "risk_score": "SELECT url_id, risk_score FROM t_report",
        "verdict": "SELECT url_id, verdict, reason FROM t_report",
        "signals": "SELECT url_id, pos, signal FROM t_signals",
        "check_report": f"SELECT url_id, {report_columns} FROM t_report",
        "report_json": REPORT_JSON,
        "report_reuse": REUSE, "stream_reuse": REUSE,
        "client_quota": f"SELECT event_id, client, st::TIMESTAMPTZ AS window_start, rn <= 3 AS accepted FROM {_placed('client')}",
        "report_store": f"""SELECT event_id, a.computed_at::TIMESTAMPTZ AS computed_at, reused, target, verdict, risk_score, reason FROM (
SELECT event_id, st AS computed_at, rn > 1 AS reused FROM {_placed('url', 'r_stored', 'rw_')}
UNION ALL SELECT event_id, ts, false FROM store_requests WHERE event_id IN (SELECT url_id FROM r_white)) a JOIN r_report r ON r.url_id = a.event_id""",
        "stream_ingest": "SELECT DISTINCT url, sha256(url) AS url_hash, source, threat_type FROM (" + "\nUNION ALL ".join(f"({text})" for text in FEEDS.values()) + ")",
        "stream_first_seen": "SELECT DISTINCT url, client AS source FROM check_requests",
        "stream_check": f"SELECT url_id AS event_id, {report_columns} FROM s_report",
    })
    return {name: with_ctes(text) for name, text in sql.items()}
