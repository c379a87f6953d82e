"""Independent DuckDB SQL for the queries that have an exact answer.

The SQL takes other routes than the engine: string positions instead of patterns, a short list of the
suffixes that occur, every URL against every brand, a recursive distance table, direct threshold
tests and pairwise AUC.
"""

from __future__ import annotations

from lurescan import dims

from .corpus import BRAND_DIM, OFFICIAL_DIM, duckdb_with, duckdb_word_brands

SWEEP = (0.5, 0.55, 0.6, 0.65, 0.7, 0.7478, 0.8, 0.9)


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def parts(table: str, key: str = "url_id") -> str:
    """CTEs up to ``p``: the parts of every row of ``table``."""
    suffixes = r"co\.in|gov\.in|com|net|org|in|io|sbi|xyz|top|info|online|ly|abc"
    return rf"""
t0 AS (SELECT *, trim(url) AS raw FROM {table}),
t1 AS (SELECT *, CASE WHEN strpos(substr(raw, 1, 16), '://') > 0 THEN raw ELSE 'http://' || raw END AS clean FROM t0),
t2 AS (SELECT *, lower(substr(clean, 1, strpos(clean, '://') - 1)) AS scheme,
  split_part(substr(clean, strpos(clean, '://') + 3), '#', 1) AS body FROM t1),
t3 AS MATERIALIZED (SELECT *, split_part(body, '?', 1) AS front, CASE WHEN strpos(body, '?') > 0 THEN substr(body, strpos(body, '?') + 1) ELSE '' END AS query FROM t2),
t4 AS (SELECT *, split_part(front, '/', 1) AS authority, CASE WHEN strpos(front, '/') > 0 THEN substr(front, strpos(front, '/')) ELSE '' END AS path FROM t3),
t5 AS (SELECT *, list_last(string_split(authority, '@')) AS hp, (contains(authority, '[') <> contains(authority, ']')) AS parse_error FROM t4),
t6 AS MATERIALIZED (SELECT *, lower(rtrim(CASE WHEN starts_with(hp, '[') THEN split_part(substr(hp, 2), ']', 1) ELSE split_part(hp, ':', 1) END, '.')) AS host,
  CASE WHEN starts_with(hp, '[') THEN split_part(hp, ']:', 2) ELSE split_part(hp, ':', 2) END AS port_text FROM t5),
t7 AS (SELECT *, CASE WHEN TRY_CAST(port_text AS INT) BETWEEN 0 AND 65535 THEN TRY_CAST(port_text AS INT) END AS port,
  replace(host, 'xn--pypal-4ve', 'pаypal') AS unicode_host,
  (contains(host, ':') OR regexp_full_match(host, '([0-9]+|0x[^.]*)(\.([0-9]+|0x[^.]*)){{0,3}}')) AS is_ip FROM t6),
t8 AS MATERIALIZED (SELECT *, CASE WHEN is_ip OR host = '' THEN '' ELSE regexp_extract(host, '(?:^|\.)({suffixes})$', 1) END AS listed FROM t7),
t9 AS (SELECT *, CASE WHEN is_ip OR host = '' THEN '' WHEN listed = '' AND contains(host, '.') THEN list_last(string_split(host, '.')) ELSE listed END AS suffix FROM t8),
t10 AS (SELECT *, CASE WHEN suffix = '' THEN host WHEN suffix = host THEN '' ELSE substr(host, 1, length(host) - length(suffix) - 1) END AS before FROM t9),
t11 AS MATERIALIZED (SELECT *, CASE WHEN is_ip THEN host ELSE list_last(string_split(before, '.')) END AS domain FROM t10),
p AS MATERIALIZED (SELECT *, CASE WHEN is_ip OR length(before) <= length(domain) THEN '' ELSE substr(before, 1, length(before) - length(domain) - 1) END AS subdomain,
  CASE WHEN NOT is_ip AND domain <> '' AND suffix <> '' THEN domain || '.' || suffix ELSE host END AS registered FROM t11)"""


def _readings(expr: str) -> str:
    """All readings of a label: each of the letter merges applied or not, in order, with and without l as i."""
    out = []
    for start in (expr, f"replace({expr}, 'l', 'i')"):
        for mask in range(16):
            form = start
            for bit, (pair, one) in enumerate(dims.SEQUENCES):
                if mask >> bit & 1:
                    form = f"replace({form}, '{pair}', '{one}')"
            out.append(form)
    return f"list_distinct([{', '.join(out)}])"


_BASE = f"translate(lower({{}}), '{''.join(x[0] for x in dims.CONFUSABLE_PAIRS)}', '{''.join(x[1] for x in dims.CONFUSABLE_PAIRS)}')"
_GLYPHS = ", ".join(f"('{c}', '{g}')" for c, row in dims.GLYPHS.items() for g in row.split())
# within two edits, neighbours swapped counting once: plain distance, or one swap with at most one more edit around it
_WITHIN_2 = """(levenshtein(h.domain, b.brand) <= 2 OR len(list_filter(range(1, length(h.domain)), lambda i:
  len(list_filter(range(1, length(b.brand)), lambda j: h.domain[i] = b.brand[j + 1] AND h.domain[i + 1] = b.brand[j] AND
    damerau_levenshtein(substr(h.domain, 1, i - 1), substr(b.brand, 1, j - 1)) + 1 +
    damerau_levenshtein(substr(h.domain, i + 2), substr(b.brand, j + 2)) <= 2)) > 0)) > 0)"""

MATCH = f"""
brand AS (SELECT * FROM brand_dim),
official AS ({OFFICIAL_DIM}),
host_rows AS (SELECT DISTINCT host, unicode_host, domain, suffix, subdomain, registered, is_ip,
  CASE domain WHEN 'xn--pypal-4ve' THEN 'pаypal' ELSE domain END AS shown FROM p),
hosts AS (SELECT *, registered IN ({_list(dims.MULTI_TENANT)}) AS tenant,
  NOT is_ip AND domain <> '' AND NOT (registered IN (SELECT official FROM official) AND registered NOT IN ({_list(dims.MULTI_TENANT)}))
    AND suffix NOT IN (SELECT brand FROM brand) AS gate FROM host_rows),
label_forms AS (SELECT *, list_distinct(list_concat({_readings(_BASE.format('domain'))}, {_readings(_BASE.format('shown'))})) AS shapes,
  regexp_extract_all(lower(shown), '[a-z]+') AS label_words, regexp_extract_all(lower(subdomain), '[a-z]+') AS sub_words FROM hosts),
rules AS (SELECT h.host, b.ord, b.brand, b.word_only, h.tenant, h.sub_words,
  NOT h.tenant AND h.domain = b.brand AS r7,
  NOT h.tenant AND list_contains(h.shapes, b.brand) AND h.shown <> b.brand AS r8,
  NOT h.tenant AND length(b.brand) >= 6 AND NOT b.word_only AND abs(length(h.domain) - length(b.brand)) <= 2 AND
    CASE WHEN length(b.brand) >= 9 THEN {_WITHIN_2} ELSE damerau_levenshtein(h.domain, b.brand) <= 1 END AS r9,
  NOT h.tenant AND list_contains(h.label_words, b.brand) AND len(h.label_words) > 1 AS r10,
  NOT h.tenant AND NOT b.word_only AND length(b.brand) > 4 AND (starts_with(h.domain, b.brand) OR ends_with(h.domain, b.brand)) AS r11,
  list_contains(h.sub_words, b.brand) AS r12,
  EXISTS (SELECT 1 FROM official o WHERE o.brand = b.brand AND contains(h.subdomain || '.', o.official || '.')) AS inside
  FROM label_forms h, brand b WHERE h.gate),
url_rules AS (SELECT p.url_id, r.*, length(r.brand) > 4 AND NOT r.r12 AND list_contains(regexp_extract_all(lower(p.path || ' ' || p.query), '[a-z]+'), r.brand) AS r14
  FROM p JOIN rules r ON p.host = r.host),
staged AS (SELECT *,
  CASE WHEN r7 THEN 'unofficial-domain' WHEN r8 THEN 'homoglyph' WHEN r9 THEN 'typosquat' WHEN r10 OR r11 THEN 'combosquat' END AS t1,
  CASE WHEN r7 THEN 2 WHEN r8 OR r9 THEN 3 WHEN r10 THEN 2 WHEN r11 THEN 1 ELSE 0 END AS s1,
  CASE WHEN r12 THEN 'brand-in-subdomain' WHEN r14 THEN 'brand-in-path' END AS t2,
  CASE WHEN r12 AND inside THEN 3 WHEN r12 THEN 2 WHEN r14 THEN 1 ELSE 0 END AS s2 FROM url_rules),
best AS (SELECT url_id, ord, brand, CASE WHEN s2 > s1 THEN t2 ELSE t1 END AS technique, greatest(s1, s2) AS sev FROM staged WHERE s1 + s2 > 0),
findings AS (SELECT url_id, ord, brand, technique, sev, CASE sev WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  CAST(row_number() OVER (PARTITION BY url_id ORDER BY sev DESC, ord) - 1 AS INT) AS pos FROM best),
per_url AS (SELECT p.*, coalesce(f.sev, 0) AS sev, coalesce(f.text, 'none') AS findings FROM p LEFT JOIN
  (SELECT url_id, max(sev) AS sev, string_agg(brand || ': ' || technique || ' (' || severity || ')', '; ' ORDER BY pos) AS text FROM findings GROUP BY url_id) f
  ON p.url_id = f.url_id)"""

# the sentence of a finding ``f`` on the host of ``p``
DETAIL = """CASE f.technique
  WHEN 'unofficial-domain' THEN '"' || p.registered || '" is the name of the brand outside its known domains, such as ' || b.home
  WHEN 'homoglyph' THEN '"' || p.unicode_host || '"' || CASE WHEN p.host <> p.unicode_host THEN ' is an internationalised (punycode) look-alike of ' ELSE ' is a look-alike of ' END || b.home
  WHEN 'typosquat' THEN '"' || p.registered || '" is a misspelling of ' || b.home
  WHEN 'combosquat' THEN '"' || p.registered || '"' || CASE f.severity WHEN 'medium' THEN ' joins the brand "' || f.brand || '" with other words' ELSE ' begins or ends with the brand "' || f.brand || '"' END
  WHEN 'brand-in-subdomain' THEN CASE f.severity WHEN 'high' THEN b.home || ' stands in front of another site, "' || p.registered || '"' ELSE 'the subdomain names ' || f.brand || ' but the site is "' || p.registered || '"' END
  ELSE 'the path names ' || f.brand || ' on an unrelated site, "' || p.registered || '"' END"""
DETAILS = f"details AS (SELECT f.url_id, f.pos, f.brand, {DETAIL} AS detail FROM findings f JOIN p ON p.url_id = f.url_id JOIN brand b ON b.brand = f.brand)"

# the same rules for a long brand table: only pairs that some test could accept, misspellings by distance alone
_MAYBE = """maybe AS MATERIALIZED (
  SELECT DISTINCT host, brand FROM (
    SELECT h.host, unnest(list_concat(list_concat(h.shapes, h.label_words), list_concat(h.sub_words, list_concat([h.domain], list_concat(
      list_transform(range(1, length(h.domain) + 1), lambda i: h.domain[:i]), list_transform(range(1, length(h.domain) + 1), lambda i: h.domain[i:])))))) AS brand FROM label_forms h
    UNION ALL SELECT p.host, unnest(regexp_extract_all(lower(p.path || ' ' || p.query), '[a-z]+')) FROM p
    UNION ALL SELECT h.host, b.brand FROM label_forms h JOIN brand b ON length(b.brand) BETWEEN length(h.domain) - 2 AND length(h.domain) + 2
      AND CASE WHEN b.word_only OR length(b.brand) < 6 THEN false ELSE damerau_levenshtein(h.domain, b.brand) <= CASE WHEN length(b.brand) >= 9 THEN 2 ELSE 1 END END)),
"""
WORD_MATCH = MATCH.replace(f"official AS ({OFFICIAL_DIM})", "official AS (SELECT * FROM word_official)").replace("brand AS (SELECT * FROM brand_dim)", "brand AS (SELECT * FROM word_brand)")
WORD_MATCH = WORD_MATCH.replace("rules AS (SELECT", _MAYBE + "rules AS (SELECT", 1).replace("FROM label_forms h, brand b WHERE h.gate)", "FROM label_forms h JOIN maybe q ON q.host = h.host JOIN brand b ON b.brand = q.brand WHERE h.gate)")
WORD_URLS = f"WITH RECURSIVE {duckdb_word_brands()}, {parts('word_urls')}, {WORD_MATCH}, {DETAILS}"

# full swap-aware distance, one row of the table per step
DISTANCE = """
dist(domain, brand, i, before, prev) AS (
  SELECT domain, brand, 0, range(0, length(brand) + 1), range(0, length(brand) + 1) FROM pairs
  UNION ALL
  SELECT domain, brand, i + 1, prev, list_reduce(list_prepend([CAST(i + 1 AS BIGINT)], list_transform(range(1, length(brand) + 1), lambda j: [j])),
    lambda acc, x: list_append(acc, least(prev[x[1] + 1] + 1, acc[-1] + 1,
      prev[x[1]] + CASE WHEN domain[i + 1] = brand[x[1]] THEN 0 ELSE 1 END,
      CASE WHEN i >= 1 AND x[1] > 1 AND domain[i + 1] = brand[x[1] - 1] AND domain[i] = brand[x[1]] THEN before[x[1] - 1] + 1 ELSE 1000 END)))
  FROM dist WHERE i < length(domain)),
osa AS (SELECT domain, brand, prev[-1] AS d FROM dist WHERE i = length(domain))"""

SIMILARITY = f"""
pairs AS (SELECT DISTINCT p.domain, b.brand FROM p, brand_dim b WHERE NOT p.is_ip AND p.domain <> '' AND length(b.brand) >= 5),
{DISTANCE},
similar_labels AS (SELECT domain, round(max(greatest(1 - d / length(brand), 0)), 4) AS brand_similarity FROM osa GROUP BY domain),
sim AS (SELECT p.*, CASE WHEN p.is_ip OR p.domain = '' THEN 0.0 ELSE s.brand_similarity END AS brand_similarity FROM p LEFT JOIN similar_labels s ON p.domain = s.domain)"""

_P = "least(CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) / 4294967296 + 0.35::DOUBLE * CASE WHEN status = 'phishing' THEN 1 ELSE 0 END, 1)"
SCORES = f"sc AS (SELECT url_id, url, status, CASE WHEN status = 'phishing' THEN 1 ELSE 0 END AS y, {_P} AS p FROM url_corpus)"
SCORES_2 = f"sc AS (SELECT url_id, url, status, CASE WHEN status = 'phishing' THEN 1 ELSE 0 END AS y, floor({_P} * 100) / 100 AS p FROM url_corpus)"
SCORES_4 = f"sc AS (SELECT url_id, url, status, CASE WHEN status = 'phishing' THEN 1 ELSE 0 END AS y, floor({_P} * 10000) / 10000 AS p FROM url_corpus)"

CORPUS, RAW, CLICKS, BIG = (duckdb_with(t) for t in ("url_corpus", "url_raw", "clicks", "url_big"))
ON_CORPUS = f"{CORPUS}, {parts('url_corpus')}"
ON_RAW = f"{RAW}, {parts('url_raw')}"
SITE = "CASE WHEN registered <> '' THEN registered ELSE url END"
VALID = "(raw <> '' AND host <> '' AND NOT parse_error)"
LABELLED = f"{ON_CORPUS}, l AS MATERIALIZED (SELECT url_id, url, status, CASE WHEN status = 'phishing' THEN 1 ELSE 0 END AS y, {SITE} AS site FROM p)"


def _count(c: str, ch: str) -> str:
    return f"CAST(len(string_split({c}, '{ch}')) - 1 AS DOUBLE)"


def _digits(c: str) -> str:
    return f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"


def _d(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END::DOUBLE"


_TOP = "list_last(string_split(suffix, '.'))"
_SENSITIVE = f"CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(url), '[a-z0-9]+')), [{_list(dims.SENSITIVE_WORDS)}])) AS DOUBLE)"
_HOSTED = f"(registered IN ({_list(dims.HOSTING)}) OR EXISTS (SELECT 1 FROM (SELECT unnest([{_list(dims.HOSTING)}]) AS hh) WHERE ends_with(host, '.' || hh)))"
_EMAIL = r"regexp_matches(substr(url, length(scheme) + 4), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+')"
FEATURE_SQL = {
    "url_length": "CAST(length(url) AS DOUBLE)",
    "hostname_length": "CAST(CASE WHEN contains(url, '://') THEN length(authority) ELSE 0 END AS DOUBLE)",
    "path_length": "CAST(CASE WHEN contains(url, '://') THEN length(path) ELSE length(front) END AS DOUBLE)",
    "count_hyphens": _count("url", "-"), "count_dots": _count("url", "."), "count_at": _count("url", "@"),
    "count_questionmark": _count("url", "?"), "count_equals": _count("url", "="), "count_slashes": _count("url", "/"),
    "count_digits": f"CAST({_digits('url')} AS DOUBLE)",
    "has_https": _d("starts_with(url, 'https://')"),
    "is_shortener": _d(f"registered IN ({_list(dims.SHORTENERS)})"),
    "query_length": "CAST(length(query) AS DOUBLE)",
    "host_dots": _count("host", "."),
    "subdomain_levels": "CAST(CASE WHEN subdomain = '' THEN 0 ELSE len(string_split(subdomain, '.')) END AS DOUBLE)",
    "host_hyphens": _count("host", "-"),
    "host_digits": f"CAST({_digits('host')} AS DOUBLE)",
    "digit_ratio": f"{_digits('url')} / length(url)::DOUBLE",
    "longest_host_token": "CAST(list_max(list_transform(regexp_extract_all(host, '[^.-]+'), lambda x: length(x))) AS DOUBLE)",
    "longest_path_token": "CAST(coalesce(list_max(list_transform(regexp_extract_all(path || '?' || query, '[^/._=?&-]+'), lambda x: length(x))), 0) AS DOUBLE)",
    "path_segments": "CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS DOUBLE)",
    "count_ampersand": _count("url", "&"), "count_percent": _count("url", "%"), "count_underscore": _count("url", "_"), "count_tilde": _count("url", "~"),
    "double_slash_in_path": _d("contains(path, '//')"),
    "has_port": _d("port IS NOT NULL"),
    "is_ip_host": _d("is_ip"),
    "is_punycode": _d("contains(host, 'xn--')"),
    "www_prefix": _d("starts_with(host, 'www.')"),
    "tld_common": _d(f"suffix <> '' AND {_TOP} IN ({_list(dims.COMMON_TLDS)})"),
    "tld_length": f"CAST(CASE WHEN suffix <> '' THEN length({_TOP}) ELSE 0 END AS DOUBLE)",
    "free_hosting": _d(_HOSTED),
    "sensitive_words": _SENSITIVE,
    "php_or_html": _d("ends_with(lower(path), '.php') OR ends_with(lower(path), '.htm') OR ends_with(lower(path), '.html') OR ends_with(lower(path), '.asp') OR ends_with(lower(path), '.aspx')"),
    "email_in_url": _d(_EMAIL),
    "official_brand_domain": _d(f"registered IN (SELECT official FROM ({OFFICIAL_DIM}))"),
}
_SHORTENED = " OR ".join(f"contains(url, '{s}')" for s in dims.V1_SHORTENER_TEXT)
FEATURE_SQL["has_ip"] = _d("contains(authority, '::')")
FEATURE_SQL["is_shortened"] = _d(_SHORTENED)


def features(*names: str, source: str = "p", key: str = "url_id") -> str:
    return f"SELECT {key}, " + ", ".join(f"{FEATURE_SQL[n]} AS {n}" for n in names) + f" FROM {source}"


def _entropy(c: str) -> str:
    return f"(SELECT coalesce(entropy(ch), 0) FROM (SELECT unnest(string_split({c}, '')) AS ch))"


_GRAMS = """g AS (SELECT url_id, unnest(list_concat(list_concat(
  [substr(lower(url), i, 3) for i in range(1, length(url) - 1)],
  [substr(lower(url), i, 4) for i in range(1, length(url) - 2)]),
  [substr(lower(url), i, 5) for i in range(1, length(url) - 3)])) AS gram FROM url_corpus),
tf AS (SELECT url_id, gram, count(*) AS tf FROM g GROUP BY ALL),
vocab AS (SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, ln((1 + (SELECT count(*) FROM url_corpus)) / (1 + count(*))) + 1 AS idf
  FROM tf GROUP BY gram HAVING count(*) >= 2 ORDER BY cf DESC, gram LIMIT 200000)"""

_CURVE = """pts AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM sc GROUP BY p),
cum AS (SELECT a.p, sum(b.pos) AS tp, sum(b.neg) AS fp FROM pts a JOIN pts b ON b.p >= a.p GROUP BY a.p),
tot AS (SELECT count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y = 0) AS N FROM sc)"""

_METRICS = """SELECT count(*) FILTER (WHERE p >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {t} AND y = 0) AS fp,
  count(*) FILTER (WHERE p < {t} AND y = 1) AS fn, count(*) FILTER (WHERE p < {t} AND y = 0) AS tn FROM sc"""

# one row per distinct URL that can be read, with the label of its first row
PREPARED = f"{LABELLED}, once AS (SELECT url, arg_min(y, url_id) AS y, arg_min(site, url_id) AS site FROM l SEMI JOIN (SELECT url_id FROM p WHERE NOT parse_error) r ON r.url_id = l.url_id GROUP BY url)"
_HASH = "CAST('0x' || substr(md5('42|' || site), 1, 8) AS BIGINT)"

_SIGNAL_CASES = {
    "ip_host": "is_ip",
    "user_info": "contains(split_part(CASE WHEN contains(url, '//') THEN substr(url, strpos(url, '//') + 2) ELSE url END, '/', 1), '@')",
    "punycode": "contains(host, 'xn--')",
    "shortener": f"registered IN ({_list(dims.SHORTENERS)})",
    "shared_hosting": _HOSTED,
    "deep_subdomain": "subdomain <> '' AND len(string_split(subdomain, '.')) >= 3",
    "port": "port IS NOT NULL",
    "sensitive_words": f"{_SENSITIVE} >= 2",
    "email": _EMAIL,
    "long_url": "length(url) > 100",
    "no_https": "scheme = 'http'",
}
_SIGNALS = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _SIGNAL_CASES.items()) + ")"

_SCORED_RAW = f"""{ON_RAW}, {MATCH}, sr AS (SELECT *, least(CAST('0x' || substr(md5(raw), 1, 8) AS BIGINT) / 4294967296 +
  CASE WHEN status = 'phishing' THEN 0.35 ELSE 0 END::DOUBLE, 1) AS sp FROM per_url)"""


def _verdict(t: float, high: bool = True) -> str:
    also = " OR sev = 3" if high else ""
    return f"CASE WHEN NOT {VALID} THEN 'invalid' WHEN sp >= {t}{also} THEN 'phishing' ELSE 'legitimate' END"


def _stream(sql: str) -> str:
    return f"""WITH RECURSIVE brand_dim AS ({BRAND_DIM}), page_urls AS (SELECT page_id AS url_id, url || CASE WHEN page_id % 5 = 0 THEN '&login=paypal' ELSE '' END AS url FROM pages),
{parts('page_urls')}, {MATCH} {sql}"""


_REQUESTS = """rq AS (SELECT url_id AS request_id, url, CAST(url_id % 7 AS INT) AS form FROM url_corpus)"""

ORACLES = {
    "load_csv": f"""{RAW} SELECT trim(url) AS url, count(*) AS n, CAST(sum(CASE WHEN status = 'phishing' THEN 1 ELSE 0 END) AS BIGINT) AS phishing
      FROM url_raw WHERE trim(url) <> '' GROUP BY 1""",
    "load_missing": f"{RAW} SELECT status, count(*) AS n FROM url_raw WHERE trim(url) = '' GROUP BY 1",
    "load_dedup": f"""{RAW} SELECT url_id, url, CASE WHEN status = 'phishing' THEN 1 ELSE 0 END AS y FROM url_raw
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY url_id) = 1""",
    "url_list": f"""{RAW} SELECT url, count(*) AS n FROM (SELECT url FROM url_raw WHERE url_id % 10 > 1 AND trim(url) <> '' AND substr(url, 1, 1) <> '#'
      UNION ALL SELECT url FROM url_corpus WHERE status = 'phishing') GROUP BY 1""",
    "feed": f"{RAW} SELECT trim(url) AS url, count(*) AS n FROM url_raw WHERE trim(url) <> '' GROUP BY 1",
    "popular_sites": f"""{CORPUS} SELECT CAST(url_id + 1 AS INT) AS rank, 'site' || url_id || '.example.org' AS domain, 'https://site' || url_id || '.example.org/' AS url
      FROM url_corpus WHERE url_id < 500""",
    "request_intake": f"""{CORPUS}, {_REQUESTS} SELECT request_id, 0 AS pos, url FROM rq WHERE form IN (0, 1, 4)
      UNION ALL SELECT request_id, 1, 'https://second.example.org/' FROM rq WHERE form = 0""",
    "request_rejects": f"""{CORPUS}, {_REQUESTS} SELECT request_id, CASE form WHEN 2 THEN concat('{{"urls":[1,"', url, '"]}}') WHEN 3 THEN '{{}}' WHEN 5 THEN 'no json' ELSE '{{"url":7}}' END AS body
      FROM rq WHERE form IN (2, 3, 5, 6)""",
    "json_results": f"""{_SCORED_RAW} SELECT url_id, 'lookalike' AS model, {_verdict(0.75)} AS verdict, CASE WHEN {VALID} THEN round(sp, 4) END AS probability,
      CASE WHEN {VALID} THEN 0.75::DOUBLE END AS threshold, CASE WHEN {VALID} THEN registered ELSE '' END AS site,
      CASE WHEN {VALID} AND findings <> 'none' THEN len(string_split(findings, '; ')) ELSE 0 END AS findings,
      CASE WHEN {VALID} AND {_SIGNALS.replace('url', 'raw')} <> '' THEN len(string_split({_SIGNALS.replace('url', 'raw')}, ',')) ELSE 0 END AS signs FROM sr""",
    "report_roundtrip": f"""{CORPUS}, {SCORES} SELECT t AS threshold, round(avg(CASE WHEN y = 1 THEN CASE WHEN p >= t THEN 1 ELSE 0 END END), 4) AS recall,
      round(avg(CASE WHEN y = 0 THEN CASE WHEN p >= t THEN 1 ELSE 0 END END), 4) AS false_positive_rate
      FROM sc, (SELECT CAST(unnest([{', '.join(map(str, SWEEP))}]) AS DOUBLE) AS t) GROUP BY t""",
    "report_shares": f"""{CORPUS}, {SCORES} SELECT status AS measure, round(avg(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END), 4) AS v1,
      round(avg(CASE WHEN p >= 0.75 THEN 1 ELSE 0 END), 4) AS combined FROM sc GROUP BY 1""",
    "snapshot_facts": f"""{CORPUS} SELECT count(*) FILTER (WHERE status = 'phishing') AS feed_urls, count(*) FILTER (WHERE status = 'legitimate') AS popular_sites,
      '2026-01-01' AS fetched, 'list-1' AS list_id FROM url_corpus""",
    "parse_parts": f"{ON_RAW} SELECT url_id, scheme, host, coalesce(port, -1) AS port, path, query, parse_error FROM p",
    "default_scheme": f"{ON_RAW} SELECT url_id, scheme, host FROM p WHERE raw <> clean",
    "registered_domain": f"{ON_RAW} SELECT url_id, subdomain, domain, suffix, registered, {SITE} AS site FROM p",
    "ip_host": f"{ON_RAW} SELECT url_id, host, domain, registered FROM p WHERE is_ip",
    "unicode_host": f"{ON_RAW} SELECT url_id, host, unicode_host FROM p WHERE host <> unicode_host",
    "invalid_urls": f"{ON_RAW} SELECT url_id, raw AS url FROM p WHERE NOT {VALID}",
    "clicks_by_site": f"{CLICKS}, {parts('clicks')} SELECT {SITE} AS site, count(*) AS clicks, count(DISTINCT url) AS urls, count(DISTINCT user_id) AS users FROM p GROUP BY 1",
    "v1_feature_rows": f"{ON_CORPUS} {features(*dims.V1_FEATURES)}",
    "feat_counts": f"{ON_CORPUS} {features('count_ampersand', 'count_percent', 'count_underscore', 'count_tilde', 'query_length', 'digit_ratio')}",
    "feat_host": f"{ON_CORPUS} {features('host_dots', 'subdomain_levels', 'host_hyphens', 'host_digits', 'longest_host_token', 'has_port', 'is_ip_host', 'is_punycode', 'www_prefix', 'tld_common', 'tld_length')}",
    "feat_path": f"{ON_CORPUS} {features('longest_path_token', 'path_segments', 'double_slash_in_path', 'php_or_html', 'email_in_url')}",
    "feat_entropy": f"{ON_CORPUS} SELECT url_id, round({_entropy('host')}, 6) AS host_entropy, round({_entropy('url')}, 6) AS url_entropy FROM p",
    "feat_words": f"{ON_CORPUS} {features('sensitive_words')}",
    "feat_hosting": f"{ON_CORPUS} {features('is_shortener', 'free_hosting', 'official_brand_domain')}",
    "feat_brand_similarity": f"{ON_CORPUS}, {SIMILARITY} SELECT url_id, brand_similarity FROM sim",
    "feat_matrix": f"{ON_CORPUS}, {MATCH}, {SIMILARITY}, fr AS (SELECT p.status, s.brand_similarity, CAST(u.sev AS DOUBLE) AS lookalike_severity, "
    + ", ".join(f"{sql.replace('url_id', 'p.url_id')} AS {n}" for n, sql in FEATURE_SQL.items() if n in dims.FEATURES and n != "digit_ratio")
    + " FROM p JOIN (SELECT url_id AS k, brand_similarity FROM sim) s ON p.url_id = s.k JOIN (SELECT url_id AS k2, sev FROM per_url) u ON p.url_id = u.k2) SELECT status, "
    + ", ".join(f"round(sum({n}), 2) AS {n}" for n in dims.FEATURES if n not in ("host_entropy", "url_entropy", "digit_ratio"))
    + " FROM fr GROUP BY status",
    "feat_similarity_clicks": f"{CLICKS}, {parts('clicks')}, {SIMILARITY} SELECT brand_similarity, count(*) AS clicks FROM sim GROUP BY 1",
    "look_gate": f"{ON_CORPUS}, {MATCH} SELECT p.registered, bool_or(h.gate) AS matched, bool_or(h.tenant) AS tenant, count(*) AS urls FROM p JOIN hosts h ON p.host = h.host GROUP BY 1",
    "look_skeletons": f"{ON_CORPUS} SELECT domain, unnest({_readings(_BASE.format('domain'))}) AS reading FROM (SELECT DISTINCT domain FROM p WHERE domain <> '' AND NOT is_ip)",
    "look_osa": f"""{ON_CORPUS}, lb AS (SELECT p.url_id, p.domain, b.brand FROM p JOIN brand_dim b ON b.ord = (p.url_id // 4 + p.url_id // 4 // 9) % 57 WHERE p.status = 'phishing' AND p.domain <> ''),
      pairs AS (SELECT DISTINCT domain, brand FROM lb), {DISTANCE} SELECT url_id, lb.domain, lb.brand, CAST(least(d, 3) AS INT) AS distance FROM lb JOIN osa ON lb.domain = osa.domain AND lb.brand = osa.brand""",
    "look_osa_full": f"""{ON_CORPUS}, lb AS (SELECT p.url_id, p.domain, b.brand FROM p JOIN brand_dim b ON b.ord = (p.url_id // 4 + p.url_id // 4 // 9) % 57 WHERE p.status = 'phishing' AND p.domain <> ''),
      pairs AS (SELECT DISTINCT domain, brand FROM lb), {DISTANCE} SELECT url_id, CAST(d AS INT) AS distance FROM lb JOIN osa ON lb.domain = osa.domain AND lb.brand = osa.brand""",
    "look_words": f"""{ON_CORPUS}, {MATCH} SELECT url_id, CASE WHEN gate THEN shown ELSE '' END AS label,
      CASE WHEN gate THEN array_to_string(regexp_extract_all(lower(shown), '[a-z]+'), ' ') ELSE '' END AS words FROM p JOIN hosts h ON p.host = h.host""",
    **{name: f"{ON_CORPUS}, {MATCH} SELECT url_id, brand FROM url_rules WHERE {rule}" for name, rule in (
        ("look_unofficial", "r7"), ("look_homoglyph", "r8"), ("look_typosquat", "r9"), ("look_combo_medium", "r10"), ("look_combo_low", "r11"), ("look_path", "r14"))},
    "look_subdomain": f"{ON_CORPUS}, {MATCH} SELECT url_id, brand, severity FROM findings WHERE technique = 'brand-in-subdomain'",
    "look_best_per_brand": f"{ON_CORPUS}, {MATCH} SELECT url_id, pos, brand, technique, severity FROM findings",
    "look_severity": f"{ON_CORPUS}, {MATCH} SELECT url_id, sev AS lookalike_severity FROM per_url",
    "look_details": f"{ON_CORPUS}, {MATCH}, {DETAILS} SELECT url_id, pos, brand, detail FROM details",
    "check_brand_table": f"""{WORD_URLS} SELECT u.url_id, CASE WHEN u.sev = 3 THEN 'phishing' ELSE 'legitimate' END AS verdict, u.registered AS site, u.findings, coalesce(d.text, '') AS details
      FROM per_url u LEFT JOIN (SELECT url_id, string_agg(detail, '; ' ORDER BY pos) AS text FROM details GROUP BY 1) d ON d.url_id = u.url_id""",
    "look_by_keys": f"{ON_CORPUS}, {MATCH} SELECT url_id, brand, technique, severity FROM findings",
    "signals": f"{ON_CORPUS} SELECT url_id, {_SIGNALS} AS codes FROM p",
    "check_verdicts": f"""{_SCORED_RAW} SELECT url_id, {_verdict(0.75)} AS verdict, CASE WHEN {VALID} THEN round(sp, 4) END AS probability,
      CASE WHEN {VALID} THEN 0.75::DOUBLE END AS threshold, CASE WHEN {VALID} THEN registered ELSE '' END AS site,
      CASE WHEN {VALID} THEN findings ELSE 'none' END AS findings FROM sr""",
    "check_model_only": f"{_SCORED_RAW} SELECT url_id, {_verdict(0.75, False)} AS verdict FROM sr",
    "batch_alarm": f"""{_SCORED_RAW} SELECT url_id % 20 AS batch, count(*) AS urls, bool_or({_verdict(0.99)} = 'phishing') AS alarm,
      count(*) FILTER (WHERE {_verdict(0.99)} = 'phishing') AS phishing, count(*) FILTER (WHERE {_verdict(0.99)} = 'invalid') AS invalid FROM sr GROUP BY 1""",
    "verdicts_by_site": f"""{ON_CORPUS}, {MATCH} SELECT registered AS site, CASE WHEN sev = 3 THEN 'phishing' ELSE 'legitimate' END AS verdict, count(*) AS urls FROM per_url GROUP BY 1, 2""",
    "dataset_counts": f"{LABELLED} SELECT count(*) AS urls, CAST(sum(y) AS BIGINT) AS phishing, count(DISTINCT site) AS sites FROM l",
    "sketched_counts": f"""{duckdb_with('clicks')}, numbered AS MATERIALIZED (SELECT row_number() OVER () AS url_id, url FROM (SELECT DISTINCT url FROM clicks)), {parts('numbered')},
      d AS (SELECT c.user_id, {SITE.replace('url END', 'p.url END')} AS site FROM clicks c JOIN p ON p.url = c.url)
      SELECT 'site' AS counted, count(*) AS rows, count(DISTINCT site) AS exact, true AS within FROM d UNION ALL SELECT 'user_id', count(*), count(DISTINCT user_id), true FROM d""",
    "class_balance": f"{RAW} SELECT status, count(*) AS n FROM url_raw GROUP BY 1",
    "class_profile": f"""{CORPUS} SELECT status, round(median(length(url)), 3) AS median_length,
      round(avg(CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END), 3) AS https_share FROM url_corpus GROUP BY 1""",
    "length_histogram": f"""{CORPUS}, ln AS (SELECT status, length(url) AS n FROM url_corpus WHERE length(url) < 250), e AS (SELECT min(n) AS lo, max(n) AS hi FROM ln),
      b AS (SELECT status, CAST(least(floor((n - lo) / ((hi - lo) / 60::DOUBLE)), 59) AS INT) AS bin, (hi - lo) / 60::DOUBLE AS w FROM ln, e)
      SELECT status, bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM ln x WHERE x.status = b.status) * any_value(w)), 9) AS density FROM b GROUP BY status, bin""",
    "site_sizes": f"{LABELLED} SELECT site, count(*) AS urls FROM l GROUP BY 1",
    "shared_site_share": f"""{LABELLED}, z AS (SELECT site, count(*) AS n FROM l GROUP BY 1) SELECT count(*) AS sites, max(n) AS largest,
      round(sum(n) FILTER (WHERE n > 1) / sum(n)::DOUBLE, 4) AS shared FROM z""",
    "site_mode_label": f"""{LABELLED}, z AS (SELECT site, count(*) AS urls FROM l GROUP BY 1 ORDER BY urls DESC, site LIMIT 10)
      SELECT z.site, z.urls, (SELECT status FROM l WHERE l.site = z.site GROUP BY status ORDER BY count(*) DESC, status LIMIT 1) AS label FROM z""",
    "url_site_size": f"{LABELLED} SELECT url_id, site, count(*) OVER (PARTITION BY site) AS site_urls FROM l",
    "v1_bug_audit": f"""{ON_CORPUS} SELECT CAST(sum({FEATURE_SQL['has_ip']}) AS BIGINT) AS v1_has_ip, count(*) FILTER (WHERE is_ip) AS ip_hosts,
      coalesce(bool_and(status = 'phishing') FILTER (WHERE is_ip), true) AS ip_hosts_all_phishing, CAST(sum({FEATURE_SQL['is_shortened']}) AS BIGINT) AS v1_is_shortened,
      CAST(sum({FEATURE_SQL['is_shortener']}) AS BIGINT) AS true_shorteners FROM p""",
    "first_flagged": f"{CORPUS} SELECT url_id, url FROM url_corpus WHERE {_SHORTENED} ORDER BY url_id LIMIT 5",
    "feature_class_means": f"""{ON_CORPUS}, {MATCH}, {SIMILARITY}, fr AS (SELECT p.status, {FEATURE_SQL['subdomain_levels']} AS subdomain_levels, {_entropy('host')} AS host_entropy,
      {_SENSITIVE} AS sensitive_words, {FEATURE_SQL['free_hosting']} AS free_hosting, {FEATURE_SQL['is_ip_host']} AS is_ip_host, s.brand_similarity, u.sev::DOUBLE AS lookalike_severity
      FROM p JOIN (SELECT url_id AS k, brand_similarity FROM sim) s ON p.url_id = s.k JOIN (SELECT url_id AS k2, sev FROM per_url) u ON p.url_id = u.k2),
      lg AS (UNPIVOT fr ON COLUMNS(* EXCLUDE (status)) INTO NAME feature VALUE v)
      SELECT feature, round(round(avg(v) FILTER (WHERE status = 'legitimate'), 3), 2) AS legitimate, round(round(avg(v) FILTER (WHERE status = 'phishing'), 3), 2) AS phishing FROM lg GROUP BY 1""",
    "findings_by_example": f"{ON_CORPUS}, {MATCH} SELECT url_id, unicode_host AS shown_as, findings FROM per_url",
    "severity_crosstab": f"""{ON_CORPUS}, {MATCH} SELECT CASE sev WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS severity,
      round(count(*) FILTER (WHERE status = 'legitimate') / (SELECT count(*) FROM p WHERE status = 'legitimate')::DOUBLE, 3) AS legitimate,
      round(count(*) FILTER (WHERE status = 'phishing') / (SELECT count(*) FROM p WHERE status = 'phishing')::DOUBLE, 3) AS phishing FROM per_url GROUP BY 1""",
    "flag_shares": f"""{ON_CORPUS}, {MATCH} SELECT status, count(*) AS n, round(avg(CASE WHEN sev > 0 THEN 1 ELSE 0 END), 4) AS any_share,
      round(avg(CASE WHEN sev = 3 THEN 1 ELSE 0 END), 4) AS high_share FROM per_url GROUP BY 1""",
    "finding_examples": f"""{ON_CORPUS}, {MATCH} SELECT f.url_id, p.url, f.brand, f.technique, f.severity FROM findings f JOIN p ON p.url_id = f.url_id WHERE f.pos = 0 ORDER BY f.url_id LIMIT 25""",
    "folds_by_site": f"{LABELLED} SELECT CAST({_HASH} % 5 AS INT) AS fold, count(*) AS urls, count(DISTINCT site) AS sites FROM l GROUP BY 1",
    "folds_stratified": f"""{CORPUS}, l AS (SELECT url_id, CASE WHEN status = 'phishing' THEN 1 ELSE 0 END AS y FROM url_corpus)
      SELECT url_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || url_id), url_id) - 1) % 5 AS INT) AS fold FROM l""",
    "holdout_by_site": f"{LABELLED} SELECT {_HASH} < {int(0.2 * 2**32)} AS is_test, count(*) AS urls, count(DISTINCT site) AS sites FROM l GROUP BY 1",
    "metrics_at": f"{CORPUS}, {SCORES} {_METRICS.format(t=0.6)}",
    "roc_auc": f"""{CORPUS}, {SCORES_2} SELECT count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives,
      round((SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM sc a, sc b WHERE a.y = 1 AND b.y = 0)::DOUBLE /
      (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS roc_auc FROM sc""",
    "roc_curve": f"{CORPUS}, {SCORES_2}, {_CURVE} SELECT p AS threshold, round(fp / N::DOUBLE, 6) AS fpr, round(tp / P::DOUBLE, 6) AS tpr FROM cum, tot".replace("p AS threshold", "cum.p AS threshold").replace("tp / P::DOUBLE", "tp / tot.P::DOUBLE"),
    "pr_curve": f"{CORPUS}, {SCORES_2}, {_CURVE} SELECT cum.p AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / tot.P::DOUBLE, 6) AS recall FROM cum, tot",
    **{name: f"""{CORPUS}, {sc}, benign AS (SELECT p FROM sc WHERE y = 0), grid AS (SELECT unnest(range(5000, 10001)) / 10000 AS t)
      SELECT (SELECT count(*) FROM benign) AS benign, coalesce((SELECT min(t) FROM grid WHERE (SELECT count(*) FROM benign WHERE p >= t) <= floor({target} * (SELECT count(*) FROM benign))), 1.0) AS threshold"""
      for name, sc, target in (("threshold_fpr", SCORES, 0.05), ("threshold_fpr_grid", SCORES_4, 0.3))},
    "share_by_source": f"""{CORPUS}, {SCORES} SELECT 'batch' || (url_id % 3) AS source, t AS threshold, count(*) AS n, count(*) FILTER (WHERE p >= t) AS reached,
      round(count(*) FILTER (WHERE p >= t) / count(*)::DOUBLE, 4) AS share FROM sc, (SELECT CAST(unnest([{', '.join(map(str, SWEEP))}]) AS DOUBLE) AS t) GROUP BY 1, 2""",
    "share_model_or_high": f"""{ON_CORPUS}, {MATCH}, {SCORES} SELECT u.status, count(*) AS n, count(*) FILTER (WHERE sc.p >= 0.7478 OR u.sev = 3) AS caught FROM per_url u JOIN sc ON sc.url_id = u.url_id GROUP BY 1""",
    "confusion": f"""{CORPUS}, {SCORES} SELECT g.y, g.predicted, (SELECT count(*) FROM sc WHERE sc.y = g.y AND (CASE WHEN sc.p >= 0.7 THEN 1 ELSE 0 END) = g.predicted) AS n
      FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS g(y, predicted)""",
    "compare_thresholds": f"""{CORPUS}, {SCORES}, a AS (SELECT 0 AS k, * FROM ({_METRICS.format(t=0.5)}) UNION ALL SELECT 1, * FROM ({_METRICS.format(t=0.7478)})),
      m AS (SELECT k, unnest(['accuracy', 'precision', 'recall', 'f1', 'false_positive_rate']) AS metric,
        unnest([(tp + tn) / (tp + tn + fp + fn)::DOUBLE, tp / greatest(tp + fp, 1)::DOUBLE, tp / greatest(tp + fn, 1)::DOUBLE, 2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, fp / greatest(fp + tn, 1)::DOUBLE]) AS v FROM a)
      SELECT metric, round(round(max(v) FILTER (WHERE k = 0), 4), 3) AS at_half, round(round(max(v) FILTER (WHERE k = 1), 4), 3) AS at_threshold FROM m GROUP BY 1
      UNION ALL SELECT 'roc_auc', area, area FROM (SELECT round(round((SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM sc a, sc b WHERE a.y = 1 AND b.y = 0)::DOUBLE /
        (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6), 3) AS area FROM sc)""",
    "top_mistakes": f"""{CORPUS}, {SCORES}, a AS (SELECT y, url_id, p FROM sc WHERE y = 0 ORDER BY p DESC, url_id LIMIT 8), b AS (SELECT y, url_id, p FROM sc WHERE y = 1 ORDER BY p, url_id LIMIT 8)
      SELECT y, url_id, round(p, 6) AS p FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "top_flagged": f"{CORPUS}, {SCORES} SELECT url_id, round(p, 6) AS p FROM (SELECT * FROM sc WHERE y = 0 ORDER BY p DESC, url_id LIMIT 10)",
    "ngram_vocab": f"{CORPUS}, {_GRAMS} SELECT gram, df, cf, round(idf, 6) AS idf FROM vocab",
    "ngram_tfidf": f"""{CORPUS}, {_GRAMS}, w AS (SELECT tf.url_id, (1 + ln(tf.tf)) * vocab.idf AS w FROM tf JOIN vocab ON tf.gram = vocab.gram), nrm AS (SELECT url_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1)
      SELECT w.url_id, count(*) AS terms, round(max(w / norm), 5) AS largest, round(sum(w / norm), 4) AS total FROM w JOIN nrm ON w.url_id = nrm.url_id GROUP BY 1""",
    "score_relation": f"""{CORPUS}, {_GRAMS}, w AS (SELECT tf.url_id, (1 + ln(tf.tf)) * idf AS w, (CAST('0x' || substr(md5(vocab.gram), 1, 6) AS BIGINT) / 16777216::DOUBLE - 0.5) * 8 AS coef FROM tf JOIN vocab ON tf.gram = vocab.gram),
      s AS (SELECT url_id, sum(w * coef) / sqrt(sum(w * w)) AS s FROM w GROUP BY 1) SELECT u.url_id, round(1 / (1 + exp(-(coalesce(s, 0) - 0.125))), 6) AS p FROM url_corpus u LEFT JOIN s ON s.url_id = u.url_id""",
    "fold_vocab": f"""{LABELLED}, f AS (SELECT url_id, url, CAST({_HASH} % 5 AS INT) AS fold FROM l),
      g AS (SELECT fold, url_id, unnest(list_concat(list_concat([substr(lower(url), i, 3) for i in range(1, length(url) - 1)], [substr(lower(url), i, 4) for i in range(1, length(url) - 2)]),
        [substr(lower(url), i, 5) for i in range(1, length(url) - 3)])) AS gram FROM f),
      t AS (SELECT fold, url_id, gram, count(*) AS tf FROM g GROUP BY ALL), k AS (SELECT unnest(range(0, 5))::INT AS out),
      v AS (SELECT out, gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM t JOIN k ON fold <> out GROUP BY 1, 2 HAVING count(*) >= 2)
      SELECT out AS fold, gram, df, cf, round(ln((1 + (SELECT count(*) FROM f WHERE fold <> out)) / (1 + df)) + 1, 6) AS idf FROM v
      QUALIFY row_number() OVER (PARTITION BY out ORDER BY cf DESC, gram) <= 2000""",
    "combined_score": f"{CORPUS}, {SCORES} SELECT url_id, round((p + floor(p * 100) / 100) / 2, 6) AS p FROM sc",
    "stream_check": _stream("SELECT url_id, CASE WHEN sev = 3 THEN 'phishing' ELSE 'legitimate' END AS verdict, registered AS site, findings FROM per_url"),
    "stream_distinct": "SELECT DISTINCT 'https://site' || (user_id % 50) || '.example.org/' AS url FROM events",
    "stream_windows": f"""{duckdb_with('clicks')}, numbered AS MATERIALIZED (SELECT row_number() OVER () AS url_id, url FROM (SELECT DISTINCT url FROM clicks)), {parts('numbered')}, {MATCH},
      d AS (SELECT date_trunc('day', c.ts) AS day, CASE WHEN u.sev = 3 THEN 'phishing' ELSE 'legitimate' END AS verdict FROM clicks c JOIN per_url u ON u.url = c.url)
      SELECT strftime(day, '%Y-%m-%d') AS day, verdict, count(*) AS urls FROM d WHERE day + INTERVAL 2 DAY <= (SELECT max(ts) FROM clicks) GROUP BY ALL""",
    "stream_with_model": "SELECT page_id AS url_id, true AS same FROM pages",
    "oof_facts": f"""{PREPARED} SELECT CAST({_HASH} % 5 AS INT) AS fold, count(*) AS urls, CAST(sum(y) AS BIGINT) AS phishing, count(*) AS in_range FROM once GROUP BY 1""",
    "train_facts": f"""{PREPARED} SELECT 'ngrams' AS model, CAST(sum(y) AS BIGINT) AS phishing, count(DISTINCT site) AS sites, count(*) AS urls, true AS target_met, true AS same_scores, true AS in_range FROM once""",
    "stream_requests": f"""{ON_CORPUS}, {MATCH}, {_REQUESTS} SELECT verdict, count(*) AS n FROM (
      SELECT CASE WHEN u.sev = 3 THEN 'phishing' ELSE 'legitimate' END AS verdict FROM rq JOIN per_url u ON u.url_id = rq.request_id WHERE form IN (0, 1, 4)
      UNION ALL SELECT 'legitimate' FROM rq WHERE form = 0 UNION ALL SELECT 'rejected' FROM rq WHERE form IN (2, 3, 5, 6)) GROUP BY 1""",
    **{name: f"""{BIG}, numbered AS MATERIALIZED (SELECT row_number() OVER () AS url_id, url FROM url_big), {parts('numbered')}, {MATCH} {tail}""" for name, tail in (
        ("big_log_findings", "SELECT technique, severity, count(*) AS n FROM findings GROUP BY 1, 2"),
        ("big_log_verdicts", "SELECT CASE WHEN sev = 3 THEN 'phishing' ELSE 'legitimate' END AS verdict, count(*) AS urls, count(DISTINCT registered) AS sites FROM per_url GROUP BY 1"))},
    "gen_lookalikes": f"""{ON_CORPUS}, homes AS (SELECT DISTINCT registered AS home, split_part(registered, '.', 1) AS label, substr(registered, strpos(registered, '.') + 1) AS ending FROM p WHERE status = 'legitimate' AND domain <> ''),
      spots AS (SELECT *, unnest(range(1, length(label) + 1)) AS i FROM homes),
      made AS (SELECT home, label, ending, 'omission' AS technique, substr(label, 1, i - 1) || substr(label, i + 1) AS m FROM spots
        UNION SELECT home, label, ending, 'repetition', substr(label, 1, i) || substr(label, i) FROM spots
        UNION SELECT home, label, ending, 'transposition', substr(label, 1, i - 1) || label[i + 1] || label[i] || substr(label, i + 2) FROM spots WHERE i < length(label)
        UNION SELECT home, label, ending, 'hyphenation', substr(label, 1, i) || '-' || substr(label, i + 1) FROM spots WHERE i < length(label)
        UNION SELECT home, label, ending, 'replacement', substr(label, 1, i - 1) || v || substr(label, i + 1) FROM spots, (SELECT unnest(['a', 'e', 'i', 'o', 'u']) AS v) WHERE v <> label[i]
        UNION SELECT home, label, ending, 'homoglyph', substr(label, 1, i - 1) || g || substr(label, i + 1) FROM spots JOIN (VALUES {_GLYPHS}) AS x(c, g) ON label[i] = c
        UNION SELECT home, label, ending, 'combosquat', unnest([label || '-' || w, w || '-' || label, label || w]) FROM homes, (SELECT unnest([{_list(dims.COMBO_WORDS)}]) AS w))
      SELECT home AS name, home, technique, 'https://' || m || '.' || ending || '/' AS url FROM made WHERE m <> label AND length(m) >= 2 AND m || '.' || ending NOT IN (SELECT official FROM ({OFFICIAL_DIM}))
      UNION ALL SELECT home, home, 'subdomain', unnest(['https://' || home || '.account-verify.com/signin', 'https://' || label || '.secure-login.com/signin']) FROM homes
      UNION ALL SELECT home, home, 'tld-swap', 'https://' || label || '.' || t || '/' FROM homes, (SELECT unnest([{_list(dims.SWAP_TLDS)}]) AS t) WHERE label || '.' || t NOT IN (SELECT official FROM ({OFFICIAL_DIM}))""",
    "parts_packed": f"{ON_CORPUS} SELECT url_id, host, registered, is_ip FROM p",
}
ORACLES["threshold_sweep"] = ORACLES["report_roundtrip"]
# a report's sections are those of the queries that make them
ORACLES["report_sections"] = f"""SELECT 'cross_validation' AS section, 'by site' AS name, at_half AS value FROM ({ORACLES["compare_thresholds"]}) WHERE metric = 'recall'
  UNION ALL SELECT 'at_threshold', metric, at_threshold FROM ({ORACLES["compare_thresholds"]})
  UNION ALL SELECT 'lookalikes', status, any_share FROM ({ORACLES["flag_shares"]})
  UNION ALL SELECT 'top_mistakes', url_id::VARCHAR, y::DOUBLE FROM ({ORACLES["top_mistakes"]})"""
