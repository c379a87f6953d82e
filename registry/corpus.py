"""Fixture tables derived from the given tables, as SQL that Spark and DuckDB both run.

``pages`` is the only table with URLs, all of them harmless, so the labelled corpus adds per page a
generated lookalike, an official address and a structurally odd URL. See FIXTURES.md section 3.
"""

from __future__ import annotations

from lurescan.dims import BRANDS, COMBO_WORDS, SUBDOMAIN_BAIT, SWAP_TLDS

_BRAND_ROWS = ", ".join(f"({b.ord}, '{b.brand}', '{b.home}', {str(b.word_only).lower()})" for b in BRANDS)
_OFFICIAL_ROWS = ", ".join(
    f"({b.ord}, '{b.brand}', {i}, '{d}')" for b in BRANDS for i, d in enumerate(b.official)
)
BRAND_DIM = f"SELECT * FROM (VALUES {_BRAND_ROWS}) AS b(ord, brand, home, word_only)"
OFFICIAL_DIM = f"SELECT * FROM (VALUES {_OFFICIAL_ROWS}) AS o(ord, brand, pos, official)"


def _pick(values, index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_LABEL_OF_KIND = f"""
  CASE kind
    WHEN 0 THEN concat(substr(label, 1, pos), substr(label, pos + 2))
    WHEN 1 THEN concat(substr(label, 1, pos + 1), substr(label, pos + 1))
    WHEN 2 THEN concat(substr(label, 1, pos2), substr(label, pos2 + 2, 1), substr(label, pos2 + 1, 1), substr(label, pos2 + 3))
    WHEN 3 THEN concat(substr(label, 1, pos2 + 1), '-', substr(label, pos2 + 2))
    WHEN 4 THEN concat(substr(label, 1, pos), substr('aeiou', CAST(i % 5 AS INT) + 1, 1), substr(label, pos + 2))
    WHEN 5 THEN concat(substr(label, 1, glyph), CASE substr(label, glyph + 1, 1) WHEN 'o' THEN '0' WHEN 'l' THEN '1'
      WHEN 'i' THEN '1' WHEN 'e' THEN '3' WHEN 'm' THEN 'rn' WHEN 'w' THEN 'vv' ELSE '' END, substr(label, glyph + 2))
    WHEN 6 THEN CASE variant % 3
      WHEN 0 THEN concat(label, '-', word) WHEN 1 THEN concat(word, '-', label) ELSE concat(label, word) END
  END"""

CORPUS_CTES = f"""
brand_dim AS ({BRAND_DIM}),
page_base AS (
  SELECT page_id AS i, url, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS rest,
    CAST((page_id + CAST(floor(page_id / 9) AS BIGINT)) % {len(BRANDS)} AS INT) AS ord,
    CAST(page_id % 9 AS INT) AS kind, CAST(floor(page_id / 9) AS BIGINT) AS step
  FROM {{pages}}),
page_brand AS (
  SELECT p.i, p.url, p.rest, p.kind, b.brand, b.home, b.word_only,
    split_part(b.home, '.', 1) AS label, substr(b.home, length(split_part(b.home, '.', 1)) + 2) AS suffix,
    CAST(p.step % length(split_part(b.home, '.', 1)) AS INT) AS pos,
    CAST(p.step % (length(split_part(b.home, '.', 1)) - 1) AS INT) AS pos2,
    length(regexp_extract(split_part(b.home, '.', 1), '^([^oliemw]*)', 1)) AS glyph,
    CAST(p.step % 18 AS INT) AS variant, CAST(p.step % 2 AS INT) AS v2, CAST(p.step % 4 AS INT) AS v4,
    {_pick(COMBO_WORDS, "CAST(floor((p.step % 18) / 3) AS INT)")} AS word
  FROM page_base p JOIN brand_dim b ON p.ord = b.ord),
page_made AS (
  SELECT *, {_LABEL_OF_KIND} AS made FROM page_brand),
page_host AS (
  SELECT *, CASE kind
      WHEN 7 THEN CASE v2 WHEN 0 THEN concat(home, '.{SUBDOMAIN_BAIT[0]}.com') ELSE concat(label, '.{SUBDOMAIN_BAIT[1]}.com') END
      WHEN 8 THEN concat(label, '.', {_pick(SWAP_TLDS, "v4")})
      ELSE concat(made, '.', suffix) END AS host0
  FROM page_made),
page_fake AS (
  SELECT *, CASE WHEN made = label OR length(made) < 2 OR host0 IN (SELECT official FROM ({OFFICIAL_DIM}) x)
    THEN concat(label, '-login.', suffix) ELSE host0 END AS fake_host
  FROM page_host),
url_corpus AS (
  SELECT 4 * i + v.v AS url_id,
    CASE v.v WHEN 0 THEN url WHEN 1 THEN concat('https://', fake_host, rest) WHEN 2 THEN concat('https://www.', home, rest)
    ELSE CASE CAST(i % 8 AS INT)
      WHEN 0 THEN concat('http://10.', CAST(i % 256 AS VARCHAR(20)), '.', CAST(CAST(floor(i / 256) AS BIGINT) % 256 AS VARCHAR(20)), '.7:8080/login.php')
      WHEN 1 THEN concat('http://0x7f.0x0.0x0.0x', CAST(1 + CAST(floor(i / 8) AS BIGINT) % 9 AS VARCHAR(20)), '/verify')
      WHEN 2 THEN concat('https://bit.ly/', CAST(i AS VARCHAR(20)))
      WHEN 3 THEN concat('https://', brand, '-support.000webhostapp.com/account/update.html')
      WHEN 4 THEN concat('http://a.b.secure.login', CAST(i AS VARCHAR(20)), '.example.org/confirm/password')
      WHEN 5 THEN concat('http://site', CAST(i AS VARCHAR(20)), '.example.net/x?user=u', CAST(i AS VARCHAR(20)), '@mail.com')
      WHEN 6 THEN concat('http://xn--pypal-4ve.com/signin/', CAST(i AS VARCHAR(20)))
      ELSE concat('evil', CAST(i AS VARCHAR(20)), '.example/', brand, '/login') END END AS url,
    CASE WHEN v.v IN (1, 3) THEN 'phishing' ELSE 'legitimate' END AS status
  FROM page_fake p JOIN (VALUES (0, 0), (0, 1), (0, 2), (0, 3)) AS v(half, v) ON v.half = floor(p.kind / 9))"""

# text rows with defects: no host, malformed authority, odd ports, no scheme, raw Unicode, comments
EDGE_URLS = (
    "", "   ", "http://", "http:///x", "http://[abc", "http://[::1]:80/", "http://a.com:99999/", "http://a.com:x/",
    "http://u:p@a.com:80/", "http://a.com/p;q=1", "javascript:alert(1)", "a@b.com", "http://a.com?x=a@b",
    "https://sites.google.com/x", "https://x.sites.google.com/", "http://office365-login.com/",
    "http://999.999.999.999/", "http://3232235777/", "http://a.com../", "not a url at all", "# a comment",
    "  http://trimmed.example.com/x  ", "ftp://files.example.org/a;type=i", "http://paypal.com@evil.example/",
    "HTTPS://WWW.Example.CO.IN/A?B=C#D", "http://example.com//double//slash", "localhost", "co.in",
)
_EDGE_ROWS = ", ".join(f"({k}, '{u}')" for k, u in enumerate(EDGE_URLS))

# repeats of every 50th corpus row with the other label, unknown labels, and edge rows on top of the pages
RAW_CTES = f"""{CORPUS_CTES},
corpus_size AS (SELECT CAST(count(*) AS BIGINT) AS n FROM url_corpus),
url_raw AS (
  SELECT url_id, url, CASE WHEN url_id % 97 = 5 THEN 'unknown' WHEN url_id % 101 = 7 THEN NULL ELSE status END AS status FROM url_corpus
  UNION ALL SELECT c.url_id + (SELECT n FROM corpus_size), c.url, CASE c.status WHEN 'phishing' THEN 'legitimate' ELSE 'phishing' END
    FROM url_corpus c WHERE c.url_id % 50 = 0
  UNION ALL SELECT 2 * (SELECT n FROM corpus_size) + e.k, e.u, 'legitimate' FROM (VALUES {_EDGE_ROWS}) AS e(k, u))"""

CLICKS_CTES = f"""{CORPUS_CTES},
corpus_size AS (SELECT CAST(count(*) AS BIGINT) AS n FROM url_corpus),
clicks AS (
  SELECT e.event_id, e.ts, e.user_id, c.url
  FROM (SELECT x.event_id, x.ts, x.user_id, (x.event_id * 31) % (SELECT n FROM corpus_size) AS pick FROM {{events}} x) e
  JOIN url_corpus c ON c.url_id = e.pick)"""

BIG_CTES = f"""{CORPUS_CTES},
corpus_size AS (SELECT CAST(count(*) AS BIGINT) AS n FROM url_corpus),
url_big AS (
  SELECT l.k AS url_id, concat(c.url, CASE WHEN c.url LIKE '%?%' THEN '&k=' ELSE '?k=' END, l.tag) AS url
  FROM (SELECT x.l_orderkey * 10 + x.l_linenumber AS k, (x.l_orderkey * 7 + x.l_linenumber) % (SELECT n FROM corpus_size) AS pick,
      concat(CAST(x.l_orderkey AS VARCHAR(20)), '-', CAST(x.l_linenumber AS VARCHAR(20))) AS tag
    FROM {{lineitem}} x) l
  JOIN url_corpus c ON c.url_id = l.pick)"""

# a brand table as long as the documents have words, and URLs that play on these words
WORD_BRAND_CTES = f"""brand_dim AS ({BRAND_DIM}),
doc_words AS (SELECT doc_id, {{words}} AS w FROM {{documents}}),
doc_word AS (SELECT DISTINCT {{explode}}(w) AS brand FROM doc_words),
word_brand AS (
  SELECT ord, brand, home, word_only FROM brand_dim
  UNION ALL SELECT 1000 + CAST({{number}} AS INT), brand, concat(brand, '.test'), false FROM doc_word WHERE brand NOT IN (SELECT brand FROM brand_dim)),
word_official AS (
  SELECT brand, official FROM ({OFFICIAL_DIM}) o
  UNION ALL SELECT brand, concat(brand, '.test') FROM word_brand WHERE ord >= 1000),
doc_base AS (SELECT doc_id, {{first}} AS a, {{last}} AS b FROM doc_words WHERE {{size}}(w) > 0),
word_urls AS (
  SELECT doc_id AS url_id, CASE doc_id % 8
    WHEN 0 THEN concat('https://', a, '.com/') WHEN 1 THEN concat('http://login-', a, '.net/x?y=', b) WHEN 2 THEN concat('https://', substr(a, 1, 1), substr(a, 3), '.org/', b)
    WHEN 3 THEN concat('https://', a, '.', b, '.info/') WHEN 4 THEN concat('https://site', CAST(doc_id AS VARCHAR(20)), '.com/', a, '/', b, '/', a) WHEN 5 THEN concat('https://www.', a, '.test/', b)
    WHEN 6 THEN concat('http://user@', a, '.test.', b, 's.com:81/') ELSE concat('https://a.login.', a, b, '.xyz/login') END AS url
  FROM doc_base)"""

TABLE_CTES = {"url_corpus": CORPUS_CTES, "url_raw": RAW_CTES, "clicks": CLICKS_CTES, "url_big": BIG_CTES}


_WORDS = {
    "spark": {"words": "filter(regexp_extract_all(lower(text), '[a-z]+', 0), x -> length(x) >= 9)", "explode": "explode", "number": "conv(substr(md5(brand), 1, 7), 16, 10)", "first": "element_at(w, 1)", "last": "element_at(w, -1)", "size": "size"},
    "duckdb": {"words": "list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 9)", "explode": "unnest", "number": "'0x' || substr(md5(brand), 1, 7)", "first": "w[1]", "last": "w[-1]", "size": "len"},
}


def duckdb_word_brands() -> str:
    """CTEs of the word brands and their URLs, in DuckDB's words."""
    return WORD_BRAND_CTES.format(documents="documents", **_WORDS["duckdb"])


def word_brands(spark, sf_dir: str):
    """(URLs, brand table) of the documents' words of nine letters or more."""
    ctes = WORD_BRAND_CTES.format(documents=f"parquet.`{sf_dir}/documents.parquet`", **_WORDS["spark"])
    urls = spark.sql(f"WITH {ctes} SELECT url_id, url FROM word_urls")
    brands = spark.sql(f"WITH {ctes} SELECT b.ord, b.brand, collect_list(o.official) AS official, b.home, b.word_only FROM word_brand b JOIN word_official o ON o.brand = b.brand GROUP BY ALL")
    return urls, brands


def duckdb_with(table: str) -> str:
    """``WITH ...`` prefix that defines a fixture table over the registered views."""
    return "WITH RECURSIVE " + TABLE_CTES[table].format(pages="pages", events="events", lineitem="lineitem")


def load(spark, sf_dir: str, table: str = "url_corpus"):
    """A fixture table as a DataFrame over the given Parquet files."""
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("pages", "events", "lineitem")}
    df = spark.sql(f"WITH {TABLE_CTES[table].format(**files)} SELECT * FROM {table}")
    # a small table is a single file with a single split: use the other cores as well
    base = {"clicks": "events", "url_big": "lineitem"}.get(table, "pages")
    cores = spark.sparkContext.defaultParallelism
    splits = spark.read.parquet(f"{sf_dir}/{base}.parquet").rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores else df
