"""Readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import add, quote, trim_space

LABELLED = "url string, status string"
REPORT = (
    "sources struct<feed_urls:bigint,popular_sites:bigint,fetched:string,list_id:string>, "
    "out_of_time array<struct<model:string,measure:string,share:double>>, "
    "sweep array<struct<threshold:double,recall:double,false_positive_rate:double>>"
)
REQUEST = "urls array<string>, url string"


def labelled_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Labelled URLs ``(url, status)`` (S1). A missing URL stays null; see ``quarantine_missing``.

    With a header, columns are taken by name in any order and others are left out; a file without one of
    the two names is refused.
    """
    read = spark.read.option("escape", '"')
    if not header:
        return read.schema(LABELLED).csv(path)
    found = read.option("header", True).csv(path)  # all columns as text; only the header line is read here
    missing = {"url", "status"} - set(found.columns)
    if missing:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    return found.select("url", "status")


def labelled_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELLED).parquet(path)


def quarantine_missing(df: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(rows with a URL, rows without): a missing URL must not become the text ``nan`` (S3)."""
    text = add(df, {url: f"CAST(`{url}` AS STRING)"})
    return text.where(F.col(url).isNotNull()), text.where(F.col(url).isNull())


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank lines and lines that start with # are left out, others kept as written."""
    lines = spark.read.text(path)
    return lines.where(f"{trim_space('value')} <> '' AND NOT startswith(value, '#')").select(F.col("value").alias("url"))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line, trimmed, blank lines left out."""
    return add(spark.read.text(path), {"url": trim_space("value")}).where("url <> ''").select("url")


def popular_sites(spark: SparkSession, path: str, top: int) -> DataFrame:
    """Ranked domains as home-page URLs, the first ``top`` ranks."""
    sites = spark.read.schema("rank int, domain string").csv(path)
    return sites.where(F.col("rank") <= top).selectExpr("rank", "domain", "concat('https://', domain, '/') AS url")


def union_inputs(*inputs: DataFrame) -> DataFrame:
    """URLs of several inputs, repeats included."""
    out = inputs[0].select("url")
    for other in inputs[1:]:
        out = out.unionByName(other.select("url"))
    return out


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``request_urls`` and ``accepted`` to a table of JSON request bodies.

    ``{"urls": [...]}`` wins over ``{"url": "..."}``; every element must be a JSON string.
    """
    raw_urls, raw_url = f"get_json_object(`{body}`, '$.urls')", f"get_json_object(`{body}`, '$.url')"
    many = f"from_json(`{body}`, {quote(REQUEST)}).urls"
    one = f"from_json(`{body}`, {quote(REQUEST)}).url"
    # element types are only visible in the raw text: count the elements that start with a quote
    strings = f"from_json(`{body}`, 'urls array<variant>').urls"
    kinds = f"transform({strings}, v -> schema_of_variant(v))"
    df = add(
        df,
        {
            "_many": many,
            "_kinds": f"IF({raw_urls} IS NULL, CAST(NULL AS array<string>), {kinds})",
            "_one": f"IF({raw_url} IS NULL, NULL, {one})",
            "_one_kind": f"schema_of_variant(from_json(`{body}`, 'url variant').url)",
        },
    )
    df = add(
        df,
        {
            "request_urls": "CASE WHEN size(_many) > 0 THEN _many WHEN _one <> '' THEN array(_one) ELSE CAST(array() AS array<string>) END",
            "accepted": "CASE WHEN size(_kinds) > 0 THEN forall(_kinds, k -> coalesce(k = 'STRING', false)) "
            "ELSE coalesce(_one <> '' AND _one_kind = 'STRING', false) END",
        },
    )
    return df.drop("_many", "_kinds", "_one", "_one_kind")


def request_urls(df: DataFrame, *keys: str) -> DataFrame:
    """One row per URL of every accepted request, with its position."""
    return df.where("accepted").selectExpr(*keys, "posexplode(request_urls) AS (pos, url)")


def rejected_requests(df: DataFrame) -> DataFrame:
    """The quarantine side of ``parse_requests``."""
    return df.where("NOT accepted").drop("request_urls", "accepted")


def snapshot(feed_urls: DataFrame, sites: DataFrame, list_id: str, fetched: str) -> DataFrame:
    """One row of facts about the inputs of a report."""
    counts = feed_urls.select(F.lit(1).alias("f"), F.lit(0).alias("s")).unionByName(sites.select(F.lit(0).alias("f"), F.lit(1).alias("s")))
    return counts.agg(F.sum("f").alias("feed_urls"), F.sum("s").alias("popular_sites")).selectExpr(
        "feed_urls", "popular_sites", f"{quote(fetched)} AS fetched", f"{quote(list_id)} AS list_id"
    )


def report(spark: SparkSession, path: str) -> DataFrame:
    """A nested report document."""
    return spark.read.schema(REPORT).json(path, multiLine=True)


def report_section(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of any section of a report; a report without it has none."""
    doc = spark.read.schema(f"`{name}` array<struct<{schema}>>").json(path, multiLine=True)
    return doc.selectExpr(f"inline(`{name}`)")


def report_shares(doc: DataFrame) -> DataFrame:
    """Model by measure table of a report."""
    rows = doc.selectExpr("inline(out_of_time)")
    return rows.groupBy("measure").pivot("model", ["v1", "combined"]).agg(F.first("share"))


def report_sweep(doc: DataFrame) -> DataFrame:
    """Threshold sweep of a report, one row per threshold."""
    return doc.selectExpr("inline(sweep)")
