"""Dataset profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import add

SEVERITY_NAME = "CASE lookalike_severity WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END"


def first_per_url(df: DataFrame) -> DataFrame:
    """One row per URL, the one with the lowest ``url_id`` (S2). The grouping keeps a running minimum
    on the map side, so copies of one URL never gather in a task."""
    return df.groupBy("url").agg(
        F.min("url_id").alias("url_id"), F.expr("min_by(struct(status), url_id)").alias("_first")
    ).selectExpr("url_id", "url", "_first.status AS status")


def with_label(df: DataFrame) -> DataFrame:
    """``y``: 1 for phishing, 0 for anything else, unknown included."""
    return add(df, {"y": "IF(status = 'phishing', 1, 0)"})


def dataset_counts(df: DataFrame) -> DataFrame:
    """Rows, phishing rows and distinct sites (A1)."""
    return df.agg(F.count(F.lit(1)).alias("urls"), F.sum("y").alias("phishing"), F.count_distinct("site").alias("sites"))


def class_balance(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def class_profile(df: DataFrame) -> DataFrame:
    """Median URL length and share of URLs that start with https, per class.

    The median is taken over counted lengths, of which there are few, not over rows.
    """
    lengths = df.groupBy("status", F.expr("length(url)").alias("_len")).agg(
        F.count(F.lit(1)).alias("_n"), F.expr("count_if(startswith(url, 'https'))").alias("_https")
    )
    return lengths.groupBy("status").agg(
        F.expr("round(CAST(percentile(_len, 0.5D, _n) AS DOUBLE), 3)").alias("median_length"),
        F.expr("round(sum(_https) / sum(_n), 3)").alias("https_share"),
    )


def length_histogram(df: DataFrame, below: int = 250, bins: int = 60) -> DataFrame:
    """Equal-width histogram of URL lengths per class, with densities that sum to one per class."""
    lengths = df.where(f"length(url) < {below}").groupBy("status", F.expr("length(url)").alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    ends = lengths.selectExpr("min(_len) AS _lo", "max(_len) AS _hi", "1 AS _one")
    binned = add(lengths, {"_one": "1"}).join(F.broadcast(ends), "_one")
    width = f"((_hi - _lo) / {bins}D)"
    binned = add(binned, {"bin": f"IF(_hi = _lo, 0, least(CAST(floor((_len - _lo) / {width}) AS INT), {bins - 1}))", "_width": width})
    counts = binned.groupBy("status", "bin", "_width").agg(F.sum("_n").alias("n"))
    return counts.selectExpr("status", "bin", "n", "round(n / (sum(n) OVER (PARTITION BY status) * _width), 9) AS density")


def site_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("site").agg(F.count(F.lit(1)).alias("urls"))


def shared_site_share(df: DataFrame) -> DataFrame:
    """Sites, largest site and the share of URLs whose site has another URL (A3, A4)."""
    return site_sizes(df).agg(
        F.count(F.lit(1)).alias("sites"),
        F.max("urls").alias("largest"),
        F.expr("round(sum(IF(urls > 1, urls, 0)) / sum(urls), 4)").alias("shared"),
    )


def top_sites(df: DataFrame, k: int = 10) -> DataFrame:
    """The largest sites with their most frequent label, the smaller label on ties."""
    per_label = df.where("status IS NOT NULL").groupBy("site", "status").agg(F.count(F.lit(1)).alias("_n"))
    modal = per_label.groupBy("site").agg(F.expr("min_by(status, struct(-_n, status))").alias("label"))
    top = site_sizes(df).orderBy(F.desc("urls"), "site").limit(k)
    return top.join(modal, "site", "left")


def url_site_size(df: DataFrame) -> DataFrame:
    """Every URL with the size of its site."""
    from .skew import spread_join

    return spread_join(df, site_sizes(df).withColumn("site_urls", F.col("urls")), "site", "urls", ["site_urls"])


def v1_audit(df: DataFrame) -> DataFrame:
    """What the two broken first-generation flags say against the truth.

    Needs status, has_ip, is_shortened, is_ip and is_shortener.
    """
    return df.agg(
        F.expr("CAST(sum(has_ip) AS BIGINT)").alias("v1_has_ip"),
        F.expr("count_if(is_ip)").alias("ip_hosts"),
        F.expr("coalesce(bool_and(status = 'phishing') FILTER (WHERE is_ip), true)").alias("ip_hosts_all_phishing"),
        F.expr("CAST(sum(is_shortened) AS BIGINT)").alias("v1_is_shortened"),
        F.expr("CAST(sum(is_shortener) AS BIGINT)").alias("true_shorteners"),
    )


def first_flagged(df: DataFrame, flag: str, k: int = 5) -> DataFrame:
    """The first ``k`` URLs, by id, for which a flag is set."""
    return df.where(F.col(flag) == 1).orderBy("url_id").limit(k).select("url_id", "url")


def feature_class_means(df: DataFrame, names) -> DataFrame:
    """One row per feature, one column per class (A10)."""
    means = df.groupBy("status").agg(*[F.avg(n).alias(n) for n in names])
    long = means.unpivot(["status"], list(names), "feature", "mean")
    return long.groupBy("feature").pivot("status", ["legitimate", "phishing"]).agg(F.round(F.first("mean"), 3))


def severity_crosstab(df: DataFrame) -> DataFrame:
    """Strongest finding by class, as shares of the class."""
    counts = df.groupBy(F.expr(SEVERITY_NAME).alias("severity"), "status").agg(F.count(F.lit(1)).alias("_n"))
    shares = counts.selectExpr("severity", "status", "_n / sum(_n) OVER (PARTITION BY status) AS _share")
    wide = shares.groupBy("severity").pivot("status", ["legitimate", "phishing"]).agg(F.round(F.first("_share"), 3))
    return wide.na.fill(0.0)


def detection_rates(df: DataFrame) -> DataFrame:
    """Share of generated lookalikes whose own brand is found, per brand group and technique.

    Needs ``grp``, ``technique``, ``name`` and ``lookalike``.
    """
    hit = "exists(lookalike, f -> f.brand = name)"
    return df.where("grp IS NOT NULL").groupBy("grp", "technique").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"count_if({hit})").alias("hits"), F.expr(f"round(avg(IF({hit}, 1, 0)), 4)").alias("detected")
    )


def flag_shares(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows with any and with a high finding."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("round(avg(IF(lookalike_severity > 0, 1, 0)), 4)").alias("any_share"),
        F.expr("round(avg(IF(lookalike_severity = 3, 1, 0)), 4)").alias("high_share"),
    )


def finding_examples(df: DataFrame, k: int = 15, high_only: bool = False) -> DataFrame:
    """First finding of the first ``k`` flagged URLs, by id."""
    flagged = df.where("lookalike_severity = 3" if high_only else "lookalike_severity > 0")
    return flagged.orderBy("url_id").limit(k).selectExpr(
        "url_id", "url", "lookalike[0].brand AS brand", "lookalike[0].technique AS technique", "lookalike[0].severity AS severity"
    )


def sketches(df: DataFrame, by: tuple[str, ...], column: str, lg: int = 14) -> DataFrame:
    """``(*by, rows, sketch)``: what to store per day or source so that distinct values can be counted over any of them
    later (A1). A sketch has ``2 ** lg`` registers at most, whatever it counted; null values are left out."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.col(column).cast("string"), lg).alias("sketch"))


def merged(stored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, rows, about)``: rows and estimated distinct values of merged sketches; the values themselves are not read."""
    return stored.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
