"""Character n-grams and their TF-IDF weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chars
from ..plans.storage import stable
from .ranked import largest
from .skew import spread_join

MIN_N, MAX_N = 3, 5
MIN_DF = 2
MAX_TERMS = 200_000
#: URLs of a task that counts their grams, of which a URL has some 250
URLS_PER_TASK = 5_000


def grams(url: str = "url") -> str:
    """array<string> of all runs of 3 to 5 characters of the lower-cased text, repeats included."""
    text = f"regexp_replace(lower(`{url}`), '(?U)\\\\s\\\\s+', ' ')"
    runs = ", ".join(
        f"IF(size(cs) >= {n}, transform(sequence(1, size(cs) - {n - 1}), i -> array_join(slice(cs, i, {n}), '')), "
        "CAST(array() AS array<string>))"
        for n in range(MIN_N, MAX_N + 1)
    )
    return f"transform(array({chars(text)}), cs -> concat({runs}))[0]"


def with_grams(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``_grams`` and stores the table: counting, fitting and scoring then read the grams instead of making them."""
    return stable(df.withColumn("_grams", F.expr(grams(url))), "grams")


def encoded(df: DataFrame, known: list[str]) -> DataFrame:
    """Stores the table with ``_ids``, the places in ``known`` of a URL's grams, ascending, and ``_tf``, how often each
    occurs, instead of ``_grams``: models then look grams up by number. ``known`` is in order, as long as some vocabularies."""

    # self-contained, as workers run it; grams stay Arrow strings throughout
    @F.arrow_udf("struct<ids: array<int>, tf: array<int>>")
    def counted(grams: pa.Array) -> pa.Array:
        n, size, flat = len(grams), max(len(known), 1), grams.flatten()
        place = pc.index_in(flat, value_set=pa.array(known, flat.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), pc.list_value_length(grams).fill_null(0).to_numpy(zero_copy_only=False))
        found = place >= 0
        pair, tf = np.unique(row[found].astype("int64") * size + place[found], return_counts=True)
        cuts = pa.array(np.searchsorted(pair // size, np.arange(n + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype("int32"))) for x in (pair % size, tf)]
        return pa.StructArray.from_arrays(lists, ["ids", "tf"])

    rest = [f"`{c}`" for c in df.columns if c != "_grams"]
    return stable(df.withColumn("_counted", counted("_grams")).select(*rest, "_counted.ids", "_counted.tf").withColumnsRenamed({"ids": "_ids", "tf": "_tf"}), "gram-ids")


def counts(df: DataFrame, url: str = "url", k: int = 0) -> DataFrame:
    """``(gram, df, cf)``: in how many URLs a gram occurs and how often, stored; with ``k``, also ``df_i, cf_i`` of each ``fold`` i.

    One exchange: every URL contributes its grams once for the corpus count and once, deduplicated in
    the row, for the document count; both are summed per task before the shuffle, so a gram that
    occurs in every URL costs one row per task.
    """
    made = F.col("_grams") if "_grams" in df.columns else F.expr(grams(url))
    fold = ["fold"] if k else []
    both = "concat(transform(_g, g -> named_struct('gram', g, 'c', 1, 'd', 0)), transform(array_distinct(_g), g -> named_struct('gram', g, 'c', 0, 'd', 1)))"
    each = df.select(*fold, made.alias("_g")).selectExpr(*fold, f"inline({both})")
    per_fold = [F.sum(F.when(F.col("fold") == i, F.col(c)).otherwise(0)).alias(f"{c}f_{i}") for i in range(k) for c in ("d", "c")]
    return stable(each.groupBy("gram").agg(F.sum("d").alias("df"), F.sum("c").alias("cf"), *per_fold), "gram-counts")


def without_fold(counted: DataFrame, fold: int) -> DataFrame:
    """``(gram, df, cf)`` of all folds but one: totals minus the fold, without another pass over URLs."""
    return counted.selectExpr("gram", f"df - df_{fold} AS df", f"cf - cf_{fold} AS cf")


def most_frequent(counted: DataFrame, docs: int, min_df: int = MIN_DF, max_terms: int = MAX_TERMS) -> DataFrame:
    """``(gram, df, cf, idf)`` of the most frequent grams that occur in ``min_df`` URLs or more, of ``docs`` URLs."""
    kept = largest(counted.where(F.col("df") >= min_df), "cf", "gram", max_terms)
    return kept.selectExpr("gram", "df", "cf", f"ln((1 + {docs}) / (1 + df)) + 1 AS idf")


def vocabulary(df: DataFrame, url: str = "url", min_df: int = MIN_DF, max_terms: int = MAX_TERMS) -> DataFrame:
    """The grams of a table of URLs by which models read them."""
    return most_frequent(counts(df, url), df.count(), min_df, max_terms)


def _spread(df: DataFrame, key: str, url: str) -> DataFrame:
    """The rows by key, in as many tasks as their number asks for: by the bytes of URLs, which is what adaptive
    execution goes by, a task would hold the grams of a million."""
    return df.select(key, url).repartition(max(1, -(-df.count() // URLS_PER_TASK)), key)


def tfidf(df: DataFrame, vocab: DataFrame, key: str = "url_id", url: str = "url") -> DataFrame:
    """``(key, gram, weight)``: sublinear counts times idf, scaled to unit length per URL.

    The short URL rows are spread by key once; counting, vocabulary lookup and scaling then need no
    further exchange of the roughly 250 grams per URL. The vocabulary is broadcast: at most
    ``MAX_TERMS`` rows by construction.
    """
    spread = _spread(df, key, url)
    counted = spread.selectExpr(f"`{key}`", f"explode({grams(url)}) AS gram").groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    weighted = counted.join(F.broadcast(vocab.select("gram", "idf")), "gram").selectExpr(f"`{key}`", "gram", "(1 + ln(tf)) * idf AS _w")
    return weighted.selectExpr(f"`{key}`", "gram", f"_w / sqrt(sum(_w * _w) OVER (PARTITION BY `{key}`)) AS weight")


def score(df: DataFrame, weights: DataFrame, intercept: float, key: str = "url_id", url: str = "url") -> DataFrame:
    """``(key, p)``: logistic scores over unit-length TF-IDF grams, as a join and a sum per URL (M5).

    ``weights``: ``(gram, idf, coef)``, a table of any length; neither it nor a vector is held anywhere. The grams
    with the least idf, which nearly every URL has, are joined by broadcast. A URL without known grams has the
    score of the intercept. ``key`` must identify a row.
    """
    spread = _spread(df, key, url)
    counted = spread.selectExpr(f"`{key}`", f"explode({grams(url)}) AS gram").groupBy(key, "gram").agg(F.count(F.lit(1)).alias("_tf"))
    heavy = weights.selectExpr("gram", "idf", "coef", "-idf AS _heavy")
    met = spread_join(counted, heavy, "gram", "_heavy", ["idf", "coef"], how="inner")
    parts = met.selectExpr(f"`{key}`", "(1 + ln(_tf)) * idf AS _w", "coef").selectExpr(f"`{key}`", "_w * coef AS _dot", "_w * _w AS _square")
    every = parts.unionByName(df.selectExpr(f"`{key}`", "0D AS _dot", "0D AS _square"))
    sums = every.groupBy(key).agg(F.sum("_dot").alias("_dot"), F.sum("_square").alias("_square"))
    return sums.selectExpr(f"`{key}`", f"1 / (1 + exp(-(coalesce(try_divide(_dot, sqrt(_square)), 0D) + {float(intercept)!r}D))) AS p")
