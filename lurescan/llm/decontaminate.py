"""Benchmark decontamination with SQL functions only (operator 8).

Words are lower-cased (A-Z) runs outside ASCII punctuation and blanks. A benchmark text's windows are its runs
of ``window`` words, or all its words if it has fewer. Their hashes form a set that is broadcast up to
``broadcast_rows`` windows (counted first) and joined by shuffle beyond that. Every run of that many words of
every document is hashed and looked up; hits are verified word by word, and the words inside verified windows
count once each. A document is contaminated if it has hits and they cover at least one word in ``one_in``.

Only hashes are exploded, never texts; hits of a document are gathered in an array no longer than the document.

Null and wordless texts have no words and no hits; a benchmark text without words has no window; a missing
item id is written ``null``. Rows that repeat an id and text repeat the result; null ids are kept. An empty
benchmark hits nothing. Extra columns are ignored by ``hits`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000


def words(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _runs(size: int, of: str = "words") -> Column:
    """Names of all runs of ``size`` words, by place from 0."""
    places = F.when(F.size(of) >= size, F.sequence(F.lit(1), F.size(of) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(of, i, size)))


def windows(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", window: int = 13) -> DataFrame:
    """``size, gram, name, items``: distinct windows and the items, ascending as strings, that hold them."""
    read = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("item"), words(text).alias("words"))
    read = read.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(window)))
    each = read.select("item", "size", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    each = each.select("item", "size", F.slice("words", F.col("at"), F.col("size")).alias("run"))
    return each.groupBy("size", F.array_join("run", " ").alias("gram"), F.xxhash64("run").alias("name")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = 13, one_in: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: id, mark (xxhash64 of the text), n_words, n_hit, n_items, items, spans, contaminated.

    ``items`` are ids as strings, ascending; ``spans`` are [start, end) word ranges of verified windows.
    """
    grams = windows(benchmark, item_column, item_text, window)
    sizes = [(r["size"], r["n"]) for r in grams.groupBy("size").agg(F.count("*").alias("n")).collect()]  # at most ``window`` rows
    small = sum(n for _, n in sizes) <= broadcast_rows
    source = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    read = source.select("id", "mark", words("text").alias("words"))
    base = read.select("id", "mark", F.size("words").cast("bigint").alias("n_words"))

    found = None
    for size, _ in sizes or [(window, 0)]:
        looked = grams.where(F.col("size") == size).select("name", "size", "gram", "items")
        runs = read.select("id", "mark", F.posexplode(_runs(size)).alias("at", "name"))
        hit = runs.join(F.broadcast(looked) if small else looked, "name").select("id", "mark", "at", "size", "gram", "items")
        found = hit if found is None else found.unionByName(hit)
    per_doc = found.groupBy("id", "mark").agg(F.collect_set(F.struct("at", "size", "gram", "items")).alias("found"))
    per_doc = per_doc.select(F.col("id").alias("hit_id"), F.col("mark").alias("hit_mark"), "found")
    held = source.join(per_doc, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark"))).withColumn("words", words("text"))
    true = F.filter("found", lambda h: F.array_join(F.slice("words", h["at"] + 1, h["size"]), " ") == h["gram"])
    held = held.select("hit_id", "hit_mark", F.array_sort(true).alias("found"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def cover(acc: Column, h: Column) -> Column:
        end = h["at"] + h["size"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["upto"], h["at"]))).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    held = held.select(
        "hit_id",
        "hit_mark",
        F.aggregate("found", start, cover)["n"].cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda h: h["items"])))).alias("items"),
        F.transform("found", lambda h: F.struct(h["at"].alias("start"), (h["at"] + h["size"]).alias("end"))).alias("spans"),
    ).dropDuplicates(["hit_id", "hit_mark"])
    out = base.join(held, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_column),
        "mark",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    bad = hits(docs, benchmark, id_column, text, **settings).where("contaminated").select(F.col(id_column).alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct()
    marked = docs.withColumn("_row_mark", F.xxhash64(text))
    return marked.join(bad, F.col(id_column).eqNullSafe(F.col("_bad_id")) & (F.col("_row_mark") == F.col("_bad_mark")), "left_anti").drop("_row_mark")
