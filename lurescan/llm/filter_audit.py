"""What each filter of a chain removes in every order of the chain (operator 13).

A row fails each of five filters or not: that is a mask of five bits, and all that an order of the filters
depends on. So rows are first counted by cell (part, mask, whether labelled good, whether labelled toxic), of
which a part has at most 128. Each cell then folds over the array of all 120 orders: ``transform`` over the
orders, ``aggregate`` along an order's steps, one struct of weighted counts per step, 600 in all. The arrays of
a part's cells are added element by element.

Failures: A, under ``least_words`` words; B, fewer than half of the words distinct; C, more than 3 of 100 code
points in A-Z; D, any of ``#$%&*|``; E, a row with a smaller id has the identical text, whatever its part and
whether or not a filter removes it. Words are maximal runs of anything but blanks and 0x09-0x0D.

E needs no window over copies: texts are named by SHA-256, identical rows are counted before the shuffle, and a
text reaches its reducer once per task and cell, so a text that holds a third of the rows is no hot group.

Null texts are empty, a null part is the empty string. A row without an id is never E and makes no other row E;
rows that share an id are not E because of each other. Several labels of an id count as good (toxic) if one of
them says so. Ties therefore do not arise. An empty table has no parts and gives no rows; extra columns of any
name are left out.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_WORD_GAP = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(failed: Column, filter_: str) -> Column:
    return F.when(failed, F.lit(1 << FILTERS.index(filter_))).otherwise(F.lit(0))


def row_masks(docs: DataFrame, id_column: str, text: str, part: str, least_words: int) -> DataFrame:
    """``id, part, key, mask``: the text's name and the failures that a row shows by itself."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), whole.alias("whole"))
    out = out.withColumn("words", F.filter(F.split("whole", _WORD_GAP), lambda w: w != ""))
    n_words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("whole") - F.length(F.translate("whole", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    mask = _bit(n_words < least_words, "A").bitwiseOR(_bit(distinct * 100 < n_words * 50, "B"))
    mask = mask.bitwiseOR(_bit(capitals.cast("bigint") * 100 > F.length("whole").cast("bigint") * 3, "C"))
    mask = mask.bitwiseOR(_bit(F.col("whole").rlike(r"[#$%&*|]"), "D"))
    return out.select("id", "part", F.unhex(F.sha2("whole", 256)).alias("key"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang", least_words: int = 200) -> DataFrame:
    """``part, mask, good, toxic, n``: all rows, counted."""
    rows = row_masks(docs, id_column, text, part, least_words).groupBy("id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.select(F.col(f"`{id_column}`").alias("said_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.where("said_id IS NOT NULL AND (good OR toxic)").groupBy("said_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("good", "toxic")])
    rows = rows.join(said, F.col("id") == F.col("said_id"), "left").drop("said_id").fillna(False, ["good", "toxic"])
    # an id has one row per text and cell here, so min_by finds how many rows have a cell's smallest id
    by_text = rows.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("n_least"),
    )
    by_text = by_text.withColumn("first", F.min("least").over(Window.partitionBy("key")))
    passes = F.col("free") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), passes.alias("n")), F.struct(F.col("mask").bitwiseOR(1 << FILTERS.index("E")).alias("mask"), (F.col("n") - passes).alias("n")))
    return by_text.select("part", "good", "toxic", F.inline(split)).where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


#: one cell along all orders: at a step, ``alive`` tells whether no earlier filter removed the cell's rows
_FOLD = """flatten(transform(orders, o -> aggregate(sequence(1, {size}),
  named_struct('alive', true, 'steps', CAST(array() AS array<struct<kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint>>)),
  (acc, i) -> named_struct(
    'alive', acc.alive AND (mask & get(o, i - 1)) = 0,
    'steps', array_append(acc.steps, named_struct(
      'kept', IF(acc.alive AND (mask & get(o, i - 1)) = 0, n, 0L),
      'removed', IF(acc.alive AND (mask & get(o, i - 1)) > 0, n, 0L),
      'redundant', IF(NOT acc.alive AND (mask & get(o, i - 1)) > 0, n, 0L),
      'unique_fails', IF(mask = get(o, i - 1), n, 0L),
      'good_lost', IF(good AND acc.alive AND (mask & get(o, i - 1)) > 0, n, 0L),
      'toxic_lost', IF(toxic AND acc.alive AND (mask & get(o, i - 1)) > 0, n, 0L)))),
  acc -> acc.steps)))"""


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang", least_words: int = 200) -> DataFrame:
    """``part, filter_order, step`` and the counts after that step, 600 rows per part.

    ``kept, removed, redundant`` (fails but went earlier), ``unique_fails`` (fails this filter alone),
    ``good_lost, toxic_lost`` (labelled and removed here) and ``shapley``, the filter's ``removed`` over all orders.
    """
    every = ["".join(o) for o in permutations(FILTERS)]
    names = F.array(*map(F.lit, every))
    bits = F.array(*[F.array(*[F.lit(1 << FILTERS.index(f)) for f in o]) for o in every])
    counted = cells(docs, labels, id_column, text, part, least_words).withColumn("orders", bits)
    folded = counted.select("part", F.expr(_FOLD.format(size=len(FILTERS))).alias("steps"))
    added = ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS)
    merge = f"aggregate(slice(vectors, 2, size(vectors)), vectors[0], (acc, v) -> zip_with(acc, v, (x, y) -> named_struct({added})))"
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("vectors")).select("part", F.expr(merge).alias("steps"))
    merged = merged.withColumn("letters", F.split(F.lit(",".join(FILTERS)), ",")).withColumn("all_letters", F.split(F.lit(",".join("".join(every))), ","))
    total = "map_from_arrays(letters, transform(letters, f -> aggregate(zip_with(all_letters, steps, (l, s) -> IF(l = f, s.removed, 0L)), 0L, (a, b) -> a + b)))"
    merged = merged.withColumn("totals", F.expr(total))
    out = merged.select("part", "totals", F.posexplode("steps").alias("at", "s"))
    out = out.withColumn("filter_order", F.get(names, (F.col("at") / len(FILTERS)).cast("int"))).withColumn("step", F.col("at") % len(FILTERS) + 1)
    shapley = F.col("totals")[F.substring(F.col("filter_order"), F.col("step"), F.lit(1))]
    return out.select("part", "filter_order", "step", *[F.col(f"s.{c}").alias(c) for c in COUNTS], shapley.alias("shapley"))
