"""Global ranks, running sums and the k largest rows, without a task that sees a whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import add
from ..plans.storage import stable

#: rows that a window orders in one task, about
ROWS_PER_RANGE = 200_000
#: groups of a histogram that the driver reads at once
_CELLS = 4_096


def ranged(df: DataFrame, order: list[Column], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows with ``_range``: ranges ascend with ``order``, and their number follows the table's length.

    Written once, because the cut points are sampled: whoever reads the table again sees the same ranges.
    """
    ranges = max(1, math.ceil(df.count() / rows_per_range))
    return stable(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: str, sums: dict[str, str], by: tuple[str, ...] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds running sums ``{name: SQL}`` up to and including each row, per group ``by`` in ``order`` (SQL).

    A row's sum is that inside its range plus the totals of the ranges before, of which there is one row per range
    and group. Rows that tie in ``order`` are summed in an open order: make it name a row.
    """
    group = ", ".join(f"`{c}`" for c in by)
    keys = f"{group}, {order}" if by else order
    cut = ranged(df, [_sort_column(k) for k in keys.split(", ")], rows_per_range)
    totals = cut.groupBy(*by, "_range").agg(*[F.sum(F.expr(sql)).alias(f"_t_{n}") for n, sql in sums.items()])
    before = f"OVER ({f'PARTITION BY {group} ' if by else ''}ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = totals.selectExpr(*by, "_range", *[f"coalesce(sum(_t_{n}) {before}, 0) AS _o_{n}" for n in sums])
    inside = f"OVER (PARTITION BY {group + ', ' if by else ''}_range ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fine = add(cut, {f"_i_{n}": f"sum({sql}) {inside}" for n, sql in sums.items()})
    joined = fine.join(offsets, [*by, "_range"])
    return joined.selectExpr(*[f"`{c}`" for c in df.columns], *[f"_i_{n} + _o_{n} AS `{n}`" for n in sums])


def _sort_column(key: str) -> Column:
    name, _, direction = key.strip().partition(" ")
    return F.desc(name.strip("`")) if direction.upper() == "DESC" else F.asc(name.strip("`"))


def kth_largest(df: DataFrame, column: str, k: int) -> tuple[int, int] | None:
    """(the k-th largest value of a column of non-negative integers, how many rows exceed it); None if there are fewer rows.

    Histograms of at most 4,096 cells, each over the cell of the one before that holds the k-th row.
    """
    low, width, above = 0, 1, 0
    top = df.agg(F.max(column)).first()[0]
    if top is None:
        return None
    while low + width <= top:
        width *= _CELLS
    while True:
        step = max(1, width // _CELLS)
        inside = df.where((F.col(column) >= low) & (F.col(column) < low + width))
        cells = inside.groupBy(F.expr(f"(`{column}` - {low}L) DIV {step}L").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(cells.collect(), key=lambda r: -r["cell"]):
            if above + r["n"] >= k:
                low, width = low + r["cell"] * step, step
                break
            above += r["n"]
        else:
            return None
        if width == 1:
            return low, above


def largest(df: DataFrame, column: str, tie: str, k: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The k rows with the largest ``column`` (non-negative integers), ties by ascending ``tie``; ``df`` should be stored.

    What exceeds the k-th value passes; only rows that equal it are ranked, within ranges.
    """
    found = kth_largest(df, column, k)
    if found is None:
        return df
    value, above = found
    same = df.where(F.col(column) == value)
    if above + same.count() > k:
        place = running(same, f"`{tie}`", {"_place": "1"}, rows_per_range=rows_per_range)
        same = place.where(F.col("_place") <= k - above).drop("_place")
    return df.where(F.col(column) > value).unionByName(same)
