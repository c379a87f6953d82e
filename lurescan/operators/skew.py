"""Work once per distinct key, joined back without hot partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import add

HOT_KEYS = 1_000


def spread_join(big: DataFrame, small: DataFrame, key: str, weight: str, values: list[str], hot_keys: int = HOT_KEYS, how: str = "left") -> DataFrame:
    """Equi-join (left or inner) of a skewed table with one row per key in ``small``.

    The ``hot_keys`` heaviest keys (a fixed bound, whatever the data) are joined by broadcast. For the shuffled
    join of the remainder their rows, and those with a null key, are spread by a salt that matches nothing, so a
    key that holds a third of the table reaches all partitions. The salt is a hash of the row: a task that runs
    again sends its rows to the same places.
    """
    hot = small.orderBy(F.desc(weight), F.col(key)).limit(hot_keys)
    hot = hot.select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    rest = small.select(F.col(key).alias("_join_key"), F.lit(0).alias("_join_salt"), F.struct(*values).alias("_rest"))
    out = big.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    row = ", ".join(f"`{f.name}`" for f in big.schema if not _holds_map(f.dataType))
    out = add(
        out,
        {
            "_spread": f"_hot IS NOT NULL OR `{key}` IS NULL",
            "_big_key": f"IF(_hot IS NOT NULL OR `{key}` IS NULL, '', CAST(`{key}` AS STRING))",
            "_big_salt": f"IF(_hot IS NOT NULL OR `{key}` IS NULL, 1 + CAST(pmod(xxhash64({row}), 1000000) AS INT), 0)",
        },
    )
    rest = add(rest, {"_join_key": "CAST(_join_key AS STRING)"})
    out = out.join(rest, (F.col("_big_key") == F.col("_join_key")) & (F.col("_big_salt") == F.col("_join_salt")), "left")
    if how == "inner":
        out = out.where("_hot IS NOT NULL OR _rest IS NOT NULL")
    picked = {v: f"IF(_hot IS NOT NULL, _hot.`{v}`, _rest.`{v}`)" for v in values}
    return out.selectExpr(*[f"`{c}`" for c in big.columns], *[f"{sql} AS `{v}`" for v, sql in picked.items()])


def _holds_map(t) -> bool:
    return "map<" in t.simpleString() or "variant" in t.simpleString()


def weighed_join(big: DataFrame, small: DataFrame, key: str, values: list[str], how: str = "left", hot_keys: int = HOT_KEYS) -> DataFrame:
    """``spread_join`` where the weight of a key is how many rows of ``big`` have it; ``big`` should be stored."""
    weight = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_weight"))
    return spread_join(big, weight.join(small, key), key, "_weight", values, hot_keys, how)


def per_distinct(df: DataFrame, key: str, columns: dict[str, str], hot_keys: int = HOT_KEYS) -> DataFrame:
    """Adds columns that depend on ``key`` alone, computing each once per distinct value.

    The grouping combines on the map side first, so a hot key costs one row per task.
    """
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_weight"))
    return spread_join(df, add(keys, columns), key, "_weight", list(columns), hot_keys)
