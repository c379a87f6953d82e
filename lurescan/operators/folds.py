"""Splits for training and evaluation. All are functions of hashes, so they
need no global order, repeat exactly on a retry and can be recomputed anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import add, quote
from .ranked import running


def _hash(text: str, seed: int) -> str:
    """First 32 bits of an md5, as a number."""
    return f"CAST(conv(substr(md5(concat({quote(f'{seed}|')}, {text})), 1, 8), 16, 10) AS BIGINT)"


def by_site(df: DataFrame, k: int = 5, seed: int = 42, site: str = "site") -> DataFrame:
    """Adds ``fold``: all rows of a site share one fold (M7)."""
    return add(df, {"fold": f"CAST(pmod({_hash(f'`{site}`', seed)}, {k}) AS INT)"})


def hash_rank(df: DataFrame, name: str, key: str, seed, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a random but repeatable rank 0..n-1 per group: the place in the order of a hash of ``key``, which must identify a row."""
    hashed = add(df, {"_h": f"md5(concat({quote(f'{seed}|')}, CAST(`{key}` AS STRING)))"})
    ranked = running(hashed, f"_h, `{key}`", {name: "1"}, by)
    return add(ranked, {name: f"`{name}` - 1"}).select(*df.columns, name)


def stratified(df: DataFrame, k: int = 5, seed: int = 42, label: str = "y", key: str = "url") -> DataFrame:
    """Adds ``fold``: random folds whose sizes differ by at most one row per class (M8)."""
    ranked = hash_rank(df, "_rank", key, seed, (label,))
    return add(ranked, {"fold": f"CAST(_rank % {k} AS INT)"}).drop("_rank")


def holdout_by_site(df: DataFrame, share: float = 0.2, seed: int = 42, site: str = "site") -> DataFrame:
    """Adds ``is_test``: about ``share`` of the sites."""
    return add(df, {"is_test": f"{_hash(f'`{site}`', seed)} < {int(share * 2**32)}"})
