"""Skeletons: the ways a label can read once look-alike characters are normalised (L1)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..dims import CONFUSABLE_PAIRS, SEQUENCES
from .text import add, add_once, is_ascii, quote
from .unicode import without_marks

_FROM = quote("".join(p[0] for p in CONFUSABLE_PAIRS))
_TO = quote("".join(p[1] for p in CONFUSABLE_PAIRS))


def with_base_forms(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Adds, for each name, the base form of a label column: lower case, no marks, confusables replaced."""
    bare = {name: f"_bare{i}" for i, name in enumerate(labels)}
    df = add(df, {bare[n]: f"IF({is_ascii(c)}, CAST(NULL AS STRING), lower({c}))" for n, c in labels.items()})
    strip = without_marks()
    df = df.withColumns({b: strip(b) for b in bare.values()})
    forms = {n: f"translate(coalesce({bare[n]}, lower({c})), {_FROM}, {_TO})" for n, c in labels.items()}
    return add_once(df, forms, drop=tuple(bare.values()))


def skeletons(base: str) -> str:
    """Distinct readings of a label in base form: itself, the same with every l as i, and both with
    letter sequences merged in turn. Only labels holding such a sequence pay for the expansion."""
    start = f"array_distinct(array({base}, replace({base}, 'l', 'i')))"
    steps = ", ".join(f"named_struct('seq', {quote(p)}, 'one', {quote(c)})" for p, c in SEQUENCES)
    grown = f"""aggregate(array({steps}), {start},
        (forms, m) -> array_union(forms, transform(forms, f -> replace(f, m.seq, m.one))))"""
    return f"IF({base} RLIKE {quote('|'.join(p for p, _ in SEQUENCES))}, {grown}, {start})"
