"""String expressions as Spark SQL text: counts, digits, entropy, words.

Every helper takes SQL text of an input expression and returns SQL text, so that a whole projection
is parsed by Spark in one go (``df.selectExpr``). All of it runs in the JVM.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame

# What Python's str.strip() removes, so that trimmed URLs agree with it.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
C0_AND_SPACE = "".join(map(chr, range(0x21)))
NO_STRINGS = "CAST(array() AS array<string>)"


def quote(text: str) -> str:
    """A Spark SQL string literal; control characters are written as escapes."""
    out = []
    for c in text:
        if c in "\\'":
            out.append("\\" + c)
        elif ord(c) < 32 or 127 <= ord(c) < 0xA1:
            out.append(f"\\u{ord(c):04x}")
        else:
            out.append(c)
    return "'" + "".join(out) + "'"


def char_class(keep) -> str:
    """Regex character class of every code point for which ``keep(char)`` is true."""
    points = [c for c in range(sys.maxunicode + 1) if keep(chr(c))]
    runs, start = [], None
    for prev, cur in zip([None, *points], [*points, None], strict=True):
        if prev is None or cur is None or cur != prev + 1:
            if start is not None:
                runs.append(rf"\x{{{start:x}}}-\x{{{prev:x}}}")
            start = cur
    return "[" + "".join(runs) + "]"


# Decimal digits of any script, superscripts and enclosed digits.
DIGIT = char_class(str.isdigit)


def trim_space(c: str) -> str:
    return f"btrim({c}, {quote(WHITESPACE)})"


def count_char(c: str, ch: str) -> str:
    return f"(length({c}) - length(replace({c}, {quote(ch)}, '')))"


def is_ascii(c: str) -> str:
    # one byte per character exactly when the text is ASCII: no regex needed; a missing text counts as such
    return f"coalesce(octet_length({c}) = length({c}), true)"


def count_digits(c: str) -> str:
    few = f"length({c}) - length(translate({c}, '0123456789', ''))"
    return f"IF({is_ascii(c)}, {few}, regexp_count({c}, {quote(DIGIT)}))"


def chars(c: str) -> str:
    """Code points of a string, in order."""
    return f"regexp_extract_all({c}, '(?s).', 0)"


def entropy(c: str) -> str:
    """Shannon entropy in bits of the characters of a string; 0 for the empty one.

    H = log2(n) - sum(k * log2(k)) / n over the count k of each distinct character; a count is a
    difference of two lengths, so the work per character is one native replace.
    """
    k = f"CAST(length({c}) - length(replace({c}, ch, '')) AS DOUBLE)"
    total = f"aggregate(array_distinct({chars(c)}), 0D, (acc, ch) -> acc + {k} * log2({k}))"
    return f"IF(length({c}) > 0, log2(CAST(length({c}) AS DOUBLE)) - {total} / length({c}), 0D)"


def words(c: str) -> str:
    """Runs of a-z in the lower-cased text."""
    return f"regexp_extract_all(lower({c}), '[a-z]+', 0)"


def longest_token(c: str, separators: str) -> str:
    """Length of the longest piece between separator characters; 0 when there is none."""
    return f"coalesce(array_max(transform(split({c}, {quote(separators)}), t -> length(t))), 0)"


def in_list(c: str, values) -> str:
    values = list(values)
    return f"({c} IN ({', '.join(map(quote, values))}))" if values else "false"


def str_array(values) -> str:
    """A constant array<string>; Catalyst folds the split into one literal."""
    values = list(values)
    return f"split({quote(chr(10).join(values))}, '\\n')" if values else NO_STRINGS


def table_literal(rows: list[dict], schema: str) -> str:
    """A small constant table as one array<struct> literal; Catalyst folds the parse away."""
    return f"from_json({quote(json.dumps(rows, ensure_ascii=False))}, 'array<struct<{schema}>>')"


def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds or replaces columns given as SQL text, in one projection."""
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return df.selectExpr(*kept, *[f"{sql} AS `{name}`" for name, sql in columns.items()])


def add_once(df: DataFrame, columns: dict[str, str], drop=()) -> DataFrame:
    """Like ``add``, with the new columns coming out of a one-row generator.

    The optimizer copies the definition of a column into every filter on it and pushes that towards
    the scan, which repeats costly expressions many times over when definitions build on each other.
    It does not push through a generator, so these columns are computed once per row and filters on
    the other columns still reach the scan.
    """
    kept = [f"`{c}`" for c in df.columns if c not in columns and c not in drop]
    fields = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    return df.selectExpr(*kept, f"inline(array(named_struct({fields})))")
