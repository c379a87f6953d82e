"""Public-suffix rules as a small dimension table.

Spark's own class path carries a snapshot of the Public Suffix List inside its HTTP client jar;
only the ICANN section is used, so that shared platforms count as registered domains.
"""

from __future__ import annotations

import os
import zipfile
from functools import lru_cache

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN, WILDCARD, EXCEPTION = 1, 2, 4
_ENTRY = "mozilla/public-suffix-list.txt"
_BEGIN, _END = "===BEGIN ICANN DOMAINS===", "===END ICANN DOMAINS==="


def _bundled_text() -> str:
    jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars")
    for name in sorted(os.listdir(jars)):
        if name.startswith("httpclient-") and name.endswith(".jar"):
            with zipfile.ZipFile(os.path.join(jars, name)) as z:
                return z.read(_ENTRY).decode("utf-8")
    raise FileNotFoundError(f"no public suffix list under {jars}; pass rules to suffix_rules()")


def _ascii(rule: str) -> str:
    return rule.encode("idna").decode("ascii") if not rule.isascii() else rule


@lru_cache(maxsize=4)
def rule_flags(text: str | None = None) -> tuple[tuple[str, int], ...]:
    """(key, flags) per suffix: the key itself is a suffix, has a wildcard below, or is excepted.

    Non-ASCII rules are listed under both spellings, because hosts come in both.
    """
    text = _bundled_text() if text is None else text
    if _BEGIN in text:
        text = text.split(_BEGIN, 1)[1].split(_END, 1)[0]
    flags: dict[str, int] = {}
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("//"):
            continue
        if line.startswith("*."):
            key, flag = line[2:], WILDCARD
        elif line.startswith("!"):
            key, flag = line[1:], EXCEPTION
        else:
            key, flag = line, PLAIN
        for spelling in {key, _ascii(key)}:
            flags[spelling] = flags.get(spelling, 0) | flag
    return tuple(sorted(flags.items()))


def suffix_rules(spark: SparkSession, text: str | None = None) -> DataFrame:
    """Rule dimension ``(rule string, flags int)``: about 8,000 rows, fixed in size."""
    import pyarrow as pa

    rows = rule_flags(text)
    table = pa.table(
        {"rule": [k for k, _ in rows], "flags": pa.array([f for _, f in rows], pa.int32())}
    )
    return spark.createDataFrame(table, schema="rule string, flags int")


def rule_depth(rules: DataFrame | None = None) -> int:
    """Labels of the longest rule; of the bundled rules without a job."""
    if rules is None:
        return max(key.count(".") + 1 for key, _ in rule_flags())
    return rules.agg(F.max(F.size(F.split("rule", "[.]")))).first()[0] or 1
