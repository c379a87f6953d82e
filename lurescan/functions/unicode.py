"""Unicode work on host names and labels.

Spark SQL has neither normalisation nor IDNA. The Arrow functions here are deterministic, so filters pass them
on the way to the scan; callers give null for plain ASCII text, so that a batch without other text comes back
as it is. The ``_jvm`` expressions call ICU and the JDK through ``java_method``: no Python workers, but they
count as nondeterministic and hold filters back.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _per_value(change: Callable[[str], str | None]):
    # nested, so that workers get the code itself
    def run(values: pa.Array) -> pa.Array:
        if values.null_count == len(values):
            return values
        return pa.array([None if v is None else change(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, T.StringType())


def nfkc():
    """Compatibility-composed text."""
    return _per_value(lambda v: unicodedata.normalize("NFKC", v))


def nfkc_jvm(c: str) -> str:
    return f"IF({c} IS NULL, CAST(NULL AS STRING), java_method('com.ibm.icu.text.Normalizer', 'compose', {c}, true))"


def shown_host_jvm(c: str) -> str:
    """As ``shown_host``, as SQL."""
    label = "IF(startswith(l, 'xn--'), java_method('java.net.IDN', 'toUnicode', l, 1), l)"
    return nfkc_jvm(f"array_join(transform(split({c}, '[.]'), l -> {label}), '.')")


def shown_host():
    """Host with punycode labels decoded, those that cannot be read left as they are, then composed."""

    def label(v: str) -> str:
        if not v.startswith("xn--"):
            return v
        try:
            return v.encode("ascii").decode("idna")
        except UnicodeError:
            return v

    return _per_value(lambda v: unicodedata.normalize("NFKC", ".".join(map(label, v.split(".")))))


def without_marks():
    """Compatibility-decomposed text without combining marks."""
    return _per_value(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


def idna_label():
    """ASCII form of a label, null where there is none (too long, or characters that are not allowed)."""

    def encode(v: str) -> str | None:
        try:
            return v.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return _per_value(encode)
