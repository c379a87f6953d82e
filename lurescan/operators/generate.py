"""Lookalike generator: a watch list for any table of names and home domains.

Input: ``(name string, home string)``; output: ``(name, home, technique, url)``. Positions and
substitutions are exploded in parallel, one row per candidate; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import add, in_list, is_ascii, quote, str_array
from ..functions.unicode import idna_label
from .parts import split_host
from ..functions import urls as U

_AT = "sequence(0, length(label) - 1)"
_BETWEEN = "IF(length(label) > 1, sequence(0, length(label) - 2), CAST(array() AS array<int>))"


def _labels() -> dict[str, str]:
    """Technique -> SQL array of mutated labels."""
    head, rest = "substr(label, 1, i)", "substr(label, i + 2)"
    ch = "substr(label, i + 1, 1)"
    vowels = str_array("aeiou")
    glyphs = [{"c": c, "g": g} for c, row in dims.GLYPHS.items() for g in row.split()]
    table = ", ".join(f"named_struct('c', {quote(x['c'])}, 'g', {quote(x['g'])})" for x in glyphs)
    words = str_array(dims.COMBO_WORDS)
    return {
        "omission": f"transform({_AT}, i -> concat({head}, {rest}))",
        "repetition": f"transform({_AT}, i -> concat({head}, {ch}, substr(label, i + 1)))",
        "transposition": f"transform({_BETWEEN}, i -> concat({head}, substr(label, i + 2, 1), {ch}, substr(label, i + 3)))",
        "hyphenation": f"transform({_BETWEEN}, i -> concat({head}, {ch}, '-', {rest}))",
        "replacement": f"flatten(transform({_AT}, i -> transform(filter({vowels}, v -> v <> {ch}), v -> concat({head}, v, {rest}))))",
        "homoglyph": f"flatten(transform({_AT}, i -> transform(filter(array({table}), x -> x.c = {ch}), x -> concat({head}, x.g, {rest}))))",
        "combosquat": f"flatten(transform({words}, w -> array(concat(label, '-', w), concat(w, '-', label), concat(label, w))))",
    }


def _homes(homes: DataFrame) -> DataFrame:
    return add(homes.select("name", "home"), {"label": "substring_index(home, '.', 1)", "ending": "substr(home, length(substring_index(home, '.', 1)) + 2)"})


def _mutated(df: DataFrame) -> DataFrame:
    """``made`` is the changed label, ``ascii`` its form in a URL, null where IDNA has none."""
    mutated = df.selectExpr(
        "name", "home", "label", "ending",
        "explode(array(" + ", ".join(f"named_struct('technique', '{t}', 'made', array_distinct({sql}))" for t, sql in _labels().items()) + ")) AS m",
    ).selectExpr("name", "home", "label", "ending", "m.technique", "explode(m.made) AS made")
    mutated = mutated.where("made <> label AND length(made) >= 2")
    mutated = add(mutated, {"_odd": f"IF({is_ascii('made')}, CAST(NULL AS STRING), made)"}).withColumn("_coded", idna_label()("_odd"))
    return add(mutated, {"ascii": "IF(_odd IS NULL, made, _coded)"}).drop("_odd", "_coded")


def rejected(homes: DataFrame) -> DataFrame:
    """``(name, home, technique, made)``: changed labels that no URL can hold; ``lookalikes`` leaves them out."""
    return _mutated(_homes(homes)).where("ascii IS NULL").select("name", "home", "technique", "made")


def lookalikes(homes: DataFrame, official=None, rules: DataFrame | None = None) -> DataFrame:
    """Generated lookalike URLs of every ``(name, home)`` row.

    Labels equal to the original, shorter than two characters or official are left out (K10), and so are
    those without an ASCII form (``rejected``).
    """
    official = dims.official_domains() if official is None else tuple(official)
    df = _homes(homes)
    mutated = add(_mutated(df).where("ascii IS NOT NULL"), {"made": "ascii"})
    mutated = add(mutated, {"host": "lower(trim(TRAILING '.' FROM concat(made, '.', ending)))"})
    mutated = add(mutated, {"is_ip": U.is_ip("host"), "unicode_host": "host"})
    mutated = split_host(mutated, rules).where(f"NOT {in_list('registered', official)}")
    made = mutated.selectExpr("name", "home", "technique", "concat('https://', made, '.', ending, '/') AS url")
    bait = ", ".join(
        f"named_struct('technique', 'subdomain', 'url', concat('https://', {what}, '.{tail}.com/signin'))"
        for what, tail in zip(("home", "label"), dims.SUBDOMAIN_BAIT, strict=True)
    )
    swaps = ", ".join(
        f"named_struct('technique', 'tld-swap', 'url', IF({in_list(f'''concat(label, '.{t}')''', official)}, NULL, concat('https://', label, '.{t}/')))"
        for t in dims.SWAP_TLDS
    )
    whole = df.selectExpr("name", "home", f"inline(array({bait}, {swaps}))").where("url IS NOT NULL")
    return made.unionByName(whole.select("name", "home", "technique", "url"))


def brand_homes(spark, brands=dims.BRANDS) -> DataFrame:
    """The brand list as generator input."""
    return spark.createDataFrame([(b.brand, b.home) for b in brands], "name string, home string")


def brand_group(brand: str = "brand", brands=dims.BRANDS) -> Column:
    """Null below five letters, else which checks apply to the brand."""
    narrow = in_list(brand, [b.brand for b in brands if b.word_only or len(b.brand) == 5])
    return F.expr(f"CASE WHEN length({brand}) < 5 THEN NULL WHEN {narrow} THEN 'word-only or 5 letters' ELSE 'distinctive' END")
