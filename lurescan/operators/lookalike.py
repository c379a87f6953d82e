"""Lookalike findings in the row, for brand lists of bounded size.

The brand list travels inside the plan as one literal array, so matching needs neither a shuffle nor
a join and cannot be skewed by a hot host. Word and skeleton techniques are hash intersections with
the brand names; only misspellings visit the brands one by one, behind a length test.
``lookalike_join`` does the same work for brand tables that are too large for a literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..dims import BRANDS, MULTI_TENANT, official_domains
from ..functions.distance import osa_within, swapped_pairs
from ..functions.skeleton import skeletons, with_base_forms
from ..functions.text import NO_STRINGS, add, add_once, in_list, str_array, table_literal, words

MAX_LITERAL_BRANDS = 5_000
FINDING_TYPE = "array<struct<brand:string,technique:string,severity:string,detail:string>>"
# one array of brand names per technique, in the order in which they are tried
_HITS = "_same _homoglyph _typo _word _affix _subword _pathword".split()


def brand_literal(brands) -> str:
    """The brand list with what the row-wise checks need, as one literal."""
    rows = [
        {
            "ord": b.ord,
            "brand": b.brand,
            "home": b.home,
            "official": [f"{d}." for d in b.official],
            "len": len(b.brand),
            "edits": 2 if len(b.brand) >= 9 else 1,
            "swaps": swapped_pairs(b.brand),
        }
        for b in brands
    ]
    schema = "ord:int,brand:string,home:string,official:array<string>,len:int,edits:int,swaps:array<string>"
    return table_literal(rows, schema)


def gate(brands=BRANDS, tenants=MULTI_TENANT) -> str:
    """Hosts worth matching (L4): a named host, not a brand's own site, not under a brand's own suffix."""
    own = f"{in_list('registered', official_domains(brands))} AND NOT {in_list('registered', tenants)}"
    return f"(NOT is_ip AND domain <> '' AND NOT ({own}) AND NOT {in_list('suffix', [b.brand for b in brands])})"


def label_columns(df: DataFrame, brands=BRANDS, tenants=MULTI_TENANT) -> DataFrame:
    """Gate, tenant flag, displayed label, words and skeletons of every row."""
    # the displayed label stands in front of the suffix in the Unicode host
    shown = "substring_index(substring_index(unicode_host, '.', -(size(split(suffix, '[.]')) + 1)), '.', 1)"
    df = add_once(df, {"_gate": gate(brands, tenants), "_tenant": in_list("registered", tenants)})
    df = add(df, {"_shown": f"CASE WHEN NOT _gate THEN '' WHEN suffix <> '' THEN {shown} ELSE domain END"})
    df = with_base_forms(df, {"_label_base": "domain", "_shown_base": "_shown"})
    path_words = f"array_distinct({words("concat_ws(' ', path, query)")})"
    return add_once(
        df,
        {
            "_label_words": words("_shown"),
            "_sub_words": f"IF(_gate, {words('subdomain')}, {NO_STRINGS})",
            "_path_words": f"IF(_gate, {path_words}, {NO_STRINGS})",
            "_shapes": f"IF(_shown = domain, {skeletons('_label_base')}, "
            f"array_union({skeletons('_shown_base')}, {skeletons('_label_base')}))",
        },
    )


def match_columns(df: DataFrame, brands=BRANDS, tenants=MULTI_TENANT) -> DataFrame:
    """Adds, per technique, the array of brand names that it matches."""
    brands = tuple(brands)
    if len(brands) > MAX_LITERAL_BRANDS:
        raise ValueError(f"{len(brands)} brands: give check() or lookalike_join.with_findings a brand table for more than {MAX_LITERAL_BRANDS}")
    names = str_array(b.brand for b in brands)
    long_names = str_array(b.brand for b in brands if len(b.brand) > 4)
    loose = [b for b in brands if not b.word_only]
    affixes = [b.brand for b in loose if len(b.brand) > 4]
    lengths = sorted({len(a) for a in affixes})
    ends = ", ".join(f"{side}(domain, {n})" for n in lengths for side in ("left", "right"))
    typo = brand_literal([b for b in loose if len(b.brand) >= 6])
    misspelt = f"filter({typo}, b -> {osa_within('domain', 'b.brand', 'b.edits', 'b.swaps')})"

    def on_label(hits: str) -> str:
        return f"IF(_gate AND NOT _tenant, {hits}, {NO_STRINGS})"

    return add_once(
        label_columns(df, brands, tenants),
        {
            "_same": on_label(f"array_intersect(array(domain), {names})"),
            "_homoglyph": on_label(f"array_except(array_intersect(_shapes, {names}), array(_shown))"),
            "_typo": on_label(f"transform({misspelt}, b -> b.brand)"),
            "_word": on_label(f"IF(size(_label_words) > 1, array_intersect(_label_words, {names}), {NO_STRINGS})"),
            "_affix": on_label(f"array_intersect(array({ends}), {str_array(affixes)})") if affixes else NO_STRINGS,
            "_subword": f"array_intersect(_sub_words, {names})",
            "_pathword": f"array_except(array_intersect(_path_words, {long_names}), _sub_words)",
        },
    )


def _finding() -> str:
    """The finding for one brand ``b`` that some technique matched."""

    def finding(technique: str, severity: str, *detail: str) -> str:
        return (
            f"named_struct('brand', b.brand, 'technique', '{technique}', 'severity', {severity}, "
            f"'detail', concat({', '.join(detail)}))"
        )

    site, quoted_brand = "'\"', registered, '\"'", "'\"', b.brand, '\"'"
    has = {h: f"array_contains({h}, b.brand)" for h in _HITS}
    kind = "IF(host <> unicode_host, ' is an internationalised (punycode) look-alike of ', ' is a look-alike of ')"
    # the first rule that holds wins among the label rules
    on_label = f"""CASE
      WHEN {has['_same']} THEN {finding('unofficial-domain', "'medium'", site, "' is the name of the brand outside its known domains, such as '", 'b.home')}
      WHEN {has['_homoglyph']} THEN {finding('homoglyph', "'high'", "'\"', unicode_host, '\"'", kind, 'b.home')}
      WHEN {has['_typo']} THEN {finding('typosquat', "'high'", site, "' is a misspelling of '", 'b.home')}
      WHEN {has['_word']} THEN {finding('combosquat', "'medium'", site, "' joins the brand '", quoted_brand, "' with other words'")}
      WHEN {has['_affix']} THEN {finding('combosquat', "'low'", site, "' begins or ends with the brand '", quoted_brand)} END"""
    inside = "exists(b.official, d -> contains(concat(subdomain, '.'), d))"
    around = f"""CASE
      WHEN {has['_subword']} AND {inside} THEN {finding('brand-in-subdomain', "'high'", "b.home, ' stands in front of another site, '", site)}
      WHEN {has['_subword']} THEN {finding('brand-in-subdomain', "'medium'", "'the subdomain names ', b.brand, ' but the site is '", site)}
      WHEN {has['_pathword']} THEN {finding('brand-in-path', "'low'", "'the path names ', b.brand, ' on an unrelated site, '", site)} END"""
    return f"array({on_label}, {around})"


def _rank(severity: str) -> str:
    return f"CASE {severity} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def find(df: DataFrame, brands=BRANDS, tenants=MULTI_TENANT, keep_matches: bool = False) -> DataFrame:
    """Adds ``lookalike array<finding>`` and ``lookalike_severity int`` to a table with parts.

    One finding per brand, strongest first, then in brand order (L15, L16).
    """
    brands = tuple(brands)
    cols = [f"`{c}`" for c in df.columns]
    df = add(match_columns(df, brands, tenants), {"_matched": f"concat({', '.join(_HITS)})"})
    hit = f"filter({brand_literal(brands)}, b -> array_contains(_matched, b.brand))"
    # per brand: the finding on the label and the one around it; the stronger stays, the label's on ties
    df = add(df, {"_pairs": f"IF(size(_matched) > 0, transform({hit}, b -> {_finding()}), CAST(array() AS array<{FINDING_TYPE}>))"})
    stronger = f"IF({_rank('p[1].severity')} > {_rank('p[0].severity')}, p[1], p[0])"
    df = add(df, {"_found": f"transform(_pairs, p -> {stronger})"})
    levels = ", ".join(f"filter(_found, f -> f.severity = '{s}')" for s in ("high", "medium", "low"))
    df = add_once(df, {"lookalike": f"IF(size(_found) < 2, _found, concat({levels}))"})
    extra = [*_HITS, "_label_words", "_sub_words", "_path_words", "_shapes", "_shown"] if keep_matches else []
    return df.selectExpr(*cols, *extra, "lookalike", f"{strongest('lookalike')} AS lookalike_severity")


def strongest(findings: str) -> str:
    """0 none, 1 low, 2 medium, 3 high; findings are sorted, so the first decides."""
    return _rank(f"try_element_at({findings}, 1).severity")


def explode_findings(df: DataFrame, *keys: str) -> DataFrame:
    """Normal form: one row per finding with its position."""
    return df.selectExpr(*keys, "posexplode(lookalike) AS (pos, f)").selectExpr(*keys, "pos", "f.*")


def findings_text(findings: str = "lookalike") -> str:
    """``brand: technique (severity); ...`` or ``none``."""
    parts = f"transform({findings}, f -> concat(f.brand, ': ', f.technique, ' (', f.severity, ')'))"
    return f"IF(size({findings}) > 0, array_join({parts}, '; '), 'none')"
