"""Lookalike findings once per distinct host, for brand tables of any size.

What depends on the host alone (its parts, the findings on its label and subdomain) is worked out once per
distinct host and stored as a *dictionary*; URLs are joined to it without hot tasks, and only path words are left
to do per URL. A tuple of brands travels as a literal and is matched in the row. A brand table becomes equi-joins
on generated keys: a Bloom filter of the brands' keys drops keys that match nothing before they are shuffled, each
key of a brand table is one row, and rows of heavy keys are joined by broadcast and spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import BRANDS, MULTI_TENANT
from ..functions.distance import osa_within, swapped_pairs_of
from ..functions.skeleton import skeletons, with_base_forms
from ..functions.text import NO_STRINGS, add, add_once, in_list, str_array, words
from ..plans.storage import dealt, stable
from .bloom import MOST_BITS, Bloom, bloom_of
from .features import with_similarity
from .lookalike import FINDING_TYPE, explode_findings, find, gate, strongest
from .parts import PART_FIELDS, split_authority, split_front, split_host
from .skew import spread_join, weighed_join

PAIRS_IN_TASK = 5_000
#: labels and brands of a task that makes their keys, of which one has up to some hundreds
KEYED_IN_TASK = 5_000
#: bits of the map of labels' keys, 8 MB
BITMAP_BITS = 1 << 26
#: a finding with its brand's place, by which findings of one severity are sorted
PLACED = "array<struct<ord:int,brand:string,technique:string,severity:string,detail:string>>"
FRONT_PARTS = ("host", "port", "unicode_host", "is_ip", "parse_error")
HOST_PARTS = ("suffix", "domain", "subdomain", "registered")
_PATH_WORDS = f"array_distinct({words("concat_ws(' ', path, query)")})"
_SITE = "'\"', registered, '\"'"
_BRAND = "'\"', b.brand, '\"'"


# --- keys ------------------------------------------------------------------------------------------


def deletion_keys(text: str, k: str) -> str:
    """All strings left after deleting at most ``k`` (0 to 2) characters, ``k`` being SQL.

    Two texts within OSA distance k share such a string: an insertion is a deletion on the other
    side, a substitution or a swap is one deletion on each side.
    """
    at = f"sequence(1, length({text}))"
    one = f"transform({at}, i -> concat(substr({text}, 1, i - 1), substr({text}, i + 1)))"
    two = (
        f"flatten(transform({at}, i -> transform(filter({at}, j -> j > i), "
        f"j -> concat(substr({text}, 1, i - 1), substr({text}, i + 1, j - i - 1), substr({text}, j + 1)))))"
    )
    return (
        f"array_distinct(concat(array({text}), IF({k} >= 1 AND length({text}) > 0, {one}, {NO_STRINGS}), "
        f"IF({k} >= 2 AND length({text}) > 1, {two}, {NO_STRINGS})))"
    )


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among ``keys``: a bitmap of hashes of fixed size, a row per 64 bits, joined by broadcast."""
    place = f"(xxhash64(key) & {BITMAP_BITS - 1}L)"
    bits = keys.selectExpr(f"{place} AS p").selectExpr("shiftright(p, 6) AS _word", "shiftleft(1L, CAST(p & 63L AS INT)) AS bit")
    bits = bits.groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    kept = add(rows, {"_word": f"shiftright({place}, 6)", "_bit": f"CAST({place} & 63L AS INT)"}).join(F.broadcast(bits), "_word")
    return kept.where("getbit(_bits, _bit) = 1").select(*rows.columns)


def _brand_keys(brands: DataFrame, longest: int, asked: DataFrame | None = None) -> DataFrame:
    """``key, owners``: one row per key of the brand table; a key begins with its rule, 7-11 being those of the label.

    Misspellings of brands more than two letters over the longest label are not made, for they match none.
    With ``asked``, most keys that are not among its are left out before they are grouped.
    """
    b = add(brands, {"len": "length(brand)", "edits": "IF(length(brand) >= 9, 2, 1)"})
    spelt = f"IF(NOT word_only AND len BETWEEN 6 AND {longest + 2}, {deletion_keys('brand', 'edits')}, {NO_STRINGS})"
    keys = f"""concat(array(concat('7:', brand), concat('8:', brand), concat('10:', brand)),
        IF(NOT word_only AND len > 4, array(concat('11:', brand)), array()),
        transform({spelt}, x -> concat('9:', x)))"""
    rows = add_once(b, {"_keys": keys}).selectExpr("ord", "brand", "home", "edits", "explode(_keys) AS key")
    rows = rows if asked is None else _among(rows, asked)
    return rows.groupBy("key").agg(F.collect_list(F.struct("ord", "brand", "home", "edits")).alias("owners"))


def _label_keys(labels: DataFrame, longest: int, bloom: Bloom | None = None) -> DataFrame:
    """``domain, shown, key``: the keys of distinct labels that the brand table may hold (without a filter, all).

    Prefixes and suffixes longer than any brand are not made.
    """
    tag = lambda rule, arr: f"transform({arr}, x -> concat('{rule}:', x))"
    shapes = f"IF(shown = domain, {skeletons('label_base')}, array_union({skeletons('shown_base')}, {skeletons('label_base')}))"
    ends = f"IF(length(domain) >= 5, sequence(5, least(length(domain), {longest})), CAST(array() AS array<int>))"
    affixes = f"array_distinct(concat(transform({ends}, n -> left(domain, n)), transform({ends}, n -> right(domain, n))))"
    # labels of 5 and 6 letters can only be one edit from a brand of 6 or more
    near = f"IF(length(domain) BETWEEN 5 AND {longest + 2}, {deletion_keys('domain', 'IF(length(domain) >= 7, 2, 1)')}, {NO_STRINGS})"
    based = with_base_forms(labels, {"label_base": "domain", "shown_base": "shown"})
    arrays = add_once(
        based,
        {"_r7": "array(domain)", "_r8": shapes, "_r9": near, "_r10": f"IF(size({words('shown')}) > 1, {words('shown')}, {NO_STRINGS})", "_r11": affixes},
    )
    every = ", ".join(tag(r, f"_r{r}") for r in (7, 8, 9, 10, 11))
    keys = f"array_distinct(concat({every}))"
    keyed = add_once(arrays, {"_keys": keys if bloom is None else f"filter({keys}, x -> {bloom.has('x')})"})
    return keyed.selectExpr("domain", "shown", "explode(_keys) AS key")


def label_findings(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """``(domain, shown, ord, brand, home, rule)``: the first rule that holds per label and brand.

    ``labels``: distinct ``(domain, shown)``; ``brands``: ``(ord, brand, official, home, word_only)``.
    """
    # labels and brands are short and their keys many: tasks go by rows
    labels, brands = dealt(labels, KEYED_IN_TASK), dealt(brands, KEYED_IN_TASK)
    # a key longer than every brand matches none
    longest = brands.agg(F.max(F.length("brand"))).first()[0] or 0
    reach = labels.agg(F.max(F.length("domain"))).first()[0] or 0
    # more keys than a Bloom filter can tell apart: brands' keys that no label has go before they are grouped and joined
    spelt = f"IF(NOT word_only AND length(brand) BETWEEN 6 AND {reach + 2}, IF(length(brand) >= 9, length(brand) * (length(brand) + 1) / 2, length(brand)), 0)"
    many = brands.agg(F.sum(F.expr(f"4 + {spelt}"))).first()[0] or 0
    owned = stable(_brand_keys(brands, reach, _label_keys(labels, longest) if many * 8 > MOST_BITS else None), "brand-keys")
    asked = stable(_label_keys(labels, longest, bloom_of(owned, "key")), "label-keys")
    met = weighed_join(asked, owned, "key", ["owners"], "inner")
    pairs = met.selectExpr("CAST(substring_index(key, ':', 1) AS INT) AS rule", "domain", "shown", "inline(owners)")
    # many keys can lead to the same pair: keep one before the distance is computed
    pairs = pairs.groupBy("rule", "domain", "shown", "ord", "brand", "home", "edits").agg(F.count(F.lit(1)).alias("keys"))
    # pairs are short and distances long: tasks go by rows
    pairs = dealt(stable(pairs, "label-pairs"), PAIRS_IN_TASK)
    pairs = add(pairs, {"swaps": f"IF(rule = 9, {swapped_pairs_of('brand')}, {NO_STRINGS})"})
    # as a plain filter the distance would be pushed below the dealing, into the few tasks of the stored pairs
    holds = f"CASE rule WHEN 8 THEN shown <> brand WHEN 9 THEN {osa_within('domain', 'brand', 'edits', 'swaps')} ELSE true END"
    return add_once(pairs, {"_holds": holds}).where("_holds").groupBy("domain", "shown", "ord", "brand", "home").agg(F.min("rule").alias("rule"))


# --- the dictionary of hosts ---------------------------------------------------------------------------


def _shown() -> str:
    label = "substring_index(substring_index(unicode_host, '.', -(size(split(suffix, '[.]')) + 1)), '.', 1)"
    return f"IF(suffix <> '', {label}, domain)"


def _literal_findings(hosts: DataFrame, brands, tenants) -> DataFrame:
    """Adds ``found`` and ``sub_words`` (null: the host fails the gate, L4); the brands travel as literals."""
    names = str_array(b.brand for b in brands)
    matched = find(add(hosts, {"path": "''", "query": "''"}), brands, tenants, keep_matches=True)
    placed = f"transform(lookalike, f -> named_struct('ord', CAST(array_position({names}, f.brand) AS INT), 'brand', f.brand, 'technique', f.technique, 'severity', f.severity, 'detail', f.detail))"
    return matched.selectExpr(*[f"`{c}`" for c in hosts.columns], f"{placed} AS found", f"IF({gate(brands, tenants)}, _sub_words, NULL) AS sub_words")


def _flag(hosts: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """Adds whether ``known`` (distinct, one column like ``column``) holds a host's value; values are as skewed as can be."""
    return weighed_join(hosts, known.withColumn(name, F.lit(True)), column, [name])


def _table_findings(hosts: DataFrame, brands: DataFrame, tenants) -> DataFrame:
    """The same by key joins with a brand table."""
    hosts = stable(hosts, "hosts")
    official = brands.select(F.explode("official").alias("registered")).distinct().where(f"NOT {in_list('registered', tenants)}")
    flagged = _flag(hosts, "registered", official, "_official")
    flagged = _flag(stable(flagged, "hosts-official"), "suffix", brands.select(F.col("brand").alias("suffix")).distinct(), "_own_suffix")
    passes = "NOT is_ip AND domain <> '' AND _official IS NULL AND _own_suffix IS NULL"
    flagged = add(flagged, {"_gate": f"coalesce({passes}, false)"})
    ready = stable(
        add_once(flagged, {"shown": f"IF(_gate, {_shown()}, NULL)", "_label": f"IF(_gate AND NOT {in_list('registered', tenants)}, concat(domain, '/', {_shown()}), NULL)", "sub_words": f"IF(_gate, array_distinct({words('subdomain')}), NULL)"}),
        "hosts-ready",
    )
    labels = ready.where("_label IS NOT NULL").groupBy("_label").agg(F.first("domain").alias("domain"), F.first("shown").alias("shown"), F.count(F.lit(1)).alias("_weight"))
    labels = stable(labels, "labels")
    on_label = label_findings(labels, brands).withColumn("_label", F.concat_ws("/", "domain", "shown"))
    on_label = on_label.groupBy("_label").agg(F.collect_list(F.struct("ord", "brand", "home", "rule")).alias("on_label"))
    on_label = stable(labels.select("_label", "_weight").join(on_label, "_label"), "label-findings")
    with_label = spread_join(ready, on_label, "_label", "_weight", ["on_label"])
    # brands that subdomains name: words first meet the filter, then the table
    named = bloom_of(brands, "brand")
    asked = stable(ready.selectExpr("host", f"explode(filter(sub_words, w -> {named.has('w')})) AS brand"), "subdomain-words")
    around = weighed_join(asked, brands.select("brand", "ord", "home", "official"), "brand", ["ord", "home", "official"], "inner")
    around = around.groupBy("host").agg(F.collect_list(F.struct("ord", "brand", "home", "official")).alias("on_sub"))
    out = with_label.join(around, "host", "left")
    kind = "IF(host <> unicode_host, ' is an internationalised (punycode) look-alike of ', ' is a look-alike of ')"

    def finding(technique: str, severity: str, *detail: str) -> str:
        return f"named_struct('ord', b.ord, 'brand', b.brand, 'technique', '{technique}', 'severity', '{severity}', 'detail', concat({', '.join(detail)}))"

    label = f"""transform(coalesce(on_label, array()), b -> CASE b.rule
        WHEN 7 THEN {finding('unofficial-domain', 'medium', _SITE, "' is the name of the brand outside its known domains, such as '", 'b.home')}
        WHEN 8 THEN {finding('homoglyph', 'high', "'\"', unicode_host, '\"'", kind, 'b.home')}
        WHEN 9 THEN {finding('typosquat', 'high', _SITE, "' is a misspelling of '", 'b.home')}
        WHEN 10 THEN {finding('combosquat', 'medium', _SITE, "' joins the brand '", _BRAND, "' with other words'")}
        ELSE {finding('combosquat', 'low', _SITE, "' begins or ends with the brand '", _BRAND)} END)"""
    inside = "exists(b.official, d -> contains(concat(subdomain, '.'), concat(d, '.')))"
    sub = f"""transform(coalesce(on_sub, array()), b -> IF({inside},
        {finding('brand-in-subdomain', 'high', 'b.home', "' stands in front of another site, '", _SITE)},
        {finding('brand-in-subdomain', 'medium', "'the subdomain names '", 'b.brand', "' but the site is '", _SITE)}))"""
    out = add_once(out, {"_on_label": label, "_on_sub": sub})
    rank = lambda f: f"CASE {f}.severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
    # per brand the stronger of the two, the label's on ties
    stays = f"filter(_on_label, f -> NOT exists(_on_sub, g -> g.brand = f.brand AND {rank('g')} > {rank('f')}))"
    added = f"filter(_on_sub, g -> NOT exists(_on_label, f -> f.brand = g.brand AND {rank('f')} >= {rank('g')}))"
    every = add_once(out, {"_every": f"array_sort(concat({stays}, {added}))"})
    levels = ", ".join(f"filter(_every, f -> f.severity = '{s}')" for s in ("high", "medium", "low"))
    return every.selectExpr(*[f"`{c}`" for c in hosts.columns], f"CAST(concat({levels}) AS {PLACED}) AS found", "sub_words")


def dictionary(urls: DataFrame, brands=BRANDS, rules: DataFrame | None = None, tenants=MULTI_TENANT, similarity: bool = False) -> DataFrame:
    """One stored row per distinct ``authority`` (host with port and user) of a URL table.

    ``urls`` (how many), the authority's parts and those of its host, ``found`` (placed findings) and ``sub_words``,
    both null where the host fails the gate; ``brand_similarity`` (F39) on request, for a tuple of brands.
    ``brands``: a tuple, or a table ``(ord, brand, official, home, word_only)`` with one row per brand.
    """
    return _dictionary(urls, _stored(brands), rules, tenants, similarity)


def _stored(brands):
    """A brand table is read a dozen times, and may be a long query itself: it is worked out once."""
    return stable(brands.select("ord", "brand", "official", "home", "word_only"), "brands") if isinstance(brands, DataFrame) else brands


def _dictionary(urls: DataFrame, brands, rules: DataFrame | None, tenants, similarity: bool) -> DataFrame:
    fronts = urls.where("authority IS NOT NULL").groupBy("authority").agg(F.count(F.lit(1)).alias("urls"))
    fronts = stable(split_authority(fronts), "authorities")
    hosts = fronts.groupBy("host").agg(F.count(F.lit(1)).alias("_weight"), F.first("unicode_host").alias("unicode_host"), F.first("is_ip").alias("is_ip"))
    hosts = split_host(hosts, rules)
    if similarity:
        hosts = with_similarity(hosts, BRANDS if isinstance(brands, DataFrame) else brands)
    found = _table_findings(hosts, brands, tenants) if isinstance(brands, DataFrame) else _literal_findings(hosts, tuple(brands), tenants)
    found = stable(add(found, {"found": "IF(sub_words IS NULL, NULL, found)"}), "hosts-found")
    columns = [*HOST_PARTS, *(["brand_similarity"] if similarity else []), "found", "sub_words"]
    return stable(spread_join(fronts, found, "host", "_weight", columns), "host-dictionary")


# --- URLs ------------------------------------------------------------------------------------------------


def _path_candidates(urls: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """URLs with ``_asked`` (their path words that may be brands, as one text), and ``_asked, _weight, _named``: the
    brands among these words, once per distinct set of words."""
    bloom = bloom_of(brands, "brand")
    some = f"filter({_PATH_WORDS}, w -> length(w) > 4 AND {bloom.has('w')})"
    urls = add_once(urls, {"_asked": f"nullif(array_join(array_sort({some}), ' '), '')"})
    sets = stable(urls.where("_asked IS NOT NULL").groupBy("_asked").agg(F.count(F.lit(1)).alias("_weight")), "path-words")
    each = stable(sets.selectExpr("_asked", "explode(split(_asked, ' ')) AS brand"), "path-word")
    met = weighed_join(each, brands.select("brand", "ord"), "brand", ["ord"], "inner")
    named = met.groupBy("_asked").agg(F.collect_list(F.struct("ord", "brand")).alias("_named"))
    return urls, stable(sets.join(named, "_asked"), "path-brands")


def with_findings(df: DataFrame, brands=BRANDS, rules: DataFrame | None = None, tenants=MULTI_TENANT, similarity: bool = False, url: str = "url", hosts: DataFrame | None = None) -> DataFrame:
    """Adds all parts, ``lookalike`` and ``lookalike_severity``, as ``with_parts`` and ``find`` do, host work done once per host.

    ``hosts``: the ``dictionary`` of these URLs, if the caller has it already.
    """
    urls, brands = split_front(df.drop(*PART_FIELDS), url), _stored(brands)
    if isinstance(brands, DataFrame):  # read for the hosts, for the path words and for the result
        urls = stable(urls, "urls")
    known = _dictionary(urls, brands, rules, tenants, similarity) if hosts is None else hosts
    extra = ["brand_similarity"] if similarity else []
    given = [c for c in df.columns if c not in (*PART_FIELDS, *extra)]
    if isinstance(brands, DataFrame):
        urls, named = _path_candidates(urls, brands)
        urls = spread_join(urls, named, "_asked", "_weight", ["_named"])
        hits = "coalesce(_named, array())"
    else:
        long_names = [b for b in brands if len(b.brand) > 4]
        names = str_array(b.brand for b in brands)
        met = f"array_intersect({_PATH_WORDS}, {str_array(b.brand for b in long_names)})"
        hits = f"transform({met}, w -> named_struct('ord', CAST(array_position({names}, w) AS INT), 'brand', w))"
    out = spread_join(urls, known, "authority", "urls", [*FRONT_PARTS, *HOST_PARTS, *extra, "found", "sub_words"])
    empty = {c: f"IF(authority IS NULL, '', {c})" for c in ("suffix", "domain", "subdomain")} | {"parse_error": "coalesce(parse_error, false)"}
    out = add(out, empty | {c: f"coalesce({c}, 0D)" for c in extra})
    # a brand in the path counts unless the host shows it in some way, which is at least as strong
    fresh = f"filter({hits}, b -> NOT array_contains(sub_words, b.brand) AND NOT exists(found, f -> f.brand = b.brand))"
    detail = f"concat('the path names ', b.brand, ' on an unrelated site, ', {_SITE})"
    rows = f"transform({fresh}, b -> named_struct('ord', b.ord, 'brand', b.brand, 'technique', 'brand-in-path', 'severity', 'low', 'detail', {detail}))"
    out = add_once(out, {"_path_found": f"IF(sub_words IS NULL, CAST(array() AS {PLACED}), {rows})"})
    low = "array_sort(concat(filter(found, f -> f.severity = 'low'), _path_found))"
    every = f"IF(size(_path_found) = 0, found, concat(filter(found, f -> f.severity <> 'low'), {low}))"
    shown = f"transform({every}, f -> named_struct('brand', f.brand, 'technique', f.technique, 'severity', f.severity, 'detail', f.detail))"
    out = add_once(out, {"lookalike": f"IF(sub_words IS NULL, CAST(array() AS {FINDING_TYPE}), {shown})"})
    return out.selectExpr(*[f"`{c}`" for c in given], *PART_FIELDS, *extra, "lookalike", f"{strongest('lookalike')} AS lookalike_severity")


def find_by_keys(df: DataFrame, brands: DataFrame, key: str = "url_id", tenants=MULTI_TENANT, url: str = "url") -> DataFrame:
    """One row per finding ``(key, pos, brand, technique, severity, detail)`` of a URL table, strongest first per URL."""
    found = with_findings(df, brands, tenants=tenants, url=url)
    return explode_findings(found, key)
