"""Lexical, structural and lookalike features. Map-only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import dims
from ..functions import urls as U
from ..functions.distance import osa_table, swapped_pairs
from ..functions.text import (
    add,
    count_char,
    count_digits,
    entropy,
    in_list,
    longest_token,
    quote,
    str_array,
    table_literal,
)
from .lookalike import find
from .parts import with_parts
from .skew import per_distinct

# schemes whose last path segment may carry ;parameters
_PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
_COUNTED = {"count_hyphens": "-", "count_dots": ".", "count_at": "@", "count_questionmark": "?", "count_equals": "=", "count_slashes": "/"}
_EMAIL = r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_.]+"
_HEX_THEN_IPV6 = r"(?i)(?:0x[0-9a-f]{1,2}\.){3}0x[0-9a-f]{1,2}(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}"
_SPLIT_V1 = ("_v1_scheme", "_v1_netloc", "_v1_path")


def _split_v1(df: DataFrame, url: str) -> DataFrame:
    df = add(df, {"_v1_raw": U.drop_unsafe(f"`{url}`")})
    return add(df, dict(zip(_SPLIT_V1, (U.scheme_of("_v1_raw"), U.authority_of("_v1_raw"), U.path_of("_v1_raw")), strict=True))).drop("_v1_raw")


def v1_columns(url: str = "url") -> dict[str, str]:
    """First-generation features of the raw URL: neither trimmed nor given a default scheme."""
    text, last = f"`{url}`", "substring_index(_v1_path, '/', -1)"
    # parameters: from the first ';' of the last segment
    params = f"length({last}) - length(substring_index({last}, ';', 1))"
    shorteners = "|".join(s.replace(".", r"\.") for s in dims.V1_SHORTENER_TEXT)
    return {
        "url_length": f"length({text})",
        "hostname_length": "length(_v1_netloc)",
        "path_length": f"length(_v1_path) - IF({in_list('_v1_scheme', _PARAM_SCHEMES)}, {params}, 0)",
        **{name: count_char(text, ch) for name, ch in _COUNTED.items()},
        "count_digits": count_digits(text),
        # kept as it was: it cannot see IPv4, only '::' or a hex quad run into a full IPv6
        "has_ip": f"contains(_v1_netloc, '::') OR _v1_netloc RLIKE {quote(_HEX_THEN_IPV6)}",
        "has_https": "_v1_scheme = 'https'",
        # kept as it was: the text may stand anywhere, so microsoft.com counts for its t.co
        "is_shortened": f"{text} RLIKE {quote(shorteners)}",
    }


def v1_features(df: DataFrame, url: str = "url", names=dims.V1_FEATURES) -> DataFrame:
    """Adds the 13 first-generation features as doubles."""
    sql = v1_columns(url)
    return add(_split_v1(df, url), {n: f"CAST({sql[n]} AS DOUBLE)" for n in names}).drop(*_SPLIT_V1)


def brand_similarity(label: str, brands=dims.BRANDS) -> str:
    """Largest 1 - distance/length over brands of five or more letters, floored at 0.

    Levenshtein scores every brand at native speed. The exact swap-aware distance is only computed
    for brands that hold a swapped pair of the label and whose best case beats the best plain score.
    """
    rows = [{"brand": b.brand, "len": len(b.brand), "swaps": swapped_pairs(b.brand)} for b in brands if len(b.brand) >= 5]
    table = table_literal(rows, "brand:string,len:double,swaps:array<string>")
    scored = f"transform({table}, b -> named_struct('b', b, 'd', levenshtein({label}, b.brand)))"
    plain = "greatest(best, 1 - s.d / s.b.len)"
    # swaps cannot save more than their number, nor more than half of the plain distance
    swaps = f"aggregate(s.b.swaps, 0, (n, w) -> n + length({label}) - length(replace({label}, w, ''))) / 2"
    hope = f"1 - greatest(ceil(s.d / 2), s.d - {swaps}, abs(length({label}) - s.b.len)) / s.b.len"
    exact = f"greatest(best, 1 - {osa_table(label, 's.b.brand')} / s.b.len)"
    improve = f"IF(s.d > 1 AND 1 - ceil(s.d / 2) / s.b.len > best AND {hope} > best, {exact}, best)"
    return f"""aggregate(array({scored}), 0D, (unused, all) -> aggregate(all,
        aggregate(all, 0D, (best, s) -> {plain}), (best, s) -> {improve}))"""


def with_similarity(df: DataFrame, brands=dims.BRANDS) -> DataFrame:
    """Adds ``brand_similarity`` (F39). The costly score is computed once per distinct label and joined
    back without skew; a stream cannot be grouped and joined like that, so there it is done in the row."""
    sql = f"round({brand_similarity('domain', brands)}, 4)"
    if df.isStreaming:
        return add(df, {"brand_similarity": f"IF(domain <> '' AND NOT is_ip, {sql}, 0D)"})
    key = "IF(domain <> '' AND NOT is_ip, domain, NULL)"
    df = add(df, {"_label_key": key})
    scored = per_distinct(df, "_label_key", {"brand_similarity": sql.replace("domain", "_label_key")})
    return add(scored, {"brand_similarity": "coalesce(brand_similarity, 0D)"}).drop("_label_key")


def v2_columns(url: str = "url", brands=dims.BRANDS) -> dict[str, str]:
    """Second-generation features of a table that has parts, findings and brand similarity."""
    text = f"`{url}`"
    top = "substring_index(suffix, '.', -1)"
    # platform names have two or three labels
    sizes = sorted({h.count(".") + 1 for h in dims.HOSTING})
    below = " OR ".join(
        f"(host <> substring_index(host, '.', -{k}) AND {in_list(f"substring_index(host, '.', -{k})", dims.HOSTING)})" for k in sizes
    )
    return {
        "is_shortener": in_list("registered", dims.SHORTENERS),
        "query_length": "length(query)",
        "host_dots": count_char("host", "."),
        "subdomain_levels": f"IF(subdomain = '', 0, {count_char('subdomain', '.')} + 1)",
        "host_hyphens": count_char("host", "-"),
        "host_digits": count_digits("host"),
        "digit_ratio": f"{count_digits(text)} / greatest(length({text}), 1)",
        "host_entropy": entropy("host"),
        "url_entropy": entropy(text),
        "longest_host_token": longest_token("host", "[.-]"),
        "longest_path_token": longest_token("concat(path, '?', query)", "[/._=?&-]"),
        "path_segments": "regexp_count(path, '[^/]+')",
        "count_ampersand": count_char(text, "&"),
        "count_percent": count_char(text, "%"),
        "count_underscore": count_char(text, "_"),
        "count_tilde": count_char(text, "~"),
        "double_slash_in_path": "contains(path, '//')",
        "has_port": "port IS NOT NULL",
        "is_ip_host": "is_ip",
        "is_punycode": "contains(host, 'xn--')",
        "www_prefix": "startswith(host, 'www.')",
        "tld_common": f"suffix <> '' AND {in_list(top, dims.COMMON_TLDS)}",
        "tld_length": f"IF(suffix <> '', length({top}), 0)",
        "free_hosting": f"{in_list('registered', dims.HOSTING)} OR {below}",
        "sensitive_words": f"size(array_intersect(split(lower({text}), '[^a-z0-9]+'), {str_array(dims.SENSITIVE_WORDS)}))",
        "php_or_html": r"lower(path) RLIKE '[.](php|html?|aspx?)$'",
        "email_in_url": f"substr({text}, length(scheme) + 4) RLIKE {quote(_EMAIL)}",
        "brand_similarity": "brand_similarity",
        "lookalike_severity": "lookalike_severity",
        "official_brand_domain": in_list("registered", dims.official_domains(brands)),
    }


def with_features(df: DataFrame, url: str = "url", names=dims.FEATURES, brands=dims.BRANDS) -> DataFrame:
    """Adds the chosen feature columns (doubles) to a table that already has parts and findings.

    Unchosen features are not computed.
    """
    if "brand_similarity" in names and "brand_similarity" not in df.columns:
        df = with_similarity(df, brands)
    sql = {**v1_columns(url), **v2_columns(url, brands)}
    return add(_split_v1(df, url), {n: f"CAST({sql[n]} AS DOUBLE)" for n in names}).drop(*_SPLIT_V1)


def extract(df: DataFrame, url: str = "url", names=dims.FEATURES, brands=dims.BRANDS, rules=None) -> DataFrame:
    """URL table -> the same rows with the chosen features only (F42): parse, match, compute."""
    keep = df.columns
    df = with_parts(df, url, rules)
    if "brand_similarity" in names:
        df = with_similarity(df, brands)  # before matching, so that its own pass over the URLs only parses them
    df = find(df, brands) if "lookalike_severity" in names else add(df, {"lookalike_severity": "0"})
    return with_features(df, url, names, brands).select(*keep, *names)
