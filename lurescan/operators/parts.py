"""URL table -> URL table with the parts of every URL.

Map-only: the public-suffix rules are a fixed-size dimension, joined by broadcast on the last labels of
the host, as many as the longest rule has, so no URL is shuffled however skewed the hosts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import add, add_once, count_char
from ..functions.unicode import nfkc, nfkc_jvm, shown_host, shown_host_jvm
from ..sources.psl import EXCEPTION, PLAIN, WILDCARD, rule_depth, suffix_rules

PART_FIELDS = (
    "scheme host unicode_host port path query subdomain domain suffix registered is_ip parse_error".split()
)


def split_url(df: DataFrame, url: str = "url", pushable: bool = False) -> DataFrame:
    """Scheme, host, port, path and query (P1-P7, P10 flags): projections only, no join.

    ``pushable`` lets filters on the other columns reach the scan; Unicode work then runs in Python workers.
    """
    df = df.drop(*PART_FIELDS)
    df = add(df, {"_clean": U.drop_unsafe(U.with_scheme(f"`{url}`"))})
    df = add(df, {"_authority": U.authority_of("_clean"), "_path": U.path_of("_clean"), "_query": U.query_of("_clean"), "_scheme": U.scheme_of("_clean")})
    df = add(df, {"_hostport": U.host_port("_authority")})
    df = add(df, {"_host": U.host_of("_hostport")})
    # null but for the rare rows that need Unicode work
    df = add(df, {"_encoded": U.encoded_host("_host"), "_plain": U.without_delimiters("_authority")})
    if pushable:
        df = df.withColumns({"_encoded": shown_host()("_encoded"), "_composed": nfkc()("_plain")})
    else:
        df = add(df, {"_encoded": shown_host_jvm("_encoded"), "_composed": nfkc_jvm("_plain")})
    return add_once(
        df,
        {
            "scheme": "_scheme",
            "host": "_host",
            "port": U.port_of("_hostport"),
            "path": "_path",
            "query": "_query",
            "parse_error": U.is_malformed("_authority", "_hostport", "_plain", "_composed"),
            "unicode_host": "coalesce(_encoded, _host)",
            "is_ip": U.is_ip("_host"),
        },
        drop=("_clean", "_authority", "_path", "_query", "_scheme", "_hostport", "_host", "_encoded", "_plain", "_composed"),
    )


def split_front(df: DataFrame, url: str = "url") -> DataFrame:
    """Scheme, authority, path and query: what differs between URLs of one site. SQL functions only."""
    df = add(df.drop("scheme", "authority", "path", "query"), {"_clean": U.drop_unsafe(U.with_scheme(f"`{url}`"))})
    # the pieces of U._SPLIT by delimiters: one regular expression on the scheme alone instead of four on the URL
    df = add(df, {"_shown": "substring_index(_clean, '#', 1)"})
    df = add(df, {"_front": "substring_index(_shown, '?', 1)"})
    df = add(df, {"_named": U.leading_scheme("_front")})
    df = add(df, {"_rest": "IF(_named = '', _front, substr(_front, length(_named) + 2))"})
    df = add(df, {"_authority": "IF(startswith(_rest, '//'), substring_index(substr(_rest, 3), '/', 1), IF(_rest IS NULL, NULL, ''))"})
    pieces = {
        "scheme": "lower(_named)",
        "authority": "_authority",
        "path": "IF(startswith(_rest, '//'), substr(_rest, 3 + length(_authority)), _rest)",
        "query": "substr(_shown, length(_front) + 2)",
    }
    return add_once(df, pieces, drop=("_clean", "_shown", "_front", "_named", "_rest", "_authority"))


def split_authority(df: DataFrame) -> DataFrame:
    """Host, port and flags of ``authority``; Unicode work runs in Python workers, so give it distinct authorities."""
    df = add(df, {"_hostport": U.host_port("authority")})
    df = add(df, {"host": U.host_of("_hostport"), "_plain": U.without_delimiters("authority")})
    df = add(df, {"_encoded": U.encoded_host("host")}).withColumns({"_encoded": shown_host()("_encoded"), "_composed": nfkc()("_plain")})
    out = {"port": U.port_of("_hostport"), "parse_error": U.is_malformed("authority", "_hostport", "_plain", "_composed"), "unicode_host": "coalesce(_encoded, host)", "is_ip": U.is_ip("host")}
    return add_once(df, out, drop=("_hostport", "_plain", "_encoded", "_composed"))


def _suffix_length(deepest: int) -> str:
    """Number of labels in the public suffix, from the rule flags of the last labels; 0 if unlisted."""
    best = "0"
    for k in range(1, deepest + 1):
        flags = f"coalesce(_rule{k}, 0)"
        excepted = f"(coalesce(_rule{k + 1}, 0) & {EXCEPTION}) > 0" if k < deepest else "false"
        best = (
            f"CASE WHEN ({flags} & {WILDCARD}) > 0 AND {excepted} THEN {k} "
            f"WHEN ({flags} & {WILDCARD}) > 0 AND _n > {k} THEN {k + 1} "
            f"WHEN ({flags} & {PLAIN}) > 0 THEN {k} ELSE {best} END"
        )
    return best


def split_host(df: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Subdomain, domain, suffix and registered domain of ``host``."""
    deepest = rule_depth(rules)
    rules = suffix_rules(df.sparkSession) if rules is None else rules
    keep = [f"`{c}`" for c in df.columns if c not in ("suffix", "domain", "subdomain", "registered")]
    # other full stops that name resolution treats as a dot
    df = df.selectExpr(*keep, "translate(host, '。．｡', '...') AS _dotted")
    df = df.selectExpr("*", f"IF(is_ip OR host = '', 0, {count_char('_dotted', '.')} + 1) AS _n")
    depth = range(1, deepest + 1)
    df = df.selectExpr("*", *[f"IF(_n >= {k}, substring_index(_dotted, '.', -{k}), NULL) AS _tail{k}" for k in depth])
    for k in depth:
        rule = F.broadcast(rules.selectExpr(f"rule AS _tail{k}", f"flags AS _rule{k}"))
        df = df.join(rule, f"_tail{k}", "left")
    df = df.selectExpr(*keep, "_dotted", "_n", f"{_suffix_length(deepest)} AS _listed")
    # an unlisted top-level domain counts as a suffix of one label
    df = df.selectExpr(*keep, "_dotted", "_n", "IF(_listed = 0 AND contains(host, '.') AND _n > 0, 1, _listed) AS _take")
    reg = "substring_index(_dotted, '.', -(_take + 1))"
    suffix = "IF(_n = 0 OR _take = 0, '', substring_index(_dotted, '.', -_take))"
    domain = f"CASE WHEN _n = 0 THEN host WHEN _n > _take THEN substring_index({reg}, '.', 1) ELSE '' END"
    return add_once(
        df,
        {
            "suffix": suffix,
            "domain": domain,
            "subdomain": f"IF(_n > _take + 1, substr(_dotted, 1, length(_dotted) - length({reg}) - 1), '')",
            "registered": f"IF(_n > _take AND _take > 0, {reg}, host)",
        },
        drop=("_dotted", "_n", "_take"),
    )


def with_parts(df: DataFrame, url: str = "url", rules: DataFrame | None = None, pushable: bool = False) -> DataFrame:
    """Adds the twelve part columns to a table of URLs. Rows are kept, duplicates included."""
    return split_host(split_url(df, url, pushable), rules)


def parts_struct() -> Column:
    """The part columns packed into one struct."""
    return F.struct(*PART_FIELDS).alias("parts")


def site_key(url: str = "url") -> str:
    """Registered domain, or the URL itself when it has none."""
    return f"IF(registered <> '', registered, `{url}`)"
