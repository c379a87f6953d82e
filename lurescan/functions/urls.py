"""SQL expressions that take a URL text apart. Nothing is fetched."""

from __future__ import annotations

from .text import C0_AND_SPACE, DIGIT, is_ascii, quote, trim_space

# scheme, authority, path, query; the fragment is matched and dropped
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_SCHEME = r"\A[A-Za-z][A-Za-z0-9+.\-]*\z"
_INSIDE = r"\[([^\]]*)"
_PORT = r"(?s)^(?:\[[^\]]*\])?[^:]*:(.*)$"
_BRACKETED = r"^\[([^\]]*)\]"
_WELL_PLACED = r"(?s)^\[[^\]]*\](?::.*)?$"
_IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
_NUMBER = rf"(?:{DIGIT}+|0x[^.]*)"


def with_scheme(url: str) -> str:
    """Trimmed text; ``http://`` goes in front unless ``://`` is among the first 16 characters."""
    raw = trim_space(url)
    return f"IF(contains(substr({raw}, 1, 16), '://'), {raw}, concat('http://', {raw}))"


def drop_unsafe(url: str) -> str:
    """Leading control characters and spaces, and every tab or line break, are ignored by URL splitting."""
    return rf"translate(trim(LEADING {quote(C0_AND_SPACE)} FROM {url}), '\t\r\n', '')"


def _group(url: str, n: int) -> str:
    return f"regexp_extract({url}, {quote(_SPLIT)}, {n})"


def leading_scheme(front: str) -> str:
    """The scheme that a URL without query and fragment begins with, as it stands; '' without one."""
    name = f"substring_index({front}, ':', 1)"
    named = f"contains({front}, ':') AND ({name} IN ('http', 'https') OR {name} RLIKE {quote(_SCHEME)})"
    return f"IF({front} IS NULL OR ({named}), {name}, '')"


def scheme_of(url: str) -> str:
    return f"lower({_group(url, 1)})"


def authority_of(url: str) -> str:
    return _group(url, 2)


def path_of(url: str) -> str:
    return _group(url, 3)


def query_of(url: str) -> str:
    return _group(url, 4)


def host_port(authority: str) -> str:
    """Authority without user information."""
    return f"substring_index({authority}, '@', -1)"


def host_of(hostport: str) -> str:
    """Host in lower case: no brackets, no port, no trailing dots."""
    inside = f"regexp_extract({hostport}, {quote(_INSIDE)}, 1)"
    name = f"IF(contains({hostport}, '['), {inside}, substring_index({hostport}, ':', 1))"
    return f"lower(trim(TRAILING '.' FROM {name}))"


def port_of(hostport: str) -> str:
    text = f"regexp_extract({hostport}, {quote(_PORT)}, 1)"
    number = f"IF({text} RLIKE '^[0-9]+$', try_cast({text} AS BIGINT), NULL)"
    return f"IF(contains({hostport}, ':') AND {number} <= 65535, CAST({number} AS INT), NULL)"


def is_ipv6(host: str) -> str:
    """Up to eight hex groups, one run of which may be ``::``; the tail may be a dotted IPv4."""
    bare = f"regexp_replace({host}, '%[^%]+$', '')"
    tail = f"substring_index({bare}, ':', -1)"
    # a dotted tail stands for two groups
    hexed = (
        f"IF({tail} RLIKE {quote('^' + _IPV4)}, concat(substr({bare}, 1, length({bare}) - length({tail})), '0:0'), {bare})"
    )
    groups = f"regexp_count({hexed}, '[0-9a-f]+')"
    full = f"({hexed} RLIKE '^{_GROUPS}$' AND {groups} = 8)"
    short = f"({hexed} RLIKE '^(?:{_GROUPS})?::(?:{_GROUPS})?$' AND {groups} <= 7)"
    return f"(contains({host}, ':') AND ({full} OR {short}))"


def is_ip(host: str) -> str:
    """IPv6, or up to four dotted numbers, decimal or 0x..., in the loose forms browsers accept."""
    dotted = rf"^{_NUMBER}(?:\.{_NUMBER}){{0,3}}$"
    return f"({host} RLIKE {quote(dotted)} OR {is_ipv6(host)})"


def without_delimiters(authority: str) -> str:
    """Authority without its delimiters where it goes beyond ASCII, else null."""
    return f"IF({is_ascii(authority)}, CAST(NULL AS STRING), translate({authority}, '@:#?', ''))"


def is_malformed(authority: str, hostport: str, plain: str, composed: str) -> str:
    """Unbalanced or misplaced brackets, a bracketed host that is no address, or characters that
    turn into delimiters under compatibility normalisation (``composed`` is that of ``plain``)."""
    inside = f"lower(regexp_extract({hostport}, {quote(_BRACKETED)}, 1))"
    placed = f"{hostport} RLIKE {quote(_WELL_PLACED)}"
    address = f"({is_ipv6(inside)} OR {inside} RLIKE {quote(r'^v[0-9a-f]+[.].+$')})"
    brackets = f"IF(contains({authority}, '[') OR contains({authority}, ']'), NOT (contains({authority}, '[') AND {placed} AND {address}), false)"
    unicode = f"coalesce({composed} <> {plain} AND {composed} RLIKE '[/?#@:]', false)"
    return f"({brackets} OR {unicode})"


def encoded_host(host: str) -> str:
    """Host that may read otherwise in Unicode: with punycode or beyond ASCII, else null."""
    return f"IF(contains({host}, 'xn--') OR NOT {is_ascii(host)}, {host}, CAST(NULL AS STRING))"
