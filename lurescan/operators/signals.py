"""Plain-language warning signs of a URL, in a fixed order."""

from __future__ import annotations

from ..dims import SHORTENERS
from ..functions.text import in_list
from .features import v2_columns

CODES = (
    "ip_host user_info punycode shortener shared_hosting deep_subdomain port sensitive_words email long_url no_https".split()
)


def signal_conditions(url: str = "url") -> dict[str, tuple[str, str]]:
    """Code -> (condition, sentence), both SQL text over a table with parts."""
    f, text = v2_columns(url), f"`{url}`"
    before_path = f"substring_index(IF(contains({text}, '//'), substr({text}, locate('//', {text}) + 2), {text}), '/', 1)"
    return {
        "ip_host": ("is_ip", "'the host is an IP address instead of a name'"),
        "user_info": (f"contains({before_path}, '@')", "'an @ before the path: what stands in front of it is not the site'"),
        "punycode": (f["is_punycode"], "concat('internationalised name, shown as ', unicode_host)"),
        "shortener": (in_list("registered", SHORTENERS), "'a link shortener hides the destination'"),
        "shared_hosting": (f["free_hosting"], "concat('anyone can publish on ', registered)"),
        "deep_subdomain": (f"{f['subdomain_levels']} >= 3", f"concat({f['subdomain_levels']}, ' subdomain levels in front of ', registered)"),
        "port": ("port IS NOT NULL", "concat('an explicit port, ', port)"),
        "sensitive_words": (f"{f['sensitive_words']} >= 2", "'several account or security words'"),
        "email": (f["email_in_url"], "'an e-mail address inside the URL'"),
        "long_url": (f"length({text}) > 100", f"concat('a long URL of ', length({text}), ' characters')"),
        "no_https": ("scheme = 'http'", "'no HTTPS'"),
    }



def signals(url: str = "url") -> str:
    """array<string> of sentences."""
    cases = ", ".join(f"IF({cond}, {say}, NULL)" for cond, say in signal_conditions(url).values())
    return f"array_compact(array({cases}))"


def signal_codes(url: str = "url") -> str:
    """array<string> of codes, for counting and filtering."""
    cases = ", ".join(f"IF({cond}, '{code}', NULL)" for code, (cond, _) in signal_conditions(url).items())
    return f"array_compact(array({cases}))"
