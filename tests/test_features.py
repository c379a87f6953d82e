import math
from collections import Counter

from lurescan import dims
from lurescan.operators.features import extract, v1_features
from lurescan.operators.parts import with_parts
from lurescan.operators.signals import signal_codes

CASES = {
    "http://192.168.0.1/login": dict(is_ip_host=1),
    "https://www.microsoft.com/": dict(is_shortener=0, official_brand_domain=1),
    "https://bit.ly/abc": dict(is_shortener=1),
    "http://paypal.com.secure-login.000webhostapp.com/verify/account.php?user=a@b.com": dict(free_hosting=1, lookalike_severity=3, email_in_url=1, php_or_html=1),
    "https://www.paypal.com/": dict(official_brand_domain=1, brand_similarity=1),
    "https://sites.google.com/x": dict(free_hosting=0),
    "https://x.sites.google.com/": dict(free_hosting=1),
    "http://pyapal.com/": dict(brand_similarity=0.8333),
    "a@b.com": dict(email_in_url=0, hostname_length=0),
}


def test_gold_features(urls):
    got = {r["url"]: r for r in extract(urls(CASES)).collect()}
    for url, want in CASES.items():
        assert {k: got[url][k] for k in want} == want, url
        n = len(url)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
        assert abs(got[url]["url_entropy"] - entropy) < 1e-9
    assert list(next(iter(got.values())).asDict()) == ["url_id", "url", *dims.FEATURES] and len(dims.FEATURES) == 41


def test_first_generation_flags_keep_their_faults(urls):
    a, b, c, d = v1_features(urls(["http://192.168.0.1/login?a=b", "https://www.microsoft.com/", "http://[::1]:80/", "http://a.com/p;q=1"])).collect()
    assert (a["url_length"], a["path_length"], a["count_equals"], a["has_ip"]) == (28, 6, 1, 0)
    assert b["is_shortened"] == 1 and c["has_ip"] == 1 and d["path_length"] == 2


def test_unicode_digits_and_signals(urls):
    df = urls(["http://a.com/²٣", "http://a.com?x=a@b", "http://u@10.0.0.1:81/"])
    assert v1_features(df, names=["count_digits"]).first()["count_digits"] == 2
    codes = [r[0] for r in with_parts(df).selectExpr(signal_codes()).collect()]
    assert "user_info" in codes[1] and codes[2] == ["ip_host", "user_info", "port", "email", "no_https"]
