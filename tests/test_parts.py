from urllib.parse import urlsplit

from lurescan.operators.parts import with_parts

GOLD = {
    "HTTPS://Login.Example.co.uk:8443/a/b?x=1": dict(scheme="https", host="login.example.co.uk", port=8443, path="/a/b", query="x=1", subdomain="login", domain="example", suffix="co.uk", registered="example.co.uk"),
    "example.com/path": dict(host="example.com", scheme="http"),
    "http://paypal.com.account-verify.example/": dict(registered="account-verify.example", subdomain="paypal.com"),
    "http://192.168.10.5/login": dict(is_ip=True, registered="192.168.10.5"),
    "http://0x7f.0x0.0x0.0x1/": dict(is_ip=True),
    "http://999.999.999.999/": dict(is_ip=True),
    "http://3232235777/": dict(is_ip=True),
    "http://[::1]:80/": dict(is_ip=True, port=80, host="::1", parse_error=False),
    "http://[::ffff:1.2.3.4]/": dict(is_ip=True, parse_error=False),
    "http://[1:2:3]/": dict(parse_error=True),
    "http://[abc": dict(parse_error=True),
    "https://xn--pypal-4ve.com/": dict(unicode_host="pаypal.com", domain="xn--pypal-4ve"),
    "http://a.com:99999/": dict(port=None, host="a.com"),
    "http://a.com:x/": dict(port=None),
    "http://u:p@a.com:80/": dict(host="a.com", port=80),
    "javascript:alert(1)": dict(host="javascript"),
    "http:///x": dict(host=""),
    "http://a.b.ck/": dict(suffix="b.ck", domain="a"),
    "http://www.ck/": dict(suffix="ck", domain="www", registered="www.ck"),
    "http://a.city.kawasaki.jp/": dict(suffix="kawasaki.jp", registered="city.kawasaki.jp"),
    "http://co.uk/": dict(suffix="co.uk", domain="", registered="co.uk"),
    "http://x.blogspot.com/": dict(registered="blogspot.com"),
    "http://localhost/": dict(registered="localhost", suffix=""),
    "http://a.com../": dict(host="a.com"),
    " http://b.org/ ": dict(host="b.org"),
    "http://ｐaypal.com/": dict(unicode_host="paypal.com"),
}


def test_gold_rows(spark, urls):
    got = {r["url"]: r for r in with_parts(urls(GOLD)).collect()}
    for url, want in GOLD.items():
        assert {k: got[url][k] for k in want} == want, url


def test_agrees_with_the_standard_splitter(spark, urls):
    cases = [f"{s}{u}{h}{p}{q}" for s in ("http://", "HTTPS://", "ftp://") for u in ("", "u@", "a:b@c@") for h in ("a.com", "A.b-c.org:8", "1.2.3.4:", "x_y.net:00080", "é.fr") for p in ("", "/", "/a;b/c;d", "//x") for q in ("", "?", "?a=b?c", "#f?g", "?x#y")]
    for r in with_parts(urls(cases)).collect():
        s = urlsplit(r["url"])
        assert (r["scheme"], r["host"], r["port"], r["path"], r["query"]) == (s.scheme, s.hostname, s.port, s.path, s.query), r["url"]


def test_rows_are_kept_and_nothing_is_shuffled(spark, urls):
    df = with_parts(urls(["http://a.com/"] * 5 + [None]))
    assert df.count() == 6
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Python" not in plan and "NestedLoop" not in plan
