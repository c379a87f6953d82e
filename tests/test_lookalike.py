import random

import pytest

from lurescan import dims
from lurescan.functions.distance import osa, osa_table, osa_within, swapped_pairs_of
from lurescan.functions.skeleton import skeletons, with_base_forms
from lurescan.functions.text import add
from lurescan.operators.generate import brand_group, brand_homes, lookalikes
from lurescan.operators.lookalike import explode_findings, find
from lurescan.operators import lookalike_join
from lurescan.operators.lookalike_join import find_by_keys
from lurescan.operators.parts import split_front, with_parts
from lurescan.operators.profile import detection_rates

POSITIVE = """
http://paypa1.com/login paypal homoglyph high
https://xn--pypal-4ve.com/ paypal homoglyph high
http://rnicrosoft.com/ microsoft homoglyph high
http://paypall.com/ paypal typosquat high
http://micorsoft.com/ microsoft typosquat high
http://paypal.example/ paypal unofficial-domain medium
http://icl0ud.com/ icloud homoglyph high
http://paypal-secure-login.com/ paypal combosquat medium
http://sbi-kyc-update.in/ sbi combosquat medium
http://netflixbilling.net/ netflix combosquat low
http://paypal.com.account-verify.example/x paypal brand-in-subdomain high
http://paypal.blogspot.com/ paypal brand-in-subdomain medium
http://evil.example/paypal/login paypal brand-in-path low
https://xn--80ak6aa92e.com/ apple homoglyph high
"""
NEGATIVE = """https://www.paypal.com/signin https://onlinesbi.sbi/ https://login.microsoftonline.com/ https://www.purchase.com/
https://pineapple.com/ https://stream.com/ https://groups.example/ https://cloud.microsoft/ https://hicloud.com/ http://192.168.1.1/login
http://office365-login.com/""".split()


def plain_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_gold_findings(spark, urls):
    gold = [line.split() for line in POSITIVE.strip().splitlines()]
    rows = explode_findings(find(with_parts(urls([g[0] for g in gold] + NEGATIVE))), "url").collect()
    got = {(r["url"], r["brand"]): (r["technique"], r["severity"]) for r in rows}
    for url, brand, technique, severity in gold:
        assert got[url, brand] == (technique, severity)
    assert not [k for k in got if k[0] in NEGATIVE]


def test_distance(spark):
    rng = random.Random(5)
    pairs = [("paypal", "paypal"), ("pyapal", "paypal"), ("paypa", "paypal"), ("ca", "abc"), ("", "ab"), ("ab", "")]
    pairs += [("".join(rng.choices("abc", k=rng.randint(0, 7))), "".join(rng.choices("abc", k=rng.randint(0, 7)))) for _ in range(200)]
    df = add(spark.createDataFrame(pairs, "a string, b string"), {"d": osa("a", "b"), "c": osa("a", "b", "3"), "s": swapped_pairs_of("b")})
    for r in add(df, {"w": osa_within("a", "b", "2", "s")}).collect():
        want = plain_osa(r["a"], r["b"])
        assert (r["d"], r["c"], r["w"]) == (want, min(want, 3), want <= 2), r


def test_skeletons(spark):
    df = with_base_forms(spark.createDataFrame([("Rnicr0s0ft",), ("cаfé",), ("bell",)], "x string"), {"b": "x"})
    got = [set(r[0]) for r in df.selectExpr(skeletons("b")).collect()]
    assert "microsoft" in got[0] and got[1] == {"cafe"} and got[2] == {"bell", "beii"}


@pytest.fixture(scope="module")
def generated(spark):
    return with_parts(lookalikes(brand_homes(spark)).selectExpr("xxhash64(name, url) AS url_id", "name", "technique", "url")).cache()


def test_published_detection_rates(generated):
    """All 18 published (n, detected) pairs of the generated-lookalike table."""
    names = "omission repetition transposition replacement homoglyph hyphenation combosquat subdomain tld-swap".split()
    published = {
        "distinctive": [(282, 0.9504), (282, 0.9504), (246, 0.9512), (1321, 0.9531), (228, 0.9386), (251, 0.9522), (648, 0.9444), (72, 0.9722), (144, 0.9722)],
        "word-only or 5 letters": [(77, 0.0), (77, 0.1558), (63, 0.0), (368, 0.0), (76, 0.7368), (67, 0.0149), (252, 0.7143), (28, 0.8571), (56, 0.8571)],
    }
    rows = detection_rates(find(generated).withColumn("grp", brand_group("name"))).collect()
    assert {(r["grp"], r["technique"]): (r["n"], r["detected"]) for r in rows} == {(g, t): v for g, vs in published.items() for t, v in zip(names, vs, strict=True)}


def test_key_joins_find_the_same(spark, generated):
    brands = spark.createDataFrame([tuple(b) for b in dims.BRANDS], "ord int, brand string, official array<string>, home string, word_only boolean")
    cols = ["url_id", "brand", "technique", "severity"]
    rows = generated.dropDuplicates(["url_id"])
    a = {tuple(r) for r in explode_findings(find(rows), "url_id").select(*cols).collect()}
    keyed = find_by_keys(rows, brands).select(*cols)
    assert {tuple(r) for r in keyed.collect()} == a and len(a) > 3000
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_key_joins_take_brands_of_any_length(spark, urls):
    """Short, long and unreachably long names in one table; a swap in a long name is found."""
    names = ["ab", "averylongbrandnameindeed", "x" * 3000]
    brands = spark.createDataFrame([(i, n, [f"{n}.test"], f"{n}.test", False) for i, n in enumerate(names)], "ord int, brand string, official array<string>, home string, word_only boolean")
    rows = with_parts(urls(["http://averylongbrandnameinded.com/", "http://ab.com/", "http://averylongbrandnameindeed.test/"]))
    got = {(r["url_id"], r["brand"], r["technique"]) for r in find_by_keys(rows, brands).collect()}
    assert got == {(0, names[1], "typosquat"), (1, "ab", "unofficial-domain")}


def test_a_brand_table_is_worked_out_once_and_long_ones_filtered(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    shape = "ord int, brand string, official array<string>, home string, word_only boolean"
    brands = spark.createDataFrame([tuple(b) for b in dims.BRANDS], shape)
    rows = spark.createDataFrame(list(enumerate(["http://paypa1.com/login", "http://paypall.com/x", "http://a.com/paypal", "http://paypal.a.com/", "", None])), "url_id bigint, url string")
    expected = sorted(map(str, find_by_keys(rows, brands).collect()))
    monkeypatch.setattr(lookalike_join, "MOST_BITS", 0)  # as for a table with more keys than the filter holds
    assert sorted(map(str, find_by_keys(rows, brands.mapInArrow(counted, shape)).collect())) == expected and len(expected) > 3
    assert seen.value == len(dims.BRANDS)
    keys = spark.createDataFrame([("9:paypal",)], "key string")
    assert lookalike_join._among(spark.range(2000).select(F.concat_ws(":", F.lit("9"), "id").alias("key")).union(keys), keys).collect() == keys.collect()


def test_a_url_is_split_by_delimiters_as_by_the_expression(spark):
    from lurescan.functions import urls as U

    rng = random.Random(5)
    parts = [*"aB1:/?#@[].+-%  \t\n\u0085\u00e9", "://", "//", "http", "HTTPS:", "http://"]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([*enumerate(urls), (-1, None)], "url_id bigint, url string")
    clean = U.drop_unsafe(U.with_scheme("url"))
    expected = add(rows, {"scheme": U.scheme_of(clean), "authority": U.authority_of(clean), "path": U.path_of(clean), "query": U.query_of(clean)})
    got = split_front(rows)
    assert got.columns == expected.columns and sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert "regexp_extract" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_distance_within_matches_brute_force(spark):
    """Pairs whose swaps, lengths and letters are near the limit, each with the table alone."""
    r = random.Random(5)
    near = []
    for _ in range(1500):
        a = [r.choice("abcd") for _ in range(r.randrange(1, 9))]
        b = a[:]
        for _ in range(r.randrange(4)):
            at = r.randrange(len(b)) if b else 0
            kind = r.randrange(4)
            if kind == 0 and at + 1 < len(b):
                b[at], b[at + 1] = b[at + 1], b[at]
            elif kind == 1:
                b.insert(at, r.choice("abcde"))
            elif b:
                b[at : at + 1] = [] if kind == 2 else [r.choice("abcde")]
        near.append(("".join(a), "".join(b), 1 + r.randrange(2)))
    df = spark.createDataFrame(near, "a string, b string, k int")
    got = df.selectExpr(f"{osa_within('a', 'b', 'k', swapped_pairs_of('b'))} AS within", f"{osa_table('a', 'b')} <= k AS plain").collect()
    assert [x["within"] for x in got] == [x["plain"] for x in got] and 100 < sum(x["plain"] for x in got) < 1400


def test_distances_are_worked_out_in_dealt_tasks(spark, monkeypatch):
    """A filter on the distance stays above the dealing of pairs into tasks; below it before."""
    monkeypatch.setattr(lookalike_join, "PAIRS_IN_TASK", 5)
    monkeypatch.setattr(lookalike_join, "KEYED_IN_TASK", 5)
    words = ["".join(random.Random(i).choices("abcdefgh", k=9)) for i in range(40)]
    brands = spark.createDataFrame([(i, w, [f"{w}.test"], f"{w}.test", False) for i, w in enumerate(words)], "ord int, brand string, official array<string>, home string, word_only boolean")
    labels = spark.createDataFrame([(w[:3] + w[4] + w[3] + w[5:],) * 2 for w in words], "domain string, shown string")
    found = lookalike_join.label_findings(lookalike_join.stable(labels, "labels"), lookalike_join.stable(brands, "brands"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and "levenshtein" not in plan.split("Repartition", 1)[1]
    assert {(r["domain"], r["brand"]) for r in found.collect()} >= {(w[:3] + w[4] + w[3] + w[5:], w) for w in words if w[3] != w[4]}
