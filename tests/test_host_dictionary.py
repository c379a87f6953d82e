"""Host work once per host: the same parts and findings as the row-wise route, for literal brands and for brand tables."""

import pytest
from pyspark.sql import functions as F

from lurescan import dims
from lurescan.operators.bloom import bloom_of
from lurescan.operators.lookalike import find
from lurescan.operators.lookalike_join import dictionary, with_findings
from lurescan.operators.parts import PART_FIELDS, split_front, with_parts
from lurescan.operators.skew import spread_join
from lurescan.plans.check import check
from registry.corpus import load

from .conftest import SF

ODD = [
    None, "", "   ", "http://[abc", "http://paypal.com.evil.net/paypal/google", "http://google-paypal.login.evil.in/amazon/amazon?x=microsoft", "http://xn--pypal-4ve.com/paypal",
    "http://a.paypa1.com", "http://paypal.amazon-x.com/netflix", "http://u:p@paypal.com:81/x", "http://ｐaypal.com/", "http://a℀b.com/", "http://paypal.com./", "http://netflix.blogspot.com/netflix",
]
COLUMNS = ["url_id", "url", *PART_FIELDS, "lookalike", "lookalike_severity"]
BRAND_SHAPE = "ord int, brand string, official array<string>, home string, word_only boolean"


@pytest.fixture(scope="module")
def rows(spark):
    odd = spark.createDataFrame([(10**9 + i, u) for i, u in enumerate(ODD)], "url_id bigint, url string")
    # a third of the rows on one host, and one path word that is a brand on all of them
    hot = spark.range(200).selectExpr("2000000000 + id AS url_id", "concat('http://paypal-x.com/google/', id) AS url")
    return load(spark, SF, "url_raw").select("url_id", "url").unionByName(odd).unionByName(hot)


@pytest.fixture(scope="module")
def brands(spark):
    return spark.createDataFrame([tuple(b) for b in dims.BRANDS], BRAND_SHAPE)


@pytest.fixture(scope="module")
def want(rows):
    return sorted(map(str, find(with_parts(rows)).select(*COLUMNS).collect()))


def test_literal_brands(rows, want):
    assert sorted(map(str, with_findings(rows).select(*COLUMNS).collect())) == want


def test_brand_table(rows, brands, want):
    got = with_findings(rows, brands)
    assert sorted(map(str, got.select(*COLUMNS).collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_check_takes_all_three_routes(rows, brands):
    results = [sorted(map(str, check(rows, keep=("url_id",), **o).collect())) for o in ({}, {"per_host": True}, {"brands": brands})]
    assert results[0] == results[1] == results[2] and len(results[0]) == rows.count()


def test_a_dictionary_is_reused(spark, rows, want):
    known = dictionary(split_front(rows))
    assert known.count() == known.select("authority").distinct().count()
    assert sorted(map(str, with_findings(rows, hosts=known).select(*COLUMNS).collect())) == want


def test_empty_tables(spark, brands):
    none = spark.createDataFrame([], "url_id bigint, url string")
    assert with_findings(none).count() == 0 and with_findings(none, brands).count() == 0
    some = spark.createDataFrame([(1, "http://paypa1.com/x")], "url_id bigint, url string")
    assert with_findings(some, spark.createDataFrame([], BRAND_SHAPE)).first()["lookalike"] == []


def test_bloom_keeps_every_key(spark):
    keys = spark.range(3_000).selectExpr("concat('key', id) AS k")
    bloom = bloom_of(keys, "k")
    assert keys.where(f"NOT {bloom.has('k')}").count() == 0
    assert spark.range(3_000).selectExpr("concat('other', id) AS k").where(bloom.has("k")).count() < 150


def test_salt_is_a_function_of_the_row(spark):
    big = spark.range(600).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id)) AS key", "map('a', id) AS m")
    small = spark.range(600).selectExpr("IF(id = 0, 'hot', concat('k', id)) AS key", "IF(id = 0, 200, 1) AS w", "id * 2 AS v")
    joined = spread_join(big, small, "key", "w", ["v"], hot_keys=1)
    assert "rand(" not in joined._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["v"] for r in joined.collect()}
    assert len(got) == 600 and all(v == (0 if i % 3 == 0 else 2 * i) for i, v in got.items())
    assert spread_join(big, small.where(F.col("key") != "hot"), "key", "w", ["v"], how="inner").count() == 400
