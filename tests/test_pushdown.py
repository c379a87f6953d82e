"""Filters on a result reach the scan, and odd labels and rules do not end a job."""

from pyspark.sql import functions as F

from lurescan.operators.generate import lookalikes, rejected
from lurescan.operators.lookalike import find
from lurescan.operators.parts import with_parts
from lurescan.plans.check import check
from lurescan.sources.psl import suffix_rules


def scan(df):
    """Partition and pushed filters of the physical plan's scan lines."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_filters_reach_the_scan(spark, tmp_path):
    rows = spark.range(20).selectExpr("id AS url_id", "CAST(id % 4 AS INT) AS day", "concat('http://a', id, '.com/') AS url")
    rows.write.partitionBy("day").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    for made in (with_parts(log, pushable=True), find(with_parts(log, pushable=True)), check(log, keep=("url_id", "day"))):
        asked = made.where("day = 3 AND url_id = 7")
        lines = scan(asked)
        assert lines and all("EqualTo(url_id,7)" in x and "(day#" in x.split("PartitionFilters: ")[1].split("]")[0] for x in lines), lines
        assert [r["url_id"] for r in asked.collect()] == [7]


def test_both_routes_agree(spark, urls):
    odd = ["http://xn--pypal-4ve.com/a", "http://ｐaypal.com/", "http://a.xn--999999.com/", "http://a℀b.com/", "http://b.com", None, ""]
    got, want = (with_parts(urls(odd), pushable=p).orderBy("url_id").collect() for p in (True, False))
    assert got == want


def test_long_rules(spark, urls):
    rules = suffix_rules(spark, "com\nb.c.d.e.f\n")
    got = with_parts(urls(["http://x.a.b.c.d.e.f/", "http://x.y.com/"]), rules=rules).orderBy("url_id").collect()
    assert [(r["suffix"], r["registered"]) for r in got] == [("b.c.d.e.f", "a.b.c.d.e.f"), ("com", "y.com")]


def test_a_label_without_ascii_form_is_set_aside(spark):
    homes = spark.createDataFrame([("long", "o" * 58 + ".com"), ("paypal", "paypal.com")], "name string, home string")
    out = rejected(homes).collect()
    assert out and {r["name"] for r in out} == {"long"} and all(not r["made"].isascii() for r in out)
    made = lookalikes(homes, official=())
    assert {r["name"] for r in made.select("name").distinct().collect()} == {"long", "paypal"}
    assert made.where(F.col("url").contains("xn--") & (F.col("name") == "paypal")).count() > 0
