import random

from lurescan.operators import evaluate, folds
from lurescan.operators.skew import per_distinct


def test_threshold_property(spark):
    benign = spark.createDataFrame([(0, i / 100) for i in range(101)], "y int, p double")
    t = evaluate.threshold_for_fpr(benign, 0.05).first()["threshold"]
    share = lambda x: sum(i / 100 >= x for i in range(101)) / 101
    assert share(t) <= 0.05 < share(t - 0.011)


def test_auc_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(400)]
    got = evaluate.roc_auc(spark.createDataFrame(rows, "y int, p double")).first()["roc_auc"]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-6


def test_folds(spark):
    df = spark.createDataFrame([(i, f"u{i}", f"s{i % 37}", int(i % 3 == 0)) for i in range(500)], "url_id int, url string, site string, y int")
    by_site = folds.by_site(df).groupBy("site").agg({"fold": "min"}).count()
    assert by_site == 37 and folds.by_site(df).select("site", "fold").distinct().count() == 37
    sizes = {(r["y"], r["fold"]): r["count"] for r in folds.stratified(df).groupBy("y", "fold").count().collect()}
    assert len(sizes) == 10 and all(max(v) - min(v) <= 1 for v in ([n for (c, _), n in sizes.items() if c == y] for y in (0, 1)))


def test_hot_keys_join_back(spark):
    rows = [("hot" if i % 3 else f"k{i}",) for i in range(300)] + [(None,)] * 5
    for bound in (1, 1000):
        out = per_distinct(spark.createDataFrame(rows, "k string"), "k", {"n": "length(k)"}, hot_keys=bound).collect()
        assert len(out) == 305 and all(r["n"] == (len(r["k"]) if r["k"] is not None else None) for r in out)
