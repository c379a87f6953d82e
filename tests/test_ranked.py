"""Running sums, k-th selection and fold vocabularies against plain Python and refits."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from lurescan.operators import evaluate, folds, ngrams
from lurescan.operators.ranked import kth_largest, largest, ranged, running
from registry.corpus import load

from .conftest import SF


def test_running_sums_per_group(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.randint(0, 9)) for g in "ab" for i in rng.sample(range(5_000), 400)]
    got = running(spark.createDataFrame(rows, "g string, k int, v int"), "k DESC", {"total": "v", "n": "1"}, ("g",), rows_per_range=50).collect()
    for g in "ab":
        mine = sorted((k, v) for x, k, v in rows if x == g)[::-1]
        want = {k: (t, i + 1) for i, ((k, _), t) in enumerate(zip(mine, accumulate(v for _, v in mine), strict=True))}
        assert {r["k"]: (r["total"], r["n"]) for r in got if r["g"] == g} == want


def test_a_million_scores_stay_in_bounded_ranges(spark):
    scores = spark.range(1_000_000).selectExpr("CAST(id % 2 AS INT) AS y", "id / 1000000 AS p")
    curve = evaluate.cumulative(scores, rows_per_range=100_000)
    # the only exchange into one task holds a row per range
    assert curve._jdf.queryExecution().executedPlan().toString().count("SinglePartition") == 1
    cut = ranged(scores, [F.desc("p")], 100_000)
    assert max(r["count"] for r in cut.groupBy("_range").count().collect()) < 200_000
    last = curve.orderBy("p").first()
    assert (last["cum_pos"], last["cum_neg"]) == (500_000, 500_000)
    # odd ids are positive and each stands just above an even one
    assert abs(evaluate.roc_auc(scores).first()["roc_auc"] - 0.500001) < 1e-9


def test_kth_largest_and_ties(spark):
    rng = random.Random(9)
    rows = [(f"g{i:05d}", rng.choice([0, 1, 2, 2, 2, 7, 5_000, 9_000_000])) for i in range(2_000)]
    df = spark.createDataFrame(rows, "gram string, n bigint").repartition(4)
    for k in (1, 3, 700, 1_500, 2_000, 2_001):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        if k <= 2_000:
            assert kth_largest(df, "n", k)[0] == want[-1][1]
        assert {tuple(r) for r in largest(df, "n", "gram", k, rows_per_range=100).collect()} == set(want)
    assert largest(df.limit(0), "n", "gram", 5).count() == 0
    plan = largest(df, "n", "gram", 700)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_fold_vocabularies_equal_refits(spark):
    urls = folds.by_site(load(spark, SF, "url_corpus").selectExpr("url_id", "url", "regexp_extract(url, '//([^/]*)', 1) AS site"))
    stored = ngrams.with_grams(urls)
    counted = ngrams.counts(stored, k=5)
    for i in (0, 3):
        rest = stored.where(F.col("fold") != i)
        n = rest.count()
        got = {tuple(r) for r in ngrams.most_frequent(ngrams.without_fold(counted, i), n, max_terms=900).collect()}
        want = {tuple(r) for r in ngrams.vocabulary(rest.drop("_grams"), max_terms=900).collect()}
        assert got == want and len(got) == 900
