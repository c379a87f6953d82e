"""Boosting: the trees of Spark ML's learner, with a number of jobs that rounds don't set, or one per level."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lurescan import dims
from lurescan.operators.folds import hash_rank
from lurescan.plans import boost, importance, models, persist
from lurescan.plans.storage import scratch_path, stable

NAMES = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    made = [(i, r.random(), float(r.randrange(5)), r.gauss(0, 1), 0.0) for i in range(900)]
    labelled = [(*x, int(x[1] + 0.2 * x[2] + 0.3 * x[3] + r.gauss(0, 0.4) > 0.9), i % 9 == 0) for i, x in enumerate(made)]
    df = spark.createDataFrame(labelled, "id int, a double, b double, c double, d double, y int, _held boolean")
    return stable(df.coalesce(1), "boost-rows")


def learner(rounds=30, **more):
    return GBTClassifier(labelCol="y", maxIter=rounds, stepSize=0.1, maxDepth=4, maxBins=32, minInstancesPerNode=5, seed=3, validationTol=0.0, **more)


def vectors(df):
    return VectorAssembler(inputCols=list(NAMES), outputCol="features", handleInvalid="keep").transform(df)


def scores(model, df):
    return {r["id"]: r["p"] for r in model.transform(vectors(df)).select("id", vector_to_array("probability")[1].alias("p")).collect()}


@pytest.mark.parametrize("stops", [False, True])
def test_trees_are_those_of_spark_ml(spark, rows, stops):
    plain = learner(60, **({"validationIndicatorCol": "_held"} if stops else {}))
    wanted = plain.fit(vectors(rows))
    found = boost.fit(rows, NAMES, plain, stops, 1)
    a, b = scores(wanted, rows), scores(found, rows)
    assert wanted.getNumTrees == found.getNumTrees and (found.getNumTrees < 60) == stops
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9
    assert found.featureImportances.toArray() == pytest.approx(wanted.featureImportances.toArray(), abs=1e-6)
    path = scratch_path(spark, "boost-model")
    found.write().save(path)
    assert scores(type(found).load(path), rows) == b


def test_many_tasks_give_the_trees_of_one(rows):
    one = boost.fit(rows, NAMES, learner(), True, 1)
    many = boost.fit(stable(rows.repartition(3), "boost-many"), NAMES, learner(), True, 3)
    a, b = scores(one, rows), scores(many, rows)
    assert one.getNumTrees == many.getNumTrees and max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_a_lost_score_is_worked_out_again(rows, monkeypatch):
    parts = [r for r in rows.where("NOT _held").toPandas()[["a", "b", "c", "d", "y"]].to_numpy().T]
    cuts = [boost.thresholds(c, 31, len(c)) for c in parts[:4]]
    x, bins, none = boost.binned(parts[:4], cuts), [len(c) + 1 for c in cuts], (boost.np.zeros((4, 0), "uint8"), boost.np.zeros(0))
    kept = boost.Rows(x, 2 * parts[4] - 1, *none, bins)
    trees = boost.grow(lambda trees, tree, nodes: kept.answer(trees, 0.1, tree, nodes), bins, 5, 3, 0.1, 5, False)
    lost = lambda trees, tree, nodes: boost.Rows(x, 2 * parts[4] - 1, *none, bins).answer(trees, 0.1, tree, nodes)
    again = boost.grow(lost, bins, 5, 3, 0.1, 5, False)
    assert all((a.value == b.value).all() and (a.feature == b.feature).all() for a, b in zip(trees, again, strict=True))


def test_rounds_start_no_jobs(spark, rows):
    train = rows.selectExpr("CAST(id AS STRING) AS url", "y", *[f"{'abcd'[i % 4]} + {i} AS {n}" for i, n in enumerate(dims.FEATURES)])
    spark.sparkContext.setJobGroup("boosting", "boosting")
    try:
        part = models.fit_part("features", train, models.Settings(rounds=40, boost_depth=3))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert part.model.getNumTrees == 40 and jobs < 40  # 4 or more a round before


def test_odd_tables(spark, rows):
    with pytest.raises(Exception, match="no rows to fit"):
        boost.fit(rows.where("false"), NAMES, learner(), False, 1)
    with pytest.raises(Exception, match="no rows to fit"):
        boost.fit(rows.where("false"), NAMES, learner(), False, 2)
    for value in (None, float("nan")):
        with pytest.raises(Exception, match="column c must not be null"):
            boost.fit(rows.withColumn("c", F.when(F.col("id") == 5, F.lit(value)).otherwise(F.col("c"))), NAMES, learner(), False, 1)
    flat = boost.fit(rows.withColumns({n: F.lit(1.0) for n in NAMES}), NAMES, learner(3), False, 1)
    few = scores(flat, rows)
    assert len(set(few.values())) == 1 and len(few) == 900
    detector = models.Detector("features", {"features": models.TreeModel(NAMES, flat)}, {"cv": 1})
    again = persist.load(spark, persist.save(spark, detector, scratch_path(spark, "boost-detector")))
    assert again.parts["features"].model.getNumTrees == 3


def test_importance_scores_only_what_differs(spark, rows):
    """The drops are those of scoring every copy."""
    named = rows.selectExpr("id AS url_id", "y", *[n for n in NAMES])
    model = models.TreeModel(NAMES, boost.fit(rows, NAMES, learner(), False, 1))
    seen, real = [], model.model

    class Counting:
        def transform(self, df):
            seen.append(df.count())
            return real.transform(df)

    found = importance.permutation_importance(models.TreeModel(NAMES, Counting()), named, repeats=2).collect()
    # a row each, then copies: d is constant, b has five values, of the others one in 900 copies may pair a row with itself
    assert seen[0] == 900 and all(900 * 2 < n < 900 * 3 for n in seen[1:]) and len(seen) == 3
    base = {r["url_id"]: r for r in named.collect()}
    ranked = lambda s: {r["_row"]: r["url_id"] for r in hash_rank(named.select("url_id"), "_row", "url_id", s).collect()}
    mine, drops = ranked("42-row"), {n: [] for n in NAMES}
    p = scores(real, rows)

    def area(by_id):
        pairs = [(by_id[i], base[i]["y"]) for i in base]
        up, down = [x for x, y in pairs if y == 1], [x for x, y in pairs if y == 0]
        return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))

    for s in range(2):
        donors = ranked(f"42-{s}")
        for n in NAMES:
            given = [(mine[k], *[float(base[donors[k] if c == n else mine[k]][c]) for c in NAMES]) for k in mine]
            drops[n].append(area(p) - area(scores(real, spark.createDataFrame(given, "id int, a double, b double, c double, d double"))))
    assert {r["feature"]: r["drop"] for r in found} == {n: pytest.approx(sum(d) / 2, abs=2e-6) for n, d in drops.items()}
