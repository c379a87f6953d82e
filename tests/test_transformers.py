"""Feature stages inside a pipeline that is saved and loaded."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from lurescan import dims
from lurescan.operators.features import extract, v1_features
from lurescan.plans.storage import scratch_path
from lurescan.plans.transformers import URLFeatures, V1Features
from registry.corpus import load

from .conftest import SF


@pytest.fixture(scope="module")
def urls_(spark):
    return load(spark, SF, "url_corpus").selectExpr("url_id", "url AS address", "CAST(status = 'phishing' AS DOUBLE) AS label")


def test_pipeline_round_trip(spark, urls_):
    names = [n for n in dims.FEATURES if n != "brand_similarity"]
    stages = [URLFeatures(inputCol="address", names=names), VectorAssembler(inputCols=names, outputCol="features"), LogisticRegression(maxIter=5)]
    model = Pipeline(stages=stages).fit(urls_)
    folder = scratch_path(spark, "pipeline")
    model.write().save(folder)
    again = PipelineModel.load(folder)
    assert again.stages[0].getNames() == names and again.stages[0].getInputCol() == "address"
    a, b = (sorted(map(str, m.transform(urls_).select("url_id", "probability").collect())) for m in (model, again))
    assert a == b and len(a) == urls_.count()


def test_stages_give_what_the_operators_give(urls_):
    want = sorted(map(str, extract(urls_, "address").collect()))
    for per_host in (False, True):
        assert sorted(map(str, URLFeatures(inputCol="address", perHost=per_host).transform(urls_).collect())) == want
    got = V1Features(inputCol="address").transform(urls_)
    assert sorted(map(str, got.collect())) == sorted(map(str, v1_features(urls_, "address").select(*got.columns).collect()))


def test_unknown_feature():
    with pytest.raises(ValueError, match="no such features: colour"):
        V1Features(names=["colour"])
