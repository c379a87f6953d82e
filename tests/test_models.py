import pathlib

import pytest

from lurescan.operators import evaluate, ngrams
from lurescan.plans import check, models, persist
from lurescan.plans.storage import scratch_path
from registry.corpus import load

from .conftest import SF


@pytest.fixture(scope="module")
def detector(spark):
    table = models.prepare(load(spark, SF, "url_corpus"))
    return models.train(table, "combined", 2, s=models.Settings(rounds=6, step=0.2, boost_depth=4, bins=64, early_stop_over=100))


def test_training(detector):
    assert 0.5 <= detector.threshold <= 1 and detector.meta["cv_by_site"]["at_0.5"]["roc_auc"] > 0.85
    with pytest.raises(ValueError, match="no model of kind"):
        models.build("other", None)


def test_altered_model_is_refused(spark, detector, urls):
    folder = scratch_path(spark, "model")
    with pytest.raises(FileNotFoundError):
        persist.load(spark, folder)
    persist.save(spark, detector, folder)
    again = persist.load(spark, folder)
    df = urls(["http://paypal.com.account-verify.example/login.php", "not a url at all", "", "http://[abc"])
    a, b = ({r["url"]: (r["verdict"], r["probability"]) for r in check.check(df, d).collect()} for d in (detector, again))
    assert a == b and a["http://paypal.com.account-verify.example/login.php"][0] == "phishing"
    assert a[""] == ("invalid", None) and a["http://[abc"][0] == "invalid" and a["not a url at all"][0] != "invalid"
    parts = sorted(p for p in pathlib.Path(folder).rglob("*.parquet"))
    whole = {p: p.read_bytes() for p in parts}
    middle = len(whole[parts[0]]) // 2

    def flip():
        data = bytearray(whole[parts[0]])
        data[middle] ^= 1
        parts[0].write_bytes(data)

    def lose():
        parts[-1].unlink()

    def add():
        parts[0].with_name("part-99999-extra.parquet").write_bytes(whole[parts[0]])

    for change in (flip, lose, add):
        change()
        with pytest.raises((ValueError, FileNotFoundError)):
            persist.load(spark, folder)
        parts[0].with_name("part-99999-extra.parquet").unlink(missing_ok=True)
        for p, data in whole.items():
            p.write_bytes(data)
    assert persist.load(spark, folder).kind == detector.kind


def test_boosting_stops_early_and_says_so(detector):
    assert 1 <= detector.meta["rounds"]["features"] <= 6


def test_comparison_shares_its_parts(spark, monkeypatch):
    """Combined scores are the means of the parts, and no learner is cross-validated twice for a split."""
    table = models.prepare(load(spark, SF, "url_corpus"))
    small = models.Settings(trees=4, forest_depth=4, rounds=2, boost_depth=3, bins=32)
    runs, real = {}, models.cross_validate

    def once(table, kind, k, grouped, s):
        assert (kind, grouped) not in runs
        runs[kind, grouped] = real(table, kind, k, grouped, s)
        return runs[kind, grouped]

    monkeypatch.setattr(models, "cross_validate", once)
    rows = {(r["model"], r["split"]): r for r in models.compare(table, random=("combined",), k=2, s=small).collect()}
    assert set(runs) == {("v1", True), ("features", True), ("ngrams", True), ("features", False), ("ngrams", False)} and len(rows) == 5
    both = [{r["url_id"]: r["p"] for r in runs[x, True][0].collect()} for x in ("features", "ngrams")]
    mean = {r["url_id"]: r["p"] for r in models.mean_scores([runs[x, True][0] for x in ("features", "ngrams")]).collect()}
    assert len(mean) == table.count() and all(abs(p - (both[0][i] + both[1][i]) / 2) < 1e-12 for i, p in mean.items())


def test_metrics(spark):
    row = evaluate.metrics_at(spark.createDataFrame([(1, 0.9), (1, 0.1), (0, 0.8), (0, 0.2)], "y int, p double")).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["f1"]) == (1, 1, 1, 1, 0.5)


def test_relational_scores_equal_the_vector_model(spark, detector, urls):
    """No vector, no vocabulary on the driver or in a broadcast, and the same scores."""
    part = detector.parts["ngrams"]
    df = load(spark, SF, "url_corpus").select("url_id", "url").unionByName(urls(["", "~", "HTTP://A  B"]).selectExpr("1000000 + url_id AS url_id", "url"))
    relation = {r["url_id"]: r["p"] for r in ngrams.score(df, part.weights(spark), part.model.intercept).collect()}
    vector = {r["url_id"]: r["p"] for r in part.score(df, "p").collect()}
    assert relation.keys() == vector.keys() and max(abs(p - vector[i]) for i, p in relation.items()) < 1e-9
