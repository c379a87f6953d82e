"""How work is cut into tasks and run side by side when tables grow."""

import threading

import numpy as np
import pytest

from lurescan.operators import ngrams
from lurescan.plans import models


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://site{i}.example.org/{'login' if i % 3 else 'a'}/{i}", "phishing" if i % 2 else "legitimate") for i in range(120)]
    return spark.createDataFrame(rows, "url_id bigint, url string, status string")


def test_grams_are_counted_in_tasks_of_bounded_length(pages, monkeypatch):
    vocabulary = ngrams.vocabulary(pages)
    key = ["url_id", "gram"]
    whole = ngrams.tfidf(pages, vocabulary).orderBy(key).collect()
    monkeypatch.setattr(ngrams, "URLS_PER_TASK", 10)
    cut = ngrams.tfidf(pages, vocabulary)
    assert cut.rdd.getNumPartitions() == 12  # one before: their URLs are few bytes
    for a, b in zip(whole, cut.orderBy(key).collect(), strict=True):
        assert (a["url_id"], a["gram"]) == (b["url_id"], b["gram"]) and a["weight"] == pytest.approx(b["weight"])


def test_vectors_are_not_written_and_equal_the_plain_ones(spark, pages, monkeypatch):
    vocabulary = ngrams.vocabulary(pages)
    monkeypatch.setattr(models, "stable", None)  # whoever stored a table here would fail
    part = models.fit_part("ngrams", models.profile.with_label(pages), models.Settings(iterations=3), vocabulary)
    idf = dict(zip(part.terms, part.idf, strict=True))
    urls = spark.createDataFrame([("http://site1.example.org/login/1",), ("zz",), ("",)], "url string")
    for r in models.gram_vectors(urls, part.terms, part.idf).collect():
        text, found = r["url"], {}
        for n in (3, 4, 5):
            for i in range(len(text) - n + 1):
                found[text[i : i + n]] = found.get(text[i : i + n], 0) + 1
        w = np.array([(1 + np.log(found[g])) * idf[g] if g in found else 0 for g in part.terms])
        assert np.allclose(r["features"].toArray(), w / max(np.sqrt((w * w).sum()), 1e-9))


def test_fits_take_no_more_tasks_than_cores(spark):
    s, many, cores = models.Settings(), spark.range(1).repartition(64), spark.sparkContext.defaultParallelism
    tasks = [models._sized(many, n, s).rdd.getNumPartitions() for n in (100, 40_000, 2_400_000, 40_000_000)]
    assert tasks == [1, 2, cores, 20]  # 64 of the third before: each sent all sums of every round


def test_features_are_made_in_tasks_of_bounded_length(pages, monkeypatch):
    monkeypatch.setattr(models, "ROWS_PER_TASK", 20)
    table = models.prepare(pages)
    assert len(table.inputFiles()) >= 6 and table.count() == 120  # one file, so one task, before


def test_learners_are_fitted_side_by_side(spark, monkeypatch):
    def together(n, result):
        meet = threading.Barrier(n)

        def run(*args, **kwargs):
            meet.wait(timeout=20)  # breaks when one waits for the other's end
            return result

        return run

    monkeypatch.setattr(models, "fit_part", together(2, "fitted"))
    assert models.build("combined", None).parts == {"features": "fitted", "ngrams": "fitted"}
    oof = spark.createDataFrame([(i, "u", i % 2, 0, 0.1 + 0.2 * i) for i in range(4)], "url_id bigint, url string, y int, fold int, p double")
    monkeypatch.setattr(models, "cross_validate", together(6, (oof, 1.0)))
    rows = models.compare(None).collect()
    assert [(r["model"], r["split"]) for r in rows] == [(m, "by site") for m in ("v1", "features", "ngrams", "combined")] + [(m, "random") for m in ("v1", "combined")]
    meet = threading.Barrier(2)
    monkeypatch.setattr(models, "build", lambda *a: meet.wait(timeout=20) and None or models.Detector("v1", {}))
    monkeypatch.setattr(models, "cross_validate", lambda *a: (meet.wait(timeout=20) and None or oof, 1.0))
    table = models.add(oof, {"site": "url"})
    assert models.train(table, "v1").kind == "v1"


def test_grams_are_looked_up_once_for_all_folds(spark, pages, monkeypatch):
    table = models.add(models.profile.with_label(pages), {"site": "url"})
    seen, real = [], models.fit_part

    def fit(part, train, s, vocabulary):
        assert {"_ids", "_tf"} <= set(train.columns) and "_grams" not in train.columns  # each fold's passes did it before
        seen.append((part, train, vocabulary))
        return real(part, train, s, vocabulary)

    monkeypatch.setattr(models, "fit_part", fit)
    oof, _ = models.cross_validate(table, "ngrams", 2, True, models.Settings(iterations=3))
    assert oof.count() == 120 and len(seen) == 2
    for _, train, v in seen:
        by_id = {r["url"]: r["features"] for r in models.gram_vectors(train, v.terms, v.idf, v.places).collect()}
        plain = {r["url"]: r["features"] for r in models.gram_vectors(train.select("url"), v.terms, v.idf).collect()}
        assert by_id == plain and len(plain) > 20


def test_fits_side_by_side_keep_no_more_vectors_than_fit():
    order, go = [], threading.Event()

    def first():
        with models._cells(80, 100):
            order.append("first in")
            go.wait(timeout=20)
            order.append("first out")

    def second():
        with models._cells(30, 100):
            order.append("second in")

    a, b = threading.Thread(target=first), threading.Thread(target=second)
    a.start()
    while not order:
        pass
    with models._cells(20, 100):  # fits beside the first
        order.append("small in")
    b.start()
    b.join(timeout=0.3)
    go.set()
    a.join(), b.join(timeout=20)
    assert order == ["first in", "small in", "first out", "second in"]
    with models._cells(500, 100):  # alone, any size goes
        pass


def test_out_of_time_scores_a_shared_learner_once(spark, pages, monkeypatch):
    table = models.prepare(pages)
    s = models.Settings(trees=4, forest_depth=4, rounds=3, boost_depth=3, bins=32, iterations=3)
    both = models.build("combined", table, s)
    kinds = {"v1": models.build("v1", table, s), "combined": both, "ngrams": models.Detector("ngrams", {"ngrams": both.parts["ngrams"]}, {"threshold": 0.6})}
    urls = pages.selectExpr("IF(url_id % 3 = 0, 'a', 'b') AS source", "url").unionByName(spark.createDataFrame([("a", "http://[abc"), ("b", ""), ("b", None), (None, "http://x.org")], "source string, url string"))
    parses, scores, parse, score = [], [], models.with_parts, models.GramModel.score
    plain = {(n, r["source"], r["threshold"]): (r["n"], r["reached"], r["share"]) for n, d in kinds.items() for r in models.evaluate.share_at(d.score_urls(urls), sorted({0.5, d.threshold})).collect()}
    monkeypatch.setattr(models, "with_parts", lambda df: parses.append(1) or parse(df))
    monkeypatch.setattr(models.GramModel, "score", lambda *a: scores.append(1) or score(*a))
    found = {(r["model"], r["source"], r["threshold"]): (r["n"], r["reached"], r["share"]) for r in models.out_of_time(kinds, urls).collect()}
    assert found == plain and len(found) == 12
    assert (len(parses), len(scores)) == (1, 1)  # three and two before
