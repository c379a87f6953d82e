"""Odd scores, files and brand tables."""

import pytest

from lurescan.operators.evaluate import roc_auc, threshold_for_fpr
from lurescan.sources.readers import labelled_csv


def test_one_class_group_does_not_fail_the_others(spark):
    scores = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.5)], "g string, y int, p double")
    assert {r.g: r.roc_auc for r in roc_auc(scores, ("g",)).collect()} == {"a": 1.0, "b": None}


def test_missing_scores_are_not_benign(spark):
    rows = [(0, 0.1), (0, 0.6), (0, 0.7), (0, 0.8)]
    plain = threshold_for_fpr(spark.createDataFrame(rows, "y int, p double"), 0.25).first()
    more = threshold_for_fpr(spark.createDataFrame(rows + [(0, None)] * 12, "y int, p double"), 0.25).first()
    assert plain == more


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,status,url\n1,phishing,"http://a/,b"\n2,legitimate,\n')
    assert [tuple(r) for r in labelled_csv(spark, str(tmp_path / "a.csv")).collect()] == [("http://a/,b", "phishing"), (None, "legitimate")]
    (tmp_path / "b.csv").write_text("link,status\nx,phishing\n")
    with pytest.raises(ValueError):
        labelled_csv(spark, str(tmp_path / "b.csv"))
