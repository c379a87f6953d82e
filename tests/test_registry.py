"""Registered queries without SQL that no other test runs."""

from unittest.mock import MagicMock

from lurescan.plans import models
from registry import queries
from registry.queries import QUERIES


def test_brands_from_whole_documents(spark):
    rows = QUERIES["look_large_table"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {r["technique"] for r in rows} <= {"unofficial-domain", "homoglyph", "typosquat", "combosquat", "brand-in-subdomain", "brand-in-path"}


def test_model_queries_fit_the_published_sizes(monkeypatch):
    """Nothing is fitted: the calls that would fit are recorded."""
    fits = MagicMock()
    for name in ("build", "cross_validate", "compare", "train", "fit_part", "out_of_time"):
        monkeypatch.setattr(models, name, getattr(fits, name))
    fits.cross_validate.return_value = (MagicMock(), 0.0)
    for name in ("_table", "corpus", "load", "scratch_path", "persist", "folds", "importance", "checking"):
        monkeypatch.setattr(queries, name, getattr(fits.other, name))
    for name in ("fit_v1", "fit_features", "fit_ngrams", "fit_combined", "oof_scores", "model_comparison", "train_save_load", "check_with_model", "out_of_time", "perm_importance"):
        QUERIES[name](MagicMock(), "")
    calls = [c for n in ("build", "cross_validate", "compare", "train", "fit_part") for c in getattr(fits, n).call_args_list]
    assert len(calls) == 11
    assert all(models.Settings() in (*c.args, *c.kwargs.values()) for c in calls)
    assert fits.cross_validate.call_args.args[2] == 5
    # folds, comparison rows and repeats are left at the published defaults: 5 folds, six rows, 5 repeats
    assert set(fits.compare.call_args.kwargs) == {"s"} and len(fits.compare.call_args.args) == 1
    assert set(fits.train.call_args.kwargs) == {"s"} and fits.train.call_args.args[1:] == ("combined",)
    assert len(fits.other.importance.permutation_importance.call_args.args) == 2
