"""Queries run the stated job: settings, seeds, columns and ranges."""

import os

import pytest
from pyspark.ml.regression import GBTRegressor

import __spark_entry__ as entry
from panelmill.operators import models as ML
from panelmill.plans import queries_models as Q

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_learners_read_the_stated_settings(spark):
    b, f = ML.learner("boosted", "y", "p"), ML.learner("forest", "y", "p")
    assert (b.getMaxIter(), b.getStepSize(), b.getSubsamplingRate(), b.getFeatureSubsetStrategy(), b.getSeed()) == (600, 0.05, 0.8, "0.8", 42)
    assert (b.getMaxDepth(), b.getMinInstancesPerNode()) == (6, 20)
    assert (f.getNumTrees(), f.getFeatureSubsetStrategy(), f.getMaxDepth(), f.getMinInstancesPerNode()) == (100, "0.5", 30, 50)


@needs_tables
def test_queries_use_the_stated_settings(spark, monkeypatch):
    """Smaller stated settings reach every learner of the queries, so the queries set none of their own."""
    monkeypatch.setitem(ML.BOOST, "trees", 2)
    monkeypatch.setitem(ML.FOREST, "trees", 2)
    used, whole = [], ML.learner

    def seen(kind, y, pred, **kw):
        est = whole(kind, y, pred, **kw)
        used.append((kind, est.getMaxIter() if isinstance(est, GBTRegressor) else kw.get("trees"), kw.get("seed")))
        return est

    monkeypatch.setattr(ML, "learner", seen)
    q = entry.queries()
    assert q["m01_boosted_regressor"](spark, SF).columns[-1] == "pred" and used == [("boosted", 2, None)]
    assert q["m02_forest_regressor"](spark, SF).columns[-1] == "pred" and used[1:] == [("forest", None, None)]
    del used[:]
    assert {(r.a, r.b) for r in q["m28_seed_stability"](spark, SF).collect()} == {("42", "43"), ("42", "44"), ("43", "44")}
    assert used == [("boosted", 2, s) for s in (42, 43, 44)]
    del used[:]
    searched = q["m12_parameter_search"](spark, SF).cache()  # twelve settings, and the best one again for every seed
    assert searched.where("seed IS NULL").count() == 12 and {u[1] for u in used} == {2, 4}
    assert sorted(r.seed for r in searched.where("seed IS NOT NULL").collect()) == [42, 43, 44]
    assert {r.features for r in q["m27_feature_subset"](spark, SF).collect()} == {"all", "price_only", "top_50_pct"}


@needs_tables
def test_splines_take_all_columns(spark, monkeypatch):
    taken, whole = [], ML.spline_columns
    monkeypatch.setattr(ML, "spline_columns", lambda df, cols, train: taken.extend(cols) or whole(df, cols, train))
    assert entry.queries()["m04_spline_ridge"](spark, SF).columns[-1] == "pred"
    assert taken == Q.NUM
