"""Learners' jobs carry short plans: rows' features are checkpointed, forests keep each row's node."""

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelmill.operators import models as ML


def rows(spark):
    return spark.range(400).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("c"), (F.sin("id") + F.col("id") % 17 / 8).alias("y"), F.col("id").alias("n"))


def checkpointed(df) -> bool:
    text = df._jdf.queryExecution().logical().toString()
    return text.startswith("LogicalRDD") and df.columns[0] == "_features"


def test_forests_keep_nodes(spark):
    assert ML.learner("forest", "y", "pred").getCacheNodeIds() is True


def test_boosted_fits_read_checkpointed_features(spark, monkeypatch):
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df, params=None: seen.append(df) or fit(self, df, params))
    x = rows(spark)
    m = ML.fit(x, "boosted", ["a"], ["c"], "y", trees=3)
    assert len(seen) == 1 and checkpointed(seen[0])
    got = ML.score(m, x)
    assert got.columns == ["a", "c", "y", "n", "pred"] and got.count() == 400


def test_classifiers_share_their_features(spark, monkeypatch):
    monkeypatch.setitem(ML.BOOST, "trees", 2)
    monkeypatch.setitem(ML.FOREST, "trees", 3)
    seen = []
    for c in (RandomForestClassifier, GBTClassifier):
        monkeypatch.setattr(c, "fit", lambda self, df, params=None, fit=c.fit: seen.append((self, df)) or fit(self, df, params))
    out = ML.classify(rows(spark), ["a"], ["c"], "y", F.col("n") < 300, F.col("n") >= 300)
    assert out.count() == 100 and {"three_way", "up", "ordinal", "label"} <= set(out.columns) and not [c for c in out.columns if c.startswith("_")]
    assert len(seen) == 4 and all(df is seen[0][1] for _, df in seen) and checkpointed(seen[0][1])
    assert [e.getCacheNodeIds() for e, _ in seen if isinstance(e, RandomForestClassifier)] == [True]
