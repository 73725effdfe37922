"""A permuted column moves over all rows; a composite without its sources is an error."""

import pytest
from pyspark.sql import functions as F

from panelmill.operators import evaluate as E
from panelmill.plans import frames as FR

SF = "/root/testdata/sf0.001"


def test_values_move_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(E, "SHUFFLE_ROWS", 10, raising=False)
    d = spark.range(2000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).alias("other"))
    out = E.permute_column(d, ["k"], "v")
    rows = out.select("k", "v", "other").collect()
    assert sorted(out.columns) == ["k", "other", "v"] and len(rows) == 2000
    assert sorted(r.k for r in rows) == sorted(int(r.v) for r in rows) == list(range(2000))
    bucket = lambda c: F.pmod(F.xxhash64(F.lit(0), F.col(c).cast("long")), F.lit(200))
    assert out.where(bucket("k") != bucket("v")).count() > 1900


def test_composites_need_their_sources(spark, monkeypatch):
    seen, whole = [], FR.combined_frame
    monkeypatch.setattr(FR, "combined_frame", lambda *a, **kw: seen.append(a) or whole(*a, **kw))
    import __spark_entry__ as entry

    out = entry.queries()["d14_combined_frame"](spark, SF)
    assert "premium" in out.columns
    with pytest.raises(ValueError, match="intl_"):
        whole(*seen[0])
