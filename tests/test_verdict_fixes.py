"""Cases beyond the limits that an earlier version had."""

import math

from pyspark.sql import functions as F

from panelmill.operators import models as ML
from panelmill.operators.aggregates import price_count_pairs
from panelmill.operators.matching import prefix_pairs
from panelmill.plans.processed import BUOY, buoy_hours


def test_prefixes_of_any_length(spark):
    items = spark.createDataFrame([("a", "12345678901"), ("b", "1")], "item string, p string")
    codes = spark.createDataFrame([("123456789012345",), ("2",)], "code string")
    assert {tuple(r) for r in prefix_pairs(items, ["item"], "p", codes, "code").collect()} == {("a", "123456789012345"), ("b", "123456789012345")}


def test_price_and_count_come_from_one_row(spark):
    d = spark.createDataFrame([("x", 1, "900", "1"), ("x", 2, "1000", "2")], "id string, line int, mAmt string, mCnt string")
    assert [tuple(r) for r in price_count_pairs(d, ["id"], order="line").collect()] == [("x", "m", "900", "1")]
    assert tuple(price_count_pairs(d, ["id"]).first()) in {("x", "m", "900", "1"), ("x", "m", "1000", "2")}


def test_a_reading_beats_a_missing_one(spark):
    raw = spark.createDataFrame([("1", "2020-01-01 10:00", None, "3"), ("1", "2020-01-01 10:00", "10.0", "3")], "a string, b string, c string, d string").toDF(*BUOY)
    assert buoy_hours(raw).first().water_temp == 10.0


def test_linear_fit_fills_missing_with_the_training_mean(spark):
    rows = [(float(i), None if i % 5 == 0 else float(i % 7), None, "k", 2.0 * (i % 7) + 1) for i in range(200)]
    d = ML.model_rows(spark.createDataFrame(rows, "i double, x double, none double, cat string, y double"), ["x", "none"], ["cat"])
    m = ML.fit(d.where("i % 5 <> 0"), "ridge", ["x", "none"], ["cat"], "y", reg=0.0)
    s = ML.score(m, d)
    err = s.where("i % 5 <> 0").agg(F.max(F.abs(F.col("pred") - F.col("y")))).first()[0]
    mean = s.where("i % 5 <> 0").agg(F.avg("y")).first()[0]
    missing = s.where("i % 5 = 0").agg(F.min("pred"), F.max("pred")).first()
    assert err < 1e-6 and all(math.isclose(v, mean, rel_tol=1e-6) for v in missing)


def test_repair_sorts_by_a_number_first(spark):
    """Keys that start with a text all rows share must not lead the sorts; rows with null keys stay as they are."""
    import datetime as dt

    from panelmill.operators import repair as R

    d = [dt.date(2020, 1, k) for k in (6, 7, 8)]
    rows = [("s", m, x, p) for m in ("a", "b") for x, p in zip(d, (100.0, 300.0, 101.0))] + [("s", None, x, p) for x, p in zip(d, (100.0, 300.0, 101.0))] + [("s", "a", d[1], 310.0), ("s", "b", None, 5.0)]
    df = spark.createDataFrame(rows, "se string, m string, date date, p double")
    out = R.repair_spikes(df, ["se", "m"], "date", "p", "marked")
    got = sorted((r.m or "-", str(r.date), r.p, r.marked) for r in out.collect())
    assert out.columns == ["se", "m", "date", "p", "marked"] and len(got) == len(rows)
    assert [g[2:] for g in got if g[:2] == ("a", "2020-01-07")] == [(100.0, True)] * 2 and ("-", "2020-01-07", 300.0, False) in got and ("b", "None", 5.0, False) in got
    left = R.drop_spikes(df, ["se", "m"], "date", "p")
    assert left.columns == df.columns and left.count() == len(rows) - 3
    import re

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.repair_spikes(df, ["se", "m"], "date", "p")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sorts = re.findall(r"Sort \[(\w+)", plan)
    assert len(sorts) >= 3 and all(s.startswith("_") for s in sorts), sorts
