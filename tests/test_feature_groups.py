"""Time trends, group shares, shared permutation and one column per concept, against plain versions."""

import datetime as dt

from pyspark.sql import functions as F

from panelmill.functions.scalars import pick
from panelmill.operators import evaluate as E
from panelmill.operators import profile as P


def test_time_trends_per_column(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]
    rows = [(d, s, float(i * i + s), float((i * 7) % 11), 5.0, None, float(-i) if i % 2 else None) for i, d in enumerate(days) for s in (0, 1)] + [(None, 0, 9e9, 1.0, 1.0, 1.0, 1.0)]
    x = spark.createDataFrame(rows, "date date, s int, up double, wave double, flat double, none double, odd double")
    got = {r.column: (r.days, r.rho, r.trending) for r in P.time_trends(x, "date", ["up", "wave", "flat", "none", "odd"]).collect()}
    assert got["up"] == (40, 1.0, True) and got["odd"][0] == 20 and abs(got["odd"][1] + 1) < 1e-12 and got["odd"][2]
    assert got["wave"][0] == 40 and abs(got["wave"][1]) < 0.3 and not got["wave"][2]
    assert got["flat"] == (40, None, False) and got["none"] == (0, None, False)
    assert {r.trending for r in P.time_trends(x.limit(0), "date", ["up"]).collect()} == {False}


def test_group_shares(spark):
    imp = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None), ("d", 4.0)], "column string, importance double")
    got = {r.group: (r.n_columns, r.importance, r.share) for r in E.group_shares(imp, pick({"a": "x", "b": "x", "c": "y"}, "column")).collect()}
    assert got == {"x": (2, 4.0, 50.0), "y": (1, 0.0, 0.0), "other": (1, 4.0, 50.0)}
    none = E.group_shares(imp.withColumn("importance", F.lit(0.0)), F.lit("x")).collect()
    assert [(r.n_columns, r.share) for r in none] == [(4, None)]


def test_columns_of_a_group_move_together(spark):
    x = spark.range(1000).select("id", (F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"), (-F.col("id")).alias("c"))
    got = E.permute_column(x, ["id"], ["a", "b"]).select("id", "a", "b", "c").collect()
    assert len(got) == 1000 and sorted(r.a for r in got) == [2 * i for i in range(1000)]
    assert all(r.b == r.a + 1 and r.c == -r.id for r in got) and sum(r.a != 2 * r.id for r in got) > 900


def test_one_column_per_concept(spark):
    imp = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.9), ("d", 0.1)], "column string, importance double")
    got = {r.column: (r.concept, r.kept, r.keep) for r in P.keep_one_per_concept(imp, pick({"a": "x", "b": "x", "c": "y", "d": "y"}, "column")).collect()}
    assert got == {"a": ("x", "a", True), "b": ("x", "a", False), "c": ("y", "c", True), "d": ("y", "c", False)}
