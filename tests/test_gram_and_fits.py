"""Additive ridge models against numpy, and fits that run side by side."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import gram
from panelmill.operators import models as ML

COLS = ["a", "b", "c"]


def plain_ridge(x, y, penalty):
    """Mean-filled, centred, penalty on standardised columns."""
    mean = np.array([np.nanmean(v) if np.isfinite(v).any() else 0.0 for v in x.T])
    z = np.where(np.isnan(x), 0.0, x - mean)
    size = np.sqrt((z * z).sum(0))
    live = size > 0
    beta = np.zeros(x.shape[1])
    u = z[:, live] / size[live]
    beta[live] = np.linalg.solve(u.T @ u + penalty * np.eye(live.sum()), u.T @ y) / size[live]
    return lambda w: y.mean() + np.where(np.isnan(w), 0.0, w - mean) @ beta


def rows(n, groups, rng):
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.01] + [0, 1000, 5]
    x[rng.random((n, 3)) < 0.15] = np.nan
    g = rng.integers(0, groups, n)
    y = np.nan_to_num(x) @ [0.5, 0.01, 3.0] + g + rng.normal(size=n) * 0.1
    days = [dt.date(2001, 1, 1) + dt.timedelta(int(d)) for d in rng.integers(0, 5 * 365, n)]
    return [(int(i), int(k), d, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (k, d, r, t) in enumerate(zip(g, days, x, y))], x, y, g, np.array(days)


SCHEMA = "id long, g long, day date, a double, b double, c double, y double"


def test_a_thousand_groups(spark):
    data, x, y, g, _ = rows(30_000, 1000, np.random.default_rng(0))
    df = spark.createDataFrame(data, SCHEMA).withColumn("group", F.when(F.col("g") > 0, F.col("g")))  # group 0 is null
    got = gram.ridge_by_group(df, ["group"], COLS, "y", F.col("id") % 3 != 0, F.lit(True), 0.05, F.lit(-1.0), 12)
    assert got.columns == [*df.columns, "pred"]
    got = {r.id: r.pred for r in got.collect()}
    train = np.arange(len(y)) % 3 != 0
    for k in (0, 1, 17, 999):
        mine = np.flatnonzero(g == k)
        fit = mine[train[mine]]
        want = plain_ridge(x[fit], y[fit], 0.05)(x[mine]) if len(fit) >= 12 else np.full(len(mine), -1.0)
        assert np.allclose([got[int(i)] for i in mine], want, rtol=1e-7, atol=1e-7)


def test_walk_forward_sees_no_later_row(spark):
    data, x, y, _, days = rows(3000, 1, np.random.default_rng(1))
    df = spark.createDataFrame(data, SCHEMA)
    p, models = gram.walk_forward(df, "day", COLS, "y", 2003, 2005, "2001-06-01", penalty=0.1)
    got = {r.id: r.pred for r in p.collect()}
    years = np.array([d.year for d in days])
    counts = {r.fold: r.n_train for r in models.collect()}
    for fold in (2003, 2004, 2005):
        train = (days >= dt.date(2001, 6, 1)) & (days <= dt.date(fold - 1, 12, 1))
        test = np.flatnonzero(years == fold)
        assert counts[fold] == train.sum()
        assert np.allclose([got[int(i)] for i in test], plain_ridge(x[train], y[train], 0.1)(x[test]), atol=1e-8)
    # values that a fold must not see change nothing
    spoiled = df.withColumn("y", F.when(F.col("day") > "2002-12-01", F.col("y") * 1000).otherwise(F.col("y")))
    again = {r.id: r.pred for r in gram.walk_forward(spoiled, "day", COLS, "y", 2003, 2003, "2001-06-01", penalty=0.1)[0].collect()}
    assert again and all(abs(again[i] - got[i]) < 1e-9 for i in again)


def test_left_out_parts(spark):
    data, x, y, g, days = rows(2000, 2, np.random.default_rng(2))
    df = spark.createDataFrame(data, SCHEMA).withColumn("year", F.year("day"))
    got = {r.id: r.pred_oof for r in gram.leave_part_out(df, "year", COLS, "y", 0.1, ["g"]).collect()}
    years = np.array([d.year for d in days])
    for k in (0, 1):
        for year in (2001, 2004):
            rest, own = (g == k) & (years != year), np.flatnonzero((g == k) & (years == year))
            assert np.allclose([got[int(i)] for i in own], plain_ridge(x[rest], y[rest], 0.1)(x[own]), atol=1e-8)
    whole = gram.leave_part_out(df, "year", COLS, "y", 0.1)
    assert whole.count() == len(y) and whole.where("pred_oof is null").count() == 0


def test_odd_columns(spark):
    data = [(i, 0, dt.date(2001, 1, 1), float(i), 7.0, None, 2.0 * i + 1) for i in range(20)] + [(99, 0, dt.date(2001, 1, 1), 3.0, float("nan"), 1.0, None)]
    got = gram.ridge_by_group(spark.createDataFrame(data, SCHEMA), ["g"], COLS, "y", F.lit(True), F.lit(True)).collect()
    assert all(abs(r.pred - (2 * r.a + 1)) < 1e-9 for r in got)
    assert gram.ridge_by_group(spark.createDataFrame([], SCHEMA), ["g"], COLS, "y", F.lit(True), F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def panel(spark):
    data, *_ = rows(600, 3, np.random.default_rng(3))
    return spark.createDataFrame(data, SCHEMA).withColumn("kind", F.col("g").cast("string"))


def test_side_by_side_keeps_order_and_errors(spark):
    assert ML.side_by_side(spark, [lambda k=k: spark.range(k).count() for k in range(12)], 4) == list(range(12))
    with pytest.raises(ZeroDivisionError):
        ML.side_by_side(spark, [lambda: 1 // 0])


def test_fits_are_those_made_one_by_one(spark, panel):
    train, valid = F.col("id") % 4 != 0, F.col("id") % 4 == 0
    options = [{"trees": 2, "seed": 1}, {"trees": 3, "seed": 2}]
    both = {r.setting: r.rmse for r in ML.search(panel, "boosted", COLS, ["kind"], "y", train, valid, options).collect()}
    from panelmill.operators.evaluate import metrics

    for o in options:
        alone = metrics(ML.train_and_score(panel, "boosted", COLS, ["kind"], "y", train, valid, **o), "y", "pred").first()["rmse"]
        assert abs(both[repr(o)] - alone) < 1e-12
    found = ML.search_and_verify(panel, "boosted", COLS, ["kind"], "y", train, valid, [{"trees": 1}, {"trees": 4}], (42, 43)).collect()
    assert len(found) == 4 and [r.seed for r in found if r.seed] == [42, 43] and len({r.setting for r in found if r.seed}) == 1
    seeds = ML.seeds_and_scores(panel, "boosted", COLS, ["kind"], "y", train, valid, (1, 2), trees=2)
    assert seeds.where("p1 is null or p2 is null").count() == 0 and seeds.count() == 150


def test_more_groups_than_threads(spark, panel):
    wide = panel.withColumn("g", (F.col("id") % 12).cast("string")).withColumn("fallback", F.lit(-5.0))
    got = ML.per_group(wide, "ridge", COLS, ["g"], "y", "g", F.col("id") < 540, F.col("id") >= 540, "fallback", min_rows=46)
    assert got.count() == 60
    assert ML.per_group(wide, "ridge", COLS, ["g"], "y", "g", F.col("id") < 540, F.col("id") >= 540, "fallback", min_rows=40).where("pred = -5").count() == 0
