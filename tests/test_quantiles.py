"""Exact quantiles of odd values, through buffers and through cells, and how often the input is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.functions.quantiles import exact_median, exact_quantiles, value_cell

RNG = np.random.default_rng(11)
GROUPS = {
    "inside one part in a thousand": 100 + RNG.random(5000) * 1e-3,
    "below 1e-9": RNG.random(5000) * 1e-9 - 3e-10,
    "negative": -np.exp(RNG.normal(size=5000) * 4),
    "all equal": np.full(5000, 0.1),
    "two values": np.repeat([1.0, np.nextafter(1.0, 2)], [2500, 2501]),
    "wide": np.concatenate([RNG.normal(size=2000) * 1e300, RNG.normal(size=2000) * 1e-300, np.zeros(1000)]),
    "single": np.array([7.5]),
}
PROBS = {"low": 0.01, "median": 0.5, "high": 0.99, "least": 0.0, "most": 1.0}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(k, float(v)) for k, vs in GROUPS.items() for v in vs] + [("single", None), (None, 1.0)]
    return spark.createDataFrame(rows, "k string, v double").repartition(4)


@pytest.mark.parametrize("buffer_rows", [10, 4999, 1_000_000])
def test_quantiles_of_odd_groups(values, buffer_rows):
    got = {r.k: r for r in exact_quantiles(values, ["k"], "v", PROBS, hot_rows=buffer_rows).collect()}
    assert set(got) == set(GROUPS)
    for k, vs in GROUPS.items():
        want = np.quantile(vs, list(PROBS.values()))
        assert np.allclose([got[k][n] for n in PROBS], want, rtol=1e-12, atol=0), k


def test_quantiles_without_keys_and_of_nothing(values):
    every = np.concatenate([*GROUPS.values(), [1.0]])
    got = exact_quantiles(values, [], "v", PROBS).first()
    assert np.allclose([got[n] for n in PROBS], np.quantile(every, list(PROBS.values())), rtol=1e-12, atol=0)
    assert exact_median(values.limit(0), ["k"], "v", "m").count() == 0


def test_cells_keep_the_order(spark):
    v = np.unique(np.concatenate([*GROUPS.values(), [5e-324, -5e-324, 1.7e308, -1.7e308]])).tolist()
    df = spark.createDataFrame([(x,) for x in [float("-inf"), *v, float("inf"), float("nan")]], "v double")
    cells = [r[0] for r in df.coalesce(1).select(value_cell("v")).collect()]
    assert cells == sorted(cells)


def test_the_input_is_read_once(spark, values):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = values.count()
    exact_median(values.mapInArrow(count, "k string, v double"), ["k"], F.col("v") * 2, "m", hot_rows=10).collect()
    assert seen.value == n


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_groups_stay_out_of_the_buffers(spark):
    """Where most rows are in groups of one or two, their least and largest value give the quantiles."""
    inf, nan = float("inf"), float("nan")
    groups = {0: [3.0], 1: [1.0, 2.0], 2: [0.1, 0.3], 3: [5.0, 5.0], 4: [4.0, -inf], 5: [nan, 1.0], 6: [inf, inf], 7: [0.0, -7.5], 8: [1.0, 2.0, 10.0], **{k: [float(k)] for k in range(9, 40)}}
    df = spark.createDataFrame([(k, x) for k, vs in groups.items() for x in vs] + [(1, None), (None, 8.0)], "k int, v double")
    got = exact_quantiles(df, ["k"], "v", PROBS)
    want = df.where("k is not null").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in PROBS.items()])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    alone = exact_quantiles(df.where("k <> 8"), ["k"], "v", PROBS)
    assert "percentile" in plan_of(got) and "percentile" not in plan_of(alone) and alone.count() == 39
    mixed = df.unionByName(spark.range(3000).selectExpr("100 k", "cast(id as double) v"))  # most rows in one group: one way for all
    assert plan_of(exact_median(mixed, ["k"], "v", "m")).count("Join") == 0
    hot = {r.k: r.m for r in exact_median(df, ["k"], "v", "m", hot_rows=2).collect()}
    assert len(hot) == 40 and hot[8] == 2.0 and hot[1] == 1.5
