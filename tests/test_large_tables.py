"""Steps that grew too dear with the tables: their results on odd rows, and how often they do their work."""

import random

from pyspark.sql import functions as F

from panelmill.functions import fixed_values as V
from panelmill.functions import scalars as S
from panelmill.operators import menu as M
from panelmill.operators import models as ML
from panelmill.plans import queries_graph as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_parsed_without_patterns(spark):
    texts = ["1,234.5", " 5 ", "\t7\n", ",", "-", "--1", "None", "nan", "NaN", "inf", "-Infinity", "1e400", "1e3", "1d", "0x10", "١", "", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    x = df.select("i", S.parse_number("s").alias("v"))
    assert [r.v for r in x.orderBy("i").collect()] == [1234.5, 5.0, 7.0, None, None, None, None, None, None, None, None, None, 1000.0, 1.0, None, None, None, None, None]
    assert "regexp_replace" not in plan(x) and " IN (" not in plan(x)


def test_finite(spark):
    df = spark.createDataFrame([(0, 1.5), (1, float("nan")), (2, float("inf")), (3, float("-inf")), (4, None), (5, -0.0)], "i int, v double")
    assert [r.v for r in df.select("i", S.finite("v").alias("v")).orderBy("i").collect()] == [1.5, None, None, None, None, 0.0]


def small_tables(spark, folder):
    d = "timestamp'1996-01-01' + make_dt_interval(cast(id * 3 % 700 AS int))"
    rows = {
        "lineitem": spark.range(400).selectExpr("id % 20 AS l_partkey", "id % 5 AS l_suppkey", f"{d} AS l_shipdate", "substr('ANR', cast(id % 3 AS int) + 1, 1) AS l_returnflag", "substr('FO', cast(id % 2 AS int) + 1, 1) AS l_linestatus",
                                                "cast(id % 7 + 1 AS double) AS l_quantity", "cast(id % 11 + 5 AS double) AS l_extendedprice", "id AS l_orderkey", "0.0D AS l_discount", "0.0D AS l_tax", "1 AS l_linenumber"),
        "part": spark.range(20).selectExpr("id AS p_partkey", "concat('T', id % 3) AS p_type", "concat('B', id % 4) AS p_brand", "'n m' AS p_name", "cast(id % 6 AS int) AS p_size"),
        "supplier": spark.range(5).selectExpr("id AS s_suppkey", "id % 2 AS s_nationkey"),
        "nation": spark.range(2).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "id AS n_regionkey"),
        "region": spark.range(2).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name"),
        "orders": spark.range(400).selectExpr("id AS o_orderkey", f"{d} AS o_orderdate", "element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'), cast(id % 5 AS int) + 1) AS o_orderpriority", "cast(id AS double) AS o_totalprice"),
    }
    for name, df in rows.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_crop_sources_are_stored(spark, tmp_path):
    sources = Q.agri_tables(spark, small_tables(spark, tmp_path)).sources
    shared = ["prices", "items", "stations", "weather", "fx", "macro", "imports", "trades", "origins", "production", "alias", "station_region"]
    assert [n for n in shared if "Exchange" in plan(sources[n])] == []


def test_wholesale_rows_are_made_once(spark, tmp_path):
    from panelmill.plans import catalog

    x = catalog.QUERIES["d02_wholesale_market_median"](spark, small_tables(spark, tmp_path))
    assert "lineitem" not in plan(x)  # days and medians come from the stored distinct rows


def test_ingredients_are_cleaned_once(spark):
    rows = [(1, "[]", "파(대파), 양파 약간,,냉동 참치"), (1, "[]", "양파,  두부 "), (2, '[["무", "1개"], [null, "2"], ["(x)", "1"]]', "당근"), (3, None, None), (None, "[]", "감자♣감자"), (4, "bad", "마늘 : 파")]
    df = spark.createDataFrame(rows, "recipe_id int, ingredients string, ingredients_text string")
    x = M.recipe_ingredients(df)
    got = {(r.recipe_id, r.ingredient, r.pos, r.raw) for r in x.collect()}
    assert got == {(1, "파", 0, "파(대파)"), (1, "양파", 0, "양파"), (1, "참치", 3, "냉동 참치"), (1, "두부", 1, "두부"), (2, "무", 0, "무"), (None, "감자", 0, "감자"), (4, "마늘", 0, "마늘"), (4, "파", 1, "파")}
    assert plan(x.select("recipe_id", "ingredient", "pos")).count(V.ING_TAIL[:6]) == 1


def test_best_rows(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", None, "c"]), rnd.choice([None, 0.0, 1.0, 2.0]), rnd.randrange(4), "t%d" % i) for i in range(200)] + [(900, "only", None, 1, "x")]
    df = spark.createDataFrame(rows, "id int, menu string, score double, h int, name string")
    got = {r.menu: (r.score, r.h) for r in M.best_rows(df, "menu", ["score", "h"]).collect()}
    low = lambda v: -1.0 if v is None else v
    want = {m: max(((s, h) for _, k, s, h, _ in rows if k == m), key=lambda p: (low(p[0]), p[1])) for m in {r[1] for r in rows}}
    assert got == want
    assert M.best_rows(df, "menu", ["score", "h"]).columns == df.columns


def test_learners_are_set_up_in_order(spark, monkeypatch):
    used = []
    monkeypatch.setattr(ML, "learner", lambda kind, y, pred, **kw: used.append(kw["seed"]))
    jobs = [ML.fitting(spark.range(1), "forest", [], [], "y", seed=s) for s in range(20)]
    assert used == list(range(20)) and all(callable(j) for j in jobs)


def test_few_fences_do_not_deal_the_changes_by_domain(spark):
    """A fence has a row a domain: the changes stay where they are, also when estimates of its query are large."""
    from panelmill.operators import repair as R

    x = spark.range(4000).select((F.col("id") % 2).alias("d"), (F.col("id") % 40).alias("market"), F.expr("date_add(DATE '1999-01-01', CAST(id / 40 AS INT))").alias("day"),
                                 (F.lit(10.0) + F.col("id") * 7919 % 13).alias("price"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
        out = R.fence_flags(x, ["d", "market"], "day", "price", "1999-12-31", ["d"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(d" not in plan
        assert out.count() == 4000 and out.where("outside IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_all_settings_of_a_search_are_fitted_at_once(spark):
    """Each job waits for the eleven others, so a second round of fits would break the barrier."""
    from threading import Barrier

    met = Barrier(12, timeout=20)
    assert sorted(ML.side_by_side(spark, [met.wait] * 12)) == list(range(12))
