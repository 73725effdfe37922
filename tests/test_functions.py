import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import fixed_values as V
from panelmill.functions import scalars as S
from panelmill.functions import text as T
from panelmill.functions.quantiles import average_ranks, exact_quantiles, nnls_weights, ordered_chunks, value_cell


def test_parse_number(spark):
    df = spark.createDataFrame([("1,234",), ("",), ("-",), ("None",), (" 5 ",), ("abc",), (None,), ("NaN",)], "s string")
    assert [r[0] for r in df.select(S.parse_number("s")).collect()] == [1234.0, None, None, None, 5.0, None, None, None]


def test_parse_date(spark):
    df = spark.createDataFrame([("20200229", "202002", "2020.02"), ("20210229", "2020xx", ""), (None, None, None)], "a string, b string, c string")
    r = df.select(S.parse_date("a"), S.parse_date("b", "yyyyMM"), S.parse_date("c", "yyyy.MM")).collect()
    assert [str(x) for x in r[0]] == ["2020-02-29", "2020-02-01", "2020-02-01"]
    assert list(r[1]) == [None, None, None] and list(r[2]) == [None, None, None]


def test_iso_week_keeps_calendar_year(spark):
    r = spark.sql("select date'2021-01-01' d").select(S.iso_week("d"), F.year("d")).first()
    assert tuple(r) == (53, 2021)


def test_shown_probability_rounds_half_even(spark):
    df = spark.createDataFrame([(0.5,), (0.005,), (-0.5,)], "p double")
    got = [r[0] for r in df.select(S.shown_probability("p", 0.625, 0.0, 0.9)).collect()]
    assert got[0] == pytest.approx(0.62) and got[1] is None and got[2] == pytest.approx(0.62)


@pytest.mark.parametrize("hot", [10**9, 5])
def test_quantiles_usual_and_spread_paths_agree(spark, hot):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.integers(0, 4, 400).astype(str), "v": np.round(rng.normal(0, 50, 400), 1)})
    pdf.loc[pdf.k == "3", "v"] = 7.0
    df = spark.createDataFrame(pdf)
    got = {r.k: (r.a, r.b) for r in exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.99}, hot_rows=hot).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx((g.v.median(), g.v.quantile(0.99)))


def test_global_quantile_and_cell_order(spark):
    v = [-3.5, -1e-9, 0.0, 1e-9, 0.2, 0.2, 5.0, 1e12]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median(v))
    cells = [r[0] for r in df.orderBy("v").select(value_cell("v")).collect()]
    assert cells == sorted(cells)


def test_average_ranks_match_pandas(spark):
    rng = random.Random(1)
    pdf = pd.DataFrame({"k": [rng.choice("ab") for _ in range(200)], "v": [float(rng.randint(-5, 5)) for _ in range(200)]})
    got = {(r.k, r.v): r["rank"] for r in average_ranks(spark.createDataFrame(pdf), ["k"], "v").collect()}
    pdf["r"] = pdf.groupby("k").v.rank()
    assert all(got[(r.k, r.v)] == r.r for r in pdf.itertuples())


def test_ordered_chunks_with_one_frequent_value(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"size": np.r_[np.full(700, 0.05), rng.uniform(0.01, 0.3, 555)], "hit": rng.integers(0, 2, 1255).astype(float)})
    o = pdf.sort_values(["size", "hit"]).reset_index(drop=True)
    o["chunk"] = np.minimum(o.index // 100, len(o) // 100 - 1)
    want = o.groupby("chunk").agg(n=("hit", "size"), h=("hit", "mean"), m=("size", "median"))
    got = ordered_chunks(spark.createDataFrame(pdf), "size", "hit", 100).toPandas().sort_values("chunk")
    assert (got.n.values == want.n.values).all()
    assert np.allclose(got.hit_rate, want.h) and np.allclose(got.median_value, want.m)


def test_nnls_matches_grid():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 3))
    y = a @ np.array([0.7, 0.0, 0.3]) - 0.2 * a[:, 1] + rng.normal(0, 0.01, 300)
    w = nnls_weights((a.T @ a).tolist(), list(a.T @ y))
    assert w[1] == 0.0 and w[0] == pytest.approx(0.7, abs=0.05)


# ---- dish names against a plain reading of the rules

def plain_menu(t):
    quoted = re.findall(V.TITLE_QUOTED, t)
    body = re.sub(V.TITLE_ASIDE, " ", t)
    for part in [*quoted, body, t]:
        words = [w for w in re.split(V.TITLE_SPLIT, part) if w and not w.isdigit()]
        cores = [re.sub(V.TITLE_NOISE, "", w) for w in words]
        for i, c in enumerate(cores):
            if len(c) < 2 or not c.endswith(V.DISH_WORDS) or c in V.NOT_DISH:
                continue
            before = cores[i - 1] if i else ""
            after = cores[i + 1] if i + 1 < len(cores) else ""
            return before + c if c in V.DISH_WORDS and len(before) >= 2 else c + after if after in V.DISH_WORDS else c
    return None


def test_menu_names(spark):
    fixed = ["팽이버섯 덮밥 만들기", "'된장찌개' 끓이는법", "[백종원] 두부조림 레시피", "콩나물 무침", "여름 보관법", "123 456", "간단 야채 볶음밥", "초간단 황금레시피", "#자취 (혼밥) 계란말이", "국 끓이는 법", ""]
    rng = random.Random(5)
    bits = ["초간단", "팽이버섯", "덮밥", "국", "'김치전'", "[영상]", "콩나물", "무침", "볶음밥", "2024", "만들기", "야채", "#태그", "<떡볶이>", "설탕", "소고기", "무국"]
    titles = fixed + [" ".join(rng.choices(bits, k=rng.randint(1, 6))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", T.menu_name("t").alias("m")).collect()}
    assert [got[i] for i in range(len(titles))] == [plain_menu(t) for t in titles]


def test_clean_ingredient(spark):
    rows = ["대파 (흰부분)", " 냉동 새우[손질] 약간", "다진 마늘 적당량", "국산 콩 또는 팥", "양 파", "기호에 따라"]
    want = ["대파", "새우", "다진마늘", "콩", "양파", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string")
    assert [r[0] for r in df.orderBy("i").select(T.clean_ingredient("s")).collect()] == want
