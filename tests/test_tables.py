import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from panelmill.functions import fixed_values as V
from panelmill.operators import cleaning as C
from panelmill.operators import decide as K
from panelmill.operators import menu as M
from panelmill.plans import dataset as DS
from panelmill.plans import frames as FR
from panelmill.plans import processed as PR
from panelmill.sources import pages as PG
from panelmill.streaming.ingest import land_new_files


def test_price_table_from_two_sources(spark):
    cols = ["exmn_ymd", *PR.PRICE_TEXT, "unit_sz", "exmn_dd_prc", "exmn_dd_cnvs_prc"]
    row = lambda **kw: tuple(kw.get(c, "x") for c in cols)
    at = [row(exmn_ymd="20200102", ctgry_cd="200", unit="포기", unit_sz="1", exmn_dd_prc="3,000", exmn_dd_cnvs_prc="-", item_nm="배추", vrty_nm="배추")] * 2 + [
        row(exmn_ymd="20140102", ctgry_cd="200", unit="kg", unit_sz="1", exmn_dd_prc="1", exmn_dd_cnvs_prc="")]
    at = spark.createDataFrame(at, ", ".join(f"{c} string" for c in cols))
    ek = spark.createDataFrame([("20170103", "4301", "소", "v1", "등심", "구분없음", "8,000"), ("20180103", "4301", "소", "v1", "등심", "1+", "9000")], "standYmd string, judgeKind string, judgeKindNm string, itemCd string, itemNm string, grdNm string, ntslPrc string")
    units = spark.createDataFrame([("배추", "포기", None, 2000.0, "k", 0)], "item_nm string, unit string, vrty_contains string, g_per_unit double, source string, line int")
    got = {r.domain: r for r in PR.price_table(at, units, second=ek).collect()}
    assert set(got) == {"agri", "livestock"}
    assert got["agri"].price_kg == 1500.0 and got["agri"].unit_g_source == "table:k" and got["agri"].price_kg_api is None
    assert got["livestock"].price_kg == 80000.0 and got["livestock"].grd_nm == "등심" and got["livestock"].date == dt.date(2017, 1, 3)


def test_calendar(spark):
    h = spark.createDataFrame([("2020-01-24", "설날 전날"), ("2020-01-25", "설날"), ("2020-10-01", "추석")], "date string, name string")
    got = {str(r.date): r for r in PR.calendar_table(h, "2020-01-20").collect()}
    assert got["2020-01-24"].days_to_seollal == 1 and got["2020-01-25"].days_to_seollal == 0 and got["2020-01-26"].days_to_seollal is None
    assert got["2020-01-25"].is_weekend and got["2020-01-25"].holiday_name == "설날" and not got["2020-01-23"].is_holiday


def test_statistics_columns_named_by_data(spark):
    df = spark.createDataFrame([("2020", "T1", "배추:생산량", "톤", "1,000", "서울", "시도별")], "PRD_DE string, ITM_ID string, ITM_NM string, UNIT_NM string, DT string, C1_NM string, C1_OBJ_NM string")
    r = PR.long_statistics(df, "veg_leaf").first()
    assert r["시도별"] == "서울" and r.value == 1000.0 and r.table == "veg_leaf"


def test_trades_missing_quantities(spark):
    cols = PR.TRADE_KEYS + ["unit_tot_qty", "totprc"]
    rows = [("20200101", "1", "채소", None, "배추", "1", "s", "kg", "-", "100"), ("20200101", "1", "채소", None, "배추", "1", "s", "kg", "", "50"), ("20200101", "1", "채소", None, "배추", "1", "s", "상자", "4", "10")]
    t = PR.market_trades(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)))
    kg = t.where("unit_nm = 'kg'").first()
    assert (kg.qty, kg.amount, kg.n_trades, kg.avg_price) == (0.0, 150.0, 2, None)
    im = spark.createDataFrame([("100", "1", "배추", "채소>배추;;채소>무")], "ctgry_cd string, item_cd string, item_nm string, garak_item string")
    r = PR.trades_by_item(t, im).first()
    assert (r.amount, r.n_trades, r.qty_kg, r.avg_price_kg) == (160.0, 3, 0.0, None)


def test_recipes_to_ranking(spark):
    rec = spark.createDataFrame([("1", "'대파 볶음' 만들기", json.dumps([["대파 (흰부분)", "1"], ["간장", "2"], ["대파", ""]], ensure_ascii=False), None),
                                 ("2", "보관법", "[]", "두부, 양파■물"), ("3", "콩나물 무침", "[]", None)], "recipe_id string, name string, ingredients string, ingredients_text string")
    items = spark.createDataFrame([("파(대파)", 0), ("양파", 1)], "item_nm string, line int")
    prod = spark.createDataFrame([("찌개두부 300g",)], "p string")
    ing = M.recipe_ingredients(rec)
    assert sorted((r.recipe_id, r.ingredient) for r in ing.collect()) == [("1", "간장"), ("1", "대파"), ("2", "두부"), ("2", "물"), ("2", "양파")]
    m = M.ingredient_map(ing, items, prod, "p")
    got = {r.ingredient: (r["class"], r.price_item, r.price_source) for r in m.collect()}
    assert got == {"간장": ("양념", None, None), "물": ("양념", None, None), "대파": ("식재료", "파", "신선식품"), "두부": ("식재료", "두부", "생필품"), "양파": ("식재료", "양파", "신선식품")}
    linked = ing.join(m, "ingredient")
    full = M.recipes_table(rec, M.recipe_coverage(linked), spark.createDataFrame([("3", "제외")], "recipe_id string, menu_name string"))
    r = {x.recipe_id: x for x in full.collect()}
    assert r["1"].menu_name == "대파볶음" and r["1"].all_priced and not r["3"].is_menu and r["2"].price_items == "두부;양파"
    state = spark.createDataFrame([("파", 2, 1, 1, -0.05, 0.1)], "item_nm string, score int, level int, trend int, pred double, pct double")
    top = M.rank_menus(full, linked, state).collect()
    assert [(x["rank"], x.menu_name, x.score, x.reason) for x in top] == [(1, "대파볶음", 2.0, "대파 1년 중 싼 편·4주 하락 예상(-5%)")]


def test_parse_pages(spark):
    h = '<script type="application/ld+json">{"@type":"Recipe","name":" 국 ","recipeIngredient":["무 1개"],"aggregateRating":{"ratingValue":4.5,"reviewCount":3}}</script><b class="view2_summary_info2">30분<'
    old = '<meta name="description" content="소개 재료: 무, 파 만들기 끝">조회수 1,234'
    df = spark.createDataFrame([("a", h), ("b", old)], "id string, html string")
    r = {x.id: x for x in PG.parse_pages(df, "id", "html").collect()}
    assert r["a"].name == "국" and json.loads(r["a"].ingredients) == [["무 1개", ""]] and r["a"].rating == "4.5" and r["a"].time == "30분"
    assert r["b"].ingredients_text == "무, 파" and r["b"].views == 1234 and r["b"].n_ingredients == 0


def test_stocking_policy_by_hand(spark):
    rows = [("i", dt.date(2024, 1, 1) + dt.timedelta(weeks=k), b, p) for k, (b, p) in enumerate([(100.0, 0.05), (110.0, 0.0), (120.0, -0.05), (90.0, 0.0)])]
    df = spark.createDataFrame(rows, "i string, date date, b double, p double")
    r = K.stocking_policy(df, ["i"], "date", "b", "p", budget=1.0).first()

    def sim(up, down):
        stock, cost = 2, 0.0
        for _, _, b, p in rows:
            target = 4 if up and p > 0.01 else (1 if down and p < -0.01 else 2)
            buy = max(0, target - stock)
            cost += buy * b
            stock += buy - 1
        return cost, stock

    (c0, s0), (c2, s2) = sim(False, False), sim(True, True)
    assert r.plain == pytest.approx(1.0) and r.early_late == pytest.approx((c2 - (s2 - s0) * 90.0) / c0)


def test_probability_fit_by_hand(spark):
    rows = [(0.02 * k, 1.0 if k % 3 else -1.0) for k in range(1, 60)] + [(0.005, 1.0)]
    df = spark.createDataFrame(rows, "p double, y double")
    h = K.direction_hits(df, "y", "p")
    f = K.fit_probability(h).first()
    x = [math.log(0.02 * k) for k in range(1, 60)]
    z = [1.0 if k % 3 else 0.0 for k in range(1, 60)]
    mx, mz = sum(x) / 59, sum(z) / 59
    b = sum((a - mx) * (c - mz) for a, c in zip(x, z)) / sum((a - mx) ** 2 for a in x)
    assert f.b == pytest.approx(b) and f.n == 59 and f.cap == 1.0


def test_model_input_leaves_the_gap_out(spark):
    d = lambda s: dt.date.fromisoformat(s)
    rows = [(d("2024-12-01"), 1.0), (d("2024-12-15"), 1.0), (d("2025-01-01"), 1.0), (d("2025-01-02"), None)]
    df = spark.createDataFrame(rows, "date date, y double")
    got = sorted((str(r.date), r.split) for r in FR.model_input(df, df, ("2016-01-01", "2024-12-01"), "2025-01-01").collect())
    assert got == [("2024-12-01", "학습"), ("2025-01-01", "테스트")]


def test_composites_ignore_missing_and_scope(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0, True), (2, None, 8.0, True), (3, None, None, False)], "i int, a double, b double, tr boolean")
    x = C.add_composites(df, {"raw": (["a", "b"], "raw"), "norm": (["a", "b"], "norm")}, F.col("tr"))
    got = {r.i: (r.raw, r.norm) for r in x.collect()}
    assert got[1] == (3.0, pytest.approx((1 + 4 / 6) / 2)) and got[2] == (8.0, pytest.approx(8 / 6)) and got[3] == (None, None)
    s = C.apply_scope(C.mark_scope(df, {"a": F.col("i") == 1}))
    assert {r.i: r.a for r in s.collect()} == {1: 2.0, 2: -1e9, 3: -1e9}


def test_wide_series_with_farm_survey(spark):
    f = spark.createDataFrame([(dt.date(2020, 1, 5), "굴", 1.0), (dt.date(2020, 1, 9), None, 3.0)], "date date, kind string, temp_s double")
    for v in DS.FARM_VARS[1:]:
        f = f.withColumn(v, F.lit(None).cast("double"))
    rows = spark.createDataFrame([("굴", dt.date(2020, 3, 1)), ("굴", dt.date(2020, 3, 2)), ("김", dt.date(2020, 3, 2))], "item_nm string, date date")
    got = {(r.item_nm, r.date.day): (r.farm_temp_s, r.farmitem_temp_s) for r in DS.with_farm_survey(rows, f).collect()}
    assert got == {("굴", 1): (2.0, 1.0), ("굴", 2): (2.0, 1.0), ("김", 2): (2.0, None)}


def test_landing_resumes(spark, tmp_path):
    src, dst, ck = [str(tmp_path / n) for n in ("s", "d", "c")]
    df = spark.range(10).select(F.col("id").cast("string").alias("v"))
    df.write.parquet(src)
    land_new_files(spark, src, df.schema, dst, ck)
    land_new_files(spark, src, df.schema, dst, ck)
    assert spark.read.parquet(dst).count() == 10
    df.write.mode("append").parquet(src)
    land_new_files(spark, src, df.schema, dst, ck)
    assert spark.read.parquet(dst).count() == 20


def test_vocabulary_is_usable(spark):
    assert len(set(V.SEASONINGS)) > 100 and all(len(a) for al in V.FRESH_ALIASES.values() for a in al)
