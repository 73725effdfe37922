"""Composed tables: raw pieces shaped from the driver tables, run through the table builders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..functions.quantiles import exact_median
from ..operators import aggregates as A
from ..operators import evaluate as E
from ..operators import menu as M
from ..operators import repair as R
from ..operators import windows as W
from ..session import cut_lineage
from . import dataset as DS
from . import frames as FR
from . import processed as PR
from .queries_joins import UNIT_ROWS, UNITS_SQL
from .queries_models import NUM, TEST, TRAIN, TE_SQL, TR_SQL, train_rows
from .queries_windows import HIST, K, MK, MKT, REGION_HIST, RK, RKS, history, market_days, predictions, r6, regional, s6
from .registry import query
from .roles import FACTS, OBS, SERIES, SqlFrames, daily_prices, daily_sql, event_days, history_sql, monthly_facts, observations, table, use_all_cores

TEXT = lambda c: F.col(c).cast("string")

# The survey table shaped from lineitem: codes 100..600 by part type, sizes and prices as texts, plus exact repeats.
CAT_SQL = "CASE p_type WHEN 'ECONOMY' THEN '100' WHEN 'LARGE' THEN '200' WHEN 'MEDIUM' THEN '300' WHEN 'PROMO' THEN '400' WHEN 'SMALL' THEN '500' ELSE '600' END"
DOM_SQL = "CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO') THEN 'agri' WHEN p_type = 'SMALL' THEN 'livestock' ELSE 'fishery' END"


def survey(spark, sf):
    t = F.col("p_type")
    cat = F.when(t == "ECONOMY", "100").when(t == "LARGE", "200").when(t == "MEDIUM", "300").when(t == "PROMO", "400").when(t == "SMALL", "500").otherwise("600")
    s = F.col("p_size")
    unit = F.when(s <= 10, "kg(5)").when(s <= 20, "g").when(s <= 25, "L").when(s <= 38, "box").otherwise("bag")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", cat.alias("cat"), unit.alias("unit"))
    x = use_all_cores(table(spark, sf, "lineitem")).join(p, "l_partkey")  # fifteen text columns per row follow
    const = {"se_cd": F.col("l_returnflag"), "se_nm": F.when(F.col("l_returnflag") == "A", PR.RETAIL).otherwise(PR.WHOLESALE), "ctgry_cd": F.col("cat"), "ctgry_nm": F.col("cat"), "item_cd": F.col("cat"), "item_nm": t, "vrty_cd": F.col("p_name"), "vrty_nm": F.col("p_name"),
             "grd_cd": F.col("p_brand"), "grd_nm": F.col("p_brand"), "sgg_cd": F.col("l_linestatus"), "sgg_nm": F.col("l_linestatus"), "mrkt_cd": TEXT("l_suppkey"), "mrkt_nm": TEXT("l_suppkey"), "unit": F.col("unit")}
    return x.select(F.date_format("l_shipdate", "yyyyMMdd").alias("exmn_ymd"), *[c.alias(n) for n, c in const.items()], TEXT("l_quantity").alias("unit_sz"), TEXT("l_extendedprice").alias("exmn_dd_prc"), F.lit("-").alias("exmn_dd_cnvs_prc"))


SURVEY_SQL = f"""{UNITS_SQL}, sv AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, CASE l_returnflag WHEN 'A' THEN '소매' ELSE '중도매' END AS se_nm, l_returnflag AS se_cd, p_type, p_name, p_brand, l_linestatus, l_suppkey, un.unit, l_quantity AS q, l_extendedprice AS p FROM lineitem JOIN part ON l_partkey = part.p_partkey JOIN (SELECT p_partkey AS pk, unit FROM un) un ON pk = l_partkey),
kg AS (SELECT sv.*, CASE WHEN starts_with(sv.unit, 'kg') OR sv.unit = 'L' THEN 1000.0 WHEN sv.unit = 'g' THEN 1.0 ELSE (SELECT g FROM ut WHERE ut.item_nm = p_type AND ut.unit = sv.unit AND (vrty_contains = '' OR contains(p_name, vrty_contains)) ORDER BY CASE WHEN vrty_contains <> '' THEN 0 ELSE 1 END, line LIMIT 1) END AS g FROM sv)"""


def price(spark, sf):
    t = spark.createDataFrame(UNIT_ROWS, "item_nm string, unit string, vrty_contains string, g_per_unit double, source string, line int")
    return PR.price_table(survey(spark, sf), t, start="1995-01-01")


@query("d01_price_table", f"""WITH {SURVEY_SQL} SELECT {DOM_SQL} AS domain, date, se_nm, count(*) AS n, count(p / (q * g / 1000)) AS n_converted, round(sum(p / (q * g / 1000)), 6) AS price_kg FROM kg GROUP BY ALL""")
def _(spark, sf):
    x = price(spark, sf)
    return x.groupBy("domain", "date", "se_nm").agg(F.count(F.lit(1)).alias("n"), F.count("price_kg").alias("n_converted"), F.round(F.sum("price_kg"), 6).alias("price_kg"))


@query("d02_wholesale_market_median", f"""WITH t AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, {CAT_SQL} AS ctgry_cd, CASE WHEN p_size % 3 = 0 THEN '1box' ELSE (p_size % 3 * 5) || 'kg' END AS unit, p_size, l_suppkey, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT date, ctgry_cd, price / TRY_CAST(regexp_extract(unit, '^([0-9.]+)\\s*kg$', 1) AS DOUBLE) AS p FROM t WHERE ends_with(unit, 'kg')) SELECT date, ctgry_cd, round(median(p), 6) AS mafra_whsl_price_kg FROM w WHERE p > 0 GROUP BY ALL""")
def _(spark, sf):
    s = survey(spark, sf)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    li = table(spark, sf, "lineitem").join(p, "l_partkey")
    t = F.col("p_type")
    cat = F.when(t == "ECONOMY", "100").when(t == "LARGE", "200").when(t == "MEDIUM", "300").when(t == "PROMO", "400").when(t == "SMALL", "500").otherwise("600")
    k = F.col("p_size") % 3
    raw = li.select(F.date_format("l_shipdate", "yyyyMMdd").alias("EXAMIN_DE"), cat.alias("FRMPRD_CATGORY_CD"), cat.alias("FRMPRD_CATGORY_NM"), cat.alias("PRDLST_CD"), t.alias("PRDLST_NM"), TEXT("p_size").alias("SPCIES_CD"), TEXT("p_size").alias("SPCIES_NM"), F.lit("").alias("GRAD_CD"), F.lit("").alias("GRAD_NM"),
                    F.when(k == 0, "1box").otherwise(F.concat((k * 5).cast("string"), F.lit("kg"))).alias("EXAMIN_UNIT"), F.lit("").alias("AREA_CD"), F.lit("").alias("AREA_NM"), TEXT("l_suppkey").alias("MRKT_CD"), TEXT("l_suppkey").alias("MRKT_NM"), TEXT("l_extendedprice").alias("AMT"))
    w = cut_lineage(PR.wholesale_market(raw).select("date", "ctgry_cd", "item_cd", "unit", "price"))  # read twice; all rows of the distinct
    days = w.select("date", "ctgry_cd", "item_cd").distinct()
    return DS.wholesale_market_price(days, w).where("mafra_whsl_price_kg IS NOT NULL").select("date", "ctgry_cd", *r6("mafra_whsl_price_kg"))


def trades_raw(spark, sf):
    o = observations(spark, sf, True)
    return o.select(F.date_format("date", "yyyyMMdd").alias("trd_clcln_ymd"), F.col("item").alias("gds_lclsf_cd"), F.col("item").alias("gds_lclsf_nm"), F.col("brand").alias("gds_mclsf_cd"), F.col("brand").alias("gds_mclsf_nm"), F.col("channel").alias("gds_sclsf_cd"), F.col("channel").alias("gds_sclsf_nm"),
                    F.when(F.col("status") == "F", "kg").otherwise("box").alias("unit_nm"), TEXT("qty").alias("unit_tot_qty"), TEXT("amount").alias("totprc"), F.concat_ws(" ", "nation", F.lit("farm")).alias("plor_nm"))


def item_map(spark, sf):
    p = table(spark, sf, "part").where("p_size <= 25")
    return p.groupBy(F.col("p_type").alias("item_nm")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(">", "p_type", "p_brand"))), ";").alias("garak_item")).select(F.lit("100").alias("ctgry_cd"), F.col("item_nm").alias("item_cd"), "item_nm", "garak_item")


@query("d03_trades_by_item", f"""WITH {OBS}, lk AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size <= 25)
SELECT date, item AS item_nm, round(sum(amount), 2) AS amount, count(*) AS n_trades, round(sum(CASE WHEN status = 'F' THEN qty END), 2) AS qty_kg, round(sum(CASE WHEN status = 'F' THEN amount END) / sum(CASE WHEN status = 'F' THEN qty END), 6) AS avg_price_kg FROM obs JOIN lk ON p_type = item AND p_brand = brand GROUP BY ALL""")
def _(spark, sf):
    x = PR.trades_by_item(PR.market_trades(trades_raw(spark, sf)), item_map(spark, sf))
    return x.select("date", "item_nm", F.round("amount", 2).alias("amount"), "n_trades", F.round("qty_kg", 2).alias("qty_kg"), *r6("avg_price_kg"))


@query("d03_trade_origins", f"""WITH {OBS} SELECT date, item || '>' || brand AS garak_key, CASE WHEN region <> 'ASIA' AND nation NOT LIKE '% %' THEN region ELSE '기타' END AS sido, round(sum(qty), 2) AS qty FROM obs WHERE status = 'F' GROUP BY ALL""")
def _(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    alias = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select(F.col("n_name").alias("name"), F.col("r_name").alias("sido"))
    return PR.trade_origins(trades_raw(spark, sf), alias).select("date", "garak_key", "sido", F.round("qty", 2).alias("qty"))


@query("d04_calendar_table", """WITH od AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY ALL), h AS (SELECT date, CASE WHEN n % 2 = 0 THEN 'Seollal' ELSE 'Chuseok' END AS name FROM od WHERE n >= 12 UNION ALL SELECT date, 'Seollal eve' FROM od WHERE n >= 13),
d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', (SELECT max(date) FROM h), INTERVAL 1 DAY)) AS DATE) AS date), nm AS (SELECT date, string_agg(name, ', ' ORDER BY length(name)) AS holiday_name FROM h GROUP BY ALL),
s AS (SELECT date AS m FROM h WHERE name = 'Seollal'), c AS (SELECT date AS m FROM h WHERE name = 'Chuseok'), x AS (SELECT d.date, s.m - d.date AS days_to_seollal FROM d ASOF LEFT JOIN s ON d.date <= s.m), y AS (SELECT d.date, c.m - d.date AS days_to_chuseok FROM d ASOF LEFT JOIN c ON d.date <= c.m)
SELECT date, holiday_name, holiday_name IS NOT NULL AS is_holiday, isodow(date) >= 6 AS is_weekend, days_to_seollal, days_to_chuseok FROM d LEFT JOIN nm USING (date) LEFT JOIN x USING (date) LEFT JOIN y USING (date)""")
def _(spark, sf):
    od = cut_lineage(table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n")))
    a = od.where("n >= 12").select("date", F.when(F.col("n") % 2 == 0, "Seollal").otherwise("Chuseok").alias("name"))
    h = a.unionByName(od.where("n >= 13").select("date", F.lit("Seollal eve").alias("name")))
    x = PR.calendar_table(h, "1995-01-01")
    return x.select("date", "holiday_name", "is_holiday", "is_weekend", *[F.col(c).cast("long").alias(c) for c in ("days_to_seollal", "days_to_chuseok")])


@query("d05_weather_tables", f"""WITH {OBS}, s AS (SELECT date, market, avg(price) AS ta, max(price) AS mx, CASE WHEN min(qty) > 20 THEN 0 ELSE sum(qty) END AS rn FROM obs GROUP BY ALL) SELECT date, round(avg(ta), 6) AS temp_avg, round(avg(mx), 6) AS temp_max, round(avg(rn), 6) AS rain FROM s GROUP BY ALL""")
def _(spark, sf):
    s = observations(spark, sf).groupBy("date", "market").agg(F.avg("price").alias("a"), F.max("price").alias("m"), F.when(F.min("qty") <= 20, F.sum("qty")).alias("r"))
    raw = s.select(TEXT("date").alias("tm"), TEXT("market").alias("stnId"), TEXT("market").alias("stnNm"), TEXT("a").alias("avgTa"), TEXT("m").alias("maxTa"), F.coalesce(TEXT("r"), F.lit("")).alias("sumRn"))
    return PR.national_weather(PR.station_weather(raw)).select("date", *r6("temp_avg", "temp_max", "rain"))


@query("d06_macro_tables", "SELECT o_orderpriority AS code, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL UNION ALL SELECT 'fx', CAST(o_orderdate AS DATE), round(avg(o_totalprice), 6) FROM orders GROUP BY ALL")
def _(spark, sf):
    o = table(spark, sf, "orders")
    row = lambda df, code: df.select(code.alias("ITEM_CODE1"), code.alias("ITEM_NAME1"), F.lit("won").alias("UNIT_NAME"), "TIME", TEXT("v").alias("DATA_VALUE"))
    m = o.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyyMM").alias("TIME")).agg(F.sum("o_totalprice").cast("decimal(20,2)").alias("v"))
    d = o.groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("TIME")).agg(F.avg("o_totalprice").alias("v"))
    fx, mm = PR.macro_tables({"fx_usd": row(d, F.lit("fx")), "import_price": row(m, F.col("o_orderpriority"))})
    a = mm.select("code", "month", F.round("value", 2).alias("value"))
    return a.unionByName(fx.select(F.lit("fx").alias("code"), F.col("date").alias("month"), F.round("usd_krw", 6).alias("value")))


@query("d07_import_table", """WITH t AS (SELECT lpad(CAST(l_partkey * 37 % 10000 AS VARCHAR), 4, '0') AS c, date_trunc('month', l_shipdate)::DATE AS month, sum(l_quantity) AS q, sum(l_extendedprice) AS a FROM lineitem GROUP BY ALL)
SELECT CASE WHEN substr(c, 1, 2) IN ('02', '04') OR c IN ('1601', '1602') THEN 'livestock' WHEN substr(c, 1, 2) = '03' OR c IN ('1603', '1604', '1605', '2501') THEN 'fishery' ELSE 'agri' END AS domain, month, count(*) AS n, round(sum(q), 2) AS imp_kg, round(sum(a), 2) AS imp_usd FROM t GROUP BY ALL""")
def _(spark, sf):
    c = F.lpad((F.col("l_partkey") * 37 % 10000).cast("string"), 4, "0")
    m = table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy.MM").alias("year"), c.alias("hsCode")).agg(F.sum("l_quantity").cast("decimal(20,2)").alias("q"), F.sum("l_extendedprice").cast("decimal(20,2)").alias("a"))
    tot = m.groupBy("hsCode").agg(F.sum("q").cast("decimal(20,2)").alias("q"), F.sum("a").cast("decimal(20,2)").alias("a")).withColumn("year", F.lit("총계"))
    raw = m.unionByName(tot).select("year", "hsCode", F.col("hsCode").alias("statKor"), TEXT("q").alias("impWgt"), TEXT("a").alias("impDlr"), F.lit("-").alias("expWgt"), F.lit("").alias("expDlr"))
    return PR.import_table(raw).groupBy("domain", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("imp_kg"), 2).alias("imp_kg"), F.round(F.sum("imp_usd"), 2).alias("imp_usd"))


@query("d08_long_statistics", "SELECT year(o_orderdate)::VARCHAR AS period, o_orderpriority AS \"시도별\", o_orderstatus AS \"품종별\", round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("string").alias("PRD_DE"), "o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").cast("decimal(20,2)").alias("v"))
    raw = o.select("PRD_DE", F.lit("T1").alias("ITM_ID"), F.lit("합").alias("ITM_NM"), F.lit("원").alias("UNIT_NM"), TEXT("v").alias("DT"), F.col("o_orderpriority").alias("C1_NM"), F.lit("시도별").alias("C1_OBJ_NM"), F.col("o_orderstatus").alias("C2_NM"), F.lit("품종별").alias("C2_OBJ_NM"))
    return PR.long_statistics(raw).select("period", "시도별", "품종별", F.round("value", 2).alias("value"))


@query("d09_disease_events", "SELECT CAST(ts AS DATE) AS date, replace(event_type, ' ', '') AS disease_std, 'R' || (user_id % 7) AS region, count(*) AS n, round(sum(value), 4) AS heads FROM events GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select(F.date_format("ts", "yyyyMMdd").alias("OCCRRNC_DE"), F.lit("").alias("CESSATION_DE"), F.concat(F.col("event_type"), F.lit(" - x")).alias("LKNTS_NM"), F.lit("소").alias("LVSTCKSPC_NM"), TEXT("value").alias("OCCRRNC_LVSTCKCNT"),
                   F.concat(F.lit(" R"), (F.col("user_id") % 7).cast("string"), F.lit("  somewhere")).alias("FARM_LOCPLC"), F.lit("1").alias("FARM_LOCPLC_LEGALDONG_CODE"))
    return PR.disease_events(raw).groupBy("date", "disease_std", "region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("head_count"), 4).alias("heads"))


@query("d10_buoy_and_sea", """WITH h AS (SELECT user_id % 40 AS st, date_trunc('minute', ts) AS t, value FROM events), u AS (SELECT st, t, CAST(t - INTERVAL 1 MINUTE AS DATE) AS date, min(value) AS v FROM h GROUP BY ALL), d AS (SELECT st, date, avg(v) AS wt, max(v) AS mx, count(v) AS n FROM u GROUP BY ALL)
SELECT date, CASE WHEN st % 3 = 0 THEN '동해' ELSE '서해' END AS sea, round(avg(wt), 6) AS water_temp, count(DISTINCT st) AS n_buoys FROM d WHERE st < 17 AND n >= 3 GROUP BY ALL""")
def _(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select((F.col("user_id") % 40).alias("지점"), F.date_trunc("minute", "ts").cast("string").alias("일시"), TEXT("value").alias("수온(°C)"), TEXT("value").alias("풍속(m/s)"))
    st = e.select((F.col("user_id") % 40).alias("stn_id")).distinct().where("stn_id < 17").select("stn_id", TEXT("stn_id").alias("stn_nm"), F.when(F.col("stn_id") % 3 == 0, "동해").otherwise("서해").alias("sea"))
    x = PR.sea_days(PR.buoy_days(PR.buoy_hours(raw), st, "2015-01-01"), 3)
    return x.select("date", "sea", *r6("water_temp"), "n_buoys")


@query("d11_item_nutrition", "SELECT n_name AS item_cd, sum(s_acctbal) > 0 AS positive, round(sum(s_acctbal), 2) AS nutr_kcal FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def _(spark, sf):
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").cast("decimal(20,2)").alias("v"))
    raw = s.select(*[(TEXT("s_nationkey") if v == "nutrition_code" else TEXT("v")).alias(k) for k, v in PR.NUTRITION.items()])
    im = table(spark, sf, "nation").select(F.lit("1").alias("ctgry_cd"), F.col("n_name").alias("item_cd"), TEXT("n_nationkey").alias("nutrition_code"))
    return PR.item_nutrition(raw, im).select("item_cd", (F.col("nutr_kcal") > 0).alias("positive"), F.round("nutr_kcal", 2).alias("nutr_kcal"))


KEY6 = "p_type, se_nm"
D6 = SqlFrames(["p_type", "se_nm"])


def series_price(spark, sf):
    """Price rows with variety and grade folded away, so series are dense enough at every scale."""
    p = price(spark, sf).withColumns({"vrty_nm": F.lit("v"), "grd_nm": F.lit("g")})
    return cut_lineage(p.select(*DS.KEYS, "date", "price_kg"))  # the stored price table


DATASET_SQL = f"""{SURVEY_SQL}, {FACTS}, pr AS (SELECT p_type, se_nm, date, p / (q * g / 1000) AS pk FROM kg), dd AS (SELECT {KEY6}, date, date - DATE '1970-01-01' AS dn, median(pk) AS price FROM pr WHERE pk > 0 GROUP BY ALL),
mac AS (SELECT avail, avg(CASE WHEN priority = '1-URGENT' THEN total END) AS urgent FROM facts GROUP BY ALL), wh AS (SELECT p_type, date, median(price) AS whsl FROM dd WHERE se_nm = '중도매' GROUP BY ALL),
ds AS (SELECT dd.*, {D6.mean('price', -14, -1, 5)} AS t14, {D6.mean('price', -28, -1, 9)} AS t28 FROM dd), dm AS (SELECT ds.*, mac.urgent FROM ds ASOF LEFT JOIN mac ON ds.date >= mac.avail)"""


@query("d12_national_panel", f"""WITH {DATASET_SQL} SELECT dm.p_type AS item_nm, dm.se_nm, dm.date, round(price, 6) AS price_kg, round(t14, 6) AS target_mean_14d, round(t28, 6) AS target_mean_28d, isodow(dm.date) - 1 AS dow, round(urgent, 2) AS "impidx_1_URGENT", round(whsl, 6) AS whsl_price_kg
FROM dm LEFT JOIN wh ON wh.p_type = dm.p_type AND wh.date = dm.date""")
def _(spark, sf):
    x = panel(spark, sf)
    return x.select("item_nm", "se_nm", "date", *r6("price_kg", "target_mean_14d", "target_mean_28d"), F.col("dow").cast("long").alias("dow"), F.round("impidx_1_URGENT", 2).alias("impidx_1_URGENT"), *r6("whsl_price_kg"))


def panel(spark, sf):
    daily = cut_lineage(DS.daily_series(series_price(spark, sf)))
    im = daily.select("ctgry_cd", "item_cd").distinct().withColumn("food_group", F.substring("item_cd", 1, 1))
    df = DS.base_rows(daily, im)
    day = daily.select("date").distinct()
    cal = day.select("date", F.lit(False).alias("is_holiday"), F.lit(1).alias("days_to_seollal"), F.lit(2).alias("days_to_chuseok"))
    wx = day.select("date", *[F.lit(1.0).alias(c) for c in PR.WEATHER.values()])
    fx = day.select("date", F.lit(1.0).alias("usd_krw"))
    macro = monthly_facts(spark, sf).select(F.lit("import_price").alias("table"), F.col("priority").alias("name"), "month", F.col("total").alias("value"))
    return DS.with_own_wholesale(DS.common_variables(df, cal, wx, fx, macro), daily)


FEAT = f"""{DATASET_SQL}, {history_sql(['p_type', 'se_nm'], 'dd', 'fh')}"""


@query("d13_feature_table", f"WITH {FEAT} SELECT p_type AS item_nm, se_nm, date, {s6('base', 'r7', 'r28', 'yoy', 'y')}, weekofyear(date) AS woy FROM fh WHERE y IS NOT NULL")
def _(spark, sf):
    x = FR.features_table(panel(spark, sf).withColumn("domain", F.lit("agri")), ["price_kg", "whsl_price_kg"])
    return x.select("item_nm", "se_nm", "date", *r6("base", "r7", "r28", "yoy", "y"), F.col("woy").cast("long").alias("woy"))


@query("d14_combined_frame", f"""WITH {REGION_HIST}, g AS (SELECT channel, date, sum(r28) OVER (PARTITION BY date) AS s, count(r28) OVER (PARTITION BY date) AS n, r28 FROM nh WHERE y IS NOT NULL), gr AS (SELECT channel, date, CASE WHEN n - (r28 IS NOT NULL)::INT > 0 THEN (s - coalesce(r28, 0)) / (n - (r28 IS NOT NULL)::INT) END AS grp_r28 FROM g)
SELECT rh.channel, rh.region, rh.date, 0 AS is_nat, {s6('y')}, round(rh.base / nh.base - 1, 6) AS premium, round(nh.r28, 6) AS nat_r28, round(grp_r28, 6) AS grp_r28 FROM (SELECT * FROM rh WHERE y IS NOT NULL) rh LEFT JOIN (SELECT channel, date, base, r28 FROM nh) nh ON nh.channel = rh.channel AND nh.date = rh.date LEFT JOIN gr ON gr.channel = rh.channel AND gr.date = rh.date
UNION ALL SELECT nh.channel, '전국', nh.date, 1, {s6('y')}, 0.0, round(nh.r28, 6), round(grp_r28, 6) FROM nh LEFT JOIN gr ON gr.channel = nh.channel AND gr.date = nh.date WHERE y IS NOT NULL""")
def _(spark, sf):
    const = {"ctgry_cd": F.lit("1"), "item_cd": F.col("channel"), "item_nm": F.col("channel"), "vrty_nm": F.lit("v"), "grd_nm": F.lit("g"), "se_nm": F.lit(PR.RETAIL)}
    o = observations(spark, sf, True)
    p = cut_lineage(o.select("date", *[c.alias(n) for n, c in const.items()], F.col("region").alias("sgg_nm"), F.col("price").alias("price_kg")))
    reg = FR.regional_rows(p, F.lit(True), "1995-01-01")
    ds = cut_lineage(DS.base_rows(DS.daily_series(p), p.select("ctgry_cd", "item_cd").distinct().withColumn("food_group", F.lit("f"))).withColumns({"domain": F.lit("livestock"), "pig_auction_price_kg": F.col("price_kg"), "days_to_seollal": F.lit(1), "days_to_chuseok": F.lit(1)}))
    feats = FR.features_table(ds, ["price_kg", "pig_auction_price_kg"])
    ev = ds.select("date", "item_nm", F.lit(0).alias("disease_item_cases_28d")).where("1 = 0")
    x = FR.combined_frame(reg, FR.national_history(ds, ["pig_auction_price_kg"]), feats, ds, ev, "livestock", train_rows(), F.lit(True), composites=[])  # the tables have no fuel, import or feed prices
    return x.select(F.col("item_nm").alias("channel"), F.col("sgg_nm").alias("region"), "date", "is_nat", *r6("y", "premium", "nat_r28", "grp_r28"))


@query("d15_final_frame_changes", f"""{HIST} SELECT {K}, date, round(CASE WHEN base / l28 > 0 THEN ln(base / l28) END, 5) AS chg28, round(CASE WHEN base / l91 > 0 THEN ln(base / l91) END, 5) AS chg91 FROM (SELECT *, last_value(base IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY dn RANGE BETWEEN 73 PRECEDING AND 28 PRECEDING) AS l28, last_value(base IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY dn RANGE BETWEEN 136 PRECEDING AND 91 PRECEDING) AS l91 FROM hist)""")
def _(spark, sf):
    h = cut_lineage(history(spark, sf).select(*SERIES, "date", "base"))
    const = {"ctgry_cd": F.lit("1"), "item_cd": F.col("item"), "item_nm": F.col("item"), "vrty_nm": F.lit("v"), "grd_nm": F.lit("g"), "se_nm": F.col("channel"), "sgg_nm": F.lit("전국")}
    df = h.withColumns(const)
    x = FR.adopted_fishery(df, df, ["base"])
    return x.select(F.col("item_nm").alias("item"), F.col("se_nm").alias("channel"), "date", F.round("chg28_base", 5).alias("chg28"), F.round("chg91_base", 5).alias("chg91"))


@query("d16_cleaned_copy_rebuilt", f"""WITH {MKT}, cp AS (SELECT o.channel, o.date, CASE WHEN spike THEN prev_price ELSE o.price END AS price FROM obs o JOIN fl ON o.channel = fl.channel AND o.market = fl.market AND o.date = fl.date WHERE o.price > 0),
cd AS (SELECT channel, date, date - DATE '1970-01-01' AS dn, median(price) AS price FROM cp GROUP BY ALL), {history_sql(['channel'], 'cd', 'ch')} SELECT channel, date, {s6('price', 'base', 'r28', 'y')} FROM ch""")
def _(spark, sf):
    o = observations(spark, sf).where("price > 0").select(*MK, "date", "price")
    d = exact_median(R.repair_spikes(o, MK, "date", "price"), ["channel", "date"], "price", "price")
    return W.with_target(W.price_history(d, ["channel"], "date", "price")).select("channel", "date", *r6("price", "base", "r28", "y"))


@query("d17_model_input", f"""WITH {MKT}, cp AS (SELECT o.channel, o.date, CASE WHEN spike THEN prev_price ELSE o.price END AS price FROM obs o JOIN fl ON o.channel = fl.channel AND o.market = fl.market AND o.date = fl.date WHERE o.price > 0),
cd AS (SELECT channel, date, date - DATE '1970-01-01' AS dn, median(price) AS price FROM cp GROUP BY ALL), {history_sql(['channel'], 'cd', 'ch')}, {daily_sql(['channel'], 'od')}, {history_sql(['channel'], 'od', 'oh')}
SELECT channel, date, 'train' AS split, {s6('base', 'y')} FROM ch WHERE y IS NOT NULL AND {TR_SQL} UNION ALL SELECT channel, date, 'test', {s6('base', 'y')} FROM oh WHERE y IS NOT NULL AND date >= DATE '{TEST}'""")
def _(spark, sf):
    o = cut_lineage(observations(spark, sf).where("price > 0").select(*MK, "date", "price"))
    frame = lambda rows: W.with_target(W.price_history(exact_median(rows, ["channel", "date"], "price", "price"), ["channel"], "date", "price")).select("channel", "date", "base", "y")
    x = FR.model_input(frame(R.repair_spikes(o, MK, "date", "price")), frame(o), TRAIN, TEST, ("train", "test"))
    return x.select("channel", "date", "split", *r6("base", "y"))


# ---- recipes: every document is a recipe whose free text lists ingredients; common words become Korean names

WORDS = (("the ", "두부 "), ("and ", "돼지고기"), ("la ", "대파 "), ("tion", "간장"), ("inea", "김가루"), ("der ", "참치"), ("que", "파"), ("der", "양파"))


def recipes(spark, sf):
    t = F.lower("text")
    for a, b in WORDS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("recipe_id"), F.lit("[]").alias("ingredients"), t.alias("ingredients_text"), F.col("source").alias("name"))


TXT_SQL = "replace(" * len(WORDS) + "lower(text)" + "".join(f", '{a}', '{b}')" for a, b in WORDS)
ING_SQL = f"""rt AS (SELECT doc_id, {TXT_SQL} AS t FROM documents), rs AS (SELECT doc_id, unnest(string_split_regex(t, '[,♣■:]')) AS raw, generate_subscripts(string_split_regex(t, '[,♣■:]'), 1) AS pos FROM rt),
c1 AS (SELECT doc_id, pos, regexp_replace(regexp_replace(raw, '\\(.*?\\)|\\[.*?\\]|<.*?>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS r FROM rs), c2 AS (SELECT doc_id, pos, regexp_replace(r, '(약간|적당량|조금|기호에\\s*따라|선택|옵션|생략가능|또는.*)$', '') AS r FROM c1),
c3 AS (SELECT doc_id, pos, regexp_replace(regexp_replace(r, '^(채썬|썬|삶은|데친|냉동|신선한|손질된|불린|말린|국산|수입산?)\\s*', ''), '\\s+', '', 'g') AS ing FROM c2), ri AS (SELECT doc_id AS recipe_id, ing AS ingredient, min(pos) AS pos FROM c3 WHERE ing <> '' GROUP BY ALL)"""


@query("d18_recipe_ingredients", f"WITH {ING_SQL} SELECT recipe_id, count(*) AS n, md5(string_agg(ingredient, '|' ORDER BY pos)) AS listing FROM ri GROUP BY ALL")
def _(spark, sf):
    x = cut_lineage(M.recipe_ingredients(recipes(spark, sf)).select("recipe_id", "ingredient", "pos"))  # read twice
    return A.ordered_concat(x, ["recipe_id"], "ingredient", "pos", "|", "l").join(x.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("n")), "recipe_id").select("recipe_id", "n", F.md5("l").alias("listing"))


def items_table(spark, sf):
    """Item names from the part names, in order of their first part."""
    p = table(spark, sf, "part").groupBy(F.split("p_name", " ")[1].alias("item_nm")).agg(F.min("p_partkey").alias("line"))
    extra = spark.createDataFrame([("양파", -2), ("파(대파)", -1)], "item_nm string, line long")
    return p.unionByName(extra).select("item_nm", (F.col("line") + 2).cast("int").alias("line"))


def _alias_values():
    fresh = [(a, 0, -len(a) * 10000 + i, len(a) == 1, it, V.SOURCE_FRESH) for i, (it, a) in enumerate((it, a) for it, al in V.FRESH_ALIASES.items() for a in al)]
    packed = [(k, 2, g, False, n, V.SOURCE_PACKAGED) for g, (n, (ws, _)) in enumerate(V.PACKAGED.items()) for k in ws]
    return ", ".join(f"('{a}', {t}, {s}, {str(e).upper()}, '{i}', '{src}')" for a, t, s, e, i, src in fresh + packed)


LINK_SQL = f"""{ING_SQL}, al0(alias, tier, sort, exact, item, src) AS (VALUES {_alias_values()}), pt AS (SELECT split_part(p_name, ' ', 2) AS nm, min(p_partkey) AS line FROM part GROUP BY ALL UNION ALL VALUES ('양파', -2), ('파(대파)', -1)),
al AS (SELECT * FROM al0 WHERE tier < 2 OR item IN ('두부', '참치') UNION ALL SELECT regexp_replace(nm, '\\(.*\\)', ''), 1, CAST(-length(regexp_replace(nm, '\\(.*\\)', '')) * 10000 + line + 2 AS INT), FALSE, nm, '{V.SOURCE_FRESH}' FROM pt WHERE length(regexp_replace(nm, '\\(.*\\)', '')) >= 2),
ni AS (SELECT ingredient, count(*) AS n_recipes, CASE WHEN ingredient IN ({", ".join(f"'{w}'" for w in V.SEASONINGS)}) OR (regexp_matches(ingredient, '(소스|액젓|가루|육수|오일|간장|식초|시럽)$') AND ingredient NOT IN ('김가루', '콩가루', '들깨가루')) THEN '양념' ELSE '식재료' END AS class,
 ingredient NOT IN ({", ".join(f"'{w}'" for w in V.NOT_FRESH)}) AND NOT ends_with(ingredient, '김치') AS fresh_ok FROM ri GROUP BY ALL),
mt AS (SELECT ingredient, item, src, row_number() OVER (PARTITION BY ingredient ORDER BY tier, sort) AS r FROM ni JOIN al ON contains(ingredient, alias) WHERE class = '식재료' AND (fresh_ok OR tier = 2) AND (NOT exact OR alias = ingredient)),
im AS (SELECT ni.ingredient, class, item AS price_item, src AS price_source, n_recipes FROM ni LEFT JOIN (SELECT * FROM mt WHERE r = 1) m ON m.ingredient = ni.ingredient)"""


def links(spark, sf):
    """Products: the source names with two packaged foods among them."""
    ing = cut_lineage(M.recipe_ingredients(recipes(spark, sf)).select("recipe_id", "ingredient", "pos"))
    prod = table(spark, sf, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "찌개두부").otherwise("살코기참치"), "source").alias("product")).distinct()
    return ing, M.ingredient_map(ing, items_table(spark, sf), prod, "product")


@query("d18_ingredient_map", f"WITH {LINK_SQL} SELECT class, price_item, price_source, count(*) AS n_names, CAST(sum(n_recipes) AS BIGINT) AS n_uses, CAST(sum(length(ingredient)) AS BIGINT) AS n_chars, min(md5(ingredient)) AS low, max(md5(ingredient)) AS high FROM im GROUP BY ALL")
def _(spark, sf):
    _, m = links(spark, sf)
    g = m.groupBy("class", "price_item", "price_source").agg(F.count(F.lit(1)).alias("n_names"), F.sum("n_recipes").alias("n_uses"), F.sum(F.length("ingredient").cast("long")).alias("n_chars"), F.min(F.md5("ingredient")).alias("low"), F.max(F.md5("ingredient")).alias("high"))
    return g


@query("d18_recipe_coverage", f"""WITH {LINK_SQL}, fo AS (SELECT recipe_id, ri.ingredient, pos, price_item FROM ri JOIN im ON im.ingredient = ri.ingredient WHERE class = '식재료'), pi AS (SELECT recipe_id, price_item, min(pos) AS p FROM fo WHERE price_item IS NOT NULL GROUP BY ALL)
SELECT recipe_id, count(*) AS n_food, count(price_item) AS n_priced, coalesce((SELECT string_agg(price_item, ';' ORDER BY p) FROM pi WHERE pi.recipe_id = fo.recipe_id), '') AS price_items FROM fo GROUP BY ALL""")
def _(spark, sf):
    ing, m = links(spark, sf)
    x = M.recipe_coverage(cut_lineage(ing.join(m, "ingredient")))
    return x.select("recipe_id", "n_food", "n_priced", "price_items")


STATE_SQL = f"""{HIST.replace('WITH ', '', 1)}, lst AS (SELECT max(date) AS mx FROM hist), hx AS (SELECT {K}, date, base FROM hist, lst WHERE base IS NOT NULL AND date > mx - 365), nb AS (SELECT {K}, arg_max(base, date) AS nb FROM hx GROUP BY ALL),
pc AS (SELECT {K}, CASE WHEN count(*) >= 30 THEN avg(CASE WHEN base <= nb THEN 1.0 ELSE 0 END) END AS pct FROM hx JOIN nb USING ({K}) GROUP BY ALL), nw AS (SELECT * FROM (SELECT {K}, base, -0.5 * r28 AS pred, row_number() OVER (PARTITION BY {K} ORDER BY date DESC) AS r FROM hist, lst WHERE date > mx - 7) WHERE r = 1),
stt AS (SELECT item AS item_nm, count(*) AS n_series, median(pred) AS pred, median(pct) AS pct, median(base) AS base FROM nw LEFT JOIN pc USING ({K}) GROUP BY ALL),
st AS (SELECT *, CASE WHEN pct <= 0.3 THEN 1 WHEN pct >= 0.7 THEN -1 ELSE 0 END AS level, CASE WHEN pred <= -0.02 THEN 1 WHEN pred >= 0.02 THEN -1 ELSE 0 END AS trend FROM stt)"""


def state(spark, sf):
    h = cut_lineage(history(spark, sf).select(*SERIES, "date", "base", "r28"))
    scored = M.latest_rows(h, SERIES, "date").withColumn("pred", F.col("r28") * -0.5)
    return M.ingredient_state(scored, M.price_percentile(h, SERIES, "date", "base"), SERIES, "item").withColumnRenamed("item", "item_nm")


@query("d19_ingredient_state", f"WITH {STATE_SQL} SELECT item_nm, n_series, {s6('pred', 'pct', 'base')}, level, trend, level + trend AS score FROM st")
def _(spark, sf):
    return state(spark, sf).select("item_nm", "n_series", *r6("pred", "pct", "base"), "level", "trend", "score")


RANK_SQL = f"""WITH {STATE_SQL}, li AS (SELECT DISTINCT orderkey AS recipe_id, item AS price_item FROM obs), rs AS (SELECT recipe_id, avg(level + trend) AS score, count(*) AS n_scored FROM li JOIN st ON item_nm = price_item GROUP BY ALL),
mn AS (SELECT rs.*, o_orderpriority || '/' || strftime(o_orderdate, '%m') AS menu_name FROM rs JOIN orders ON o_orderkey = recipe_id), b AS (SELECT menu_name, max(score) AS score FROM mn GROUP BY ALL)
SELECT menu_name, round(score, 6) AS score FROM b"""


def dishes(spark, sf, top=None):
    """The best recipe of every dish; with `top`, the ranked report."""
    st = cut_lineage(state(spark, sf))
    o = observations(spark, sf).select(F.col("orderkey").alias("recipe_id"), F.col("item").alias("ingredient"), F.col("l_linenumber").alias("pos"))
    linked = o.select("recipe_id", "ingredient", "pos", F.col("ingredient").alias("price_item"), F.lit(V.CLASS_FOOD).alias("class"), F.lit(V.SOURCE_FRESH).alias("price_source"))
    rec = table(spark, sf, "orders").select(F.col("o_orderkey").alias("recipe_id"), F.concat_ws("/", "o_orderpriority", F.date_format("o_orderdate", "MM")).alias("menu_name"), F.lit(True).alias("is_menu"), F.col("o_orderstatus").alias("name"))
    linked = cut_lineage(linked)
    return M.rank_menus(rec, linked, st, seed=1, top=top) if top else M.scored_dishes(rec, linked, st, seed=1)[0]


@query("d20_best_score_per_dish", RANK_SQL)
def _(spark, sf):
    return dishes(spark, sf).select("menu_name", *r6("score"))


@query("d20_ranked_dishes")
def _(spark, sf):
    return dishes(spark, sf, 30).select("rank", "menu_name", *r6("score"), "n_scored", "reason", "name")


COOC = f"""WITH {OBS}, bk AS (SELECT DISTINCT orderkey, brand FROM obs), ct AS (SELECT brand, count(*) AS n FROM bk GROUP BY ALL HAVING count(*) >= 5), kp AS (SELECT bk.* FROM bk JOIN ct USING (brand)), nb AS (SELECT count(DISTINCT orderkey) AS n FROM bk),
co AS (SELECT a.brand AS item_a, b.brand AS item_b, count(*) AS n_both FROM kp a JOIN kp b ON a.orderkey = b.orderkey AND a.brand <> b.brand GROUP BY ALL),
pp AS (SELECT item_a, item_b, n_both, greatest(ln((n_both / nb.n + 1e-12) / ((ca.n / nb.n) * (cb.n / nb.n))), 0) AS ppmi FROM co JOIN ct ca ON ca.brand = item_a JOIN ct cb ON cb.brand = item_b, nb)"""


def cooc(spark, sf):
    o = cut_lineage(observations(spark, sf).select("orderkey", "brand").distinct())
    counts, pairs = A.cooccurrence(o, "orderkey", "brand")
    return cut_lineage(A.ppmi(counts, pairs, "brand", o.agg(F.countDistinct("orderkey").alias("n_baskets"))))


@query("d21_cooccurrence_ppmi", f"{COOC} SELECT item_a, item_b, n_both, round(ppmi, 6) AS ppmi FROM pp")
def _(spark, sf):
    return cooc(spark, sf).select("item_a", "item_b", "n_both", *r6("ppmi"))


@query("d21_second_order_neighbours", f"""{COOC}, no AS (SELECT item_a, sqrt(sum(ppmi * ppmi)) + 1e-12 AS n FROM pp GROUP BY ALL), v AS (SELECT pp.item_a, item_b, ppmi / n AS v FROM pp JOIN no ON no.item_a = pp.item_a), s AS (SELECT a.item_a AS x, b.item_a AS y, sum(a.v * b.v) AS similarity FROM v a JOIN v b ON a.item_b = b.item_b AND a.item_a <> b.item_a WHERE a.v > 0 AND b.v > 0 GROUP BY ALL)
SELECT x, y, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(similarity, 9) DESC, y) AS rank FROM s) WHERE rank <= 4""")
def _(spark, sf):
    s = A.second_order(cooc(spark, sf))
    return A.top_k(s, ["x"], [F.round("similarity", 9).desc(), F.col("y")], 4).select("x", "y", *r6("similarity"), "rank")


@query("d22_vector_clusters")
def _(spark, sf):
    """k-means on standardised vectors for several k: silhouette and agreement with the labels."""
    from functools import reduce

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: F.signum(x) * F.log1p(F.abs(x))).cast("array<double>")).alias("raw"))
    z = StandardScaler(inputCol="raw", outputCol="z", withMean=True).fit(e).transform(e)
    z = cut_lineage(PCA(k=2, inputCol="z", outputCol="pc").fit(z).transform(z))
    rows = []
    for k in range(3, 13):
        c = KMeans(k=k, seed=0, featuresCol="z", predictionCol="cluster").fit(z).transform(z)
        sil = ClusteringEvaluator(featuresCol="z", predictionCol="cluster").evaluate(c)
        rows.append(adjusted_rand(c, "cluster", "label").select(F.lit(k).alias("k"), F.lit(round(sil, 6)).alias("silhouette"), "n", *r6("ari")))
    return reduce(lambda a, b: a.unionByName(b), rows)


def adjusted_rand(df, a, b):
    """Adjusted Rand index from contingency counts."""
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda x: x * (x - 1) / 2.0
    pairs = lambda g, n: g.agg(F.sum(two(F.col("n"))).alias(n))
    i = pairs(c, "ij")
    ra = pairs(c.groupBy(a).agg(F.sum("n").alias("n")), "ai")
    rb = pairs(c.groupBy(b).agg(F.sum("n").alias("n")), "bj").crossJoin(c.agg(F.sum("n").alias("n")))
    x = i.crossJoin(ra).crossJoin(rb)  # one row each
    exp = F.col("ai") * F.col("bj") / two(F.col("n"))
    return x.select("n", S.safe_div(F.col("ij") - exp, (F.col("ai") + F.col("bj")) / 2 - exp).alias("ari"))


@query("d22_adjusted_rand", """WITH t AS (SELECT d.doc_id, lang, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id), c AS (SELECT lang, quality, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2.0) AS ij, sum(n) AS n FROM c), a AS (SELECT sum(n * (n - 1) / 2.0) AS ai FROM (SELECT lang, sum(n) AS n FROM c GROUP BY ALL)), b AS (SELECT sum(n * (n - 1) / 2.0) AS bj FROM (SELECT quality, sum(n) AS n FROM c GROUP BY ALL))
SELECT CAST(n AS BIGINT) AS n, round((ij - ai * bj / (n * (n - 1) / 2.0)) / ((ai + bj) / 2 - ai * bj / (n * (n - 1) / 2.0)), 6) AS ari FROM s, a, b""")
def _(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return adjusted_rand(t, "lang", "quality").select("n", *r6("ari"))


@query("u03_train_and_test_rows", f"{HIST} SELECT {K}, date, 'train' AS split, {s6('y')} FROM hist WHERE y IS NOT NULL AND {TR_SQL} UNION ALL SELECT {K}, date, 'test', {s6('y')} FROM hist WHERE y IS NOT NULL AND {TE_SQL}")
def _(spark, sf):
    x = cut_lineage(history(spark, sf).select(*SERIES, "date", "y"))
    return FR.model_input(x, x, TRAIN, TEST, ("train", "test")).select(*SERIES, "date", "split", *r6("y"))


@query("t03_best_then_random_pick", RANK_SQL.replace("SELECT menu_name, round(score, 6) AS score FROM b", "SELECT count(*) AS n_dishes, round(sum(score), 6) AS total FROM b"))
def _(spark, sf):
    x = dishes(spark, sf)
    return x.agg(F.count(F.lit(1)).alias("n_dishes"), F.round(F.sum("score"), 6).alias("total"))
