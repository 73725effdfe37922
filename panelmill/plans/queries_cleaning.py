"""Projection, cleaning, text, source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import cleaning as C
from ..operators import evaluate as E
from ..operators import windows as W
from ..session import checkpoint_folder, cut_lineage
from ..sources import files as IO
from ..sources import pages as PG
from ..streaming.ingest import land_and_aggregate, land_new_files
from .queries_models import TE_SQL, TR_SQL, TRAIN, test_rows, train_rows
from .queries_windows import HIST, K, REGION_HIST, RK, RKS, history, r6, regional, s6
from .registry import query
from .roles import FACTS, OBS, SERIES, daily_prices, daily_sql, monthly_facts, observations, table


def scratch(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


NUM_TXT = "CASE l_linenumber % 7 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN ' ' || l_partkey || ' ' WHEN 4 THEN 'None' WHEN 5 THEN (l_partkey // 1000) || ',' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') ELSE CAST(l_discount AS VARCHAR) END"


@query("p01_lenient_numbers", f"""WITH t AS (SELECT l_returnflag AS channel, {NUM_TXT} AS s FROM lineitem), n AS (SELECT channel, TRY_CAST(nullif(trim(replace(s, ',', '')), '') AS DOUBLE) AS v FROM t)
SELECT channel, count(*) AS n, count(v) AS n_read, round(sum(v), 4) AS total FROM n GROUP BY ALL""")
def _(spark, sf):
    k, p = F.col("l_linenumber") % 7, F.col("l_partkey")
    s = (F.when(k == 0, "-").when(k == 1, "").when(k == 2, "abc").when(k == 3, F.concat(F.lit(" "), p.cast("string"), F.lit(" "))).when(k == 4, "None")
         .when(k == 5, F.concat(F.floor(p / 1000).cast("string"), F.lit(","), F.lpad((p % 1000).cast("string"), 3, "0"))).otherwise(F.col("l_discount").cast("string")))
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("channel"), S.parse_number(s).alias("v"))
    return x.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_read"), F.round(F.sum("v"), 4).alias("total"))


@query("p02_date_parsing", """WITH t AS (SELECT o_orderpriority AS priority, CASE WHEN o_orderkey % 9 = 0 THEN '20011340' ELSE strftime(o_orderdate, '%Y%m%d') END AS d, strftime(o_orderdate, '%Y%m') AS m, strftime(o_orderdate, '%Y.%m') AS pm FROM orders)
SELECT priority, count(TRY_STRPTIME(d, '%Y%m%d')) AS n_days, max(CAST(TRY_STRPTIME(d, '%Y%m%d') AS DATE)) AS last_day, min(CAST(strptime(m || '01', '%Y%m%d') AS DATE)) AS first_month, max(CAST(strptime(pm || '.01', '%Y.%m.%d') AS DATE)) AS last_month FROM t GROUP BY ALL""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    d = F.when(F.col("o_orderkey") % 9 == 0, "20011340").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    x = o.select(F.col("o_orderpriority").alias("priority"), S.parse_date(d).alias("d"), S.parse_date(F.date_format("o_orderdate", "yyyyMM"), "yyyyMM").alias("m"), S.parse_date(F.date_format("o_orderdate", "yyyy.MM"), "yyyy.MM").alias("pm"))
    return x.groupBy("priority").agg(F.count("d").alias("n_days"), F.max("d").alias("last_day"), F.min("m").alias("first_month"), F.max("pm").alias("last_month"))


@query("p03_date_from_parts", "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    o = table(spark, sf, "orders").select(*[fn("o_orderdate").cast("string").alias(a) for fn, a in ((F.year, "y"), (F.month, "m"), (F.dayofmonth, "d"))])
    return o.select(S.date_from_parts("y", "m", "d").alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("p04_rename_columns", "SELECT c_custkey AS custkey, c_mktsegment AS segment, c_acctbal AS acctbal FROM customer")
def _(spark, sf):
    from .processed import lower_columns

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("CUSTKEY"), F.col("c_mktsegment").alias("SEGMENT"), F.col("c_acctbal").alias("ACCTBAL"), F.lit(1).alias("ROW_NUM"))
    return lower_columns(c)


@query("p05_exact_duplicates", "SELECT date, channel, count(*) AS n FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, l_returnflag AS channel, l_linestatus, l_discount FROM lineitem) GROUP BY ALL")
def _(spark, sf):
    x = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("channel"), "l_linestatus", "l_discount").distinct()
    return x.groupBy("date", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("p06_keyed_duplicates", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1""")
def _(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    x = C.keyed_first(x, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_partkey")], keep="last")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("p07_base_price_filter", f"WITH {OBS} SELECT channel, region, count(*) AS n, round(sum(price), 4) AS total FROM obs WHERE channel IN ('A', 'N') AND price > 0 AND region <> 'ASIA' AND date >= DATE '1996-01-01' GROUP BY ALL")
def _(spark, sf):
    x = C.retail_and_wholesale(observations(spark, sf, True), "channel", ["A", "N"], "price", "region", "ASIA", "date", "1996-01-01")
    return x.groupBy("channel", "region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query("p08_regex_row_filter", "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE regexp_matches(source, '^src1\\d$') GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "documents").where(F.col("source").rlike(r"^src1\d$")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


HS = "lpad(CAST(l_partkey * 37 % 10000 AS VARCHAR), 4, '0')"


@query("p09_route_by_code_prefix", f"""WITH t AS (SELECT {HS} AS c, l_quantity AS q FROM lineitem) SELECT CASE WHEN substr(c, 1, 2) IN ('02', '04') OR c IN ('1601', '1602') THEN 'livestock' WHEN substr(c, 1, 2) = '03' OR c IN ('1603', '1604', '1605', '2501') THEN 'fishery' ELSE 'agri' END AS domain, count(*) AS n, round(sum(q), 2) AS qty FROM t GROUP BY ALL""")
def _(spark, sf):
    c = F.lpad((F.col("l_partkey") * 37 % 10000).cast("string"), 4, "0")
    x = table(spark, sf, "lineitem").select(S.as_col(C.route_hs(c)).alias("domain"), "l_quantity")
    return x.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("p10_zero_fill_by_rule", f"""WITH {OBS}, {daily_sql()}, od AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS t FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY ALL)
SELECT {K}, date, round(CASE WHEN t IS NULL AND date >= DATE '1998-01-03' AND item IN ('ECONOMY', 'PROMO') THEN 0 ELSE t END, 2) AS filled FROM daily LEFT JOIN od USING (date)""")
def _(spark, sf):
    od = table(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("filled"))
    x = daily_prices(spark, sf).join(od, "date", "left")
    x = C.zero_where(x, (F.col("date") >= F.to_date(F.lit("1998-01-03"))) & F.col("item").isin("ECONOMY", "PROMO"), ["filled"])
    return x.select(*SERIES, "date", F.round("filled", 2).alias("filled"))


@query("p11_unit_scaling", "SELECT p_type, 'ton' AS unit, round(sum(CASE WHEN p_size % 2 = 0 THEN l_quantity / 1000 ELSE l_quantity END), 6) AS qty, round(sum(CASE WHEN p_size % 2 = 0 THEN l_extendedprice / 1000 ELSE l_extendedprice END), 4) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", F.when(F.col("p_size") % 2 == 0, "KG").otherwise("ton").alias("unit"))
    x = C.scale_units(table(spark, sf, "lineitem").join(p, "l_partkey"), "unit", "kg", ["l_quantity", "l_extendedprice"], 1000.0, "ton")
    return x.groupBy("p_type", "unit").agg(F.round(F.sum("l_quantity"), 6).alias("qty"), F.round(F.sum("l_extendedprice"), 4).alias("amount"))


@query("p12_price_per_kg", "SELECT p_type, count(*) AS n, round(avg(l_extendedprice / nullif(l_quantity * (p_size % 10) * 100 / 1000, 0)), 6) AS price_kg FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", ((F.col("p_size") % 10) * 100).alias("g"))
    return table(spark, sf, "lineitem").join(p, "l_partkey").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(C.price_per_kg("l_extendedprice", "l_quantity", "g")), 6).alias("price_kg"))


@query("p13_infinite_to_missing", "SELECT l_returnflag AS channel, count(*) AS n, count(CASE WHEN l_discount <> 0 THEN 1 END) AS n_finite, round(sum(CASE WHEN l_discount <> 0 THEN ln(l_tax / l_discount + 1) END), 4) AS total FROM lineitem GROUP BY ALL")
def _(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("channel"), S.finite(S.safe_ln(S.safe_div("l_tax", "l_discount") + 1)).alias("v"))
    return x.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_finite"), F.round(F.sum("v"), 4).alias("total"))


@query("p14_columns_by_prefix", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    drop = C.columns_like(o.columns, "o_order*")
    return o.drop(*[c for c in drop if c != "o_orderkey"]).select("o_orderkey", *[c for c in o.columns if c not in drop])


@query("p15_drop_empty_columns", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(None).cast("string").alias("empty"), "c_name")
    return C.drop_empty_columns(c, ["c_name"])


@query("p16_narrow_floats", "SELECT CAST(l_quantity AS FLOAT) AS qty, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return C.narrow_floats(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("qty"))).groupBy("qty").agg(F.count(F.lit(1)).alias("n"))


@query("p17_required_columns", "SELECT n_name, n_regionkey FROM nation")
def _(spark, sf):
    return C.require_columns(table(spark, sf, "nation"), ["n_name", "n_regionkey"], "nation").select("n_name", "n_regionkey")


@query("p18_calendar_parts", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, year(l_shipdate) AS year, month(l_shipdate) AS month, isodow(l_shipdate) - 1 AS dow, weekofyear(l_shipdate) AS woy, isodow(l_shipdate) >= 6 AS is_weekend FROM lineitem")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return d.select("date", F.year("date").alias("year"), F.month("date").alias("month"), S.weekday("date").alias("dow"), S.iso_week("date").alias("woy"), S.is_weekend("date").alias("is_weekend"))


@query("p19_midnight_belongs_to_day_before", "SELECT CAST(date_trunc('hour', ts) - INTERVAL 1 MINUTE AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").select(S.previous_day_midnight(F.date_trunc("hour", "ts")).alias("date"))
    return e.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


TM = lambda c: f"(SELECT avg({c}) FROM hist WHERE {TR_SQL})"


@query("p20_composite_features", f"""{HIST} SELECT {K}, date, round(CASE WHEN price IS NULL AND base IS NULL THEN NULL ELSE (coalesce(price, 0) + coalesce(base, 0)) / ((price IS NOT NULL)::INT + (base IS NOT NULL)::INT) END, 6) AS raw_mean,
 round((coalesce(price / {TM('price')}, 0) + coalesce(fwd14 / {TM('fwd14')}, 0)) / nullif((price IS NOT NULL)::INT + (fwd14 IS NOT NULL)::INT, 0), 6) AS norm_mean FROM hist""")
def _(spark, sf):
    x = cut_lineage(history(spark, sf).select(*SERIES, "date", "price", "base", "fwd14"))
    x = C.add_composites(x, {"raw_mean": (["price", "base"], "raw"), "norm_mean": (["price", "fwd14"], "norm")}, train_rows())
    return x.select(*SERIES, "date", *r6("raw_mean", "norm_mean"))


@query("p21_item_matched_column", f"{HIST} SELECT {K}, date, round(CASE WHEN item = 'ECONOMY' THEN r7 WHEN item IN ('LARGE', 'PROMO') THEN r28 END, 6) AS matched FROM hist")
def _(spark, sf):
    from ..operators.matching import item_column

    c = item_column([(F.col("item") == "ECONOMY", "r7"), (F.col("item").isin("LARGE", "PROMO"), "r28")])
    return history(spark, sf).select(*SERIES, "date", F.round(c, 6).alias("matched"))


@query("p22_scope_sentinel", f"{HIST} SELECT {K}, date, item IN ('ECONOMY', 'PROMO') AS in_scope, round(CASE WHEN item IN ('ECONOMY', 'PROMO') THEN r28 ELSE -1e9 END, 6) AS r28 FROM hist")
def _(spark, sf):
    x = C.apply_scope(C.mark_scope(history(spark, sf), {"r28": F.col("item").isin("ECONOMY", "PROMO")}))
    return x.select(*SERIES, "date", F.col("_scope__r28").alias("in_scope"), *r6("r28"))


@query("p23_target_clip", f"{HIST}, q AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM hist WHERE {TR_SQL}) SELECT {K}, date, round(greatest(lo, least(hi, y)), 6) AS y FROM hist, q WHERE y IS NOT NULL")
def _(spark, sf):
    x = cut_lineage(history(spark, sf).where("y IS NOT NULL").select(*SERIES, "date", "y"))
    return C.clip_to_train(x, "y", train_rows()).select(*SERIES, "date", *r6("y"))


def _mm(c):
    return f"round((coalesce({c}, (SELECT avg({c}) FROM hist WHERE {TR_SQL}), 0) - (SELECT min({c}) FROM hist WHERE {TR_SQL})) / (SELECT max({c}) - min({c}) FROM hist WHERE {TR_SQL}), 6) AS {c}"


@query("p24_mean_fill_and_minmax", f"{HIST} SELECT {K}, date, {_mm('r28')}, {_mm('yoy')} FROM hist")
def _(spark, sf):
    x = cut_lineage(history(spark, sf).select(*SERIES, "date", "r28", "yoy"))
    return C.fill_and_scale(x, ["r28", "yoy"], train_rows()).select(*SERIES, "date", *r6("r28", "yoy"))


@query("p25_impute_standardise_encode", f"""{HIST}, m AS (SELECT median(yoy) AS md FROM hist WHERE {TR_SQL}), f AS (SELECT hist.*, coalesce(yoy, md) AS v FROM hist, m), s AS (SELECT avg(v) AS a, stddev_pop(v) AS s FROM f WHERE {TR_SQL}),
 lv AS (SELECT item AS it, row_number() OVER (ORDER BY item) - 1 AS slot FROM hist WHERE {TR_SQL} GROUP BY item HAVING count(*) >= 20) SELECT {K}, date, round((v - a) / s, 6) AS yoy, CASE WHEN yoy IS NULL THEN 1.0 ELSE 0.0 END AS missing_yoy, slot AS item_slot FROM f JOIN s ON TRUE LEFT JOIN lv ON it = item""")
def _(spark, sf):
    x = cut_lineage(history(spark, sf).select(*SERIES, "date", "yoy"))
    x = C.encode_levels(C.impute_and_standardise(x, ["yoy"], train_rows()), "item", train_rows())
    return x.select(*SERIES, "date", *r6("yoy"), "missing_yoy", F.col("item_slot").cast("long").alias("item_slot"))


@query("p26_direction_labels", f"{HIST} SELECT {K}, date, CASE WHEN y > 0.01 THEN 1 WHEN y < -0.01 THEN -1 ELSE 0 END AS label, CASE WHEN abs(y) > 0.01 AND abs(y) <= 0.02 THEN '1~2%' WHEN abs(y) > 0.02 AND abs(y) <= 0.05 THEN '2~5%' WHEN abs(y) > 0.05 AND abs(y) <= 0.1 THEN '5~10%' WHEN abs(y) > 0.1 AND abs(y) <= 9.9 THEN '10% 이상' ELSE '보합 (±1% 이내)' END AS size_bin FROM hist")
def _(spark, sf):
    return history(spark, sf).select(*SERIES, "date", S.direction("y").alias("label"), S.size_bin("y").alias("size_bin"))


@query("p27_probability_text", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.09 THEN '큰 변화 없을 것으로 예상' WHEN l_discount * 10 <= 0.5 THEN '신뢰성이 낮으니 판단에 주의하세요' ELSE '4주 뒤 평균이 지금보다 1% 넘게 ' || CASE WHEN l_tax > 0.04 THEN '오를' ELSE '내릴' END || ' 확률 약 ' || CAST(round(l_discount * 1000) AS INT) || '%' END AS card FROM lineitem")
def _(spark, sf):
    x = table(spark, sf, "lineitem")
    prob = F.when(F.col("l_discount") <= 0.09, F.col("l_discount") * 10)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", S.probability_text(prob, F.when(F.col("l_tax") > 0.04, 1.0).otherwise(-1.0)).alias("card"))


@query("p28_sample_weights", f"""WITH {REGION_HIST}, st AS (SELECT channel, region, date, 0 AS is_nat FROM rh WHERE y IS NOT NULL UNION ALL SELECT channel, '*', date, 1 FROM nh WHERE y IS NOT NULL), n AS (SELECT channel AS c, date AS d, count(*) AS n FROM st WHERE is_nat = 0 GROUP BY ALL)
SELECT channel, region, date, is_nat, CASE WHEN is_nat = 1 THEN greatest(coalesce(n, 1), 1)::DOUBLE ELSE 1.0 END AS weight, CASE WHEN date BETWEEN DATE '2020-03-01' AND DATE '2021-12-31' THEN 0.5 ELSE 1.0 END AS half, round(0.3 + 0.7 * (year(date) - 1995) / 6.0, 6) AS linear, round(pow(0.5, (DATE '2001-11-04' - date) / 730.0), 6) AS life FROM st LEFT JOIN n ON c = channel AND d = date""")
def _(spark, sf):
    reg = history(spark, sf, RK).where("y IS NOT NULL").select(*RK, "date", F.lit(0).alias("is_nat"))
    nat = history(spark, sf, ["channel"]).where("y IS NOT NULL").select("channel", F.lit("*").alias("region"), "date", F.lit(1).alias("is_nat"))
    x = C.national_row_weight(cut_lineage(reg.unionByName(nat)), ["channel"], "date", "is_nat")
    return x.select(*RK, "date", "is_nat", "weight", C.covid_weight("date").alias("half"), F.round(C.year_linear_weight("date", 1995, 2001), 6).alias("linear"), F.round(C.half_life_weight("date", "2001-11-04"), 6).alias("life"))


@query("p29_shrunk_target", f"WITH {REGION_HIST}, v AS (SELECT {RKS}, date, y, avg(CASE WHEN {TR_SQL} THEN y END) OVER (PARTITION BY channel, date) AS c FROM rh WHERE y IS NOT NULL) SELECT {RKS}, date, round(CASE WHEN {TR_SQL} AND c IS NOT NULL THEN c + 0.7 * (y - c) ELSE y END, 6) AS target FROM v")
def _(spark, sf):
    x = cut_lineage(history(spark, sf, RK).where("y IS NOT NULL").select(*RK, "date", "y"))
    return C.shrink_to_common(x, ["channel"], "date", "y", 0.7, train_rows(), "target").select(*RK, "date", *r6("target"))


@query("p30_log_target", f"{HIST} SELECT {K}, date, round(ln(1 + y), 6) AS y_log, round(exp(ln(1 + y)) - 1, 6) AS back FROM hist WHERE y IS NOT NULL")
def _(spark, sf):
    x = history(spark, sf).where("y IS NOT NULL").withColumn("l", F.log1p("y"))
    return x.select(*SERIES, "date", F.round("l", 6).alias("y_log"), F.round(F.expm1("l"), 6).alias("back"))


# ---- functions

@query("f01_string_functions", r"""SELECT doc_id, lower(lang) || '-' || upper(source) AS tag, regexp_extract(source, '(\d+)', 1) AS num, replace(source, 'src', 's') AS short, lpad(regexp_extract(source, '(\d+)', 1), 4, '0') AS padded, regexp_matches(text, '(?i)the|la') AS has_article, starts_with(lang, 'e') AS starts_e, ends_with(source, '9') AS ends_9, split_part(text, ' ', 1) AS first_word, substr(text, 3, 5) AS piece, length(regexp_replace(text, '[aeiou]', '', 'g')) AS n_left FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("-", F.lower("lang"), F.upper("source")).alias("tag"), F.regexp_extract("source", r"(\d+)", 1).alias("num"), F.replace(F.col("source"), F.lit("src"), F.lit("s")).alias("short"),
        F.lpad(F.regexp_extract("source", r"(\d+)", 1), 4, "0").alias("padded"), t.rlike("(?i)the|la").alias("has_article"), F.col("lang").startswith("e").alias("starts_e"), F.col("source").endswith("9").alias("ends_9"),
        F.split(t, " ")[0].alias("first_word"), F.substring(t, 3, 5).alias("piece"), F.length(F.regexp_replace(t, "[aeiou]", "")).cast("long").alias("n_left"))


RAW_ING = "'[' || p_type || '] 냉동 ' || p_name || ' (' || p_brand || ') ' || CASE p_size % 4 WHEN 0 THEN '약간' WHEN 1 THEN '적당량' WHEN 2 THEN '또는 무엇이든' ELSE '' END"


def raw_ingredients(spark, sf):
    tail = F.when(F.col("p_size") % 4 == 0, "약간").when(F.col("p_size") % 4 == 1, "적당량").when(F.col("p_size") % 4 == 2, "또는 무엇이든").otherwise("")
    raw = F.concat(F.lit("["), "p_type", F.lit("] 냉동 "), "p_name", F.lit(" ("), "p_brand", F.lit(") "), tail)
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw"))


@query("f02_clean_ingredients", f"""WITH t AS (SELECT p_partkey, {RAW_ING} AS r FROM part), a AS (SELECT p_partkey, trim(regexp_replace(r, '\\(.*?\\)|\\[.*?\\]|<.*?>', '', 'g')) AS r FROM t), b AS (SELECT p_partkey, regexp_replace(r, '(약간|적당량|조금|기호에\\s*따라|선택|옵션|생략가능|또는.*)$', '') AS r FROM a)
SELECT p_partkey, regexp_replace(regexp_replace(r, '^(채썬|썬|삶은|데친|냉동|신선한|손질된|불린|말린|국산|수입산?)\\s*', ''), '\\s+', '', 'g') AS ingredient FROM b""")
def _(spark, sf):
    return raw_ingredients(spark, sf).select("p_partkey", T.clean_ingredient("raw").alias("ingredient"))


@query("f03_menu_names")
def _(spark, sf):
    words = F.array(*[F.lit(w) for w in ("김치 볶음밥", "'된장찌개' 끓이는법", "[백종원] 두부조림 레시피", "콩나물 무침 만들기", "여름 보관법")])
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.get(words, (F.col("p_partkey") % 5).cast("int")), F.lit(" "), "p_name").alias("title"))
    return p.select("p_partkey", "title", T.unify(T.menu_name("title")).alias("menu_name"))


@query("f04_unified_spelling", "SELECT p_partkey, " + "replace(" * 12 + "p_name || CASE p_size % 3 WHEN 0 THEN ' 달걀말이' WHEN 1 THEN ' 오뎅국' ELSE ' 토마토스파게티' END" + "".join(f", '{a}', '{b}')" for a, b in T.V.SAME_DISH) + " AS name FROM part")
def _(spark, sf):
    s = F.col("p_size") % 3
    x = F.concat("p_name", F.when(s == 0, " 달걀말이").when(s == 1, " 오뎅국").otherwise(" 토마토스파게티"))
    return table(spark, sf, "part").select("p_partkey", T.unify(x).alias("name"))


@query("f05_date_functions", """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(last_day(o_orderdate) + 20 AS DATE) AS month_release, CAST(last_day(make_date(year(o_orderdate), 3 * quarter(o_orderdate), 1)) + 60 AS DATE) AS quarter_release, make_date(year(o_orderdate) + 1, 3, 1) AS year_release, strftime(o_orderdate, '%m-%d') AS md, DATE '2001-12-31' - CAST(o_orderdate AS DATE) AS days_left, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders""")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    period = F.concat(F.year("date").cast("string"), F.lpad(F.quarter("date").cast("string"), 2, "0"))
    return d.select("date", S.month_end("date", 20).alias("month_release"), S.quarter_end(period, 60).alias("quarter_release"), S.year_release(F.year("date")).alias("year_release"), F.date_format("date", "MM-dd").alias("md"),
                    F.datediff(F.to_date(F.lit("2001-12-31")), "date").cast("long").alias("days_left"), F.to_date(F.date_trunc("month", F.col("date"))).alias("month"))


@query("f06_math_functions", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity), 6) AS a, round(ln(1 + l_discount), 6) AS b, round(exp(l_tax), 6) AS c, round(exp(l_tax) - 1, 6) AS d, sign(l_discount - 0.05) AS e, greatest(10, least(40, l_quantity)) AS f, floor(l_quantity / 7) AS g, round_even(l_quantity / 2, 0) AS h FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.ln("l_quantity"), 6).alias("a"), F.round(F.log1p("l_discount"), 6).alias("b"), F.round(F.exp("l_tax"), 6).alias("c"), F.round(F.expm1("l_tax"), 6).alias("d"),
        F.signum(F.col("l_discount") - 0.05).alias("e"), F.greatest(F.lit(10.0), F.least(F.lit(40.0), F.col("l_quantity"))).alias("f"), F.floor(F.col("l_quantity") / 7).alias("g"), F.rint(F.col("l_quantity") / 2).alias("h"))


@query("f07_arrays_and_json", """WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[,:]')) AS w, generate_subscripts(string_split_regex(text, '[,:]'), 1) AS i FROM documents), d AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL)
SELECT doc_id, count(*) AS n_distinct, md5(string_agg(w, '|' ORDER BY i)) AS joined FROM d GROUP BY ALL""")
def _(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", F.array_distinct(F.from_json(F.to_json(F.split("text", "[,:]")), "array<string>")).alias("a"))
    return x.select("doc_id", F.size("a").cast("long").alias("n_distinct"), F.md5(F.array_join("a", "|")).alias("joined"))


@query("f08_map_lookup", "SELECT CASE l_returnflag WHEN 'A' THEN 'agri' WHEN 'R' THEN 'livestock' END AS domain, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(S.pick({"A": "agri", "R": "livestock"}, "l_returnflag").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("f09_select_and_where", f"{HIST} SELECT {K}, date, CASE WHEN r28 <= -0.02 THEN 1 WHEN r28 >= 0.02 THEN -1 ELSE 0 END AS trend FROM hist")
def _(spark, sf):
    return history(spark, sf).select(*SERIES, "date", F.when(F.col("r28") <= -0.02, 1).when(F.col("r28") >= 0.02, -1).otherwise(0).alias("trend"))


# ---- sources and sinks

ORD = "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL"


def by_priority(df):
    return df.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


@query("s01_land_pieces_once", ORD)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    src, dst, ck = [scratch(spark, n) for n in ("src", "dst", "ck")]
    o.where("o_orderkey % 2 = 0").repartition(4).write.parquet(src)
    land_new_files(spark, src, o.schema, dst, ck)
    o.where("o_orderkey % 2 = 1").repartition(4).write.mode("append").parquet(src)
    land_new_files(spark, src, o.schema, dst, ck)
    return by_priority(spark.read.parquet(dst))


@query("s01_land_and_aggregate", ORD)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    src, dst, ck = [scratch(spark, n) for n in ("src", "dst", "ck")]
    o.repartition(4).write.parquet(src)
    agg = lambda b: b.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    land_and_aggregate(spark, src, o.schema, dst, ck, agg)
    x = spark.read.parquet(dst)
    return x.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.sum("n").alias("n"), F.round(F.sum("t"), 2).alias("total"))


@query("s02_union_pieces_by_name", "SELECT o_orderpriority AS priority, count(*) AS n, count(CASE WHEN o_orderkey % 3 > 0 THEN 1 END) AS n_status, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def _(spark, sf):
    o = table(spark, sf, "orders")
    root = scratch(spark, "pieces")
    o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderpriority", "o_totalprice").write.parquet(f"{root}/a/x")
    o.where("o_orderkey % 3 > 0").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").write.parquet(f"{root}/b")
    x = IO.read_pieces(spark, root, "*.parquet")
    return x.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.count("o_orderstatus").alias("n_status"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s03_text_csv_with_byte_mark", "SELECT lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS code, o_orderpriority AS priority FROM orders")
def _(spark, sf):
    root = scratch(spark, "csv")
    x = table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 19, "0").alias("\ufeffcode"), F.col("o_orderpriority").alias("priority"))
    x.write.option("header", True).csv(root)  # every file starts with the mark, as exported sheets do
    return IO.read_text_csv(spark, root).select("code", "priority")


@query("s04_csv_ms949", "SELECT s_suppkey AS k, '부이 ' || s_name AS name FROM supplier")
def _(spark, sf):
    root = scratch(spark, "csv949")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("지점"), F.concat(F.lit("부이 "), "s_name").alias("이름")).write.option("header", True).option("encoding", "MS949").csv(root)
    x = IO.read_text_csv(spark, root, encoding="cp949")
    return x.select(F.col("지점").cast("long").alias("k"), F.col("이름").alias("name"))


@query("s05_xml_items", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL")
def _(spark, sf):
    root = scratch(spark, "xml")
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("string").alias("bal"))
    c.write.format("xml").option("rowTag", "item").option("rootTag", "items").save(root)
    x = IO.read_items_xml(spark, root, "item", c.schema)
    return x.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(S.parse_number("bal")), 2).alias("total"))


@query("s06_json_flatten_children", "SELECT event_id, event_type AS news, CASE WHEN event_id % 5 > 0 THEN user_id END AS area, CASE WHEN event_id % 5 > 0 THEN 1 END AS pos FROM events UNION ALL SELECT event_id, event_type, user_id + 1, 2 FROM events WHERE event_id % 5 > 1")
def _(spark, sf):
    e = table(spark, sf, "events")
    kids = F.array_compact(F.array(F.when(F.col("event_id") % 5 > 0, F.struct(F.col("user_id").alias("area"), F.lit(1).alias("pos"))), F.when(F.col("event_id") % 5 > 1, F.struct((F.col("user_id") + 1).alias("area"), F.lit(2).alias("pos")))))
    body = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("news"), kids.alias("item2"))).alias("items")))
    schema = "items array<struct<news string, item2 array<struct<area bigint, pos int>>>>"
    return IO.flatten_bodies(e.select("event_id", body.alias("body")), "body", schema, "items", "item2")


@query("s07_column_pruned_scan", "SELECT l_returnflag AS channel, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_quantity").groupBy(F.col("l_returnflag").alias("channel")).agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("s08_pushed_filter_scan", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def _(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("s09_partitioned_parquet_sink", "SELECT l_returnflag AS domain, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL")
def _(spark, sf):
    root = scratch(spark, "sink")
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("domain"), "l_extendedprice")
    IO.write_table(x, root, ["domain"])
    return spark.read.parquet(root).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("s10_csv_sink", ORD)
def _(spark, sf):
    root = scratch(spark, "csvout")
    IO.write_csv(table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), root)
    return by_priority(spark.read.option("header", True).csv(root))


@query("s11_stored_frame", f"WITH {OBS}, {daily_sql()} SELECT {K}, count(*) AS n, round(sum(price), 4) AS total FROM daily GROUP BY ALL")
def _(spark, sf):
    root = scratch(spark, "frame")
    build = lambda: daily_prices(spark, sf)
    IO.stored(spark, root, build)
    x = IO.stored(spark, root, lambda: 1 / 0)  # the second call must reuse the table
    return x.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query("s12_calendar", "WITH c AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS date) SELECT date, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = date) AS n FROM c")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return W.densify(o, [], "date", ["n"]).select("date", "n")


@query("s13_page_parts", r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages""")
def _(spark, sf):
    x = PG.page_parts(table(spark, sf, "pages"), "page_id", "html")
    return x.select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("n_links").cast("long").alias("n_links"), F.col("n_paragraphs").cast("long").alias("n_paragraphs"))


@query("s13_recipe_pages", r"""SELECT page_id, 'dish ' || page_id AS name, 'https://x/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN '2인분' END AS servings, page_id * 1000 AS views, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS n_ingredients, CASE WHEN page_id % 3 = 0 THEN '[["a' || page_id || '","1"],["b","2"]]' ELSE '[["x' || page_id || '",""]]' END AS ingredients FROM pages""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id").cast("string")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"Recipe","name":"dish '), k, F.lit('","recipeIngredient":["x'), k, F.lit('"]}</script>'))
    one = lambda n, a: F.concat(F.lit('<div class="ingre_list_name">\n<a href="#"> '), n, F.lit(' </a></div>\n<span class="ingre_list_ea">'), F.lit(a), F.lit("</span>"))
    ing = F.when(F.col("page_id") % 3 == 0, F.concat(one(F.concat(F.lit("a"), k), "1"), one(F.lit("b"), "2"))).otherwise("")
    serv = F.when(F.col("page_id") % 2 == 0, '<span class="view2_summary_info1">2인분</span>').otherwise("")
    views = F.concat(F.lit('<span class="hit font_num">'), F.format_number(F.col("page_id") * 1000, 0), F.lit("</span>"))
    x = PG.parse_pages(p.select("page_id", F.concat("html", ld, ing, serv, views).alias("html")), "page_id", "html", "https://x/")
    return x.select("page_id", "name", "url", "servings", "views", F.col("n_ingredients").cast("long").alias("n_ingredients"), "ingredients")


@query("s14_ids_by_keyword", "WITH t AS (SELECT doc_id % 300 AS id, source AS kw, doc_id % 7 AS page, doc_id FROM documents), f AS (SELECT id, kw, min(doc_id) AS p FROM t GROUP BY ALL) SELECT id, string_agg(kw, ';' ORDER BY p) AS keywords, (SELECT min(page) FROM t WHERE t.id = f.id) AS first_page FROM f GROUP BY ALL")
def _(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 300).alias("id"), F.col("source").alias("kw"), (F.col("doc_id") % 7).alias("page"), "doc_id")
    return PG.ids_by_keyword(d, "id", "kw", "page", "doc_id").select("id", "keywords", "first_page")
