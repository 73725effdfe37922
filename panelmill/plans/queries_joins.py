"""Join queries: lookups, as-of, prefix, interval, matching, overrides, fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import log_ratio, safe_div
from ..operators import matching as M
from ..operators import windows as W
from ..operators.asof import Fact, asof_backward, asof_forward_days
from .queries_windows import HIST, K, LATEST, REGION_HIST, RK, RKS, history, r6, regional, s6
from .registry import query
from .roles import FACTS, OBS, SERIES, daily_prices, daily_sql, monthly_facts, observations, table
from ..functions.quantiles import exact_median
from ..session import cut_lineage

DAYS_ORDERS = """od AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY ALL)"""


def order_days(spark, sf):
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))


@query("j01_daily_fact_left_join", f"WITH {OBS}, {daily_sql()}, {DAYS_ORDERS} SELECT {K}, date, round(price, 6) AS price, round(total, 2) AS total, n FROM daily LEFT JOIN od USING (date)")
def _(spark, sf):
    return daily_prices(spark, sf).join(order_days(spark, sf), "date", "left").select(*SERIES, "date", *r6("price"), F.round("total", 2).alias("total"), "n")


@query("j02_dimension_lookup", """SELECT n_name AS nation, r_name AS region, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS amount, count(DISTINCT l_suppkey) AS n_markets
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    # Pre-aggregate per supplier, so the lookup joins touch suppliers instead of line items.
    per = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("a"))
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nat = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"), "n_regionkey")
    reg = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    x = per.join(sup, "l_suppkey", "left").join(nat, "s_nationkey", "left").join(reg, "n_regionkey", "left")
    return x.groupBy("nation", "region").agg(F.sum("n").alias("n_rows"), F.round(F.sum("a"), 2).alias("amount"), F.count("l_suppkey").alias("n_markets"))


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
WIDE = "wide AS (SELECT avail, " + ", ".join(f"sum(CASE WHEN priority = '{p}' THEN total END) AS {n}" for p, n in PRIORITIES.items()) + " FROM facts GROUP BY avail)"


@query("j03_asof_published_facts", f"""WITH {OBS}, {daily_sql()}, {FACTS}, {WIDE}
SELECT {K}, date, round(price, 6) AS price, {", ".join(f"round({n}, 2) AS {n}" for n in PRIORITIES.values())} FROM daily ASOF LEFT JOIN wide ON daily.date >= wide.avail""")
def _(spark, sf):
    w = monthly_facts(spark, sf).groupBy("avail").pivot("priority", list(PRIORITIES)).agg(F.sum("total"))
    w = w.select("avail", *[F.col(f"`{p}`").alias(n) for p, n in PRIORITIES.items()])
    x = asof_backward(daily_prices(spark, sf), "date", [Fact(w, "avail", list(PRIORITIES.values()))])
    return x.select(*SERIES, "date", *r6("price"), *[F.round(n, 2).alias(n) for n in PRIORITIES.values()])


@query("j03_asof_by_key", f"""WITH {FACTS} SELECT o_orderkey, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS date, round(total, 2) AS total, n_orders, facts.month AS fact_month
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) o ASOF LEFT JOIN facts ON o.o_orderpriority = facts.priority AND o.d >= facts.avail""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("date"))
    f = monthly_facts(spark, sf).withColumnRenamed("month", "fact_month")
    x = asof_backward(o, "date", [Fact(f, "avail", ["total", "n_orders", "fact_month"])], ["priority"])
    return x.select("o_orderkey", "priority", "date", F.round("total", 2).alias("total"), "n_orders", "fact_month")


@query("j03_asof_missing_value_kept", f"""WITH {FACTS}, f AS (SELECT avail, CASE WHEN month(month) % 2 = 0 THEN t END AS total, month FROM (SELECT avail, month, sum(total) AS t FROM facts GROUP BY avail, month)),
d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT date, round(total, 2) AS total, month AS fact_month FROM d ASOF LEFT JOIN f ON date >= avail""")
def _(spark, sf):
    f = monthly_facts(spark, sf).groupBy("avail", F.col("month").alias("fact_month")).agg(F.sum("total").alias("t"))
    f = f.withColumn("total", F.when(F.month("fact_month") % 2 == 0, F.col("t")))
    d = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return asof_backward(d, "date", [Fact(f, "avail", ["total", "fact_month"])]).select("date", F.round("total", 2).alias("total"), "fact_month")


@query("j04_days_to_next_mark", """WITH od AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY ALL),
mk AS (SELECT date AS m FROM od WHERE n >= (SELECT quantile_cont(n, 0.99) FROM od)), d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT date, m - date AS days_to_mark FROM d ASOF LEFT JOIN mk ON date <= m""")
def _(spark, sf):
    from ..functions.quantiles import exact_quantiles

    od = order_days(spark, sf)
    q = exact_quantiles(od, [], "n", {"q": 0.99})
    marks = od.crossJoin(F.broadcast(q)).where("n >= q")  # one row
    d = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return asof_forward_days(d, "date", marks, "date", "days_to_mark").select("date", F.col("days_to_mark").cast("long").alias("days_to_mark"))


@query("j05_asof_with_tolerance", f"""{HIST} SELECT {K}, date, round({LATEST('base', 28, 73)}, 6) AS base_28d_ago, round(ln(base / ({LATEST('base', 28, 73)})), 6) AS chg28 FROM hist""")
def _(spark, sf):
    f = W.DayFrames(SERIES, "date")
    x = history(spark, sf).select("*", f.latest_within("base", 28, 73).alias("p"))
    return x.select(*SERIES, "date", F.round("p", 6).alias("base_28d_ago"), F.round(log_ratio("base", "p"), 6).alias("chg28"))


@query("j06_exact_lag_364", f"""{HIST} SELECT a.item, a.channel, a.date, round(a.base, 6) AS base, round(b.base, 6) AS base_last_year FROM hist a LEFT JOIN hist b ON a.item = b.item AND a.channel = b.channel AND a.date = b.date + 364""")
def _(spark, sf):
    f = W.DayFrames(SERIES, "date")
    return history(spark, sf).select(*SERIES, "date", *r6("base"), F.round(f.at("base", 364), 6).alias("base_last_year"))


@query("j07_prefix_join", """WITH codes AS (SELECT DISTINCT lpad(CAST(p_partkey AS VARCHAR), 19, '0') AS code FROM part),
pre AS (SELECT p_brand AS item, unnest(string_split(string_agg(DISTINCT substr(lpad(CAST(p_partkey AS VARCHAR), 19, '0'), 1, 18), ';'), ';')) AS pre FROM part WHERE p_size >= 45 GROUP BY p_brand),
pairs AS (SELECT DISTINCT item, code FROM pre JOIN codes ON starts_with(code, pre))
SELECT item, count(*) AS n_codes, round(sum(qty), 2) AS qty, round(sum(amount), 2) AS amount FROM pairs
JOIN (SELECT lpad(CAST(l_partkey AS VARCHAR), 19, '0') AS code, sum(l_quantity) AS qty, sum(l_extendedprice) AS amount FROM lineitem GROUP BY ALL) t USING (code) GROUP BY item""")
def _(spark, sf):
    code = lambda c: F.lpad(F.col(c).cast("string"), 19, "0")
    p = table(spark, sf, "part")
    items = p.where("p_size >= 45").groupBy(F.col("p_brand").alias("item")).agg(F.array_join(F.collect_set(F.substring(code("p_partkey"), 1, 18)), ";").alias("prefixes"))
    pre = M.explode_list(items, "prefixes", "pre")
    pairs = M.prefix_pairs(pre, ["item"], "pre", p.select(code("p_partkey").alias("code")), "code")
    t = table(spark, sf, "lineitem").groupBy(code("l_partkey").alias("code")).agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("a"))
    return pairs.join(t, "code").groupBy("item").agg(F.count(F.lit(1)).alias("n_codes"), F.round(F.sum("q"), 2).alias("qty"), F.round(F.sum("a"), 2).alias("amount"))


@query("j08_bridge_join", f"""WITH {OBS}, lnk AS (SELECT item, unnest(string_split(keys, ';')) AS k FROM (SELECT p_type AS item, string_agg(DISTINCT p_type || '>' || p_brand, ';') AS keys FROM part WHERE p_size <= 25 GROUP BY ALL)),
tr AS (SELECT item || '>' || brand AS k, date, sum(qty) AS q, sum(amount) AS a FROM obs GROUP BY ALL)
SELECT lnk.item, date, count(*) AS n_keys, round(sum(q), 2) AS qty, round(sum(a), 2) AS amount FROM tr JOIN lnk USING (k) GROUP BY ALL""")
def _(spark, sf):
    p = table(spark, sf, "part").where("p_size <= 25")
    link = p.groupBy(F.col("p_type").alias("item")).agg(F.array_join(F.collect_set(F.concat_ws(">", "p_type", "p_brand")), ";").alias("keys"))
    link = M.explode_list(link, "keys", "k").select("item", "k")
    tr = observations(spark, sf).groupBy(F.concat_ws(">", "item", "brand").alias("k"), "date").agg(F.sum("qty").alias("q"), F.sum("amount").alias("a"))
    return tr.join(link, "k").groupBy("item", "date").agg(F.count(F.lit(1)).alias("n_keys"), F.round(F.sum("q"), 2).alias("qty"), F.round(F.sum("a"), 2).alias("amount"))


# count units by part size band; the table has variety hits ("red", "small") and default rows
UNITS_SQL = """ut AS (SELECT * FROM (VALUES ('ECONOMY', 'box', 'red', 400.0, 'a', 0), ('ECONOMY', 'box', '', 500.0, 'b', 1), ('LARGE', 'box', 'small', 250.0, 'c', 2), ('PROMO', 'bag', '', 900.0, 'd', 3), ('SMALL', 'bag', 'hot', 120.0, 'e', 4), ('SMALL', 'bag', '', 150.0, 'f', 5)) t(item_nm, unit, vrty_contains, g, source, line)),
un AS (SELECT p_partkey, p_type, p_name, CASE WHEN p_size <= 10 THEN 'kg(5)' WHEN p_size <= 20 THEN 'g' WHEN p_size <= 25 THEN 'L' WHEN p_size <= 38 THEN 'box' ELSE 'bag' END AS unit FROM part)"""
UNIT_ROWS = [("ECONOMY", "box", "red", 400.0, "a", 0), ("ECONOMY", "box", None, 500.0, "b", 1), ("LARGE", "box", "small", 250.0, "c", 2), ("PROMO", "bag", None, 900.0, "d", 3), ("SMALL", "bag", "hot", 120.0, "e", 4), ("SMALL", "bag", None, 150.0, "f", 5)]


@query("j09_unit_priority_match", f"""WITH {UNITS_SQL}, c AS (SELECT un.*, g, source, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN vrty_contains <> '' AND contains(p_name, vrty_contains) THEN 0 WHEN vrty_contains = '' THEN 1 ELSE 2 END, line) AS r,
 CASE WHEN vrty_contains <> '' AND contains(p_name, vrty_contains) THEN 0 WHEN vrty_contains = '' THEN 1 END AS tier FROM un LEFT JOIN ut ON item_nm = p_type AND ut.unit = un.unit),
b AS (SELECT p_partkey, unit, CASE WHEN starts_with(unit, 'kg') OR unit = 'L' THEN 1000.0 WHEN unit = 'g' THEN 1.0 WHEN tier IS NOT NULL THEN g END AS unit_g,
 CASE WHEN starts_with(unit, 'kg') OR unit IN ('L', 'g') THEN 'weight' WHEN tier IS NOT NULL THEN 'table:' || source ELSE 'missing' END AS unit_g_source FROM c WHERE r = 1)
SELECT unit, unit_g, unit_g_source, count(*) AS n, round(avg(l_extendedprice / (l_quantity * unit_g / 1000)), 4) AS avg_price_kg FROM lineitem JOIN b ON l_partkey = p_partkey GROUP BY ALL""")
def _(spark, sf):
    t = spark.createDataFrame(UNIT_ROWS, "item_nm string, unit string, vrty_contains string, g_per_unit double, source string, line int")
    s = F.col("p_size")
    unit = F.when(s <= 10, "kg(5)").when(s <= 20, "g").when(s <= 25, "L").when(s <= 38, "box").otherwise("bag")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name", unit.alias("unit"))
    g = M.unit_grams(p, t, "p_type", "p_name", "unit").select("l_partkey", "unit", "unit_g", "unit_g_source")
    x = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity").join(g, "l_partkey")
    return x.groupBy("unit", "unit_g", "unit_g_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(safe_div("l_extendedprice", F.col("l_quantity") * F.col("unit_g") / 1000)), 4).alias("avg_price_kg"))


ALIAS_ROWS = [("s", "single"), ("that", "that"), ("tion", "tion"), ("ation", "ation"), ("tionble", "tionble"), ("the", "the"), ("eaux", "eaux"), ("ment", "ment"), ("umentvi", "umentvi")]


@query("j10_longest_alias_match", """WITH al AS (SELECT * FROM (VALUES ('s', 'single', 0), ('that', 'that', 1), ('tion', 'tion', 2), ('ation', 'ation', 3), ('tionble', 'tionble', 4), ('the', 'the', 5), ('eaux', 'eaux', 6), ('ment', 'ment', 7), ('umentvi', 'umentvi', 8)) t(alias, item, rk)),
wd AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '' GROUP BY w),
m AS (SELECT w, n, item, row_number() OVER (PARTITION BY w ORDER BY length(alias) DESC, rk) AS r FROM wd JOIN al ON CASE WHEN length(alias) = 1 THEN w = alias ELSE contains(w, alias) END)
SELECT item, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n_uses, max(w) AS last_word FROM m WHERE r = 1 GROUP BY item""")
def _(spark, sf):
    al = spark.createDataFrame([(a, i, k) for k, (a, i) in enumerate(ALIAS_ROWS)], "alias string, item string, rank int")
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = cut_lineage(words)
    m = M.first_contained(words, "w", al, ["item"])
    return words.join(m, "w").groupBy("item").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_uses"), F.max("w").alias("last_word"))


SEASON_ROWS = [("ECONOMY", "", "04-01", "06-30"), ("ECONOMY", "1997", "04-23", "05-22"), ("ECONOMY", "1999", "04-12", "05-12"), ("LARGE", "", "05-01", "07-15"), ("PROMO", "", "11-01", "12-31")]
SEASON_SQL = "se AS (SELECT * FROM (VALUES " + ", ".join(repr(r) for r in SEASON_ROWS) + ") t(item_nm, yr, a, b))"


def seasons(spark, sf):
    s = spark.createDataFrame(SEASON_ROWS, "item_nm string, year string, start_md string, end_md string")
    return M.season_windows(daily_prices(spark, sf).select(*SERIES, "date", "price"), s, "item", "date")


SEASON_X = f"""{OBS}, {daily_sql()}, {SEASON_SQL}, ru AS (SELECT item_nm AS item, a, b FROM se WHERE yr = ''), ye AS (SELECT item_nm AS item, CAST(yr AS INT) AS yr, a AS ya, b AS yb FROM se WHERE yr <> ''),
hy AS (SELECT DISTINCT item, TRUE AS has FROM ye),
x AS (SELECT daily.item, channel, date, strftime(date, '%m-%d') AS md, year(date) AS y, a, b, y1.ya, y1.yb, y2.ya AS na, has FROM daily LEFT JOIN ru ON ru.item = daily.item LEFT JOIN hy ON hy.item = daily.item
 LEFT JOIN ye y1 ON y1.item = daily.item AND y1.yr = year(date) LEFT JOIN ye y2 ON y2.item = daily.item AND y2.yr = year(date) + 1)"""


@query("j11_closed_season", f"""WITH {SEASON_X} SELECT {K}, date, CASE WHEN a IS NULL THEN 0.0 WHEN md BETWEEN a AND b THEN 1.0 ELSE 0.0 END AS closed_window,
 CASE WHEN has THEN CASE WHEN ya IS NOT NULL THEN CASE WHEN md BETWEEN ya AND yb THEN 1.0 ELSE 0.0 END END WHEN a IS NULL THEN 0.0 WHEN md BETWEEN a AND b THEN 1.0 ELSE 0.0 END AS closed_season FROM x""")
def _(spark, sf):
    return seasons(spark, sf).select(*SERIES, "date", "closed_window", "closed_season")


@query("j12_days_to_season_start", f"""WITH {SEASON_X}, t AS (SELECT {K}, date, CAST(y || '-' || coalesce(ya, a) AS DATE) AS s1, CAST((y + 1) || '-' || coalesce(na, a) AS DATE) AS s2 FROM x)
SELECT {K}, date, CASE WHEN s1 >= date THEN s1 - date ELSE s2 - date END AS days_to_closed_start FROM t""")
def _(spark, sf):
    return seasons(spark, sf).select(*SERIES, "date", F.col("days_to_closed_start").cast("long").alias("days_to_closed_start"))


@query("j13_semi_join", """SELECT l_returnflag AS channel, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL""")
def _(spark, sf):
    u = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(u, "l_orderkey", "left_semi").groupBy(F.col("l_returnflag").alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("j14_anti_join_flagged_days", """WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date FROM lineitem GROUP BY ALL HAVING max(l_discount) >= 0.1)
SELECT l_suppkey AS market, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.l_suppkey = l.l_suppkey AND d.date = CAST(l.l_shipdate AS DATE)) GROUP BY ALL""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    bad = li.groupBy("l_suppkey", "date").agg(F.max("l_discount").alias("m")).where("m >= 0.1").select("l_suppkey", "date")
    return li.join(bad, ["l_suppkey", "date"], "left_anti").groupBy(F.col("l_suppkey").alias("market")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("j15_national_history_and_premium", f"WITH {REGION_HIST} SELECT {RKS}, date, {s6('base', 'nat_base', 'premium')} FROM pr")
def _(spark, sf):
    return regional(spark, sf).select(*RK, "date", *r6("base", "nat_base", "premium"))


@query("j16_override_table", """WITH ov AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN 'exclude' ELSE upper(p_name) END AS label FROM part WHERE p_size >= 40)
SELECT label, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM (SELECT l_extendedprice, nullif(coalesce(ov.label, part.p_name), 'exclude') AS label FROM lineitem JOIN part ON l_partkey = part.p_partkey LEFT JOIN ov ON ov.p_partkey = part.p_partkey) GROUP BY ALL""")
def _(spark, sf):
    p = table(spark, sf, "part")
    ov = p.where("p_size >= 40").select("p_partkey", F.when(F.col("p_size") == 50, "exclude").otherwise(F.upper("p_name")).alias("label"))
    named = M.override(p.select("p_partkey", F.col("p_name").alias("label")), ov, "p_partkey", "label", "exclude")
    x = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_extendedprice").join(named, "p_partkey")
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("j17_fallback_lookup", f"""WITH {OBS}, rg AS (SELECT channel, region, date, median(price) AS p FROM obs WHERE price > 0 AND qty >= 20 GROUP BY ALL), nt AS (SELECT channel, date, median(price) AS p FROM obs WHERE price > 0 AND qty >= 40 GROUP BY ALL),
rq AS (SELECT DISTINCT channel, region, date FROM obs), al AS (SELECT channel, date AS hd, max(p) AS p FROM (SELECT channel, date, p FROM rg UNION ALL SELECT channel, date, p FROM nt) GROUP BY ALL),
la AS (SELECT rq.*, al.p AS lp, al.hd FROM rq ASOF LEFT JOIN al ON rq.channel = al.channel AND rq.date >= al.hd)
SELECT la.channel, la.region, la.date, round(coalesce(rg.p, nt.p, lp), 6) AS price, CASE WHEN rg.p IS NOT NULL THEN 'region' WHEN nt.p IS NOT NULL THEN 'national' WHEN lp IS NOT NULL THEN 'last' ELSE 'none' END AS source,
 CASE WHEN rg.p IS NULL AND nt.p IS NULL AND lp IS NOT NULL THEN hd END AS last_day FROM la LEFT JOIN rg ON rg.channel = la.channel AND rg.region = la.region AND rg.date = la.date LEFT JOIN nt ON nt.channel = la.channel AND nt.date = la.date""")
def _(spark, sf):
    o = observations(spark, sf, True).where("price > 0")
    reg = exact_median(o.where("qty >= 20"), [*RK, "date"], "price", "price")
    nat = exact_median(o.where("qty >= 40"), ["channel", "date"], "price", "price").withColumn("region", F.lit("*"))
    req = observations(spark, sf, True).select(*RK, "date")
    x = M.fallback_rows(req, reg.unionByName(nat), "channel", "region", "date", "*", "price")
    return x.select(*RK, "date", *r6("price"), "source", "last_day")


@query("j18_catalogue_match", f"""WITH {OBS}, a AS (SELECT status AS d, brand AS a, floor(price / 200) AS p, count(*) AS na FROM obs WHERE channel = 'A' GROUP BY ALL), b AS (SELECT status AS d, pname AS b, floor(price / 200) AS p, count(*) AS nb FROM obs WHERE channel = 'N' GROUP BY ALL),
ta AS (SELECT d, a, sum(na) AS ta FROM a GROUP BY ALL), tb AS (SELECT d, b, sum(nb) AS tb FROM b GROUP BY ALL),
i AS (SELECT d, a, b, sum(least(na, nb)) AS i FROM a JOIN b USING (d, p) GROUP BY ALL),
s AS (SELECT a, b, sum(i / (ta + tb - i)) / 2 AS score FROM i JOIN ta USING (d, a) JOIN tb USING (d, b) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY round(score, 9) DESC, a) AS rb FROM s)
SELECT a AS brand, b AS pname, round(score, 6) AS score, score >= 0.5 AS confident FROM r WHERE ra = 1 AND rb = 1""")
def _(spark, sf):
    o = observations(spark, sf).select("status", "brand", "pname", "channel", F.floor(F.col("price") / 200).alias("p"))
    x = M.catalogue_matches(o.where("channel = 'A'"), "brand", o.where("channel = 'N'"), "pname", "status", "p", 2)
    return x.select("brand", "pname", *r6("score"), "confident")


@query("j19_duplicate_series", f"""WITH {OBS}, d0 AS (SELECT brand, date, median(price) AS price FROM obs WHERE price > 0 GROUP BY ALL),
d AS (SELECT brand || '/' || v AS s, date, CASE WHEN v = 'c' AND day(date) = 31 THEN price * 1.5 WHEN v = 'd' AND day(date) > 25 THEN price * 1.5 ELSE price END AS price FROM d0, (VALUES ('a'), ('c'), ('d')) t(v)),
p AS (SELECT a.s AS series_a, b.s AS series_b, count(*) AS shared_days, avg(CASE WHEN abs(a.price - b.price) <= 1e-8 + 1e-6 * abs(b.price) THEN 1.0 ELSE 0.0 END) AS same_share FROM d a JOIN d b ON a.date = b.date AND a.s < b.s GROUP BY ALL)
SELECT series_a, series_b, shared_days, round(same_share, 6) AS same_share FROM p WHERE shared_days >= 200 AND same_share >= 0.95""")
def _(spark, sf):
    d0 = exact_median(observations(spark, sf).where("price > 0"), ["brand", "date"], "price", "price")
    d = d0.withColumn("v", F.explode(F.array(*[F.lit(v) for v in "acd"])))
    off = ((F.col("v") == "c") & (F.dayofmonth("date") == 31)) | ((F.col("v") == "d") & (F.dayofmonth("date") > 25))
    d = d.select(F.concat_ws("/", "brand", "v").alias("s"), "date", F.when(off, F.col("price") * 1.5).otherwise(F.col("price")).alias("price"))
    return M.duplicate_series(d, "s", "date", "price").select("series_a", "series_b", "shared_days", *r6("same_share"))
