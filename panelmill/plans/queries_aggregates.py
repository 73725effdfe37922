"""Aggregation and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import exact_median, exact_quantiles
from ..functions.scalars import pick, safe_div
from ..operators import aggregates as A
from ..operators import profile as P
from ..operators import repair as R
from ..operators import windows as W
from ..session import cut_lineage
from .queries_windows import HIST, K, ORIGIN, TRADE_DAY, WPROD, area_weather, event_weather, history, market_days, r6, s6, trade_days
from .registry import query
from .roles import FACTS, OBS, SERIES, SqlFrames, daily_prices, daily_sql, event_days, history_sql, monthly_facts, observations, table

D = SqlFrames(SERIES)


@query("a01_daily_median_national", f"WITH {OBS}, {daily_sql()} SELECT {K}, date, {s6('price')} FROM daily")
def _(spark, sf):
    return daily_prices(spark, sf).select(*SERIES, "date", *r6("price"))


@query("a01_daily_median_regional", f"WITH {OBS}, {daily_sql(['channel', 'region'])} SELECT channel, region, date, {s6('price')} FROM daily")
def _(spark, sf):
    return daily_prices(spark, sf, ["channel", "region"]).select("channel", "region", "date", *r6("price"))


@query("a02_trade_totals", f"WITH {OBS} SELECT date, item, brand, status, round(coalesce(sum(qty), 0), 2) AS qty, round(coalesce(sum(amount), 0), 2) AS amount, count(*) AS n_trades, round(sum(amount) / sum(qty), 6) AS avg_price FROM obs GROUP BY ALL")
def _(spark, sf):
    x = A.trade_totals(observations(spark, sf).select("date", "item", "brand", "status", F.col("qty").alias("q"), F.col("amount").alias("a")), ["date", "item", "brand", "status"], "q", "a")
    return x.select("date", "item", "brand", "status", F.round("qty", 2).alias("qty"), F.round("amount", 2).alias("amount"), "n_trades", F.round("avg_price", 6).alias("avg_price"))


@query("a03_totals_with_kept_unit", f"""WITH {OBS}, t AS (SELECT date, item, status, sum(qty) AS q, sum(amount) AS a, count(*) AS n FROM obs GROUP BY ALL)
SELECT date, item, round(sum(a), 2) AS amount, CAST(sum(n) AS BIGINT) AS n_trades, round(sum(CASE WHEN status = 'F' THEN q END), 2) AS qty_kg, round(sum(CASE WHEN status = 'F' THEN a END) / sum(CASE WHEN status = 'F' THEN q END), 6) AS avg_price_kg FROM t GROUP BY ALL""")
def _(spark, sf):
    t = observations(spark, sf).groupBy("date", "item", "status").agg(F.sum("qty").alias("q"), F.sum("amount").alias("a"), F.count(F.lit(1)).alias("n"))
    x = A.totals_with_unit(t, ["date", "item"], "status", "F", "q", "a", "n")
    return x.select("date", "item", F.round("amount", 2).alias("amount"), "n_trades", F.round("qty_kg", 2).alias("qty_kg"), F.round("avg_price_kg", 6).alias("avg_price_kg"))


@query("a04_station_and_national_means", f"""WITH {OBS}, st AS (SELECT date, market, avg(price) AS m, max(price) AS mx, count(price) AS n FROM obs GROUP BY ALL)
SELECT date, round(avg(m), 6) AS mean_price, round(max(mx), 6) AS max_price, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_stations FROM st GROUP BY ALL""")
def _(spark, sf):
    st = observations(spark, sf).groupBy("date", "market").agg(F.avg("price").alias("m"), F.max("price").alias("mx"), F.count("price").alias("n"))
    return st.groupBy("date").agg(F.round(F.avg("m"), 6).alias("mean_price"), F.round(F.max("mx"), 6).alias("max_price"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_stations"))


HOURS = "hr AS (SELECT user_id % 50 AS station, event_type, CAST(ts - INTERVAL 1 MINUTE AS DATE) AS date, value FROM events)"


def hours(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 50).alias("station"), "event_type", F.to_date(F.col("ts") - F.expr("INTERVAL 1 MINUTE")).alias("date"), "value")


@query("a05_quality_gated_mean", f"WITH {HOURS}, d AS (SELECT station, event_type, date, avg(value) AS m, count(value) AS n FROM hr GROUP BY ALL HAVING count(value) >= 2) SELECT event_type, date, round(avg(m), 6) AS mean_value, count(DISTINCT station) AS n_stations FROM d GROUP BY ALL")
def _(spark, sf):
    d = hours(spark, sf).groupBy("station", "event_type", "date").agg(F.avg("value").alias("m"), F.count("value").alias("n")).where("n >= 2")
    return d.groupBy("event_type", "date").agg(F.round(F.avg("m"), 6).alias("mean_value"), F.countDistinct("station").alias("n_stations"))


@query("a06_share_over_threshold", f"""WITH {HOURS}, g AS (SELECT date, avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END) AS gust_share FROM hr GROUP BY ALL),
s AS (SELECT station, date, count(value) AS n, sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) AS k FROM hr GROUP BY ALL HAVING count(value) >= 3),
t AS (SELECT date, avg(CASE WHEN k >= 2 THEN 1.0 ELSE 0.0 END) AS storm_share FROM s GROUP BY ALL) SELECT date, round(gust_share, 6) AS gust_share, round(storm_share, 6) AS storm_share FROM g LEFT JOIN t USING (date)""")
def _(spark, sf):
    h = hours(spark, sf)
    s = A.storm_share(h, "station", "date", "value", at_least=20, hours_needed=2, min_readings=3)
    return A.share_over(h, "date", "value", 50, "gust_share").join(s, "date", "left").select("date", *r6("gust_share", "storm_share"))


@query("a07_event_counts", """SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS cases, round(sum(value), 4) AS heads, count(DISTINCT user_id) AS areas, max(value) AS density_max FROM events GROUP BY ALL""")
def _(spark, sf):
    e = event_days(spark, sf)
    return e.groupBy("event_type", "date").agg(F.count(F.lit(1)).alias("cases"), F.round(F.sum("value"), 4).alias("heads"), F.countDistinct("user_id").alias("areas"), F.max("value").alias("density_max"))


@query("a08_string_aggregation", """WITH f AS (SELECT CAST(ts AS DATE) AS date, user_id % 100 AS grp, event_type, min(ts) AS t FROM events GROUP BY ALL)
SELECT date, grp, string_agg(event_type, ', ' ORDER BY t, event_type) AS names FROM f GROUP BY ALL""")
def _(spark, sf):
    e = event_days(spark, sf).withColumn("grp", F.col("user_id") % 100)
    return A.ordered_concat(e, ["date", "grp"], "event_type", "ts", ", ", "names")  # at most one entry per event type


@query("a09_ordered_distinct_concat", f"""WITH {OBS}, f AS (SELECT orderkey, item, min(l_linenumber) AS p FROM obs GROUP BY ALL)
SELECT orderkey, string_agg(item, ';' ORDER BY p, item) AS items, count(*) AS n_items FROM f GROUP BY ALL""")
def _(spark, sf):
    o = observations(spark, sf).select("orderkey", "item", "l_linenumber")
    items = A.ordered_concat(o, ["orderkey"], "item", "l_linenumber", ";", "items")
    return items.withColumn("n_items", F.size(F.split("items", ";")).cast("long"))


@query("a10_first_and_mode", f"""WITH {OBS}, c AS (SELECT item, brand, count(*) AS n FROM obs GROUP BY ALL), m AS (SELECT item, brand AS mode_brand FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, brand) AS r FROM c) WHERE r = 1)
SELECT item, mode_brand, min(date) AS first_date, arg_min(brand, (date, orderkey, l_linenumber, brand)) AS first_brand FROM obs JOIN m USING (item) GROUP BY ALL""")
def _(spark, sf):
    o = observations(spark, sf)
    mode = R.most_common(o, ["item"], ["brand"]).withColumnRenamed("brand", "mode_brand")
    first = o.groupBy("item").agg(F.min("date").alias("first_date"), F.min_by("brand", F.struct("date", "orderkey", "l_linenumber", "brand")).alias("first_brand"))
    return mode.join(first, "item")


@query("a11_top_origin_share", f"WITH {OBS}, {ORIGIN} SELECT item, date, top_origin, round(top_qty / total_qty, 6) AS top_origin_share FROM os")
def _(spark, sf):
    o = observations(spark, sf, True).groupBy("item", "region", "date").agg(F.sum("qty").alias("q"))
    return A.top_origin_share(o, ["item"], "date", "region", "q", 1996, 1998, "AFRICA").select("item", "date", "top_origin", *r6("top_origin_share"))


@query("a12_origin_volume", """WITH al AS (SELECT n_name AS name, r_name AS sido FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
SELECT CAST(l_shipdate AS DATE) AS date, coalesce(al.sido, 'other') AS sido, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN al ON al.name = split_part(n_name || ' harbour ' || s_suppkey, ' harbour', 1) GROUP BY ALL""")
def _(spark, sf):
    nat, reg = table(spark, sf, "nation"), table(spark, sf, "region")
    al = nat.join(reg, nat.n_regionkey == reg.r_regionkey).where("r_name <> 'ASIA'").select(F.col("n_name").alias("name"), F.col("r_name").alias("sido"))
    sup = table(spark, sf, "supplier").join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
    sup = sup.select(F.col("s_suppkey").alias("l_suppkey"), F.split(F.concat("n_name", F.lit(" harbour "), F.col("s_suppkey").cast("string")), " harbour")[0].alias("name"))
    look = sup.join(al, "name", "left").select("l_suppkey", F.coalesce("sido", F.lit("other")).alias("sido"))
    li = table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_quantity")
    return li.join(look, "l_suppkey").groupBy("date", "sido").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("a13_production_weighted_weather", f"WITH {OBS}, {WPROD} SELECT item, date, round(t, 6) AS t, round(r, 6) AS r FROM pw")
def _(spark, sf):
    return area_weather(spark, sf).select("item", "date", *r6("t", "r"))


@query("a14_long_to_wide", f"WITH {FACTS} SELECT month, " + ", ".join(f"round(avg(CASE WHEN priority = '{p}' THEN total END), 2) AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM facts GROUP BY month")
def _(spark, sf):
    vals = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    w = A.long_to_wide(monthly_facts(spark, sf), ["month"], "priority", vals, "total")
    return w.select("month", *[F.round(F.col(f"`{v}`"), 2).alias(v) for v in vals])


@query("a15_unpivot_price_and_count", f"""WITH {OBS} SELECT date_trunc('month', date)::DATE AS month, item, region AS market, round(sum(amount), 2) AS price, count(*) AS head_count FROM obs GROUP BY ALL""")
def _(spark, sf):
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    o = observations(spark, sf, True).withColumn("month", F.to_date(F.date_trunc("month", F.col("date"))))
    wide = o.groupBy("month", "item").pivot("region", regions).agg(F.sum("amount").cast("string").alias("Amt"), F.count(F.lit(1)).cast("string").alias("Cnt"))
    wide = wide.toDF("month", "item", *[c.replace("_Amt", "Amt").replace("_Cnt", "Cnt") for c in wide.columns[2:]])
    x = A.price_count_pairs(wide, ["month", "item"]).where("price IS NOT NULL")
    return x.select("month", "item", "market", F.round(F.col("price").cast("double"), 2).alias("price"), F.col("head_count").cast("long").alias("head_count"))


@query("a16_monthly_environment_by_kind", """WITH f AS (SELECT date_trunc('month', CAST(ts AS DATE))::DATE AS month, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
kinds AS (SELECT * FROM (VALUES ('buy', 'purchase|click'), ('look', 'view'), ('bad', 'err.*')) t(item, pat))
SELECT month, item, round(avg(value), 6) AS value, round(avg(k), 6) AS k FROM f JOIN kinds ON regexp_matches(event_type, pat) GROUP BY ALL UNION ALL SELECT month, 'all', round(avg(value), 6), round(avg(k), 6) FROM f GROUP BY ALL""")
def _(spark, sf):
    e = event_days(spark, sf).select(F.to_date(F.date_trunc("month", F.col("date"))).alias("month"), "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    # sums per kind first: patterns meet distinct kinds, not readings
    per = e.groupBy("month", "event_type").agg(*[fn(c).alias(f"{t}{c}") for c in ("value", "k") for t, fn in (("s", F.sum), ("n", F.count))])
    rules = F.array(*[F.when(F.col("event_type").rlike(p), F.lit(i)) for i, p in (("buy", "purchase|click"), ("look", "view"), ("bad", "err.*"))], F.lit("all"))
    x = per.withColumn("item", F.explode(F.array_compact(rules)))
    return x.groupBy("month", "item").agg(*[F.round(safe_div(F.sum(f"s{c}"), F.sum(f"n{c}")), 6).alias(c) for c in ("value", "k")])


@query("a17_census_selection", f"""WITH {OBS}, c AS (SELECT year(date) || lpad(CAST(quarter(date) AS VARCHAR), 2, '0') AS period, item, CASE WHEN year(date) < 1998 THEN 'old' WHEN year(date) = 1998 AND status = 'F' THEN 'old' ELSE 'pig' END AS tbl, region, qty FROM obs),
n AS (SELECT period, item, tbl, sum(qty) AS v FROM c GROUP BY ALL), k AS (SELECT period, item, max(tbl) AS tbl FROM n GROUP BY ALL)
SELECT period, item, tbl, round(v, 2) AS heads, CAST(last_day(make_date(CAST(substr(period, 1, 4) AS INT), 3 * CAST(substr(period, 5, 2) AS INT), 1)) + 60 AS DATE) AS avail FROM n JOIN k USING (period, item, tbl)""")
def _(spark, sf):
    from ..functions.scalars import quarter_end

    o = observations(spark, sf)
    period = F.concat(F.year("date").cast("string"), F.lpad(F.quarter("date").cast("string"), 2, "0"))
    tbl = F.when(F.year("date") < 1998, "old").when((F.year("date") == 1998) & (F.col("status") == "F"), "old").otherwise("pig")
    n = o.groupBy(period.alias("period"), "item", tbl.alias("tbl")).agg(F.sum("qty").alias("v"))
    x = A.newest_source(n, ["period", "item"], "tbl")
    return x.select("period", "item", "tbl", F.round("v", 2).alias("heads"), quarter_end("period", 60).alias("avail"))


@query("a18_leave_one_out_mean", f"""{HIST}, g AS (SELECT *, sum(coalesce(r28, 0)) OVER w AS s, count(r28) OVER w AS n FROM hist WINDOW w AS (PARTITION BY date, channel))
SELECT {K}, date, round(CASE WHEN n - CASE WHEN r28 IS NULL THEN 0 ELSE 1 END > 0 THEN (s - coalesce(r28, 0)) / (n - CASE WHEN r28 IS NULL THEN 0 ELSE 1 END) END, 6) AS grp_r28 FROM g""")
def _(spark, sf):
    x = cut_lineage(history(spark, sf).select(*SERIES, "date", "r28"))
    return W.leave_one_out_mean(x, ["date", "channel"], "r28", "grp_r28").select(*SERIES, "date", *r6("grp_r28"))


@query("a19_prior_years_norm", f"""{HIST}, a AS (SELECT {K}, weekofyear(date) AS woy, year(date) AS year, avg(y) AS v FROM hist GROUP BY ALL)
SELECT {K}, woy, year, round(CASE WHEN row_number() OVER w > 2 THEN avg(v) OVER (PARTITION BY {K}, woy ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 6) AS prior FROM a WINDOW w AS (PARTITION BY {K}, woy ORDER BY year)""")
def _(spark, sf):
    return W.prior_years_mean(history(spark, sf), SERIES, "date", "y", "prior").select(*SERIES, F.col("woy").cast("long").alias("woy"), F.col("year").cast("long").alias("year"), *r6("prior"))


@query("a20_climatology_anomaly", f"""WITH {OBS}, {daily_sql()}, c AS (SELECT {K}, month(date) AS mo, avg(price) AS clim FROM daily WHERE year(date) BETWEEN 1996 AND 1998 GROUP BY ALL)
SELECT d.item, d.channel, date, round(clim, 6) AS clim, round(price - clim, 6) AS anomaly FROM daily d LEFT JOIN c ON c.item = d.item AND c.channel = d.channel AND mo = month(date)""")
def _(spark, sf):
    d = cut_lineage(daily_prices(spark, sf).withColumn("mo", F.month("date")))
    c = d.where(F.year("date").between(1996, 1998)).groupBy(*SERIES, "mo").agg(F.avg("price").alias("clim"))
    return d.join(c, [*SERIES, "mo"], "left").select(*SERIES, "date", *r6("clim"), F.round(F.col("price") - F.col("clim"), 6).alias("anomaly"))


@query("a21_table_profile", f"""WITH {OBS}, t AS (SELECT count(*) AS n_rows, min(date) AS first, max(date) AS last, count(DISTINCT item) AS a, count(DISTINCT brand) AS b, count(DISTINCT pname) AS c FROM obs)
SELECT n_rows, 3 AS n_cols, first, last, CASE WHEN a >= b AND a >= c THEN 'item' WHEN b >= c THEN 'brand' ELSE 'pname' END AS label, greatest(a, b, c) AS n_labels FROM (SELECT * FROM t)""")
def _(spark, sf):
    x = P.describe_table(observations(spark, sf).select("date", "item", "brand", "pname"), "date", ["item", "brand", "pname"])
    return x.withColumn("n_cols", F.col("n_cols") - 1)


@query("a21_item_spans", f"WITH {OBS} SELECT item, min(date) AS first, max(date) AS last, count(*) AS n FROM obs GROUP BY ALL")
def _(spark, sf):
    return P.spans(observations(spark, sf), ["item"], "date")


def _desc(v):
    return f"""SELECT channel, '{v}' AS variable, count(*) AS n, round(100.0 * avg(CASE WHEN {v} IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_pct, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min,
 round(quantile_cont({v}, 0.25), 6) AS q25, round(median({v}), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS q75, round(max({v}), 6) AS max, round(skewness({v}), 5) AS skew FROM hist GROUP BY channel"""


@query("a22_descriptive_statistics", f"{HIST} " + " UNION ALL ".join(_desc(v) for v in ("r28", "vol28", "y")))
def _(spark, sf):
    x = P.describe_columns(history(spark, sf), ["r28", "vol28", "y"], ["channel"])
    return x.select("channel", "variable", "n", *r6("missing_pct", "mean", "std", "min", "q25", "median", "q75", "max"), F.round("skew", 5).alias("skew"))


@query("a23_missing_rates", f"{HIST} " + " UNION ALL ".join(f"SELECT channel, '{v}' AS \"column\", round(100.0 * avg(CASE WHEN {v} IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_pct FROM hist GROUP BY channel" for v in ("base", "r28", "yoy", "vol28", "y")))
def _(spark, sf):
    return P.missing_rates(history(spark, sf), ["base", "r28", "yoy", "vol28", "y"], ["channel"]).select("channel", "column", *r6("missing_pct"))


@query("a23_missing_drift", f"""{HIST}, r AS (SELECT v, avg(CASE WHEN d < DATE '1996-06-30' THEN m END) * 100 AS b, avg(CASE WHEN d >= DATE '1996-06-30' THEN m END) * 100 AS a FROM (
 SELECT date AS d, unnest(['r28', 'yoy', 'y']) AS v, unnest([CASE WHEN r28 IS NULL THEN 1.0 ELSE 0 END, CASE WHEN yoy IS NULL THEN 1.0 ELSE 0 END, CASE WHEN y IS NULL THEN 1.0 ELSE 0 END]) AS m FROM hist) GROUP BY v)
SELECT v AS "column", round(a, 6) AS before_pct, round(b, 6) AS after_pct, round(b - a, 6) AS rise FROM r WHERE b - a > 10""")
def _(spark, sf):
    x = cut_lineage(history(spark, sf).select("date", "r28", "yoy", "y"))
    cut = F.to_date(F.lit("1996-06-30"))
    return P.missing_drift(x.where(F.col("date") >= cut), x.where(F.col("date") < cut), ["r28", "yoy", "y"]).select("column", *r6("before_pct", "after_pct", "rise"))


@query("a24_panel_structure", f"""WITH {OBS}, p AS (SELECT {K}, date, count(*) AS n, sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS mi FROM obs GROUP BY ALL),
s AS (SELECT {K}, sum(n) AS r, sum(n - 1) AS du, sum(mi) AS mi, min(date) AS a, max(date) AS b FROM p GROUP BY ALL)
SELECT CAST(sum(r) AS BIGINT) AS n_rows, count(*) AS n_series, CAST(sum(du) AS BIGINT) AS n_duplicates, CAST(sum(mi) AS BIGINT) AS n_missing, min(a) AS first, max(b) AS last, round(100 * avg(CASE WHEN a < DATE '1995-02-01' THEN 1.0 ELSE 0 END), 6) AS early_pct,
 round(median(r), 6) AS median_days, round(median(r / (b - a + 1)), 6) AS median_density FROM s""")
def _(spark, sf):
    x = P.panel_structure(observations(spark, sf), SERIES, "date", "price", "1995-02-01")
    return x.select("n_rows", "n_series", "n_duplicates", "n_missing", "first", "last", *r6("early_pct", "median_days", "median_density"))


@query("a25_price_level_distribution", f"""WITH {OBS}, {daily_sql(['item', 'channel'])}, s AS (SELECT channel, item, avg(price) AS m, stddev_samp(price) / avg(price) AS cv FROM daily GROUP BY ALL)
SELECT channel, count(*) AS n_series, round(min(m), 6) AS min, round(quantile_cont(m, 0.25), 6) AS q25, round(median(m), 6) AS median, round(quantile_cont(m, 0.75), 6) AS q75, round(max(m), 6) AS max, round(max(m) / min(m), 6) AS spread, round(median(cv), 6) AS median_cv FROM s GROUP BY ALL""")
def _(spark, sf):
    x = P.price_levels(daily_prices(spark, sf), SERIES, ["channel"], "price")
    return x.select("channel", "n_series", *r6("min", "q25", "median", "q75", "max", "spread", "median_cv"))


@query("a26_target_distribution", f"""{HIST} SELECT channel, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std, round(quantile_cont(y, 0.05), 6) AS q05, round(median(y), 6) AS median, round(quantile_cont(y, 0.95), 6) AS q95,
 round(100 * avg(CASE WHEN abs(y) > 0.1 THEN 1.0 ELSE 0 END), 6) AS big_pct FROM hist WHERE y IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return P.target_distribution(history(spark, sf).where("y IS NOT NULL"), ["channel"], "y").select("channel", "n", *r6("mean", "std", "q05", "median", "q95", "big_pct"))


@query("a27_seasonal_index", f"""WITH {OBS}, {daily_sql()}, m AS (SELECT {K}, year(date) AS yr, month(date) AS mo, avg(price) AS p FROM daily GROUP BY ALL),
yv AS (SELECT {K}, yr, avg(p) AS py FROM m GROUP BY ALL HAVING count(p) >= 10), ny AS (SELECT {K}, count(*) AS n_years FROM yv GROUP BY ALL HAVING count(*) >= 3),
ix AS (SELECT m.item, m.channel, m.yr, mo, n_years, p / py AS i FROM m JOIN yv USING ({K}, yr) JOIN ny USING ({K})), pf AS (SELECT {K}, n_years, mo, avg(i) AS i FROM ix GROUP BY ALL),
am AS (SELECT {K}, n_years, max(i) - min(i) AS amplitude FROM pf GROUP BY ALL),
cc AS (SELECT {K}, avg(c) AS c FROM (SELECT a.item, a.channel, a.yr, b.yr AS yb, corr(a.i, b.i) AS c FROM ix a JOIN ix b ON a.item = b.item AND a.channel = b.channel AND a.mo = b.mo AND a.yr < b.yr GROUP BY ALL) GROUP BY ALL)
SELECT {K}, n_years, round(amplitude, 6) AS amplitude, round(c, 6) AS year_corr FROM am LEFT JOIN cc USING ({K})""")
def _(spark, sf):
    return P.seasonal_index(daily_prices(spark, sf), SERIES, "date", "price").select(*SERIES, "n_years", *r6("amplitude", "year_corr"))


@query("a28_weekday_effect", f"""WITH {OBS}, {daily_sql()}, g AS (SELECT isodow(date) - 1 AS dow, CASE WHEN count(price) OVER w >= 3 THEN ln(price) - avg(ln(price)) OVER w END AS g FROM daily WINDOW w AS (PARTITION BY {K} ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT dow, round(100 * avg(g), 6) AS gap_pct FROM g GROUP BY ALL""")
def _(spark, sf):
    return P.weekday_effect(daily_prices(spark, sf), SERIES, "date", "price").select("dow", *r6("gap_pct"))


@query("a29_autocorrelation", f"""WITH {OBS}, {daily_sql()}, x AS (SELECT {K}, dn, ln(price) AS l FROM daily), y AS (SELECT {K}, l, {', '.join(f"{D.at('l', k)} AS l{k}" for k in (1, 7, 28, 91))} FROM x)
SELECT {K}, count(l) AS n_obs, {', '.join(f'round(corr(l, l{k}), 6) AS lag{k}' for k in (1, 7, 28, 91))} FROM y GROUP BY ALL HAVING count(l) >= 400""")
def _(spark, sf):
    return P.autocorrelation(daily_prices(spark, sf), SERIES, "date", "price").select(*SERIES, "n_obs", *r6("lag1", "lag7", "lag28", "lag91"))


@query("a29_change_autocorrelation", f"""WITH {OBS}, {daily_sql()}, sp AS (SELECT {K}, min(date) AS a, max(date) AS b FROM daily GROUP BY ALL), gr AS (SELECT {K}, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
x AS (SELECT {K}, date - DATE '1970-01-01' AS dn, ln(price) AS l FROM gr LEFT JOIN daily USING ({K}, date)), m AS (SELECT *, {D.mean('l', 0, 6, 3)} AS m FROM x), c AS (SELECT *, {D.at('m', -28)} - m AS c FROM m),
z AS (SELECT {K}, l, c, {D.at('c', 28)} AS c28, {D.at('c', 364)} AS c364 FROM c) SELECT {K}, count(l) AS n_obs, round(corr(c, c28), 6) AS change28, round(corr(c, c364), 6) AS change364 FROM z GROUP BY ALL HAVING count(l) >= 400""")
def _(spark, sf):
    return P.change_autocorrelation(daily_prices(spark, sf), SERIES, "date", "price").select(*SERIES, "n_obs", *r6("change28", "change364"))


@query("a30_jump_counts", f"""WITH {OBS}, {daily_sql()}, x AS (SELECT channel, ln(price / lag(price) OVER w) AS d, lead(price) OVER w AS nx, ln(lead(price) OVER w / lag(price) OVER w) AS r, count(*) OVER (PARTITION BY {K}) AS n FROM daily WINDOW w AS (PARTITION BY {K} ORDER BY date))
SELECT channel, count(d) AS n_changes, CAST(sum(CASE WHEN nx IS NOT NULL AND abs(d) > ln(1.5) THEN 1 ELSE 0 END) AS BIGINT) AS n_jumps, CAST(sum(CASE WHEN nx IS NOT NULL AND abs(d) > ln(1.5) AND abs(r) < ln(1.1) THEN 1 ELSE 0 END) AS BIGINT) AS n_reversed FROM x WHERE n >= 3 GROUP BY ALL""")
def _(spark, sf):
    return P.jump_counts(daily_prices(spark, sf), SERIES, ["channel"], "date", "price")


@query("a31_extreme_days", f"""WITH {OBS}, st AS (SELECT date, market, max(price) AS mx, min(price) AS mn, sum(qty) AS r FROM obs GROUP BY ALL), y AS (SELECT year(date) AS year, market, sum(CASE WHEN mx >= 3000 THEN 1 ELSE 0 END) AS heat, sum(CASE WHEN mn <= 1000 THEN 1 ELSE 0 END) AS cold, sum(CASE WHEN r >= 80 THEN 1 ELSE 0 END) AS heavy FROM st GROUP BY ALL)
SELECT year, round(avg(heat), 6) AS heat, round(avg(cold), 6) AS cold, round(avg(heavy), 6) AS heavy FROM y GROUP BY ALL""")
def _(spark, sf):
    st = observations(spark, sf).groupBy("date", "market").agg(F.max("price").alias("mx"), F.min("price").alias("mn"), F.sum("qty").alias("r"))
    x = P.extreme_days(st, "market", "date", {"heat": F.col("mx") >= 3000, "cold": F.col("mn") <= 1000, "heavy": F.col("r") >= 80})
    return x.select(F.col("year").cast("long").alias("year"), *r6("heat", "cold", "heavy"))


@query("a32_rebased_index", f"WITH {FACTS} SELECT priority, month, round(total * 100 / first_value(total) OVER (PARTITION BY priority ORDER BY month), 6) AS index100 FROM facts")
def _(spark, sf):
    return P.rebase(monthly_facts(spark, sf), ["priority"], "month", "total").select("priority", "month", *r6("index100"))


@query("a32_change_volatility", f"""WITH {OBS}, m AS (SELECT brand, date_trunc('month', date)::DATE AS month, avg(price) AS v FROM obs GROUP BY ALL), c AS (SELECT brand, (v / lag(v, 12) OVER (PARTITION BY brand ORDER BY month) - 1) * 100 AS c FROM m)
SELECT brand, round(stddev_samp(c), 6) AS volatility FROM c GROUP BY ALL ORDER BY stddev_samp(c) DESC, brand LIMIT 15""")
def _(spark, sf):
    m = observations(spark, sf).groupBy("brand", F.to_date(F.date_trunc("month", F.col("date"))).alias("month")).agg(F.avg("price").alias("v"))
    return P.change_volatility(m, ["brand"], "month", "v").select("brand", *r6("volatility"))


@query("a33_volume_price_correlation", f"""WITH {TRADE_DAY}, x AS (SELECT *, a / q AS p FROM td WHERE q > 0 AND a > 0), d AS (SELECT {K}, ln(q / lag(q) OVER w) AS dq, ln(p / lag(p) OVER w) AS dp FROM x WINDOW w AS (PARTITION BY {K} ORDER BY date)),
s AS (SELECT {K}, count(*) AS n_days, corr(dq, dp) AS same_day FROM d GROUP BY ALL HAVING count(*) >= 1000), wk AS (SELECT {K}, date_trunc('week', date)::DATE AS w, sum(q) AS q, avg(p) AS p FROM x GROUP BY ALL),
k AS (SELECT {K}, w, ln(q / lag(q) OVER z) AS dq, ln(p / lag(p) OVER z) AS dp FROM wk WINDOW z AS (PARTITION BY {K} ORDER BY w)), n AS (SELECT {K}, dq, lead(dp) OVER (PARTITION BY {K} ORDER BY w) AS nx FROM k)
SELECT {K}, n_days, round(same_day, 6) AS same_day, round(nw, 6) AS next_week FROM s LEFT JOIN (SELECT {K}, corr(dq, nx) AS nw FROM n GROUP BY ALL) USING ({K})""")
def _(spark, sf):
    t = trade_days(spark, sf).withColumn("p", safe_div("a", "q"))
    return A.volume_price_correlation(t, SERIES, "date", "q", "p").select(*SERIES, "n_days", *r6("same_day", "next_week"))


@query("a34_year_by_type_pivot", f"WITH {OBS} SELECT year(date) AS year, " + ", ".join(f"sum(CASE WHEN item = '{i}' THEN 1 END) AS {i.lower()}" for i in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM obs GROUP BY ALL")
def _(spark, sf):
    vals = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    x = observations(spark, sf).groupBy(F.year("date").cast("long").alias("year")).pivot("item", vals).count()
    return x.select("year", *[F.col(v).alias(v.lower()) for v in vals])


RANK = lambda a, b: f"""SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM hist WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
PAIRS = [("r7", "r28"), ("r28", "dev_last"), ("n_obs28", "vol28"), ("r28", "y"), ("n_obs28", "y")]


@query("a35_spearman_pairs", f"{HIST} " + " UNION ALL ".join(RANK(a, b) for a, b in PAIRS))
def _(spark, sf):
    return P.spearman_pairs(history(spark, sf), PAIRS).select("a", "b", "n", *r6("rho"))


ALL4 = [("r7", "r28"), ("r7", "dev_last"), ("r28", "dev_last"), ("r7", "n_obs28"), ("r28", "n_obs28"), ("dev_last", "n_obs28")]


@query("a35_most_similar_column", f"""{HIST}, rh AS ({' UNION ALL '.join(RANK(a, b) for a, b in ALL4)}), b2 AS (SELECT a, b, rho FROM rh UNION ALL SELECT b, a, rho FROM rh)
SELECT a AS "column", b AS mate, rho FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY abs(rho) DESC, b DESC) AS r FROM b2) WHERE r = 1""")
def _(spark, sf):
    return P.most_similar(P.spearman_pairs(history(spark, sf), ALL4)).select("column", "mate", *r6("rho"))


def _vif3(cols):
    a, b, c = cols
    return f"""{HIST}, md AS (SELECT {', '.join(f'median({x}) AS m{x}' for x in cols)} FROM hist), x AS (SELECT {', '.join(f'coalesce({x}, m{x}) AS {x}' for x in cols)} FROM hist, md),
 c AS (SELECT corr({a}, {b}) AS ab, corr({a}, {c}) AS ac, corr({b}, {c}) AS bc FROM x), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
 SELECT '{a}' AS "column", round((1 - bc * bc) / det, 5) AS vif FROM d UNION ALL SELECT '{b}', round((1 - ac * ac) / det, 5) FROM d UNION ALL SELECT '{c}', round((1 - ab * ab) / det, 5) FROM d"""


@query("a36_variance_inflation", _vif3(["r7", "r28", "dev_last"]))
def _(spark, sf):
    return P.variance_inflation(history(spark, sf), ["r7", "r28", "dev_last"]).select("column", F.round("vif", 5).alias("vif"))


@query("a37_redundancy_keep", f"""{HIST}, rh AS ({' UNION ALL '.join(RANK(a, b) for a, b in ALL4)}), im AS (SELECT 'r7' AS c, round(abs(corr(r7, y)), 6) AS i FROM hist UNION ALL SELECT 'r28', round(abs(corr(r28, y)), 6) FROM hist UNION ALL SELECT 'dev_last', round(abs(corr(dev_last, y)), 6) FROM hist UNION ALL SELECT 'n_obs28', round(abs(corr(n_obs28, y)), 6) FROM hist),
b2 AS (SELECT a, b FROM rh WHERE abs(rho) >= 0.3 UNION ALL SELECT b, a FROM rh WHERE abs(rho) >= 0.3), lo AS (SELECT b2.a, arg_max(b2.b, (ib.i, b2.b)) AS covered_by FROM b2 JOIN im ia ON ia.c = b2.a JOIN im ib ON ib.c = b2.b WHERE ib.i > ia.i OR (ib.i = ia.i AND b2.b < b2.a) GROUP BY b2.a)
SELECT c AS "column", i AS importance, covered_by, covered_by IS NULL AS keep FROM im LEFT JOIN lo ON lo.a = im.c""")
def _(spark, sf):
    h = cut_lineage(history(spark, sf).select("r7", "r28", "dev_last", "n_obs28", "y"))
    cols = ["r7", "r28", "dev_last", "n_obs28"]
    imp = h.agg(*[F.round(F.abs(F.corr(c, "y")), 6).alias(c) for c in cols]).unpivot([], cols, "column", "importance")
    return P.keep_most_important(P.spearman_pairs(h, ALL4), imp, 0.3).select("column", "importance", "covered_by", "keep")


CONCEPT = {"r7": "momentum", "r28": "momentum", "dev_last": "level", "n_obs28": "survey", "vol28": "survey"}


@query("a37_one_per_concept", f"""{HIST}, im AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, '{k}' AS concept, round(abs(corr({c}, y)), 6) AS i FROM hist WHERE {c} IS NOT NULL AND y IS NOT NULL" for c, k in CONCEPT.items())})
SELECT c AS "column", concept, i AS importance, first_value(c) OVER (PARTITION BY concept ORDER BY i DESC, c) AS kept, row_number() OVER (PARTITION BY concept ORDER BY i DESC, c) = 1 AS keep FROM im""")
def _(spark, sf):
    cols = list(CONCEPT)
    imp = history(spark, sf).agg(*[F.round(F.abs(F.corr(c, "y")), 6).alias(c) for c in cols]).unpivot([], cols, "column", "importance")
    return P.keep_one_per_concept(cut_lineage(imp), pick(CONCEPT, "column")).select("column", "concept", "importance", "kept", "keep")


@query("a38_shared_sources", "SELECT p_name AS source, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS users, count(DISTINCT p_type) AS n_users FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 1")
def _(spark, sf):
    return P.shared_sources(table(spark, sf, "part").select(F.col("p_name").alias("source"), F.col("p_type").alias("user")), "source", "user")


@query("a39_yearly_change", f"""WITH {OBS}, {daily_sql()}, a AS (SELECT {K}, year(date) AS year, avg(price) AS p FROM daily GROUP BY ALL), c AS (SELECT year, ln(p / lag(p) OVER (PARTITION BY {K} ORDER BY year)) AS c FROM a)
SELECT year, round(exp(median(c)) - 1, 6) AS median_change, round(exp(avg(c)) - 1, 6) AS mean_change, count(c) AS n_series FROM c WHERE c IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return P.yearly_change(daily_prices(spark, sf), SERIES, "date", "price").select(F.col("year").cast("long").alias("year"), *r6("median_change", "mean_change"), "n_series")


@query("a40_value_shares", "SELECT coalesce(CASE WHEN source <> 'src0' THEN source END, 'none') AS source, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS pct FROM documents GROUP BY ALL")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("source") != "src0", F.col("source")).alias("source"))
    return P.shares(d, "source", "none").select("source", "n", *r6("pct"))


@query("a41_monthly_sums_by_prefix", """SELECT substr(lpad(CAST(l_partkey AS VARCHAR), 19, '0'), 16, 2) AS hs2, date_trunc('month', l_shipdate)::DATE AS month, round(sum(l_quantity) / 1000, 8) AS ton, round(sum(l_extendedprice) / 1e6, 8) AS musd FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.substring(F.lpad(F.col("l_partkey").cast("string"), 19, "0"), 16, 2).alias("hs2"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(
        F.round(F.sum("l_quantity") / 1000, 8).alias("ton"), F.round(F.sum("l_extendedprice") / 1e6, 8).alias("musd"))


# ---- top-k, sampling, unions

@query("t01_sorted_output", f"WITH {OBS}, {daily_sql()} SELECT {K}, date, {s6('price')} FROM daily ORDER BY item, channel, date")
def _(spark, sf):
    return daily_prices(spark, sf).select(*SERIES, "date", *r6("price")).orderBy(*SERIES, "date")


@query("t02_top_days_per_series", f"""WITH {OBS}, {daily_sql()} SELECT {K}, date, {s6('price')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY price DESC, date) AS rank FROM daily) WHERE rank <= 4""")
def _(spark, sf):
    return A.top_k(daily_prices(spark, sf), SERIES, [F.desc("price"), F.asc("date")], 4).select(*SERIES, "date", *r6("price"), "rank")


@query("t02_top_global", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(15)


@query("t04_random_sample")
def _(spark, sf):
    return A.sample_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), 1000, ["o_orderkey"])


@query("u01_regional_and_national_rows", f"""WITH {OBS}, {daily_sql(['channel', 'region'], 'rd')}, {daily_sql(['channel'], 'nd')} SELECT channel, region, date, {s6('price')}, 0 AS is_nat FROM rd UNION ALL SELECT channel, '*', date, {s6('price')}, 1 FROM nd""")
def _(spark, sf):
    reg = daily_prices(spark, sf, ["channel", "region"]).withColumn("is_nat", F.lit(0))
    nat = daily_prices(spark, sf, ["channel"]).withColumn("region", F.lit("*")).withColumn("is_nat", F.lit(1))
    return reg.unionByName(nat).select("channel", "region", "date", *r6("price"), "is_nat")


@query("u02_second_source_fills_period", """SELECT CAST(l_shipdate AS DATE) AS date, 'lines' AS source, round(sum(l_extendedprice), 2) AS amount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY ALL
UNION ALL SELECT CAST(o_orderdate AS DATE), 'orders', round(sum(o_totalprice), 2) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL""")
def _(spark, sf):
    cut = F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    a = table(spark, sf, "lineitem").where(F.col("l_shipdate") >= cut).select(F.to_date("l_shipdate").alias("date"), F.lit("lines").alias("source"), F.col("l_extendedprice").alias("amount"))
    b = table(spark, sf, "orders").where(F.col("o_orderdate") < cut).select(F.to_date("o_orderdate").alias("date"), F.lit("orders").alias("source"), F.col("o_totalprice").alias("amount"))
    return a.unionByName(b).groupBy("date", "source").agg(F.round(F.sum("amount"), 2).alias("amount"))
