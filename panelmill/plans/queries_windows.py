"""Calendar-window queries (price history, forward means, seasonal norms, momentum, repair, splice)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_median
from ..functions.scalars import direction, log_ratio, safe_div, safe_ln
from ..operators import aggregates as A
from ..operators import repair as R
from ..operators import windows as W
from ..operators.evaluate import smoothed, stability
from ..session import cut_lineage
from .registry import query
from .roles import FACTS, OBS, SERIES, SqlFrames, daily_prices, daily_sql, event_days, history_sql, ln_ratio, monthly_facts, observations, table

K = ", ".join(SERIES)
D = SqlFrames(SERIES)


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def s6(*cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def history(spark, sf, keys=None):
    return W.with_target(W.price_history(daily_prices(spark, sf, keys), keys or SERIES, "date", "price"))


HIST = f"WITH {OBS}, {daily_sql()}, {history_sql()}"


@query("w01_forward_means", f"{HIST} SELECT {K}, date, {s6('fwd14', 'fwd28')} FROM hist")
def _(spark, sf):
    return history(spark, sf).select(*SERIES, "date", *r6("fwd14", "fwd28"))


@query("w02_base_week_mean", f"{HIST} SELECT {K}, date, {s6('price', 'base')} FROM hist")
def _(spark, sf):
    return history(spark, sf).select(*SERIES, "date", *r6("price", "base"))


@query("w03_week_changes", f"{HIST} SELECT {K}, date, {s6('r7', 'r28', 'r91')} FROM hist")
def _(spark, sf):
    return history(spark, sf).select(*SERIES, "date", *r6("r7", "r28", "r91"))


@query("w04_year_change", f"{HIST} SELECT {K}, date, {s6('yoy')} FROM hist")
def _(spark, sf):
    return history(spark, sf).select(*SERIES, "date", *r6("yoy"))


@query("w05_volatility_28d", f"{HIST} SELECT {K}, date, {s6('vol28')} FROM hist")
def _(spark, sf):
    return history(spark, sf).select(*SERIES, "date", *r6("vol28"))


@query("w06_last_deviation", f"{HIST} SELECT {K}, date, {s6('dev_last')} FROM hist")
def _(spark, sf):
    return history(spark, sf).select(*SERIES, "date", *r6("dev_last"))


@query("w07_last_year_change", f"{HIST} SELECT {K}, date, {s6('ly_change')} FROM hist")
def _(spark, sf):
    return history(spark, sf).select(*SERIES, "date", *r6("ly_change"))


@query("w08_survey_days_28d", f"{HIST} SELECT {K}, date, n_obs28 FROM hist")
def _(spark, sf):
    return history(spark, sf).select(*SERIES, "date", "n_obs28")


@query("w09_target_change", f"{HIST} SELECT {K}, date, {s6('y')}, round(ln(1 + y), 6) AS y_log FROM hist WHERE y IS NOT NULL")
def _(spark, sf):
    x = W.with_target(history(spark, sf), name="y_log", log=True)
    return x.where("y IS NOT NULL").select(*SERIES, "date", *r6("y", "y_log"))


@query("w09_target_horizon_14", f"""WITH {OBS}, {daily_sql()}, x AS (SELECT {K}, date, {D.mean('price', 0, 6, 3)} AS base, {D.mean('price', -14, -1, 5)} AS fwd,
  {D.mean('price', 358, 364, 3)} AS lb, {D.mean('price', 350, 363, 10)} AS lf FROM daily)
SELECT {K}, date, round(fwd / base - 1, 6) AS y14, round(ln(fwd / base), 6) AS y14_log, round(ln(lf / lb), 6) AS ly_change FROM x""")
def _(spark, sf):
    d = daily_prices(spark, sf)
    f = W.DayFrames(SERIES, "date")
    x = d.select(
        *SERIES, "date", f.mean("price", 0, 6, 3).alias("base"), W.forward_mean(f, F.col("price"), 14).alias("fwd"),
        f.mean("price", 358, 364, 3).alias("lb"), f.mean("price", 350, 363, 10).alias("ln"))
    return x.select(*SERIES, "date", F.round(safe_div("fwd", "base") - 1, 6).alias("y14"), F.round(log_ratio("fwd", "base"), 6).alias("y14_log"), F.round(log_ratio("ln", "lb"), 6).alias("ly_change"))


@query("w10_trailing_means", f"""{HIST} SELECT {K}, date, round({D.mean('base', 0, 6, 3)}, 6) AS m7, round({D.mean('base', 0, 27, 8)}, 6) AS m28,
  round({D.mean('base', 0, 90, 27)}, 6) AS m91, round({D.mean('base', 0, 364, 109)}, 6) AS m365 FROM hist""")
def _(spark, sf):
    f = W.DayFrames(SERIES, "date")
    return history(spark, sf).select(*SERIES, "date", *[F.round(f.trailing_mean("base", k), 6).alias(f"m{k}") for k in (7, 28, 91, 365)])


PRIOR = lambda src, col, name, minimum: f"""{name}0 AS (SELECT {K}, weekofyear(date) AS woy, year(date) AS yr, avg({col}) AS v FROM {src} GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {K}, woy ORDER BY yr) > {minimum} THEN avg(v) OVER (PARTITION BY {K}, woy ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS prior FROM {name}0)"""


@query("w11_level_vs_year_and_season", f"""{HIST}, lv AS (SELECT *, ln(base / ({D.mean('base', 0, 364, 109)})) AS lvl FROM hist),
{PRIOR('lv', 'lvl', 'norm', 2)}, {PRIOR('hist', 'y', 'clim', 2)}
SELECT lv.item, lv.channel, lv.date, round(lvl, 6) AS lvl_52w, round(lvl - norm.prior, 6) AS lvl_vs_season, round(clim.prior, 6) AS clim_y_woy
FROM lv LEFT JOIN norm ON norm.item = lv.item AND norm.channel = lv.channel AND norm.woy = weekofyear(lv.date) AND norm.yr = year(lv.date)
LEFT JOIN clim ON clim.item = lv.item AND clim.channel = lv.channel AND clim.woy = weekofyear(lv.date) AND clim.yr = year(lv.date)""")
def _(spark, sf):
    f = W.DayFrames(SERIES, "date")
    x = cut_lineage(history(spark, sf).select(*SERIES, "date", "y", log_ratio("base", f.trailing_mean("base", 365)).alias("lvl_52w")))
    x = W.attach_season(x, SERIES, "date", "lvl_52w", "norm")
    x = x.join(W.prior_years_mean(x, SERIES, "date", "y", "clim_y_woy"), [*SERIES, "woy", "year"], "left")
    return x.withColumn("lvl_vs_season", F.col("lvl_52w") - F.col("norm")).select(*SERIES, "date", *r6("lvl_52w", "lvl_vs_season", "clim_y_woy"))


WHSL = f"""{OBS}, {daily_sql()}, {history_sql()}, wh AS (SELECT item, date, median(price) AS whsl FROM daily WHERE channel = 'A' GROUP BY ALL),
j AS (SELECT hist.*, whsl, CASE WHEN whsl / base > 0 THEN ln(whsl / base) END AS gap FROM hist LEFT JOIN wh USING (item, date))"""


@query("w12_wholesale_gap_and_momentum", f"""WITH {WHSL} SELECT {K}, date, round(gap - ({D.mean('gap', 0, 90, 27)}), 6) AS gap_anom,
 round(ln(whsl / ({D.mean('whsl', 0, 6, 3)})), 6) AS mom7, round(ln(whsl / ({D.mean('whsl', 0, 27, 8)})), 6) AS mom28 FROM j""")
def _(spark, sf):
    d = cut_lineage(daily_prices(spark, sf))
    wh = exact_median(d.where("channel = 'A'"), ["item", "date"], "price", "whsl")
    x = W.with_target(W.price_history(d, SERIES, "date", "price")).join(wh, ["item", "date"], "left")
    f = W.DayFrames(SERIES, "date")
    x = x.withColumn("gap", log_ratio("whsl", "base"))
    return x.select(*SERIES, "date", F.round(F.col("gap") - f.trailing_mean("gap", 91), 6).alias("gap_anom"),
                    *[F.round(log_ratio("whsl", f.trailing_mean("whsl", k)), 6).alias(f"mom{k}") for k in (7, 28)])


# events as a 30-day "weather": one row per day
EV = """ev AS (SELECT CAST(ts AS DATE) AS date, CAST(ts AS DATE) - DATE '1970-01-01' AS dn, sum(value) AS rain, max(value) AS hi, min(value) AS lo, avg(value) AS av FROM events GROUP BY ALL)"""
E0 = SqlFrames([])


def event_weather(spark, sf):
    return event_days(spark, sf).groupBy("date").agg(F.sum("value").alias("rain"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("av"))


@query("w13_fortnight_sums_and_extreme_days", f"""WITH {EV}, g AS (SELECT *, dn - min(dn) OVER (ORDER BY dn ROWS UNBOUNDED PRECEDING) + 1 AS nd FROM ev)
SELECT date, round({E0.sum('rain', 0, 13, 7)}, 4) AS rain_14d,
 CASE WHEN least(nd, 14) >= 7 THEN sum(CASE WHEN hi >= 300 THEN 1 ELSE 0 END) {E0.over(0, 13)} END AS heat_14d,
 CASE WHEN least(nd, 14) >= 7 THEN sum(CASE WHEN lo <= 0.05 THEN 1 ELSE 0 END) {E0.over(0, 13)} END AS cold_14d FROM g""")
def _(spark, sf):
    f = W.DayFrames([], "date")
    days = F.least(f.days_since_start(), F.lit(14))
    flag = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0))).over(f.frame(0, 13))
    x = event_weather(spark, sf)
    return x.select("date", F.round(f.sum("rain", 0, 13, 7), 4).alias("rain_14d"),
                    F.when(days >= 7, flag(F.col("hi") >= 300)).alias("heat_14d"), F.when(days >= 7, flag(F.col("lo") <= 0.05)).alias("cold_14d"))


ORDERS_DAY = """od AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS dn, sum(o_totalprice) AS sun, avg(o_totalprice) AS t FROM orders GROUP BY ALL)"""


@query("w14_fortnight_anomalies", f"""WITH {ORDERS_DAY}, e AS (SELECT *, {E0.sum('sun', 0, 13, 10)} AS sun14, {E0.mean('t', 0, 13, 10)} AS t14, weekofyear(date) AS woy, year(date) AS yr FROM od),
n0 AS (SELECT woy, yr, avg(sun14) AS vs, avg(t14) AS vt FROM e GROUP BY ALL),
n AS (SELECT woy, yr, avg(vs) OVER w AS ps, avg(vt) OVER w AS pt FROM n0 WINDOW w AS (PARTITION BY woy ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT date, round(sun14 - ps, 3) AS sun_anom, round(t14 - pt, 4) AS temp_anom FROM e LEFT JOIN n USING (woy, yr)""")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("sun"), F.avg("o_totalprice").alias("t"))
    f = W.DayFrames([], "date")
    e = o.select("date", f.sum("sun", 0, 13, 10).alias("sun14"), f.mean("t", 0, 13, 10).alias("t14"))
    e = W.attach_season(e, [], "date", "sun14", "ps", min_years=0)
    e = e.join(W.prior_years_mean(e, [], "date", "t14", "pt", 0), ["woy", "year"], "left")
    return e.select("date", F.round(F.col("sun14") - F.col("ps"), 3).alias("sun_anom"), F.round(F.col("t14") - F.col("pt"), 4).alias("temp_anom"))


TRADE_DAY = f"""{OBS}, td AS (SELECT {K}, date, date - DATE '1970-01-01' AS dn, sum(qty) AS q, sum(amount) AS a FROM obs GROUP BY ALL)"""


def trade_days(spark, sf):
    return observations(spark, sf).groupBy(*SERIES, "date").agg(F.sum("qty").alias("q"), F.sum("amount").alias("a"))


@query("w15_volume_vs_season", f"""WITH {TRADE_DAY}, x AS (SELECT *, CASE WHEN ({D.mean('q', 0, 6, 3)}) > 0 THEN ln({D.mean('q', 0, 6, 3)}) END AS lv FROM td), {PRIOR('x', 'lv', 'norm', 2)}
SELECT x.item, x.channel, date, round(lv - prior, 6) AS qty_vs_season FROM x LEFT JOIN norm ON norm.item = x.item AND norm.channel = x.channel AND woy = weekofyear(date) AND yr = year(date)""")
def _(spark, sf):
    f = W.DayFrames(SERIES, "date")
    x = trade_days(spark, sf).withColumn("lv", safe_ln(f.mean("q", 0, 6, 3)))
    x = W.attach_season(x, SERIES, "date", "lv", "norm")
    return x.select(*SERIES, "date", F.round(F.col("lv") - F.col("norm"), 6).alias("qty_vs_season"))


RK = ["channel", "region"]
RKS = ", ".join(RK)
DR = SqlFrames(RK)
REGION_HIST = f"""{OBS}, {daily_sql(RK, 'rd')}, {history_sql(RK, 'rd', 'rh')}, {daily_sql(['channel'], 'nd')}, {history_sql(['channel'], 'nd', 'nh')},
pr AS (SELECT rh.*, rh.base / nh.base - 1 AS premium, nh.base AS nat_base FROM rh LEFT JOIN nh ON rh.channel = nh.channel AND rh.date = nh.date)"""


def regional(spark, sf):
    reg = history(spark, sf, RK)
    nat = history(spark, sf, ["channel"]).select("channel", "date", F.col("base").alias("nat_base"), F.col("r28").alias("nat_r28"))
    return reg.join(nat, ["channel", "date"], "left").withColumn("premium", safe_div("base", "nat_base") - 1)


@query("w16_premium_momentum", f"""WITH {REGION_HIST} SELECT {RKS}, date, round(premium - ({DR.mean('premium', 0, 27, 8)}), 6) AS premium_mom28,
 round({DR.mean('premium', 0, 364, 109)}, 6) AS premium_norm, round(premium - ({DR.mean('premium', 0, 364, 109)}), 6) AS premium_anom FROM pr""")
def _(spark, sf):
    f = W.DayFrames(RK, "date")
    x = regional(spark, sf)
    return x.select(*RK, "date", F.round(F.col("premium") - f.trailing_mean("premium", 28), 6).alias("premium_mom28"),
                    F.round(f.trailing_mean("premium", 365), 6).alias("premium_norm"), F.round(F.col("premium") - f.trailing_mean("premium", 365), 6).alias("premium_anom"))


@query("w17_days_since_change", f"""WITH {OBS}, d AS (SELECT {K}, date, round(median(price), -2) AS price FROM obs WHERE price > 0 GROUP BY ALL),
c AS (SELECT *, CASE WHEN price <> lag(price) OVER (PARTITION BY {K} ORDER BY date) THEN date END AS chg FROM d)
SELECT {K}, date, date - max(chg) OVER (PARTITION BY {K} ORDER BY date ROWS UNBOUNDED PRECEDING) AS days_since_change FROM c""")
def _(spark, sf):
    d = daily_prices(spark, sf).withColumn("price", F.round("price", -2))
    return W.days_since_change(d, SERIES, "date", "price").select(*SERIES, "date", F.col("days_since_change").cast("long").alias("days_since_change"))


@query("w18_area_weather_fortnight", f"""WITH {TRADE_DAY}, x AS (SELECT *, CASE WHEN q IS NOT NULL THEN CASE WHEN q >= 100 THEN 1.0 ELSE 0.0 END END AS heat FROM td)
SELECT {K}, date, round(14 * ({D.mean('q', 0, 13, 5)}), 4) AS rain_14d, round(14 * ({D.mean('heat', 0, 13, 5)}), 6) AS heat_14d FROM x""")
def _(spark, sf):
    f = W.DayFrames(SERIES, "date")
    x = trade_days(spark, sf).withColumn("heat", (F.col("q") >= 100).cast("double"))
    return x.select(*SERIES, "date", F.round(f.mean("q", 0, 13, 5) * 14, 4).alias("rain_14d"), F.round(f.mean("heat", 0, 13, 5) * 14, 6).alias("heat_14d"))


MK = ["channel", "market"]
DM = SqlFrames(MK)


@query("w19_market_composition", f"""WITH {OBS}, m AS (SELECT channel, region, market, date, date - DATE '1970-01-01' AS dn, median(price) AS price FROM obs WHERE price > 0 GROUP BY ALL),
m2 AS (SELECT *, ln(price / avg(price) OVER (PARTITION BY channel, region, market ORDER BY dn RANGE BETWEEN 6 PRECEDING AND 0 PRECEDING)) AS mdev, ln(price) AS lp FROM m),
g AS (SELECT channel, region, date, dn, count(*) AS n_mkt, avg(mdev) AS same_mkt_dev, stddev_samp(lp) AS mkt_disp FROM m2 GROUP BY ALL)
SELECT channel, region, date, n_mkt, round(same_mkt_dev, 6) AS same_mkt_dev, round(mkt_disp, 6) AS mkt_disp, round(ln(n_mkt / ({DR.mean('n_mkt', 0, 27, 3)})), 6) AS n_mkt_dev FROM g""")
def _(spark, sf):
    k = ["channel", "region", "market"]
    m = exact_median(observations(spark, sf, True).where("price > 0"), [*k, "date"], "price", "price")
    m = m.withColumn("mdev", log_ratio("price", W.DayFrames(k, "date").mean("price", 0, 6, 1))).withColumn("lp", F.ln("price"))
    g = m.groupBy(*RK, "date").agg(F.count(F.lit(1)).alias("n_mkt"), F.avg("mdev").alias("same_mkt_dev"), F.stddev_samp("lp").alias("mkt_disp"))
    return g.select(*RK, "date", "n_mkt", *r6("same_mkt_dev", "mkt_disp"), F.round(log_ratio("n_mkt", W.DayFrames(RK, "date").mean("n_mkt", 0, 27, 3)), 6).alias("n_mkt_dev"))


@query("w20_export_and_unit_value_yoy", f"""WITH {TRADE_DAY}, x AS (SELECT *, {D.mean('q', 0, 90, 20)} AS e3, CASE WHEN q > 0 THEN a / q END AS u FROM td)
SELECT {K}, date, round(ln((e3 + 1) / ({D.at('e3', 364)} + 1)), 6) AS export_yoy, round(ln(u / {D.at('u', 364)}), 6) AS unit_yoy FROM x""")
def _(spark, sf):
    f = W.DayFrames(SERIES, "date")
    x = trade_days(spark, sf).withColumn("e3", f.mean("q", 0, 90, 20)).withColumn("u", safe_div("a", F.when(F.col("q") > 0, F.col("q"))))
    return x.select(*SERIES, "date", F.round(log_ratio(F.col("e3") + 1, f.at("e3", 364) + 1), 6).alias("export_yoy"), F.round(log_ratio("u", f.at("u", 364)), 6).alias("unit_yoy"))


LATEST = lambda c, lo, hi: f"last_value({c} IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY dn RANGE BETWEEN {hi} PRECEDING AND {lo} PRECEDING)"


@query("w21_typed_changes", f"""{HIST}, {PRIOR('hist', 'base', 'norm', 2)}
SELECT hist.item, hist.channel, date, round(ln(base / chg28), 6) AS chg28, round(ln(base / chg91), 6) AS chg91, round(ln((base + 1) / (ly + 1)), 6) AS yoy_level, round(base - prior, 6) AS anom
FROM (SELECT *, {LATEST('base', 28, 73)} AS chg28, {LATEST('base', 91, 136)} AS chg91, {LATEST('base', 364, 409)} AS ly FROM hist) hist
LEFT JOIN norm ON norm.item = hist.item AND norm.channel = hist.channel AND woy = weekofyear(date) AND yr = year(date)""")
def _(spark, sf):
    f = W.DayFrames(SERIES, "date")
    x = history(spark, sf).select(*SERIES, "date", "base")
    x = cut_lineage(x.select("*", *[f.latest_within("base", k, k + 45).alias(f"_l{k}") for k in (28, 91, 364)]))
    x = W.attach_season(x, SERIES, "date", "base", "norm")
    return x.select(*SERIES, "date", *[F.round(log_ratio("base", f"_l{k}"), 6).alias(f"chg{k}") for k in (28, 91)],
                    F.round(log_ratio(F.col("base") + 1, F.col("_l364") + 1), 6).alias("yoy_level"), F.round(F.col("base") - F.col("norm"), 6).alias("anom"))


@query("w22_weekly_momentum", f"""WITH {OBS}, w AS (SELECT item, CAST(date_trunc('week', date) AS DATE) AS week_start, avg(price) AS price FROM obs GROUP BY ALL)
SELECT item, week_start, CAST(week_start + 7 AS DATE) AS avail, round(CASE WHEN count(price) OVER f >= 3 THEN ln(price / avg(price) OVER f) END, 6) AS mom4 FROM w
WINDOW f AS (PARTITION BY item ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    wk = observations(spark, sf).groupBy("item", F.to_date(F.date_trunc("week", F.col("date"))).alias("week_start")).agg(F.avg("price").alias("price"))
    return W.row_momentum(wk, ["item"], "week_start", "price").select("item", "week_start", F.date_add("week_start", 7).alias("avail"), *r6("mom4"))


ET = SqlFrames(["event_type"])


@query("w23_event_windows", f"""WITH days AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS DATE) AS date),
t AS (SELECT DISTINCT event_type FROM events), c AS (SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n, avg(CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END) AS sh FROM events GROUP BY ALL),
x AS (SELECT event_type, date, date - DATE '1970-01-01' AS dn, coalesce(n, 0) AS n, sh FROM t CROSS JOIN days LEFT JOIN c USING (event_type, date))
SELECT event_type, date, {ET.sum('n', 0, 27, 1)} AS cases_28d, round({ET.max('sh', 0, 13, 1)}, 6) AS max_share_14d, round({ET.mean('sh', 0, 6, 3)}, 6) AS mean_share_7d FROM x""")
def _(spark, sf):
    e = event_days(spark, sf)
    c = e.groupBy("event_type", "date").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") >= 100).cast("double")).alias("sh"))
    span = e.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    grid = e.select("event_type").distinct().crossJoin(F.broadcast(span))  # calendar days, bounded by the table's span
    x = grid.join(c, ["event_type", "date"], "left").fillna(0, subset=["n"])
    f = W.DayFrames(["event_type"], "date")
    return x.select("event_type", "date", f.sum("n", 0, 27).alias("cases_28d"), F.round(f.max("sh", 0, 13), 6).alias("max_share_14d"), F.round(f.mean("sh", 0, 6, 3), 6).alias("mean_share_7d"))


DENSE = f"""{TRADE_DAY}, sp AS (SELECT {K}, min(date) AS a, max(date) AS b FROM td GROUP BY ALL),
gr AS (SELECT {K}, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
dq AS (SELECT {K}, date, date - DATE '1970-01-01' AS dn, coalesce(q, 0) AS q FROM gr LEFT JOIN td USING ({K}, date))"""
def avg3(c, fr):
    """Mean of the available values 1, 2 and 3 years ago, as SQL."""
    a = [fr.at(c, 364 * k) for k in (1, 2, 3)]
    total = " + ".join(f"coalesce({x}, 0)" for x in a)
    return f"(({total}) / nullif({' + '.join(f'count({c}) {fr.over(364 * k, 364 * k)}' for k in (1, 2, 3))}, 0))"


@query("w24_volume_vs_normal", f"""WITH {DENSE}, s AS (SELECT *, {D.sum('q', 0, 13, 14)} AS s14, {D.sum('q', 0, 29, 30)} AS s30, {D.sum('q', 0, 6, 7)} AS s7, {D.sum('q', 7, 13, 7)} AS p7, {D.sum('q', 364, 370, 7)} AS y7 FROM dq)
SELECT {K}, date, round(ln((s14 + 1) / ({avg3('s14', D)} + 1)), 6) AS q14_vs_norm, round(ln((s30 + 1) / ({avg3('s30', D)} + 1)), 6) AS q30_vs_norm,
 round(ln((s7 + 1) / (p7 + 1)), 6) AS q7_chg, round(ln((s7 + 1) / (y7 + 1)), 6) AS q7_yoy FROM s""")
def _(spark, sf):
    d = W.densify(trade_days(spark, sf).select(*SERIES, "date", "q"), SERIES, "date", ["q"])
    x = W.volume_changes(W.volume_vs_normal(d, SERIES, "date", "q"), SERIES, "date", "q")
    return x.select(*SERIES, "date", *r6("q14_vs_norm", "q30_vs_norm", "q7_chg", "q7_yoy"))


ORIGIN = """orig AS (SELECT item, region, date, sum(qty) AS q FROM obs GROUP BY ALL),
tb AS (SELECT item, region, sum(q) AS t FROM orig WHERE year(date) BETWEEN 1996 AND 1998 AND region <> 'AFRICA' GROUP BY ALL),
top AS (SELECT item, region AS top_origin FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY t DESC, region) AS r FROM tb) WHERE r = 1),
os AS (SELECT item, date, top_origin, sum(CASE WHEN region = top_origin THEN q ELSE 0 END) AS top_qty, sum(q) AS total_qty FROM orig JOIN top USING (item) GROUP BY ALL)"""


@query("w25_top_origin_share_dev", f"""WITH {OBS}, {ORIGIN}, sp AS (SELECT item, min(date) AS a, max(date) AS b FROM os GROUP BY ALL),
gr AS (SELECT item, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
x AS (SELECT item, date, date - DATE '1970-01-01' AS dn, coalesce(top_qty, 0) AS tq, coalesce(total_qty, 0) AS aq FROM gr LEFT JOIN os USING (item, date)),
s AS (SELECT *, CASE WHEN ({SqlFrames(['item']).sum('aq', 0, 13, 14)}) <> 0 THEN ({SqlFrames(['item']).sum('tq', 0, 13, 14)}) / ({SqlFrames(['item']).sum('aq', 0, 13, 14)}) END AS sh FROM x)
SELECT item, date, round(sh - {avg3('sh', SqlFrames(['item']))}, 6) AS origin_share_dev FROM s""")
def _(spark, sf):
    o = observations(spark, sf, True).groupBy("item", "region", "date").agg(F.sum("qty").alias("q"))
    t = A.top_origin_share(o, ["item"], "date", "region", "q", 1996, 1998, "AFRICA")
    d = W.densify(t.select("item", "date", "top_qty", "total_qty"), ["item"], "date", ["top_qty", "total_qty"])
    return W.share_vs_normal(d, ["item"], "date", "top_qty", "total_qty", "origin_share_dev").select("item", "date", *r6("origin_share_dev"))


WPROD = """wgt AS (SELECT item, region, sum(qty) AS w FROM obs WHERE year(date) BETWEEN 1996 AND 1998 GROUP BY ALL),
rd AS (SELECT region, date, avg(price) AS t, avg(qty) AS r FROM obs GROUP BY ALL),
wn AS (SELECT item, region, w / sum(w) OVER (PARTITION BY item) AS w FROM wgt WHERE w > 0),
pw AS (SELECT item, date, date - DATE '1970-01-01' AS dn, sum(w * t) / sum(CASE WHEN t IS NOT NULL THEN w END) AS t, sum(w * r) / sum(CASE WHEN r IS NOT NULL THEN w END) AS r FROM rd JOIN wn USING (region) GROUP BY ALL)"""
DI = SqlFrames(["item"])


def area_weather(spark, sf):
    o = observations(spark, sf, True)
    wgt = o.where(F.year("date").between(1996, 1998)).groupBy("item", "region").agg(F.sum("qty").alias("w"))
    readings = o.select("region", "date", F.col("price").alias("t"), F.col("qty").alias("r"))
    return A.weighted_region_mean(readings, "region", "date", ["t", "r"], wgt, ["item"], "w")


@query("w26_area_weather_30d", f"""WITH {OBS}, {WPROD}, g AS (SELECT *, dn - min(dn) OVER (PARTITION BY item ORDER BY dn ROWS UNBOUNDED PRECEDING) + 1 AS nd FROM pw),
cl AS (SELECT item AS ci, month(date) AS mo, avg(t) AS c FROM pw WHERE year(date) BETWEEN 1996 AND 1998 GROUP BY ALL)
SELECT item, date, CASE WHEN least(nd, 30) >= 20 THEN sum(CASE WHEN r >= 30 THEN 1 ELSE 0 END) {DI.over(0, 29)} END AS heavy30, round({DI.sum('r', 0, 29, 20)}, 4) AS rain30,
 round(({DI.mean('t', 0, 13, 10)}) - c, 4) AS temp14_anom FROM g LEFT JOIN cl ON ci = g.item AND mo = month(date)""")
def _(spark, sf):
    x = area_weather(spark, sf)
    f = W.DayFrames(["item"], "date")
    clim = x.where(F.year("date").between(1996, 1998)).groupBy("item", F.month("date").alias("mo")).agg(F.avg("t").alias("c"))
    x = x.select("item", "date", F.when(F.least(f.days_since_start(), F.lit(30)) >= 20, F.sum(F.coalesce((F.col("r") >= 30).cast("int"), F.lit(0))).over(f.frame(0, 29))).alias("heavy30"),
                 F.round(f.sum("r", 0, 29, 20), 4).alias("rain30"), f.mean("t", 0, 13, 10).alias("t14"), F.month("date").alias("mo"))
    return x.join(clim, ["item", "mo"], "left").select("item", "date", "heavy30", "rain30", F.round(F.col("t14") - F.col("c"), 4).alias("temp14_anom"))


@query("w27_wholesale_index", f"""WITH {OBS}, {daily_sql()}, lp AS (SELECT item, channel, date, ln(price) - avg(ln(price)) OVER (PARTITION BY {K}) AS lp FROM daily),
ix AS (SELECT item, date, avg(lp) AS i FROM lp GROUP BY ALL), sp AS (SELECT item, min(date) AS a, max(date) AS b FROM ix GROUP BY ALL),
gr AS (SELECT item, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
x AS (SELECT item, date, date - DATE '1970-01-01' AS dn, i FROM gr LEFT JOIN ix USING (item, date)), m AS (SELECT *, {DI.mean('i', 0, 6, 3)} AS m7 FROM x)
SELECT item, date, round(m7 - {DI.at('m7', 7)}, 6) AS whsl_r7, round(m7 - {DI.at('m7', 28)}, 6) AS whsl_r28 FROM m""")
def _(spark, sf):
    return W.wholesale_index(daily_prices(spark, sf), SERIES, ["item"], "date", "price").select("item", "date", *r6("whsl_r7", "whsl_r28"))


@query("w28_period_changes", f"""WITH {FACTS}, sp AS (SELECT priority, min(month) AS a, max(month) AS b FROM facts GROUP BY ALL),
gr AS (SELECT priority, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM sp),
x AS (SELECT priority, month, total FROM gr LEFT JOIN facts USING (priority, month)),
s AS (SELECT *, CASE WHEN count(total) OVER f >= 3 THEN sum(total) OVER f END AS t3 FROM x WINDOW f AS (PARTITION BY priority ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT priority, month, CAST(last_day(month) + 20 AS DATE) AS avail, round(ln((total + 1) / (lag(total, 12) OVER w + 1)), 6) AS yoy, round(ln((t3 + 1) / (lag(t3, 12) OVER w + 1)), 6) AS yoy3,
 round(ln(total / lag(total, 1) OVER w), 6) AS mom FROM s WINDOW w AS (PARTITION BY priority ORDER BY month)""")
def _(spark, sf):
    from ..functions.scalars import month_end

    k = ["priority"]
    x = W.fill_months(monthly_facts(spark, sf).select("priority", "month", "total"), k, "month")
    x = x.withColumn("t3", W.rolling_rows_sum(k, "month", "total", 3))
    x = W.period_log_change(x, k, "month", "total", 12, "yoy", 1.0)
    x = W.period_log_change(x, k, "month", "t3", 12, "yoy3", 1.0)
    x = W.period_log_change(x, k, "month", "total", 1, "mom")
    return x.select("priority", "month", month_end("month", 20).alias("avail"), *r6("yoy", "yoy3", "mom"))


@query("w29_cull_sums", f"""WITH days AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS DATE) AS date),
t AS (SELECT DISTINCT event_type FROM events), c AS (SELECT event_type, CAST(ts AS DATE) AS date, sum(value) AS v FROM events GROUP BY ALL),
x AS (SELECT event_type, date, date - DATE '1970-01-01' AS dn, coalesce(v, 0) AS v FROM t CROSS JOIN days LEFT JOIN c USING (event_type, date))
SELECT event_type, date, round(ln(1 + ({ET.sum('v', 0, 6, 7)})), 6) AS cull7, round(ln(1 + ({ET.sum('v', 0, 27, 28)})), 6) AS cull28 FROM x""")
def _(spark, sf):
    e = event_days(spark, sf)
    d = W.densify(e.groupBy("event_type", "date").agg(F.sum("value").alias("v")), ["event_type"], "date", ["v"])
    span = e.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    x = e.select("event_type").distinct().crossJoin(F.broadcast(span)).join(d, ["event_type", "date"], "left").fillna(0, subset=["v"])
    f = W.DayFrames(["event_type"], "date")
    return x.select("event_type", "date", F.round(F.log1p(f.sum("v", 0, 6, 7)), 6).alias("cull7"), F.round(F.log1p(f.sum("v", 0, 27, 28)), 6).alias("cull28"))


@query("w30_carried_changes", f"""WITH {OBS}, {daily_sql()}, sp AS (SELECT {K}, min(date) AS a, max(date) AS b FROM daily GROUP BY ALL),
gr AS (SELECT {K}, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
x AS (SELECT {K}, date, date - DATE '1970-01-01' AS dn, price FROM gr LEFT JOIN daily USING ({K}, date)),
f AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY dn RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS fp FROM x)
SELECT {K}, date, round(ln(fp / {D.at('fp', 7)}), 6) AS chg7, round(ln(fp / {D.at('fp', 28)}), 6) AS chg28 FROM f""")
def _(spark, sf):
    return W.carried_change(daily_prices(spark, sf), SERIES, "date", "price").select(*SERIES, "date", *r6("chg7", "chg28"))


MKT = f"""{OBS}, mk AS (SELECT channel, market, date, median(price) AS price FROM obs WHERE price > 0 GROUP BY ALL),
cg AS (SELECT *, lag(price) OVER w AS prev_price, date - lag(date) OVER w AS gap, ln(price / lag(price) OVER w) AS change, ln(lead(price) OVER w / lag(price) OVER w) AS around FROM mk WINDOW w AS (PARTITION BY channel, market ORDER BY date)),
fl AS (SELECT *, coalesce(gap <= 14 AND abs(change) > ln(1.5) AND abs(around) < ln(1.2), FALSE) AS spike FROM cg)"""


def market_days(spark, sf):
    return exact_median(observations(spark, sf).where("price > 0"), [*MK, "date"], "price", "price")


@query("w31_spike_flags", f"WITH {MKT} SELECT channel, market, date, round(price, 6) AS price, round(CASE WHEN spike THEN prev_price ELSE price END, 6) AS repaired, spike FROM fl")
def _(spark, sf):
    x = R.spike_flags(market_days(spark, sf), MK, "date", "price")
    return x.select(*MK, "date", *r6("price"), F.round(F.when(F.col("spike"), F.col("prev_price")).otherwise(F.col("price")), 6).alias("repaired"), "spike")


@query("w31_repaired_rows", f"""WITH {MKT} SELECT o.channel, o.date, count(*) AS n, round(sum(CASE WHEN spike THEN prev_price ELSE o.price END), 6) AS repaired_sum, sum(CASE WHEN spike THEN 1 ELSE 0 END) AS n_spikes
FROM obs o JOIN fl ON o.channel = fl.channel AND o.market = fl.market AND o.date = fl.date WHERE o.price > 0 GROUP BY ALL""")
def _(spark, sf):
    o = observations(spark, sf).where("price > 0").select(*MK, "date", "price", F.col("price").alias("raw"))
    x = R.repair_spikes(cut_lineage(o), MK, "date", "price", mark="spike")
    return x.groupBy("channel", "date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 6).alias("repaired_sum"), F.sum(F.col("spike").cast("long")).alias("n_spikes"))


@query("w32_fence_filter", f"""WITH {MKT}, fe AS (SELECT channel, quantile_cont(change, 0.25) AS q1, quantile_cont(change, 0.75) AS q3 FROM cg WHERE gap <= 14 AND abs(change) > 1e-9 AND date <= DATE '1999-12-31' GROUP BY ALL)
SELECT channel, market, date, round(price, 6) AS price, coalesce(gap <= 14 AND abs(change) > 1e-9 AND (change < q1 - 1.5 * (q3 - q1) OR change > q3 + 1.5 * (q3 - q1)), FALSE) AS outside FROM cg LEFT JOIN fe USING (channel)""")
def _(spark, sf):
    return R.fence_flags(market_days(spark, sf), MK, "date", "price", "1999-12-31", ["channel"]).select(*MK, "date", *r6("price"), "outside")


@query("w33_splice_renamed", f"""WITH {OBS}, base AS (SELECT channel, brand, item, date, price FROM obs WHERE (brand = 'Brand#1' AND date <= DATE '1998-06-30') OR (brand = 'Brand#2' AND date > DATE '1998-03-31') OR (brand = 'Brand#3' AND date > DATE '1998-07-31') OR brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')),
pairs AS (SELECT DISTINCT channel, 'Brand#1' AS o, n FROM obs, (VALUES ('Brand#2'), ('Brand#3')) v(n)),
od AS (SELECT channel, date, median(price) AS m FROM base WHERE brand = 'Brand#1' GROUP BY ALL), nd AS (SELECT channel, brand AS n, date, median(price) AS m FROM base WHERE brand IN ('Brand#2', 'Brand#3') GROUP BY ALL),
ol AS (SELECT channel, avg(m) AS lo FROM od JOIN (SELECT channel, max(date) AS b FROM od GROUP BY ALL) USING (channel) WHERE date > b - 42 GROUP BY ALL),
nl AS (SELECT channel, n, a, avg(m) AS ln FROM nd JOIN (SELECT channel, n, min(date) AS a FROM nd GROUP BY ALL) USING (channel, n) WHERE date < a + 42 GROUP BY ALL),
ra AS (SELECT channel, n, a, ln / lo AS ratio FROM nl JOIN ol USING (channel)),
out AS (SELECT channel, brand, date, price FROM base WHERE brand <> 'Brand#1' UNION ALL SELECT b.channel, ra.n, b.date, b.price * ratio FROM base b JOIN ra ON b.channel = ra.channel WHERE brand = 'Brand#1' AND b.date < ra.a)
SELECT channel, brand, date, count(*) AS n, round(sum(price), 6) AS price_sum FROM out GROUP BY ALL""")
def _(spark, sf):
    day = lambda s: F.to_date(F.lit(s))
    o = observations(spark, sf).select("channel", "brand", "item", "date", "price")
    keep = (
        ((F.col("brand") == "Brand#1") & (F.col("date") <= day("1998-06-30"))) | ((F.col("brand") == "Brand#2") & (F.col("date") > day("1998-03-31")))
        | ((F.col("brand") == "Brand#3") & (F.col("date") > day("1998-07-31"))) | ~F.col("brand").isin("Brand#1", "Brand#2", "Brand#3"))
    base = cut_lineage(o.where(keep))
    pairs = o.select("channel").distinct().select("channel", F.lit("Brand#1").alias("old_brand"), F.explode(F.array(F.lit("Brand#2"), F.lit("Brand#3"))).alias("new_brand"))
    out = R.splice_renamed(base, pairs, ["channel"], ["brand"], ["item"], "date", "price", ["price"])
    return out.groupBy("channel", "brand", "date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 6).alias("price_sum"))


@query("w34_price_percentile", f"""{HIST}, x AS (SELECT {K}, date, base FROM hist WHERE base IS NOT NULL AND date > (SELECT max(date) FROM hist) - 365),
nw AS (SELECT {K}, arg_max(base, date) AS nb FROM x GROUP BY ALL)
SELECT {K}, CASE WHEN count(*) >= 30 THEN round(avg(CASE WHEN base <= nb THEN 1.0 ELSE 0.0 END), 6) END AS pct FROM x JOIN nw USING ({K}) GROUP BY ALL""")
def _(spark, sf):
    from ..operators.menu import price_percentile

    return price_percentile(history(spark, sf), SERIES, "date", "base").select(*SERIES, *r6("pct"))


@query("w35_latest_rows", f"{HIST} SELECT {K}, date, {s6('base')} FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY date DESC) AS r FROM hist WHERE date > (SELECT max(date) FROM hist) - 7) WHERE r = 1")
def _(spark, sf):
    from ..operators.menu import latest_rows

    return latest_rows(history(spark, sf), SERIES, "date").select(*SERIES, "date", *r6("base"))


PRED = f"{HIST}, pv AS (SELECT *, -0.5 * r28 AS p FROM hist WHERE y IS NOT NULL AND r28 IS NOT NULL)"


def predictions(spark, sf, keys=None):
    """Reversal forecast: half of the last four weeks' change comes back."""
    return history(spark, sf, keys).where("y IS NOT NULL AND r28 IS NOT NULL").withColumn("p", F.col("r28") * -0.5)


LAB = lambda c, b=0.02: f"CASE WHEN {c} > {b} THEN 1 WHEN {c} < -{b} THEN -1 ELSE 0 END"


@query("w36_prediction_stability", f"""{PRED}, l AS (SELECT p, y, lag(p) OVER w AS pp, lag(y) OVER w AS py, date - lag(date) OVER w AS gap FROM pv WINDOW w AS (PARTITION BY {K} ORDER BY date))
SELECT count(*) AS n_pairs, round(corr(p, pp), 6) AS pred_corr, round(corr(y, py), 6) AS target_corr, round(avg(CASE WHEN {LAB('p')} <> {LAB('pp')} THEN 1.0 ELSE 0 END), 6) AS label_flips,
 round(avg(CASE WHEN {LAB('y')} <> {LAB('py')} THEN 1.0 ELSE 0 END), 6) AS target_flips, round(avg(CASE WHEN ({LAB('p')}) * ({LAB('pp')}) = -1 THEN 1.0 ELSE 0 END), 6) AS reversals FROM l WHERE gap = 1""")
def _(spark, sf):
    x = stability(predictions(spark, sf), SERIES, "date", "p", "y")
    return x.select("n_pairs", *r6("pred_corr", "target_corr", "label_flips", "target_flips", "reversals"))


@query("w37_smoothed_predictions", f"{PRED} SELECT {K}, date, " + ", ".join(f"round(avg(p) OVER (PARTITION BY {K} ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 6) AS p{k}" for k in (3, 7)) + " FROM pv")
def _(spark, sf):
    return predictions(spark, sf).select(*SERIES, "date", *[F.round(smoothed(SERIES, "date", "p", k), 6).alias(f"p{k}") for k in (3, 7)])


@query("w38_size_chunks", f"""{PRED}, h AS (SELECT round(abs(p), 6) AS size, CASE WHEN sign(p) * y > 0.01 THEN 1.0 ELSE 0.0 END AS hit FROM pv WHERE round(abs(p), 6) > 0.01),
o AS (SELECT size, hit, row_number() OVER (ORDER BY size, hit) - 1 AS i, count(*) OVER () AS n FROM h)
SELECT least(i // 1000, greatest(n // 1000 - 1, 0)) AS chunk, count(*) AS n, round(avg(hit), 6) AS hit_rate, round(median(size), 6) AS median_value FROM o GROUP BY ALL""")
def _(spark, sf):
    from ..functions.quantiles import ordered_chunks

    h = predictions(spark, sf).withColumn("size", F.round(F.abs("p"), 6)).where("size > 0.01").withColumn("hit", (F.signum("p") * F.col("y") > 0.01).cast("double"))
    return ordered_chunks(h, "size", "hit", 1000).select("chunk", "n", *r6("hit_rate", "median_value"))
