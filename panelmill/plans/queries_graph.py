"""The crop tables from raw pieces to the model input: every outside variable, composites, and the rebuild on cleaned prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.models import side_by_side
from ..session import cut_lineage
from . import frames as FR
from . import processed as PR
from .graph import AGRI_VARIABLES, Tables, agri_steps
from .queries_models import TEST, TRAIN, TR_SQL, train_rows
from .queries_windows import MKT, r6
from .registry import query
from .roles import FACTS, SqlFrames, history_sql, observations, table

TEXT = lambda c: F.col(c).cast("string")

# Channels as items: name, food group, trade code prefixes, market categories.
ITEMS = {"A": ("쌀", "곡류", "1;12", "A>F;A>O"), "N": ("사과", "과일류", "2;35", "N>F;N>O"), "R": ("배추", "채소류", "4", "R>F")}
YEARS, TRADES_FROM = (1995, 1999), "1998-01-03"
IMPORT_INDEX = {"1-URGENT": "과일", "2-HIGH": "곡류", "3-MEDIUM": "맥류및잡곡", "4-NOT SPECIFIED": "콩류", "5-LOW": "과실및채소가공품"}
FUELS = {"1-URGENT": "보통휘발유", "2-HIGH": "자동차용 경유", "3-MEDIUM": "실내등유"}
ITEM_CPI = {"4-NOT SPECIFIED": "쌀", "5-LOW": "사과"}
NUMBERS = ["premium", "nat_r28", "fuel_휘발유경유등유", "wx_temp_avg_nat_prod", "wx_rain_nat_prod", "wx_sun_solar_hr_nat_prod", "impidx_item_matched", "impidx_과실및채소가공품", "whsl_gap_anom", "wx_rain_14d", "wx_sun_14d_anom", "wx_temp_14d_anom", "wx_gust20_station_share_14d"]


def named(names: dict, key) -> F.Column:
    """The name listed for the key, NULL for others."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col(key) == k, v).otherwise(out)
    return out


def agri_tables(spark, sf) -> Tables:
    """Raw pieces shaped from the driver tables, run through the builders of the typed tables.

    Every typed table is written once: the steps read most of them several times, and each comes from all observations or orders.
    Tables that don't read each other are written side by side: each has a tail of small jobs that leaves cores idle.
    """
    stored = lambda frames: side_by_side(spark, [lambda x=x: cut_lineage(x) for x in frames])
    o = cut_lineage(observations(spark, sf, True).select("date", "channel", "status", "qty", "amount", "price", "market", "region", "psize", "l_partkey"))
    pick = lambda i: named({k: v[i] for k, v in ITEMS.items()}, "channel")
    const = {"ctgry_cd": F.lit("200"), "item_cd": F.col("channel"), "item_nm": pick(0), "vrty_nm": F.lit("v"), "grd_nm": F.lit("g"), "se_nm": F.lit(PR.RETAIL), "sgg_nm": F.col("region"), "mrkt_cd": TEXT("market")}
    prices = o.where("price > 0").select("date", *[c.alias(n) for n, c in const.items()], F.col("price").alias("price_kg"))
    items = o.select("channel").distinct().select(F.lit("agri").alias("domain"), const["ctgry_cd"].alias("ctgry_cd"), F.col("channel").alias("item_cd"), *[pick(i).alias(n) for i, n in enumerate(("item_nm", "food_group", "hs_prefixes", "garak_item"))], F.concat(F.lit("tab:"), "channel").alias("kosis_production"))

    od = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderpriority", "o_totalprice")
    y = od.select(F.year("date").alias("y")).distinct()
    feast = lambda m, d, name: F.struct(F.make_date("y", F.lit(m), F.lit(d)).cast("string").alias("date"), F.lit(name).alias("name"))
    holidays = y.select(F.inline(F.array(feast(1, 31, "Seollal eve"), feast(2, 1, "Seollal"), feast(9, 20, "Chuseok"))))

    st = o.groupBy("date", "market").agg(F.avg("price").alias("a"), F.when(F.min("qty") <= 20, F.sum("qty")).alias("r"), F.count(F.lit(1)).alias("n"), F.max("qty").alias("g"), F.avg("qty").alias("s"))
    stations = PR.station_weather(st.select(TEXT("date").alias("tm"), TEXT("market").alias("stnId"), TEXT("market").alias("stnNm"), TEXT("a").alias("avgTa"), F.coalesce(TEXT("r"), F.lit("")).alias("sumRn"), TEXT("n").alias("sumSsHr"), TEXT("g").alias("maxInsWs"), TEXT("s").alias("sumGsr")))

    total = od.groupBy("o_orderpriority", F.date_format("date", "yyyyMM").alias("TIME")).agg(F.sum("o_totalprice").cast("decimal(20,2)").alias("v"), F.count(F.lit(1)).alias("n"))
    daily_total = od.groupBy(F.date_format("date", "yyyyMMdd").alias("TIME")).agg(F.avg("o_totalprice").alias("v"))
    piece = lambda df, name: df.select(F.lit("c").alias("ITEM_CODE1"), name.alias("ITEM_NAME1"), F.lit("won").alias("UNIT_NAME"), "TIME", TEXT("v").alias("DATA_VALUE")).where("ITEM_NAME1 IS NOT NULL")
    fuel = total.select(F.lit("c").alias("C1"), named(FUELS, "o_orderpriority").alias("C1_NM"), F.lit("won").alias("UNIT_NM"), F.col("TIME").alias("PRD_DE"), TEXT("n").alias("DT")).where("C1_NM IS NOT NULL")
    fx, macro = PR.macro_tables({"fx_usd": piece(daily_total, F.lit("fx")), "import_price": piece(total, named(IMPORT_INDEX, "o_orderpriority")), "cpi": piece(total, named(ITEM_CPI, "o_orderpriority"))}, fuel)

    code = F.lpad((F.col("l_partkey") * 37 % 10000).cast("string"), 4, "0")
    customs = o.groupBy(F.date_format("date", "yyyy.MM").alias("year"), code.alias("hsCode")).agg(F.sum("qty").cast("decimal(20,2)").alias("q"), F.sum("amount").cast("decimal(20,2)").alias("a"))
    imports = PR.import_table(customs.select("year", "hsCode", F.col("hsCode").alias("statKor"), TEXT("q").alias("impWgt"), TEXT("a").alias("impDlr"), F.lit("-").alias("expWgt"), F.lit("").alias("expDlr")))

    raw = o.select(F.date_format("date", "yyyyMMdd").alias("trd_clcln_ymd"), *[F.col(c).alias(f"gds_{s}_{t}") for c, s in (("channel", "lclsf"), ("status", "mclsf"), ("status", "sclsf")) for t in ("cd", "nm")],
                   F.when(F.col("psize") % 2 == 1, "kg").otherwise("box").alias("unit_nm"), TEXT("qty").alias("unit_tot_qty"), TEXT("amount").alias("totprc"), F.concat_ws(" ", "region", F.lit("farm")).alias("plor_nm"))
    alias = o.select(F.col("region").alias("name")).distinct()

    made = o.groupBy("channel", F.year("date").alias("y"), "region").agg(F.sum("qty").alias("q"), F.count(F.lit(1)).alias("n"))
    whole = made.groupBy("channel", "y").agg(F.sum("q").alias("q"), F.sum("n").alias("n")).withColumn("region", F.lit(PR.NATIONAL))
    figures = made.unionByName(whole).select("*", F.inline(F.array(*[F.struct(F.concat("channel", F.lit(s)).alias("ITM_NM"), TEXT(c).alias("DT")) for s, c in ((":생산량", "q"), (":면적", "n"))])))
    regions = o.select(TEXT("market").alias("stnId"), F.col("region").alias("sido")).distinct()

    prices, items, stations, fx, macro, imports, alias, figures, regions = stored([prices, items, stations, fx, macro, imports, alias, figures, regions])
    alias = alias.withColumn("sido", F.col("name"))
    weather, trades, origins = stored([PR.national_weather(stations), PR.trades_by_item(PR.market_trades(raw), items), PR.trade_origins(raw, alias)])
    production = PR.long_statistics(figures.select(TEXT("y").alias("PRD_DE"), F.lit("T").alias("ITM_ID"), "ITM_NM", F.lit("t").alias("UNIT_NM"), "DT", F.col("region").alias("C1_NM"), F.lit("시도별").alias("C1_OBJ_NM")), "tab")

    sources = {
        "prices": prices, "items": items, "calendar": PR.calendar_table(holidays, "1995-01-01"), "stations": stations, "weather": weather, "fx": fx, "macro": macro, "imports": imports,
        "trades": trades, "origins": origins, "production": production, "alias": alias, "station_region": regions,
    }
    return Tables(sources, agri_steps(AGRI_VARIABLES, NUMBERS, train_rows(), YEARS, TRADES_FROM, "1995-01-01"))


def _case(names: dict, key: str) -> str:
    return f"CASE {key} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in names.items())} END"


_PREFIX = "(VALUES " + ", ".join(f"('{c}', '{p}')" for c, v in ITEMS.items() for p in v[2].split(";")) + ") px(channel, pre)"
_KEYS = "(VALUES " + ", ".join(f"('{c}', '{k}')" for c, v in ITEMS.items() for k in v[3].split(";")) + ") gx(channel, gk)"
_NAME, _GROUP = (_case({c: v[i] for c, v in ITEMS.items()}, "channel") for i in (0, 1))
_MACRO = ", ".join([f"""max(CASE priority WHEN '{k}' THEN round(total, 2) END) AS "impidx_{v}" """ for k, v in IMPORT_INDEX.items()] + [f"""max(CASE priority WHEN '{k}' THEN n_orders END)::DOUBLE AS "fuel_{v.replace(' ', '_')}" """ for k, v in FUELS.items()])
_W, _R = SqlFrames([]), SqlFrames(["channel", "region"])

#: Outside tables; they don't depend on which copy of the prices is used.
OUTSIDE = f"""{MKT}, {FACTS}, hd AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), s AS (SELECT make_date(y, 2, 1) AS m FROM hd), c AS (SELECT make_date(y, 9, 20) AS m FROM hd), last_day AS (SELECT max(m) AS z FROM c),
st AS (SELECT date, market, region, avg(price) AS ta, CASE WHEN min(qty) > 20 THEN 0 ELSE sum(qty) END AS rn, count(*) AS sn, max(qty) AS gu, avg(qty) AS so FROM obs GROUP BY ALL),
wx AS (SELECT date, date - DATE '1970-01-01' AS dn, avg(ta) AS ta, avg(rn) AS rn, avg(sn) AS sn, avg(so) AS so, avg(CASE WHEN gu >= 20 THEN 1.0 ELSE 0.0 END) AS gs FROM st GROUP BY ALL),
fx AS (SELECT CAST(o_orderdate AS DATE) AS fd, avg(o_totalprice) AS usd FROM orders GROUP BY ALL), mac AS (SELECT avail, {_MACRO} FROM facts GROUP BY ALL),
cpi AS (SELECT avail, {_case(ITEM_CPI, 'priority')} AS item_nm, total AS cpi FROM facts WHERE {_case(ITEM_CPI, 'priority')} IS NOT NULL),
tc AS (SELECT lpad(CAST(l_partkey * 37 % 10000 AS VARCHAR), 4, '0') AS code, CAST(date_trunc('month', date) AS DATE) AS month, sum(qty) AS q, sum(amount) AS a FROM obs GROUP BY ALL),
im AS (SELECT channel, month, CAST(last_day(month) + 20 AS DATE) AS avail, sum(q) AS q, sum(a) AS a FROM tc JOIN (SELECT DISTINCT channel, code FROM tc JOIN {_PREFIX} ON starts_with(code, pre)) USING (code) GROUP BY ALL),
tr AS (SELECT date, obs.channel, sum(CASE WHEN psize % 2 = 1 THEN qty END) AS tq, sum(CASE WHEN psize % 2 = 1 THEN amount END) / sum(CASE WHEN psize % 2 = 1 THEN qty END) AS tp, count(*) AS tn FROM obs JOIN {_KEYS} ON obs.channel || '>' || status = gk GROUP BY ALL),
og AS (SELECT date, channel || '>' || status AS gk, CASE WHEN region LIKE '% %' THEN '기타' ELSE region END AS sido, sum(qty) AS q FROM obs WHERE psize % 2 = 1 GROUP BY ALL),
tp AS (SELECT gk, sido AS top FROM (SELECT gk, sido, sum(q) AS q FROM og WHERE sido <> '기타' AND year(date) BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY gk ORDER BY q DESC, sido) = 1),
os AS (SELECT date, channel, avg(sh) AS top_share FROM (SELECT date, gk, coalesce(sum(CASE WHEN sido = top THEN q END), 0) / sum(q) AS sh FROM og JOIN tp USING (gk) GROUP BY ALL) JOIN {_KEYS} USING (gk) GROUP BY ALL),
wr AS (SELECT date, region, avg(ta) AS ta, avg(rn) AS rn, avg(sn) AS sn FROM st GROUP BY ALL), wt AS (SELECT channel, region, sum(qty) AS w FROM obs WHERE year(date) BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY ALL),
pw AS (SELECT channel, date, sum(w * ta) / sum(w) AS pta, sum(w * rn) / sum(w) AS prn, sum(w * sn) / sum(w) AS psn FROM wr JOIN wt USING (region) GROUP BY ALL),
pd AS (SELECT channel, year(date) AS py, make_date(year(date) + 1, 3, 1) AS avail, sum(qty) AS ton, count(*) AS area FROM obs GROUP BY ALL),
we AS (SELECT date, dn, weekofyear(date) AS woy, year(date) AS yr, {_W.sum('rn', 0, 13, 7)} AS r14, {_W.sum('sn', 0, 13, 10)} AS s14, {_W.mean('ta', 0, 13, 10)} AS t14 FROM wx),
wy AS (SELECT woy, yr, avg(avg(s14)) OVER w AS ps, avg(avg(t14)) OVER w AS pt FROM we GROUP BY woy, yr WINDOW w AS (PARTITION BY woy ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wa AS (SELECT date, r14, s14 - ps AS sa, t14 - pt AS ta FROM we JOIN wy USING (woy, yr)),
gd AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM wx), gu AS (SELECT date, max(gs) OVER (ORDER BY date RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW) AS gust FROM gd LEFT JOIN wx USING (date))"""


def variables_sql(p: str) -> str:
    """CTE <p>v: one row for each (channel, date) of <p>d with the outside variables known on the day."""
    return f"""{p}v0 AS (SELECT d.*, {_NAME} AS item_nm, {_GROUP} AS grp FROM {p}d d), {p}v1 AS (SELECT d.*, s.m - d.date AS ds, d.date <= z AS listed, fx.usd FROM {p}v0 d CROSS JOIN last_day ASOF LEFT JOIN s ON d.date <= s.m ASOF LEFT JOIN fx ON d.date >= fx.fd),
{p}v2 AS (SELECT d.*, mac.* EXCLUDE (avail), c.m - d.date AS dc FROM {p}v1 d ASOF LEFT JOIN mac ON d.date >= mac.avail ASOF LEFT JOIN c ON d.date <= c.m), {p}v3 AS (SELECT d.*, cpi.cpi FROM {p}v2 d ASOF LEFT JOIN cpi ON d.item_nm = cpi.item_nm AND d.date >= cpi.avail),
{p}v4 AS (SELECT d.*, im.month AS import_month, im.q AS iq, im.a AS ia FROM {p}v3 d ASOF LEFT JOIN im ON d.channel = im.channel AND d.date >= im.avail), {p}v5 AS (SELECT d.*, pd.py, pd.ton, pd.area FROM {p}v4 d ASOF LEFT JOIN pd ON d.channel = pd.channel AND d.date >= pd.avail),
{p}v AS (SELECT d.*, wx.ta AS wta, wx.rn AS wrn, wx.sn AS wsn, wx.so AS wso, CASE WHEN tr.tq IS NULL AND d.date >= DATE '{TRADES_FROM}' THEN 0 ELSE tr.tq END AS tq, CASE WHEN tr.tq IS NULL AND d.date >= DATE '{TRADES_FROM}' THEN 0 ELSE tr.tn END AS tn, tr.tp, os.top_share, pw.pta, pw.prn, pw.psn
FROM {p}v5 d LEFT JOIN wx ON wx.date = d.date LEFT JOIN tr ON tr.date = d.date AND tr.channel = d.channel LEFT JOIN os ON os.date = d.date AND os.channel = d.channel LEFT JOIN pw ON pw.date = d.date AND pw.channel = d.channel)"""


def prices_sql(p: str, rows: str) -> str:
    """CTEs <p>d and <p>r: daily medians of a price copy, over the country and by region, and their histories <p>h and <p>q."""
    med = "date - DATE '1970-01-01' AS dn, median(price) AS price"
    return f"{p}d AS (SELECT channel, date, {med} FROM {rows} GROUP BY ALL), {p}r AS (SELECT channel, region, date, {med} FROM {rows} GROUP BY ALL), {history_sql(['channel'], f'{p}d', f'{p}h')}, {history_sql(['channel', 'region'], f'{p}r', f'{p}q')}"


def frame_sql(p: str) -> str:
    """CTE <p>f: the model frame of a price copy, floats narrowed."""
    raw = ["wta", "wrn", "wsn", "wso", "pta", "prn", "psn", "tp", "fuel_보통휘발유", "fuel_자동차용_경유", "fuel_실내등유", *[f"impidx_{v}" for v in IMPORT_INDEX.values()]]
    v = ", ".join(f'v."{c}"' for c in raw)
    norm = ["fuel_보통휘발유", "fuel_자동차용_경유", "fuel_실내등유", "wso", "wsn", "psn"]
    means = ", ".join(f'avg("{c}") AS "m_{c}"' for c in norm)
    share = lambda cols: "list_avg([" + ", ".join(f'"{c}" / nullif("m_{c}", 0)' for c in cols) + "])"
    f4 = lambda e, n: f"CAST(CAST({e} AS FLOAT) AS DOUBLE) AS \"{n}\""
    out = [f4(e, n) for e, n in (("y", "y"), ("base", "base"), ("premium", "premium"), ("nat_r28", "nat_r28"), (share(norm[:3]), NUMBERS[2]), ("list_avg([wta, pta])", NUMBERS[3]), ("list_avg([wrn, prn])", NUMBERS[4]), (share(norm[3:]), NUMBERS[5]),
           ("""CASE WHEN starts_with(grp, '과일') THEN "impidx_과일" WHEN item_nm IN ('쌀', '찹쌀', '현미') THEN "impidx_곡류" END""", NUMBERS[6]), ('"impidx_과실및채소가공품"', NUMBERS[7]), (f"g - ({_R.mean('g', 0, 90, 27)})", NUMBERS[8]), ("r14", NUMBERS[9]), ("sa", NUMBERS[10]), ("wat", NUMBERS[11]), ("gust", NUMBERS[12]))]
    return f"""{p}c AS (SELECT q.channel, q.region, q.date, q.dn, 0 AS is_nat, q.y, q.base, q.base / h.base - 1 AS premium, h.r28 AS nat_r28, v.item_nm, v.grp, {v} FROM {p}q q LEFT JOIN {p}h h ON h.channel = q.channel AND h.date = q.date LEFT JOIN {p}v v ON v.channel = q.channel AND v.date = q.date WHERE q.y IS NOT NULL
UNION ALL SELECT h.channel, '전국', h.date, h.dn, 1, h.y, h.base, 0.0, h.r28, v.item_nm, v.grp, {v} FROM {p}h h JOIN {p}v v ON v.channel = h.channel AND v.date = h.date WHERE h.y IS NOT NULL),
{p}m AS (SELECT {means} FROM {p}c WHERE {TR_SQL}), {p}g AS (SELECT c.*, m.*, CASE WHEN tp / base > 0 THEN ln(tp / base) END AS g, wa.r14, wa.sa, wa.ta AS wat, gu.gust FROM {p}c c CROSS JOIN {p}m m LEFT JOIN wa ON wa.date = c.date LEFT JOIN gu ON gu.date = c.date),
{p}f AS (SELECT item_nm, region AS sgg_nm, date, is_nat, {', '.join(out)}, grp NOT IN ('곡류', '두류', '견과·종실류') AS in_scope_processed, item_nm IN ('쌀', '찹쌀', '현미') OR starts_with(grp, '과일') AS in_scope_matched FROM {p}g)"""


_ORIGINAL = f"ok AS (SELECT channel, region, date, price FROM obs WHERE price > 0), {prices_sql('raw_', 'ok')}, {variables_sql('raw_')}"
_CLEANED = f"ck AS (SELECT o.channel, o.region, o.date, CASE WHEN spike THEN prev_price ELSE o.price END AS price FROM obs o JOIN fl ON o.channel = fl.channel AND o.market = fl.market AND o.date = fl.date WHERE o.price > 0), {prices_sql('fix_', 'ck')}, {variables_sql('fix_')}"
_SHOWN = ", ".join(f'round("{c}", 5) AS "{c}"' for c in ("y", "base", *NUMBERS))


@query("d12_crop_variables", f"""WITH {OUTSIDE}, {_ORIGINAL} SELECT item_nm, date, round(price, 6) AS price_kg, CASE WHEN date <= last_day.z THEN ds END AS days_to_seollal, dc AS days_to_chuseok, round(wta, 6) AS wx_temp_avg, round(wrn, 6) AS wx_rain, round(usd, 6) AS usd_krw, round("impidx_과일", 2) AS "impidx_과일",
round("fuel_자동차용_경유", 2) AS "fuel_자동차용_경유", round(cpi, 2) AS cpi_item, round(iq, 2) AS import_kg, round(ia, 2) AS import_usd, import_month, round(tq, 6) AS garak_qty_kg, round(tp, 6) AS garak_price_kg, CAST(tn AS DOUBLE) AS garak_n_trades, round(top_share, 6) AS garak_top_origin_share,
round(pta, 6) AS prodarea_temp_avg, round(prn, 6) AS prodarea_rain, round(ton, 2) AS production_ton, CAST(area AS DOUBLE) AS cultivated_area_ha, CAST(py AS BIGINT) AS production_year FROM raw_v CROSS JOIN last_day""")
def _(spark, sf):
    x = agri_tables(spark, sf).table("dataset")
    r2 = lambda *cols: [F.round(F.col(f"`{c}`"), 2).alias(c) for c in cols]
    return x.select("item_nm", "date", *r6("price_kg"), *[F.col(c).cast("long").alias(c) for c in ("days_to_seollal", "days_to_chuseok")], *r6("wx_temp_avg", "wx_rain", "usd_krw"), *r2("impidx_과일", "fuel_자동차용_경유", "cpi_item", "import_kg", "import_usd"), "import_month",
                    *r6("garak_qty_kg", "garak_price_kg"), "garak_n_trades", *r6("garak_top_origin_share", "prodarea_temp_avg", "prodarea_rain"), *r2("production_ton"), "cultivated_area_ha", F.col("production_year").cast("long").alias("production_year"))


def shown(x):
    return [F.round(F.col(f"`{c}`").cast("double"), 5).alias(c) for c in ("y", "base", *NUMBERS)]


@query("d15_crop_model_frame", f"""WITH {OUTSIDE}, {_ORIGINAL}, {frame_sql('raw_')} SELECT item_nm, sgg_nm, date, is_nat, {_SHOWN}, in_scope_processed, in_scope_matched FROM raw_f""")
def _(spark, sf):
    tables = agri_tables(spark, sf)
    side_by_side(spark, [lambda n=n: tables.table(n) for n in ("regional", "dataset", "gusts")])
    x = tables.table("model_frame")
    return x.select("item_nm", "sgg_nm", "date", "is_nat", *shown(x), F.col("_scope__impidx_과실및채소가공품").alias("in_scope_processed"), F.col("_scope__impidx_item_matched").alias("in_scope_matched"))


@query("d16_crop_frames_rebuilt", f"""WITH {OUTSIDE}, {_ORIGINAL}, {frame_sql('raw_')}, {_CLEANED}, {frame_sql('fix_')} SELECT item_nm, sgg_nm, date, is_nat, 'train' AS split, {_SHOWN} FROM fix_f WHERE {TR_SQL} UNION ALL SELECT item_nm, sgg_nm, date, is_nat, 'test', {_SHOWN} FROM raw_f WHERE date >= DATE '{TEST}'""")
def _(spark, sf):
    original = agri_tables(spark, sf)
    made = lambda t, *names: [lambda n=n: t.table(n) for n in names]
    repaired, *_ = side_by_side(spark, [lambda: cut_lineage(FR.cleaned_prices(original.table("prices"))), *made(original, "regional", "dataset", "gusts")])
    cleaned = original.with_source("prices", repaired)
    side_by_side(spark, [*made(original, "model_frame"), *made(cleaned, "regional", "dataset")])
    x = FR.model_input(cleaned.table("model_frame"), original.table("model_frame"), TRAIN, TEST, ("train", "test"))
    return x.select("item_nm", "sgg_nm", "date", "is_nat", "split", *shown(x))
