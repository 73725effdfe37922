"""Raw all-string pieces to typed tables. Each function takes opened frames and returns one table (or a few)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_weekend, parse_date, date_from_parts, parse_number, previous_day_midnight, safe_div
from ..operators import aggregates as A
from ..operators.asof import asof_forward_days
from ..operators.cleaning import domain_of_category, keyed_first, price_per_kg, route_hs, scale_units
from ..operators.matching import explode_list, unit_grams
from ..operators.repair import splice_renamed

# First kept day, end of the gap the second source fills, and names in the raw tables.
START, SECOND_SOURCE_UNTIL = "2015-01-01", "2018-01-01"
RETAIL, WHOLESALE, NATIONAL = "소매", "중도매", "전국"
NO_GRADE = "구분없음"
SECOND_SOURCE = {"se_cd": "01", "se_nm": "소매", "ctgry_cd": "500", "ctgry_nm": "축산물", "mrkt_nm": "축평원 소비자가격", "unit": "g"}
SECOND_SOURCE_ITEMS = ("4301", "4304")

PRICE_TEXT = ["se_cd", "se_nm", "ctgry_cd", "ctgry_nm", "item_cd", "item_nm", "vrty_cd", "vrty_nm", "grd_cd", "grd_nm", "sgg_cd", "sgg_nm", "mrkt_cd", "mrkt_nm", "unit"]


def survey_rows(at_price: DataFrame) -> DataFrame:
    out = at_price.select(
        parse_date("exmn_ymd").alias("date"), *PRICE_TEXT, parse_number("unit_sz").alias("unit_sz"),
        parse_number("exmn_dd_prc").alias("price"), parse_number("exmn_dd_cnvs_prc").alias("price_kg_api"),
    )
    return out.distinct().withColumn("source", F.lit("aT"))


def second_source_rows(e: DataFrame) -> DataFrame:
    """The consumer price source in the same columns, only before the first source covers the items."""
    c = SECOND_SOURCE
    none, code = F.lit(""), F.col("judgeKind")
    return e.select(
        parse_date("standYmd").alias("date"), F.lit(c["se_cd"]).alias("se_cd"), F.lit(c["se_nm"]).alias("se_nm"),
        F.lit(c["ctgry_cd"]).alias("ctgry_cd"), F.lit(c["ctgry_nm"]).alias("ctgry_nm"),
        F.when(code.isin(*SECOND_SOURCE_ITEMS), code).alias("item_cd"), F.col("judgeKindNm").alias("item_nm"),
        F.col("itemCd").alias("vrty_cd"), F.col("itemNm").alias("vrty_nm"), none.alias("grd_cd"),
        F.when(F.col("grdNm") == NO_GRADE, F.col("itemNm")).otherwise(F.col("grdNm")).alias("grd_nm"),
        none.alias("sgg_cd"), F.lit(NATIONAL).alias("sgg_nm"), none.alias("mrkt_cd"), F.lit(c["mrkt_nm"]).alias("mrkt_nm"),
        F.lit(c["unit"]).alias("unit"), F.lit(100.0).alias("unit_sz"), parse_number("ntslPrc").alias("price"),
        F.lit(None).cast("double").alias("price_kg_api"), F.lit("EKAPE").alias("source"),
    ).where(F.col("date") < F.to_date(F.lit(SECOND_SOURCE_UNTIL)))


def price_table(at_price: DataFrame, unit_table: DataFrame, renames: DataFrame | None = None, second: DataFrame | None = None, start: str = START) -> DataFrame:
    """Typed, unit-converted and re-linked prices with a domain column (write partitioned by it)."""
    out = survey_rows(at_price)
    if second is not None:
        out = out.unionByName(second_source_rows(second))
    out = unit_grams(out.where(F.col("date") >= F.to_date(F.lit(start))), unit_table)
    out = out.withColumn("price_kg", price_per_kg("price", "unit_sz", "unit_g"))
    if renames is not None:
        pairs = renames.select("se_nm", "item_nm", *[F.col(f"{t}_{s}").alias(f"{t}_{c}") for t in ("old", "new") for s, c in (("vrty", "vrty_nm"), ("grd", "grd_nm"))])
        out = splice_renamed(out, pairs, ["se_nm", "item_nm"], ["vrty_nm", "grd_nm"], ["vrty_cd", "grd_cd"], "date", "price_kg", ["price", "price_kg", "price_kg_api"])
    return out.withColumn("domain", domain_of_category("ctgry_cd")).where("domain IS NOT NULL")


def wholesale_market(df: DataFrame) -> DataFrame:
    names = {"FRMPRD_CATGORY_CD": "ctgry_cd", "FRMPRD_CATGORY_NM": "ctgry_nm", "PRDLST_CD": "item_cd", "PRDLST_NM": "item_nm", "SPCIES_CD": "vrty_cd", "SPCIES_NM": "vrty_nm",
             "GRAD_CD": "grd_cd", "GRAD_NM": "grd_nm", "EXAMIN_UNIT": "unit", "AREA_CD": "area_cd", "AREA_NM": "area_nm", "MRKT_CD": "mrkt_cd", "MRKT_NM": "mrkt_nm"}
    out = df.select(parse_date("EXAMIN_DE").alias("date"), *[F.col(a).alias(b) for a, b in names.items()], parse_number("AMT").alias("price")).distinct()
    return out.withColumn("domain", domain_of_category("ctgry_cd")).where("domain IS NOT NULL")


TRADE_KEYS = ["trd_clcln_ymd", "gds_lclsf_cd", "gds_lclsf_nm", "gds_mclsf_cd", "gds_mclsf_nm", "gds_sclsf_cd", "gds_sclsf_nm", "unit_nm"]


def market_trades(raw: DataFrame) -> DataFrame:
    """Settled trades per day, class and unit; one partial/final aggregation over all rows."""
    x = raw.select(*TRADE_KEYS, parse_number("unit_tot_qty").alias("_q"), parse_number("totprc").alias("_a"))
    out = A.trade_totals(x, TRADE_KEYS, "_q", "_a")
    text = F.regexp_replace("trd_clcln_ymd", "-", "")
    return out.withColumn("date", parse_date(text)).drop("trd_clcln_ymd")


def trades_by_item(trades: DataFrame, item_map: DataFrame) -> DataFrame:
    link = explode_list(item_map, "garak_item", "garak_key").select("ctgry_cd", "item_cd", "item_nm", "garak_key")
    j = trades.withColumn("garak_key", F.concat(F.col("gds_lclsf_nm"), F.lit(">"), F.col("gds_mclsf_nm"))).join(link, "garak_key")
    return A.totals_with_unit(j, ["date", "ctgry_cd", "item_cd", "item_nm"], "unit_nm", "kg", "qty", "amount", "n_trades")


def trade_origins(raw: DataFrame, alias: DataFrame, other: str = "기타") -> DataFrame:
    """kg volumes per day, class and origin region (first word of the origin through the alias table)."""
    first = F.split(F.trim(F.coalesce("plor_nm", F.lit(""))), r"\s+")[0]
    a = alias.select(F.col("name").alias("_n"), F.when(F.col("sido") == "전남+광주", "전남").otherwise(F.col("sido")).alias("_s"))
    x = raw.where("unit_nm = 'kg'").withColumn("_n", first).join(a, "_n", "left")
    key = F.concat(F.col("gds_lclsf_nm"), F.lit(">"), F.col("gds_mclsf_nm"))
    return x.groupBy(parse_date(F.regexp_replace("trd_clcln_ymd", "-", "")).alias("date"), key.alias("garak_key"), F.coalesce("_s", F.lit(other)).alias("sido")).agg(
        F.coalesce(F.sum(parse_number("unit_tot_qty")), F.lit(0.0)).alias("qty"))


# The two lunar holidays by column name, and names that are not the day itself.
LUNAR = {"seollal": "Seollal|설날", "chuseok": "Chuseok|추석"}
NOT_THE_DAY = "(?i)전날|다음날|eve|day after|대체|alternative"


def calendar_table(holidays: DataFrame, start: str = START) -> DataFrame:
    h = holidays.select(F.to_date("date").alias("date"), "name")
    last = h.agg(F.max("date").alias("_l"))
    days = last.select(F.explode(F.sequence(F.to_date(F.lit(start)), F.col("_l"))).alias("date"))
    names = h.withColumn("_o", F.monotonically_increasing_id())
    names = A.ordered_concat(names, ["date"], "name", "_o", ", ", "holiday_name", distinct=False)
    out = days.join(names, "date", "left").withColumn("is_holiday", F.col("holiday_name").isNotNull()).withColumn("is_weekend", is_weekend("date"))
    for col, pattern in LUNAR.items():
        main = h.where(F.col("name").rlike(pattern) & ~F.col("name").rlike(NOT_THE_DAY))
        out = asof_forward_days(out, "date", main, "date", f"days_to_{col}")
    return out


# Weather columns of the station table.
WEATHER = {"avgTa": "temp_avg", "minTa": "temp_min", "maxTa": "temp_max", "sumRn": "rain", "hr1MaxRn": "rain_1h_max", "sumSsHr": "sunshine_hr", "sumGsr": "solar_rad",
           "avgRhm": "humidity", "maxInsWs": "wind_gust", "avgWs": "wind_avg", "ddMes": "snow_depth", "avgTs": "ground_temp"}


def station_weather(asos: DataFrame) -> DataFrame:
    """Typed station days; a missing rain reading means no rain."""
    cols = [parse_number(k).alias(v) if k in asos.columns else F.lit(None).cast("double").alias(v) for k, v in WEATHER.items()]
    return asos.select(F.to_date("tm").alias("date"), F.col("stnId").alias("stn_id"), F.col("stnNm").alias("stn_nm"), *cols).fillna(0.0, subset=["rain"])


def national_weather(stations: DataFrame) -> DataFrame:
    return stations.groupBy("date").agg(*[F.avg(c).alias(c) for c in WEATHER.values()])


def macro_tables(ecos: dict[str, DataFrame], fuel: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fx_daily, macro_monthly) from the statistics tables."""
    parts = [d.select(F.lit("ECOS").alias("source"), F.lit(n).alias("table"), F.col("ITEM_CODE1").alias("code"), F.col("ITEM_NAME1").alias("name"), F.col("UNIT_NAME").alias("unit"), F.col("TIME").alias("period"), parse_number("DATA_VALUE").alias("value")) for n, d in ecos.items()]
    if fuel is not None:
        parts.append(fuel.select(F.lit("KOSIS").alias("source"), F.lit("fuel_price").alias("table"), F.col("C1").alias("code"), F.col("C1_NM").alias("name"), F.col("UNIT_NM").alias("unit"), F.col("PRD_DE").alias("period"), parse_number("DT").alias("value")))
    df = reduce(lambda a, b: a.unionByName(b), parts)
    fx = df.where("`table` = 'fx_usd'").select(parse_date("period").alias("date"), F.col("value").alias("usd_krw"))
    return fx, df.where("`table` <> 'fx_usd'").withColumn("month", parse_date("period", "yyyyMM")).drop("period")


def import_table(customs: DataFrame) -> DataFrame:
    """Monthly trade per code with its domain; total rows dropped."""
    c = customs.where(F.col("year").rlike(r"^\d{4}\.\d{2}$"))
    return c.select(
        parse_date("year", "yyyy.MM").alias("month"), F.col("hsCode").alias("hs_code"), F.col("statKor").alias("hs_name"), parse_number("impWgt").alias("imp_kg"),
        parse_number("impDlr").alias("imp_usd"), parse_number("expWgt").alias("exp_kg"), parse_number("expDlr").alias("exp_usd"), route_hs("hsCode").alias("domain"))


def long_statistics(df: DataFrame, table: str | None = None) -> DataFrame:
    """Statistics pieces with dimension columns named by the data itself (one row is read for the names)."""
    dims = sorted(c[:-3] for c in df.columns if re.fullmatch(r"C\d_NM", c))
    names = df.select(*[F.col(f"{d}_OBJ_NM") for d in dims]).first() if dims else []
    out = df.select(F.col("PRD_DE").alias("period"), F.col("ITM_ID").alias("item_id"), F.col("ITM_NM").alias("item_nm"), F.col("UNIT_NM").alias("unit"),
                    *[F.col(f"{d}_NM").alias(names[i]) for i, d in enumerate(dims)], parse_number("DT").alias("value"))
    return out.withColumn("table", F.lit(table)) if table else out


def disease_events(d: DataFrame) -> DataFrame:
    std = F.split(F.replace(F.replace(F.col("LKNTS_NM"), F.lit(" "), F.lit("")), F.lit("티프스"), F.lit("티푸스")), "-")[0]
    return d.select(
        parse_date("OCCRRNC_DE").alias("date"), parse_date("CESSATION_DE").alias("end_date"), F.col("LKNTS_NM").alias("disease"), std.alias("disease_std"),
        F.col("LVSTCKSPC_NM").alias("species"), parse_number("OCCRRNC_LVSTCKCNT").alias("head_count"), F.split(F.trim("FARM_LOCPLC"), r"\s+")[0].alias("region"),
        F.col("FARM_LOCPLC").alias("address"), F.col("FARM_LOCPLC_LEGALDONG_CODE").alias("legaldong_cd"))


def auctions(frames: dict[str, DataFrame], markets: DataFrame) -> DataFrame:
    """species name -> wide auction pieces; rows of month, grade, market with price and head count."""
    parts = []
    for species, a in frames.items():
        x = A.price_count_pairs(a.select("ym", "gradeNm", *[c for c in a.columns if c.endswith(("Amt", "Cnt"))]), ["ym", "gradeNm"])
        parts.append(x.withColumn("species", F.lit(species)))
    x = reduce(lambda a, b: a.unionByName(b), parts)
    x = x.select(parse_date("ym", "yyyyMM").alias("month"), F.col("gradeNm").alias("grade"), parse_number("price").alias("price"), parse_number("head_count").alias("head_count"), "species", F.regexp_replace("market", "c_", "").alias("market_cd"))
    return x.join(markets.select("market_cd", "market_nm", "region"), "market_cd", "left")


def pig_prices(p: DataFrame) -> DataFrame:
    return p.select(parse_date("sumYmd").alias("date"), F.col("sableGubn").alias("skin"), parse_number("costAmt").alias("price")).distinct()


def stocks(s: DataFrame) -> DataFrame:
    part = [c for c in s.columns if c.startswith("livestockPart_")] + ["totStock"]
    x = s.select(parse_date("ym", "yyyyMM").alias("month"), F.col("judgeKindNm").alias("species"), "unit", *[parse_number(c).alias(c) for c in part])
    return scale_units(x, "unit", "kg", part, 1000.0, "ton")


def coast_temperature(t: DataFrame) -> DataFrame:
    return t.select(parse_date("obs_dat").alias("date"), F.col("gru_nam").alias("sea"), F.col("sta_cde").alias("stn_cd"), F.col("sta_nam_kor").alias("stn_nm"), parse_number("wtr_tmp").alias("water_temp"), parse_number("air_tmp").alias("air_temp"), F.col("qc_wtr").alias("qc"))


def red_tide(r: DataFrame) -> DataFrame:
    return r.select(parse_date("day_report").alias("date"), F.col("cod_news").alias("news_id"), F.col("nam_biology").alias("organism"), F.col("txt_seas").alias("area"), parse_number("min_density").alias("density_min"),
                    parse_number("max_density").alias("density_max"), parse_number("min_watertemp").alias("water_temp_min"), parse_number("max_watertemp").alias("water_temp_max"))


FARM_MEASURES = ["TEMP_S", "TEMP_B", "SAL_S", "SAL_B", "PH_S", "PH_B", "DO_S", "DO_B", "COD_S", "COD_B", "DIN_S", "DIN_B", "DIP_S", "DIP_B", "TN_S", "TP_S", "SIL_S", "CHL_S", "CHL_B", "SS_S", "SS_B"]


def farm_survey(fe: DataFrame) -> DataFrame:
    vals = [parse_number(v).alias(v.lower()) if v in fe.columns else F.lit(None).cast("double").alias(v.lower()) for v in FARM_MEASURES]
    return fe.select(date_from_parts("DATE_Y", "DATE_M", "DATE_D").alias("date"), F.col("FISHERY").alias("fishery_area"), F.col("LOCATION_POINT").alias("point"), F.col("KIND").alias("kind"), parse_number("DEPTH").alias("depth"), *vals)


def jellyfish(j: DataFrame) -> DataFrame:
    return j.select(parse_date("inpt_date").alias("date"), F.col("board_subject").alias("title"))


# Headers of the buoy file.
BUOY = {"지점": "stn_id", "일시": "time", "수온(°C)": "water_temp", "풍속(m/s)": "wind"}


def buoy_hours(raw: DataFrame) -> DataFrame:
    """One reading per station and time; 24:00 counts for the day that ends."""
    h = raw.select(*[F.col(f"`{k}`").alias(v) for k, v in BUOY.items()])
    h = h.select("stn_id", F.try_to_timestamp("time").alias("time"), parse_number("water_temp").alias("water_temp"), parse_number("wind").alias("wind"))
    h = keyed_first(h, ["stn_id", "time"], [x for c in ("water_temp", "wind") for x in (F.col(c).isNull(), F.col(c))])
    return h.withColumn("date", previous_day_midnight("time"))


def buoy_days(hours: DataFrame, stations: DataFrame, start: str = START) -> DataFrame:
    d = hours.groupBy("stn_id", "date").agg(F.avg("water_temp").alias("water_temp"), F.max("water_temp").alias("water_temp_max"), F.avg("wind").alias("wind"), F.count("water_temp").alias("n_hours"))
    d = d.where(F.col("date") >= F.to_date(F.lit(start))).join(stations.select("stn_id", "stn_nm", "sea"), "stn_id", "left")
    return d.withColumn("core", F.col("stn_nm").isNotNull())


def sea_days(days: DataFrame, min_hours: int = 12) -> DataFrame:
    return days.where(F.col("core") & (F.col("n_hours") >= min_hours)).groupBy("date", "sea").agg(F.avg("water_temp").alias("water_temp"), F.countDistinct("stn_id").alias("n_buoys"))


def lower_columns(df: DataFrame, drop: tuple[str, ...] = ("ROW_NUM",)) -> DataFrame:
    d = df.drop(*drop)
    return d.toDF(*[c.lower() for c in d.columns])


# Nutrition columns kept for items.
NUTRITION = {"식품코드": "nutrition_code", "에너지(kcal)": "nutr_kcal", "단백질(g)": "nutr_protein_g", "지방(g)": "nutr_fat_g", "탄수화물(g)": "nutr_carb_g", "당류(g)": "nutr_sugar_g",
             "식이섬유(g)": "nutr_fiber_g", "나트륨(mg)": "nutr_sodium_mg", "폐기율(%)": "nutr_waste_pct"}


def item_nutrition(raw: DataFrame, item_map: DataFrame) -> DataFrame:
    nu = raw.select(*[(F.col(f"`{k}`") if v == "nutrition_code" else parse_number(F.col(f"`{k}`"))).alias(v) for k, v in NUTRITION.items()])
    vals = [v for v in NUTRITION.values() if v != "nutrition_code"]
    nu = keyed_first(nu, ["nutrition_code"], [x for v in vals for x in (F.col(v).isNull(), F.col(v))])
    return item_map.select("ctgry_cd", "item_cd", "nutrition_code").join(nu, "nutrition_code", "left").drop("nutrition_code")
