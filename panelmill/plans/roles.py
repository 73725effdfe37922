"""The driver tables read as a price panel, and the SQL text of the same views.

series = (item = part type, channel = return flag); market = supplier; region = the supplier's region;
price = extended price / quantity; facts = monthly order totals, public 20 days after month end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import exact_median
from ..functions.scalars import month_end, safe_div

SERIES = ["item", "channel"]


LARGE = ("documents",)  # text work is heavy enough to pay for dealing a single split out


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return use_all_cores(df) if name in LARGE else df


def use_all_cores(df: DataFrame) -> DataFrame:
    """A table that arrives in fewer splits than cores (one small file) is dealt out once; otherwise nothing happens."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def observations(spark: SparkSession, sf: str, regions: bool = False) -> DataFrame:
    """Market-level observations: lineitem with its part (and the supplier's nation and region).

    part, supplier, nation and region are joined without hints: Spark broadcasts them while their size allows.
    """
    li = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("channel"),
        F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amount"),
        safe_div("l_extendedprice", "l_quantity").alias("price"), F.col("l_suppkey").alias("market"), F.col("l_orderkey").alias("orderkey"),
        "l_discount", "l_tax", "l_linenumber",
    )
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("item"), F.col("p_brand").alias("brand"), F.col("p_name").alias("pname"), F.col("p_size").alias("psize"))
    out = li.join(part, "l_partkey")
    if regions:
        sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
        nat = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"), F.col("n_regionkey").alias("r_regionkey"))
        reg = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
        out = out.join(sup, "l_suppkey").join(nat, "n_nationkey").join(reg, "r_regionkey")
    return out


def daily_prices(spark: SparkSession, sf: str, keys=None) -> DataFrame:
    """Exact median price per series and day."""
    keys = keys or SERIES
    src = observations(spark, sf, regions="region" in keys or "nation" in keys)
    return exact_median(src.where("price > 0"), [*keys, "date"], "price", "price")


def monthly_facts(spark: SparkSession, sf: str) -> DataFrame:
    """month, priority, total, n_orders, avail (month end + 20 days)."""
    o = table(spark, sf, "orders")
    return (
        o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.col("o_orderpriority").alias("priority"))
        .agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders"))
        .withColumn("avail", month_end("month", 20))
    )


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.to_date("ts").alias("date"), "ts", "user_id", "event_type", "value", "props")


# ---- the same views as SQL

OBS = """obs AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS channel, l_linestatus AS status, l_quantity AS qty,
         l_extendedprice AS amount, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS price,
         l_suppkey AS market, l_orderkey AS orderkey, p_type AS item, p_brand AS brand, p_name AS pname, p_size AS psize,
         n_name AS nation, r_name AS region, l_discount, l_tax, l_linenumber, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

FACTS = """facts AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS priority, sum(o_totalprice) AS total,
         count(*) AS n_orders, CAST(last_day(CAST(date_trunc('month', o_orderdate) AS DATE)) + 20 AS DATE) AS avail
  FROM orders GROUP BY ALL)"""


def daily_sql(keys=None, name: str = "daily") -> str:
    k = ", ".join(keys or SERIES)
    return f"{name} AS (SELECT {k}, date, date - DATE '1970-01-01' AS dn, median(price) AS price FROM obs WHERE price > 0 GROUP BY {k}, date)"


class SqlFrames:
    """SQL text of calendar-day frames."""

    def __init__(self, keys, order: str = "dn"):
        part = f"PARTITION BY {', '.join(keys)} " if keys else ""
        self.over = lambda lo, hi: f"OVER ({part}ORDER BY {order} RANGE BETWEEN {self._b(hi, True)} AND {self._b(lo, False)})"

    @staticmethod
    def _b(n: int, start: bool) -> str:
        return f"{n} PRECEDING" if n >= 0 else f"{-n} FOLLOWING"

    def mean(self, c, lo, hi, m):
        w = self.over(lo, hi)
        return f"CASE WHEN count({c}) {w} >= {m} THEN avg({c}) {w} END"

    def sum(self, c, lo, hi, m=1):
        w = self.over(lo, hi)
        return f"CASE WHEN count({c}) {w} >= {m} THEN sum({c}) {w} END"

    def max(self, c, lo, hi, m=1):
        w = self.over(lo, hi)
        return f"CASE WHEN count({c}) {w} >= {m} THEN max({c}) {w} END"

    def std(self, c, lo, hi, m):
        w = self.over(lo, hi)
        return f"CASE WHEN count({c}) {w} >= {m} THEN stddev_samp({c}) {w} END"

    def count(self, c, lo, hi):
        return f"count({c}) {self.over(lo, hi)}"

    def at(self, c, k):
        return f"max({c}) {self.over(k, k)}"


def ln_ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 AND ({a}) / ({b}) > 0 THEN ln(({a}) / ({b})) END"


def history_sql(keys=None, src: str = "daily", name: str = "hist", horizon: int = 28) -> str:
    """CTEs <name>0 and <name>: price history features and forward means."""
    k = keys or SERIES
    f = SqlFrames(k)
    ks = ", ".join(k)
    step = f"CASE WHEN dn - lag(dn) OVER (PARTITION BY {ks} ORDER BY dn) = 1 THEN ln(price / lag(price) OVER (PARTITION BY {ks} ORDER BY dn)) END AS step"
    return f"""{name}0 AS (SELECT *, {step} FROM {src}),
{name}1 AS (SELECT *, {f.mean('price', 0, 6, 3)} AS base, {f.mean('price', 7, 13, 3)} AS m7, {f.mean('price', 28, 34, 3)} AS m28,
  {f.mean('price', 91, 97, 3)} AS m91, {f.mean('price', 358, 371, 3)} AS m358, {f.mean('price', 358, 364, 3)} AS lyb,
  {f.mean('price', 364 - horizon, 363, 10)} AS lyn, {f.std('step', 0, 27, 10)} AS vol28, CAST({f.count('price', 0, 27)} AS DOUBLE) AS n_obs28,
  {f.mean('price', -14, -1, 5)} AS fwd14, {f.mean('price', -horizon, -1, max(5, horizon // 3))} AS fwd{horizon} FROM {name}0),
{name} AS (SELECT {ks}, date, dn, price, base, fwd14, fwd{horizon}, ln(base / m7) AS r7, ln(base / m28) AS r28, ln(base / m91) AS r91, ln(base / m358) AS yoy,
  vol28, ln(price / base) AS dev_last, ln(lyn / lyb) AS ly_change, n_obs28, fwd{horizon} / base - 1 AS y FROM {name}1)"""
