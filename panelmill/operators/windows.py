"""Calendar-day windows over irregular series.

A series keeps only its observed days; frames are ranges of day numbers, so missing days need no rows. After the
daily aggregation a series has at most one row per calendar day, so a window partition is bounded by the calendar
no matter how many raw observations a series has. All features that share keys run in one window pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_col, day_number, iso_week, log_ratio, safe_div, safe_ln

HISTORY = ["r7", "r28", "r91", "yoy", "vol28", "dev_last", "ly_change", "n_obs28"]


class DayFrames:
    """Aggregates of a column over day offsets [t - hi, t - lo] (negative offsets look forward)."""

    def __init__(self, keys: list[str], day: str = "date"):
        self.rows = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(day_number(day))

    def frame(self, lo: int, hi: int):
        return self.rows.rangeBetween(-hi, -lo)

    def mean(self, c, lo: int, hi: int, min_obs: int) -> Column:
        c, w = as_col(c), self.frame(lo, hi)
        return F.when(F.count(c).over(w) >= min_obs, F.avg(c).over(w))

    def sum(self, c, lo: int, hi: int, min_obs: int = 1) -> Column:
        c, w = as_col(c), self.frame(lo, hi)
        return F.when(F.count(c).over(w) >= min_obs, F.sum(c).over(w))

    def max(self, c, lo: int, hi: int, min_obs: int = 1) -> Column:
        c, w = as_col(c), self.frame(lo, hi)
        return F.when(F.count(c).over(w) >= min_obs, F.max(c).over(w))

    def std(self, c, lo: int, hi: int, min_obs: int) -> Column:
        c, w = as_col(c), self.frame(lo, hi)
        return F.when(F.count(c).over(w) >= min_obs, F.stddev_samp(c).over(w))

    def count(self, c, lo: int, hi: int) -> Column:
        return F.count(as_col(c)).over(self.frame(lo, hi))

    def at(self, c, days_ago: int) -> Column:
        """Value exactly that many calendar days ago (same-series lookup without a join)."""
        return F.max(as_col(c)).over(self.frame(days_ago, days_ago))

    def latest_within(self, c, lo: int, hi: int) -> Column:
        """Last non-missing value in the frame: a backward lookup at t - lo with tolerance hi - lo."""
        return F.last(as_col(c), ignorenulls=True).over(self.frame(lo, hi))

    def trailing_mean(self, c, days: int, min_obs: int | None = None) -> Column:
        """Mean over the last `days` days, by default needing 30 % of them (at least 3)."""
        return self.mean(c, 0, days - 1, min_obs or max(3, int(days * 0.3)))

    def days_since_start(self, day: str = "date") -> Column:
        """Calendar days from the first row up to today, both included: gates windows that count grid days."""
        first = F.min(day_number(day)).over(self.rows.rangeBetween(Window.unboundedPreceding, 0))
        return day_number(day) - first + 1


def forward_mean(f: DayFrames, price, h: int) -> Column:
    """Mean of days t+1 .. t+h, needing a third of them (at least 5)."""
    return f.mean(price, -h, -1, max(5, h // 3))


def price_history(df: DataFrame, keys: list[str], day: str, price: str, horizon: int = 28) -> DataFrame:
    """base, the eight price-history features and the raw forward means, in one window pass."""
    f = DayFrames(keys, day)
    p = F.col(price)
    prev_day = F.lag(day_number(day)).over(f.rows)
    prev = F.lag(p).over(f.rows)
    df = df.withColumn("_step", F.when(day_number(day) - prev_day == 1, log_ratio(p, prev)))
    df = df.select(
        "*",
        f.mean(p, 0, 6, 3).alias("base"),
        *[f.mean(p, lo, hi, 3).alias(f"_m{lo}") for lo, hi in ((7, 13), (28, 34), (91, 97), (358, 371))],
        f.mean(p, 358, 364, 3).alias("_ly_base"),
        f.mean(p, 364 - horizon, 363, 10).alias("_ly_next"),
        f.std("_step", 0, 27, 10).alias("vol28"),
        f.count(p, 0, 27).cast("double").alias("n_obs28"),
        forward_mean(f, p, 14).alias("fwd14"),
        forward_mean(f, p, horizon).alias(f"fwd{horizon}"),
    )
    base = F.col("base")
    return df.select(
        *[c for c in df.columns if not c.startswith("_") and c not in ("vol28", "n_obs28")],
        log_ratio(base, "_m7").alias("r7"), log_ratio(base, "_m28").alias("r28"), log_ratio(base, "_m91").alias("r91"),
        log_ratio(base, "_m358").alias("yoy"), "vol28", log_ratio(p, base).alias("dev_last"),
        log_ratio("_ly_next", "_ly_base").alias("ly_change"), "n_obs28",
    )


def with_target(df: DataFrame, forward: str = "fwd28", base: str = "base", name: str = "y", log: bool = False) -> DataFrame:
    y = safe_ln(safe_div(forward, base)) if log else safe_div(forward, base) - 1
    return df.withColumn(name, y)


def prior_years_mean(df: DataFrame, keys: list[str], day: str, col, name: str, min_years: int = 2) -> DataFrame:
    """Mean over earlier years of the key's average in the same ISO week: keys, woy, year, name.

    The year is the calendar year. Earlier means earlier rows of (key, week), whatever the gap between years.
    """
    yw = df.groupBy(*keys, iso_week(day).alias("woy"), F.year(day).alias("year")).agg(F.avg(as_col(col)).alias("_v"))
    w = Window.partitionBy(*keys, "woy").orderBy("year")
    prior = F.avg("_v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    if min_years > 0:
        prior = F.when(F.row_number().over(w) > min_years, prior)
    return yw.select(*keys, "woy", "year", prior.alias(name))


def attach_season(df: DataFrame, keys: list[str], day: str, col, name: str, min_years: int = 2) -> DataFrame:
    """df with the prior-years norm of its own column, matched on key, ISO week and calendar year."""
    norm = prior_years_mean(df, keys, day, col, name, min_years)
    return (
        df.withColumn("woy", iso_week(day)).withColumn("year", F.year(day))
        .join(norm, [*keys, "woy", "year"], "left")
    )


def days_since_change(df: DataFrame, keys: list[str], day: str, price: str, name: str = "days_since_change") -> DataFrame:
    """Days since the price last differed from the previous survey row; NULL before the first change."""
    w = Window.partitionBy(*keys).orderBy(day)
    changed = F.coalesce(F.col(price) != F.lag(price).over(w), F.lit(False))
    df = df.withColumn("_chg", F.when(changed, F.col(day)))
    last = F.last("_chg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.datediff(F.col(day), last)).drop("_chg")


def densify(df: DataFrame, keys: list[str], day: str, zero: list[str], start: str | None = None, end=None) -> DataFrame:
    """One row per calendar day between a key's first and last day (or fixed bounds); `zero` columns become 0 on new days."""
    spans = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    a = F.to_date(F.lit(start)) if start else F.col("_a")
    b = as_col(end) if end is not None else F.col("_b")
    grid = spans.where(a <= b).select(*keys, F.explode(F.sequence(a, b)).alias(day))
    out = grid.join(df, [*keys, day], "left")
    return out.fillna(0, subset=zero) if zero else out


def mean_of_years_ago(f: DayFrames, c, years=(1, 2, 3)) -> Column:
    """Mean of the available values 364, 728, 1092 days ago."""
    from ..functions.scalars import mean_of_available

    return mean_of_available([f.at(c, 364 * k) for k in years])


def volume_vs_normal(daily: DataFrame, keys: list[str], day: str, qty: str, windows=(14, 30)) -> DataFrame:
    """Dense daily volumes -> ln((sum w + 1) / (mean of the same window 1-3 years ago + 1))."""
    f = DayFrames(keys, day)
    out = daily.select("*", *[f.sum(qty, 0, w - 1, w).alias(f"_s{w}") for w in windows])
    norms = out.select("*", *[mean_of_years_ago(f, f"_s{w}").alias(f"_n{w}") for w in windows])
    return norms.select(
        *daily.columns, *[log_ratio(F.col(f"_s{w}") + 1, F.col(f"_n{w}") + 1).alias(f"q{w}_vs_norm") for w in windows]
    )


def volume_changes(daily: DataFrame, keys: list[str], day: str, qty: str) -> DataFrame:
    """7-day sum against the 7 days before and against the same days a year (364 d) earlier; full windows only."""
    f = DayFrames(keys, day)
    s7, p7, y7 = f.sum(qty, 0, 6, 7), f.sum(qty, 7, 13, 7), f.sum(qty, 364, 370, 7)
    return daily.select("*", log_ratio(s7 + 1, p7 + 1).alias("q7_chg"), log_ratio(s7 + 1, y7 + 1).alias("q7_yoy"))


def share_vs_normal(daily: DataFrame, keys: list[str], day: str, part: str, total: str, name: str) -> DataFrame:
    """14-day share of one origin minus the same share 1-3 years ago (dense days)."""
    f = DayFrames(keys, day)
    out = daily.withColumn("_sh", safe_div(f.sum(part, 0, 13, 14), f.sum(total, 0, 13, 14)))
    return out.withColumn(name, F.col("_sh") - mean_of_years_ago(f, "_sh")).drop("_sh")


def carried_change(daily: DataFrame, keys: list[str], day: str, value: str, lags=(7, 28), limit: int = 5) -> DataFrame:
    """ln change over `lags` days of a value carried forward at most `limit` days, on every calendar day."""
    f = DayFrames(keys, day)
    dense = densify(daily, keys, day, [])
    dense = dense.withColumn("_f", f.latest_within(value, 0, limit))
    return dense.select(*keys, day, *[log_ratio("_f", f.at("_f", k)).alias(f"chg{k}") for k in lags])


def wholesale_index(daily: DataFrame, series_keys: list[str], item_keys: list[str], day: str, price: str) -> DataFrame:
    """Mean over an item's series of (log price - series mean); its 7-day mean against 7 and 28 days ago."""
    lp = daily.where(F.col(price) > 0).withColumn("_lp", F.ln(price))
    lp = lp.withColumn("_lp", F.col("_lp") - F.avg("_lp").over(Window.partitionBy(*series_keys)))
    idx = lp.groupBy(*item_keys, day).agg(F.avg("_lp").alias("_i"))
    f = DayFrames(item_keys, day)
    m7 = f.mean("_i", 0, 6, 3)
    dense = densify(idx, item_keys, day, []).withColumn("_m7", m7)
    return dense.select(
        *item_keys, day, (F.col("_m7") - f.at("_m7", 7)).alias("whsl_r7"), (F.col("_m7") - f.at("_m7", 28)).alias("whsl_r28")
    )


def row_momentum(df: DataFrame, keys: list[str], order: str, price: str, back: int = 4, min_obs: int = 3, name: str = "mom4") -> DataFrame:
    """ln(price / mean of the previous `back` rows), needing `min_obs` of them."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order).rowsBetween(-back, -1)
    prev = F.when(F.count(price).over(w) >= min_obs, F.avg(price).over(w))
    return df.withColumn(name, log_ratio(price, prev))


def period_log_change(df: DataFrame, keys: list[str], period: str, value, lag: int, name: str, plus: float = 0.0) -> DataFrame:
    """ln((v + plus) / (v `lag` rows earlier + plus)) along the period sequence of a key."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(period)
    v = as_col(value) + plus
    return df.withColumn(name, log_ratio(v, F.lag(v, lag).over(w)))


def fill_months(df: DataFrame, keys: list[str], month: str) -> DataFrame:
    """One row per month between a key's first and last month; values stay missing on added months."""
    spans = df.groupBy(*keys).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    grid = spans.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias(month))
    return grid.join(df, [*keys, month], "left")


def rolling_rows_sum(keys: list[str], order: str, value, rows: int) -> Column:
    """Sum of the last `rows` rows; NULL unless all are present."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(as_col(value)).over(w) >= rows, F.sum(as_col(value)).over(w))


def leave_one_out_mean(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Mean of the other rows' values in the group; NULL when there are no others.

    Group totals are aggregated map-side and joined back, so a large group never gathers in one window partition.
    """
    tot = df.groupBy(*group).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_s"), F.count(value).alias("_n"))
    out = df.join(tot, group, "left")
    own = F.col(value).isNotNull().cast("int")
    n = F.col("_n") - own
    mean = safe_div(F.col("_s") - F.coalesce(F.col(value), F.lit(0.0)), n)
    return out.withColumn(name, F.when(n > 0, mean)).drop("_s", "_n")


def group_mean(df: DataFrame, group: list[str], value, name: str, count: str | None = None) -> DataFrame:
    """Group mean (and count) attached to the rows, through a map-side aggregate and a join."""
    aggs = [F.avg(as_col(value)).alias(name)] + ([F.count(as_col(value)).alias(count)] if count else [])
    return df.join(df.groupBy(*group).agg(*aggs), group, "left")
