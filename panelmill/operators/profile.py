"""Table, column and series profiles; correlation, redundancy and drift reports."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import average_ranks, bias_adjusted_skew, exact_median, exact_quantiles
from ..functions.scalars import as_col, log_ratio, safe_div, safe_ln
from ..session import cut_lineage
from .windows import DayFrames


def describe_table(df: DataFrame, time_col: str | None, label_cols: list[str]) -> DataFrame:
    """One row: rows, columns, first and last time, and the label with most distinct values."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if time_col:
        aggs += [F.min(time_col).alias("first"), F.max(time_col).alias("last")]
    aggs += [F.countDistinct(c).alias(f"_d{i}") for i, c in enumerate(label_cols)]
    out = df.agg(*aggs).withColumn("n_cols", F.lit(len(df.columns)))
    if label_cols:
        best = F.array_max(F.array(*[F.struct(F.col(f"_d{i}").alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(label_cols)]))
        out = out.withColumn("label", best["c"]).withColumn("n_labels", best["n"]).drop(*[f"_d{i}" for i in range(len(label_cols))])
    return out


def spans(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n"))


def describe_columns(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """n, missing %, mean, std (n-1), min, quartiles, max and adjusted skew, one row per group and column."""
    df = cut_lineage(df.select(*by, *cols))
    long = df.unpivot(by, [F.col(c).cast("double").alias(c) for c in cols], "variable", "v")
    keys = [*by, "variable"]
    basic = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col("v").isNull().cast("double")) * 100).alias("missing_pct"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        bias_adjusted_skew("v").alias("skew"),
    )
    q = exact_quantiles(long, keys, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return basic.join(q, keys, "left")


def missing_rates(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Percent missing per column, one pass; rows of (by, column, missing_pct)."""
    by = by or []
    one = df.groupBy(*by).agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    return one.unpivot(by, cols, "column", "missing_pct")


def missing_drift(before: DataFrame, after: DataFrame, cols: list[str], points: float = 10.0) -> DataFrame:
    """Columns whose missing rate rose by more than `points` percent points."""
    b = missing_rates(before, cols).withColumnRenamed("missing_pct", "before_pct")
    a = missing_rates(after, cols).withColumnRenamed("missing_pct", "after_pct")
    return b.join(a, "column").withColumn("rise", F.col("after_pct") - F.col("before_pct")).where(F.col("rise") > points)


def panel_structure(df: DataFrame, keys: list[str], day: str, price: str, early: str) -> DataFrame:
    """One row: rows, series, duplicate key-days, missing prices, median survey days and density, share starting early."""
    per_day = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(price).isNull().cast("long")).alias("_miss"))
    per = per_day.groupBy(*keys).agg(
        F.sum("_n").alias("_rows"), F.sum(F.col("_n") - 1).alias("_dup"), F.sum("_miss").alias("_missing"),
        F.min(day).alias("_a"), F.max(day).alias("_b"),
    )
    per = cut_lineage(per.withColumn("_density", F.col("_rows") / (F.datediff("_b", "_a") + 1)))  # one row per series
    tot = per.agg(
        F.sum("_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_series"), F.sum("_dup").alias("n_duplicates"),
        F.sum("_missing").alias("n_missing"), F.min("_a").alias("first"), F.max("_b").alias("last"),
        (F.avg((F.col("_a") < F.to_date(F.lit(early))).cast("double")) * 100).alias("early_pct"),
    )
    med = exact_median(per, [], "_rows", "median_days").crossJoin(exact_median(per, [], "_density", "median_density"))
    return tot.crossJoin(med)  # single rows on both sides


def price_levels(df: DataFrame, keys: list[str], by: list[str], price: str) -> DataFrame:
    """Distribution of the series' mean prices and the median coefficient of variation, per group."""
    s = df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.avg(price).alias("_m"), safe_div(F.stddev_samp(price), F.avg(price)).alias("_cv"))
    s = cut_lineage(s)  # one row per series
    n = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n_series"))
    q = exact_quantiles(s, by, "_m", {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0})
    cv = exact_median(s, by, "_cv", "median_cv")
    return n.join(q, by).join(cv, by, "left").withColumn("spread", safe_div("max", "min"))


def target_distribution(df: DataFrame, by: list[str], y: str) -> DataFrame:
    df = cut_lineage(df.select(*by, y))
    q = exact_quantiles(df, by, y, {"q05": 0.05, "median": 0.5, "q95": 0.95})
    a = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
        (F.avg(F.coalesce((F.abs(F.col(y)) > 0.1).cast("double"), F.lit(0.0))) * 100).alias("big_pct"),
    )
    return a.join(q, by, "left")


def seasonal_index(df: DataFrame, keys: list[str], day: str, price: str, min_months: int = 10, min_years: int = 3) -> DataFrame:
    """Per series: amplitude of the mean monthly index and mean correlation between years' profiles."""
    m = df.groupBy(*keys, F.year(day).alias("_y"), F.month(day).alias("_mo")).agg(F.avg(price).alias("_p"))
    m = cut_lineage(m)  # one row per series and month
    yr = m.groupBy(*keys, "_y").agg(F.avg("_p").alias("_py"), F.count("_p").alias("_k")).where(F.col("_k") >= min_months)
    years = yr.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_years")).where(F.col("n_years") >= min_years)
    idx = m.join(yr, [*keys, "_y"]).join(years, keys).withColumn("_i", safe_div("_p", "_py"))
    prof = idx.groupBy(*keys, "n_years", "_mo").agg(F.avg("_i").alias("_i"))
    amp = prof.groupBy(*keys, "n_years").agg((F.max("_i") - F.min("_i")).alias("amplitude"))
    # Years of one series meet month by month: at most 12 rows per year and series.
    a = idx.select(*keys, "_mo", F.col("_y").alias("_ya"), F.col("_i").alias("_ia"))
    b = idx.select(*keys, "_mo", F.col("_y").alias("_yb"), F.col("_i").alias("_ib"))
    c = a.join(b, [*keys, "_mo"]).where("_ya < _yb").groupBy(*keys, "_ya", "_yb").agg(F.corr("_ia", "_ib").alias("_c"))
    c = c.groupBy(*keys).agg(F.avg("_c").alias("year_corr"))
    return amp.join(c, keys, "left")


def weekday_effect(df: DataFrame, keys: list[str], day: str, price: str) -> DataFrame:
    """Mean percent gap of log price to the centred 7-row mean, by weekday (Monday = 0)."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-3, 3)
    lp = safe_ln(price)
    gap = F.when(F.count(lp).over(w) >= 3, lp - F.avg(lp).over(w))
    return df.select(F.weekday(day).alias("dow"), gap.alias("_g")).groupBy("dow").agg((F.avg("_g") * 100).alias("gap_pct"))


def autocorrelation(df: DataFrame, keys: list[str], day: str, price: str, lags=(1, 7, 28, 91), min_obs: int = 400) -> DataFrame:
    """Per series: correlation of log price with itself `lag` calendar days earlier."""
    f = DayFrames(keys, day)
    x = df.withColumn("_l", safe_ln(price))
    x = x.select(*keys, "_l", *[f.at("_l", k).alias(f"_l{k}") for k in lags])
    return (
        x.groupBy(*keys).agg(F.count("_l").alias("n_obs"), *[F.corr("_l", f"_l{k}").alias(f"lag{k}") for k in lags])
        .where(F.col("n_obs") >= min_obs)
    )


def change_autocorrelation(df: DataFrame, keys: list[str], day: str, price: str, back=(28, 364), min_obs: int = 400) -> DataFrame:
    """Per series: the 4-week change of the 7-day log mean against the same change 28 and 364 days earlier, on the full day grid."""
    from .windows import densify

    f = DayFrames(keys, day)
    x = densify(df.select(*keys, day, safe_ln(price).alias("_l")), keys, day, [])
    x = x.withColumn("_m", f.mean("_l", 0, 6, 3))
    x = x.withColumn("_c", f.at("_m", -28) - F.col("_m"))
    x = x.select(*keys, "_l", "_c", *[f.at("_c", k).alias(f"_c{k}") for k in back])
    return (
        x.groupBy(*keys).agg(F.count("_l").alias("n_obs"), *[F.corr("_c", f"_c{k}").alias(f"change{k}") for k in back])
        .where(F.col("n_obs") >= min_obs)
    )


def jump_counts(df: DataFrame, keys: list[str], by: list[str], day: str, price: str) -> DataFrame:
    """Changes between surveys, jumps beyond x1.5, and jumps back within x1.1 on the next survey."""
    w = Window.partitionBy(*keys).orderBy(day)
    x = df.select(
        *by, log_ratio(price, F.lag(price).over(w)).alias("_d"), F.lead(price).over(w).isNotNull().alias("_has"),
        log_ratio(F.lead(price).over(w), F.lag(price).over(w)).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
    ).where(F.col("_n") >= 3)
    jump = F.col("_has") & (F.abs("_d") > math.log(1.5))
    back = jump & (F.abs("_r") < math.log(1.1))
    return x.groupBy(*by).agg(
        F.count("_d").alias("n_changes"), F.coalesce(F.sum(jump.cast("long")), F.lit(0)).alias("n_jumps"),
        F.coalesce(F.sum(back.cast("long")), F.lit(0)).alias("n_reversed"),
    )


def extreme_days(df: DataFrame, station: str, day: str, rules: dict[str, Column]) -> DataFrame:
    """Per year: station-days meeting each rule, averaged over stations."""
    s = df.groupBy(F.year(day).alias("year"), station).agg(*[F.sum(F.coalesce(r.cast("int"), F.lit(0))).alias(n) for n, r in rules.items()])
    return s.groupBy("year").agg(*[F.avg(n).alias(n) for n in rules])


def rebase(df: DataFrame, keys: list[str], order: str, value: str, name: str = "index100") -> DataFrame:
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, safe_div(F.col(value) * 100, F.first(value, ignorenulls=True).over(w)))


def change_volatility(df: DataFrame, keys: list[str], order: str, value: str, lag: int = 12, top: int = 15) -> DataFrame:
    """Std of the `lag`-row percent change per key, the most volatile first."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.select(*keys, ((safe_div(value, F.lag(value, lag).over(w)) - 1) * 100).alias("_c"))
    return x.groupBy(*keys).agg(F.stddev_samp("_c").alias("volatility")).orderBy(F.desc("volatility"), *keys).limit(top)


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Spearman correlation of the requested column pairs, on rows where both are present.

    Every pair is its own unpivoted block; ranks come from value counts with ties averaged, then one corr per pair.
    """
    blocks = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]))
    xy = df.select(blocks.alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    xy = cut_lineage(xy.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    rx = average_ranks(xy, ["a", "b"], "x", "rx", weight="n").drop("_n")
    ry = average_ranks(xy, ["a", "b"], "y", "ry", weight="n").drop("_n")
    r = xy.join(rx, ["a", "b", "x"]).join(ry, ["a", "b", "y"])
    # weighted Pearson on the ranks
    n = F.sum("n").cast("double")
    sx, sy = F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    g = r.groupBy("a", "b").agg(
        n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("sxy"),
        F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("syy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return g.select("a", "b", F.col("n").cast("long").alias("n"), safe_div(cov, F.sqrt(vx * vy)).alias("rho"))


def time_trends(df: DataFrame, day: str, cols: list[str], threshold: float = 0.8) -> DataFrame:
    """column, days, rho, trending: rank correlation of each column's daily mean with the day.

    A column that follows the calendar this closely may only stand for time. One map-side aggregate leaves a row a day, so
    ranking costs what the calendar costs; means are rounded to 9 digits, so that ranks don't depend on the order of sums.
    Days without a value don't count for a column; one without any, or with a single value, has no rho and isn't trending.
    """
    daily = df.where(F.col(day).isNotNull()).groupBy(F.unix_date(day).alias("_day")).agg(*[F.round(F.avg(c), 9).alias(c) for c in cols])
    rho = spearman_pairs(daily, [(c, "_day") for c in cols]).select(F.col("a").alias("column"), F.col("n").alias("days"), "rho")
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    out = names.join(rho, "column", "left")
    return out.select("column", F.coalesce("days", F.lit(0)).cast("long").alias("days"), "rho", F.coalesce(F.abs("rho") >= threshold, F.lit(False)).alias("trending"))


def pairs_above(rho: DataFrame, threshold: float = 0.8) -> DataFrame:
    return rho.where(F.abs("rho") >= threshold)


def most_similar(rho: DataFrame) -> DataFrame:
    """Per column: the partner with the largest absolute correlation."""
    rho = cut_lineage(rho)  # one row per column pair
    both = rho.select("a", "b", "rho").unionByName(rho.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    best = F.max_by(F.struct("b", "rho"), F.struct(F.abs("rho").alias("r"), F.col("b").alias("b")))
    return both.where("rho IS NOT NULL").groupBy("a").agg(best.alias("_m")).select(F.col("a").alias("column"), F.col("_m.b").alias("mate"), F.col("_m.rho").alias("rho"))


def variance_inflation(df: DataFrame, cols: list[str]) -> DataFrame:
    """VIF = diagonal of the inverse correlation matrix; missing values take the median. k x k numbers reach the driver."""
    df = cut_lineage(df.select(*cols))
    med = exact_medians_row(df, cols)
    x = df.select(*cols).crossJoin(F.broadcast(med)).select(*[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) for c in cols])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = x.agg(*[F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    use = [i for i in range(len(cols)) if (row[f"s{i}"] or 0) > 0]
    m = np.eye(len(use))
    for p, i in enumerate(use):
        for q in range(p + 1, len(use)):
            m[p, q] = m[q, p] = row[f"c{i}_{use[q]}"]
    d = np.diag(np.linalg.inv(m))
    return df.sparkSession.createDataFrame([(cols[i], float(v)) for i, v in zip(use, d)], "column string, vif double")


def exact_medians_row(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the median of every column."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")
    ).select("s.*")
    med = exact_median(long, ["c"], "v", "m")
    return med.groupBy().agg(*[F.max(F.when(F.col("c") == c, F.col("m"))).alias(f"_m_{c}") for c in cols])


def keep_most_important(rho: DataFrame, importance: DataFrame, threshold: float) -> DataFrame:
    """Per column: kept unless a correlated column (or one sharing its concept) is more important.

    importance: column, importance. One greedy pass: a column falls to any more important neighbour.
    """
    rho, importance = cut_lineage(rho), cut_lineage(importance)  # one row per pair, one per column
    both = rho.where(F.abs("rho") >= threshold).select("a", "b").unionByName(
        rho.where(F.abs("rho") >= threshold).select(F.col("b").alias("a"), F.col("a").alias("b")))
    ia = importance.select(F.col("column").alias("a"), F.col("importance").alias("_ia"))
    ib = importance.select(F.col("column").alias("b"), F.col("importance").alias("_ib"))
    beaten = both.join(ia, "a").join(ib, "b").where((F.col("_ib") > F.col("_ia")) | ((F.col("_ib") == F.col("_ia")) & (F.col("b") < F.col("a"))))
    lost = beaten.groupBy("a").agg(F.max_by("b", F.struct("_ib", "b")).alias("covered_by"))
    return importance.join(lost.withColumnRenamed("a", "column"), "column", "left").withColumn("keep", F.col("covered_by").isNull())


def keep_one_per_concept(importance: DataFrame, concept: Column) -> DataFrame:
    """Most important column of each concept (ties: lowest name)."""
    c = importance.withColumn("concept", concept)
    best = c.groupBy("concept").agg(F.min_by("column", F.struct((-F.col("importance")).alias("i"), F.col("column").alias("c"))).alias("kept"))
    return c.join(best, "concept").withColumn("keep", F.col("column") == F.col("kept"))


def shared_sources(df: DataFrame, source: str, user: str) -> DataFrame:
    """Sources used by more than one item, with the items in order."""
    u = df.select(source, user).distinct()
    return (
        u.groupBy(source).agg(F.array_join(F.array_sort(F.collect_list(user)), ";").alias("users"), F.count(F.lit(1)).alias("n_users"))
        .where("n_users > 1")
    )


def yearly_change(df: DataFrame, keys: list[str], day: str, price: str) -> DataFrame:
    """Median and mean over series of the log change of yearly mean prices."""
    a = df.groupBy(*keys, F.year(day).alias("year")).agg(F.avg(price).alias("_p"))
    w = Window.partitionBy(*keys).orderBy("year")
    a = cut_lineage(a.withColumn("_c", log_ratio("_p", F.lag("_p").over(w))).where("_c IS NOT NULL"))
    m = exact_median(a, ["year"], "_c", "_med")
    g = a.groupBy("year").agg(F.avg("_c").alias("_avg"), F.count("_c").alias("n_series"))
    return g.join(m, "year").select("year", F.expm1("_med").alias("median_change"), F.expm1("_avg").alias("mean_change"), "n_series")


def shares(df: DataFrame, col: str, missing: str) -> DataFrame:
    """Counts and percent of each value, missing named."""
    c = df.groupBy(F.coalesce(F.col(col), F.lit(missing)).alias(col)).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("_t"))
    return c.crossJoin(F.broadcast(total)).select(col, "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct"))  # one row
