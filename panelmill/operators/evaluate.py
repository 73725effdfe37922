"""Splits, metrics, accuracy tables, agreement tiers, ceilings, blends and importances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalars import BAND, as_col, direction, safe_div

# Training ends four weeks before the test so no training target reaches into it.
TRAIN_FROM, TRAIN_TO, TEST_FROM = "2016-01-01", "2024-12-01", "2025-01-01"


def between_dates(day, first: str, last: str | None = None) -> Column:
    d = as_col(day)
    cond = d >= F.to_date(F.lit(first))
    return cond & (d <= F.to_date(F.lit(last))) if last else cond


def split_label(day, train: tuple[str, str], test_from: str, names=("train", "test")) -> Column:
    """train / test / NULL for the gap in between."""
    return F.when(between_dates(day, *train), names[0]).when(between_dates(day, test_from), names[1])


def walk_forward_folds(day, first_year: int, last_year: int, start: str, train_end: str = "12-01") -> list[tuple[int, Column, Column]]:
    """(year, train rows: start .. previous year's train_end, test rows: the year)."""
    return [
        (y, between_dates(day, start, f"{y - 1}-{train_end}"), between_dates(day, f"{y}-01-01", f"{y}-12-31"))
        for y in range(first_year, last_year + 1)
    ]


def metric_columns(y, p, band: float = BAND) -> list[Column]:
    """n, rmse, mae, r2 and direction accuracy on rows that really moved (a zero prediction counts as wrong)."""
    y, p = as_col(y), as_col(p)
    sse = F.sum((y - p) * (y - p))
    hit = (F.signum(p) == F.signum(y)).cast("double")
    return [
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"), F.avg(F.abs(p - y)).alias("mae"),
        (1 - safe_div(sse, F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.when(F.abs(y) > band, hit)).alias("direction_accuracy"),
    ]


def metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None, band: float = BAND) -> DataFrame:
    """One aggregation pass over rows with target and prediction."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*(by or [])).agg(*metric_columns(y, p, band))


def price_metrics(df: DataFrame, y: str, p: str, base: str, by: list[str] | None = None) -> DataFrame:
    """Errors on the price scale (base * (1 + change)) and MAPE, plus the gain over a zero-change forecast."""
    fut, hat = F.col(base) * (1 + F.col(y)), F.col(base) * (1 + F.col(p))
    sse = F.sum((hat - fut) * (hat - fut))
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*(by or [])).agg(
        F.avg(F.abs(hat - fut)).alias("price_mae"), F.sqrt(F.avg((hat - fut) * (hat - fut))).alias("price_rmse"),
        (1 - safe_div(sse, F.var_pop(fut) * F.count(fut))).alias("price_r2"), (F.avg(F.abs(safe_div(hat - fut, fut))) * 100).alias("mape"),
        ((1 - safe_div(F.avg(F.abs(F.col(p) - F.col(y))), F.avg(F.abs(F.col(y))))) * 100).alias("gain_over_zero_pct"),
    )


def baselines(dev_last: str, ly_change: str) -> dict[str, Column]:
    """Zero change, today's price stays, last year's change repeats."""
    return {
        "zero": F.lit(0.0), "today": F.expm1(F.coalesce(F.col(dev_last), F.lit(0.0))),
        "last_year": F.expm1(F.coalesce(F.col(ly_change), F.lit(0.0))),
    }


def band_table(df: DataFrame, y: str, p: str, bands=(0.01, 0.02, 0.03, 0.05)) -> DataFrame:
    """Three-way agreement and direction accuracy for several dead bands, in one pass."""
    b = F.col("band")
    x = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).alias("y"), F.col(p).alias("p"), F.explode(F.array(*[F.lit(v) for v in bands])).alias("band"))
    t = F.when(F.col("y") > b, 1).when(F.col("y") < -b, -1).otherwise(0)
    q = F.when(F.col("p") > b, 1).when(F.col("p") < -b, -1).otherwise(0)
    return x.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.avg((t == 0).cast("double")).alias("flat_share"), F.avg((t == q).cast("double")).alias("three_way"),
        F.avg(F.when(F.abs("y") > b, (F.signum("p") == F.signum("y")).cast("double"))).alias("direction_accuracy"),
        F.avg((q != 0).cast("double")).alias("shown_share"), F.avg(F.when(q != 0, (q == t).cast("double"))).alias("shown_right"),
    )


def threshold_table(df: DataFrame, y: str, p: str, thresholds=(0.0, 0.02, 0.05, 0.10), real: float = 0.02) -> DataFrame:
    """Share shown and direction accuracy when only forecasts of at least a size are shown."""
    x = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).alias("y"), F.col(p).alias("p"), F.explode(F.array(*[F.lit(v) for v in thresholds])).alias("threshold"))
    show = F.abs("p") >= F.col("threshold")
    right = (F.signum("p") == F.signum("y")).cast("double")
    big = F.abs("y") > real
    return x.groupBy("threshold").agg(
        F.avg(show.cast("double")).alias("shown_share"), F.avg(F.when(show & big, right)).alias("right_on_big"),
        F.avg(F.when(show, right)).alias("right_on_shown"), F.avg(F.when(show, big.cast("double"))).alias("big_share"),
    )


def tier_columns(models: list[str], mean: Column, band: float) -> Column:
    """high: all models name the same move; medium: all say flat; low: they differ."""
    labels = [direction(m, band) for m in models]
    agree = reduce(lambda a, b: a & b, [labels[0] == x for x in labels[1:]])
    return F.when(agree & (direction(mean, band) != 0), "high").when(agree, "medium").otherwise("low")


def tier_table(df: DataFrame, y: str, models: list[str], band: float = 0.02) -> DataFrame:
    mean = reduce(lambda a, b: a + b, [F.col(m) for m in models]) / float(len(models))
    x = df.withColumn("_mean", mean).withColumn("tier", tier_columns(models, F.col("_mean"), band)).withColumn("_t", direction(y, band))
    lab = direction("_mean", band)
    total = x.agg(F.count(F.lit(1)).alias("_all"))
    g = x.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg((lab == F.col("_t")).cast("double")).alias("label_right"),
        F.avg(F.when(F.col("_t") != 0, (F.signum("_mean") == F.signum(y)).cast("double"))).alias("direction_accuracy"),
        F.avg((F.col("_t") != 0).cast("double")).alias("moved_share"), F.avg(F.abs("_mean")).alias("mean_abs_pred"),
        F.avg(F.abs(F.col("_mean") - F.col(y))).alias("mae"),
    )
    return g.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # one row


def majority_agreement(df: DataFrame, y: str, models: list[str], band: float = 0.02) -> DataFrame:
    """Share and accuracy of rows where at least two models carry the label of their mean."""
    mean = reduce(lambda a, b: a + b, [F.col(m) for m in models]) / float(len(models))
    lab = direction(mean, band)
    votes = reduce(lambda a, b: a + b, [(direction(m, band) == lab).cast("int") for m in models])
    agree = votes >= 2
    t = direction(y, band)
    return df.groupBy().agg(
        F.avg(agree.cast("double")).alias("agree_share"), F.avg((agree & (lab != 0)).cast("double")).alias("high_share"),
        F.avg(F.when(agree, (lab == t).cast("double"))).alias("agree_right"), F.avg(F.when(~agree, (lab == t).cast("double"))).alias("differ_right"),
    )


def error_shares(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Share of the total squared error and own R2, per group."""
    se = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(se).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    tot = df.agg(F.sum(se).alias("_all"))
    return g.crossJoin(F.broadcast(tot)).select(  # one row
        *by, "n", (safe_div("_sse", "_all") * 100).alias("sse_pct"), (1 - safe_div("_sse", "_sst")).alias("r2"))


def common_move_ceiling(df: DataFrame, series: list[str], day: str, y: str, min_regions: int = 3) -> DataFrame:
    """R2 of predicting every region by the mean over regions of the same series and day: all rows, and rows with several regions."""
    g = df.groupBy(*series, day).agg(F.avg(y).alias("_c"), F.count(y).alias("_n"))
    x = df.join(g, [*series, day]).where(F.col(y).isNotNull())
    e = (F.col(y) - F.col("_c")) * (F.col(y) - F.col("_c"))
    many = F.col("_n") >= min_regions
    return x.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_n").alias("mean_regions"), (1 - safe_div(F.avg(e), F.var_pop(y))).alias("ceiling_r2"),
        (1 - safe_div(F.avg(F.when(many, e)), F.var_pop(F.when(many, F.col(y))))).alias("ceiling_r2_many"),
    )


def error_correlation(df: DataFrame, y: str, models: list[str]) -> DataFrame:
    """Correlation of the errors of every two models, one pass."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    row = df.agg(*[F.corr(F.col(a) - F.col(y), F.col(b) - F.col(y)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("error_corr")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def stability(df: DataFrame, keys: list[str], day: str, p: str, y: str, band: float = 0.02) -> DataFrame:
    """Consecutive-day pairs of a series: correlation of values a day apart, share of changed labels and of reversed signs."""
    w = Window.partitionBy(*keys).orderBy(day)
    x = df.select(
        F.col(p).alias("p"), F.col(y).alias("y"), F.lag(p).over(w).alias("pp"), F.lag(y).over(w).alias("py"),
        F.datediff(F.col(day), F.lag(day).over(w)).alias("gap"),
    ).where("gap = 1")
    lp, lpp, ly, lpy = [direction(c, band) for c in ("p", "pp", "y", "py")]
    return x.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.corr("p", "pp").alias("pred_corr"), F.corr("y", "py").alias("target_corr"),
        F.avg((lp != lpp).cast("double")).alias("label_flips"), F.avg((ly != lpy).cast("double")).alias("target_flips"),
        F.avg((lp * lpp == -1).cast("double")).alias("reversals"),
    )


def gram_sums(df: DataFrame, y: str, models: list[str]) -> DataFrame:
    """One row of sums p_i p_j and p_i y: all a small least-squares blend needs."""
    k = range(len(models))
    return df.where(F.col(y).isNotNull()).agg(
        *[F.sum(F.col(models[i]) * F.col(models[j])).alias(f"g{i}_{j}") for i in k for j in k if i <= j],
        *[F.sum(F.col(models[i]) * F.col(y)).alias(f"b{i}") for i in k],
    )


def blend_weights(df: DataFrame, y: str, models: list[str]) -> list[float]:
    """Non-negative blend weights; only the k x k sums reach the driver."""
    from ..functions.quantiles import nnls_weights

    r = gram_sums(df, y, models).first()
    k = range(len(models))
    gram = [[float(r[f"g{min(i, j)}_{max(i, j)}"] or 0.0) for j in k] for i in k]
    return nnls_weights(gram, [float(r[f"b{i}"] or 0.0) for i in k])


def permute_column(df: DataFrame, keys: list[str], col: str | list[str], seed: int = 0) -> DataFrame:
    """The column's values shuffled over all rows; several columns move together, so what holds between them stays.

    Rows and values are numbered in two different hash orders and meet on the number. A number is the count of the hash
    cells before (65,536 cells whatever the size) and the place inside the cell, so no task sorts the whole table.
    """

    moved = [col] if isinstance(col, str) else col

    def numbered(s: int, *cols) -> DataFrame:
        rows = df.select(*cols, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.xxhash64(F.lit(seed + s), *keys).alias("_h")).withColumn("_c", F.shiftright("_h", 48))
        cells = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        place = F.row_number().over(Window.partitionBy("_c").orderBy("_h", *[f"_k{i}" for i in range(len(keys))]))
        out = rows.join(cells.select("_c", before.alias("_before")), "_c").withColumn("_i", F.col("_before") + place)
        return out.drop("_c", "_h", "_before", *[f"_k{i}" for i in range(len(keys))])

    a = numbered(1, *[F.col(c) for c in df.columns if c not in moved])
    return a.join(numbered(2, *[F.col(c) for c in moved]), "_i").drop("_i")


def group_shares(importance: DataFrame, group: Column) -> DataFrame:
    """group, n_columns, importance, share: each feature group's percentage of all importance (null where there is none).

    importance: column, importance. A column without a group counts as `other`, one without importance as nothing.
    """
    x = importance.select(F.coalesce(group, F.lit("other")).alias("group"), F.coalesce(F.col("importance"), F.lit(0.0)).alias("_i"))
    g = x.groupBy("group").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("_i").alias("importance"))
    total = g.agg(F.sum("importance").alias("_t"))  # one row
    return g.crossJoin(F.broadcast(total)).select("group", "n_columns", "importance", (safe_div("importance", "_t") * 100).alias("share"))


def seed_agreement(df: DataFrame, seeds: dict[str, str], band: float = 0.02) -> DataFrame:
    """Share of rows with the same label for every two seeds' forecasts."""
    names = list(seeds)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    row = df.agg(*[F.avg((direction(seeds[a], band) == direction(seeds[b], band)).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("same_label")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def smoothed(keys: list[str], day: str, p: str, rows: int) -> Column:
    """Mean of the last `rows` forecasts of a series."""
    return F.avg(p).over(Window.partitionBy(*keys).orderBy(day).rowsBetween(-(rows - 1), 0))


def clipped_quantile_band(df: DataFrame, y: str, low: float, high: float) -> DataFrame:
    return exact_quantiles(df, [], y, {"low": low, "high": high})
