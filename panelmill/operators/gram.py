"""Ridge regressions of many groups, folds or years at once, from sums that add up.

One aggregation collects, for every key, the sums that centred normal equations need. Sums of parts add up to those of
their union, so a model per group, per growing training period or per left-out part costs one pass over the rows,
whatever the number of models. A missing value counts as the mean of the model's own training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .evaluate import between_dates


def _value(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def moments(df: DataFrame, by: list[str], cols: list[str], y: str) -> DataFrame:
    """Per key: count, sums and sums of products of the columns and the target, on rows with a target."""
    x = df.select(*by, _value(y).alias("_y"), *[_value(c).alias(f"_x{i}") for i, c in enumerate(cols)]).where("_y IS NOT NULL")
    at = lambda i: F.col(f"_x{i}")
    sums = {"_n": F.count(F.lit(1)), "_sy": F.sum("_y")}
    for i in range(len(cols)):
        seen = at(i).isNotNull()
        sums |= {f"_c{i}": F.count(at(i)), f"_s{i}": F.sum(at(i)), f"_t{i}": F.sum(at(i) * F.col("_y")), f"_u{i}": F.sum(F.when(seen, F.col("_y"))), f"_g{i}_{i}": F.sum(at(i) * at(i))}
        for j in range(i):
            both = seen & at(j).isNotNull()
            sums |= {f"_g{i}_{j}": F.sum(at(i) * at(j)), f"_k{i}_{j}": F.count(F.when(both, 1)), f"_h{i}_{j}": F.sum(F.when(both, at(i))), f"_h{j}_{i}": F.sum(F.when(both, at(j)))}
    return x.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])


def add_up(m: DataFrame, by: list[str]) -> DataFrame:
    """Moments of unions: rows of equal keys added."""
    return m.groupBy(*by).agg(*[F.sum(c).alias(c) for c in m.columns if c.startswith("_")])


def _coefficients(by: list[str], p: int, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            get = lambda c: np.nan_to_num(b.column(c).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False))  # noqa: B023, E731
            n, k = get("_n"), b.num_rows
            mean = np.stack([get(f"_s{i}") / np.maximum(get(f"_c{i}"), 1) for i in range(p)], 1)
            gram, right = np.zeros((k, p, p)), np.zeros((k, p))
            for i in range(p):
                right[:, i] = get(f"_t{i}") - mean[:, i] * get(f"_u{i}")
                gram[:, i, i] = get(f"_g{i}_{i}") - mean[:, i] * get(f"_s{i}")
                for j in range(i):
                    g = get(f"_g{i}_{j}") - mean[:, j] * get(f"_h{i}_{j}") - mean[:, i] * get(f"_h{j}_{i}") + mean[:, i] * mean[:, j] * get(f"_k{i}_{j}")
                    gram[:, i, j] = gram[:, j, i] = g
            # On standardised columns the penalty is the same for all; a constant column gets no say.
            size = np.sqrt(np.maximum(np.einsum("kii->ki", gram), 0))
            dead = size <= 1e-9 * np.sqrt(np.stack([np.maximum(get(f"_g{i}_{i}"), 0) for i in range(p)], 1))
            size[dead] = 1.0
            gram = gram / size[:, :, None] / size[:, None, :]
            gram[dead[:, :, None] | dead[:, None, :]] = 0.0
            gram[:, range(p), range(p)] = 1.0 + penalty
            right = np.where(dead, 0.0, right / size)
            beta = np.einsum("kij,kj->ki", np.linalg.pinv(gram, hermitian=True), right) / size
            rows = pa.array(list(beta), pa.list_(pa.float64())), pa.array(list(mean), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in by], pa.array(n.astype(np.int64)), pa.array(get("_sy") / n), rows[1], rows[0]], [*by, "n_train", "mean_y", "means", "coefficients"])

    return run


def solve(m: DataFrame, by: list[str], p: int, penalty: float = 0.0) -> DataFrame:
    """Per key: n_train, mean_y, means, coefficients; one small matrix a row. The penalty is on standardised columns."""
    fields = [m.schema[c] for c in by] + [StructField("n_train", LongType()), StructField("mean_y", DoubleType()), StructField("means", ArrayType(DoubleType())), StructField("coefficients", ArrayType(DoubleType()))]
    return m.mapInArrow(_coefficients(by, p, penalty), StructType(fields))


def predict(df: DataFrame, models: DataFrame, by: list[str], cols: list[str], pred: str = "pred", fallback: Column | None = None, min_rows: int = 1) -> DataFrame:
    """The rows with their key's forecast; the fallback (or null) where no model of min_rows training rows exists."""
    m = models.where(F.col("n_train") >= min_rows).select(*[F.col(c).alias(f"_{c}_m") for c in by], "mean_y", "means", "coefficients")
    on = [df[c].eqNullSafe(m[f"_{c}_m"]) for c in by]
    value = F.col("mean_y")
    for i, c in enumerate(cols):
        value = value + F.col("coefficients")[i] * F.coalesce(_value(c) - F.col("means")[i], F.lit(0.0))
    value = F.when(F.col("mean_y").isNotNull(), value).otherwise(fallback if fallback is not None else F.lit(None))
    return df.join(m, on, "left").withColumn(pred, value).drop(*[f"_{c}_m" for c in by], "mean_y", "means", "coefficients")


def ridge_by_group(df: DataFrame, by: list[str], cols: list[str], y: str, train: Column, test: Column, penalty: float = 0.0, fallback: Column | None = None, min_rows: int = 1, pred: str = "pred") -> DataFrame:
    """Each group's test rows with the forecast of its own model, for any number of groups. A null key is a group."""
    models = solve(moments(df.where(train), by, cols, y), by, len(cols), penalty)
    return predict(df.where(test), models, by, cols, pred, fallback, min_rows)


def walk_forward_models(df: DataFrame, day: str, cols: list[str], y: str, first: int, last: int, start: str, train_end: str = "12-01", penalty: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """A model for each year of first .. last, fitted on the rows from start to the previous year's train_end.

    A row belongs to the first fold that trains on it and to all later ones; sums per first fold are added up.
    """
    by = by or []
    year = F.year(day)
    in_time = F.date_format(day, "MM-dd") <= train_end
    x = df.where(between_dates(day, start)).withColumn("_from", F.greatest(year + F.when(in_time, 1).otherwise(2), F.lit(first))).where(F.col("_from") <= last)
    m = moments(x.withColumnRenamed("_from", "from_fold"), [*by, "from_fold"], cols, y)
    m = m.withColumn("fold", F.explode(F.sequence(F.col("from_fold"), F.lit(last)))).drop("from_fold")
    return solve(add_up(m, [*by, "fold"]), [*by, "fold"], len(cols), penalty)


def walk_forward(df: DataFrame, day: str, cols: list[str], y: str, first: int, last: int, start: str, train_end: str = "12-01", penalty: float = 0.0, by: list[str] | None = None, pred: str = "pred") -> tuple[DataFrame, DataFrame]:
    """Forecasts of each year's rows by the model of its fold, and the models."""
    models = walk_forward_models(df, day, cols, y, first, last, start, train_end, penalty, by)
    rows = df.where(F.year(day).between(first, last)).withColumn("fold", F.year(day))
    return predict(rows, models, [*(by or []), "fold"], cols, pred), models


def leave_part_out(df: DataFrame, part: str, cols: list[str], y: str, penalty: float = 0.0, by: list[str] | None = None, pred: str = "pred_oof") -> DataFrame:
    """Every row with the forecast of a model fitted on all other parts (years, folds) of its group: all minus own sums."""
    by = by or []
    m = moments(df, [*by, part], cols, y)
    sums = [c for c in m.columns if c.startswith("_")]
    total = add_up(m, by).select(*[F.col(c).alias(f"_{c}_all") for c in by], *[F.coalesce(F.col(c), F.lit(0)).alias(f"all{c}") for c in sums])
    parts = df.select(*by, part).distinct()  # a part may have no target of its own
    own = parts.join(m.select(*[F.col(c).alias(f"_{c}_own") for c in [*by, part]], *sums), [parts[c].eqNullSafe(F.col(f"_{c}_own")) for c in [*by, part]], "left")
    rest = own.join(total, [own[c].eqNullSafe(F.col(f"_{c}_all")) for c in by]) if by else own.crossJoin(F.broadcast(total))  # one row
    rest = rest.select(*by, part, *[(F.col(f"all{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums]).where("_n > 0")
    return predict(df, solve(rest, [*by, part], len(cols), penalty), [*by, part], cols, pred)
