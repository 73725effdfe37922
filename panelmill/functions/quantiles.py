"""Exact order statistics that stay distributed when a group is very large.

The input is read once: its keys and values are stored, and what follows reads that narrow table. A percentile buffer
holds every distinct value of a group in one task; that is the way of groups up to a stated number of rows. Where most
rows are in groups of one or two, these take their least and largest value instead. Groups above the stated number
go through counts of equal values: a histogram over ordered cells finds the cell of each wanted rank, an even split of
that cell finds the part, and only the values of that part, of bounded number, are ordered. Both ways give the same
numbers; nothing is approximated and no row is dropped.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scalars import as_col, key_hash

CELLS_PER_E_FOLD = 1024
#: Rows of a key up to which its values fit one percentile buffer.
BUFFER_ROWS = 1_000_000
#: Even parts of a cell. A cell is 0.1 % wide, where doubles stand evenly, some 2^42 at most: a part has 2^21 values at most.
PARTS = 1 << 21
_SMALLEST = 746  # above -ln of the smallest double


def value_cell(c) -> Column:
    """Order-preserving cell number of a double: about 0.1 % wide at every size, symmetric around zero, which is alone."""
    d = as_col(c).cast("double")
    size = F.floor((F.ln(F.abs(d)) + _SMALLEST) * CELLS_PER_E_FOLD) + 1
    last = F.lit(4 * _SMALLEST * CELLS_PER_E_FOLD)
    return F.when(F.isnan(d), 2 * last).when(F.abs(d) == float("inf"), F.signum(d) * last).when(d == 0, 0).otherwise(F.signum(d) * size).cast("long")


def _clean(df: DataFrame, keys, value) -> DataFrame:
    out = df.select(*[F.col(k) for k in keys], as_col(value).cast("double").alias("_v"))
    cond = F.col("_v").isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return out.where(cond)


def _wanted(rows: DataFrame, keys: list[str], path: list[str], cell: str, probs: dict[str, float]) -> DataFrame:
    """The rows of cells that hold a wanted rank, with _before (values in front of the cell), _total, _low and _high.

    rows: keys, path (cells of earlier rounds), the cell, _v, _n, and from an earlier round _before and _total.
    """
    again = "_total" in rows.columns
    part = [*keys, *path] or [F.lit(1)]
    known = [F.max(c).alias(c) for c in ("_total", "_before")] if again else []
    hist = rows.groupBy(*keys, *path, cell).agg(F.sum("_n").alias("_cn"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), *known)
    upto = F.sum("_cn").over(Window.partitionBy(*part).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
    if not again:
        hist = hist.withColumn("_total", F.sum("_cn").over(Window.partitionBy(*part))).withColumn("_before", F.lit(0))
    hist = hist.withColumn("_before", F.col("_before") + upto - F.col("_cn"))
    hit = F.lit(False)
    for p in probs.values():
        pos = F.lit(p) * (F.col("_total") - 1)
        for r in (F.floor(pos), F.ceil(pos)):
            hit = hit | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_cn")))
    return rows.drop("_before", "_total", "_low", "_high").join(hist.where(hit).drop("_cn"), [*keys, *path, cell])


def _interpolated(low: Column, high: Column, share: Column) -> Column:
    return F.when(low == high, low).otherwise(low + (high - low) * share)


def _through_cells(runs: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of counted values (keys, _v, _n) without a task that holds a key's values."""
    rows = _wanted(runs.withColumn("_cell", value_cell("_v")), keys, [], "_cell", probs)
    width = F.col("_high") - F.col("_low")
    rows = rows.withColumn("_part", F.when(width > 0, F.floor((F.col("_v") - F.col("_low")) / width * PARTS)).otherwise(F.lit(0)).cast("long"))
    rows = _wanted(rows, keys, ["_cell"], "_part", probs)
    inside = Window.partitionBy(*keys, "_cell", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("_hi", F.col("_before") + F.sum("_n").over(inside)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        for tag, r in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            aggs.append(F.max(F.when((r >= F.col("_lo")) & (r < F.col("_hi")), F.col("_v"))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
    out = runs.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[_interpolated(*(F.col(f"_{t}_{n}") for t in "lhf")).alias(n) for n in probs])


def _of_two(p: float) -> Column:
    """A percentile of one value, of equal values or of two, from the least and the largest: the terms of F.percentile."""
    low, high = F.col("_low"), F.col("_high")
    return low if p == 0 else high if p == 1 else F.when(low == high, low).otherwise(low * (1.0 - p) + high * p)


def exact_quantiles(df: DataFrame, keys: list[str], value, probs: dict[str, float], hot_rows: int = BUFFER_ROWS) -> DataFrame:
    """Interpolated quantiles per key. probs maps output column -> probability. Rows with a missing key or value are left out.

    One pass of plain sums finds the rows of each key with its least and largest value. That is all a key of up to two rows
    needs; where most rows are of such keys, only the others' rows travel to the buffers.
    """
    v = cut_lineage(_clean(df, keys, value))
    counted = lambda x: x.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if not keys:
        return _through_cells(counted(v), keys, probs)
    names = list(probs)
    found = cut_lineage(v.groupBy(key_hash(*keys).alias("_k"), *keys).agg(F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    short, hot = F.col("_rows") <= 2, F.col("_rows") > hot_rows
    rows = lambda which: F.coalesce(F.sum(F.when(which, F.col("_rows"))), F.lit(0))
    n, n_short, n_hot = found.agg(rows(F.lit(True)), rows(short), rows(hot)).first()
    apart = hot_rows >= 2 and 2 * n_short > n
    q = F.percentile("_v", F.array(*[F.lit(probs[c]) for c in names]))
    of = lambda which: v.withColumn("_k", key_hash(*keys)).join(found.where(which).select("_k", *keys), ["_k", *keys], "left_semi").drop("_k")
    parts = []
    if not apart or n_short + n_hot < n:
        usual = v if not apart and not n_hot else of(~short & ~hot if apart else ~hot)
        parts.append(usual.groupBy(key_hash(*keys), *keys).agg(q.alias("_q")).select(*keys, *[F.col("_q")[i].alias(c) for i, c in enumerate(names)]))
    if apart:
        parts.append(found.where(short).select(*keys, *[_of_two(probs[c]).alias(c) for c in names]))
    if n_hot:  # without such keys this way would only be empty stages
        parts.append(_through_cells(counted(of(hot)), keys, probs))
    return reduce(lambda a, b: a.unionByName(b), parts)


def exact_median(df: DataFrame, keys: list[str], value, name: str, hot_rows: int = BUFFER_ROWS) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, hot_rows)


def average_ranks(df: DataFrame, by: list[str], value: str, name: str = "rank", weight: str | None = None) -> DataFrame:
    """Average rank (1-based, ties share) of every distinct value per key: by, value, _n, rank.

    Ranks come from value counts: offsets per ordered cell plus a running count inside the cell, so a key with
    most of the rows is still spread over its cells.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n"))
        .withColumn("_cell", value_cell(value))
    )
    part = by if by else [F.lit(1)]
    offsets = (
        counts.groupBy(*by, "_cell").agg(F.sum("_n").alias("_cn"))
        .withColumn("_before", F.sum("_cn").over(Window.partitionBy(*part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cn"))
        .drop("_cn")
    )
    in_cell = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(offsets, [*by, "_cell"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(in_cell))
        .withColumn(name, F.col("_upto") - (F.col("_n") - 1) / 2.0)
        .select(*by, value, "_n", name)
    )


def ordered_chunks(df: DataFrame, value: str, hit: str, per: int) -> DataFrame:
    """Rows in order of (value, hit), cut into consecutive chunks of `per` rows, the remainder joined to the last.

    Works on run lengths of equal (value, hit): each run covers a range of ranks and is cut at chunk borders, so
    neither ties nor a single frequent value gather in one task. Returns chunk, n, hit_sum, and value runs' median.
    """
    runs = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v"), F.col(hit).cast("double").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    runs = runs.withColumn("_cell", value_cell("_v"))
    cells = (
        runs.groupBy("_cell").agg(F.sum("_n").alias("_cn"))
        .withColumn("_before", F.sum("_cn").over(Window.partitionBy(F.lit(1)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cn"))
        .withColumn("_total", F.sum("_cn").over(Window.partitionBy(F.lit(1))))
        .drop("_cn")
    )
    w = Window.partitionBy("_cell").orderBy("_v", "_h").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        runs.join(cells, "_cell")
        .withColumn("_end", F.col("_before") + F.sum("_n").over(w))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_last", F.greatest(F.floor(F.col("_total") / per) - 1, F.lit(0)))
    )
    # A very long run spans many chunks: first cut in blocks of 1,000 chunks, then in chunks.
    block = per * 1000
    runs = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))))
    runs = runs.withColumn("_bs", F.greatest("_start", F.col("_b") * block)).withColumn("_be", F.least("_end", (F.col("_b") + 1) * block))
    runs = runs.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_bs") / per), F.floor((F.col("_be") - 1) / per))))
    runs = runs.withColumn("_m", F.least("_be", (F.col("_c") + 1) * per) - F.greatest("_bs", F.col("_c") * per))
    runs = runs.withColumn("chunk", F.least("_c", "_last"))
    # One chunk holds fewer than 2 * per rows, so its percentile map is bounded by that.
    return runs.groupBy("chunk").agg(
        F.sum("_m").alias("n"),
        (F.sum(F.col("_h") * F.col("_m")) / F.sum("_m")).alias("hit_rate"),
        F.percentile("_v", F.lit(0.5), F.col("_m").cast("long")).alias("median_value"),
    )


def bias_adjusted_skew(c) -> Column:
    """Sample skewness with the small-sample correction; needs three values."""
    n = F.count(as_col(c)).cast("double")
    return F.when(n > 2, F.skewness(as_col(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def nnls_weights(gram: list[list[float]], rhs: list[float], sweeps: int = 500) -> list[float]:
    """Non-negative least squares on an already aggregated Gram matrix (a handful of unknowns)."""
    k = len(rhs)
    w = [0.0] * k
    for _ in range(sweeps):
        moved = 0.0
        for i in range(k):
            if gram[i][i] <= 0:
                continue
            r = rhs[i] - math.fsum(gram[i][j] * w[j] for j in range(k) if j != i)
            new = max(0.0, r / gram[i][i])
            moved = max(moved, abs(new - w[i]))
            w[i] = new
        if moved < 1e-14:
            break
    return w
