"""Group aggregates of the panel: trades, weather, events, weights, pivots, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_col, log_ratio, safe_div


def trade_totals(df: DataFrame, keys: list[str], qty: str, amount: str) -> DataFrame:
    """Sums of quantity and amount (0 when all missing), number of rows, average price. Missing keys form groups."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(qty), F.lit(0.0)).alias("qty"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount"),
        F.count(F.lit(1)).alias("n_trades"),
    ).withColumn("avg_price", safe_div("amount", "qty"))


def totals_with_unit(df: DataFrame, keys: list[str], unit: str, kept_unit: str, qty: str, amount: str, n: str) -> DataFrame:
    """All amounts and counts, quantity and price only from rows in the kept unit (NULL where a group has none)."""
    kept = F.col(unit) == kept_unit
    return (
        df.groupBy(*keys).agg(
            F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount"), F.coalesce(F.sum(n), F.lit(0)).alias("n_trades"),
            F.max(kept.cast("int")).alias("_any"),
            F.coalesce(F.sum(F.when(kept, F.col(qty))), F.lit(0.0)).alias("qty_kg"),
            F.coalesce(F.sum(F.when(kept, F.col(amount))), F.lit(0.0)).alias("_amount_kg"),
        )
        .withColumn("qty_kg", F.when(F.col("_any") == 1, F.col("qty_kg")))
        .withColumn("avg_price_kg", F.when(F.col("_any") == 1, safe_div("_amount_kg", "qty_kg")))
        .drop("_any", "_amount_kg")
    )


def share_over(df: DataFrame, day: str, c: str, at_least: float, name: str) -> DataFrame:
    """Share of a day's rows at or above the threshold; missing readings count as no."""
    return df.groupBy(day).agg(F.avg(F.coalesce((F.col(c) >= at_least).cast("double"), F.lit(0.0))).alias(name))


def storm_share(hours: DataFrame, station: str, day: str, wind: str, at_least: float = 14.0, hours_needed: int = 3,
                min_readings: int = 12, name: str = "storm_share") -> DataFrame:
    """Per day: share of stations with enough readings that had enough strong hours."""
    d = hours.groupBy(station, day).agg(F.count(wind).alias("_n"), F.sum((F.col(wind) >= at_least).cast("int")).alias("_s"))
    return d.where(F.col("_n") >= min_readings).groupBy(day).agg(F.avg((F.coalesce("_s", F.lit(0)) >= hours_needed).cast("double")).alias(name))


def ordered_concat(df: DataFrame, key: list[str], value: str, position: str, sep: str, name: str, distinct: bool = True) -> DataFrame:
    """Values in order of first position, joined by sep. Duplicates leave before anything is collected."""
    src = df.where(F.col(value).isNotNull())
    if distinct:
        src = src.groupBy(*key, value).agg(F.min(position).alias(position))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).cast("string").alias("v"))))
    return src.groupBy(*key).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), sep).alias(name))


def top_origin_share(df: DataFrame, key: list[str], day: str, origin: str, qty: str, first_year: int, last_year: int, other: str) -> DataFrame:
    """Top origin by volume in the base years (ties: lowest name), and its share of each day's volume."""
    base = (
        df.where(F.year(day).between(first_year, last_year) & (F.col(origin) != other))
        .groupBy(*key, origin).agg(F.coalesce(F.sum(qty), F.lit(0.0)).alias("_q"))
    )
    top = base.groupBy(*key).agg(F.min_by(origin, F.struct((-F.col("_q")).alias("q"), F.col(origin).alias("o"))).alias("top_origin"))
    day_origin = df.groupBy(*key, day, origin).agg(F.sum(qty).alias("_q"))
    return (
        day_origin.join(top, key).groupBy(*key, day, "top_origin")
        .agg(F.coalesce(F.sum(F.when(F.col(origin) == F.col("top_origin"), F.col("_q"))), F.lit(0.0)).alias("_t"), F.coalesce(F.sum("_q"), F.lit(0.0)).alias("_all"))
        .select(*key, day, "top_origin", F.col("_t").alias("top_qty"), F.col("_all").alias("total_qty"), safe_div("_t", "_all").alias("top_origin_share"))
    )


def weighted_region_mean(readings: DataFrame, region: str, day: str, cols: list[str], weights: DataFrame, item: list[str], weight: str) -> DataFrame:
    """Item x day means of regional readings, weighted by the item's regional production share.

    Weights are normalised over regions that have readings; a missing reading leaves both sums.
    """
    regional = readings.groupBy(region, day).agg(*[F.avg(c).alias(c) for c in cols])
    w = weights.where(F.col(weight) > 0).join(regional.select(region).distinct(), region, "left_semi")
    tot = w.groupBy(*item).agg(F.sum(weight).alias("_t"))
    w = w.join(tot, item).select(*item, region, safe_div(weight, "_t").alias("_w"))
    return (
        regional.join(w, region).groupBy(*item, day)
        .agg(*[safe_div(F.sum(F.col("_w") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))).alias(c) for c in cols])
    )


def long_to_wide(df: DataFrame, index: list[str], key: str, values: list[str], value, agg=F.avg) -> DataFrame:
    """Pivot with the column list given, so no extra pass looks for it."""
    return df.groupBy(*index).pivot(key, values).agg(agg(as_col(value)))


def price_count_pairs(df: DataFrame, ids: list[str], price_suffix: str = "Amt", count_suffix: str = "Cnt", order: str | None = None) -> DataFrame:
    """Wide <market>Amt / <market>Cnt columns -> rows of market, price, head_count (texts), both of one row.

    Of several rows of a group the first by `order` counts; without one, rows with a price come first, then the text
    order of price and count decides.
    """
    markets = list(dict.fromkeys(c[: -len(x)] for c in df.columns for x in (price_suffix, count_suffix) if c.endswith(x)))
    text = lambda c: F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(m).alias("market"), text(m + price_suffix).alias("price"), text(m + count_suffix).alias("head_count")) for m in markets])
    long = df.select(*ids, *([F.col(order).alias("_o")] if order else []), F.explode(cells).alias("_c"))
    first = [F.col("_o")] if order else []
    rank = F.struct(*first, F.col("_c.price").isNull(), F.col("_c.price"), F.col("_c.head_count").isNull(), F.col("_c.head_count"))
    return long.groupBy(*ids, F.col("_c.market").alias("market")).agg(F.min_by("_c", rank).alias("_c")).select(*ids, "market", "_c.price", "_c.head_count")


def newest_source(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """One row per key, the last source name winning."""
    from .cleaning import keyed_first

    return keyed_first(df, keys, [F.col(source)], keep="last")


def event_counts(df: DataFrame, keys: list[str], heads: str, heads_name: str, cases_name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(cases_name), F.coalesce(F.sum(heads), F.lit(0.0)).alias(heads_name))


SET_ITEMS = 5000


def cooccurrence(df: DataFrame, basket: str, item: str, min_baskets: int = 5, set_items: int = SET_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(item counts, item pair counts) over baskets, items in at least min_baskets baskets.

    The vocabulary is counted first. Up to `set_items` items, baskets become item sets and equal sets are counted once,
    so a very large basket is one row no wider than the vocabulary. A larger vocabulary is paired by an equi join on the
    basket, both sides spread by item.
    """
    pairs = df.select(basket, item).where(F.col(item).isNotNull()).distinct()
    counts = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_baskets)
    kept = pairs.join(counts.select(item), item, "left_semi")
    if counts.limit(set_items + 1).count() > set_items:
        other = kept.select(basket, F.col(item).alias("item_b"))
        both = kept.select(basket, F.col(item).alias("item_a")).join(other, basket).where("item_a <> item_b")
        return counts, both.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_both"))
    sets = kept.groupBy(basket).agg(F.array_sort(F.collect_set(item)).alias("_s")).groupBy("_s").agg(F.count(F.lit(1)).alias("_k"))
    a = sets.select("_s", "_k", F.posexplode("_s").alias("_i", "_a"))
    pc = (
        a.select("_k", "_a", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("_b"))
        .groupBy("_a", "_b").agg(F.sum("_k").alias("n_both"))
    )
    both = pc.unionByName(pc.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "n_both"))
    return counts, both.select(F.col("_a").alias("item_a"), F.col("_b").alias("item_b"), "n_both")


def ppmi(counts: DataFrame, pairs: DataFrame, item: str, n_baskets: DataFrame) -> DataFrame:
    """Positive pointwise mutual information of item pairs. n_baskets: one row, column `n_baskets`."""
    a = counts.select(F.col(item).alias("item_a"), F.col("n").alias("_na"))
    b = counts.select(F.col(item).alias("item_b"), F.col("n").alias("_nb"))
    out = pairs.join(a, "item_a").join(b, "item_b").crossJoin(F.broadcast(n_baskets))  # one row
    n = F.col("n_baskets").cast("double")
    pmi = F.ln((F.col("n_both") / n + 1e-12) / ((F.col("_na") / n) * (F.col("_nb") / n)))
    return out.select("item_a", "item_b", "n_both", F.greatest(pmi, F.lit(0.0)).alias("ppmi"))


def second_order(pp: DataFrame) -> DataFrame:
    """Cosine of PPMI rows: do two items keep the same company.

    The sum over shared contexts runs context by context; contexts and items are the same bounded vocabulary.
    """
    norm = pp.groupBy("item_a").agg((F.sqrt(F.sum(F.col("ppmi") * F.col("ppmi"))) + 1e-12).alias("_n"))
    v = pp.where("ppmi > 0").join(norm, "item_a").select("item_a", "item_b", (F.col("ppmi") / F.col("_n")).alias("_v"))
    x = v.select(F.col("item_a").alias("x"), "item_b", F.col("_v").alias("_vx"))
    y = v.select(F.col("item_a").alias("y"), "item_b", F.col("_v").alias("_vy"))
    return x.join(y, "item_b").where("x <> y").groupBy("x", "y").agg(F.sum(F.col("_vx") * F.col("_vy")).alias("similarity"))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group; Spark limits each task's group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """A reproducible random sample of n rows: smallest hashes of the key."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(k) for k in key])).orderBy("_h", *key).limit(n).drop("_h")


def volume_price_correlation(daily: DataFrame, item: list[str], day: str, qty: str, price: str, min_days: int = 1000) -> DataFrame:
    """Correlation of log differences: same day, and this week's volume with next week's price change."""
    x = daily.where((F.col(qty) > 0) & (F.col(price) > 0))
    w = Window.partitionBy(*item).orderBy(day)
    d = x.withColumn("_dq", log_ratio(qty, F.lag(qty).over(w))).withColumn("_dp", log_ratio(price, F.lag(price).over(w)))
    same = d.groupBy(*item).agg(F.count(F.lit(1)).alias("n_days"), F.corr("_dq", "_dp").alias("same_day")).where(F.col("n_days") >= min_days)
    wk = x.groupBy(*item, F.to_date(F.date_trunc("week", F.col(day))).alias("_w")).agg(F.sum(qty).alias("_q"), F.avg(price).alias("_p"))
    ww = Window.partitionBy(*item).orderBy("_w")
    k = wk.withColumn("_dq", log_ratio("_q", F.lag("_q").over(ww))).withColumn("_dp", log_ratio("_p", F.lag("_p").over(ww)))
    k = k.withColumn("_next", F.lead("_dp").over(ww))
    lead = k.groupBy(*item).agg(F.corr("_dq", "_next").alias("next_week"))
    return same.join(lead, item, "left")
