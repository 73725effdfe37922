"""Direction probability, purchase savings, stocking policy and forecast cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, ordered_chunks
from ..session import cut_lineage
from ..functions.scalars import BAND, as_col, direction, probability_text, safe_div, shown_probability


def direction_hits(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows whose forecast leaves the band: size = |p|, hit = moved more than 1 % the forecast's way."""
    x = df.where((F.abs(p) > BAND) & F.col(y).isNotNull())
    return x.withColumn("size", F.abs(p)).withColumn("hit", (F.signum(p) * F.col(y) > BAND).cast("double"))


def fit_probability(hits: DataFrame, by: list[str] | None = None, top: float = 0.99) -> DataFrame:
    """a, b of hit = a + b ln(size) and cap = hit rate of the largest 1 % sizes, rounded down to whole percents."""
    by = by or []
    hits = cut_lineage(hits.select(*by, "size", "hit"))  # three passes over the same narrow rows
    line = hits.groupBy(*by).agg(
        F.regr_intercept("hit", F.ln("size")).alias("a"), F.regr_slope("hit", F.ln("size")).alias("b"), F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(hits, by, "size", {"_q": top})
    joined = hits.join(q, by) if by else hits.crossJoin(F.broadcast(q))  # one row without groups
    cap = joined.where("size >= _q").groupBy(*by).agg((F.floor(F.avg("hit") * 100) / 100).cast("double").alias("cap"))
    return line.join(cap, by) if by else line.crossJoin(cap)


def with_probability(df: DataFrame, p: str, fit: DataFrame, by: list[str] | None = None, name: str = "prob") -> DataFrame:
    f = fit.select(*(by or []), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("cap").alias("_cap"))
    out = df.join(f, by, "left") if by else df.crossJoin(F.broadcast(f))  # one row without groups
    return out.withColumn(name, shown_probability(p, F.col("_a"), F.col("_b"), F.col("_cap"))).drop("_a", "_b", "_cap")


def brier(hits: DataFrame, p: str, fit: DataFrame) -> DataFrame:
    """Mean squared distance of the unrounded, uncapped line to the hits."""
    f = fit.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    x = hits.crossJoin(F.broadcast(f))  # one row
    pr = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_a") + F.col("_b") * F.ln("size")))
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg((pr - F.col("hit")) * (pr - F.col("hit"))).alias("brier"))


def calibration_bins(hits: DataFrame, p: str, fit: DataFrame, width: float = 0.05) -> DataFrame:
    """Shown probability in bins (0.5 and below together): share of rows and real hit rate."""
    x = with_probability(hits, p, fit)
    b = F.when(F.col("prob") <= 0.5, F.lit(0.5)).otherwise(F.ceil((F.col("prob") - 1e-9) / width) * width)
    tot = x.agg(F.count(F.lit(1)).alias("_all"))
    return (
        x.groupBy(F.round(b, 2).alias("upto")).agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("hit_rate"))
        .crossJoin(F.broadcast(tot)).select("upto", "n", safe_div("n", "_all").alias("share"), "hit_rate")
    )


def hit_curve(hits: DataFrame, per: int = 1000) -> DataFrame:
    """Hit rate of consecutive chunks by forecast size."""
    return ordered_chunks(hits, "size", "hit", per)


def monthly_refits(df: DataFrame, day: str, y: str, p: str, horizon: int = 28, months_back: int | None = None) -> DataFrame:
    """a and b per month, fitted on outcomes known by its first day (date + 28 d <= month start), all or the last months.

    Sums per day are enough for a least-squares line, so days (bounded by the calendar) meet months, not rows.
    """
    h = direction_hits(df, y, p)
    x = F.ln("size")
    daily = h.groupBy(F.col(day).alias("_d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum("hit").alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * F.col("hit")).alias("sxy"))
    months = df.select(F.to_date(F.date_trunc("month", F.col(day))).alias("month")).distinct()
    cum = daily.withColumn("_known", F.date_add("_d", horizon))
    # First month that may use a day's outcomes; summing per entry month, then a running sum over months.
    entry = F.when(F.dayofmonth("_known") == 1, F.col("_known")).otherwise(F.add_months(F.to_date(F.date_trunc("month", F.col("_known"))), 1))
    cols = ["n", "sx", "sy", "sxx", "sxy"]
    per = cum.groupBy(entry.cast("date").alias("month")).agg(*[F.sum(c).alias(c) for c in cols])
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("_mi"))
    frame = w.rangeBetween(Window.unboundedPreceding if months_back is None else -(months_back - 1), 0)
    all_m = months.join(per, "month", "full_outer").withColumn("_mi", F.year("month") * 12 + F.month("month"))
    s = all_m.select("month", *[F.sum(c).over(frame).alias(c) for c in cols]).join(months, "month", "left_semi")
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    b = safe_div(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), det)
    return s.where("n > 1").select("month", "n", ((F.col("sy") - b * F.col("sx")) / F.col("n")).alias("a"), b.alias("b"))


def card_cost(y, p, idle: Column) -> Column:
    """Relative cost of following the card: up -> buy now (1), down -> spread (1 + y), flat -> the idle behaviour."""
    p = as_col(p)
    return F.when(p > BAND, F.lit(1.0)).when(p < -BAND, 1 + as_col(y)).otherwise(idle)


def savings(df: DataFrame, y: str, p: str, base: str, by: list[str] | None = None) -> DataFrame:
    """Against always buying now and always spreading: mean saving, best possible saving, their ratio, won per kg."""
    by = by or []
    x = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    spread = 1 + F.col(y)
    best = F.least(F.lit(1.0), spread)
    out = None
    for name, idle in (("now", F.lit(1.0)), ("spread", spread)):
        save, room = idle - card_cost(y, p, idle), idle - best
        one = x.groupBy(*by).agg(
            F.lit(name).alias("against"), (F.avg(save) * 100).alias("saving_pct"), (F.avg(room) * 100).alias("possible_pct"),
            (safe_div(F.sum(save), F.sum(room)) * 100).alias("of_possible_pct"), F.avg(save * F.col(base)).alias("saving_per_kg"))
        out = one if out is None else out.unionByName(one)
    return out


def savings_above(df: DataFrame, y: str, p: str, base: str, prob: str, thresholds=(0.5, 0.6, 0.7)) -> DataFrame:
    """Savings against spreading when only cards above a probability are followed."""
    x = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    spread = 1 + F.col(y)
    cost = F.when(F.coalesce(F.col(prob) > F.col("threshold"), F.lit(False)), card_cost(y, p, spread)).otherwise(spread)
    save, room = spread - cost, spread - F.least(F.lit(1.0), spread)
    return x.groupBy("threshold").agg((F.avg(save) * 100).alias("saving_pct"), (safe_div(F.sum(save), F.sum(room)) * 100).alias("of_possible_pct"), F.avg(save * F.col(base)).alias("saving_per_kg"))


def wrong_card_losses(df: DataFrame, y: str, p: str, base: str) -> DataFrame:
    """Bought now and it fell, waited and it rose: share of directional cards, mean loss, won per kg, share above 10 %."""
    x = df.where(F.col(y).isNotNull() & (F.abs(p) > BAND))
    up = (F.col(p) > BAND) & (F.col(y) < -BAND)
    dn = (F.col(p) < -BAND) & (F.col(y) > BAND)
    x = x.withColumn("case", F.when(up, "bought_now_fell").when(dn, "waited_rose")).withColumn("_loss", F.abs(y))
    tot = x.agg(F.count(F.lit(1)).alias("_all"))
    return (
        x.where(F.col("case").isNotNull()).groupBy("case")
        .agg(F.count(F.lit(1)).alias("n"), (F.avg("_loss") * 100).alias("loss_pct"), F.avg(F.col("_loss") * F.col(base)).alias("loss_per_kg"), (F.avg((F.col("_loss") > 0.10).cast("double")) * 100).alias("over_10_pct"))
        .crossJoin(F.broadcast(tot)).select("case", "n", (F.col("n") * 100.0 / F.col("_all")).alias("share_pct"), "loss_pct", "loss_per_kg", "over_10_pct")  # one row
    )


# Weeks of stock held normally, before an expected rise, before an expected fall.
STOCK_NORMAL, STOCK_UP, STOCK_DOWN = 2, 4, 1


def weekly_first(df: DataFrame, keys: list[str], day: str, cols: list[str]) -> DataFrame:
    """First survey row of each ISO week (within the calendar year) per item."""
    row = F.struct(F.col(day), *[F.col(c) for c in cols])
    return df.groupBy(*keys, F.year(day).alias("year"), F.weekofyear(day).alias("week")).agg(F.min_by(row, day).alias("_r")).select(*keys, "year", "week", "_r.*")


def stocking_policy(df: DataFrame, keys: list[str], day: str, base: str, p: str, budget: float = 1_000_000.0) -> DataFrame:
    """Weekly shopping over a year: spend without forecasts, buying early, and buying early or late.

    Each item-year is an array of at most 53 weeks, folded in order with (stock, cost) as state. Quantities are scaled
    so that the plain policy spends the budget; the year-end difference in stock is valued at the last price.
    """
    wk = weekly_first(df.where(F.col(base).isNotNull()), keys, day, [base, p])
    arr = wk.groupBy(*keys, "year").agg(F.array_sort(F.collect_list(F.struct(F.col("week").alias("w"), F.col(base).alias("b"), F.coalesce(F.col(p), F.lit(0.0)).alias("p")))).alias("_w"))

    def run(use_up: bool, use_down: bool) -> Column:
        start = F.struct(F.lit(float(STOCK_NORMAL)).alias("stock"), F.lit(0.0).alias("cost"))

        def step(acc, x):
            target = F.lit(float(STOCK_NORMAL))
            if use_down:
                target = F.when(x["p"] < -BAND, float(STOCK_DOWN)).otherwise(target)
            if use_up:
                target = F.when(x["p"] > BAND, float(STOCK_UP)).otherwise(target)
            buy = F.greatest(F.lit(0.0), target - acc["stock"])
            return F.struct((acc["stock"] + buy - 1).alias("stock"), (acc["cost"] + buy * x["b"]).alias("cost"))

        return F.aggregate("_w", start, step)

    out = arr.select(
        *keys, "year", F.size("_w").alias("weeks"), run(False, False).alias("_p"), run(True, False).alias("_e"), run(True, True).alias("_l"),
        F.element_at("_w", -1)["b"].alias("_last"),
        F.size(F.filter("_w", lambda x: x["p"] > BAND)).alias("up_weeks"), F.size(F.filter("_w", lambda x: x["p"] < -BAND)).alias("down_weeks"),
        safe_div(F.array_max(F.transform("_w", lambda x: x["b"])), F.array_min(F.transform("_w", lambda x: x["b"]))).alias("price_range"),
    )
    kg = safe_div(F.lit(budget), "_p.cost")
    settle = lambda c: (F.col(f"{c}.cost") - (F.col(f"{c}.stock") - F.col("_p.stock")) * F.col("_last")) * kg
    return out.select(
        *keys, "year", "weeks", (F.col("_p.cost") * kg).alias("plain"), settle("_e").alias("early"), settle("_l").alias("early_late"),
        "up_weeks", "down_weeks", "price_range",
    ).withColumn("early_saving_pct", (1 - safe_div("early", "plain")) * 100).withColumn("early_late_saving_pct", (1 - safe_div("early_late", "plain")) * 100)


def forecast_cards(df: DataFrame, base: str, p: str, prob: str, history: list[str]) -> DataFrame:
    """Price forecast, label, card sentence, and a warning when at least four history features are missing."""
    missing = sum((F.col(c).isNull().cast("int") for c in history), F.lit(0))
    return (
        df.withColumn("price_forecast", F.col(base) * (1 + F.col(p))).withColumn("label", direction(p))
        .withColumn("card", probability_text(prob, p)).withColumn("short_history", missing >= 4)
    )
