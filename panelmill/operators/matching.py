"""Dictionary, prefix, interval, unit and similarity matching."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_col, safe_div
from ..session import cut_lineage


def explode_list(df: DataFrame, col: str, name: str, sep: str = ";") -> DataFrame:
    """One row per non-empty element of a separated list."""
    return df.withColumn(name, F.explode(F.split(F.coalesce(F.col(col), F.lit("")), sep))).where(F.col(name) != "")


def prefix_pairs(items: DataFrame, item_keys: list[str], prefix: str, codes: DataFrame, code: str) -> DataFrame:
    """Distinct (item, code) with code starting with one of the item's prefixes.

    Codes are cut into their leading pieces of the lengths that the prefixes have, so the theta join is an equi join on
    the piece. Overlapping prefixes count once.
    """
    want = items.select(*item_keys, F.col(prefix).alias("_p")).where(F.col("_p") != "").distinct()
    lengths = want.select(F.length("_p").alias("_l")).distinct()  # one row a length, so at most as many as the longest prefix has characters
    pieces = (
        codes.select(code).where(F.col(code).isNotNull()).distinct().join(lengths, F.length(code) >= F.col("_l"))
        .withColumn("_p", F.expr(f"substring(`{code}`, 1, _l)")).drop("_l")
    )
    return want.join(pieces, "_p").select(*item_keys, code).distinct()


# Units that already are weights, in grams.
KG_UNITS, GRAM_UNITS = ("L", "ℓ"), ("g", "ml")


def unit_grams(rows: DataFrame, table: DataFrame, item: str = "item_nm", variety: str = "vrty_nm", unit: str = "unit") -> DataFrame:
    """Grams per unit: weight units directly, count units from the table (variety hit first, then the default row).

    table: item_nm, unit, vrty_contains, g_per_unit, source and a line number `line` for file order. The table is folded
    to one row per (item, unit) holding its few options, so rows need one join and no second pass.
    """
    option = F.struct(F.col("line").alias("line"), F.coalesce("vrty_contains", F.lit("")).alias("has"), F.col("g_per_unit").cast("double").alias("g"), F.col("source").alias("src"))
    t = table.groupBy(F.col("item_nm").alias("_i"), F.col("unit").alias("_u")).agg(F.array_sort(F.collect_list(option)).alias("_o"))
    u, v = F.col(unit), F.coalesce(F.col(variety), F.lit(""))
    weight = F.when(u.startswith("kg") | u.isin(*KG_UNITS), 1000.0).when(u.isin(*GRAM_UNITS), 1.0)
    hit = F.get(F.filter("_o", lambda x: (x["has"] != "") & v.contains(x["has"])), F.lit(0))
    plain = F.get(F.filter("_o", lambda x: x["has"] == ""), F.lit(0))
    x = rows.join(t, (F.col(item) == F.col("_i")) & (u == F.col("_u")), "left").withColumn("_b", F.coalesce(hit, plain))
    source = F.when(weight.isNotNull(), "weight").when(F.col("_b.g").isNotNull(), F.concat(F.lit("table:"), "_b.src")).otherwise("missing")
    return x.withColumns({"unit_g": F.coalesce(weight, F.col("_b.g")), "unit_g_source": source}).drop("_i", "_u", "_o", "_b")


# Alias lists up to this size are matched inside one expression; longer ones by an equi join on substrings.
INLINE_ALIASES = 2000


def best_alias(names: DataFrame, name: str, aliases: DataFrame, out: list[str], order: list[str], eligible=None, inline: int = INLINE_ALIASES) -> DataFrame:
    """First alias (by `order`) contained in each name; aliases flagged `exact` must equal it.

    names: distinct names with whatever columns `eligible` reads; eligible(get) gives a condition, get(c) being a column
    of the alias. The alias list is counted first: a short one becomes a constant array tested per name. A longer one
    meets substrings of the name by equality: work per name is (length x number of distinct alias lengths).
    """
    fields = list(dict.fromkeys(["alias", "exact", *order, *out]))
    rows = aliases.select(*fields).limit(inline + 1).collect()
    if len(rows) <= inline:
        rows = sorted((r.asDict() for r in rows), key=lambda r: [r[o] for o in order])
        schema = aliases.select(*fields).schema
        listed = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), T.ArrayType(schema))

        def fits(x):
            ok = F.contains(F.col(name), x["alias"]) & (~x["exact"] | (x["alias"] == F.col(name)))
            return ok & eligible(lambda c: x[c]) if eligible else ok

        m = names.withColumn("_m", F.get(F.filter(listed, fits), F.lit(0))).where("_m IS NOT NULL")
    else:
        lens = aliases.select(F.length("alias").alias("_l")).where("_l > 0").groupBy(F.lit(1)).agg(F.collect_set("_l").alias("_ls"))
        cut = (
            names.crossJoin(F.broadcast(lens.select("_ls")))  # one row: the set of alias lengths
            .withColumn("_l", F.explode("_ls")).where(F.length(name) >= F.col("_l"))
            .withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(name) - F.col("_l") + 1)))
            .withColumn("alias", F.expr(f"substring(`{name}`, _at, _l)")).drop("_ls", "_l", "_at").distinct()
        )
        cond = ~F.col("exact") | (F.col("alias") == F.col(name))
        if eligible:
            cond = cond & eligible(F.col)
        hit = cut.join(aliases.select(*fields), "alias").where(cond)
        m = hit.groupBy(name).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_m"))
    return m.select(name, *[F.col(f"_m.{c}").alias(c) for c in out])


def first_contained(names: DataFrame, name: str, aliases: DataFrame, out: list[str], inline: int = INLINE_ALIASES) -> DataFrame:
    """Best alias contained in each distinct name: longest first, then declared order; one-character aliases need equality.

    aliases: alias, rank (declared order) and the `out` columns.
    """
    n = names.select(name).where(F.col(name).isNotNull()).distinct()
    a = aliases.withColumns({"exact": F.length("alias") == 1, "_len": -F.length("alias")})
    return best_alias(n, name, a, out, ["_len", "rank"], inline=inline)


def season_windows(rows: DataFrame, seasons: DataFrame, item: str, day: str) -> DataFrame:
    """closed_season, closed_window and days_to_closed_start per row.

    seasons: item_nm, year (empty = general rule), start_md, end_md as MM-dd. A year's own row overrides the rule;
    items that have yearly rows are NULL in years without one. Items without a season: 0, 0, NULL.
    """
    s = seasons.select(F.col("item_nm").alias("_item"), F.coalesce("year", F.lit("")).alias("_y"), F.col("start_md").alias("_a"), F.col("end_md").alias("_b"))
    rule = s.where("_y = ''").groupBy("_item").agg(F.min_by(F.struct("_a", "_b"), F.lit(0)).alias("_r"))
    has = s.where("_y <> ''").groupBy("_item").agg(F.lit(True).alias("_yearly"))
    y = s.where("_y <> ''").select("_item", F.col("_y").cast("int").alias("_yy"), F.col("_a").alias("_ya"), F.col("_b").alias("_yb"))
    nxt = y.select("_item", (F.col("_yy") - 1).alias("_yy"), F.col("_ya").alias("_na"))
    md, yr = F.date_format(F.col(day), "MM-dd"), F.year(F.col(day))
    out = (
        rows.withColumn("_item", F.col(item)).withColumn("_yy", yr)
        .join(rule, "_item", "left").join(has, "_item", "left").join(y, ["_item", "_yy"], "left").join(nxt, ["_item", "_yy"], "left")
    )
    inside = lambda a, b: ((md >= a) & (md <= b)).cast("double")
    ruled = F.col("_r").isNotNull()
    window = F.when(ruled, inside(F.col("_r._a"), F.col("_r._b"))).otherwise(0.0)
    season = F.when(F.col("_yearly"), F.when(F.col("_ya").isNotNull(), inside(F.col("_ya"), F.col("_yb")))).otherwise(window)
    start = lambda year, own: F.to_date(F.concat(year.cast("string"), F.lit("-"), F.coalesce(own, F.col("_r._a"))))
    this, following = start(yr, F.col("_ya")), start(yr + 1, F.col("_na"))
    days = F.when(ruled, F.datediff(F.when(this >= F.col(day), this).otherwise(following), F.col(day)))
    return out.withColumn("closed_season", season).withColumn("closed_window", window).withColumn("days_to_closed_start", days).drop("_item", "_yy", "_r", "_yearly", "_ya", "_yb", "_na")


def catalogue_matches(a: DataFrame, a_id: str, b: DataFrame, b_id: str, day: str, price: str, days: int) -> DataFrame:
    """Products of two catalogues matched by the multiset Jaccard of their store prices, averaged over survey days.

    Stores are counted per (day, product, price) first; products meet only on an equal price of the same day, so the
    pairs are bounded by the two catalogues, not by the observations. Keeps mutual best partners (ties: lowest id).
    """
    ca = a.groupBy(day, price, F.col(a_id).alias("_a")).agg(F.count(F.lit(1)).alias("_na"))
    cb = b.groupBy(day, price, F.col(b_id).alias("_b")).agg(F.count(F.lit(1)).alias("_nb"))
    ta = ca.groupBy(day, "_a").agg(F.sum("_na").alias("_ta"))
    tb = cb.groupBy(day, "_b").agg(F.sum("_nb").alias("_tb"))
    inter = ca.join(cb, [day, price]).groupBy(day, "_a", "_b").agg(F.sum(F.least("_na", "_nb")).alias("_i"))
    sim = (
        inter.join(ta, [day, "_a"]).join(tb, [day, "_b"])
        .groupBy("_a", "_b").agg((F.sum(safe_div("_i", F.col("_ta") + F.col("_tb") - F.col("_i"))) / days).alias("score"))
    )
    best_a = sim.groupBy("_a").agg(F.min_by("_b", F.struct(-F.col("score"), "_b")).alias("_b"))
    best_b = sim.groupBy("_b").agg(F.min_by("_a", F.struct(-F.col("score"), "_a")).alias("_a"))
    return (
        sim.join(best_a, ["_a", "_b"]).join(best_b, ["_a", "_b"])
        .select(F.col("_a").alias(a_id), F.col("_b").alias(b_id), "score", (F.col("score") >= 0.5).alias("confident"))
    )


def duplicate_series(daily: DataFrame, series: str, day: str, price: str, min_overlap: int = 200, share: float = 0.95,
                     rtol: float = 1e-6) -> DataFrame:
    """Pairs of series with at least min_overlap shared days and equal prices on `share` of them.

    Such a pair agrees on at least ceil(share * min_overlap) days. Every observation gives a token (day, price cell)
    on each of two shifted grids, so equal prices share a token. A pair that agrees on k days must share a token
    outside the k - 1 most frequent tokens of each series: only those rare tokens generate candidates, which keeps
    common day-price values from producing all pairs, and loses none. Candidates are then checked exactly.
    """
    need = -(-int(share * 1000) * min_overlap // 1000)
    width = 64.0 * rtol
    ln = F.ln(F.col(price))
    grids = F.array(F.struct(F.lit(0).alias("g"), F.floor(ln / width).alias("c")), F.struct(F.lit(1).alias("g"), F.floor(ln / width + 0.5).alias("c")))
    obs = cut_lineage(daily.where(F.col(price) > 0).select(series, day, price))
    tok = obs.withColumn("_t", F.explode(grids)).select(series, day, F.col("_t.g").alias("_g"), F.col("_t.c").alias("_c"))
    freq = tok.groupBy(day, "_g", "_c").agg(F.count(F.lit(1)).alias("_f")).where("_f > 1")
    # Rarest first inside a series; the last need-1 tokens may be skipped. A series has at most two tokens per day.
    w = Window.partitionBy(series)
    rare = (
        tok.join(freq, [day, "_g", "_c"])
        .withColumn("_r", F.row_number().over(w.orderBy("_f", day, "_g", "_c")))
        .withColumn("_k", F.count(F.lit(1)).over(w))
        .where(F.col("_r") <= F.col("_k") - (need - 1))
    )
    rare = cut_lineage(rare.select(series, day, "_g", "_c"))
    left = rare.select(F.col(series).alias("_a"), day, "_g", "_c")
    right = rare.select(F.col(series).alias("_b"), day, "_g", "_c")
    cand = left.join(right, [day, "_g", "_c"]).where("_a < _b").select("_a", "_b").distinct()
    x = obs.select(F.col(series).alias("_a"), day, F.col(price).alias("_pa"))
    y = obs.select(F.col(series).alias("_b"), day, F.col(price).alias("_pb"))
    close = F.abs(F.col("_pa") - F.col("_pb")) <= 1e-8 + rtol * F.abs(F.col("_pb"))
    return (
        cand.join(x, "_a").join(y, ["_b", day]).groupBy("_a", "_b")
        .agg(F.count(F.lit(1)).alias("shared_days"), F.avg(close.cast("double")).alias("same_share"))
        .where((F.col("shared_days") >= min_overlap) & (F.col("same_share") >= share))
        .select(F.col("_a").alias("series_a"), F.col("_b").alias("series_b"), "shared_days", "same_share")
    )


def item_column(rules: list[tuple[Column, str]]) -> Column:
    """Value of the column that applies to the row; NULL when no rule fits."""
    out = None
    for cond, c in rules:
        out = F.when(cond, F.col(c)) if out is None else out.when(cond, F.col(c))
    return out


def override(df: DataFrame, table: DataFrame, key: str, col: str, exclude: str) -> DataFrame:
    """Value from the override table where listed, else the computed one; the exclude word means none."""
    o = table.select(key, F.col(col).alias("_o"))
    return df.join(o, key, "left").withColumn(col, F.nullif(F.coalesce("_o", F.col(col)), F.lit(exclude))).drop("_o")


def fallback_rows(requests: DataFrame, rows: DataFrame, item: str, region: str, day: str, national: str, value: str) -> DataFrame:
    """Per request: the region's value that day, else the national one with a note, else the last observation up to the day.

    requests: item, region, day (distinct). Output adds value, source ('region' | 'national' | 'last' | 'none') and last_day.
    """
    req = requests.select(item, region, day).distinct()
    reg = rows.where(F.col(region) != national).groupBy(item, region, day).agg(F.max(value).alias("_reg"))
    nat = rows.where(F.col(region) == national).groupBy(item, day).agg(F.max(value).alias("_nat"))
    out = req.join(reg, [item, region, day], "left").join(nat, [item, day], "left")
    # Last observation: one row per (item, day) in the history, so the as-of step is bounded by the calendar.
    from .asof import Fact, asof_backward

    hist = rows.where(F.col(value).isNotNull()).groupBy(item, F.col(day).alias("_hd")).agg(F.max(value).alias("_last")).withColumn("last_day", F.col("_hd"))
    out = asof_backward(out, day, [Fact(hist, "_hd", ["_last", "last_day"])], [item])
    src = F.when(F.col("_reg").isNotNull(), "region").when(F.col("_nat").isNotNull(), "national").when(F.col("_last").isNotNull(), "last").otherwise("none")
    return out.select(item, region, day, F.coalesce("_reg", "_nat", "_last").alias(value), src.alias("source"),
                      F.when(src == "last", F.col("last_day")).alias("last_day"))
