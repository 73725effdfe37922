"""Recipes: ingredients, links to priced items, ingredient state, dish ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.quantiles import exact_median
from ..functions.scalars import safe_div
from ..functions.text import clean_ingredient, menu_name, strip_all, unify
from ..session import cut_lineage
from .aggregates import ordered_concat
from .matching import best_alias, override


def recipe_ingredients(recipes: DataFrame, key: str = "recipe_id", listed: str = "ingredients", text: str = "ingredients_text") -> DataFrame:
    """recipe, raw, ingredient (cleaned), pos: JSON list of [name, amount], or the free text cut at separators when the list is empty."""
    names = F.transform(F.from_json(F.col(listed), "array<array<string>>"), lambda p: F.get(p, F.lit(0)))
    source = F.when(F.size(names) > 0, names).otherwise(F.split(F.col(text), V.ING_SEPARATORS))
    x = recipes.select(key, F.posexplode(source).alias("pos", "_raw")).where(F.col("_raw").isNotNull())
    x = x.withColumn("ingredient", clean_ingredient("_raw")).groupBy(key, "ingredient").agg(F.min_by(strip_all("_raw"), "pos").alias("raw"), F.min("pos").alias("pos"))
    # Empty names leave by a condition that also reads an aggregate: one on the key alone would move in front and run all patterns a second time.
    return x.where((F.col("ingredient") != "") | (F.col("pos") < 0))


def alias_table(spark, items: DataFrame) -> DataFrame:
    """alias, tier, sort, exact, price_item, price_source: fresh aliases, then item names, then packaged food words.

    Tiers 0 and 1 prefer longer aliases, then declared order; one-character fresh aliases must equal the name.
    """
    fresh = [(a, 0, -len(a) * 10_000 + i, len(a) == 1, it, V.SOURCE_FRESH)
             for i, (it, a) in enumerate((it, a) for it, al in V.FRESH_ALIASES.items() for a in al)]
    packed = [(k, 2, g, False, name, V.SOURCE_PACKAGED) for g, (name, (words, _)) in enumerate(V.PACKAGED.items()) for k in words]
    schema = "alias string, tier int, sort int, exact boolean, price_item string, price_source string"
    fixed = spark.createDataFrame(fresh + packed, schema)
    base = F.regexp_replace("item_nm", r"\(.*\)", "")
    named = items.select(
        base.alias("alias"), F.lit(1).alias("tier"), (-F.length(base) * 10_000 + F.col("line")).cast("int").alias("sort"),
        F.lit(False).alias("exact"), F.col("item_nm").alias("price_item"), F.lit(V.SOURCE_FRESH).alias("price_source"),
    ).where(F.length("alias") >= 2)
    return fixed.unionByName(named)


def sold_packaged(products: DataFrame, product: str) -> DataFrame:
    """Packaged foods with at least one product whose name contains one of their words: one pass, one row per food."""
    rules = {name: " OR ".join(["_p LIKE '%" + w + "%'" for w in words]) for name, (_, words) in V.PACKAGED.items()}
    one = products.select(F.col(product).alias("_p")).agg(*[F.max(F.expr(r)).alias(f"c{i}") for i, r in enumerate(rules.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("price_item"), F.coalesce(F.col(f"c{i}"), F.lit(False)).alias("sold")) for i, n in enumerate(rules)]))
    return one.select(rows.alias("r")).select("r.*").where("sold").select("price_item")


def is_seasoning(c: Column) -> Column:
    ends = "(?:" + "|".join(V.SEASONING_ENDINGS) + ")$"
    return c.isin(*dict.fromkeys(V.SEASONINGS)) | (c.rlike(ends) & ~c.isin(*V.NOT_SEASONING))


def ingredient_map(ingredients: DataFrame, items: DataFrame, products: DataFrame, product: str) -> DataFrame:
    """Every distinct ingredient: class, price item, price source, number of recipes.

    Works on distinct names. items needs item_nm and line (its order in the file).
    """
    spark = ingredients.sparkSession
    n = ingredients.groupBy("ingredient").agg(F.count(F.lit(1)).alias("n_recipes"))
    c = F.col("ingredient")
    n = n.withColumn("class", F.when(is_seasoning(c), V.CLASS_SEASONING).otherwise(V.CLASS_FOOD))
    n = n.withColumn("_fresh_ok", ~c.isin(*V.NOT_FRESH) & ~c.endswith(V.KIMCHI))
    aliases = alias_table(spark, items)
    sold = sold_packaged(products, product)
    aliases = aliases.where("tier < 2").unionByName(aliases.where("tier = 2").join(sold, "price_item", "left_semi"))
    food = n.where(F.col("class") == V.CLASS_FOOD).select("ingredient", "_fresh_ok")
    best = best_alias(food, "ingredient", aliases, ["price_item", "price_source"], ["tier", "sort"], lambda get: F.col("_fresh_ok") | (get("tier") == 2))
    return (
        n.join(best, "ingredient", "left")
        .select("ingredient", "class", "price_item", "price_source", "n_recipes")
    )


def recipe_coverage(linked: DataFrame, key: str = "recipe_id") -> DataFrame:
    """Per recipe: food ingredients, priced ones, ordered food names and ordered distinct price items."""
    food = linked.where(F.col("class") == V.CLASS_FOOD)
    n = food.groupBy(key).agg(F.count(F.lit(1)).alias("n_food"), F.count("price_item").alias("n_priced"))
    names = ordered_concat(food, [key], "ingredient", "pos", ";", "food_items")
    items = ordered_concat(food, [key], "price_item", "pos", ";", "price_items")
    return n.join(names, key, "left").join(items, key, "left").withColumn("price_items", F.coalesce("price_items", F.lit("")))


def recipes_table(recipes: DataFrame, coverage: DataFrame, overrides: DataFrame | None = None, key: str = "recipe_id", title: str = "name") -> DataFrame:
    """Recipes with unified dish name (override table first), menu flag and price coverage."""
    r = recipes.withColumn("menu_name", menu_name(title))
    if overrides is not None:
        r = override(r, overrides, key, "menu_name", V.EXCLUDED_MENU)
    r = r.withColumn("is_menu", F.col("menu_name").isNotNull()).withColumn("menu_name", unify("menu_name"))
    r = r.join(coverage, key, "left").fillna(0, subset=["n_food", "n_priced"])
    return r.withColumn("all_priced", (F.col("n_food") > 0) & (F.col("n_food") == F.col("n_priced")))


def price_percentile(rows: DataFrame, keys: list[str], day: str, base: str, min_obs: int = 30, days: int = 365) -> DataFrame:
    """Share of the last year's 7-day means at or below the latest one, per series (NULL with too few)."""
    last = rows.agg(F.max(day).alias("_max"))
    x = rows.where(F.col(base).isNotNull()).crossJoin(F.broadcast(last)).where(F.col(day) > F.date_sub("_max", days))  # one row
    now = x.groupBy(*keys).agg(F.max_by(base, day).alias("_now"))
    p = x.join(now, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg((F.col(base) <= F.col("_now")).cast("double")).alias("pct"))
    return p.select(*keys, F.when(F.col("_n") >= min_obs, F.col("pct")).alias("pct"))


def latest_rows(rows: DataFrame, keys: list[str], day: str, days: int = 7) -> DataFrame:
    """Last row of every series among the last `days` days of the table."""
    from .cleaning import keyed_first

    last = rows.agg(F.max(day).alias("_max"))
    x = rows.crossJoin(F.broadcast(last)).where(F.col(day) > F.date_sub("_max", days)).drop("_max")  # one row
    return keyed_first(x, keys, [F.col(day)], keep="last")


def ingredient_state(scored: DataFrame, pct: DataFrame, keys: list[str], item: str, pred: str = "pred", base: str = "base") -> DataFrame:
    """Per item: median forecast, percentile and base over its series; level, trend and score in -2 .. 2."""
    x = scored.join(pct, keys, "left")
    g = x.groupBy(item).agg(F.count(F.lit(1)).alias("n_series"))
    for c in (pred, "pct", base):
        g = g.join(exact_median(x, [item], c, c), item, "left")
    level = F.when(F.col("pct") <= 0.3, 1).when(F.col("pct") >= 0.7, -1).otherwise(0)
    trend = F.when(F.col(pred) <= -0.02, 1).when(F.col(pred) >= 0.02, -1).otherwise(0)
    return g.withColumn("level", level).withColumn("trend", trend).withColumn("score", level + trend)


# Reason texts by level and by trend.
LEVEL_TEXT = {1: "1년 중 싼 편", -1: "1년 중 비싼 편", 0: "평소 수준"}
TREND_DOWN, TREND_UP, TREND_FLAT = "4주 하락 예상(", "4주 상승 예상(", "4주 보합"


def reason_text(item: str = "ingredient", pred: str = "pred") -> Column:
    from ..functions.scalars import pick

    pct = F.rint(F.col(pred) * 100).cast("int")
    signed = F.concat(F.when(pct >= 0, "+").otherwise(""), pct.cast("string"), F.lit("%)"))
    trend = F.when(F.col("trend") == 1, F.concat(F.lit(TREND_DOWN), signed)).when(F.col("trend") == -1, F.concat(F.lit(TREND_UP), signed)).otherwise(TREND_FLAT)
    return F.concat(F.col(item), F.lit(" "), pick(LEVEL_TEXT, "level"), F.lit("·"), trend)


def scored_dishes(recipes: DataFrame, linked: DataFrame, state: DataFrame, seed: int = 0, key: str = "recipe_id") -> tuple[DataFrame, DataFrame]:
    """Every dish with its best recipe (mean ingredient score; random among the best), and the scored ingredients of recipes."""
    rec = recipes.where("is_menu")
    ing = (
        linked.where((F.col("class") == V.CLASS_FOOD) & (F.col("price_source") == V.SOURCE_FRESH))
        .join(rec.select(key), key, "left_semi")
        .groupBy(key, "price_item").agg(F.min_by("ingredient", "pos").alias("ingredient"), F.min("pos").alias("pos"))
        .join(state.select(F.col("item_nm").alias("price_item"), "score", "level", "trend", "pred", "pct"), "price_item")
    )
    rs = ing.groupBy(key).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_scored")).join(rec.select(key, "menu_name", *[c for c in ("name", "url", "time", "servings") if c in rec.columns]), key)
    return best_rows(rs.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))), "menu_name", ["score", "_h"]).drop("_h"), ing


def best_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key with the largest values of the (numeric) order columns, one after the other.

    Numeric maxima are kept in a hash table of the keys; a maximum of rows would have every task sort all its rows first.
    Only rows that share all maxima reach the last step.
    """
    left, out = cut_lineage(rows), rows.columns
    for c in order:
        top = cut_lineage(left.groupBy(F.col(key).alias("_k")).agg(F.max(c).alias("_top")))
        left = left.join(top, F.col(key).eqNullSafe(F.col("_k")) & F.col(c).eqNullSafe(F.col("_top"))).select(*out)
    return left.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*out), F.struct(*order)).alias("_r")).select("_r.*")


def rank_menus(recipes: DataFrame, linked: DataFrame, state: DataFrame, seed: int = 0, top: int = 30, key: str = "recipe_id") -> DataFrame:
    """The `top` best dishes ordered by score, scored items, random, with the reasons of their best recipe.

    Randomness is a hash of the recipe and the seed, so reruns agree.
    """
    best, ing = scored_dishes(recipes, linked, state, seed, key)
    h2 = F.xxhash64(F.lit(seed + 1), F.col(key))
    pick = best.orderBy(F.desc("score"), F.desc("n_scored"), h2, key).limit(top)
    # At most `top` rows from here on: the rank may use one window.
    pick = pick.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.desc("n_scored"), h2, key)))
    why = ing.join(F.broadcast(pick.select(key)), key, "left_semi").withColumn("_w", reason_text())
    w = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    why = why.withColumn("_i", F.row_number().over(w)).where("_i <= 3")
    why = ordered_concat(why, [key], "_w", "_i", " / ", "reason", distinct=False)
    return pick.join(why, key, "left")
