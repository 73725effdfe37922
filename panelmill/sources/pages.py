"""Recipe pages to records, and keyword lists to one row per id. Patterns and layout names are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import ordered_concat

# Where a page keeps its parts.
LD_JSON = r'(?s)<script type="application/ld\+json">(.*?)</script>'
INFO = ("view2_summary_info1", "view2_summary_info2", "view2_summary_info3")
INGREDIENT = r'(?s)<div class="ingre_list_name">\s*<a[^>]*>\s*([^<]+?)\s*</a>.*?<span class="ingre_list_ea">([^<]*)</span>'
DESCRIPTION = r'<meta name="description" content="([^"]*)"'
INGREDIENT_TEXT = r"(?si)재료[^:：]*[:：]\s*(.+?)(?:■\s*만들|만드는\s*법|만들기|조리\s*방법|how to|\d\s*\.\.\.)"
HITS = (r'class="hit font_num">\s*([\d,]+)', r"조회수\s*([\d,]+)")
RATING, REVIEWS = r'class="hit_rv_pt">([\d.]+)', r'class="hit_rv_ea">\((\d+)\)'

LD_SCHEMA = (
    "`@type` string, name string, datePublished string, recipeIngredient array<string>, "
    "aggregateRating struct<ratingValue string, reviewCount string>"
)


def _first(text, pattern: str, group: int = 1) -> Column:
    """First match or NULL (an empty match stays empty)."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def parse_pages(pages: DataFrame, key: str, html: str, url_base: str = "") -> DataFrame:
    """One record per page: structured data where present, page markup as fallback, whole text throughout."""
    h = F.col(html)
    blocks = F.transform(F.regexp_extract_all(h, F.lit(LD_JSON), F.lit(1)), lambda b: F.from_json(b, LD_SCHEMA, {"allowUnquotedControlChars": "true"}))
    recipes = F.filter(blocks, lambda b: b["@type"] == "Recipe")
    ld = F.element_at(F.when(F.size(recipes) > 0, recipes), -1)
    names = F.regexp_extract_all(h, F.lit(INGREDIENT), F.lit(1))
    amounts = F.regexp_extract_all(h, F.lit(INGREDIENT), F.lit(2))
    listed = F.transform(F.arrays_zip(names.alias("n"), amounts.alias("a")), lambda x: F.array(F.trim(x["n"]), F.trim(x["a"])))
    from_ld = F.transform(F.coalesce(F.col("_ld.recipeIngredient"), F.array().cast("array<string>")), lambda s: F.array(F.trim(s), F.lit("")))
    num = lambda c: F.regexp_replace(c, ",", "").try_cast("long")
    out = pages.select(key, h.alias("_h"), ld.alias("_ld"), listed.alias("_listed"))
    out = out.withColumn("_ing", F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(from_ld))
    desc = _first(F.col("_h"), DESCRIPTION)
    text = F.when(F.size("_ing") == 0, F.trim(_first(desc, INGREDIENT_TEXT)))
    rating = F.col("_ld.aggregateRating")
    return out.select(
        key, F.trim(F.coalesce(F.col("_ld.name"), F.lit(""))).alias("name"), F.concat(F.lit(url_base), F.col(key).cast("string")).alias("url"),
        *[_first(F.col("_h"), i + '">([^<]*)').alias(n) for i, n in zip(INFO, ("servings", "time", "difficulty"))],
        num(F.coalesce(*[_first(F.col("_h"), p) for p in HITS])).alias("views"),
        F.coalesce(rating["ratingValue"], _first(F.col("_h"), RATING)).alias("rating"),
        F.coalesce(rating["reviewCount"], _first(F.col("_h"), REVIEWS)).alias("reviews"),
        F.col("_ld.datePublished").alias("published"), F.size("_ing").alias("n_ingredients"),
        F.to_json("_ing").alias("ingredients"), text.alias("ingredients_text"),
    )


def ids_by_keyword(lists: DataFrame, key: str, keyword: str, page: str, order: str) -> DataFrame:
    """One row per id: distinct keywords in order of first sight, joined by ';', and the smallest page."""
    words = ordered_concat(lists, [key], keyword, order, ";", "keywords")
    return words.join(lists.groupBy(key).agg(F.min(page).alias("first_page")), key)


def page_parts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title, language, link and paragraph counts, and visible text length of any page."""
    h = F.col(html)
    body = F.regexp_replace(h, r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]+>", " ")
    return pages.select(
        key, _first(h, r"(?s)<title>(.*?)</title>").alias("title"), _first(h, r'<html lang="([^"]*)"').alias("lang"),
        F.size(F.regexp_extract_all(h, F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("n_links"),
        F.size(F.regexp_extract_all(h, F.lit(r"<p>"), F.lit(0))).alias("n_paragraphs"),
        F.length(F.trim(F.regexp_replace(body, r"\s+", " "))).alias("n_text"),
    )
