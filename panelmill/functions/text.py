"""Ingredient and dish-name expressions. Vocabularies are parameters; the defaults are the fixed recipe vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .scalars import as_col


def strip_all(c) -> Column:
    return F.regexp_replace(as_col(c), r"(?U)^\s+|\s+$", "")


def clean_ingredient(c, brackets: str = V.ING_BRACKETS, tail: str = V.ING_TAIL, head: str = V.ING_HEAD) -> Column:
    """Brackets away, trailing amount words away, leading state words away, then all spaces."""
    x = strip_all(F.regexp_replace(as_col(c), brackets, ""))
    for pattern in (tail, head, r"(?U)\s+"):
        x = F.regexp_replace(x, pattern, "")
    return x


def unify(c, pairs=V.SAME_DISH) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, as_col(c))


def _pick(text: Column, dishes, not_dishes, noise: str) -> Column:
    """First token that ends in a dish word, joined with the token before or after it where those belong to the name."""
    plain = lambda w: F.regexp_replace(w, noise, "")
    tokens = F.filter(F.split(text, "(?U)" + V.TITLE_SPLIT), lambda w: (w != "") & ~w.rlike(r"(?U)^\d+$"))
    cores = F.transform(tokens, plain)
    ends = "(?:" + "|".join(dishes) + ")$"

    def name(core: Column, i: Column) -> Column:
        prev = F.when(i > 0, F.get(cores, i - 1))
        nxt = F.get(cores, i + 1)
        joined = (
            F.when(core.isin(*dishes) & (F.length(prev) >= 2), F.concat(prev, core))
            .when(nxt.isin(*dishes), F.concat(core, nxt)).otherwise(core)
        )
        ok = (F.length(core) >= 2) & core.rlike(ends) & ~core.isin(*not_dishes)
        return F.when(ok, joined)

    found = F.filter(F.transform(cores, name), lambda x: x.isNotNull())
    return F.get(found, F.lit(0))


def menu_name(c, dishes=V.DISH_WORDS, not_dishes=V.NOT_DISH, noise: str = V.TITLE_NOISE) -> Column:
    """Dish name of a recipe title: quoted spans first, then the body without asides, then the whole title."""
    t = as_col(c)
    quoted = F.regexp_extract_all(t, F.lit(V.TITLE_QUOTED), F.lit(1))
    from_quotes = F.get(F.filter(F.transform(quoted, lambda q: _pick(q, dishes, not_dishes, noise)), lambda x: x.isNotNull()), F.lit(0))
    body = F.regexp_replace(t, V.TITLE_ASIDE, " ")
    return F.coalesce(from_quotes, _pick(body, dishes, not_dishes, noise), _pick(t, dishes, not_dishes, noise))
