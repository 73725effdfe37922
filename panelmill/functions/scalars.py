"""Column expressions shared by all operators. Missing is always NULL, never NaN or infinity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-width of the "no real move" band, and the value given to rows outside a feature's scope.
BAND = 0.01
OUT_OF_SCOPE = -1e9


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_hash(*keys) -> Column:
    """A number equal for equal keys, to stand before them in sorts: Spark compares eight bytes of the first sort column, and
    where that is a text that all rows share, each comparison would walk through the keys."""
    return F.xxhash64(*[as_col(k) for k in keys])


def parse_number(c) -> Column:
    """Lenient number: drop commas and outer blanks; missing ("", "-", "None", "nan") and unreadable texts become NULL.

    The cast trims and gives NULL or NaN for the missing texts by itself. The expression stands several times in the
    plan, so it holds no pattern and no list: a table of stations has a dozen of them in every row.
    """
    return finite(F.replace(as_col(c).cast("string"), F.lit(","), F.lit("")).try_cast("double"))


def parse_date(c, pattern: str = "yyyyMMdd") -> Column:
    """Strict pattern, NULL where the text does not follow it. Months without a day land on the first."""
    text = F.trim(as_col(c).cast("string"))
    if "d" not in pattern:
        text, pattern = F.concat(text, F.lit("01" if pattern.endswith("M") and "." not in pattern else ".01")), (
            pattern + ("dd" if "." not in pattern else ".dd")
        )
    return F.to_date(F.try_to_timestamp(text, F.lit(pattern)))


def date_from_parts(y, m, d) -> Column:
    """yyyy, m, d as texts with or without leading zeros."""
    text = F.concat_ws("-", as_col(y), F.lpad(as_col(m), 2, "0"), F.lpad(as_col(d), 2, "0"))
    ok = as_col(y).isNotNull() & as_col(m).isNotNull() & as_col(d).isNotNull()
    return F.when(ok, F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def safe_div(a, b) -> Column:
    """a / b; NULL where b is 0."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def safe_ln(c) -> Column:
    """ln of positive numbers, NULL for the rest."""
    c = as_col(c)
    return F.when(c > 0, F.ln(c))


def log_ratio(a, b) -> Column:
    return safe_ln(safe_div(a, b))


def finite(c) -> Column:
    """NaN and both infinities become NULL (NaN is above infinity in comparisons)."""
    c = as_col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def day_number(c) -> Column:
    return F.unix_date(as_col(c))


def weekday(c) -> Column:
    """Monday = 0."""
    return F.weekday(as_col(c))


def iso_week(c) -> Column:
    return F.weekofyear(as_col(c))


def is_weekend(c) -> Column:
    return F.weekday(as_col(c)) >= 5


def month_end(c, plus_days: int = 0) -> Column:
    return F.date_add(F.last_day(as_col(c)), plus_days)


def quarter_end(period, plus_days: int = 0) -> Column:
    """period text YYYYQQ (or YYYYQ) -> last day of the quarter, plus a lag."""
    p = as_col(period)
    q = F.substring(p, 5, 2).cast("int")
    first = F.make_date(F.substring(p, 1, 4).cast("int"), q * 3, F.lit(1))
    return F.date_add(F.last_day(first), plus_days)


def year_release(year, month: int = 3, day: int = 1) -> Column:
    """A year's figure is public on the given day of the next year."""
    return F.make_date(as_col(year).cast("int") + 1, F.lit(month), F.lit(day))


def previous_day_midnight(ts) -> Column:
    """Readings stamped 24:00 belong to the day that ends."""
    return F.to_date(as_col(ts) - F.expr("INTERVAL 1 MINUTE"))


def mean_of_available(cols) -> Column:
    """Row mean over the non-missing inputs."""
    cols = [as_col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return safe_div(total, n)


def direction(c, band: float = BAND) -> Column:
    """+1 / 0 / -1 with a dead band; missing counts as 0."""
    c = as_col(c)
    return F.when(c > band, 1).when(c < -band, -1).otherwise(0)


# Fixed values: (lower, upper] bounds of the predicted-size bins and the flat bin's name.
SIZE_BINS = ((0.01, 0.02, "1~2%"), (0.02, 0.05, "2~5%"), (0.05, 0.10, "5~10%"), (0.10, 9.9, "10% 이상"))
FLAT_BIN = "보합 (±1% 이내)"


def size_bin(c, bins=SIZE_BINS, flat: str = FLAT_BIN) -> Column:
    a = F.abs(as_col(c))
    out = None
    for lo, hi, name in bins:
        cond = (a > lo) & (a <= hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(flat)


def shown_probability(p, a: float | Column, b: float | Column, cap: float | Column, step: float = 0.01) -> Column:
    """a + b ln|p| held in [0, 1], rounded half-even to the step, capped; NULL inside the band."""
    p = as_col(p)
    a, b, cap = [x if isinstance(x, Column) else F.lit(x) for x in (a, b, cap)]
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a + b * F.ln(F.greatest(F.abs(p), F.lit(1e-6)))))
    return F.when(F.abs(p) > BAND, F.least(F.rint(raw / F.lit(step)) * F.lit(step), cap))


# The three card sentences.
CARD_FLAT = "큰 변화 없을 것으로 예상"
CARD_CAUTION = "신뢰성이 낮으니 판단에 주의하세요"
CARD_MOVE = "4주 뒤 평균이 지금보다 1% 넘게 {0} 확률 약 {1}%"
CARD_UP, CARD_DOWN = "오를", "내릴"


def probability_text(prob, p) -> Column:
    prob, p = as_col(prob), as_col(p)
    word = F.when(p > 0, CARD_UP).otherwise(CARD_DOWN)
    pct = F.rint(prob * 100).cast("int").cast("string")
    head, tail = CARD_MOVE.split("{0}")
    mid, end = tail.split("{1}")
    return (
        F.when(prob.isNull(), CARD_FLAT)
        .when(prob <= 0.5, CARD_CAUTION)
        .otherwise(F.concat(F.lit(head), word, F.lit(mid), pct, F.lit(end)))
    )


def pick(pairs: dict, key) -> Column:
    """Small fixed mapping as a when-chain (dict lookup); NULL when the key is not listed."""
    key, out = as_col(key), None
    for k, v in pairs.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out if out is not None else F.lit(None)
