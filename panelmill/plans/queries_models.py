"""Model, evaluation and decision queries.

The forecast in the SQL-checked ones is a fixed rule (half of the last four weeks' change comes back), so every number
can be written in SQL; the learner queries fit MLlib models on the same rows and are checked by rows only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import pick, shown_probability, size_bin
from ..operators import decide as C
from ..operators import evaluate as E
from ..operators import gram as G
from ..operators import models as ML
from ..operators import windows as W
from ..session import cut_lineage
from .queries_windows import HIST, K, LAB, PRED, REGION_HIST, RK, RKS, history, predictions, r6, regional, s6
from .registry import query
from .roles import FACTS, OBS, SERIES

TRAIN = ("1995-01-01", "1999-12-03")
VALID = ("2000-01-01", "2000-12-31")
TEST = "2001-01-01"
NUM = ["r7", "r28", "r91", "yoy", "vol28", "dev_last", "ly_change", "n_obs28", "woy"]
CATS = ["item", "channel"]
KEEP = (0.5,)  # shares of the ranked features that the subset query keeps; the whole list is its "all"
TR_SQL, VA_SQL, TE_SQL = [f"date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in (TRAIN, VALID, (TEST, "2099-12-31"))]


def train_rows():
    return E.between_dates("date", *TRAIN)


def valid_rows():
    return E.between_dates("date", *VALID)


def test_rows():
    return E.between_dates("date", TEST)


def frame(spark, sf):
    return history(spark, sf).where("y IS NOT NULL").withColumn("woy", F.weekofyear("date").cast("double"))


# Predictions of three fixed rules plus the target: the stand-ins for three models.
THREE = f"{HIST}, p3 AS (SELECT {K}, date, y, base, r28, dev_last, -0.5 * r28 AS p1, -0.3 * r7 AS p2, exp(dev_last) - 1 AS p3 FROM hist WHERE y IS NOT NULL AND r28 IS NOT NULL AND r7 IS NOT NULL)"
MEAN3 = "((p1 + p2 + p3) / 3.0)"
MODELS = ["p1", "p2", "p3"]


def three(spark, sf):
    x = history(spark, sf).where("y IS NOT NULL AND r28 IS NOT NULL AND r7 IS NOT NULL")
    return x.withColumn("p1", F.col("r28") * -0.5).withColumn("p2", F.col("r7") * -0.3).withColumn("p3", F.exp("dev_last") - 1)


def metric_sql(y, p, band=0.01):
    return f"""count(*) AS n, round(sqrt(avg(({p} - {y}) * ({p} - {y}))), 6) AS rmse, round(avg(abs({p} - {y})), 6) AS mae, round(1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count({y})), 6) AS r2,
 round(avg(CASE WHEN abs({y}) > {band} THEN CASE WHEN sign({p}) = sign({y}) THEN 1.0 ELSE 0.0 END END), 6) AS direction_accuracy"""


MC = ["rmse", "mae", "r2", "direction_accuracy"]


@query("m13_fixed_split_counts", f"{HIST} SELECT channel, CASE WHEN {TR_SQL} THEN 'train' WHEN {TE_SQL} THEN 'test' END AS split, count(*) AS n, min(date) AS first, max(date) AS last FROM hist WHERE y IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    x = history(spark, sf).where("y IS NOT NULL").withColumn("split", E.split_label("date", TRAIN, TEST))
    return x.groupBy("channel", "split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("m13_walk_forward_metrics", f"{PRED} " + " UNION ALL ".join(f"SELECT {y} AS fold, count(*) FILTER (WHERE date BETWEEN DATE '1995-01-01' AND DATE '{y - 1}-12-01') AS n_train, count(*) FILTER (WHERE year(date) = {y}) AS n_test, round(avg(abs(p - y)) FILTER (WHERE year(date) = {y}), 6) AS mae FROM pv" for y in (1997, 1998, 1999, 2000, 2001)))
def _(spark, sf):
    x = predictions(spark, sf)
    folds = E.walk_forward_folds("date", 1997, 2001, "1995-01-01")
    # Folds overlap: every row names its folds, one pass counts them all.
    tags = F.explode(F.array(*[F.struct(F.lit(y).alias("fold"), tr.alias("tr"), te.alias("te")) for y, tr, te in folds]))
    x = x.select("p", "y", tags.alias("f")).where("f.tr OR f.te")
    return x.groupBy("f.fold").agg(F.count(F.when(F.col("f.tr"), 1)).alias("n_train"), F.count(F.when(F.col("f.te"), 1)).alias("n_test"), F.round(F.avg(F.when(F.col("f.te"), F.abs(F.col("p") - F.col("y")))), 6).alias("mae"))


# Ridge on two columns as SQL: centred sums with missing values at the training mean, solved by hand.
TWO = ["r28", "dev_last"]
PENALTY = 0.1


def ridge_sql(train: str, keys: str, name: str) -> str:
    """CTE <name>: keys, n, and the coefficients of the two-column ridge of the rows of a CTE."""
    on = " AND ".join(f"t.{k} IS NOT DISTINCT FROM m.{k}" for k in keys.split(", "))
    return f"""{name}_m AS (SELECT {keys}, count(*) AS n, avg(y) AS my, coalesce(avg(r28), 0) AS m1, coalesce(avg(dev_last), 0) AS m2 FROM {train} GROUP BY {keys}),
{name}_g AS (SELECT {", ".join("m." + k for k in keys.split(", "))}, any_value(n) AS n, any_value(my) AS my, any_value(m1) AS m1, any_value(m2) AS m2, sum(coalesce(r28 - m1, 0) ** 2) AS a, sum(coalesce(r28 - m1, 0) * coalesce(dev_last - m2, 0)) AS b,
  sum(coalesce(dev_last - m2, 0) ** 2) AS c, sum(coalesce(r28 - m1, 0) * y) AS p, sum(coalesce(dev_last - m2, 0) * y) AS q FROM {train} t JOIN {name}_m m ON {on} GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN a < 1e-18 THEN 0 WHEN c < 1e-18 THEN p / ((1 + {PENALTY}) * a) ELSE ((1 + {PENALTY}) * c * p - b * q) / ((1 + {PENALTY}) * a * (1 + {PENALTY}) * c - b * b) END AS b1,
  CASE WHEN c < 1e-18 THEN 0 WHEN a < 1e-18 THEN q / ((1 + {PENALTY}) * c) ELSE ((1 + {PENALTY}) * a * q - b * p) / ((1 + {PENALTY}) * a * (1 + {PENALTY}) * c - b * b) END AS b2 FROM {name}_g)"""


FORECAST = "my + b1 * coalesce(r28 - m1, 0) + b2 * coalesce(dev_last - m2, 0)"


@query("m13_walk_forward_refit", f"""{HIST}, t AS (SELECT f.fold, y, r28, dev_last FROM hist, (SELECT unnest(range(1997, 2002)) AS fold) f WHERE y IS NOT NULL AND date >= DATE '1995-01-01' AND date <= make_date(f.fold - 1, 12, 1)),
{ridge_sql('t', 'fold', 'w')}, z AS (SELECT w.fold, w.n AS n_train, y, {FORECAST} AS p FROM hist JOIN w ON year(date) = w.fold WHERE y IS NOT NULL)
SELECT fold, any_value(n_train) AS n_train, {metric_sql('y', 'p')} FROM z GROUP BY fold""")
def _(spark, sf):
    x = cut_lineage(history(spark, sf).where("y IS NOT NULL").select("date", "y", *TWO))
    p, models = G.walk_forward(x, "date", TWO, "y", 1997, 2001, "1995-01-01", penalty=PENALTY)
    return E.metrics(p, "y", "pred", ["fold"]).join(models.select("fold", "n_train"), "fold").select("fold", "n_train", "n", *r6(*MC))


@query("m09_ridge_per_group", f"""{HIST}, h AS (SELECT * FROM hist WHERE y IS NOT NULL), t AS (SELECT * FROM h WHERE {TR_SQL}), {ridge_sql('t', 'item, channel', 'w')},
z AS (SELECT h.item, h.channel, h.y, CASE WHEN w.n >= 100 THEN {FORECAST} ELSE -0.5 * r28 END AS p FROM h LEFT JOIN w ON w.item = h.item AND w.channel = h.channel WHERE {TE_SQL})
SELECT item, channel, {metric_sql('y', 'p')} FROM z WHERE p IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    x = cut_lineage(history(spark, sf).where("y IS NOT NULL").select(*SERIES, "date", "y", *TWO))
    p = G.ridge_by_group(x, SERIES, TWO, "y", train_rows(), test_rows(), PENALTY, F.col("r28") * -0.5, 100)
    return E.metrics(p, "y", "pred", SERIES).select(*SERIES, "n", *r6(*MC))


@query("m08_leave_year_out", f"""{HIST}, h AS (SELECT *, year(date) AS part FROM hist WHERE y IS NOT NULL), t AS (SELECT f.part, h.channel, y, r28, dev_last FROM h JOIN (SELECT DISTINCT part FROM h) f ON f.part <> h.part),
{ridge_sql('t', 'part, channel', 'w')}, z AS (SELECT h.part, h.channel, y, {FORECAST} AS p FROM h JOIN w ON w.part = h.part AND w.channel = h.channel) SELECT part AS year, channel, {metric_sql('y', 'p')} FROM z GROUP BY ALL""")
def _(spark, sf):
    x = cut_lineage(history(spark, sf).where("y IS NOT NULL").select("channel", "date", "y", *TWO).withColumn("year", F.year("date")))
    p = G.leave_part_out(x, "year", TWO, "y", PENALTY, ["channel"])
    return E.metrics(p, "y", "pred_oof", ["year", "channel"]).select("year", "channel", "n", *r6(*MC))


@query("m14_metrics", f"{PRED} SELECT channel, {metric_sql('y', 'p')} FROM pv GROUP BY ALL")
def _(spark, sf):
    return E.metrics(predictions(spark, sf), "y", "p", ["channel"]).select("channel", "n", *r6(*MC))


@query("m14_price_scale_metrics", f"""{PRED}, z AS (SELECT channel, y, p, base * (1 + y) AS f, base * (1 + p) AS h FROM pv)
SELECT channel, round(avg(abs(h - f)), 6) AS price_mae, round(sqrt(avg((h - f) * (h - f))), 6) AS price_rmse, round(1 - sum((h - f) * (h - f)) / (var_pop(f) * count(f)), 6) AS price_r2, round(100 * avg(abs((h - f) / f)), 6) AS mape,
 round(100 * (1 - avg(abs(p - y)) / avg(abs(y))), 6) AS gain_over_zero_pct FROM z GROUP BY ALL""")
def _(spark, sf):
    return E.price_metrics(predictions(spark, sf), "y", "p", "base", ["channel"]).select("channel", *r6("price_mae", "price_rmse", "price_r2", "mape", "gain_over_zero_pct"))


@query("m15_baselines", f"{HIST}, b AS (SELECT y, 0.0 AS zero, exp(coalesce(dev_last, 0)) - 1 AS today, exp(coalesce(ly_change, 0)) - 1 AS last_year FROM hist WHERE y IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{b}' AS baseline, {metric_sql('y', b)} FROM b" for b in ("zero", "today", "last_year")))
def _(spark, sf):
    b = E.baselines("dev_last", "ly_change")
    x = history(spark, sf).where("y IS NOT NULL").select("y", *[c.alias(n) for n, c in b.items()])
    x = x.unpivot(["y"], list(b), "baseline", "p")
    return E.metrics(x, "y", "p", ["baseline"]).select("baseline", "n", *r6(*MC))


BIN = lambda c: f"CASE WHEN abs({c}) > 0.01 AND abs({c}) <= 0.02 THEN '1~2%' WHEN abs({c}) > 0.02 AND abs({c}) <= 0.05 THEN '2~5%' WHEN abs({c}) > 0.05 AND abs({c}) <= 0.1 THEN '5~10%' WHEN abs({c}) > 0.1 AND abs({c}) <= 9.9 THEN '10% 이상' ELSE '보합 (±1% 이내)' END"


@query("m16_accuracy_by_size_bin", f"{PRED} SELECT {BIN('p')} AS size_bin, {metric_sql('y', 'p')} FROM pv GROUP BY ALL")
def _(spark, sf):
    return E.metrics(predictions(spark, sf).withColumn("size_bin", size_bin("p")), "y", "p", ["size_bin"]).select("size_bin", "n", *r6(*MC))


@query("m16_accuracy_by_quarter", f"{PRED} SELECT year(date) AS year, quarter(date) AS quarter, {metric_sql('y', 'p')} FROM pv GROUP BY ALL")
def _(spark, sf):
    x = predictions(spark, sf).withColumn("year", F.year("date").cast("long")).withColumn("quarter", F.quarter("date").cast("long"))
    return E.metrics(x, "y", "p", ["year", "quarter"]).select("year", "quarter", "n", *r6(*MC))


@query("m16_accuracy_by_item_pivot", f"{PRED} SELECT item, " + ", ".join(f"round(avg(CASE WHEN channel = '{c}' THEN abs(p - y) END), 6) AS mae_{c.lower()}" for c in "ANR") + " FROM pv GROUP BY ALL")
def _(spark, sf):
    x = predictions(spark, sf).withColumn("e", F.abs(F.col("p") - F.col("y")))
    w = x.groupBy("item").pivot("channel", ["A", "N", "R"]).agg(F.avg("e"))
    return w.select("item", *[F.round(c, 6).alias(f"mae_{c.lower()}") for c in "ANR"])


@query("m16_band_table", f"""{PRED}, z AS (SELECT y, p, unnest([0.01, 0.02, 0.03, 0.05]) AS band FROM pv), l AS (SELECT CAST(band AS DOUBLE) AS band, y, p, CASE WHEN y > band THEN 1 WHEN y < -band THEN -1 ELSE 0 END AS t, CASE WHEN p > band THEN 1 WHEN p < -band THEN -1 ELSE 0 END AS q FROM z)
SELECT band, count(*) AS n, round(avg(CASE WHEN t = 0 THEN 1.0 ELSE 0 END), 6) AS flat_share, round(avg(CASE WHEN t = q THEN 1.0 ELSE 0 END), 6) AS three_way, round(avg(CASE WHEN abs(y) > band THEN CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0 END END), 6) AS direction_accuracy,
 round(avg(CASE WHEN q <> 0 THEN 1.0 ELSE 0 END), 6) AS shown_share, round(avg(CASE WHEN q <> 0 THEN CASE WHEN q = t THEN 1.0 ELSE 0 END END), 6) AS shown_right FROM l GROUP BY ALL""")
def _(spark, sf):
    return E.band_table(predictions(spark, sf), "y", "p").select("band", "n", *r6("flat_share", "three_way", "direction_accuracy", "shown_share", "shown_right"))


@query("m16_threshold_table", f"""{PRED}, z AS (SELECT y, p, CAST(unnest([0.0, 0.02, 0.05, 0.10]) AS DOUBLE) AS threshold FROM pv)
SELECT threshold, round(avg(CASE WHEN abs(p) >= threshold THEN 1.0 ELSE 0 END), 6) AS shown_share, round(avg(CASE WHEN abs(p) >= threshold AND abs(y) > 0.02 THEN CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0 END END), 6) AS right_on_big,
 round(avg(CASE WHEN abs(p) >= threshold THEN CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0 END END), 6) AS right_on_shown, round(avg(CASE WHEN abs(p) >= threshold THEN CASE WHEN abs(y) > 0.02 THEN 1.0 ELSE 0 END END), 6) AS big_share FROM z GROUP BY ALL""")
def _(spark, sf):
    return E.threshold_table(predictions(spark, sf), "y", "p").select("threshold", *r6("shown_share", "right_on_big", "right_on_shown", "big_share"))


TIER = f"CASE WHEN ({LAB('p1')}) = ({LAB('p2')}) AND ({LAB('p1')}) = ({LAB('p3')}) THEN CASE WHEN ({LAB('m')}) <> 0 THEN 'high' ELSE 'medium' END ELSE 'low' END"


@query("m17_agreement_tiers", f"""{THREE}, m AS (SELECT *, {MEAN3} AS m FROM p3), t AS (SELECT *, {TIER} AS tier, {LAB('y')} AS t, {LAB('m')} AS l FROM m)
SELECT tier, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS share, round(avg(CASE WHEN l = t THEN 1.0 ELSE 0 END), 6) AS label_right, round(avg(CASE WHEN t <> 0 THEN CASE WHEN sign(m) = sign(y) THEN 1.0 ELSE 0 END END), 6) AS direction_accuracy,
 round(avg(CASE WHEN t <> 0 THEN 1.0 ELSE 0 END), 6) AS moved_share, round(avg(abs(m)), 6) AS mean_abs_pred, round(avg(abs(m - y)), 6) AS mae FROM t GROUP BY ALL""")
def _(spark, sf):
    return E.tier_table(three(spark, sf), "y", MODELS).select("tier", "n", *r6("share", "label_right", "direction_accuracy", "moved_share", "mean_abs_pred", "mae"))


@query("m17_two_of_three", f"""{THREE}, m AS (SELECT *, {MEAN3} AS m FROM p3), t AS (SELECT *, {LAB('y')} AS t, {LAB('m')} AS l, (({LAB('p1')}) = ({LAB('m')}))::INT + (({LAB('p2')}) = ({LAB('m')}))::INT + (({LAB('p3')}) = ({LAB('m')}))::INT >= 2 AS ag FROM m)
SELECT round(avg(CASE WHEN ag THEN 1.0 ELSE 0 END), 6) AS agree_share, round(avg(CASE WHEN ag AND l <> 0 THEN 1.0 ELSE 0 END), 6) AS high_share, round(avg(CASE WHEN ag THEN CASE WHEN l = t THEN 1.0 ELSE 0 END END), 6) AS agree_right, round(avg(CASE WHEN NOT ag THEN CASE WHEN l = t THEN 1.0 ELSE 0 END END), 6) AS differ_right FROM t""")
def _(spark, sf):
    return E.majority_agreement(three(spark, sf), "y", MODELS).select(*r6("agree_share", "high_share", "agree_right", "differ_right"))


@query("m18_error_shares_by_item", f"""{PRED} SELECT item, count(*) AS n, round(100 * sum((y - p) * (y - p)) / (SELECT sum((y - p) * (y - p)) FROM pv), 6) AS sse_pct, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2 FROM pv GROUP BY ALL""")
def _(spark, sf):
    return E.error_shares(predictions(spark, sf), ["item"], "y", "p").select("item", "n", *r6("sse_pct", "r2"))


@query("m18_error_shares_by_month", f"""{PRED} SELECT date_trunc('month', date)::DATE AS month, count(*) AS n, round(100 * sum((y - p) * (y - p)) / (SELECT sum((y - p) * (y - p)) FROM pv), 6) AS sse_pct, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0), 5) AS r2 FROM pv GROUP BY ALL""")
def _(spark, sf):
    x = predictions(spark, sf).withColumn("month", F.to_date(F.date_trunc("month", F.col("date"))))
    return E.error_shares(x, ["month"], "y", "p").select("month", "n", *r6("sse_pct"), F.round("r2", 5).alias("r2"))


@query("m18_common_move_ceiling", f"""WITH {REGION_HIST}, v AS (SELECT y, avg(y) OVER w AS c, count(y) OVER w AS n FROM rh WHERE y IS NOT NULL WINDOW w AS (PARTITION BY channel, date))
SELECT count(*) AS n, round(avg(n), 6) AS mean_regions, round(1 - avg((y - c) * (y - c)) / var_pop(y), 6) AS ceiling_r2, round(1 - avg(CASE WHEN n >= 3 THEN (y - c) * (y - c) END) / var_pop(CASE WHEN n >= 3 THEN y END), 6) AS ceiling_r2_many FROM v""")
def _(spark, sf):
    x = history(spark, sf, RK).where("y IS NOT NULL")
    return E.common_move_ceiling(x, ["channel"], "date", "y").select("n", *r6("mean_regions", "ceiling_r2", "ceiling_r2_many"))


@query("m19_error_correlation", f"{THREE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a} - y, {b} - y), 6) AS error_corr FROM p3" for a, b in (("p1", "p2"), ("p1", "p3"), ("p2", "p3"))))
def _(spark, sf):
    return E.error_correlation(three(spark, sf), "y", MODELS).select("a", "b", *r6("error_corr"))


HITS = f"{PRED}, h AS (SELECT *, abs(p) AS size, CASE WHEN sign(p) * y > 0.01 THEN 1.0 ELSE 0.0 END AS hit FROM pv WHERE abs(p) > 0.01)"
CAL = "cal AS (SELECT channel, regr_intercept(hit, ln(size)) AS a, regr_slope(hit, ln(size)) AS b, count(*) AS n FROM h GROUP BY ALL), qq AS (SELECT channel, quantile_cont(size, 0.99) AS q FROM h GROUP BY ALL), cp AS (SELECT channel, floor(avg(hit) * 100) / 100 AS cap FROM h JOIN qq USING (channel) WHERE size >= q GROUP BY ALL), fit AS (SELECT * FROM cal JOIN cp USING (channel))"


@query("m20_probability_fit", f"{HITS}, {CAL} SELECT channel, n, {s6('a', 'b', 'cap')} FROM fit")
def _(spark, sf):
    h = C.direction_hits(predictions(spark, sf), "y", "p")
    return C.fit_probability(h, ["channel"]).select("channel", "n", *r6("a", "b", "cap"))


@query("m20_shown_probability", f"""{HITS}, {CAL}, s AS (SELECT {K}, date, p, CASE WHEN abs(p) > 0.01 THEN least(round_even(greatest(0, least(1, a + b * ln(greatest(abs(p), 1e-6)))) / 0.01, 0) * 0.01, cap) END AS prob FROM pv LEFT JOIN fit USING (channel))
SELECT {K}, date, {s6('p')}, round(prob, 4) AS prob FROM s""")
def _(spark, sf):
    x = cut_lineage(predictions(spark, sf))
    fit = C.fit_probability(C.direction_hits(x, "y", "p"), ["channel"])
    return C.with_probability(x, "p", fit, ["channel"]).select(*SERIES, "date", *r6("p"), F.round("prob", 4).alias("prob"))


FIT1 = "f1 AS (SELECT regr_intercept(hit, ln(size)) AS a, regr_slope(hit, ln(size)) AS b FROM h), q1 AS (SELECT quantile_cont(size, 0.99) AS q FROM h), c1 AS (SELECT floor(avg(hit) * 100) / 100 AS cap FROM h, q1 WHERE size >= q)"


@query("m20_brier_and_bins", f"""{HITS}, {FIT1}, s AS (SELECT hit, greatest(0, least(1, a + b * ln(size))) AS raw, least(round_even(greatest(0, least(1, a + b * ln(size))) / 0.01, 0) * 0.01, cap) AS prob FROM h, f1, c1),
g AS (SELECT round(CASE WHEN prob <= 0.5 THEN 0.5 ELSE ceil((prob - 1e-9) / 0.05) * 0.05 END, 2) AS upto, count(*) AS n, avg(hit) AS hit_rate FROM s GROUP BY ALL)
SELECT upto, n, round(n / (SELECT count(*) FROM s), 6) AS share, round(hit_rate, 6) AS hit_rate, (SELECT round(avg((raw - hit) * (raw - hit)), 6) FROM s) AS brier FROM g""")
def _(spark, sf):
    h = cut_lineage(C.direction_hits(predictions(spark, sf), "y", "p").select("p", "y", "size", "hit"))
    fit = C.fit_probability(h)
    b = C.brier(h, "p", fit).select(F.round("brier", 6).alias("brier"))
    return C.calibration_bins(h, "p", fit).select("upto", "n", *r6("share", "hit_rate")).crossJoin(F.broadcast(b))  # one row


@query("m20_isotonic_and_logistic")
def _(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    h = cut_lineage(C.direction_hits(predictions(spark, sf), "y", "p").select(*SERIES, "date", "size", "hit"))
    lg = ML.fit_logistic(h).transform(h.withColumn("_ln", F.ln("size"))).withColumn("logit", vector_to_array("logit_prob")[1]).select(*SERIES, "date", "size", "hit", "logit")
    iso = ML.fit_isotonic(h).transform(VectorAssembler(inputCols=["size"], outputCol="_features").transform(lg))
    return iso.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("iso") - F.col("hit"), 2)).alias("isotonic_brier"), F.avg(F.pow(F.col("logit") - F.col("hit"), 2)).alias("logistic_brier"))


def _refit(back):
    cond = "" if back is None else f" AND (year(m.month) * 12 + month(m.month)) - (year(e) * 12 + month(e)) < {back}"
    return f"""{HITS}, mo AS (SELECT DISTINCT date_trunc('month', date)::DATE AS month FROM pv), k AS (SELECT ln(size) AS x, hit, CASE WHEN day(date + 28) = 1 THEN (date + 28)::DATE ELSE (date_trunc('month', date + 28) + INTERVAL 1 MONTH)::DATE END AS e FROM h)
SELECT m.month, count(*) AS n, round(regr_intercept(hit, x), 5) AS a, round(regr_slope(hit, x), 5) AS b FROM mo m JOIN k ON e <= m.month{cond} GROUP BY m.month HAVING count(*) > 1"""


@query("m21_monthly_refit_cumulative", _refit(None))
def _(spark, sf):
    x = C.monthly_refits(predictions(spark, sf), "date", "y", "p")
    return x.select("month", "n", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


@query("m21_monthly_refit_last_12", _refit(12))
def _(spark, sf):
    x = C.monthly_refits(predictions(spark, sf), "date", "y", "p", months_back=12)
    return x.select("month", "n", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


def _save(name, idle):
    return f"""SELECT channel, '{name}' AS against, round(100 * avg({idle} - c), 6) AS saving_pct, round(100 * avg({idle} - least(1, 1 + y)), 6) AS possible_pct, round(100 * sum({idle} - c) / sum({idle} - least(1, 1 + y)), 6) AS of_possible_pct, round(avg(({idle} - c) * base), 6) AS saving_per_kg
 FROM (SELECT *, CASE WHEN p > 0.01 THEN 1.0 WHEN p < -0.01 THEN 1 + y ELSE {idle} END AS c FROM pv) GROUP BY ALL"""


@query("m22_purchase_savings", f"{PRED} {_save('now', '1.0')} UNION ALL {_save('spread', '(1 + y)')}")
def _(spark, sf):
    return C.savings(predictions(spark, sf), "y", "p", "base", ["channel"]).select("channel", "against", *r6("saving_pct", "possible_pct", "of_possible_pct", "saving_per_kg"))


@query("m22_savings_above_probability", f"""{HITS}, {FIT1}, s AS (SELECT y, p, base, CASE WHEN abs(p) > 0.01 THEN least(round_even(greatest(0, least(1, a + b * ln(greatest(abs(p), 1e-6)))) / 0.01, 0) * 0.01, cap) END AS prob, CAST(unnest([0.4, 0.5, 0.6]) AS DOUBLE) AS threshold FROM pv, f1, c1),
c AS (SELECT threshold, base, 1 + y AS sp, least(1, 1 + y) AS be, CASE WHEN coalesce(prob > threshold, FALSE) AND p > 0.01 THEN 1.0 ELSE 1 + y END AS c FROM s)
SELECT threshold, round(100 * avg(sp - c), 6) AS saving_pct, round(100 * sum(sp - c) / sum(sp - be), 6) AS of_possible_pct, round(avg((sp - c) * base), 6) AS saving_per_kg FROM c GROUP BY ALL""")
def _(spark, sf):
    x = cut_lineage(predictions(spark, sf))
    x = C.with_probability(x, "p", C.fit_probability(C.direction_hits(x, "y", "p")))
    return C.savings_above(x, "y", "p", "base", "prob", (0.4, 0.5, 0.6)).select("threshold", *r6("saving_pct", "of_possible_pct", "saving_per_kg"))


@query("m23_wrong_card_losses", f"""{PRED}, x AS (SELECT *, CASE WHEN p > 0.01 AND y < -0.01 THEN 'bought_now_fell' WHEN p < -0.01 AND y > 0.01 THEN 'waited_rose' END AS cs FROM pv WHERE abs(p) > 0.01)
SELECT cs AS "case", count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM x), 6) AS share_pct, round(100 * avg(abs(y)), 6) AS loss_pct, round(avg(abs(y) * base), 6) AS loss_per_kg, round(100 * avg(CASE WHEN abs(y) > 0.1 THEN 1.0 ELSE 0 END), 6) AS over_10_pct FROM x WHERE cs IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return C.wrong_card_losses(predictions(spark, sf), "y", "p", "base").select("case", "n", *r6("share_pct", "loss_pct", "loss_per_kg", "over_10_pct"))


@query("m24_weekly_stocking_policy", f"""{PRED}, wk AS (SELECT {K}, year(date) AS year, weekofyear(date) AS w, arg_min(base, date) AS b, arg_min(p, date) AS p FROM pv GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY {K}, year ORDER BY w) AS i FROM wk),
RECURSIVE_PLACEHOLDER
""".replace("RECURSIVE_PLACEHOLDER", f"""z AS (SELECT *, count(*) OVER (PARTITION BY {K}, year) AS k, last_value(b) OVER (PARTITION BY {K}, year ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lb FROM o),
st AS (SELECT {K}, year, 0::BIGINT AS i, 2::DOUBLE AS s0, 2::DOUBLE AS s1, 2::DOUBLE AS s2, 0::DOUBLE AS c0, 0::DOUBLE AS c1, 0::DOUBLE AS c2 FROM (SELECT DISTINCT {K}, year FROM z)
 UNION ALL SELECT z.item, z.channel, z.year, z.i, s0 + greatest(0, 2 - s0) - 1, s1 + greatest(0, CASE WHEN p > 0.01 THEN 4 ELSE 2 END - s1) - 1, s2 + greatest(0, CASE WHEN p > 0.01 THEN 4 WHEN p < -0.01 THEN 1 ELSE 2 END - s2) - 1,
  c0 + greatest(0, 2 - s0) * b, c1 + greatest(0, CASE WHEN p > 0.01 THEN 4 ELSE 2 END - s1) * b, c2 + greatest(0, CASE WHEN p > 0.01 THEN 4 WHEN p < -0.01 THEN 1 ELSE 2 END - s2) * b
 FROM st JOIN z ON z.item = st.item AND z.channel = st.channel AND z.year = st.year AND z.i = st.i + 1),
e AS (SELECT st.*, z.k, z.lb FROM st JOIN z ON z.item = st.item AND z.channel = st.channel AND z.year = st.year AND z.i = st.i AND z.k = st.i)
SELECT {K}, year, k AS weeks, round(1000000 / c0 * c0, 2) AS plain, round(1000000 / c0 * (c1 - (s1 - s0) * lb), 2) AS early, round(1000000 / c0 * (c2 - (s2 - s0) * lb), 2) AS early_late,
 round(100 * (1 - (c1 - (s1 - s0) * lb) / c0), 5) AS early_saving_pct, round(100 * (1 - (c2 - (s2 - s0) * lb) / c0), 5) AS early_late_saving_pct FROM e""").replace("WITH obs", "WITH RECURSIVE obs", 1))
def _(spark, sf):
    x = C.stocking_policy(predictions(spark, sf), SERIES, "date", "base", "p")
    return x.select(*SERIES, F.col("year").cast("long").alias("year"), F.col("weeks").cast("long").alias("weeks"), *[F.round(c, 2).alias(c) for c in ("plain", "early", "early_late")],
                    *[F.round(c, 5).alias(c) for c in ("early_saving_pct", "early_late_saving_pct")])


@query("m25_forecast_cards", f"""{HITS}, {CAL}, lt AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY date DESC) AS r FROM pv),
s AS (SELECT lt.*, CASE WHEN abs(p) > 0.01 THEN least(round_even(greatest(0, least(1, a + b * ln(greatest(abs(p), 1e-6)))) / 0.01, 0) * 0.01, cap) END AS prob FROM lt LEFT JOIN fit USING (channel) WHERE r = 1)
SELECT {K}, date, round(base * (1 + p), 6) AS price_forecast, {LAB('p', 0.01)} AS label, CASE WHEN prob IS NULL THEN '큰 변화 없을 것으로 예상' WHEN prob <= 0.5 THEN '신뢰성이 낮으니 판단에 주의하세요' ELSE '4주 뒤 평균이 지금보다 1% 넘게 ' || CASE WHEN p > 0 THEN '오를' ELSE '내릴' END || ' 확률 약 ' || CAST(CAST(round(prob * 100) AS INT) AS VARCHAR) || '%' END AS card,
 (r7 IS NULL)::INT + (r28 IS NULL)::INT + (r91 IS NULL)::INT + (yoy IS NULL)::INT + (ly_change IS NULL)::INT >= 4 AS short_history FROM s""")
def _(spark, sf):
    from ..operators.cleaning import keyed_first

    x = cut_lineage(predictions(spark, sf))
    fit = C.fit_probability(C.direction_hits(x, "y", "p"), ["channel"])
    latest = keyed_first(x, SERIES, [F.col("date")], keep="last")
    y = C.forecast_cards(C.with_probability(latest, "p", fit, ["channel"]), "base", "p", "prob", ["r7", "r28", "r91", "yoy", "ly_change"])
    return y.select(*SERIES, "date", *r6("price_forecast"), "label", "card", "short_history")


# ---- learners (rows-only checks)

def _scored(spark, sf, kind, **kw):
    x = ML.train_and_score(frame(spark, sf), kind, NUM, CATS, "y", train_rows(), test_rows(), **kw)
    return x.select(*SERIES, "date", "y", F.round("pred", 6).alias("pred"))


@query("m01_boosted_regressor")
def _(spark, sf):
    return _scored(spark, sf, "boosted")


@query("m02_forest_regressor")
def _(spark, sf):
    return _scored(spark, sf, "forest")


@query("m03_ridge_regressor")
def _(spark, sf):
    return _scored(spark, sf, "ridge")


@query("m04_spline_ridge")
def _(spark, sf):
    x, names = ML.spline_columns(frame(spark, sf), NUM, train_rows())
    y = ML.train_and_score(x, "ridge", names, CATS, "y", train_rows(), test_rows(), reg=0.01)
    return y.select(*SERIES, "date", "y", F.round("pred", 6).alias("pred"))


@query("m05_direction_classifiers")
def _(spark, sf):
    x = ML.classify(frame(spark, sf), NUM, CATS, "y", train_rows(), test_rows())
    t = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double"))
    return x.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), t("three_way", "label").alias("three_way_right"), t("ordinal", "label").alias("ordinal_right"), F.avg((F.col("up") == (F.col("y") > 0).cast("int")).cast("double")).alias("binary_right"))


@query("m06_robust_losses")
def _(spark, sf):
    x = cut_lineage(frame(spark, sf))
    a, b = ML.side_by_side(spark, [lambda k=k, kw=kw: ML.train_and_score(x, k, NUM, CATS, "y", train_rows(), test_rows(), **kw) for k, kw in (("boosted", {"loss": "absolute"}), ("huber", {}))])
    a = a.select(*SERIES, "date", "y", F.round("pred", 6).alias("absolute"))
    return a.join(b.select(*SERIES, "date", F.round("pred", 6).alias("huber")), [*SERIES, "date"])


@query("m07_blend_gram_sums", f"{THREE} SELECT " + ", ".join(f"round(sum({MODELS[i]} * {MODELS[j]}), 5) AS g{i}_{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"round(sum({m} * y), 5) AS b{i}" for i, m in enumerate(MODELS)) + " FROM p3")
def _(spark, sf):
    g = E.gram_sums(three(spark, sf), "y", MODELS)
    return g.select(*[F.round(c, 5).alias(c) for c in g.columns])


@query("m07_equal_mean_metrics", f"{THREE} SELECT channel, {metric_sql('y', MEAN3)} FROM p3 GROUP BY ALL")
def _(spark, sf):
    x = three(spark, sf).withColumn("m", (F.col("p1") + F.col("p2") + F.col("p3")) / 3.0)
    return E.metrics(x, "y", "m", ["channel"]).select("channel", "n", *r6(*MC))


@query("m07_blend_metrics")
def _(spark, sf):
    from functools import reduce

    x = cut_lineage(three(spark, sf))
    w = E.blend_weights(x.where(valid_rows()), "y", MODELS)
    blend = reduce(lambda a, b: a + b, [F.col(m) * F.lit(v) for m, v in zip(MODELS, w)])
    t = x.where(test_rows()).withColumn("blend", blend)
    meta = ML.fit(x.where(valid_rows()), "ridge", MODELS, [], "y", "meta", reg=0.001)
    t = ML.score(meta, t)
    return E.metrics(t, "y", "blend").withColumn("model", F.lit("weights")).unionByName(E.metrics(t, "y", "meta").withColumn("model", F.lit("ridge_meta")))


@query("m08_two_stage_out_of_year")
def _(spark, sf):
    nat = history(spark, sf, ["channel"]).where("y IS NOT NULL").withColumn("woy", F.weekofyear("date").cast("double"))
    oof = ML.out_of_year(nat, "ridge", NUM, ["channel"], "y", "date", [r[0] for r in nat.select(F.year("date").alias("year")).distinct().orderBy("year").collect()]).select("channel", "date", F.round("pred_oof", 6).alias("nat_pred"))
    return history(spark, sf, RK).where("y IS NOT NULL").join(oof, ["channel", "date"], "left").select(*RK, "date", "y", "nat_pred")


@query("m09_models_per_group")
def _(spark, sf):
    x = frame(spark, sf).withColumn("fallback", F.col("r28") * -0.5)
    y = ML.per_group(x, "ridge", NUM, CATS, "y", "channel", train_rows(), test_rows(), "fallback")
    return y.select(*SERIES, "date", "y", F.round("pred", 6).alias("pred"))


@query("m10_importance")
def _(spark, sf):
    x = cut_lineage(ML.model_rows(frame(spark, sf).where(train_rows()), NUM, CATS))
    return ML.importances(ML.fit(x, "forest", NUM, CATS, "y"), NUM, CATS, spark)


@query("m10_permutation_importance")
def _(spark, sf):
    from functools import reduce

    x = cut_lineage(ML.model_rows(frame(spark, sf), NUM, CATS))
    m = ML.fit(x.where(train_rows()), "ridge", NUM, CATS, "y")
    te = x.where(test_rows())
    parts = [E.metrics(ML.score(m, te), "y", "pred").withColumn("shuffled", F.lit("none"))]
    for c in NUM:
        parts.append(E.metrics(ML.score(m, E.permute_column(te, [*SERIES, "date"], c)), "y", "pred").withColumn("shuffled", F.lit(c)))
    return reduce(lambda a, b: a.unionByName(b), parts).select("shuffled", "n", *r6("rmse", "r2"))


@query("m10_direction_check", f"""{HIST}, d AS (SELECT item, r28 - avg(r28) OVER (PARTITION BY item) AS xw, y - avg(y) OVER (PARTITION BY item) AS yw FROM hist WHERE y IS NOT NULL AND r28 IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY round(xw, 9)) + (count(*) OVER (PARTITION BY round(xw, 9)) - 1) / 2.0 AS rx, rank() OVER (ORDER BY round(yw, 9)) + (count(*) OVER (PARTITION BY round(yw, 9)) - 1) / 2.0 AS ry FROM d)
SELECT 'r28' AS feature, round(corr(rx, ry), 5) AS rho, CASE WHEN abs(corr(rx, ry)) < 0.1 THEN 'none' WHEN corr(rx, ry) < 0 THEN 'as_expected' ELSE 'opposite' END AS verdict FROM r""")
def _(spark, sf):
    from ..operators.profile import spearman_pairs

    x = cut_lineage(history(spark, sf).where("y IS NOT NULL AND r28 IS NOT NULL").select("item", "r28", "y"))
    x = W.group_mean(W.group_mean(x, ["item"], "r28", "mx"), ["item"], "y", "my")
    x = x.select(F.round(F.col("r28") - F.col("mx"), 9).alias("xw"), F.round(F.col("y") - F.col("my"), 9).alias("yw"))
    r = spearman_pairs(x, [("xw", "yw")])
    v = F.when(F.abs("rho") < 0.1, "none").when(F.col("rho") < 0, "as_expected").otherwise("opposite")
    return r.select(F.lit("r28").alias("feature"), F.round("rho", 5).alias("rho"), v.alias("verdict"))


def _trend_sql(c):
    return f"""SELECT '{c}' AS "column", count(*) AS days, round(corr(rv, rd), 6) AS rho, abs(corr(rv, rd)) >= 0.8 AS trending FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rv, rank() OVER (ORDER BY date) AS rd FROM dm WHERE {c} IS NOT NULL)"""


@query("m10_time_trend", f"{HIST}, dm AS (SELECT date, {', '.join(f'round(avg({c}), 9) AS {c}' for c in NUM[:-1])} FROM hist WHERE y IS NOT NULL AND {TR_SQL} GROUP BY date) " + " UNION ALL ".join(_trend_sql(c) for c in NUM[:-1]))
def _(spark, sf):
    from ..operators.profile import time_trends

    x = history(spark, sf).where("y IS NOT NULL").where(train_rows())
    return time_trends(x, "date", NUM[:-1]).select("column", "days", F.round("rho", 6).alias("rho"), "trending")


FEATURE_GROUPS = {"momentum": ["r7", "r28", "r91"], "season": ["yoy", "ly_change", "woy"], "level": ["dev_last"], "survey": ["vol28", "n_obs28"]}
_GROUP_OF = {c: g for g, cols in FEATURE_GROUPS.items() for c in cols}


@query("m10_group_share", f"""{HIST}, im AS ({" UNION ALL ".join(f"SELECT '{_GROUP_OF[c]}' AS g, abs(corr({c}, y)) AS i FROM hist WHERE {c} IS NOT NULL AND y IS NOT NULL" for c in NUM[:-1])})
SELECT g AS "group", count(*) AS n_columns, round(sum(coalesce(i, 0)), 6) AS importance, round(100 * sum(coalesce(i, 0)) / (SELECT sum(i) FROM im), 5) AS share FROM im GROUP BY g""")
def _(spark, sf):
    x = history(spark, sf).where("y IS NOT NULL")
    row = x.agg(*[F.abs(F.corr(c, "y")).alias(c) for c in NUM[:-1]])
    g = E.group_shares(row.unpivot([], NUM[:-1], "column", "importance"), pick(_GROUP_OF, "column"))
    return g.select("group", "n_columns", F.round("importance", 6).alias("importance"), F.round("share", 5).alias("share"))


@query("m10_group_permutation")
def _(spark, sf):
    from functools import reduce

    x = cut_lineage(ML.model_rows(frame(spark, sf), NUM, CATS))
    m = ML.fit(x.where(train_rows()), "ridge", NUM, CATS, "y")
    te = cut_lineage(x.where(test_rows()))
    parts = [E.metrics(ML.score(m, te), "y", "pred").withColumn("shuffled", F.lit("none"))]
    for g, cols in FEATURE_GROUPS.items():
        parts.append(E.metrics(ML.score(m, E.permute_column(te, [*SERIES, "date"], cols)), "y", "pred").withColumn("shuffled", F.lit(g)))
    return reduce(lambda a, b: a.unionByName(b), parts).select("shuffled", "n", *r6("rmse", "r2"))


@query("m11_ablation")
def _(spark, sf):
    return ML.ablation(frame(spark, sf), "boosted", NUM, CATS, "y", train_rows(), valid_rows(), {"without_yoy": ["yoy", "ly_change"]})


@query("m12_parameter_search")
def _(spark, sf):
    n, rate = ML.BOOST["trees"], ML.BOOST["rate"]
    options = [{**o, **r} for o in ML.grid(depth=[5, 6, 7], leaf=[20, 100]) for r in ({"trees": n, "rate": rate}, {"trees": 2 * n, "rate": rate / 2})]
    return ML.search_and_verify(frame(spark, sf), "boosted", NUM, CATS, "y", train_rows(), valid_rows(), options)


@query("m26_saved_model_rescored", f"{HIST} SELECT channel, count(*) AS n, CAST(0 AS DOUBLE) AS largest_gap FROM hist WHERE y IS NOT NULL AND {TE_SQL} GROUP BY channel")
def _(spark, sf):
    import uuid

    from ..session import checkpoint_folder

    x = cut_lineage(ML.model_rows(frame(spark, sf), NUM, CATS))
    m = ML.fit(x.where(train_rows()), "ridge", NUM, CATS, "y")
    path = f"{checkpoint_folder(spark)}/model-{uuid.uuid4().hex}"
    ML.save(m, path)
    te = x.where(test_rows())
    a = ML.score(m, te).select(*SERIES, "date", F.col("pred").alias("p1"))
    b = ML.score(ML.load(path), te).select(*SERIES, "date", F.col("pred").alias("p2"))
    return a.join(b, [*SERIES, "date"]).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p1") - F.col("p2"))).alias("largest_gap"))


@query("m27_feature_subset")
def _(spark, sf):
    from functools import reduce

    x = cut_lineage(frame(spark, sf))
    rows = cut_lineage(ML.model_rows(x.where(train_rows()), NUM, CATS))

    def metrics(name, cols):
        return E.metrics(ML.train_and_score(x, "ridge", cols, CATS, "y", train_rows(), test_rows()), "y", "pred").withColumn("features", F.lit(name))

    lists = {"all": NUM, "price_only": ["r28", "dev_last"]}
    model, *parts = ML.side_by_side(spark, [ML.fitting(rows, "boosted", NUM, CATS, "y"), *[lambda a=a: metrics(*a) for a in lists.items()]])
    ranked = ML.importances(model, NUM, CATS, spark)
    rank = [r["column"] for r in ranked.where(F.col("column").isin(NUM)).orderBy(F.desc("importance"), "column").collect()]  # one row a feature
    parts += [metrics(f"top_{round(k * 100)}_pct", rank[: max(1, round(len(rank) * k))]) for k in KEEP]
    return reduce(lambda a, b: a.unionByName(b), parts).select("features", "n", *r6(*MC))


@query("m28_seed_stability")
def _(spark, sf):
    x = ML.seeds_and_scores(frame(spark, sf), "boosted", NUM, CATS, "y", train_rows(), test_rows())
    return E.seed_agreement(x, {str(s): f"p{s}" for s in ML.SEEDS})
