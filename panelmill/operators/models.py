"""Regressors and classifiers on MLlib: fitted by Spark over all training rows, scored as DataFrame columns.

Not in MLlib, and stated as gaps: monotone constraints, native missing values (a sentinel below every real value
takes their place), leaf-wise growth, extra-trees thresholds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import OUT_OF_SCOPE, direction
from ..session import checkpoint_folder, cut_lineage
from . import boosting
from .cleaning import apply_scope, clip_to_train

# Learner settings in use (trees, learning rate, row and column share, depth, rows of a leaf, seed). A depth
# of 6 stands for 63 leaves; forests grow until their leaves are small, at most as deep as MLlib goes.
BOOST = {"trees": 600, "rate": 0.05, "rows": 0.8, "columns": 0.8, "depth": 6, "leaf": 20, "seed": 42}
FOREST = {"trees": 100, "rows": 0.8, "columns": 0.5, "depth": 30, "leaf": 50}
SEEDS = (42, 43, 44)
#: Fits that run side by side, all settings of the parameter search; each holds the statistics of one tree level on the driver.
SIDE_BY_SIDE = 12
#: Training rows for which a fit has one partition: its thousands of small jobs should not be mostly scheduling.
ROWS_A_PARTITION = 50_000


def side_by_side(spark, jobs: list[Callable], at_most: int = SIDE_BY_SIDE) -> list:
    """Results of independent fits, in their order. A fit is a chain of small jobs that leaves most cores idle; threads
    share the session, and the cluster's scheduler interleaves their jobs."""
    with ThreadPool(max(1, min(at_most, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)


def few_partitions(df: DataFrame) -> DataFrame:
    """A stored frame in as many partitions as its rows need, never more than it has."""
    return df.coalesce(max(1, -(-df.count() // ROWS_A_PARTITION)))


def model_rows(df: DataFrame, num: list[str], cats: list[str]) -> DataFrame:
    """Numeric columns as double with the sentinel for missing, scope applied, categories as text."""
    out = apply_scope(df)
    return out.withColumns({
        **{c: F.coalesce(F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")), F.lit(OUT_OF_SCOPE)) for c in num},
        **{c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cats},
    })


def _stages(num, cats, linear=False):
    """Indexers and assembler. Linear learners get missing numbers as the training mean, the training min-max scale and
    one-hot categories (unseen ones all zero); trees split the sentinel off themselves. The statistics are stages of the pipeline.
    """
    stages, inputs, one_hot = [], list(num), linear
    if linear and num:
        filled = [f"_m_{c}" for c in num]
        stages += [Imputer(inputCols=num, outputCols=filled, strategy="mean", missingValue=OUT_OF_SCOPE), VectorAssembler(inputCols=filled, outputCol="_num"),
                   MinMaxScaler(inputCol="_num", outputCol="_scaled")]
        inputs = ["_scaled"]
    for c in cats:
        stages.append(StringIndexer(inputCol=c, outputCol=f"_i_{c}", stringOrderType="alphabetAsc", handleInvalid="keep"))
        if one_hot:
            stages.append(OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_h_{c}", handleInvalid="keep"))
        inputs.append(f"_h_{c}" if one_hot else f"_i_{c}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features"))
    return stages


def learner(kind: str, y: str, pred: str, **kw):
    common = dict(featuresCol="_features", labelCol=y, predictionCol=pred)
    seed = kw.pop("seed", BOOST["seed"])
    if kind in ("boosted", "forest"):
        of = (BOOST if kind == "boosted" else FOREST) | kw
        trees = dict(maxDepth=of["depth"], minInstancesPerNode=of["leaf"], subsamplingRate=of["rows"], featureSubsetStrategy=str(of["columns"]), maxBins=of.get("bins", 64), seed=seed)
        if kind == "boosted":
            return GBTRegressor(**common, maxIter=of["trees"], stepSize=of["rate"], lossType=of.get("loss", "squared"), **trees)
        return RandomForestRegressor(**common, numTrees=of["trees"], cacheNodeIds=True, **trees)
    if kind == "ridge":
        return LinearRegression(**common, regParam=kw.pop("reg", 0.1), elasticNetParam=0.0, solver="normal", **kw)
    if kind == "huber":
        return LinearRegression(**common, loss="huber", epsilon=kw.pop("epsilon", 1.35), **kw)
    raise ValueError(kind)


def fit(df: DataFrame, kind: str, num: list[str], cats: list[str], y: str, pred: str = "pred", weight: str | None = None, **kw) -> PipelineModel:
    """One fitted pipeline (indexers, assembler, learner) on rows with a target."""
    return fitting(df, kind, num, cats, y, pred, weight, **kw)()


def fitting(df: DataFrame, kind: str, num: list[str], cats: list[str], y: str, pred: str = "pred", weight: str | None = None, **kw) -> Callable[[], PipelineModel]:
    """The fit as a job for side_by_side; its learner is set up at once, so that the order of learners is that of the calls."""
    est = learner(kind, y, pred, **kw)
    if kind in ("boosted", "forest"):
        cut_iterations(df)
    if weight:
        est = est.setWeightCol(weight)

    def job() -> PipelineModel:
        rows, linear, kept = df.where(F.col(y).isNotNull()), kind in ("ridge", "huber"), num
        if linear and num:  # a column without any real training value says nothing: filled with 0 it would be constant
            n = rows.agg(*[F.count(F.when(F.col(c) != OUT_OF_SCOPE, 1)).alias(c) for c in num]).first()
            kept = [c for c in num if n[c]]
        if kind != "boosted":
            return Pipeline(stages=[*_stages(kept, cats, linear), est]).fit(rows)
        features, stored = _features(rows, kept, cats, [y, *([weight] if weight else [])])
        return PipelineModel([*features.stages, boosting.fit(est, stored)])

    return job


def _features(rows: DataFrame, num: list[str], cats: list[str], keep: list[str]) -> tuple[PipelineModel, DataFrame]:
    """Fitted indexers and assembler of tree learners, and the rows' features beside the columns to keep, checkpointed: every
    job of a fit carries the plan behind its rows, and boosting is a chain of thousands of them."""
    cut_iterations(rows)
    m = Pipeline(stages=_stages(num, cats)).fit(rows)
    return m, m.transform(rows).select("_features", *keep).checkpoint()


def cut_iterations(df: DataFrame) -> None:
    """Names a folder where learners write residuals and rows' nodes every ten rounds, or their lineage grows by each round."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.drop(*[c for c in out.columns if c.startswith(("_i_", "_h_", "_m_")) or c in ("_features", "_num", "_scaled")])


def train_and_score(df: DataFrame, kind: str, num, cats, y: str, train: Column, test: Column, pred: str = "pred", clip: bool = True, **kw) -> DataFrame:
    """Fit on the training rows (target held inside its 1 % and 99 % quantiles), score the test rows."""
    x = cut_lineage(model_rows(df, num, cats))  # learners pass over the rows many times
    return score(fit(_training(x, y, train, clip), kind, num, cats, y, pred, **kw), x.where(test))


def _training(x: DataFrame, y: str, train: Column, clip: bool = True) -> DataFrame:
    """The training rows, stored: fits read them many times, and the quantiles behind the clipped target are found once."""
    t = x.where(train & F.col(y).isNotNull())
    return few_partitions(cut_lineage(clip_to_train(t, y, F.lit(True)) if clip else t))


def seeds_and_scores(df: DataFrame, kind: str, num, cats, y: str, train: Column, test: Column, seeds=SEEDS, **kw) -> DataFrame:
    """The test rows with one forecast column p<seed> for each seed, all fitted on one stored frame."""
    x = cut_lineage(model_rows(df, num, cats))
    t = _training(x, y, train)
    out = x.where(test)
    for m in side_by_side(df.sparkSession, [fitting(t, kind, num, cats, y, f"p{s}", seed=s, **kw) for s in seeds]):
        out = score(m, out)
    return out


def spline_columns(df: DataFrame, cols: list[str], train: Column, knots: int = 5) -> tuple[DataFrame, list[str]]:
    """Uniform cubic B-spline basis of each column between its training minimum and maximum; missing counts as the training mean."""
    stats = df.where(train).agg(*[fn(c).alias(f"_{t}_{c}") for c in cols for t, fn in (("lo", F.min), ("hi", F.max), ("mid", F.avg))])
    out, names = df.crossJoin(F.broadcast(stats)), []  # exactly one row
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        h = F.when(hi > lo, (hi - lo) / (knots - 1)).otherwise(1.0)
        x = F.greatest(lo, F.least(hi, F.coalesce(F.col(c), F.col(f"_mid_{c}"))))
        for i in range(knots + 2):
            t = (x - lo) / h - (i - 3)
            b = (
                F.when((t >= 0) & (t < 1), t * t * t / 6)
                .when((t >= 1) & (t < 2), (-3 * t * t * t + 12 * t * t - 12 * t + 4) / 6)
                .when((t >= 2) & (t < 3), (3 * t * t * t - 24 * t * t + 60 * t - 44) / 6)
                .when((t >= 3) & (t <= 4), (4 - t) * (4 - t) * (4 - t) / 6).otherwise(0.0)
            )
            out = out.withColumn(f"{c}_b{i}", b)
            names.append(f"{c}_b{i}")
    return out.drop(*[f"_{t}_{c}" for c in cols for t in ("lo", "hi", "mid")]), names


def classify(df: DataFrame, num, cats, y: str, train: Column, test: Column, band: float = 0.02, seed: int = BOOST["seed"]) -> DataFrame:
    """Three-way forest, binary boosted (y > 0) and ordinal (two binary boosted) direction forecasts on the test rows."""
    x = cut_lineage(model_rows(df.where(F.col(y).isNotNull()), num, cats)).withColumns({
        "_cls": (direction(y, band) + 1).cast("double"), "_up": (F.col(y) > 0).cast("double"),
        "_gt": (F.col(y) > band).cast("double"), "_ge": (F.col(y) >= -band).cast("double"),
    })
    features, tr = _features(few_partitions(cut_lineage(x.where(train))), num, cats, ["_cls", "_up", "_gt", "_ge"])
    out = x.where(test)
    rf = RandomForestClassifier(featuresCol="_features", labelCol="_cls", predictionCol="_p3", probabilityCol="_pp", rawPredictionCol="_pr", numTrees=FOREST["trees"], maxDepth=FOREST["depth"], minInstancesPerNode=FOREST["leaf"],
                                subsamplingRate=FOREST["rows"], featureSubsetStrategy=str(FOREST["columns"]), maxBins=64, seed=seed, cacheNodeIds=True)
    learners = [rf]
    for lab in ("_up", "_gt", "_ge"):
        g = GBTClassifier(featuresCol="_features", labelCol=lab, predictionCol=f"p{lab}", maxIter=BOOST["trees"], maxDepth=BOOST["depth"], minInstancesPerNode=BOOST["leaf"], stepSize=BOOST["rate"],
                          subsamplingRate=BOOST["rows"], featureSubsetStrategy=str(BOOST["columns"]), maxBins=64, seed=seed)
        learners.append(g.setProbabilityCol(f"q{lab}").setRawPredictionCol(f"r{lab}"))
    fitted = side_by_side(df.sparkSession, [lambda g=g: g.fit(tr) for g in learners])
    out = score(PipelineModel([*features.stages, *fitted]), out)
    out = out.withColumn("three_way", (F.col("_p3") - 1).cast("int")).drop("_p3", "_pp", "_pr", *[f"{c}{lab}" for c in "qr" for lab in ("_up", "_gt", "_ge")])
    ordinal = (F.col("p_gt") + F.col("p_ge") - 1).cast("int")
    return out.withColumn("up", F.col("p_up").cast("int")).withColumn("ordinal", ordinal).withColumn("label", direction(y, band)).drop("_cls", "_up", "_gt", "_ge", "p_up", "p_gt", "p_ge")


def out_of_year(df: DataFrame, kind: str, num, cats, y: str, day: str, years: list[int], pred: str = "pred_oof", **kw) -> DataFrame:
    """Predictions for each year from a model fitted on the other years (one fit per year, a fixed short list)."""
    x = cut_lineage(model_rows(df, num, cats))
    fitted = side_by_side(df.sparkSession, [lambda yv=yv: fit(x.where(F.year(day) != yv), kind, num, cats, y, pred, **kw) for yv in years])
    parts = [score(m, x.where(F.year(day) == yv)) for m, yv in zip(fitted, years)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def per_group(df: DataFrame, kind: str, num, cats, y: str, group: str, train: Column, test: Column, fallback: str, min_rows: int = 1000, **kw) -> DataFrame:
    """Own model per group with enough training rows, the fallback column elsewhere.

    Every model is a fit of its own over a cluster, side by side; for linear models of very many groups see gram.ridge_by_group.
    """
    x = cut_lineage(model_rows(df, num, [c for c in cats if c != group]))
    n = x.where(train & F.col(y).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    groups = [r[0] for r in n.orderBy(group).collect()]  # those with a learner of their own
    parts = [x.where(test).join(F.broadcast(n.select(F.col(group).alias("_g"))), F.col(group).eqNullSafe(F.col("_g")), "left_anti").withColumn("pred", F.col(fallback))]
    subs = [x.where(F.col(group).eqNullSafe(F.lit(g))) for g in groups]
    fitted = side_by_side(df.sparkSession, [lambda sub=sub: fit(sub.where(train), kind, num, [c for c in cats if c != group], y, "pred", **kw) for sub in subs])
    parts += [score(m, sub.where(test)) for m, sub in zip(fitted, subs)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def importances(model: PipelineModel, num: list[str], cats: list[str], spark) -> DataFrame:
    """Importance share per feature in percent."""
    v = model.stages[-1].featureImportances.toArray()
    tot = float(v.sum()) or 1.0
    return spark.createDataFrame([(c, float(x) / tot * 100) for c, x in zip([*num, *cats], v)], "column string, importance double")


def save(model: PipelineModel, path: str) -> None:
    """Columns, category lists and learner travel together in the pipeline."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def grid(**options) -> list[dict]:
    out = [{}]
    for k, vs in options.items():
        out = [{**o, k: v} for o in out for v in vs]
    return out


def search(df: DataFrame, kind: str, num, cats, y: str, train: Column, valid: Column, options: list[dict]) -> DataFrame:
    """Metrics on later dates for every setting: one row per setting."""
    from .evaluate import metrics

    x = cut_lineage(model_rows(df, num, cats))
    t = _training(x, y, train)
    fitted = side_by_side(df.sparkSession, [fitting(t, kind, num, cats, y, **o) for o in options])
    parts = [metrics(score(m, x.where(valid)), y, "pred").withColumn("setting", F.lit(repr(o))) for m, o in zip(fitted, options)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def search_and_verify(df: DataFrame, kind: str, num, cats, y: str, train: Column, valid: Column, options: list[dict], seeds=SEEDS) -> DataFrame:
    """The search, and its best setting (least rmse, then the first) repeated for every seed: setting, seed, metrics."""
    found = cut_lineage(search(df, kind, num, cats, y, train, valid, options))
    best = found.orderBy("rmse", "setting").first()["setting"]
    setting = next(o for o in options if repr(o) == best)
    again = search(df, kind, num, cats, y, train, valid, [{**setting, "seed": s} for s in seeds])
    seed = F.regexp_extract("setting", r"'seed': (\d+)", 1).cast("int")
    return found.withColumn("seed", F.lit(None).cast("int")).unionByName(again.withColumn("seed", seed).withColumn("setting", F.lit(best)))


def verdict(delta, sigma) -> Column:
    """Better / worse only beyond the seed noise."""
    d, s = F.col(delta), F.col(sigma)
    return F.when(F.abs(d) < s, "noise").when(d < 0, "better").otherwise("worse")


def ablation(df: DataFrame, kind: str, num, cats, y: str, train: Column, valid: Column, drops: dict[str, list[str]], seeds=SEEDS, **kw) -> DataFrame:
    """RMSE change when a feature group is left out, against twice the seed-to-seed spread of the full model."""
    from .evaluate import metrics

    runs = [("full", num, s) for s in seeds] + [(name, [c for c in num if c not in cols], s) for name, cols in drops.items() for s in seeds]
    x = cut_lineage(model_rows(df, num, cats))
    t = _training(x, y, train)
    fitted = side_by_side(df.sparkSession, [fitting(t, kind, cols, cats, y, seed=s, **kw) for _, cols, s in runs])
    parts = [metrics(score(m, x.where(valid)), y, "pred").select("rmse").withColumn("experiment", F.lit(n)).withColumn("seed", F.lit(s)) for m, (n, _, s) in zip(fitted, runs)]
    r = reduce(lambda a, b: a.unionByName(b), parts)
    g = r.groupBy("experiment").agg(F.avg("rmse").alias("rmse"), F.stddev_samp("rmse").alias("spread"))
    full = g.where("experiment = 'full'").select(F.col("rmse").alias("_full"), (F.coalesce("spread", F.lit(0.0)) * 2).alias("sigma"))
    out = g.crossJoin(F.broadcast(full)).withColumn("delta", F.col("rmse") - F.col("_full")).drop("_full")  # one row
    return out.withColumn("verdict", F.when(F.col("experiment") == "full", "reference").otherwise(verdict("delta", "sigma")))


def fit_isotonic(hits: DataFrame):
    x = Pipeline(stages=[VectorAssembler(inputCols=["size"], outputCol="_features")]).fit(hits).transform(hits)
    return IsotonicRegression(featuresCol="_features", labelCol="hit", predictionCol="iso").fit(x)


def fit_logistic(hits: DataFrame):
    x = hits.withColumn("_ln", F.ln("size"))
    return Pipeline(stages=[VectorAssembler(inputCols=["_ln"], outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol="hit", predictionCol="_pl", probabilityCol="logit_prob", rawPredictionCol="_rl")]).fit(x)
