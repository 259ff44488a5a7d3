"""Fold-local pipelines, out-of-fold scores, calibration and ensembles on Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, metrics, ordered, splits, stats
from ..operators.isotonic import Isotonic
from ..session import materialise

Factory = Callable[[int, int], object]  # (training rows, features) -> estimator

#: Training tables of fewer rows keep the parts they have.
EVEN_FROM = 20_000
#: Most cells (rows by features) of one part of a training table.
PART_CELLS = 8_000_000
#: Tables of more features are not held: Spark reads them without generated code, far slower than files.
MOST_HELD = 90


def usable(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one value; one aggregate for all of them."""
    counts = df.agg(*[F.count(f).alias(f) for f in features]).first()
    return [f for f in features if counts[f]]


def at_once(tasks: Sequence[Callable], parallelism: int = 4) -> list:
    """Run driver-side fits side by side, so Spark always has jobs of several to schedule.

    Each task gets its own copy of the thread's properties: in a shared one, threads
    clear the execution id that another has just set.
    """
    session = SparkSession.active()
    with ThreadPool(min(parallelism, max(len(tasks), 1))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(session)(t) for t in tasks])


def preparation(features: Sequence[str], scale: bool = True) -> list:
    """Median imputation and scaling as pipeline stages, so each fold fits its own."""
    filled = [f"{f}__filled" for f in features]
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=filled),
              VectorAssembler(inputCols=filled, outputCol="assembled")]
    if scale:
        stages.append(StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True))
    else:
        stages[-1].setOutputCol("features")
    return stages


def with_class_weight(df: DataFrame, label: str = "y", out: str = "weight") -> tuple[DataFrame, int]:
    """Weight n / (2 n_class), from two counts; also returns n."""
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2 * counts.get(1, n) or 1)).otherwise(n / (2 * counts.get(0, n) or 1))
    return df.withColumn(out, weight), n


def logistic(c: float = 1.0, mix: float = 0.0, **extra) -> Factory:
    """Penalised logistic regression; strength ``c`` is per data set, Spark's is per row."""
    def make(n, width):
        return LogisticRegression(labelCol="y", weightCol="weight", elasticNetParam=mix, regParam=1 / (c * max(n, 1)),
                                  standardization=False, **extra)
    return make


def forest(trees: int = 600, depth: int = 12, leaf: int = 4, seed: int = 42) -> Factory:
    return lambda n, width: RandomForestClassifier(
        labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
        featureSubsetStrategy="sqrt", seed=seed)


def boosting(rounds: int = 300, step: float = 0.05, depth: int = 3, seed: int = 42) -> Factory:
    return lambda n, width: GBTClassifier(
        labelCol="y", weightCol="weight", maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=0.8, seed=seed)


def perceptron(hidden: Sequence[int] = (128, 64), rounds: int = 100, seed: int = 42) -> Factory:
    return lambda n, width: MultilayerPerceptronClassifier(
        labelCol="y", layers=[width, *hidden, 2], maxIter=rounds, seed=seed)


@contextmanager
def dealt(rows: DataFrame, n: int, width: int, side_by_side: int = 1) -> Iterator[DataFrame]:
    """A training table of ``n`` rows, held in even parts while it is fitted on.

    Learners pass over it many times, in the parts of its scan: few, as files are cut by
    their compressed bytes. Fits that run ``side_by_side`` share the cores, so each needs
    fewer parts. Small tables and those of over MOST_HELD features are left as they lie.
    """
    if n < EVEN_FROM or width > MOST_HELD:
        yield rows
        return
    cores = rows.sparkSession.sparkContext.defaultParallelism
    even = rows.repartition(max(-(-cores // side_by_side), -(-n * width // PART_CELLS))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield even
    finally:
        even.unpersist()


def fit(train: DataFrame, features: Sequence[str], factory: Factory, label: str = "y", trust: str | None = None) -> PipelineModel:
    """Fit preparation and model together on the labelled rows, classes balanced by weight.

    One aggregate supplies class counts and feature counts. ``trust`` names an
    extra row weight. Every labelled row is fitted on.
    """
    known = train.where(F.col(label).isNotNull()).withColumn("y", F.col(label).cast("double"))
    counts = known.agg(F.count_if(F.col("y") == 1).alias("y|1"), F.count_if(F.col("y") == 0).alias("y|0"),
                       *[F.count(f).alias(f) for f in features]).first()
    chosen = [f for f in features if counts[f]]
    n = counts["y|1"] + counts["y|0"]
    weight = F.when(F.col("y") == 1, n / (2 * (counts["y|1"] or 1))).otherwise(n / (2 * (counts["y|0"] or 1)))
    known = known.withColumn("weight", weight * F.col(trust) if trust else weight)
    known = known.select("y", "weight", *chosen)
    with dealt(known, n, len(chosen)) as rows:
        return Pipeline(stages=[*preparation(chosen), factory(n, len(chosen))]).fit(rows)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], out: str = "p") -> DataFrame:
    """Row-wise scores: nothing here looks at the other rows of the batch."""
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(out))


def fold_values(df: DataFrame, fold: str = "fold") -> list:
    """The folds that ``df`` has, in order: a handful of values."""
    return sorted(r[fold] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect())


def out_of_fold(df: DataFrame, features: Sequence[str], factory: Factory, name: str, fold: str = "fold", key: str = "id",
                label: str = "y", parallelism: int = 4) -> DataFrame:
    """Every labelled row scored by a model that never saw its fold: (id, fold, y, model, p).

    The folds are those of the column, however many there are; a single one is an error.
    """
    def held_scores(i) -> DataFrame:
        model = fit(df.where(F.col(fold) != i), features, factory, label)
        return score(model, df.where((F.col(fold) == i) & F.col(label).isNotNull()), [key, fold, label])

    folds = fold_values(df, fold)
    if len(folds) < 2:
        raise ValueError(f"column {fold} has {len(folds)} fold(s); two or more are needed")
    parts = at_once([lambda i=i: held_scores(i) for i in folds], parallelism)
    return materialise(stacked(parts).withColumn("model", F.lit(name)), "oof")


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def fold_table(df: DataFrame, columns: Sequence[str], fold: str = "fold") -> DataFrame:
    """Features and folds computed once and stored by fold, so a fit or scoring pass reads only its folds."""
    return materialise(df.select(*columns), "folds", [fold])


def cross_validate(df: DataFrame, features: Sequence[str], zoo: dict[str, Factory], key: str = "id", fold: str = "fold",
                   repeats: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores of every model and their ranked fold summary.

    With ``repeats`` above 1 the rows are dealt anew for each repeat, in as many
    stratified folds as the column has; a row's scores are averaged over repeats, and
    the summary is over all folds of all repeats.
    """
    tables = [fold_table(df, [key, fold, "y", *features], fold)]
    k = len(fold_values(tables[0], fold)) if repeats > 1 else 0
    for r in range(1, repeats):
        again = splits.stratified_folds(tables[0].drop(fold), key, "y", k, seed=seed + r).withColumnRenamed("fold", fold)
        tables.append(fold_table(again, [key, fold, "y", *features], fold))
    runs = [(r, t, name, factory) for r, t in enumerate(tables) for name, factory in zoo.items()]
    oof = stacked(at_once([
        lambda r=r, t=t, n=n, f=f: out_of_fold(t, features, f, n, fold, key).withColumn("repeat", F.lit(r)) for r, t, n, f in runs], 2))
    by_fold = metrics.roc_auc(oof, by=["model", "repeat", fold])
    summary = aggregates.fold_summary(by_fold).orderBy(F.desc("mean"), "model")
    return (aggregates.average_repeats(oof, ["model", key]) if repeats > 1 else oof.drop("repeat")), summary


def families() -> dict[str, tuple[object, dict[str, Callable[[random.Random], object]]]]:
    """Learners of the nested search, each with the ranges its parameters are drawn from."""
    log_uniform = lambda lo, hi: lambda rng: lo * (hi / lo) ** rng.random()
    common = {"labelCol": "y", "weightCol": "weight"}
    return {
        "logistic": (LogisticRegression(standardization=False, **common), {
            "regParam": log_uniform(1e-4, 1.0), "elasticNetParam": lambda rng: rng.random()}),
        "forest": (RandomForestClassifier(seed=42, **common), {
            "numTrees": lambda rng: rng.randrange(50, 401), "maxDepth": lambda rng: rng.randrange(3, 13),
            "minInstancesPerNode": lambda rng: rng.randrange(1, 11)}),
        "boosting": (GBTClassifier(seed=42, subsamplingRate=0.8, **common), {
            "maxIter": lambda rng: rng.randrange(50, 301), "stepSize": log_uniform(0.01, 0.3),
            "maxDepth": lambda rng: rng.randrange(2, 6)}),
    }


def nested_search(df: DataFrame, features: Sequence[str], family: str = "logistic", candidates: int = 20, inner: int = 4,
                  seed: int = 42, parallelism: int = 4, ranges: dict | None = None) -> DataFrame:
    """Tune on inner folds, score the untouched outer fold: one row per outer fold of ``df``.

    ``candidates`` settings are drawn from the family's ranges (or from ``ranges``).
    Inner folds come from column ``inner_fold``; a value outside 0 to ``inner`` - 1, a NULL
    or a fold without rows is an error.
    """
    rng = random.Random(seed)
    learner, own = families()[family]
    space = ranges or own
    evaluator = BinaryClassificationEvaluator(labelCol="y")
    rows = []

    def inner_aucs(train: DataFrame, n: int, j: int, grid: list[dict]) -> list[float]:
        """AUC of every setting on inner fold ``j``: settings share the preparation, which depends on the rows only."""
        with dealt(train.where(F.col("inner_fold") != j), n, len(features), parallelism) as known:
            ready = Pipeline(stages=preparation(features)).fit(known)
            keep = ["y", "weight", "features"]
            fitted, held = (ready.transform(t).select(*keep).persist(StorageLevel.MEMORY_AND_DISK) for t in (
                known, train.where(F.col("inner_fold") == j)))
            try:
                return at_once([lambda g=g: evaluator.evaluate(learner.copy(
                    {getattr(learner, k): v for k, v in g.items()}).fit(fitted).transform(held)) for g in grid], parallelism)
            finally:
                fitted.unpersist()
                held.unpersist()

    # Every candidate reads its folds several times: they are computed once.
    df = fold_table(df, ["fold", "inner_fold", "y", *features])
    for i in fold_values(df):
        train, n = with_class_weight(df.where((F.col("fold") != i) & F.col("y").isNotNull()).withColumn(
            "y", F.col("y").cast("double")))
        train = train.withColumn("inner_fold", F.col("inner_fold").cast("int"))
        inside = {r["inner_fold"] for r in train.select("inner_fold").distinct().limit(inner + 1).collect()}
        if inner < 2 or inside != set(range(inner)):
            raise ValueError(f"column inner_fold must hold 0 to {inner - 1}, each in some row, and two folds at least")
        grid = [{n: draw(rng) for n, draw in sorted(space.items())} for _ in range(candidates)]
        aucs = at_once([lambda j=j: inner_aucs(train, n, j, grid) for j in range(inner)], 2)
        means = [sum(of_one) / inner for of_one in zip(*aucs)]
        best = max(range(len(grid)), key=lambda j: means[j])
        with dealt(train, n, len(features)) as known:
            chosen = learner.copy({getattr(learner, k): v for k, v in grid[best].items()})
            model = Pipeline(stages=[*preparation(features), chosen]).fit(known)
        held = df.where((F.col("fold") == i) & F.col("y").isNotNull())
        outer = metrics.roc_auc(score(model, held, ["y"])).first()["auc_roc"]
        rows.append((i, family, float(outer), float(means[best]), str(grid[best])))
    return df.sparkSession.createDataFrame(rows, "fold int, family string, outer_auc double, inner_auc double, chosen string")


class Calibrator:
    """Isotonic calibration, optionally held inside the smoothed decile rates."""

    def __init__(self, model: Isotonic, lo: float, hi: float):
        self.model, self.lo, self.hi = model, lo, hi

    @classmethod
    def fit(cls, df: DataFrame, score: str = "p", label: str = "y", bounded: bool = True, n_bins: int = 10,
            digits: int | None = None) -> "Calibrator":
        """The exact fit over all distinct scores, as a table of steps; with ``digits`` scores are rounded first."""
        known = df.where(F.col(label).isNotNull())
        known = known if digits is None else known.withColumn(score, F.round(F.col(score), digits))
        model = Isotonic.fit(known, score, label)
        lo, hi = 0.0, 1.0
        if bounded:
            lo, hi = cls.bounds(known, score, label, n_bins).first()
        return cls(model, lo, hi)

    def save(self, path: str) -> None:
        self.model.save(f"{path}/steps")
        self.model.steps.sparkSession.createDataFrame([(self.lo, self.hi)], "lo double, hi double").write.mode("overwrite").parquet(f"{path}/bounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Calibrator":
        lo, hi = spark.read.parquet(f"{path}/bounds").select("lo", "hi").first()
        return cls(Isotonic.load(spark, f"{path}/steps"), lo, hi)

    @staticmethod
    def bounds(known: DataFrame, score: str = "p", label: str = "y", n_bins: int = 10) -> DataFrame:
        """Lowest and highest Laplace-smoothed event rate over the quantile bins."""
        rate = (F.col("pos") + 1) / (F.col("n") + 2)
        bins = metrics.calibration_curve(known, label, score, n_bins=n_bins)
        fallback = known.agg(F.avg(F.col(label).cast("double")).alias("prior"), F.lit(1).alias("_one"))
        spread = bins.agg(F.min(rate).alias("lo"), F.max(rate).alias("hi"), F.lit(1).alias("_one"))
        return spread.join(F.broadcast(fallback), "_one").select(
            F.coalesce("lo", "prior").alias("lo"), F.coalesce("hi", "prior").alias("hi"))

    def transform(self, df: DataFrame, score: str = "p", out: str = "calibrated") -> DataFrame:
        held = F.greatest(F.lit(self.lo), F.least(F.lit(self.hi), F.col(out)))
        return self.model.transform(df, score, out).withColumn(out, held)


def rank_average(reference: DataFrame, scored: DataFrame, key: str = "id") -> DataFrame:
    """Mean over members of the share of the member's training scores at or under the row's.

    Both frames are long (model, p). The training distribution fixes every rank,
    so a row's value is the same alone or in any batch.
    """
    shares = ordered.share_at_or_below(reference, scored, "p", ["model"])
    return scored.join(shares, ["model", "p"], "left").groupBy(key).agg(F.avg("share").alias("p"))


def auc_weights(oof: DataFrame, power: float = 4.0) -> DataFrame:
    """One weight per model, (AUC - 0.5)^power over their sum."""
    raw = F.pow(F.greatest(F.col("auc_roc") - 0.5, F.lit(1e-6)), power)
    table = metrics.roc_auc(oof, by=["model"]).withColumn("weight", raw)
    return ordered.share_of_total(table, "weight", out="share").select("model", "auc_roc", F.col("share").alias("weight"))


def weighted_average(scored: DataFrame, weights: DataFrame, key: str = "id") -> DataFrame:
    """Weighted mean per row; one weight per model is a small side."""
    joined = scored.join(F.broadcast(weights.select("model", "weight")), "model")
    return joined.groupBy(key).agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p"))


def wide_scores(oof: DataFrame, members: Sequence[str], keep: Sequence[str] = ("id", "y")) -> DataFrame:
    return oof.groupBy(*keep).pivot("model", list(members)).agg(F.first("p"))


def stack(oof: DataFrame, members: Sequence[str], c: float = 1.0) -> tuple[PipelineModel, DataFrame]:
    """Logistic meta-learner on out-of-fold columns; also its coefficient table."""
    wide = wide_scores(oof, members)
    known, n = with_class_weight(wide.where("y IS NOT NULL").withColumn("y", F.col("y").cast("double")))
    learner = logistic(c)(n, len(members)).setFeaturesCol("assembled")
    model = Pipeline(stages=[VectorAssembler(inputCols=list(members), outputCol="assembled"), learner]).fit(known)
    weights = [(m, float(w)) for m, w in zip(members, model.stages[-1].coefficients.toArray())]
    return model, oof.sparkSession.createDataFrame(weights, "model string, weight double")


def greedy_rank_ensemble(oof: DataFrame, key: str = "id", label: str = "y", rounds: int = 5, gain: float = 1e-4) -> DataFrame:
    """Forward selection with replacement of the member that raises the rank-average AUC most.

    Ranks are stored once; each round scores every candidate in one grouped pass.
    """
    members = [r["model"] for r in oof.select("model").distinct().orderBy("model").collect()]
    shares = ordered.share_at_or_below(oof, oof, "p", ["model"])
    ranks = materialise(
        oof.join(shares, ["model", "p"]).groupBy(key, label).pivot("model", members).agg(F.first("share")), "ranks")
    chosen: list[str] = []
    path, best = [], 0.0
    for step in range(rounds):
        total = sum((F.col(m) for m in chosen), F.lit(0.0))
        options = ranks.select(label, F.explode(F.array(*[
            F.struct(F.lit(m).alias("model"), ((total + F.col(m)) / (len(chosen) + 1)).alias("p")) for m in members])).alias("o"))
        top = metrics.roc_auc(options.select(label, "o.*"), label, by=["model"]).orderBy(F.desc("auc_roc"), "model").first()
        if top["auc_roc"] <= best + gain:
            break
        best = top["auc_roc"]
        chosen.append(top["model"])
        path.append((step + 1, top["model"], float(best)))
    return oof.sparkSession.createDataFrame(path, "step int, added string, auc_roc double")


def tie_tier(oof: DataFrame, alpha: float = 0.05) -> DataFrame:
    return stats.tie_tier(oof, alpha)
