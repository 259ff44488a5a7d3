"""The final stage: one model, its calibration and thresholds from out-of-fold scores, and one look at the held-out rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, splits, stats
from ..session import materialise
from ..sources import tables
from . import models


@dataclass
class FinalStage:
    """What the stage leaves: the artefact's parts and the report's tables."""

    model: PipelineModel
    calibrator: models.Calibrator
    thresholds: DataFrame  #: rule, threshold
    report: DataFrame  #: a metric row for each rule, on held-out rows
    calibration: DataFrame  #: Brier score and calibration error, raw and calibrated
    intervals: DataFrame  #: metric, point, lo, hi

    def save(self, path: str) -> None:
        tables.save_artefact(path, self.model, {
            "thresholds": self.thresholds, "report": self.report, "calibration": self.calibration, "intervals": self.intervals})
        self.calibrator.save(f"{path}/calibrator")


def calibrated_out_of_fold(oof: DataFrame, fold: str = "fold") -> DataFrame:
    """``oof`` with the column ``calibrated``: each fold through a calibration fitted on the others."""
    folds = models.fold_values(oof, fold)
    fits = models.at_once([lambda i=i: models.Calibrator.fit(oof.where(F.col(fold) != i)) for i in folds])
    return models.stacked([c.transform(oof.where(F.col(fold) == i)) for i, c in zip(folds, fits)])


def final_stage(df: DataFrame, features: Sequence[str], factory: models.Factory, key: str = "id", label: str = "y",
                share: float = 0.2, k: int = 5, sensitivity: float = 0.90, n_boot: int = 2000, seed: int = 42) -> FinalStage:
    """Hold out, cross-validate, calibrate, choose thresholds, fit on all training rows, score the held-out rows once.

    Thresholds come from the training rows' calibrated out-of-fold scores; the
    held-out rows choose nothing.
    """
    known = df.where(F.col(label).isNotNull()).select(key, F.col(label).alias("y"), *features)
    split = materialise(splits.stratified_holdout(known, key, "y", share, seed), "final")
    train = models.fold_table(splits.stratified_folds(split.where("NOT is_test"), key, "y", k, seed=seed), [key, "fold", "y", *features])
    oof = models.out_of_fold(train, features, factory, "final", key=key)
    inner = materialise(calibrated_out_of_fold(oof), "final")
    chosen = metrics.operating_points(inner, score="calibrated", target=sensitivity)
    rules = {r["rule"]: float(r["threshold"]) for r in chosen.collect()}
    model, calibrator = models.fit(train, features, factory), models.Calibrator.fit(oof)
    scored = materialise(
        calibrator.transform(models.score(model, split.where("is_test"), [key, "y"])).select(key, "y", "p", "calibrated"), "final")
    curve = metrics.score_curve(scored, score="calibrated")
    report = models.stacked([
        metrics.summarise_curve(curve, "calibrated", threshold=t).withColumn("rule", F.lit(rule)) for rule, t in sorted(rules.items())])
    both = scored.unpivot([key, "y"], ["p", "calibrated"], "scores", "p")
    calibration = metrics.brier(both, by=["scores"]).join(metrics.calibration_error(both, by=["scores"]), "scores")
    intervals = stats.exact_bootstrap(scored, score="calibrated", n_boot=n_boot, seed=seed)
    thresholds = df.sparkSession.createDataFrame(sorted(rules.items()), "rule string, threshold double")
    return FinalStage(model, calibrator, thresholds, report, calibration, intervals)
