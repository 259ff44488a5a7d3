"""Evaluation statistics read off one ordered score curve per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from . import ordered

INFINITY = float("inf")


def score_histogram(df: DataFrame, label: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Labelled rows as (key, score, pos, neg): the only pass over row-level data."""
    known = df.where(F.col(label).isNotNull())
    return ordered.histogram(known, score, {
        "pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)}, by)


def score_curve(df: DataFrame, label: str = "y", score: str = "p", by: Sequence[str] = (), splits=None,
                hist: DataFrame | None = None) -> DataFrame:
    """Per distinct score: ``tp``/``fp`` at the threshold ``score`` and the class totals.

    Columns ``pos``/``neg`` hold the score's own rows, ``pos_before``/``neg_before``
    those with a smaller score, ``pos_all``/``neg_all`` the whole key.
    """
    if splits is None:
        splits = ordered.range_splits(df if hist is None else hist, score)
    hist = score_histogram(df, label, score, by) if hist is None else hist
    curve = ordered.running_totals(hist, score, ["pos", "neg"], splits, by)
    return curve.withColumns({
        "tp": F.col("pos_all") - F.col("pos_before"),
        "fp": F.col("neg_all") - F.col("neg_before"),
    })


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def ratio(top: Column, bottom: Column, empty=None) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def tpr() -> Column:
    return ratio(_d("tp"), _d("pos_all"))


def fpr() -> Column:
    return ratio(_d("fp"), _d("neg_all"))


def auc_agg() -> Column:
    """Chance that a positive outscores a negative; a tie counts half."""
    wins = F.sum(_d("pos") * (_d("neg_before") + _d("neg") / 2))
    return ratio(wins, F.max(_d("pos_all")) * F.max(_d("neg_all")))


def average_precision_agg() -> Column:
    return ratio(F.sum(_d("pos") * _d("tp") / (_d("tp") + _d("fp"))), F.max(_d("pos_all")))


def youden_agg(score: str, value: Column | None = None) -> Column:
    """``value`` (the score itself by default) at the first maximum of tpr - fpr from the top."""
    return F.max_by(F.col(score) if value is None else value, F.struct(tpr() - fpr(), F.col(score)))


def youden_threshold_agg(score: str) -> Column:
    """Infinity when no threshold beats calling nobody."""
    return F.when(F.max(tpr() - fpr()) > 0, youden_agg(score)).otherwise(F.lit(INFINITY))


def sensitivity_threshold_agg(score: str, target: float) -> Column:
    """Highest threshold whose sensitivity reaches ``target``; 0 when none does."""
    return F.coalesce(F.max(F.when(tpr() >= target, F.col(score))), F.lit(0.0))


def roc_auc(df, label="y", score="p", by=(), splits=None) -> DataFrame:
    return score_curve(df, label, score, by, splits).groupBy(*by).agg(auc_agg().alias("auc_roc"))


def average_precision(df, label="y", score="p", by=(), splits=None) -> DataFrame:
    return score_curve(df, label, score, by, splits).groupBy(*by).agg(average_precision_agg().alias("auc_pr"))


def roc_points(df, label="y", score="p", by=(), splits=None, corners: bool = False) -> DataFrame:
    """One ROC point per distinct score; ``corners`` drops points inside straight runs."""
    splits = ordered.range_splits(df, score) if splits is None else splits
    curve = score_curve(df, label, score, by, splits)
    if corners:
        curve = _corner_points(curve, score, by, splits)
    return curve.select(*by, F.col(score).alias("threshold"), fpr().alias("fpr"), tpr().alias("tpr"))


def pr_points(df, label="y", score="p", by=(), splits=None) -> DataFrame:
    curve = score_curve(df, label, score, by, splits)
    return curve.select(
        *by, F.col(score).alias("threshold"), tpr().alias("recall"),
        ratio(_d("tp"), _d("tp") + _d("fp")).alias("precision"))


def _corner_points(curve: DataFrame, score: str, by: Sequence[str], splits) -> DataFrame:
    """Keep a point when the step into it differs from the step out of it.

    The step out of a bucket's lowest score is the step into the next lower
    bucket's highest one, read from a table with one row per bucket.
    """
    step = F.struct("pos", "neg")
    staged = ordered.with_bucket(curve, score, splits).withColumn("_key", F.struct(*by) if by else F.lit(0))
    heads = staged.groupBy("_key", "_bucket").agg(F.max_by(step, score).alias("_head"))
    heads = heads.select("_key", "_bucket", F.lag("_head").over(
        Window.partitionBy("_key").orderBy("_bucket")).alias("_next_head"))
    inside = Window.partitionBy("_key", "_bucket").orderBy(F.col(score).desc())
    out = F.coalesce(F.lead(step).over(inside), F.col("_next_head"))
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return (
        staged.join(heads, ["_key", "_bucket"])
        .withColumn("_keep", first | out.isNull() | (out != step))
        .where("_keep").select(*curve.columns)
    )


def youden_threshold(df, label="y", score="p", by=(), splits=None) -> DataFrame:
    return score_curve(df, label, score, by, splits).groupBy(*by).agg(
        youden_threshold_agg(score).alias("threshold"))


def sensitivity_threshold(df, target: float = 0.90, label="y", score="p", by=(), splits=None,
                          corners: bool = False) -> DataFrame:
    """Highest threshold reaching ``target``, over all scores or over the curve's corner points only."""
    splits = ordered.range_splits(df, score) if splits is None else splits
    curve = score_curve(df, label, score, by, splits)
    if corners:
        curve = _corner_points(curve, score, by, splits)
    return curve.groupBy(*by).agg(
        sensitivity_threshold_agg(score, target).alias("threshold"))


def accuracy_threshold(df, label="y", score="p", by=(), splits=None) -> DataFrame:
    """Lowest of the scores rounded to 3 digits with the best accuracy; 0.5 when there are none.

    Candidate cuts join the score axis as values without rows, so the running
    counts give each cut's exact counts against the unrounded scores.
    """
    splits = ordered.range_splits(df, score) if splits is None else splits
    hist = score_histogram(df, label, score, by)
    cuts = hist.select(*by, F.bround(score, 3).alias(score), F.lit(0).alias("pos"), F.lit(0).alias("neg"),
                       F.lit(True).alias("_cut"))
    axis = hist.withColumn("_cut", F.lit(False)).unionByName(cuts).groupBy(*by, score).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("_cut").alias("_cut"))
    curve = score_curve(axis, score=score, by=by, splits=splits, hist=axis).where("_cut")
    right = F.col("tp") + F.col("neg_before")
    best = F.max_by(F.col(score), F.struct(right, -F.col(score)))
    return curve.groupBy(*by).agg(F.coalesce(best, F.lit(0.5)).alias("threshold"))


def operating_points(df, label="y", score="p", by=(), target: float = 0.90, splits=None) -> DataFrame:
    """Named thresholds in long form: keys, ``rule``, ``threshold``."""
    splits = ordered.range_splits(df, score) if splits is None else splits
    curve = score_curve(df, label, score, by, splits)
    two = curve.groupBy(*by).agg(
        youden_threshold_agg(score).alias("youden"),
        sensitivity_threshold_agg(score, target).alias("sensitivity"))
    long = two.unpivot(list(by), ["youden", "sensitivity"], "rule", "threshold")
    best = accuracy_threshold(df, label, score, by, splits).withColumn("rule", F.lit("accuracy"))
    return long.unionByName(best)


def bin_edges(n_bins: int) -> list[float]:
    return [i * (1 / n_bins) for i in range(1, n_bins)]


def probability_bin(score: str, n_bins: int = 10) -> Column:
    """0-based equal-width bin, open below and closed above; the first holds 0 as well."""
    return sum((F.col(score) > edge).cast("int") for edge in bin_edges(n_bins))


def calibration_error(df, label="y", score="p", by=(), n_bins: int = 10) -> DataFrame:
    """Expected calibration error: rows combine map-side into at most ``n_bins`` per key."""
    known = df.where(F.col(label).isNotNull() & F.col(score).between(0, 1))
    bins = known.groupBy(*by, probability_bin(score, n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("pos"), F.sum(score).alias("total"))
    return bins.groupBy(*by).agg(
        (F.sum(F.abs(F.col("pos") - F.col("total"))) / F.sum("n")).alias("ece"))


def brier(df, label="y", score="p", by=()) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(
        F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def counts_at(df, cuts: Sequence[float], label="y", score="p", by=()) -> DataFrame:
    """Confusion counts at literal thresholds: keys, ``threshold``, ``tp, fp, pos, neg``.

    Each row falls between two cuts and combines map-side, so the shuffle
    carries at most ``len(cuts) + 1`` rows per key and task.
    """
    cuts = sorted(float(c) for c in cuts)
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    cells = (
        ordered.with_bucket(known, score, cuts, "_below").groupBy(*by, "_below")
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    # A cell counts towards every cut at or under it, and once more for the totals.
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("_step")
    spread = cells.select(*by, "pos", "neg", "_below", steps)
    reach = F.col("_below") >= F.col("_step")
    grid = spread.groupBy(*by, "_step").agg(
        F.sum(F.when(reach, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(reach, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    named = F.array(*[F.lit(c) for c in cuts])
    return grid.where(F.col("_step") > 0).select(
        *by, F.element_at(named, F.col("_step")).alias("threshold"), "tp", "fp", "pos", "neg")


def net_benefit(tp: Column, fp: Column, n: Column, threshold: Column) -> Column:
    odds = threshold / F.nullif(1 - threshold, F.lit(0.0))
    return F.when(threshold >= 1, 0.0).otherwise(tp / n - fp / n * odds)


def decision_curve(df, cuts: Sequence[float], label="y", score="p", by=()) -> DataFrame:
    """Net benefit of the model, of treating everyone, and whether the model beats both."""
    n = F.col("pos") + F.col("neg")
    t = F.col("threshold")
    out = counts_at(df, cuts, label, score, by).withColumns({
        "model": net_benefit(F.col("tp"), F.col("fp"), n, t),
        "treat_all": net_benefit(F.col("pos"), F.col("neg"), n, t)})
    return out.withColumn("useful", (F.col("model") > 0) & (F.col("model") > F.col("treat_all"))).drop(
        "tp", "fp", "pos", "neg")


def useful_range(curve: DataFrame, by=()) -> DataFrame:
    hit = F.when(F.col("useful"), F.col("threshold"))
    return curve.groupBy(*by).agg(F.min(hit).alias("lowest"), F.max(hit).alias("highest"))


def threshold_sweep(df, cuts: Sequence[float], label="y", score="p", by=()) -> DataFrame:
    counts = counts_at(df, cuts, label, score, by)
    right = F.col("tp") + F.col("neg") - F.col("fp")
    return counts.select(
        *by, "threshold", (right / (F.col("pos") + F.col("neg"))).alias("accuracy"),
        ratio(_d("tp"), _d("pos")).alias("sensitivity"))


def calibration_curve(df, label="y", score="p", by=(), n_bins: int = 10, min_rows: int = 5,
                      splits=None) -> DataFrame:
    """Mean predicted against observed in quantile bins closed at both ends.

    A score on an edge counts in both bins. The edges are exact quantiles, at
    most ``n_bins + 1`` per key.
    """
    splits = ordered.range_splits(df, score) if splits is None else splits
    known = df.where(F.col(label).isNotNull())
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = ordered.quantiles(known, score, probs, by, splits).groupBy(
        (F.struct(*by) if by else F.lit(0)).alias("_key")).agg(
        F.array_sort(F.collect_set("value")).alias("_edges"))
    edges = small_side(edges) if by else F.broadcast(edges)
    hist = score_histogram(df, label, score, by).withColumn("_key", F.struct(*by) if by else F.lit(0))
    bins = F.filter(
        F.sequence(F.lit(1), F.size("_edges") - 1),
        lambda i: F.col(score).between(F.element_at("_edges", i), F.element_at("_edges", i + 1)))
    placed = hist.join(edges, "_key").where(F.size("_edges") > 1).select(
        *by, score, "pos", "neg", F.explode(bins).alias("bin"))
    n = F.sum(F.col("pos") + F.col("neg"))
    return placed.groupBy(*by, "bin").agg(
        n.alias("n"), (F.sum(F.col(score) * (F.col("pos") + F.col("neg"))) / n).alias("predicted"),
        (F.sum("pos") / n).alias("observed"), F.sum("pos").alias("pos")).where(F.col("n") >= min_rows)


def summary(df, label="y", score="p", by=(), threshold: float | None = None, splits=None) -> DataFrame:
    """The full metric row per key, at ``threshold`` or at the key's own Youden point.

    One pass over the rows builds the histogram; everything else is one
    aggregate over its curve.
    """
    return summarise_curve(score_curve(df, label, score, by, splits), score, by, threshold)


def summarise_curve(curve: DataFrame, score="p", by=(), threshold: float | None = None) -> DataFrame:
    s, pos, neg = _d(score), _d("pos"), _d("neg")
    cut = youden_threshold_agg(score) if threshold is None else F.lit(float(threshold))
    if threshold is None:
        beats = F.max(tpr() - fpr()) > 0
        at = lambda name: F.when(beats, youden_agg(score, F.col(name))).otherwise(F.lit(0))
    else:
        at = lambda name: F.sum(F.when(F.col(score) >= threshold, F.col(name)).otherwise(0))
    over = lambda t, name: F.sum(F.when(F.col(score) >= t, _d(name)).otherwise(0.0))
    in_bin = lambda i, value: F.sum(F.when(probability_bin(score) == i, value).otherwise(0.0))
    raw = curve.groupBy(*by).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), cut.alias("threshold"),
        (at("tp") if threshold is None else at("pos")).alias("tp"),
        (at("fp") if threshold is None else at("neg")).alias("fp"),
        auc_agg().alias("auc_roc"), average_precision_agg().alias("auc_pr"),
        F.sum(pos * F.pow(s - 1, 2) + neg * F.pow(s, 2)).alias("_sq"),
        sum(F.abs(in_bin(i, pos) - in_bin(i, s * (pos + neg))) for i in range(10)).alias("_gap"),
        *[over(t, name).alias(f"_{name}_{pct}") for t, pct in ((0.1, 10), (0.2, 20)) for name in ("pos", "neg")])
    p, n, tp, fp = _d("_p"), _d("_n"), _d("tp"), _d("fp")
    total = p + n
    fn, tn = p - tp, n - fp
    sens, spec = ratio(tp, p, 0.0), ratio(tn, n, 0.0)
    benefit = lambda pct: net_benefit(_d(f"_pos_{pct}"), _d(f"_neg_{pct}"), total, F.lit(pct / 100))
    return raw.select(
        *by, (F.col("_p") + F.col("_n")).alias("n"), (p / total).alias("prevalence"), "threshold",
        "auc_roc", "auc_pr", (p / total).alias("auc_pr_baseline"),
        ((tp + tn) / total).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"),
        sens.alias("sensitivity"), spec.alias("specificity"), ratio(tp, tp + fp, 0.0).alias("precision"),
        ratio(tn, tn + fn, 0.0).alias("npv"), ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(p) * F.sqrt(n) * F.sqrt(tn + fn), 0.0).alias("mcc"),
        (F.col("_sq") / total).alias("brier"), (F.col("_gap") / total).alias("ece"),
        benefit(10).alias("net_benefit_10"), benefit(20).alias("net_benefit_20"),
        F.col("tp"), tn.cast("long").alias("tn"), F.col("fp"), fn.cast("long").alias("fn"))


def majority_baseline(df, label="y", by=()) -> DataFrame:
    """Accuracy of always predicting the larger class."""
    rate = F.avg(F.col(label).cast("double"))
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(
        rate.alias("prevalence"), F.greatest(rate, 1 - rate).alias("majority_accuracy"))


def accuracy_with_baseline(df, threshold: float, label="y", score="p", by=()) -> DataFrame:
    rate = F.avg(F.col(label).cast("double"))
    hit = F.avg(((F.col(score) >= threshold).cast("int") == F.col(label)).cast("double"))
    base = F.greatest(rate, 1 - rate)
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(
        rate.alias("prevalence"), hit.alias("accuracy"), base.alias("majority_accuracy"),
        (hit - base).alias("margin"))
