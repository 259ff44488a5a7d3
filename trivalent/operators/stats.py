"""Tests and associations. Tables reduce to a few numbers on Spark; p-values use math.erfc."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import metrics, ordered


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_square_p(statistic: float, dof: int) -> float:
    """Upper tail of chi-square: the regularised incomplete gamma function Q(dof/2, statistic/2).

    Below its mean the lower tail's series is summed, above it the continued
    fraction (Lentz); the common factor is taken in logs, so large tables keep their p.
    """
    if statistic <= 0:
        return 1.0
    shape, x = dof / 2, statistic / 2
    scale = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        step = shape
        while term > total * 1e-16:
            step += 1
            term *= x / step
            total += term
        return min(1.0, max(0.0, 1 - scale * total))
    tiny = 1e-300
    b = x + 1 - shape
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 100_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, scale * value)


def cross_tab(df: DataFrame, category: str, label: str = "y") -> DataFrame:
    """Labelled counts and event rate per category."""
    return df.where(F.col(label).isNotNull() & F.col(category).isNotNull()).groupBy(category).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"),
        (F.avg(F.col(label).cast("double")) * 100).alias("rate_pct"))


def chi_square(df: DataFrame, category: str, label: str = "y") -> DataFrame:
    """Independence test of a category and a 0/1 label; a 2x2 table gets Yates' correction."""
    table = cross_tab(df, category, label).select("pos", "neg", (F.col("pos") + F.col("neg")).alias("n"))
    totals = table.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"), F.sum("n").alias("_t"),
                       F.count(F.lit(1)).alias("_k"))
    joined = table.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one")

    def term(observed: str, side: str) -> Column:
        expected = F.col("n") * F.col(side) / F.col("_t")
        gap = F.abs(F.col(observed) - expected)
        gap = gap - F.when(F.col("_k") == 2, F.least(F.lit(0.5), gap)).otherwise(0.0)
        return F.try_divide(F.pow(gap, 2), expected)  # unknown where a class is empty

    row = joined.agg(
        F.max("_t").alias("n"), F.greatest(F.max("_k") - 1, F.lit(1)).cast("int").alias("dof"),
        F.sum(term("pos", "_p") + term("neg", "_q")).alias("statistic"))
    named = row.select(F.lit(category).alias("category"), "*")
    return with_value(named, chi_square_p, ["statistic", "dof"], "p_value")


def rate_spread(df: DataFrame, category: str, label: str = "y") -> DataFrame:
    return cross_tab(df, category, label).agg((F.max("rate_pct") - F.min("rate_pct")).alias("spread_pct"))


def odds_ratio(df: DataFrame, exposed: Column, label: str = "y") -> DataFrame:
    """(a/b)/(c/d) of a yes/no exposure."""
    cell = lambda e, y: F.count_if((exposed == F.lit(e)) & (F.col(label) == y)).cast("double")
    a, b, c, d = cell(True, 1), cell(True, 0), cell(False, 1), cell(False, 0)
    return df.agg(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).select(
        *[F.col(x).cast("long").alias(x) for x in "abcd"],
        ((F.col("a") / F.nullif(F.col("b"), F.lit(0.0))) / F.nullif(
            F.col("c") / F.nullif(F.col("d"), F.lit(0.0)), F.lit(0.0))).alias("odds_ratio"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson_r"))


def label_correlations(df: DataFrame, features: Sequence[str], label: str = "y", fill: dict | None = None) -> DataFrame:
    """Correlation of every feature with the label, one aggregate for all of them."""
    fill = fill or {}
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(fill.get(f)).cast("double"))
    row = df.where(F.col(label).isNotNull()).agg(*[
        F.corr(value(f), F.col(label).cast("double")).alias(f) for f in features])
    return row.unpivot([], list(features), "feature", "r")


def correlation_matrix(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Model-by-model Pearson matrix of complete rows, in long form."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v", handleInvalid="skip").transform(wide)
    matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
    rows = [(a, b, float(matrix[i][j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return wide.sparkSession.createDataFrame(rows, "a string, b string, r double")


def rank_agreement(joined: DataFrame, a: str = "rank_a", b: str = "rank_b") -> DataFrame:
    """Spearman of two joined rankings (ties share a midrank); NULL below three shared entries."""
    ra = ordered.value_ranks(joined, a).select(a, F.col("midrank").alias("ra"))
    rb = ordered.value_ranks(joined, b).select(b, F.col("midrank").alias("rb"))
    n = F.count(F.lit(1))
    return joined.join(ra, a).join(rb, b).agg(n.alias("n"), F.when(n >= 3, F.corr("ra", "rb")).alias("spearman"))


def set_agreement(a: DataFrame, b: DataFrame, key: str = "feature") -> DataFrame:
    """Jaccard and overlap of two feature sets."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(
        b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    shared = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.agg(
        shared.alias("shared"), F.try_divide(shared, F.count(F.lit(1))).alias("jaccard"),
        F.try_divide(shared, F.least(F.count("_a"), F.count("_b"))).alias("overlap"))


def mann_whitney(df: DataFrame, value: str, label: str = "y", by: Sequence[str] = (), splits=None) -> DataFrame:
    """U of the positives, tie-corrected z and two-sided p (normal approximation with continuity)."""
    curve = metrics.score_curve(df.withColumn(value, F.col(value).cast("double")), label, value, by, splits)
    size = (F.col("pos") + F.col("neg")).cast("double")
    table = curve.groupBy(*by).agg(
        F.max("pos_all").cast("double").alias("n1"), F.max("neg_all").cast("double").alias("n2"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"),
        F.sum(F.pow(size, 3) - size).alias("ties"))
    n = F.col("n1") + F.col("n2")
    variance = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    gap = F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5, F.lit(0.0))
    return with_p(table.withColumn("z", F.try_divide(gap, F.sqrt(variance))).drop("ties"))


def with_value(df: DataFrame, function: Callable[..., float], columns: Sequence[str], out: str) -> DataFrame:
    """Append a plain Python function of summary columns, in Arrow batches."""
    def add(batches):
        for pdf in batches:
            known = pdf[list(columns)].notna().all(axis=1)
            pdf[out] = [function(*row) if ok else None
                        for ok, row in zip(known, pdf[list(columns)].itertuples(index=False, name=None))]
            pdf[out] = pdf[out].astype("float64")
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(add, f"{schema}, {out} double")


def with_p(df: DataFrame, z: str = "z", out: str = "p_value") -> DataFrame:
    """Two-sided normal p of a z column on summary rows (Spark SQL has no erf)."""
    return with_value(df, two_sided_p, [z], out)


def oriented_auc(df: DataFrame, features: Sequence[str], label: str = "y") -> DataFrame:
    """Univariate AUC of each feature, its oriented form and the class means."""
    long = df.where(F.col(label).isNotNull()).select(label, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [label], list(features), "feature", "value").where(F.col("value").isNotNull())
    curve = metrics.score_curve(long, label, "value", ["feature"])
    mean = lambda side: F.sum(F.col("value") * F.col(side)) / F.nullif(F.sum(side), F.lit(0))
    auc = metrics.auc_agg()
    return curve.groupBy("feature").agg(
        auc.alias("auc"), F.greatest(auc, 1 - auc).alias("auc_oriented"),
        mean("pos").alias("mean_positive"), mean("neg").alias("mean_negative"))


def placements(df: DataFrame, label: str, score: str, splits=None) -> DataFrame:
    """Per distinct score: share of negatives it beats and share of positives that beat it."""
    curve = metrics.score_curve(df, label, score, splits=splits)
    return curve.select(
        score,
        metrics.ratio(F.col("neg_before") + F.col("neg") / 2, F.col("neg_all").cast("double")).alias("beats"),
        metrics.ratio(F.col("pos_all") - F.col("pos_before") - F.col("pos") / 2,
                      F.col("pos_all").cast("double")).alias("beaten"))


def paired_auc_test(df: DataFrame, a: str = "p", b: str = "q", label: str = "y", keep_p: bool = True) -> DataFrame:
    """DeLong test of two scores on the same rows: AUCs, difference, z, two-sided p.

    Rows collapse to distinct (a, b, label) first; placements come from each
    score's running counts, and class covariances from weighted moments, so no
    step ranks rows globally.
    """
    known = df.where(F.col(label).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = known.groupBy(a, b).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    pa = placements(known, label, a).select(a, F.col("beats").alias("xa"), F.col("beaten").alias("ya"))
    pb = placements(known, label, b).select(b, F.col("beats").alias("xb"), F.col("beaten").alias("yb"))
    placed = pairs.join(pa, a).join(pb, b)

    def moments(weight: str, u: str, v: str) -> list[Column]:
        w = F.col(weight)
        return [F.sum(w).cast("double").alias(f"n_{u}"), F.sum(w * F.col(u)).alias(f"s_{u}"),
                F.sum(w * F.col(v)).alias(f"s_{v}"), F.sum(w * F.col(u) * F.col(u)).alias(f"q_{u}"),
                F.sum(w * F.col(v) * F.col(v)).alias(f"q_{v}"), F.sum(w * F.col(u) * F.col(v)).alias(f"q_{u}{v}")]

    sums = placed.agg(*moments("pos", "xa", "xb"), *moments("neg", "ya", "yb"))

    def gap_variance(u: str, v: str) -> Column:
        n = F.col(f"n_{u}")
        mean = F.try_divide(F.col(f"s_{u}") - F.col(f"s_{v}"), n)
        square = F.col(f"q_{u}") + F.col(f"q_{v}") - 2 * F.col(f"q_{u}{v}")
        return F.try_divide(F.try_divide(square - n * mean * mean, n - 1), n)

    variance = gap_variance("xa", "xb") + gap_variance("ya", "yb")
    out = sums.select(
        metrics.ratio(F.col("s_xa"), F.col("n_xa")).alias("auc_a"), metrics.ratio(F.col("s_xb"), F.col("n_xa")).alias("auc_b"),
        variance.alias("variance")).select(
        "auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("delta"),
        F.when(F.col("variance") > 0, F.try_divide(F.col("auc_a") - F.col("auc_b"), F.sqrt("variance")))
        .when(F.col("variance").isNotNull(), 0.0).alias("z"))
    return with_p(out) if keep_p else out


def tie_tier(oof: DataFrame, alpha: float = 0.05, key: str = "id", label: str = "y") -> DataFrame:
    """Every model against the best by AUC, with the verdict at ``alpha``.

    ``oof`` is long (model, id, y, p). The loop runs over models, never rows.
    """
    aucs = metrics.roc_auc(oof, label, "p", ["model"]).orderBy(F.desc("auc_roc"), "model").collect()
    best = aucs[0]["model"]
    base = oof.where(F.col("model") == best).select(key, label, F.col("p").alias("q"))
    rows = [(best, float(aucs[0]["auc_roc"]), 0.0, None, "--")]
    for row in aucs[1:]:
        other = oof.where(F.col("model") == row["model"]).select(key, "p")
        test = paired_auc_test(base.join(other, key), "p", "q", label).first()
        verdict = "indistinguishable" if test["p_value"] >= alpha else "worse"
        rows.append((row["model"], float(row["auc_roc"]), float(test["delta"]), float(test["p_value"]), verdict))
    return oof.sparkSession.createDataFrame(
        rows, "model string, oof_auc double, delta double, p_value double, verdict string")


#: Metrics that :func:`exact_bootstrap` knows.
EXACT = ("auc_roc", "auc_pr", "sensitivity")
#: Distinct scores whose replicate weights are held at once.
CELLS_AT_ONCE = 256


def _weights(seed: int, unit: str, cells: pd.DataFrame, n_boot: int) -> tuple[np.ndarray, np.ndarray]:
    """Poisson weights of the positives and negatives of each cell: column 0 has the counts themselves.

    A cell's draws depend on the seed, its key and its score alone, wherever it is computed.
    """
    out = np.empty((2, len(cells), n_boot + 1))
    own = zlib.crc32(unit.encode())
    for i, (score, *counts) in enumerate(cells[["s", "pos", "neg"]].itertuples(index=False)):
        rng = np.random.default_rng([seed, own, int(np.float64(score).view(np.uint64))])
        for side, count in enumerate(counts):
            out[side, i, 0] = count
            out[side, i, 1:] = rng.poisson(count, n_boot)
    return out[0], out[1]


def exact_bootstrap(df: DataFrame, label: str = "y", score: str = "p", of: Sequence[str] = EXACT, n_boot: int = 2000, alpha: float = 0.05,
                    seed: int = 42, by: Sequence[str] = (), threshold: float | None = None, hist: DataFrame | None = None) -> DataFrame:
    """Bootstrap percentile intervals over all distinct scores: keys, metric, point, lo, hi, n_boot.

    Every row gets a Poisson(1) weight in each replicate; the rows of one class and
    score together get a Poisson weight of their number. Each range bucket of scores adds
    up arrays with an element a replicate; the totals of the buckets above are carried
    into it, then its share of each metric is added up element by element. Replicates
    without a class are left out and not counted. ``threshold`` fixes where sensitivity
    is taken; without it that is each replicate's own Youden point. No score is rounded,
    and the result does not depend on partitioning.
    """
    cells = metrics.score_histogram(df, label, score, by) if hist is None else hist
    cells = cells.select(*by, F.col(score).cast("double").alias("s"), "pos", "neg").where("pos + neg > 0")
    unit = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    splits = ordered.range_splits(cells, "s")
    cells = ordered.with_bucket(cells, "s", splits).select(unit.alias("unit"), F.to_json(unit).alias("name"), "_bucket", "s", "pos", "neg")
    cells = materialise(cells, "cells")
    width = n_boot + 1

    def parts(rows: pd.DataFrame):
        rows = rows.sort_values("s", ascending=False)
        for a in range(0, len(rows), CELLS_AT_ONCE):
            some = rows.iloc[a : a + CELLS_AT_ONCE]
            yield some["s"].to_numpy(), *_weights(seed, rows["name"].iloc[0], some, n_boot)

    def totals(rows: pd.DataFrame) -> pd.DataFrame:
        pos, neg = np.zeros(width), np.zeros(width)
        for _, p, n in parts(rows):
            pos += p.sum(axis=0)
            neg += n.sum(axis=0)
        return pd.DataFrame({"name": [rows["name"].iloc[0]], "_bucket": [rows["_bucket"].iloc[0]], "pos": [pos], "neg": [neg]})

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_bucket", ascending=False)  # one row a bucket
        pos, neg = np.cumsum(np.stack(rows["pos"]), axis=0), np.cumsum(np.stack(rows["neg"]), axis=0)
        return pd.DataFrame({
            "name": rows["name"], "_bucket": rows["_bucket"], "tp": list(pos - np.stack(rows["pos"])), "fp": list(neg - np.stack(rows["neg"])),
            "all_pos": [pos[-1]] * len(rows), "all_neg": [neg[-1]] * len(rows)})

    def shares(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        tp, fp, all_pos, all_neg = (np.array(above[c].iloc[0]) for c in ("tp", "fp", "all_pos", "all_neg"))
        auc, ap, best, at = np.zeros(width), np.zeros(width), np.full(width, -np.inf), np.zeros(width)
        with np.errstate(divide="ignore", invalid="ignore"):
            for scores, p, n in parts(rows):
                up_p, up_n = tp + np.cumsum(p, axis=0), fp + np.cumsum(n, axis=0)
                auc += (p * (all_neg - up_n + n / 2)).sum(axis=0)
                ap += np.where(p > 0, p * up_p / (up_p + up_n), 0.0).sum(axis=0)
                if threshold is None:
                    gain = up_p / all_pos - up_n / all_neg
                    top = np.argmax(gain, axis=0)  # the first from the top
                    here = np.take_along_axis(gain, top[None], axis=0)[0]
                    better = here > best
                    at = np.where(better, np.take_along_axis(up_p, top[None], axis=0)[0], at)
                    best = np.where(better, here, best)
                else:
                    at += p[scores >= threshold].sum(axis=0)
                tp, fp = up_p[-1], up_n[-1]
        return pd.DataFrame({
            "name": [rows["name"].iloc[0]], "_bucket": [rows["_bucket"].iloc[0]], "auc": [auc], "ap": [ap], "best": [best], "at": [at],
            "pos": [all_pos], "neg": [all_neg]})

    def intervals(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_bucket", ascending=False)  # one row a bucket
        pos, neg, at, best = (np.stack(rows[c]) for c in ("pos", "neg", "at", "best"))
        pos, neg = pos[0], neg[0]
        if threshold is None:
            top = np.argmax(best, axis=0)
            found = np.take_along_axis(at, top[None], axis=0)[0]
            found = np.where(best.max(axis=0) > 0, found, 0.0)
        else:
            found = at.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            values = {"auc_roc": np.stack(rows["auc"]).sum(axis=0) / (pos * neg), "auc_pr": np.stack(rows["ap"]).sum(axis=0) / pos, "sensitivity": found / pos}
        there = (pos > 0) & (neg > 0)
        out = []
        for name in of:
            drawn = values[name][1:][there[1:]]
            ends = [float(x) for x in np.percentile(drawn, [100 * alpha / 2, 100 * (1 - alpha / 2)])] if len(drawn) else [None, None]
            out.append((rows["name"].iloc[0], name, float(values[name][0]) if there[0] else None, *ends, len(drawn)))
        return pd.DataFrame(out, columns=["name", "metric", "point", "lo", "hi", "n_boot"]).astype({"point": float, "lo": float, "hi": float})

    vector = lambda *names: ", ".join(f"{n} array<double>" for n in names)
    head = "name string, _bucket int, "
    # One row a bucket and key, so a task holds buckets x replicates.
    carried = cells.groupBy("name", "_bucket").applyInPandas(totals, head + vector("pos", "neg")).groupBy("name").applyInPandas(
        carry, head + vector("tp", "fp", "all_pos", "all_neg"))
    found = cells.groupBy("name", "_bucket").cogroup(carried.groupBy("name", "_bucket")).applyInPandas(
        shares, head + vector("auc", "ap", "best", "at", "pos", "neg"))
    found = found.groupBy("name").applyInPandas(intervals, "name string, metric string, point double, lo double, hi double, n_boot int")
    units = cells.select("name", "unit").distinct()
    missing = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.join(F.broadcast(units), "name").select(
        *[F.col(f"unit.{c}").alias(c) for c in by], "metric", missing("point"), missing("lo"), missing("hi"), F.col("n_boot").cast("long").alias("n_boot"))


def bootstrap_interval(df: DataFrame, label: str = "y", score: str = "p", metric: str = "auc_roc", n_boot: int = 2000,
                       digits: int | None = None, alpha: float = 0.05, seed: int = 42, by: Sequence[str] = (),
                       threshold: float | None = None, hist: DataFrame | None = None) -> DataFrame:
    """Stratified bootstrap percentile interval of one metric, at ``threshold`` or at each draw's own Youden point.

    ``hist`` may give the counts (key, score, pos, neg) in place of rows.

    The metrics in EXACT use every distinct score (see :func:`exact_bootstrap`), unless
    ``digits`` is given. Then, and for other metrics (to 3 digits), rows collapse to
    counts per rounded score. Drawing those counts per class from a multinomial is the
    same as drawing the rows, so a replicate costs the number of score cells (at most
    10^digits + 1), not the number of rows.
    """
    if digits is None and metric in EXACT:
        whole = exact_bootstrap(df, label, score, [metric], n_boot, alpha, seed, by, threshold, hist)
        return whole.select(*by, "point", "lo", "hi", "n_boot")
    digits = 3 if digits is None else digits
    if hist is None:
        cells = metrics.score_histogram(df.withColumn(score, F.round(F.col(score), digits)), label, score, by)
    else:
        cells = hist.groupBy(*by, F.round(F.col(score), digits).alias(score)).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cells = cells.withColumn(
        "unit", F.struct(*by) if by else F.struct(F.lit(0).alias("all")))
    packed = cells.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct(score, "pos", "neg"))).alias("_cells"))
    reps = packed.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot)))).repartition("unit", "replicate")
    drawn = reps.select(
        "unit", "replicate", F.col("_cells").getField(score).alias("_s"),
        F.col("_cells.pos").alias("_pos"), F.col("_cells.neg").alias("_neg"))
    drawn = drawn.select("unit", "replicate", "_s", _resample(seed)("replicate", "_pos", "_neg").alias("_d"))
    flat = drawn.select("unit", "replicate", F.explode(F.arrays_zip(
        F.col("_s").alias(score), F.col("_d.pos").alias("pos"), F.col("_d.neg").alias("neg"))).alias("c")).select(
        "unit", "replicate", "c.*").where(F.col("pos") + F.col("neg") > 0)
    # A replicate's cells are few, so one window per replicate orders them.
    curve = metrics.score_curve(flat, score=score, by=["unit", "replicate"], splits=[], hist=flat)
    values = metrics.summarise_curve(curve, score, ["unit", "replicate"], threshold).select(
        "unit", "replicate", F.col(metric).cast("double").alias("_m")).where(F.col("_m").isNotNull())
    resampled = F.col("replicate") > 0
    out = values.groupBy("unit").agg(
        F.max(F.when(~resampled, F.col("_m"))).alias("point"),
        F.percentile(F.when(resampled, F.col("_m")), alpha / 2).alias("lo"),  # n_boot values
        F.percentile(F.when(resampled, F.col("_m")), 1 - alpha / 2).alias("hi"),
        F.count_if(resampled).alias("n_boot"))
    return out.select(*[F.col(f"unit.{c}").alias(c) for c in by], "point", "lo", "hi", "n_boot")


def _resample(seed: int):
    def draw(replicate: pd.Series, pos: pd.Series, neg: pd.Series) -> pd.DataFrame:
        out = {"pos": [], "neg": []}
        for rep, p, n in zip(replicate, pos, neg):
            rng = np.random.default_rng([seed, int(rep)])
            for name, counts in (("pos", p), ("neg", n)):
                counts = np.asarray(counts, dtype="int64")
                total = counts.sum()
                fresh = rep > 0 and total > 0
                out[name].append(rng.multinomial(total, counts / total) if fresh else counts)
        return pd.DataFrame(out)

    return F.pandas_udf(draw, "pos array<long>, neg array<long>")
