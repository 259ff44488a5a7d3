"""Data-quality checks as one-row frames (check, passed, detail) that can be rolled up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..sources.tables import forbidden_present
from . import aggregates, relations, splits, stats


def outcome(df: DataFrame, check: str, passed: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), passed.alias("passed"), detail.cast("string").alias("detail"))


def no_identifiers(df: DataFrame, features: Sequence[str], cut: float = 0.5) -> DataFrame:
    """No banned column and no near-unique feature."""
    banned = forbidden_present(df.columns)
    worst = aggregates.cardinality_audit(df, features, cut).agg(F.max("share").alias("worst"))
    return outcome(worst, "no identifier features", F.coalesce(F.col("worst") < cut, F.lit(True)) & F.lit(not banned),
                   F.concat(F.lit("largest share "), F.round("worst", 4).cast("string")))


def label_blind(df: DataFrame, key: str, outcome_columns: Sequence[str], build: Callable[[DataFrame], DataFrame],
                seed: int = 0) -> DataFrame:
    """Features must be identical when the outcome columns are shuffled."""
    shuffled = splits.permute(df, list(outcome_columns), key, seed)
    before, after = build(df), build(shuffled)
    changed = relations.frame_differences(before, after).agg(F.count(F.lit(1)).alias("n_changed"), F.lit(1).alias("_one"))
    total = df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(1).alias("_one"))
    return total.join(F.broadcast(changed), "_one").select(
        F.lit("label-blind features").alias("check"), (F.col("n_changed") == 0).alias("passed"), "n_rows", "n_changed")


def label_policy(df: DataFrame, min_unlabelled: int, low: float, high: float, label: str = "y") -> DataFrame:
    """Unrecorded outcomes are still unrecorded and prevalence is in its band."""
    s = aggregates.label_summary(df, label)
    rate = F.col("prevalence_labelled")
    return outcome(s, "label policy", (F.col("n_unlabelled") >= min_unlabelled) & rate.between(low, high),
                   F.concat(F.lit("prevalence "), F.round(rate, 4).cast("string")))


def label_proxies(df: DataFrame, features: Sequence[str], label: str = "y", limit: float = 0.95, min_values: int = 10) -> DataFrame:
    """No feature with enough values may nearly equal the outcome after median fill."""
    known = df.where(F.col(label).isNotNull())
    table = stats.label_correlations(known, features, label, aggregates.exact_medians(known, features))
    counts = known.agg(*[F.count(f).alias(f) for f in features]).unpivot([], list(features), "feature", "n_values")
    proxy = (F.abs("r") >= limit) & (F.col("n_values") >= min_values)
    return table.join(F.broadcast(counts), "feature").withColumn("passed", ~F.coalesce(proxy, F.lit(False)))


def finite_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All features are doubles and hold no NaN or infinity."""
    types = dict(df.dtypes)
    wrong = [f for f in features if types[f] != "double"]
    bad = sum(F.count_if(F.isnan(f) | (F.abs(F.col(f)) == float("inf"))) for f in features if f not in wrong)
    return outcome(df.agg(F.lit(0).alias("_z") if not len(features) - len(wrong) else bad.alias("_z")), "finite matrix",
                   (F.col("_z") == 0) & F.lit(not wrong), F.concat(F.lit("bad cells "), F.col("_z").cast("string")))


def split_hygiene(df: DataFrame, group: str, columns: Sequence[str], side: str = "is_test") -> DataFrame:
    """Both sides are filled, no group straddles, and no test row is a copy of a training row."""
    sizes = df.agg(F.count_if(F.col(side)).alias("n_test"), F.count_if(~F.col(side)).alias("n_train"), F.lit(1).alias("_one"))
    one = lambda frame, name: F.broadcast(frame.agg(F.count(F.lit(1)).alias(name), F.lit(1).alias("_one")))
    straddle = one(relations.straddling_groups(df, group, side), "n_straddling")
    copies = one(relations.rows_also_in(df.where(F.col(side)), df.where(~F.col(side)), columns), "n_copied")
    table = sizes.join(straddle, "_one").join(copies, "_one")
    clean = (F.col("n_test") > 0) & (F.col("n_train") > 0) & (F.col("n_straddling") == 0) & (F.col("n_copied") == 0)
    return outcome(table, "split hygiene", clean, F.concat_ws(" ", *[F.col(c).cast("string") for c in (
        "n_test", "n_train", "n_straddling", "n_copied")]))


def baseline_shipped(metric_rows: DataFrame) -> DataFrame:
    """Every accuracy stands next to its majority-class baseline."""
    both = F.count_if(F.col("accuracy").isNotNull() & F.col("majority_accuracy").isNull())
    return outcome(metric_rows.agg(both.alias("_bare")), "accuracy with baseline", F.col("_bare") == 0, F.col("_bare"))


def roll_up(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks in one table; a NULL result is a skipped check."""
    frame = checks[0].select("check", "passed", "detail")
    for other in checks[1:]:
        frame = frame.unionByName(other.select("check", "passed", "detail"))
    return frame.withColumn("state", F.when(F.col("passed").isNull(), "skip").when(F.col("passed"), "pass").otherwise("fail"))


def provenance(df: DataFrame, identifier: str = "Patient_ID", category: str = "Ethnicity", exposure: str = "Family_History",
               pair: tuple[str, str] = ("Age_at_Diagnosis", "Exposure_Days"), label: str = "y") -> DataFrame:
    """Four signatures of generated covariates: id pattern, flat category, typed-in odds ratio, tight pair."""
    long = lambda frame, name, value: frame.select(F.lit(name).alias("signature"), F.col(value).cast("double").alias("value"))
    trimmed = df.withColumn(category, F.trim(category)).withColumns({c: F.col(c).try_cast("double") for c in pair})
    parts = [
        long(aggregates.pattern_share(df, identifier, fv.UUID4_PATTERN), "share of random ids", "share_matching"),
        long(stats.rate_spread(trimmed, category, label), "rate spread over category, points", "spread_pct"),
        long(stats.chi_square(trimmed, category, label), "category p", "p_value"),
        long(stats.odds_ratio(df, F.col(exposure).cast("string") == "1", label), "exposure odds ratio", "odds_ratio"),
        long(stats.chi_square(df, exposure, label), "exposure p", "p_value"),
        long(stats.pearson(trimmed, *pair), "pair correlation", "pearson_r"),
    ]
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part)
    return frame
