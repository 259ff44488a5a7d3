"""Cohort summaries, rates and audits as plain grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import squeeze, strip
from ..session import small_side
from . import ordered


def _share(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def label_summary(df: DataFrame, label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Counts per state and prevalence with unknowns left out and called negative."""
    pos, neg, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0), F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("n_total"), pos.alias("n_positive"), neg.alias("n_negative"),
        F.count_if(F.col(label).isNull()).alias("n_unlabelled"), F.count(label).alias("n_labelled"),
        _share(pos, F.count(label)).alias("prevalence_labelled"),
        _share(pos, n).alias("prevalence_if_unknown_negative"))


def registry_summary(df: DataFrame, label: str = "y", variant: str = "mut_id", study: str = "study") -> DataFrame:
    """Label counts plus distinct variants and studies among labelled records.

    The two distinct counts are separate two-stage aggregates, so neither
    multiplies the rows of the other.
    """
    counts = label_summary(df, label).select(
        F.col("n_total").alias("n_records"), "n_labelled", "n_unlabelled", "n_positive", "n_negative",
        F.col("prevalence_labelled").alias("prevalence"))
    known = df.where(F.col(label).isNotNull())
    distinct = lambda c, name: known.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1)).alias(name))
    # Three one-row frames side by side.
    one = F.lit(1).alias("_one")
    frames = [counts, distinct(variant, "n_variants_labelled"), distinct(study, "n_studies_labelled")]
    first, *rest = [f.select("*", one) for f in frames]
    for frame in rest:
        first = first.join(F.broadcast(frame), "_one")
    return first.drop("_one")


def group_extent(df: DataFrame, group: str, position: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Inner extent of the positions of each group, with its row count and length of at least 1."""
    ranks = ordered.quantiles(df, position, [low, high], [group])
    counts = df.where(F.col(position).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n_obs"))
    bounds = ranks.groupBy(group).agg(
        F.max(F.when(F.col("prob") == low, F.col("value"))).alias("start"),
        F.max(F.when(F.col("prob") == high, F.col("value"))).alias("end"))
    return bounds.join(counts, group).withColumn("length", F.greatest(F.col("end") - F.col("start") + 1, F.lit(1.0)))


def category_load(df: DataFrame, category: Column, out: str = "load") -> DataFrame:
    """log(1 + rows) per category."""
    return df.groupBy(category.alias("category")).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias(out))


def with_category_load(df: DataFrame, loads: DataFrame, category: Column, out: str = "load") -> DataFrame:
    """Left join to stored loads; an unseen category loads 0."""
    dim = loads.select(F.col("category").alias("_category"), F.col(loads.columns[-1]).alias("_load"))
    return (
        df.join(small_side(dim), category == F.col("_category"), "left")
        .withColumn(out, F.coalesce("_load", F.lit(0.0))).drop("_category", "_load"))


def outcome_rate(df: DataFrame, by: Sequence[str], label: str = "y", min_rows: int = 25) -> DataFrame:
    """Size, events and rate among labelled rows of each group with enough of them."""
    return (
        df.where(F.col(label).isNotNull()).groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("n_positive"),
             F.avg(F.col(label).cast("double")).alias("rate"))
        .where(F.col("n") >= min_rows).orderBy("rate", *by))


def value_counts(df: DataFrame, column: str, blank: str = "(blank)") -> DataFrame:
    key = F.lower(strip(F.coalesce(F.col(column).cast("string"), F.lit(blank))))
    return df.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("records"))


def cardinality_audit(df: DataFrame, features: Sequence[str], cut: float = 0.5) -> DataFrame:
    """Distinct values per row and feature, and whether it looks like an identifier.

    Features become (feature, value) pairs that combine map-side, so all exact
    counts come from one scan and one shuffle of distinct pairs. The share is over all rows.
    """
    text = df.select(*[F.col(f).cast("string").alias(f) for f in features])
    pairs = text.unpivot([], list(features), "feature", "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    share = F.try_divide(F.count("value"), F.sum("_n"))
    out = pairs.groupBy("feature").agg(F.count("value").alias("n_distinct"), share.alias("share"))
    return out.withColumn("identifier_like", F.col("share") >= cut)


def pattern_share(df: DataFrame, column: str, pattern: str = fv.UUID4_PATTERN) -> DataFrame:
    """Rows, distinct ids and the share of ids that follow a pattern."""
    ids = df.groupBy(F.col(column).cast("string").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return ids.agg(
        F.count("_id").alias("n_unique"), F.sum("_n").alias("n_rows"),
        (F.sum(F.when(F.col("_id").rlike(pattern), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("share_matching"))


def group_outcomes(df: DataFrame, group: str, label: str = "y") -> DataFrame:
    known = df.where(F.col(label).isNotNull())
    return known.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("low"), F.max(label).alias("high"),
        F.sum(label).alias("pos"))


def discordance(df: DataFrame, group: str, label: str = "y") -> DataFrame:
    """Groups with two or more recorded outcomes, those that disagree, and the rows inside them."""
    multi = F.col("n") >= 2
    split = multi & (F.col("low") < F.col("high"))
    return group_outcomes(df, group, label).agg(
        F.count_if(multi).alias("groups_2plus"), F.count_if(split).alias("discordant_groups"),
        _share(F.count_if(split), F.count_if(multi)).alias("discordance_rate"),
        F.coalesce(F.sum(F.when(split, F.col("n"))), F.lit(0)).alias("rows_in_discordant"))


def group_table(df: DataFrame, group: str, features: Sequence[str], label: str = "y") -> DataFrame:
    """One row per group: averaged features and the majority label."""
    rate = F.avg(F.col(label).cast("double"))
    return df.where(F.col(label).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), (rate > 0.5).cast("int").alias("y"),
        *[F.avg(f).alias(f) for f in features])


def relabel_cost(df: DataFrame, group: str, label: str = "y") -> DataFrame:
    """What calling unrecorded groups negative does to prevalence."""
    groups = df.groupBy(group).agg(F.count(label).alias("known"), F.max(label).alias("any_pos"), F.count(F.lit(1)).alias("n"))
    recorded = F.col("known") > 0
    pos = F.count_if(F.col("any_pos") == 1)
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(recorded).alias("n_recorded"),
        F.count_if(~recorded).alias("n_called_negative_unrecorded"),
        _share(pos, F.count_if(recorded)).alias("prevalence_recorded"),
        _share(pos, F.count(F.lit(1))).alias("prevalence_relabelled"))


def pool_risk(df: DataFrame, score: str = "p", cut: float = 0.5) -> DataFrame:
    """Mean, exact median and share at or over ``cut`` of an unlabelled pool's scores."""
    median = ordered.quantiles(df, score, [0.5]).select(F.col("value").alias("median_risk"), F.lit(1).alias("_one"))
    rest = df.agg(
        F.count(score).alias("n_unlabelled"), F.avg(score).alias("mean_risk"),
        F.count_if(F.col(score) >= cut).alias("n_over"), F.lit(1).alias("_one"))
    return rest.join(F.broadcast(median), "_one").withColumn(
        "share_over", _share(F.col("n_over"), F.col("n_unlabelled"))).drop("_one")


def block_rollup(attributions: DataFrame, blocks: DataFrame, value: str = "value") -> DataFrame:
    """Mean absolute attribution summed per block, with its share.

    ``blocks`` maps each feature once to its block; it has one row per feature.
    """
    per_feature = attributions.groupBy("feature").agg(F.avg(F.abs(F.col(value))).alias("mean_abs"))
    rolled = per_feature.join(F.broadcast(blocks), "feature").groupBy("block").agg(
        F.sum("mean_abs").alias("mean_abs"), F.count(F.lit(1)).alias("n_features"))
    return ordered.share_of_total(rolled, "mean_abs")


def fold_summary(df: DataFrame, value: str = "auc_roc", by: Sequence[str] = ("model",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("folds"))


def average_repeats(oof: DataFrame, by: Sequence[str] = ("model", "id"), label: str = "y") -> DataFrame:
    return oof.groupBy(*by).agg(F.max(label).alias(label), F.avg("p").alias("p"), F.count(F.lit(1)).alias("repeats"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
        (F.sum("_n") - F.count(F.lit(1))).alias("n_duplicates"))


def exact_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Median per feature: values combine to counts first, so a frequent value is one row."""
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("feature").agg(F.percentile("value", 0.5, F.col("n")).alias("median")).collect()
    by = {r["feature"]: r["median"] for r in found}
    return {f: by[f] for f in features if f in by}
