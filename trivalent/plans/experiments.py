"""Ablations, leakage audits, semi-supervision, transfer and attributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import metrics, relations, splits, stats
from ..session import materialise, small_side
from . import models


# --- ablation ---------------------------------------------------------------------

def block_sets(blocks: dict[str, list[str]]) -> dict[str, list[str]]:
    """Feature sets of an ablation: each block alone, all but each, and the growing ladder."""
    every = [f for fs in blocks.values() for f in fs]
    sets = {f"only:{b}": fs for b, fs in blocks.items()}
    sets |= {f"without:{b}": [f for f in every if f not in fs] for b, fs in blocks.items()}
    ladder: list[str] = []
    for i, (block, fs) in enumerate(blocks.items()):
        ladder = ladder + fs
        sets[f"ladder:{i + 1}:{block}"] = ladder
    return {name: fs for name, fs in sets.items() if fs}


def ablate(df: DataFrame, sets: dict[str, list[str]], factory: models.Factory) -> DataFrame:
    """Out-of-fold AUC per feature set, on the same stored folds; sets of equal features are fitted once."""
    every = sorted({f for fs in sets.values() for f in fs})
    return _ablate_stored(models.fold_table(df, ["id", "fold", "y", *every]), sets, factory)


def _ablate_stored(table: DataFrame, sets: dict[str, list[str]], factory: models.Factory) -> DataFrame:
    def measure(fs: tuple[str, ...]) -> float:
        oof = models.out_of_fold(table, fs, factory, ",".join(fs), parallelism=2)
        return float(metrics.roc_auc(oof).first()["auc_roc"])

    different = list(dict.fromkeys(tuple(fs) for fs in sets.values()))
    auc = dict(zip(different, models.at_once([lambda f=fs: measure(f) for fs in different])))
    rows = [(name, len(fs), auc[tuple(fs)]) for name, fs in sets.items()]
    return table.sparkSession.createDataFrame(rows, "feature_set string, n_features int, auc_roc double")


def forest_ranking(model: PipelineModel, features: Sequence[str]) -> list[str]:
    weights = model.stages[-1].featureImportances.toArray()
    return [f for _, f in sorted(zip(-weights, features))]


def top_k_sweep(df: DataFrame, features: Sequence[str], ks: Sequence[int], ranker: models.Factory,
                factory: models.Factory) -> DataFrame:
    """AUC of the ``ks`` best features by the ranker, which is fitted on all labelled rows.

    Features and folds are computed and stored once. The ranker's rows are dealt evenly
    over the cores: a forest passes over them many times, and the parts of a scan are as
    few as the source has files or row groups.
    """
    table = models.fold_table(df, ["id", "fold", "y", *sorted(features)])
    chosen = models.usable(table, features)
    cores = df.sparkSession.sparkContext.defaultParallelism
    even = materialise(table.where("y IS NOT NULL").select("y", *chosen).repartition(cores), "ranked_rows")
    order = forest_ranking(models.fit(even, chosen, ranker), chosen)
    return _ablate_stored(table, {f"top:{n}": order[:n] for n in ks}, factory)


# --- leakage audit -----------------------------------------------------------------

def encode_everything(df: DataFrame, outcome: str, key: str = "id", patterns=fv.UNTRUSTED_PATTERNS) -> tuple[DataFrame, list[str]]:
    """The careless preprocessing the audit measures: every remaining text column label-encoded."""
    kept = [c for c in df.columns if c not in (key, outcome) and not any(p in c.lower() for p in patterns)]
    filled = df.select(key, outcome, *[
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("Unknown")).alias(c) for c in kept])
    codes = materialise(relations.label_codes(filled, kept), "codes")
    return relations.with_codes(filled, codes, kept), kept


def _fit_and_score(df: DataFrame, features: Sequence[str], factory: models.Factory, name: str) -> tuple:
    model = models.fit(df.where("NOT is_test"), features, factory)
    both = materialise(models.score(model, df.where("y IS NOT NULL"), ["y", "is_test"]), "audit")
    rows = metrics.accuracy_with_baseline(both, 0.5, by=["is_test"]).join(metrics.roc_auc(both, by=["is_test"]), "is_test")
    got = {r["is_test"]: r for r in rows.collect()}
    test, train = got[True], got[False]
    return (name, float(test["accuracy"]), test["auc_roc"], float(train["accuracy"]), train["auc_roc"],
            float(test["prevalence"]), float(test["majority_accuracy"]))


def leakage_audit(df: DataFrame, coded_features: Sequence[str], identifiers: Sequence[str], factory: models.Factory,
                  key: str = "id", label: str = "y", position: str = "pos", seed: int = 42) -> DataFrame:
    """The same model under seven protocols, each changing one thing.

    ``df`` holds key, tri-state ``label``, ``position`` and encoded features.
    """
    base = materialise(df.select(key, F.col(label).alias("honest"), F.col(position).alias("_at"), *coded_features), "audit")
    padded = base.withColumn("y", F.coalesce("honest", F.lit(0)))
    held = materialise(splits.stratified_holdout(padded, key, "y", seed=seed), "audit")
    honest = splits.stratified_holdout(base.withColumnRenamed("honest", "y").where("y IS NOT NULL"), key, "y", seed=seed)
    shuffled = splits.permute(held.select(key, "y"), ["y"], key, seed)
    region = splits.region_holdout(padded, "_at", key)
    copies = splits.oversample_minority(padded, key, "y", seed)
    copies = copies.withColumn("copy_key", F.concat_ws("#", F.col(key).cast("string"), F.col("copy").cast("string")))
    copied = splits.stratified_holdout(copies, "copy_key", "y", seed=seed)
    biology = [f for f in coded_features if f not in identifiers]
    runs = {
        "A_everything": (held, coded_features),
        "B_identifiers_only": (held, identifiers),
        "C_no_identifiers": (held, biology),
        "D_honest_labels": (honest, coded_features),
        "E_label_permutation": (held.drop("y").join(shuffled, key), coded_features),
        "F_unseen_region": (region, coded_features),
        "G_copies_before_split": (copied, coded_features),
    }
    rows = models.at_once([
        lambda n=name, d=frame, f=fs: _fit_and_score(d if d is held else materialise(d, "audit"), f, factory, n)
        for name, (frame, fs) in runs.items()])
    return df.sparkSession.createDataFrame(
        rows, "protocol string, test_accuracy double, test_auc double, train_accuracy double, train_auc double,"
              " test_prevalence double, majority_accuracy double")


def copied_share(df: DataFrame, features: Sequence[str], key: str = "id", label: str = "y", seed: int = 42) -> DataFrame:
    """Share of test rows that are copies of training rows when copying precedes the split."""
    copies = splits.oversample_minority(df, key, label, seed)
    copies = copies.withColumn("copy_key", F.concat_ws("#", F.col(key).cast("string"), F.col("copy").cast("string")))
    split = materialise(splits.stratified_holdout(copies, "copy_key", label, seed=seed), "copies")
    test, train = split.where("is_test"), split.where("NOT is_test")
    hits = relations.rows_also_in(test, train, [key, *features])
    return hits.agg(F.count(F.lit(1)).alias("n_copied"), F.lit(1).alias("_one")).join(
        F.broadcast(test.agg(F.count(F.lit(1)).alias("n_test"), F.lit(1).alias("_one"))), "_one").select(
        "n_copied", "n_test", (F.col("n_copied") / F.col("n_test")).alias("share_copied"))


def interpret_audit(audit: DataFrame) -> DataFrame:
    """How much of the lift identifiers explain, and what padding the negatives adds to accuracy."""
    at = lambda protocol, c: F.max(F.when(F.col("protocol") == protocol, F.col(c)))
    lift = at("A_everything", "test_auc") - 0.5
    return audit.agg(
        F.when(lift > 0, (at("B_identifiers_only", "test_auc") - 0.5) / lift).alias("identifier_share_of_lift"),
        (at("A_everything", "test_accuracy") - at("D_honest_labels", "test_accuracy")).alias("accuracy_inflation"))


# --- unrecorded outcomes ------------------------------------------------------------

def missingness_probe(df: DataFrame, features: Sequence[str], factory: models.Factory, key: str = "id", label: str = "y",
                      k: int = 5, cut: float = 0.60) -> DataFrame:
    """Can the features tell whether the outcome was recorded? Below ``cut`` they cannot."""
    labelled, unlabelled = df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())
    stacked = relations.stack_states(labelled, unlabelled).select(key, F.col("recorded").alias("y"), *[
        F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in features])
    folded = models.fold_table(splits.stratified_folds(stacked, key, "y", k), [key, "fold", "y", *features])
    oof = models.out_of_fold(folded, features, factory, "probe", key=key)
    return metrics.summary(oof, threshold=0.5).select(
        F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp"), "auc_roc").toDF("n_labelled", "n_unlabelled", "reporting_auc").withColumn(
        "missing_at_random", F.col("reporting_auc") < cut)


def self_train(df: DataFrame, features: Sequence[str], factory: models.Factory, key: str = "id", label: str = "y",
               rounds: int = 5, hi: float = 0.85, lo: float = 0.05, per_round: int = 200,
               pseudo_weight: float = 0.5) -> tuple[PipelineModel, DataFrame]:
    """Adopt the surest unlabelled rows in capped rounds at reduced weight.

    The labelled rows and the pool are stored once; a round stores only what it adopts.
    """
    columns = [key, label, "trust", *features]
    start = materialise(df.withColumn("trust", F.lit(1.0)).select(*columns), "selftrain")
    labelled, pool = start.where(F.col(label).isNotNull()), start.where(F.col(label).isNull())
    counts = start.agg(F.avg(F.col(label).cast("double")).alias("prevalence"), F.count_if(F.col(label).isNull()).alias("left")).first()
    prevalence, left = float(counts["prevalence"]), counts["left"]

    learn = lambda rows: models.fit(rows, features, factory, label, trust="trust")
    train, rest = labelled, pool
    model, history = learn(train), []
    taken = None
    for i in range(rounds):
        scored = models.score(model, rest, columns)
        adopted = materialise(relations.adopt_confident(scored, prevalence, "p", key, hi, lo, per_round), "selftrain")
        counts = adopted.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).first()
        if counts["pos"] + counts["neg"] == 0:
            break
        grown, _ = relations.append_adopted(labelled.limit(0), adopted, pool, key, pseudo_weight, "trust")
        taken = grown if taken is None else taken.unionByName(grown)
        train, rest = labelled.unionByName(taken), pool.join(small_side(taken.select(key)), key, "left_anti")
        model = learn(train)
        left -= counts["pos"] + counts["neg"]
        history.append((i + 1, counts["pos"], counts["neg"], left))
    return model, df.sparkSession.createDataFrame(
        history, "round int, adopted_positive long, adopted_negative long, pool_remaining long")


# --- transfer and added columns -------------------------------------------------------

def transfer(source: DataFrame, target: DataFrame, features: Sequence[str], keys: Sequence[str], factory: models.Factory,
             resolvable: Column | None = None, n_boot: int = 2000) -> DataFrame:
    """Fit on one registry, score the other: all, shared and novel rows, both label conventions, each with the AUC's interval.

    Both frames hold ``y``, the shared features and the identity ``keys``.
    """
    model = models.fit(source, features, factory)
    scored = materialise(models.score(model, target, ["y", *keys]), "transfer")
    asked = F.lit(True) if resolvable is None else F.coalesce(resolvable, F.lit(False))
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    known = materialise(source.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_known", F.lit(True)), "transfer")
    marked = scored.withColumn("_asked", asked).join(known, same, "left")
    part = F.when(F.col("_asked") & F.col("_known"), F.lit("shared")).when(F.col("_asked"), F.lit("novel"))
    marked = materialise(marked.select(part.alias("part"), "y", "p"), "transfer")
    each = marked.withColumn("rows", F.explode(F.array_compact(F.array(F.lit("all"), F.col("part"))))).withColumn(
        "labels", F.explode(F.array(F.lit("recorded"), F.lit("unknown_negative"))))
    again = each.withColumn("y", F.when(
        F.col("labels") == "unknown_negative", F.coalesce("y", F.lit(0))).otherwise(F.col("y")))
    again = again.select("rows", "labels", "y", "p")
    interval = stats.bootstrap_interval(again, n_boot=n_boot, by=["rows", "labels"], digits=3).select(
        "rows", "labels", F.col("lo").alias("auc_lo"), F.col("hi").alias("auc_hi"))
    return metrics.summary(again, by=["rows", "labels"], threshold=0.5).join(interval, ["rows", "labels"], "left").select(
        "rows", "labels", "n", "prevalence", "auc_roc", "auc_lo", "auc_hi", "auc_pr", "brier", "ece")


def covariate_value(df: DataFrame, arms: dict[str, list[str]], factory: models.Factory) -> DataFrame:
    """Arms on identical folds; the last arm's row also has its gain over the first and the paired test's p."""
    every = sorted({f for fs in arms.values() for f in fs})
    table = models.fold_table(df, ["id", "fold", "y", *every])
    runs = {name: models.out_of_fold(table, fs, factory, name) for name, fs in arms.items()}
    first, last = list(runs)[0], list(runs)[-1]
    test = stats.paired_auc_test(
        runs[last].select("id", "y", "p").join(runs[first].select("id", F.col("p").alias("q")), "id")).first()
    rows = [(name, len(arms[name]), float(metrics.roc_auc(oof).first()["auc_roc"]),
             *((test["delta"], test["p_value"]) if name == last else (None, None))) for name, oof in runs.items()]
    return df.sparkSession.createDataFrame(rows, "arm string, n_features int, auc_roc double, gain double, p_value double")


# --- attributions ----------------------------------------------------------------------

def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str = "id", repeats: int = 3,
                           seed: int = 0) -> DataFrame:
    """AUC lost when a column is shuffled.

    Each repeat pairs every row with one donor row by digest order (one shuffle
    per repeat, not per feature); a feature's copy takes only that feature from
    the donor. One scoring pass and one grouped AUC cover all copies.
    """
    known = materialise(df.where("y IS NOT NULL").select(key, "y", *features), "importance")
    base = metrics.roc_auc(models.score(model, known, ["y"])).first()["auc_roc"]
    parts = []
    for r in range(repeats):
        receivers = splits.hash_order(known, key, seed + 2 * r, "_i")
        donors = splits.hash_order(known.select(key, *features), key, seed + 2 * r + 1, "_i").select(
            "_i", F.struct(*features).alias("_donor"))
        parts.append(receivers.join(donors, "_i").drop("_i").withColumn("repeat", F.lit(r)))
    paired = parts[0]
    for part in parts[1:]:
        paired = paired.unionByName(part)
    each = paired.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    changed = each.withColumns({f: F.when(F.col("feature") == f, F.col(f"_donor.{f}")).otherwise(F.col(f)) for f in features})
    scored = models.score(model, changed.drop("_donor"), ["feature", "repeat", "y"])
    drops = metrics.roc_auc(materialise(scored, "importance"), by=["feature", "repeat"])
    return drops.groupBy("feature").agg(F.avg(F.lit(base) - F.col("auc_roc")).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def reset_attribution(model: PipelineModel, df: DataFrame, medians: dict[str, float], key: str = "id", top: int = 8) -> DataFrame:
    """Score change when one feature goes back to its training median; the largest per record.

    Features already at the median are skipped; a missing value is not.
    """
    features = list(medians)
    base = models.score(model, df, [key], "base")
    each = df.select(key, *features).withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    value = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in features])
    target = F.coalesce(*[F.when(F.col("feature") == f, F.lit(m)) for f, m in medians.items()])
    each = each.withColumn("value", value).where(~F.coalesce(value == target, F.lit(False)))
    reset = each.withColumns({f: F.when(F.col("feature") == f, F.lit(m)).otherwise(F.col(f)) for f, m in medians.items()})
    scored = models.score(model, reset, [key, "feature", "value"], "reset").join(base, key)
    effect = scored.withColumn("contribution", F.col("base") - F.col("reset")).where(F.abs("contribution") > 1e-9)
    ranked = relations.top_k_each(effect, key, F.abs("contribution"), top, "feature")
    return ranked.select(key, "rank", "feature", "value", "contribution", F.when(
        F.col("contribution") > 0, "increases risk").otherwise("lowers risk").alias("direction"))
