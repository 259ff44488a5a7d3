"""Models, calibration, ensembles, audits, attributions and scoring on the given tables."""

from __future__ import annotations

import re

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import encode as enc
from ..functions import fixed_values as fv
from ..functions import notation, text
from ..operators import aggregates, metrics, neighbours, quality, splits
from ..operators.isotonic import Isotonic
from ..plans import experiments, features, final, models, scoring, stages
from ..session import materialise
from ..streaming import scoring as streaming
from .bindings import CATALOGUE, MEMBERS, SCORES, VARIANTS
from .cohorts import CATALOGUE_LABEL, FUSED_SQL, fused, loaded_fused, records, scratch
from .registry import query
from .scalars import EFFECT_SQL, clean
from .shared import AUC_SQL, chi_square_p_sql, curve_sql, rounded

COLUMNS = ["alpha", "beta", "gamma", "pos"]
FAST = models.logistic(1.0)
# Trees and rounds of the leaderboards; the functions' own defaults are 600 trees and 300 rounds.
FOREST = models.forest(trees=100)
BOOSTING = models.boosting(rounds=30)
#: The audit fits 300 trees on every training row.
AUDIT_FOREST = models.forest(trees=300)


def matrix(spark, sf):
    """One feature row per order, with blanks and a stratified fold."""
    df = MEMBERS.frame(spark, sf).withColumns({
        "pos": F.col("pos").cast("double"), "beta": F.when(F.col("id") % 11 != 0, F.col("beta"))})
    return splits.stratified_folds(df, "id")


def members_long(spark, sf):
    return MEMBERS.frame(spark, sf).unpivot(["id", "y"], ["alpha", "beta", "gamma"], "model", "p")


LONG_SQL = f"""l AS (SELECT id, y, 'alpha' AS model, alpha AS p FROM {MEMBERS.sql} t UNION ALL SELECT id, y, 'beta', beta FROM {MEMBERS.sql} t
  UNION ALL SELECT id, y, 'gamma', gamma FROM {MEMBERS.sql} t)"""


@query
def imputed_and_scaled(spark, sf):
    """Median fill and scaling fitted on rows outside fold 0, applied to fold 0."""
    df = matrix(spark, sf)
    fitted = models.Pipeline(stages=models.preparation(COLUMNS)).fit(df.where("fold <> 0"))
    out = fitted.transform(df.where("fold = 0"))
    values = vector_to_array("features")
    return rounded(out.select("id", *[values[i].alias(c) for i, c in enumerate(COLUMNS)]), 4)


@query(sql=f"""
WITH n AS (SELECT y, count(*) AS k FROM {MEMBERS.sql} t WHERE y IS NOT NULL GROUP BY y)
SELECT CAST(y AS INT) AS y, k AS n, round((SELECT sum(k) FROM n) / (2 * k), 6) AS weight FROM n""")
def balanced_weights(spark, sf):
    weighted, _ = models.with_class_weight(MEMBERS.frame(spark, sf).where("y IS NOT NULL"))
    return rounded(weighted.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight")))


@query
def logistic_leaderboard(spark, sf):
    zoo = {"l2": FAST, "elastic_net": models.logistic(0.5, 0.5)}
    return rounded(models.cross_validate(matrix(spark, sf), COLUMNS, zoo)[1])


@query
def tree_leaderboard(spark, sf):
    zoo = {"forest": FOREST, "boosting": BOOSTING, "mlp": models.perceptron()}
    return rounded(models.cross_validate(matrix(spark, sf), COLUMNS, zoo)[1])


@query
def region_blocked_leaderboard(spark, sf):
    df = matrix(spark, sf).drop("fold")
    blocked = splits.block_folds(splits.position_blocks(df, "pos", "id"))
    return rounded(models.cross_validate(blocked, COLUMNS, {"l2": FAST})[1])


@query
def out_of_fold_scores(spark, sf):
    oof = models.out_of_fold(models.fold_table(matrix(spark, sf), ["id", "fold", "y", *COLUMNS]), COLUMNS, FAST, "l2")
    return rounded(oof, 4)


@query(sql=f"""
WITH f AS (SELECT id, y, ntile(5) OVER (PARTITION BY y ORDER BY md5(concat('42:', CAST(id AS STRING)))) - 1 AS fold FROM {MEMBERS.sql} t)
SELECT CAST(fold AS INT) AS fold, count(*) AS n_scored, count(DISTINCT id) AS n_rows FROM f WHERE y IS NOT NULL GROUP BY fold""")
def out_of_fold_coverage(spark, sf):
    """Every labelled row is scored exactly once, in its own fold."""
    oof = models.out_of_fold(models.fold_table(matrix(spark, sf), ["id", "fold", "y", *COLUMNS]), COLUMNS, FAST, "l2")
    once = oof.where("p BETWEEN 0 AND 1").groupBy("fold", "id").agg(F.count(F.lit(1)).alias("_n"))
    return once.groupBy("fold").agg(F.sum("_n").alias("n_scored"), F.count(F.lit(1)).alias("n_rows"))


@query
def nested_parameter_search(spark, sf):
    df = matrix(spark, sf).withColumn("inner_fold", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int"))
    return rounded(models.nested_search(df, COLUMNS, candidates=4, inner=3), 4)


def isotonic_sql(source: str, score: str) -> str:
    """CTE ``f`` (x, v): the closed min-max form over all distinct labelled scores."""
    return f"""
i0 AS (SELECT {score} AS x, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS w FROM {source} t WHERE y IS NOT NULL GROUP BY 1),
i1 AS (SELECT *, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM i0),
i2 AS (SELECT b.x, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.x ORDER BY b.x DESC) AS m FROM i1 a JOIN i1 b ON a.x <= b.x),
f AS (SELECT x, max(m) AS v FROM i2 GROUP BY x)"""


def bounds_sql(source: str, score: str) -> str:
    """CTE ``bounds`` (lo, hi): the extreme smoothed rates over the quantile bins."""
    return f"""
b0 AS (SELECT y, {score} AS p FROM {source} t WHERE y IS NOT NULL),
b1 AS (SELECT DISTINCT unnest(quantile_cont(p, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS edge FROM b0),
b2 AS (SELECT edge AS lo, lead(edge) OVER (ORDER BY edge) AS hi FROM b1),
b3 AS (SELECT lo, (sum(y) + 1) / (count(*) + 2) AS rate FROM b2 JOIN b0 ON p BETWEEN lo AND hi WHERE hi IS NOT NULL GROUP BY lo HAVING count(*) >= 5),
bounds AS (SELECT min(rate) AS lo, max(rate) AS hi FROM b3)"""


@query(sql=f"""
WITH {isotonic_sql(SCORES.sql, 'p')}, k AS (SELECT y, p, v FROM {SCORES.sql} t JOIN f ON p = x WHERE y IS NOT NULL)
SELECT round(avg(pow(v - y, 2)), 6) AS brier FROM k UNION ALL SELECT round(avg(pow(p - y, 2)), 6) FROM k""")
def isotonic_calibration(spark, sf):
    df = SCORES.frame(spark, sf)
    fitted = models.Calibrator.fit(df, bounded=False)
    return rounded(metrics.brier(fitted.transform(df), score="calibrated").unionByName(metrics.brier(df)), 6)


@query(sql=f"WITH {isotonic_sql(SCORES.sql, 'p')} SELECT round(x, 9) AS p, round(v, 9) AS isotonic FROM f")
def isotonic_steps(spark, sf):
    """The fitted value of every distinct score."""
    df = SCORES.frame(spark, sf)
    fitted = Isotonic.fit(df)
    return rounded(fitted.transform(df.where("y IS NOT NULL").select("p").distinct()).select("p", "isotonic"), 9)


@query(sql=f"""
WITH s AS (SELECT * FROM {SCORES.sql} t WHERE y IS NOT NULL),
e AS (SELECT DISTINCT unnest(quantile_cont(p, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS edge FROM s),
b AS (SELECT edge AS lo, lead(edge) OVER (ORDER BY edge) AS hi FROM e),
r AS (SELECT lo, (sum(y) + 1) / (count(*) + 2) AS rate FROM b JOIN s ON p BETWEEN lo AND hi WHERE hi IS NOT NULL GROUP BY lo HAVING count(*) >= 5)
SELECT round(min(rate), 6) AS lo, round(max(rate), 6) AS hi FROM r""")
def calibration_bounds(spark, sf):
    return rounded(models.Calibrator.bounds(SCORES.frame(spark, sf).where("y IS NOT NULL")))


@query(sql=f"""
WITH {isotonic_sql(MEMBERS.sql, 'gamma')}, {bounds_sql(MEMBERS.sql, 'gamma')},
g AS (SELECT x AS lo_x, v AS lo_v, lead(x) OVER (ORDER BY x) AS hi_x, lead(v) OVER (ORDER BY x) AS hi_v FROM f),
q AS (SELECT id, gamma, CASE WHEN lo_x IS NULL THEN (SELECT min(v) FROM f) WHEN gamma = lo_x OR hi_x IS NULL THEN lo_v
  ELSE lo_v + (hi_v - lo_v) * (gamma - lo_x) / (hi_x - lo_x) END AS v FROM {MEMBERS.sql} t ASOF LEFT JOIN g ON gamma >= lo_x)
SELECT id, round(greatest(lo, least(hi, v)), 6) AS calibrated FROM q, bounds""")
def bounded_isotonic_scores(spark, sf):
    df = MEMBERS.frame(spark, sf)
    fitted = models.Calibrator.fit(df, score="gamma")
    return rounded(fitted.transform(df, "gamma").select("id", "calibrated"))


@query(sql=f"""
WITH {LONG_SQL}, h AS (SELECT model, p, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT model, p, sum(n) OVER (PARTITION BY model ORDER BY p) / sum(n) OVER (PARTITION BY model) AS share FROM h)
SELECT id, round(avg(share), 6) AS p FROM l JOIN s USING (model, p) GROUP BY id""")
def rank_average_ensemble(spark, sf):
    long = members_long(spark, sf)
    return rounded(models.rank_average(long, long))


WEIGHT_SQL = f"""{LONG_SQL}, {curve_sql('(SELECT * FROM l)', by='model')}, a AS (SELECT model, {AUC_SQL} AS auc FROM c GROUP BY model),
w AS (SELECT model, auc, pow(greatest(auc - 0.5::DOUBLE, 1e-6), 4) / sum(pow(greatest(auc - 0.5::DOUBLE, 1e-6), 4)) OVER () AS w FROM a)"""


@query(sql=f"WITH {WEIGHT_SQL} SELECT model, round(auc, 6) AS auc_roc, round(w, 6) AS weight FROM w")
def auc_weights(spark, sf):
    return rounded(models.auc_weights(members_long(spark, sf)))


@query(sql=f"WITH {WEIGHT_SQL} SELECT id, round(sum(p * w) / sum(w), 6) AS p FROM l JOIN w USING (model) GROUP BY id")
def auc_weighted_average(spark, sf):
    long = members_long(spark, sf)
    return rounded(models.weighted_average(long, models.auc_weights(long)))


@query
def stacked_ensemble_weights(spark, sf):
    return rounded(models.stack(members_long(spark, sf), ["alpha", "beta", "gamma"])[1], 3)


STACK = stages.StackedClassifier(
    bases={"l2": ["logistic", {"c": 1.0}], "elastic_net": ["logistic", {"c": 0.5, "mix": 0.5}]}, features=COLUMNS, groupCol="grp")


@query(sql=f"""
WITH m AS (SELECT * FROM {MEMBERS.sql} t)
SELECT (SELECT count(*) FROM m) AS n_rows, 2 * count(*) AS n_cross_fitted, 0 AS n_straddling, 0 AS n_changed FROM m WHERE y IS NOT NULL""")
def stacked_model_round_trip(spark, sf):
    """All rows scored by a stack that was saved and loaded; every labelled row has one inner score a base, no group is in two folds."""
    df = MEMBERS.frame(spark, sf, busy=True).withColumn("pos", F.col("pos").cast("double"))
    model = STACK.fit(df)
    path = scratch(spark, "stack")
    model.write().save(path)
    again = stages.StackedModel.load(path).transform(df).select("id", F.col("p").alias("q"))
    scored = model.transform(df).join(again, "id").agg(
        F.count("p").alias("n_rows"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("n_changed"))
    inner = model.cross_fitted.where("p BETWEEN 0 AND 1").agg(F.count(F.lit(1)).alias("n_cross_fitted"))
    groups = model.inner_folds.groupBy("row_group").agg(F.count_distinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_straddling"))
    return scored.join(F.broadcast(inner)).join(F.broadcast(groups)).select("n_rows", "n_cross_fitted", "n_straddling", "n_changed")


SHARES_SQL = f"""{LONG_SQL}, h AS (SELECT model, p, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT model, p, sum(n) OVER (PARTITION BY model ORDER BY p) / sum(n) OVER (PARTITION BY model) AS share FROM h),
w AS (SELECT id, y, max(share) FILTER (model = 'alpha') AS a, max(share) FILTER (model = 'beta') AS b, max(share) FILTER (model = 'gamma') AS c
  FROM l JOIN s USING (model, p) GROUP BY id, y)"""


def greedy_sql(rounds: int = 5, gain: float = 1e-4) -> str:
    """Each round counts the AUC of the chosen sum plus each member; a round without the gain ends the path."""
    steps = [f"WITH {SHARES_SQL}, r0 AS (SELECT 0::BIGINT AS step, '' AS added, 0::DOUBLE AS auc, 0::DOUBLE AS ka, 0::DOUBLE AS kb, 0::DOUBLE AS kc, true AS goes)"]
    for i in range(1, rounds + 1):
        steps.append(f"""o{i} AS (SELECT m.model, y, (ka * a + kb * b + kc * c + CASE m.model WHEN 'alpha' THEN a WHEN 'beta' THEN b ELSE c END) / {i} AS p
  FROM w, r{i - 1}, (VALUES ('alpha'), ('beta'), ('gamma')) m(model) WHERE y IS NOT NULL AND goes),
g{i} AS (SELECT model, round(p, 12) AS p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM o{i} GROUP BY ALL),
c{i} AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY p) - neg AS below FROM g{i}),
u{i} AS (SELECT model, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM c{i} GROUP BY model),
t{i} AS (SELECT * FROM u{i} ORDER BY auc DESC, model LIMIT 1),
r{i} AS (SELECT {i}::BIGINT AS step, t.model AS added, t.auc, ka + CAST(t.model = 'alpha' AS INT) AS ka, kb + CAST(t.model = 'beta' AS INT) AS kb,
  kc + CAST(t.model = 'gamma' AS INT) AS kc, t.auc > r.auc + {gain} AS goes FROM t{i} t, r{i - 1} r)""")
    rows = " UNION ALL ".join(f"SELECT step, added, auc FROM r{i} WHERE goes" for i in range(1, rounds + 1))
    return ",\n".join(steps) + f"\nSELECT CAST(step AS INT) AS step, added, round(auc, 6) AS auc_roc FROM ({rows})"


@query(sql=greedy_sql())
def greedy_rank_ensemble(spark, sf):
    return rounded(models.greedy_rank_ensemble(members_long(spark, sf)), 6)


@query(sql="""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label = 1 AS INT) AS y FROM embeddings),
d AS (SELECT q.id, r.y, r.id AS ref, list_distance(q.v, r.v) AS d FROM e q JOIN e r ON q.id % 5 = 0 AND r.id % 5 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref) AS r FROM d)
SELECT id, round(CASE WHEN min(d) = 0 THEN avg(CASE WHEN d = 0 THEN y END) ELSE sum(y / nullif(d, 0)) / sum(1 / nullif(d, 0)) END, 5) AS p
FROM k WHERE r <= 25 GROUP BY id""")
def nearest_neighbour_vote(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") == 1).cast("int").alias("y"))
    found = neighbours.nearest(df.where("id % 5 <> 0"), df.where("id % 5 = 0").drop("y"))
    return rounded(neighbours.vote(found), 5)


def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") == 1).cast("int").alias("y"))


@query(sql="SELECT count(*) AS n_queries, 25 * count(*) AS n_exact, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def neighbour_index_recall(spark, sf):
    """Every row with an id divisible by 100 against all rows: nine in ten exact neighbours must be in the lists read."""
    df = vectors(spark, sf)
    asked = df.where("id % 100 = 0").drop("y")
    found = neighbours.NeighbourIndex.fit(df).nearest(asked)
    share = neighbours.recall_of(found, neighbours.nearest(df, asked))
    one = share.select("n_exact", (F.col("recall") >= 0.9).alias("reached"))
    return asked.agg(F.count(F.lit(1)).alias("n_queries")).join(F.broadcast(one))


@query
def indexed_neighbour_vote(spark, sf):
    """The vote of :func:`nearest_neighbour_vote` from the index."""
    df = vectors(spark, sf)
    index = neighbours.NeighbourIndex.fit(df.where("id % 5 <> 0"))
    return rounded(neighbours.vote(index.nearest(df.where("id % 5 = 0").drop("y"))), 5)


@query
def feature_ablation(spark, sf):
    blocks = {"members": ["alpha", "gamma"], "place": ["pos", "beta"]}
    return rounded(experiments.ablate(matrix(spark, sf), experiments.block_sets(blocks), FAST))


@query
def top_feature_sweep(spark, sf):
    return rounded(experiments.top_k_sweep(matrix(spark, sf), COLUMNS, [1, 2, 4], FOREST, FAST))


@query(sql="""
WITH t AS (SELECT o_orderkey AS id, coalesce(o_orderpriority, 'Unknown') AS a FROM orders),
c AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS code FROM (SELECT DISTINCT a FROM t))
SELECT id, CAST(code AS DOUBLE) AS priority FROM t JOIN c USING (a)""")
def label_encoded_columns(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey AS id", "o_orderpriority AS priority", "o_orderstatus AS outcome", "o_orderdate AS `Year Reported`")
    return experiments.encode_everything(df, "outcome")[0].select("id", "priority")


def audit_table(spark, sf):
    """All text columns label-encoded, the label, and the real position; feature names and the identifiers among them."""
    identifiers, outcome = ["HGVS cDNA", "HGVS Protein", "Mature Protein"], "History of Inhibitor"
    df = CATALOGUE.frame(spark, sf)
    # Only the parsing is dealt out: bagging and medians depend on how the rows of the fitted table lie.
    place = notation.with_cdna(CATALOGUE.frame(spark, sf, busy=True).select("id", "`HGVS cDNA`"), "`HGVS cDNA`").select("id", F.col("cdna.cdna_pos").alias("pos"))
    coded, kept = experiments.encode_everything(df, outcome)
    tidy = lambda c: re.sub(r"\W+", "_", c)
    small = coded.withColumn("y", text.catalogue_label(f"`{outcome}`")).drop(outcome)
    small = small.withColumnsRenamed({c: tidy(c) for c in kept}).join(place, "id")
    return materialise(small, "audit"), [tidy(c) for c in kept], [tidy(c) for c in identifiers]


@query
def leakage_audit(spark, sf):
    return rounded(experiments.leakage_audit(*audit_table(spark, sf), AUDIT_FOREST))


@query(sql=f"""
WITH k AS (SELECT id, y, alpha FROM {MEMBERS.sql} t WHERE y IS NOT NULL), n AS (SELECT y, count(*) AS n FROM k GROUP BY y),
p AS (SELECT min(n) AS lo, max(n) AS hi, arg_min(y, n) AS minor FROM n),
m AS (SELECT id, y, row_number() OVER (ORDER BY md5(concat('42:', CAST(id AS STRING)))) AS r FROM k, p WHERE y = minor),
g AS (SELECT id, y, unnest(range(1, CAST(hi // lo + CASE WHEN r <= hi % lo THEN 1 ELSE 0 END + 1 AS BIGINT))) AS copy FROM m, p
  UNION ALL SELECT id, y, 1 FROM k, p WHERE y <> minor),
h AS (SELECT id, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', CAST(id AS STRING), '#', CAST(copy AS STRING))))
  <= ceil(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE) AS test FROM g),
t AS (SELECT id FROM h WHERE test), c AS (SELECT count(*) AS k FROM t WHERE id IN (SELECT id FROM h WHERE NOT test))
SELECT k AS n_copied, (SELECT count(*) FROM t) AS n_test, round(k / (SELECT count(*) FROM t), 6) AS share_copied FROM c""")
def copies_across_a_split(spark, sf):
    df = MEMBERS.frame(spark, sf).select("id", "y", "alpha")
    return rounded(experiments.copied_share(df, ["alpha"]))


@query
def missingness_probe(spark, sf):
    return rounded(experiments.missingness_probe(matrix(spark, sf).drop("fold"), COLUMNS, FAST))


@query
def capped_self_training(spark, sf):
    return experiments.self_train(matrix(spark, sf), COLUMNS, FAST, hi=0.55, lo=0.45)[1]


@query
def cross_registry_transfer(spark, sf):
    reg = records(spark, sf)
    source = reg.select("*", F.round(text.number("aa_numb") - fv.SIGNAL_LENGTH, 1).alias("mature_key"),
                        text.residue_letter("aa_first").alias("ref_key"), text.residue_letter("aa_last").alias("alt_key"),
                        F.col("effect").alias("effect_key"))
    keys = ["effect_key", "mature_key", "ref_key", "alt_key"]
    a = materialise(features.harmonise_registry(source, ["y", *keys]), "transfer")
    names = [c for c in a.columns if c not in ("y", *keys)]
    cat = CATALOGUE.frame(spark, sf, busy=True).withColumn("y", text.catalogue_label("`History of Inhibitor`"))
    joined = features.catalogue_shared_inputs(cat).withColumns({
        "effect_key": F.col("effect"), "mature_key": F.round("mature", 1), "ref_key": F.col("ref_aa"), "alt_key": F.col("alt_aa")})
    b = materialise(features.project(joined, features.harmonised_blocks(), ["y", *keys]).select("y", *keys, *names), "transfer")
    return rounded(experiments.transfer(a, b, names, keys, FAST, F.col("mature_key").isNotNull()), 4)


@query
def covariate_experiment(spark, sf):
    arms = {"members": ["gamma"], "place": ["beta", "pos"], "both": ["gamma", "alpha", "beta", "pos"]}
    return rounded(experiments.covariate_value(matrix(spark, sf), arms, FAST))


@query
def final_stage_report(spark, sf):
    """Held-out metrics at each named threshold, the thresholds chosen on calibrated out-of-fold scores."""
    stage = final.final_stage(matrix(spark, sf).drop("fold"), COLUMNS, FAST)
    stage.save(scratch(spark, "artefact"))
    return rounded(stage.report, 4)


@query
def audit_interpretation(spark, sf):
    """What identifiers explain of the lift, in the audit of a logistic model."""
    audit = experiments.leakage_audit(*audit_table(spark, sf), FAST)
    return rounded(experiments.interpret_audit(audit), 4)


@query
def permutation_importance(spark, sf):
    df = matrix(spark, sf)
    model = models.fit(df.where("fold <> 0"), COLUMNS, FAST)
    return rounded(experiments.permutation_importance(model, df.where("fold = 0"), COLUMNS), 4)


@query
def reset_to_median_attribution(spark, sf):
    df = matrix(spark, sf)
    train = df.where("fold <> 0")
    model = models.fit(train, COLUMNS, FAST)
    medians = aggregates.exact_medians(train, COLUMNS)
    return rounded(experiments.reset_attribution(model, df.where("fold = 0"), medians), 4)


# --- feature matrices ------------------------------------------------------------------

@query(sql=f"""
WITH h AS (SELECT id, "Variant Type" AS vt, lower(trim("Exon")) AS ex FROM {CATALOGUE.sql} t)
SELECT count(*) AS n_rows, 135 AS n_features FROM h""")
def catalogue_matrix_shape(spark, sf):
    df = CATALOGUE.frame(spark, sf)
    _, built = features.CatalogueFeatures.fit_transform(df, ["id"])
    return built.agg(F.count("vtype_missense").alias("n_rows"), F.lit(len(built.columns) - 1).alias("n_features"))


def matrix_profile(built, keep):
    """Mean and filled cells of every feature: one row per feature."""
    names = [c for c in built.columns if c not in keep]
    row = built.agg(*[F.avg(c).alias(f"{c}|mean") for c in names], *[F.count(c).alias(f"{c}|n") for c in names])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}|mean`").alias("mean"), F.col(f"`{c}|n`").alias("n"))
                      for c in names])
    return row.select(F.explode(cells).alias("c")).select("c.*")


@query
def catalogue_matrix(spark, sf):
    df = CATALOGUE.frame(spark, sf)
    return rounded(matrix_profile(features.CatalogueFeatures.fit_transform(df, ["id"])[1], ["id"]))


@query
def registry_matrix(spark, sf):
    return rounded(matrix_profile(features.registry_features(records(spark, sf), ["mut_id"]), ["mut_id"]))


@query
def harmonised_matrices(spark, sf):
    both = features.harmonise_registry(records(spark, sf)).withColumn("source", F.lit("registry")).unionByName(
        features.harmonise_catalogue(CATALOGUE.frame(spark, sf)).withColumn("source", F.lit("catalogue")))
    return rounded(both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(c).alias(c) for c in ("is_null_variant", "in_C_domain", "relative_pos", "grantham", "severity_ordinal")]))


@query(sql=f"""
SELECT CAST(id AS BIGINT) AS id, TRY_CAST("Age_at_Diagnosis" AS DOUBLE) AS age, round(ln(1 + TRY_CAST("Age_at_Diagnosis" AS DOUBLE)), 6) AS log_age,
  CAST(TRY_CAST("Exposure_Days" AS DOUBLE) <= 50 AS DOUBLE) AS early, CAST(lower(trim("Treatment_Regimen")) = 'prophylaxis' AS DOUBLE) AS prophylaxis,
  CAST(coalesce(trim("Ethnicity") = 'Black', false) AS DOUBLE) AS ethnicity_black,
  CAST(coalesce(TRY_CAST("Age_at_Diagnosis" AS DOUBLE) <= 2 AND TRY_CAST("Exposure_Days" AS DOUBLE) <= 50, false) AS DOUBLE) AS young FROM {FUSED_SQL} t""")
def covariate_block(spark, sf):
    built = features.covariates(fused(spark, sf), ["id"])
    return rounded(built.select(
        F.col("id").cast("long").alias("id"), F.col("age_at_diagnosis").alias("age"), "log_age",
        F.col("within_first_50_ed").alias("early"), "prophylaxis", "ethnicity_black",
        F.col("young_and_early_exposure").alias("young")))


# --- scoring and streams ------------------------------------------------------------------

def catalogue_artefact(spark, sf):
    """Model on all 135 columns, calibrator and thresholds of its out-of-fold scores, saved as one artefact; its folder."""
    df = CATALOGUE.frame(spark, sf).withColumn("y", text.catalogue_label("`History of Inhibitor`"))
    fitted, built = features.CatalogueFeatures.fit_transform(df, ["id", "y"])
    names = features.catalogue_feature_names()
    folds = splits.stratified_folds(materialise(built.where("y IS NOT NULL"), "matrix"), "id", k=3)
    train = models.fold_table(folds, ["id", "fold", "y", *names])
    oof, model = models.at_once([lambda: models.out_of_fold(train, names, FAST, "l2"), lambda: models.fit(train, names, FAST)])
    calibrator = models.Calibrator.fit(oof)
    points = metrics.operating_points(calibrator.transform(oof), score="calibrated").collect()
    rules = {r["rule"]: float(r["threshold"]) for r in points}
    path = scratch(spark, "artefact")
    stages.Artefact.of_catalogue(fitted, model, rules, "youden", calibrator, tables={"out_of_fold": oof}).save(path)
    return path


@query
def scored_catalogue_table(spark, sf):
    """The raw table through a loaded artefact alone."""
    return stages.Artefact.load(spark, catalogue_artefact(spark, sf)).score(CATALOGUE.frame(spark, sf, busy=True))


@query(sql="SELECT count(*) AS n_rows, 0 AS n_unscored, 0 AS n_changed, 135 AS n_features FROM orders")
def artefact_round_trip(spark, sf):
    """Rows of the table scored by a loaded artefact, and how many of them score otherwise alone among a tenth of the rows."""
    artefact = stages.Artefact.load(spark, catalogue_artefact(spark, sf))
    df = CATALOGUE.frame(spark, sf, busy=True)
    whole = materialise(artefact.score(df), "scored")
    part = artefact.score(df.where("id % 10 = 0")).select("id", F.col("risk").alias("again"), F.col("call").alias("call_again"))
    changed = ~F.col("risk").eqNullSafe(F.col("again")) | ~F.col("call").eqNullSafe(F.col("call_again"))
    n = whole.join(part, "id").agg(F.count_if(changed).alias("n_changed"))
    return whole.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("risk").isNull() | F.col("band").isNull()).alias("n_unscored"),
    ).join(F.broadcast(n)).withColumn("n_features", F.lit(len(artefact.names)))


def caller_records(spark, sf):
    """The variant table reshaped to the fields a caller supplies."""
    return VARIANTS.frame(spark, sf).selectExpr(
        "mut_id AS record", "mut_effect AS effect", "d_id AS domain", "e_i_numb AS exon", "aa_numb AS aa_position", "aa_first",
        "aa_last", "mut_type", "location", "ntchange", "n_bp", "CASE WHEN mut_id % 3 = 0 THEN 'svere' END AS severity",
        "locnumb AS fviii_activity", "CAST(NULL AS STRING) AS fviii_antigen", "CASE WHEN mut_id % 2 = 0 THEN 'ii' END AS crm_type",
        "CASE WHEN mut_id % 4 = 0 THEN '' ELSE 'africa' END AS region")


@query(sql=f"""
SELECT mut_id AS record, {EFFECT_SQL.format('e')} AS effect, coalesce(mut_type, 'Point') AS mut_type, coalesce(location, 'Exon') AS location,
  coalesce(n_bp, '1') AS n_bp, TRY_CAST(aa_numb AS DOUBLE) + 19 AS aa_numb, CASE WHEN mut_id % 3 = 0 THEN 'Severe' ELSE 'Unknown' END AS severity,
  CASE WHEN mut_id % 2 = 0 THEN 'II' ELSE 'Unknown' END AS crm_type, CASE WHEN mut_id % 4 = 0 THEN 'Unknown' ELSE 'africa' END AS region,
  TRY_CAST(locnumb AS DOUBLE) AS fviii_activity FROM (SELECT *, lower({clean('mut_effect')}) AS e FROM {VARIANTS.sql} t)""")
def caller_record_inputs(spark, sf):
    shaped = scoring.registry_from_inputs(caller_records(spark, sf))
    return shaped.select("record", "effect", "mut_type", "location", "n_bp", "aa_numb", "severity", "crm_type", "region", "fviii_activity")


@query
def caller_record_scores(spark, sf):
    names = ["is_null_variant", "severity_ordinal", "fviii_activity", "relative_pos", "grantham"]
    model = models.fit(materialise(features.registry_features(records(spark, sf), ["y"]).select("y", *names), "matrix"), names, FAST)
    matrix = features.registry_features(scoring.registry_from_inputs(caller_records(spark, sf)), ["record"])
    return scoring.score_features(model, enc.align(matrix, names, ["record"]), {"youden": 0.5}, "youden", ["record"])


@query(sql="""
WITH s AS (SELECT event_id, value / 500 AS p FROM events WHERE event_id % 50 <> 0)
SELECT event_id, round(p, 4) AS risk, CASE WHEN p < 0.1::DOUBLE THEN 'Low' WHEN p < 0.25::DOUBLE THEN 'Moderate' WHEN p < 0.4::DOUBLE THEN 'High' ELSE 'Very high' END AS band,
  p >= 0.3::DOUBLE AS call FROM s""")
def stream_scores_and_rejects(spark, sf):
    """Events as a stream; blank records are set aside, the rest scored, banded and called."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = streaming.read_files(spark, sf, schema, "events.parquet").select(
        "event_id", F.when(F.col("event_id") % 50 != 0, F.col("value").cast("string")).alias("reading"))
    scorer = lambda df: scoring.with_decision(
        df.withColumn("p", F.col("reading").cast("double") / 500), {"youden": 0.3}, "youden")
    out, rejects = scratch(spark, "scored"), scratch(spark, "rejected")
    streaming.score_stream_with_rejects(stream, scorer, ["reading"], out, rejects, scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "risk", "band", "call")


@query(sql="SELECT event_id, 'no usable field' AS reason FROM events WHERE event_id % 50 = 0")
def stream_rejects(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = streaming.read_files(spark, sf, schema, "events.parquet").select(
        "event_id", F.when(F.col("event_id") % 50 != 0, F.col("value").cast("string")).alias("reading"))
    out, rejects = scratch(spark, "scored"), scratch(spark, "rejected")
    streaming.score_stream_with_rejects(
        stream, lambda df: df, ["reading"], out, rejects, scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(rejects).select("event_id", "reason")


@query
def stream_model_scores(spark, sf):
    """A fitted pipeline on a stream of JSON-carrying events, appended to Parquet."""
    source = spark.read.parquet(f"{sf}/events.parquet")

    def shape(df):
        k = F.from_json("props", T.StructType([T.StructField("k", T.DoubleType())]))["k"]
        return df.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"), "value", k.alias("k"))

    model = models.fit(shape(source), ["value", "k"], FAST)
    stream = streaming.read_files(spark, sf, source.schema, "events.parquet")
    out = scratch(spark, "scored")
    scorer = lambda df: scoring.score_features(model, shape(df), {"youden": 0.5}, "youden", ["event_id"])
    streaming.score_stream(stream, scorer, out, scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(out)


# --- quality checks -------------------------------------------------------------------------

@query(sql=f"SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM {CATALOGUE.sql} t")
def label_blind_features(spark, sf):
    """Feature rows that change when the outcome text is shuffled: there must be none."""
    df = CATALOGUE.frame(spark, sf, busy=True)
    result = quality.label_blind(df, "id", ["History of Inhibitor"], lambda frame: features.harmonise_catalogue(frame, ["id"]))
    return result.select("n_rows", "n_changed")


@query(sql=f"""
WITH {LONG_SQL}, a AS (SELECT corr(alpha, y) AS r1, corr(gamma, y) AS r2 FROM {MEMBERS.sql} t WHERE y IS NOT NULL)
SELECT unnest(['alpha', 'gamma']) AS feature, unnest([abs(r1) < 0.95::DOUBLE, abs(r2) < 0.95::DOUBLE]) AS passed FROM a""")
def single_feature_proxies(spark, sf):
    return quality.label_proxies(MEMBERS.frame(spark, sf), ["alpha", "gamma"]).select("feature", "passed")


@query(sql=f"""
WITH m AS (SELECT * FROM {MEMBERS.sql} t), g AS (SELECT grp, row_number() OVER (ORDER BY md5(concat('42:', CAST(grp AS STRING))))
  <= ceil(count(*) OVER () * 0.2::DOUBLE) AS test FROM (SELECT DISTINCT grp FROM m)),
h AS (SELECT m.*, test FROM m JOIN g USING (grp))
SELECT 'label policy' AS "check", avg(y) BETWEEN 0.3 AND 0.7 AND count(*) FILTER (y IS NULL) >= 1000 AS passed FROM m
UNION ALL SELECT 'finite matrix', count(*) FILTER (isnan(alpha) OR isinf(alpha) OR isnan(gamma) OR isinf(gamma)) = 0 FROM m
UNION ALL SELECT 'split hygiene', (SELECT count(*) FROM (SELECT grp FROM h GROUP BY grp HAVING min(test) <> max(test))) = 0
  AND (SELECT count(*) FROM h WHERE test AND id IN (SELECT id FROM h WHERE NOT test)) = 0 AND count(*) FILTER (test) > 0 FROM h
UNION ALL SELECT 'no identifier features', count(DISTINCT beta) / count(*) < 0.5 FROM m
UNION ALL SELECT 'accuracy with baseline', avg(CASE WHEN (gamma >= 0.4::DOUBLE) = (y = 1) THEN 1.0 ELSE 0.0 END) IS NOT NULL FROM m WHERE y IS NOT NULL""")
def quality_roll_up(spark, sf):
    df = matrix(spark, sf)
    held = splits.group_holdout(df, "grp")
    known = df.where("y IS NOT NULL")
    checks = [
        quality.label_policy(df, 1000, 0.3, 0.7),
        quality.finite_matrix(df, COLUMNS),
        quality.split_hygiene(held, "grp", ["id"], "is_test"),
        quality.no_identifiers(df.select("beta", "y"), ["beta"]),
        quality.baseline_shipped(metrics.accuracy_with_baseline(known, 0.4, score="gamma")),
    ]
    return quality.roll_up(checks).select("check", "passed")


def category_sql(category: str) -> str:
    return f"""(WITH t AS (SELECT {category} AS k, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b, count(*) AS n FROM f
  WHERE y IS NOT NULL AND {category} IS NOT NULL GROUP BY 1),
s AS (SELECT *, n * sum(a) OVER () / sum(n) OVER () AS ea, n * sum(b) OVER () / sum(n) OVER () AS eb, count(*) OVER () AS m FROM t),
g AS (SELECT *, abs(a - ea) - CASE WHEN m = 2 THEN least(0.5::DOUBLE, abs(a - ea)) ELSE 0 END AS ga,
  abs(b - eb) - CASE WHEN m = 2 THEN least(0.5::DOUBLE, abs(b - eb)) ELSE 0 END AS gb FROM s),
x AS (SELECT sum(ga * ga / ea + gb * gb / eb) AS x, (greatest(max(m) - 1, 1))::DOUBLE AS dof FROM g) SELECT {chi_square_p_sql('x', 'dof')} FROM x)"""


@query(sql=f"""
WITH f AS (SELECT i, e, fh, g, x, CAST({CATALOGUE_LABEL} AS INT) AS y FROM (
  SELECT "Patient_ID" AS i, trim("Ethnicity") AS e, CAST("Family_History" AS STRING) AS fh, TRY_CAST("Age_at_Diagnosis" AS DOUBLE) AS g,
  TRY_CAST("Exposure_Days" AS DOUBLE) AS x, "History of Inhibitor" AS h FROM {FUSED_SQL} t)),
k AS (SELECT count(*) FILTER (fh = '1' AND y = 1) AS a, count(*) FILTER (fh = '1' AND y = 0) AS b, count(*) FILTER (fh <> '1' AND y = 1) AS c,
  count(*) FILTER (fh <> '1' AND y = 0) AS d FROM f)
SELECT signature, round(value, 6) AS value FROM (
SELECT 'share of random ids' AS signature, avg(CASE WHEN regexp_matches(i, '{fv.UUID4_PATTERN}') THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM f
UNION ALL SELECT 'rate spread over category, points', max(r) - min(r) FROM (SELECT avg(y) * 100 AS r FROM f WHERE y IS NOT NULL AND e IS NOT NULL GROUP BY e)
UNION ALL SELECT 'category p', {category_sql('e')}
UNION ALL SELECT 'exposure odds ratio', (a / b) / (c / d) FROM k
UNION ALL SELECT 'exposure p', {category_sql('fh')}
UNION ALL SELECT 'pair correlation', corr(g, x) FROM f)""")
def provenance_signatures(spark, sf):
    df = loaded_fused(spark, sf).withColumn("y", F.col("inhibitor"))
    return rounded(quality.provenance(df))
