"""Evaluation statistics on the score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, ordered, stats, strata
from .bindings import MEMBERS, SCORES
from .registry import query
from .shared import AP_SQL, AUC_SQL, curve_sql, normal_p_sql, rounded

CUTS = [round(0.01 * i, 2) for i in range(1, 61)]
GRID = [round(0.005 * i, 3) for i in range(200)]
CUT_VALUES = ", ".join(f"({t!r}::DOUBLE)" for t in CUTS)
GRID_VALUES = ", ".join(f"({t!r}::DOUBLE)" for t in GRID)
EDGES = " + ".join(f"CAST(p > {i} * CAST(0.1 AS DOUBLE) AS INT)" for i in range(1, 10))


@query(sql=f"""
WITH {curve_sql()} SELECT p AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg FROM c""")
def ordered_cumulative_counts(spark, sf):
    curve = metrics.score_curve(SCORES.frame(spark, sf))
    return curve.select(F.col("p").alias("threshold"), "tp", "fp", F.col("pos_all").alias("n_pos"),
                        F.col("neg_all").alias("n_neg"))


@query(sql=f"WITH {curve_sql(by='stratum')} SELECT stratum, round({AUC_SQL}, 6) AS auc_roc FROM c GROUP BY stratum")
def roc_auc_by_stratum(spark, sf):
    return rounded(metrics.roc_auc(SCORES.frame(spark, sf), by=["stratum"]))


@query(sql=f"WITH {curve_sql(score='q')} SELECT round({AUC_SQL}, 6) AS auc_roc FROM c")
def roc_auc_fine_scores(spark, sf):
    return rounded(metrics.roc_auc(SCORES.frame(spark, sf), score="q"))


@query(sql=f"WITH {curve_sql(by='stratum')} SELECT stratum, round({AP_SQL}, 6) AS auc_pr FROM c GROUP BY stratum")
def average_precision_by_stratum(spark, sf):
    return rounded(metrics.average_precision(SCORES.frame(spark, sf), by=["stratum"]))


@query(sql=f"""
WITH {curve_sql()} SELECT round(p, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM c""")
def roc_curve_points(spark, sf):
    return rounded(metrics.roc_points(SCORES.frame(spark, sf)))


@query(sql=f"""
WITH {curve_sql()}, d AS (SELECT *, row_number() OVER (ORDER BY p DESC) AS r,
  lead(pos) OVER (ORDER BY p DESC) AS next_pos, lead(neg) OVER (ORDER BY p DESC) AS next_neg FROM c)
SELECT round(p, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM d
WHERE r = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""")
def roc_curve_corners(spark, sf):
    return rounded(metrics.roc_points(SCORES.frame(spark, sf), corners=True))


@query(sql=f"""
WITH {curve_sql()} SELECT round(p, 6) AS threshold, round(tp / np, 6) AS recall,
  round(tp / (tp + fp), 6) AS "precision" FROM c""")
def precision_recall_points(spark, sf):
    return rounded(metrics.pr_points(SCORES.frame(spark, sf)))


@query(sql=f"""
WITH {curve_sql(by='stratum')}, j AS (SELECT *, row_number() OVER (
  PARTITION BY stratum ORDER BY tp / np - fp / nn DESC, p DESC) AS r FROM c)
SELECT stratum, round(p, 6) AS threshold FROM j WHERE r = 1""")
def youden_threshold(spark, sf):
    return rounded(metrics.youden_threshold(SCORES.frame(spark, sf), by=["stratum"]))


@query(sql=f"""
WITH {curve_sql(by='stratum')} SELECT stratum, round(max(CASE WHEN tp / np >= 0.9::DOUBLE THEN p END), 6) AS threshold
FROM c GROUP BY stratum""")
def sensitivity_target_threshold(spark, sf):
    return rounded(metrics.sensitivity_threshold(SCORES.frame(spark, sf), 0.9, by=["stratum"]))


@query(sql=f"""
WITH {curve_sql(by='stratum')}, d AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY p DESC) AS r,
  lead(pos) OVER (PARTITION BY stratum ORDER BY p DESC) AS next_pos, lead(neg) OVER (PARTITION BY stratum ORDER BY p DESC) AS next_neg FROM c)
SELECT stratum, round(max(p), 6) AS threshold FROM d WHERE tp / np >= 0.8::DOUBLE
  AND (r = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg) GROUP BY stratum""")
def sensitivity_target_at_corners(spark, sf):
    return rounded(metrics.sensitivity_threshold(SCORES.frame(spark, sf), 0.8, by=["stratum"], corners=True))


ACCURACY_SQL = f"""
h AS (SELECT p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM {SCORES.sql} t
      WHERE y IS NOT NULL GROUP BY p),
cand AS (SELECT DISTINCT round_even(p, 3) AS t FROM h),
acc AS (SELECT t, sum(CASE WHEN p >= t THEN pos ELSE neg END) AS good FROM cand CROSS JOIN h GROUP BY t)"""


@query(sql=f"WITH {ACCURACY_SQL} SELECT round(t, 6) AS threshold FROM acc ORDER BY good DESC, t LIMIT 1")
def accuracy_max_threshold(spark, sf):
    return rounded(metrics.accuracy_threshold(SCORES.frame(spark, sf)))


@query(sql=f"""
WITH {curve_sql()}, {ACCURACY_SQL.replace('h AS', 'h2 AS').replace('FROM h)', 'FROM h2)').replace('JOIN h ', 'JOIN h2 ')}
SELECT 'youden' AS rule, round(p, 6) AS threshold FROM (SELECT p FROM c ORDER BY tp / np - fp / nn DESC, p DESC LIMIT 1)
UNION ALL SELECT 'sensitivity', round(max(p), 6) FROM c WHERE tp / np >= 0.9::DOUBLE
UNION ALL SELECT 'accuracy', round(t, 6) FROM (SELECT t FROM acc ORDER BY good DESC, t LIMIT 1)""")
def operating_points(spark, sf):
    return rounded(metrics.operating_points(SCORES.frame(spark, sf)))


SUMMARY_SQL = f"""
WITH {curve_sql(by='stratum')},
best AS (SELECT stratum, p AS threshold, tp, fp FROM (SELECT *, row_number() OVER (
  PARTITION BY stratum ORDER BY tp / np - fp / nn DESC, p DESC) AS r FROM c) WHERE r = 1),
curve AS (SELECT stratum, max(np) AS pp, max(nn) AS qq, {AUC_SQL} AS auc_roc, {AP_SQL} AS auc_pr,
  sum(pos * pow(p - 1, 2) + neg * pow(p, 2)) AS sq,
  sum(CASE WHEN p >= 0.1::DOUBLE THEN pos ELSE 0 END) AS tp10, sum(CASE WHEN p >= 0.1::DOUBLE THEN neg ELSE 0 END) AS fp10,
  sum(CASE WHEN p >= 0.2::DOUBLE THEN pos ELSE 0 END) AS tp20, sum(CASE WHEN p >= 0.2::DOUBLE THEN neg ELSE 0 END) AS fp20
  FROM c GROUP BY stratum),
bins AS (SELECT stratum, {EDGES} AS b, abs(sum(pos) - sum(p * (pos + neg))) AS gap FROM h GROUP BY ALL),
ece AS (SELECT stratum, sum(gap) AS gap FROM bins GROUP BY stratum),
m AS (SELECT *, pp + qq AS n, pp - tp AS fn, qq - fp AS tn FROM curve JOIN best USING (stratum) JOIN ece USING (stratum))
SELECT stratum, CAST(n AS BIGINT) AS n, round(pp / n, 6) AS prevalence, round(threshold, 6) AS threshold,
  round(auc_roc, 6) AS auc_roc, round(auc_pr, 6) AS auc_pr, round(pp / n, 6) AS auc_pr_baseline,
  round((tp + tn) / n, 6) AS accuracy, round((tp / pp + tn / qq) / 2, 6) AS balanced_accuracy,
  round(tp / pp, 6) AS sensitivity, round(tn / qq, 6) AS specificity, round(tp / (tp + fp), 6) AS "precision",
  round(tn / (tn + fn), 6) AS npv, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(pp) * sqrt(qq) * sqrt(tn + fn)), 6) AS mcc,
  round(sq / n, 6) AS brier, round(gap / n, 6) AS ece,
  round(tp10 / n - fp10 / n * (0.1::DOUBLE / (1 - 0.1::DOUBLE)), 6) AS net_benefit_10,
  round(tp20 / n - fp20 / n * (0.2::DOUBLE / (1 - 0.2::DOUBLE)), 6) AS net_benefit_20,
  CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM m"""


@query(sql=SUMMARY_SQL)
def metric_summary(spark, sf):
    return rounded(metrics.summary(SCORES.frame(spark, sf), by=["stratum"]))


@query(sql=f"""
SELECT study, round(avg(pow(p - y, 2)), 6) AS brier FROM {SCORES.sql} t WHERE y IS NOT NULL GROUP BY study""")
def brier_by_study(spark, sf):
    return rounded(metrics.brier(SCORES.frame(spark, sf), by=["study"]))


@query(sql=f"""
WITH b AS (SELECT stratum, {EDGES} AS bin, count(*) AS n, sum(y) AS pos, sum(p) AS total FROM {SCORES.sql} t
  WHERE y IS NOT NULL GROUP BY ALL)
SELECT stratum, round(sum(abs(pos - total)) / sum(n), 6) AS ece FROM b GROUP BY stratum""")
def calibration_error(spark, sf):
    return rounded(metrics.calibration_error(SCORES.frame(spark, sf), by=["stratum"]))


@query(sql=f"""
WITH s AS (SELECT * FROM {SCORES.sql} t WHERE y IS NOT NULL),
e AS (SELECT DISTINCT unnest(quantile_cont(p, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS edge FROM s),
b AS (SELECT edge AS lo, lead(edge) OVER (ORDER BY edge) AS hi, row_number() OVER (ORDER BY edge) AS bin FROM e)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed,
  CAST(sum(y) AS BIGINT) AS pos FROM b JOIN s ON p BETWEEN lo AND hi WHERE hi IS NOT NULL GROUP BY bin HAVING count(*) >= 5""")
def calibration_curve(spark, sf):
    return rounded(metrics.calibration_curve(SCORES.frame(spark, sf)))


DECISION_SQL = f"""
WITH s AS (SELECT * FROM {SCORES.sql} t WHERE y IS NOT NULL), cuts AS (SELECT * FROM (VALUES {CUT_VALUES}) v(threshold)),
k AS (SELECT threshold, count(*) AS n, sum(y) AS pos, sum(1 - y) AS neg,
  sum(CASE WHEN p >= threshold THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold THEN 1 - y ELSE 0 END) AS fp
  FROM cuts CROSS JOIN s GROUP BY threshold),
d AS (SELECT threshold, tp / n - fp / n * (threshold / (1 - threshold)) AS model,
  pos / n - neg / n * (threshold / (1 - threshold)) AS treat_all FROM k)"""


@query(sql=DECISION_SQL + """
SELECT round(threshold, 6) AS threshold, round(model, 6) + 0.0::DOUBLE AS model, round(treat_all, 6) + 0.0::DOUBLE AS treat_all,
  model > 0 AND model > treat_all AS useful FROM d""")
def decision_curve(spark, sf):
    return rounded(metrics.decision_curve(SCORES.frame(spark, sf), CUTS))


@query(sql=DECISION_SQL + """
SELECT round(min(threshold), 6) AS lowest, round(max(threshold), 6) AS highest FROM d WHERE model > 0 AND model > treat_all""")
def decision_useful_range(spark, sf):
    return rounded(metrics.useful_range(metrics.decision_curve(SCORES.frame(spark, sf), CUTS)))


@query(sql=f"""
WITH s AS (SELECT * FROM {SCORES.sql} t WHERE y IS NOT NULL), cuts AS (SELECT * FROM (VALUES {GRID_VALUES}) v(threshold))
SELECT round(threshold, 6) AS threshold, round(avg(CASE WHEN (p >= threshold) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(sum(CASE WHEN p >= threshold THEN y ELSE 0 END) / sum(y), 6) AS sensitivity
FROM cuts CROSS JOIN s GROUP BY threshold""")
def threshold_sweep(spark, sf):
    return rounded(metrics.threshold_sweep(SCORES.frame(spark, sf), GRID))


@query(sql=f"""
SELECT stratum, round(avg(y), 6) AS prevalence, round(greatest(avg(y), 1 - avg(y)), 6) AS majority_accuracy
FROM {SCORES.sql} t WHERE y IS NOT NULL GROUP BY stratum""")
def majority_baseline(spark, sf):
    return rounded(metrics.majority_baseline(SCORES.frame(spark, sf), by=["stratum"]))


@query(sql=f"""
SELECT round(avg(y), 6) AS prevalence, round(avg(CASE WHEN (p >= 0.4::DOUBLE) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(greatest(avg(y), 1 - avg(y)), 6) AS majority_accuracy,
  round(avg(CASE WHEN (p >= 0.4::DOUBLE) = (y = 1) THEN 1.0 ELSE 0.0 END) - greatest(avg(y), 1 - avg(y)), 6) AS margin
FROM {SCORES.sql} t WHERE y IS NOT NULL""")
def accuracy_with_baseline(spark, sf):
    return rounded(metrics.accuracy_with_baseline(SCORES.frame(spark, sf), 0.4))


def demo_masks():
    f = F.col
    return {
        "All": F.lit(True),
        "Open": f("stratum") == "O",
        "Filled": f("stratum") == "F",
        "Low part": f("grp") % 10 < 3,
        "Study even": f("study") % 2 == 0,
        "Rare": (f("grp") == 7) & (f("study") < 3),
    }


STRATA_SQL = "[CASE WHEN true THEN 'All' END, CASE WHEN stratum = 'O' THEN 'Open' END, CASE WHEN stratum = 'F' THEN 'Filled' END," \
    " CASE WHEN grp % 10 < 3 THEN 'Low part' END, CASE WHEN study % 2 = 0 THEN 'Study even' END," \
    " CASE WHEN grp = 7 AND study < 3 THEN 'Rare' END]"


@query(sql=f"""
SELECT s AS stratum, count(*) AS n, CAST(sum(y) AS BIGINT) AS events FROM (
  SELECT unnest({STRATA_SQL}) AS s, y FROM {SCORES.sql} t WHERE y IS NOT NULL) WHERE s IS NOT NULL GROUP BY s""")
def overlapping_strata(spark, sf):
    hist = strata.stratum_histogram(SCORES.frame(spark, sf), demo_masks())
    return hist.groupBy("stratum").agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("events"))


@query(sql=f"""
WITH x AS (SELECT unnest({STRATA_SQL}) AS stratum, y, p FROM {SCORES.sql} t WHERE y IS NOT NULL),
{curve_sql('(SELECT * FROM x WHERE stratum IS NOT NULL)', by='stratum')},
m AS (SELECT stratum, max(np) AS pp, max(nn) AS qq, {AUC_SQL} AS auc,
  sum(CASE WHEN p >= 0.4::DOUBLE THEN pos ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.4::DOUBLE THEN neg ELSE 0 END) AS fp
  FROM c GROUP BY stratum)
SELECT stratum, CAST(pp + qq AS BIGINT) AS n, CAST(pp AS BIGINT) AS events, round(pp / (pp + qq), 6) AS prevalence,
  CASE WHEN pp >= 10 AND qq >= 10 THEN round(auc, 6) END AS auc_roc,
  CASE WHEN pp >= 10 AND qq >= 10 THEN round(tp / pp, 6) END AS sensitivity,
  CASE WHEN pp >= 10 AND qq >= 10 THEN round((qq - fp) / qq, 6) END AS specificity,
  CASE WHEN pp >= 10 AND qq >= 10 THEN '' ELSE
    concat('too few events (', CAST(CAST(pp AS BIGINT) AS STRING), ') for a stable estimate') END AS note FROM m""")
def stratum_report(spark, sf):
    return rounded(strata.stratum_report(SCORES.frame(spark, sf), demo_masks(), 0.4))


@query(sql=f"""
SELECT round(q, 6) AS q, CAST(n AS BIGINT) AS n, CAST(before AS BIGINT) AS n_before, round(before + (n + 1) / 2, 6) AS midrank FROM (
  SELECT q, n, sum(n) OVER (ORDER BY q) - n AS before FROM (SELECT p AS q, count(*) AS n FROM {SCORES.sql} t GROUP BY p))""")
def midranks(spark, sf):
    ranks = ordered.value_ranks(SCORES.frame(spark, sf), "p").withColumnRenamed("p", "q")
    return rounded(ranks.select("q", "n", "n_before", "midrank"))


@query(sql=f"""
WITH s AS (SELECT * FROM {SCORES.sql} t)
SELECT stratum, unnest([0.05::DOUBLE, 0.25, 0.5, 0.95]) AS prob,
  round(unnest(quantile_cont(q, [0.05, 0.25, 0.5, 0.95])), 6) AS "value" FROM s GROUP BY stratum""")
def exact_quantiles(spark, sf):
    return rounded(ordered.quantiles(SCORES.frame(spark, sf), "q", [0.05, 0.25, 0.5, 0.95], ["stratum"]))


@query(sql=f"""
WITH ref AS (SELECT p FROM {SCORES.sql} t WHERE stratum = 'O'), ask AS (SELECT DISTINCT p FROM {SCORES.sql} t WHERE stratum = 'F'),
h AS (SELECT p, sum(r) AS n, min(r) AS asked FROM (SELECT p, 1 AS r FROM ref UNION ALL SELECT p, 0 FROM ask) GROUP BY p),
c AS (SELECT p, asked, sum(n) OVER (ORDER BY p) AS upto, sum(n) OVER () AS n FROM h)
SELECT round(p, 6) AS p, round(upto / n, 6) AS share FROM c WHERE asked = 0""")
def training_rank_transform(spark, sf):
    df = SCORES.frame(spark, sf)
    return rounded(ordered.share_at_or_below(df.where("stratum = 'O'"), df.where("stratum = 'F'"), "p"))


@query(sql=f"""
WITH m AS (SELECT pos, count(*) AS n FROM {MEMBERS.sql} t WHERE pos IS NOT NULL GROUP BY pos)
SELECT CAST(pos AS DOUBLE) AS pos,
  CAST(sum(n) OVER (ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) - 1 AS BIGINT) AS within_50,
  CAST(sum(n) OVER (ORDER BY pos RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) - 1 AS BIGINT) AS within_500 FROM m""")
def neighbourhood_density(spark, sf):
    df = MEMBERS.frame(spark, sf)
    return ordered.neighbour_count(df, df, "pos", [50, 500])


@query(sql=f"""
WITH n AS (SELECT study, count(*) AS n FROM {SCORES.sql} t GROUP BY study)
SELECT study, n, round(n / (sum(n) OVER ()), 6) AS share FROM n""")
def share_of_total(spark, sf):
    counts = SCORES.frame(spark, sf).groupBy("study").agg(F.count(F.lit(1)).alias("n"))
    return rounded(ordered.share_of_total(counts, "n"))


@query(sql=f"""
WITH r AS (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS rung, avg(l_extendedprice) AS auc FROM lineitem GROUP BY 1)
SELECT rung, round(auc, 4) AS auc, round(auc - lag(auc) OVER (ORDER BY rung), 4) AS gain FROM r""")
def ladder_step_gain(spark, sf):
    rungs = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(
        F.floor(F.col("l_quantity") / 10).alias("rung")).agg(F.avg("l_extendedprice").alias("auc"))
    return rounded(ordered.step_gain(rungs, "auc", "rung"), 4)


def placement_sql(score: str, name: str) -> str:
    return f"""{name}h AS (SELECT {score} AS s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM s GROUP BY 1),
{name} AS (SELECT s, (sum(neg) OVER (ORDER BY s) - neg / 2) / sum(neg) OVER () AS beats,
  (sum(pos) OVER (ORDER BY s DESC) - pos / 2) / sum(pos) OVER () AS beaten FROM {name}h)"""


@query(sql=f"""
WITH s AS (SELECT y, p, q FROM {SCORES.sql} t WHERE y IS NOT NULL), {placement_sql('p', 'a')}, {placement_sql('q', 'b')},
r AS (SELECT y, a.beats AS xa, a.beaten AS ya, b.beats AS xb, b.beaten AS yb FROM s JOIN a ON a.s = p JOIN b ON b.s = q),
v AS (SELECT avg(xa) FILTER (y = 1) AS auc_a, avg(xb) FILTER (y = 1) AS auc_b,
  var_samp(xa - xb) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(ya - yb) FILTER (y = 0) / count(*) FILTER (y = 0) AS v FROM r)
SELECT round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS delta,
  round((auc_a - auc_b) / sqrt(v), 4) AS z FROM v""")
def paired_auc_test(spark, sf):
    out = stats.paired_auc_test(SCORES.frame(spark, sf), keep_p=False)
    return rounded(out.withColumn("z", F.round("z", 4)))


@query(sql=f"""
WITH s AS (SELECT y, p, q FROM {SCORES.sql} t WHERE y IS NOT NULL), {placement_sql('p', 'a')}, {placement_sql('q', 'b')},
r AS (SELECT y, a.beats AS xa, a.beaten AS ya, b.beats AS xb, b.beaten AS yb FROM s JOIN a ON a.s = p JOIN b ON b.s = q),
v AS (SELECT avg(xa) FILTER (y = 1) AS auc_a, avg(xb) FILTER (y = 1) AS auc_b,
  var_samp(xa - xb) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(ya - yb) FILTER (y = 0) / count(*) FILTER (y = 0) AS v FROM r)
SELECT round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS delta,
  round((auc_a - auc_b) / sqrt(v), 4) AS z, round({normal_p_sql('(auc_a - auc_b) / sqrt(v)')}, 6) AS p_value FROM v""")
def paired_auc_test_with_p(spark, sf):
    return rounded(stats.paired_auc_test(SCORES.frame(spark, sf)).withColumn("z", F.round("z", 4)))


@query
def bootstrap_auc_interval(spark, sf):
    return rounded(stats.bootstrap_interval(SCORES.frame(spark, sf), by=["stratum"]))


@query(sql=f"""
WITH {curve_sql(by='stratum')},
a AS (SELECT stratum, {AUC_SQL} AS auc_roc, {AP_SQL} AS auc_pr, arg_max(tp / np, (tp / np - fp / nn, p)) AS sensitivity FROM c GROUP BY stratum)
SELECT stratum, metric, round(point, 6) AS point, true AS inside, 300 AS n_boot FROM a UNPIVOT (point FOR metric IN (auc_roc, auc_pr, sensitivity))""")
def exact_bootstrap_points(spark, sf):
    """Points of three metrics over all distinct scores, whether their intervals hold them, and the replicates that had both classes."""
    found = stats.exact_bootstrap(SCORES.frame(spark, sf), n_boot=300, by=["stratum"])
    return rounded(found.select("stratum", "metric", "point", F.col("point").between(F.col("lo"), F.col("hi")).alias("inside"), "n_boot"))


@query(sql=f"""
WITH x AS (SELECT unnest({STRATA_SQL}) AS stratum, y, p FROM {SCORES.sql} t WHERE y IS NOT NULL),
{curve_sql('(SELECT * FROM x WHERE stratum IS NOT NULL)', by='stratum')},
m AS (SELECT stratum, max(np) AS pp, max(nn) AS qq, {AUC_SQL} AS auc FROM c GROUP BY stratum)
SELECT stratum, CAST(pp AS BIGINT) AS events, CASE WHEN pp >= 10 AND qq >= 10 THEN round(auc, 6) END AS auc_roc,
  CASE WHEN pp >= 10 AND qq >= 10 THEN true END AS inside FROM m""")
def stratum_intervals(spark, sf):
    """The stratum report with the bootstrap interval of every AUC, and whether it holds the AUC."""
    report = strata.stratum_report(SCORES.frame(spark, sf), demo_masks(), 0.4, n_boot=500)
    return rounded(report.select("stratum", "events", "auc_roc", F.col("auc_roc").between(F.col("auc_lo"), F.col("auc_hi")).alias("inside")))


def members_long(spark, sf):
    return MEMBERS.frame(spark, sf).unpivot(["id", "y", "grp"], ["alpha", "beta", "gamma"], "model", "p")


@query
def best_model_tie_tier(spark, sf):
    return rounded(stats.tie_tier(members_long(spark, sf).where("y is not null")))
