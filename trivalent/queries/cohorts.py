"""Sources, joins, cohort aggregates, splits, set forms and associations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text
from ..operators import aggregates, metrics, relations, splits, stats
from ..plans import features
from ..session import materialise, shared_folder
from ..sources import tables
from ..streaming import scoring as streaming
from .bindings import CATALOGUE, MEMBERS, RECORDS, SCORES, VARIANTS
from .registry import query
from .scalars import (ACTIVITY, AA_SQL, CATALOGUE_EFFECT_SQL, EFFECT_SQL, PROTEIN_SQL, READING, REGION_SQL,
                      REGISTRY_LABEL, REGISTRY_SEVERITY, clean, key)
from .shared import AUC_SQL, chi_square_p_sql, curve_sql, normal_p_sql, rounded


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


CATALOGUE_LABEL = "CASE WHEN lower(trim(h)) IN ('yes', 'y') THEN 1 WHEN lower(trim(h)) IN ('no', 'n') THEN 0 END"


def records(spark, sf):
    """Joined registry records; the binding's key uniqueness is checked in its own query."""
    return tables.registry_records(RECORDS.frame(spark, sf), VARIANTS.frame(spark, sf), check=False)


def known_labels(spark, sf):
    return SCORES.frame(spark, sf).where("y IS NOT NULL")


@query(sql=f"""
SELECT v.mut_effect AS effect, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, round(avg(y), 6) AS rate FROM (
  SELECT mut_id, {REGISTRY_LABEL} AS y FROM {RECORDS.sql} r) r JOIN (
  SELECT mut_id, {EFFECT_SQL.format('e')} AS mut_effect FROM (SELECT mut_id, lower({clean('mut_effect')}) AS e FROM {VARIANTS.sql} t) t) v
USING (mut_id) WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) >= 25""")
def outcome_rate_by_class(spark, sf):
    return rounded(aggregates.outcome_rate(records(spark, sf), ["effect"]))


# --- sources and sinks ---------------------------------------------------------

@query(sql=f"""
SELECT {CATALOGUE_LABEL} AS inhibitor, gene, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (
  SELECT id, "History of Inhibitor" AS h, 'F8' AS gene FROM {CATALOGUE.sql} t) GROUP BY ALL""")
def catalogue_scan(spark, sf):
    """Catalogue text with untidy headers and doubled rows, through CSV and the reader."""
    raw = CATALOGUE.frame(spark, sf).withColumns({c: F.col(f"`{c}`").cast("string") for c in ("id",)})
    untidy = raw.withColumnsRenamed({"HGVS cDNA": "HGVS  cDNA ", "Exon": " Exon"}).withColumn("Unnamed: 3", F.lit("z"))
    path = scratch(spark, "catalogue")
    untidy.unionByName(untidy.where("id % 5 = 0")).write.option("header", True).csv(path)
    loaded = tables.load_catalogue(spark, path)
    return loaded.groupBy("inhibitor", "gene").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


@query(sql=f"""
SELECT {CATALOGUE_LABEL} AS inhibitor, {key('s')} AS severity_key, 'F9' AS gene, count(*) AS n FROM (
  SELECT "History of Inhibitor" AS h, "Reported Clinical Severity" AS s FROM {CATALOGUE.sql} t) GROUP BY ALL""")
def external_catalogue_scan(spark, sf):
    back = {new: old for old, new in fv.EXTERNAL_RENAMES.items()}
    path = scratch(spark, "external")
    CATALOGUE.frame(spark, sf).withColumnsRenamed(back).write.option("header", True).csv(path)
    loaded = tables.load_external(spark, path)
    return loaded.groupBy("inhibitor", text.text_key("`Reported Clinical Severity`").alias("severity_key"), "gene").agg(
        F.count(F.lit(1)).alias("n"))


@query(sql=f"""
WITH v AS (SELECT mut_id, {EFFECT_SQL.format('e')} AS effect FROM (SELECT mut_id, lower({clean('mut_effect')}) AS e FROM {VARIANTS.sql} t)),
r AS (SELECT mut_id, {REGISTRY_LABEL} AS y, {REGISTRY_SEVERITY} AS severity, {ACTIVITY} AS act, {REGION_SQL.format('g')} AS region,
  coalesce({clean('reference')}, 'unknown') AS study FROM (SELECT *, replace(lower({clean('cli_phe')}), ' ', '') AS k,
  {READING.format(clean('clotting'))} AS a, lower({clean('pa_race')}) AS g FROM {RECORDS.sql} t))
SELECT effect, severity, region, CAST(y AS INT) AS y, count(*) AS n, round(sum(act), 4) AS activity, count(DISTINCT study) AS studies
FROM r LEFT JOIN v USING (mut_id) GROUP BY ALL""")
def registry_scan(spark, sf):
    """Two CSV files to joined records with every derived column."""
    facts, dim = scratch(spark, "records"), scratch(spark, "variants")
    RECORDS.frame(spark, sf).write.option("header", True).csv(facts)
    VARIANTS.frame(spark, sf).write.option("header", True).csv(dim)
    joined = tables.load_registry(spark, dim, facts)
    return rounded(joined.groupBy("effect", "severity", "region", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fviii_activity").alias("activity"),
        F.count_distinct("study").alias("studies")), 4)


FUSED = {
    "History of Inhibitor": "`History of Inhibitor`",
    "Patient_ID": "concat(substr(md5(CAST(id AS STRING)), 1, 8), '-', substr(md5(CAST(id AS STRING)), 9, 4), '-4',"
                  " substr(md5(CAST(id AS STRING)), 14, 3), '-a', substr(md5(CAST(id AS STRING)), 18, 3), '-', substr(md5(CAST(id AS STRING)), 21, 12))",
    "Age_at_Diagnosis": "CASE WHEN id % 41 = 0 THEN 'n/a' ELSE CAST(id % 30 AS STRING) END",
    "Exposure_Days": "CAST((id % 30) * 4 + id % 7 AS STRING)",
    "Ethnicity": "CASE id % 6 WHEN 0 THEN 'Caucasian' WHEN 1 THEN 'Asian' WHEN 2 THEN ' Black' WHEN 3 THEN 'Hispanic' WHEN 4 THEN 'Other' END",
    "Treatment_Regimen": "CASE id % 3 WHEN 0 THEN 'Prophylaxis' WHEN 1 THEN ' prophylaxis ' ELSE 'On-demand' END",
    "Family_History": "CAST(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS STRING)",
    "Inhibitor_Status": "'0'",
}
FUSED_SQL = "(SELECT id, " + ", ".join(f'{e.replace("`", chr(34))} AS "{n}"' for n, e in FUSED.items()) + f" FROM {CATALOGUE.sql} b)"


def fused(spark, sf):
    return CATALOGUE.frame(spark, sf).selectExpr("id", *[f"{e} AS `{n}`" for n, e in FUSED.items()])


def loaded_fused(spark, sf):
    path = scratch(spark, "fused")
    fused(spark, sf).write.option("header", True).csv(path)
    return tables.load_fused(spark, path)


@query(sql=f"""
SELECT id, CAST({CATALOGUE_LABEL} AS INT) AS inhibitor, Age_at_Diagnosis AS age FROM (
  SELECT CAST(id AS BIGINT) AS id, "History of Inhibitor" AS h, Age_at_Diagnosis FROM {FUSED_SQL} t)""")
def fused_scan(spark, sf):
    return loaded_fused(spark, sf).select(F.col("id").cast("long").alias("id"), "inhibitor", F.col("Age_at_Diagnosis").alias("age"))


@query(sql="SELECT o_orderkey AS id, concat('c.', CAST(o_custkey + 1 AS STRING), 'A>G') AS cdna, CAST(NULL AS STRING) AS domain FROM orders")
def headers_and_aliases(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey AS id", "concat('c.', CAST(o_custkey + 1 AS STRING), 'A>G') AS `hgvs\n cdna  name`", "1 AS `Unnamed: 0`")
    tidy = tables.clean_headers(df)
    return tables.resolve(tidy, {k: fv.CATALOGUE_ALIASES[k] for k in ("cdna", "domain")}, ["id"])


@query(sql=f"""
SELECT model, count(*) AS n, round(avg(p), 6) AS mean_p FROM (
  SELECT 'alpha' AS model, alpha AS p FROM {MEMBERS.sql} t UNION ALL SELECT 'beta', beta FROM {MEMBERS.sql} t) GROUP BY model""")
def score_sink_by_model(spark, sf):
    """Long scores written per model and read back, one report through JSON."""
    long = MEMBERS.frame(spark, sf).unpivot(["id", "y"], ["alpha", "beta"], "model", "p")
    path, report = scratch(spark, "scores"), scratch(spark, "report")
    tables.write_scores(long, path)
    out = tables.read_scores(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"))
    tables.write_report(rounded(out), report)
    return spark.read.schema("model string, n long, mean_p double").json(report)


BROKEN_LINE = """CASE WHEN o_orderkey % 50 = 0 THEN concat(CAST(o_orderkey AS STRING), ',x')
  WHEN o_orderkey % 50 = 1 THEN concat(CAST(o_orderkey AS STRING), ',a,b,c,d')
  WHEN o_orderkey % 50 = 2 THEN concat(CAST(o_orderkey AS STRING), ',,v')
  ELSE concat(CAST(o_orderkey AS STRING), ',"a ""quoted"", field",', o_orderstatus) END"""


def broken_lines(spark, sf):
    """A folder of CSV lines, some of them with too few, too many or blank fields."""
    path = scratch(spark, "lines")
    lines = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(f"{BROKEN_LINE} AS value")
    lines.write.option("lineSep", "\n").text(f"{path}/raw")
    # Each file gets a header line: partitions are written by Spark's own CSV writer, unquoted.
    spark.read.text(f"{path}/raw").withColumnRenamed("value", "id,name,status").write.option("header", True).option(
        "quote", "").option("sep", "\x01").csv(f"{path}/csv")
    return f"{path}/csv"


QUARANTINE_SQL = """
SELECT CASE WHEN k IN (0, 1) THEN 'fields do not match the header' WHEN k = 2 THEN 'no value for name' ELSE 'sound' END AS reason, count(*) AS n
FROM (SELECT o_orderkey % 50 AS k FROM orders) GROUP BY 1"""


@query(sql=QUARANTINE_SQL)
def quarantined_rows(spark, sf):
    """Rows read from CSV by reason of refusal; none is lost and none is filled with NULLs."""
    sound, rejects = tables.read_checked(spark, broken_lines(spark, sf), ["id", "name", "status"], ["name"])
    reasons = rejects.select("reason").unionByName(sound.where("id IS NOT NULL AND name = 'a \"quoted\", field'").select(F.lit("sound").alias("reason")))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(sql=QUARANTINE_SQL)
def stream_quarantine(spark, sf):
    """The same from a stream of files."""
    out, rejects = scratch(spark, "sound"), scratch(spark, "refused")
    stream = streaming.read_lines(spark, broken_lines(spark, sf), ["id", "name", "status"])
    streaming.quarantine_stream(stream, ["name"], out, rejects, scratch(spark, "progress")).awaitTermination()
    both = spark.read.parquet(rejects).select("reason").unionByName(spark.read.parquet(out).select(F.lit("sound").alias("reason")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(sql=f"""
WITH l AS (SELECT y, 'alpha' AS model, alpha AS p FROM {MEMBERS.sql} t UNION ALL SELECT y, 'beta', beta FROM {MEMBERS.sql} t
  UNION ALL SELECT y, 'gamma', gamma FROM {MEMBERS.sql} t), {curve_sql('(SELECT * FROM l)', by='model')},
a AS (SELECT model, {AUC_SQL} AS auc_roc FROM c GROUP BY model)
SELECT model, round(auc_roc, 6) AS auc_roc, CAST(row_number() OVER (ORDER BY auc_roc DESC, model) AS INT) AS place FROM a""")
def ranked_model_report(spark, sf):
    long = MEMBERS.frame(spark, sf).unpivot(["id", "y"], ["alpha", "beta", "gamma"], "model", "p")
    board = relations.leaderboard(metrics.roc_auc(long, by=["model"]), "auc_roc")
    return rounded(board.withColumn("place", F.row_number().over(Window.orderBy(F.desc("auc_roc"), "model"))))  # three rows


# --- joins ----------------------------------------------------------------------

@query(sql="""
SELECT l_orderkey, l_partkey AS mut_id, l_quantity AS size, p_size AS size_v FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def fact_dimension_join(spark, sf):
    facts = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "l_partkey AS mut_id", "l_quantity AS size")
    dim = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS mut_id", "p_size AS size")
    return relations.join_dimension(facts, dim, "mut_id")


KEY_SQL = f"""
reg AS (SELECT {EFFECT_SQL.format('e')} AS effect, round(TRY_CAST(aa_numb AS DOUBLE) - 19, 1) AS mature_pos, {AA_SQL.format('a')} AS ref_aa,
  {AA_SQL.format('b')} AS alt_aa FROM (SELECT lower({clean('mut_effect')}) AS e, aa_numb, {clean('aa_first')} AS a, {clean('aa_last')} AS b FROM {VARIANTS.sql} t)),
{PROTEIN_SQL.replace('{src}', CATALOGUE.sql)},
cat AS (SELECT s3.id, {CATALOGUE_EFFECT_SQL.format('v')} AS effect, round(mature, 1) AS mature_pos, ref AS ref_aa,
  CASE WHEN NOT fs AND alt = '=' THEN ref ELSE alt END AS alt_aa
  FROM s3 JOIN (SELECT id, lower({clean('"Variant Type"')}) AS v FROM {CATALOGUE.sql} t) t USING (id)),
hit AS (SELECT cat.*, EXISTS (SELECT 1 FROM reg WHERE reg.effect = cat.effect AND reg.mature_pos IS NOT DISTINCT FROM cat.mature_pos
  AND reg.ref_aa IS NOT DISTINCT FROM cat.ref_aa AND reg.alt_aa IS NOT DISTINCT FROM cat.alt_aa) AS known FROM cat)"""
KEYS = ["effect", "mature_pos", "ref_aa", "alt_aa"]


def registry_pair(spark, sf):
    reg = features.registry_keys(VARIANTS.frame(spark, sf).withColumn("effect", text.registry_effect("mut_effect")))
    # Parsed once: a filter on a key would otherwise be pushed into the parser.
    return materialise(features.catalogue_keys(CATALOGUE.frame(spark, sf), ["id"]), "keys"), materialise(reg, "keys")


@query(sql=f"WITH {KEY_SQL} SELECT id, effect, mature_pos FROM hit WHERE known")
def registry_overlap_shared(spark, sf):
    cat, reg = registry_pair(spark, sf)
    return relations.overlap(cat, reg, KEYS).select("id", "effect", "mature_pos")


@query(sql=f"WITH {KEY_SQL} SELECT id FROM hit WHERE NOT known AND mature_pos IS NOT NULL")
def registry_overlap_novel(spark, sf):
    cat, reg = registry_pair(spark, sf)
    return relations.overlap(cat, reg, KEYS, shared=False).where("mature_pos IS NOT NULL").select("id")


@query(sql=f"""
WITH {KEY_SQL} SELECT count(*) AS n_resolvable, CAST(sum(CAST(known AS INT)) AS BIGINT) AS n_shared,
  round(avg(CAST(known AS INT)), 6) AS share_shared FROM hit WHERE mature_pos IS NOT NULL""")
def registry_overlap_share(spark, sf):
    cat, reg = registry_pair(spark, sf)
    return rounded(relations.overlap_summary(cat, reg, KEYS, F.col("mature_pos").isNotNull()))


@query(sql="""
WITH t AS (SELECT l_partkey, l_quantity, l_discount FROM lineitem WHERE l_linestatus = 'F'), o AS (
  SELECT DISTINCT l_partkey, l_quantity, l_discount FROM lineitem WHERE l_linestatus = 'O')
SELECT count(*) AS n_copied FROM t JOIN o USING (l_partkey, l_quantity, l_discount)""")
def cross_split_copies(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_quantity", "l_discount", "l_linestatus")
    columns = ["l_partkey", "l_quantity", "l_discount"]
    hits = relations.rows_also_in(df.where("l_linestatus = 'F'"), df.where("l_linestatus = 'O'"), columns)
    return hits.agg(F.count(F.lit(1)).alias("n_copied"))


@query(sql="SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_linestatus) <> max(l_linestatus)")
def straddling_groups(spark, sf):
    return relations.straddling_groups(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey", "l_linestatus")


RANKINGS_SQL = """
t AS (SELECT l_suppkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1),
a AS (SELECT l_suppkey, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS rank_a FROM t),
b AS (SELECT l_suppkey, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS rank_b FROM t)"""


def supplier_totals(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))


@query(sql=f"WITH {RANKINGS_SQL} SELECT count(*) AS n, round(corr(rank_a, rank_b), 6) AS spearman FROM a JOIN b USING (l_suppkey)")
def ranking_agreement(spark, sf):
    totals = supplier_totals(spark, sf)
    joined = relations.ranking_join(totals.withColumnRenamed("q", "rank"), totals.withColumnRenamed("n", "rank"), "l_suppkey")
    return rounded(stats.rank_agreement(joined))


@query(sql="""
WITH t AS (SELECT l_suppkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1),
x AS (SELECT l_suppkey FROM t ORDER BY q DESC, l_suppkey LIMIT 20), y AS (SELECT l_suppkey FROM t ORDER BY n DESC, l_suppkey LIMIT 25),
s AS (SELECT count(*) AS k, (SELECT count(*) FROM x) AS a, (SELECT count(*) FROM y) AS b FROM x JOIN y USING (l_suppkey))
SELECT k AS shared, round(k / (a + b - k), 6) AS jaccard, round(k / least(a, b), 6) AS overlap FROM s""")
def top_set_agreement(spark, sf):
    totals = supplier_totals(spark, sf)
    best = lambda c, k: relations.top_k(totals, c, k, "l_suppkey").select("l_suppkey")
    return rounded(stats.set_agreement(best("q", 20), best("n", 25), "l_suppkey"))


MODEL_SQL = """
cv AS (SELECT event_type AS model, avg(value) AS mean FROM events GROUP BY 1),
bl AS (SELECT event_type AS model, max(value) AS blocked_auc FROM events GROUP BY 1),
cp AS (SELECT event_type AS model, CASE WHEN event_type = 'view' THEN NULL ELSE count(*) / 40000 END AS p_value FROM events GROUP BY 1)"""


def model_tables(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "model").groupBy("model").agg(
        F.avg("value").alias("mean"), F.max("value").alias("blocked_auc"), (F.count(F.lit(1)) / 40000).alias("p_value"))
    events = materialise(events.withColumn("p_value", F.when(F.col("model") != "view", F.col("p_value"))), "models")
    return tuple(events.select("model", c) for c in ("mean", "blocked_auc", "p_value"))


@query(sql=f"""
WITH {MODEL_SQL} SELECT model, round(mean, 6) AS mean, round(blocked_auc, 6) AS blocked_auc, round(p_value, 6) AS p_value
FROM cv JOIN bl USING (model) JOIN cp USING (model) WHERE p_value >= 0.05 OR p_value IS NULL ORDER BY blocked_auc DESC, model LIMIT 1""")
def model_selection(spark, sf):
    return rounded(relations.select_model(*model_tables(spark, sf)))


# --- aggregates -----------------------------------------------------------------

@query(sql=f"""
SELECT stratum, count(*) AS n_total, count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y = 0) AS n_negative,
  count(*) FILTER (y IS NULL) AS n_unlabelled, count(y) AS n_labelled, round(avg(y), 6) AS prevalence_labelled,
  round(count(*) FILTER (y = 1) / count(*), 6) AS prevalence_if_unknown_negative FROM {SCORES.sql} t GROUP BY stratum""")
def label_summary(spark, sf):
    return rounded(aggregates.label_summary(SCORES.frame(spark, sf), by=["stratum"]))


@query(sql=f"""
SELECT count(*) AS n_records, count(y) AS n_labelled, count(*) FILTER (y IS NULL) AS n_unlabelled, count(*) FILTER (y = 1) AS n_positive,
  count(*) FILTER (y = 0) AS n_negative, round(avg(y), 6) AS prevalence, count(DISTINCT grp) FILTER (y IS NOT NULL) AS n_variants_labelled,
  count(DISTINCT study) FILTER (y IS NOT NULL) AS n_studies_labelled FROM {SCORES.sql} t""")
def registry_label_summary(spark, sf):
    return rounded(aggregates.registry_summary(SCORES.frame(spark, sf), variant="grp"))


@query(sql=f"""
SELECT study, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, round(avg(y), 6) AS rate FROM {SCORES.sql} t
WHERE y IS NOT NULL GROUP BY study HAVING count(*) >= 400""")
def outcome_rate_min_support(spark, sf):
    return rounded(aggregates.outcome_rate(SCORES.frame(spark, sf), ["study"], min_rows=400))


@query(sql=f"""
SELECT lower(trim(coalesce("Inhibitors", '(blank)'))) AS "value", count(*) AS records FROM {RECORDS.sql} t GROUP BY 1""")
def value_counts_with_blanks(spark, sf):
    return aggregates.value_counts(RECORDS.frame(spark, sf), "Inhibitors")


@query(sql=f"""
WITH m AS (SELECT * FROM {MEMBERS.sql} t), n AS (SELECT count(*) AS n FROM m),
d AS (SELECT 'id' AS feature, count(DISTINCT id) AS k FROM m UNION ALL SELECT 'alpha', count(DISTINCT alpha) FROM m
  UNION ALL SELECT 'beta', count(DISTINCT beta) FROM m UNION ALL SELECT 'grp', count(DISTINCT grp) FROM m)
SELECT feature, k AS n_distinct, round(k / n, 6) AS share, k / n >= 0.5 AS identifier_like FROM d, n""")
def near_unique_features(spark, sf):
    audit = aggregates.cardinality_audit(MEMBERS.frame(spark, sf), ["id", "alpha", "beta", "grp"])
    return rounded(audit.select("feature", "n_distinct", "share", "identifier_like"))


@query(sql=f"""
SELECT count(DISTINCT i) AS n_unique, count(*) AS n_rows, round(avg(CASE WHEN regexp_matches(i, '{fv.UUID4_PATTERN}') THEN 1.0 ELSE 0.0 END), 6)
  AS share_matching FROM (SELECT "Patient_ID" AS i FROM {FUSED_SQL} t)""")
def id_pattern_share(spark, sf):
    return rounded(aggregates.pattern_share(fused(spark, sf), "Patient_ID"))


GROUP_SQL = f"g AS (SELECT grp, count(*) AS n, min(y) AS lo, max(y) AS hi, avg(y) AS rate FROM {SCORES.sql} t WHERE y IS NOT NULL GROUP BY grp)"


@query(sql=f"""
WITH {GROUP_SQL} SELECT count(*) FILTER (n >= 2) AS groups_2plus, count(*) FILTER (n >= 2 AND lo < hi) AS discordant_groups,
  round(count(*) FILTER (n >= 2 AND lo < hi) / count(*) FILTER (n >= 2), 6) AS discordance_rate,
  CAST(sum(n) FILTER (n >= 2 AND lo < hi) AS BIGINT) AS rows_in_discordant FROM g""")
def group_discordance(spark, sf):
    return rounded(aggregates.discordance(SCORES.frame(spark, sf), "grp"))


@query(sql=f"""
SELECT grp, count(*) AS n, CAST(avg(y) > 0.5 AS INT) AS y, round(avg(p), 6) AS p, round(avg(q), 6) AS q FROM {SCORES.sql} t
WHERE y IS NOT NULL GROUP BY grp""")
def group_majority_table(spark, sf):
    return rounded(aggregates.group_table(SCORES.frame(spark, sf), "grp", ["p", "q"]))


@query(sql=f"""
WITH g AS (SELECT grp, count(y) AS k, max(y) AS hi FROM {MEMBERS.sql} t GROUP BY grp)
SELECT count(*) AS n_groups, count(*) FILTER (k > 0) AS n_recorded, count(*) FILTER (k = 0) AS n_called_negative_unrecorded,
  round(count(*) FILTER (hi = 1) / count(*) FILTER (k > 0), 6) AS prevalence_recorded,
  round(count(*) FILTER (hi = 1) / count(*), 6) AS prevalence_relabelled FROM g""")
def relabel_cost(spark, sf):
    return rounded(aggregates.relabel_cost(MEMBERS.frame(spark, sf), "grp"))


@query(sql=f"""
WITH s AS (SELECT y, coalesce(y, 0) AS z, p FROM {SCORES.sql} t), {curve_sql('(SELECT y AS w, p FROM s)', label='w')},
{curve_sql('(SELECT z, p FROM s)', label='z').replace('h AS', 'h2 AS').replace('c AS', 'c2 AS').replace('FROM h)', 'FROM h2)')}
SELECT 'recorded' AS labels, round({AUC_SQL}, 6) AS auc_roc FROM c UNION ALL SELECT 'unknown_negative', round({AUC_SQL}, 6) FROM c2""")
def relabelled_scores_compared(spark, sf):
    """The same scores against the honest labels and with unknowns called negative."""
    both = SCORES.frame(spark, sf).select("p", F.explode(F.array(
        F.struct(F.lit("recorded").alias("labels"), F.col("y").alias("y")),
        F.struct(F.lit("unknown_negative").alias("labels"), F.coalesce("y", F.lit(0)).alias("y")))).alias("s")).select("p", "s.*")
    return rounded(metrics.roc_auc(both, by=["labels"]))


@query(sql=f"""
SELECT count(p) AS n_unlabelled, round(avg(p), 6) AS mean_risk, count(*) FILTER (p >= 0.5::DOUBLE) AS n_over,
  round(quantile_cont(p, 0.5), 6) AS median_risk, round(count(*) FILTER (p >= 0.5::DOUBLE) / count(*), 6) AS share_over
FROM {SCORES.sql} t WHERE y IS NULL""")
def unlabelled_pool_risk(spark, sf):
    return rounded(aggregates.pool_risk(SCORES.frame(spark, sf).where("y IS NULL")))


@query(sql=f"""
WITH a AS (SELECT 'p' AS feature, 'linear' AS block, p - 0.4::DOUBLE AS v FROM {SCORES.sql} t
  UNION ALL SELECT 'q', 'price', q - 0.5::DOUBLE FROM {SCORES.sql} t UNION ALL SELECT 'size', 'linear', p - q FROM {SCORES.sql} t),
f AS (SELECT feature, block, avg(abs(v)) AS m FROM a GROUP BY ALL), b AS (SELECT block, sum(m) AS m, count(*) AS k FROM f GROUP BY block)
SELECT block, round(m, 6) AS mean_abs, k AS n_features, round(m / sum(m) OVER (), 6) AS share FROM b""")
def block_attribution(spark, sf):
    wide = SCORES.frame(spark, sf).selectExpr("p - 0.4D AS p", "q - 0.5D AS q", "p - q AS size")
    long = wide.unpivot([], ["p", "q", "size"], "feature", "value")
    blocks = features.block_table(spark, {"linear": ["p", "size"], "price": ["q"]})
    return rounded(aggregates.block_rollup(long, blocks))


@query(sql=f"""
WITH {curve_sql(f'(SELECT y, p, study % 5 AS fold, stratum AS model FROM {SCORES.sql} s)', by='model, fold')},
a AS (SELECT model, fold, {AUC_SQL} AS auc FROM c GROUP BY model, fold)
SELECT model, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std, count(*) AS folds FROM a GROUP BY model""")
def fold_summary(spark, sf):
    df = SCORES.frame(spark, sf).select("y", "p", (F.col("study") % 5).alias("fold"), F.col("stratum").alias("model"))
    return rounded(aggregates.fold_summary(metrics.roc_auc(df, by=["model", "fold"])))


@query(sql=f"""
WITH r AS (SELECT id, y, unnest([alpha, beta, gamma]) AS p FROM {MEMBERS.sql} t)
SELECT id, CAST(max(y) AS INT) AS y, round(avg(p), 6) AS p, count(*) AS repeats FROM r GROUP BY id""")
def repeat_averaged_scores(spark, sf):
    repeats = MEMBERS.frame(spark, sf).unpivot(["id", "y"], ["alpha", "beta", "gamma"], "repeat", "p")
    return rounded(aggregates.average_repeats(repeats, ["id"]))


@query(sql="""
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(*) - count(DISTINCT l_orderkey) AS n_duplicates FROM lineitem""")
def duplicate_key_count(spark, sf):
    return aggregates.duplicate_keys(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey")


# --- associations ---------------------------------------------------------------

@query(sql=f"""
SELECT study, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, round(avg(y) * 100, 6) AS rate_pct
FROM {SCORES.sql} t WHERE y IS NOT NULL GROUP BY study""")
def category_cross_tab(spark, sf):
    return rounded(stats.cross_tab(SCORES.frame(spark, sf), "study"))


CHI_SQL = """
WITH t AS (SELECT {0} AS k, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b, count(*) AS n FROM {1} t WHERE y IS NOT NULL GROUP BY 1),
s AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb, sum(n) OVER () AS tn, count(*) OVER () AS m FROM t),
e AS (SELECT *, n * ta / tn AS ea, n * tb / tn AS eb FROM s),
g AS (SELECT *, abs(a - ea) - CASE WHEN m = 2 THEN least(0.5::DOUBLE, abs(a - ea)) ELSE 0 END AS ga,
  abs(b - eb) - CASE WHEN m = 2 THEN least(0.5::DOUBLE, abs(b - eb)) ELSE 0 END AS gb FROM e)
SELECT '{0}' AS category, n, CAST(dof AS INT) AS dof, round(x, 5) AS statistic, round(""" + chi_square_p_sql("x", "dof::DOUBLE") + """, 5) AS p_value FROM (
  SELECT CAST(max(tn) AS BIGINT) AS n, max(m) - 1 AS dof, sum(ga * ga / ea + gb * gb / eb) AS x FROM g)"""


@query(sql=CHI_SQL.format("study", SCORES.sql))
def chi_square_many(spark, sf):
    return rounded(stats.chi_square(SCORES.frame(spark, sf), "study"), 5)


@query(sql=CHI_SQL.format("stratum", SCORES.sql))
def chi_square_two_by_two(spark, sf):
    return rounded(stats.chi_square(SCORES.frame(spark, sf), "stratum"), 5)


@query(sql=f"""
WITH k AS (SELECT count(*) FILTER (e AND y = 1) AS a, count(*) FILTER (e AND y = 0) AS b, count(*) FILTER (NOT e AND y = 1) AS c,
  count(*) FILTER (NOT e AND y = 0) AS d FROM (SELECT y, study % 4 = 0 AS e FROM {SCORES.sql} t))
SELECT a, b, c, d, round((a / b) / (c / d), 6) AS odds_ratio FROM k""")
def odds_ratio(spark, sf):
    return rounded(stats.odds_ratio(SCORES.frame(spark, sf), F.col("study") % 4 == 0))


@query(sql=f"SELECT round(corr(p, q), 6) AS pearson_r FROM {SCORES.sql} t")
def pearson_pair(spark, sf):
    return rounded(stats.pearson(SCORES.frame(spark, sf), "p", "q"))


@query(sql=f"""
SELECT unnest(['alpha', 'beta', 'gamma', 'pos']) AS feature, round(unnest([corr(alpha, y), corr(beta, y), corr(gamma, y), corr(coalesce(pos, 1000), y)]), 6) AS r
FROM {MEMBERS.sql} t WHERE y IS NOT NULL""")
def feature_label_correlation(spark, sf):
    return rounded(stats.label_correlations(MEMBERS.frame(spark, sf), ["alpha", "beta", "gamma", "pos"], fill={"pos": 1000.0}))


@query(sql=f"""
WITH m AS (SELECT alpha, beta, gamma FROM {MEMBERS.sql} t)
SELECT 'alpha' AS a, 'beta' AS b, round(corr(alpha, beta), 6) AS r FROM m UNION ALL SELECT 'alpha', 'gamma', round(corr(alpha, gamma), 6) FROM m
UNION ALL SELECT 'beta', 'gamma', round(corr(beta, gamma), 6) FROM m""")
def model_correlation_matrix(spark, sf):
    matrix = stats.correlation_matrix(MEMBERS.frame(spark, sf), ["alpha", "beta", "gamma"])
    return rounded(matrix.where("a < b"))


@query(sql=f"""
WITH {curve_sql(by='stratum')}, u AS (SELECT stratum, max(np) AS n1, max(nn) AS n2, sum(pos * (nn - fp + neg / 2)) AS u,
  sum(pow(pos + neg, 3) - (pos + neg)) AS ties FROM c GROUP BY stratum),
w AS (SELECT stratum, n1, n2, u, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)
SELECT stratum, n1, n2, u, round(z, 5) AS z FROM w""")
def mann_whitney(spark, sf):
    return rounded(stats.mann_whitney(SCORES.frame(spark, sf), "p", by=["stratum"]).drop("p_value"), 5)


@query(sql=f"""
WITH {curve_sql(by='stratum')}, u AS (SELECT stratum, max(np) AS n1, max(nn) AS n2, sum(pos * (nn - fp + neg / 2)) AS u,
  sum(pow(pos + neg, 3) - (pos + neg)) AS ties FROM c GROUP BY stratum),
w AS (SELECT stratum, n1, n2, u, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)
SELECT stratum, n1, n2, u, round(z, 5) AS z, round({normal_p_sql('z')}, 5) AS p_value FROM w""")
def mann_whitney_with_p(spark, sf):
    return rounded(stats.mann_whitney(SCORES.frame(spark, sf), "p", by=["stratum"]), 5)


@query(sql=f"""
WITH l AS (SELECT y, unnest(['p', 'q']) AS feature, unnest([p, q]) AS v FROM {SCORES.sql} t WHERE y IS NOT NULL),
{curve_sql('l', score='v', by='feature')}, a AS (SELECT feature, {AUC_SQL} AS auc FROM c GROUP BY feature)
SELECT feature, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS auc_oriented,
  round(avg(v) FILTER (y = 1), 6) AS mean_positive, round(avg(v) FILTER (y = 0), 6) AS mean_negative
FROM a JOIN l USING (feature) GROUP BY feature, auc""")
def oriented_feature_auc(spark, sf):
    return rounded(stats.oriented_auc(SCORES.frame(spark, sf), ["p", "q"]))


# --- sets and top-k ---------------------------------------------------------------

@query(sql=f"SELECT study, round(sum(q), 4) AS total FROM {SCORES.sql} t GROUP BY study ORDER BY sum(q) DESC, study LIMIT 10")
def top_k_features(spark, sf):
    totals = SCORES.frame(spark, sf).groupBy("study").agg(F.sum("q").alias("total"))
    return rounded(relations.top_k(totals, "total", 10, "study"), 4)


@query(sql=f"""
WITH a AS (SELECT id, unnest(['alpha', 'beta', 'gamma']) AS feature, unnest([alpha - 0.4::DOUBLE, beta - 0.5::DOUBLE, gamma - 0.3::DOUBLE]) AS v FROM {MEMBERS.sql} t),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, feature) AS rank FROM a)
SELECT id, feature, round(v, 6) + 0.0::DOUBLE AS v, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""")
def top_k_per_record(spark, sf):
    wide = MEMBERS.frame(spark, sf).selectExpr("id", "alpha - 0.4D AS alpha", "beta - 0.5D AS beta", "gamma - 0.3D AS gamma")
    long = wide.unpivot(["id"], ["alpha", "beta", "gamma"], "feature", "v")
    return rounded(relations.top_k_each(long, "id", F.abs("v"), 2, "feature"))


ADOPT_SQL = f"""
u AS (SELECT id, gamma AS p FROM {MEMBERS.sql} t WHERE y IS NULL),
hi AS (SELECT id, 1 AS y, p FROM u WHERE p >= 0.45::DOUBLE ORDER BY p DESC, id LIMIT 60),
lo AS (SELECT id, 0 AS y, p FROM u WHERE p <= 0.05::DOUBLE ORDER BY p, id LIMIT 140),
ad AS (SELECT * FROM hi UNION ALL SELECT * FROM lo)"""


def adopted(spark, sf):
    pool = MEMBERS.frame(spark, sf).where("y IS NULL").selectExpr("id", "gamma AS p")
    return relations.adopt_confident(pool, 0.3, hi=0.45, lo=0.05), pool


@query(sql=f"WITH {ADOPT_SQL} SELECT id, y, round(p, 6) AS p FROM ad")
def capped_adoption(spark, sf):
    return rounded(adopted(spark, sf)[0].select("id", "y", "p"))


@query(sql=f"""
WITH {ADOPT_SQL}, train AS (SELECT id, y, gamma AS p, 1.0::DOUBLE AS weight FROM {MEMBERS.sql} t WHERE y IS NOT NULL)
SELECT 'train' AS part, count(*) AS n, round(sum(weight), 4) AS weight FROM (SELECT * FROM train UNION ALL SELECT id, y, p, 0.5::DOUBLE FROM ad)
UNION ALL SELECT 'pool', count(*), NULL FROM u WHERE id NOT IN (SELECT id FROM ad)""")
def append_adopted_rows(spark, sf):
    chosen, pool = adopted(spark, sf)
    train = MEMBERS.frame(spark, sf).where("y IS NOT NULL").selectExpr("id", "y", "gamma AS p", "1.0D AS weight")
    grown, left = relations.append_adopted(train, chosen, pool)
    side = lambda df, name, w: df.agg(F.count(F.lit(1)).alias("n"), w.alias("weight")).select(F.lit(name).alias("part"), "n", "weight")
    return rounded(side(grown, "train", F.sum("weight")).unionByName(side(left, "pool", F.lit(None).cast("double"))), 4)


@query(sql=f"""
SELECT CAST(y IS NOT NULL AS INT) AS recorded, count(*) AS n, round(avg(p), 6) AS mean_p FROM {SCORES.sql} t GROUP BY 1""")
def stacked_label_states(spark, sf):
    labelled, unlabelled = tables.split_by_label(SCORES.frame(spark, sf), "y")
    both = relations.stack_states(labelled, unlabelled)
    return rounded(both.groupBy("recorded").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p")))


@query(sql="""
WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O')
SELECT side, count(*) AS n FROM (SELECT 'left' AS side, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', * FROM (FROM b EXCEPT ALL FROM a)) GROUP BY side""")
def frame_differences(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    part = lambda s: df.where(F.col("l_linestatus") == s).select("l_partkey", "l_suppkey")
    return relations.frame_differences(part("F"), part("O")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(sql="SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_discount < 0.02::DOUBLE INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def common_groups(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    return relations.common_keys(df.where("l_linestatus = 'F' AND l_discount < 0.02D"), df.where("l_linestatus = 'O'"), "l_partkey")


@query(sql="SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def distinct_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_returnflag")
    return relations.distinct_rows(df)


@query(sql=f"SELECT id, alpha, beta FROM {MEMBERS.sql} t WHERE y IS NOT NULL")
def forbidden_columns_dropped(spark, sf):
    df = MEMBERS.frame(spark, sf).where("y IS NOT NULL").withColumns(
        {"uinhibitor": F.lit("x"), "Year Reported": F.lit(2000), "gene_name": F.lit("g"), "Inhibitors": F.col("y")})
    clean_df = tables.drop_forbidden(df.drop("gamma", "pos", "grp", "y"), patterns=["gene"])
    assert not tables.forbidden_present(clean_df.columns)
    return clean_df


# --- splits -----------------------------------------------------------------------

HASH = "md5(concat('{seed}:', CAST({key} AS STRING)))"


@query(sql=f"""
WITH r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {HASH.format(seed=42, key='id')}) AS r, count(*) OVER (PARTITION BY y) AS n FROM {MEMBERS.sql} t)
SELECT id, y, r <= ceil(n * 0.2::DOUBLE) AS is_test FROM r""")
def stratified_holdout(spark, sf):
    return splits.stratified_holdout(MEMBERS.frame(spark, sf), "id").select("id", "y", "is_test")


@query(sql=f"""
WITH g AS (SELECT grp, row_number() OVER (ORDER BY {HASH.format(seed=42, key='grp')}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM {MEMBERS.sql} t))
SELECT id, r <= ceil(n * 0.2::DOUBLE) AS is_test FROM {MEMBERS.sql} t JOIN g USING (grp)""")
def group_holdout(spark, sf):
    return splits.group_holdout(MEMBERS.frame(spark, sf), "grp").select("id", "is_test")


@query(sql=f"""
SELECT id, CAST(ntile(5) OVER (PARTITION BY y ORDER BY {HASH.format(seed=42, key='id')}) - 1 AS INT) AS fold FROM {MEMBERS.sql} t""")
def stratified_folds(spark, sf):
    return splits.stratified_folds(MEMBERS.frame(spark, sf), "id").select("id", "fold")


@query(sql=f"""
SELECT id, CAST(rep AS INT) AS repeat, CAST(ntile(5) OVER (PARTITION BY y, rep ORDER BY md5(concat('42:', CAST(rep AS STRING), ':', CAST(id AS STRING)))) - 1 AS INT) AS fold
FROM {MEMBERS.sql} t, (SELECT unnest([1, 2, 3]) AS rep)""")
def repeated_stratified_folds(spark, sf):
    return splits.stratified_folds(MEMBERS.frame(spark, sf), "id", repeats=3).select("id", "repeat", "fold")


@query(sql=f"""
WITH g AS (SELECT grp, floor(log2(count(*) FILTER (y = 1) + 1)) AS a, floor(log2(count(*) FILTER (y = 0) + 1)) AS b FROM {MEMBERS.sql} t GROUP BY grp),
f AS (SELECT grp, CAST(ntile(5) OVER (PARTITION BY a, b ORDER BY {HASH.format(seed=42, key='grp')}) - 1 AS INT) AS fold FROM g)
SELECT id, fold FROM {MEMBERS.sql} t JOIN f USING (grp)""")
def stratified_group_folds(spark, sf):
    return splits.group_folds(MEMBERS.frame(spark, sf), "grp").select("id", "fold")


@query(sql=f"SELECT count(*) AS n_rows, count(DISTINCT grp) AS n_groups, 5 AS n_folds, 0 AS n_straddling, true AS even FROM {MEMBERS.sql} t")
def balanced_group_folds(spark, sf):
    """Rows, groups, folds, groups in two folds, and whether folds differ by less than the largest group in each class."""
    df = splits.balanced_group_folds(MEMBERS.frame(spark, sf), "grp")
    of_group = df.groupBy("grp").agg(
        F.count_distinct("fold").alias("folds"), F.min("fold").alias("fold"), F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("y") == c).alias(f"n{c}") for c in (0, 1)])
    of_fold = of_group.groupBy("fold").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("folds") > 1).alias("straddling"),
        *[e for c in (0, 1) for e in (F.sum(f"n{c}").alias(f"n{c}"), F.max(f"n{c}").alias(f"most{c}"))])
    even = [F.max(f"n{c}") - F.min(f"n{c}") <= F.max(f"most{c}") for c in (0, 1)]
    return of_fold.agg(
        F.sum("n").alias("n_rows"), F.sum("groups").alias("n_groups"), F.count(F.lit(1)).alias("n_folds"),
        F.sum("straddling").alias("n_straddling"), (even[0] & even[1]).alias("even"))


BLOCK_SQL = f"""
f AS (SELECT id, coalesce(CAST(pos AS DOUBLE), (SELECT quantile_cont(pos, 0.5) FROM {MEMBERS.sql} t)) AS pos FROM {MEMBERS.sql} t),
b AS (SELECT id, ntile({{n}}) OVER (ORDER BY pos, {HASH.format(seed=42, key='id')}) - 1 AS block FROM f)"""


@query(sql=f"WITH {BLOCK_SQL.format(n=10)} SELECT id, CAST(block AS INT) AS block, CAST(block % 5 AS INT) AS fold FROM b")
def region_blocks_and_folds(spark, sf):
    blocks = splits.position_blocks(MEMBERS.frame(spark, sf), "pos", "id")
    return splits.block_folds(blocks).select("id", "block", "fold")


@query(sql=f"WITH {BLOCK_SQL.format(n=5)} SELECT id, block = 4 AS is_test FROM b")
def region_holdout(spark, sf):
    return splits.region_holdout(MEMBERS.frame(spark, sf), "pos", "id").select("id", "is_test")


@query(sql=f"""
WITH a AS (SELECT id, row_number() OVER (ORDER BY {HASH.format(seed=42, key='id')}) AS r FROM {MEMBERS.sql} t),
b AS (SELECT y, row_number() OVER (ORDER BY {HASH.format(seed=43, key='id')}) AS r FROM {MEMBERS.sql} t)
SELECT id, y FROM a JOIN b USING (r)""")
def permuted_labels(spark, sf):
    return splits.permute(MEMBERS.frame(spark, sf).select("id", "y"), ["y"], "id")


@query(sql=f"""
WITH k AS (SELECT id, y FROM {MEMBERS.sql} t WHERE y IS NOT NULL), n AS (SELECT y, count(*) AS n FROM k GROUP BY y),
p AS (SELECT min(n) AS lo, max(n) AS hi, arg_min(y, n) AS minor FROM n),
m AS (SELECT id, y, row_number() OVER (ORDER BY {HASH.format(seed=42, key='id')}) AS r FROM k, p WHERE y = minor),
e AS (SELECT id, y, unnest(range(1, CAST(hi // lo + CASE WHEN r <= hi % lo THEN 1 ELSE 0 END + 1 AS BIGINT))) AS copy FROM m, p)
SELECT id, y, CAST(copy AS INT) AS copy FROM e UNION ALL SELECT id, y, 1 FROM k, p WHERE y <> minor""")
def oversampled_rows(spark, sf):
    return splits.oversample_minority(MEMBERS.frame(spark, sf).select("id", "y"), "id")


@query(sql=f"SELECT id, y FROM {MEMBERS.sql} t ORDER BY {HASH.format(seed=42, key='id')} LIMIT 200")
def background_sample(spark, sf):
    return splits.background_sample(MEMBERS.frame(spark, sf), "id").select("id", "y")
