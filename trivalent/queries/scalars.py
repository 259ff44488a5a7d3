"""Labels, vocabularies, numbers, notation and intervals on whole tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions import encode as enc
from ..functions import fixed_values as fv
from ..functions import intervals, notation, text
from ..operators import aggregates, spans
from .bindings import CATALOGUE, MEMBERS, RECORDS, SCORES, VARIANTS
from .registry import query
from .shared import rounded

NULLS = "(" + ", ".join(f"'{t}'" for t in fv.NULL_TOKENS) + ")"


def clean(c: str) -> str:
    return f"(CASE WHEN lower(trim({c})) NOT IN {NULLS} THEN trim({c}) END)"


def key(c: str) -> str:
    t = f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    return f"(CASE WHEN {t} NOT IN ('', 'nan', 'none', 'n/a') THEN {t} ELSE 'unknown' END)"


def sql_map(expr: str, table: dict, default: str) -> str:
    arms = " ".join("WHEN '{}' THEN '{}'".format(k.replace("'", "''"), v) for k, v in table.items())
    return f"(CASE {expr} {arms} ELSE '{default}' END)"


@query(sql=f"""
SELECT id, CAST(CASE WHEN lower(trim(t)) IN ('yes', 'y') THEN 1 WHEN lower(trim(t)) IN ('no', 'n') THEN 0 END AS INT) AS label,
  {key('t')} AS label_key FROM (SELECT id, "History of Inhibitor" AS t FROM {CATALOGUE.sql} s)""")
def catalogue_labels(spark, sf):
    df = CATALOGUE.frame(spark, sf)
    return df.select("id", text.catalogue_label("`History of Inhibitor`").alias("label"),
                     text.text_key("`History of Inhibitor`").alias("label_key"))


REGISTRY_LABEL = f"""CASE WHEN lower({clean('Inhibitors')}) IN ('yes', 'y', 'positive') THEN 1
  WHEN lower({clean('Inhibitors')}) IN ('no', 'n', 'negative') THEN 0 END"""


@query(sql=f"""
SELECT coalesce({clean('Inhibitors')}, '(none)') AS token, CAST({REGISTRY_LABEL} AS INT) AS label, count(*) AS n
FROM {RECORDS.sql} s GROUP BY ALL""")
def registry_labels(spark, sf):
    df = RECORDS.frame(spark, sf)
    return df.groupBy(
        F.coalesce(text.clean_token("Inhibitors"), F.lit("(none)")).alias("token"),
        text.registry_label("Inhibitors").alias("label")).agg(F.count(F.lit(1)).alias("n"))


SEV = key("t")
@query(sql=f"""
SELECT id, {sql_map(key('vt'), fv.VARIANT_TYPES, 'other')} AS vtype, {sql_map(key('mech'), fv.MECHANISMS, 'other')} AS mech,
  CASE WHEN {key('ch')} LIKE '%heavy%' THEN 'heavy' WHEN {key('ch')} LIKE '%light%' THEN 'light'
       WHEN {key('ch')} LIKE '%single%' THEN 'single_domain' ELSE 'unknown' END AS chain FROM
  (SELECT id, "Variant Type" AS vt, "Mechanism" AS mech, "Subtype" AS ch FROM {CATALOGUE.sql} s)""")
def catalogue_vocabularies(spark, sf):
    df = CATALOGUE.frame(spark, sf)
    return df.select("id", text.variant_type("`Variant Type`").alias("vtype"), text.mechanism("Mechanism").alias("mech"),
                     text.chain("Subtype").alias("chain"))


@query(sql=f"""
WITH t AS (SELECT id, {key('"Reported Clinical Severity"')} AS k FROM {CATALOGUE.sql} s),
f AS (SELECT *, k LIKE '%severe%' AS a, k LIKE '%moderate%' AS b, k LIKE '%mild%' AS c FROM t),
l AS (SELECT id, CASE WHEN k LIKE '%not reported%' OR k = 'unknown' THEN 'unknown'
  WHEN CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) <> 1 THEN 'mixed' WHEN a THEN 'severe' WHEN b THEN 'moderate'
  ELSE 'mild' END AS level FROM f)
SELECT id, level, CASE level WHEN 'mild' THEN 0.0::DOUBLE WHEN 'mixed' THEN 1.0 WHEN 'moderate' THEN 1.0 WHEN 'severe' THEN 2.0 END AS rank FROM l""")
def catalogue_severity(spark, sf):
    level = text.catalogue_severity("`Reported Clinical Severity`")
    df = CATALOGUE.frame(spark, sf).select("id", level.alias("level"))
    return df.withColumn("rank", text.catalogue_severity_rank(F.col("level")))


REGISTRY_SEVERITY = """CASE WHEN k IS NULL OR k IN ('unclassified', 'notreported', 'notaffected') THEN 'Unknown'
  WHEN k IN ('non-severe', 'nonsevere') THEN 'Moderate' WHEN regexp_matches(k, 'sev|svere') THEN 'Severe'
  WHEN regexp_matches(k, 'mod|mpderate') THEN 'Moderate' WHEN k LIKE '%mild%' THEN 'Mild' ELSE 'Unknown' END"""


@query(sql=f"""
SELECT cli_phe, {REGISTRY_SEVERITY} AS severity, count(*) AS n FROM (
  SELECT cli_phe, replace(lower({clean('cli_phe')}), ' ', '') AS k FROM {RECORDS.sql} s) GROUP BY ALL""")
def registry_severity(spark, sf):
    df = RECORDS.frame(spark, sf)
    return df.groupBy("cli_phe", text.registry_severity("cli_phe").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


READING = "trim(split_part(replace(replace({0}, '%', ''), ',', '.'), '|', 1))"
ACTIVITY = r"""CASE WHEN regexp_matches(a, '^([<>])=?\s*([0-9.]+)\??$')
    THEN TRY_CAST(regexp_extract(a, '^([<>])=?\s*([0-9.]+)\??$', 2) AS DOUBLE) * CASE WHEN a LIKE '<%' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
  WHEN regexp_matches(a, '^([0-9.]+)\s*(to|-|and)\s*([0-9.]+)\??$')
    THEN (TRY_CAST(regexp_extract(a, '^([0-9.]+)\s*(to|-|and)\s*([0-9.]+)\??$', 1) AS DOUBLE)
        + TRY_CAST(regexp_extract(a, '^([0-9.]+)\s*(to|-|and)\s*([0-9.]+)\??$', 3) AS DOUBLE)) / 2
  ELSE TRY_CAST(nullif(regexp_extract(a, '^([0-9.]+)', 1), '') AS DOUBLE) END"""


@query(sql=f"""
SELECT clotting, antigen, {ACTIVITY.replace('a,', 'c,').replace('a LIKE', 'c LIKE')} AS activity,
  {ACTIVITY.replace('a,', 'g,').replace('a LIKE', 'g LIKE')} AS antigen_level, count(*) AS n FROM (
  SELECT clotting, antigen, {READING.format(clean('clotting'))} AS c, {READING.format(clean('antigen'))} AS g FROM {RECORDS.sql} s)
GROUP BY ALL""")
def censored_readings(spark, sf):
    df = RECORDS.frame(spark, sf)
    return df.groupBy("clotting", "antigen", text.censored_number("clotting").alias("activity"),
                      text.censored_number("antigen").alias("antigen_level")).agg(F.count(F.lit(1)).alias("n"))


EFFECT_SQL = """CASE WHEN {0} IS NULL THEN 'Unknown' WHEN {0} LIKE '%large%' AND {0} LIKE '%del%' THEN 'LargeDeletion'
  WHEN {0} LIKE '%large%' AND ({0} LIKE '%dup%' OR {0} LIKE '%ins%') THEN 'LargeDuplication' WHEN {0} LIKE '%nonsense%' THEN 'Nonsense'
  WHEN {0} LIKE '%frameshift%' THEN 'Frameshift' WHEN {0} LIKE '%missense%' THEN 'Missense' WHEN {0} LIKE '%splice%' THEN 'Splice'
  WHEN {0} LIKE '%silent%' OR {0} LIKE '%synonym%' THEN 'Silent' WHEN {0} LIKE '%in-frame%' OR {0} LIKE '%inframe%' THEN 'InFrame'
  ELSE 'Other' END"""
DOMAIN_SQL = "CASE WHEN {0} IS NULL THEN 'Unknown' " + " ".join(
    f"WHEN {{0}} = '{k}' THEN '{v}'" for k, v in fv.DOMAIN_SYNONYMS.items()
) + " WHEN upper({0}) IN ('A1', 'A2', 'A3', 'B', 'C1', 'C2') THEN upper({0}) ELSE 'Unknown' END"
AA_CODES = {row[1].lower(): row[0] for row in fv.RESIDUES} | {k.lower(): v for k, v in fv.OTHER_RESIDUE_CODES.items()}
AA_SQL = "CASE WHEN length({0}) = 1 THEN upper({0}) ELSE CASE lower({0}) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in AA_CODES.items()) + " END END"


@query(sql=f"""
SELECT mut_id, {EFFECT_SQL.format('e')} AS effect, {DOMAIN_SQL.format('d')} AS domain, {AA_SQL.format('a')} AS ref_aa,
  {AA_SQL.format('b')} AS alt_aa FROM (SELECT mut_id, lower({clean('mut_effect')}) AS e, lower({clean('d_id')}) AS d,
  {clean('aa_first')} AS a, {clean('aa_last')} AS b FROM {VARIANTS.sql} s)""")
def registry_vocabularies(spark, sf):
    return VARIANTS.frame(spark, sf).select(
        "mut_id", text.registry_effect("mut_effect").alias("effect"), text.domain_level("d_id").alias("domain"),
        text.residue_letter("aa_first").alias("ref_aa"), text.residue_letter("aa_last").alias("alt_aa"))


CATALOGUE_EFFECT_SQL = """CASE WHEN {0} IS NULL THEN 'Unknown' WHEN {0} LIKE '%large structural%' THEN 'LargeDeletion'
  WHEN {0} LIKE '%small structural%' OR {0} LIKE '%in-frame%' THEN 'InFrame' WHEN {0} LIKE '%splice%' THEN 'Splice'
  WHEN {0} LIKE '%synonymous%' THEN 'Silent' WHEN {0} LIKE '%missense%' THEN 'Missense' WHEN {0} LIKE '%nonsense%' THEN 'Nonsense'
  WHEN {0} LIKE '%frameshift%' THEN 'Frameshift' ELSE 'Other' END"""


@query(sql=f"""
SELECT id, e AS effect, CASE WHEN e = 'LargeDeletion' AND regexp_matches(m, 'duplication|insertion') THEN 'LargeDuplication' ELSE e END AS resolved
FROM (SELECT id, {CATALOGUE_EFFECT_SQL.format('t')} AS e, m FROM (
  SELECT id, lower({clean('"Variant Type"')}) AS t, lower({clean('"Mechanism"')}) AS m FROM {CATALOGUE.sql} s))""")
def cross_registry_effects(spark, sf):
    df = CATALOGUE.frame(spark, sf)
    vt = F.col("`Variant Type`")
    return df.select("id", text.catalogue_effect(vt).alias("effect"),
                     text.catalogue_effect(vt, F.col("Mechanism")).alias("resolved"))


REGION_SQL = "CASE WHEN {0} IS NULL THEN 'Unknown' " + " ".join(
    f"WHEN {{0}} IN ({', '.join(repr(m) for m in members)}) THEN '{name}'" for name, members in fv.REGIONS.items()
) + " ELSE 'europe_other' END"


@query(sql=f"""
SELECT pa_race, {REGION_SQL.format('r')} AS region, CASE WHEN upper({clean('"type"')}) IN ('I', 'II', 'NU') THEN upper({clean('"type"')}) ELSE 'Unknown' END AS crm,
  count(*) AS n FROM (SELECT pa_race, lower({clean('pa_race')}) AS r, "type" FROM {RECORDS.sql} s) GROUP BY ALL""")
def region_and_crm(spark, sf):
    df = text.with_region(RECORDS.frame(spark, sf), "pa_race")
    return df.groupBy("pa_race", "region", text.crm_type("type").alias("crm")).agg(F.count(F.lit(1)).alias("n"))


@query(sql=f"""
SELECT id, CASE WHEN k NOT IN ('unknown', 'promoter') THEN TRY_CAST(regexp_extract(k, '([0-9]+)', 1) AS DOUBLE) END AS first_exon,
  TRY_CAST(regexp_extract(k, '([0-9]+)[^0-9]*$', 1) AS DOUBLE) AS last_exon,
  TRY_CAST(regexp_extract({clean('t')}, '^([0-9]+)', 1) AS DOUBLE) AS leading
FROM (SELECT id, "Exon" AS t, {key('"Exon"')} AS k FROM {CATALOGUE.sql} s)""")
def exon_numbers(spark, sf):
    return CATALOGUE.frame(spark, sf).select(
        "id", text.first_integer("Exon").alias("first_exon"), text.last_integer("Exon").alias("last_exon"),
        text.leading_integer("Exon").alias("leading"))


CDNA_SQL = r"""
b AS (SELECT id, regexp_replace(CASE WHEN lower(trim(t)) NOT IN ('', 'nan', 'none', '?') THEN trim(t) END, '^[cC][.]', '') AS body
      FROM (SELECT id, "HGVS cDNA" AS t FROM {src} s)),
h AS (SELECT *, lower(body) AS low, nullif(regexp_replace(body, '(del|dup|ins|inv).*$', ''), '') AS head FROM b),
a AS (SELECT *, regexp_extract_all(coalesce(head, body), '(-|\*)?([0-9]+)([+-]([0-9]+|\?))?') AS an FROM h),
c AS (SELECT *, an[1] AS f, an[len(an)] AS l,
  list_filter([regexp_extract(x, '^[-*]?[0-9]+([+-]([0-9]+|\?))?', 1) FOR x IN an], lambda x: x <> '') AS offs FROM a),
d AS (SELECT *, [CAST(o AS DOUBLE) FOR o IN offs IF o NOT LIKE '%?'] AS known,
  TRY_CAST(regexp_extract(f, '^[-*]?([0-9]+)', 1) AS DOUBLE) * CASE WHEN f LIKE '-%' THEN -1 ELSE 1 END + CASE WHEN f LIKE '*%' THEN 7053 ELSE 0 END AS p1,
  TRY_CAST(regexp_extract(l, '^[-*]?([0-9]+)', 1) AS DOUBLE) * CASE WHEN l LIKE '-%' THEN -1 ELSE 1 END + CASE WHEN l LIKE '*%' THEN 7053 ELSE 0 END AS p2 FROM c)
"""


@query(sql="WITH " + CDNA_SQL.replace("{src}", CATALOGUE.sql) + r"""
SELECT id, p1 AS cdna_pos, p2 AS cdna_pos_end, abs(p2 - p1) + 1 AS span_nt,
  CASE WHEN len(known) > 0 THEN list_reduce(known, lambda m, x: CASE WHEN abs(x) < abs(m) THEN x ELSE m END) END AS intron_offset,
  CAST(coalesce(len(offs) > 0, false) AS INT) AS is_intronic, CAST(coalesce(p1 < 0, false) AS INT) AS is_utr5,
  CAST(coalesce(p1 > 7053, false) AS INT) AS is_utr3, CAST(coalesce(p1 < -100, false) AS INT) AS is_promoter,
  CAST(coalesce(body LIKE '%?%' OR (len(offs) > 0 AND len(known) = 0), false) AS INT) AS unknown_breakpoint,
  nullif(regexp_extract(body, '([ACGT]+)>([ACGT]+)\s*$', 1), '') AS ref_nt, nullif(regexp_extract(body, '([ACGT]+)>([ACGT]+)\s*$', 2), '') AS alt_nt,
  CAST(coalesce(low LIKE '%del%' AND low NOT LIKE '%delins%', false) AS INT) AS op_del, CAST(coalesce(low LIKE '%dup%', false) AS INT) AS op_dup,
  CAST(coalesce(low LIKE '%ins%' AND low NOT LIKE '%delins%', false) AS INT) AS op_ins, CAST(coalesce(low LIKE '%delins%', false) AS INT) AS op_delins,
  CAST(coalesce(regexp_matches(body, '([ACGT]+)>([ACGT]+)\s*$'), false) AS INT) AS op_sub FROM d""")
def cdna_notation(spark, sf):
    parsed = notation.with_cdna(CATALOGUE.frame(spark, sf), "`HGVS cDNA`")
    return parsed.select("id", "cdna.*").drop("ref_len", "alt_len", "op_inv")


RES_SQL = "CASE {0} " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ({row[1]: row[0] for row in fv.RESIDUES} | fv.OTHER_RESIDUE_CODES
                                          | {m: m for m in ("*", "=", "del", "dup")}).items()) + " END"
PROTEIN_SQL = r"""
s0 AS (SELECT id, CASE WHEN lower(trim(pt)) NOT IN ('', 'nan', 'none') THEN trim(pt) END AS p,
       CASE WHEN lower(trim(mt)) NOT IN ('', 'nan', 'none') THEN trim(mt) END AS m
       FROM (SELECT id, "HGVS Protein" AS pt, "Mature Protein" AS mt FROM {src} s)),
s1 AS (SELECT *, coalesce(p, m) AS t, coalesce(p, m) IN ('p.(=)', '=', 'p.=') AS same, lower(coalesce(p, m)) AS low FROM s0),
s2 AS (SELECT *, regexp_matches(t, '([A-Z][a-z]{2})(-?[0-9]+)([A-Z][a-z]{2})?fs') AS fs,
       CASE WHEN same THEN '' WHEN regexp_matches(t, '([A-Z][a-z]{2})(-?[0-9]+)([A-Z][a-z]{2})?fs') THEN '([A-Z][a-z]{2})(-?[0-9]+)([A-Z][a-z]{2})?fs'
         ELSE '' END AS rule FROM s1),
s3 AS (SELECT *, CASE WHEN same THEN NULL WHEN fs THEN [regexp_extract(t, '([A-Z][a-z]{2})(-?[0-9]+)([A-Z][a-z]{2})?fs', i) FOR i IN [1, 2, 3]] END AS u FROM (
  SELECT * FROM s2))
"""
FSR = r"([A-Z][a-z]{2})(-?[0-9]+)([A-Z][a-z]{2})?fs\*?([0-9]+|\?)?"
PLR = r"p\.?\(?([A-Z][a-z]{2})(-?[0-9]+)([A-Z][a-z]{2}|\*|=|del|dup)?"
MTR = r"^([A-Z][a-z]{2})(-?[0-9]+)([A-Z][a-z]{2}|\*|=|del|dup)?"


def _part(i: int) -> str:
    return (f"CASE WHEN same THEN NULL WHEN regexp_matches(t, '{FSR}') THEN regexp_extract(t, '{FSR}', {i})"
            f" WHEN regexp_matches(t, '{PLR}') THEN regexp_extract(t, '{PLR}', {i}) ELSE regexp_extract(t, '{MTR}', {i}) END")


PROTEIN_SQL = PROTEIN_SQL[:PROTEIN_SQL.index("s2 AS")] + f"""
s2 AS (SELECT *, regexp_matches(t, '{FSR}') AND NOT same AS fs, {RES_SQL.format('(' + _part(1) + ')')} AS ref,
  {RES_SQL.format('(' + _part(3) + ')')} AS alt, TRY_CAST(nullif({_part(2)}, '') AS DOUBLE) AS pos,
  CASE WHEN regexp_matches(t, '{FSR}') AND NOT same THEN TRY_CAST(nullif(regexp_extract(t, '{FSR}', 4), '') AS DOUBLE) END AS off FROM s1),
s3 AS (SELECT *, CASE WHEN p IS NULL THEN pos WHEN pos > 19 THEN pos - 19 ELSE pos - 20 END AS mature,
  CASE WHEN p IS NOT NULL THEN pos WHEN pos > 0 THEN pos + 19 ELSE pos + 20 END AS prec FROM s2)"""


@query(sql="WITH " + PROTEIN_SQL.replace("{src}", CATALOGUE.sql) + """
SELECT id, prec AS prot_pos, mature AS mature_pos, ref AS ref_aa, CASE WHEN NOT fs AND alt = '=' THEN ref ELSE alt END AS alt_aa,
  CAST(coalesce(fs, false) AS INT) AS is_frameshift, CAST(coalesce(NOT fs AND alt = '*', false) AS INT) AS is_nonsense,
  CAST(coalesce(same OR (NOT fs AND alt = '='), false) AS INT) AS is_synonymous,
  CAST(coalesce(NOT same AND low LIKE '%del%' AND low NOT LIKE '%delins%' AND low NOT LIKE '%fs%', false) AS INT) AS is_inframe_del,
  CAST(coalesce(NOT same AND low LIKE '%dup%' AND low NOT LIKE '%fs%', false) AS INT) AS is_inframe_dup,
  CAST(coalesce(NOT same AND low LIKE '%delins%', false) AS INT) AS is_delins, off AS fs_ter_offset,
  CASE WHEN off IS NOT NULL THEN mature + off - 1 WHEN NOT fs AND alt = '*' THEN mature END AS ptc_mature_pos FROM s3""")
def protein_notation(spark, sf):
    parsed = notation.with_protein(CATALOGUE.frame(spark, sf), "`HGVS Protein`", "`Mature Protein`")
    return parsed.select("id", "prot.*")


@query(sql="WITH " + CDNA_SQL.replace("{src}", CATALOGUE.sql) + ", " + PROTEIN_SQL.replace("{src}", CATALOGUE.sql) + """
SELECT d.id, p1 AS cdna_pos, abs(p2 - p1) + 1 AS span_nt, mature AS mature_pos, ref AS ref_aa FROM d JOIN s3 USING (id)""")
def flattened_parse(spark, sf):
    flat = notation.parse_table(CATALOGUE.frame(spark, sf), "HGVS cDNA", "HGVS Protein", "Mature Protein", ["id"])
    return flat.select("id", "cdna_pos", "span_nt", "mature_pos", "ref_aa")


@query(sql="""
SELECT o_orderkey AS id, CASE WHEN k > 19 THEN k - 19 ELSE k - 20 END AS mature,
  CASE WHEN CASE WHEN k > 19 THEN k - 19 ELSE k - 20 END > 0 THEN CASE WHEN k > 19 THEN k - 19 ELSE k - 20 END + 19
       ELSE CASE WHEN k > 19 THEN k - 19 ELSE k - 20 END + 20 END AS back
FROM (SELECT o_orderkey, CAST(o_orderkey % 90 AS DOUBLE) AS k FROM orders)""")
def numbering_round_trip(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 90).cast("double").alias("k"))
    staged = df.withColumn("mature", notation.to_mature(F.col("k")))
    return staged.select("id", "mature", notation.to_precursor(F.col("mature")).alias("back"))


SPAN_SQL = "CASE WHEN {0} < 1 THEN 'Signal' " + " ".join(
    f"WHEN {{0}} BETWEEN {lo} AND {hi} THEN '{name}'" for name, lo, hi in fv.DOMAIN_SPANS) + " ELSE 'Unknown' END"
EPI_SQL = "least(" + ", ".join(f"greatest({lo} - {{0}}, {{0}} - {hi}, 0)" for _, lo, hi in fv.EPITOPE_SPANS) + ")"
POSITION = "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey % 2400 - 20 AS DOUBLE) END"


@query(sql=f"""
SELECT id, {SPAN_SQL.format('m')} AS domain, CASE WHEN m IS NOT NULL THEN CAST({EPI_SQL.format('m')} AS DOUBLE) END AS epitope_distance,
  CAST(coalesce(m BETWEEN 484 AND 508, false) AS DOUBLE) AS in_a2_epitope,
  CAST(coalesce({' OR '.join(f'm BETWEEN {lo} AND {hi}' for _, lo, hi in fv.EPITOPE_SPANS)}, false) AS DOUBLE) AS in_any_epitope
FROM (SELECT o_orderkey AS id, {POSITION} AS m FROM orders)""")
def interval_lookups(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS id", f"{POSITION} AS m")
    return df.select(
        "id", intervals.span_name("m").alias("domain"), intervals.nearest_span_distance("m").alias("epitope_distance"),
        intervals.in_span("m", 484, 508).alias("in_a2_epitope"),
        intervals.in_any_span("m", fv.EPITOPE_SPANS).alias("in_any_epitope"))


@query(sql="""
WITH spans AS (SELECT p_partkey AS span_id, p_retailprice AS lo, p_retailprice + p_size / 100e0 AS hi FROM part)
SELECT o_orderkey AS id, span_id FROM orders LEFT JOIN spans ON o_totalprice / 500 BETWEEN lo AND hi""")
def interval_range_join(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS id", "o_totalprice / 500 AS pos")
    spans = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey AS span_id", "p_retailprice AS lo", "p_retailprice + p_size / 100e0 AS hi")
    return intervals.range_join(rows, "pos", spans, 25.0).select("id", "span_id")


#: Spans by order: many short ones, and a few that hold nearly everything.
SPANS_OF = ("o_orderkey AS span_id, CAST(o_totalprice AS DOUBLE) / 8 AS lo,"
            " CAST(o_totalprice AS DOUBLE) / 8 + CASE WHEN o_orderkey % 970 = 0 THEN 90000e0 ELSE o_custkey % 50 END AS hi")


@query(sql=f"""
WITH spans AS (SELECT {SPANS_OF} FROM orders WHERE o_orderkey % 97 = 0),
r AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_extendedprice AS DOUBLE) AS pos FROM lineitem WHERE l_linenumber < 4)
SELECT k, n, span_id FROM r LEFT JOIN spans ON pos BETWEEN lo AND hi""")
def interval_tree_join(spark, sf):
    """Items of orders with every span over their price, whatever the spans' lengths."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber < 4").selectExpr(
        "l_orderkey AS k", "l_linenumber AS n", "CAST(l_extendedprice AS DOUBLE) AS pos")
    spans_of = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 97 = 0").selectExpr(*[c.strip() for c in re.split(r",(?![^(]*\))", SPANS_OF)])
    return spans.span_join(rows, "pos", spans_of).select("k", "n", "span_id")


@query(sql=f"""
WITH spans AS (SELECT o_orderstatus AS status, {SPANS_OF} FROM orders WHERE o_orderkey % 97 = 0),
r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linestatus AS status, CASE WHEN l_orderkey % 31 <> 0 THEN CAST(l_extendedprice AS DOUBLE) END AS pos FROM lineitem),
d AS (SELECT DISTINCT status, pos FROM r WHERE pos IS NOT NULL),
g AS (SELECT d.status, pos, min(greatest(lo - pos, pos - hi, 0)) AS distance FROM d JOIN spans s ON s.status = d.status GROUP BY ALL)
SELECT k, n, round(distance, 6) AS distance FROM r LEFT JOIN g ON r.status = g.status AND r.pos = g.pos""")
def nearest_interval(spark, sf):
    """Distance of every item's price to the nearest span of its status, from a table of spans."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey AS k", "l_linenumber AS n", "l_linestatus AS status", "CASE WHEN l_orderkey % 31 <> 0 THEN CAST(l_extendedprice AS DOUBLE) END AS pos")
    spans_of = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 97 = 0").selectExpr(
        "o_orderstatus AS status", *[c.strip() for c in re.split(r",(?![^(]*\))", SPANS_OF)])
    return rounded(spans.nearest_span(rows, "pos", spans_of, by=["status"]).select("k", "n", "distance"))


PAIR_VALUES = ", ".join(f"('{r}', '{a}', {s})" for (r, a), s in chem.substitution_scores().items())
RES_VALUES = ", ".join("('{}', '{}', {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE)".format(*row) for row in fv.RESIDUES)


@query(sql=f"""
WITH v AS (SELECT mut_id, {AA_SQL.format('a')} AS ref, {AA_SQL.format('b')} AS alt FROM (
  SELECT mut_id, {clean('aa_first')} AS a, {clean('aa_last')} AS b FROM {VARIANTS.sql} s)),
m AS (SELECT * FROM (VALUES {PAIR_VALUES}) t(ref, alt, score)),
r AS (SELECT * FROM (VALUES {RES_VALUES}) t(aa, three, hyd, vol, chg, pol, comp))
SELECT mut_id, CAST(score AS DOUBLE) AS blosum62, round(50.723::DOUBLE * sqrt(1.833::DOUBLE * pow(x.comp - y.comp, 2)
  + 0.1018::DOUBLE * pow(x.pol - y.pol, 2) + 0.000399::DOUBLE * pow(x.vol - y.vol, 2)), 6) AS grantham,
  round(y.hyd - x.hyd, 6) + 0.0::DOUBLE AS delta_hydropathy, y.chg - x.chg AS delta_charge,
  CAST(coalesce(x.chg * y.chg < 0, false) AS DOUBLE) AS charge_flip,
  CAST(coalesce((x.aa IN ('F', 'W', 'Y')) <> (y.aa IN ('F', 'W', 'Y')), false) AS DOUBLE) AS aromatic_change
FROM v LEFT JOIN m ON v.ref = m.ref AND v.alt = m.alt LEFT JOIN r x ON m.ref = x.aa LEFT JOIN r y ON m.alt = y.aa""")
def pair_chemistry(spark, sf):
    df = VARIANTS.frame(spark, sf).select(
        "mut_id", text.residue_letter("aa_first").alias("r"), text.residue_letter("aa_last").alias("a"))
    out = chem.with_pair(df, "r", "a").select(
        "mut_id", "pair.blosum62", "pair.grantham", chem.delta("hydropathy").alias("delta_hydropathy"),
        chem.delta("charge").alias("delta_charge"), chem.charge_flip().alias("charge_flip"),
        chem.aromatic_change().alias("aromatic_change"))
    return rounded(out)


@query(sql="""
SELECT o_orderkey AS id, round(round_even((o_custkey - 3) / 2.5::DOUBLE, 0) * 2.5::DOUBLE + 3, 6) AS snapped,
  round(1.0 - least(greatest(CAST(o_custkey AS DOUBLE), 0), 2332) / 2332, 6) AS lost, round(ln(1 + o_custkey), 6) AS log_span
FROM orders""")
def grid_and_share(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").withColumn("v", F.col("o_custkey").cast("double"))
    return rounded(df.select(
        F.col("o_orderkey").alias("id"), enc.snap("v", 3.0, 103.0, 40).alias("snapped"),
        enc.share_lost("v").alias("lost"), enc.log1p_nonneg("v").alias("log_span")))


BAND_SQL = "CASE WHEN p IS NULL THEN NULL WHEN p >= 0 AND p < 0.1::DOUBLE THEN 'Low' WHEN p >= 0.1::DOUBLE AND p < 0.25::DOUBLE THEN 'Moderate'" \
    " WHEN p >= 0.25::DOUBLE AND p < 0.4::DOUBLE THEN 'High' ELSE 'Very high' END"


@query(sql=f"SELECT {BAND_SQL} AS band, p >= 0.35::DOUBLE AS called, count(*) AS n FROM {SCORES.sql} s GROUP BY ALL")
def risk_bands_and_calls(spark, sf):
    df = SCORES.frame(spark, sf)
    cut = enc.threshold_value({"youden": 0.35}, "youden")
    return df.groupBy(enc.risk_band("p").alias("band"), enc.call_at("p", cut).alias("called")).agg(F.count(F.lit(1)).alias("n"))


@query(sql="""
SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS clean,
  CAST(o_orderkey AS DOUBLE) AS kept, CAST(0 AS DOUBLE) AS absent FROM orders""")
def finite_and_aligned(spark, sf):
    raw = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("double").alias("kept"),
        F.when(F.col("o_custkey") % 10 == 0, float("inf")).when(F.col("o_custkey") % 5 == 0, float("nan"))
        .otherwise(F.col("o_custkey").cast("double")).alias("clean"))
    return enc.align(enc.finite_or_null(raw), ["clean", "kept", "absent"], ["id"], fill=0.0)


@query(sql=f"""
SELECT "Domain" AS domain_text, round(ln(1 + n), 6) AS load, n FROM (
  SELECT "Domain", count(*) OVER (PARTITION BY {key('"Domain"')}) AS n FROM {CATALOGUE.sql} s)""")
def category_load(spark, sf):
    df = CATALOGUE.frame(spark, sf).select(F.col("Domain").alias("domain_text"))
    loads = aggregates.category_load(df, text.text_key("domain_text"))
    out = aggregates.with_category_load(df, loads, text.text_key("domain_text"))
    return rounded(out.withColumn("n", F.round(F.expm1("load")).cast("long")))


@query(sql=f"""
SELECT grp, round(quantile_cont(pos, 0.05), 6) AS "start", round(quantile_cont(pos, 0.95), 6) AS "end", count(pos) AS n_obs,
  round(greatest(quantile_cont(pos, 0.95) - quantile_cont(pos, 0.05) + 1, 1), 6) AS length
FROM (SELECT grp % 26 AS grp, CAST(pos AS DOUBLE) AS pos FROM {MEMBERS.sql} s) WHERE pos IS NOT NULL GROUP BY grp""")
def group_extent(spark, sf):
    df = MEMBERS.frame(spark, sf).withColumn("grp", F.col("grp") % 26)
    return rounded(aggregates.group_extent(df, "grp", "pos"))
