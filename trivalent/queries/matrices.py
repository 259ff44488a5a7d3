"""Row-level feature matrices next to their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text
from ..plans import features
from .bindings import CATALOGUE, RECORDS, VARIANTS
from .cohorts import records
from .registry import query
from .scalars import (AA_SQL, ACTIVITY, CATALOGUE_EFFECT_SQL, CDNA_SQL, DOMAIN_SQL, EFFECT_SQL, EPI_SQL, PAIR_VALUES,
                      PROTEIN_SQL, READING, REGION_SQL, REGISTRY_SEVERITY, RES_VALUES, SPAN_SQL, clean, key, sql_map)
from .shared import rounded


def num(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS DOUBLE)"


def snap(x: str, lo: float, hi: float, bins: int = 40) -> str:
    width = f"'{(hi - lo) / bins!r}'::DOUBLE"
    return f"round_even(({x} - ({lo}::DOUBLE)) / {width}, 0) * {width} + ({lo}::DOUBLE)"


GRANTHAM = """50.723::DOUBLE * sqrt(1.833::DOUBLE * pow({0}.comp - {1}.comp, 2) + 0.1018::DOUBLE * pow({0}.pol - {1}.pol, 2)
  + 0.000399::DOUBLE * pow({0}.vol - {1}.vol, 2))"""
DIMENSIONS = f"""bl AS (SELECT * FROM (VALUES {PAIR_VALUES}) t(ref, alt, score)),
rs AS (SELECT * FROM (VALUES {RES_VALUES}) t(aa, three, hyd, vol, chg, pol, comp))"""

VARIANT_KEY, DOMAIN_KEY, EXON_KEY = key('"Variant Type"'), key('"Domain"'), key('"Exon"')
MARK = lambda c: num(f"{key(chr(34) + c + chr(34))} <> 'unknown'")
SEVERITY_KEY = key('"Reported Clinical Severity"')

CATALOGUE_ROWS = f"""
WITH {CDNA_SQL.replace('{src}', CATALOGUE.sql)}, {PROTEIN_SQL.replace('{src}', CATALOGUE.sql)}, {DIMENSIONS},
v AS (SELECT id, {sql_map(VARIANT_KEY, fv.VARIANT_TYPES, 'other')} AS vtype, replace(upper({DOMAIN_KEY}), ' ', '_') AS dtext,
  CASE WHEN {EXON_KEY} NOT IN ('unknown', 'promoter') THEN TRY_CAST(regexp_extract({EXON_KEY}, '([0-9]+)', 1) AS DOUBLE) END AS ex,
  TRY_CAST(regexp_extract({EXON_KEY}, '([0-9]+)[^0-9]*$', 1) AS DOUBLE) AS exl, {key('"Subtype"')} AS ch, {key('"In Poly A"')} AS pa, {SEVERITY_KEY} AS sv,
  {MARK("Severe (<1 U/dL)")} AS m1, {MARK("Moderate (1-5 U/dL)")} AS m2, {MARK("Mild (>5 U/dL)")} AS m3, {MARK("No FVIII level given")} AS m4
  FROM {CATALOGUE.sql} t),
w AS (SELECT v.*, CASE WHEN sv LIKE '%not reported%' OR sv = 'unknown' THEN 'unknown'
  WHEN CAST(sv LIKE '%severe%' AS INT) + CAST(sv LIKE '%moderate%' AS INT) + CAST(sv LIKE '%mild%' AS INT) <> 1 THEN 'mixed'
  WHEN sv LIKE '%severe%' THEN 'severe' WHEN sv LIKE '%moderate%' THEN 'moderate' ELSE 'mild' END AS sev,
  p1 AS pos, abs(p2 - p1) + 1 AS span, CASE WHEN len(known) > 0 THEN list_reduce(known, lambda m, x: CASE WHEN abs(x) < abs(m) THEN x ELSE m END) END AS off,
  coalesce(len(offs) > 0, false) AS intronic, coalesce(d.body LIKE '%?%' OR (len(offs) > 0 AND len(known) = 0), false) AS unk,
  nullif(regexp_extract(body, '([ACGT]+)>([ACGT]+)\\s*$', 1), '') AS rn, nullif(regexp_extract(body, '([ACGT]+)>([ACGT]+)\\s*$', 2), '') AS an,
  mature, ref, CASE WHEN NOT fs AND alt = '=' THEN ref ELSE alt END AS alt2, coalesce(fs OR (NOT fs AND alt = '*'), false) AS stops,
  coalesce(NOT same AND ((s3.low LIKE '%del%' AND s3.low NOT LIKE '%delins%' AND s3.low NOT LIKE '%fs%') OR (s3.low LIKE '%dup%' AND s3.low NOT LIKE '%fs%')
    OR s3.low LIKE '%delins%'), false) AS indel,
  CASE WHEN s3.off IS NOT NULL THEN mature + s3.off - 1 WHEN NOT fs AND alt = '*' THEN mature END AS ptc
  FROM v JOIN d USING (id) JOIN s3 USING (id)),
x AS (SELECT *, CASE WHEN mature IS NOT NULL AND {SPAN_SQL.format('mature')} <> 'Unknown' THEN {SPAN_SQL.format('mature')} ELSE dtext END AS dom FROM w),
em AS (SELECT ex, greatest(quantile_cont(pos, 0.95) - quantile_cont(pos, 0.05) + 1, 1) AS len FROM w
  WHERE NOT intronic AND NOT unk AND exl = ex AND pos IS NOT NULL GROUP BY ex),
dl AS (SELECT dtext, ln(1 + count(*)) AS load FROM v GROUP BY dtext),
hp AS (SELECT pos, sum(n) OVER (ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) - 1 AS c50 FROM (
  SELECT pos, count(*) AS n FROM w WHERE pos IS NOT NULL GROUP BY pos))
SELECT x.id, {num("vtype = 'missense'")} AS vtype_missense, {num("vtype IN ('large_structural', 'frameshift', 'nonsense', 'splice')")} AS is_null_mutation,
  {num('stops')} AS is_truncating, {num('indel')} AS is_inframe_indel, {num('exl > x.ex')} AS is_multi_exon, coalesce(exl - x.ex + 1, 1) AS n_exons_involved,
  {num('unk')} AS unknown_breakpoint, round(ln(1 + coalesce(span, 0)), 5) AS log_span_nt, {num('span > 50')} AS is_large_event,
  round({snap('mature', -19, 2332)}, 5) AS mature_pos, {num("dom = 'A1'")} AS domain_A1, {num("upper(dom) = 'SIGNAL'")} AS domain_SIGNAL,
  {num("dom = 'a2'")} AS domain_acidic_a2, {num("upper(dom) = 'UNKNOWN'")} AS domain_UNKNOWN, {num('mature BETWEEN 741 AND 1648')} AS in_b_domain,
  {num("ch LIKE '%light%' AND ch NOT LIKE '%heavy%' OR coalesce(mature > 1648, false)")} AS is_light_chain, round(ln(1 + coalesce(len, 0)), 5) AS exon_length,
  CASE WHEN mature IS NOT NULL THEN round({snap(EPI_SQL.format('mature'), 0, 2332, 20)}, 5) END AS nearest_epitope_dist,
  round_even(ln(1 + greatest(coalesce(c50, 0), 0)), 2) AS hotspot_density_50nt, round(coalesce(load, 0), 5) AS domain_variant_load,
  round({snap('ptc', -19, 2332)}, 5) AS ptc_pos, CASE WHEN ptc IS NOT NULL THEN round({snap('(1 - least(greatest(ptc, 0), 2332) / 2332)', 0, 1, 20)}, 5) END AS fraction_protein_lost,
  {num('x.ex >= 26 AND stops')} AS nmd_escape, {num('stops AND NOT coalesce(x.ex >= 26, false)')} AS nmd_target,
  {' + '.join(num(f'ptc < {lo} AND stops') for _, lo, _ in fv.DOMAIN_SPANS)} AS n_domains_lost,
  round({GRANTHAM.format('rr', 'ra')}, 5) AS grantham, CAST(score AS DOUBLE) AS blosum62, {num('score IS NOT NULL')} AS has_chemistry,
  {num("concat(rn, an) IN ('AA', 'AG', 'GA', 'GG', 'CC', 'CT', 'TC', 'TT')")} AS is_transition, {num("concat(rn, '>', an) IN ('C>T', 'G>A')")} AS cpg_signature,
  {num("rn = 'C'")} AS ref_nt_C, round(({snap('x.pos', -250, 7053)}) / 7053, 6) AS cdna_pos_norm, coalesce(span, 0) % 3 AS indel_length_mod3,
  {num('abs(x.off) <= 2')} AS is_canonical_splice, {num('x.off > 0')} AS splice_donor_side, {num("sev = 'mixed'")} AS severity_mixed,
  CASE sev WHEN 'mild' THEN 0.0::DOUBLE WHEN 'mixed' THEN 1.0 WHEN 'moderate' THEN 1.0 WHEN 'severe' THEN 2.0 END AS severity_ordinal,
  {num("pa = 'y'")} AS in_poly_a, {num("vtype IN ('large_structural', 'frameshift', 'nonsense', 'splice') AND sev = 'severe'")} AS null_and_severe,
  m1 + m2 + m3 AS severity_strata_count, {num('m1 + m2 + m3 > 1')} AS variable_expressivity, m4 AS fviii_not_given
FROM x LEFT JOIN em ON x.ex = em.ex LEFT JOIN dl ON upper(dom) = dl.dtext LEFT JOIN hp ON x.pos = hp.pos
LEFT JOIN bl ON bl.ref = x.ref AND bl.alt = x.alt2 LEFT JOIN rs rr ON rr.aa = bl.ref LEFT JOIN rs ra ON ra.aa = bl.alt"""

CATALOGUE_COLUMNS = [
    "vtype_missense", "is_null_mutation", "is_truncating", "is_inframe_indel", "is_multi_exon", "n_exons_involved",
    "unknown_breakpoint", "log_span_nt", "is_large_event", "mature_pos", "domain_A1", "domain_SIGNAL", "domain_acidic_a2",
    "domain_UNKNOWN", "in_b_domain", "is_light_chain", "exon_length", "nearest_epitope_dist", "hotspot_density_50nt",
    "domain_variant_load", "ptc_pos", "fraction_protein_lost", "nmd_escape", "nmd_target", "n_domains_lost", "grantham",
    "blosum62", "has_chemistry", "is_transition", "cpg_signature", "ref_nt_C", "cdna_pos_norm", "indel_length_mod3",
    "is_canonical_splice", "splice_donor_side", "severity_mixed", "severity_ordinal", "in_poly_a", "null_and_severe",
    "severity_strata_count", "variable_expressivity", "fviii_not_given",
]


FIVE_DIGITS = ("log_span_nt", "mature_pos", "exon_length", "nearest_epitope_dist", "domain_variant_load", "ptc_pos", "fraction_protein_lost", "grantham")


def five(df):
    """Each column is rounded once: these to five digits, the others to six."""
    five_ = [c for c in FIVE_DIGITS if c in df.columns]
    rest = rounded(df.select(*[c for c in df.columns if c not in five_], *[F.col(c).cast("string").alias(c) for c in five_]))
    return rest.withColumns({c: F.round(F.col(c).cast("double"), 5) + F.lit(0.0) for c in five_}).select(*df.columns)


@query(sql=CATALOGUE_ROWS)
def catalogue_matrix_rows(spark, sf):
    """42 of the 135 columns, at least two from every block, row by row."""
    df = CATALOGUE.frame(spark, sf)
    _, built = features.CatalogueFeatures.fit_transform(df, ["id"])
    return five(built.select("id", *CATALOGUE_COLUMNS))


REGISTRY_CTE = f"""{DIMENSIONS},
v AS (SELECT *, {EFFECT_SQL.format('e')} AS effect, {DOMAIN_SQL.format('dd')} AS domain, {AA_SQL.format('fa')} AS ref, {AA_SQL.format('la')} AS alt,
  nullif(TRY_CAST(aa_numb AS DOUBLE) - 19, 0) AS mature, TRY_CAST(regexp_extract({clean('e_i_numb')}, '^([0-9]+)', 1) AS DOUBLE) AS ex FROM (
  SELECT *, lower({clean('mut_effect')}) AS e, lower({clean('d_id')}) AS dd, {clean('aa_first')} AS fa, {clean('aa_last')} AS la,
    replace(upper({clean('ntchange')}), ' ', '') AS nt FROM {VARIANTS.sql} t)),
r AS (SELECT mut_id, {REGISTRY_SEVERITY} AS severity, {ACTIVITY} AS act, {REGION_SQL.format('g')} AS region,
  TRY_CAST("act/ant" AS DOUBLE) AS ratio FROM (SELECT *, replace(lower({clean('cli_phe')}), ' ', '') AS k,
  {READING.format(clean('clotting'))} AS a, lower({clean('pa_race')}) AS g FROM {RECORDS.sql} t)),
x AS (SELECT r.*, v.* EXCLUDE (mut_id, "type") FROM r LEFT JOIN v USING (mut_id))"""
STOPS = "effect IN ('Nonsense', 'Frameshift')"
SHARED_SQL = f"""{num("effect = 'Missense'")} AS effect_Missense,
  {num("effect IN ('LargeDeletion', 'LargeDuplication', 'Nonsense', 'Frameshift')")} AS is_null_variant, {num("domain IN ('C1', 'C2')")} AS in_C_domain,
  mature AS mature_pos, {num('mature <= 1648')} AS is_heavy_chain, CASE WHEN mature IS NOT NULL THEN CAST({EPI_SQL.format('mature')} AS DOUBLE) END AS epitope_distance,
  {num(f"{SPAN_SQL.format('mature')} <> 'Unknown' AND mature IS NOT NULL")} AS structural_domain_known, ex AS exon_number, {num(f'ex = 26 AND {STOPS}')} AS nmd_escape,
  round(CASE WHEN {STOPS} THEN CASE WHEN mature IS NOT NULL THEN 1 - least(greatest(mature, 0), 2332) / 2332 END ELSE 0 END, 5) AS truncation_fraction,
  {num("x.ref <> x.alt AND x.alt <> '*'")} AS is_substitution, round({GRANTHAM.format('rr', 'ra')}, 5) AS grantham, r1.hyd AS ref_hydropathy,
  round(r2.vol - r1.vol, 5) + 0.0::DOUBLE AS delta_volume, {num("x.alt = '*'")} AS creates_stop,
  CASE severity WHEN 'Mild' THEN 0.0::DOUBLE WHEN 'Moderate' THEN 1.0 WHEN 'Severe' THEN 2.0 END AS severity_ordinal"""
SHARED_FROM = """FROM x LEFT JOIN bl ON bl.ref = x.ref AND bl.alt = x.alt LEFT JOIN rs rr ON rr.aa = bl.ref LEFT JOIN rs ra ON ra.aa = bl.alt
LEFT JOIN rs r1 ON r1.aa = x.ref LEFT JOIN rs r2 ON r2.aa = x.alt"""
SHARED_COLUMNS = [
    "effect_Missense", "is_null_variant", "in_C_domain", "mature_pos", "is_heavy_chain", "epitope_distance",
    "structural_domain_known", "exon_number", "nmd_escape", "truncation_fraction", "is_substitution", "grantham",
    "ref_hydropathy", "delta_volume", "creates_stop", "severity_ordinal"]


@query(sql=f"""
WITH {REGISTRY_CTE} SELECT mut_id, {SHARED_SQL}, {num("lower(trim(mut_type)) LIKE '%deletion%'")} AS muttype_deletion,
  {num("lower(trim(location)) = 'exon'")} AS loc_exon, {num("nt IN ('C>T', 'G>A')")} AS cpg_signature, {num("regexp_matches(nt, '^([AG]>[AG]|[CT]>[CT])$')")} AS is_transition,
  CASE WHEN TRY_CAST(n_bp AS DOUBLE) IS NOT NULL THEN round(ln(1 + greatest(TRY_CAST(n_bp AS DOUBLE), 0)), 5) END AS n_bp_log, {num('TRY_CAST(nuc_numb AS DOUBLE) < 0')} AS nuc_pos_negative,
  act AS fviii_activity, {num('act >= 1 AND act < 5')} AS fviii_1_to_5, {num('act >= 5')} AS fviii_above_5, {num('act IS NOT NULL')} AS fviii_measured,
  ratio AS act_ant_ratio, {num("region = 'east_asia'")} AS region_east_asia, {num("region = 'Unknown'")} AS region_Unknown {SHARED_FROM}""")
def registry_matrix_rows(spark, sf):
    """29 of the 95 columns, at least two from every block, one row per record."""
    built = features.registry_features(records(spark, sf), ["mut_id"])
    chosen = built.select("mut_id", *SHARED_COLUMNS, "muttype_deletion", "loc_exon", "cpg_signature", "is_transition", "n_bp_log",
                          "nuc_pos_negative", "fviii_activity", "fviii_1_to_5", "fviii_above_5", "fviii_measured",
                          "act_ant_ratio", "region_east_asia", "region_Unknown")
    return rounded(chosen, 5)


@query(sql=f"WITH {REGISTRY_CTE} SELECT mut_id, {SHARED_SQL} {SHARED_FROM}")
def harmonised_registry_rows(spark, sf):
    return rounded(features.harmonise_registry(records(spark, sf), ["mut_id"]).select("mut_id", *SHARED_COLUMNS), 5)


@query(sql=f"""
WITH {PROTEIN_SQL.replace('{src}', CATALOGUE.sql)}, {DIMENSIONS},
k AS (SELECT id, {CATALOGUE_EFFECT_SQL.format('t')} AS e0, m, {DOMAIN_SQL.format('dd')} AS domain, ex, {REGISTRY_SEVERITY} AS severity FROM (
  SELECT id, lower({clean('"Variant Type"')}) AS t, lower({clean('"Mechanism"')}) AS m, lower({clean('"Domain"')}) AS dd,
  TRY_CAST(regexp_extract({clean('"Exon"')}, '^([0-9]+)', 1) AS DOUBLE) AS ex, replace(lower({clean('"Reported Clinical Severity"')}), ' ', '') AS k FROM {CATALOGUE.sql} t)),
x AS (SELECT k.id, CASE WHEN e0 = 'LargeDeletion' AND regexp_matches(k.m, 'duplication|insertion') THEN 'LargeDuplication' ELSE e0 END AS effect,
  domain, ex, severity, mature, s3.ref, CASE WHEN NOT fs AND s3.alt = '=' THEN s3.ref ELSE s3.alt END AS alt FROM k JOIN s3 USING (id))
SELECT id, {SHARED_SQL} {SHARED_FROM}""")
def harmonised_catalogue_rows(spark, sf):
    return rounded(features.harmonise_catalogue(CATALOGUE.frame(spark, sf), ["id"]).select("id", *SHARED_COLUMNS), 5)


@query(sql="""
SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS token, CAST(o_custkey % 3 < 2 AS BOOLEAN) AS given FROM orders""")
def null_tokens(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey AS id", "CASE o_custkey % 3 WHEN 0 THEN ' A' WHEN 1 THEN 'B\\t' ELSE ' N/A ' END AS t")
    token = text.clean_token("t")
    return df.select("id", token.alias("token"), token.isNotNull().alias("given"))
