"""Feature matrices as single projections over parsed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions import encode as enc
from ..functions import fixed_values as fv
from ..functions import intervals, notation, text
from ..functions.text import flag
from ..operators import aggregates, ordered
from ..session import materialise, small_side
from ..sources.tables import resolve

#: Spark column names ignore case, so acidic linkers get their own names.
LINKER = {"a1": "acidic_a1", "a2": "acidic_a2", "a3": "acidic_a3"}
Blocks = dict[str, dict[str, Column]]


def named(columns: list[Column], names: list[str]) -> dict[str, Column]:
    return dict(zip(names, columns))


def hot(value, levels, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{LINKER.get(level, level)}": flag(text._col(value) == level) for level in levels}


def project(df: DataFrame, blocks: Blocks, keep=()) -> DataFrame:
    """All blocks in one select, doubles only."""
    pairs = [(name, expr) for columns in blocks.values() for name, expr in columns.items()]
    return df.select(*keep, *[expr.cast("double").alias(name) for name, expr in pairs])


def block_table(spark, blocks: dict[str, list[str]]) -> DataFrame:
    rows = [(feature, block) for block, features in blocks.items() for feature in features]
    return spark.createDataFrame(rows, "feature string, block string")


def block_names(blocks: Blocks) -> dict[str, list[str]]:
    return {block: list(columns) for block, columns in blocks.items()}


# --- pieces shared by the registry matrix and the harmonised matrix -----------

def effect_columns() -> dict[str, Column]:
    return {**hot("effect", fv.EFFECT_LEVELS, "effect_"),
            "is_null_variant": enc.member("effect", fv.NULL_EFFECTS),
            "is_truncating": enc.member("effect", fv.NULL_EFFECTS)}


def domain_columns() -> dict[str, Column]:
    return {**hot("domain", fv.DOMAIN_LEVELS, "domain_"),
            "in_C_domain": enc.member("domain", ["C1", "C2"]),
            "in_A_domain": enc.member("domain", ["A1", "A2", "A3"])}


def mature_columns() -> dict[str, Column]:
    pos = F.col("mature")
    return {
        "mature_pos": pos,
        "relative_pos": pos / fv.MATURE_LENGTH,
        "is_heavy_chain": flag(pos <= fv.CHAIN_BOUNDARY),
        "epitope_distance": intervals.nearest_span_distance(pos),
        "structural_domain_known": flag(intervals.span_name(pos) != "Unknown"),
    }


def exon_columns() -> dict[str, Column]:
    exon, stops = F.col("exon"), F.col("effect").isin(fv.STOP_EFFECTS)
    return {
        "exon_number": exon,
        "is_exon_14": flag(exon == fv.LARGEST_EXON),
        "is_last_exon": flag(exon == fv.LAST_EXON),
        "nmd_escape": flag((exon == fv.LAST_EXON) & stops),
        "truncation_fraction": F.when(stops, enc.share_lost("mature")).otherwise(0.0),
    }


def residue_columns(proline: bool) -> dict[str, Column]:
    ref, alt = F.col("ref_aa"), F.col("alt_aa")
    out = {
        "is_substitution": flag((ref != alt) & (alt != "*")),
        "grantham": F.col("pair.grantham"),
        "blosum62": F.col("pair.blosum62"),
    }
    for name in chem.PROPERTIES:
        out[f"ref_{name}"] = F.col(f"ref_res.{name}")
        out[f"delta_{name}"] = F.col(f"alt_res.{name}") - F.col(f"ref_res.{name}")
    out |= {"ref_aromatic": enc.member(ref, fv.AROMATIC), "alt_aromatic": enc.member(alt, fv.AROMATIC),
            "ref_is_cysteine": flag(ref == "C"), "alt_is_cysteine": flag(alt == "C")}
    if proline:
        out |= {"ref_is_proline": flag(ref == "P"), "alt_is_proline": flag(alt == "P")}
    return out | {"creates_stop": flag(alt == "*")}


def severity_columns() -> dict[str, Column]:
    return {"severity_ordinal": text.registry_severity_rank(F.col("severity")),
            **hot("severity", ["Mild", "Moderate", "Severe", "Unknown"], "severity_")}


# --- registry ------------------------------------------------------------------

def registry_inputs(df: DataFrame) -> DataFrame:
    """Normalised inputs of the registry matrix next to the record's own columns."""
    staged = df.withColumns({
        "_mature": text.number("aa_numb") - fv.SIGNAL_LENGTH, "_domain": text.lower_token("d_id"),
        "_ref": text.clean_token("aa_first"), "_alt": text.clean_token("aa_last"),
        "kind": text.lower_token("mut_type"), "place": text.lower_token("location"),
        "change": F.replace(F.upper(text.clean_token("ntchange")), F.lit(" "), F.lit("")),
        "nuc": text.number("nuc_numb"), "bases": text.number("n_bp"),
    } | {c: F.lit(None).cast("double") for c in ("locnumb",) if c not in df.columns})
    staged = staged.withColumns({
        "domain": text.domain_level("_domain", ready=True),
        "exon": text.leading_integer("e_i_numb"),
        "mature": F.when(F.col("_mature") != 0, F.col("_mature")),
        "ref_aa": text.residue_letter("_ref", ready=True),
        "alt_aa": text.residue_letter("_alt", ready=True),
    })
    return chem.with_pair(staged, "ref_aa", "alt_aa")


def registry_blocks(clinical: bool = True, context: bool = True) -> Blocks:
    kind, place, change, nuc = (F.col(c) for c in ("kind", "place", "change", "nuc"))
    blocks: Blocks = {
        "genotype": effect_columns() | {
            f"muttype_{level}": flag(kind.contains(level))
            for level in ("point", "deletion", "insertion", "duplication", "indel")
        } | {f"loc_{level}": flag(place == level) for level in ("exon", "intron", "utr")} | {
            "cpg_signature": enc.member(change, ["C>T", "G>A"]),
            "is_transition": flag(change.rlike("^([AG]>[AG]|[CT]>[CT])$")),
            "n_bp_log": enc.log1p_nonneg("bases"),
        },
        "domain": domain_columns(),
        "position": mature_columns() | {"nuc_pos": nuc, "nuc_pos_negative": flag(nuc < 0)} | exon_columns() | {
            "locnumb": text.number("locnumb")},
        "chemistry": residue_columns(proline=True),
    }
    if clinical:
        act, ant = F.col("fviii_activity"), F.col("fviii_antigen")
        blocks["clinical"] = {
            "fviii_activity": act,
            "fviii_activity_log": enc.log1p_nonneg(act),
            "fviii_below_1": flag(act < 1),
            "fviii_1_to_5": flag((act >= 1) & (act < 5)),
            "fviii_above_5": flag(act >= 5),
            "fviii_measured": flag(act.isNotNull()),
        } | severity_columns() | {
            "fviii_antigen": ant,
            "fviii_antigen_measured": flag(ant.isNotNull()),
            "act_ant_ratio": F.col("act_ant_ratio"),
        } | hot("crm_type", ["I", "II", "NU", "Unknown"], "crm_")
    if context:
        blocks["context"] = hot("region", fv.REGION_LEVELS, "region_")
    return blocks


def registry_features(df: DataFrame, keep=(), clinical: bool = True, context: bool = True) -> DataFrame:
    """95 columns in 6 blocks; the measurement and centre blocks can be left out."""
    return project(registry_inputs(df), registry_blocks(clinical, context), keep)


# --- harmonised space ------------------------------------------------------------

def harmonised_blocks() -> Blocks:
    return {"genotype": effect_columns(), "domain": domain_columns(), "position": mature_columns() | exon_columns(),
            "chemistry": residue_columns(proline=False), "severity": severity_columns()}


def harmonise_registry(df: DataFrame, keep=()) -> DataFrame:
    blank = {c: F.lit(None).cast("string") for c in ("mut_type", "location", "ntchange", "nuc_numb", "n_bp")
             if c not in df.columns}
    return project(registry_inputs(df.withColumns(blank) if blank else df), harmonised_blocks(), keep)


def catalogue_shared_inputs(df: DataFrame) -> DataFrame:
    """Catalogue rows expressed in the registry's vocabulary."""
    staged = notation.with_protein(df, "HGVS Protein", "Mature Protein", "_prot").withColumns({
        "effect": text.catalogue_effect(F.col("`Variant Type`"), F.col("Mechanism")),
        "domain": text.domain_level("Domain"),
        "exon": text.leading_integer("Exon"),
        "mature": F.col("_prot.mature_pos"),
        "ref_aa": F.col("_prot.ref_aa"),
        "alt_aa": F.col("_prot.alt_aa"),
        "severity": text.registry_severity(F.col("`Reported Clinical Severity`")),
    })
    return chem.with_pair(staged, "ref_aa", "alt_aa")


def harmonise_catalogue(df: DataFrame, keep=()) -> DataFrame:
    return project(catalogue_shared_inputs(df), harmonised_blocks(), keep)


def registry_keys(df: DataFrame, keep=()) -> DataFrame:
    """Four-part identity a variant keeps across registries; residue 0 stays 0 here."""
    return df.select(
        *keep, "effect", F.round(text.number("aa_numb") - fv.SIGNAL_LENGTH, 1).alias("mature_pos"),
        text.residue_letter("aa_first").alias("ref_aa"), text.residue_letter("aa_last").alias("alt_aa"))


def catalogue_keys(df: DataFrame, keep=()) -> DataFrame:
    return notation.with_protein(df, "HGVS Protein", "Mature Protein", "_prot").select(
        *keep, text.catalogue_effect(F.col("`Variant Type`")).alias("effect"),
        F.round("_prot.mature_pos", 1).alias("mature_pos"), F.col("_prot.ref_aa").alias("ref_aa"),
        F.col("_prot.alt_aa").alias("alt_aa"))


# --- catalogue -------------------------------------------------------------------

def parsed_catalogue(df: DataFrame, keep=()) -> DataFrame:
    """Every row parsed and normalised once."""
    raw = resolve(df, fv.CATALOGUE_ALIASES, keep)
    raw = notation.with_protein(notation.with_cdna(raw, "cdna", "cd"), "protein", "mature", "pr")
    texts = ("variant_type", "mechanism", "subtype", "severity", "exon", "domain", "poly_a")
    keyed = raw.withColumns({c: text.text_key(c) for c in texts})
    return keyed.select(
        *keep, "cd", "pr",
        text.lookup(F.col("variant_type"), fv.VARIANT_TYPES, "other").alias("vtype"),
        text.lookup(F.col("mechanism"), fv.MECHANISMS, "other").alias("mech"),
        text.chain("subtype", ready=True).alias("chain"), text.catalogue_severity("severity", ready=True).alias("sev"),
        text.first_integer("exon", ready=True).alias("exon"), text.last_integer("exon", ready=True).alias("exon_last"),
        F.replace(F.upper("domain"), F.lit(" "), F.lit("_")).alias("domain_text"), "poly_a",
        *[flag(text.text_key(f"mark_{m}") != "unknown").alias(f"mark_{m}")
          for m in ("severe", "moderate", "mild", "none")])


def exon_map(parsed: DataFrame) -> DataFrame:
    """Inner coding extent of each exon from single-exon, non-intronic anchors."""
    clean = parsed.where(
        (F.col("cd.is_intronic") == 0) & (F.col("cd.unknown_breakpoint") == 0) & (F.col("exon_last") == F.col("exon")))
    return aggregates.group_extent(clean.select("exon", F.col("cd.cdna_pos").alias("pos")), "exon", "pos")


@dataclass
class CatalogueFeatures:
    """Label-free fitted tables of the catalogue matrix."""

    exons: DataFrame
    hotspots: DataFrame
    loads: DataFrame

    @classmethod
    def fit(cls, df: DataFrame) -> "CatalogueFeatures":
        return cls.fit_parsed(materialise(parsed_catalogue(df), "parsed"))

    @classmethod
    def fit_transform(cls, df: DataFrame, keep=()) -> tuple["CatalogueFeatures", DataFrame]:
        """Fit and transform the same rows with the text parsed once."""
        parsed = materialise(parsed_catalogue(df, keep), "parsed")
        fitted = cls.fit_parsed(parsed)
        return fitted, fitted.transform_parsed(parsed, keep)

    @classmethod
    def fit_parsed(cls, parsed: DataFrame) -> "CatalogueFeatures":
        positions = parsed.select(F.col("cd.cdna_pos").alias("pos")).where("pos is not null")
        return cls(
            exons=materialise(exon_map(parsed), "exons"),
            hotspots=materialise(positions, "hotspots"),
            loads=materialise(aggregates.category_load(parsed, F.col("domain_text")), "loads"))

    def save(self, path: str) -> None:
        for name in ("exons", "hotspots", "loads"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "CatalogueFeatures":
        return cls(**{name: spark.read.parquet(f"{path}/{name}") for name in ("exons", "hotspots", "loads")})

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        """135 columns in 7 blocks. Rows never depend on the other rows of the frame.

        Parsed rows are stored: the density lookup and the final projection both
        read them, and neither repeats the text work.
        """
        return self.transform_parsed(materialise(parsed_catalogue(df, keep), "parsed"), keep)

    def transform_parsed(self, parsed: DataFrame, keep=()) -> DataFrame:
        staged = parsed.withColumns({
            "mature": F.col("pr.mature_pos"), "ptc": F.col("pr.ptc_mature_pos"), "pos": F.col("cd.cdna_pos"),
            "stops": (F.col("pr.is_frameshift") + F.col("pr.is_nonsense")) > 0,
            "by_pos": intervals.span_name("pr.mature_pos")})
        staged = staged.withColumn("domain", F.when(
            F.col("by_pos") != "Unknown", F.col("by_pos")).otherwise(F.col("domain_text")))
        staged = chem.with_pair(
            staged.withColumns({"ref_aa": F.col("pr.ref_aa"), "alt_aa": F.col("pr.alt_aa")}), "ref_aa", "alt_aa")
        staged = staged.join(
            small_side(self.exons.select(F.col("exon").alias("_exon"), F.col("length").alias("exon_length"))),
            F.col("exon") == F.col("_exon"), "left")
        density = ordered.neighbour_count(self.hotspots, staged.select("pos"), "pos", [50, 500])
        staged = aggregates.with_category_load(staged, self.loads, F.upper("domain"), "domain_load")
        density = density.withColumnRenamed("pos", "_pos")
        joined = staged.join(density, F.col("pos").eqNullSafe(F.col("_pos")), "left")
        return project(joined, catalogue_blocks(), keep)


def catalogue_blocks() -> Blocks:
    mature, ptc, exon, last = (F.col(c) for c in ("mature", "ptc", "exon", "exon_last"))
    span = F.coalesce(F.col("cd.span_nt"), F.lit(0.0))
    stops, offset = F.col("stops"), F.col("cd.intron_offset")
    null = enc.member("vtype", fv.NULL_VARIANT_TYPES)
    severe_text = flag(F.col("sev") == "severe")
    ref_nt, alt_nt = F.col("cd.ref_nt"), F.col("cd.alt_nt")
    ref, alt = F.col("pr.ref_aa"), F.col("pr.alt_aa")
    escape = flag((exon >= fv.LAST_EXON) & stops)
    strata = F.col("mark_severe") + F.col("mark_moderate") + F.col("mark_mild")
    lost = {f"loses_{LINKER.get(name, name)}": flag((ptc < lo) & stops) for name, lo, _ in fv.DOMAIN_SPANS}
    lo_grid, hi_grid = -fv.SIGNAL_LENGTH, fv.MATURE_LENGTH
    upper = F.upper("domain")
    domain_hot = hot("domain", fv.PLAIN_DOMAINS, "domain_") | {"domain_SIGNAL": flag(upper == "SIGNAL")} | hot(
        "domain", ["a1", "a2", "a3"], "domain_") | {"domain_UNKNOWN": flag(upper == "UNKNOWN")}
    density = lambda w: F.bround(F.log1p(F.coalesce(F.col(f"within_{w}"), F.lit(0)).cast("double")), 2)
    within = lambda d: flag(F.abs(offset) <= d)
    return {
        "consequence": hot("vtype", fv.VARIANT_TYPE_LEVELS, "vtype_") | hot("mech", fv.MECHANISM_LEVELS, "mech_") | {
            "is_null_mutation": null,
            "is_truncating": flag(stops),
            "is_inframe_indel": flag(F.col("pr.is_inframe_del") + F.col("pr.is_inframe_dup") + F.col("pr.is_delins") > 0),
            "is_multi_exon": flag(last > exon),
            "n_exons_involved": F.coalesce(last - exon + 1, F.lit(1.0)),
            "unknown_breakpoint": F.col("cd.unknown_breakpoint"),
            "log_span_nt": F.log1p(span),
            "is_large_event": flag(span > 50),
        },
        "position": {
            "mature_pos": enc.snap(mature, lo_grid, hi_grid),
            "mature_pos_norm": enc.snap(mature, lo_grid, hi_grid) / fv.MATURE_LENGTH,
            "mature_pos_known": flag(mature.isNotNull()),
        } | domain_hot | {
            "in_b_domain": intervals.in_span(mature, *fv.B_DOMAIN),
            "is_light_chain": flag((F.col("chain") == "light") | F.coalesce(mature > fv.CHAIN_BOUNDARY, F.lit(False))),
            "is_heavy_chain": flag(F.col("chain") == "heavy"),
            "is_single_domain_event": flag(F.col("chain") == "single_domain"),
            "exon_number": exon,
            "exon_norm": exon / fv.EXON_COUNT,
            "is_exon_14": flag(exon == fv.LARGEST_EXON),
            "is_last_exon": flag(exon == fv.LAST_EXON),
            "exon_length": F.log1p(F.coalesce("exon_length", F.lit(0.0))),
        } | {f"in_{n}": intervals.in_span(mature, lo, hi) for n, lo, hi in fv.EPITOPE_SPANS} | {
            "nearest_epitope_dist": enc.snap(intervals.nearest_span_distance(mature), 0.0, fv.MATURE_LENGTH, 20),
            "in_any_epitope": intervals.in_any_span(mature, fv.EPITOPE_SPANS),
        } | {f"in_{n}": intervals.in_span(mature, lo, hi) for n, lo, hi in fv.SITE_SPANS} | {
            "hotspot_density_50nt": density(50),
            "hotspot_density_500nt": density(500),
            "domain_variant_load": F.col("domain_load"),
        },
        "truncation": {
            "ptc_pos": enc.snap(ptc, lo_grid, hi_grid),
            "ptc_known": flag(ptc.isNotNull()),
            "fraction_protein_lost": enc.snap(enc.share_lost(ptc), 0.0, 1.0, 20),
            "fs_ter_offset": F.col("pr.fs_ter_offset"),
            "nmd_escape": escape,
            "nmd_target": flag(stops & (escape == 0)),
        } | lost | {"n_domains_lost": sum(lost.values())},
        "chemistry": {
            "grantham": F.col("pair.grantham"),
            "blosum62": F.col("pair.blosum62"),
        } | {f"d_{name}": chem.delta(name) for name in chem.PROPERTIES} | {
            "abs_d_charge": F.abs(chem.delta("charge")),
            "ref_is_cys": flag(ref == "C"),
            "alt_is_cys": flag(alt == "C"),
            "ref_is_gly": flag(ref == "G"),
            "alt_is_pro": flag(alt == "P"),
            "ref_is_arg": flag(ref == "R"),
            "aromatic_change": chem.aromatic_change(),
            "charge_flip": chem.charge_flip(),
            "has_chemistry": flag(F.col("pair").isNotNull()),
        },
        "nucleotide": {
            "is_transition": enc.is_transition(ref_nt, alt_nt),
            "is_transversion": enc.is_transversion(ref_nt, alt_nt),
            "cpg_signature": enc.member(F.concat(ref_nt, F.lit(">"), alt_nt), ["C>T", "G>A"]),
        } | {f"{side}_nt_{base}": flag(col == base) for base in "ACGT" for side, col in (("ref", ref_nt), ("alt", alt_nt))} | {
            "cdna_pos_norm": enc.snap("pos", -250.0, fv.CODING_LENGTH) / fv.CODING_LENGTH,
            "indel_length_mod3": F.pmod(span, F.lit(3.0)),
            "frame_preserving": flag(F.pmod(span, F.lit(3.0)) == 0),
        },
        "splicing": {
            "is_intronic": F.col("cd.is_intronic"),
            "abs_intron_offset": F.abs(offset),
            "is_canonical_splice": within(2),
            "is_extended_splice": within(8),
            "splice_donor_side": flag(offset > 0),
            "splice_acceptor_side": flag(offset < 0),
            "is_utr5": F.col("cd.is_utr5"),
            "is_utr3": F.col("cd.is_utr3"),
            "is_promoter": F.col("cd.is_promoter"),
        },
        "clinical": {f"severity_{level}": flag(F.col("sev") == level)
                     for level in ("severe", "moderate", "mild", "mixed", "unknown")} | {
            "severity_ordinal": text.catalogue_severity_rank(F.col("sev")),
            "severity_reported": flag(F.col("sev") != "unknown"),
            "in_poly_a": flag(F.col("poly_a") == "y"),
            "null_and_severe": null * severe_text,
            "null_and_light_chain": null * flag(F.col("chain") == "light"),
            "fviii_severe": F.col("mark_severe"),
            "fviii_moderate": F.col("mark_moderate"),
            "fviii_mild": F.col("mark_mild"),
            "fviii_not_given": F.col("mark_none"),
            "severity_strata_count": strata,
            "variable_expressivity": flag(strata > 1),
        },
    }


def covariate_columns(ethnicities=fv.ETHNICITY_LEVELS) -> dict[str, Column]:
    """Plain encoding of the five supplied covariates of the fused table."""
    age, exposure = text.number("Age_at_Diagnosis"), text.number("Exposure_Days")
    early = flag(exposure <= 50)
    return {
        "age_at_diagnosis": age,
        "log_age": enc.log1p_nonneg(age),
        "exposure_days": exposure,
        "log_exposure_days": enc.log1p_nonneg(exposure),
        "within_first_50_ed": early,
        "family_history": text.number("Family_History"),
        "prophylaxis": flag(F.lower(text.strip("Treatment_Regimen")) == "prophylaxis"),
    } | {f"ethnicity_{e.lower()}": flag(text.strip("Ethnicity") == e) for e in ethnicities} | {
        "young_and_early_exposure": flag(age <= 2) * early}


def covariates(df: DataFrame, keep=()) -> DataFrame:
    return project(df, {"covariates": covariate_columns()}, keep)


def catalogue_feature_names() -> list[str]:
    return [name for columns in catalogue_blocks().values() for name in columns]
