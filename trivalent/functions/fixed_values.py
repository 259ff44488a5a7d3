"""Fixed values. They must equal the published ones for results to be right."""

# Spellings that mean "nothing recorded".
NULL_TOKENS = ["", "nan", "none", "null", "na", "n/a", "?", "-"]

# Variant-type spellings -> class.
VARIANT_TYPES = {
    "missense": "missense",
    "nonsense": "nonsense",
    "frameshift": "frameshift",
    "splice site change": "splice",
    "large structural change (>50 bp)": "large_structural",
    "large structure change (>50bp)": "large_structural",
    "small structural change (in-frame, <50 bp)": "small_structural",
    "small structural change (in-frame, <50bp)": "small_structural",
    "synonymous": "synonymous",
    "promoter": "regulatory",
    "5'utr": "regulatory",
    "3'utr": "regulatory",
}
VARIANT_TYPE_LEVELS = ["missense", "nonsense", "frameshift", "splice", "large_structural",
                       "small_structural", "synonymous", "regulatory", "other"]
NULL_VARIANT_TYPES = ["large_structural", "frameshift", "nonsense", "splice"]

# Mechanism spellings -> class.
MECHANISMS = {
    "substitution": "substitution",
    "deletion": "deletion",
    "duplication": "duplication",
    "insertion": "insertion",
    "inversion": "inversion",
    "deletion/insertion": "delins",
    "deletion/duplication": "complex",
    "duplication/insertion": "complex",
    "deletion/inversion": "complex",
    "duplication/inversion": "complex",
    "deletion/duplication/inversion": "complex",
}
MECHANISM_LEVELS = ["substitution", "deletion", "duplication", "insertion", "inversion",
                    "delins", "complex", "other"]

# Effect classes shared by both registries.
EFFECT_LEVELS = ["Missense", "Nonsense", "Frameshift", "Splice", "InFrame", "Silent",
                 "LargeDeletion", "LargeDuplication"]
NULL_EFFECTS = ["LargeDeletion", "LargeDuplication", "Nonsense", "Frameshift"]
STOP_EFFECTS = ["Nonsense", "Frameshift"]

# Domain synonyms -> level.
DOMAIN_SYNONYMS = {
    "5utr": "UTR", "3utr": "UTR", "utr": "UTR",
    "signal peptide": "Signal", "splice site": "SpliceSite",
    "multiple domains": "Multiple", "undefined": "Unknown",
    "a1 linker": "a1", "a2 linker": "a2", "a3 linker": "a3",
    "a1-a2": "Multiple",
}
PLAIN_DOMAINS = ["A1", "A2", "A3", "B", "C1", "C2"]
DOMAIN_LEVELS = ["A1", "A2", "A3", "B", "C1", "C2", "a1", "a2", "a3",
                 "Signal", "UTR", "SpliceSite", "Multiple", "Unknown"]

# Reporting country -> region; anything else recorded is europe_other.
REGIONS = {
    "africa": ["south africa", "egypt", "tunisia", "morocco", "nigeria", "algeria", "kenya"],
    "east_asia": ["china", "japan", "korea", "south korea", "taiwan", "hong kong", "singapore",
                  "thailand", "malaysia", "vietnam", "indonesia"],
    "south_asia": ["india", "pakistan", "bangladesh", "sri lanka", "nepal", "iran"],
    "middle_east": ["turkey", "israel", "saudi arabia", "lebanon", "jordan", "kuwait",
                    "united arab emirates", "iraq", "syria", "qatar"],
    "latin_america": ["brazil", "argentina", "mexico", "chile", "colombia", "venezuela", "peru",
                      "cuba", "uruguay", "costa rica"],
    "north_america": ["usa", "united states", "canada", "u.s.a.", "us"],
    "oceania": ["australia", "new zealand"],
}
REGION_LEVELS = ["europe_other", "east_asia", "south_asia", "middle_east", "latin_america",
                 "north_america", "africa", "oceania", "Unknown"]

# Molecule geometry.
SIGNAL_LENGTH = 19
MATURE_LENGTH = 2332
CODING_LENGTH = 7053
CHAIN_BOUNDARY = 1648
B_DOMAIN = (741, 1648)
EXON_COUNT = 26
LAST_EXON = 26
LARGEST_EXON = 14
POSITION_BINS = 40

# Inclusive spans in mature numbering; lower case marks the acidic linkers.
DOMAIN_SPANS = [
    ("A1", 1, 336), ("a1", 337, 372), ("A2", 373, 719), ("a2", 720, 740), ("B", 741, 1648),
    ("a3", 1649, 1689), ("A3", 1690, 2019), ("C1", 2020, 2172), ("C2", 2173, 2332),
]
EPITOPE_SPANS = [
    ("A2_epitope", 484, 508), ("A3_epitope", 1804, 1819), ("C1_epitope", 2091, 2115),
    ("C2_epitope_1", 2181, 2243), ("C2_epitope_2", 2248, 2312),
]
SITE_SPANS = [
    ("vwf_binding", 1670, 1684), ("fixa_binding", 1811, 1818), ("fx_binding", 337, 372),
    ("phospholipid_c2", 2199, 2332), ("thrombin_r372", 372, 372),
    ("thrombin_r740", 740, 740), ("thrombin_r1689", 1689, 1689),
]

# Residues: letter, code, Kyte-Doolittle hydropathy, Zamyatnin volume, charge,
# Grantham polarity, Grantham composition.
RESIDUES = [
    ("A", "Ala", 1.8, 88.6, 0.0, 8.1, 0.00),
    ("R", "Arg", -4.5, 173.4, 1.0, 10.5, 0.65),
    ("N", "Asn", -3.5, 114.1, 0.0, 11.6, 1.33),
    ("D", "Asp", -3.5, 111.1, -1.0, 13.0, 1.38),
    ("C", "Cys", 2.5, 108.5, 0.0, 5.5, 2.75),
    ("Q", "Gln", -3.5, 143.8, 0.0, 10.5, 0.89),
    ("E", "Glu", -3.5, 138.4, -1.0, 12.3, 0.92),
    ("G", "Gly", -0.4, 60.1, 0.0, 9.0, 0.74),
    ("H", "His", -3.2, 153.2, 0.5, 10.4, 0.58),
    ("I", "Ile", 4.5, 166.7, 0.0, 5.2, 0.00),
    ("L", "Leu", 3.8, 166.7, 0.0, 4.9, 0.00),
    ("K", "Lys", -3.9, 168.6, 1.0, 11.3, 0.33),
    ("M", "Met", 1.9, 162.9, 0.0, 5.7, 0.00),
    ("F", "Phe", 2.8, 189.9, 0.0, 5.2, 0.00),
    ("P", "Pro", -1.6, 112.7, 0.0, 8.0, 0.39),
    ("S", "Ser", -0.8, 89.0, 0.0, 9.2, 1.42),
    ("T", "Thr", -0.7, 116.1, 0.0, 8.6, 0.71),
    ("W", "Trp", -0.9, 227.8, 0.0, 5.4, 0.13),
    ("Y", "Tyr", -1.3, 193.6, 0.0, 6.2, 0.20),
    ("V", "Val", 4.2, 140.0, 0.0, 5.9, 0.00),
]
AROMATIC = ["F", "W", "Y"]
OTHER_RESIDUE_CODES = {"Ter": "*", "Sec": "U", "Xaa": "X"}
GRANTHAM_WEIGHTS = (1.833, 0.1018, 0.000399)
GRANTHAM_SCALE = 50.723

# BLOSUM62 (fixed values): each residue's score with the residues of the rows above, in order, and with itself.
BLOSUM62 = {
    "A": [4],
    "R": [-1, 5],
    "N": [-2, 0, 6],
    "D": [-2, -2, 1, 6],
    "C": [0, -3, -3, -3, 9],
    "Q": [-1, 1, 0, 0, -3, 5],
    "E": [-1, 0, 0, 2, -4, 2, 5],
    "G": [0, -2, 0, -1, -3, -2, -2, 6],
    "H": [-2, 0, 1, -1, -3, 0, 0, -2, 8],
    "I": [-1, -3, -3, -3, -1, -3, -3, -4, -3, 4],
    "L": [-1, -2, -3, -4, -1, -2, -3, -4, -3, 2, 4],
    "K": [-1, 2, 0, -1, -3, 1, 1, -2, -1, -3, -2, 5],
    "M": [-1, -1, -2, -3, -1, 0, -2, -3, -2, 1, 2, -1, 5],
    "F": [-2, -3, -3, -3, -2, -3, -3, -3, -1, 0, 0, -3, 0, 6],
    "P": [-1, -2, -2, -1, -3, -1, -1, -2, -2, -3, -3, -1, -2, -4, 7],
    "S": [1, -1, 1, 0, -1, 0, 0, 0, -1, -2, -2, 0, -1, -2, -1, 4],
    "T": [0, -1, 0, -1, -1, -1, -1, -2, -2, -1, -1, -1, -1, -2, -1, 1, 5],
    "W": [-3, -3, -4, -4, -2, -2, -3, -2, -2, -3, -2, -3, -1, 1, -4, -3, -2, 11],
    "Y": [-2, -2, -2, -3, -2, -1, -2, -3, 2, -1, -1, -2, -1, 3, -3, -2, -2, 2, 7],
    "V": [0, -3, -3, -3, -1, -2, -2, -3, -3, 3, 1, -2, 1, -1, -2, -2, 0, -3, -1, 4],
}

# Risk bands, half-open.
RISK_BANDS = [(0.00, 0.10, "Low"), (0.10, 0.25, "Moderate"), (0.25, 0.40, "High"),
              (0.40, 1.01, "Very high")]

# Columns that identify a row or a paper and must never become features.
IDENTIFIER_COLUMNS = [
    "HGVS cDNA", "HGVS cDNA Name", "hg19 Coordinates", "hg19 Nucleotide No.",
    "Yoshitake Nucleotide No.", "HGVS Protein", "HGVS Protein Name", "Mature Protein",
    "Mature Protein Change", "Codon", "Comments", "Reference Number", "Year Reported", "Year",
    "Newly Added in the Current Version",
]
IDENTIFIER_LIKE = ["HGVS cDNA", "hg19 Coordinates", "HGVS Protein", "Mature Protein", "Codon"]
UNTRUSTED_PATTERNS = ["comment", "reference", "year", "newly added", "unnamed", "inhibitor", "gene"]
OUTCOME_DERIVED = [
    "uinhibitor", "useverity", "uclotting", "uratio", "uantigen", "utype", "udiscrep",
    "ucomments", "comments", "pri_comments", "inhibitor_no_count", "inhibitor_yes_count",
    "inhibitor_total_known", "inhibitor_positive_rate", "inhibitor_target", "Inhibitors",
]

# Column names of the external catalogue -> catalogue names.
EXTERNAL_RENAMES = {
    "HGVS cDNA Name": "HGVS cDNA",
    "HGVS Protein Name": "HGVS Protein",
    "Mature Protein Change": "Mature Protein",
    "hg19 Nucleotide No.": "hg19 Coordinates",
    "Reported Severity": "Reported Clinical Severity",
}
CATALOGUE_ALIASES = {
    "cdna": ["HGVS cDNA", "HGVS cDNA Name"],
    "protein": ["HGVS Protein", "HGVS Protein Name"],
    "mature": ["Mature Protein", "Mature Protein Change"],
    "variant_type": ["Variant Type"],
    "mechanism": ["Mechanism"],
    "exon": ["Exon"],
    "domain": ["Domain"],
    "subtype": ["Subtype"],
    "poly_a": ["In Poly A"],
    "severity": ["Reported Clinical Severity", "Reported Severity"],
    "mark_severe": ["Severe (<1 U/dL)"],
    "mark_moderate": ["Moderate (1-5 U/dL)"],
    "mark_mild": ["Mild (>5 U/dL)"],
    "mark_none": ["No FVIII level given"],
}
VARIANT_COLUMNS = [
    "mut_id", "mut_type", "mut_effect", "d_id", "location", "e_i_numb", "locnumb", "aa_numb_old",
    "aa_numb", "codon_change", "codon_first", "codon_last", "n_bp", "nuc_numb", "ntchange",
    "aa_first", "aa_last", "CpG", "Count_mut_id",
]
SUPPLIED_COVARIATES = ["Inhibitor_Status", "Severity_Encoded", "High_Risk_Mutation_Flag",
                       "Mutation_Location_Group", "Genomic_Region_Bucket",
                       "Variant_Type_Encoded", "Severity_Interaction", "Patient_ID"]
ETHNICITY_LEVELS = ["Caucasian", "Asian", "Black", "Hispanic", "Other"]
UUID4_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
