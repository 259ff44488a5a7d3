"""How the given tables play the roles of catalogue, registry and score tables.

Each column is one expression in the SQL that Spark and DuckDB share, so both
engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread


def pick(key: str, values: list[str | None]) -> str:
    """CASE that deals the values out by ``key``."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    arms = " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values))
    return f"CASE ({key}) % {len(values)} {arms} END"


def _ticks(text: str) -> str:
    """Spark spells quoted names with backticks."""
    return text.replace('"', "`")


class Binding:
    """A named projection of one table."""

    def __init__(self, table: str, columns: dict[str, str]):
        self.table, self.columns = table, columns

    def frame(self, spark: SparkSession, sf: str, busy: bool = False) -> DataFrame:
        """``busy``: much is computed from each row, so all cores get some (:func:`session.spread`)."""
        source = spark.read.parquet(f"{sf}/{self.table}.parquet")
        source = spread(source) if busy else source
        return source.selectExpr(*[f'{_ticks(e)} AS `{n}`' for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        names = ", ".join(f'{e} AS "{n}"' for n, e in self.columns.items())
        return f"(SELECT {names} FROM {self.table})"


TRI_STATE = "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END"

SCORES = Binding("lineitem", {
    "y": TRI_STATE,
    "p": "l_discount * 4 + l_tax * 3 + l_quantity / 200"
         " + CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 8e-2 ELSE 0e0 END",
    "q": "l_extendedprice / 106000",
    "stratum": "l_linestatus",
    "grp": "l_partkey",
    "study": "l_suppkey",
})

#: One row per order, with an id: three members' scores and a label.
MEMBERS = Binding("orders", {
    "id": "o_orderkey",
    "y": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END",
    "grp": "o_custkey",
    "pos": "CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END",
    "alpha": "(o_totalprice / 600000) * 8e-1 + CASE WHEN o_orderstatus = 'F' THEN 1e-1 ELSE 0e0 END",
    "beta": "(o_custkey % 97) / 1e2",
    "gamma": "((o_orderkey * 7919) % 1009) / 2018e0"
             " + CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 2e-1 ELSE 0e0 END",
})

_K = "o_orderkey"
CATALOGUE = Binding("orders", {
    "id": _K,
    "HGVS cDNA": "CASE " + _K + " % 9"
        " WHEN 0 THEN concat('c.', CAST(" + _K + " % 7000 + 1 AS STRING), 'C>T')"
        " WHEN 1 THEN concat('c.', CAST(" + _K + " % 6900 + 1 AS STRING), '_', CAST(" + _K + " % 6900 + 1 + o_custkey % 90 AS STRING), 'del')"
        " WHEN 2 THEN concat('c.-', CAST(" + _K + " % 180 + 1 AS STRING), 'G>A')"
        " WHEN 3 THEN concat('c.', CAST(" + _K + " % 7000 + 1 AS STRING), '-', CAST(o_custkey % 12 + 1 AS STRING), '_', CAST(" + _K + " % 7000 + 9 AS STRING), 'del')"
        " WHEN 4 THEN concat('c.', CAST(" + _K + " % 7000 + 1 AS STRING), '+', CAST(o_custkey % 5 + 1 AS STRING), 'delGTG')"
        " WHEN 5 THEN concat('c.-', CAST(" + _K + " % 170 + 1 AS STRING), '-?_', CAST(" + _K + " % 170 + 143 AS STRING), '+?del')"
        " WHEN 6 THEN concat('c.', CAST(" + _K + " % 7000 + 1 AS STRING), '_', CAST(" + _K + " % 7000 + 12 AS STRING), 'delinsGAAGAATGC')"
        " WHEN 7 THEN concat('c.*', CAST(" + _K + " % 90 + 1 AS STRING), 'A>G')"
        " ELSE CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('C.', CAST(" + _K + " % 7000 + 1 AS STRING), 'dup') END END",
    "HGVS Protein": "CASE " + _K + " % 8"
        " WHEN 0 THEN concat('p.(Arg', CAST(" + _K + " % 2351 + 1 AS STRING), 'Cys)')"
        " WHEN 1 THEN concat('p.(Cys', CAST(" + _K + " % 2351 + 1 AS STRING), '*)')"
        " WHEN 2 THEN concat('p.(Met', CAST(" + _K + " % 2351 + 1 AS STRING), 'Alafs*', CAST(o_custkey % 40 + 1 AS STRING), ')')"
        " WHEN 3 THEN 'p.(=)'"
        " WHEN 4 THEN concat('p.(Gly', CAST(" + _K + " % 2351 + 1 AS STRING), 'del)')"
        " WHEN 5 THEN concat('p.(Trp', CAST(" + _K + " % 2351 + 1 AS STRING), '=)')"
        " WHEN 6 THEN CASE WHEN o_custkey % 2 = 0 THEN '???' ELSE NULL END"
        " ELSE NULL END",
    "Mature Protein": "CASE WHEN " + _K + " % 8 = 7 THEN concat(" + pick("o_custkey", ["Asp", "Leu", "Phe", "Lys"]) +
        ", CAST(" + _K + " % 2332 - 15 AS STRING), " + pick(_K + " + o_custkey", ["Glu", "Ile", "Tyr", "Pro", "*"]) +
        ") WHEN " + _K + " % 8 = 6 THEN concat('Ser', CAST(" + _K + " % 2332 + 1 AS STRING), 'fs*', CAST(o_custkey % 9 + 1 AS STRING)) END",
    "Variant Type": pick(_K + " + o_custkey", ["Missense", " nonsense ", "Frameshift", "Splice  site change",
        "Large structural change (>50 bp)", "Large structure change (>50bp)",
        "Small structural change (in-frame, <50 bp)", "small structural change (in-frame, <50bp)",
        "Synonymous", "Promoter", "5'UTR", "3'UTR", "gene conversion", None]),
    "Mechanism": pick(_K, ["Substitution", "Deletion", "Duplication", "Insertion", "Inversion",
        "Deletion/Insertion", "deletion/duplication", "Duplication/Insertion", "Deletion/Inversion",
        "Duplication/Inversion", "Deletion/Duplication/Inversion", "other", None]),
    "Exon": pick("o_custkey", ["1", "14", "Exon 26", "7 - 9", "promoter", "26", "14", "intron 22", "1-26", None, "3"]),
    "Domain": pick(_K, ["A1", "a2", "B", "A3", " c1", "C2", "Signal peptide", "a1 linker", "Multiple domains", "n/a", None]),
    "Subtype": pick(_K, ["Heavy chain", "Light chain", "single domain", "", "light", None, "Heavy"]),
    "In Poly A": pick(_K, ["Y", "N", "n", None, " y "]),
    "Reported Clinical Severity": pick(_K + " / 3", ["Severe", "severe ", "Moderate", "Mild", "Mild/Moderate",
        "Severe/mild", "Not reported", None, "moderate", "unclear"]).replace("(o_orderkey / 3)", "CAST(floor(o_orderkey / 3) AS BIGINT)"),
    "Severe (<1 U/dL)": pick("o_custkey", ["x", None, "", "n/a", None, "x"]),
    "Moderate (1-5 U/dL)": pick("o_custkey + 1", ["x", None, None, "X", ""]),
    "Mild (>5 U/dL)": pick("o_custkey + " + _K, [None, "x", None, None]),
    "No FVIII level given": pick("o_custkey", [None, None, "x"]),
    "History of Inhibitor": pick(_K + " + o_custkey", ["Yes", "No", "Not reported", "no ", " YES", "NP", None, "No", "n", "y"]),
})

VARIANTS = Binding("part", {
    "mut_id": "p_partkey",
    "mut_type": pick("p_partkey", ["Point", "Deletion", "Insertion", "duplication", "Indel", None]),
    "mut_effect": pick("p_partkey + p_size", ["Missense", "Nonsense", "Frameshift", "Splice site", "Large deletion",
        "Large duplication", "Silent", "In-frame deletion", "inframe", "synonymous", "unclassified", "?"]),
    "d_id": pick("p_size", ["A1", "a2", "B", "A3", "C1", "C2", "Signal peptide", "a1 linker", "5UTR", "Splice site",
        "undefined", "multiple domains", "null"]),
    "location": pick("p_partkey", ["Exon", "Intron", "UTR", " exon", None]),
    "e_i_numb": pick("p_size", ["14", "26", "7a", "", "1", "22 inv", None]),
    "locnumb": "CAST(p_size AS STRING)",
    "aa_numb": "CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE CAST(p_partkey % 2351 + 1 AS STRING) END",
    "n_bp": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size - 2 AS STRING) END",
    "nuc_numb": "CAST(p_partkey * 3 - 90 AS STRING)",
    "ntchange": pick("p_partkey", ["C>T", "g>a", "A > C", "T>G", "delA", None]),
    "aa_first": pick("p_partkey", ["Arg", "CYS", "leu", "W", "Gly", "Xaa", None]),
    "aa_last": pick("p_size", ["His", "Tyr", "pro", "Ter", "K", "*", "n/a"]),
    "type": "p_type",
})

RECORDS = Binding("lineitem", {
    "mut_id": "l_partkey",
    "Inhibitors": "CASE l_returnflag WHEN 'R' THEN " + pick("l_orderkey", ["Yes", "yes", " Y", "Positive"]) +
        " WHEN 'A' THEN " + pick("l_orderkey", ["No", "no ", "N", "negative"]) +
        " ELSE " + pick("l_orderkey", ["Not reported", "Not", "", None, "?", "NULL"]) + " END",
    "cli_phe": pick("l_orderkey + l_linenumber", ["Severe", "severe ", "svere", "Severe/moderate", "Moderate", "moderare",
        "Mild/Moderate", "non-severe", "Mild", "Not reported", "Unclassified", "", None]),
    "clotting": "CASE l_orderkey % 7 WHEN 0 THEN CAST(l_linenumber AS STRING) WHEN 1 THEN '<1' WHEN 2 THEN '>5'"
        " WHEN 3 THEN concat(CAST(l_linenumber AS STRING), ' to ', CAST(l_linenumber + 17 AS STRING))"
        " WHEN 4 THEN concat(CAST(l_linenumber AS STRING), '|<1?') WHEN 5 THEN 'not done' END",
    "antigen": "CASE l_orderkey % 5 WHEN 0 THEN concat(CAST(l_linenumber AS STRING), ',5%') WHEN 1 THEN '< 2'"
        " WHEN 2 THEN concat(CAST(l_linenumber AS STRING), '-', CAST(l_linenumber + 4 AS STRING), '?') END",
    "act/ant": "CASE l_orderkey % 4 WHEN 0 THEN CAST(l_linenumber AS STRING) WHEN 1 THEN 'n.d.' END",
    "type": pick("l_orderkey", ["I", "ii", "NU", "III", None]),
    "pa_race": pick("l_suppkey", ["China", "Iran", " usa", "Brazil", "Egypt", "Turkey", "France", "New Zealand", "", None, "?"]),
    "reference": "CASE WHEN l_suppkey % 13 = 0 THEN '?' ELSE concat('study ', CAST(l_suppkey AS STRING)) END",
})
