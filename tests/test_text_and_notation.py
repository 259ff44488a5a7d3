import pytest
from pyspark.sql import functions as F

from trivalent.functions import chemistry, encode, intervals, notation, text
from trivalent.functions import fixed_values as fv


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [r["out"] for r in df.select("i", make(F.col("x")).alias("out")).orderBy("i").collect()]


def test_registry_labels(spark):
    given = ["Yes", "yes", "No", "no ", "Not reported", "Not", "", None, "?", "NULL"]
    assert values(spark, given, text.registry_label) == [1, 1, 0, 0, None, None, None, None, None, None]


def test_catalogue_labels_keep_unknown_unknown(spark):
    assert values(spark, ["Y", " n ", "Not  reported", None], text.catalogue_label) == [1, 0, None, None]


@pytest.mark.parametrize("raw, want", [
    ("5", 5.0), ("<1", 0.5), ("<2", 1.0), (">5", 5.0), ("23 to 40", 31.5), ("9|<1?", 9.0), ("", None), ("not done", None),
    ("12%", 12.0), ("1,5", 1.5), ("<=3", 1.5), ("4 - 6?", 5.0), ("1.2.3", None)])
def test_censored_numbers(spark, raw, want):
    assert values(spark, [raw], text.censored_number) == [want]


def test_registry_severity(spark):
    given = ["Severe", "severe ", "svere", "Severe/moderate", "Moderate", "moderare", "Mild/Moderate", "non-severe",
             "Not reported", "Unclassified", ""]
    assert values(spark, given, text.registry_severity) == ["Severe"] * 4 + ["Moderate"] * 4 + ["Unknown"] * 3


def test_region_forms_agree(spark):
    rows = [(c,) for c in ["Iran", "usa", "France", None, "?", "South Korea"]]
    df = text.with_region(spark.createDataFrame(rows, "c string"), "c").withColumn("e", text.region("c"))
    got = {r["c"]: r["region"] for r in df.where("region = e").collect()}
    assert got == {"Iran": "south_asia", "usa": "north_america", "France": "europe_other", None: "Unknown",
                   "?": "Unknown", "South Korea": "east_asia"}


def parse_cdna(spark, raw):
    df = notation.with_cdna(spark.createDataFrame([(raw,)], "x string"), "x")
    return df.select("cdna.*").first().asDict()


@pytest.mark.parametrize("raw, want", [
    ("c.101A>T", dict(cdna_pos=101, span_nt=1, op_sub=1, ref_nt="A", alt_nt="T")),
    ("c.106_107del", dict(cdna_pos=106, span_nt=2, op_del=1)),
    ("c.5815G>T", dict(cdna_pos=5815, span_nt=1, op_sub=1)),
    ("c.-112G>A", dict(cdna_pos=-112, span_nt=1, op_sub=1, is_utr5=1, is_promoter=1)),
    ("c.96_107del", dict(cdna_pos=96, span_nt=12)),
    ("c.1538-10_1546del", dict(is_intronic=1, intron_offset=-10)),
    ("c.388+2delGTG", dict(is_intronic=1, intron_offset=2)),
    ("c.-171-?_143+?del", dict(unknown_breakpoint=1, op_del=1, is_intronic=1, intron_offset=None)),
    ("c.145_156delinsGAAGAATGC", dict(op_delins=1, op_del=0, op_ins=0)),
    (None, dict(cdna_pos=None, is_intronic=0)),
    ("???", dict(cdna_pos=None))])
def test_cdna_vectors(spark, raw, want):
    got = parse_cdna(spark, raw)
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize("precursor, mature, want", [
    ("p.(Asp34Glu)", "Asp15Glu", dict(mature_pos=15, ref_aa="D", alt_aa="E")),
    ("p.(Ala1939Ser)", "Ala1920Ser", dict(mature_pos=1920)),
    ("p.(Cys8*)", "Cys-12*", dict(mature_pos=-12, is_nonsense=1, ptc_mature_pos=-12)),
    ("p.(Arg15*)", "Arg-5*", dict(mature_pos=-5)),
    ("p.(Met36Alafs*3)", "Met17Alafs*3", dict(is_frameshift=1, fs_ter_offset=3, ptc_mature_pos=19)),
    ("p.(=)", "=", dict(is_synonymous=1, is_frameshift=0, mature_pos=None)),
    (None, "Arg-5*", dict(mature_pos=-5, prot_pos=15, is_nonsense=1)),
    (None, None, dict(mature_pos=None)),
    ("", "", dict(mature_pos=None)),
    ("NM_000132.4:p.Arg1781His", None, dict(prot_pos=1781, mature_pos=1762, ref_aa="R", alt_aa="H")),
    ("NP_000123.1:p.(Leu12Profs*8)", None, dict(prot_pos=12, is_frameshift=1, fs_ter_offset=8)),
    ("not a variant", None, dict(mature_pos=None, is_frameshift=0))])
def test_protein_vectors(spark, precursor, mature, want):
    df = spark.createDataFrame([(precursor, mature)], "p string, m string")
    got = notation.with_protein(df, "p", "m").select("prot.*").first().asDict()
    assert {k: got[k] for k in want} == want


def test_published_chemistry(spark):
    pairs = {(r["ref"], r["alt"]): r for r in chemistry.pair_table(spark).collect()}
    assert len(pairs) == 400
    published = dict(SW=177, IV=29, RW=101, CW=215, LI=5, DE=45, GW=184, FY=22, KR=26, AG=60)
    for (a, b), want in published.items():
        assert abs(pairs[a, b]["grantham"] - want) <= 5
        assert pairs[a, b]["grantham"] == pytest.approx(pairs[b, a]["grantham"])
    assert [pairs[x, x]["blosum62"] for x in "WACGP"] == [11, 4, 9, 6, 7]


def test_domains_tile_the_molecule(spark):
    spans = sorted((lo, hi) for _, lo, hi in fv.DOMAIN_SPANS)
    assert spans[0][0] == 1 and spans[-1][1] == fv.MATURE_LENGTH
    assert all(b[0] == a[1] + 1 for a, b in zip(spans, spans[1:]))
    df = spark.createDataFrame([(-5.0,), (None,), (2832.0,), (1648.0,), (1649.0,), (490.0,), (400.0,)], "m double")
    rows = df.select(intervals.span_name("m").alias("d"), intervals.nearest_span_distance("m").alias("e")).collect()
    assert [r["d"] for r in rows] == ["Signal", "Unknown", "Unknown", "B", "a3", "A2", "A2"]
    assert rows[5]["e"] == 0 and rows[6]["e"] == 84 and rows[1]["e"] is None


def test_range_join_equals_brute_force(spark):
    points = spark.createDataFrame([(i, float(i * 7 % 50)) for i in range(40)] + [(99, None)], "id int, pos double")
    spans = spark.createDataFrame([("a", 0.0, 9.5), ("b", 5.0, 31.0), ("c", 40.0, 40.0)], "name string, lo double, hi double")
    got = {(r["id"], r["name"]) for r in intervals.range_join(points, "pos", spans, 4.0).collect()}
    rows = {(r["id"], r["pos"]) for r in points.collect()}
    want = set()
    for i, p in rows:
        hits = [n for n, lo, hi in (("a", 0, 9.5), ("b", 5, 31), ("c", 40, 40)) if p is not None and lo <= p <= hi]
        want |= {(i, n) for n in hits} or {(i, None)}
    assert got == want


def test_snap_rounds_half_to_even_and_bands(spark):
    df = spark.createDataFrame([(2.5, 0.1), (3.5, 0.25), (None, 0.4), (0.5, 1.0)], "x double, p double")
    rows = df.select(encode.snap("x", 0, 10, 10).alias("s"), encode.risk_band("p").alias("b")).collect()
    assert [r["s"] for r in rows] == [2.0, 4.0, None, 0.0]
    assert [r["b"] for r in rows] == ["Moderate", "High", "Very high", "Very high"]
    with pytest.raises(ValueError):
        encode.threshold_value({"youden": 0.2}, "nope")
