import pytest
from pyspark.sql import functions as F

from trivalent.operators import aggregates, metrics, splits
from trivalent.plans import experiments, features, models, scoring
from trivalent.queries import learning
from trivalent.queries.bindings import CATALOGUE, RECORDS, VARIANTS
from trivalent.sources import tables

SF = "/root/testdata/sf0.001"
FAST = models.logistic(maxIter=10)


@pytest.fixture(scope="module")
def table(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    df = spark.range(1200).select("id", h.alias("a"), F.when(F.col("id") % 9 != 0, F.col("id") % 13).cast("double").alias("b"))
    y = F.when(F.col("id") % 6 == 0, None).otherwise((F.col("a") + (F.col("id") % 4) / 4 > 0.9).cast("int"))
    return models.fold_table(splits.stratified_folds(df.withColumn("y", y), "id"), ["id", "a", "b", "y", "fold"])


def test_out_of_fold_scores_every_labelled_row_once(spark, table):
    oof = models.out_of_fold(table, ["a", "b"], FAST, "l2")
    assert oof.count() == oof.select("id").distinct().count() == table.where("y IS NOT NULL").count()
    assert metrics.roc_auc(oof).first()[0] > 0.7


def test_out_of_fold_uses_the_folds_there_are(spark, table):
    three = table.withColumn("fold", F.col("fold") % 3)
    assert models.out_of_fold(three, ["a"], FAST, "l2").select("id").distinct().count() == table.where("y IS NOT NULL").count()
    with pytest.raises(ValueError):
        models.out_of_fold(table.where("fold = 1"), ["a"], FAST, "l2")


def test_audit_fits_every_training_row(spark, monkeypatch):
    """The audit's forest was fitted on about 5,000 rows, however many there were."""
    class Counting:
        def __init__(self, stages):
            pass

        def fit(self, df):
            return df.count()

    rows = spark.range(12_000).select((F.col("id") % 3).cast("double").alias("a"), F.when(F.col("id") % 6 != 0, F.col("id") % 2).alias("y"))
    monkeypatch.setattr(models, "Pipeline", Counting)
    assert models.fit(rows, ["a"], learning.AUDIT_FOREST) == 10_000


def test_repeats_average_a_rows_scores(spark, table):
    oof, summary = models.cross_validate(table, ["a"], {"l2": FAST}, repeats=2)
    rows = oof.collect()
    assert len(rows) == table.where("y IS NOT NULL").count() and {r["repeats"] for r in rows} == {2}
    assert summary.first()["folds"] == 10


def test_row_scores_do_not_depend_on_the_batch(spark, table):
    model = models.fit(table.where("fold <> 0"), ["a", "b"], FAST)
    batch = {r["id"]: r["p"] for r in models.score(model, table.where("fold = 0"), ["id"]).collect()}
    one = next(iter(batch))
    assert models.score(model, table.where(F.col("id") == one), ["id"]).first()["p"] == batch[one]


def test_bounded_calibration_stays_off_the_ends_and_keeps_order(spark):
    rows = [(i, i / 500, int(i >= 460)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, p double, y int")
    out = [r["calibrated"] for r in models.Calibrator.fit(df).transform(df).orderBy("p").collect()]
    assert all(0 < v < 1 for v in out) and out == sorted(out)


def test_greedy_selection_never_loses_to_the_best_member(spark, table):
    long = table.where("y IS NOT NULL").select("id", "y", "a", (F.pmod(F.xxhash64("id", "y"), F.lit(97)) / 97).alias("noise")).unpivot(
        ["id", "y"], ["a", "noise"], "model", "p")
    path = models.greedy_rank_ensemble(long).orderBy("step").collect()
    best = max(r["auc_roc"] for r in metrics.roc_auc(long, by=["model"]).collect())
    assert path[0]["auc_roc"] == pytest.approx(best) and [r["auc_roc"] for r in path] == sorted(r["auc_roc"] for r in path)


def test_attributions_skip_no_ops_and_rank_by_size(spark, table):
    model = models.fit(table, ["a", "b"], FAST)
    medians = aggregates.exact_medians(table, ["a", "b"])
    at_median = table.limit(1).withColumns({"a": F.lit(medians["a"]), "b": F.lit(medians["b"])})
    assert experiments.reset_attribution(model, at_median, medians).count() == 0
    for r in experiments.reset_attribution(model, table.where("fold = 1"), medians, top=2).groupBy("id").agg(
            F.max_by(F.abs("contribution"), -F.col("rank")).alias("first"), F.max(F.abs("contribution")).alias("most")).collect():
        assert r["first"] == r["most"]


def test_permutation_importance_finds_the_signal(spark, table):
    model = models.fit(table, ["a", "b"], FAST)
    top = experiments.permutation_importance(model, table, ["a", "b"], repeats=1).first()
    assert top["feature"] == "a" and top["importance"] > 0.1


def test_self_training_pool_only_shrinks(spark, table):
    _, history = experiments.self_train(table, ["a", "b"], FAST, rounds=2, hi=0.6, lo=0.4, per_round=40)
    rows = history.orderBy("round").collect()
    assert rows and all(r["adopted_positive"] + r["adopted_negative"] <= 40 for r in rows)
    assert rows[0]["pool_remaining"] < table.where("y IS NULL").count()


def test_matrices_have_the_expected_width_and_only_doubles(spark):
    cat = CATALOGUE.frame(spark, SF)
    fitted = features.CatalogueFeatures.fit(cat)
    built = fitted.transform(cat, ["id"])
    assert len(built.columns) == 136 and {t for n, t in built.dtypes if n != "id"} == {"double"}
    assert built.count() == cat.count()
    reg = tables.registry_records(RECORDS.frame(spark, SF), VARIANTS.frame(spark, SF))
    assert len(features.registry_features(reg).columns) == 95
    assert len(features.registry_features(reg, clinical=False, context=False).columns) == 68
    assert features.harmonise_registry(reg).columns == features.harmonise_catalogue(cat).columns
    assert len(features.harmonise_registry(reg).columns) == 57


def test_catalogue_transform_of_one_row_equals_the_batch(spark):
    cat = CATALOGUE.frame(spark, SF)
    fitted = features.CatalogueFeatures.fit(cat)
    batch = {r["id"]: tuple(r) for r in fitted.transform(cat, ["id"]).where("id IN (3, 10, 22)").collect()}
    for i in (3, 10, 22):
        assert tuple(fitted.transform(cat.where(F.col("id") == i), ["id"]).first()) == batch[i]


def test_feature_values_of_a_known_variant(spark):
    record = {"HGVS cDNA": "c.6496C>T", "HGVS Protein": "p.(Arg2166*)", "Mature Protein": "Arg2147*", "Variant Type": "Nonsense",
              "Mechanism": "Substitution", "Exon": "23", "Domain": "C1", "Subtype": "Light chain", "In Poly A": "N",
              "Reported Clinical Severity": "Severe"}
    df = tables.from_records(spark, [record], scoring.CATALOGUE_INPUTS)
    row = features.CatalogueFeatures.fit(CATALOGUE.frame(spark, SF)).transform(df).first()
    want = dict(vtype_nonsense=1, is_null_mutation=1, is_truncating=1, domain_C1=1, domain_acidic_a1=0, is_light_chain=1,
                loses_C2=1, loses_C1=0, n_domains_lost=1, nmd_target=1, nmd_escape=0, cpg_signature=1, is_transition=1,
                null_and_severe=1, severity_ordinal=2, exon_number=23, ptc_known=1, has_chemistry=0, grantham=None)
    assert {k: row[k] for k in want} == want


def test_records_score_alone_as_together(spark):
    records = [{"effect": "Large deletion", "severity": "Severe", "fviii_activity": "0.5", "aa_position": "500"},
               {"effect": "Missense", "severity": "Mild", "fviii_activity": "12"}, {"effect": "Nonsense", "severity": "severe"}]
    reg = tables.registry_records(RECORDS.frame(spark, SF), VARIANTS.frame(spark, SF))
    names = ["is_null_variant", "severity_ordinal", "fviii_activity", "relative_pos"]
    model = models.fit(features.registry_features(reg, ["y"]), names, FAST)
    both = scoring.score_registry_records(spark, records, model, {"youden": 0.5}, "youden", names).orderBy("record").collect()
    alone = scoring.score_registry_records(spark, records[2:], model, {"youden": 0.5}, "youden", names).first()
    assert len(both) == 3 and both[2]["risk"] == alone["risk"]
    with pytest.raises(ValueError):
        scoring.score_registry_records(spark, records, model, {"youden": 0.5}, "other", names)


def clustered(spark, n, rng, hot=0):
    import numpy as np

    centres = rng.normal(size=(20, 8)) * 4
    vecs = [*(centres[i % 20] + rng.normal(size=8) for i in range(n)), *(np.ones(8) for _ in range(hot))]
    rows = [(i, int(rng.random() < 0.5), [float(x) for x in v]) for i, v in enumerate(vecs)] + [(10**6, 1, None)]
    return spark.createDataFrame(rows, "id long, y int, vec array<double>").repartition(5)


def test_neighbour_index_recall_and_hot_lists(spark):
    import numpy as np

    from trivalent.operators import neighbours

    df = clustered(spark, 1500, np.random.default_rng(1), hot=750)
    index = neighbours.NeighbourIndex.fit(df, k=10, list_rows=200)
    assert index.rows.count() == 2250
    assert index.parts.agg({"parts": "max"}).first()[0] >= 4
    assert index.rows.groupBy("list", "part").count().agg({"count": "max"}).first()[0] < 300
    asked = df.where("id % 100 = 0").drop("y")
    found = index.nearest(asked, 10, query_block=5)
    pairs = found.count()
    assert pairs == found.select("query_id", "ref_id").distinct().count() == 10 * asked.count() - 10 * asked.where("vec is null").count()
    near = found.groupBy("query_id").agg({"distance": "max"})
    exact = neighbours.nearest(df, asked, 10).groupBy("query_id").agg({"distance": "max"})
    close = [(r[1], s[1]) for r, s in zip(sorted(near.collect()), sorted(exact.collect()))]
    assert sum(a <= b + 1e-9 for a, b in close) >= 0.9 * len(close)  # equal vectors tie, so distances are compared


def test_neighbour_index_of_nothing(spark):
    from trivalent.operators import neighbours

    empty = spark.createDataFrame([], "id long, y int, vec array<double>")
    asked = spark.createDataFrame([(1, [0.0])], "id long, vec array<double>")
    assert neighbours.NeighbourIndex.fit(empty).nearest(asked).count() == 0
