"""Saved stages of our own and the committed score sink."""

import random

import pytest
from pyspark.sql import functions as F

from trivalent.plans import features, models, stages
from trivalent.sources import tables


def rows_of(spark, n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        a, b = rng.random(), rng.random()
        y = None if i % 11 == 0 else int(a + 0.3 * b + 0.2 * rng.random() > 0.7)
        rows.append((i, i // 6, a, None if i % 9 == 0 else b, y))
    return spark.createDataFrame(rows, "id long, family long, a double, b double, y int")


def test_stacked_model_saves_loads_and_keeps_groups_apart(spark, tmp_path):
    df = rows_of(spark)
    stack = stages.StackedClassifier(
        bases={"l2": ["logistic", {}], "trees": ["forest", {"trees": 5, "depth": 3}]}, features=["a", "b"], groupCol="family", folds=3)
    stack.write().save(str(tmp_path / "estimator"))
    again = stages.StackedClassifier.load(str(tmp_path / "estimator"))
    assert again.getOrDefault("bases") == stack.getOrDefault("bases") and again.getOrDefault("folds") == 3
    model = again.fit(df)
    assert model.cross_fitted.count() == 2 * df.where("y IS NOT NULL").count()
    folds = model.inner_folds.groupBy("row_group").agg(F.count_distinct("fold").alias("n"))
    assert folds.where("n > 1").isEmpty()
    # A base's inner score equals that of a model fitted without the row's fold.
    table = model.inner_folds.join(df.select("id", "a", "b", "y"), "id")
    held = models.score(models.fit(table.where("fold <> 0"), ["a", "b"], models.logistic()), table.where("fold = 0"), ["id"])
    both = held.join(model.cross_fitted.where("model = 'l2'").select("id", F.col("p").alias("q")), "id").collect()
    assert both and all(r["p"] == pytest.approx(r["q"], abs=1e-6) for r in both)

    model.write().save(str(tmp_path / "model"))
    loaded = stages.StackedModel.load(str(tmp_path / "model"))
    scores = lambda m: sorted((r["id"], round(r["p"], 12)) for r in m.transform(df).collect())
    assert scores(model) == scores(loaded)
    alone = loaded.transform(df.where("id = 7")).first()
    assert (7, round(alone["p"], 12)) in scores(model)
    assert model.transform(df).columns == [*df.columns, "p"]


def test_artefact_refuses_other_features(spark, tmp_path, monkeypatch):
    df = rows_of(spark)
    model = models.fit(df, ["a", "b"], models.logistic())
    fitted = features.CatalogueFeatures(*[spark.range(1) for _ in range(3)])
    built = stages.Artefact.of_catalogue(fitted, model, {"youden": 0.5})
    path = str(tmp_path / "artefact")
    built.save(path)
    assert stages.Artefact.load(spark, path).names == features.catalogue_feature_names()
    with pytest.raises(ValueError, match="other features"):
        stages.Artefact.load(spark, path, [*features.catalogue_feature_names(), "one_more"])
    with pytest.raises(Exception):  # incomplete: no manifest
        stages.Artefact.load(spark, str(tmp_path / "artefact" / "pipeline"))


def test_rewriting_one_model_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "scores")
    of = lambda model, p: spark.createDataFrame([(i, model, p) for i in range(3)], "id long, model string, p double")
    tables.write_scores(of("a", 0.1).unionByName(of("b", 0.2)), path)
    tables.write_scores(of("b", 0.9), path)
    # A write that never came to its commit.
    of("a", 0.5).withColumn("run", F.lit("lost")).write.mode("append").partitionBy("model", "run").parquet(path)
    got = {(r["model"], r["p"]) for r in tables.read_scores(spark, path).collect()}
    assert got == {("a", 0.1), ("b", 0.9)}
    assert tables.read_scores(spark, path, "b").count() == 3
    assert tables.read_scores(spark, path, "c").count() == 0


def test_temporary_tables_go_and_lasting_ones_stay(spark):
    import os

    from trivalent.session import discard, materialise, temporary

    with temporary():
        inner = materialise(spark.range(5), "inner")
        with temporary():
            innermost = materialise(spark.range(3), "innermost")
        kept = materialise(inner.join(materialise(spark.range(4), "more"), "id"), "kept", lasting=True)
    local = lambda df: df.stored_at.removeprefix("file://")
    assert not os.path.exists(local(inner)) and not os.path.exists(local(innermost))
    assert kept.count() == 4
    outside = materialise(spark.range(2), "outside")
    assert outside.count() == 2
    discard(outside, outside)  # twice does no harm
    assert not os.path.exists(local(outside))
