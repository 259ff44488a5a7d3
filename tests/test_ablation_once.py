"""An ablation fits each different set of features once; a sweep computes its rows once and ranks on all cores."""

from __future__ import annotations

from trivalent.plans import experiments, models


def test_sets_of_equal_features_are_fitted_once(spark, monkeypatch):
    df = spark.range(120).selectExpr("id", "CAST(id % 3 AS INT) AS fold", "CAST(id % 2 AS INT) AS y", "(id * 37) % 11 + id % 2 * 2.0D AS a", "(id * 53) % 7 * 1.0D AS b")
    asked, real = [], models.out_of_fold

    def counted(table, features, *args, **kwargs):
        asked.append(tuple(features))
        return real(table, features, *args, **kwargs)

    monkeypatch.setattr(models, "out_of_fold", counted)
    sets = experiments.block_sets({"one": ["a"], "two": ["b"]})
    rows = {r.feature_set: r for r in experiments.ablate(df, sets, models.logistic(1.0)).collect()}
    assert sorted(asked) == [("a",), ("a", "b"), ("b",)]
    assert set(rows) == set(sets) and all(rows[n].n_features == len(fs) for n, fs in sets.items())
    assert rows["only:one"].auc_roc == rows["without:two"].auc_roc == rows["ladder:1:one"].auc_roc
    assert rows["only:two"].auc_roc == rows["without:one"].auc_roc != rows["only:one"].auc_roc


def test_a_sweep_computes_its_rows_once_and_ranks_them_on_all_cores(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(0, 240, 1, 1).selectExpr(
        "id", "CAST(id % 3 AS INT) AS fold", "CASE WHEN id % 8 < 7 THEN CAST(id % 2 AS INT) END AS y", "(id * 37) % 11 + id % 2 * 9.0D AS a",
        "(id * 53) % 7 * 1.0D AS b", "CAST(NULL AS DOUBLE) AS none")
    df = df.mapInArrow(passed, df.schema)
    parts, real = [], models.fit

    def counted(train, features, factory, *args, **kwargs):
        if factory is ranker:
            parts.append((train.rdd.getNumPartitions(), train.count()))
        return real(train, features, factory, *args, **kwargs)

    ranker = models.forest(trees=5)
    monkeypatch.setattr(models, "fit", counted)
    found = {r.feature_set: r for r in experiments.top_k_sweep(df, ["a", "b", "none"], [1, 2], ranker, models.logistic(1.0)).collect()}
    assert seen.value == 240
    assert parts == [(spark.sparkContext.defaultParallelism, 210)]
    assert found["top:1"].n_features == 1 and found["top:2"].n_features == 2 and found["top:1"].auc_roc > 0.9
