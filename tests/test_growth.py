"""Inputs on which the work must not grow faster than the rows."""

import time

import pytest
from pyspark.sql import functions as F

from trivalent.functions import intervals
from trivalent.operators import neighbours, spans


def test_nearest_span_of_many_positions_far_from_the_spans(spark):
    """All positions lie behind the last span: one bucket of the spans' own edges would hold them all."""
    rows = spark.range(150_000).select("id", (F.col("id") + 1000.0).alias("pos"))
    few = spark.createDataFrame([(0.0, 10.0), (20.0, 21.0), (500.0, 900.0)], "lo double, hi double")
    begun = time.monotonic()
    got = spans.nearest_span(rows, "pos", few).agg(F.count("distance"), F.min("distance"), F.max("distance")).first()
    assert tuple(got) == (150_000, 100.0, 150_099.0)
    assert time.monotonic() - begun < 60  # quadratic: minutes


def test_range_join_of_many_short_spans_in_one_bin(spark):
    """Every position and span lies in one bin of the given width: 6 billion candidates there, but one pair a row."""
    n = 80_000
    rows = spark.range(n).select("id", (F.col("id") * 20.0 / n).alias("pos"))
    many = spark.range(n).select(F.col("id").alias("span"), (F.col("id") * 20.0 / n - 1e-6).alias("lo"), (F.col("id") * 20.0 / n + 1e-6).alias("hi"))
    begun = time.monotonic()
    got = intervals.range_join(rows, "pos", many, 25.0).agg(F.count("span"), F.count_if(F.col("id") == F.col("span"))).first()
    assert tuple(got) == (n, n)
    assert time.monotonic() - begun < 60


def test_range_join_of_spans_of_all_sizes(spark):
    """Points, endless and reversed spans, NULL ends and names on both sides."""
    rows = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 7.5), (3, None), (4, -1e9), (None, 100.0)], "id int, pos double")
    ends = [(1, 0.0, 0.0), (2, float("-inf"), 5.0), (3, 5.0, float("inf")), (4, 9.0, 1.0), (5, None, 3.0), (6, 7.5, 7.6), (7, -1e12, 1e12), (1, 0.0, 0.0)]
    held = spark.createDataFrame(ends, "name int, lo double, hi double")
    for how in ("left", "inner"):
        got = sorted((tuple(r) for r in intervals.range_join(rows, "pos", held, 2.0, how=how).select("id", "pos", "name").collect()), key=str)
        want = []
        for i, pos in [tuple(r) for r in rows.collect()]:
            hits = [k for k, lo, hi in ends if None not in (pos, lo, hi) and lo <= pos <= hi]
            want += [(i, pos, k) for k in hits] or ([(i, pos, None)] if how == "left" else [])
        assert got == sorted(want, key=str)


def test_nearest_rows_with_ties_equal_every_distance(spark):
    """Equal and nearly equal vectors far from zero, where a product of vectors cannot tell them apart."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    base = np.repeat(rng.normal(size=(30, 8)), 20, axis=0) + 1e4
    base[1::3] += rng.normal(size=base[1::3].shape) * 1e-7
    known = pd.DataFrame({"ref_id": np.arange(len(base)), "y": np.arange(len(base)) % 2, "ref_vec": list(base)})
    some = pd.DataFrame({"query_id": np.arange(60), "query_vec": list(base[::10] + rng.normal(size=(60, 8)) * 1e-8)})
    got = neighbours.k_best(some, known, 25)
    for q, v in zip(some["query_id"], some["query_vec"]):
        away = np.sqrt(((v[None, :] - base) ** 2).sum(axis=1))
        at = np.argsort(away, kind="stable")[:25]
        mine = got[got["query_id"] == q]
        assert mine["ref_id"].tolist() == at.tolist() and mine["distance"].tolist() == away[at].tolist()


def test_lists_of_rows_do_not_repeat_vectors_in_python(spark):
    """A row's lists leave Python as one array, so a worker's memory does not grow with the number of lists."""
    import numpy as np

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id int, vec array<double>")
    found = neighbours.with_lists(rows, "vec", np.array([[float(c), 1.0] for c in range(40)]), 30)
    assert found.count() == 50 and all(len(set(r["lists"])) == 30 and r["lists"][0] == min(r["id"], 39) for r in found.collect())
    assert neighbours.listed(rows, "vec", np.array([[0.0, 0.0], [9.0, 9.0]]), 5).count() == 100


def test_nested_search_computes_its_folds_once(spark, monkeypatch):
    """Candidates and folds read a stored table, not the windows that made the folds."""
    from trivalent.plans import models

    stored = []
    keep = models.materialise
    monkeypatch.setattr(models, "materialise", lambda df, *args, **more: stored.append(df.columns) or keep(df, *args, **more))
    rows = spark.createDataFrame(
        [(i % 2, i // 2 % 2, int(i % 7 < 3), float(i % 7) + i % 5 / 10) for i in range(200)], "fold int, inner_fold int, y int, x double")
    found = models.nested_search(rows, ["x"], candidates=1, inner=2, parallelism=1).collect()
    assert [r["fold"] for r in found] == [0, 1] and stored == [["fold", "inner_fold", "y", "x"]]


def test_nested_search_prepares_the_rows_of_a_fold_once(spark, monkeypatch):
    """Every setting fitted medians and scales of the same rows anew."""
    from trivalent.plans import models

    fits, fit = [], models.StandardScaler._fit
    monkeypatch.setattr(models.StandardScaler, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    rows = spark.createDataFrame(
        [(i % 2, i // 2 % 2, int(i % 7 < 3), float(i % 7) + i % 5 / 10) for i in range(200)], "fold int, inner_fold int, y int, x double")
    models.nested_search(rows, ["x"], candidates=3, inner=2)
    assert len(fits) == 2 * (2 + 1)
    for wrong in (F.lit(0), F.col("inner_fold") + 1, F.when(F.col("y") == 1, F.col("inner_fold"))):
        with pytest.raises(ValueError):
            models.nested_search(rows.withColumn("inner_fold", wrong), ["x"], candidates=1, inner=2)


def test_large_training_tables_are_held_in_even_parts(spark, monkeypatch):
    """A learner's passes ran on the parts of the scan, here a single one."""
    from trivalent.plans import models

    class Parts:
        def __init__(self, stages):
            pass

        def fit(self, df):
            return df.rdd.glom().map(len).collect()

    monkeypatch.setattr(models, "Pipeline", Parts)
    rows = spark.range(0, 30_000, 1, 1).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 2).alias("y"))
    parts = models.fit(rows, ["a"], models.logistic())
    assert len(parts) == spark.sparkContext.defaultParallelism and max(parts) - min(parts) <= 4
    monkeypatch.setattr(models, "PART_CELLS", 1_000)
    assert len(models.fit(rows, ["a"], models.logistic())) == 30
    assert models.fit(rows.limit(100), ["a"], models.logistic()) == [100]  # small ones are left as they lie


def test_fits_side_by_side_have_their_own_properties(spark):
    """One task's local properties were seen, and cleared, by the others."""
    import threading

    from trivalent.plans import models

    sc, both = spark.sparkContext, threading.Barrier(2, timeout=60)

    def set_and_read(value):
        sc.setLocalProperty("test.own", value)
        both.wait()
        return sc.getLocalProperty("test.own")

    assert models.at_once([lambda v=v: set_and_read(v) for v in ("a", "b")], 2) == ["a", "b"]
