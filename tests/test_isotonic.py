"""Distributed isotonic regression and as-of lookups against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from trivalent.operators import isotonic, ordered
from trivalent.plans.models import Calibrator


def pooled(cells):
    """Pool adjacent violators over (x, positives, rows), one stack."""
    stack = []
    for x, s, w in cells:
        stack.append([s, w, [x]])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            s2, w2, xs = stack.pop()
            stack[-1][0] += s2
            stack[-1][1] += w2
            stack[-1][2] += xs
    return {x: s / w for s, w, xs in stack for x in xs}


def cells_of(rows):
    table = {}
    for p, y in rows:
        if y is not None and p is not None:
            s, w = table.get(p, (0, 0))
            table[p] = (s + y, w + 1)
    return [(x, *table[x]) for x in sorted(table)]


SHAPES = {
    "rising": lambda rng, x: rng.random() < x,
    "falling": lambda rng, x: rng.random() > x,
    "wave": lambda rng, x: rng.random() < (0.2 if int(x * 10) % 2 else 0.8),
    "steps": lambda rng, x: x > 0.5,
}


@pytest.mark.parametrize("shape,stretch", [("rising", 3), ("falling", 3), ("wave", 3), ("wave", 50_000), ("steps", 50_000)])
def test_steps_equal_pooled_violators(spark, shape, stretch):
    rng = random.Random(shape)
    rows = [(round(x, 3), int(SHAPES[shape](rng, x))) for x in (rng.random() for _ in range(3000))]
    rows += [(0.25, 1)] * 1000 + [(0.7, None), (None, 1)]  # a hot score, an unknown label, no score
    df = spark.createDataFrame(rows, "p double, y int").repartition(3)
    fitted = isotonic.Isotonic.fit(df, stretch=stretch)
    got = {r["p"]: r["isotonic"] for r in fitted.transform(df.select("p").distinct()).collect()}
    want = pooled(cells_of(rows))
    assert got.pop(None) is None
    assert {x: got[x] for x in want} == pytest.approx(want, abs=1e-12)  # 0.7 may have no label


def test_long_stretches_are_cut_and_solid_ones_found(spark):
    rng = random.Random(1)
    rows = [(i / 4000, int(rng.random() < (i / 4000) ** 2)) for i in range(4000)]
    rows += [(2 + i / 4000, i % 2 if i < 2000 else 0) for i in range(4000)]  # one block over many buckets
    points = isotonic.corners(spark.createDataFrame(rows, "p double, y int"), "p", "y")
    edges, solid = isotonic.cuts(points, 10)
    placed = ordered.with_bucket(points, "w", [w for w, _ in edges], "stretch")
    sizes = {r["stretch"]: r["count"] for r in placed.groupBy("stretch").count().collect()}
    assert len(edges) > 5
    assert all(n <= 10 or edges[i - 1][0] in solid for i, n in sizes.items())


def test_scores_between_and_beyond_the_steps(spark):
    df = spark.createDataFrame([(0.2, 0), (0.3, 0), (0.6, 1), (0.8, 1)], "p double, y int")
    asked = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.45, 0.6, 0.9)], "p double")
    got = {r["p"]: r["isotonic"] for r in isotonic.Isotonic.fit(df).transform(asked).collect()}
    assert got == pytest.approx({0.0: 0.0, 0.25: 0.0, 0.45: 0.5, 0.6: 1.0, 0.9: 1.0})


def test_no_labelled_rows(spark):
    empty = spark.createDataFrame([(0.5, None)], "p double, y int")
    fitted = isotonic.Isotonic.fit(empty)
    assert fitted.steps.count() == 0
    assert [r["isotonic"] for r in fitted.transform(empty).collect()] == [None]


def test_calibrator_saves_and_loads(spark, tmp_path):
    rng = random.Random(2)
    rows = [(x, int(rng.random() < x)) for x in (round(rng.random(), 4) for _ in range(500))]
    df = spark.createDataFrame(rows, "p double, y int")
    fitted = Calibrator.fit(df)
    fitted.save(str(tmp_path / "c"))
    again = Calibrator.load(spark, str(tmp_path / "c"))
    order = lambda c: sorted(tuple(r) for r in c.transform(df).select("p", "calibrated").collect())
    assert order(fitted) == order(again)
    assert all(fitted.lo <= c <= fitted.hi for _, c in order(fitted))


@pytest.mark.parametrize("backwards", [False, True])
def test_carried_equals_a_scan(spark, backwards):
    rng = random.Random(4)
    given = {(k, rng.randrange(1000)): rng.randrange(10**6) for k in "ab" for _ in range(40)}
    rows = [(k, float(v), p) for (k, v), p in given.items()] + [(k, float(v), None) for k in "abc" for v in range(-5, 1005, 7)]
    df = spark.createDataFrame(rows, "k string, v double, pay long").repartition(4)
    got = ordered.carried(df, "v", "pay", [100.0, 110.0, 500.0, 900.0], ["k"], backwards).where(F.col("pay").isNull()).collect()
    for r in got:
        own = [(v, p) for (k, v), p in given.items() if k == r["k"] and (v >= r["v"] if backwards else v <= r["v"])]
        assert r["pay_carried"] == ((min if backwards else max)(own)[1] if own else None)
