"""Span joins and exact bootstrap intervals against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivalent.operators import spans, stats


def span_table(rng, n, reach):
    return [(i, float(a), float(a + rng.choice([0, 0.5, 3, reach]))) for i, a in enumerate(rng.sample(range(1000), n))]


@pytest.mark.parametrize("top", [16, 2])
def test_span_join_equals_brute_force_with_hot_rows_and_spans(spark, monkeypatch, top):
    monkeypatch.setattr(spans, "TOP", top)  # 2: nodes of four ranks at most
    rng = random.Random(top)
    table = span_table(rng, 60, 200) + [(900, -1e9, 1e9), (901, 5.0, 4.0), (902, None, 7.0), (903, 500.0, 500.0)]
    table += [(1000 + i, 300.0, 310.0) for i in range(30)]  # one span many times
    rows = [(i, rng.choice([rng.uniform(-5, 1300), float(rng.randrange(1000))])) for i in range(300)]
    rows += [(1000 + i, 305.0) for i in range(150)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id long, pos double").repartition(4)
    held = spark.createDataFrame(table, "span int, lo double, hi double").repartition(3)
    want = {(i, s) for i, p in rows for s, lo, hi in table if p is not None and lo is not None and lo <= p <= hi}
    got = [(r["id"], r["span"]) for r in spans.span_join(df, "pos", held, how="inner").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = spans.span_join(df, "pos", held)
    assert left.columns == ["id", "pos", "span", "lo", "hi"]
    assert {r["id"] for r in left.where("span IS NULL").collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_span_over_everything_is_cut_into_bounded_nodes(spark, monkeypatch):
    monkeypatch.setattr(spans, "TOP", 3)
    df = spark.range(1).select(spans.nodes(spans.F.lit(3).cast("long"), spans.F.lit(60).cast("long")).alias("n"))
    found = [(x["level"], x["node"]) for x in df.first()["n"]]
    assert sorted(r for level, node in found for r in range(node << level, (node + 1) << level)) == list(range(3, 61))
    assert max(level for level, _ in found) == 3


def test_span_join_stores_no_pairs(spark, monkeypatch):
    stored, real = {}, spans.materialise

    def counted(df, label="table", *args, **kwargs):
        found = real(df, label, *args, **kwargs)
        stored[label] = found.count()
        return found

    monkeypatch.setattr(spans, "materialise", counted)
    df = spark.range(300).select("id", (F.col("id") + 0.5).alias("pos"))
    held = spark.range(300).select(F.col("id").alias("span"), (F.col("id") * -1.0).alias("lo"), (F.col("id") + 300.0).alias("hi"))
    assert spans.span_join(df, "pos", held).count() == 300 * 300
    assert max(stored.values()) < 20 * 300, stored


@pytest.mark.parametrize("how", ["left", "inner"])
def test_span_join_of_nodes_too_many_to_replicate(spark, monkeypatch, how):
    monkeypatch.setattr(spans, "SMALL", 0)
    monkeypatch.setattr(spans, "PAIRS", 40)
    rng = random.Random(5)
    table = span_table(rng, 60, 200) + [(900 + i, -1e9, 1e9) for i in range(5)] + [(990, None, 7.0)]
    rows = [(i, rng.uniform(-5, 1300)) for i in range(200)] + [(1000 + i, 305.0) for i in range(150)] * 2 + [(5000, None), (5001, 2e9)]
    df = spark.createDataFrame(rows, "id long, pos double").repartition(4)
    held = spark.createDataFrame(table, "span int, lo double, hi double").repartition(3)
    want = [(i, s) for i, p in rows for s, lo, hi in table if p is not None and lo is not None and lo <= p <= hi]
    want += [(i, None) for i, p in rows if how == "left" and (p is None or p == 2e9)]
    found = [(r["id"], r["span"]) for r in spans.span_join(df, "pos", held, how=how).collect()]
    key = lambda x: (x[0], -1 if x[1] is None else x[1])
    assert sorted(found, key=key) == sorted(want, key=key)


def test_span_join_rows_carry_no_lists_of_nodes(spark, monkeypatch):
    """Rows were dealt out with the list of all nodes over them, many times their own size."""
    stored, keep = [], spans.materialise
    monkeypatch.setattr(spans, "materialise", lambda df, *more: stored.extend(df.dtypes) or keep(df, *more))
    rows = spark.range(50).select("id", (F.col("id") % 20).cast("double").alias("pos"), F.lit(0).alias("rank"))
    held = spark.createDataFrame([(i, float(i), float(i + 7)) for i in range(15)], "span int, lo double, hi double")
    got = spans.span_join(rows, "pos", held)
    assert ("_rank", "bigint") in stored and not [t for _, t in stored if t.startswith("array")]
    want = sorted((r["id"], r["rank"], i) for r in rows.collect() for i in range(15) if i <= r["pos"] <= i + 7)
    assert sorted((r["id"], r["rank"], r["span"]) for r in got.where("span IS NOT NULL").collect()) == want


def test_span_join_without_spans(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, pos double")
    none = spark.createDataFrame([], "span int, lo double, hi double")
    assert [tuple(r) for r in spans.span_join(df, "pos", none).collect()] == [(1, 2.0, None, None, None)]
    assert spans.nearest_span(df, "pos", none).first()["distance"] is None


def test_nearest_span_equals_brute_force(spark):
    rng = random.Random(8)
    table = [(k, *x[1:]) for k in "ab" for x in span_table(rng, 40, 60)] + [("c", 5.0, 4.0)]
    rows = [(i, rng.choice("abc"), rng.choice([None, rng.uniform(-50, 1200), float(rng.randrange(1000))])) for i in range(400)] + [(900 + i, "a", 7.25) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, pos double").repartition(4)
    held = spark.createDataFrame(table, "k string, lo double, hi double")
    got = {r["id"]: r["distance"] for r in spans.nearest_span(df, "pos", held, by=["k"]).collect()}
    assert len(got) == len(rows)
    for i, k, p in rows:
        own = [max(lo - p, p - hi, 0) for k2, lo, hi in table if k2 == k and lo <= hi] if p is not None else []
        assert got[i] == (pytest.approx(min(own)) if own else None)


def curve(rows):
    pos, neg = [p for p, y in rows if y == 1], [p for p, y in rows if y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    ap, best = 0.0, (0.0, 0.0)
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        ap += sum(p == t for p in pos) * tp / (tp + fp) / len(pos)
        if tp / len(pos) - fp / len(neg) > best[0]:
            best = (tp / len(pos) - fp / len(neg), tp / len(pos))
    return {"auc_roc": auc, "auc_pr": ap, "sensitivity": best[1]}


def test_exact_bootstrap_points_and_repeats(spark):
    rng = random.Random(2)
    rows = [(round(rng.gauss(y * 0.8, 1), 2), y) for y in (rng.random() < 0.4 for _ in range(400))]
    rows = [(p, int(y)) for p, y in rows] + [(0.1, None), (None, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    found = {r["metric"]: r for r in stats.exact_bootstrap(df, n_boot=400).collect()}
    again = {r["metric"]: r for r in stats.exact_bootstrap(df.repartition(7), n_boot=400).collect()}
    want = curve([(p, y) for p, y in rows if y is not None and p is not None])
    for name, r in found.items():
        assert r["point"] == pytest.approx(want[name]) and r["lo"] < r["point"] < r["hi"] and r["n_boot"] == 400
        assert (r["lo"], r["hi"]) == pytest.approx((again[name]["lo"], again[name]["hi"]), abs=1e-12)
    # The spread is that of drawing rows.
    known = [x for x in rows if None not in x]
    drawn = []
    numbers = np.random.default_rng(1)
    by_class = [[x for x in known if x[1] == c] for c in (0, 1)]
    for _ in range(150):
        drawn.append(curve([c[i] for c in by_class for i in numbers.integers(0, len(c), len(c))])["auc_roc"])
    assert found["auc_roc"]["hi"] - found["auc_roc"]["lo"] == pytest.approx(np.subtract(*np.percentile(drawn, [97.5, 2.5])), rel=0.25)


def test_exact_bootstrap_of_degenerate_tables(spark):
    rows = [("one class", 0.3, 1), ("one class", 0.4, 1), ("apart", 0.9, 1), ("apart", 0.1, 0), ("tied", 0.5, 1), ("tied", 0.5, 0)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    found = {(r["g"], r["metric"]): r for r in stats.exact_bootstrap(df, n_boot=200, by=["g"]).collect()}
    lone = found["one class", "auc_roc"]
    assert (lone["point"], lone["lo"], lone["hi"], lone["n_boot"]) == (None, None, None, 0)
    for name in ("auc_roc", "auc_pr", "sensitivity"):  # every replicate with both classes has the same value
        r = found["apart", name]
        assert (r["point"], r["lo"], r["hi"]) == (1, 1, 1) and 0 < r["n_boot"] < 200
    assert found["tied", "auc_roc"]["point"] == 0.5 and found["tied", "sensitivity"]["point"] == 0
    fixed = {r["metric"]: r["point"] for r in stats.exact_bootstrap(df.where("g = 'apart'"), n_boot=10, threshold=0.95).collect()}
    assert fixed["sensitivity"] == 0
