import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivalent.operators import metrics, ordered, stats, strata


def frame(spark, n=900, ties=200, partitions=3):
    rows = []
    for i in range(n):
        h = (i * 2654435761) % 10007
        y = 1 if h % 5 == 0 else (None if h % 17 == 0 else 0)
        p = ((h * 31 + (40 * 31 if y == 1 else 0)) % ties) / ties
        rows.append((i, y, p, (h * 17 % 997) / 997, h % 3))
    return spark.createDataFrame(rows, "id long, y int, p double, q double, g int").repartition(partitions), rows


def brute_auc(rows, score=2):
    pos = [r[score] for r in rows if r[1] == 1]
    neg = [r[score] for r in rows if r[1] == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)


def test_auc_matches_pair_counting_for_any_buckets(spark):
    df, rows = frame(spark)
    want = brute_auc(rows)
    for splits in ([], [0.5], [0.001 * i for i in range(1, 900)], None):
        assert metrics.roc_auc(df, splits=splits).first()[0] == pytest.approx(want)


def test_partition_count_does_not_change_curves(spark):
    a, _ = frame(spark, partitions=1)
    b, _ = frame(spark, partitions=7)
    get = lambda d: sorted(map(tuple, metrics.score_curve(d, by=["g"]).collect()))
    assert get(a) == get(b)


def test_perfect_inverted_and_clean_split(spark):
    perfect = spark.createDataFrame([(y, float(y), 1.0 - y) for y in (0, 0, 0, 1, 1, 1)], "y int, p double, r double")
    assert metrics.roc_auc(perfect).first()[0] == 1 and metrics.roc_auc(perfect, score="r").first()[0] == 0
    clean = spark.createDataFrame([(0, 0.1)] * 50 + [(1, 0.9)] * 50, "y int, p double")
    row = metrics.summary(clean).first()
    assert row["threshold"] == 0.9 and row["accuracy"] == 1 and row["mcc"] == pytest.approx(1)
    flat = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double")
    assert metrics.youden_threshold(flat).first()[0] == math.inf


def test_average_precision_and_confusion(spark):
    df, rows = frame(spark)
    known = [r for r in rows if r[1] is not None]
    scores = sorted({r[2] for r in known}, reverse=True)
    total, last, ap = sum(r[1] for r in known), 0, 0.0
    for t in scores:
        tp, n = sum(r[1] for r in known if r[2] >= t), sum(r[2] >= t for r in known)
        ap += (tp - last) / total * tp / n
        last = tp
    row = metrics.summary(df, threshold=0.5).first()
    assert row["auc_pr"] == pytest.approx(ap)
    assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == row["n"] == len(known)
    assert row["brier"] == pytest.approx(np.mean([(r[2] - r[1]) ** 2 for r in known]))


def test_net_benefit_closed_form(spark):
    df = spark.createDataFrame([(y, 1.0) for y in (0, 1, 0, 1, 0, 0, 1, 0, 0, 0)], "y int, p double")
    row = metrics.decision_curve(df, [0.2]).first()
    assert row["model"] == pytest.approx(0.3 - 0.7 * 0.25) and row["treat_all"] == pytest.approx(row["model"])


def test_thresholds_by_brute_force(spark):
    df, rows = frame(spark)
    known = [r for r in rows if r[1] is not None]
    grid = sorted({round(r[2], 3) for r in known})
    best = max(grid, key=lambda t: sum((r[2] >= t) == (r[1] == 1) for r in known))
    assert metrics.accuracy_threshold(df).first()[0] == pytest.approx(best)
    pos = [r[2] for r in known if r[1] == 1]
    want = max(t for t in {r[2] for r in known} if sum(p >= t for p in pos) / len(pos) >= 0.9)
    assert metrics.sensitivity_threshold(df, 0.9).first()[0] == want


def test_calibration_curve_counts_edges_twice(spark):
    df, rows = frame(spark)
    known = [r for r in rows if r[1] is not None]
    p, y = np.array([r[2] for r in known]), np.array([r[1] for r in known])
    edges = np.unique(np.quantile(p, np.linspace(0, 1, 11)))
    want = [(int(m.sum()), p[m].mean(), y[m].mean()) for lo, hi in zip(edges, edges[1:]) for m in [(p >= lo) & (p <= hi)] if m.sum() >= 5]
    got = [(r["n"], r["predicted"], r["observed"]) for r in metrics.calibration_curve(df).orderBy("bin").collect()]
    assert np.allclose(got, want)


def test_small_strata_have_null_metrics(spark):
    df, _ = frame(spark)
    rows = {r["stratum"]: r for r in strata.stratum_report(df, {"all": F.lit(True), "few": F.col("id") < 20}, 0.5).collect()}
    assert rows["all"]["auc_roc"] is not None and rows["few"]["auc_roc"] is None and "too few" in rows["few"]["note"]


def test_quantiles_ranks_and_density(spark):
    df, rows = frame(spark)
    p = np.array([r[2] for r in rows])
    got = {r["prob"]: r["value"] for r in ordered.quantiles(df, "p", [0.05, 0.5, 0.93]).collect()}
    assert all(got[q] == pytest.approx(np.quantile(p, q)) for q in got)
    pts = df.withColumn("pos", F.floor(F.col("q") * 300).cast("double"))
    at = [r["pos"] for r in pts.collect()]
    for row in ordered.neighbour_count(pts, pts, "pos", [5, 40]).collect():
        for w in (5, 40):
            assert row[f"within_{w}"] == sum(abs(a - row["pos"]) <= w for a in at) - 1


def test_density_of_an_unseen_position_is_not_negative(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,)], "pos double")
    ask = spark.createDataFrame([(500.0,), (None,)], "pos double")
    assert [r["within_50"] for r in ordered.neighbour_count(ref, ask, "pos", [50]).collect()] == [0]


def test_share_does_not_depend_on_the_batch(spark):
    df, _ = frame(spark)
    ask = df.where("id IN (3, 77, 500)")
    together = {r["p"]: r["share"] for r in ordered.share_at_or_below(df, ask, "p").collect()}
    for i in (3, 77, 500):
        alone = ordered.share_at_or_below(df, df.where(F.col("id") == i), "p").first()
        assert alone["share"] == together[alone["p"]]


def test_null_keys_are_ordinary_groups(spark):
    df, rows = frame(spark)
    keyed = df.withColumn("k", F.when(F.col("g") == 0, None).otherwise(F.col("g")))
    got = {r["k"]: r["auc_roc"] for r in metrics.roc_auc(keyed, by=["k"]).collect()}
    assert set(got) == {None, 1, 2}
    assert got[None] == pytest.approx(brute_auc([r for r in rows if r[4] == 0]))


def test_delong_against_numpy(spark):
    df, rows = frame(spark)
    known = [r for r in rows if r[1] is not None]
    pos, neg = [r for r in known if r[1] == 1], [r for r in known if r[1] == 0]
    v10 = np.array([[np.mean([(a[s] > b[s]) + 0.5 * (a[s] == b[s]) for b in neg]) for a in pos] for s in (2, 3)])
    v01 = np.array([[np.mean([(a[s] > b[s]) + 0.5 * (a[s] == b[s]) for a in pos]) for b in neg] for s in (2, 3)])
    cov = np.cov(v10) / len(pos) + np.cov(v01) / len(neg)
    diff = v10[0].mean() - v10[1].mean()
    z = diff / math.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    got = stats.paired_auc_test(df).first()
    assert got["z"] == pytest.approx(z) and got["delta"] == pytest.approx(diff)
    assert got["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    same = stats.paired_auc_test(df.withColumn("q", F.col("p"))).first()
    assert same["p_value"] == 1 and same["delta"] == 0


def test_chi_square_tail():
    assert stats.chi_square_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_p(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_p(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_p(11.070498, 5) == pytest.approx(0.05, abs=1e-6)


def test_mann_whitney_links_to_auc(spark):
    df, rows = frame(spark)
    row = stats.mann_whitney(df, "p").first()
    assert row["u"] == pytest.approx(brute_auc(rows) * row["n1"] * row["n2"]) and 0 <= row["p_value"] <= 1


def test_bootstrap_brackets_and_repeats(spark):
    df, _ = frame(spark)
    a = stats.bootstrap_interval(df, n_boot=80).first()
    b = stats.bootstrap_interval(df.repartition(5), n_boot=80).first()
    assert a["lo"] < a["point"] < a["hi"] and a["n_boot"] == 80 and tuple(a) == tuple(b)


def test_chi_square_tail_at_small_and_large_tables():
    import math

    from trivalent.operators.stats import chi_square_p

    assert chi_square_p(0.0, 3) == 1.0
    assert math.isclose(chi_square_p(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(chi_square_p(4.0, 2), math.exp(-2), rel_tol=1e-12)
    assert math.isclose(chi_square_p(67.50480654954, 50), 0.05, rel_tol=1e-6)
    assert abs(chi_square_p(2000, 2000) - 0.4958) < 1e-3 and abs(chi_square_p(1600, 1601) - 0.503) < 1e-2
    assert 0.49 < chi_square_p(20000, 20000) < 0.5 and chi_square_p(30000, 2000) == 0.0


def test_one_class_keys_give_nulls(spark):
    from trivalent.operators import stats

    rows = [(1, "a", 1, 0.2, 0.3), (2, "a", 1, 0.4, 0.1), (3, "b", 1, 0.5, 0.2), (4, "b", 0, 0.1, 0.6), (5, "b", 0, 0.7, 0.4)]
    df = spark.createDataFrame(rows, "id long, s string, y int, p double, q double")
    one = df.where("s = 'a'")
    found = {r.s: r for r in stats.mann_whitney(df, "p", by=["s"]).collect()}
    assert found["a"].z is None and found["a"].p_value is None and found["b"].z is not None
    assert stats.chi_square(one, "id").first().p_value is None
    test = stats.paired_auc_test(one).first()
    assert test.z is None and test.p_value is None
    lone = stats.paired_auc_test(df.where("s = 'b'")).first()
    assert lone.auc_a is not None and lone.z is None


def test_chi_square_of_a_wide_category(spark):
    from trivalent.operators import stats

    df = spark.range(6000).selectExpr("id % 2000 AS k", "CAST(id % 3 = 0 AS INT) AS y")
    assert 0.0 <= stats.chi_square(df, "k").first().p_value <= 1.0
    even = spark.range(8000).selectExpr("id % 2000 AS k", "CAST(id >= 4000 AS INT) AS y")
    assert stats.chi_square(even, "k").first().p_value > 0.99
