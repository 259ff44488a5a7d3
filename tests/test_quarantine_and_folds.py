"""Quarantined records, header drift and balanced group folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivalent.operators import splits
from trivalent.sources import tables
from trivalent.streaming import scoring as streaming

LINES = ["1,a,x", "2,b", "3,c,z,extra", '4,"d, with comma",y', "5,,y", "", "6,f,", '7,"broken quote,y']


def test_rows_in_are_rows_out_and_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(["id,name,status", *LINES]) + "\n")
    (tmp_path / "in" / "b.csv").write_text("id,name,status\n8,h,y\n")
    sound, rejects = tables.read_checked(spark, str(tmp_path / "in"), ["id", "name", "status"], ["name"])
    assert {r["id"] for r in sound.collect()} >= {"1", "4", "6", "8"}
    refused = {r["record"]: r for r in rejects.collect()}
    assert sound.count() + len(refused) == 8  # the empty line is no record
    assert refused["2,b"]["reason"] == refused["3,c,z,extra"]["reason"] == "fields do not match the header"
    assert refused["5,,y"]["reason"] == "no value for name"
    assert all(r["file"].endswith("a.csv") and r["block_start"] == 0 for r in refused.values())

    stream = streaming.read_lines(spark, str(tmp_path / "in"), ["id", "name", "status"])
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    streaming.quarantine_stream(stream, ["name"], out, bad, str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(out).count() == sound.count()
    assert {r["record"] for r in spark.read.parquet(bad).collect()} == set(refused)


def test_header_drift(spark, tmp_path):
    for name, header in (("same", "id,name"), ("moved", "name,id"), ("other", "id,label"), ("spaced", '"id", name ')):
        (tmp_path / f"{name}.csv").write_text(f"{header}\n1,2\n")
    found = {r["file"].rsplit("/", 1)[1]: r for r in tables.header_drift(spark, str(tmp_path), ["id", "name"]).collect()}
    assert set(found) == {"moved.csv", "other.csv"}
    assert found["moved.csv"]["reordered"] and not found["other.csv"]["reordered"]
    assert (found["other.csv"]["missing"], found["other.csv"]["unexpected"]) == (["name"], ["label"])


def grouped(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 1, 2, 3, 5, 8]) for _ in range(150)] + [90, 60, 40, 40, 25]
    rows, i = [], 0
    for g, n in enumerate(sizes):
        rate = rng.random()
        for _ in range(n):
            rows.append((i, g if g else None, None if rng.random() < 0.1 else int(rng.random() < rate)))
            i += 1
    return rows


def spread(rows, fold_of, k):
    counts = np.zeros((k, 2))
    for _, g, y in rows:
        if y is not None:
            counts[fold_of[g], y] += 1
    return (counts / counts.sum(axis=0)).std(axis=0).mean()


@pytest.mark.parametrize("seed,most", [(1, 50_000), (2, 50_000), (3, 50_000), (1, 3)])
def test_balanced_folds_are_no_worse_than_a_greedy_choice_group_by_group(spark, seed, most):
    rows, k = grouped(seed), 5
    df = spark.createDataFrame(rows, "id long, grp int, y int").repartition(3)
    got = splits.balanced_group_folds(df, "grp", k=k, most_profiles=most).collect()
    assert len(got) == len(rows)
    fold_of = {}
    for r in got:
        assert fold_of.setdefault(r["grp"], r["fold"]) == r["fold"] and 0 <= r["fold"] < k
    again = splits.balanced_group_folds(df.repartition(7), "grp", k=k, most_profiles=most).collect()
    assert {(r["id"], r["fold"]) for r in got} == {(r["id"], r["fold"]) for r in again}
    if most == 3:
        return
    profile = {}
    for _, g, y in rows:
        p = profile.setdefault(g, [0, 0])
        if y is not None:
            p[y] += 1
    total, held, greedy = np.array([sum(p[c] for p in profile.values()) for c in (0, 1)], float), np.zeros((k, 2)), {}
    for g in sorted(profile, key=lambda g: (-sum(profile[g]), str(g))):
        options = []
        for f in range(k):
            held[f] += profile[g]
            options.append(((held / total).std(axis=0).mean(), held[f].sum(), f))
            held[f] -= profile[g]
        greedy[g] = min(options)[2]
        held[greedy[g]] += profile[g]
    assert spread(rows, fold_of, k) <= max(1.5 * spread(rows, greedy, k), 0.004)


def test_balanced_folds_of_nothing(spark):
    assert splits.balanced_group_folds(spark.createDataFrame([], "id long, grp int, y int"), "grp").count() == 0
