import pytest
from pyspark.sql import functions as F

from trivalent.operators import aggregates, neighbours, quality, relations, splits


def people(spark, n=1000, partitions=4):
    rows = [(i, (None if i % 7 == 0 else int(i % 5 == 0)), i % 61 if i % 3 else 5, None if i % 50 == 0 else float(i * 13 % 200)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, grp int, pos double").repartition(partitions)


@pytest.mark.parametrize("make", [
    lambda d: splits.stratified_holdout(d, "id"),
    lambda d: splits.group_holdout(d, "grp"),
    lambda d: splits.stratified_folds(d, "id"),
    lambda d: splits.group_folds(d, "grp"),
    lambda d: splits.position_blocks(d, "pos", "id"),
    lambda d: splits.permute(d, ["y"], "id")])
def test_splits_ignore_partitioning_and_keep_every_row(spark, make):
    get = lambda d: sorted(map(tuple, make(d).collect()), key=repr)
    first = get(people(spark, partitions=1))
    assert first == get(people(spark, partitions=6)) and len(first) == 1000


def test_folds_balance_every_class(spark):
    for row in splits.stratified_folds(people(spark), "id").groupBy("y").pivot("fold").count().collect():
        sizes = row[1:]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_group_folds_never_straddle_and_hold_positives(spark):
    folds = splits.group_folds(people(spark), "grp")
    assert relations.straddling_groups(folds, "grp", "fold").count() == 0
    assert all(r["pos"] > 0 for r in folds.groupBy("fold").agg(F.count_if(F.col("y") == 1).alias("pos")).collect())


def test_blocks_are_contiguous_and_even(spark):
    blocks = splits.position_blocks(people(spark), "pos", "id", 10)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert sizes == [100] * 10
    spans = blocks.where("pos IS NOT NULL").groupBy("block").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).orderBy("block").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(spans, spans[1:]))


def test_one_position_holding_a_third_of_rows_is_divided(spark):
    df = spark.range(900).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("pos"))
    sizes = [r["count"] for r in splits.position_blocks(df, "pos", "id", 9).groupBy("block").count().collect()]
    assert sizes == [100] * 9


def test_permutation_keeps_the_multiset(spark):
    df = people(spark)
    shuffled = splits.permute(df, ["y"], "id")
    count = lambda d: sorted(map(tuple, d.groupBy("y").count().collect()), key=repr)
    assert count(df) == count(shuffled)
    assert relations.frame_differences(df, shuffled).count() > 0


def test_oversampling_evens_classes_and_leaks(spark):
    df = people(spark)
    sizes = {r["y"]: r["count"] for r in splits.oversample_minority(df.select("id", "y"), "id").groupBy("y").count().collect()}
    assert sizes[0] == sizes[1]


def test_dimension_with_repeated_keys_is_refused(spark):
    facts = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        relations.join_dimension(facts, spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), "k")


def test_overlap_treats_missing_as_equal(spark):
    a = spark.createDataFrame([("x", None), ("y", 1.0), ("z", None)], "e string, pos double")
    b = spark.createDataFrame([("x", None), ("y", 2.0)], "e string, pos double")
    assert [r["e"] for r in relations.overlap(a, b, ["e", "pos"]).collect()] == ["x"]
    assert sorted(r["e"] for r in relations.overlap(a, b, ["e", "pos"], shared=False).collect()) == ["y", "z"]


def test_adoption_respects_the_caps(spark):
    pool = spark.range(1000).select("id", (F.col("id") / 1000).alias("p"))
    rows = relations.adopt_confident(pool, 0.2, per_round=100).collect()
    assert sum(r["y"] for r in rows) == 20 and len(rows) == 71  # only 51 rows lie at or under 0.05


def test_discordance_and_relabelling(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (3, 1), (4, None)], "g int, y int")
    row = aggregates.discordance(df, "g").first()
    assert (row["groups_2plus"], row["discordant_groups"], row["rows_in_discordant"]) == (2, 1, 2)
    cost = aggregates.relabel_cost(df, "g").first()
    assert cost["n_called_negative_unrecorded"] == 1 and cost["prevalence_relabelled"] == 0.5


def test_nearest_neighbours_equal_brute_force(spark):
    vec = lambda i: [float((i * k * 37) % 101) / 10 for k in range(1, 6)]
    refs = spark.createDataFrame([(i, vec(i), i % 2) for i in range(300)] + [(900 + i, vec(7), 1) for i in range(40)], "id long, vec array<double>, y int")
    asks = spark.createDataFrame([(i, vec(i * 3 + 1)) for i in range(25)] + [(99, vec(7))], "id long, vec array<double>")
    got = {}
    for r in neighbours.nearest(refs, asks, k=9, query_block=10, reference_block=64).collect():
        got.setdefault(r["query_id"], []).append((round(r["distance"], 9), r["ref_id"]))
    table = [(r["id"], r["vec"]) for r in refs.collect()]
    for a in asks.collect():
        want = sorted((round(sum((x - y) ** 2 for x, y in zip(a["vec"], v)) ** 0.5, 9), i) for i, v in table)[:9]
        assert sorted(got[a["id"]]) == want


def test_quality_checks_catch_what_they_should(spark):
    df = people(spark).withColumn("f", F.col("id").cast("double"))
    assert not quality.no_identifiers(df.select("f", "y"), ["f"]).first()["passed"]
    assert not quality.label_proxies(df.withColumn("f", F.col("y").cast("double")), ["f"]).first()["passed"]
    bad = df.withColumn("f", F.lit(float("nan")))
    assert not quality.finite_matrix(bad, ["f"]).first()["passed"]
    leaky = df.withColumn("is_test", F.col("id") % 2 == 0)
    assert not quality.split_hygiene(leaky, "grp", ["id"]).first()["passed"]
    states = quality.roll_up([quality.finite_matrix(df, ["f"]), quality.finite_matrix(bad, ["f"])])
    assert sorted(r["state"] for r in states.collect()) == ["fail", "pass"]
    assert not quality.label_blind(df, "id", ["y"], lambda d: d.select("id", "y")).first()["passed"]
    assert quality.label_blind(df, "id", ["y"], lambda d: d.select("id", "pos")).first()["passed"]


def test_splits_do_not_depend_on_the_digits_counted(spark, monkeypatch):
    from trivalent.operators import splits

    df = spark.range(3000).selectExpr("id", "CAST(id % 3 = 0 AS INT) AS y", "CAST(id % 40 AS DOUBLE) AS pos")

    def everything():
        folds = {r["id"]: r["fold"] for r in splits.stratified_folds(df, "id").collect()}
        blocks = {r["id"]: r["block"] for r in splits.position_blocks(df, "pos", "id", n_blocks=7).collect()}
        order = {r["id"]: r["order"] for r in splits.hash_order(df, "id", 1).collect()}
        return folds, blocks, order

    first = everything()
    assert sorted(first[2].values()) == list(range(3000))
    for levels in ((1, 2), (1, 5), (2, 3, 4)):
        monkeypatch.setattr(splits, "LEVELS", levels)
        assert everything() == first
