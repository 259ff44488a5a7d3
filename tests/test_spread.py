"""Heavy work reaches every core whatever the files' sizes, and is done once."""

from __future__ import annotations

from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import functions as F

from trivalent.plans import models, stages
from trivalent.queries.bindings import MEMBERS
from trivalent.session import spread


def test_a_small_scan_is_dealt_to_every_core_and_a_wide_one_is_left(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("id") % 3)).coalesce(1).write.parquet(f"{tmp_path}/t")
    one = spark.read.parquet(f"{tmp_path}/t")
    dealt = spread(one)
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() == cores
    assert dealt.exceptAll(one).isEmpty() and one.exceptAll(dealt).isEmpty()
    wide = spark.range(0, 10, numPartitions=cores)
    assert spread(wide) is wide


def test_busy_frames_have_the_same_rows(spark, tmp_path):
    spark.range(50).selectExpr(
        "id AS o_orderkey", "id % 9 AS o_custkey", "CASE id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' END AS o_orderstatus",
        "CASE WHEN id % 8 <> 0 THEN id * 10.5D END AS o_totalprice").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    plain, busy = MEMBERS.frame(spark, str(tmp_path)), MEMBERS.frame(spark, str(tmp_path), busy=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, busy.collect()))
    assert busy.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_calibrated_scores_compute_their_rows_once(spark):
    known = spark.range(60).selectExpr("id", "(id % 20) / 20 AS p", "CAST((id * 7) % 3 = 0 AS INT) AS y")
    calibrator = models.Calibrator.fit(known, bounded=False)
    computed = spark.sparkContext.accumulator(0)

    @F.udf(VectorUDT())
    def probability(p):
        computed.add(1)
        return DenseVector([1 - p, p])

    scored = stages.CalibratedScore(calibrator, ["id"]).transform(known.select("id", probability("p").alias("probability")))
    found = {r.id: r.p for r in scored.collect()}
    assert computed.value == 60
    assert found == {r.id: r.calibrated for r in calibrator.transform(known).collect()}
