import uuid

from pyspark.sql import functions as F

from trivalent.operators import metrics, relations
from trivalent.plans import experiments, scoring
from trivalent.session import shared_folder
from trivalent.sources import tables
from trivalent.streaming import scoring as streaming

SF = "/root/testdata/sf0.001"


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def test_stream_equals_batch_and_keeps_rejects_apart(spark):
    source = spark.read.parquet(f"{SF}/events.parquet")
    shape = lambda df: df.select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("value").cast("string")).alias("reading"))
    scorer = lambda df: scoring.with_decision(df.withColumn("p", F.col("reading").cast("double") / 500), {"t": 0.2}, "t")
    out, rejects = scratch(spark, "out"), scratch(spark, "rejects")
    stream = shape(streaming.read_files(spark, SF, source.schema, "events.parquet"))
    query = streaming.score_stream_with_rejects(stream, scorer, ["reading"], out, rejects, scratch(spark, "log"))
    query.awaitTermination()
    batch = scorer(shape(source).where("reading IS NOT NULL"))
    assert relations.frame_differences(batch, spark.read.parquet(out)).count() == 0
    assert spark.read.parquet(rejects).count() == shape(source).where("reading IS NULL").count()


def test_label_codes_are_dense_and_in_value_order(spark):
    rows = [(i, f"v{i % 17:02d}", None if i % 5 == 0 else f"w{(i * 7) % 301:03d}") for i in range(900)]
    df = spark.createDataFrame(rows, "id int, a string, `b c` string").repartition(6)
    codes = relations.label_codes(df, ["a", "b c"])
    for column, values in (("a", {r[1] for r in rows}), ("b c", {r[2] for r in rows if r[2]})):
        got = [(r["value"], r["code"]) for r in codes.where(F.col("column") == column).orderBy("value").collect()]
        assert got == [(v, float(i)) for i, v in enumerate(sorted(values))]
    coded = relations.with_codes(df, codes, ["a", "b c"])
    assert coded.count() == 900 and dict(coded.dtypes)["b c"] == "double"


def test_careless_encoding_drops_untrusted_columns(spark):
    df = spark.createDataFrame([(1, "x", "y", "z", "no")], "id int, Exon string, `Year Reported` string, Comments string, `History of Inhibitor` string")
    _, kept = experiments.encode_everything(df, "History of Inhibitor")
    assert kept == ["Exon"]


def test_corner_threshold_is_the_end_of_a_straight_run(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.4)], "y int, p double")
    assert metrics.sensitivity_threshold(df, 0.5).first()[0] == 0.8
    for splits in ([], [0.75], [0.55, 0.65, 0.75, 0.85]):
        assert metrics.sensitivity_threshold(df, 0.5, corners=True, splits=splits).first()[0] == 0.7
        points = {r["threshold"] for r in metrics.roc_points(df, corners=True, splits=splits).collect()}
        assert points == {0.9, 0.7, 0.6, 0.5, 0.4}


def test_untidy_csv_reads_clean(spark):
    path = scratch(spark, "csv")
    spark.createDataFrame([("c.1A>G", "Yes", "q"), ("c.1A>G", "Yes", "q"), ("c.2C>T", "Not reported", "q"), (None, None, None)],
                          "`HGVS  cDNA ` string, `History of\tInhibitor` string, `Unnamed: 7` string").write.option("header", True).csv(path)
    df = tables.load_catalogue(spark, path)
    assert df.columns == ["HGVS cDNA", "History of Inhibitor", "inhibitor", "gene"]
    assert sorted(map(tuple, df.select("HGVS cDNA", "inhibitor").collect()), key=repr) == [("c.1A>G", 1), ("c.2C>T", None)]


def test_blank_records_and_aliases(spark):
    df = spark.createDataFrame([("", " "), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(scoring.is_empty(["x", "y"])).collect()] == [True, False]
    assert tables.find_column(["hgvs cdna", "Exon"], ["HGVS cDNA Name", "HGVS cDNA"]) == "hgvs cdna"
    assert tables.find_column(["Exon"], ["Domain"]) is None
