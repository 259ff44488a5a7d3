"""Online scoring: the batch expressions on a stream, with rejects kept apart.

Scoring is row-wise, so the stream holds no state and needs no watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import is_empty
from ..sources import tables

Scorer = Callable[[DataFrame], DataFrame]


def read_files(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, per_trigger: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def score_stream(stream: DataFrame, scorer: Scorer, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows to Parquet; exactly-once through the file sink's log."""
    return (
        scorer(stream).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def score_stream_with_rejects(stream: DataFrame, scorer: Scorer, fields: Sequence[str], path: str, rejects: str,
                              checkpoint: str) -> StreamingQuery:
    """Records with every field blank go to a reject table, the rest are scored.

    A batch writes under its own id, so a batch that is run again after a
    failure replaces its output.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        blank = is_empty(fields)
        batch.persist(StorageLevel.MEMORY_AND_DISK)  # both writes read the batch
        scorer(batch.where(~blank)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.where(blank).withColumn("reason", F.lit("no usable field")).write.mode("overwrite").parquet(
            f"{rejects}/batch={batch_id}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def read_lines(spark: SparkSession, folder: str, columns: Sequence[str], per_trigger: int = 100) -> DataFrame:
    """CSV files with a header as they come, for :func:`quarantine_stream`."""
    reader = spark.readStream.schema(tables.checked_schema(columns)).option("maxFilesPerTrigger", per_trigger)
    reader = reader.option("header", True).option("escape", '"').option("columnNameOfCorruptRecord", tables.CORRUPT)
    return tables.with_origin(reader.csv(folder))


def quarantine_stream(stream: DataFrame, required: Sequence[str], path: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Sound rows to one table and the others, with reason and origin, to another; a batch run again replaces its output."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)  # both writes read the batch
        sound, refused = tables.sound_and_rejected(batch, required)
        sound.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        refused.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
