"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

ASCII_SPACE = r"[ \t-\r]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text``; a null text is the empty text. Other columns are left behind."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")
    )


def map_texts(docs: DataFrame, schema: str, per_batch: Callable[[list[str]], dict[str, list]]) -> DataFrame:
    """One output row per row of ``docs`` (doc_id, text): doc_id and the columns ``per_batch`` returns for the texts."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = per_batch(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(v if isinstance(v, pa.Array) else pa.array(v) for v in made.values())],
                names=["doc_id", *made],
            )

    return docs.mapInArrow(run, "doc_id long, " + schema)


def by_bytes(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of ``texts`` of about ``most`` characters each; one longer text is a run of its own."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
