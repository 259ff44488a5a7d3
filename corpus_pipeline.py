"""From documents to token ids: five stages, each over all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.llm import bpe, decontamination, line_dedup, line_quality, similar
from trivalent.llm.common import read
from trivalent.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, fitted on the labelled ones among them, accepts."""
    return line_quality.keep_good(docs, line_quality.train(docs, read(spark, sf_dir, "labels")))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts less the passages that stand together in a document of smaller id; n_chars follows."""
    found = line_dedup.remove_repeated_passages(docs, together=True)
    changed = F.col("removed_ranges").isNotNull()
    return found.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more (five-word shingles) the one of smallest id; fingerprints propose first."""
    return similar.keep_one(docs, words=5, similarity=0.8, radius=4)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and digests of the ids and of the decoded text."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", passages),
    ("near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("bpe encoding", token_ids),
]

#: A trained classifier and fingerprints of hashes are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
