"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest dimension (in rows) that may be replicated to every executor.
BROADCAST_ROW_LIMIT = 200_000


def build_session(app: str = "trivalent", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the wide projections and skewed joins rely on.

    Text classifiers easily generate a method over 8,000 bytes, which the JVM
    never compiles; past that limit Spark should use its split projections.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh one only in local mode, where none is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    folder = folder or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="trivalent-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


@contextmanager
def temporary():
    """Tables stored inside, but for ``lasting`` ones, are deleted at the end: store what is to be kept before that."""
    mark = _held.set([])
    try:
        yield
    finally:
        discard(*_held.get())
        _held.reset(mark)


def materialise(df: DataFrame, label: str = "table", partition_by: Sequence[str] = (), lasting: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like a checkpoint, and leaves Catalyst with real file sizes for
    choosing join strategies. Lost executors re-read the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    if not lasting and _held.get() is not None:
        _held.get().append(stored)
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote, once nothing that is still to run reads them."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A plain scan with a part for every core: parsing and fitting cost far more than the bytes that scans are cut by.

    Scans that have as many parts already are left as they are. Only their parts are counted, no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_side(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only after checking that ``df`` is within ``limit`` rows.

    A larger table is returned without a hint, so Catalyst and AQE choose a
    shuffled join for it. Pass stored or cheap tables: the check is one bounded job.
    """
    if df.select(F.lit(1)).limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df
