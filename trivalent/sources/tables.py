"""Readers and writers for catalogues, registries, scores and fitted artefacts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import text
from ..functions.encode import finite_or_null
from ..operators.relations import join_dimension
from ..session import materialise


#: Column of records that do not fit the header.
CORRUPT = "_corrupt"
#: Folder of commits beside a score table's data; Spark's readers pass over names with an underscore.
COMMITS, COMMIT = "_commits", "model string, n_rows long, run string, committed_at timestamp"


def clean_headers(df: DataFrame) -> DataFrame:
    """Collapse white space in column names and drop unnamed columns."""
    names = [re.sub(r"\s+", " ", c).strip() for c in df.columns]
    kept = [n for n in names if not n.startswith("Unnamed") and n]
    renamed = df.toDF(*[n or f"Unnamed {i}" for i, n in enumerate(names)])
    return renamed.select(*[F.col(f"`{n}`") for n in kept])


def find_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First alias that is present, exactly or else ignoring case."""
    squeezed = {re.sub(r"\s+", " ", c).strip().lower(): c for c in reversed(columns)}
    for test in (lambda a: a if a in columns else None, lambda a: squeezed.get(a.lower())):
        for alias in aliases:
            if test(alias):
                return test(alias)
    return None


def resolve(df: DataFrame, aliases: dict[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Canonical string columns; absent ones are NULL."""
    chosen = []
    for name, options in aliases.items():
        found = find_column(df.columns, options)
        chosen.append((F.col(f"`{found}`").cast("string") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*keep, *chosen)


def string_schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_raw(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header, every column a string. Multi-line fields stop file splitting, so they are opt-in."""
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    if columns:
        reader = reader.schema(string_schema(columns))
    return reader.csv(path)


REJECT = "record string, reason string, file string, block_start long"


def checked_schema(columns: Sequence[str]) -> T.StructType:
    """String columns and one for records that do not have as many."""
    return string_schema([*columns, CORRUPT])


def with_origin(raw: DataFrame) -> DataFrame:
    """The file and the start of the block that a record was read from."""
    return raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block_start"))


def sound_and_rejected(raw: DataFrame, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and rejects (REJECT) with the whole record: of other width, or without a value in a required column.

    ``raw`` has the columns of :func:`checked_schema` and :func:`with_origin`; every row is in one of the two.
    """
    names = [c for c in raw.columns if c not in (CORRUPT, "_file", "_block_start")]
    blank = [F.when(F.coalesce(F.btrim(F.col(f"`{c}`")), F.lit("")) == "", F.lit(f"no value for {c}")) for c in required]
    reason = F.coalesce(F.when(F.col(CORRUPT).isNotNull(), F.lit("fields do not match the header")), *blank)
    whole = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names])))
    marked = raw.withColumn("_reason", reason)
    rejects = marked.where("_reason IS NOT NULL").select(
        whole.alias("record"), F.col("_reason").alias("reason"), F.col("_file").alias("file"), F.col("_block_start").alias("block_start"))
    return marked.where("_reason IS NULL").select(*[F.col(f"`{c}`") for c in names]), rejects


def read_checked(spark: SparkSession, path: str, columns: Sequence[str], required: Sequence[str] = (),
                 multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """CSV with a header as (rows, rejects): no record is lost and none is silently filled with NULLs.

    The records are parsed once into a stored table, so a lost executor does not parse
    them into other rows and both results agree.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("enforceSchema", True)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(checked_schema(columns))
    return sound_and_rejected(materialise(with_origin(reader.csv(path)), "checked"), required)


def header_drift(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """file, missing, unexpected and reordered of every file whose header is not ``columns``. One line a file is compared."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").withColumn("place", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "place").alias("header"))
    found = F.transform(F.split("header", ","), lambda c: F.regexp_replace(F.btrim(F.regexp_replace(c, '"', "")), r"\s+", " "))
    wanted = F.array(*[F.lit(c) for c in columns])
    told = first.select("file", F.array_except(wanted, found).alias("missing"), F.array_except(found, wanted).alias("unexpected"), (found != wanted).alias("differs"))
    return told.where("differs").select(
        "file", "missing", "unexpected", ((F.size("missing") == 0) & (F.size("unexpected") == 0)).alias("reordered"))


def finish_catalogue(df: DataFrame, gene: str, outcome: str = "History of Inhibitor", distinct: bool = True) -> DataFrame:
    """Header clean-up, blank and duplicate rows out, tri-state label and gene in."""
    df = clean_headers(df).na.drop("all")
    if distinct:
        df = df.dropDuplicates()
    return df.withColumns({"inhibitor": text.catalogue_label(F.col(f"`{outcome}`")), "gene": F.lit(gene)})


def load_catalogue(spark: SparkSession, path: str, gene: str = "F8", columns=None) -> DataFrame:
    return finish_catalogue(read_raw(spark, path, columns), gene)


def load_external(spark: SparkSession, path: str, gene: str = "F9", renames: dict | None = None, columns=None) -> DataFrame:
    """A second catalogue brought onto the first one's column names."""
    raw = clean_headers(read_raw(spark, path, columns))
    return finish_catalogue(raw.withColumnsRenamed(renames or fv.EXTERNAL_RENAMES), gene)


def load_fused(spark: SparkSession, path: str, gene: str = "F8", columns=None) -> DataFrame:
    """Catalogue plus covariates; supplied derived columns are dropped and the label rebuilt from the text."""
    df = finish_catalogue(read_raw(spark, path, columns), gene, distinct=False)
    return df.drop(*[c for c in fv.SUPPLIED_COVARIATES if c != "Patient_ID"])


def load_registry(spark: SparkSession, variants_path: str, records_path: str) -> DataFrame:
    return registry_records(read_raw(spark, records_path), read_raw(spark, variants_path))


def registry_records(records: DataFrame, variants: DataFrame, check: bool = True) -> DataFrame:
    """Record facts left-joined to the projected variant dimension, with the derived columns."""
    dim = variants.select(*[c for c in fv.VARIANT_COLUMNS if c in variants.columns])
    joined = text.with_region(join_dimension(records, dim, "mut_id", check=check), "pa_race")
    optional = lambda c: F.col(f"`{c}`") if c in joined.columns else F.lit(None).cast("string")
    staged = joined.withColumns({
        "_severity": text.packed_token("cli_phe"), "_effect": text.lower_token("mut_effect"),
        "_activity": text.reading_token("clotting"), "_antigen": text.reading_token("antigen")})
    derived = staged.withColumns({
        "y": text.registry_label("Inhibitors"),
        "severity": text.registry_severity("_severity", ready=True),
        "fviii_activity": text.censored_number("_activity", ready=True),
        "fviii_antigen": text.censored_number("_antigen", ready=True),
        "act_ant_ratio": text.number(optional("act/ant")),
        "crm_type": text.crm_type("type"),
        "effect": text.registry_effect("_effect", ready=True),
        "study": F.coalesce(text.clean_token("reference"), F.lit("unknown")),
    }).drop("_severity", "_effect", "_activity", "_antigen")
    return finite_or_null(derived, ["fviii_activity", "fviii_antigen"])


def split_by_label(df: DataFrame, label: str = "inhibitor") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())


def from_records(spark: SparkSession, records: Sequence[dict], fields: Sequence[str]) -> DataFrame:
    """Caller-supplied records as string columns; absent fields are NULL."""
    rows = [tuple(None if r.get(f) is None else str(r[f]) for f in fields) for r in records]
    return spark.createDataFrame(rows, string_schema(fields))


def drop_forbidden(df: DataFrame, names: Sequence[str] = (*fv.IDENTIFIER_COLUMNS, *fv.OUTCOME_DERIVED),
                   patterns: Sequence[str] = ()) -> DataFrame:
    """Projection without identifiers, outcome-derived columns and untrusted name patterns."""
    banned = {n.lower() for n in names}
    out = [c for c in df.columns if c.lower() in banned or any(p in c.lower() for p in patterns)]
    return df.drop(*out)


def forbidden_present(columns: Sequence[str], names: Sequence[str] = (*fv.IDENTIFIER_COLUMNS, *fv.OUTCOME_DERIVED)) -> list[str]:
    banned = {n.lower() for n in names}
    return [c for c in columns if c.lower() in banned]


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A metric table as JSON or Parquet."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_scores(df: DataFrame, path: str) -> str:
    """Add long scores as one run, one folder per model and run; returns the run's name.

    A run counts once its commit is there, which is written last, a row per model. So
    writing a model again replaces that model's scores for readers and no other's, and a
    failed or running write is never read. Older runs stay on disk.
    """
    run, spark = uuid.uuid4().hex, df.sparkSession
    df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("model", "run").parquet(path)
    written = spark.read.parquet(path).where(F.col("run") == run).groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))
    commit = written.select("model", "n_rows", F.lit(run).alias("run"), F.current_timestamp().alias("committed_at"))
    commit.coalesce(1).write.mode("append").json(f"{path}/{COMMITS}")
    return run


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """model, run and n_rows of the last committed run of each model."""
    commits = spark.read.schema(COMMIT).json(f"{path}/{COMMITS}")
    last = F.max(F.struct("committed_at", "run", "n_rows")).alias("last")
    return commits.groupBy("model").agg(last).select("model", "last.run", "last.n_rows")


def read_scores(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The committed scores of each model, or of one; only their folders are scanned."""
    runs = committed_runs(spark, path)
    wanted = F.lit(False)
    for r in (runs.where(F.col("model") == model) if model else runs).collect():  # one a model
        wanted = wanted | ((F.col("model") == r["model"]) & (F.col("run") == r["run"]))
    return spark.read.parquet(path).where(wanted).drop("run")


def save_artefact(path: str, model: PipelineModel, tables: dict[str, DataFrame]) -> None:
    """A fitted pipeline and its side tables (thresholds, references, feature list)."""
    model.write().overwrite().save(f"{path}/model")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/tables/{name}")


def load_artefact(spark: SparkSession, path: str, names: Sequence[str]) -> tuple[PipelineModel, dict[str, DataFrame]]:
    tables = {name: spark.read.parquet(f"{path}/tables/{name}") for name in names}
    return PipelineModel.load(f"{path}/model"), tables
