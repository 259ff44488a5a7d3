"""Ordered computations over a whole table without a one-partition window.

Rows collapse to distinct values first. The distinct values are cut into range
buckets at literal split points, so each window covers one bucket, and a small
table of bucket totals supplies what lies before the bucket. The split points
only balance the work: results are exact wherever they fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INFINITY = float("inf")


def default_buckets(df: DataFrame) -> int:
    return max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_splits(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Quantile split points of one column: one narrow scan, no shuffle of rows."""
    buckets = buckets or default_buckets(df)
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(F.col(value).cast("double").alias(value)).approxQuantile(value, probs, 0.25 / buckets)
    return sorted({x + 0.0 for x in found})


def with_bucket(df: DataFrame, value: str, splits: Sequence[float], out: str = "_bucket") -> DataFrame:
    """Bucket number by binary search over the literal split points."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    edges = [-INFINITY, *splits, INFINITY]
    # The cast keeps integer positions and doubles on the same path.
    staged = df.withColumn("_edge_value", F.col(value).cast("double"))
    return Bucketizer(splits=edges, inputCol="_edge_value", outputCol=out,
                      handleInvalid="keep").transform(staged).drop("_edge_value").withColumn(
        out, F.col(out).cast("int"))


def histogram(df: DataFrame, value: str, measures: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per key and distinct non-null value; combines map-side, so hot values are cheap."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[expr.alias(name) for name, expr in measures.items()])
    )


def _key(by: Sequence[str]) -> Column:
    # A struct keeps null keys as ordinary groups in joins and windows.
    return F.struct(*by) if by else F.lit(0)


def running_totals(hist: DataFrame, value: str, measures: Sequence[str], splits: Sequence[float],
                   by: Sequence[str] = ()) -> DataFrame:
    """Add ``<m>_before`` (strictly smaller values) and ``<m>_all`` (whole key) per measure."""
    staged = with_bucket(hist, value, splits).withColumn("_key", _key(by))
    totals = staged.groupBy("_key", "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    # At most one row per bucket and key here.
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    offsets = totals.select(
        "_key", "_bucket",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_all") for m in measures],
    )
    inside = Window.partitionBy("_key", "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = staged.join(offsets, ["_key", "_bucket"])
    before = {f"{m}_before": F.coalesce(F.sum(m).over(inside), F.lit(0)) + F.col(f"_{m}_offset") for m in measures}
    return joined.select(
        *hist.columns, *[expr.alias(name) for name, expr in before.items()],
        *[f"{m}_all" for m in measures])


def carried(df: DataFrame, value: str, payload: str, splits: Sequence[float], by: Sequence[str] = (), backwards: bool = False,
            out: str | None = None) -> DataFrame:
    """Add the payload of the last row at or before ``value`` that has one (with ``backwards`` at or after it).

    An as-of lookup: rows that ask carry a NULL payload. Windows stay inside range
    buckets; what a bucket inherits comes from a table of one row per bucket and key. A
    value of a key should have one payload at most.
    """
    out = out or f"{payload}_carried"
    far = lambda c: F.col(c).desc() if backwards else F.col(c)
    staged = with_bucket(df, value, splits).withColumn("_key", _key(by))
    given = F.when(F.col(payload).isNotNull(), F.col(value))
    edge = F.min_by(payload, given) if backwards else F.max_by(payload, given)
    earlier = Window.partitionBy("_key").orderBy(far("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    handed = staged.groupBy("_key", "_bucket").agg(edge.alias("_edge")).select(
        "_key", "_bucket", F.last("_edge", ignorenulls=True).over(earlier).alias("_handed"))
    inside = Window.partitionBy("_key", "_bucket").orderBy(far(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = staged.withColumn("_own", F.last(payload, ignorenulls=True).over(inside)).join(handed, ["_key", "_bucket"])
    return found.select(*df.columns, F.coalesce("_own", "_handed").alias(out))


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), splits=None) -> DataFrame:
    """Distinct values with row count, count below and midrank (ties share the average)."""
    splits = range_splits(df, value) if splits is None else splits
    hist = histogram(df, value, {"n": F.count(F.lit(1))}, by)
    return running_totals(hist, value, ["n"], splits, by).withColumn(
        "midrank", F.col("n_before") + (F.col("n") + 1) / 2)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), splits=None) -> DataFrame:
    """Exact linear-interpolation quantiles per key: columns ``by``, ``prob``, ``value``.

    Reads the two neighbouring order statistics off the running counts.
    """
    ranks = value_ranks(df, value, by, splits)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    at = (F.col("n_all") - 1) * F.col("prob")
    holds = lambda r: (F.col("n_before") <= r) & (r < F.col("n_before") + F.col("n"))
    hits = (
        ranks.withColumn("prob", wanted)
        .withColumn("_at", at)
        .where(holds(F.floor("_at")) | holds(F.ceil("_at")))
    )
    weight = F.max(F.col("_at") - F.floor("_at"))
    low, high = F.min(F.col(value).cast("double")), F.max(F.col(value).cast("double"))
    return hits.groupBy(*by, "prob").agg((low + (high - low) * weight).alias("value"))


def share_at_or_below(reference: DataFrame, queries: DataFrame, value: str, by: Sequence[str] = (),
                      splits=None, out: str = "share") -> DataFrame:
    """Distinct query values with the share of reference values that do not exceed them.

    Reference and query values go through one set of running counts, so no
    range join is needed and a query never depends on the other queries.
    """
    splits = range_splits(reference, value) if splits is None else splits
    both = reference.select(*by, value, F.lit(1).alias("_ref")).unionByName(
        queries.select(*by, value, F.lit(0).alias("_ref")))
    hist = histogram(both, value, {"n": F.sum("_ref"), "_asked": F.min("_ref")}, by)
    counted = running_totals(hist, value, ["n"], splits, by).where(F.col("_asked") == 0)
    return counted.select(*by, value, F.try_divide(F.col("n_before") + F.col("n"), F.col("n_all")).alias(out))


def neighbour_count(reference: DataFrame, queries: DataFrame, position: str, widths: Sequence[float],
                    splits=None, prefix: str = "within_") -> DataFrame:
    """Distinct query positions with the number of reference rows within each width.

    Both ends are inclusive and one row is taken off for the position itself,
    never below zero. Three lookups per position and width, all on distinct values.
    """
    splits = range_splits(reference, position) if splits is None else splits
    pos = F.col(position).cast("double")
    # Unknown positions leave by a count, not by a filter that would be pushed
    # into (and repeat) whatever computes the position.
    asked = queries.groupBy(pos.alias("origin")).agg(F.count(position).alias("_known")).where("_known > 0")
    ends = F.explode(F.array(*[
        F.struct(F.lit(float(w)).alias("width"), F.lit(side).alias("side"),
                 (F.col("origin") + (w if side == "hi" else -w)).alias("edge"))
        for w in widths for side in ("lo", "hi")]))
    probes = asked.select("origin", ends.alias("e")).select("origin", "e.*")
    points = reference.where(F.col(position).isNotNull()).select(pos.alias("edge"), F.lit(1).alias("_ref"))
    hist = histogram(
        points.unionByName(probes.select("edge", F.lit(0).alias("_ref"))), "edge", {"n": F.sum("_ref")})
    counts = running_totals(hist, "edge", ["n"], splits).select("edge", "n", "n_before")
    at_edge = F.when(F.col("side") == "hi", F.col("n_before") + F.col("n")).otherwise(-F.col("n_before"))
    found = probes.join(counts, "edge").groupBy("origin").agg(*[
        F.greatest(F.sum(F.when(F.col("width") == float(w), at_edge)) - 1, F.lit(0)).alias(f"{prefix}{w:g}")
        for w in widths])
    return found.withColumnRenamed("origin", position)


def step_gain(df: DataFrame, value: str, order: str, by: Sequence[str] = (), out: str = "gain") -> DataFrame:
    """Difference to the previous rung. For ladders: a few rows per key."""
    window = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(out, F.col(value) - F.lag(value).over(window))


def share_of_total(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "share") -> DataFrame:
    """Share of a key's total; the totals are combined map-side and joined back."""
    totals = df.groupBy(_key(by).alias("_key")).agg(F.sum(value).alias("_total"))
    totals = totals if by else F.broadcast(totals)  # without a key it is one row
    return (
        df.withColumn("_key", _key(by)).join(totals, "_key")
        .withColumn(out, F.col(value) / F.nullif(F.col("_total"), F.lit(0))).drop("_key", "_total")
    )
