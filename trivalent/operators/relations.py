"""Joins, set operations and top-k forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _col
from ..session import materialise, small_side


def assert_unique(dim: DataFrame, key: str) -> None:
    """A dimension with repeated keys would multiply fact rows: refuse it."""
    repeated = dim.groupBy(key).count().where((F.col("count") > 1) & F.col(key).isNotNull()).limit(1).count()
    if repeated:
        raise ValueError(f"dimension key {key!r} is not unique")


def join_dimension(facts: DataFrame, dim: DataFrame, key: str, suffix: str = "_v", check: bool = True) -> DataFrame:
    """Left equi-join; clashing dimension columns take a suffix, the key must be unique."""
    if check:
        assert_unique(dim, key)
    clash = {c: f"{c}{suffix}" for c in dim.columns if c != key and c in facts.columns}
    return facts.join(small_side(dim.withColumnsRenamed(clash)), key, "left")


def same_key(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality on every key part: a missing part equals a missing part."""
    tests = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, tests)


def overlap(target: DataFrame, other: DataFrame, keys: Sequence[str], shared: bool = True) -> DataFrame:
    """Target rows whose key also occurs (or never occurs) in the other registry."""
    known = other.select(*keys).distinct()
    return target.alias("t").join(known.alias("o"), same_key("t", "o", keys), "left_semi" if shared else "left_anti")


def overlap_summary(target: DataFrame, other: DataFrame, keys: Sequence[str], resolvable: Column) -> DataFrame:
    """Resolvable target keys, how many the other registry holds, and the share."""
    asked = target.where(resolvable).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = other.select(*keys).distinct().withColumn("_known", F.lit(True))
    joined = asked.alias("t").join(known.alias("o"), same_key("t", "o", keys), "left")
    hit = F.sum(F.when(F.col("o._known"), F.col("t._n")).otherwise(0))
    return joined.agg(
        F.sum("t._n").alias("n_resolvable"), hit.alias("n_shared"), (hit / F.sum("t._n")).alias("share_shared"))


def rows_also_in(test: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Test rows with an identical training row.

    A 64-bit digest is the join key, so wide rows hash once; the columns are
    compared as well, so a digest collision is never a match. Training rows are
    made distinct first, which also flattens hot copies.
    """
    digest = F.xxhash64(*columns).alias("_digest")
    left = test.select("*", digest).alias("t")
    right = train.select(*columns).distinct().select("*", digest).alias("o")
    same = (F.col("t._digest") == F.col("o._digest")) & same_key("t", "o", columns)
    return left.join(right, same, "left_semi").drop("_digest")


def straddling_groups(df: DataFrame, group: str, side: str) -> DataFrame:
    """Groups with rows on more than one side of a split."""
    return df.groupBy(group).agg(F.min(side).alias("_lo"), F.max(side).alias("_hi")).where(
        F.col("_lo") != F.col("_hi")).select(group)


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dense 0-based code of every distinct value per column, in value order: (column, value, code).

    All columns sort in one distributed sort. Ids that rise along the sort are
    stored first, then made dense with one offset per sorted partition, so even
    a near-unique column never passes through the driver or one task.
    """
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    values = long.where(F.col("value").isNotNull()).distinct().sort("column", "value")
    stored = materialise(values.withColumn("_rising", F.monotonically_increasing_id()), "codes")
    staged = stored.withColumns({"_part": F.shiftright("_rising", 33), "_row": F.col("_rising").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    dense = staged.join(F.broadcast(offsets), "_part").withColumn("_dense", F.col("_offset") + F.col("_row"))
    first = dense.groupBy("column").agg(F.min("_dense").alias("_first"))
    return dense.join(F.broadcast(first), "column").select(
        "column", "value", (F.col("_dense") - F.col("_first")).cast("double").alias("code"))


def with_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace text columns by their codes; a small column's codes are broadcast, a large one's shuffled."""
    for c in columns:
        dim = codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = df.join(small_side(dim), F.col(f"`{c}`").cast("string") == F.col("_value"), "left").drop(c, "_value")
        df = df.withColumnRenamed("_code", c)
    return df


def ranking_join(a: DataFrame, b: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    return a.select(key, F.col(rank).alias("rank_a")).join(b.select(key, F.col(rank).alias("rank_b")), key)


def model_table(cv: DataFrame, blocked: DataFrame, comparison: DataFrame) -> DataFrame:
    """Cross-validated, region-blocked and paired-test results side by side."""
    return cv.join(blocked, "model", "left").join(comparison, "model", "left")


def select_model(cv: DataFrame, blocked: DataFrame, comparison: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Among models no test separates from the best, the one with the highest blocked AUC."""
    tied = F.coalesce(F.col("p_value") >= alpha, F.lit(True))
    table = model_table(cv, blocked, comparison).where(tied & F.col("blocked_auc").isNotNull())
    return table.orderBy(F.desc("blocked_auc"), "model").limit(1)


def leaderboard(df: DataFrame, score: str = "mean", name: str = "model") -> DataFrame:
    return df.orderBy(F.desc(score), name)


def top_k(df: DataFrame, score, k: int, name: str) -> DataFrame:
    return df.orderBy(F.desc(_col(score)), name).limit(k)


def top_k_each(df: DataFrame, key: str, score: Column, k: int, tie: str) -> DataFrame:
    """k best rows per key; partial top-k per task bounds what a hot key shuffles."""
    best = Window.partitionBy(key).orderBy(F.desc("_score"), tie)
    scored = df.withColumn("_score", score)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("_score")


def adopt_confident(pool: DataFrame, prevalence: float, score: str = "p", key: str = "id", hi: float = 0.85,
                    lo: float = 0.05, per_round: int = 200) -> DataFrame:
    """Rows a model is surest about, split so the adopted batch keeps the labelled prevalence."""
    wanted = max(1, int(per_round * prevalence))
    pos = pool.where(F.col(score) >= hi).orderBy(F.desc(score), key).limit(wanted)
    n_pos = pos.count()
    neg = pool.where(F.col(score) <= lo).orderBy(score, key).limit(per_round - n_pos)
    return pos.withColumn("y", F.lit(1)).unionByName(neg.withColumn("y", F.lit(0)))


def stack_states(labelled: DataFrame, unlabelled: DataFrame, out: str = "recorded") -> DataFrame:
    return labelled.withColumn(out, F.lit(1)).unionByName(
        unlabelled.withColumn(out, F.lit(0)), allowMissingColumns=True)


def append_adopted(train: DataFrame, adopted: DataFrame, pool: DataFrame, key: str = "id", weight: float = 0.5,
                   out: str = "weight") -> tuple[DataFrame, DataFrame]:
    """Training rows with the adopted ones at reduced weight, and the pool without them."""
    grown = train.unionByName(adopted.withColumn(out, F.lit(weight)).select(*train.columns))
    return grown, pool.join(adopted.select(key), key, "left_anti")


def frame_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one frame only, counting copies; empty when the frames are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right")))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()
