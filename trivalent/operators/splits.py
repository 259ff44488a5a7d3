"""Seeded splits that do not depend on how rows are partitioned.

Every row gets the digest of its seed and id. Cutting each class at exact order
statistics of that digest gives parts whose sizes differ by at most one, and the
cut points are a handful of strings, so rows are assigned where they are and
only ids near a cut are ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, small_side
from . import ordered

#: Hex digits of the digest by which rows are counted, level by level: only buckets that hold a cut are looked at
#: again, so the rows that are sorted in one task are one of 16^6 parts of all rows.
LEVELS = (3, 6)


def digest(key, seed: int) -> Column:
    """Hex digest of seed and key, uniform over rows with distinct keys."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _bucket(hash_col: str, digits: int) -> Column:
    return F.substring(hash_col, 1, digits)


def _key(by: Sequence[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def rows_at(keyed: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows (_key, _h) of ``keyed`` whose 0-based rank by _h in their key is one of the key's ``_starts``.

    ``starts`` has one row a key. Rows are counted by ever longer prefixes of _h, each
    time only in the buckets that hold a wanted rank.
    """
    wanted = starts.select("_key", F.lit("").alias("_b"), F.lit(0).cast("long").alias("_before"), "_starts")
    done = 0
    for digits in LEVELS:
        near = keyed.withColumn("_b", _bucket("_h", done)).join(wanted, ["_key", "_b"])
        counts = near.groupBy("_key", "_b", _bucket("_h", digits).alias("_c")).agg(
            F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_from"), F.first("_starts").alias("_starts"))
        up_to = Window.partitionBy("_key", "_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_before", F.col("_from") + F.coalesce(F.sum("_n").over(up_to), F.lit(0)))
        held = placed.withColumn("_starts", F.filter(
            "_starts", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))))
        # One row per cut at most. Stored, so Catalyst knows its size when joining.
        wanted = materialise(held.where(F.size("_starts") > 0).select(
            "_key", F.col("_c").alias("_b"), "_before", "_starts"), "cuts")
        done = digits
    near = keyed.withColumn("_b", _bucket("_h", done)).join(wanted, ["_key", "_b"])
    inside = Window.partitionBy("_key", "_b").orderBy("_h")
    ranked = near.withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    return ranked.where(F.array_contains("_starts", F.col("_rank"))).select("_key", "_h")


def cut_points(df: DataFrame, hash_col: str, by: Sequence[str], sizes) -> DataFrame:
    """Digest of the first row of each part but the first: one row per key.

    ``sizes`` maps the row count column to the list of ranks at which a new part starts.
    """
    keyed = df.select(_key(by).alias("_key"), F.col(hash_col).alias("_h"))
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_all"))
    inside = F.filter(F.array(*[s.cast("long") for s in sizes(F.col("_all"))]), lambda r: r < F.col("_all"))
    starts = materialise(counts.select("_key", inside.alias("_starts")), "cuts")
    return rows_at(keyed, starts).groupBy("_key").agg(F.array_sort(F.collect_list("_h")).alias("_cuts"))


def assign_part(df: DataFrame, hash_col: str, by: Sequence[str], sizes, out: str) -> DataFrame:
    """0-based part of each row: the number of cut points its digest has reached."""
    points = materialise(cut_points(df, hash_col, by, sizes), "parts")
    reached = F.size(F.filter("_cuts", lambda c: F.col(hash_col) >= c))
    return (
        df.withColumn("_key", _key(by)).join(points, "_key", "left")
        .withColumn(out, F.coalesce(reached, F.lit(0))).drop("_key", "_cuts"))


def equal_parts(k: int):
    """Start ranks of k parts whose sizes differ by at most one, larger ones first."""
    def starts(n: Column) -> list[Column]:
        return [F.floor(n / k) * i + F.least(F.lit(i), n % k) for i in range(1, k)]
    return starts


def held_share(share: float):
    def starts(n: Column) -> list[Column]:
        return [F.ceil(n * F.lit(share))]
    return starts


def stratified_holdout(df: DataFrame, key: str, label: str = "y", share: float = 0.2, seed: int = 42,
                       out: str = "is_test") -> DataFrame:
    """Boolean column: the lowest ``share`` of each class by digest is held out."""
    hashed = df.withColumn("_h", digest(key, seed))
    parts = assign_part(hashed, "_h", [label], held_share(share), "_part")
    return parts.withColumn(out, F.col("_part") == 0).drop("_h", "_part")


def group_holdout(df: DataFrame, group: str, share: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Holds out whole groups; the choice is made on distinct groups, then read off the digest."""
    groups = df.select(group).distinct().withColumn("_h", digest(group, seed))
    points = cut_points(groups, "_h", [], held_share(share))
    cut = F.broadcast(points.select(F.col("_cuts")[0].alias("_cut"), F.lit(1).alias("_one")))  # one row
    hashed = df.withColumns({"_h": digest(group, seed), "_one": F.lit(1)})
    return hashed.join(cut, "_one", "left").withColumn(
        out, F.coalesce(F.col("_h") < F.col("_cut"), F.lit(True))).drop("_h", "_one", "_cut")


def stratified_folds(df: DataFrame, key: str, label: str = "y", k: int = 5, repeats: int = 1,
                     seed: int = 42) -> DataFrame:
    """Column ``fold`` (and ``repeat`` when repeated); each class is dealt evenly."""
    if repeats == 1:
        hashed = df.withColumn("_h", digest(key, seed))
        return assign_part(hashed, "_h", [label], equal_parts(k), "fold").drop("_h")
    each = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    salted = F.concat_ws(":", F.col("repeat").cast("string"), F.col(key).cast("string"))
    hashed = each.withColumn("_h", digest(salted, seed))
    return assign_part(hashed, "_h", [label, "repeat"], equal_parts(k), "fold").drop("_h")


def group_folds(df: DataFrame, group: str, label: str = "y", k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Folds of whole groups: groups of one label profile are dealt evenly over the folds.

    A profile is the pair of class counts on a log2 scale, so the number of
    profiles stays small however large groups grow.
    """
    profile = df.groupBy(group).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    level = lambda c: F.floor(F.log2(F.col(c) + F.lit(1.0))).cast("int")
    groups = profile.select(
        group, level("_pos").alias("_lp"), level("_neg").alias("_ln"), digest(group, seed).alias("_h"))
    folds = assign_part(groups, "_h", ["_lp", "_ln"], equal_parts(k), out).select(
        F.col(group).alias("_group"), out)
    return df.join(folds, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def dealt_leftovers(profiles: list[tuple[int, int, int]], k: int) -> dict[tuple[int, int], list[int]]:
    """How many groups of each profile (positives, negatives, number of groups) every fold gets.

    Largest profiles first. Groups go, a few at a time where there are many of one
    profile and at last one by one, to the fold where the folds' shares of both classes
    then spread least, and of equal ones to the fold with fewest rows.
    """
    totals = np.array([max(1, sum(p[c] * p[2] for p in profiles)) for c in (0, 1)], float)
    held, quotas, each = np.zeros((k, 2)), {}, np.eye(k)[:, :, None]
    for pos, neg, groups in sorted(profiles, key=lambda p: (-(p[0] + p[1]), p)):
        counts, own = [0] * k, np.array([pos, neg], float)
        while groups:
            some = max(1, groups // (4 * k))
            spread = ((held + each * own * some) / totals).std(axis=1).mean(axis=1)
            best = int(np.lexsort((held.sum(axis=1), np.round(spread, 12)))[0])
            counts[best] += some
            held[best] += own * some
            groups -= some
        quotas[pos, neg] = counts
    return quotas


def balanced_group_folds(df: DataFrame, group: str, label: str = "y", k: int = 5, seed: int = 42, out: str = "fold",
                         most_profiles: int = 50_000) -> DataFrame:
    """Folds of whole groups with rows and rates as even as a greedy assignment makes them.

    Groups with the same class counts are interchangeable, so the greedy choice is made
    on the table of distinct counts and their multiplicities, and the groups of one
    profile are dealt by digest. At most ``most_profiles`` profiles, the largest, take
    part in the choice on the driver; what smaller ones leave over is dealt in turn.
    """
    profile = materialise(df.groupBy(group).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")), "profiles")
    sizes = profile.groupBy("_pos", "_neg").agg(F.count(F.lit(1)).alias("_groups"))
    largest = [tuple(r) for r in sizes.orderBy((F.col("_pos") + F.col("_neg")).desc(), "_pos").limit(most_profiles).collect()]
    chosen = [(*p, quotas) for p, quotas in dealt_leftovers(largest, k).items()]
    plan = df.sparkSession.createDataFrame(chosen, "_pos long, _neg long, _quotas array<int>")
    turn = F.pmod(F.xxhash64("_pos", "_neg"), F.lit(k))
    even = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: (
        F.floor(F.col("_groups") / k) + F.when(F.pmod(f + turn, F.lit(k)) < F.col("_groups") % k, 1).otherwise(0)).cast("int"))
    planned = sizes.join(F.broadcast(plan), ["_pos", "_neg"], "left").withColumn("_quotas", F.coalesce("_quotas", even))
    # Parts are the folds that get any group, in order; a part starts after the quotas before it.
    folds = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.get("_quotas", f) > 0)
    start = lambda f: F.aggregate(F.slice("_quotas", 1, f), F.lit(0), lambda a, b: a + b).cast("long")
    planned = planned.withColumn("_folds", folds).withColumn("_starts", F.transform(F.slice("_folds", 2, k), start))
    planned = materialise(planned.select(F.struct("_pos", "_neg").alias("_key"), "_folds", "_starts"), "plan")
    keyed = profile.select(F.struct("_pos", "_neg").alias("_key"), F.col(group).alias("_group"), digest(group, seed).alias("_h"))
    points = rows_at(keyed.select("_key", "_h"), planned.select("_key", "_starts"))
    points = points.groupBy("_key").agg(F.array_sort(F.collect_list("_h")).alias("_cuts"))
    points = materialise(planned.join(points, "_key", "left"), "parts")
    reached = F.coalesce(F.size(F.filter("_cuts", lambda c: F.col("_h") >= c)), F.lit(0))
    placed = keyed.join(small_side(points), "_key").select("_group", F.get("_folds", reached).alias(out))
    return df.join(placed, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def position_blocks(df: DataFrame, position: str, key: str, n_blocks: int = 10, seed: int = 42,
                    out: str = "block") -> DataFrame:
    """Equal-count contiguous blocks along a position; unknown positions take the median.

    Cut positions come from running counts of distinct positions. A position
    that holds a cut (however many rows share it) is divided by digest.
    """
    splits = ordered.range_splits(df, position)
    median = ordered.quantiles(df, position, [0.5], splits=splits).first()  # one number
    fallback = F.lit(median["value"] if median else 0.0)
    filled = df.withColumns({
        "_pos": F.coalesce(F.col(position).cast("double"), fallback), "_h": digest(key, seed)})
    ranks = ordered.value_ranks(filled, "_pos", splits=splits)
    starts = F.array(*equal_parts(n_blocks)(F.col("n_all")))
    inside = lambda r: (r >= F.col("n_before")) & (r < F.col("n_before") + F.col("n"))
    held = ranks.withColumn("_starts", F.filter(starts, inside)).where(F.size("_starts") > 0)
    # At most n_blocks - 1 positions hold a cut.
    held = materialise(held.select(
        F.struct("_pos").alias("_key"), F.transform("_starts", lambda r: (r - F.col("n_before")).cast("long")).alias("_starts")), "cuts")
    keyed = filled.select(F.struct("_pos").alias("_key"), "_h").join(F.broadcast(held.select("_key")), "_key")
    cuts = rows_at(keyed, held).select("_key._pos", "_h")
    points = cuts.agg(F.collect_list(F.struct("_pos", "_h")).alias("_cuts"), F.lit(1).alias("_one"))
    here = F.struct("_pos", "_h")
    return (
        filled.withColumn("_one", F.lit(1)).join(F.broadcast(points), "_one", "left")
        .withColumn(out, F.size(F.filter("_cuts", lambda c: here >= c)))
        .drop("_one", "_cuts", "_pos", "_h"))


def block_folds(df: DataFrame, block: str = "block", k: int = 5, out: str = "fold") -> DataFrame:
    """Whole blocks to folds, in turn."""
    return df.withColumn(out, F.col(block) % k)


def region_holdout(df: DataFrame, position: str, key: str, n_blocks: int = 5, seed: int = 42) -> DataFrame:
    """The last stretch of positions is the test set."""
    return position_blocks(df, position, key, n_blocks, seed, "_block").withColumn(
        "is_test", F.col("_block") == n_blocks - 1).drop("_block")


def hash_order(df: DataFrame, key, seed: int, out: str = "order") -> DataFrame:
    """Dense 0-based index of rows in digest order.

    Rows are spread over 16^6 even buckets and sorted inside them; what lies before
    a bucket is summed inside its coarse bucket and over the 4,096 coarse ones.
    """
    coarse, fine = LEVELS[0], LEVELS[-1]
    staged = df.withColumn("_h", digest(key, seed)).withColumn("_b", _bucket("_h", fine))
    counts = staged.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", _bucket("_b", coarse))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy("_c").agg(F.sum("_n").alias("_n"))
    totals = totals.select("_c", before(Window.orderBy("_c")).alias("_far"))  # 16^3 rows at most
    offsets = counts.withColumn("_near", before(Window.partitionBy("_c").orderBy("_b"))).join(F.broadcast(totals), "_c")
    offsets = offsets.select("_b", (F.col("_far") + F.col("_near")).alias("_before"))
    inside = Window.partitionBy("_b").orderBy("_h")
    return staged.join(offsets, "_b").withColumn(
        out, F.col("_before") + F.row_number().over(inside) - 1).drop("_h", "_b", "_before")


def permute(df: DataFrame, columns: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Shuffle ``columns`` jointly over rows: row i in one digest order takes row i of another."""
    receivers = hash_order(df.drop(*columns), key, seed, "_i")
    donors = hash_order(df.select(key, *columns), key, seed + 1, "_i").drop(key)
    return receivers.join(donors, "_i").drop("_i").select(*df.columns)


def oversample_minority(df: DataFrame, key: str, label: str = "y", seed: int = 42) -> DataFrame:
    """Copies of minority rows until the classes match, each copy with its own ``copy`` number.

    Every minority row is repeated equally often and the remainder goes to the
    lowest digests. Kept to measure what copying before a split leaks.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most, least = F.max("_n"), F.min("_n")
    plan = counts.agg(
        F.min_by(label, F.struct("_n", label)).alias("_minor"), F.floor(most / least).alias("_times"),
        (most % least).alias("_extra"), F.lit(1).alias("_one"))
    known = df.where(F.col(label).isNotNull())
    minor = known.withColumn("_one", F.lit(1)).join(F.broadcast(plan), "_one").where(
        F.col(label) == F.col("_minor"))
    ranked = hash_order(minor, key, seed, "_rank")
    copies = F.col("_times") + (F.col("_rank") < F.col("_extra")).cast("int")
    grown = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    major = known.withColumn("_one", F.lit(1)).join(F.broadcast(plan), "_one").where(
        F.col(label) != F.col("_minor")).withColumn("copy", F.lit(1))
    return grown.select(*df.columns, "copy").unionByName(major.select(*df.columns, "copy"))


def background_sample(df: DataFrame, key: str, size: int = 200, seed: int = 42) -> DataFrame:
    """Fixed-size sample in digest order."""
    return df.orderBy(digest(key, seed)).limit(size)
