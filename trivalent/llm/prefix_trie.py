"""The trie of rebuilt conversations: sums of turn hashes name its nodes, perfect-hash tables of subtrees count them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.session import materialise, small_side

from .common import bounded_batches
from .line_dedup import large

#: Every FAMILY conversations share an opening, of at most OPENING - 1 turns.
FAMILY, OPENING = 5, 9
#: Turns of one conversation that a window orders at once, and conversation ids that are joined to one text.
BLOCK, ID_BLOCK = 4096, 65_536
#: Path rows below a node from which on it belongs to no table but is summed by joins, and rows of one table.
SUBTREE_ROWS, TABLE_ROWS = 100_000, 200_000


def running(rows: DataFrame, block: Column, order: list[Column], measures: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each measure over the rows of the same conversation that come before.

    A window orders one block of a conversation; what earlier blocks hold is added, so
    a conversation of any length is dealt out. ``block`` must not fall along ``order``.
    """
    staged = rows.withColumn("_block", block).withColumns({f"_{m}": e for m, e in measures.items()})
    totals = staged.groupBy("conv_id", "_block").agg(*[F.sum(f"_{m}").alias(f"_{m}") for m in measures])
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select("conv_id", "_block", *[F.sum(f"_{m}").over(earlier).alias(f"_{m}_offset") for m in measures])
    sums = materialise(sums.where(F.col(f"_{next(iter(measures))}_offset").isNotNull()), "blocks")
    inside = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = staged.withColumns({f"_{m}_inside": F.sum(f"_{m}").over(inside) for m in measures})
    both = placed.join(small_side(sums), ["conv_id", "_block"], "left")
    zero = F.lit(0)
    return both.select(
        *rows.columns,
        *[(F.coalesce(f"_{m}_inside", zero) + F.coalesce(f"_{m}_offset", zero)).alias(f"{m}_before") for m in measures])


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), a, b (hashes of role and text) and bytes (UTF-8 bytes of the text) of each turn."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    hashed = turns.select(
        "conv_id", "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"),
        F.octet_length("text").cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).cast("long")
    return running(hashed, block, order, {"pos": F.lit(1).cast("long")}).select(
        "conv_id", F.col("pos_before").alias("pos"), "a", "b", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, total) of every conversation, and (conv_id, at, total, a, b, bytes) of each of its rebuilt turns.

    The first h turns are those of conversation c - c % 5, where h = crc32(c) % 9; then come its own after its first h.
    """
    sizes = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    opening = F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING
    lengths = sizes.select(F.col("conv_id").alias("family"), F.col("n").alias("family_n"))
    convs = sizes.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", opening)
    convs = convs.join(large(lengths), "family", "left")
    shared = F.least("h", F.coalesce("family_n", F.lit(0)))
    convs = convs.select("conv_id", "family", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    convs = materialise(convs, "convs")
    own = turns.join(large(convs), "conv_id").where(F.col("pos") >= F.col("h")).withColumn("at", F.col("shared") + F.col("pos") - F.col("h"))
    lent = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < OPENING - 1)).withColumnRenamed("conv_id", "family")
    lent = lent.join(large(convs), "family").where(F.col("pos") < F.col("h")).withColumn("at", F.col("pos"))
    fields = ["conv_id", "at", "total", "a", "b", "bytes"]
    return convs.select("conv_id", "total"), own.select(*fields).unionByName(lent.select(*fields))


def paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a conversation and node on its path, the root too: conv_id, depth, k1, k2 (the node), p1, p2 (its parent), bytes, turn, total.

    A node is named by its depth and two sums of 64-bit hashes of (place, turn), so a
    prefix needs no pass from its start. ``turn`` is a hash of the last turn and the parent.
    """
    one, two = F.xxhash64("at", "a", "b"), F.xxhash64("b", F.lit(2), "at", "a")
    measures = {"s": one.cast("decimal(20,0)"), "t": two.cast("decimal(20,0)")}
    summed = running(turns, F.floor(F.col("at") / BLOCK), [F.col("at")], measures)

    def named(depth: Column, s: Column, t: Column, k: str) -> list[Column]:
        s, t = s.cast("decimal(38,0)"), t.cast("decimal(38,0)")
        return [F.xxhash64(depth, s, t).alias(f"{k}1"), F.xxhash64(t, F.lit(3), s, depth).alias(f"{k}2")]

    depth = (F.col("at") + 1).cast("long")
    rows = summed.select(
        "conv_id", depth.alias("depth"), *named(depth, F.col("s_before") + measures["s"], F.col("t_before") + measures["t"], "k"),
        *named(F.col("at").cast("long"), F.col("s_before"), F.col("t_before"), "p"), "bytes", "a", "b", "total")
    rows = rows.withColumn("turn", F.xxhash64("p1", "p2", "a", "b")).drop("a", "b")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select(
        "conv_id", zero.alias("depth"), *named(zero, zero, zero, "k"), none.alias("p1"), none.alias("p2"), zero.alias("bytes"), "total", zero.alias("turn"))
    return rows.unionByName(root)


class Slots:
    """A minimal perfect hash of distinct 128-bit keys: every key has a slot of its own below their number.

    Level by level the keys that are alone at their place get the next slots; the others
    try again, hashed anew. Slots keep their keys, so a lookup of a key that is not there
    is found out.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.levels: list[np.ndarray] = []  # at each place a slot or -1
        self.k1, self.k2 = np.empty_like(k1), np.empty_like(k2)
        rest, done = np.arange(len(k1)), 0
        while len(rest):
            if len(self.levels) > 64:
                raise ValueError("equal keys have no slots of their own")
            size = max(64, len(rest) + len(rest) // 2)
            place = self._place(k1[rest], k2[rest], size, len(self.levels))
            alone = np.bincount(place, minlength=size) == 1
            slots = np.where(alone, done + np.cumsum(alone) - 1, -1)
            self.levels.append(slots)
            own = alone[place]
            self.k1[slots[place[own]]], self.k2[slots[place[own]]] = k1[rest[own]], k2[rest[own]]
            done += int(own.sum())
            rest = rest[~own]

    @staticmethod
    def _place(k1: np.ndarray, k2: np.ndarray, size: int, level: int) -> np.ndarray:
        x = k1.view(np.uint64) ^ (k2.view(np.uint64) * np.uint64(2 * level + 0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slots of the keys; -1 for keys that have none."""
        found, rest = np.full(len(k1), -1), np.arange(len(k1))
        for level, slots in enumerate(self.levels):
            at = slots[self._place(k1[rest], k2[rest], len(slots), level)]
            hit = at >= 0
            mine, at = rest[hit], at[hit]
            same = (self.k1[at] == k1[mine]) & (self.k2[at] == k2[mine])
            found[mine[same]] = at[same]
            rest = rest[~hit]
        return found


def count_table(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Children, leaves and saved bytes of each node of whole subtrees, and its parent's least conversation (-1: not in the table).

    ``nodes`` holds k1, k2, p1, p2, depth, conv_id, n and bytes. Results are by row.
    """
    table = Slots(nodes["k1"], nodes["k2"])
    slot = table.find(nodes["k1"], nodes["k2"])
    size = len(slot)
    if (np.bincount(slot, minlength=size) != 1).any():
        raise ValueError("two nodes share a slot")
    depth, parent, conv, saved = (np.empty(size, np.int64) for _ in range(4))
    depth[slot], conv[slot] = nodes["depth"], nodes["conv_id"]
    saved[slot] = (nodes["n"] - 1) * nodes["bytes"]
    parent[slot] = table.find(nodes["p1"], nodes["p2"])
    children = np.bincount(parent[parent >= 0], minlength=size)
    leaves = (children == 0).astype(np.int64)
    by_depth = np.argsort(-depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        inner = level[parent[level] >= 0]
        np.add.at(leaves, parent[inner], leaves[inner])
        np.add.at(saved, parent[inner], saved[inner])
    of_parent = np.where(parent >= 0, conv[np.maximum(parent, 0)], -1)
    return {"n_children": children[slot], "n_leaves": leaves[slot], "saved_tokens": saved[slot],
            "parent_conv_id": of_parent[slot], "inner": parent[slot] >= 0}


NODE = ["k1", "k2", "p1", "p2", "depth", "conv_id", "n", "bytes"]


def count_subtrees(nodes: DataFrame) -> DataFrame:
    """Nodes (NODE and u1, u2: the top of their subtree) with n_children, n_leaves, saved_tokens, parent_conv_id and inner (is no top)."""
    bounded_batches(nodes.sparkSession)

    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        columns = {c: whole.column(c).to_numpy() for c in NODE}
        made = count_table(columns)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(columns[c]) for c in NODE), *(pa.array(v) for v in made.values())], names=[*NODE, *made])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            u1, u2 = batch.column("u1").to_numpy(), batch.column("u2").to_numpy()
            fresh = np.append(True, (u1[1:] != u1[:-1]) | (u2[1:] != u2[:-1]))
            fresh[:1] = (u1[:1] != last[0]) | (u2[:1] != last[1]) if last is not None else True
            cuts = [*np.flatnonzero(fresh).tolist(), batch.num_rows]
            if cuts[0]:
                held.append(batch.slice(0, cuts[0]))
                size += cuts[0]
            for a, b in zip(cuts, cuts[1:]):  # a new subtree begins at a
                if size >= TABLE_ROWS:
                    yield flush(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += b - a
            last = (u1[-1], u2[-1])
        if held:
            yield flush(held)

    dealt = nodes.select(*NODE, "u1", "u2").repartition("u1", "u2").sortWithinPartitions("u1", "u2")
    schema = ", ".join(f"{c} long" for c in [*NODE, "n_children", "n_leaves", "saved_tokens", "parent_conv_id"]) + ", inner boolean"
    return dealt.mapInArrow(run, schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """k1, k2 and ends_sha256 of ``ends`` (k1, k2, conv_id): the digest of each node's ids, ascending and comma-joined.

    Ids are joined in blocks where they are; one task then digests the blocks of a node in turn and holds one at a time.
    """
    block = F.floor(F.col("conv_id") / ID_BLOCK)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    joined = ends.groupBy("k1", "k2", block.alias("block")).agg(ids.alias("ids"))
    bounded_batches(ends.sparkSession)

    def run(batches):
        last, digest = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if last == (k1, k2):
                    digest.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((*last, digest.hexdigest()))
                last, digest = (k1, k2), hashlib.sha256(ids.encode())
            yield as_batch(done)
        if last is not None:
            yield as_batch([(*last, digest.hexdigest())])

    def as_batch(rows):
        k1, k2, sha = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha, pa.string())], names=["k1", "k2", "ends_sha256"])

    dealt = joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").select("k1", "k2", "ids")
    return dealt.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see :func:`rebuilt`): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    conv_id is the least member. Turns go by ``turn``, null first, and ties by a hash of
    role and text; null roles and texts are empty, repeated rows are turns of their own.
    Rows without a conv_id are left out, as are other columns. An empty table has no
    node, not even a root.

    Subtrees of at most SUBTREE_ROWS path rows are counted in flat arrays, several to a
    table. The few nodes above are summed by joins along the paths of their least members.
    """
    convs, turns = rebuilt(materialise(placed_turns(conversations), "turns"))
    rows = materialise(paths(convs, materialise(turns, "rebuilt")), "paths")
    last = F.max("turn").alias("turn"), F.min("turn").alias("turn2")
    nodes = rows.groupBy("k1", "k2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n"), F.min("bytes").alias("bytes"), F.sum(F.col("total") - F.col("depth") + 1).alias("below"), *last)
    clash = F.raise_error(F.lit("two prefixes share a digest")).cast("long")
    nodes = nodes.withColumn("n", F.when(F.col("turn") != F.col("turn2"), clash).otherwise(F.col("n"))).drop("turn", "turn2")
    nodes = materialise(nodes, "nodes")
    is_top = (F.col("below") > SUBTREE_ROWS) | (F.col("depth") == 0)
    top = materialise(nodes.where(is_top), "top")
    few = small_side(top.select("k1", "k2"))

    # The subtree of a conversation is that of the first node on its path that is not among the top.
    units = rows.join(few, ["k1", "k2"], "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2")).alias("u"))
    units = materialise(units.select("conv_id", F.col("u.k1").alias("u1"), F.col("u.k2").alias("u2")), "units")
    counted = materialise(count_subtrees(nodes.where(~is_top).join(large(units), "conv_id")), "subtrees")

    # What hangs below each top node, added up along the path of its least member.
    hanging = counted.where("not inner").groupBy("p1", "p2").agg(
        F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    inside = top.where("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("c"), F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("s"))
    below = hanging.unionByName(inside).groupBy("p1", "p2").agg(*[F.sum(x).alias(x) for x in "cls"])
    own = top.join(below.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "c", "l", "s"), ["k1", "k2"], "left")
    own = own.select(
        *NODE, F.coalesce("c", F.lit(0)).alias("n_children"), F.coalesce("l", F.when(F.col("c").isNull(), 1).otherwise(0)).alias("leaves"),
        (F.coalesce("s", F.lit(0)) + (F.col("n") - 1) * F.col("bytes")).alias("saved"))
    own = materialise(own, "top_own")
    line = rows.join(few, ["k1", "k2"]).select("conv_id", F.col("depth").alias("up"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    line = line.join(small_side(own.select("conv_id").distinct()), "conv_id", "left_semi")
    above = own.join(line, "conv_id").where("up <= depth").groupBy("a1", "a2").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    of_top = own.join(above, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")))

    fields = ["k1", "k2", "p1", "p2", "conv_id", "depth", "parent_conv_id", "n", "n_children", "n_leaves", "saved_tokens"]
    known = F.when(F.col("inner"), F.col("parent_conv_id"))
    nodes = counted.withColumn("parent_conv_id", known).select(*fields).unionByName(
        of_top.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*fields))
    parents = small_side(own.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("of_top")))
    # Only nodes whose parent is among the top look for it there.
    outer = F.col("parent_conv_id").isNull()
    nodes = nodes.join(parents, (F.when(outer, F.col("p1")) == F.col("q1")) & (F.when(outer, F.col("p2")) == F.col("q2")), "left")
    ends = end_digests(rows.where("depth = total").select("k1", "k2", "conv_id"))
    done = nodes.join(large(ends), ["k1", "k2"], "left")
    return done.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "of_top").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
