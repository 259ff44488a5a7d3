"""Near duplicates by SimHash fingerprints and BK-trees over shards of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.session import materialise

from .common import id_and_text, map_texts
from .components import components

BITS = 64
#: Rows of a shard that one task holds; a larger shard is dealt out as pairs of blocks of about half that size.
SHARD_ROWS = 8192
#: (query, node) pairs that a walk over the trees holds at once.
FRONTIER = 1 << 20


def fingerprint(text: str, words: int = 4) -> int:
    """The SimHash of the word shingles of ``text``, A-Z in lower case; 0 without words.

    Words are what ASCII white space parts; fewer words than ``words`` are one shingle.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    data = b" ".join(found)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(found) - words + 1)
    ends = ends[-n:]
    view = memoryview(data)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(view[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())), dtype=np.uint64, count=n
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of ``hashes`` have; 0 of none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id and its fingerprint as a (signed) long."""

    def per_batch(texts: list[str]) -> dict[str, list]:
        made = np.fromiter((fingerprint(t, words) for t in texts), dtype=np.uint64, count=len(texts))
        return {"fp": pa.array(made.view(np.int64))}

    return map_texts(id_and_text(df, id_col, text_col), "fp long", per_batch)


def shard_masks(radius: int, spare: int = 2) -> list[int]:
    """Bit masks of which at least one is free of differences between two values within ``radius``.

    The bits are cut into ``radius + spare`` pieces; at most ``radius`` of them hold a
    difference, so some choice of ``spare`` whole pieces holds none.
    """
    pieces = radius + spare
    cuts = [round(BITS * i / pieces) for i in range(pieces + 1)]
    piece = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]
    return [reduce(lambda x, y: x | y, chosen) for chosen in combinations(piece, spare)]


class Forest:
    """BK-trees, one for each shard: a child hangs under its parent by their Hamming distance.

    Trees are built and walked level by level for all shards at once. Of one shard's
    values with the same distance to a node, the first becomes the child and the
    others move on to it.
    """

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        n = len(value)
        self.shard, self.value = shard, value
        first = np.ones(n, dtype=bool)
        first[1:] = shard[1:] != shard[:-1]
        roots = np.flatnonzero(first)
        self.root = roots[np.cumsum(first) - 1]
        at, rest = self.root.copy(), np.flatnonzero(~first)
        parents, edges, children = [], [], []
        while len(rest):
            gap = np.bitwise_count(value[rest] ^ value[at[rest]]).astype(np.int64)
            key = at[rest] * (BITS + 1) + gap
            _, lead, back = np.unique(key, return_index=True, return_inverse=True)
            children.append(rest[lead])
            parents.append(at[rest[lead]])
            edges.append(gap[lead])
            at[rest] = rest[lead][back]
            stays = np.ones(len(rest), dtype=bool)
            stays[lead] = False
            rest = rest[stays]
        parent, edge, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, edges, children))
        order = np.argsort(parent * (BITS + 1) + edge, kind="stable")
        self.child, self.code = child[order], (parent * (BITS + 1) + edge)[order]

    def within(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, of one shard at most ``radius`` apart: one chain of them for each component."""
        found_i, found_j = [], []
        n = len(self.value)
        label = np.arange(n)
        stack = [(np.arange(a, min(n, a + FRONTIER // 4)), None) for a in range(0, n, FRONTIER // 4)]
        stack = [(q, self.root[q]) for q, _ in stack]
        while stack:
            query, node = stack.pop()
            gap = np.bitwise_count(self.value[query] ^ self.value[node]).astype(np.int64)
            hit = (gap <= radius) & (node < query)
            if hit.any():
                i, j = join_up(label, node[hit], query[hit])
                found_i.append(i)
                found_j.append(j)
            base = node * (BITS + 1)
            low = np.searchsorted(self.code, base + np.maximum(gap - radius, 0), side="left")
            high = np.searchsorted(self.code, base + np.minimum(gap + radius, BITS), side="right")
            count = high - low
            go = count > 0
            query, low, count = query[go], low[go], count[go]
            if not len(query):
                continue
            ends = np.cumsum(count)
            for a in range(0, len(query), 1 << 14):
                b = min(len(query), a + (1 << 14))
                c = count[a:b]
                offset = np.arange(int(c.sum())) - np.repeat(ends[a:b] - c - (ends[a - 1] if a else 0), c)
                stack.append((np.repeat(query[a:b], c), self.child[np.repeat(low[a:b], c) + offset]))
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that join two sets not joined before; ``label`` is a union-find forest and is brought up to date."""

    def top(x: np.ndarray) -> np.ndarray:
        while True:
            up = label[x]
            if np.array_equal(up, x):
                return x
            x = label[up]

    kept_a, kept_b = [], []
    while len(a):
        ta, tb = top(a), top(b)
        apart = ta != tb
        a, b, ta, tb = a[apart], b[apart], ta[apart], tb[apart]
        if not len(a):
            break
        high, low = np.maximum(ta, tb), np.minimum(ta, tb)
        _, lead = np.unique(high, return_index=True)
        label[high[lead]] = low[lead]
        label[a], label[b] = top(a), top(b)
        kept_a.append(a[lead])
        kept_b.append(b[lead])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *kept_a]), np.concatenate([empty, *kept_b])


def linked(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct values ``fp``, as many as connect all values at most ``radius`` bits apart.

    Every value goes to one shard for each of :func:`shard_masks`. Shards of one
    value are left out; a shard of more than ``SHARD_ROWS`` is cut into blocks by a
    hash and every pair of its blocks is one task's work, so nothing is lost and no
    task holds more than its share.
    """
    masks = shard_masks(radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("shard"))
    sizes = keyed.groupBy("shard").count().where("count > 1")
    blocks = F.ceil(F.col("count") * 2 / SHARD_ROWS)
    mine = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks"))
    dealt = (
        keyed.join(sizes, "shard").withColumn("blocks", F.when(F.col("count") <= SHARD_ROWS, F.lit(1)).otherwise(blocks))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("fp", F.xxhash64("shard", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"))
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush(task: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            i, j = Forest(task, fp.view(np.uint64)).within(radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

        for batch in batches:
            kept.append((batch.column("task").to_numpy(), batch.column("fp").to_numpy()))
            held += batch.num_rows
            if held < 4 * SHARD_ROWS:
                continue
            task, fp = (np.concatenate(x) for x in zip(*kept))
            whole = int(np.searchsorted(task, task[-1], side="left"))  # the last task's rows may go on
            if whole:
                yield flush(task[:whole], fp[:whole])
            kept, held = [(task[whole:], fp[whole:])], len(task) - whole
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*kept)))

    return dealt.repartition("task").sortWithinPartitions("task", "fp").mapInArrow(walk, "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4
) -> DataFrame:
    """doc_id, fp (long) and component_id of each row of ``df``.

    component_id is the smallest doc_id reachable over fingerprints at most
    ``radius`` bits apart; rows of equal fingerprint are always together, whatever
    their number. A null or empty text has fingerprint 0 and links like any other.
    A null doc_id is never the smallest unless a component has no other, whose id is
    then null. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    prints = materialise(fingerprints(df, id_col, text_col, words), "prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(linked(classes.select("fp"), radius))
    named = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = named.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = materialise(named.join(least, "root").select("fp", "component_id"), "of_class")
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
