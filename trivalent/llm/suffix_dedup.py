"""Repeated byte strings of a fixed length: anchors deal them to shards, a Burrows-Wheeler transform of each shard finds them."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.session import materialise, temporary

from .common import bounded_batches
from .line_dedup import large

#: Bytes whose hash is an anchor's key. A string of ``length`` bytes holds length - ANCHOR + 1 of them; the least hash is its anchor.
ANCHOR = 32
#: Most window starts that are hashed at once, so that a very long text stays small.
STRETCH = 1 << 20
#: Bytes of contexts whose transform is built at once, and most contexts of one key that are not dealt out again by window.
SHARD_BYTES, SHARD_CONTEXTS = 1 << 20, 4096
#: A byte that UTF-8 never has.
END = 0xFF
#: Elements of an interval that are walked before its letters are looked up by rank instead.
WALK = 16
UNSET = 255


@functools.lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, stop) of each anchor of ``text``: it belongs to the windows that start at first up to stop - 1.

    The anchor of a window of ``length`` bytes is the leftmost of its ANCHOR-byte strings
    of least hash. It depends on the window's bytes alone, so equal windows have equal
    anchors at the same place in them.
    """
    w = length - ANCHOR + 1
    up, down = powers(STRETCH + length)
    t = np.frombuffer(text, np.uint8).astype(np.uint64)
    total = np.zeros(len(t) + 1, np.uint64)
    np.cumsum((t + np.uint64(1)) * up[: len(t)], out=total[1:])
    h = (total[ANCHOR:] - total[:-ANCHOR]) * down[: len(t) - ANCHOR + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if w > span:
        least = np.minimum(least[: span - w], least[w - span :])
    place = (least & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    return h[place[first]], place[first], first, np.append(first[1:], len(place))


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """Of each anchor in ``docs`` (doc_id, digest, bytes): doc_id, digest, key, context, start and windows.

    The context are the bytes of all its windows, from ``start`` on; ``context`` is their
    hash with the anchor's place among them. Texts under ``length`` bytes have none.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            ids, digests = batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()
            for doc_id, digest, text in zip(ids, digests, batch.column("bytes").to_pylist()):
                for at in range(0, max(0, len(text) - length + 1), STRETCH):
                    part = text[at : at + STRETCH + length - 1]
                    key, place, first, stop = anchors(part, length)
                    hashes = [
                        xxhash.xxh64_intdigest(part[a : b + length - 1], seed=m - a)
                        for m, a, b in zip(place.tolist(), first.tolist(), stop.tolist())
                    ]
                    rows.append((doc_id, digest, key, np.array(hashes, np.uint64), first + at, stop - first))
            counts = [len(r[2]) for r in rows]
            flat = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in (2, 3, 4, 5)]
            which = pa.array(np.repeat(np.arange(len(rows)), counts))
            owners = [pa.array([r[i] for r in rows], pa.int64()).take(which) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*owners, *(pa.array(x.view(np.int64)) for x in flat)],
                names=["doc_id", "digest", "key", "context", "start", "windows"],
            )

    return docs.mapInArrow(run, "doc_id long, digest long, key long, context long, start long, windows long")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text``, ordered by their first ``depth`` bytes (a power of two times eight) by doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)
    values = key[order]
    rank = np.zeros(n, np.int64)
    places, known = np.arange(n), 8
    while True:
        fresh = np.concatenate([[True], values[1:] != values[:-1]])
        start = np.flatnonzero(fresh)
        sizes = np.diff(np.append(start, len(values)))
        rank[order[places]] = np.repeat(places[start], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        if known >= depth or not len(places):
            return order.astype(np.int32)
        own = order[places]
        later = own + known
        follow = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        pair = (rank[own] << 32) | follow
        turn = np.argsort(pair)
        order[places], values = own[turn], pair[turn]
        known *= 2


def common_prefixes(bwt: np.ndarray, depth: int) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in order, where under ``depth``; else UNSET.

    Interval by interval, shortest strings first: where a boundary of length l appeared,
    a letter c that stands before suffixes on both sides of it parts the strings that
    begin with c at length l + 1. The letters beside a boundary are read off the suffixes
    of the two intervals that meet there; of an interval of over WALK suffixes they are
    found by rank. Lengths come in increasing order, so the first one a place gets is right.
    """
    n = len(bwt)
    by_letter = np.argsort(bwt, kind="stable").astype(np.int32)  # place i holds the suffix whose step back leads to i
    back = np.empty(n, np.int32)
    back[by_letter] = np.arange(n, dtype=np.int32)
    counts = np.bincount(bwt, minlength=256)
    begins = np.concatenate([[0], np.cumsum(counts)])
    letters = np.flatnonzero(counts)
    same = bwt[by_letter[1:]] == bwt[by_letter[:-1]]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    after[by_letter[:-1][same]] = by_letter[1:][same]
    before[by_letter[1:][same]] = by_letter[:-1][same]

    shared = np.full(n + 1, UNSET, np.uint8)
    new = begins[letters].astype(np.int32)
    shared[new] = shared[n] = shared[0] = 0
    new = new[new > 0]
    for level in range(depth - 1):
        if not len(new):
            break
        found = []
        far_left, far_right = np.full(len(new), UNSET, np.uint8), np.full(len(new), UNSET, np.uint8)
        live = np.arange(len(new))
        for j in range(1, WALK + 1):  # the interval that ends at the boundary, from its end
            b = new[live]
            x = b - j
            found.append(back[x[after[x] >= b]] + 1)
            far_left[live] = shared[x]
            live = live[shared[x] == UNSET]
            if not len(live):
                break
        live = np.arange(len(new))
        for j in range(WALK):  # the interval that begins there
            b = new[live]
            y = b + j
            found.append(back[y[before[y] < b]])
            far_right[live] = shared[y + 1]
            live = live[shared[y + 1] == UNSET]
            if not len(live):
                break
        # A long interval needs no look if what was parted from it is one interval and has been walked.
        settled = (far_left < level) | (far_right < level) | ((far_left != UNSET) & (far_right != UNSET))
        rest = new[~settled]
        if len(rest):
            for c in letters:
                found.append((begins[c] + np.searchsorted(by_letter[begins[c] : begins[c + 1]], rest)).astype(np.int32))
        new = np.concatenate(found)
        new = np.unique(new[shared[new] == UNSET])
        shared[new] = level + 1
    return shared[:n]


def repeated_windows(contexts: list[bytes], weights: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to) of the runs of window starts whose ``length`` bytes occur twice or more, counted by weight."""
    sizes = np.array([len(c) + 1 for c in contexts])
    text = np.frombuffer(b"".join(c + b"\xff" for c in contexts), np.uint8)
    depth = 8
    while depth <= length:
        depth *= 2
    order = suffix_order(text, depth)
    shared = common_prefixes(text[order - 1], length)  # the first suffix is preceded by the last END
    of_place = np.empty(len(text), np.int64)
    of_place[order] = np.cumsum(shared != UNSET)
    starts = np.cumsum(sizes) - sizes
    n_windows = sizes - length
    owner = np.repeat(np.arange(len(contexts)), n_windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    string = of_place[starts[owner] + offset]
    often = np.bincount(string, weights=weights[owner])[string] > 1.5
    edge = np.concatenate([[True], (owner[1:] != owner[:-1]) | (often[1:] != often[:-1])]) if len(owner) else often
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(owner)) - 1
    hit = often[first] if len(owner) else often
    return owner[first][hit], offset[first][hit], offset[last][hit] + 1


def search_shards(contexts: DataFrame, length: int) -> DataFrame:
    """key, context, low and high (window starts from low up to high - 1 repeat) of ``contexts`` (key, context, weight, bytes).

    Contexts of one key stay together; a task joins keys to shards of about SHARD_BYTES.
    """
    bounded_batches(contexts.sparkSession)

    def flush(rows):
        which, low, high = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows], float), length)
        keys, names = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (keys[which], names[which], low, high)], names=["key", "context", "low", "high"])

    def run(batches):
        rows, size, last, seen = [], 0, None, set()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "weight", "bytes"))):
                if row[0] != last:
                    if size >= SHARD_BYTES:
                        yield flush(rows)
                        rows, size = [], 0
                    last, seen = row[0], set()
                if row[1] in seen:  # from a row equal in id and text
                    continue
                seen.add(row[1])
                rows.append(row)
                size += len(row[3])
        if rows:
            yield flush(rows)

    dealt = contexts.select("key", "context", "weight", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, context long, low long, high long")


def search_windows(contexts: DataFrame, length: int) -> DataFrame:
    """What :func:`search_shards` returns, of keys with very many contexts: dealt out again, window by window.

    Equal windows combine where they are (two 64-bit hashes), so no task holds the contexts of such a key.
    """
    bounded_batches(contexts.sparkSession)

    def run(batches):
        for batch in batches:
            for key, name, weight, text in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "weight", "bytes"))):
                n = len(text) - length + 1
                both = [
                    pa.array(np.array([xxhash.xxh64_intdigest(text[i : i + length], seed=s) for i in range(n)], np.uint64).view(np.int64))
                    for s in (1, 2)
                ]
                fixed = [pa.array(np.full(n, x, np.int64)) for x in (key, name, weight)]
                yield pa.RecordBatch.from_arrays(
                    [*fixed, pa.array(np.arange(n)), *both], names=["key", "context", "weight", "low", "h1", "h2"])

    windows = materialise(
        contexts.mapInArrow(run, "key long, context long, weight long, low long, h1 long, h2 long"), "windows")
    often = windows.groupBy("h1", "h2").agg(F.sum("weight").alias("total")).where("total > 1").select("h1", "h2")
    found = windows.join(large(materialise(often, "often")), ["h1", "h2"])
    return found.select("key", "context", "low", (F.col("low") + 1).alias("high"))


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, digest and ranges (set of start, stop: bytes, stop exclusive) that cover the repeated strings of ``docs``."""
    held = occurrences(docs, length)
    counted = held.groupBy("key").agg(F.count("*").alias("n"), F.min("context").alias("c"), F.max("context").alias("d")).where("n > 1")
    counted = materialise(counted.select("key", (F.col("c") != F.col("d")).alias("mixed")), "anchors")
    again = materialise(held.join(large(counted), "key"), "occurrences")

    # Equal contexts are one with a weight. A key that has no other context needs no search: all its windows repeat.
    one = F.min(F.struct("doc_id", "digest", "start", "windows")).alias("one")
    contexts = again.where("mixed").groupBy("key", "context").agg(F.count("*").alias("weight"), one)
    contexts = materialise(contexts.select("key", "context", "weight", "one.*"), "contexts")
    of_key = contexts.groupBy("key").agg(F.count("*").alias("n_contexts"), F.min("weight").alias("least"))
    of_key = materialise(of_key.where("least = 1").select("key", "n_contexts"), "keys")
    wanted = contexts.join(large(of_key), "key")
    slices = wanted.groupBy("doc_id", "digest").agg(
        F.collect_list(F.struct("key", "context", "weight", "n_contexts", "start", "windows")).alias("slices"))
    mine = docs["doc_id"].eqNullSafe(slices["doc_id"]) & (docs["digest"] == slices["digest"])
    cut = docs.join(large(slices), mine).select(F.explode("slices").alias("s"), "bytes")
    cut = cut.select("s.key", "s.context", "s.weight", "s.n_contexts",
                     F.substring("bytes", F.col("s.start").cast("int") + 1, F.col("s.windows").cast("int") + length - 1).alias("bytes"))
    cut = materialise(cut, "cut")
    found = search_shards(cut.where(F.col("n_contexts") <= SHARD_CONTEXTS), length)
    hot = cut.where(F.col("n_contexts") > SHARD_CONTEXTS)
    if not hot.isEmpty():
        found = found.unionByName(search_windows(hot, length))
    rest = contexts.join(large(of_key), "key", "left_anti").select("key", "context", F.lit(0).cast("long").alias("low"), F.col("windows").alias("high"))
    verdict = materialise(found.unionByName(rest), "verdict")

    whole = again.where("not mixed").select("doc_id", "digest", "start", (F.col("start") + F.col("windows")).alias("stop"))
    partly = again.where("mixed").join(large(verdict), ["key", "context"]).select(
        "doc_id", "digest", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("stop"))
    each = whole.unionByName(partly).select("doc_id", "digest", F.struct("start", (F.col("stop") + length - 1).alias("stop")).alias("range"))
    return each.groupBy("doc_id", "digest").agg(F.collect_set("range").alias("ranges"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs of the bytes that ``ranges`` cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["stop"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, stop: bytes, stop exclusive) and kept (binary) of each row of ``df``.

    Each byte of a string of ``length`` UTF-8 bytes that also starts elsewhere, in another
    row or in the same one, is removed; strings are judged on the input, never cross rows,
    and overlaps count. What is kept may cut a character in two, hence binary. Null texts
    are empty; texts under ``length`` bytes stay; equal rows, with or without an id, are
    elsewhere to each other. Other columns are left behind. An empty table gives an empty
    result. ``length`` is from 64 to 254.
    """
    if not 64 <= length <= 254:
        raise ValueError("length must be from 64 to 254")
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("bytes"))
    with temporary():
        gone = materialise(repeated_ranges(docs, length), "gone", lasting=True)
    mine = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (docs["digest"] == gone["digest"])
    rows = docs.join(large(gone), mine, "left").select(docs["doc_id"], docs["bytes"], gone["ranges"])
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, ranges in zip(batch.column("bytes").to_pylist(), batch.column("ranges").to_pylist()):
                runs = merged(ranges)
                edges = [0, *(x for r in runs for x in r), len(text)]
                sizes.append(len(text))
                removed.append([{"start": a, "stop": b} for a, b in runs])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start: long, stop: long>>, kept binary")
