"""Near duplicates by the exact Jaccard similarity of word shingles: fingerprints propose, then prefixes; whole sets decide."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trivalent.session import discard, materialise, small_side, temporary

from . import simhash
from .common import bounded_batches
from .components import components
from .line_dedup import large

#: Most shingles that are ordered by their frequency, and how many prefixes hold such a one at least, among those of one
#: row in ORDER_SHARE. Any order gives the same result.
COMMON, OFTEN, ORDER_SHARE = 100_000, 8, 8
#: Holders of a token that a task compares with each other at once.
BLOCK = 4096
#: Bits of the smallest and largest parity map of a set.
LEAST_BITS, MOST_BITS = 512, 16_384


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A-Z in lower case; fewer words are one shingle, no word gives none.

    Words are what ASCII white space parts.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + words])) for i in range(n)), dtype=np.uint64, count=n))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, share: Fraction) -> np.ndarray:
    """The first n - ceil(share n) + 1 of ``hashes``: by value, then those in ``common`` (sorted) by their ``rank``.

    Two sets of similarity ``share`` or more have one of these in common, whatever the order.
    """
    n = len(hashes)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        last = common[at] == hashes
        late = hashes[last]
        hashes = np.concatenate([hashes[~last], late[np.argsort(rank[at[last]], kind="stable")]])
    return hashes[: n + 1 - -(-n * share.numerator // share.denominator)] if n else hashes


def parities(hashes: np.ndarray) -> bytes:
    """How many of ``hashes`` fall to each bit, modulo 2. Two sets differ in at least as many hashes as their maps in bits.

    A larger map folds to a smaller one: halves of it combine by exclusive or.
    """
    size = LEAST_BITS
    while size < MOST_BITS and 2 * size <= len(hashes):
        size *= 2
    odd = np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words, folded to ``width`` words."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def may_link(one: tuple[int, bytes], sizes: np.ndarray, maps: dict[int, tuple[np.ndarray, np.ndarray]], share: Fraction) -> np.ndarray:
    """Which sets (``sizes``, and ``maps``: places and words by width) sizes and parities do not rule out for ``one``."""
    p, q = share.numerator, share.denominator
    n, words = one[0], np.frombuffer(one[1], np.uint64)[None, :]
    fits = (np.minimum(n, sizes) * q >= np.maximum(n, sizes) * p)
    for width, (places, table) in maps.items():
        least = min(width, words.shape[1])
        apart = np.bitwise_count(folded(words, least) ^ folded(table, least)).sum(axis=1).astype(np.int64)
        # of n + m shingles at most the part (q - p) / (q + p) is in one set alone
        fits[places] &= apart * (p + q) <= (n + sizes[places]) * (q - p)
    return fits


def by_width(maps: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    widths = np.array([len(m) // 8 for m in maps])
    return {
        int(w): (at, np.frombuffer(b"".join(maps[i] for i in at.tolist()), np.uint64).reshape(len(at), w))
        for w in np.unique(widths) for at in [np.flatnonzero(widths == w)]
    }


def medoid(maps: dict[int, tuple[np.ndarray, np.ndarray]]) -> int:
    """The place of the set whose parities are nearest to what most sets of the commonest width have."""
    places, table = max(maps.values(), key=lambda m: len(m[0]))
    bits = np.unpackbits(table.view(np.uint8), axis=1)
    most = (2 * bits.sum(axis=0) > len(bits)).astype(np.uint8)
    return int(places[np.argmin((bits != most).sum(axis=1))])


def signatures(docs: DataFrame, words: int, share: Fraction, common: list[int]) -> DataFrame:
    """doc_id, digest, set_id (a hash of the set), n (its size), fp (its SimHash), tokens (its prefix) and bits (its parities) of ``docs`` (doc_id, digest, text)."""
    bounded_batches(docs.sparkSession)
    values = np.array(common, dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    values, rank = values[order], order  # ``common`` starts with the rarest

    def run(batches):
        for batch in batches:
            ids, sizes, prints, tokens, bits = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, words)
                ids.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                prints.append(simhash.majority(found))
                tokens.append(prefix(found, values, rank, share).view(np.int64))
                bits.append(parities(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)),
                 pa.array(sizes, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)),
                 pa.array(tokens, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["doc_id", "digest", "set_id", "n", "fp", "tokens", "bits"],
            )

    return docs.mapInArrow(run, "doc_id long, digest long, set_id long, n long, fp long, tokens array<long>, bits binary")


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """set_id and hashes of each row of ``docs`` (set_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [shingles(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(made, pa.list_(pa.int64()))], names=["set_id", "hashes"])

    return docs.mapInArrow(run, "set_id long, hashes array<long>")


def in_groups(batches, keys: list[str], columns: list[str], most: int | None = None):
    """(key, rows) of batches sorted by ``keys``; a group of over ``most`` rows comes in several parts."""
    last, rows = None, []
    for batch in batches:
        for key, row in zip(zip(*(batch.column(k).to_pylist() for k in keys)), zip(*(batch.column(c).to_pylist() for c in columns))):
            if key != last or len(rows) == most:
                if rows:
                    yield last, rows
                last, rows = key, []
            rows.append(row)
    if rows:
        yield last, rows


def as_pairs(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def by_fingerprint(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): sets whose fingerprints (set_id, fp) are equal or linked by :func:`simhash.linked`; the first set of a fingerprint stands for it."""
    first = materialise(prints.groupBy("fp").agg(F.min("set_id").alias("a")), "prints")
    same = prints.join(large(first), "fp").select("a", F.col("set_id").alias("b"))
    links = materialise(simhash.linked(first.select("fp"), radius).withColumnsRenamed({"a": "fp", "b": "other"}), "near_prints")
    near = links.join(large(first), "fp").select("a", F.col("other").alias("fp")).join(large(first.withColumnRenamed("a", "b")), "fp").select("a", "b")
    found = materialise(same.unionByName(near).where("a <> b").distinct(), "proposed")
    discard(first, links)
    return found


def with_root(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """``groups`` with the root of each set_id; one that is in no link is its own."""
    named = groups.join(large(roots.withColumnRenamed("node", "set_id")), "set_id", "left")
    return named.withColumn("root", F.coalesce("root", "set_id"))


def spokes_of(groups: DataFrame, share: Fraction) -> DataFrame:
    """(a, b): the most central holder a of each group (token, part; set_id, n, bits, root) and each holder b of another root that may be similar to it."""
    bounded_batches(groups.sparkSession)

    def run(batches):
        made: set[tuple[int, int]] = set()
        for _, rows in in_groups(batches, ["token", "part"], ["set_id", "n", "bits", "root"], 2 * BLOCK):
            maps = by_width([r[2] for r in rows])
            hub = medoid(maps)
            fits = may_link(rows[hub][1:3], np.array([r[1] for r in rows]), maps, share) & (np.array([r[3] for r in rows]) != rows[hub][3])
            made.update((rows[hub][0], rows[i][0]) for i in np.flatnonzero(fits).tolist())
            if len(made) >= BLOCK:
                yield as_pairs(made)
                made = set()
        yield as_pairs(made)

    return groups.repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(run, "a long, b long").distinct()


def pairs_of(groups: DataFrame, share: Fraction) -> DataFrame:
    """(a, b), a < b: holders of one token, in blocks i and j of it (of about BLOCK / 2 rows each), of different roots, that may be similar."""
    bounded_batches(groups.sparkSession)

    def run(batches):
        for (_, i, j), rows in in_groups(batches, ["token", "i", "j"], ["set_id", "n", "bits", "root", "block"]):
            sizes, roots, blocks = (np.array([r[k] for r in rows]) for k in (1, 3, 4))
            ids = np.array([r[0] for r in rows])
            maps, made = by_width([r[2] for r in rows]), set()
            for x in np.flatnonzero(blocks == i).tolist():
                fits = may_link(rows[x][1:3], sizes, maps, share) & (roots != roots[x])
                fits &= (ids > ids[x]) if i == j else (blocks == j)
                made.update((min(ids[x], y), max(ids[x], y)) for y in ids[fits].tolist())
            yield as_pairs({(int(a), int(b)) for a, b in made})

    dealt = groups.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, words: int, share: Fraction) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets are similar enough. Sets meet a's, which travels once for all its pairs."""
    p, q = share.numerator, share.denominator
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "wanted")
    holder = materialise(first.join(large(wanted), "set_id").select("set_id", "doc_id", "digest"), "holders")
    same_row = docs["doc_id"].eqNullSafe(holder["doc_id"]) & (docs["digest"] == holder["digest"])
    texts = docs.join(small_side(holder), same_row).select("set_id", "text")
    found = materialise(whole_sets(texts, words), "sets")
    none = F.lit(None).cast("long")
    left = found.join(large(pairs.select(F.col("a").alias("set_id")).distinct()), "set_id").select(F.col("set_id").alias("a"), none.alias("b"), "hashes")
    right = pairs.join(large(found), F.col("b") == F.col("set_id")).select("a", "b", "hashes")
    bounded_batches(docs.sparkSession)

    def run(batches):
        own, hub = None, None
        for batch in batches:
            made = set()
            hashes = batch.column("hashes")
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                these = hashes[i].values.to_numpy()
                if b is None:
                    own, hub = a, these
                    continue
                assert own == a
                shared = len(np.intersect1d(hub, these, assume_unique=True))
                if shared * q >= (len(hub) + len(these) - shared) * p:
                    made.add((a, b))
            yield as_pairs(made)

    both = left.unionByName(right).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    links = materialise(both.mapInArrow(run, "a long, b long"), "similar")
    discard(wanted, holder, found)
    return links


def similar_sets(docs: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """set_id, doc_id, digest and root of each distinct set in ``docs`` (doc_id, digest, text), with the first row that has it.

    Sets of one root are linked. First those are compared whose fingerprints the BK-trees
    link within ``radius`` bits. That misses sets of lesser similarity, but every pair at
    ``similarity`` or more shares a token of their prefixes; tokens with the same holders
    count once. So each holder of a token is compared with the most central one, if they
    are still apart: a large group of near copies
    is joined by as many pairs as it has members. Then holders that are still apart
    are compared with each other, block against block: all pairs, less those that sizes
    and parities rule out.
    """
    share = Fraction(str(similarity))
    few = docs.where(F.pmod("digest", F.lit(ORDER_SHARE)) == 0)
    counts = signatures(few, words, share, []).select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= OFTEN)
    common = [r["token"] for r in counts.orderBy(F.desc("count"), "token").limit(COMMON).collect()][::-1]

    rows = materialise(signatures(docs, words, share, common), "signatures")
    first = rows.groupBy("set_id").agg(F.min(F.struct("doc_id", "digest")).alias("row"))
    first = materialise(first.select("set_id", "row.doc_id", "row.digest"), "first")
    own = rows.join(small_side(first), ["set_id", "doc_id", "digest"], "left_semi")
    proposed = by_fingerprint(own.select("set_id", "fp").distinct(), radius)
    links = verified(proposed, first, docs, words, share)
    roots = components(links)
    # One shuffle of the tokens; those with one holder, nearly all, go no further. Hashes do not compress.
    holders = F.count("*").over(Window.partitionBy("token"))
    held = own.select(F.explode("tokens").alias("token"), "set_id").withColumn("holders", holders).where("holders > 1")
    held = materialise(held.select("token", "set_id").distinct(), "held")
    alike = held.groupBy("token").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.min("set_id").alias("low"), F.max("set_id").alias("high"))
    kept = alike.where("m > 1").groupBy("m", "x", "low", "high").agg(F.min("token").alias("token"))
    kept = materialise(kept.select("token", "m"), "tokens")
    groups = held.join(large(kept), "token").join(large(own.select("set_id", "n", "bits").dropDuplicates(["set_id"])), "set_id")
    groups = materialise(groups.select("token", "m", "set_id", "n", "bits"), "groups")
    discard(rows, held, kept)

    parts = F.ceil(F.col("m") / BLOCK)
    order = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = proposed.select(order.alias("pair")).select("pair.*")
    spokes = spokes_of(with_root(groups, roots).withColumn("part", F.pmod(F.xxhash64("set_id"), parts)), share)
    spokes = materialise(spokes, "spokes")
    tried = tried.unionByName(spokes.select(order.alias("pair")).select("pair.*"))
    if not spokes.isEmpty():
        links = links.unionByName(verified(spokes, first, docs, words, share))
        roots = components(links)
    named = with_root(groups, roots)
    apart = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    mixed = materialise(named.join(large(materialise(apart, "apart")), "token"), "mixed")
    blocks = F.ceil(F.col("m") / (BLOCK // 2)).cast("int")
    block = F.pmod(F.xxhash64("set_id"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = mixed.withColumn("block", block).withColumn("other", other)
    dealt = dealt.select("token", "set_id", "n", "bits", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    cross = pairs_of(dealt, share)
    cross = materialise(cross.join(large(tried), ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        roots = components(links.unionByName(verified(cross, first, docs, words, share)))
    discard(groups, mixed)
    return first.join(large(roots.withColumnRenamed("node", "set_id")), "set_id", "left").select(
        "set_id", "doc_id", "digest", F.coalesce("root", "set_id").alias("root"))


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 4
) -> DataFrame:
    """The rows of ``df``, all columns, less the near duplicates: of each group the row of smallest id stays.

    A group is what links of Jaccard similarity ``similarity`` or more of the sets of
    word shingles connect; every such link counts and no other does, whatever ``radius``
    (the bits within which fingerprints propose links before prefixes do). Texts without a
    word (null ones too) are equal. Of rows with one id in a group the first by the hash
    of its set, then of its text, stays; of rows equal in id and text any one. Rows
    without an id are all kept. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    with temporary():
        found = similar_sets(docs.where("doc_id is not null"), words, similarity, radius)
        first = found.groupBy("root").agg(F.min(F.struct("doc_id", "set_id", "digest")).alias("first"))
        first = materialise(first.select("first.doc_id", "first.digest"), "keepers", lasting=True)
    own = (df[id_col].cast("long") == first["doc_id"]) & (F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))) == first["digest"])
    return (
        df.where(F.col(id_col).isNotNull()).join(large(first), own, "left_semi").dropDuplicates([id_col, text_col])
        .unionByName(df.where(F.col(id_col).isNull())).select(*df.columns)
    )
