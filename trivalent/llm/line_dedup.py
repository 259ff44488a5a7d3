"""Passages of lines that stand in several documents, by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.session import materialise, temporary

from .common import bounded_batches

WORD = r"[^ \t-\r]+"


def large(df: DataFrame) -> DataFrame:
    """A side that grows with the corpus: joined by sorting both sides, never broadcast, so plans are alike at every size."""
    return df.hint("merge")


def hashed_lines(docs: DataFrame) -> DataFrame:
    """One row a line: doc_id, row (a hash of the text), pos, h and next_h (hashes of the line and the next), words and cut.

    cut: the rolling hash over this line's and the next line's digest starts with a
    zero (one of sixteen), which bounds how long a chunk grows.
    """
    lines = F.split("text", "\n", -1)
    each = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.md5(x.cast("binary")).alias("m"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), each.alias("lines"))
    rows = rows.select("doc_id", "row", "lines", F.posexplode("lines").alias("pos", "line"))
    follower = F.get("lines", F.col("pos") + 1)
    roll = F.md5(F.concat(F.col("line.m"), follower["m"]).cast("binary"))
    return rows.select(
        "doc_id", "row", "pos", F.col("line.h").alias("h"), follower["h"].alias("next_h"), F.col("line.w").alias("words"),
        F.coalesce(roll.startswith("0"), F.lit(True)).alias("cut"),
    )


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, row, start, stop (line numbers, both in), words and key of the chunks of lines that other lines repeat.

    Between two lines there is a boundary unless the pair is as frequent, in all
    documents, as either line, and more than once; or where the rolling hash cuts.
    That depends on the two lines alone, so the chunks inside a shared passage are
    the same wherever it stands, and its ends are boundaries wherever it is set among
    other lines.
    """
    lines = materialise(hashed_lines(docs), "lines")
    often = materialise(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    pairs = lines.where("not cut").groupBy("h", "next_h").agg(F.count("*").alias("n")).where("n > 1")
    glued = pairs.join(large(often), ["h", "n"]).join(large(often.select(F.col("h").alias("next_h"), "n")), ["next_h", "n"])
    pair = F.xxhash64("h", "next_h").alias("pair")
    glued = materialise(glued.select(pair, F.lit(True).alias("glued")).dropDuplicates(["pair"]), "glued")
    # Stored sides and a key of its own for each join, so that Spark can split the partition of a very common line or pair.
    marked = lines.join(large(often.select("h")), "h").withColumn("pair", pair).join(large(glued), "pair", "left")
    in_doc = Window.partitionBy("doc_id", "row").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(in_doc)
    fresh = F.coalesce((gap > 1) | ((gap == 1) & F.lag("glued").over(in_doc).isNull()), F.lit(True))
    numbered = marked.withColumn("fresh", fresh.cast("int")).withColumn("chunk", F.sum("fresh").over(in_doc))
    chunks = numbered.groupBy("doc_id", "row", "chunk").agg(
        F.min("pos").alias("start"), F.max("pos").alias("stop"),
        F.array_sort(F.collect_set(F.struct("pos", "h", "words"))).alias("own"),
    )
    return chunks.select(
        "doc_id", "row", "start", "stop", F.aggregate("own", F.lit(0), lambda n, x: n + x["words"]).alias("words"),
        F.xxhash64(F.transform("own", lambda x: x["h"])).alias("key"),
    )


def in_runs(chunks: DataFrame, min_words: int) -> DataFrame:
    """The chunks that stand, with the chunks right before and after them, in a run of ``min_words`` words or more."""
    in_doc = Window.partitionBy("doc_id", "row").orderBy("start")
    fresh = F.coalesce(F.col("start") - F.lag("stop").over(in_doc) > 1, F.lit(True)).cast("int")
    run = chunks.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(in_doc))
    total = F.sum("words").over(Window.partitionBy("doc_id", "row", "run"))
    return run.withColumn("total", total).where(F.col("total") >= min_words).drop("total", "fresh")


def sequences(starts: list[int], stops: list[int], words: list[int], keys: list[int], min_words: int) -> Iterator[tuple[int, int, int]]:
    """(key, start, stop): from each chunk on, and up to each chunk, the fewest adjoining chunks of ``min_words`` words."""
    prime, base = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
    n = len(starts)
    total, rolled, powers, run = [0], [0], [1], []
    for i in range(n):
        total.append(total[-1] + words[i])
        rolled.append((rolled[-1] * base + (keys[i] + (1 << 63)) + 1) % prime)
        powers.append(powers[-1] * base % prime)
        run.append(run[-1] if i and starts[i] == stops[i - 1] + 1 else i)

    def of(a: int, b: int) -> tuple[int, int, int]:
        return (rolled[b + 1] - rolled[a] * powers[b + 1 - a]) % prime, starts[a], stops[b]

    found, b, a = set(), 0, 0
    for i in range(n):
        b = max(b, i)
        while b < n and total[b + 1] - total[i] < min_words:
            b += 1
        if b < n and run[b] <= i:
            found.add((i, b))
        while a < i and total[i + 1] - total[a + 1] >= min_words:
            a += 1
        if total[i + 1] - total[a] >= min_words and run[i] <= a:
            found.add((a, i))
    yield from (of(*x) for x in sorted(found))


def in_one_earlier(chunks: DataFrame, min_words: int) -> DataFrame:
    """The chunks inside a sequence of adjoining chunks, of ``min_words`` words, that stands together in one document of smaller id.

    All such sequences are unions of the fewest chunks from, or up to, each of them.
    """
    bounded_batches(chunks.sparkSession)
    own = F.array_sort(F.collect_set(F.struct("start", "stop", "words", "key")))
    of_doc = chunks.groupBy("doc_id", "row").agg(own.alias("own"), F.sum("words").alias("total")).where(F.col("total") >= min_words)
    of_doc = of_doc.select("doc_id", "row", *[F.col(f"own.{c}").alias(c) for c in ("start", "stop", "words", "key")])

    def run(batches):
        for batch in batches:
            made: list[tuple] = []
            for doc_id, row, *columns in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "start", "stop", "words", "key"))):
                made += [(doc_id, row, *x) for x in sequences(*columns, min_words)]
            columns = list(zip(*made)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "row", "sequence", "start", "stop"])

    found = materialise(of_doc.mapInArrow(run, "doc_id long, row long, sequence long, start long, stop long"), "sequences")
    first = found.groupBy("sequence").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    first = materialise(first.where("first_id < last_id").select("sequence", "first_id"), "first_sequences")
    again = found.join(large(first), "sequence").where("doc_id > first_id")
    reach = materialise(again.groupBy("doc_id", "row", "start").agg(F.max("stop").alias("reach")), "reach")
    before = Window.partitionBy("doc_id", "row").orderBy("start")
    marked = chunks.join(large(reach), ["doc_id", "row", "start"], "left").withColumn("reach", F.max("reach").over(before))
    return marked.where("reach >= stop").select(*chunks.columns)


def chunk_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (doc_id, row, start, stop, ...) with the text of their lines."""
    fields = [c for c in wanted.columns if c not in ("doc_id", "row")]
    of_doc = wanted.groupBy("doc_id", "row").agg(F.collect_set(F.struct(*fields)).alias("wanted"))
    found = docs.withColumn("row", F.xxhash64("text")).join(large(of_doc), ["doc_id", "row"])
    found = found.select("doc_id", "row", F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("one"))
    text = F.array_join(F.slice("lines", F.col("one.start") + 1, F.col("one.stop") - F.col("one.start") + 1), "\n")
    return found.select("doc_id", "row", "one.*", text.alias("passage")).distinct()


def passages_to_remove(docs: DataFrame, min_words: int, together: bool = False) -> DataFrame:
    """doc_id, row and ranges (sorted array of start, stop): runs of lines that repeat chunks of documents of smaller id."""
    chunks = materialise(repeated_chunks(docs), "chunks")
    first = chunks.groupBy("key").agg(
        F.min(F.struct("doc_id", "row", "start", "stop")).alias("first"), F.max("doc_id").alias("last_id"))
    first = materialise(first.where("first.doc_id < last_id").select("key", "first"), "first")
    again = chunks.join(large(first), "key").where("doc_id <> first.doc_id")
    if together:
        again = in_one_earlier(chunks, min_words).join(large(first), "key")
    else:
        again = in_runs(again, min_words).drop("run")
    again = materialise(again, "again")
    # Byte comparison: equal hashes only propose; the lines' text must equal that of the first place.
    originals = again.select("first.*", "key", F.lit(0).alias("words"), F.lit(True).alias("original")).distinct()
    copies = again.select("doc_id", "row", "start", "stop", "key", "words", F.lit(False).alias("original"))
    texts = materialise(chunk_texts(docs, originals.unionByName(copies.select(*originals.columns))), "passages")
    original = materialise(texts.where("original").select("key", F.col("passage").alias("first_passage")).distinct(), "originals")
    same = texts.where("not original").join(large(original), "key").where("passage = first_passage")
    kept = in_runs(same.select("doc_id", "row", "start", "stop", "words"), min_words)
    runs = kept.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("ranges"))


def without(lines: Column, ranges: Column) -> Column:
    """``lines`` less the sorted, disjoint ``ranges``."""
    n = F.size(ranges)

    def between(i: Column) -> Column:
        low = F.when(i == 0, F.lit(0)).otherwise(F.get(ranges, i - 1)["stop"] + 1)
        high = F.when(i == n, F.size(lines)).otherwise(F.get(ranges, i)["start"])
        return F.slice(lines, low + 1, F.greatest(high - low, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), n), between))


def remove_repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, together: bool = False,
) -> DataFrame:
    """``df``, all rows and columns, with the text less its repeated passages, and the column ``removed_ranges``.

    A chunk of lines (see :func:`repeated_chunks`) repeats if it stands in a document
    of smaller id as well; there it stays. Runs of adjoining repeated chunks are
    removed where they hold ``min_words`` words or more, so short lines that many
    documents share (licence lines, greetings) stay. With ``together`` those words must
    also stand together in one document of smaller id; without it (op8, as its SQL
    says) each chunk may come from another. A document all of whose lines
    go keeps an empty text. Rows that share an id are never each other's copies; rows
    without an id and null texts are left as they are and nothing is compared with them.
    removed_ranges (array of start and stop, line numbers from 0, both in) is null
    where nothing was removed. An empty table gives an empty result.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    docs = docs.where("doc_id is not null and text is not null")
    with temporary():
        gone = materialise(passages_to_remove(docs, min_words, together), "gone", lasting=True)
    text = df[text_col].cast("string")
    rows = df.join(large(gone), (gone["doc_id"] == df[id_col].cast("long")) & (gone["row"] == F.xxhash64(text)), "left")
    ranges = gone["ranges"]
    kept = F.when(ranges.isNull(), text).otherwise(F.array_join(without(F.split(text, "\n", -1), ranges), "\n"))
    own = [kept.alias(c) if c == text_col else df[c] for c in df.columns if c != "removed_ranges"]
    return rows.select(*own, ranges.alias("removed_ranges"))
