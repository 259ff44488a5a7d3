"""Spelling variants in the vocabulary of all documents, by search schemes over FM-indexes of both directions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivalent.session import materialise

from .common import bounded_batches
from .line_dedup import large
from .suffix_dedup import suffix_order

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters are a to z and À to ÿ: one Latin-1 byte each. Zero delimits words.
RUN = "[a-zÀ-ÿ]+"
#: Words and letters of one shard, and words that share a half beyond which they are dealt out in blocks.
SHARD_WORDS, SHARD_LETTERS, HALF_WORDS = 40_000, 2_000_000, 40_000
#: Words that are looked for at once, and letters an interval is asked for by reading it; a wider one is asked for every letter.
SEARCH_WORDS, NARROW = 20_000, 64


def words(docs: DataFrame, every: int = 97, least: int = 5) -> DataFrame:
    """word and n of ``docs`` (doc_id, text): runs of letters, A-Z in lower case, of ``least`` letters or more.

    Let h be the CRC-32 of ``<doc_id>:<run>``. Where ``every`` divides h the run loses its letter h % length.
    """
    runs = F.explode(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(RUN), F.lit(0)))
    found = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), runs.alias("run"))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    found = found.where(F.length("run") >= least).select("run", h.alias("h")).withColumn("at", at)
    word = F.when(F.col("h") % every == 0, less).otherwise(F.col("run"))
    return found.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


class Index:
    """FM-index of words read forwards, as a Burrows-Wheeler transform of the delimited words read backwards."""

    def __init__(self, listed: list[bytes]):
        text = np.frombuffer(b"\0" + b"\0".join(listed) + b"\0", np.uint8)[::-1]
        depth = 8
        while depth < max(map(len, listed)) + 3:
            depth *= 2
        self.order = suffix_order(text, depth)
        self.bwt = text[self.order - 1]
        self.n = len(text)
        by_letter = np.argsort(self.bwt, kind="stable")
        self.places = self.bwt[by_letter].astype(np.int64) * (self.n + 1) + by_letter
        self.letters = np.unique(self.bwt)
        self.letters = self.letters[self.letters > 0]
        self.word = len(listed) - np.cumsum(text == 0)  # of the word whose last letter follows a delimiter

    def extend(self, low: np.ndarray, high: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank intervals of the strings one letter longer."""
        base = letter.astype(np.int64) * (self.n + 1)
        return np.searchsorted(self.places, base + low), np.searchsorted(self.places, base + high)

    def followers(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, letter, low, high) of every letter that follows the strings of the intervals."""
        width = high - low
        narrow = np.flatnonzero(width <= NARROW)
        sizes = width[narrow]
        read = np.repeat(low[narrow] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(narrow, sizes) * 256 + self.bwt[read])
        wide = np.flatnonzero(width > NARROW)
        asked = (wide[:, None] * 256 + self.letters[None, :].astype(np.int64)).ravel()
        pairs = np.concatenate([pairs[pairs % 256 > 0], asked])
        which, letter = pairs // 256, pairs % 256
        a, b = self.extend(low[which], high[which], letter)
        there = a < b
        return which[there], letter[there], a[there], b[there]

    def one_error(self, queries: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of the pairs that differ by one letter inserted, deleted or replaced after the first ``exact`` letters.

        The exact part is matched first; then intervals are extended with and without
        an error. Of a run of equal letters the last one is deleted, and a letter is
        inserted after the equal ones, so no pair is found twice.
        """
        size = np.array([len(q) for q in queries])
        flat = np.frombuffer(b"".join(q + b"\0\0" for q in queries), np.uint8)
        begin = np.cumsum(size + 2) - (size + 2)
        zero = np.zeros(len(queries), np.int64)
        low, high = self.extend(zero, zero + self.n, zero)
        q = np.arange(len(queries))
        e_q, e_i, e_low, e_high = (np.zeros(0, np.int64) for _ in range(4))
        hit_q, hit_low = [], []
        at = 0
        while len(q) or len(e_q):
            due = flat[begin[q] + at]
            late = at >= exact[q]
            more = []
            if late.any():
                lq, ll, lh, ld = q[late], low[late], high[late], due[late]
                # delete the letter due here
                gone = (at < size[lq]) & (ld != flat[begin[lq] + np.minimum(at + 1, size[lq])])
                more.append((lq[gone], np.full(gone.sum(), at + 1), ll[gone], lh[gone]))
                # another letter, in its place or before it
                own, inverse = np.unique(ll * (self.n + 1) + lh, return_inverse=True)
                which, letter, a, b = self.followers(own // (self.n + 1), own % (self.n + 1))
                by = np.argsort(which, kind="stable")
                count = np.bincount(which, minlength=len(own))
                first = np.cumsum(count) - count
                times = count[inverse]
                state = np.repeat(np.arange(len(lq)), times)
                pick = by[np.repeat(first[inverse] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                other = letter[pick] != ld[state]
                state, pick = state[other], pick[other]
                more.append((lq[state], np.full(len(state), at), a[pick], b[pick]))
                inside = at < size[lq[state]]
                state, pick = state[inside], pick[inside]
                more.append((lq[state], np.full(len(state), at + 1), a[pick], b[pick]))
            # go on without an error, and exactly after one
            a, b = self.extend(low, high, due)
            live = (a < b) & (at < size[q])
            q, low, high = q[live], a[live], b[live]
            e_q, e_i, e_low, e_high = (np.concatenate([x, *(m[k] for m in more)]) for k, x in enumerate((e_q, e_i, e_low, e_high)))
            a, b = self.extend(e_low, e_high, flat[begin[e_q] + e_i])
            live = a < b
            ended = live & (e_i == size[e_q])
            hit_q.append(e_q[ended])
            hit_low.append(a[ended])
            live &= ~ended
            e_q, e_i, e_low, e_high = e_q[live], e_i[live] + 1, a[live], b[live]
            at += 1
        return np.concatenate(hit_q), self.word[self.order[np.concatenate(hit_low)]]


def shard_neighbours(rows: list[tuple[int, bytes, int, bool, bool]]) -> list[tuple[str, int, int, str]]:
    """(word, number of near words, n of the most frequent one, that one) of ``rows`` (side, word, n, is looked for, may be found).

    Side 0 looks for words that differ after the first half, side 1 for words that differ in it, on words read backwards.
    """
    out = []
    for side in (0, 1):
        counts = {word: n for s, word, n, _, there in rows if s == side and there}
        wanted = sorted({word for s, word, _, asked, _ in rows if s == side and asked})
        if not counts or not wanted:
            continue
        listed = sorted(counts)  # bytes in order are code points in order
        n = np.array([counts[w] for w in listed], np.int64)
        index = Index([w[::-1] for w in listed] if side else listed)
        for begin in range(0, len(wanted), SEARCH_WORDS):
            part = wanted[begin : begin + SEARCH_WORDS]
            half = np.array([len(w) // 2 for w in part])
            sizes = np.array([len(w) for w in part])
            q, near = index.one_error([w[::-1] for w in part] if side else part, sizes - half if side else half)
            if side:
                new = np.array([part[a][: half[a]] != listed[b][: half[a]] for a, b in zip(q.tolist(), near.tolist())], bool)
                q, near = q[new], near[new]
            best = np.lexsort((near, -n[near], q))
            q, near = q[best], near[best]
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
            totals = np.diff(np.append(first, len(q)))
            out += [
                (part[a].decode("latin-1"), t, int(n[b]), listed[b].decode("latin-1"))
                for a, b, t in zip(q[first].tolist(), near[first].tolist(), totals.tolist())
            ]
    return out


def halves(vocabulary: DataFrame) -> DataFrame:
    """side, half, word, n and asked: the halves under which each word is looked for, and those under which it is found.

    A word of m letters is looked for by its first m // 2 letters and by the rest. The
    words near it have m - 1 to m + 1 letters, so each word stands under two openings
    and two endings.
    """
    m = F.length("word")
    half = F.floor(m / 2).cast("int")
    even = m % 2 == 0

    def one(side: int, size: Column, asked: bool) -> Column:
        text = F.right("word", size) if side else F.left("word", size)
        return F.struct(F.lit(side).alias("side"), text.alias("half"), F.lit(asked).alias("asked"))

    both = F.array(
        one(0, half, True), one(0, F.when(even, half - 1).otherwise(half + 1), False),
        one(1, m - half, True), one(1, F.when(even, half + 1).otherwise(half), False))
    return vocabulary.select("word", "n", F.explode(both).alias("h")).select("h.side", "h.half", "word", "n", "h.asked")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, near_n and near (the most frequent near word; of equal ones the first) of the words that have a near word.

    Words that share a half make a group; a task joins groups to shards. A very common
    half's words are dealt out in blocks, and those looked for go to every block.
    """
    rows = materialise(halves(vocabulary), "halves")
    sizes = rows.groupBy("side", "half").agg(F.count("*").alias("size")).where("size > 1")
    sizes = materialise(sizes.withColumn("blocks", F.ceil(F.col("size") / HALF_WORDS).cast("int")), "half_sizes")
    grouped = rows.join(large(sizes), ["side", "half"])
    one = F.col("blocks") == 1
    own = F.when(one, 0).otherwise(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    found_in = grouped.withColumn("block", own).withColumn("asked", F.col("asked") & one).withColumn("listed", F.lit(True))
    asked_in = grouped.where(~one & F.col("asked")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = found_in.unionByName(asked_in.withColumn("listed", F.lit(False))).withColumn("alone", ~one)
    group = ["side", "half", "block"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group).select(*group, "alone", "word", "n", "asked", "listed")
    bounded_batches(vocabulary.sparkSession)

    def as_batch(found):
        columns = list(zip(*found)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "n_near", "near_n", "near"])

    def run(batches):
        held, letters, last, last_alone = [], 0, None, False
        for batch in batches:
            for side, half, block, alone, word, n, asked, listed in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if (side, half, block) != last:
                    if held and (alone or last_alone or len(held) >= SHARD_WORDS or letters >= SHARD_LETTERS):
                        yield as_batch(shard_neighbours(held))
                        held, letters = [], 0
                    last, last_alone = (side, half, block), alone
                held.append((side, word.encode("latin-1"), n, asked, listed))
                letters += len(word)
        if held:
            yield as_batch(shard_neighbours(held))

    found = dealt.mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of ``forms`` (word, form): the last form that following them leads to. Each round doubles the step."""
    steps = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(steps.join(large(onward), "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        steps = moved.select("word", "root")
        if moved.where("next is not null").isEmpty():
            return steps


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = 3, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word (see :func:`words`) that occurs ``least_n`` times or more.

    Words are near if they differ by one letter inserted, deleted or replaced. A word's
    form is its most frequent near word if that is at least ``ratio`` times as frequent
    (else null), its root the end of the chain of forms, or the word itself. Null texts
    are empty; a null id is the empty text in the hash; repeated rows count again; other
    columns are left behind. No such word gives no rows.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text"))
    vocabulary = materialise(words(docs).where(F.col("n") >= least_n), "vocabulary")
    near = materialise(near_words(vocabulary), "near")
    known = vocabulary.join(large(near), "word", "left")
    chosen = F.col("near_n") >= F.lit(ratio) * F.col("n")
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("near")).alias("form"),
        F.when(chosen, F.col("near_n")).alias("form_n"))
    known = materialise(known, "forms")
    last = roots(known.where("form is not null").select("word", "form"))
    return known.join(large(last), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
