"""Benchmark items in documents, by exact pieces and bit-parallel edit distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_and_text

_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def plain(text: str) -> str:
    """Text for comparison: A-Z in lower case, other ASCII than letters and digits as single spaces, one character a UTF-8 byte."""
    return b" ".join(text.encode().lower().translate(_KEPT).split()).decode("latin-1")


def best_place(pattern: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to the pattern; of equal ones the first to end (Myers 1999).

    ``pattern`` has for each character the bit mask of its places. Columns of the
    dynamic-programming table are kept as the bits of their vertical steps.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    get = pattern.get
    for j, c in enumerate(text, 1):
        same = get(c, 0)
        vertical = same | minus
        horizontal = (((same & plus) + plus) ^ plus) | same
        up = minus | ~(horizontal | plus)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, j
    return best, end


def budget(item: str, rate: float) -> int:
    """Edits that an item (as :func:`plain` gives it) may have: ``rate`` a character, or its longest word if that is an eighth of it at most."""
    return max(int(len(item) * rate), min(max(map(len, item.split()), default=0), len(item) // 8))


class Matcher:
    """Finds items within their :func:`budget`: an item of that many errors holds one of (errors + 1) pieces unchanged.

    Items under ``least_chars`` are found as whole words only, without an edit.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int):
        self.items, pieces, exact = [], defaultdict(list), defaultdict(list)
        for item_id, text in items:
            item = plain(text)
            n = len(item)
            if not n:
                continue
            if n < least_chars:
                exact[f" {item} "].append((item_id, n))
                continue
            errors = budget(item, rate)
            masks: dict[str, int] = {}
            for i, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << i
            cuts = [n * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[item[a:b]].append((len(self.items), a))
            self.items.append((item_id, n, errors, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.short = ahocorasick.Automaton() if exact else None
        for item, whose in exact.items():
            self.short.add_word(item, whose)
        if exact:
            self.short.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, end, item length) of the items in ``text`` (as :func:`plain` gives it), each at its best place."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.automaton.iter(text) if self.items else ():
            for item, offset in where:
                starts[item].add(end + 1 - size - offset)
        found: dict[int, tuple[int, int, int]] = {}
        for end, whose in self.short.iter(f" {text} ") if self.short else ():
            for item_id, n in whose:
                found.setdefault(item_id, (0, end - 1, n))
        for item, places in starts.items():
            item_id, n, errors, masks = self.items[item]
            windows: list[list[int]] = []
            for at in sorted(places):
                low, high = max(0, at - errors), at + n + errors
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = high
                else:
                    windows.append([low, high])
            for low, high in windows:
                distance, end = best_place(masks, n, text[low:high])
                if distance <= errors and (item_id not in found or (distance, low + end) < found[item_id][:2]):
                    found[item_id] = distance, low + end, n
        return [(k, *v) for k, v in sorted(found.items())]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items (id, text) in blocks of about ``block_bytes``; an id's texts are in one block, items without id in none."""
    items = id_and_text(benchmark, item_col, text_col).where("doc_id is not null").distinct()
    blocks = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes + 1
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block).orderBy("doc_id", "text").collect()
        yield [(r["doc_id"], r["text"]) for r in own]


def benchmark_hits(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", rate: float = 0.05, least_chars: int = 25, block_bytes: int = 1 << 20,
) -> DataFrame:
    """doc_id, item_id, distance, item_chars and end (all long), one row for each row of ``df`` and item found in it.

    Texts are compared as :func:`plain` gives them; an item is found where a substring
    is within its :func:`budget` of edits, ``rate`` a character or one word, and end is
    where its best place ends in the plain text. Items of fewer than ``least_chars`` plain
    characters must stand there as whole words without an edit. Every task gets the items in blocks of about
    ``block_bytes``: a larger benchmark takes more passes over the documents, not
    more memory. Nulls are empty texts, which hold and give nothing; an item without
    id is passed over; repeated rows are searched each; of an id with several texts
    the nearest counts; empty tables give an empty result.
    """
    docs = id_and_text(df, id_col, text_col)
    bounded_batches(df.sparkSession)
    names = ["doc_id", "item_id", "distance", "item_chars", "end"]

    def one_block(texts: list[tuple[int, str]]) -> DataFrame:
        def run(batches):
            matcher = Matcher(texts, rate, least_chars)
            for batch in batches:
                rows = [
                    (doc_id, item_id, distance, n, end)
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for item_id, distance, end, n in matcher.find(plain(text))
                ]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))

    parts = [one_block(texts) for texts in item_blocks(benchmark, item_col, item_text_col, block_bytes)]
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rate: float = 0.05, least_chars: int = 25, block_bytes: int = 1 << 20,
) -> DataFrame:
    """The rows of ``df``, all columns, in which no benchmark item is found (as in :func:`benchmark_hits`).

    Rows are dropped where they are, block after block of items, so no document is shuffled and an id is not needed.
    """
    bounded_batches(df.sparkSession)

    def without(rows: DataFrame, texts: list[tuple[int, str]]) -> DataFrame:
        def run(batches):
            matcher = Matcher(texts, rate, least_chars)
            for batch in batches:
                clean = [not matcher.find(plain(t or "")) for t in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, df.schema)

    return reduce(without, item_blocks(benchmark, item_col, item_text_col, block_bytes), df)
