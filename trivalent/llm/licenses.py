"""Licence scans by a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_and_text, map_texts

# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Label, opening of the notice, phrases that must stand in it.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("gpl-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("free of charge to any person", "without restriction")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("affero general public license",)),
    ("gpl-or-later", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license", "without any warranty")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("apache org licenses license 2 0",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("copies or substantial portions of the software",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("retain the above copyright notice", "following disclaimer")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ("mozilla org mpl 2 0",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
)
#: Rarest words of a template that are looked up.
RARE_WORDS = 4
ACCEPT = 0.8
#: Words by which rare words may stand nearer or farther from each other than in the template.
BAND = 16

_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (in lower case), digits and non-ASCII characters."""
    return text.encode().lower().translate(_KEPT).split()


def vocabulary(templates=TEMPLATES) -> set[bytes]:
    return {w for _, notice, _ in templates for w in notice.encode().split()}


def document_frequencies(docs: DataFrame, wanted: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many rows of ``docs`` (doc_id, text) each wanted word occurs, and the number of rows.

    Every task sends one count for each wanted word it has met, so what is gathered
    is bounded by the vocabulary of the templates.
    """
    bounded_batches(docs.sparkSession)

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(wanted.intersection(words_of(text)))
            found[b""] += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
        )

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


@dataclass
class Index:
    """Postings (template, offset) of every template's rarest words, and what is needed to verify."""

    labels: list[str]
    words: list[list[bytes]]
    weights: list[list[float]]
    keys: list[list[list[bytes]]]
    postings: dict[bytes, list[tuple[int, int]]]
    needed: list[int]
    phrases: set[tuple[bytes, ...]]


def build_index(frequency: dict[bytes, int], rows: int, templates=TEMPLATES) -> Index:
    def idf(word: bytes) -> float:
        return math.log((rows + 1) / (frequency.get(word, 0) + 1)) + 1e-3

    index = Index([], [], [], [], defaultdict(list), [], {tuple(k.encode().split()) for _, _, keys in templates for k in keys})
    for i, (label, notice, keys) in enumerate(templates):
        words = notice.encode().split()
        rarest = sorted(set(words), key=lambda w: (-idf(w), w))[:RARE_WORDS]
        index.labels.append(label)
        index.words.append(words)
        index.weights.append([idf(w) for w in words])
        index.keys.append([k.encode().split() for k in keys])
        index.needed.append(min(2, len(rarest)))
        for at, word in enumerate(words):
            if word in rarest:
                index.postings[word].append((i, at))
    index.postings = dict(index.postings)
    return index


def stands(words: list[bytes], phrase: list[bytes], low: int, high: int, others: set[tuple[bytes, ...]] = frozenset()) -> bool:
    """Whether the phrase stands in words low to high - 1, with one other word inside at most: one that makes none of ``others`` of it."""
    n = len(phrase)
    for p in range(max(low, 0), min(high, len(words)) - n + 1):
        if words[p] == phrase[0]:
            same = 1
            while same < n and words[p + same] == phrase[same]:
                same += 1
            if same == n or words[p + same + 1 : p + n + 1] == phrase[same:] and tuple(words[p : p + n + 1]) not in others:
                return True
    return False


def in_order(words: list[bytes], notice: list[bytes], weights: list[float]) -> float:
    """The greatest weight of words of the notice that stand in ``words`` in the notice's order, whatever stands between."""
    places: dict[bytes, list[int]] = defaultdict(list)
    for i, w in enumerate(notice):
        places[w].append(i)
    best = [0.0] * (len(notice) + 1)  # of the notice's first i words
    for word in words:
        for i in reversed(places.get(word, ())):
            reached = best[i] + weights[i]
            j = i + 1
            while j <= len(notice) and best[j] < reached:
                best[j] = reached
                j += 1
    return best[-1]


def match(words: list[bytes], index: Index) -> list[tuple[str, int, float]]:
    """(label, start, score) of the notices: two rare words about at their distance, key phrases, and enough of the words' weight in order.

    Every rare word votes for the place where the notice would start. Places within
    BAND words count together, so words put in, left out or changed do not hide a notice.
    """
    votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
    for at, word in enumerate(words):
        for template, offset in index.postings.get(word, ()):
            votes[template].append((at - offset, word))
    out = []
    for template, cast in votes.items():
        notice, weights = index.words[template], index.weights[template]
        cast.sort()
        at = 0
        while at < len(cast):
            start = cast[at][0]
            stop = at
            while stop < len(cast) and cast[stop][0] <= start + BAND:
                stop += 1
            low, high = max(start - BAND // 2, 0), start + len(notice) + 2 * BAND
            if (len({w for _, w in cast[at:stop]}) >= index.needed[template]
                    and all(stands(words, k, low, high, index.phrases) for k in index.keys[template])):
                score = min(1.0, in_order(words[low:high], notice, weights) / sum(weights))  # sums in two orders
                if score >= ACCEPT:
                    out.append((index.labels[template], max(start, 0), score))
            # Windows overlap by half, so a notice is whole in one of them.
            while at < len(cast) and cast[at][0] <= start + BAND // 2:
                at += 1
    return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    places = []
    for phrase, label in BASE_PHRASES.items():
        first, *rest = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(first, at + 1)
            except ValueError:
                break
            if words[at + 1 : at + 1 + len(rest)] == rest:
                places.append((at, label))
    return places


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of ``df``.

    The base counts every place of :data:`BASE_PHRASES`. The method adds the labels of
    the templates it finds; its score is the best share of a template's
    inverse-frequency weight that stands in its order. Frequencies are those of all rows.
    A document with base phrases only scores 0.5, one with nothing 0. A null text is
    the empty text; repeated rows are scanned each; an empty table gives an empty one.
    """
    docs = id_and_text(df, id_col, text_col)
    index = build_index(*document_frequencies(docs, vocabulary(templates)), templates)

    def per_batch(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in texts:
            words = words_of(text)
            base = base_places(words)
            found = match(words, index)
            at = [p for p, _ in base]
            own = {label for _, label in base}
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(min(at, default=None))
            out["last_word"].append(max(at, default=None))
            out["base_labels"].append(",".join(sorted(own)))
            out["labels"].append(",".join(sorted(own | {label for label, _, _ in found})))
            out["score"].append(float(max([s for _, _, s in found] + [0.5 * bool(base)])))
        long = {k: pa.array(out[k], pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")}
        return out | long | {"score": pa.array(out["score"], pa.float64())}

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(docs, schema, per_batch)
