"""Token counts of whole texts, without keeping the tokens."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from .common import by_bytes, id_and_text, map_texts

#: Words whose count a worker remembers at once, and bytes of the longest of them: some 100 MB.
REMEMBERED_WORDS, REMEMBERED_BYTES = 400_000, 64
BATCH_CHARS = 1 << 18

_LOADED: dict[str, object] = {}
_COUNTS: dict[str, dict[bytes, int]] = {}


def tokenizer(path: str):
    """The tokenizer at ``path``, loaded once in each Python worker; Spark's slots are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded
    return _LOADED[path]


class WordCounter:
    """Token counts of texts cut at ASCII white space, for tokenizers that drop white space.

    Such a cut is safe: normalisation never composes a character with a preceding
    ASCII space, no pre-token holds white space, and no special token holds any.
    Pieces not met before are encoded in batches of about ``BATCH_CHARS``.
    """

    def __init__(self, path: str):
        self.path = path

    def learn(self, words: set[bytes]) -> dict[bytes, int]:
        """The counts of at least these words; the worker keeps them for its next batches and tasks."""
        known = _COUNTS.setdefault(self.path, {})
        if len(known) + len(words) > REMEMBERED_WORDS:
            known = _COUNTS[self.path] = {w: known[w] for w in words if w in known}
        new = [w for w in words if w not in known]
        encoder = tokenizer(self.path)
        for group in by_bytes([w.decode() for w in new], BATCH_CHARS):
            for text, found in zip(group, encoder.encode_batch_fast(group, add_special_tokens=False)):
                known[text.encode()] = len(found.ids)
        return known

    def counts(self, texts: list[str]) -> list[int]:
        # bytes.split() cuts at ASCII white space only.
        cut = [t.encode().split() for t in texts]
        unknown: set[bytes] = set()
        for words in cut:
            unknown.update(words)
        known = self.learn(unknown)
        counts = [sum(map(known.__getitem__, words)) for words in cut]
        for w in unknown:
            if len(w) > REMEMBERED_BYTES:
                del known[w]
        return counts


def count_tokens(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of each row of ``df``.

    ``vocabulary`` is the path of a tokenizer file whose pre-tokens hold no white space.
    No begin, end or added special token is counted, nothing is truncated. A null or
    empty text has 0 tokens; repeated rows are counted each; an empty table gives an
    empty result; further columns of ``df`` are ignored, whatever their names.
    """
    counter = WordCounter(vocabulary)

    def per_batch(texts: list[str]) -> dict[str, list]:
        n_tokens = counter.counts(texts)
        return {
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": n_tokens,
            "over_limit": [n > limit for n in n_tokens],
        }

    return map_texts(
        id_and_text(df, id_col, text_col), "n_bytes long, n_tokens long, over_limit boolean", per_batch
    )
