"""Byte-level BPE over independently encoded fragments."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, id_and_text, map_texts
from .token_counts import tokenizer

#: Fragments whose ids a worker remembers at once, and bytes of the longest of them: some 50 MB.
REMEMBERED_FRAGMENTS, REMEMBERED_BYTES = 250_000, 64
#: Characters of the texts that are cut at once, and of the fragments that the library encodes at once.
CUT_CHARS, BATCH_CHARS = 1 << 22, 1 << 16

SPACES = b" \t\n\x0b\x0c\r"
ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
OTHER_SPACE = re.compile(r"[^\S \t-\r]")


def byte_alphabet() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def cut_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte pair (first * 256 + second), whether a text is certainly cut between the two bytes.

    A pair that stands inside no token cannot be merged over. Of those pairs, the
    ones are taken at which the pre-tokenizer sees the same on either side: a
    non-space before ASCII white space, and two ASCII letters or digits. The first
    table is for texts with no other white space than ASCII's; in the second, a
    byte of a longer character is no non-space.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    inside = np.zeros(65536, dtype=bool)
    tokens = [[alphabet[c] for c in t] for t in spec["model"]["vocab"] if all(c in alphabet for c in t)]
    tokens += [list(t["content"].encode()) for t in spec.get("added_tokens", [])]
    for token in tokens:
        for a, b in zip(token, token[1:]):
            inside[a * 256 + b] = True
    same = np.zeros((256, 256), dtype=bool)
    for b in SPACES:
        same[0x21:0x7F, b] = True
    for a in ALNUM:
        same[a, list(ALNUM)] = True
    ascii_only = same.copy()
    for b in SPACES:
        same[0x80:, b] = True
    return same.reshape(-1) & ~inside, ascii_only.reshape(-1) & ~inside


def fragments(text: str, path: str) -> list[bytes]:
    """``text`` in UTF-8, cut wherever :func:`cut_tables` says so."""
    data = text.encode()
    if len(data) < 2:
        return [data] if data else []
    anywhere, ascii_only = cut_tables(path)
    table = ascii_only if not text.isascii() and OTHER_SPACE.search(text) else anywhere
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint16)
    cuts = (np.flatnonzero(table[codes[:-1] * 256 + codes[1:]]) + 1).tolist()
    return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]


#: For each vocabulary the ids (comma-joined digits) of fragments; only with them, in a tuple, a decoded text that is not the fragment.
_CODES: dict[str, dict[bytes, bytes | tuple[bytes, str]]] = {}


class Codec:
    """Encodes fragments in batches and remembers them."""

    def __init__(self, path: str):
        self.path = path

    def learn(self, wanted: set[bytes]) -> dict[bytes, bytes | tuple[bytes, str]]:
        """The codes of at least these fragments; the worker keeps them for its next batches and tasks."""
        known = _CODES.setdefault(self.path, {})
        new = [w.decode() for w in wanted if w not in known]
        if len(known) + len(new) > REMEMBERED_FRAGMENTS:
            known = _CODES[self.path] = {w: known[w] for w in wanted if w in known}
        coder = tokenizer(self.path)
        for group in by_bytes(new, BATCH_CHARS):
            ids = [e.ids for e in coder.encode_batch_fast(group, add_special_tokens=False)]
            texts = coder.decode_batch(ids, skip_special_tokens=False)
            for text, own, back in zip(group, ids, texts):
                joined = ",".join(map(str, own)).encode()
                known[text.encode()] = joined if back == text else (joined, back)
        return known

    def code(self, texts: list[str]) -> Iterator[tuple[bytes, int, str]]:
        """Comma-joined ids, their number, and the decoded text, for each text."""
        for group in by_bytes(texts, CUT_CHARS):
            yield from self.code_group(group)

    def code_group(self, texts: list[str]) -> Iterator[tuple[bytes, int, str]]:
        cut = [fragments(t, self.path) for t in texts]
        wanted: set[bytes] = set()
        for parts in cut:
            wanted.update(parts)
        known = self.learn(wanted)
        for text, parts in zip(texts, cut):
            found = [known[p] for p in parts]
            if any(type(f) is tuple for f in found):
                text = "".join(f[1] if type(f) is tuple else p.decode() for p, f in zip(parts, found))
                found = [f[0] if type(f) is tuple else f for f in found]
            joined = b",".join(found)
            yield joined, joined.count(b",") + 1 if joined else 0, text
        for w in wanted:
            if len(w) > REMEMBERED_BYTES:
                del known[w]


def numbers(joined: bytes) -> np.ndarray:
    return np.array(joined.split(b",") if joined else [], dtype=np.bytes_).astype(np.int32)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each row of ``df``, under the byte-level file ``vocabulary``.

    No special token is added; the string of one inside a text is taken as the
    library does by default. A null text is the empty text, which has no ids;
    repeated rows are coded each; further columns are ignored, whatever their names.
    """
    codec = Codec(vocabulary)

    def per_batch(texts: list[str]) -> dict[str, list]:
        coded = [(numbers(joined), back) for joined, _, back in codec.code(texts)]
        return {"ids": pa.array([c[0] for c in coded], pa.list_(pa.int32())), "decoded": [c[1] for c in coded]}

    return map_texts(id_and_text(df, id_col, text_col), "ids array<int>, decoded string", per_batch)


def encode_digests(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """As :func:`encode`, but n_tokens, ids_sha256 and decoded_sha256 in place of the text, and ids only if asked for."""
    codec = Codec(vocabulary)

    def per_batch(texts: list[str]) -> dict[str, list]:
        sizes, own, back, ids = [], [], [], []
        for joined, n, text in codec.code(texts):
            sizes.append(n)
            own.append(hashlib.sha256(joined).hexdigest())
            back.append(hashlib.sha256(text.encode()).hexdigest())
            if with_ids:
                ids.append(numbers(joined))
        made = {"n_tokens": sizes, "ids_sha256": own, "decoded_sha256": back}
        return made | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {})

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_texts(id_and_text(df, id_col, text_col), schema, per_batch)
