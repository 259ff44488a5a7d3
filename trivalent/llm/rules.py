"""Quality rules that vote or abstain, combined by their estimated accuracies."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.session import materialise

from .common import id_and_text, map_texts

#: Characters that count as symbols.
SYMBOLS = re.compile(r"[#*$%&|<>]+")
SPACE_BYTES = b" \t\n\x0b\x0c\r"
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_letters", "n_upper", "n_distinct", "n_marked")
MIN_WORDS = 50

#: Each rule: what it measures, a vote for bad from this value on, a vote for good up to this value (None: never).
#: Between the two it abstains. A fault that is absent says little of quality, so most rules vote bad or abstain.
RULES = {
    "symbols per word": (lambda c: c["n_symbols"] / c["n_words"], 0.1, None),
    "words ending in a symbol": (lambda c: c["n_marked"] / c["n_words"], 0.1, None),
    "upper-case share of letters": (lambda c: c["n_upper"] / c["n_letters"], 0.3, None),
    "repeated lines": (lambda c: c["n_dup_lines"] / c["n_lines"], 0.5, None),
    "words in repeated windows": (lambda c: c["n_repeat_words"] / c["n_words"], 0.4, 0.05),
    "repetition of words": (lambda c: 1 - c["n_distinct"] / c["n_words"], 0.93, None),
    "mean word length": (lambda c: abs(c["word_chars"] / c["n_words"] - 6), 4, 2.5),
}
#: Prior chance of each vote (bad, abstain, good) of a rule about a bad and a good text, and its weight as a share of all texts.
PRIOR = ((0.3, 0.5, 0.2), (0.02, 0.48, 0.5))
PRIOR_WEIGHT = 0.2


def count_text(text: str) -> list[int]:
    """BASE_COUNTS and MORE_COUNTS of one text. Words are what ASCII white space parts, lines what \\n parts."""
    data = text.encode()
    words = data.split()
    n = len(words)
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n >= 4:
        pairs = np.unique(codes[:-1] * len(ids) + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(ids) + codes[2:]
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        covered = np.zeros(n, dtype=bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= twice
        repeated = int(covered.sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_symbols = sum(map(len, SYMBOLS.findall(text)))
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.sub(r"[^A-Za-z]+", "", text))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    if not text.isascii():
        upper += sum(c.isupper() for c in text if c > "\x7f")
    marked = sum(w[-1] in b"#*$%&|<>!" for w in words)
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACE_BYTES)))
    return [n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines), letters, upper, len(ids), marked]


def text_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    names = (*BASE_COUNTS, *MORE_COUNTS)

    def per_batch(texts: list[str]) -> dict[str, list]:
        made = np.array([count_text(t) for t in texts], dtype=np.int64).reshape(-1, len(names))
        return {name: made[:, i].tolist() for i, name in enumerate(names)}

    return map_texts(id_and_text(df, id_col, text_col), ", ".join(f"{n} long" for n in names), per_batch)


def votes() -> list:
    """For each rule 2 (good), 0 (bad) or 1 (abstains; also where the measure is undefined)."""
    counts = {n: F.when(F.col(n) > 0, F.col(n)) for n in ("n_words", "n_letters", "n_lines")}
    row = {n: counts.get(n, F.col(n)) for n in (*BASE_COUNTS, *MORE_COUNTS)}
    out = []
    for measure, bad, good in RULES.values():
        value = measure({k: _Measure(v) for k, v in row.items()}).column
        vote = F.when(value >= bad, 0)
        out.append((vote if good is None else vote.when(value <= good, 2)).otherwise(1))
    return out


class _Measure:
    """A column with plain arithmetic, so that a rule reads as a formula."""

    def __init__(self, column):
        self.column = column

    def __truediv__(self, other):
        return _Measure(self.column / other.column)

    def __sub__(self, other):
        return _Measure(self.column - other)

    def __rsub__(self, other):
        return _Measure(F.lit(other) - self.column)

    def __abs__(self):
        return _Measure(F.abs(self.column))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability of good quality for each vote pattern (rows of 0, 1, 2), by expectation-maximisation.

    Given the unseen class, rules vote independently, each with a probability of its
    own for every vote; these and the share of good texts are estimated from the
    number of texts of each pattern, with ``PRIOR`` as pseudo-counts, which settles
    which class is "good" and that good texts seldom get a vote for bad.
    """
    n_rules, total = patterns.shape[1], counts.sum()
    prior = np.array(PRIOR)
    table = np.repeat(prior[:, None, :], n_rules, axis=1)
    share = 0.8
    seen = np.stack([patterns == v for v in range(3)], axis=-1)
    posterior = np.zeros(len(counts))
    for _ in range(rounds):
        log = np.log(table)
        good = np.log(share) + (seen * log[1]).sum(axis=(1, 2))
        bad = np.log1p(-share) + (seen * log[0]).sum(axis=(1, 2))
        fresh = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        if np.abs(fresh - posterior).max(initial=0) < 1e-9:
            break
        posterior = fresh
        extra = PRIOR_WEIGHT * total
        for c, weight in ((1, posterior * counts), (0, (1 - posterior) * counts)):
            table[c] = (np.einsum("p,prv->rv", weight, seen) + extra * prior[c]) / (weight.sum() + extra)
        share = (posterior @ counts + 1) / (total + 2)
    return posterior


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """doc_id, BASE_COUNTS, base_failed, good_probability and kept of each row of ``df``.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word
    windows. kept: not base_failed, and the posterior probability of good quality,
    given the votes of all rules, is ``keep_from`` or more. All rows count towards the
    estimate; what is gathered is one row for each pattern of votes (3 to the power
    of the number of rules at most). A null or empty text has no words and fails;
    repeated rows are judged each; an empty table gives an empty result.
    """
    counted = materialise(text_counts(df, id_col, text_col), "counts")
    voted = counted.withColumn("votes", F.array(*votes()))
    found = voted.groupBy("votes").count().orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in found], dtype=np.int64).reshape(-1, len(RULES))
    good = estimate(patterns, np.array([r["count"] for r in found], dtype=float))
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(r["votes"], float(g)) for r, g in zip(found, good)], "votes array<int>, good_probability double"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.join(F.broadcast(table), "votes").withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("good_probability") >= keep_from))
        .select("doc_id", *BASE_COUNTS, "base_failed", "good_probability", "kept")
    )
