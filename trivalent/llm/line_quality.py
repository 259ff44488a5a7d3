"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_and_text, map_texts

MARKS = b"#*$%&|<>!@^~_=+{}[]\\"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OWN = 9
#: A line's own features, those of the line before and after (zeros at the ends), whether there is such a line, and 1.
FEATURES = 3 * OWN + 3
NOT_WORD = re.compile(rb"[^A-Za-z0-9\x80-\xff]+")


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, words of each line); lines without a word are left out, and a text without words is one line."""
    kept, seen = [], set()
    for line in text.encode().split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        upper = size - len(line.translate(None, UPPER))
        marks = size - len(line.translate(None, MARKS))
        same = sum(map(bytes.__eq__, words, words[1:]))
        bare = set(words)
        pairs = len(set(zip(words, words[1:])))
        ends = sum(w[-1] in MARKS for w in words)
        kept.append((
            min(1, 4 * marks / size), ends / n, min(1, upper / size * 1.5), 1 - len(bare) / n,
            1 - pairs / (n - 1) if n > 1 else 0.0, same / n, min(1, size / n / 20), np.log1p(n) / 6, float(line in seen),
            n,
        ))
        seen.add(line)
    if not kept:
        kept = [(0.0,) * OWN + (1,)]
    made = np.array(kept, dtype=np.float64)
    own = made[:, :OWN]
    out = np.zeros((len(own), FEATURES))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[1:, -3] = 1
    out[:-1, -2] = 1
    out[:, -1] = 1
    return out, made[:, OWN]


@dataclass
class Model:
    weights: np.ndarray  #: FEATURES; what a line's features add to "good"
    turns: np.ndarray  #: 2 x 2; score of a label (row) followed by another (column)
    slope: float = 1.0
    shift: float = 0.0


def chains(sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step, the chains that are so long and the rows of their lines."""
    sizes_ = np.asarray(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes_)[:-1]])
    order = np.argsort(-sizes_, kind="stable")
    alive = np.searchsorted(-sizes_[order], -np.arange(sizes_.max(initial=0)), side="left")
    return [(order[:a], starts[order[:a]] + t) for t, a in enumerate(alive)]


def forward_backward(model: Model, x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (lines x 2), summed pair marginals (2 x 2) and log partition of chains laid end to end."""
    unary = np.zeros((len(x), 2))
    unary[:, 1] = x @ model.weights
    steps = chains(sizes)
    forward, backward = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    for t, (who, rows) in enumerate(steps):
        forward[rows] = unary[rows]
        if t:
            forward[rows] += np.logaddexp.reduce(forward[rows - 1][:, :, None] + model.turns, axis=1)
    for t in range(len(steps) - 2, -1, -1):
        rows = steps[t + 1][1] - 1
        backward[rows] = np.logaddexp.reduce(model.turns + (unary[rows + 1] + backward[rows + 1])[:, None, :], axis=2)
    total = np.zeros(len(sizes))
    last = np.cumsum(sizes) - 1
    total[:] = np.logaddexp.reduce(forward[last], axis=1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    marginal = np.exp(forward + backward - total[owner][:, None])
    pair = np.zeros((2, 2))
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    if len(inner):
        joint = forward[inner][:, :, None] + model.turns + (unary[inner + 1] + backward[inner + 1])[:, None, :]
        pair = np.exp(joint - total[owner[inner]][:, None, None]).sum(axis=0)
    return marginal, pair, total


def fit(features: list[np.ndarray], words: list[np.ndarray], labels: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> Model:
    """Conditional likelihood by gradient steps (Adam); every line starts with its document's label.

    Then the score's slope and shift are fitted by logistic regression on document labels.
    """
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)))
    if not features or len(set(labels.tolist())) < 2:
        model.weights[-1] = 50.0 if len(labels) and labels[0] == 1 else 0.0
        return model
    sizes = [len(f) for f in features]
    x, y = np.concatenate(features), np.repeat(labels, sizes).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[inner], y[inner + 1]), 1)
    n = len(x)
    first, second = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, rounds + 1):
        marginal, pair, _ = forward_backward(model, x, sizes)
        slope = np.concatenate([x.T @ (y - marginal[:, 1]) / n - ridge * model.weights, ((pairs - pair) / n - ridge * model.turns).reshape(-1)])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        model.weights, model.turns = model.weights + move[:FEATURES], model.turns + move[FEATURES:].reshape(2, 2)
    raw = document_scores(model, features, words)
    a, b = 4.0, -2.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((labels - p) * raw).sum() - 0.05 * a, (labels - p).sum() - 0.05 * b])
        hess = np.array([[(w * raw * raw).sum() + 0.05, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.05]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    model.slope, model.shift = float(max(a, 0.0)), float(b)
    return model


def document_scores(model: Model, features: list[np.ndarray], words: list[np.ndarray]) -> np.ndarray:
    """The mean probability of a good line, each line weighted by its words."""
    if not features:
        return np.zeros(0)
    sizes = [len(f) for f in features]
    marginal = forward_backward(model, np.concatenate(features), sizes)[0][:, 1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    weight = np.concatenate(words)
    return np.add.reduceat(marginal * weight, starts) / np.add.reduceat(weight, starts)


def calibrated(model: Model, raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(model.slope * raw + model.shift)))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def train(
    df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    sample_docs: int = 4000, sample_lines: int = 2000,
) -> Model:
    """A model from at most ``sample_docs`` labelled documents, the first by a hash of the id.

    Held-out rows and rows without an id, label or text are never used, nor are
    sampled documents of more than ``sample_lines`` lines. The sample's ids are chosen
    from the labels alone, so only they are sent to the documents and only their line
    features to the driver; both are bounded by the parameters. Of an id with
    several labels or texts each is a row. Without labelled rows of both classes,
    every document scores alike.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id", "label").limit(sample_docs)
    n_lines = F.size(F.split(F.col("text"), "\n", -1))
    sample = id_and_text(df, id_col, text_col).join(F.broadcast(chosen), "doc_id").where(n_lines <= sample_lines)
    bounded_batches(df.sparkSession)

    def shrink(batches):
        for batch in batches:
            made = [line_features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([np.column_stack(m).astype(np.float32).tobytes() for m in made], pa.binary())],
                names=["doc_id", "label", "features"],
            )

    rows = sample.mapInArrow(shrink, "doc_id long, label long, features binary")
    rows = rows.orderBy("doc_id", "label", "features").limit(sample_docs).collect()
    both = [np.frombuffer(r["features"], dtype=np.float32).reshape(-1, FEATURES + 1).astype(np.float64) for r in rows]
    return fit([m[:, :FEATURES] for m in both], [m[:, FEATURES] for m in both], np.array([r["label"] for r in rows], dtype=float))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", accept_from: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from ``accept_from`` on) of each row of ``df``.

    A null text is the empty text, which is scored as one line of no features.
    Repeated rows get the same score; an empty table gives an empty one.
    """

    def per_batch(texts: list[str]) -> dict[str, list]:
        made = [line_features(t) for t in texts]
        scores = calibrated(model, document_scores(model, [m[0] for m in made], [m[1] for m in made]))
        return {"score": scores.tolist(), "predicted": pa.array([int(s >= accept_from) for s in scores], pa.int32())}

    return map_texts(id_and_text(df, id_col, text_col), "score double, predicted int", per_batch)


def keep_good(df: DataFrame, model: Model, text_col: str = "text", accept_from: float = 0.7) -> DataFrame:
    """The rows of ``df``, all columns, that the model accepts."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            made = [line_features(t or "") for t in batch.column(text_col).to_pylist()]
            scores = calibrated(model, document_scores(model, [m[0] for m in made], [m[1] for m in made]))
            yield batch.filter(pa.array(scores >= accept_from))

    return df.mapInArrow(run, df.schema)
