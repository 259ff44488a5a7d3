"""Nearest neighbours: exact block against block, or through an index of inverted lists.

Without structure in the vectors an exact answer needs every distance. Both sides
are dealt into blocks by a hash; a task holds one block of queries and one of
references and sends on the k best of each query, so what is shuffled is bounded
by queries x k x reference blocks, and no task holds more than two blocks.

The index deals every reference row to the nearest of a bounded number of centroids. A
query reads the lists of its nearest centroids only; how many is measured, not guessed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, small_side
from . import relations

#: Rows of a task's two blocks.
QUERY_BLOCK, REFERENCE_BLOCK = 65_536, 8_192
#: Distances that a task computes at once.
CELLS = 1 << 20
#: Rows that centroids are fitted on, most centroids, and queries that set the number of lists to read.
SAMPLE_ROWS, MOST_LISTS, TRIAL_QUERIES = 20_000, 4_096, 200


def k_best(some: pd.DataFrame, known: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of ``known`` (ref_id, y, ref_vec) of each row of ``some`` (query_id, query_vec)."""
    if not len(some) or not len(known):
        return pd.DataFrame({"query_id": [], "ref_id": [], "y": [], "distance": []})
    known = known.sort_values("ref_id")
    ids, labels = known["ref_id"].to_numpy(), known["y"].to_numpy()
    against, asked_for = np.stack(known["ref_vec"].to_numpy()), np.stack(some["query_vec"].to_numpy())
    # Squared distances by one product say which rows may be among the k nearest; those are measured exactly.
    norms, asked_norms = (against * against).sum(axis=1), (asked_for * asked_for).sum(axis=1)
    step = max(1, CELLS // len(against))
    parts = []
    for a in range(0, len(some), step):
        near = nearest_places(asked_for[a : a + step], against, asked_norms[a : a + step], norms, k)
        row, column = np.nonzero(near)
        away = np.concatenate([
            np.sqrt(((asked_for[a + row[b : b + CELLS // 64]] - against[column[b : b + CELLS // 64]]) ** 2).sum(axis=1))
            for b in range(0, max(1, len(row)), CELLS // 64)])
        order = np.lexsort((column, away, row))  # columns rise with ref_id
        place = np.arange(len(row)) - np.repeat(np.cumsum(near.sum(axis=1)) - near.sum(axis=1), near.sum(axis=1))
        best = order[place < k]
        parts.append(pd.DataFrame({
            "query_id": some["query_id"].to_numpy()[a + row[best]], "ref_id": ids[column[best]],
            "y": labels[column[best]], "distance": away[best]}))
    return pd.concat(parts)


def nearest_places(asked: np.ndarray, against: np.ndarray, asked_norms: np.ndarray, norms: np.ndarray, k: int) -> np.ndarray:
    """Which rows of ``against`` may be among the ``k`` nearest of each row of ``asked``: all that are, and any not told apart by rounding."""
    about = asked_norms[:, None] + norms[None, :] - 2 * (asked @ against.T)
    if k >= len(against) or not np.isfinite(about).all():
        return np.ones(about.shape, bool)
    # Products of vectors of n parts are off by n roundings of the norms at most.
    off = 4 * (asked.shape[1] + 4) * np.finfo(float).eps * (asked_norms + norms.max())
    return about <= (np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * off)[:, None]


def nearest(references: DataFrame, queries: DataFrame, k: int = 25, query_block: int = QUERY_BLOCK,
            reference_block: int = REFERENCE_BLOCK) -> DataFrame:
    """(query_id, ref_id, y, distance, rank) of the k nearest; frames hold id, vec and the references y.

    Ties go to the smaller ref_id. Rows without a vector are left out.
    """
    # Names of their own keep the two sides apart where both come from one frame.
    refs = references.where("vec IS NOT NULL").select(
        F.col("id").alias("ref_id"), F.col("y").alias("y"), F.col("vec").cast("array<double>").alias("ref_vec"))
    asked = queries.where("vec IS NOT NULL").select(
        F.col("id").alias("query_id"), F.col("vec").cast("array<double>").alias("query_vec"))
    blocks = {"q": math.ceil(asked.count() / query_block) or 1, "r": math.ceil(refs.count() / reference_block) or 1}

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*df.columns), F.lit(blocks[own])).cast("int")
        return df.withColumns({own: mine, other: F.explode(F.sequence(F.lit(0), F.lit(blocks[other] - 1)))})

    types = dict(refs.dtypes)
    schema = f"query_id {dict(asked.dtypes)['query_id']}, ref_id {types['ref_id']}, y {types['y']}, distance double"
    best = lambda some, known: k_best(some, known, k)
    found = dealt(asked, "q", "r").groupBy("q", "r").cogroup(dealt(refs, "r", "q").groupBy("q", "r")).applyInPandas(best, schema)
    return relations.top_k_each(found, "query_id", -F.col("distance"), k, "ref_id")


def vote(neighbours: DataFrame) -> DataFrame:
    """Distance-weighted share of positive neighbours; exact matches outvote all others."""
    exact = F.max(F.col("distance") == 0)
    weight = F.when(F.col("distance") > 0, 1 / F.col("distance"))
    share = F.sum(weight * F.col("y")) / F.sum(weight)
    at_zero = F.avg(F.when(F.col("distance") == 0, F.col("y").cast("double")))
    return neighbours.groupBy(F.col("query_id").alias("id")).agg(F.when(exact, at_zero).otherwise(share).alias("p"))


def by_distance(vectors: np.ndarray, centroids: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centroids of each vector, nearest first."""
    parts = []
    step = max(1, CELLS // len(centroids))
    for a in range(0, len(vectors), step):
        away = (centroids * centroids).sum(axis=1)[None, :] - 2 * vectors[a : a + step] @ centroids.T
        parts.append(np.argsort(away, axis=1, kind="stable")[:, :count])
    return np.concatenate(parts) if parts else np.zeros((0, count), int)


@dataclass
class NeighbourIndex:
    """Inverted lists around centroids: every reference row is in the list of its nearest centroid."""

    centroids: np.ndarray
    rows: DataFrame  #: list, part, ref_id, y, ref_vec
    parts: DataFrame  #: list, parts: the pieces a list is kept in
    probes: int

    @classmethod
    def fit(cls, references: DataFrame, k: int = 25, lists: int | None = None, probes: int | None = None, recall: float = 0.95,
            list_rows: int = REFERENCE_BLOCK, seed: int = 42) -> "NeighbourIndex":
        """Index all rows of ``references`` (id, y, vec) that have a vector.

        Centroids are fitted on SAMPLE_ROWS rows at most, chosen by a hash of the id;
        their number is the root of the row count, MOST_LISTS at most. Lists of more
        than ``list_rows`` rows are kept in several parts. Without ``probes`` the number
        of lists to read is the least that finds ``recall`` of the exact neighbours of
        TRIAL_QUERIES reference rows.
        """
        refs = references.where("vec IS NOT NULL").select(
            F.col("id").alias("ref_id"), F.col("y").alias("y"), F.col("vec").cast("array<double>").alias("ref_vec"))
        refs = materialise(refs, "references")
        spark, n = references.sparkSession, refs.count()
        if not n:
            return cls(np.zeros((1, 1)), refs.selectExpr("0 AS list", "0 AS part", "*"), spark.createDataFrame([], "list int, parts int"), 1)
        lists = min(lists or math.ceil(math.sqrt(n)), MOST_LISTS, n)
        drawn = refs.orderBy(F.xxhash64("ref_id", F.lit(seed)), "ref_id").limit(SAMPLE_ROWS)
        drawn = materialise(drawn.select(array_to_vector("ref_vec").alias("features")), "sample")
        model = KMeans(k=lists, seed=seed, maxIter=10, initMode="random").fit(drawn)
        centroids = np.stack(model.clusterCenters())
        placed = materialise(listed(refs, "ref_vec", centroids, 1), "placed")
        sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        parts = materialise(sizes.select("list", F.ceil(F.col("n") / list_rows).cast("int").alias("parts")), "parts")
        # At most MOST_LISTS rows.
        own = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("ref_id"), "parts").cast("int"))
        rows = materialise(own.select("list", "part", "ref_id", "y", "ref_vec"), "lists", ["list"])
        index = cls(centroids, rows, parts, probes or 1)
        if probes is None:
            index.probes = index.least_probes(refs, k, recall, seed)
        return index

    def least_probes(self, refs: DataFrame, k: int, recall: float, seed: int) -> int:
        """Lists to read so that the wanted share of exact neighbours of a few reference rows is found."""
        trial = refs.orderBy(F.xxhash64("ref_id", F.lit(seed + 1)), "ref_id").limit(TRIAL_QUERIES)
        trial = materialise(trial.select(F.col("ref_id").alias("id"), F.col("ref_vec").alias("vec")), "trial")
        exact = nearest(refs.select(F.col("ref_id").alias("id"), "y", F.col("ref_vec").alias("vec")), trial, k)
        homes = self.rows.select("ref_id", "list").join(small_side(exact.select("query_id", "ref_id")), "ref_id")
        found = homes.collect()  # TRIAL_QUERIES x k rows at most
        vectors = {r["id"]: np.array(r["vec"]) for r in trial.collect()}
        order = {q: np.argsort(by_distance(v[None, :], self.centroids, len(self.centroids))[0]) for q, v in vectors.items()}
        ranks = np.sort([order[r["query_id"]][r["list"]] for r in found])
        return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1

    def nearest(self, queries: DataFrame, k: int = 25, query_block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, ref_id, y, distance, rank) among the rows of the ``probes`` lists nearest to each row of ``queries`` (id, vec).

        A list that very many queries read is joined block by block.
        """
        asked = queries.where("vec IS NOT NULL").select(
            F.col("id").alias("query_id"), F.col("vec").cast("array<double>").alias("query_vec"))
        probed = materialise(with_lists(asked, "query_vec", self.centroids, self.probes), "probed")
        probed = probed.select("query_id", "query_vec", F.explode("lists").alias("list"))
        blocks = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks"))
        both = F.broadcast(self.parts.join(F.broadcast(blocks), "list"))
        up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        mine = probed.join(both, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", up_to("parts"))
        theirs = self.rows.join(both, "list").withColumn("block", up_to("blocks"))
        key = ["list", "part", "block"]
        types = dict(self.rows.dtypes)
        schema = f"query_id {dict(asked.dtypes)['query_id']}, ref_id {types['ref_id']}, y {types['y']}, distance double"
        found = mine.select(*key, "query_id", "query_vec").groupBy(*key).cogroup(
            theirs.select(*key, "ref_id", "y", "ref_vec").groupBy(*key)).applyInPandas(lambda some, known: k_best(some, known, k), schema)
        return relations.top_k_each(found, "query_id", -F.col("distance"), k, "ref_id")


def with_lists(df: DataFrame, vector: str, centroids: np.ndarray, count: int) -> DataFrame:
    """``df`` with ``lists``: the ``count`` nearest centroids of each row. The centroids are a bounded table."""
    count = min(count, len(centroids))

    def run(batches):
        for pdf in batches:
            near = by_distance(np.stack(pdf[vector].to_numpy()), centroids, count) if len(pdf) else np.zeros((0, count), int)
            yield pdf.assign(lists=list(near.astype("int32")))

    return df.mapInPandas(run, f"{', '.join(f'{n} {t}' for n, t in df.dtypes)}, lists array<int>")


def listed(df: DataFrame, vector: str, centroids: np.ndarray, count: int) -> DataFrame:
    """``df`` with ``list``: a row for each of the ``count`` nearest centroids, repeated outside of Python."""
    return with_lists(df, vector, centroids, count).select(*df.columns, F.explode("lists").alias("list"))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the number of exact pairs (query_id, ref_id) and the share of them that was found."""
    hits = exact.select("query_id", "ref_id").join(
        found.select("query_id", "ref_id", F.lit(1).alias("hit")), ["query_id", "ref_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_exact"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
