"""Connected components by randomised contraction, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); nodes of a component share one root.

    Each round every node joins the neighbour (or itself) that comes first in an
    order hashed anew with the round's number, and links are rewritten to the
    chosen nodes. The number of nodes falls by a constant factor in expectation
    whatever the shape of the graph, so rounds grow with the logarithm of its
    size. Links to oneself and nulls are ignored; no links give no rows.
    """
    edges = materialise(links.where("a <> b").select("a", "b").distinct(), "links")
    names = None
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.xxhash64(F.col("b"), F.lit(turn))
        own = F.xxhash64(F.col("a"), F.lit(turn))
        near = both.groupBy("a").agg(F.min(F.struct(rank.alias("rank"), F.col("b").alias("b"))).alias("near"))
        chosen = near.select(
            F.col("a").alias("node"),
            F.when(F.struct(own.alias("rank"), F.col("a").alias("b")) < F.col("near"), F.col("a"))
            .otherwise(F.col("near.b")).alias("to"),
        )
        chosen = materialise(chosen, "chosen")
        if names is None:
            names = chosen.select("node", F.col("to").alias("root"))
        else:
            step = chosen.select(F.col("node").alias("root"), "to")
            names = names.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        names = materialise(names, "names")
        left = chosen.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        right = chosen.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        edges = materialise(
            edges.join(left, "a").join(right, "b")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .where("a <> b").distinct(),
            "links",
        )
        turn += 1
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
