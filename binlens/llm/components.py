"""Connected components of a distributed edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b`` of type long): one root per component.

    Each round, every node points to the neighbour (or itself) of the smallest hash, a new
    hash each round; edges then join the nodes pointed to, loops and doubles go, until no
    edge is left. The number of nodes with edges shrinks by a constant factor a round, so
    rounds grow with the logarithm of the largest component. A node of very many edges is
    pre-aggregated on the map side and its join is one that Spark splits when skewed.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for turn in range(max_rounds):
        if edges.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))
        both = edges.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), rank("a").alias("r")), F.struct(F.col("a").alias("node"), rank("b").alias("r")),
            F.struct(F.col("b").alias("node"), rank("a").alias("r")), F.struct(F.col("b").alias("node"), rank("b").alias("r")))).alias("e"))
        to = materialise(both.groupBy("e.node").agg(F.min("e.r").alias("r")).select("node", F.col("r.to").alias("to")), "points")
        if labels is None:
            labels = to.select("node", F.col("to").alias("root"))
        else:
            nxt = to.select(F.col("node").alias("root"), "to")
            labels = materialise(labels.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        ends = (edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
                .join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y"))
        edges = materialise(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components still have edges after {max_rounds} rounds")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
