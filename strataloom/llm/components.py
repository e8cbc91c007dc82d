"""Connected components of a distributed edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(u, v), long; nodes of one component share a label, one of its nodes.

    Every round each node moves to its neighbour (or itself) of least hash, and edges become edges
    between the nodes moved to. Hash order shrinks a path by a constant factor a round, whatever its
    ids, so rounds grow with the logarithm of the component; the driver only sees row counts. Edges
    need not be distinct or free of loops. No edges: no rows. Nulls in u or v are left out.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = edges.select("u", "v").where("u <> v").distinct()
    moves = []
    while True:
        edges = written(edges, "edges")
        if edges.isEmpty():
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        move = both.groupBy("u").agg(F.min(rank("v")).alias("least")).select(F.col("u").alias("node"), F.least(rank("u"), F.col("least"))["id"].alias("to"))
        move = written(move, "moves")
        moves.append(move)
        edges = (
            edges.join(move.select(F.col("node").alias("u"), F.col("to").alias("u_to")), "u")
            .join(move.select(F.col("node").alias("v"), F.col("to").alias("v_to")), "v")
            .select(F.col("u_to").alias("u"), F.col("v_to").alias("v"))
            .where("u <> v")
            .distinct()
        )
    if not moves:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = moves[0].withColumnRenamed("to", "label")
    for move in moves[1:]:
        step = move.select(F.col("node").alias("label"), "to")
        labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(labels, "labels")
