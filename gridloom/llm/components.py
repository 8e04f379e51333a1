"""Connected components of a graph given as edges, by contraction (built-in expressions only).

Nodes are renamed by a bijective hash, every node points to the least name in its closed
neighbourhood, pointers jump once, and the edges are drawn again between the targets.
Random names make the graph shrink by a constant factor a round whatever its shape; stars
take two rounds. Each round is written, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import settle, tidy


SALTS = 64


def in_blocks(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Deal ``members (rep, pool, ...)`` to ``block`` 0 .. ``blocks`` - 1 of their pool, by hash.

    ``blocks (pool, blocks)`` is repeated once a salt, so that a large pool's members do not
    meet in one task for it.
    """
    salt = lambda c, n: F.pmod(F.xxhash64(F.lit(c), "rep"), n).cast("int")
    repeated = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", salt("salt", F.lit(SALTS))).join(repeated, ["pool", "salt"]).drop("salt").withColumn("block", salt("block", F.col("blocks")))


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` to ``(node, component)``: the least node reachable. Nodes without an edge are left out. Written."""
    with tidy(edges.sparkSession) as keep:
        given = settle(edges.where("a != b").select("a", "b"))
        nodes = given.select(F.col("a").alias("node")).union(given.select("b")).distinct()
        graph = settle(given.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).distinct())
        labels = None
        while not graph.isEmpty():
            with tidy(edges.sparkSession) as keep_round:
                graph, labels = contracted(graph, labels)
                keep_round(graph), keep_round(labels)
        if labels is None:
            return keep(settle(nodes.select("node", F.col("node").alias("component"))))
        named = nodes.join(labels, F.xxhash64("node") == F.col("name")).select("node", "label")
        least = named.groupBy("label").agg(F.min("node").alias("component"))
        return keep(settle(named.join(least, "label").select("node", "component")))


def contracted(graph: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One round: the smaller graph, and ``(name, label)`` of all nodes so far."""
    both = graph.select(F.col("a").alias("u"), F.col("b").alias("v")).union(graph.select("b", "a"))
    to = settle(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v")))
    hop = settle(to.join(to.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", "w"))
    if labels is None:
        labels = hop.select(F.col("u").alias("name"), F.col("w").alias("label"))
    else:
        labels = settle(labels.join(hop, labels.label == hop.u, "left").select("name", F.coalesce("w", "label").alias("label")))
    at = lambda end: hop.select(F.col("u").alias(end), F.col("w").alias(f"{end}2"))
    return settle(graph.join(at("a"), "a").join(at("b"), "b").where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()), labels
