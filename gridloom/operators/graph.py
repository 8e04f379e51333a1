"""Graph and vector computations over stored matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expressions import l2_distance, l2_norm
from gridloom.functions.ordinals import with_positions
from gridloom.operators import sparse

BLOCK = 1024


def row_norms(df: DataFrame) -> DataFrame:
    """``norm, pos`` of a dense matrix."""
    return df.select(l2_norm(F.col("vector")).alias("norm"), "pos")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group: ``group, col, mean`` in long form."""
    cells = df.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("col", "x"))
    return cells.groupBy(group, "col").agg(F.avg("x").alias("mean"))


def pairwise_distances(df: DataFrame, rows: int) -> DataFrame:
    """``i, j, distance`` of all rows i < j of a dense matrix, block against block.

    Each row goes to the pairs of blocks that it belongs to, and rows meet by an equi-join
    on the pair; the answer has rows * (rows - 1) / 2 rows, so this is for few rows.
    """
    blocks = max(1, -(-rows // BLOCK))
    block = F.floor(F.col("pos") / BLOCK).cast("int")
    sent = df.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = sent.where("block <= other").select(F.col("block").alias("bi"), F.col("other").alias("bj"), F.col("pos").alias("i"), F.col("vector").alias("x"))
    right = sent.where("other <= block").select(F.col("other").alias("bi"), F.col("block").alias("bj"), F.col("pos").alias("j"), F.col("vector").alias("y"))
    return left.join(right, ["bi", "bj"]).where("i < j").select("i", "j", l2_distance(F.col("x"), F.col("y")).alias("distance"))


def count_far(distances: DataFrame, least: float) -> DataFrame:
    """``n``: rows that have a later one farther than ``least``."""
    return distances.where(F.col("distance") > least).agg(F.count_distinct("i").alias("n"))


def clique_blocks(members: DataFrame, node: str, clique: str) -> DataFrame:
    """The cliques' adjacency in blocks ``rows, cols, value`` 1.0: up to ``BLOCK`` members against as many of the same clique.

    Each member stands in one list of its clique and each list meets each, so no task holds
    a clique, and there is a row for a million pairs of a large one.
    """
    known = members.select(F.col(node).cast("bigint").alias("node"), F.col(clique).alias("clique")).where("node IS NOT NULL AND clique IS NOT NULL")
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    lists = with_positions(known, "clique", "node").groupBy("clique", block).agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    a, b = (lists.select(F.col("clique").alias(c), F.col("nodes").alias(n)) for c, n in (("a", "rows"), ("b", "cols")))
    return a.join(b, F.col("a") == F.col("b")).select("rows", "cols", F.lit(1.0).alias("value"))


def clique_adjacency(members: DataFrame, node: str, clique: str) -> DataFrame:
    """``row, col, value`` 1.0 for each ordered pair of one clique; no diagonal, nothing for a null clique.

    The answer is the pairs themselves, as many as each clique's square.
    """
    return sparse.entries(clique_blocks(members, node, clique))
