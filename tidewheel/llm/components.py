"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over distinct edges (a, b), a > b. Large: a node's larger neighbours link to its least one; small: its smaller ones do, and itself."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stored(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")  # stored, so that a hot node's join can be split
    joined = near.join(least, "u")
    out = joined.where((F.col("v") > F.col("u")) if large else (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b"))
    return out.unionByName(own).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node reachable. Self links and repeated links do no harm; no links, no rows.

    Each round halves the distance to the root at least; rounds go on until only stars are left.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    while True:
        # stars alone: every node that points somewhere points at a node that points nowhere, and at one only
        shape = edges.groupBy("a").count().agg(F.max("count").alias("most")).first().most
        if shape is None or shape == 1 and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0:
            break
        edges = stored(_star(_star(edges, True), False), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
