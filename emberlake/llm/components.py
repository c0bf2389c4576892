"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import ROWS_PER_SALT
from emberlake.operators.skew import salted_join
from emberlake.session import materialize


def _print(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def _least_neighbour(arcs: DataFrame) -> DataFrame:
    """Each arc a -> b with ``m``, the least of a and all its neighbours; hubs are split over tasks."""
    least = arcs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
    facts = least.select("a", F.least("a", "m").alias("m"))
    return salted_join(arcs, facts, ["a"], ["b"], rows_per_salt=ROWS_PER_SALT, counts=least.select("a", "_n"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``); a component is named by its least node.

    Alternates two steps until nothing changes: each node hands its larger neighbours to
    the least node it knows, then its smaller ones. The number of rounds grows with the
    logarithm of the longest path, not with its length, and the edges of a round never
    outnumber those of the round before. Every round is written to the shared folder.
    Loops and repeated edges have no effect; edges with a null end are left out.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "components")
    before = None
    while (mark := _print(now)) != before and mark[0]:
        before = mark
        both = now.union(now.select("b", "a"))
        large = _least_neighbour(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "components")
        near = _least_neighbour(large)
        small = near.select("a", F.col("m").alias("b")).union(near.where("b <> m").select("b", "m")).distinct()
        now = materialize(small, "components")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
