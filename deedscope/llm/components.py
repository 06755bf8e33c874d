"""Connected components by alternating large and small stars.

The neighbours of a hub are spread over salts wherever they need to know its least neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedscope.llm.common import with_group_facts
from deedscope.plans.lineage import rewritten


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = with_group_facts(both, ["u"], "v", "min", "m", "n", combined=False).filter("v > u")
    # One row for each edge at most; the small star leaves no edge twice.
    return known.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    known = with_group_facts(down, ["u"], "v", "min", "m", "n", combined=False)
    # A neighbour that is the least itself stands for the node's own link.
    moved = F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u"))
    return known.select(moved.alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node of ``edges``.

    ``edges`` has two long columns ``u`` and ``v``; loops and repeated edges do no harm, rows with
    a NULL are left out. Nodes without an edge to another node are not returned.
    """
    edges = rewritten(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        edges = rewritten(_small_star(_large_star(edges)), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
