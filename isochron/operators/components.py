"""Connected components by alternating large-star and small-star rounds.

Every round costs two aggregations and two joins over the remaining edges. A hub
(one node with a large share of the edges) is reduced by map-side ``min`` before
it is shuffled, and the join back to its edges is one AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.plans.runtime import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over directed rows (u, v), u > v, one row per undirected edge."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(u, v)`` with the smallest node it can reach.

    Returns (node, component) for nodes that appear in an edge between two
    different nodes; isolated nodes and self loops are the caller's to add.
    Null ends and repeated edges are ignored. Raises if not stable after
    ``max_rounds`` (rounds grow with the logarithm of the longest path).
    """
    cur = cut_lineage(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        cur = cut_lineage(_star(_star(cur, True), False))
        # Stars are final when no node is both a leaf and a centre and each leaf has one centre.
        mark = cur.agg(
            F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")
        ).first()
        if (mark["n"], mark["h"]) == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = (mark["n"], mark["h"])
    raise RuntimeError(f"components not stable after {max_rounds} rounds")
