"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is joins and grouped minima over edges, each written to the shared folder; a hub's edges are aggregated
before they are shuffled or split by the skew join, and nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import drop, save


def _checksum(edges: DataFrame) -> tuple:
    # Sums over the edges; decimal so that they cannot overflow.
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); the component is its smallest node.

    Loops and repeated edges change nothing; edges with a null end are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _checksum(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # Large star: a node's larger neighbours go to its smallest neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(spark, e)
        e, before, seen = after, seen, _checksum(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
