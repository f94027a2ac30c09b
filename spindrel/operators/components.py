"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.functions.runtime import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of its component for every node on an edge.

    Every round links the larger neighbours of a node to the smallest one, then
    the smaller neighbours likewise; labels halve their distance to the root, so
    the rounds grow with the logarithm of the longest path. A hub's neighbours
    are never gathered: both steps are a minimum over the node's edges (with
    map-side partial aggregation) joined back to the edges. Each round is
    written to the shared folder.

    Edges with a null end are left out, loops give a component of one node.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u").distinct()
    cur = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = cut(cur.select("u").union(cur.select("v")).union(loops).distinct(), "nodes")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", after=cur)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur = after
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    root = cur.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(root, "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
