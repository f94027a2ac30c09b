"""Traversals as frontier joins: breadth first, shortest paths, simple paths.

Each level joins the frontier with the edges and leaves out what was visited.
Every level is written to the shared folder, so the plan stays flat and a lost
executor costs one level. The stop test is one count a level.

An unknown start gives no rows; ties of paths go to the smallest predecessor.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrel.functions.runtime import cut


def steps(edges: DataFrame, direction: str = "out", types: list[str] | None = None, edge_filter: Column | None = None, once: bool = True) -> DataFrame:
    """(u, v): where one step leads, each step ``once`` or as often as there are edges."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    if edge_filter is not None:
        e = e.where(edge_filter)
    out = e.select(F.col("source").alias("u"), F.col("target").alias("v"))
    back = e.select(F.col("target").alias("u"), F.col("source").alias("v"))
    got = {"out": out, "in": back, "both": out.union(back)}[direction]
    got = got.where("u is not null and v is not null")
    return got.distinct() if once else got


def bfs(nodes: DataFrame, edges: DataFrame, starts: list[str], hops: int, direction: str = "out", types: list[str] | None = None, node_filter: Column | None = None, edge_filter: Column | None = None, include_start: bool = True) -> DataFrame:
    """(id, depth, parent, path): nodes within ``hops`` steps and how they were reached first."""
    step = steps(edges, direction, types, edge_filter, once=False)  # only edges at the frontier are shuffled and counted once
    allowed = None if node_filter is None else nodes.where(node_filter).select("id").distinct()
    seen = nodes.where(F.col("id").isin(starts)).select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.col("id").alias("path")).distinct()
    front = seen
    for depth in range(1, hops + 1):
        reach = front.join(step, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id")).agg(F.min(F.struct(F.col("u").alias("parent"), F.col("path").alias("before"))).alias("p"))
        fresh = reach.join(seen.select("id"), "id", "left_anti")
        fresh = fresh if allowed is None else fresh.join(allowed, "id", "left_semi")
        front = cut(fresh.select("id", F.lit(depth).alias("depth"), "p.parent", F.concat_ws(">", "p.before", "id").alias("path")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen if include_start else seen.where("depth > 0")


def shortest_path(edges: DataFrame, a: str, b: str, hops: int = 10, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(distance, path): a shortest path, the first by name, found from both ends level by level; no row if there is none.

    Distance 0 for equal ends.
    """
    spark = edges.sparkSession
    schema = "distance int, path string"
    if a == b:
        return spark.createDataFrame([(0, a)], schema)
    forth = cut(steps(edges, direction, types), "steps")
    back = forth.select(F.col("v").alias("u"), F.col("u").alias("v"))
    seen = [spark.createDataFrame([(x, x)], "id string, path string") for x in (a, b)]
    front = list(seen)
    depth = [0, 0]
    join = (lambda p, n: F.concat_ws(">", p, n), lambda p, n: F.concat_ws(">", n, p))
    while sum(depth) < hops:
        side = 0 if depth[0] <= depth[1] else 1
        reach = front[side].join((forth, back)[side], F.col("id") == F.col("u")).groupBy(F.col("v").alias("id")).agg(F.min(join[side](F.col("path"), F.col("v"))).alias("path"))
        front[side] = cut(reach.join(seen[side].select("id"), "id", "left_anti"), "front")
        depth[side] += 1
        if front[side].isEmpty():
            break
        met = front[side].alias("x").join(front[1 - side].alias("y"), "id")
        if not met.isEmpty():
            ends = ("x.path", "y.path") if side == 0 else ("y.path", "x.path")
            whole = F.concat(F.col(ends[0]), F.expr(f"substring({ends[1]}, length(id) + 1)"))
            return met.select(F.lit(sum(depth)).alias("distance"), whole.alias("path")).agg(F.min("distance").alias("distance"), F.min("path").alias("path"))
        seen[side] = seen[side].union(front[side])
    return spark.createDataFrame([], schema)


def ego(nodes: DataFrame, edges: DataFrame, start: str, hops: int = 3, most: int = 100) -> DataFrame:
    """(id, depth, path): undirected neighbourhood of strict depth, the first ``most`` by depth and id; an unknown start gives no rows."""
    reach = bfs(nodes, edges, [start], hops, "both").select("id", "depth", "path")
    return reach.orderBy("depth", "id").limit(most)


def ordered(nodes: DataFrame, edges: DataFrame, start: str, hops: int, most: int = 1000, *, way: str = "breadth", direction: str = "out", types: list[str] | None = None, node_filter: Column | None = None, edge_filter: Column | None = None, include_start: bool = True, order: str = "ord") -> DataFrame:
    """(pos, id, path, visited, edges, depth): one node after the other, as the edges stand in ``order``.

    A node at depth ``hops`` is still expanded, so results lie up to one step
    further; ``most`` is tested before a node is taken. ``breadth`` takes the
    node found first, ``depth`` the one pushed last; edges out come before edges in. The
    edges near the start are found by frontier joins, then one task walks them, as
    the result depends on the order of all steps before; the neighbourhood of the
    start within ``hops`` steps must fit into a task. An unknown start raises.
    """
    if nodes.where(F.col("id") == start).isEmpty():
        raise ValueError(f"no node {start}")
    e = edges.where(F.col("type").isin(types)) if types else edges
    e = e.select("source", "target", F.col(order).alias("_o"), (F.lit(True) if edge_filter is None else F.coalesce(edge_filter, F.lit(False))).alias("_e"))
    parts = []
    if direction in ("out", "both"):
        parts.append(e.select(F.col("source").alias("u"), F.col("target").alias("v"), F.lit(0).alias("way"), "_o", "_e"))
    if direction in ("in", "both"):
        parts.append(e.select(F.col("target").alias("u"), F.col("source").alias("v"), F.lit(1).alias("way"), "_o", "_e"))
    step = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    near = bfs(nodes, edges, [start], hops, direction, types, node_filter, edge_filter).select(F.col("id").alias("u"))
    ok = nodes.select(F.col("id").alias("v"), (F.lit(True) if node_filter is None else F.coalesce(node_filter, F.lit(False))).alias("_n"))
    loop = nodes.where(F.col("id") == start).select(F.lit(None).cast("string").alias("u"), F.col("id").alias("v"), F.lit(0).alias("way"), F.lit(None).cast(step.schema["_o"].dataType).alias("_o"), F.lit(True).alias("_e"))
    rows = step.join(near, "u", "left_semi").unionByName(loop).join(ok, "v").withColumn("g", F.lit(0))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["way", "_o"], kind="stable")
        at: dict[str, list] = {}
        first_ok = True
        for u, v, e_ok, n_ok in zip(frame["u"], frame["v"], frame["_e"], frame["_n"], strict=True):
            if u is None:
                first_ok = bool(n_ok)
            else:
                at.setdefault(u, []).append((v, e_ok and n_ok))
        found: dict[str, list] = {start: [start]} if include_start and first_ok else {}
        waiting, met, done = deque([(start, 0, [start])]), {start}, set()
        visited = passed = deepest = 0
        while waiting and len(found) < most:
            node, depth, path = waiting.popleft() if way == "breadth" else waiting.pop()
            if depth > hops or node in done:
                continue
            done.add(node)
            visited, deepest = visited + 1, max(deepest, depth)
            own = at.get(node, [])
            passed += len(own)
            for other, fits in own if way == "breadth" else reversed(own):
                if fits and other not in (met if way == "breadth" else done):
                    met.add(other)
                    found.setdefault(other, [*path, other])
                    waiting.append((other, depth + 1, [*path, other]))
        return pd.DataFrame([(i, n, ">".join(p), visited, passed, deepest) for i, (n, p) in enumerate(found.items())], columns=["pos", "id", "path", "visited", "edges", "depth"])

    return rows.groupBy("g").applyInPandas(walk, "pos int, id string, path string, visited int, edges int, depth int")


def simple_paths(edges: DataFrame, a: str, b: str, hops: int, direction: str = "both", types: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(path, hops): paths without repeated nodes of at most ``hops`` steps, shortest first, then by name."""
    spark = edges.sparkSession
    step = cut(steps(edges, direction, types), "steps")
    front = spark.createDataFrame([(a, [a])], "id string, nodes array<string>")
    done = None
    for _ in range(hops):
        front = front.join(step, F.col("id") == F.col("u")).where(~F.array_contains("nodes", F.col("v"))).select(F.col("v").alias("id"), F.concat("nodes", F.array("v")).alias("nodes"))
        front = cut(front, "paths")
        hit = front.where(F.col("id") == b)
        done = hit if done is None else done.unionByName(hit)
        front = front.where(F.col("id") != b)
    out = done.select(F.concat_ws(">", "nodes").alias("path"), (F.size("nodes") - 1).alias("hops"))
    return out.orderBy("hops", "path").limit(most) if most else out
