"""Lookups, filters, maintenance and metrics of property graphs.

Nodes have ``id`` and ``type``, edges ``source``, ``target`` and ``type``. Null
ids match nothing; empty inputs give empty outputs or zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("type") == label)


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def property_condition(value: Column, operator: str, wanted: object) -> Column:
    """eq, ne, lt, gt, lte, gte, contains (any case), matches (any case; an invalid pattern matches nothing)."""
    w = F.lit(wanted)
    if operator in ("lt", "gt", "lte", "gte"):
        number = value.try_cast("double")
        return {"lt": number < w, "gt": number > w, "lte": number <= w, "gte": number >= w}[operator]
    if operator == "eq":
        return value == w
    if operator == "ne":
        return value.isNotNull() & (value != w)
    if operator == "contains":
        return F.contains(F.lower(value.cast("string")), F.lower(w.cast("string")))
    if operator == "matches":
        import re

        try:
            re.compile(str(wanted))
        except re.error:
            return F.lit(False)
        return value.cast("string").rlike(f"(?i){wanted}")
    raise ValueError(f"unknown operator {operator}")


def property_distribution(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count_distinct("id").alias("n"))


def out_edges(edges: DataFrame, ids: list[str], types: list[str] | None = None) -> DataFrame:
    rows = edges.where(F.col("source").isin(ids))
    return rows.where(F.col("type").isin(types)) if types else rows


def in_edges(edges: DataFrame, ids: list[str], types: list[str] | None = None) -> DataFrame:
    rows = edges.where(F.col("target").isin(ids))
    return rows.where(F.col("type").isin(types)) if types else rows


def neighbours(edges: DataFrame, ids: list[str], types: list[str] | None = None) -> DataFrame:
    """(id, neighbour, type, direction); a loop appears in both directions."""
    out = out_edges(edges, ids, types).select(F.col("source").alias("id"), F.col("target").alias("neighbour"), "type", F.lit("out").alias("direction"))
    return out.unionAll(in_edges(edges, ids, types).select(F.col("target").alias("id"), F.col("source").alias("neighbour"), "type", F.lit("in").alias("direction")))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those with their ids."""
    return nodes.join(new.select("id").distinct(), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, most: int, order: str) -> DataFrame:
    """Edges whose ends exist, at most ``most`` of a source in ``order`` (existing ones first)."""
    ids = nodes.select("id").distinct()
    ok = new.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    both = edges.withColumn("_new", F.lit(0)).unionByName(ok.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("source").orderBy("_new", order)
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r", "_new")


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``ids`` and the edges at them."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, density, memory_bytes): 600 bytes a node and 200 an edge."""
    counts = nodes.agg(F.count("*").alias("nodes")).withColumn("k", F.lit(0)).join(edges.agg(F.count("*").alias("edges")).withColumn("k", F.lit(0)), "k")
    n, m = F.col("nodes"), F.col("edges")
    return counts.select("nodes", "edges", F.when(n <= 1, 0.0).otherwise(m / (n.cast("double") * (n - 1))).alias("density"), (600 * n + 200 * m).alias("memory_bytes"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which end."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    a = edges.join(ids, F.col("source") == F.col("_id"), "left_anti").withColumn("missing", F.lit("source"))
    return a.unionByName(edges.join(ids, F.col("target") == F.col("_id"), "left_anti").withColumn("missing", F.lit("target")))


def siblings(edges: DataFrame, types: list[str]) -> DataFrame:
    """(parent, a, b): pairs of children of one parent, ``a`` before ``b``."""
    e = edges.where(F.col("type").isin(types)).select(F.col("source").alias("parent"), F.col("target").alias("child")).distinct()
    return e.select("parent", F.col("child").alias("a")).join(e.select("parent", F.col("child").alias("b")), "parent").where("a < b")


def roots(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, root, incoming): the member of each group with most incoming edges, the first id if equal."""
    n = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("incoming"))
    rows = members.join(n, "id", "left").na.fill({"incoming": 0})
    best = rows.groupBy("group").agg(F.min_by(F.struct("id", "incoming"), F.struct(-F.col("incoming"), F.col("id"))).alias("m"))
    return best.select("group", F.col("m.id").alias("root"), F.col("m.incoming").alias("incoming"))


def confidence_buckets(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.floor(F.col(col) * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def two_hop(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(a, b, c): a -first-> b -second-> c with three different nodes."""
    x = edges.where(F.col("type") == first).select(F.col("source").alias("a"), F.col("target").alias("b"))
    y = edges.where(F.col("type") == second).select(F.col("source").alias("b"), F.col("target").alias("c"))
    return x.join(y, "b").where("a <> b and b <> c and a <> c").select("a", "b", "c")


def match_motif(nodes: DataFrame, edges: DataFrame, variables: dict[str, Column], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """All bindings of a pattern.

    ``variables``: condition on the node columns for each variable; ``links``:
    (from, to, edge type, direction), direction ``out``, ``in`` or ``any``.
    Every link must reach a bound variable; variables bind different nodes. A
    node condition filters before its join, so Catalyst sees a chain of equi-joins.
    """

    def pairs(a: str, b: str, type_: str, direction: str) -> DataFrame:
        e = edges.where(F.col("type") == type_).select("source", "target")
        forth = e.select(F.col("source").alias(a), F.col("target").alias(b))
        back = e.select(F.col("target").alias(a), F.col("source").alias(b))
        return (forth if direction == "out" else back if direction == "in" else forth.union(back)).distinct()

    out: DataFrame | None = None
    bound: list[str] = []
    for a, b, type_, direction in links:
        p = pairs(a, b, type_, direction)
        for v in (a, b):
            if v not in bound:
                p = p.join(nodes.where(variables[v]).select(F.col("id").alias(v)).distinct(), v)
        on = [v for v in (a, b) if v in bound]
        if out is not None and not on:
            raise ValueError(f"link {a}-{b} reaches no bound variable")
        out = p if out is None else out.join(p, on)
        for v in (a, b):
            if v not in bound:
                for w in bound:
                    out = out.where(F.col(v) != F.col(w))
                bound.append(v)
    return out.select(*sorted(bound))
