"""Registered graph patterns: lookups, candidates, equality of patterns.

A pattern is (pattern, nodes, edges): variables with a type or none, and edges
(from, to, type, direction) with ``out``, ``in`` or ``any``. Patterns are few
and small; ``operators.graph.match_motif`` finds their instances in a graph.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    name: str
    nodes: dict[str, str | None]
    edges: list[tuple[str, str, str | None, str]]
    properties: dict[str, dict[str, str]] = field(default_factory=dict)


def keys(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    """(pattern, what, key): node types, edge types and node properties of registered patterns."""
    rows = [(p.name, "node", t) for p in patterns for t in p.nodes.values() if t]
    rows += [(p.name, "edge", t) for p in patterns for *_, t, _ in p.edges if t]
    rows += [(p.name, "property", f"{k}={v}") for p in patterns for kv in p.properties.values() for k, v in kv.items()]
    return spark.createDataFrame(sorted(set(rows)), "pattern string, what string, key string")


def candidates(known: DataFrame, nodes: list[str], edges: list[str]) -> DataFrame:
    """(pattern): those with any of the node types and all of the edge types; without types all of them."""
    out = known.select("pattern").distinct()
    if nodes:
        out = out.join(known.where((F.col("what") == "node") & F.col("key").isin(nodes)).select("pattern").distinct(), "pattern", "left_semi")
    for e in edges:
        out = out.join(known.where((F.col("what") == "edge") & (F.col("key") == e)).select("pattern").distinct(), "pattern", "left_semi")
    return out


def _normal(edges: list[tuple[str, str, str | None, str]]) -> list[tuple[frozenset | tuple, str | None]]:
    return [(frozenset((a, b)) if d == "any" else (b, a) if d == "in" else (a, b), t) for a, b, t, d in edges]


def isomorphic(p: Pattern, q: Pattern) -> bool:
    """Whether a renaming of variables makes the patterns equal; a missing type fits every type.

    Variables are tried in the order of their degree, and a partial renaming
    with an edge that fits none is left at once.
    """
    if len(p.nodes) != len(q.nodes) or len(p.edges) != len(q.edges):
        return False
    ep, eq = _normal(p.edges), _normal(q.edges)
    degree = {v: sum(v in e for e, _ in ep) for v in p.nodes}
    order = sorted(p.nodes, key=lambda v: -degree[v])

    def fits(a: str | None, b: str | None) -> bool:
        return a is None or b is None or a == b

    def edges_fit(names: dict[str, str]) -> bool:
        free = list(eq)
        for e, t in ep:
            if not all(v in names for v in e):
                continue
            to = frozenset(names[v] for v in e) if isinstance(e, frozenset) else tuple(names[v] for v in e)
            hit = next((f for f in free if f[0] == to and fits(t, f[1])), None)
            if hit is None:
                return False
            free.remove(hit)
        return True

    def grow(names: dict[str, str]) -> bool:
        if len(names) == len(order):
            return edges_fit(names)
        v = order[len(names)]
        for w in q.nodes:
            if w not in names.values() and fits(p.nodes[v], q.nodes[w]) and p.properties.get(v, {}) == q.properties.get(w, {}) and edges_fit(names | {v: w}) and grow(names | {v: w}):
                return True
        return False

    return grow({})


def equal_patterns(patterns: list[Pattern]) -> list[list[str]]:
    """Names of patterns that are equal to each other."""
    groups: list[list[Pattern]] = []
    for p in patterns:
        same = next((g for g in groups if isomorphic(g[0], p)), None)
        if same is None:
            groups.append([p])
        else:
            same.append(p)
    return [[p.name for p in g] for g in groups]


def pairs_of(patterns: list[Pattern]) -> list[tuple[str, str]]:
    return [(a, b) for g in equal_patterns(patterns) for a, b in itertools.combinations(sorted(g), 2)]
