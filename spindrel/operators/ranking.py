"""Filters, relevance and ranking of chunks, entities, relationships and links.

A unified query is a union of scored branches: the first branch that finds an
item fixes its score, then results of all kinds are ranked together. Missing
scores, and scores of 0, take the default of their kind. Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.operators import vectors

#: Default scores of the kinds of results.
DEFAULTS = {"chunk": 0.5, "entity": 0.6, "relationship": 0.4, "link": 0.3}
#: Words of a question that are no names.
QUESTION_WORDS = ["Who", "What", "Where", "When", "Why", "How", "The", "A", "An", "Is", "Are", "Do", "Does"]


def names_in(query: str) -> list[str]:
    """Words that don't begin in lower case and aren't question words; the whole query if there are none."""
    got = [w for w in query.split() if len(w) > 1 and w[0] == w[0].upper() and w not in QUESTION_WORDS]
    return got or [query]


def preview(text: Column, most: int = 100) -> Column:
    return F.concat(F.substring(text, 1, most), F.lit("..."))


def name_match(name: Column, query: str, *, either: bool = True) -> Column:
    """Whether the name holds the query, or the query the name; never for an empty name."""
    n, q = F.lower(name), query.lower()
    hit = F.contains(n, F.lit(q))
    return F.coalesce((F.length(n) > 0) & ((hit | F.contains(F.lit(q), n)) if either else hit), F.lit(False))


def property_hits(properties: Column, query: str) -> Column:
    """Number of properties whose value holds the query."""
    return F.coalesce(F.size(F.filter(F.map_values(properties), lambda v: F.contains(F.lower(v), F.lit(query.lower())))), F.lit(0))


def relevance(name: Column, properties: Column, query: str, *, confidences: dict[str, float] | None = None, similarity: Column | None = None) -> Column:
    """1 for the name itself, 0.7 for a part either way; 0.2 for each property that holds the query; half
    the confidence of an entity found in the query; 1.2 times the cosine. At most 1."""
    n, q = F.lower(name), query.lower()
    score = F.when(n == q, 1.0).when(name_match(name, query), 0.7).otherwise(0.0) + 0.2 * F.greatest(F.lit(0), property_hits(properties, query))
    for known, c in (confidences or {}).items():
        score = score + F.when(n == known.lower(), 0.5 * c).otherwise(0.0)
    if similarity is not None:
        score = score + 1.2 * F.coalesce(similarity, F.lit(0.0))
    return F.least(F.lit(1.0), score)


def relevant(text: Column, query: str, similarity: Column, least: float = 0.2) -> Column:
    """Text match or cosine above ``least``."""
    return F.coalesce(F.contains(F.lower(text), F.lit(query.lower())), F.lit(False)) | F.coalesce(similarity > least, F.lit(False))


def relevant_nodes(nodes: DataFrame, query: str, *, similarity: Column | None = None, least: float = 0.05, top: int | None = None) -> DataFrame:
    """(id, score) of nodes above ``least``, best first."""
    rows = nodes.select("id", relevance(F.col("name"), F.col("properties"), query, similarity=similarity).alias("score")).groupBy("id").agg(F.max("score").alias("score"))
    rows = rows.where(F.col("score") > least).orderBy(F.desc("score"), "id")
    return rows if top is None else rows.limit(top)


def similar_nodes(nodes: DataFrame, vector_col: str, wanted: list[float], most: int, least: float = 0.1) -> DataFrame:
    """(id, score): cosine above ``least``, at least 10 rows if there are so many."""
    q = F.array(*[F.lit(float(x)) for x in wanted])
    rows = nodes.where(vectors.valid(F.col(vector_col))).select("id", vectors.cosine(F.col(vector_col).cast("array<double>"), q).alias("score")).groupBy("id").agg(F.max("score").alias("score"))
    return rows.where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(max(most, 10))


def filter_chunks(chunks: DataFrame, *, query: str | None = None, kind: str | None = None, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks that hold any word of the query, are of the kind and from the source."""
    rows = chunks
    if query:
        words = query.lower().split()
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower("text"), F.lit(w))
        rows = rows.where(hit)
    rows = rows if kind is None else rows.where(F.lower("kind") == kind.lower())
    rows = rows if source is None else rows.where(F.col("source") == source)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def filter_domain(entities: DataFrame, relationships: DataFrame, *, types: list[str] | None = None, relations: list[str] | None = None, name: str | None = None, least: float = 0.0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities by type, part of the name and confidence, and relationships by type and confidence, each limited by itself."""
    e = entities.where(F.coalesce("confidence", F.lit(1.0)) >= least)
    e = e.where(F.col("type").isin(types)) if types else e
    e = e.where(name_match(F.col("name"), name, either=False)) if name else e
    r = relationships.where(F.coalesce("confidence", F.lit(1.0)) >= least)
    r = r.where(F.col("type").isin(relations)) if relations else r
    return (e, r) if limit is None else (e.orderBy("id").limit(limit), r.orderBy("id").limit(limit))


def filter_links(links: DataFrame, *, types: list[str] | None = None, source_graph: str | None = None, target_graph: str | None = None) -> DataFrame:
    """(kind, id, score, ts): links of the types between the graphs, scored by their confidence."""
    rows = links.where(F.col("type").isin(types)) if types else links
    rows = rows if source_graph is None else rows.where(F.col("source_graph") == source_graph)
    rows = rows if target_graph is None else rows.where(F.col("target_graph") == target_graph)
    return rows.select("id", F.col("confidence").alias("score"))


def first_hit(branches: list[DataFrame]) -> DataFrame:
    """(id, score): the score of the first branch that finds an id."""
    rows = None
    for i, b in enumerate(branches):
        one = b.select("id", "score", F.lit(i).alias("_b"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id").agg(F.min_by("score", F.struct("_b", -F.col("score"))).alias("score"))


def multi_index(nodes: DataFrame, conditions: list[Column], how: str = "all", limit: int | None = None) -> DataFrame:
    """Nodes that meet all conditions, or ``any`` of them: one scan whatever their number."""
    if how not in ("all", "any"):
        raise ValueError(f"{how} is neither all nor any")
    ok = None
    for c in conditions:
        c = F.coalesce(c, F.lit(False))
        ok = c if ok is None else (ok & c if how == "all" else ok | c)
    rows = nodes if ok is None else nodes.where(ok)
    return rows if limit is None else rows.orderBy("id").limit(limit)


@dataclass(frozen=True)
class Query:
    """A unified query; what is None isn't asked for."""

    text: str | None = None
    vector: list[float] | None = None
    chunk_kind: str | None = None
    source: str | None = None
    entity_types: list[str] | None = None
    relation_types: list[str] | None = None
    link_types: list[str] | None = None
    sort: str = "relevance"
    limit: int = 50
    near: int = 20
    least: float = 0.0
    extra: dict = field(default_factory=dict)


def _near(df: DataFrame, vector_col: str, q: Query) -> DataFrame:
    return vectors.top_k(df.where(vectors.valid(F.col(vector_col))).dropDuplicates(["id"]), "id", vector_col, q.vector, q.near)


def lexical_branch(chunks: DataFrame, q: Query) -> DataFrame:
    """(id, score): the whole query as a part of the text (0.8), the nearest vectors, the kind (0.9); only chunks of the source."""
    rows = chunks if q.source is None else chunks.where(F.col("source") == q.source)
    parts = []
    if q.text:
        parts.append(rows.where(F.contains(F.lower("text"), F.lit(q.text.lower()))).select("id", F.lit(0.8).alias("score")))
    if q.vector:
        parts.append(_near(rows, "embedding", q))
    if q.chunk_kind:
        parts.append(rows.where(F.lower("kind") == q.chunk_kind.lower()).select("id", F.lit(0.9).alias("score")))
    return first_hit(parts or [rows.select("id", F.lit(0.0).alias("score"))])


def domain_branch(entities: DataFrame, q: Query) -> DataFrame:
    """(id, score): type (0.9), name either way (0.8), the nearest vectors; a query of text alone looks into names and properties."""
    none = not (q.text or q.vector or q.entity_types)
    if none:
        return entities.select("id", F.lit(0.0).alias("score")).distinct()
    parts = []
    if q.entity_types:
        parts.append(entities.where(F.col("type").isin(q.entity_types)).select("id", F.lit(0.9).alias("score")))
    if q.text:
        hit = name_match(F.col("name"), q.text)
        for name in names_in(q.text):
            hit = hit | name_match(F.col("name"), name)
        if not (q.vector or q.entity_types):
            hit = hit | (property_hits(F.col("properties"), q.text) > 0)
        parts.append(entities.where(hit).select("id", F.lit(0.8).alias("score")))
    if q.vector:
        parts.append(_near(entities, "embedding", q))
    return first_hit(parts)


def relation_branch(relationships: DataFrame, q: Query) -> DataFrame:
    rows = relationships.where(F.col("type").isin(q.relation_types)) if q.relation_types else relationships.limit(0)
    return rows.select("id", F.lit(0.7).alias("score")).distinct()


def combine(parts: dict[str, DataFrame], sort: str = "relevance", limit: int = 50) -> DataFrame:
    """(kind, id, score, confidence, ts): results of all kinds, best first by relevance, confidence or time."""
    rows = None
    for kind, df in parts.items():
        get = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)  # noqa: E731, B023
        score = F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(DEFAULTS[kind]))
        one = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), score.alias("score"), get("confidence", "double").alias("confidence"), get("ts", "timestamp").alias("ts"))
        rows = one if rows is None else rows.unionByName(one)
    by = {"confidence": F.coalesce(F.nullif("confidence", F.lit(0.0)), "score"), "timestamp": F.coalesce(F.unix_micros("ts"), F.lit(0))}.get(sort, F.col("score"))
    return rows.orderBy(by.desc(), "kind", "id").limit(limit)


def recent_first(results: DataFrame, accesses: DataFrame, *, kind: str, recent: int = 10, boosted: int = 10) -> DataFrame:
    """(id, score, place): results ordered by their accesses, and the first ones' scores raised.

    ``accesses`` are (id, at). The ``recent`` ids accessed last count as recent.
    Chunks: 0.4 recent, 0.3 share of accesses, 0.3 age within the results; entities: 0.6 and 0.4.
    """
    uses = accesses.groupBy("id").agg(F.count("*").alias("uses"), F.max("at").alias("last"))
    last = uses.orderBy(F.desc("last"), "id").limit(recent).select("id", F.lit(1).alias("recent"))
    rows = results.join(uses, "id", "left").join(F.broadcast(last), "id", "left").na.fill({"uses": 0, "recent": 0})
    most = rows.agg(F.max("uses").alias("m"), F.min("ts").alias("t0"), F.max("ts").alias("t1")).first() if kind == "chunk" else None
    if kind == "chunk":
        t0, t1 = (most["t0"].timestamp(), most["t1"].timestamp()) if most["t1"] is not None else (0.0, 1.0)
        age = F.coalesce((F.unix_micros("ts") / 1e6 - t0) / max(t1 - t0, 1e-6), F.lit(0.0))
        key = 0.4 * F.col("recent") + 0.3 * F.col("uses") / float(max(1, most["m"] or 1)) + 0.3 * age
        extra = F.when(F.col("uses") > 5, F.least(F.lit(0.2), F.col("uses") / 50)).otherwise(0.0)
    else:
        key = 0.6 * F.col("recent") + 0.4 * F.col("uses")
        extra = F.when(F.col("uses") > 3, F.least(F.lit(0.25), F.col("uses") / 40)).otherwise(0.0)
    top = rows.select("id", "score", key.alias("key"), (1 + 0.3 * F.col("recent") + extra).alias("boost")).orderBy(F.desc("key"), "id").limit(boosted)
    top = top.select("id", F.row_number().over(Window.orderBy(F.desc("key"), "id")).alias("place"), "boost")  # ``boosted`` rows
    out = results.select("id", "score").join(F.broadcast(top), "id", "left")
    return out.select("id", F.least(F.lit(1.0), F.col("score") * F.coalesce("boost", F.lit(1.0))).alias("score"), "place")


def cluster_boost(confidence: Column, size: Column, updated: Column, now: Column) -> Column:
    """1, and 0.2 or 0.1 for a confidence above 0.8 or 0.6, 0.1 for 3 to 10 members, 0.05 if updated within a day."""
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    return 1.0 + F.when(confidence > 0.8, 0.2).when(confidence > 0.6, 0.1).otherwise(0.0) + one(size.between(3, 10), 0.1) + one(updated > now - F.expr("interval 24 hours"), 0.05)


def with_clusters(results: DataFrame, members: DataFrame, clusters: DataFrame, now: Column, related: int = 5) -> DataFrame:
    """(id, cluster, theme, size, centrality, representative, related, score, place key): entities with the surest of their clusters.

    Members are (cluster, id), clusters (id, theme, confidence, last_updated). An
    entity of no cluster is ``isolated``. ``related``: the first ids of the cluster besides the entity's own.
    """
    own = members.where("id is not null").select("cluster", "id").distinct()
    size = own.groupBy("cluster").agg(F.count("*").cast("int").alias("size"))
    w = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    first = own.withColumn("r", w).where(F.col("r") <= related + 1).groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("first"))
    info = clusters.select(F.col("id").alias("cluster"), "theme", F.col("confidence").alias("cluster_confidence"), "last_updated").join(size, "cluster").join(first, "cluster")
    best = own.join(info, "cluster").groupBy("id").agg(F.min_by(F.struct("cluster", "theme", "size", "first", "cluster_confidence", "last_updated"), F.struct(-F.coalesce("cluster_confidence", F.lit(0.0)), F.col("cluster"))).alias("c"))
    rows = results.join(best, "id", "left")
    n = F.col("c.size")
    centrality = F.when(n.isNull() | (n <= 1), 1.0).otherwise(F.least(F.lit(1.0), 2.0 / n))
    boost = F.when(n.isNull(), 1.0).otherwise(cluster_boost(F.col("c.cluster_confidence"), n, F.col("c.last_updated"), now))
    score = F.least(F.lit(1.0), F.col("score") * boost)
    others = F.slice(F.filter("c.first", lambda x: x != F.col("id")), 1, related)
    return rows.select(
        "id", F.coalesce("c.cluster", F.lit("isolated")).alias("cluster"), F.col("c.theme").alias("theme"), F.coalesce(n, F.lit(1)).alias("size"), centrality.alias("centrality"),
        (F.coalesce(F.col("c.theme") == F.col("type"), F.lit(False)) | (centrality > 0.7)).alias("representative"), others.alias("related"), score.alias("score"), (score + 0.1 * F.coalesce("c.cluster_confidence", F.lit(0.0))).alias("order_key"),
    )


def contextual(messages: DataFrame, nodes: DataFrame, keyword_of: Column, most: int, last: int = 3) -> DataFrame:
    """(conv, id): for each conversation the first ``most`` nodes whose text holds a keyword of its ``last`` messages.

    Messages are (conv, turn, text), nodes (id, text). Nodes meet conversations by
    whole words, so the join has a key.
    """
    w = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("turn")))
    words = messages.withColumn("_r", w).where(F.col("_r") <= last).select("conv", F.explode(keyword_of).alias("word")).distinct()
    posts = nodes.where("text is not null").select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word"))
    first = F.row_number().over(Window.partitionBy("word").orderBy("id"))
    posts = posts.withColumn("_f", first).where(F.col("_f") <= most)  # only the first nodes of a word can be among the first of a conversation
    hits = words.join(posts, "word").select("conv", "id").distinct()
    r = F.row_number().over(Window.partitionBy("conv").orderBy("id"))
    return hits.withColumn("r", r).where(F.col("r") <= most).select("conv", "id")
