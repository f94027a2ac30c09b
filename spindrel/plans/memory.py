"""The memory engine: texts in, linked chunks, entities and relationships stored, ranked answers out.

Every table has a ``graph_id``, the session. Ids of chunks are hashes of their
session, text and place, so they never collide over sessions, and storing a
text again adds versions of the same rows. Reads take the latest version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.operators import extraction, linking, ranking, resolution, retention, texts
from spindrel.sources.graphs import TableStore

SCHEMAS = {
    "chunks": "id string, text string, kind string, source string, ts timestamp, confidence double, embedding array<double>",
    "entities": "id string, type string, name string, properties map<string,string>, confidence double, ts timestamp, embedding array<double>",
    "relationships": "id string, source string, target string, type string, confidence double, ts timestamp",
    "links": "id string, type string, source string, target string, confidence double, ts timestamp",
    "accesses": "id string, at timestamp",
}


@dataclass(frozen=True)
class Added:
    """Rows that a call has stored, and entities that were known before."""

    chunks: int
    entities: int
    relationships: int
    links: int
    merged: int


class Memory:
    """A store of memories in a shared folder."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.store = spark, TableStore(spark, directory)

    def table(self, name: str, graphs: list[str] | None = None) -> DataFrame:
        if not self.store.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name]).withColumn("graph_id", F.lit(None).cast("string"))
        return self.store.read(name, graphs=graphs, key=None if name == "accesses" else "id")

    def _put(self, name: str, df: DataFrame, at: Column | None) -> None:
        cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        kinds = dict(x.split(" ", 1) for x in SCHEMAS[name].split(", "))
        have = set(df.columns)
        self.store.write(name, df.select("graph_id", *[(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in cols]), F.col("graph_id"), at)

    def add(self, memories: DataFrame, *, at: Column | None = None) -> Added:
        """Store memories (id, text, session, ts): chunked, read for entities and relationships, resolved, linked.

        Entities that match a known one of any session keep its id; null sessions are ``default``.
        """
        from spindrel.functions.runtime import cut

        rows = memories.where("length(trim(text)) > 0 and id is not null").select(F.col("id").cast("string").alias("id"), "text", F.coalesce("session", F.lit("default")).alias("graph_id"), "ts").dropDuplicates(["id"])
        rows = cut(rows, "memories")
        parts = texts.chunks(rows, "id", "text").join(rows.select(F.col("id").alias("doc"), "graph_id", "ts"), "doc")
        chunks = cut(parts.select("graph_id", F.sha2(F.concat_ws("|", "graph_id", "doc", F.col("pos").cast("string")), 256).alias("id"), "text", "kind", F.col("doc").alias("source"), "ts", "confidence"), "chunks")
        about = rows.select("id", "graph_id", "ts")
        found = extraction.entities(rows.select("id", "text")).join(about, "id")
        none = F.create_map().cast("map<string,string>")
        found = found.groupBy("graph_id", F.col("entity").alias("id")).agg(F.max_by("type", "confidence").alias("type"), F.min("name").alias("name"), F.max("confidence").alias("confidence"), F.max("ts").alias("ts"))
        found = cut(found.select("graph_id", "id", "type", "name", none.alias("properties"), "confidence", "ts", F.lit(None).cast("array<double>").alias("embedding")), "found")
        known = self.table("entities")
        fresh = found.drop("graph_id").dropDuplicates(["id"])
        old = cut(known.drop("graph_id").dropDuplicates(["id"]), "known")
        unknown = fresh.join(old.select("id"), "id", "left_anti")
        same = cut(resolution.resolve(unknown, old).where("match is not null"), "same")
        merged = same.count() + fresh.join(old.select("id"), "id", "left_semi").count()
        to = same.select("id", F.col("match"))
        entities = cut(found.join(to, "id", "left").withColumn("id", F.coalesce("match", "id")).drop("match").dropDuplicates(["graph_id", "id"]), "entities")
        rels = extraction.relationships(rows.select("id", "text")).join(about, "id").select("graph_id", F.col("relationship").alias("id"), "source", "target", "type", "confidence", "ts")
        rels = cut(resolution.rewrite(rels, same).dropDuplicates(["graph_id", "id"]), "relations")
        links = linking.links(entities.dropDuplicates(["id"]), chunks, rels.dropDuplicates(["id"]))
        of = chunks.select(F.col("id").alias("target"), "graph_id", "ts")
        links = cut(links.join(of, "target"), "links")
        for name, df in (("chunks", chunks), ("entities", entities), ("relationships", rels), ("links", links)):
            self._put(name, df, at)
        return Added(chunks.count(), entities.count(), rels.count(), links.count(), merged)

    def query(self, q: ranking.Query, *, graphs: list[str] | None = None, now: Column | None = None) -> DataFrame:
        """(kind, id, score, confidence, ts): ranked results; the ids found are what was accessed recently the next time."""
        chunks, ents, rels, links = (self.table(n, graphs) for n in ("chunks", "entities", "relationships", "links"))
        out = answer(chunks, ents, rels, links, q, accesses=self.table("accesses") if self.store.exists("accesses") else None)
        return out

    def mark(self, ids: DataFrame, at: Column) -> None:
        """Log accesses to (id)."""
        self._put("accesses", ids.select("id", at.alias("at"), F.lit("all").alias("graph_id")), None)

    def forget(self, most: int, policy: str = "lru") -> DataFrame:
        """(id): chunks that a store of at most ``most`` would drop."""
        return retention.evicted(self.table("chunks").select("id", F.col("ts").alias("created_at")), self.table("accesses"), most, policy=policy)

    def totals(self) -> dict[str, int]:
        return {n: self.table(n).count() for n in ("chunks", "entities", "relationships", "links")}

    def clear(self) -> None:
        for n in SCHEMAS:
            self.store.clear(n)


def answer(chunks: DataFrame, entities: DataFrame, relationships: DataFrame, links: DataFrame, q: ranking.Query, *, accesses: DataFrame | None = None) -> DataFrame:
    """Find, score, raise what is accessed often, and rank.

    Chunks need (id, text, kind, source, ts, embedding), entities (id, type,
    name, properties, embedding), relationships (id, type), links (id, type, confidence).
    """
    lex = ranking.lexical_branch(chunks, q)
    dom = ranking.domain_branch(entities, q)
    if accesses is not None:
        times = chunks.groupBy("id").agg(F.max("ts").alias("ts"))
        lex = ranking.recent_first(lex.join(times, "id"), accesses, kind="chunk").select("id", "score")
        dom = ranking.recent_first(dom, accesses, kind="entity").select("id", "score")
    times = chunks.groupBy("id").agg(F.max("ts").alias("ts"), F.max("confidence").alias("confidence"))
    parts = {"chunk": lex.join(times, "id"), "entity": dom, "relationship": ranking.relation_branch(relationships, q)}
    if q.link_types:
        parts["link"] = ranking.filter_links(links, types=q.link_types).distinct()
    return ranking.combine(parts, q.sort, q.limit).where(F.col("score") >= q.least)
