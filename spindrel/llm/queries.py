"""The pN queries: each problem's operator over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions.runtime import table
from spindrel.llm import clusters, language, personal
from spindrel.llm.bpe import token_ids
from spindrel.llm.mixing import mix
from spindrel.llm.names import entities, linked_pairs
from spindrel.llm.nearcopies import near_copy_groups, near_copy_pairs
from spindrel.llm.neighbours import nearest


def _texts(spark: SparkSession, d: str) -> DataFrame:
    memories = table(spark, d, "memories").select(F.lit("memory").alias("kind"), F.col("memory_id").alias("id"), F.col("content").alias("text"))
    chunks = table(spark, d, "text_chunks").select(F.lit("chunk").alias("kind"), "id", F.col("content").alias("text"))
    return memories.unionByName(chunks)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copy_pairs(_texts(spark, d), kind_col="kind")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_copy_groups(_texts(spark, d), kind_col="kind")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(entities(table(spark, d, "entity_records"), table(spark, d, "name_aliases")))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every record with a name."""
    return entities(table(spark, d, "entity_records"), table(spark, d, "name_aliases")).select("id", "entity").distinct()


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "graph_nodes").select(F.lit("node").alias("kind"), "id", "embeddings")
    return nodes.unionByName(table(spark, d, "text_chunks").select(F.lit("chunk").alias("kind"), "id", "embeddings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(_vectors(spark, d), 5, kind_col="kind", min_cosine=0.9)
    return near.select("kind", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 20, whatever their cosine."""
    asks = F.conv(F.substring_index("id", "_", -1), 16, 10).cast("long") % 20 == 0
    near = nearest(_vectors(spark, d), 5, kind_col="kind", query=asks, tables=3, probes=40, width=4.0)
    return near.select("kind", "id", "other", F.round("cosine", 6).alias("cosine"), "rank")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    memories = table(spark, d, "memories")
    return personal.found(memories, personal.learn(memories, table(spark, d, "name_aliases")))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    memories = table(spark, d, "memories")
    return personal.redacted(memories, personal.learn(memories, table(spark, d, "name_aliases")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = clusters.cluster(table(spark, d, "graph_nodes"))
    return clusters.same_cluster(members, table(spark, d, "cluster_probes"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.describe(*clusters.cluster(table(spark, d, "graph_nodes")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language.identify(docs, language.fit(docs))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_or_further(_languages(spark, d))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", "label", "main", F.round("confidence", 4).alias("confidence"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = _languages(spark, d).select("doc_id", F.posexplode("segments").alias("segment", "s"))
    return rows.select("doc_id", "segment", "s.begin", "s.until", "s.lang", F.round("s.confidence", 4).alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_entities, p4_found, p4_neighbours, p5_found, p5_redacted, p6_found, p6_clusters, p7_ids, p8_mix, p8_shares, p9_found, p9_documents, p9_segments)}


def oracle_sql() -> dict[str, str]:
    return {}
