"""Property graphs as DataFrames: views over relational tables, JSON-lines storage, snapshots."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.functions.runtime import cut, table

NODE = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())])
EDGE = T.StructType([T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("type", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())])


def star_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes (id, type, name, amount) of the relational tables; ``amount`` is the number the table has of each row, or null."""

    def part(name: str, type_: str, key: str, label: str | None, amount: str | None) -> DataFrame:
        id_ = F.concat(F.lit(type_ + ":"), F.col(key).cast("string"))
        return table(spark, d, name).select(id_.alias("id"), F.lit(type_).alias("type"), (F.col(label) if label else id_).alias("name"), (F.col(amount) if amount else F.lit(None)).cast("double").alias("amount"))

    parts = [part("region", "region", "r_regionkey", "r_name", None), part("nation", "nation", "n_nationkey", "n_name", None), part("customer", "customer", "c_custkey", "c_name", "c_acctbal"), part("supplier", "supplier", "s_suppkey", "s_name", "s_acctbal"), part("part", "part", "p_partkey", "p_name", "p_retailprice"), part("orders", "orders", "o_orderkey", None, "o_totalprice")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_edges(spark: SparkSession, d: str, types: tuple[str, ...] | None = None, once: bool = True) -> DataFrame:
    """Edges (source, target, type, weight); ``types`` keeps unneeded tables from being read, ``once=False`` gives derived edges as often as they are found."""

    def ref(type_: str, key: str) -> Column:
        return F.concat(F.lit(type_ + ":"), F.col(key).cast("string"))

    def part(name: str, type_: str, a: Column, b: Column, w: Column) -> tuple[str, DataFrame]:
        return type_, table(spark, d, name).select(a.alias("source"), b.alias("target"), F.lit(type_).alias("type"), w.cast("double").alias("weight"))

    one = F.lit(1.0)
    parts = [
        part("nation", "part_of", ref("nation", "n_nationkey"), ref("region", "n_regionkey"), one),
        part("customer", "located_in", ref("customer", "c_custkey"), ref("nation", "c_nationkey"), one),
        part("supplier", "located_in", ref("supplier", "s_suppkey"), ref("nation", "s_nationkey"), one),
        part("orders", "placed", ref("customer", "o_custkey"), ref("orders", "o_orderkey"), one),
        part("lineitem", "contains", ref("orders", "l_orderkey"), ref("part", "l_partkey"), F.col("l_quantity")),
    ]
    kept = [p for t, p in parts if types is None or t in types]
    if types is None or "supplies" in types:
        kept.append(table(spark, d, "lineitem").select(ref("supplier", "l_suppkey").alias("source"), ref("part", "l_partkey").alias("target")).select("source", "target", F.lit("supplies").alias("type"), one.alias("weight")))
        kept[-1] = kept[-1].distinct() if once else kept[-1]
    out = kept[0]
    for p in kept[1:]:
        out = out.unionByName(p)
    return out


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last version of each row by ``order``."""
    w = Window.partitionBy(key).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# -- JSON-lines storage ---------------------------------------------------------------------------


@dataclass(frozen=True)
class StorageConfig:
    """Where and how graphs are stored."""

    directory: str
    compression: str = "gzip"
    retention_days: int = 30

    def problems(self) -> list[str]:
        out = []
        if not self.directory:
            out.append("directory is empty")
        if self.compression not in ("none", "gzip", "zstd"):
            out.append(f"compression {self.compression} is unknown")
        if self.retention_days < 0:
            out.append("retention_days is negative")
        return out


class GraphStore:
    """Append-only storage of nodes and edges as enveloped JSON lines, with tombstones and snapshots.

    A write appends one directory of files; a read takes the latest version of
    each id and leaves out ids with a later tombstone. Lines that aren't JSON
    are skipped and counted by ``broken_lines``.
    """

    def __init__(self, spark: SparkSession, config: StorageConfig):
        if config.problems():
            raise ValueError("; ".join(config.problems()))
        self.spark, self.config = spark, config

    def _path(self, kind: str) -> str:
        return f"{self.config.directory}/{kind}"

    def _append(self, df: DataFrame, kind: str, schema: T.StructType, at: Column) -> None:
        cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        rows = df.select(F.lit(kind).alias("type"), F.struct(*[c.alias(f.name) for c, f in zip(cols, schema, strict=True)]).alias("data"), at.alias("timestamp"))
        rows.write.mode("append").option("compression", self.config.compression).json(self._path(kind))

    def store_nodes(self, nodes: DataFrame, at: Column | None = None) -> None:
        self._append(nodes, "node", NODE, F.current_timestamp() if at is None else at)

    def store_edges(self, edges: DataFrame, at: Column | None = None) -> None:
        self._append(edges, "edge", EDGE, F.current_timestamp() if at is None else at)

    def delete(self, ids: DataFrame, kind: str, at: Column | None = None) -> None:
        rows = ids.select(F.lit(f"{kind}_delete").alias("type"), F.col("id"), (F.current_timestamp() if at is None else at).alias("timestamp"))
        rows.write.mode("append").option("compression", self.config.compression).json(self._path(f"{kind}_delete"))

    def _exists(self, kind: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(kind))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _load(self, kind: str, schema: T.StructType, types: list[str] | None, since: Column | None) -> DataFrame:
        if not self._exists(kind):
            return self.spark.createDataFrame([], schema)
        line = T.StructType([T.StructField("type", T.StringType()), T.StructField("data", schema), T.StructField("timestamp", T.TimestampType()), T.StructField("_corrupt_record", T.StringType())])
        rows = self.spark.read.schema(line).option("mode", "PERMISSIVE").json(self._path(kind)).where("data.id is not null").select("data.*", F.col("timestamp").alias("_at"))
        rows = latest(rows, "id", F.col("_at"))
        if self._exists(f"{kind}_delete"):
            gone = self.spark.read.schema("type string, id string, timestamp timestamp").json(self._path(f"{kind}_delete")).groupBy("id").agg(F.max("timestamp").alias("_gone"))
            rows = rows.join(gone, "id", "left").where("_gone is null or _gone < _at").drop("_gone")
        if types:
            rows = rows.where(F.col("type").isin(types))
        if since is not None:
            rows = rows.where(F.col("updated_at") >= since)
        return rows.drop("_at")

    def load_nodes(self, types: list[str] | None = None, since: Column | None = None) -> DataFrame:
        return self._load("node", NODE, types, since)

    def load_edges(self, types: list[str] | None = None, since: Column | None = None) -> DataFrame:
        return self._load("edge", EDGE, types, since)

    def broken_lines(self, kind: str) -> int:
        return self.spark.read.text(self._path(kind)).where(F.col("value") != "").where(F.try_parse_json("value").isNull()).count()

    def stats(self, kind: str) -> DataFrame:
        """(file, size, modified, items) of each file."""
        rows = self.spark.read.text(self._path(kind)).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        return rows.groupBy("file_path", "file_size", "file_modification_time").agg(F.count("*").alias("items"))

    def snapshot(self, name: str) -> None:
        """The current state as one consistent version."""
        for kind, df in (("node", self.load_nodes()), ("edge", self.load_edges())):
            df.write.mode("overwrite").parquet(f"{self.config.directory}/snapshots/{name}/{kind}")

    def restore(self, name: str) -> None:
        """Replace the current state by a snapshot: written aside first, then swapped in, so that a failure leaves one of both whole."""
        jvm = self.spark.sparkContext._jvm
        fs_path = jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.config.directory).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        aside = GraphStore(self.spark, StorageConfig(f"{self.config.directory}/restore-{uuid.uuid4().hex[:8]}", self.config.compression, self.config.retention_days))
        for kind in ("node", "edge"):
            rows = self.spark.read.parquet(f"{self.config.directory}/snapshots/{name}/{kind}")
            (aside.store_nodes if kind == "node" else aside.store_edges)(rows)
        for kind in ("node", "edge"):
            for old in (kind, f"{kind}_delete"):
                fs.delete(fs_path(self._path(old)), True)
            fs.rename(fs_path(aside._path(kind)), fs_path(self._path(kind)))
        fs.delete(fs_path(aside.config.directory), True)

    def snapshots(self) -> list[tuple[str, int]]:
        """(name, written at, in milliseconds) of the snapshots."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.config.directory}/snapshots")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted((x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(path)) if fs.exists(path) else []

    def drop_old_snapshots(self, now_ms: int) -> list[str]:
        """Delete snapshots older than the days of retention; their names."""
        old = [n for n, at in self.snapshots() if at < now_ms - self.config.retention_days * 86_400_000]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for n in old:
            p = path(f"{self.config.directory}/snapshots/{n}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return old

    def index(self, kind: str) -> DataFrame:
        """(type, id, file): which file holds which versions of an item."""
        schema = T.StructType([T.StructField("data", T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType())]))])
        return self.spark.read.schema(schema).json(self._path(kind)).where("data.id is not null").select("data.type", "data.id", F.col("_metadata.file_path").alias("file")).distinct()

    def clear(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for kind in ("node", "edge", "node_delete", "edge_delete"):
            p = path(self._path(kind))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def sync(self, changes: DataFrame, kind: str, every: str = "30 seconds", checkpoint: str = ""):
        """Write a stream of nodes or edges behind: one append for each trigger; a batch that is run again adds equal versions only."""
        add = self.store_nodes if kind == "node" else self.store_edges
        writer = changes.writeStream.foreachBatch(lambda df, _: add(df)).option("checkpointLocation", checkpoint or f"{self.config.directory}/sync-{kind}")
        return writer.trigger(availableNow=True).start() if every == "now" else writer.trigger(processingTime=every).start()


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[DataFrame, bool]:
    """Rows of a page, and whether more follow; sorted once, a page is small."""
    rows = cut(df.orderBy(*order).offset(offset).limit(limit + 1), "page")
    return rows.orderBy(*order).limit(limit), rows.count() > limit


def by_id(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.where(F.col("id").isin(ids))


def without_edges(edges: DataFrame, ids: list[str]) -> DataFrame:
    return edges.where(~F.coalesce(F.col("id").isin(ids), F.lit(False)))


def entity_of(nodes: DataFrame) -> DataFrame:
    """(id, type, name, properties): nodes as entities; the name is that of the properties, or the id."""
    return nodes.select("id", "type", F.coalesce(F.try_element_at("properties", F.lit("name")), F.col("id")).alias("name"), "properties")


def replay_log(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Nodes after a log of changes (at, op, id, type): the last one of each id counts, ``delete`` or ``put``."""
    last = log.where("id is not null").groupBy("id").agg(F.max(F.struct("at", "op", F.col("type").alias("new"))).alias("c"))
    rows = nodes.join(last, "id", "full").where("c is null or c.op <> 'delete'")
    return rows.select(*[F.coalesce("c.new", "type").alias("type") if x == "type" else F.col(x) for x in nodes.columns])


def history(log: DataFrame, last: int = 100) -> DataFrame:
    """The last operations of a log (at, op, id), newest first."""
    return log.orderBy(F.desc("at"), "id").limit(last)


class TableStore:
    """Named tables of several graphs (chunks, entities, relationships, links, embeddings): appended parquet, the latest version of each id counts.

    A write adds files below ``graph_id=..``, so a read of some graphs touches only their folders.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def write(self, name: str, df: DataFrame, graph: Column, at: Column | None = None) -> None:
        rows = df.withColumn("graph_id", graph).withColumn("_at", F.current_timestamp() if at is None else at)
        rows.write.mode("append").partitionBy("graph_id").parquet(f"{self.directory}/{name}")

    def read(self, name: str, *, graphs: list[str] | None = None, since: Column | None = None, key: str | None = "id", limit: int | None = None) -> DataFrame:
        """Rows with ``graph_id``, the newest first if limited."""
        rows = self.spark.read.option("basePath", f"{self.directory}/{name}").parquet(f"{self.directory}/{name}").withColumn("graph_id", F.col("graph_id").cast("string"))
        rows = rows.where(F.col("graph_id").isin(graphs)) if graphs else rows
        rows = rows.where(F.col("_at") >= since) if since is not None else rows
        if key:
            w = Window.partitionBy("graph_id", key).orderBy(F.desc("_at"))
            rows = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        if limit is not None:
            rows = rows.orderBy(F.desc("_at"), *([key] if key else [])).limit(limit)
        return rows.drop("_at")

    def exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def clear(self, name: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{name}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def check_memories(spark: SparkSession, path: str) -> DataFrame:
    """(valid, invalid): lines with a string ``content``, and the others."""
    schema = "content string, _corrupt_record string"
    rows = spark.read.text(path).where("length(trim(value)) > 0").select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"), F.try_parse_json("value").alias("v"))
    good = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.content", "variant")) == "STRING", F.lit(False))
    return rows.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"))


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Memory records of JSON lines; lines without a string ``content`` are left out."""
    schema = "content string, sessionId string, userId string, timestamp timestamp, metadata map<string,string>, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null and content is not null").drop("_corrupt_record")


def image_target(width: Column, height: Column) -> Column:
    """Target size of an image: square within 0.2 of equal sides, else tall or wide."""
    ratio = width.cast("double") / height
    return F.when(F.abs(ratio - 1) < 0.2, "672x672").when(ratio < 1, "336x1344").otherwise("1344x336")
