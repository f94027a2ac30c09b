"""Clustering of modest collections by given numbers of groups, and measures of stored clusters.

The k-means runs as DataFrame passes: centres are a bounded table (at most
``k`` rows) and each round is one aggregate over all rows. The agglomerative
form merges centres, not rows: rows are pre-grouped by k-means, so the number
of merged items is bounded by ``start``. Seeds are fixed.

Fewer than ``least`` valid vectors give no clusters; rows with invalid vectors are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.operators import vectors


def _valid(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    v = F.col(vector_col)
    return df.where(vectors.valid(v) & (F.size(v) == dim) & (vectors.norm(v) > 0)).select(F.col(id_col).alias("id"), vectors.normalize(v).alias("v"))


def kmeans(df: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "embedding", dim: int = 64, threshold: float = 0.6, rounds: int = 10, least: int = 2, seed: int = 7) -> DataFrame:
    """(cluster, id, similarity): every centre that a row is at least ``threshold`` alike to, so clusters may overlap; those of one row are left out.

    ``k`` is bounded by what one row of an aggregate may hold.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    rows = _valid(df, id_col, vector_col, dim)
    if rows.limit(max(least, k)).count() < max(least, k):
        return spark.createDataFrame([], f"cluster int, id {rows.schema['id'].dataType.simpleString()}, similarity double")
    model = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=rounds, featuresCol="f").fit(rows.select(array_to_vector("v").alias("f")))
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, c array<double>")
    near = rows.join(F.broadcast(centres), F.size("v") == F.size("c")).select("cluster", "id", vectors.cosine(F.col("v"), F.col("c")).alias("similarity"))  # k rows
    near = near.where(F.col("similarity") >= threshold)
    return near.join(near.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2").select("cluster"), "cluster").select("cluster", "id", "similarity")


def agglomerate(df: DataFrame, most: int, *, id_col: str = "id", vector_col: str = "embedding", dim: int = 64, threshold: float = 0.0, start: int = 64, seed: int = 7) -> DataFrame:
    """(cluster, id): the most alike centres are merged while there are more than ``most`` and they are at least ``threshold`` alike; clusters of one row are left out.

    With at most ``start`` rows every row begins as a cluster of its own, else ``start`` k-means groups do.
    """
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    rows = _valid(df, id_col, vector_col, dim)
    few = rows.orderBy("id").limit(start + 1).collect()
    if not few:
        return spark.createDataFrame([], f"cluster int, id {rows.schema['id'].dataType.simpleString()}")
    if len(few) <= start:
        first = spark.createDataFrame([(r["id"], i) for i, r in enumerate(few)], f"id {rows.schema['id'].dataType.simpleString()}, g int")
        first = rows.join(first, "id")
    else:
        model = KMeans(k=start, distanceMeasure="cosine", seed=seed, featuresCol="f", predictionCol="g").fit(rows.withColumn("f", array_to_vector("v")))
        first = model.transform(rows.withColumn("f", array_to_vector("v"))).select("id", "v", "g")
    sums = first.groupBy("g").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dim)]).alias("s")).orderBy("g").collect()  # at most ``start`` rows
    own = {r["g"]: r["g"] for r in sums}
    total = {r["g"]: np.array(r["s"]) for r in sums}
    while len(total) > most:
        keys = sorted(total)
        u = np.array([total[k] / max(np.linalg.norm(total[k]), 1e-12) for k in keys])
        s = u @ u.T
        s[np.tril_indices(len(keys))] = -2
        i, j = np.unravel_index(int(s.argmax()), s.shape)
        if s[i, j] < threshold:
            break
        total[keys[i]] = total[keys[i]] + total.pop(keys[j])
        own = {g: keys[i] if o == keys[j] else o for g, o in own.items()}
    to = spark.createDataFrame(sorted(own.items()), "g int, cluster int")
    out = first.join(F.broadcast(to), "g").select("cluster", "id")
    return out.join(out.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2").select("cluster"), "cluster")


def confidence(members: DataFrame, centres: DataFrame) -> DataFrame:
    """(cluster, confidence): mean cosine of the members (cluster, v) with their centre (cluster, c)."""
    return members.join(centres, "cluster").groupBy("cluster").agg(F.avg(vectors.cosine(F.col("v"), F.col("c"))).alias("confidence"))


def summary(members: DataFrame) -> DataFrame:
    """(clusters, mean_size, max_size) of (cluster, id)."""
    return members.groupBy("cluster").agg(F.count_distinct("id").alias("n")).agg(F.count("*").alias("clusters"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"))


def related(clusters: DataFrame, wanted: list[float], *, threshold: float = 0.3, top: int = 5) -> DataFrame:
    """(id, score): the clusters whose centroid is most alike to a vector, above ``threshold``."""
    q = F.array(*[F.lit(float(x)) for x in wanted])
    rows = clusters.where(F.size("centroid") == len(wanted)).select("id", vectors.cosine(F.col("centroid").cast("array<double>"), q).alias("score"))
    return rows.where(F.col("score") > threshold).orderBy(F.desc("score"), "id").limit(top)


def themes(members: DataFrame) -> DataFrame:
    """(cluster, theme): the most frequent type, ties by type, and the first two names; members are (cluster, type, name)."""
    kind = members.where("type is not null").groupBy("cluster", "type").agg(F.count("*").alias("n"))
    best = kind.groupBy("cluster").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    r = F.row_number().over(Window.partitionBy("cluster").orderBy("name"))
    names = members.where("name is not null").select("cluster", "name").distinct().withColumn("r", r).where("r <= 2").groupBy("cluster").agg(F.concat_ws(", ", F.min("name"), F.max(F.when(F.col("r") == 2, F.col("name")))).alias("names"))
    return best.join(names, "cluster", "left").select("cluster", F.concat_ws(": ", "type", "names").alias("theme"))
