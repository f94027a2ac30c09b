"""Vector functions and exact search. Arrays are compared in double precision; different lengths give 0 or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def valid(a: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(df: DataFrame, id_col: str, vector_col: str, wanted: list[float], k: int, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(id, score): nearest rows to one vector; euclidean scores are 1 / (1 + distance), dot scores (dot + 1) / 2 within 0 to 1."""
    q, v = F.array(*[F.lit(float(x)) for x in wanted]), F.col(vector_col)
    score = {"cosine": cosine(v, q), "euclidean": 1 / (1 + euclidean(v, q)), "dot": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(v, q) + 1) / 2))}[metric]
    rows = df.where(F.size(v) == len(wanted)).select(F.col(id_col).alias("id"), score.alias("score"))
    rows = rows if threshold is None else rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), "id").limit(k)


def cosine_strict(a: Column, b: Column) -> Column:
    """Cosine that raises if the lengths differ; 0 for a zero vector."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length")).cast("double")).otherwise(cosine(a, b))


def cosine_prefix(a: Column, b: Column) -> Column:
    """Cosine over the places that both have."""
    n = F.least(F.size(a), F.size(b))
    return cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def normalize(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def _mean(dim: int, vector_col: str, weight: Column) -> Column:
    """Element-wise weighted mean as one aggregate for each place, without exploding; null without rows."""
    total = F.sum(weight)
    return F.array(*[F.sum(F.get(vector_col, F.lit(i)).cast("double") * weight) / total for i in range(dim)])


def centroids(df: DataFrame, group_col: str, vector_col: str, dim: int = 64) -> DataFrame:
    """(group, pos, value): element-wise means of the vectors of length ``dim``."""
    rows = df.where(F.size(vector_col) == dim).groupBy(F.col(group_col).alias("group")).agg(_mean(dim, vector_col, F.lit(1.0)).alias("v"))
    return rows.select("group", F.posexplode("v").alias("pos", "value"))


def weighted_centroids(df: DataFrame, group_col: str, vector_col: str, weight_col: str, dim: int = 64) -> DataFrame:
    """(group, vector): weighted element-wise means, of length 1."""
    rows = df.where((F.size(vector_col) == dim) & F.col(weight_col).isNotNull()).groupBy(F.col(group_col).alias("group")).agg(_mean(dim, vector_col, F.col(weight_col).cast("double")).alias("v"))
    return rows.select("group", normalize(F.col("v")).alias("vector"))


def embedding_stats(df: DataFrame, vector_col: str) -> DataFrame:
    """(mean, std, low, high) over all numbers; a row adds its own sums, so nothing is exploded."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = df.where(F.size(vector_col) > 0).select(F.size(v).alias("n"), fold(v).alias("s"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x).alias("q"), F.array_min(v).alias("low"), F.array_max(v).alias("high"))
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    return rows.agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / n - mean * mean)).alias("std"), F.min("low").alias("low"), F.max("high").alias("high"))


def vector_stats(df: DataFrame, vector_col: str) -> DataFrame:
    """(n, dimension, mean_norm) of the rows with a vector."""
    rows = df.where(F.size(vector_col) > 0)
    return rows.agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("dimension"), F.avg(norm(F.col(vector_col))).alias("mean_norm"))


def quality(df: DataFrame, vector_col: str, dim: int = 64) -> DataFrame:
    """(issue, n): missing, empty, of another length, not finite, zero, or good; each row counts once."""
    v = F.col(vector_col)
    issue = F.when(v.isNull(), "missing").when(F.size(v) == 0, "empty").when(~valid(v), "not finite").when(F.size(v) != dim, "other length").when(norm(v) == 0, "zero").otherwise("good")
    return df.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


def search(df: DataFrame, id_col: str, vector_col: str, wanted: list[float], *, where: Column | None = None, threshold: float = 0.7, top: int = 10) -> DataFrame:
    """(rank, id, score): filtered cosine search, at most 100 rows, ties by id."""
    rows = df if where is None else df.where(where)
    best = top_k(rows, id_col, vector_col, wanted, min(top, 100), "cosine", threshold)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "id", "score")  # at most 100 rows


def combine(queries: list[list[float]], how: str = "average", weights: list[float] | None = None) -> list[float]:
    """One query of several: weighted average or element-wise maximum; queries of different length, and joining them, raise."""
    if how not in ("average", "max"):
        raise ValueError(f"{how} changes the length of the query")
    if len({len(q) for q in queries}) != 1:
        raise ValueError("queries of different length")
    if how == "max":
        return [max(x) for x in zip(*queries, strict=True)]
    w = weights or [1.0] * len(queries)
    return [sum(a * x for a, x in zip(w, xs, strict=True)) / sum(w) for xs in zip(*queries, strict=True)]


def pairwise(asked: DataFrame, df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(a, b, cosine): a bounded set of asked rows against all rows, 1 for a row with itself."""
    q = asked.select(F.col(id_col).alias("a"), F.col(vector_col).cast("array<double>").alias("va"))
    return F.broadcast(q).join(df.select(F.col(id_col).alias("b"), F.col(vector_col).cast("array<double>").alias("vb")), F.size("va") == F.size("vb")).select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(cosine(F.col("va"), F.col("vb"))).alias("cosine"))


def leading(df: DataFrame, id_col: str, vector_col: str, keep: int, dim: int = 64) -> DataFrame:
    """(id, vector): vectors less their mean, cut to the first ``keep`` numbers."""
    rows = df.where(F.size(vector_col) == dim)
    mean = rows.agg(_mean(dim, vector_col, F.lit(1.0)).alias("mean"))
    both = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.lit(0).alias("k")).join(F.broadcast(mean.withColumn("k", F.lit(0))), "k")  # one row
    return both.select("id", F.slice(F.zip_with("v", "mean", lambda x, m: x - m), 1, keep).alias("vector"))


def principal(df: DataFrame, id_col: str, vector_col: str, keep: int, dim: int = 64) -> DataFrame:
    """(id, vector): the first ``keep`` principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.where(valid(F.col(vector_col)) & (F.size(vector_col) == dim)).select(F.col(id_col).alias("id"), array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    model = PCA(k=keep, inputCol="v", outputCol="p").fit(rows)
    return model.transform(rows).select("id", vector_to_array("p").alias("vector"))


def approximate(df: DataFrame, id_col: str, vector_col: str, wanted: list[float], k: int, *, tables: int = 8, width: float = 1.0) -> DataFrame:
    """(id, score): cosine search in hash buckets of all vectors of length 1; rows that share no bucket with the query are not seen."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    v = F.col(vector_col)
    rows = df.where(valid(v) & (F.size(v) == len(wanted)) & (norm(v) > 0)).select(F.col(id_col).alias("id"), array_to_vector(normalize(v)).alias("v"))
    length = sum(x * x for x in wanted) ** 0.5 or 1.0
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=width, seed=7).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense([x / length for x in wanted]), k)
    return near.select("id", (1 - F.pow("distCol", F.lit(2.0)) / 2).alias("score"))


def same_content(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, first, copies): texts by their SHA-256, with the first id and the number of ids."""
    return df.where(F.col(text_col).isNotNull()).groupBy(F.sha2(F.col(text_col), 256).alias("digest")).agg(F.min(id_col).alias("first"), F.count_distinct(id_col).alias("copies"))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
