"""What stays in a bounded store: by last access, number of accesses or age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage(accesses: DataFrame) -> DataFrame:
    """(id, uses, last) of accesses (id, at)."""
    return accesses.groupBy("id").agg(F.count("*").alias("uses"), F.max("at").alias("last"))


def evicted(items: DataFrame, accesses: DataFrame, most: int, *, policy: str = "lru", spare: int = 100) -> DataFrame:
    """(id): if there are more than ``most`` items (id, created_at), those beyond ``most - spare`` that were accessed
    longest ago (lru), least often (lfu) or are oldest (temporal); items without accesses go first, ties by id."""
    n = items.select("id").distinct().count()
    if n <= most:
        return items.select("id").limit(0)
    rows = items.groupBy("id").agg(F.min("created_at").alias("created_at")).join(usage(accesses), "id", "left")
    by = {"lru": [F.asc_nulls_first("last")], "lfu": [F.coalesce("uses", F.lit(0))], "temporal": [F.asc_nulls_first("created_at")]}[policy]
    return rows.orderBy(*by, "id").limit(min(n, n - most + spare)).select("id")


def kept(items: DataFrame, gone: DataFrame) -> DataFrame:
    return items.join(gone, "id", "left_anti")
