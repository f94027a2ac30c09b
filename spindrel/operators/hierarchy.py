"""Hierarchies of a domain: groups of members, their root, children and siblings, and how sure they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The property that groups each kind of hierarchy, and the group of members without it.
GROUPS = {"organization": ("organization", "unknown"), "taxonomy": ("domain", "general"), "temporal": ("period", "recent")}


def grouped(entities: DataFrame, kind: str) -> DataFrame:
    """(group, id): members by the kind's property or its default; groups of one are left out."""
    key, rest = GROUPS[kind]
    rows = entities.where("id is not null").select(F.coalesce(F.try_element_at("properties", F.lit(key)), F.lit(rest)).alias("group"), "id").distinct()
    return rows.join(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "group")


def children(relationships: DataFrame) -> DataFrame:
    """(parent, child): targets of relations whose type holds ``contains`` or ``manages``, from their own source."""
    t = F.lower("type")
    return relationships.where((F.contains(t, F.lit("contains")) | F.contains(t, F.lit("manages"))) & (F.col("source") != F.col("target"))).select(F.col("source").alias("parent"), F.col("target").alias("child")).distinct()


def confidence(members: Column, pairs: Column, siblings: Column, parents: Column) -> Column:
    """0.8 times if over 20 members, 1.2 with parents and children, 1.1 with siblings, 0.9 if below 1.5 children a parent; 0 to 1."""
    c = F.when(members > 20, 0.8).otherwise(1.0) * F.when(pairs > 0, 1.2).otherwise(1.0) * F.when(siblings > 0, 1.1).otherwise(1.0)
    c = c * F.when((parents > 0) & (pairs / F.greatest(parents, F.lit(1)) < 1.5), 0.9).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def hierarchies(members: DataFrame, relationships: DataFrame, least: float = 0.7) -> DataFrame:
    """(group, root, members, pairs, confidence) of groups (group, id); siblings are counted, not listed."""
    inside = members.select("group", F.col("id").alias("parent")).join(children(relationships), "parent").join(members.select("group", F.col("id").alias("child")), ["group", "child"])
    of_parent = inside.groupBy("group", "parent").agg(F.count("*").alias("k"))
    tree = of_parent.groupBy("group").agg(F.sum("k").alias("pairs"), F.count("*").alias("parents"), F.sum(F.expr("k * (k - 1) div 2")).alias("siblings"))
    count = relationships.where("source <> target").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("incoming"))
    roots = members.join(count, "id", "left").groupBy("group").agg(F.count("*").alias("members"), F.min_by("id", F.struct(-F.coalesce("incoming", F.lit(0)), F.col("id"))).alias("root"))
    rows = roots.join(tree, "group", "left").na.fill({"pairs": 0, "parents": 0, "siblings": 0})
    rows = rows.select("group", "root", "members", "pairs", confidence(F.col("members"), F.col("pairs"), F.col("siblings"), F.col("parents")).alias("confidence"))
    return rows.where(F.round("confidence", 9) >= least)


def inverted(df: DataFrame, key: Column, id_col: str = "id") -> DataFrame:
    """(key, id): an inverted index as rows, so that no key's ids are gathered."""
    return df.select(key.alias("key"), F.col(id_col).alias("id")).where("key is not null").distinct()
