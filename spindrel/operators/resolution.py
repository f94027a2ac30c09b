"""Resolution of new entities against known ones.

Both are (id, type, name, properties, embedding). Exact keys come first:
normal name, normal id, then equal identifying properties. What is left meets
known entities of its type that share a block (first letters of the normal
name's words), is scored, and takes the best above the threshold. Ties go to
the smaller known id. Null or blank names meet nothing by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.functions.runtime import partitions
from spindrel.operators import similarity, vectors
from spindrel.operators.similarity import in_blocks

#: Properties that identify an entity, in this order.
IDENTIFYING = ("email", "ssn", "id_number", "phone", "url")


def _keys(df: DataFrame, who: str) -> DataFrame:
    """(who, type, rank, key): exact keys of each entity."""
    name, own = similarity.normal_name(F.col("name")), similarity.normal_name(F.col("id"))
    props = [F.struct(F.lit(i + 2).alias("rank"), F.concat(F.lit(f"{k}="), F.try_element_at("properties", F.lit(k))).alias("key")) for i, k in enumerate(IDENTIFYING)]
    keys = F.array(F.struct(F.lit(0).alias("rank"), F.concat(F.lit("name="), F.nullif(name, F.lit(""))).alias("key")), F.struct(F.lit(1).alias("rank"), F.concat(F.lit("id="), F.nullif(own, F.lit(""))).alias("key")), *props)
    return df.select(F.col("id").alias(who), F.lower("type").alias("type"), F.inline(keys)).where("key is not null").distinct()


def exact(new: DataFrame, known: DataFrame, *, typed: bool = True) -> DataFrame:
    """(id, match): the first key that a known entity shares decides, then the smaller known id; not itself."""
    on = ["rank", "key", "type"] if typed else ["rank", "key"]
    a, b = _keys(new, "id"), _keys(known, "match")
    b = (b if typed else b.drop("type")).groupBy(*on).agg(F.array_sort(F.collect_set("match")).alias("all"))
    b = b.select(*on, F.slice("all", 1, 2).alias("firsts"))  # two are enough: one of them may be the entity itself
    hits = a.join(b, on).select("id", "rank", F.explode("firsts").alias("match")).where("id <> match")
    return hits.groupBy("id").agg(F.min(F.struct("rank", "match")).alias("m")).select("id", "m.match")


def _pair_score(jw: Column) -> Column:
    """Composite of edits, Jaro-Winkler, words, sound and vectors of the pair ``a``, ``b``."""
    fuzzy = (similarity.levenshtein_similarity(F.col("a.n"), F.col("b.n")) + jw) / 2
    either = F.size(F.array_union("a.ws", "b.ws"))
    words = F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect("a.ws", "b.ws")) / either)
    sound = (F.col("a.sound") == F.col("b.sound")).cast("double")
    vector = F.coalesce(vectors.cosine(F.col("a.embedding"), F.col("b.embedding")), F.lit(0.0))
    return similarity.composite(fuzzy, words, sound, vector)


def _blocks(df: DataFrame, name: str) -> DataFrame:
    """(name, block): what is compared of each entity, for its type and the first three letters of each word of its normal name."""
    ws = F.array_distinct(F.transform(F.split(similarity.normal_name(F.col("name")), " "), lambda w: F.substring(w, 1, 3)))
    rows = df.where("length(trim(name)) > 0 and id is not null").dropDuplicates(["id"])
    n = F.lower("name")
    own = F.struct("id", n.alias("n"), similarity.sound_code(n).alias("sound"), F.array_distinct(F.filter(F.split(n, r"\s+"), lambda t: t != "")).alias("ws"), "embedding")
    return rows.select(own.alias(name), F.explode(F.transform(ws, lambda w: F.concat_ws("/", F.lower("type"), w))).alias("block"))


def _rarest(df: DataFrame, all_: DataFrame, name: str, share: float) -> DataFrame:
    """(name, block): what is compared of each entity, for its type and its rarest words, as many as a pair with ``share`` of all words in common can't miss.

    Of n words at least share * n are common, so one of the n - that + 1 rarest is, in one order for all.
    """
    rows = df.where("length(trim(name)) > 0 and id is not null").dropDuplicates(["id"])
    ws = lambda n: F.array_distinct(F.filter(F.split(n, r"\s+"), lambda t: t != ""))
    n = F.lower("name")
    used = all_.where("length(trim(name)) > 0").select(F.explode(ws(n)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    own = rows.select(F.struct("id", n.alias("n"), similarity.sound_code(n).alias("sound"), ws(n).alias("ws"), "embedding").alias(name), F.lower("type").alias("type"))
    firsts = own.select(F.col(f"{name}.id").alias("id"), F.explode(f"{name}.ws").alias("w")).join(used, "w", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("by"))
    size = F.size("by")
    firsts = firsts.select("id", F.explode(F.slice("by", F.lit(1), (size - F.ceil(size * share) + 1).cast("int"))).alias("f")).select("id", F.col("f.w").alias("w"))
    return own.join(firsts, F.col(f"{name}.id") == F.col("id")).select(name, F.concat_ws("/", "type", "w").alias("block"))


def candidates(new: DataFrame, known: DataFrame, least: float = 0.0) -> DataFrame:
    """(id, match, score) of the pairs that share a block and score at least ``least``; each pair once, not itself.

    Without vectors a high ``least`` needs words in common: such pairs share a
    block of a rare word. Jaro-Winkler runs in Python and is at most 1, so it is only taken for
    pairs that could reach ``least`` with it; the bound is computed in the JVM, edits first.
    """
    parts = partitions(new.sparkSession)
    words = (0.6 * least - 0.39) / 0.15 - 1e-9  # the share of common words that a pair without vectors needs if all else is at its best
    if words > 0:
        bare = lambda df: df.where("embedding is null")
        sides = [(bare(new), known), (new.where("embedding is not null"), bare(known))]
        pairs = None
        for x, y in sides:
            a, b = in_blocks(_rarest(x, known, "a", words), _rarest(y, known, "b", words), "block", "a.id", "b.id")
            both = a.join(b, ["block", "i", "j"]).drop("i", "j")
            pairs = both if pairs is None else pairs.unionByName(both)
        valued = lambda df: df.where("embedding is not null")
        pairs = pairs.unionByName(_blocks(valued(new), "a").repartition(parts, "block").join(_blocks(valued(known), "b"), "block"))
    else:
        pairs = _blocks(new, "a").repartition(parts, "block").join(_blocks(known, "b"), "block")
    pairs = pairs.where("a.id <> b.id and abs(length(a.n) - length(b.n)) <= 0.5 * greatest(length(a.n), length(b.n))")
    vector = F.when(F.col("a.embedding").isNotNull() & F.col("b.embedding").isNotNull(), 0.3).otherwise(0.0)
    edits = (0.6 * least - 0.24 - vector) / 0.15 - 1  # what edits must reach if all else is at its best
    near = pairs.where(similarity.levenshtein_similarity(F.col("a.n"), F.col("b.n")) >= edits).where(_pair_score(F.lit(1.0)) >= least)
    near = near.select("a", "b", F.col("a.id").alias("id"), F.col("b.id").alias("match")).dropDuplicates(["id", "match"])
    scored = near.withColumn("jw", similarity.jaro_winkler(F.col("a.n"), F.col("b.n")))
    return scored.select("id", "match", _pair_score(F.col("jw")).alias("score")).where(F.col("score") >= least)


def resolve(new: DataFrame, known: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, match, score, how): exact matches with score 1, else the best candidate above ``threshold``, else null."""
    sure = exact(new, known).select("id", "match", F.lit(1.0).alias("score"), F.lit("exact").alias("how"))
    rest = new.join(sure, "id", "left_anti")
    best = candidates(rest, known, threshold).where(F.col("score") > threshold).groupBy("id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "match")).alias("m"))
    near = best.select("id", "m.match", (-F.col("m.s")).alias("score"), F.lit("similar").alias("how"))
    got = sure.unionByName(near)
    return new.select("id").distinct().join(got, "id", "left")


def name_index(nodes: DataFrame, order: str) -> DataFrame:
    """(type, name, id): the last node of each name."""
    rows = nodes.where("length(trim(name)) > 0").select(F.lower("type").alias("type"), F.lower(F.trim("name")).alias("name"), "id", F.col(order).alias("o"))
    return rows.groupBy("type", "name").agg(F.max_by("id", F.struct("o", "id")).alias("id"))


def resolve_in_graph(new: DataFrame, nodes: DataFrame, order: str, threshold: float = 0.8) -> DataFrame:
    """(id, match, score): the node of the same id and type (0.95), else that of the same name and type (0.9), else the composite one."""
    ids = new.select("id", F.lower("type").alias("type"), F.lower(F.trim("name")).alias("name")).distinct()
    same = ids.join(nodes.select("id", F.lower("type").alias("type")).distinct(), ["id", "type"]).select("id", F.col("id").alias("match"), F.lit(0.95).alias("score"))
    index = name_index(nodes, order).withColumnRenamed("id", "match")
    named = ids.join(same, "id", "left_anti").join(index, ["type", "name"]).select("id", "match", F.lit(0.9).alias("score"))
    done = same.unionByName(named)
    near = candidates(new.join(done, "id", "left_anti"), nodes, threshold).where(F.col("score") >= threshold).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("m"))
    return done.unionByName(near.select("id", "m.match", (-F.col("m.s")).alias("score")))


def rewrite(relationships: DataFrame, resolved: DataFrame) -> DataFrame:
    """Relationships with the matched ids at their ends; those that now end where they begin are left out."""
    a = resolved.where("match is not null").select(F.col("id").alias("source"), F.col("match").alias("_s"))
    b = resolved.where("match is not null").select(F.col("id").alias("target"), F.col("match").alias("_t"))
    out = relationships.join(a, "source", "left").join(b, "target", "left")
    cols = [F.coalesce("_s", "source").alias("source") if c == "source" else F.coalesce("_t", "target").alias("target") if c == "target" else F.col(c) for c in relationships.columns]
    return out.select(*cols).where("source <> target")


def merge_properties(known: Column, new: Column, at: Column, by: str) -> Column:
    """Later values win; ``lastUpdated`` and ``updatedBy`` are added."""
    none = F.create_map().cast("map<string,string>")
    stamp = F.create_map(F.lit("lastUpdated"), at.cast("string"), F.lit("updatedBy"), F.lit(by))
    late = F.map_concat(F.map_filter(F.coalesce(new, none), lambda k, v: ~k.isin("lastUpdated", "updatedBy")), stamp)
    kept = F.map_filter(F.coalesce(known, none), lambda k, v: ~F.map_contains_key(late, k))
    return F.map_concat(kept, late)


def distinct_entities(entities: DataFrame, order: str) -> DataFrame:
    """One row for each type and lower-case name: the surest, the first if equal."""
    w = Window.partitionBy(F.lower("type"), F.lower("name")).orderBy(F.desc("confidence"), order)
    return entities.where("name is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
