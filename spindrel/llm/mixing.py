"""Mixing sources to target weights by capped water-filling.

A source with ``size`` tokens that gets ``epochs`` passes gives ``epochs *
size`` tokens. Sources whose share of the total would need more passes than
their cap are clamped to it, and what they leave is spread over the others in
proportion to their weights, until no further source exceeds its cap. (The
table of sources is one row a source; this runs on the driver.)

Whole passes take every document. A fractional pass takes documents in the
order of a seeded hash until the fraction of the source's tokens is reached:
hash buckets with their token sums are enough to find the bucket in which
that happens, and only that bucket is ordered.

Defined results: null texts and texts without tokens are never mixed, neither are
documents of a null source or of one without target; a null or negative
weight counts as 0, a null cap as 1; sources with the same name have their
weights added and the larger cap; a source without documents
gets 0 passes and its weight is spread; an empty table gives no documents and
shares of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.functions.runtime import cut
from spindrel.llm.bpe import token_counts

BUCKETS = 4096

def water_fill(weights: dict[str, float], sizes: dict[str, int], caps: dict[str, int], total: float) -> dict[str, float]:
    """Passes of each source: ``total`` tokens by weight, no source beyond its cap."""
    room = {s: caps[s] * sizes[s] for s in weights}
    filled = {s: 0.0 for s in weights}
    open_ = {s for s in weights if weights[s] > 0 and room[s] > 0}
    rest = float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / weight >= room[s]}
        if not over:
            for s in open_:
                filled[s] = rest * weights[s] / weight
            break
        for s in over:
            filled[s] = float(room[s])
        rest -= sum(room[s] for s in over)
        open_ -= over
    return {s: filled[s] / sizes[s] if sizes[s] else 0.0 for s in weights}

def _plan(docs: DataFrame, targets: DataFrame, total_tokens: float | None) -> list[tuple]:
    rows = targets.groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    rows = rows.where("source is not null").join(docs.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("docs")), "source", "left").orderBy("source").collect()
    weights, caps = {r["source"]: float(r["w"]) for r in rows}, {r["source"]: max(0, int(r["cap"])) for r in rows}
    sizes, count = {r["source"]: int(r["size"] or 0) for r in rows}, {r["source"]: int(r["docs"] or 0) for r in rows}
    total = sum(sizes[s] for s in sizes if weights[s] > 0) if total_tokens is None else total_tokens
    epochs = water_fill(weights, sizes, caps, total)
    return [(s, weights[s], caps[s], count[s], sizes[s], epochs[s]) for s in weights]

PLAN = "source string, target_weight double, max_repeats int, documents long, available_tokens long, epochs double"

def mix(documents: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, seed: int = 7, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixed documents (doc_id, source, tokens, repeats) and the report by source.

    ``total_tokens``: size of the mix, by default the tokens of all documents
    whose source has a positive weight.
    """
    spark = documents.sparkSession
    wanted = targets.select("source", F.col("target_weight").cast("double").alias("target_weight"), F.col("max_repeats").cast("int").alias("max_repeats"))
    named = documents.select("doc_id", "source", "text").where("source is not null and text is not null and doc_id is not null")
    named = named.join(wanted.select("source").distinct(), "source", "left_semi")
    docs = cut(token_counts(named, ["doc_id", "source"], path=tokenizer).where("tokens > 0").withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS)).cast("int")), "sizes")
    plan = spark.createDataFrame(_plan(docs, wanted, total_tokens), PLAN)
    whole = plan.select("source", F.floor("epochs").cast("int").alias("whole"), ((F.col("epochs") - F.floor("epochs")) * F.col("available_tokens")).alias("part"))
    sums = docs.groupBy("source", "b").agg(F.sum("tokens").alias("t"))
    before = sums.withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy("b")))  # at most BUCKETS rows a source
    state = before.join(F.broadcast(whole), "source")  # one row a source
    state = state.select("source", "b", "whole", (F.col("part") - (F.col("upto") - F.col("t"))).alias("budget"), "t")
    marked = docs.join(state, ["source", "b"])
    full = marked.where("budget >= t").select("doc_id", "source", "tokens", (F.col("whole") + 1).alias("repeats"))
    none = marked.where("budget <= 0").select("doc_id", "source", "tokens", F.col("whole").alias("repeats"))
    by = Window.partitionBy("source", "b").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = marked.where("budget > 0 and budget < t").withColumn("upto", F.sum("tokens").over(by))
    edge = edge.select("doc_id", "source", "tokens", (F.col("whole") + (F.col("upto") - F.col("tokens") / 2 <= F.col("budget")).cast("int")).alias("repeats"))
    mixed = full.unionByName(none).unionByName(edge).where("repeats > 0")
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    got = plan.join(got, "source", "left").select(*plan.columns, F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))

    every = F.sum("mixed_tokens").over(Window.partitionBy())  # one row a source
    report = got.withColumn("actual_share", F.when(every > 0, F.col("mixed_tokens") / every).otherwise(F.lit(0.0)))
    return mixed, report
