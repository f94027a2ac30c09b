"""Edges with validity periods, and event sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Words of relations.
EVENT_WORDS = "happened|occurred|started|ended|began|finished|created|deleted|changed"
STATE_WORDS = "is|has|contains|includes|located|based|works|lives|manages"


def valid_at(edges: DataFrame, at: Column) -> DataFrame:
    return edges.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def overlapping(edges: DataFrame, start: Column, end: Column, open_end: Column) -> DataFrame:
    """Periods that meet the closed range; open ones end at ``open_end``."""
    return edges.where((F.col("valid_from") <= end) & (F.coalesce(F.col("valid_until"), open_end) >= start))


def superseded(edges: DataFrame, conflict: Column, order: list[Column]) -> DataFrame:
    """An edge ends at the latest when the next one of its (source, target, conflict class) begins."""
    nxt = F.lead("valid_from").over(Window.partitionBy("source", "target", conflict).orderBy(*order))
    return edges.withColumn("valid_until", F.least(F.col("valid_until"), nxt))


def metrics(edges: DataFrame, now: Column) -> DataFrame:
    ok = (F.col("valid_from") <= now) & (F.col("valid_until").isNull() | (F.col("valid_until") > now))
    when = F.when(ok, F.col("valid_from"))
    return edges.agg(F.count("*").alias("total"), F.count_if(F.coalesce(ok, F.lit(False))).alias("valid"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"), F.min(when).alias("oldest"), F.max(when).alias("newest"))


def temporal_type(name: Column) -> Column:
    """Event before state, else fact, by words of the relation's name; underscores part words."""
    words = F.lower(F.regexp_replace(name, "_", " "))
    return F.when(words.rlike(rf"\b({EVENT_WORDS})\b"), "event").when(words.rlike(rf"\b({STATE_WORDS})\b"), "state").otherwise("fact")


def default_expiry(start: Column, kind: Column) -> Column:
    return start + F.make_dt_interval(F.when(kind == "fact", 365).when(kind == "event", 30).when(kind == "state", 90).otherwise(365))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, session, begin, until, n): runs of events with no pause longer than ``gap``."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    fresh = F.lag(ts).over(w).isNull() | (F.col(ts) > F.lag(ts).over(w) + F.expr(f"interval {gap}"))
    rows = events.withColumn("session", F.sum(F.when(fresh, 1).otherwise(0)).over(w))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("begin"), F.max(ts).alias("until"), F.count("*").alias("n"))


def has_sequence(events: DataFrame, key: str, ts: str, kind: str, pattern: list[str], max_gap_ms: int, tie: str = "event_id") -> DataFrame:
    """Keys whose events hold the pattern as a subsequence: greedy first matches, failing at the first gap that is too long."""
    at = F.struct(F.unix_millis(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("e"))
    rows = events.where(F.col(kind).isin(pattern) & F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(kind).alias("_kind"), at.alias("_at"))
    place = None
    for wanted in pattern:  # the first match of each place is a minimum of the key's events after the place before
        own = rows.where(F.col("_kind") == wanted).select("_key", "_at")
        if place is None:
            place = own.groupBy("_key").agg(F.min("_at").alias("_at"))
            continue
        later = own.withColumnRenamed("_at", "_next").join(place, "_key").where(F.col("_next") > F.col("_at"))
        place = later.groupBy("_key", "_at").agg(F.min("_next").alias("_next")).where(F.col("_next.t") - F.col("_at.t") <= max_gap_ms).select("_key", F.col("_next").alias("_at"))
    return place.select(F.col("_key").alias(key))


#: Pairs of relations that exclude each other, and the class that each pair shares.
EXCLUSIVE = [("married_to", "divorced_from"), ("works_at", "unemployed"), ("lives_at", "moved_from"), ("owns", "sold"), ("leads", "left_position")]


def conflict_class(type_: Column) -> Column:
    """Types of one class conflict: a type with itself, and with the one that excludes it."""
    out = F.lower(type_)
    for a, b in EXCLUSIVE:
        out = F.when(F.lower(type_) == b, a).otherwise(out)
    return out


def superseded_by_change(edges: DataFrame, order: list[Column]) -> DataFrame:
    """The other rule: an edge ends when the next one of its (source, target) that has another type begins."""
    w = Window.partitionBy("source", "target").orderBy(*order)
    run = F.sum(F.when(F.lag("type").over(w).eqNullSafe(F.col("type")), 0).otherwise(1)).over(w)
    rows = edges.withColumn("_run", run)
    starts = rows.groupBy("source", "target", "_run").agg(F.min("valid_from").alias("_begin"))
    nxt = F.lead("_begin").over(Window.partitionBy("source", "target").orderBy("_run"))
    starts = starts.select("source", "target", "_run", nxt.alias("_next"))
    return rows.join(starts, ["source", "target", "_run"]).select(*[F.least("valid_until", "_next").alias("valid_until") if c == "valid_until" else F.col(c) for c in edges.columns])


def at_node(edges: DataFrame, node: str, at: Column, mode: str = "valid") -> DataFrame:
    """Edges at a node: ``all``, ``valid`` at a time, or ``invalidated`` by then."""
    rows = edges.where((F.col("source") == node) | (F.col("target") == node))
    if mode == "all":
        return rows
    return valid_at(rows, at) if mode == "valid" else rows.where(F.col("valid_until") <= at)


def graph_state(edges: DataFrame, nodes: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Valid edges at a time, and the nodes at their ends."""
    now = valid_at(edges, at)
    ids = now.select(F.col("source").alias("id")).union(now.select(F.col("target").alias("id"))).distinct()
    return now, nodes.join(ids, "id", "left_semi")


def invalidate(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges ended by (id, at, reason): the earlier end counts; ``reason`` is that of the change that ended the edge."""
    c = changes.groupBy("id").agg(F.min(F.struct("at", "reason")).alias("c"))
    rows = edges.join(c, "id", "left")
    ends = F.col("c.at").isNotNull() & (F.col("valid_until").isNull() | (F.col("c.at") < F.col("valid_until")))
    return rows.select(*[F.when(ends, F.col("c.at")).otherwise(F.col(x)).alias(x) if x == "valid_until" else F.col(x) for x in edges.columns], F.when(ends, F.col("c.reason")).alias("reason"))


def update_period(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with the periods of (id, valid_from, valid_until, reason) where those aren't null."""
    c = changes.select("id", F.struct("valid_from", "valid_until", "reason").alias("c"))
    cols = [F.coalesce(F.col(f"c.{x}"), F.col(x)).alias(x) if x in ("valid_from", "valid_until") else F.col(x) for x in edges.columns]
    return edges.join(c, "id", "left").select(*cols, F.col("c.reason").alias("reason"))


def cleanup(edges: DataFrame, cutoff: Column, only_inactive: Column | None = None) -> DataFrame:
    """Without edges that ended before ``cutoff`` (and are inactive)."""
    old = F.coalesce(F.col("valid_until") < cutoff, F.lit(False))
    return edges.where(~(old if only_inactive is None else old & ~F.coalesce(only_inactive, F.lit(False))))


def track(relationships: DataFrame, graph: str) -> DataFrame:
    """Relationships with their temporal type, and an end by default where they have none."""
    kind = temporal_type(F.col("type"))
    rows = relationships.withColumn("temporal_type", F.coalesce("temporal_type", kind) if "temporal_type" in relationships.columns else kind)
    return rows.withColumn("graph", F.lit(graph)).withColumn("valid_until", F.coalesce("valid_until", default_expiry(F.col("valid_from"), F.col("temporal_type"))))


def tracked(rows: DataFrame, *, at: Column | None = None, kinds: list[str] | None = None, graphs: list[str] | None = None, between: tuple[Column, Column] | None = None, now: Column | None = None) -> DataFrame:
    """Tracked relationships by validity, type, graph, and strict overlap with a range; open ones end ``now``."""
    rows = rows if at is None else valid_at(rows, at)
    rows = rows.where(F.col("temporal_type").isin(kinds)) if kinds else rows
    rows = rows.where(F.col("graph").isin(graphs)) if graphs else rows
    if between is not None:
        rows = rows.where((F.col("valid_from") < between[1]) & (F.coalesce(F.col("valid_until"), now if now is not None else F.current_timestamp()) > between[0]))
    return rows


def stats(edges: DataFrame, now: Column, kind: Column) -> DataFrame:
    """(kind, active, invalidated, mean_age_s, ended_last_day) by ``kind``: those with an end by ``now`` are invalidated."""
    over = F.coalesce(F.col("valid_until") <= now, F.lit(False))
    age = F.unix_micros(now) / 1e6 - F.unix_micros(F.col("valid_from").cast("timestamp")) / 1e6
    day = over & (F.col("valid_until") > now - F.expr("interval 24 hours"))
    return edges.groupBy(kind.alias("kind")).agg(F.count_if(~over).alias("active"), F.count_if(over).alias("invalidated"), F.avg(age).alias("mean_age_s"), F.count_if(day).alias("ended_last_day"))


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def by_day(edges: DataFrame, ts: str = "valid_from") -> DataFrame:
    """(day, type, n)."""
    return edges.where(F.col(ts).isNotNull()).groupBy(day(F.col(ts)).alias("day"), "type").agg(F.count("*").alias("n"))


def edge_key(source: Column, type_: Column, target: Column, at: Column) -> Column:
    return F.concat_ws("_", F.lit("temp"), source, type_, target, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
