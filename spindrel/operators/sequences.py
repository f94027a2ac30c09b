"""Event sequences: their log, state, statistics, causes and patterns.

A sequence is a log of (seq, at, what, type), ``what`` being start, add or
complete. Additions before the start or after the completion are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences (seq, name, status, events, begin, until) and the refused rows of the log.

    The first start and the first completion after it count; whether a row is
    refused follows from these two times, so no sequence is gathered.
    """
    starts = log.where("what = 'start'").groupBy("seq").agg(F.min("at").alias("begin"), F.min_by("type", "at").alias("name"))
    ends = log.where("what = 'complete'").join(starts, "seq").where("at >= begin").groupBy("seq").agg(F.min("at").alias("until"))
    both = starts.join(ends, "seq", "left")
    rows = log.join(both, "seq", "left")
    late = F.col("begin").isNull() | (F.col("at") < F.col("begin")) | F.coalesce(F.col("at") > F.col("until"), F.lit(False))
    fine = rows.where("what = 'add'").where(~late).groupBy("seq").agg(F.count("*").alias("events"))
    status = F.when(F.col("until").isNull(), "active").otherwise("completed")
    seqs = both.join(fine, "seq", "left").select("seq", "name", status.alias("status"), F.coalesce("events", F.lit(0)).alias("events"), "begin", "until")
    return seqs, rows.where("what <> 'start'").where(late).select(*log.columns)


def active(seqs: DataFrame) -> DataFrame:
    return seqs.where("status = 'active'")


def statistics(seqs: DataFrame) -> DataFrame:
    """(status, sequences, events, mean_length, mean_ms): by status, mean duration of those that have an end."""
    ms = (F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))) / 1000
    return seqs.groupBy("status").agg(F.count("*").alias("sequences"), F.sum("events").alias("events"), F.round(F.avg("events"), 2).alias("mean_length"), F.round(F.avg(ms)).alias("mean_ms"))


def top_types(events: DataFrame, kind: str, top: int = 10) -> DataFrame:
    return events.groupBy(F.col(kind).alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(top)


def durations(seqs: DataFrame) -> DataFrame:
    """(name, events, n, mean_ms) of completed sequences by name and length."""
    ms = (F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))) / 1000
    return seqs.where("status = 'completed'").groupBy("name", "events").agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"))


def causes(events: DataFrame) -> DataFrame:
    """(cause, effect): events (id, caused_by) with the earlier events they name that exist."""
    links = events.select(F.col("id").alias("effect"), F.explode("caused_by").alias("cause")).distinct()
    return links.join(events.select(F.col("id").alias("cause")).distinct(), "cause", "left_semi").select("cause", "effect")
