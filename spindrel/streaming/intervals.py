"""The interval map as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.operators.intervals import OPEN, IntervalMap


def stream_gaps(df: DataFrame, keys: list[str], start: str, end: str, *, open_year: int = 9999) -> DataFrame:
    """Update-mode stream of (keys, gap_from, gap_until): all gaps of each entity that a batch touched.

    The state of an entity is its ordered map of disjoint intervals. The rules
    for rows are those of ``operators.intervals``; after the last batch the
    latest rows of each entity equal the batch operator's. An entity that has
    no gap left gives one row with null gaps.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    far = F.col("e").isNull() | (F.year("e") >= open_year)
    rows = df.select(*keys, F.col(start).cast("timestamp").alias("s"), F.col(end).cast("timestamp").alias("e"))
    rows = rows.where(" and ".join(f"{k} is not null" for k in [*keys, "s"])).where("e is null or e > s")
    rows = rows.select(*keys, F.unix_micros("s").alias("s"), F.when(far, F.lit(OPEN)).otherwise(F.unix_micros("e")).alias("e"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        m = IntervalMap(*state.get) if state.exists else IntervalMap()
        for frame in frames:
            for s, e in zip(frame["s"].tolist(), frame["e"].tolist(), strict=True):
                m.insert(s, e)
        state.update((m.starts, m.ends))
        found = m.gaps() or [(None, None)]
        out = pd.DataFrame([(*key, a, b) for a, b in found], columns=[*keys, "gap_from", "gap_until"])
        yield out.astype({"gap_from": "Int64", "gap_until": "Int64"})

    return rows.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, gap_from long, gap_until long", "starts array<long>, ends array<long>", "update", "NoTimeout")
