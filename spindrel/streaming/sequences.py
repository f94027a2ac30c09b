"""Greedy sequence matching as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sequences(events: DataFrame, key: str, ts: str, kind: str, pattern: list[str], max_gap_ms: int, tie: str = "event_id") -> DataFrame:
    """Append-mode stream of (key, at): keys whose events hold the pattern, as ``operators.temporal.has_sequence`` has it, each once.

    The state of a key is the place in the pattern, the time of the last match and
    whether a gap was too long. Events of a key must come in the order of time
    over the batches; within a batch they are sorted.
    """
    rows = events.where(F.col(kind).isin(pattern) & F.col(ts).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).alias("_key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("_t"), F.col(tie).cast("string").alias("_tie"), F.col(kind).alias("_kind"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        place, last, over = state.get if state.exists else (0, 0, False)
        hit = None
        for _, t, _, what in sorted((tuple(r) for f in frames for r in f.itertuples(index=False)), key=lambda r: (r[1], r[2])):
            if over or what != pattern[place]:
                continue
            if place and t - last > max_gap_ms:
                over = True
                continue
            place, last = place + 1, t
            if place == len(pattern):
                hit, over = t, True
        state.update((place, last, over))
        yield pd.DataFrame({key: [k[0]] if hit is not None else [], "at": [hit] if hit is not None else []})

    kind_of = events.schema[key].dataType.simpleString()
    return rows.groupBy("_key").applyInPandasWithState(step, f"`{key}` {kind_of}, at long", "place int, last long, over boolean", "append", "NoTimeout")
