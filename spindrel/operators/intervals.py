"""Overlapping and gapped intervals: continuous periods of each entity and the gaps between them.

Every entity has an ordered map of disjoint intervals as keyed state. An
insertion finds the intervals it touches by binary search, replaces them by
their union and so updates the gaps. Each input partition builds partial maps
first, which shrinks what is shuffled; the maps of a key are then merged in
one place. An entity with more than ``hot`` pieces (its number is known from
the partial maps) is cut into slices at quantiles of the start; a slice only
needs the latest end of the slices before it, so no task holds more than a
slice and the result is the same.

Intervals include their start and not their end; touching ones are continuous.

Defined results: a row counts if its keys and its start aren't null and its end is
null or later than the start; a null end, or one in the year ``open_year`` or
later, is open-ended. Repeated rows change nothing. An empty table gives no
rows. Columns besides the named ones aren't read, so names can't clash.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.functions.runtime import cut

OPEN = 2**63 - 1
BROADCAST_ROWS = 200_000


class IntervalMap:
    """Disjoint intervals [start, end) in order."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: Iterable[int] = (), ends: Iterable[int] = ()):
        self.starts, self.ends = list(starts), list(ends)

    def insert(self, start: int, end: int) -> None:
        if end <= start:
            return
        a = bisect_left(self.ends, start)  # first interval that reaches the start
        b = bisect_right(self.starts, end)  # after the last that begins by the end
        if a < b:
            start, end = min(start, self.starts[a]), max(end, self.ends[b - 1])
        self.starts[a:b] = [start]
        self.ends[a:b] = [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))

    def __len__(self) -> int:
        return len(self.starts)


def _state(batches: Iterable[pa.RecordBatch], keys: int, most: int) -> Iterator[dict[tuple, IntervalMap]]:
    """Maps by key; handed out whenever they hold ``most`` intervals."""
    state: dict[tuple, IntervalMap] = {}
    held = 0
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(keys + 2)]
        for *key, start, end in zip(*cols, strict=True):
            m = state.get(key := tuple(key))
            if m is None:
                m = state[key] = IntervalMap()
            held -= len(m)
            m.insert(start, end)
            held += len(m)
            if held >= most:
                yield state
                state, held = {}, 0
    yield state


def _partial(keys: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state in _state(batches, keys, 200_000):
            rows = [(*k, s, e) for k, m in state.items() for s, e in zip(m.starts, m.ends, strict=True)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:keys]), pa.array(cols[-2], pa.int64()), pa.array(cols[-1], pa.int64())], names=[*(f"k{i}" for i in range(keys)), "s", "e"])

    return run


def _merge(keys: int):
    """Pieces of each key and slice, with the end of the piece before; the input comes key by key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(f"k{i}" for i in range(keys)), "slice", "s", "e", "prev"]
        out: list[tuple] = []
        last, m = None, IntervalMap()

        def done() -> None:
            out.extend((*last, s, e, p) for s, e, p in zip(m.starts, m.ends, [None, *m.ends[:-1]], strict=True))

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            arrays = [*(pa.array(c) for c in cols[:keys]), pa.array(cols[keys], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[keys + 1 :])]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for *key, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    if last is not None:
                        done()
                    last, m = key, IntervalMap()
                m.insert(start, end)
            if len(out) > 50_000:
                yield emit()
        if last is not None:
            done()
        if out:
            yield emit()

    return run


def _pieces(df: DataFrame, keys: list[str], start: str | Column, end: str | Column, open_year: int, hot: int) -> tuple[DataFrame, list[str]]:
    """(keys as k0.., slice, s, e, prev): disjoint pieces; ``prev`` is the latest end before the piece, or null."""
    n = len(keys)
    ks = [f"k{i}" for i in range(n)]
    s, e = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    rows = df.select(*(F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)), s.cast("timestamp").alias("s"), e.cast("timestamp").alias("e"))
    rows = rows.where(" and ".join(f"{k} is not null" for k in [*ks, "s"])).where("e is null or e > s")
    far = F.col("e").isNull() | (F.year("e") >= open_year)
    rows = rows.select(*ks, F.unix_micros("s").alias("s"), F.when(far, F.lit(OPEN)).otherwise(F.unix_micros("e")).alias("e"))
    kind = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ks)
    partial = cut(rows.mapInArrow(_partial(n), f"{kind}, s long, e long"), "intervals")
    heavy = cut(partial.groupBy(*ks).agg(F.count("*").alias("n")).where(F.col("n") > hot), "heavy")
    number, most = heavy.agg(F.count("*"), F.max("n")).first()
    small = (lambda t: F.broadcast(t)) if number <= BROADCAST_ROWS else (lambda t: t)
    if number:
        wide = math.ceil(most / hot)
        steps = [i / (2 * wide) for i in range(1, 2 * wide)]
        marks = cut(partial.join(small(heavy.select(*ks)), ks).groupBy(*ks).agg(F.array_distinct(F.percentile_approx("s", steps, 10_000)).alias("q")), "marks")
        place = F.size(F.filter("q", lambda x: x <= F.col("s"))) + 1
        sliced = partial.join(small(marks), ks, "left").select(*ks, F.when(F.col("q").isNull(), 0).otherwise(place).cast("int").alias("slice"), "s", "e")
    else:
        sliced = partial.select(*ks, F.lit(0).cast("int").alias("slice"), "s", "e")
    own = sliced.repartition(*ks, "slice").sortWithinPartitions(*ks, "slice")
    pieces = own.mapInArrow(_merge(n), f"{kind}, slice int, s long, e long, prev long")
    if number:
        pieces = cut(pieces, "pieces")
        tops = pieces.where("slice > 0").groupBy(*ks, "slice").agg(F.max("e").alias("top"))
        before = Window.partitionBy(*ks).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = cut(tops.select(*ks, "slice", F.max("top").over(before).alias("carry")), "carry")
        carry = F.broadcast(carry) if carry.count() <= BROADCAST_ROWS else carry
        pieces = pieces.join(carry, [*ks, "slice"], "left").select(*ks, "slice", "s", "e", F.greatest("prev", "carry").alias("prev"))
    return pieces, ks


def gaps(df: DataFrame, keys: list[str], start: str | Column, end: str | Column, *, open_year: int = 9999, hot: int = 50_000) -> DataFrame:
    """(keys, gap_from, gap_until) in microseconds of the epoch: what lies between continuous periods."""
    pieces, ks = _pieces(df, keys, start, end, open_year, hot)
    found = pieces.where("prev is not null and s > prev")
    return found.select(*(F.col(k).alias(c) for k, c in zip(ks, keys, strict=True)), F.col("prev").alias("gap_from"), F.col("s").alias("gap_until"))


def periods(df: DataFrame, keys: list[str], start: str | Column, end: str | Column, *, open_year: int = 9999, hot: int = 50_000) -> DataFrame:
    """(keys, period_from, period_until) in microseconds of the epoch; open-ended periods end at null."""
    pieces, ks = _pieces(df, keys, start, end, open_year, hot)
    pieces = cut(pieces, "pieces")
    starts = pieces.where("prev is null or s > prev")
    inside = starts.withColumn("until", F.lead("prev").over(Window.partitionBy(*ks, "slice").orderBy("s")))
    first = starts.groupBy(*ks, "slice").agg(F.min_by("prev", "s").alias("prev"))
    after = first.select(*ks, "slice", F.lead("prev").over(Window.partitionBy(*ks).orderBy("slice")).alias("next"))
    top = pieces.groupBy(*ks).agg(F.max("e").alias("top"))
    done = inside.join(after, [*ks, "slice"]).join(top, ks).withColumn("until", F.coalesce("until", "next", "top"))
    until = F.when(F.col("until") < OPEN, F.col("until"))
    return done.select(*(F.col(k).alias(c) for k, c in zip(ks, keys, strict=True)), F.col("s").alias("period_from"), until.alias("period_until"))
