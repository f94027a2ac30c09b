"""Shuffling of packed numpy records.

A stage in Python that fans each row out to many buckets pays mostly for the
per-row cost of Arrow, of the JVM rows and of the shuffle. Here the records
that go to one shuffle partition travel as one binary value for each input
batch, so that this cost falls on batches and not on records. The reader gets
all records of its partition as one numpy array.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, blob binary"
_ARROW = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def pack(part: np.ndarray, records: np.ndarray) -> pa.RecordBatch | None:
    """One row for each partition number that occurs."""
    if not len(records):
        return None
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[starts[1:], len(part)]
    blobs = [records[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(blobs, pa.binary())], schema=_ARROW)


def exchange(blobs: DataFrame, parts: int) -> DataFrame:
    return blobs.repartitionById(parts, F.col("part"))


def unpack(batches: Iterable[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All records of a partition."""
    got = [np.frombuffer(b.as_buffer(), dtype) for batch in batches for b in batch.column(1)]
    return np.concatenate(got) if got else np.zeros(0, dtype)


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values in a sorted array."""
    if len(keys):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield from zip(starts.tolist(), np.r_[starts[1:], len(keys)].tolist(), strict=True)
