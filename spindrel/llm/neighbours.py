"""Most similar vectors for every vector: multiprobe p-stable hashing.

Each of ``tables`` hash tables projects the unit vectors on ``m`` random
orthogonal directions and cuts every direction into slots of ``width``. A row
is stored in its home cell of each table. As a query it visits its home cell
and the ``probes`` neighbouring cells that most likely hold close vectors:
sets of one to three steps over the nearest slot borders, in the order of
their summed squared distances to those borders (the estimated success
order). Candidates of all visited cells are compared there by a matrix
product of 8-bit codes, the best of them are merged over the tables and
ranked again by the exact cosine of the stored vectors.

``m`` follows the number of rows, so that a cell keeps its size while the
collection grows. A cell with more than ``hot`` stored rows is split into
blocks by row hash and its queries visit every block, so no task holds more
than a block; nothing is dropped. Equal vectors in a block count once: the
``k + 1`` first rows of a group of copies stand for it as candidates, and its
queries are answered once for all.

Defined results: rows whose vector is null, empty, of another length, all
zero, or holds nulls, NaN or infinite values are left out; rows with a null
id too; an id that is stored repeatedly with the same vector counts once; a row is never
its own neighbour; equal cosines are ordered by id; an empty table gives no
rows; columns besides the named ones are not read, so their names can't clash.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.functions.runtime import partitions
from spindrel.llm import blobs


def record(dim: int) -> np.dtype:
    """A row in a cell; a negative scale marks a query that isn't stored there. ``same`` is the hash of the whole vector."""
    return np.dtype([("cell", "<u4"), ("id", "<i8"), ("same", "<u4"), ("scale", "<f2"), ("code", "i1", (dim,))])


def unit_rows(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row positions, row hashes and unit vectors of the valid rows of a batch."""
    lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, int)
    ok = (lengths == dim) & vectors.is_valid().to_numpy(False) & ids.is_valid().to_numpy(False)
    at = np.flatnonzero(ok)
    flat = vectors.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    norm = np.sqrt((flat.astype(np.float64) ** 2).sum(axis=1)) if len(flat) else np.zeros(0)
    good = np.isfinite(norm) & (norm > 0)
    x = (flat[good] / norm[good, None]).astype(np.float32)
    return at[good], ids.take(pa.array(at[good])).to_numpy(zero_copy_only=False).astype(np.int64), x


class Hashing:
    """Home cells and probe sequences of ``tables`` p-stable hash tables."""

    def __init__(self, dim: int, m: int, width: float, tables: int, probes: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        m = min(m, dim)
        self.m, self.width, self.probes = m, width, probes
        self.directions, self.shifts, self.steps = [], [], []
        for _ in range(tables):
            q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            self.directions.append((q[:, :m] * math.sqrt(dim)).astype(np.float32))
            self.shifts.append((rng.random(m) * width).astype(np.float32))
            self.steps.append(rng.integers(1, 2**63 - 1, m, dtype=np.int64).astype(np.uint64) | np.uint64(1))
        near = min(2 * m, 10)
        expected = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) for j in range(near)]
        sets = [s for r in (1, 2, 3) for s in itertools.combinations(range(near), r)]
        self.sets = sorted(sets, key=lambda s: sum(expected[j] for j in s))[: 4 * probes]

    def home(self, x: np.ndarray, t: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.floor((x @ self.directions[t] + self.shifts[t]) / self.width).astype(np.int64).astype(np.uint64)
            return blobs.mix((h * self.steps[t]).sum(axis=1, dtype=np.uint64) + np.uint64(t + 1))

    def visits(self, x: np.ndarray, t: int) -> np.ndarray:
        """Cells a query visits, home first: one column each."""
        y = (x @ self.directions[t] + self.shifts[t]) / self.width
        h = np.floor(y)
        f = y - h
        with np.errstate(over="ignore"):
            base = (h.astype(np.int64).astype(np.uint64) * self.steps[t]).sum(axis=1, dtype=np.uint64) + np.uint64(t + 1)
            if not self.probes:
                return blobs.mix(base)[:, None]
            scores = np.concatenate([f * f, (1 - f) ** 2], axis=1)
            near = np.argsort(scores, axis=1)[:, : max(max(s) for s in self.sets) + 1]
            score = np.take_along_axis(scores, near, axis=1)
            direction = near % self.m
            change = np.concatenate([np.uint64(0) - self.steps[t], self.steps[t]])[near]
            total = np.empty((len(x), len(self.sets)), np.float32)
            cell = np.empty((len(x), len(self.sets)), np.uint64)
            for j, s in enumerate(self.sets):
                total[:, j] = sum(score[:, r] for r in s)
                cell[:, j] = base + sum(change[:, r] for r in s)
                for a, b in itertools.combinations(s, 2):
                    total[direction[:, a] == direction[:, b], j] = np.inf
            best = np.argpartition(total, self.probes - 1, axis=1)[:, : self.probes] if len(self.sets) > self.probes else np.argsort(total, axis=1)
            return blobs.mix(np.concatenate([base[:, None], np.take_along_axis(cell, best, axis=1)], axis=1))


def _salted(cell: np.ndarray, block: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.where(block == 0, cell, blobs.mix(cell + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _count_cells(hashing: Hashing, dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _, x = unit_rows(batch.column(0), batch.column(1), dim)
            kind = batch.column(2).to_numpy()[at].view(np.uint64)
            for t in range(len(hashing.directions)):
                cells, counts = np.unique(hashing.home(x, t) ^ kind, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(counts.astype(np.int64))], names=["cell", "n"])

    return run


def _scatter(hashing: Hashing, dim: int, parts: int, hot: dict[int, int], asked: bool):
    """Records of stored rows and queries; where all rows ask (``asked``), a stored row is its own query at home."""
    hot_cells = np.array(sorted(hot), np.int64).view(np.uint64)
    hot_cells.sort()
    hot_blocks = np.array([hot[int(c)] for c in hot_cells.view(np.int64)], np.int64)

    def blocks_of(cell: np.ndarray) -> np.ndarray:
        if not len(hot_cells):
            return np.ones(len(cell), np.int64)
        at = np.minimum(np.searchsorted(hot_cells, cell), len(hot_cells) - 1)
        return np.where(hot_cells[at] == cell, hot_blocks[at], 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = record(dim)
        for batch in batches:
            at, ids, x = unit_rows(batch.column(0), batch.column(1), dim)
            kind = batch.column(2).to_numpy()[at].view(np.uint64)
            asks = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)[at]
            if not len(x):
                continue
            scale = (np.abs(x).max(axis=1) / 127).astype(np.float16).astype(np.float32)
            code = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
            same = vector_hash(x)
            for t in range(len(hashing.directions)):
                cells = [hashing.home(x, t) ^ kind]
                rows, stored = [np.arange(len(x))], [np.ones(len(x), bool)]
                visits = hashing.visits(x[asks], t)[:, int(asked) :]
                rows.append(np.repeat(np.flatnonzero(asks), visits.shape[1]))
                cells.append((visits ^ kind[asks][:, None]).ravel())
                stored.append(np.zeros(visits.size, bool))
                row, cell, own = np.concatenate(rows), np.concatenate(cells), np.concatenate(stored)
                n = blocks_of(cell)
                block = np.zeros(len(row), np.int64)
                wide = n > 1
                if wide.any():  # a stored row keeps its block, a query visits all of them
                    mine = blobs.mix(ids[row].view(np.uint64)) % n.astype(np.uint64)
                    block = np.where(own & wide, mine.astype(np.int64), 0)
                    i = np.flatnonzero(wide & (~own | asked))
                    again = np.repeat(i, n[i])
                    every = np.concatenate([np.arange(k) for k in n[i]]) if len(i) else np.zeros(0, np.int64)
                    keep = ~(own[again] & (every == block[again]))
                    again, every = again[keep], every[keep]
                    rest = ~wide | own
                    row = np.concatenate([row[rest], row[again]])
                    cell = np.concatenate([cell[rest], cell[again]])
                    block = np.concatenate([block[rest], every])
                    own = np.concatenate([own[rest], np.zeros(len(again), bool)])
                cell = _salted(cell, block)
                out = np.empty(len(row), dtype)
                out["cell"] = (cell >> np.uint64(32)).astype(np.uint32)
                out["id"] = ids[row]
                out["same"] = same[row]
                out["scale"] = np.where(own, scale[row], -scale[row])
                out["code"] = code[row]
                got = blobs.pack((cell % np.uint64(parts)).astype(np.int32), out)
                if got is not None:
                    yield got

    return run


_PAIR = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("near", pa.float32())])


def vector_hash(x: np.ndarray) -> np.ndarray:
    """32-bit hash of each row of floats."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for j in range(bits.shape[1]):
        h = blobs.mix(h ^ bits[:, j])
    return (h >> np.uint64(32)).astype(np.uint32)


def _first_copies(rows: np.ndarray, most: int) -> np.ndarray:
    """Positions of rows so that equal vectors keep their ``most`` first ids; vectors that only share a code are all kept."""
    code = np.ascontiguousarray(rows["code"])
    words = code.view(np.uint64) if code.shape[1] % 8 == 0 else code.astype(np.uint64)
    h = rows["same"].astype(np.uint64)
    for j in range(words.shape[1]):
        h = blobs.mix(h ^ words[:, j])
    order = np.lexsort((rows["id"], h))
    same = np.r_[False, h[order][1:] == h[order][:-1]]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return order[np.arange(len(order)) - start < most]


def _search(dim: int, keep: int, floor: float | None, asked: bool):
    """Best stored rows for each query of a cell: those above ``floor``, or the ``keep`` best."""

    def cell_pairs(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, first = np.unique(np.rec.fromarrays([rows["id"], rows["scale"] < 0]), return_index=True)
        rows = rows[first]
        own = rows["scale"] > 0
        home = rows[own]
        if not len(home):
            return
        home = home[_first_copies(home, keep + 1)]
        ask = rows if asked else rows[~own]
        _, one = np.unique(ask["id"], return_index=True)
        ask = ask[one]
        codes, back = np.unique(np.ascontiguousarray(ask["code"]).view(f"V{dim}").ravel(), return_index=True, return_inverse=True)[1:]
        right = (home["code"].astype(np.float32) * np.abs(home["scale"]).astype(np.float32)[:, None]).T
        step = max(16, 4_000_000 // len(home))
        order = np.argsort(back, kind="stable")
        bounds = np.searchsorted(back[order], np.arange(len(codes) + 1))
        for a in range(0, len(codes), step):
            lead = ask[codes[a : a + step]]
            s = (lead["code"].astype(np.float32) * np.abs(lead["scale"]).astype(np.float32)[:, None]) @ right
            if floor is not None:
                i, j = np.nonzero(s >= floor)
                v = s[i, j]
                by = np.lexsort((home["id"][j], -v, i))
                i, j, v = i[by], j[by], v[by]
                rank = np.arange(len(i)) - np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0)) if len(i) else i
                i, j, v = i[rank <= keep], j[rank <= keep], v[rank <= keep]
            else:
                k = min(keep + 1, len(home))
                j = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(home) else np.tile(np.arange(k), (len(s), 1))
                v = np.take_along_axis(s, j, axis=1).ravel()
                i, j = np.repeat(np.arange(len(s)), k), j.ravel()
            if not len(i):
                continue
            size = np.diff(bounds)[a + i]  # every query with this code gets the same answer
            who = np.repeat(bounds[a + i], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            q, n, v = ask["id"][order[who]], np.repeat(home["id"][j], size), np.repeat(v, size)
            good = q != n
            yield q[good], n[good], v[good]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = blobs.unpack(batches, record(dim))
        rows = rows[np.argsort(rows["cell"], kind="stable")]
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for a, b in blobs.runs(rows["cell"]):
            if b - a > 1:
                for got in cell_pairs(rows[a:b]):
                    held.append(got)
                    size += len(got[0])
                    if size > 200_000:
                        yield from _best(held, keep)
                        held, size = [], 0
        yield from _best(held, keep)

    return run


def _best(held: list[tuple[np.ndarray, ...]], keep: int) -> Iterator[pa.RecordBatch]:
    """The ``keep`` best partners of each query among what is held, each pair once."""
    if not held:
        return
    q, n, v = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.lexsort((n, -v, q))
    q, n, v = q[by], n[by], v[by]
    again = np.r_[False, (q[1:] == q[:-1]) & (n[1:] == n[:-1])]
    q, n, v = q[~again], n[~again], v[~again]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0))
    ok = rank < keep
    yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(n[ok]), pa.array(v[ok].astype(np.float32))], schema=_PAIR)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def directions_for(rows: int) -> int:
    """Directions of a table so that the size of a cell stays about the same."""
    return max(4, round(2.4 * math.log10(max(rows, 10)) - 2.6))


def nearest(
    df: DataFrame,
    k: int = 5,
    *,
    id_col: str = "id",
    vector_col: str = "embeddings",
    kind_col: str | None = None,
    query: Column | None = None,
    min_cosine: float | None = None,
    dim: int = 64,
    tables: int = 2,
    probes: int = 7,
    width: float = 3.0,
    m: int | None = None,
    hot: int = 20_000,
    spare: int = 5,
) -> DataFrame:
    """(kind, id, other, cosine, rank): the ``k`` most similar rows of each query row.

    ``query``: condition of the rows that ask, all by default. ``min_cosine``
    leaves out less similar neighbours and makes the search cheaper, the ranks
    stay those among all. ``kind_col``: only rows of one kind are compared.
    """
    spark = df.sparkSession
    kind = F.col(kind_col).cast("string") if kind_col else F.lit("")
    rows = df.select(
        F.when(F.col(id_col).isNotNull(), F.xxhash64(kind, F.col(id_col))).alias("h"),
        F.col(vector_col).cast("array<float>").alias("v"),
        (F.lit(True) if query is None else F.coalesce(query, F.lit(False))).alias("asks"),
        kind.alias("kind"),
        F.col(id_col).cast("string").alias("id"),
    )
    total = rows.count()
    kinds = max(1, rows.select("kind").distinct().count()) if kind_col else 1
    hashing = Hashing(dim, m or directions_for(total // kinds), width, tables, probes)
    parts = partitions(spark, total * tables * (probes + 1), 150_000)
    cells = rows.select("h", "v", F.xxhash64("kind").alias("kh")).mapInArrow(_count_cells(hashing, dim), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    hot_cells = {r["cell"]: math.ceil(r["n"] / hot) for r in cells.filter(F.col("n") > hot).collect()}  # at most tables * rows / hot cells
    scattered = rows.select("h", "v", F.xxhash64("kind").alias("kh"), "asks").mapInArrow(_scatter(hashing, dim, parts, hot_cells, query is None), blobs.SCHEMA)
    keep = k + spare
    floor = None if min_cosine is None else min_cosine - 0.01
    near = blobs.exchange(scattered, parts).mapInArrow(_search(dim, keep, floor, query is None), "q long, n long, near float")
    pairs = near.groupBy("q", "n").agg(F.max("near").alias("near"))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "n"))).filter(F.col("r") <= keep)
    stored = rows.select("h", "v", "kind", "id")
    exact = (  # both sides read the same exchange of the stored vectors
        best.select("q", "n")
        .join(stored.alias("a"), F.col("q") == F.col("a.h"))
        .join(stored.alias("b"), F.col("n") == F.col("b.h"))
        .where("concat(a.kind, chr(31), b.kind) = concat(a.kind, chr(31), a.kind) and a.id <> b.id")  # no join key, or the exchanges would differ
        .select("a.kind", "a.id", F.col("b.id").alias("other"), cosine(F.col("a.v"), F.col("b.v")).alias("cosine"))
        .groupBy("kind", "id", "other")
        .agg(F.max("cosine").alias("cosine"))
    )
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc("cosine"), "other")))
    good = F.col("rank") <= k
    return ranked.filter(good if min_cosine is None else good & (F.col("cosine") >= min_cosine))
