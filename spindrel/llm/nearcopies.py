"""Near-copies of texts: HyperMinHash registers, banded, estimated and verified.

A text is the multiset of its words (maximal runs of letters or digits of the
lower-cased text); the k-th occurrence of a word is an element of its own, so
the set Jaccard similarity of elements is the multiset similarity of words.
Reordering doesn't change it.

Each register keeps the smallest of the element hashes of its own hash
function in compressed form: the leading-zero count and the first mantissa
bits after it. (One hash function split over all registers, as for large
sets, would leave most registers of texts of some dozen words empty.) ``bands``
bands of ``rows`` 16-bit registers are the candidate keys. Candidates of a band
are compared by 32 registers of 4 bits (the leading-zero count modulo 4 and two
mantissa bits): the share of equal ones is corrected for accidental collisions,
whose probability follows from the two sizes. What remains is verified on the
whole texts, which are shuffled at every size of the collection.

Texts with the same multiset of words form a class first; one member, the
first by hash, stands for it. A band bucket with more than ``hot`` classes is cut
into blocks, and each two blocks meet in a task of their own.

Defined results: rows with a null id or null text, and texts with fewer than
``min_words`` words have no copies; an id that is stored repeatedly counts once; an
empty table gives no rows; other columns are not read, so names can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.functions.runtime import cut, partitions
from spindrel.llm import blobs
from spindrel.operators.components import connected_components

WORD = re.compile(r"[^\W_]+")
REGS = 32
BROADCAST_ROWS = 500_000
_LOW = np.uint64(0x1111111111111111)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Hashes(dict):
    """Word hashes; emptied before it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _elements(texts: list[str], known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Element hashes of all texts in a row, and the number of each text's."""
    split = [words(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    h = np.array([known[w] for ws in split for w in ws], np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        nth = np.arange(len(h)) - np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
        with np.errstate(over="ignore"):
            h = blobs.mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, counts


def compress(least: np.ndarray, mantissa: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading-zero count and the first bits after the leading one of 64-bit minima."""
    bits = least.astype(np.float64).view(np.uint64)
    exponent = (bits >> np.uint64(52)).astype(np.int64) - 1023
    tail = (bits >> np.uint64(52 - mantissa)) & np.uint64((1 << mantissa) - 1)
    return np.clip(63 - exponent, 0, 63).astype(np.uint64), tail


def collision_table(top: int = 32, kept: int = 4, mantissa: int = 2, sizes: int = 24) -> np.ndarray:
    """P(two unrelated registers are equal) for texts of 2**(i/2) and 2**(j/2) words; leading zeros count modulo ``kept``."""
    edges = [2.0 ** -(k + 1) * (1 + j / (1 << mantissa)) for k in range(top - 1, -1, -1) for j in range(1 << mantissa)]
    edges = np.array([0.0, *sorted(edges)[1:], 1.0])
    n = 2.0 ** (np.arange(sizes) / 2)
    tail = (1 - edges[None, :]) ** n[:, None]
    p = (tail[:, :-1] - tail[:, 1:]).reshape(sizes, top // kept, kept << mantissa).sum(axis=1)
    return p @ p.T


def _signatures(bands: int, rows: int, min_words: int, seed: int):
    rng = np.random.default_rng(seed)
    total = max(bands * rows, REGS)
    mult = rng.integers(1, 2**63 - 1, total, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63 - 1, total, dtype=np.int64).astype(np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            h, counts = _elements(texts, known)
            ok = counts >= max(1, min_words)
            keep = np.repeat(ok, counts)
            h, n = h[keep], counts[ok]
            if not len(n):
                continue
            starts = np.cumsum(n) - n
            with np.errstate(over="ignore"):
                own = np.array([known["\x1f" + (k or "")] for k in batch.column("kind").to_pylist()], np.uint64)[ok]
                cls = blobs.mix(np.add.reduceat(blobs.mix(h), starts) + n.astype(np.uint64) ^ own)
                key = np.zeros((len(n), bands), np.uint64)
                regs = np.zeros((len(n), REGS // 2), np.uint8)
                for r in range(total):
                    least = np.minimum.reduceat(h * mult[r] + add[r], starts)
                    lz, tail = compress(least, 10)
                    if r < REGS:
                        regs[:, r // 2] |= (((lz & np.uint64(3)) << np.uint64(2) | tail >> np.uint64(8)) << np.uint64(4 * (r % 2))).astype(np.uint8)
                    if r < bands * rows:
                        key[:, r // rows] = blobs.mix(key[:, r // rows] ^ (lz << np.uint64(10) | tail) + np.uint64(r))
            at = pa.array(np.flatnonzero(ok))
            key32 = np.ascontiguousarray((key >> np.uint64(32)).astype(np.uint32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("kind").take(at),
                    batch.column("id").take(at),
                    batch.column("h").take(at),
                    pa.array(cls.view(np.int64)),
                    pa.array(np.minimum(n, 65535).astype(np.int32)),
                    pa.array([x.tobytes() for x in key32], pa.binary()),
                    pa.array([x.tobytes() for x in regs], pa.binary()),
                ],
                names=["kind", "id", "h", "cls", "n", "keys", "regs"],
            )

    return run


def _record() -> np.dtype:
    return np.dtype([("key", "<u4"), ("h", "<i8"), ("n", "<u2"), ("regs", "<u8", (REGS // 16,))])


def _keys(batch: pa.RecordBatch, bands: int) -> np.ndarray:
    """Bucket of each row in each band."""
    key = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint32).reshape(-1, bands)
    kind = np.array(batch.column("kh").to_numpy(), np.int64).view(np.uint64)
    return blobs.mix((key.astype(np.uint64) | np.arange(bands, dtype=np.uint64)[None, :] << np.uint64(32)) ^ kind[:, None])


def _heavy(bands: int, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_keys(b, bands).ravel() for b in batches if b.num_rows]
        if got:
            key, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[n >= least].view(np.int64)), pa.array(n[n >= least].astype(np.int64))], names=["key", "n"])

    return run


def _scatter(bands: int, parts: int, hot: dict[int, int]):
    hot_keys = np.sort(np.array(list(hot), np.int64).view(np.uint64))
    hot_blocks = np.array([hot[int(k)] for k in hot_keys.view(np.int64)], np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _keys(batch, bands)
            row = np.repeat(np.arange(len(key)), bands)
            key = key.ravel()
            h = batch.column("h").to_numpy()
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                wide = np.flatnonzero(hot_keys[at] == key)
                blocks = hot_blocks[at[wide]]
                mine = (blobs.mix(h[row[wide]].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(wide)), blocks)
                other = np.concatenate([np.arange(k) for k in blocks]) if len(wide) else np.zeros(0, np.int64)
                ok = other != mine[again]  # a block meets every other; its own pairs come along
                again, other = again[ok], other[ok]
                low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
                with np.errstate(over="ignore"):
                    split = blobs.mix(key[wide][again] + (low * 1_000_003 + high + 1).astype(np.uint64))
                rest = np.ones(len(key), bool)
                rest[wide] = False
                row = np.concatenate([row[rest], row[wide][again]])
                key = np.concatenate([key[rest], split])
            out = np.empty(len(row), _record())
            out["key"] = (key >> np.uint64(32)).astype(np.uint32)
            out["h"] = h[row]
            out["n"] = batch.column("n").to_numpy()[row]
            out["regs"] = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint64).reshape(-1, REGS // 16)[row]
            got = blobs.pack((key % np.uint64(parts)).astype(np.int32), out)
            if got is not None:
                yield got

    return run


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Jaccard similarity by the equal registers, corrected for collisions."""
    x = ra ^ rb
    x |= x >> np.uint64(2)
    total = 16 * x.shape[1]
    same = total - np.bitwise_count((x | x >> np.uint64(1)) & _LOW).sum(axis=1, dtype=np.int64)
    i, j = (np.minimum(np.rint(2 * np.log2(np.maximum(n, 1))).astype(np.int64), len(table) - 1) for n in (na, nb))
    c = table[i, j]
    return (same / total - c) / (1 - c)


def _compare(least: float, size_ratio: float):
    table = collision_table()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = blobs.unpack(batches, _record())
        rows = rows[np.lexsort((rows["h"], rows["key"]))]
        key, h, n, regs = rows["key"], rows["h"], rows["n"].astype(np.float32), np.ascontiguousarray(rows["regs"])
        found: list[np.ndarray] = []
        held = 0
        i = np.arange(len(rows))
        d = 0
        while len(i):
            d += 1
            i = i[i + d < len(rows)]
            i = i[key[i] == key[i + d]]
            for s in range(0, len(i), 500_000):
                a = i[s : s + 500_000]
                b = a + d
                ok = (np.minimum(n[a], n[b]) >= size_ratio * np.maximum(n[a], n[b])) & (h[a] != h[b])
                a, b = a[ok], b[ok]
                ok = estimate(regs[a], regs[b], n[a], n[b], table) >= least
                pair = np.stack([np.minimum(h[a[ok]], h[b[ok]]), np.maximum(h[a[ok]], h[b[ok]])], axis=1)
                if len(pair):
                    found.append(pair)
                    held += len(pair)
            if held > 500_000:
                yield _pairs(found)
                found, held = [], 0
        if found:
            yield _pairs(found)

    return run


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["a", "b"])


def overlap(x: str, y: str) -> float:
    """Words in common, counted with repetition, over the words in either."""
    p, q = Counter(words(x)), Counter(words(y))
    both = sum((p & q).values())
    either = p.total() + q.total() - both
    return both / either if either else 0.0


def _verify(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([overlap(x, y) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)])
            ok = pa.array(s >= least) if len(s) else pa.array([], pa.bool_())
            kept = batch.filter(ok)
            cols = [kept.column(c) for c in ("kind", "id_a", "id_b", "a", "b")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s[s >= least].astype(np.float64))], names=["kind", "id_a", "id_b", "a", "b", "similarity"])

    return run


def _small(df: DataFrame, name: str) -> DataFrame:
    """Written; to be broadcast if it has few rows (of some dozen bytes), beyond that both sides of a join are shuffled."""
    df = cut(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def class_links(
    df: DataFrame,
    *,
    id_col: str = "id",
    text_col: str = "text",
    kind_col: str | None = None,
    threshold: float = 0.75,
    min_words: int = 8,
    bands: int = 16,
    rows: int = 5,
    hot: int = 20_000,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links between class representatives, the class of every row, and classes of several rows.

    (kind, id_a, id_b, a, b, similarity), rows may repeat, a and b are the hashes of the representatives;
    (kind, id, cls, h), likewise; (cls, first h), whose row represents the class.
    """
    spark = df.sparkSession
    kind = F.col(kind_col).cast("string") if kind_col else F.lit("")
    base = df.select(kind.alias("kind"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    base = base.select("kind", "id", F.xxhash64("kind", "id").alias("h"), "text")
    schema = "kind string, id string, h long, cls long, n int, keys binary, regs binary"
    sig = cut(base.mapInArrow(_signatures(bands, rows, min_words, seed), schema), "signatures")
    copies = sig.groupBy("cls").agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first <> last").select("cls", "first")
    copies = _small(copies, "copies")
    later = cut(sig.select("cls", "h").join(copies, "cls").where("h <> first").select("h"), "later")
    few = later.count() <= BROADCAST_ROWS
    reps = sig.join(F.broadcast(later) if few else later, "h", "left_anti").select(F.xxhash64("kind").alias("kh"), "cls", "h", "n", "keys", "regs")
    reps = reps if few else cut(reps, "classes")
    tasks = max(1, sig.rdd.getNumPartitions())
    hot = max(hot, 8 * tasks)
    heavy = reps.select("kh", "keys").mapInArrow(_heavy(bands, max(2, hot // tasks)), "key long, n long")
    blocks = {r["key"]: max(2, math.ceil((r["n"] + hot) / hot)) for r in heavy.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot // 2).collect()}
    blocks = {k: max(3, n) for k, n in blocks.items()}  # at most 2 * bands * classes / hot keys
    count = reps.count()
    parts = partitions(spark, count * bands, 150_000)
    scattered = reps.select("kh", "h", "n", "keys", "regs").mapInArrow(_scatter(bands, parts, blocks), blobs.SCHEMA)
    near = blobs.exchange(scattered, parts).mapInArrow(_compare(threshold - 0.25, threshold * 0.98), "a long, b long").distinct()
    pairs = cut(near, "candidates")
    asked = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    texts = base.join(asked.hint("merge"), "h")  # no side is small when the collection is not
    a = texts.select(F.col("h").alias("a"), "kind", F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("h").alias("b"), F.col("kind").alias("kind_b"), F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    both = a.join(pairs.hint("merge"), "a").join(b.hint("merge"), "b").where("kind = kind_b")
    links = both.select("kind", "id_a", "id_b", "a", "b", "text_a", "text_b").mapInArrow(
        _verify(threshold), "kind string, id_a string, id_b string, a long, b long, similarity double"
    )
    return links, sig.select("kind", "id", "cls", "h"), copies


def near_copy_pairs(df: DataFrame, *, expand: int = 50, **how) -> DataFrame:
    """(kind, id_a, id_b): near-copies, ``id_a`` before ``id_b``.

    Copies with the same words are expanded into all pairs up to ``expand``
    members; a larger class is given by pairs of its first member with each
    other one, and links between classes by their first members.
    """
    links, members, copies = class_links(df, **how)
    many = cut(members.join(copies, "cls").distinct(), "members")
    sizes = many.groupBy("cls").agg(F.count("*").alias("n"), F.min(F.when(F.col("h") == F.col("first"), F.col("id"))).alias("lead"))
    many = many.join(sizes, "cls").select("kind", F.col("first").alias("head"), "id", "n", F.col("lead").alias("first"))
    few = many.where(F.col("n") <= expand).select("kind", "head", "id")
    order = lambda p: p.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b")
    inside = order(few.select("kind", "head", F.col("id").alias("x")).join(few.select("kind", "head", F.col("id").alias("y")), ["kind", "head"]))
    star = order(many.where(F.col("n") > expand).select("kind", F.col("first").alias("x"), F.col("id").alias("y")))
    left = few.select("kind", F.col("head").alias("a"), F.col("id").alias("xa"))
    right = few.select("kind", F.col("head").alias("b"), F.col("id").alias("xb"))
    across = links.join(left, ["kind", "a"], "left").join(right, ["kind", "b"], "left")
    across = order(across.select("kind", F.coalesce("xa", "id_a").alias("x"), F.coalesce("xb", "id_b").alias("y")))
    return inside.union(star).union(across).distinct()


def near_copy_groups(df: DataFrame, **how) -> DataFrame:
    """(kind, id, group_id, group_size, links): one row per text that has a near-copy.

    ``group_id`` is the first id of the connected near-copies, ``links`` the
    number of other word multisets that the row's own is linked to.
    """
    links, members, copies = class_links(df, **how)
    links = cut(links.distinct(), "links")
    members = members.join(copies, "cls", "left").select("kind", "id", F.coalesce("first", "h").alias("head")).distinct()
    name = lambda c: F.concat_ws("\x1f", F.col("kind"), F.col(c).cast("string"))
    comp = connected_components(links.select(name("a").alias("a"), name("b").alias("b")))
    ends = links.select("kind", F.col("a").alias("head")).union(links.select("kind", F.col("b").alias("head")))
    degree = ends.groupBy("kind", "head").agg(F.count("*").alias("links"))
    rows = members.withColumn("node", name("head")).join(comp, "node", "left").join(degree, ["kind", "head"], "left")
    rows = rows.select("kind", "id", F.coalesce("component", "node").alias("c"), F.coalesce("links", F.lit(0)).alias("links"))
    groups = rows.groupBy("kind", "c").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return rows.join(groups, ["kind", "c"]).select("kind", "id", "group_id", "group_size", "links")
