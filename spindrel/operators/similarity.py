"""Similarities of short strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from spindrel.functions.runtime import partitions


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Of lower-case tokens between white space."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")) for c in (a, b))
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / either)


def normal_name(a: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(a), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def jaro(a: str, b: str) -> float:
    """Matches within half the longer string; transpositions keep their half."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), None)
        if j is not None:
            taken[j] = True
            mine.append(c)
    if not mine:
        return 0.0
    t = sum(x != b[j] for x, j in zip(mine, [j for j, u in enumerate(taken) if u], strict=True)) / 2
    return (len(mine) / len(a) + len(mine) / len(b) + (len(mine) - t) / len(mine)) / 3


def winkler(a: str, b: str) -> float:
    """Jaro similarity with the bonus of 0.1 for each of up to four common first letters, which always counts."""
    s = jaro(a, b)
    p = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return s + 0.1 * p * (1 - s)


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each name, filled up with 0, and lengths."""
    size = np.fromiter(map(len, names), "int64", len(names))
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "uint32")
    out = np.zeros((len(names), max(1, int(size.max(initial=0)))), "uint32")
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def winklers(a: list[str], b: list[str]) -> np.ndarray:
    """``winkler`` of many pairs at once."""
    (x, n), (y, m) = _letters(a), _letters(b)
    at, rows = np.arange(y.shape[1]), np.arange(len(a))
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)[:, None]
    mine, free = np.zeros(x.shape, bool), at < m[:, None]
    for i in range(x.shape[1]):
        hit = (y == x[:, i : i + 1]) & free & (at >= i - reach) & (at <= i + reach) & (i < n)[:, None]
        j = hit.argmax(1)
        mine[:, i] = hit[rows, j]
        free[rows[mine[:, i]], j[mine[:, i]]] = False
    taken = ~free & (at < m[:, None])
    both = mine.sum(1)
    p, q = x[mine], y[taken]  # matched letters in order, row by row, as many of either
    t = np.bincount(np.repeat(rows, both), p != q, len(a)) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(both == 0, 0.0, (both / n + both / m + (both - t) / both) / 3)
    w = min(4, x.shape[1], y.shape[1])
    same = (x[:, :w] == y[:, :w]) & (np.arange(w) < np.minimum(n, m)[:, None])
    s[(n == 0) & (m == 0)] = 1.0
    return s + 0.1 * np.cumprod(same, 1).sum(1) * (1 - s)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null for nulls. Runs in Python: call it on distinct pairs that a block and their lengths have left."""
    out, known = np.full(len(a), np.nan), (a.notna() & b.notna()).to_numpy()
    for k in np.array_split(np.flatnonzero(known), len(a) // 4096 + 1):
        if len(k):
            out[k] = winklers(a.iloc[k].tolist(), b.iloc[k].tolist())
    return pd.Series(out)


#: Letters of n as bits, those that it has and those that it has twice: an edit changes at most two of the bits.
_BITS = "aggregate(transform(split(n, ''), c -> shiftleft(1L, ascii(c) % 64)), named_struct('one', 0L, 'two', 0L), (s, x) -> named_struct('one', s.one | x, 'two', s.two | (s.one & x)))"


def with_bits(names: DataFrame) -> DataFrame:
    """Adds ``one`` and ``two`` for column n. The repartition keeps Spark from computing them again for each pair."""
    return names.withColumn("bits", F.expr(_BITS)).select(*names.columns, "bits.one", "bits.two").repartition(partitions(names.sparkSession), "n")


def bits_apart(a: str, b: str) -> Column:
    """At most the sum of the differences of the two counts of each letter."""
    return F.expr(f"bit_count({a}1 ^ {b}1) + bit_count({a}2 ^ {b}2)")


def close_by_edits(names: DataFrame, least: float) -> DataFrame:
    """(a, b, score): all pairs of the distinct names in column n with an edit similarity of at least ``least`` > 0, a < b.

    Names of length L may differ from a shorter one by d = (1 - least) L edits;
    of the d + 1 parts of the longer name one stands unchanged in the shorter
    one, moved no further than the edits allow. So no pair is lost.
    """
    rows = with_bits(names.where("length(n) > 0").select("n").distinct()).withColumn("size", F.length("n"))
    d = lambda size: f"cast(floor({size} * {1 - least!r} + 1e-9) as int)"
    part = lambda size, i: f"(({i}) * {size} div ({d(size)} + 1))"
    key = lambda size, i, text: f"xxhash64({size}, {i}, {text})"
    cut = lambda start: f"substring(n, {start} + 1, int({part('l', 'i + 1')} - {part('l', 'i')}))"
    x = rows.where(f"{d('size')} > 0").withColumn("l", F.col("size"))
    x = x.select(F.col("n").alias("x"), F.col("one").alias("x1"), F.col("two").alias("x2"), "size", F.expr(f"explode(sequence(0, {d('size')}))").alias("i"), "n", "l")
    x = x.select("x", "x1", "x2", F.col("size").alias("xl"), F.expr(key("l", "i", cut(f"int({part('l', 'i')})"))).alias("key"))
    sizes = rows.agg(F.max("size").alias("most"))
    y = rows.crossJoin(F.broadcast(sizes)).select("n", "one", "two", "size", F.expr(f"explode(sequence(size, least(most, cast(floor(size / {least!r} + 1e-9) as int))))").alias("l"))
    y = y.where(f"{d('l')} > 0 and l - size <= {d('l')}").select("n", "one", "two", "size", "l", F.expr(f"explode(sequence(0, {d('l')}))").alias("i"))
    y = y.select("*", F.expr(f"explode(sequence(int({part('l', 'i')} - (({d('l')} + l - size) div 2)), int({part('l', 'i')} + (({d('l')} - l + size) div 2))))").alias("p"))
    y = y.where(f"p >= 0 and p + {part('l', 'i + 1')} - {part('l', 'i')} <= size")
    y = y.select(F.col("n").alias("y"), F.col("one").alias("y1"), F.col("two").alias("y2"), F.col("size").alias("yl"), F.expr(key("l", "i", cut("p"))).alias("key"))
    x, y = in_blocks(x, y, "key", "x", "y")
    pairs = x.join(y, ["key", "i", "j"]).where("xl > yl or (xl = yl and x < y)")
    near = pairs.where(bits_apart("x", "y") <= 2 * F.expr(d("xl"))).where(F.expr(f"levenshtein(x, y, {d('xl')})") >= 0)
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return near.withColumn("score", levenshtein_similarity(F.col("a"), F.col("b"))).where(F.col("score") >= least)


def in_blocks(x: DataFrame, y: DataFrame, key: str, a: str, b: str, rows: int = 500) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by ``key`` with columns i, j added to it: blocks of about ``rows`` x ``rows``, so that no task holds a frequent key alone."""
    count = lambda df, c: df.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias(c))
    size = count(x, "p").join(count(y, "q"), key)  # keys of one side only meet nothing
    parts = partitions(x.sparkSession)
    i, j = F.pmod(F.xxhash64(a), F.col("p")).cast("int"), F.pmod(F.xxhash64(b), F.col("q")).cast("int")
    x = x.join(size, key).withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).drop("p", "q")
    y = y.join(size, key).withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).drop("p", "q")
    return x.repartition(parts, key, "i", "j"), y.repartition(parts, key, "i", "j")


def close_by_words(names: DataFrame, more: float) -> DataFrame:
    """(a, b, score): all pairs of the distinct names in column n with a token overlap above ``more`` >= 0, a < b; found by a word in common."""
    ws = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("n"), r"\s+"), lambda t: t != "")))
    rows = names.where("n is not null").select("n").distinct().select("n", ws.alias("ws"))
    side = lambda n, w, k: rows.select(F.col("n").alias(n), F.col("ws").alias(w), F.size("ws").alias(k), F.explode("ws").alias("w"))
    x, y = in_blocks(side("a", "x", "k"), side("b", "y", "l"), "w", "a", "b")
    common = F.size(F.array_intersect("x", "y"))
    # with one word in common it is the joined one; else only the first of them gives the pair
    pairs = x.join(y, ["w", "i", "j"]).where("a < b").where(F.least("k", "l") / F.greatest("k", "l") > more)
    pairs = pairs.where((F.array_intersect("x", "y")[0] == F.col("w")) & (common / (F.col("k") + F.col("l") - common) > more))
    return pairs.select("a", "b", (common / (F.col("k") + F.col("l") - common)).alias("score"))


def sound_code(a: Column) -> Column:
    """First letter and three digits; digits repeat only after another digit, vowels don't part them."""
    letters = F.regexp_replace(F.upper(a), "[^A-Z]", "")
    digits = F.translate(F.substring(letters, 2, 100), "BFPVCGJKQSXZDTLMNRAEIOUHWY", "11112222222233455600000000")
    once = F.regexp_replace(F.regexp_replace(digits, "0", ""), r"(.)\1+", "$1")
    return F.when(letters == "", "0000").otherwise(F.substring(F.concat(F.substring(letters, 1, 1), once, F.lit("000")), 1, 4))


def composite(fuzzy: Column, words: Column, sound: Column, vector: Column) -> Column:
    return (0.3 * fuzzy + 0.15 * words + 0.09 * sound + 0.3 * vector) / 0.6
