"""Text operators: tokens, term queries, keywords, chunks and their relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "shall"]


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of 2 to 50 ASCII word characters."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-zA-Z0-9_\s]", " "), r"\s+", " "))
    return F.array_distinct(F.filter(F.split(plain, " "), lambda t: F.length(t).between(2, 50)))


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token"))


def any_term(posts: DataFrame, terms: list[str]) -> DataFrame:
    """Ids with a token of any term."""
    words = sorted({w for t in terms for w in _words(t)})
    return posts.where(F.col("token").isin(words)).select("id").distinct()


def all_terms(posts: DataFrame, terms: list[str]) -> DataFrame:
    """Ids that have, for every term, one of its tokens."""
    which = F.array(*[F.when(F.col("token").isin(_words(t)), F.lit(i)) for i, t in enumerate(terms)])
    hits = posts.where(F.col("token").isin(sorted({w for t in terms for w in _words(t)}))).select("id", F.explode(F.array_compact(which)).alias("term"))
    return hits.groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select("id")


def phrase(df: DataFrame, id_col: str, text_col: str, wanted: str) -> DataFrame:
    """Ids whose text holds the words of the phrase in a row."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text_col), r"[^a-zA-Z0-9_]+", " ")), F.lit(" "))
    return df.where(F.contains(plain, F.lit(" " + " ".join(_words(wanted)) + " "))).select(F.col(id_col).alias("id"))


def _words(term: str) -> list[str]:
    import re

    return [w for w in re.sub(r"[^a-z0-9_\s]", " ", term.lower()).split() if 2 <= len(w) <= 50]


def token_frequency(posts: DataFrame, top: int) -> DataFrame:
    """The most frequent tokens: number of rows, ties by token."""
    return posts.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top)


def keywords(text: Column, most: int = 10) -> Column:
    """First distinct lower-case words between white space, of more than two characters, that are no stop words."""
    words = F.split(F.lower(text), r"\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP))), 1, most)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) > 0)


def chunk_confidence(text: Column, least: int = 50, most: int = 1000) -> Column:
    """1, halved if short, 0.7 of it if long, 1.1 times if it ends a sentence, 0.8 times if over 30 % is space; 0 to 1."""
    n = F.length(text)
    space = n - F.length(F.regexp_replace(text, r"\s", ""))
    c = F.when(n < least, 0.5).otherwise(1.0) * F.when(n > most, 0.7).otherwise(1.0) * F.when(text.rlike(r"[.!?]$"), 1.1).otherwise(1.0) * F.when(space > 0.3 * n, 0.8).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def chunks(df: DataFrame, id_col: str, text_col: str, least: int = 50, most: int = 1000, confidence: float = 0.7) -> DataFrame:
    """(doc, pos, kind, text, confidence): sentences of a fitting size; else paragraphs; else the whole text."""
    doc = df.where(F.length(F.trim(text_col)) > 0).select(F.col(id_col).alias("doc"), F.col(text_col).alias("whole"))
    fits = lambda a: F.filter(F.transform(a, lambda t: F.struct(t.alias("text"), chunk_confidence(t, least, most).alias("confidence"))), lambda s: F.length(s["text"]).between(least, most) & (s["confidence"] >= confidence))
    one = fits(sentences(F.col("whole")))
    two = fits(F.filter(F.transform(F.split("whole", r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) > 0))
    last = F.array(F.struct(F.col("whole").alias("text"), F.lit(1.0).alias("confidence")))
    rows = doc.select("doc", "whole", one.alias("one")).select("doc", "whole", "one", F.when(F.size("one") == 0, two).alias("two"))
    pick = F.when(F.size("one") > 0, F.col("one")).when(F.size("two") > 0, F.col("two")).otherwise(last)
    kind = F.when(F.size("one") > 0, "sentence").when(F.size("two") > 0, "paragraph").otherwise("document")
    return rows.select("doc", kind.alias("kind"), F.posexplode(pick).alias("pos", "c")).select("doc", "pos", "kind", "c.text", "c.confidence")


def sequential(chunk_rows: DataFrame) -> DataFrame:
    """(doc, a, b): neighbouring chunks."""
    nxt = F.lead("pos").over(Window.partitionBy("doc").orderBy("pos"))
    return chunk_rows.select("doc", F.col("pos").alias("a"), nxt.alias("b")).where("b is not null")


def cooccurrence(chunk_rows: DataFrame, window: int = 5) -> DataFrame:
    """(doc, a, b, weight): ordered pairs of chunks at most ``window`` apart, max(0.1, 1 - distance / window)."""
    near = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - window), F.least(F.col("last"), F.col("pos") + window)))
    rows = chunk_rows.select("doc", "pos", F.max("pos").over(Window.partitionBy("doc")).alias("last")).select("doc", F.col("pos").alias("a"), near.alias("b"))
    return rows.where("a <> b").select("doc", "a", "b", F.greatest(F.lit(0.1), 1 - F.abs(F.col("a") - F.col("b")) / F.lit(float(window))).alias("weight"))
