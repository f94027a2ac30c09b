"""Models from outside: vectors of texts and answers about images, by a function that takes a batch.

A provider is called once for each distinct content, in Arrow batches on the
executors. What fails gives a zero vector or no answer, marked as such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.functions.runtime import cut

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed(df: DataFrame, text_col: str, provider: Embed, dim: int, *, out: str = "embedding", batch: int = 32) -> DataFrame:
    """``df`` with the vector of each text, and ``<out>_ok``; null and blank texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                try:
                    got = [[float(x) for x in v] for v in provider(part["_text"].tolist())]
                    if len(got) != len(part) or any(len(v) != dim for v in got):
                        raise ValueError("wrong number or length of vectors")
                    ok = True
                except Exception:  # the provider is foreign code
                    got, ok = [[0.0] * dim] * len(part), False
                yield pd.DataFrame({"_text": part["_text"], "_v": got, "_ok": ok})

    texts = df.where(F.length(F.trim(text_col)) > 0).select(F.col(text_col).alias("_text")).distinct()
    known = cut(texts.mapInPandas(run, "_text string, _v array<double>, _ok boolean"), "vectors")
    return df.join(known, F.col(text_col) == F.col("_text"), "left").select(*[F.col(c) for c in df.columns], F.col("_v").alias(out), F.col("_ok").alias(f"{out}_ok"))


def describe(df: DataFrame, id_col: str, data_col: str, provider: Callable[[Sequence[bytes]], Sequence[str]]) -> DataFrame:
    """(id, digest, description, ok): what a provider says of images, once for equal data."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                got, ok = list(provider(frame["data"].tolist())), True
            except Exception:  # the provider is foreign code
                got, ok = [None] * len(frame), False
            yield pd.DataFrame({"digest": frame["digest"], "description": got, "ok": ok})

    rows = df.where(F.col(data_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(F.col(data_col), 256).alias("digest"), F.col(data_col).alias("data"))
    said = rows.groupBy("digest").agg(F.first("data").alias("data")).select("digest", "data").mapInPandas(run, "digest string, description string, ok boolean")
    return rows.select("id", "digest").distinct().join(cut(said, "said"), "digest").select("id", "digest", "description", "ok")
