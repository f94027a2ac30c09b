"""Fusion of several vectors of one item: weighted mean, joining, attention, cross attention.

All forms are column expressions over an array of vectors of equal length;
vectors of different length raise, an empty array gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrel.operators import vectors

#: Weights of text and image.
TEXT_WEIGHT, IMAGE_WEIGHT = 0.7, 0.3
#: Confidence of what was read from a text, an image, and an image that couldn't be read.
TEXT_CONFIDENCE, IMAGE_CONFIDENCE, FALLBACK_CONFIDENCE = 0.95, 0.85, 0.3


def _sum(vs: Column, dim: int, weights: Column | None = None) -> Column:
    """Element-wise (weighted) sum."""
    zero = F.array_repeat(F.lit(0.0), F.lit(dim))
    if weights is None:
        return F.aggregate(vs, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    pairs = F.arrays_zip(vs.alias("v"), weights.alias("w"))
    return F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["v"], lambda a, b: a + b * p["w"]))


def weighted(text: Column, image: Column) -> Column:
    """Weighted mean of a text's and an image's vector, of length 1; the other one if one is null."""
    both = F.zip_with(text, image, lambda a, b: a * TEXT_WEIGHT + b * IMAGE_WEIGHT)
    return vectors.normalize(F.coalesce(both, text, image))


def joined(text: Column, image: Column) -> Column:
    return F.concat(text, image)


def attention(vs: Column, dim: int) -> Column:
    """Mean of the rows of softmax(V V' / sqrt(dim)) V."""
    scale = float(dim) ** 0.5
    rows = F.transform(vs, lambda q: _sum(vs, dim, vectors.softmax(F.transform(vs, lambda k: vectors.dot(q, k) / scale))))
    n = F.size(vs)
    return F.when(n > 0, F.transform(_sum(rows, dim), lambda x: x / n))


def crossed(text: Column, image: Column, dim: int) -> Column:
    """Texts attend to images and images to texts; the weighted sum of both means, of length 1. Null without either."""
    scale = float(dim) ** 0.5

    def attend(a: Column, b: Column) -> Column:
        rows = F.transform(a, lambda q: _sum(b, dim, vectors.softmax(F.transform(b, lambda k: vectors.dot(q, k) / scale))))
        return F.transform(_sum(rows, dim), lambda x: x / F.size(a))

    both = F.zip_with(attend(text, image), attend(image, text), lambda a, b: a * TEXT_WEIGHT + b * IMAGE_WEIGHT)
    return F.when((F.size(text) > 0) & (F.size(image) > 0), vectors.normalize(both))


def confidence(has_text: Column, has_image: Column, image_read: Column) -> Column:
    """Mean confidence of the parts that an item has."""
    image = F.when(image_read, IMAGE_CONFIDENCE).otherwise(FALLBACK_CONFIDENCE)
    return F.when(has_text & has_image, (TEXT_CONFIDENCE + image) / 2).when(has_text, TEXT_CONFIDENCE).when(has_image, image)


def content_key(*parts: Column) -> Column:
    """Digest of the content's parts, to process equal content once."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
