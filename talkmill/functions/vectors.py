"""Similarities of sets, bags and vectors."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-block matching ratio; a check of few candidate pairs, not a way to find them."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def set_cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.sqrt(F.size(a) * F.size(b))), F.lit(0.0))


def containment(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has; 0 without tokens."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, text)), F.size(query)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))).otherwise(0.0)


def unit_cosine(a: Column, b: Column) -> Column:
    """cosine() of vectors that are l2_normalize()d."""
    return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def recency(created: Column, now: Column) -> Column:
    """1 / (1 + log1p(age in days)); both as epoch seconds, so that results repeat."""
    return 1 / (1 + F.log1p(F.greatest(now - created, F.lit(0.0)) / 86400))


def softmax(logits: Column, temperature: float | Column) -> Column:
    powers = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def hashed_embeddings(rows: DataFrame, key: str, size: int = 384) -> DataFrame:
    """(key, embedding): signed hashing of each row's distinct tokens to a unit vector; md5 gives bucket and sign. rows:
    key (unique), tokens. Rows without tokens have a vector of zeros. Sums are grouped by (key, bucket)."""
    digest = F.col("digest")
    long = rows.select(key, F.explode(F.array_distinct("tokens")).alias("t")).select(key, F.md5("t").alias("digest"))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = long.select(key, bucket.alias("b"), sign.alias("s")).groupBy(key, "b").agg(F.sum("s").alias("s"))
    found = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    value = lambda i: F.coalesce(F.try_divide(F.element_at("m", i), F.col("norm")), F.lit(0.0))
    return rows.select(key).join(found, key, "left").select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), value).alias("embedding"))
