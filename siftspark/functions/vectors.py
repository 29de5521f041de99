"""Vector and bit functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalized(a: Column) -> Column:
    """The vector over its length (plus 1e-12, so a zero vector stays zero)."""
    length = norm(a) + 1e-12
    return F.transform(a.cast("array<double>"), lambda x: x / length)


def set_bits(a: Column) -> Column:
    """Places (from 0) of positive components."""
    return F.filter(F.transform(a, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def packed_bits(a: Column, words: int) -> list[Column]:
    """The positive components as `words` longs of 32 bits each."""
    return [F.aggregate(F.transform(F.slice(a, 32 * w + 1, 32), lambda x, i: F.when(x > 0, F.expr("1L").cast("long") * F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x) for w in range(words)]


def bits_jaccard(a: Column, b: Column) -> Column:
    """Of arrays of set places; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def min_max(value: Column, group: Column) -> Column:
    """value scaled to 0..1 within its group; 0 if all are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def centroid_distance(similarity: Column, distance: Column, metric: str = "cosine", spherical: bool = True) -> Column:
    """What clusters are ranked by."""
    return distance if metric == "l2" else F.lit(1.0) - (distance if spherical else similarity)
