"""Vector and set similarity as columns over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0, null where a vector is null."""
    product = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(F.try_divide(dot(a, b), product), F.lit(0.0)))


def jaccard_words(a: Column, b: Column) -> Column:
    """Overlap of the lower-cased word sets; 0 if one has no words."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")) for t in (a, b))
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / F.size(F.array_union(x, y)))
