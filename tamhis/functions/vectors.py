"""Vector arithmetic on array columns and conversions to and from ML vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_vector(c) -> Column:
    """Array column to the vector type of Spark ML."""
    return array_to_vector((F.col(c) if isinstance(c, str) else c).cast("array<double>"))


def as_array(c) -> Column:
    """ML vector column to an array of doubles."""
    return vector_to_array(F.col(c) if isinstance(c, str) else c)


def array_of(df: DataFrame, name: str) -> Column:
    """The vector column ``name`` as an array, whether it is an array or an ML vector; floats stay floats."""
    return as_array(name) if isinstance(df.schema[name].dataType, VectorUDT) else F.col(name)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when one of them has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
