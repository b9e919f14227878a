"""Vector expressions: int8 quantisation and cosine, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale_of(vector: Column) -> Column:
    """The quantisation step: largest magnitude / 127, and 1 for a zero vector."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.when(top == 0, F.lit(1.0)).otherwise(top / 127)


def quantise(vector: Column, scale: Column) -> Column:
    """Components in steps of ``scale``, rounded half to even and held within int8."""
    return F.transform(vector, lambda x: F.least(F.lit(127), F.greatest(F.lit(-127), F.rint(x.cast("double") / scale).cast("int"))).cast("tinyint"))


def dequantise(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x * scale)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
