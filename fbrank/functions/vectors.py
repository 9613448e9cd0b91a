"""Column expressions over ARRAY<DOUBLE> vectors (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double_array(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two equal-length vectors, summed left to right."""
    prod = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    v = as_double_array(a)
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(a: Column | str) -> Column:
    """v / ||v||; the zero vector stays zero."""
    v = as_double_array(a)
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def scale(a: Column | str, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(as_double_array(a), lambda x: x * s)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x + y)


def sum_vectors(arr_of_vecs: Column, dim: Column) -> Column:
    """Element-wise sum of an array of vectors, in array order (deterministic)."""
    zero = F.array_repeat(F.lit(0.0).cast("double"), dim)
    return F.aggregate(arr_of_vecs, zero, lambda acc, v: F.zip_with(acc, v.cast("array<double>"), lambda x, y: x + y))


def round_vec(a: Column | str, digits: int = 6) -> Column:
    return F.transform(as_double_array(a), lambda x: F.round(x, digits))


def sign_vec(a: Column | str) -> Column:
    """Binary code as +-1 (positive component -> 1, else -1)."""
    return F.transform(as_double_array(a), lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
