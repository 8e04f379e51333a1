"""Column expressions for vectors and matrices. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unsigned 32-bit range of coordinates and ids.
ID_LIMIT = 1 << 32
#: Most bytes of float64 cells that one process takes; exactly so many are allowed.
LOCAL_BYTES = 4 * 1024**3


def as_doubles(c: Column) -> Column:
    return c.cast("array<double>")


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_distance(a: Column, b: Column) -> Column:
    return l2_norm(F.zip_with(a, b, lambda x, y: x - y))


def none_as_negative(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(-1))


def negative_as_none(c: Column) -> Column:
    return F.when(c >= 0, c)


def wrap_id(c: Column) -> Column:
    """Modulo 2**32."""
    return c.cast("bigint").bitwiseAND(ID_LIMIT - 1)


def must(condition: Column, message: str) -> Column:
    """A filter that raises where ``condition`` is not true; unlike a projected check it cannot be pruned."""
    return F.assert_true(condition, F.lit(message)).isNull()
