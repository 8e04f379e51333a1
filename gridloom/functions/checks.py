"""Eager checks of an artifact: one aggregation each, before anything is written."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import InvalidArtifact, OutOfBounds, SchemaMismatch
from gridloom.functions.expressions import ID_LIMIT


@dataclasses.dataclass(frozen=True)
class Shape:
    rows: int
    cols: int


def _positions(spark, row) -> None:
    """Bounds, and all hashes together against those of 0 .. n - 1: no position has to be shuffled."""
    if row.n and (row.no_pos or row.first != 0 or row.last != row.n - 1 or row.mixed != spark.range(row.n).agg(F.bit_xor(F.xxhash64("id"))).first()[0]):
        raise InvalidArtifact("pos must hold 0 .. n - 1, each once")


def _pos_aggregates():
    return [F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos").isNull()).alias("no_pos"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.bit_xor(F.xxhash64(F.col("pos").cast("long"))).alias("mixed")]


def is_double_array(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType)


def check_dense(df: DataFrame) -> Shape:
    """``vector, pos``: at least a row and a column, equal lengths, no nulls, positions complete."""
    if not is_double_array(df.schema["vector"].dataType):
        raise SchemaMismatch(f"vector must be array<double>, not {df.schema['vector'].dataType.simpleString()}")
    row = df.agg(*_pos_aggregates(), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.count_if(F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull())).alias("nulls")).first()
    if row.nulls:
        raise InvalidArtifact(f"{row.nulls} rows are null or hold a null")
    if not row.n or not row.most:
        raise InvalidArtifact("a dense matrix needs at least one row and one column")
    if row.least != row.most:
        raise InvalidArtifact(f"rows have between {row.least} and {row.most} columns")
    _positions(df.sparkSession, row)
    return Shape(row.n, row.most)


def check_sparse(df: DataFrame, rows: int, cols: int) -> int:
    """``row, col, value``: integer coordinates inside ``rows x cols``, no nulls. The number of entries."""
    for name in ("row", "col"):
        if not isinstance(df.schema[name].dataType, T.IntegralType):
            raise SchemaMismatch(f"{name} must be an integer, not {df.schema[name].dataType.simpleString()}")
    _values_and_size(df, rows, cols)
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("row").isNull() | F.col("col").isNull() | F.col("value").isNull()).alias("nulls"), F.count_if(~inside).alias("outside")).first()
    if row.nulls:
        raise InvalidArtifact(f"{row.nulls} entries hold a null")
    if row.outside:
        raise OutOfBounds(f"{row.outside} entries lie outside {rows} x {cols}")
    return row.n


def check_sparse_blocks(df: DataFrame, rows: int, cols: int) -> int:
    """``rows, cols, value``: as for triplets. The number of entries: the blocks' sizes less what lies on the diagonal."""
    for name in ("rows", "cols"):
        kind = df.schema[name].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.IntegralType)):
            raise SchemaMismatch(f"{name} must be an array of integers, not {kind.simpleString()}")
    _values_and_size(df, rows, cols)
    null = F.col("rows").isNull() | F.col("cols").isNull() | F.col("value").isNull() | F.exists("rows", lambda x: x.isNull()) | F.exists("cols", lambda x: x.isNull())
    inside = F.forall("rows", lambda x: x.between(0, rows - 1)) & F.forall("cols", lambda x: x.between(0, cols - 1))
    row = df.agg(F.sum(F.size("rows").cast("bigint") * F.size("cols") - _on_diagonal()).alias("n"), F.count_if(null).alias("nulls"), F.count_if(~inside).alias("outside")).first()
    if row.nulls:
        raise InvalidArtifact(f"{row.nulls} blocks hold a null")
    if row.outside:
        raise OutOfBounds(f"{row.outside} blocks lie partly outside {rows} x {cols}")
    return row.n or 0


def _on_diagonal():
    """Places of a block where row and column are equal. Only lists that repeat a member are held against each other one by one."""
    sole = (F.size(F.array_distinct("rows")) == F.size("rows")) & (F.size(F.array_distinct("cols")) == F.size("cols"))
    each = F.aggregate("rows", F.lit(0).cast("bigint"), lambda n, r: n + F.size(F.filter("cols", lambda c: c == r)))
    return F.when(~F.arrays_overlap("rows", "cols"), 0).when(sole, F.size(F.array_intersect("rows", "cols"))).otherwise(each)


def _values_and_size(df: DataFrame, rows: int, cols: int) -> None:
    if not isinstance(df.schema["value"].dataType, T.DoubleType):
        raise SchemaMismatch(f"value must be double, not {df.schema['value'].dataType.simpleString()}")
    if not (0 <= rows <= ID_LIMIT and 0 <= cols <= ID_LIMIT):
        raise OutOfBounds(f"{rows} x {cols} does not fit 32-bit coordinates")


def check_vector(df: DataFrame, column: str, *, ids: bool, nullable: bool) -> int:
    """``column, pos``: the number of elements; ids inside 32 bits unsigned."""
    kind = df.schema[column].dataType
    if not (isinstance(kind, T.IntegralType) if ids else isinstance(kind, T.DoubleType)):
        raise SchemaMismatch(f"{column} must be {'an integer' if ids else 'double'}, not {kind.simpleString()}")
    outside = F.count_if(~F.col(column).between(0, ID_LIMIT - 1)) if ids and not nullable else F.lit(0)
    row = df.agg(*_pos_aggregates(), F.count_if(F.col(column).isNull()).alias("nulls"), outside.alias("outside")).first()
    if row.nulls and not nullable:
        raise InvalidArtifact(f"{row.nulls} elements of {column} are null")
    if row.outside:
        raise OutOfBounds(f"{row.outside} elements of {column} are not unsigned 32-bit integers")
    _positions(df.sparkSession, row)
    return row.n
