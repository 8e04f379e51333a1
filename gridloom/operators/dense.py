"""Dense matrices: a row a vector, ``vector array<double>, pos bigint``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import InvalidArtifact, SchemaMismatch, TooLarge
from gridloom.functions.checks import is_double_array
from gridloom.functions.expressions import LOCAL_BYTES, as_doubles
from gridloom.functions.ordinals import with_positions


def encode(df: DataFrame, vector: str = "vector", *order: str) -> DataFrame:
    """``vector, pos`` of a frame that has a vector column and ``pos``, or columns to order by."""
    if vector not in df.columns:
        raise SchemaMismatch(f"no column {vector!r}")
    placed = df if "pos" in df.columns and not order else with_positions(df.drop("pos"), *order)
    return placed.select(as_doubles(F.col(vector)).alias("vector"), F.col("pos").cast("bigint").alias("pos"))


def decode(df: DataFrame) -> DataFrame:
    """Check the layout of a stored matrix: one vector column beside ``pos``."""
    payload = [f for f in df.schema if f.name != "pos"]
    if len(payload) != 1 or not is_double_array(payload[0].dataType):
        raise SchemaMismatch(f"a dense matrix has one array<double> column, not {df.schema.simpleString()}")
    return df.select(F.col(payload[0].name).alias("vector"), "pos")


def long_form(df: DataFrame) -> DataFrame:
    """``row, col, value`` of every cell."""
    return df.select(F.col("pos").alias("row"), F.posexplode("vector").alias("col", "value"))


def column_major(df: DataFrame, rows: int) -> DataFrame:
    """``idx, value``: cells as they lie in column-major order."""
    return long_form(df).select((F.col("col") * F.lit(rows) + F.col("row")).cast("bigint").alias("idx"), "value")


def from_long(df: DataFrame) -> DataFrame:
    """``row, col, value`` back to ``vector, pos``; a row's cells in order of ``col``."""
    cells = F.array_sort(F.collect_list(F.struct("col", "value")))
    return df.groupBy("row").agg(F.transform(cells, lambda c: c.value).alias("vector")).select("vector", F.col("row").cast("bigint").alias("pos"))


def from_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """A column a feature, to ``vector, pos``."""
    return df.select(F.array(*[F.col(f"`{c}`") for c in columns]).alias("vector"), "pos")


def transpose(df: DataFrame) -> DataFrame:
    return from_long(long_form(df).select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))


def shape(df: DataFrame) -> DataFrame:
    """``n_rows, n_cols, n_bytes``, one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vector")).cast("bigint").alias("n_cols")).withColumn("n_bytes", F.col("n_rows") * F.col("n_cols") * 8)


def check_local(rows: int, cols: int) -> None:
    if rows * cols * 8 > LOCAL_BYTES:
        raise TooLarge(f"{rows} x {cols} doubles are more than {LOCAL_BYTES} bytes")


def to_numpy(df: DataFrame) -> np.ndarray:
    """The matrix in this process, column-major; refused over 4 GiB."""
    size = shape(df).first()
    check_local(size.n_rows, size.n_cols or 0)
    rows = df.orderBy("pos").select("vector").toPandas()["vector"]
    return np.asfortranarray(np.stack([np.asarray(r, np.float64) for r in rows])) if len(rows) else np.zeros((0, 0))


def to_rows(df: DataFrame) -> list[list[float]]:
    """The rows in this process, as lists."""
    return [list(map(float, r)) for r in to_numpy(df)]


def from_numpy(spark: SparkSession, m: np.ndarray) -> DataFrame:
    if m.ndim != 2 or not m.size:
        raise InvalidArtifact("a dense matrix needs at least one row and one column")
    return spark.createDataFrame([(row.tolist(), k) for k, row in enumerate(np.asarray(m, np.float64))], "vector array<double>, pos bigint")
