"""Standalone dense files: their layout is found from the schema."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import AlreadyExists, InvalidArtifact, NotFound, SchemaMismatch, UnsupportedFormat
from gridloom.functions.checks import check_dense, is_double_array
from gridloom.functions.ordinals import file_positions
from gridloom.operators import dense
from gridloom.sources.files import Files

#: Extension: whether writing replaces what is there.
EXTENSIONS = {".parquet": True, ".lance": False}


def _extension(path: str) -> str:
    found = posixpath.splitext(path.rstrip("/"))[1]
    if found not in EXTENSIONS:
        raise UnsupportedFormat(f"{path}: {found or 'no extension'}; there are {', '.join(EXTENSIONS)}")
    return found


def layout_of(schema: T.StructType) -> str:
    """``vector``: one array<double>. ``wide``: doubles only, at least one named ``col_*``. Else an error. ``pos`` does not count."""
    fields = [f for f in schema if f.name != "pos" or not isinstance(f.dataType, T.LongType)]
    if len(fields) == 1 and is_double_array(fields[0].dataType):
        return "vector"
    if fields and all(isinstance(f.dataType, T.DoubleType) for f in fields) and any(f.name.startswith("col_") for f in fields):
        return "wide"
    raise SchemaMismatch(f"neither vectors nor col_* columns: {schema.simpleString()}")


def read_dense_file(spark: SparkSession, path: str) -> DataFrame:
    """``vector, pos`` of a Parquet file or folder; rows in their order, wide columns in schema order."""
    if not Files(spark, path).exists(path):
        raise NotFound(path)
    _extension(path)
    df = spark.read.parquet(path)
    layout = layout_of(df.schema)
    columns = [c for c in df.columns if c != "pos" or df.schema[c].dataType != T.LongType()]
    placed = df if "pos" in df.columns and "pos" not in columns else file_positions(df)
    found = dense.from_wide(placed, columns) if layout == "wide" else placed.select(F.col(f"`{columns[0]}`").alias("vector"), "pos")
    if found.isEmpty():
        raise InvalidArtifact(f"{path} has no rows")
    check_dense(found)
    return found


def write_dense_file(df: DataFrame, path: str) -> None:
    """Write ``vector, pos`` as Snappy Parquet; ``.parquet`` replaces, ``.lance`` must be new."""
    replaces = EXTENSIONS[_extension(path)]
    files = Files(df.sparkSession, path)
    if not replaces and files.exists(path):
        raise AlreadyExists(path)
    check_dense(df)
    df.select("vector", "pos").write.mode("overwrite" if replaces else "errorifexists").option("compression", "snappy").parquet(path)
