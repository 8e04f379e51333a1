"""Vectors: a column and ``pos``, after one table of kinds."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import SchemaMismatch, UnknownKey
from gridloom.functions.expressions import negative_as_none, none_as_negative, wrap_id
from gridloom.functions.ordinals import with_positions


@dataclasses.dataclass(frozen=True)
class VectorKind:
    column: str
    key: str | None  # None: the caller's
    ids: bool = False
    optional: bool = False  # none is -1 on disk


KINDS = {
    "lambdas": VectorKind("lambda", "lambdas"),
    "vector": VectorKind("element", None),
    "index": VectorKind("id", None, ids=True),
    "centroid_map": VectorKind("centroid_id", "centroid_map", ids=True),
    "subcentroid_lambdas": VectorKind("subcentroid_lambda", "subcentroid_lambdas"),
    "item_norms": VectorKind("norm", "item_norms"),
    "cluster_assignments": VectorKind("cluster_id", "cluster_assignments", ids=True, optional=True),
}


def kind(name: str) -> VectorKind:
    try:
        return KINDS[name]
    except KeyError:
        raise UnknownKey(f"no vector kind {name!r}; there are {', '.join(KINDS)}") from None


def encode(df: DataFrame, spec: VectorKind, column: str, *order: str, wrap: bool = False) -> DataFrame:
    """``<column of the kind>, pos``. ``wrap`` takes ids modulo 2**32 in place of refusing them."""
    if column not in df.columns:
        raise SchemaMismatch(f"no column {column!r}")
    placed = df if "pos" in df.columns and not order else with_positions(df.drop("pos"), *order)
    value = F.col(column)
    if spec.optional:
        value = none_as_negative(value)
    elif spec.ids and wrap:
        value = wrap_id(value)
    elif spec.ids and isinstance(df.schema[column].dataType, T.IntegralType):
        value = value.cast("bigint")
    return placed.select(value.alias(spec.column), F.col("pos").cast("bigint").alias("pos"))


def decode(df: DataFrame, spec: VectorKind) -> DataFrame:
    """The first column, whatever its name, as this kind."""
    first = df.schema[0]
    wanted = T.LongType() if spec.ids else T.DoubleType()
    if first.dataType != wanted or "pos" not in df.columns:
        raise SchemaMismatch(f"a {spec.column} vector has {wanted.simpleString()} and pos, not {df.schema.simpleString()}")
    value = F.col(first.name)
    return df.select((negative_as_none(value) if spec.optional else value).alias(spec.column), "pos")


def to_list(df: DataFrame) -> list:
    """The elements in this process, in order."""
    return [r[0] for r in df.orderBy("pos").collect()]
