"""Sparse matrices: an entry a row, ``row bigint, col bigint, value double``.

Those of few different rows can also be kept in blocks, ``rows array<bigint>, cols array<bigint>,
value double``: the value at each of the rows and each of the columns, except where they are equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import SchemaMismatch
from gridloom.functions.expressions import must
from gridloom.functions.ordinals import running_total, with_positions


#: Entries of blocks that one task makes, about.
SHARE = 1 << 23


def encode(df: DataFrame, rows: int, cols: int, nnz: int) -> DataFrame:
    """The triplets, with the dimensions in the columns' metadata. Stored zeros are kept."""
    return _encoded(df, _TRIPLETS, rows, cols, nnz)


def encode_blocks(df: DataFrame, rows: int, cols: int, nnz: int) -> DataFrame:
    """The blocks, with the dimensions in the columns' metadata."""
    return _encoded(df, _BLOCKS, rows, cols, nnz)


def decode(df: DataFrame, rows: int, cols: int, *, consolidated: bool = True) -> DataFrame:
    """Stored triplets against the catalog's dimensions; duplicates are summed."""
    _must_be(df, _TRIPLETS, rows, cols)
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    checked = df.where(must(inside, f"entry outside {rows} x {cols}"))
    return consolidate(checked) if consolidated else checked


def decode_blocks(df: DataFrame, rows: int, cols: int, nnz: int | None, *, consolidated: bool = True) -> DataFrame:
    """The triplets of stored blocks, checked block by block against the catalog's dimensions; duplicates are summed."""
    _must_be(df, _BLOCKS, rows, cols)
    inside = F.forall("rows", lambda x: x.between(0, rows - 1)) & F.forall("cols", lambda x: x.between(0, cols - 1))
    found = entries(df.where(must(inside, f"entry outside {rows} x {cols}")), nnz)
    return consolidate(found) if consolidated else found


def entries(blocks: DataFrame, nnz: int | None = None) -> DataFrame:
    """``row, col, value`` of blocks, dealt out first so that tasks make about as many entries each."""
    spark = blocks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if nnz is not None:  # small matrices in fewer tasks, large ones in more
        parts = max(1, min(-(-nnz // (SHARE // 16)), max(parts, -(-nnz // SHARE))))
    # generated code holds all that it makes of one input row; coalesce, which leaves the parts as they are,
    # ends it between the two explosions, so that this is a row of a block and not a block
    lines = blocks.repartition(parts).select(F.explode("rows").alias("row"), "cols", "value").coalesce(parts)
    return lines.select("row", F.explode("cols").alias("col"), "value").where("row <> col")


_TRIPLETS = {"row": "bigint", "col": "bigint", "value": "double"}
_BLOCKS = {"rows": "array<bigint>", "cols": "array<bigint>", "value": "double"}


def _encoded(df: DataFrame, layout: dict[str, str], rows: int, cols: int, nnz: int) -> DataFrame:
    about = {"rows": str(rows), "cols": str(cols), "nnz": str(nnz)}
    return df.select(*[F.col(c).cast(t).alias(c, metadata=about) for c, t in layout.items()])


def _must_be(df: DataFrame, layout: dict[str, str], rows: int, cols: int) -> None:
    if [(f.name, f.dataType.simpleString()) for f in df.schema] != list(layout.items()):
        raise SchemaMismatch(f"a sparse matrix has {', '.join(layout)}, not {df.schema.simpleString()}")
    about = df.schema[0].metadata
    if about and (int(about["rows"]), int(about["cols"])) != (rows, cols):
        raise SchemaMismatch(f"stored as {about['rows']} x {about['cols']}, catalogued as {rows} x {cols}")


def consolidate(df: DataFrame) -> DataFrame:
    """One entry a coordinate. Sole entries pass through as they are, so -0.0 stays -0.0."""
    total = F.when(F.count(F.lit(1)) == 1, F.any_value("value")).otherwise(F.sum("value"))
    return df.groupBy("row", "col").agg(total.alias("value"))


def nnz(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("nnz"))


def indptr(df: DataFrame, rows: int) -> DataFrame:
    """``row, indptr``: entries before each row, and before the end as row ``rows``. Empty rows are there too."""
    counts = df.groupBy(F.col("row").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(rows).withColumnRenamed("id", "row").join(counts, F.col("row") == F.col("r"), "left").select((F.col("row") + 1).alias("row"), F.coalesce("n", F.lit(0)).alias("n"))
    first = df.sparkSession.range(1).select(F.col("id").alias("row"), F.lit(0).cast("bigint").alias("n"))
    return running_total(every.union(first), "row", "n").select("row", F.col("upto").cast("bigint").alias("indptr"))


def csr_entries(df: DataFrame) -> DataFrame:
    """``row, nth, col, value``: indices and data of each row in order.

    Entries are placed in one order of all rows and each row's first place is taken off, so
    that a row of any size is dealt to many tasks.
    """
    placed = with_positions(df, "row", "col")
    firsts = placed.groupBy(F.col("row").alias("r")).agg(F.min("pos").alias("first"))
    return placed.join(firsts, F.col("row") == F.col("r")).select("row", (F.col("pos") - F.col("first")).cast("int").alias("nth"), "col", "value")


def to_csr(df: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``indptr, indices, data`` in this process."""
    frame = df.orderBy("row", "col").toPandas()
    starts = np.concatenate([[0], np.cumsum(np.bincount(frame.row.to_numpy(int), minlength=rows))])
    return starts, frame.col.to_numpy(np.int64), frame.value.to_numpy(np.float64)
