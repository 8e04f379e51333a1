"""Row positions as data: Spark keeps no order, so every artifact carries ``pos``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.errors import InvalidArtifact
from gridloom.sources.files import scratch_folder

BLOCK = 1 << 16


def with_positions(df: DataFrame, *order: str | Column) -> DataFrame:
    """Add ``pos`` 0, 1, ... in the given order.

    Rows are range-partitioned and sorted; positions are counted inside each partition and
    shifted by the sizes of those before, one row a partition. The sorted rows are written
    to the scratch folder in between: the bounds of ranges come from samples, and counts
    and rows must go by the same ones.
    """
    if not order:
        raise InvalidArtifact("rows without a pos column need an order")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    path = scratch_folder(df.sparkSession)
    ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).write.parquet(path)
    local = df.sparkSession.read.parquet(path)
    sizes = local.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return local.join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn("pos", F.col("__at") + F.col("__before")).drop("__part", "__at", "__p", "__before")


def file_positions(df: DataFrame) -> DataFrame:
    """Add ``pos`` in the order of a Parquet file's rows, files of a folder by name."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    sizes = tagged.groupBy(F.col("__file").alias("__f")).agg((F.max("__at") + 1).alias("__n"))
    before = sizes.select("__f", F.coalesce(F.sum("__n").over(Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return tagged.join(before, F.col("__file") == F.col("__f")).withColumn("pos", F.col("__at") + F.col("__before")).drop("__file", "__at", "__f", "__before")


def running_total(df: DataFrame, at: str, value: str) -> DataFrame:
    """Add ``upto``: the sum of ``value`` over all rows up to this one, in order of the integer ``at``.

    Summed inside blocks of ``BLOCK`` positions and over the blocks, so no window holds all rows.
    """
    blocked = df.withColumn("__block", F.floor(F.col(at) / BLOCK))
    inside = Window.partitionBy("__block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(F.col("__block").alias("__b")).agg(F.sum(value).alias("__sum")).select("__b", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return blocked.withColumn("__in", F.sum(value).over(inside)).join(blocks, F.col("__block") == F.col("__b")).withColumn("upto", F.col("__in") + F.col("__before")).drop("__block", "__in", "__b", "__before")
