"""Small helpers that every corpus operator shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``: the white space that word and line rules go by.
BLANKS = "\t\n\x0b\x0c\r "
WORD_REGEX = r"[^ \t-\r]+"


def let_workers_import(spark: SparkSession) -> None:
    """Put this package's place on the path of Python workers that start from now on (a cluster gets it by ``--py-files``)."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates: the session's own setting. Only a local session may do without: it gets a new folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="gridloom-"))
    return sc.getCheckpointDir()


_written: list[str] = []


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    Later reads neither recompute it nor depend on the executor that made it. A plain table
    also drops what a checkpoint's plan carries over (constraints, partitionings), which
    would grow through repeated joins.
    """
    spark = df.sparkSession
    let_workers_import(spark)
    path = f"{ensure_checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession):
    """Tables settled inside are deleted at the end, but for those that the DataFrames told to the yielded function read. After an error all stay."""
    outer, kept = list(_written), []
    _written.clear()
    try:
        yield lambda df: kept.append(df) or df
        if _written:
            needed = {m for df in kept for f in df.inputFiles() for m in re.findall(r"settled-[0-9a-f]{32}", f)}
            conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
            for path in [p for p in _written if p.rpartition("/")[2] not in needed]:
                path_of(path).getFileSystem(conf).delete(path_of(path), True)
                _written.remove(path)
    finally:
        _written[:0] = outer


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, m: int) -> Column:
    """``crc32(id as text) mod m``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; the plain ``lower`` is the fast path of texts that are all ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))
