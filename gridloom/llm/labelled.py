"""The bounded sample of labelled documents that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import settle

#: Of all texts of a sample together.
SAMPLE_BYTES = 128 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, *, id_col="doc_id", text_col="text", most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``bound`` labelled ids, spread evenly over all ids by hash, written.

    Ids are chosen first, in their own table; only that list (``bound`` rows at most) is
    broadcast to the scan of the texts. In order of the same hash, texts are taken while
    they have no more than ``most_bytes`` together. Null labels and null ids are left out;
    an id with several labels takes the largest, one with several texts that of the least
    hash.
    """
    order = [F.xxhash64(F.col("doc_id")), "doc_id"]
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(*order)
        .limit(bound)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    found = settle(texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    sizes = found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))  # at most ``bound`` rows
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fit = sizes.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id")
    return found.join(F.broadcast(fit), "doc_id").select("doc_id", "text", "label")
