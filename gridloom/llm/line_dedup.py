"""Exact line de-duplication across documents (built-in expressions only).

Only 16-byte hashes of line keys travel, with document id and position. They are
range-partitioned by hash and sorted inside each partition by hash, document and position,
and a running window streams the first document of every key. What comes back is a bitmap
per document that loses lines: an array of 64-bit words whose 1 bits are the lines to keep,
cut after the last word that loses any, so texts are never shuffled to decide. Bitmaps of
up to ``BROADCAST_BYTES`` together are broadcast to the texts; more are joined by id.

A key that occurs in a third of all lines would fill one range. Keys with more than
1/1024 of all lines are therefore found first (at most 1024 of them exist, so their list
may be broadcast); their first document comes from the same pre-aggregated pass, and their
rows are spread over salts in the range order.

Cases: a null or empty text is one empty line; lines whose key has fewer than
``min_chars`` code points always stay; copies of a key inside its first document all stay;
repeated rows of one id count as one document in the bitmap; rows with a null id neither
lose lines nor hold a first occurrence; columns of the input named as the new counts stay,
and the counts get an underscore more. An empty table gives an empty result. Keys are compared by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import BLANKS, ascii_lower, partitions, settle, table, tidy

HOT_SHARE = 1024
SALTS = 256
BROADCAST_BYTES = 32 << 20


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keep_bitmaps(docs: DataFrame, *, id_col="doc_id", text_col="text", min_chars: int = 10) -> DataFrame:
    """``(doc_id, n_dropped, keep array<long>)`` of the documents that lose lines."""
    spark = docs.sparkSession
    named = docs.where(F.col(id_col).isNotNull())
    lines = named.select(F.col(id_col).alias("doc_id"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    key = lines.select("doc_id", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = settle(key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "pos"))

    counts = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hot_first"))
    total = hashed.count()
    hot = counts.where(F.col("n") * HOT_SHARE > total).select("h1", "h2", "hot_first")  # at most HOT_SHARE rows
    salted = hashed.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", F.when(F.col("hot_first").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))))
    ranged = salted.repartitionByRange(partitions(spark), "h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.coalesce("hot_first", F.first("doc_id").over(stream))
    lost = ranged.withColumn("first", first).where(F.col("doc_id") > F.col("first"))

    words = lost.groupBy("doc_id", F.shiftright("pos", 6).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop"))
    entries = words.groupBy("doc_id").agg(F.sum(F.bit_count("drop")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("keep")))).alias("entries"))
    before = F.slice(F.concat(F.array(F.lit(-1).cast("long")), F.transform("entries", lambda e: e["word"])), F.lit(1), F.size("entries"))
    dense = F.flatten(F.zip_with("entries", before, lambda e, last: F.concat(F.array_repeat(F.lit(-1).cast("long"), (e["word"] - last - 1).cast("int")), F.array(e["keep"]))))
    return entries.select("doc_id", "n_dropped", dense.alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with its text cut down to the lines that the bitmaps keep, and ``n_lines``, ``n_dropped``."""
    marks = bitmaps.select(F.col("doc_id").alias("__id"), F.col("n_dropped").alias("__dropped"), F.col("keep").alias("__keep"))
    size = bitmaps.agg(F.sum(F.size("keep") * 8 + 32)).first()[0] or 0
    names = {n: n + "_" * next(k for k in range(len(docs.columns) + 1) if n + "_" * k not in docs.columns) for n in ("n_lines", "n_dropped")}
    lines = lines_of(F.col(text_col))
    kept = F.filter(lines, lambda _, i: F.coalesce(F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", F.get("__keep", F.shiftright(i, 6)), i % 64)) == 1, F.lit(True)))
    return (
        docs.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, F.col(id_col) == F.col("__id"), "left")
        .withColumn(names["n_lines"], F.size(lines).cast("long"))
        .withColumn(names["n_dropped"], F.coalesce("__dropped", F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col("__keep").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")))
        .drop("__id", "__dropped", "__keep")
    )


def deduplicated(docs: DataFrame, *, id_col="doc_id", text_col="text", min_chars: int = 10) -> DataFrame:
    """``docs`` without the lines that an earlier document has, and ``n_lines``, ``n_dropped``."""
    with tidy(docs.sparkSession) as keep:
        return keep(apply_bitmaps(docs, settle(keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)), id_col=id_col, text_col=text_col))


def op3_line_dedup(spark, sf_dir):
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id > f.first AS lost FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*)::bigint AS n_lines, (count(*) FILTER (WHERE lost))::bigint AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
