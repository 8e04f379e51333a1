"""Mixing sources to target weights by systematic sampling (built-in expressions only).

Every document of a source expects ``rate = target / source_size`` copies. The documents
of a source are put in a fixed order, their expected copies are prefix-summed, one seeded
offset per source is added, and a document is emitted once for each integer that its
stretch of the sum crosses.

Two choices make it hold for any skew and any rerun:

* The order goes by size first, so that the words taken differ from the target by about
  one document, not by a random walk. It is cut into segments (band of sizes, hash of the
  id, of the text where it is null); the sum is made inside each segment and over the few segments of a source, so a
  source with a third of all rows never meets in one task.
* Expected copies are integers in units of 2**-26, so the sums are exact and do not depend
  on partitioning.

Cases: null or blank texts have size 0, may be drawn, and add 0 words. A source whose size
is 0 has target 0. A null source is a source of its own, last in order. Repeated rows (and
repeated ids) each count as documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_REGEX, settle, table

UNIT_BITS = 26
SALTS = 64
WEIGHTS = (5, 2, 1)
CAP = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def _hex(text: Column, digits: int) -> Column:
    """The first so many hexadecimal digits of the text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``: shares of the total by weight, each at most ``cap`` times its source.

    Sharing the excess again until no target is above its cap ends where
    ``target = min(cap * size, level * weight)`` adds up to the total. With the sources in
    order of ``cap * size / weight`` the level comes from two running sums. The table has
    one row per source, and one task sorts them: sources are names of collections, not of pages.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    full = F.col("source_size") * cap
    order = Window.orderBy((full / F.col("weight")).asc(), "rank")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("filled", F.coalesce(F.sum(full).over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(onward))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open_weight"))
        # the level of the first source that its cap does not hold back
        .withColumn("free_level", F.when(F.col("level") * F.col("weight") <= full, F.col("level")))
        .withColumn("final", F.first("free_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(full.cast("double"), F.coalesce(F.col("final") * F.col("weight"), full.cast("double")))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, copies, taken``."""
    size = F.col("size")
    bits = F.length(F.bin(size)) - 1
    base = settle(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), (_hex(F.coalesce(F.col(id_col).cast("long").cast("string"), text_col, F.lit("")), 4) % SALTS).alias("salt")))
    base = base.withColumn("band", bits * 8 + F.expr("shiftright(size * 8, length(bin(size)) - 1)") % 8)
    segments = settle(base.groupBy("source", "band", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    targets = source_targets(segments.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = _hex(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), 6)
    targets = targets.withColumn("step", F.floor(rate * (1 << UNIT_BITS) + 0.5).cast("long")).withColumn("offset", draw * (1 << (UNIT_BITS - 24)))
    along = Window.partitionBy("source").orderBy("band", "salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        segments.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .withColumnRenamed("source", "s_source")
        .join(targets, F.col("s_source").eqNullSafe(F.col("source")))
        .select("s_source", F.col("band").alias("s_band"), F.col("salt").alias("s_salt"), "before", "source_size", "target", "step", "offset")
    )
    in_segment = Window.partitionBy("source", "band", "salt").orderBy("size", "doc_id")
    ranked = base.withColumn("nth", F.row_number().over(in_segment))
    joined = ranked.join(placed, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("band") == F.col("s_band")) & (F.col("salt") == F.col("s_salt")))
    upto = (F.col("before") + F.col("nth")) * F.col("step") + F.col("offset")
    copies = F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - F.col("step"), UNIT_BITS)
    return joined.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * size).alias("taken"))


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as ``mixed`` says. Rows that share an id go by the most copies of one of them; a null id is an id."""
    drawn = mixed.where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    take = drawn.select(F.col("doc_id").alias("__take_id"), F.sequence(F.lit(1), "copies").alias("__copies"))
    return docs.join(take, F.col(id_col).eqNullSafe(F.col("__take_id"))).withColumn("__copy", F.explode("__copies")).select(*docs.columns)


def op2_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH base AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0)::bigint AS size FROM documents),
keyed AS (
  SELECT *, (length(bin(size)) - 1) * 8 + ((size * 8) >> (length(bin(size)) - 1)::bigint) % 8 AS band,
    ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 4))::bigint % 64 AS salt FROM base),
sources AS (SELECT source, sum(size)::bigint AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
sums AS (
  SELECT *, sum(source_size) OVER ()::bigint AS total,
    coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS filled,
    sum(weight) OVER (ORDER BY source_size * 3 / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::bigint AS open_weight
  FROM weighed),
levels AS (SELECT *, (total - filled)::double / open_weight::double AS level FROM sums),
final AS (SELECT level FROM levels WHERE level * weight <= source_size * 3 ORDER BY source_size * 3 / weight, rank LIMIT 1),
targets AS (
  SELECT source, source_size, least((source_size * 3)::double, coalesce((SELECT level FROM final) * weight, (source_size * 3)::double)) AS target,
    ('0x' || substr(md5('mix' || coalesce('s' || source, 'n')), 1, 6))::bigint * 4 AS off
  FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 67108864 + 0.5)::bigint ELSE 0 END AS step FROM targets),
nth AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, salt, size, doc_id) AS nth FROM keyed)
SELECT n.doc_id, n.size, r.source_size, r.target,
  (((n.nth * r.step + r.off) >> 26) - (((n.nth - 1) * r.step + r.off) >> 26)) * n.size AS taken
FROM nth n JOIN rates r ON n.source IS NOT DISTINCT FROM r.source
"""
