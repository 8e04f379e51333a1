"""Embedding near-duplicates by NN-descent, with an audit of its recall.

1. Rows that can link (label, finite components, some length) become unit vectors in double
   precision; equal ones of a label form a class with a count.
2. The graph starts from random hyperplanes: ``TABLES`` keys of about log2(vectors of the label) bits;
   inside a key (large ones dealt to chunks) neighbours along one more projection are paired.
3. Rounds of neighbours-of-neighbours joins refine lists of the ``K`` nearest, of cosine
   ``FLOOR`` or more: two neighbours of one vector at cosine 0.98 are at 0.92 or more, so
   weaker ones lead nowhere. Rounds end when they meet no new edge.
4. A list whose entries are all links is saturated: it gets twice as many, and the rounds go
   on, until none is saturated or they have ``MOST_K``. The component of one that still is
   gets compared in full, block against block, which returns counts and not pairs; links
   cannot leave it.
5. Each label is audited by itself: queries outside saturated components are compared with
   all of the label until ``LINKED`` of them have links, and recall is the mean over those.
   If a label is below ``RECALL`` the search goes on, up to ``PASSES`` times. A label that
   still is below, that shows too few linked queries, or that is small is compared in full,
   block against block. So every label has its measured recall, or is exact.

Links are pairs of one label at cosine >= 0.98. Cases: rows with a null label, and vectors
that are null, empty, zero or hold a null or non-finite component, link with nothing (n_links 0, their own
component); vectors of different lengths do not link. Repeated rows count as vectors of
their own. Where rows of one id have different vectors or labels, that with the least label,
then the least hash, stands for the id. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import settle, table, tidy
from gridloom.llm.components import components, in_blocks

THRESHOLD = 0.98
FLOOR = 0.9
K, MOST_K = 10, 20
TABLES = 16
CHUNK = 4096
ROUNDS = 6
BLOCK = 512
#: Queries of a label at first, and at most; how many with links an audit takes.
AUDIT_QUERIES, MOST_QUERIES, LINKED = 512, 8192, 32
RECALL = 0.97
PASSES = 4
SLACK = 1e-12  # for the order of additions; links exactly at the threshold count


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, embedding)`` to ``vec_id, label, dim, unit binary`` of the rows that can link."""

    def answer(batches):
        for batch in batches:
            lists = batch.column(2)
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            flat = pc.cast(lists.flatten(), pa.float64())  # null lists have no values here
            value = np.asarray(pc.fill_null(flat, float("nan")), np.float64)
            begin = np.cumsum(size) - size
            for dim in np.unique(size[size > 0]).tolist():
                pick = np.flatnonzero(size == dim)
                x = value[begin[pick][:, None] + np.arange(dim)]
                top = np.abs(x).max(1)
                ok = np.isfinite(x).all(1) & (top > 0)
                x, at = x[ok] / top[ok, None], pa.array(pick[ok])
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(x), dim), pa.int32()), pa.array([row.tobytes() for row in x.astype("<f8")], pa.binary())], ["vec_id", "label", "dim", "unit"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.where("label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(answer, f"vec_id long, label {kind}, dim int, unit binary")


def hyperplane_pairs(reps: DataFrame, bits: int, tables: range) -> DataFrame:
    """Candidate ``(u, v)``, u < v: neighbours along a projection inside a key of the row's own ``bits``, at most ``bits``."""

    def keys(batches):
        planes = {}
        for batch in batches:
            ids, labels, dims, units, own = (batch.column(k).to_pylist() for k in range(5))
            for dim in set(dims):
                if dim not in planes:
                    planes[dim] = [np.random.Generator(np.random.PCG64([t, dim])).standard_normal((dim, bits + 1)) for t in tables]
                pick = [k for k, d in enumerate(dims) if d == dim]
                mask = (1 << np.array([own[k] for k in pick], np.int64)) - 1
                x = np.stack([np.frombuffer(units[k], "<f8") for k in pick])
                for t, p in zip(tables, planes[dim]):
                    y = x @ p
                    code = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) & mask
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({"rep": np.array([ids[k] for k in pick], np.int64), "t": np.int32(t), "label": pd.array([str(labels[k]) for k in pick]), "dim": np.int32(dim), "code": code, "along": y[:, bits]}), preserve_index=False)

    rows = reps.select("rep", "label", "dim", "unit", "bits").mapInArrow(keys, "rep long, t int, label string, dim int, code long, along double")
    key = ["t", "label", "dim", "code"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunked = rows.join(sizes, key).withColumn("chunk", F.pmod(F.xxhash64("rep", "t"), F.ceil(F.col("n") / CHUNK)))
    order = Window.partitionBy(*key, "chunk").orderBy("along", "rep")
    near = F.array(*[F.lead("rep", d).over(order) for d in (1, 2, 3)])
    pairs = chunked.withColumn("near", near).select("rep", F.explode("near").alias("v")).where("v IS NOT NULL")
    return pairs.select(F.least("rep", "v").alias("u"), F.greatest("rep", "v").alias("v")).distinct()


def scored(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``(u, v, cos)`` of the pairs of one label at ``FLOOR`` or more."""

    def dots(batches):
        for batch in batches:
            u, v = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            size, cos = np.array([len(a) for a in u], np.int64), np.empty(len(u))
            for n in np.unique(size).tolist():
                pick = np.flatnonzero(size == n)
                x, y = (np.frombuffer(b"".join(side[k] for k in pick.tolist()), "<f8").reshape(len(pick), -1) for side in (u, v))
                cos[pick] = np.einsum("ij,ij->i", x, y)
            keep = np.flatnonzero(cos >= FLOOR)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(cos[keep], pa.float64())], ["u", "v", "cos"])

    side = lambda end: reps.select(F.col("rep").alias(end), F.col("unit").alias(f"unit_{end}"), F.col("label").alias(f"label_{end}"), F.col("dim").alias(f"dim_{end}"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v").where("label_u = label_v AND dim_u = dim_v")
    return joined.select("u", "v", "unit_u", "unit_v").mapInArrow(dots, "u long, v long, cos double")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "cos").union(edges.select("v", "u", "cos"))


def nearest(edges: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """The best ``(u, v, cos)`` of each u and how many it may have: ``K``, or what ``wide (rep, k)`` says."""
    order = Window.partitionBy("u").orderBy(F.desc("cos"), F.xxhash64("v"))
    best = both_ways(edges).withColumn("nth", F.row_number().over(order))
    if wide is None:
        return best.where(F.col("nth") <= K).withColumn("k", F.lit(K))
    sized = best.where(F.col("nth") <= MOST_K).join(wide, F.col("u") == F.col("rep"), "left").withColumn("k", F.coalesce("k", F.lit(K)))
    return sized.where(F.col("nth") <= F.col("k")).select("u", "v", "cos", "nth", "k")


def refine(edges: DataFrame, reps: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins until they meet no new edge, for all vectors or for those in ``wide``; all edges met."""
    for _ in range(ROUNDS):
        lists = settle(nearest(edges, wide).select("u", "v"))
        own = lists if wide is None else lists.join(wide.select(F.col("rep").alias("u")), "u", "left_semi")
        hops = own.join(lists.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").where("u != w").select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("v")).distinct()
        fresh = settle(scored(hops.join(edges.select("u", "v"), ["u", "v"], "left_anti"), reps))
        if fresh.isEmpty():
            break
        edges = edges.union(fresh)
    return edges


def saturated(edges: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """``(rep, k)`` of the lists that are full of links."""
    return nearest(edges, wide).where((F.col("nth") == F.col("k")) & (F.col("cos") >= THRESHOLD - SLACK)).select(F.col("u").alias("rep"), "k")


def enlarge(edges: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges after rounds with doubled lists for the saturated ones, and ``(rep, k)`` of those that are so at ``MOST_K``."""
    full = settle(saturated(edges))
    wide, k = None, K
    while k < MOST_K and not full.isEmpty():
        k = min(2 * k, MOST_K)
        own = full.select("rep", F.lit(k).alias("k"))
        wide = settle(own if wide is None else own.union(wide.join(own, "rep", "left_anti")))
        edges = refine(edges, reps, wide)
        full = settle(saturated(edges, wide).where(F.col("k") == k))
    return edges, full


def pool_counts(members: DataFrame) -> DataFrame:
    """``(rep, n)``: copies linked with each member ``(rep, pool, label, unit, copies)`` inside its pool, its own copies left out."""
    counts = members.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = in_blocks(members, counts)
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("pool", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "unit", "copies")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame.i.iloc[0], frame.j.iloc[0]
        a, b = frame[frame.block == i], frame[frame.block == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
        x, y = (np.frombuffer(b"".join(s.unit), "<f8").reshape(len(s), -1) for s in (a, b))
        link = x @ y.T >= THRESHOLD - SLACK
        if i == j:
            np.fill_diagonal(link, False)
            return pd.DataFrame({"rep": a.rep, "n": link @ b.copies.to_numpy()})
        return pd.concat([pd.DataFrame({"rep": a.rep, "n": link @ b.copies.to_numpy()}), pd.DataFrame({"rep": b.rep, "n": link.T @ a.copies.to_numpy()})])

    return sent.groupBy("pool", "i", "j").applyInPandas(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def new_links(members: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between different components ``c`` of the members ``(rep, pool, c, unit)`` of a pool, by blocks; one for each two components of a pair of blocks."""
    counts = members.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = in_blocks(members, counts)
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("pool", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "c", "unit")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame.block == frame.i.iloc[0]], frame[frame.block == frame.j.iloc[0]]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        x, y = (np.frombuffer(b"".join(s.unit), "<f8").reshape(len(s), -1) for s in (a, b))
        u, v = np.nonzero((x @ y.T >= THRESHOLD - SLACK) & (a.c.to_numpy()[:, None] != b.c.to_numpy()[None, :]))
        out = pd.DataFrame({"a": a.rep.to_numpy()[u], "b": b.rep.to_numpy()[v], "ca": a.c.to_numpy()[u], "cb": b.c.to_numpy()[v]})
        return out.drop_duplicates(["ca", "cb"])[["a", "b"]]

    return sent.groupBy("pool", "i", "j").applyInPandas(compare, "a long, b long")


def audit(reps: DataFrame, found: DataFrame, pools: DataFrame) -> dict[int, float | None]:
    """Recall of each group of ``reps`` with more than ``4 * BLOCK`` rows: the mean over queries with links, None where too few have any.

    Queries are rows outside ``pools``, compared with all of their group; ``found (rep, n)`` is judged.
    """
    large = [r.grp for r in reps.where(F.col("size") > 4 * BLOCK).select("grp").distinct().collect()]
    order = Window.partitionBy("grp").orderBy(F.xxhash64(F.lit("audit"), "rep"))
    ranked = settle(reps.join(pools.select("rep"), "rep", "left_anti").withColumn("nth", F.row_number().over(order)))
    out: dict[int, float | None] = dict.fromkeys(large)
    left, first, last = large, 0, AUDIT_QUERIES
    seen = {g: (0, 0.0) for g in large}
    while left and first < MOST_QUERIES:
        queries = ranked.where(F.col("grp").isin(left) & (F.col("nth") > first) & (F.col("nth") <= last)).select("rep", "grp", "unit").toPandas()
        groups = {k: (g.rep.to_numpy(), np.stack([np.frombuffer(u, "<f8") for u in g.unit])) for k, g in queries.groupby("grp")}
        shared = reps.sparkSession.sparkContext.broadcast(groups)

        def count(batches, shared=shared):
            for batch in batches:
                frame = batch.to_pandas()
                for k, g in frame.groupby("grp"):
                    if k not in shared.value:
                        continue
                    ids, q = shared.value[k]
                    x = np.stack([np.frombuffer(u, "<f8") for u in g.unit])
                    for at in range(0, len(ids), BLOCK):
                        link = q[at : at + BLOCK] @ x.T >= THRESHOLD - SLACK
                        link &= ids[at : at + BLOCK, None] != g.rep.to_numpy()[None, :]
                        n = link @ g.copies.to_numpy()
                        yield pa.RecordBatch.from_pandas(pd.DataFrame({"rep": ids[at : at + BLOCK], "grp": np.int64(k), "n": n})[n > 0], preserve_index=False)

        true = reps.where(F.col("grp").isin(left)).select("rep", "grp", "unit", "copies").mapInArrow(count, "rep long, grp long, n long").groupBy("rep", "grp").agg(F.sum("n").alias("n"))
        share = F.least("n", F.coalesce("m", F.lit(0))) / F.col("n")
        rows = true.join(found.select("rep", F.col("n").alias("m")), "rep", "left").groupBy("grp").agg(F.count(F.lit(1)).alias("linked"), F.sum(share).alias("share")).collect()
        for r in rows:
            seen[r.grp] = (seen[r.grp][0] + r.linked, seen[r.grp][1] + r.share)
        left = [g for g in left if seen[g][0] < LINKED and g in groups]
        first, last = last, last * 4
    for g in large:
        if seen[g][0] >= LINKED:
            out[g] = seen[g][1] / seen[g][0]
    return out


def near_duplicates(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """``vec_id, n_links, class_id, component_id, kept, recall`` for every row of ``vectors``.

    ``recall`` is what the audit measured for the row's label; null where the label was compared in full.
    """
    with tidy(vectors.sparkSession) as keep:
        given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
        units = settle(unit_vectors(given).withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit("second"), "unit")}))
        key = ["label", "dim", "h1", "h2"]
        own = units.groupBy(F.col("vec_id").alias("id")).agg(F.min(F.struct(*key)).alias("own"))
        units = settle(units.join(own, (F.col("vec_id") == F.col("id")) & (F.struct(*key) == F.col("own"))).drop("id", "own"))
        classes = settle(units.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
        firsts = units.select("vec_id", *key, "unit").dropDuplicates(["vec_id", *key])
        reps = settle(firsts.join(classes, [*key]).where("vec_id = rep").select("rep", "label", "dim", "unit", "copies"))
        group = reps.groupBy("label", "dim").agg(F.min("rep").alias("grp"), F.count(F.lit(1)).alias("size"))
        reps = settle(reps.join(group, ["label", "dim"]).withColumn("bits", F.least(F.lit(40), F.greatest(F.lit(2), F.ceil(F.log2("size")))).cast("int")))
        bits = reps.agg(F.max("bits")).first()[0] or 2

        edges, more = None, 0
        while True:
            pairs = hyperplane_pairs(reps, bits, range(more * TABLES, (more + 1) * TABLES))
            fresh = settle(scored(pairs, reps))
            edges = refine(fresh if edges is None else settle(edges.union(fresh).dropDuplicates(["u", "v"])), reps)
            edges, full = enlarge(edges, reps)
            links = settle(edges.where(F.col("cos") >= THRESHOLD - SLACK))
            comps = components(links.select(F.col("u").alias("a"), F.col("v").alias("b")))
            pools = settle(comps.join(comps.join(full, F.col("node") == F.col("rep")).select(F.col("component").alias("pool")).distinct(), F.col("component") == F.col("pool")).select(F.col("node").alias("rep"), "pool"))
            counted = pool_counts(reps.join(pools, "rep"))
            few = both_ways(links).select("u", "v").distinct().join(reps.select(F.col("rep").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("n")).select(F.col("u").alias("rep"), "n")
            found = settle(few.join(pools, "rep", "left_anti").union(counted))
            more += 1
            recall = audit(reps, found, pools)
            poor = [g for g, r in recall.items() if r is not None and r < RECALL]
            if more == PASSES or not poor:
                break

        sure = {g: r for g, r in recall.items() if r is not None and r >= RECALL}
        exact = reps.where(~F.col("grp").isin([*sure]))
        if not exact.isEmpty():
            placed = exact.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", F.col("grp").alias("pool"), F.coalesce("component", "rep").alias("c"), "unit")
            ties = settle(new_links(placed))
            if not ties.isEmpty():
                comps = components(links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(ties))
            counted = pool_counts(exact.select("rep", F.col("grp").alias("pool"), "label", "unit", "copies"))
            found = settle(found.join(exact.select("rep"), "rep", "left_anti").union(counted))

        known = F.create_map(*[F.lit(x) for g, r in sure.items() for x in (g, float(r))])[F.col("grp")] if sure else F.lit(None).cast("double")
        member = units.join(classes, key).select(F.col("vec_id").alias("id"), "rep", "copies").dropDuplicates(["id"])
        linked = member.join(reps.select("rep", known.alias("recall")), "rep").join(found, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left").select("id", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"), "recall")
        out = given.select("vec_id").join(linked, F.col("vec_id") == F.col("id"), "left")
        return keep(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep", "vec_id").alias("class_id"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"), "recall"))


def op6_embedding_links(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


SQL = r"""
WITH RECURSIVE unit AS (
  SELECT vec_id, label, embedding::double[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) AS norm FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98 - 1e-12),
reach(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least_of AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least_of ON node = vec_id LEFT JOIN degree ON a = vec_id
"""
