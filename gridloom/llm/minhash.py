"""Near-duplicate texts: MinHash bands for candidates, sequential Bayesian pruning, exact check.

1. A text's set holds its distinct ``k``-word shingles (64-bit hashes). Texts with equal
   sets form a class at once, so a group of exact copies goes on as one member.
2. 128 minima per class make 32 bands of 4: a pair at similarity 0.8 shares none with
   probability 5e-8.
3. Inside a bucket every member is compared with the bucket's least and greatest member
   only, so a group of n makes 2n candidates and not n*n.
4. Candidates are compared 32 minima at a time; after each batch those go whose posterior
   probability of reaching the threshold is under ``MISS``.
5. Survivors are confirmed on the full sets: first the likeliest partner of each member,
   then those that would still join two components.
6. Buckets whose members still lie in several components are then searched in full across
   components, by the same steps: signatures in batches, posterior pruning, full sets of the
   survivors. Small buckets list their pairs; those of more than ``LARGE`` members, joined
   into pools where they share a member so that no pair is met in every band, are met block
   against block, from which only new links come out. Pairs inside one component cannot
   change it; so no link between components is left out for the size of its bucket.

Links are ``100 * intersection >= percent * union``. Cases: null texts and texts without a
word have an empty set and are linked with nothing; texts of fewer than ``k`` words have
their whole sequence as one shingle. Repeated rows are copies of each other. Rows of one id
with different texts are texts of their own: sharing an id links nothing, and each has the
least id of the texts that it reaches. Rows with a null id stay alone. An empty table gives
an empty result. Texts are read whole. Sets are told apart by 128-bit digests, and classes of
equal sets have 64-bit names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BLANKS, settle, table, tidy
from gridloom.llm.components import components, in_blocks
from gridloom.llm.textcodes import mix, word_batches

SIZE, BANDS, BATCH = 128, 32, 32
MISS = 1e-6
#: Pairs of buckets with more members are not listed but met block against block, in blocks of at most about so many rows and bytes of sets.
LARGE = 64
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 21
_rng = np.random.Generator(np.random.PCG64(5))
_XOR = _rng.integers(0, 2**32, SIZE, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 2**31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text, one after another, and how many each has."""
    grams, start = words.grams(k)
    sets = []
    for d in range(len(words)):
        if start[d + 1] > start[d]:
            sets.append(np.unique(grams[start[d] : start[d + 1]]))
        elif (n := words.start[d + 1] - words.start[d]) > 0:
            own = words.hashes[words.start[d] : words.start[d + 1]]
            sets.append(mix((own * (2 * np.arange(n, dtype=np.uint64) + np.uint64(3))).sum(keepdims=True) + np.uint64(n)))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def signatures(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minima of the non-empty sets, a row each; 0 for empty ones."""
    out = np.zeros((len(sizes), SIZE), np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        begin = (np.cumsum(sizes) - sizes)[some]
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(SIZE):
            out[some, i] = np.minimum.reduceat((x ^ _XOR[i]) * _MULTIPLY[i], begin)
    return out


def digests(shingles: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set; 0 for empty ones."""
    begin, padded = np.cumsum(np.append(0, sizes)), np.append(shingles, np.uint64(0))  # the last sum is of what stands behind all sets
    return [np.where(sizes > 0, np.add.reduceat(mix(padded ^ np.uint64(c)), begin)[:-1], 0).astype(np.uint64).view(np.int64) for c in (0x1234567, 0x9E3779B97F4A7C15)]


def describe(docs: DataFrame, k: int, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, text_hash, n_shingles, d1, d2, sig``: set size, 128-bit digest of the set, minima."""

    def answer(batches):
        for batch in batches:
            for words in word_batches(batch.column(1).to_pylist()):
                shingles, sizes = shingle_sets(words, k)
                sigs = signatures(shingles, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, len(words)), batch.column(2).slice(words.first, len(words)), pa.array(sizes), *map(pa.array, digests(shingles, sizes)), pa.array([row.tobytes() for row in sigs], pa.binary())], ["doc_id", "text_hash", "n_shingles", "d1", "d2", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(answer, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sig binary")


def least_matches(percent: int, miss: float = MISS) -> dict[int, int]:
    """After n minima, the fewest equal ones that leave a posterior probability of at least ``miss``.

    With a uniform prior the similarity given m of n is Beta(m + 1, n - m + 1), whose upper
    tail at t is the chance of at most m successes in n + 1 trials at t.
    """
    t, out = percent / 100, {}
    for n in range(BATCH, SIZE + 1, BATCH):
        below, m = 0.0, 0
        while (below := below + math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        out[n] = m
    return out


def likely(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` that are not pruned, with the number of equal minima."""
    bounds = least_matches(percent)

    def compare(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIZE) for c in (2, 3))
            every = np.arange(batch.num_rows)
            left, same = unpruned(x, y, every, every, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(left)), batch.column(1).take(pa.array(left)), pa.array(same)], ["a", "b", "same"])

    one = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    two = one.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return two.select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a long, b long, same int")


def unpruned(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, bounds: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of rows ``x[i], y[j]`` are left after the last batch of minima, and how many of theirs are equal."""
    left, same = np.arange(len(i)), np.zeros(len(i), np.int32)
    for n, least in bounds.items():
        same = same + (x[i[left], n - BATCH : n] == y[j[left], n - BATCH : n]).sum(1).astype(np.int32)
        left, same = left[same >= least], same[same >= least]
    return left, same


def full_sets(docs: DataFrame, reps: DataFrame, k: int, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``(rep, set binary)`` of the classes ``reps (rep, doc_id, d1, d2)``, from a document of each."""

    def answer(batches):
        for batch in batches:
            for words in word_batches(batch.column(1).to_pylist()):
                shingles, sizes = shingle_sets(words, k)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, len(words)), *map(pa.array, digests(shingles, sizes)), pa.array([shingles[e - n : e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], ["doc_id", "d1", "d2", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(reps.select("doc_id"), "doc_id", "left_semi")
    found = rows.mapInArrow(answer, "doc_id long, d1 long, d2 long, set binary").join(reps.select("rep", "doc_id", "d1", "d2"), ["doc_id", "d1", "d2"])
    return found.select("rep", "set").dropDuplicates(["rep"])  # those of one class are equal


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold; sizes too unlike decide without a look at the members."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` whose full sets reach the threshold."""

    def compare(batches):
        for batch in batches:
            at = pa.array(np.flatnonzero([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    one = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    two = one.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    return two.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def pooled(pools: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components ``c`` inside each pool ``(rep, pool, c)``, block against block.

    A pool's members are dealt to blocks of bounded size; each pair of blocks is a group of
    its own, which prunes by signatures, confirms survivors on full sets and returns links
    that join what it has not joined yet.
    """
    bounds = least_matches(percent)
    full = settle(pools.join(sigs, "rep").join(sets, "rep"))
    counts = full.groupBy("pool").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("set")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    sent = in_blocks(full, counts).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("pool", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "c", "sig", "set")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame.i.iloc[0], frame.j.iloc[0]
        a, b = frame[frame.block == i].sort_values("rep"), frame[frame.block == j].sort_values("rep")
        out, joined = [], {}
        if len(a) and len(b):
            x, y = (np.frombuffer(b"".join(s.sig), np.uint32).reshape(-1, SIZE) for s in (a, b))
            size = [np.array([len(s) // 8 for s in side.set], np.int64) for side in (a, b)]
            open_pairs = a.c.to_numpy()[:, None] != b.c.to_numpy()[None, :]
            open_pairs &= 100 * np.minimum(size[0][:, None], size[1][None, :]) >= percent * np.maximum(size[0][:, None], size[1][None, :])
            u, v = np.nonzero(open_pairs)
            left, same = unpruned(x, y, u, v, bounds)
            order = np.argsort(-same, kind="stable")  # the likeliest first, so that most others are joined already
            ca, cb, ra, rb = a.c.to_numpy(), b.c.to_numpy(), a.rep.to_numpy(), b.rep.to_numpy()
            held = [[np.frombuffer(s, np.uint64) for s in side.set] for side in (a, b)]

            def root(c):
                while joined.get(c, c) != c:
                    c = joined[c]
                return c

            for p, q in zip(u[left][order].tolist(), v[left][order].tolist()):
                one, two = root(int(ca[p])), root(int(cb[q]))
                if one != two and linked(held[0][p], held[1][q], percent):
                    joined[max(one, two)] = min(one, two)
                    out.append((int(ra[p]), int(rb[q])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return sent.groupBy("pool", "i", "j").applyInPandas(compare, "a long, b long")


def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    one = pairs.join(comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    two = one.join(comps.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return two.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept, class, component, text_hash`` for every row of ``docs``.

    ``class`` and ``component`` name the set and all that it reaches; null for rows that are linked with nothing.
    """
    with tidy(docs.sparkSession) as keep:
        base = settle(describe(docs, k, id_col=id_col, text_col=text_col).withColumn("class", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("d1", "d2", "n_shingles"))))
        classes = settle(base.where("class IS NOT NULL").groupBy(F.col("class").alias("rep"), "d1", "d2", "n_shingles").agg(F.min("doc_id").alias("doc_id")))
        sigs = settle(base.select("class", "doc_id", "sig").join(classes.select("rep", "doc_id"), ["doc_id"]).where("class = rep").select("rep", "sig").dropDuplicates(["rep"]))

        width = 4 * SIZE // BANDS
        band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
        rows = sigs.select("rep", F.explode(band).alias("key"))
        ends = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
        members = settle(rows.join(ends, "key"))
        first = members.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("rep").alias("b")), F.struct(F.col("rep").alias("a"), F.col("high").alias("b")))).alias("p")).select("p.*").where("a < b").distinct()
        alike = settle(likely(first, sigs, percent))

        ids = members.select("rep").distinct()
        sets = settle(full_sets(docs, classes.join(ids, "rep", "left_semi"), k, id_col=id_col, text_col=text_col))
        # the likeliest partner of each member, ties to the one with the least hash
        best = alike.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("p"), "same").select("p.*", "same")
        best = best.groupBy("u").agg(F.max_by("v", F.col("same").cast("long") * (1 << 32) - F.pmod(F.xxhash64("v"), F.lit(1 << 31))).alias("v"))
        tree = best.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        links = settle(confirmed(tree, sets, percent))
        comps = components(links)
        links = settle(links.union(confirmed(across(alike, comps), sets, percent)))
        comps = components(links)

        # what is left: pairs of one bucket in different components
        placed = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
        split = placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).where("c1 < c2").select("key", "low", "n")
        open_rows = settle(placed.join(split, "key"))
        pools = components(open_rows.where(F.col("n") > LARGE).select(F.col("low").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("pool"))
        small = open_rows.where(F.col("n") <= LARGE).join(pools, "rep", "left").select("key", "rep", "c", "pool")
        left, right = (small.select("key", F.col("rep").alias(end), F.col("c").alias(f"c_{end}"), F.col("pool").alias(f"pool_{end}")) for end in "ab")
        cross = left.join(right, "key").where("a < b AND c_a != c_b AND NOT coalesce(pool_a = pool_b, false)").select("a", "b").distinct()
        late = confirmed(likely(cross.join(first, ["a", "b"], "left_anti"), sigs, percent), sets, percent)
        within = pools.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "pool", F.coalesce("component", "rep").alias("c"))
        late = settle(late.union(pooled(within, sigs, sets, percent)))
        if not late.isEmpty():
            comps = components(links.union(late))

        placed = classes.join(comps, F.col("rep") == F.col("node"), "left").select("rep", F.col("doc_id").alias("class_id"), F.coalesce("component", "rep").alias("component"))
        least = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
        named = base.drop("sig").join(placed.join(least, "component"), F.col("class") == F.col("rep"), "left")
        component_id = F.coalesce("component_id", "doc_id")
        return keep(named.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"), "class", "component", "text_hash"))


def deduplicated(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """One row of each component: that with the least id (then set, then text), of equal ones the least by its other columns.

    Rows without an id or without a word are copies of nothing and stay.
    """
    found = near_duplicates(docs, k=k, percent=percent, id_col=id_col, text_col=text_col).where("class IS NOT NULL")
    chosen = found.groupBy("component").agg(F.min(F.struct("doc_id", "class", "text_hash")).alias("c")).select(F.col("c.doc_id").alias("__id"), F.col("c.text_hash").alias("__text"))
    keyed = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__text", F.xxhash64(text_col))
    columns, ordered = ([f"`{f.name}`" for f in docs.schema if every or f.dataType.typeName() not in ("map", "variant")] for every in (True, False))
    least = F.min(F.struct(*columns)) if len(columns) == len(ordered) else F.min_by(F.struct(*columns), F.struct(*ordered))
    one = keyed.join(chosen, ["__id", "__text"], "left_semi").groupBy("__id", "__text").agg(least.alias("__row")).select("__row.*")
    alone = F.col(id_col).isNull() | (F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(BLANKS)) == "")
    return one.union(docs.where(alone))


def op5_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least_of AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_of l ON l.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
