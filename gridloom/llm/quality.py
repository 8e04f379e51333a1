"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Texts become counts of ``DIMS`` terms: hashed words, and word shapes (letters, digits and
marks, runs cut short) with how often words repeat. Counts are damped, weighted by inverse
document frequency over all documents, and projected on the leading singular directions of
a bounded sample of labelled documents (``TRAIN_DOCS``). Executors get that projection and
the labelled vectors; every document is compared with all of them by exact products in
blocks, and its ``NEIGHBOURS`` nearest vote with their similarity.

A document of the sample is among its own neighbours, as ids are no input of a score: scores
of ids that labels were learned from are not held-out ones.

Cases: null and empty texts have a zero vector and get the share of label 1 among all
labelled vectors, as do texts unlike all; without labelled documents every score is 0.
Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import crc_mod, table
from gridloom.llm.labelled import labelled_sample
from gridloom.llm.textcodes import _power_tables, mix, word_batches

WORD_DIMS, SHAPE_DIMS, TALLY_DIMS = 3072, 992, 32
DIMS = WORD_DIMS + SHAPE_DIMS + TALLY_DIMS
SHAPE_WEIGHT = 3.0
TRAIN_DOCS = 6_000
RANK = 64
NEIGHBOURS = 25
BLOCK_DOCS = 256

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE_VALUE = mix(np.arange(1001, 1257, dtype=np.uint64))


def _shapes(words) -> np.ndarray:
    """Hash of each word's shape: the run-length-free sequence of its kinds of byte."""
    b = _SHAPE[np.frombuffer(words.data, np.uint8)]
    before = np.concatenate([[0], b[:-1]])
    value = np.where(b != before, _SHAPE_VALUE[b], np.uint64(0))
    value[words.begin] = _SHAPE_VALUE[b[words.begin]]
    gone = np.concatenate([[0], np.cumsum(value != 0)])
    up, down = _power_tables(len(b) + 1)
    turn = gone[:-1]  # number of kinds before this byte
    value = value * up[turn]
    edges = np.stack([words.begin, words.end], 1).ravel()
    sums = np.add.reduceat(np.append(value, np.uint64(0)), edges)[::2]
    return mix(sums * down[turn[words.begin]])


def term_counts(words, shapes: np.ndarray) -> np.ndarray:
    """Counts of terms, ``len(words) x DIMS``. ``shapes``: those of the words."""
    n = len(words)
    if not len(words.hashes):
        return np.zeros((n, DIMS), np.float32)
    doc = words.doc_of()
    at = doc * DIMS + (words.hashes % np.uint64(WORD_DIMS)).astype(np.int64)
    shape = doc * DIMS + WORD_DIMS + (shapes % np.uint64(SHAPE_DIMS)).astype(np.int64)
    out = np.bincount(np.concatenate([at, shape]), minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
    size = np.diff(words.start)
    pair = np.unique(words.hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    fresh = np.bincount(doc[pair], minlength=n)
    some = size > 0
    ratio = np.where(some, fresh / np.maximum(size, 1), 0)
    rows = np.flatnonzero(some)
    out[rows, WORD_DIMS + SHAPE_DIMS + np.minimum((ratio[rows] * 16).astype(int), 15)] = np.sqrt(size[rows])
    out[rows, WORD_DIMS + SHAPE_DIMS + 16 + np.minimum(np.log2(size[rows]).astype(int), 15)] = 1
    return out


def _blocks(texts: list, limit: int = BLOCK_DOCS):
    """``(first, counts)`` of a few hundred texts at a time."""
    for words in word_batches(texts):
        shapes = _shapes(words) if len(words.hashes) else words.hashes
        for k in range(0, len(words), limit):
            part = _part(words, k, min(k + limit, len(words)))
            yield words.first + k, term_counts(part, shapes[words.start[k] : words.start[k] + len(part.hashes)])


def _part(words, a: int, b: int):
    if a == 0 and b == len(words):
        return words
    s, e = words.start[a], words.start[b]
    return type(words)(words.first + a, words.hashes[s:e], words.start[a : b + 1] - s, words.begin[s:e], words.end[s:e], words.data)


def document_frequency(docs: DataFrame, text_col="text") -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents there are."""

    def count(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, counts in _blocks(batch.column(0).to_pylist()):
                df += (counts > 0).sum(0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(np.append(df, n))], ["term", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIMS + 1)
    out[rows.term.to_numpy(int)] = rows.n
    return out[:-1], int(out[-1])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    idf = np.log((n + 1) / (df + 1)) + 0.1
    idf[WORD_DIMS:] *= SHAPE_WEIGHT
    return idf.astype(np.float32)


def fit(sample: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Projection, labelled unit vectors and labels. ``sample``: ``(doc_id, text, label)``, bounded; None if it is empty."""
    shared = sample.sparkSession.sparkContext.broadcast(idf)

    def solve(batches):
        rows, labels = [], []
        for batch in batches:
            labels += batch.column(1).to_pylist()
            rows += [weigh(counts, shared.value) for _, counts in _blocks(batch.column(0).to_pylist())]
        if not rows:
            return
        x = np.concatenate(rows)
        q = np.random.default_rng(7).standard_normal((DIMS, RANK + 16)).astype(np.float32)
        for _ in range(4):  # subspace iteration
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        project = (q @ v.T)[:, :RANK].astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([project.tobytes()]), pa.array([_unit(x @ project).astype("<f4").tobytes()]), pa.array([np.array(labels, "<f4").tobytes()])], ["project", "vectors", "labels"])

    rows = sample.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "label").mapInArrow(solve, "project binary, vectors binary, labels binary").collect()
    if not rows:
        return None
    project = np.frombuffer(rows[0].project, "<f4").reshape(DIMS, -1)
    return project, np.frombuffer(rows[0].vectors, "<f4").reshape(-1, project.shape[1]), np.frombuffer(rows[0].labels, "<f4")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the k nearest known vectors, weighted by cosine."""
    k = min(k, len(known))
    sims = vectors @ known.T
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64)
    total = w.sum(1)
    return np.where(total > 1e-9, (w * labels[near]).sum(1) / np.maximum(total, 1e-9), labels.mean())


def score(docs: DataFrame, model, idf: np.ndarray, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, idf))

    def answer(batches):
        own, weights = shared.value
        for batch in batches:
            for first, counts in _blocks(batch.column(1).to_pylist()):
                p = np.zeros(len(counts)) if own is None else np.clip(vote(_unit(weigh(counts, weights) @ own[0]), own[1], own[2]), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(p.astype(np.float64))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(answer, f"doc_id {kind}, score double")


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAIN_DOCS):
    """Model and term weights, learned from ``labels`` whose crc32 of the id mod 5 is not 0."""
    idf = inverse_frequency(*document_frequency(docs))
    return fit(labelled_sample(docs, labels.where(crc_mod("doc_id", 5) != 0), label, bound), idf), idf


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``."""
    return score(docs, *fitted(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, judged where they are read; all of them without a model."""
    model, idf = fitted(docs, labels)
    if model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast((model, idf)), docs.columns.index("text")

    def keep(batches):
        own, weights = shared.value
        for batch in batches:
            for first, counts in _blocks(batch.column(at).to_pylist()):
                p = vote(_unit(weigh(counts, weights) @ own[0]), own[1], own[2])
                yield batch.slice(first, len(counts)).filter(pa.array(p >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op9_quality(spark, sf_dir):
    scored = train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
