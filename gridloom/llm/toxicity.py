"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or not: words (without punctuation), pairs of neighbours and pairs one or two words apart,
hashed into ``2**BITS`` places. FTRL-proximal gives each place its own learning rate and
sets those without lasting evidence to exactly 0, so the model that executors get is the
short list of the others. Training goes over a bounded sample of labelled documents
(``TRAIN_DOCS``, ``labelled.SAMPLE_BYTES``) in one task, in an order fixed by hash; scoring
reads every whole text. Rates and L1 are those of the least log-loss on a fifth of the
training labels (remainder 1 of the split by five), after training on the other three.

Cases: null and empty texts have no features and get the score of the bias alone; without
labelled documents every score is 0. Repeated rows are scored each. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import crc_mod, table
from gridloom.llm.labelled import labelled_sample
from gridloom.llm.textcodes import word_batches

BITS = 20
TRAIN_DOCS = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 1.0
GAPS = (0, 1, 2)


def features(words):
    """Places of the features of every text, with repeats, and where each kind's begin."""
    shift = np.uint64(64 - BITS)
    yield (words.hashes >> shift).astype(np.int32), words.start
    for gap in GAPS:
        grams, start = words.grams(2, gap)
        yield (grams >> shift).astype(np.int32), start


def presence(words) -> list[np.ndarray]:
    """The distinct places of each text."""
    kinds = list(features(words))
    return [np.unique(np.concatenate([f[s[k] : s[k + 1]] for f, s in kinds])) for k in range(len(words))]


class FTRL:
    """Follow the regularised leader, with present features only and an unregularised bias."""

    def __init__(self, size: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias, self.bias_n = 0.0, 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_n += g * g
        self.bias -= self.alpha / (self.beta + np.sqrt(self.bias_n)) * g


def train(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Places, their weights and the bias. ``sample``: ``(doc_id, text, label)``, bounded; None if it is empty."""

    def fit(batches):
        model, seen = FTRL(1 << BITS), []
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for words in word_batches(batch.column(0).to_pylist(), marks=False):
                for at, label in zip(presence(words), labels[words.first : words.first + len(words)]):
                    seen.append((at, label))
                    model.learn(at, label)
        for _ in range(EPOCHS - 1):
            for at, label in seen:
                model.learn(at, label)
        if seen:
            w = model.weights(slice(None))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()]), pa.array([w[at].astype("<f4").tobytes()]), pa.array([float(model.bias)])], ["at", "w", "bias"])

    rows = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("order"), "doc_id"), "doc_id", "text").select("text", "label").mapInArrow(fit, "at binary, w binary, bias double").collect()
    return (np.frombuffer(rows[0].at, "<i4"), np.frombuffer(rows[0].w, "<f4"), rows[0].bias) if rows else None


def score(docs: DataFrame, model, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches):
        dense = np.zeros(1 << BITS, np.float32)
        if shared.value:
            dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for words in word_batches(texts, marks=False):
                logit = np.zeros(len(words))
                if shared.value:
                    doc, at = [], []
                    for found, start in features(words):  # only features with a weight need telling apart
                        hit = np.flatnonzero(dense[found])
                        at.append(found[hit])
                        doc.append(np.searchsorted(start, hit, "right") - 1)
                    pair = np.unique(np.concatenate(doc).astype(np.int64) << BITS | np.concatenate(at))
                    logit = shared.value[2] + np.bincount(pair >> BITS, dense[pair & ((1 << BITS) - 1)], len(words))
                p = 1 / (1 + np.exp(-np.clip(logit, -35, 35))) if shared.value else logit
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, len(words)), pa.array(p)], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(answer, f"doc_id {kind}, score double")


def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(labelled_sample(docs, labels.where(crc_mod("doc_id", 5) != 0), "toxic", TRAIN_DOCS))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
