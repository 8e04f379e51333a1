"""Language identification by mixture inference.

A model of hashed byte 4-grams of words is counted per language over all training
documents. A word's likelihood under a language is the product over its grams; a text is a
mixture of words from several languages, and expectation-maximisation estimates the
proportions. The set of languages is chosen among the nested sets of most likely languages
by log-likelihood less ``penalty`` per language, so a text gets a second language only if
that explains enough of its words. Sets grow to all languages; a text is left out only of
those too large to win (a fit is at most 0, each word being measured against its best).

All training documents are counted in their tasks (one sparse table per task and language
is sent on, and summed by Spark); the model has ``languages x 2**BITS`` entries and is what
the executors get. Up to ``MODEL_CELLS`` they are broadcast as they are; with more languages
than that allows, grams share buckets (half as many for each doubling).

Cases: a null text or one without a letter is ``und`` with score 0; null languages are not
learned; without any training text every text is ``und``. Rows with a null id are answered, not
learned, and their ``held_out`` is null. Texts are read whole. Repeated
rows are answered each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import crc_mod, table
from gridloom.llm.textcodes import _BLANK, _LOWER, Words, word_batches

BITS = 16
MODEL_CELLS = 1 << 26
SMOOTH = 0.1
PENALTY = 4.0
ROUNDS, SET_ROUNDS = 8, 8
UND = "und"
_LETTER = regex.compile(r"\p{L}")


def _grams(words: Words, pick: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte 4-grams of some words with a blank on either side, and where each word's begin."""
    b = np.frombuffer(b" " + words.data + b"   ", np.uint8)
    b = np.where(_BLANK[b], 32, _LOWER[b]).astype(np.uint32)
    code = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    begin, size = words.begin[pick], words.end[pick] - words.begin[pick]
    n = np.maximum(size - 1, 1)
    start = np.cumsum(n) - n
    code = code[np.arange(n.sum()) + np.repeat(begin - start, n)]
    short = start[size == 1]  # their fourth byte is not theirs
    code[short] = code[short] & np.uint32(0xFFFFFF) | np.uint32(32 << 24)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), start


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, pick, which, count = np.unique(words.hashes, return_index=True, return_inverse=True, return_counts=True)
    return pick, which, count


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities of gram buckets under each. ``docs``: ``(text, lang)``."""
    docs, bits = docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL"), BITS
    languages = docs.select("lang").distinct().count()
    while bits and languages << bits > MODEL_CELLS:
        bits -= 1

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang", sort=False):
                own = tables.setdefault(lang, np.zeros(1 << bits, np.int64))
                for words in word_batches(part.text.tolist()):
                    if len(words.hashes):
                        pick, _, n = _distinct(words)
                        bucket, start = _grams(words, pick, bits)
                        own += np.bincount(bucket, np.repeat(n, np.diff(start, append=len(bucket))), 1 << bits).astype(np.int64)
        for lang, own in tables.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": own[at]}), preserve_index=False)

    rows = docs.mapInArrow(count, "lang string, bucket int, n long")
    # at most MODEL_CELLS rows, a list a language
    summed = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n")).toPandas().sort_values("lang")
    counts = np.zeros((len(found), 1 << bits))
    for k, (buckets, n) in enumerate(zip(found.buckets, found.n)):
        counts[k, np.asarray(buckets, int)] = n
    logp = np.log((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * counts.shape[1]))
    return found.lang.tolist(), logp.astype(np.float32)


def _em(like: np.ndarray, weight: np.ndarray, doc: np.ndarray, begin: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds, and log-likelihoods. ``theta`` 0 keeps a language out."""
    total = np.add.reduceat(weight, begin)[:, None]
    for _ in range(rounds):
        part = like * theta[doc]
        part *= (weight / np.maximum(part.sum(1), 1e-30))[:, None]
        theta = np.add.reduceat(part, begin, axis=0) / total
    fit = np.log(np.maximum((like * theta[doc]).sum(1), 1e-30)) * weight
    return theta, np.add.reduceat(fit, begin)


def infer(words: Words, logp: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of each language in each text; all 0 where a text has no word."""
    n, k = len(words), len(logp)
    out = np.zeros((n, k), np.float32)
    if not len(words.hashes) or not k:
        return out
    pick, which, _ = _distinct(words)
    bucket, start = _grams(words, pick, logp.shape[1].bit_length() - 1)
    loglike = np.stack([np.add.reduceat(row[bucket], start) for row in logp], 1)
    # against the best language, and held above e**-30 so that one odd word decides nothing
    like = np.exp(np.maximum(loglike - loglike.max(1, keepdims=True), -30)).astype(np.float32)
    pair, weight = np.unique(words.doc_of() * len(pick) + which, return_counts=True)
    doc, word = pair // len(pick), pair % len(pick)
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    which_doc = doc[begin]
    doc = np.cumsum(np.diff(doc, prepend=doc[0]) > 0)
    like, weight = like[word], weight.astype(np.float32)
    theta, _ = _em(like, weight, doc, begin, np.full((len(begin), k), 1 / k, np.float32), ROUNDS)
    order = np.argsort(-theta, axis=1, kind="stable")
    best, best_score = None, None
    for size in range(1, k + 1):
        allowed = np.zeros_like(theta)
        np.put_along_axis(allowed, order[:, :size], np.float32(1 / size), 1)
        if best is None:
            best, fit = _em(like, weight, doc, begin, allowed, 0)
            best_score = fit - penalty
            continue
        able = best_score < -penalty * size
        if not able.any():
            break
        rows, at = able[doc], (np.cumsum(able) - 1)[doc]
        at = at[rows]
        fitted, fit = _em(like[rows], weight[rows], at, np.flatnonzero(np.diff(at, prepend=-1)), allowed[able], SET_ROUNDS)
        score = fit - penalty * size
        better = score > best_score[able]
        which = np.flatnonzero(able)[better]
        best[which], best_score[which] = fitted[better], score[better]
    out[which_doc] = best
    return out


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray, *, id_col="doc_id", text_col="text", penalty: float = PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score, langs array<string>, shares array<double>`` for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))

    def answer(batches):
        names, own = model.value
        names = np.array([*names, UND], object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for words in word_batches(texts):
                here = texts[words.first : words.first + len(words)]
                theta = infer(words, own, penalty)
                lettered = np.array([t is not None and _LETTER.search(t) is not None for t in here]) & (theta.sum(1) > 0) if len(own) else np.zeros(len(here), bool)
                top = theta.argmax(1) if len(own) else np.zeros(len(here), int)
                score = np.where(lettered, np.clip(theta.max(1), 0, 1), 0.0) if len(own) else np.zeros(len(here))
                sets = [np.flatnonzero(row > 0.001) if ok else [] for row, ok in zip(theta, lettered)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, len(words)), pa.array(names[np.where(lettered, top, len(names) - 1)].tolist(), pa.string()), pa.array(score.astype(np.float64)), pa.array([names[s].tolist() if len(s) else [] for s in sets], pa.list_(pa.string())), pa.array([row[s].astype(float).tolist() if len(s) else [] for row, s in zip(theta, sets)], pa.list_(pa.float64()))],
                    ["doc_id", "lang_pred", "score", "langs", "shares"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(answer, f"doc_id {kind}, lang_pred string, score double, langs array<string>, shares array<double>")


def op1_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    langs, logp = train(docs.where(crc_mod("doc_id", 4) != 2).select("text", "lang"))
    return identify(docs, langs, logp).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "langs", "shares")
