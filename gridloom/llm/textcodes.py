"""Hashes of the words of many texts at once, in numpy.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. The
64-bit hash of a word is a polynomial over random byte values, computed for all words of a
batch by one segmented sum, then mixed with the length. Batches are cut so that memory
stays bounded; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BATCH_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.ones(256, bool)
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = _MARK[128:] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = _VALUE[_LOWER]
_VALUE[_BLANK] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BATCH_BYTES + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of texts ``first .. first + n - 1`` of a batch; those of text k are ``start[k]:start[k + 1]``."""

    first: int
    hashes: np.ndarray
    start: np.ndarray
    begin: np.ndarray  # byte positions in ``data``
    end: np.ndarray
    data: bytes

    def __len__(self) -> int:
        return len(self.start) - 1

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def grams(self, n: int, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``n`` words in a row (or of word pairs ``gap`` words apart), and where each text's begin."""
        span = n + gap
        h, count = self.hashes, np.maximum(np.diff(self.start) - (span - 1), 0)
        start = np.concatenate([[0], np.cumsum(count)])
        if not start[-1]:
            return np.empty(0, np.uint64), start
        m = len(h) - span + 1
        acc = np.zeros(m, np.uint64)
        for k in range(n):
            at = k if not gap or k < n - 1 else span - 1
            acc += h[at : at + m] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1) + 2 * gap) & (2**64 - 1) | 1)
        ok = np.ones(m, bool)
        for s in range(1, span):  # those that run over the end of a text
            cut = self.start[1:-1] - s
            ok[cut[(cut >= 0) & (cut < m)]] = False
        return mix(acc[ok]), start


def word_batches(texts: list, limit: int = BATCH_BYTES, marks: bool = True) -> Iterator[Words]:
    """``marks``: whether ASCII punctuation belongs to words; else it separates them."""
    first = 0
    while first < len(texts):
        parts, size, k = [], 0, first
        while k < len(texts) and (not parts or size < limit):
            parts.append((texts[k] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            k += 1
        yield _words(first, parts, _BLANK if marks else _MARK)
        first = k


def _words(first: int, parts: list[bytes], apart: np.ndarray) -> Words:
    data = b"\n".join(parts) + b"\n"
    b = np.frombuffer(data, np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    inside = ~apart[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(b) and inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return Words(first, np.empty(0, np.uint64), np.zeros(len(parts) + 1, np.int64), begin, end, data)
    up, down = _power_tables(len(b))
    value = _VALUE[b]
    value *= up
    if apart is not _BLANK:
        value *= inside
    h = np.add.reduceat(value, begin) * down[begin]
    h = mix(h + (end - begin).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return Words(first, h, np.searchsorted(begin, bounds).astype(np.int64), begin, end, data)
