"""Benchmark decontamination: q-gram lemma filter in diagonal bands, banded alignment.

A benchmark item is cut into windows of two sizes: up to ``WINDOW`` characters, overlapping
by half, and ``SHORT`` characters, one every ``STRIDE``; a document leaks an item if it holds
a window within ``edits(window)`` edits. So every verbatim passage of ``SHORT + STRIDE - 1``
(74) characters of an item is found wherever it begins, and items of ``MIN_CHARS`` to
``WINDOW`` characters are looked for whole as well. Shorter items, down to the ``Q``
characters that the filter needs, are looked for as phrases: exact, with the ends of words
at their own. Texts are compared in a plain form: lower case, anything but letters and
digits a single blank.

* A window of m characters within e edits of a stretch of text shares at least
  ``m + 1 - q - q * e`` of its q-grams with it (the q-gram lemma), all on diagonals (place
  in the text less place in the window) no more than e apart. Shared q-grams are counted in
  bands of 2e + 1 diagonals that overlap by half, so every such stretch falls whole into
  one band.
* Stretches of a band that reach the bound are verified by alignment inside the band.

The q-gram index of the benchmark is what executors get. It is built for blocks of items
whose index takes about ``INDEX_BYTES``; a larger benchmark takes several scans of the
documents.

Cases: null and empty texts leak nothing; an item whose plain form is shorter than ``Q``
characters (a word or two, which clean texts hold) is not looked for, a null item neither;
repeated rows are answered each. An empty documents or benchmark table gives an empty
result. Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table

Q = 10
WINDOW = 120
SHORT, STRIDE = 60, 15
MIN_CHARS = 40
EDIT_SHARE = 0.08
#: Of the index of a block of items, and of what a character of an item adds to it.
INDEX_BYTES, BYTES_A_CHAR = 128 << 20, 64
SLICE_CHARS = 1 << 20
_COUNT_BITS = 20
_END = np.uint32(0xFFFFFFFF)  # after each text
_alnum: list[np.ndarray] = []


def plain_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all plain forms, ``_END`` after each, and the place after each end."""
    if not _alnum:
        _alnum.append(np.array([chr(c).isalnum() for c in range(0x110000)]))
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(t + "\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum([len(t) + 1 for t in low]) - 1
    sign = _alnum[0][codes]
    sign[end] = False
    keep = sign | np.concatenate([[False], sign[:-1]])  # the first other character after a word is its blank
    keep[end] = True
    out = np.where(sign, codes, np.uint32(32))
    out[end] = _END
    return out[keep], np.cumsum(keep)[end]


def plain(text: str | None) -> str:
    return plain_codes([text])[0][:-1].tobytes().decode("utf-32-le", "surrogatepass").strip()


def edits(m: int) -> int:
    """Edits allowed in a window of m characters; the q-gram lemma leaves at least a few q-grams."""
    return max(0, min(int(m * EDIT_SHARE), (m + 1 - Q) // Q - 1))


def windows_of(text: str) -> list[str]:
    """The windows of both sizes; each size covers ``text``, and a shorter text is one."""
    out = []
    for size, stride in ((WINDOW, WINDOW // 2), (SHORT, STRIDE)):
        starts = [*range(0, len(text) - size, stride), max(len(text) - size, 0)]
        out += [text[s : s + size] for s in starts]
    return list(dict.fromkeys(out))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _qgrams(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h *= np.uint64(0x100000001B3)
        h += codes[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Index:
    items: list[int]
    windows: list[str]
    item_of: np.ndarray
    phrase: np.ndarray  # whether a window is a short item, to be found as it is
    bound: np.ndarray  # shared q-grams that a window needs
    budget: np.ndarray
    distinct: np.ndarray  # q-grams in order; where their entries begin, how many there are
    first: np.ndarray
    count: np.ndarray
    window: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    shift: np.uint64  # of a q-gram to its place in the filter


def build_index(items: list[tuple[int, str]]) -> Index | None:
    ids, windows, item_of = [], [], []
    for k, (i, text) in enumerate(items):
        ids.append(i)
        own = plain(text)
        if len(own) >= Q:
            for w in windows_of(own):
                windows.append(w)
                item_of.append(k)
    if not windows:
        return None
    grams = [_qgrams(_codes(w)) for w in windows]
    n = np.array([len(g) for g in grams])
    flat = np.concatenate(grams)
    order = np.argsort(flat, kind="stable")
    distinct, count = np.unique(flat, return_counts=True)
    window, place = np.repeat(np.arange(len(windows), dtype=np.int32), n), np.concatenate([np.arange(x, dtype=np.int32) for x in n])
    phrase = np.array([len(w) < MIN_CHARS for w in windows])
    budget = np.array([0 if short else edits(len(w)) for w, short in zip(windows, phrase)])
    shift = np.uint64(64 - min(25, max(16, len(distinct).bit_length() + 3)))  # at most about an eighth of the filter is set
    bits = np.zeros(1 << (64 - int(shift)), bool)
    bits[(distinct >> shift).astype(np.int64)] = True
    return Index(ids, windows, np.array(item_of), phrase, np.maximum(n - Q * budget, 1), budget, distinct, (np.cumsum(count) - count).astype(np.int32), count.astype(np.int32), window[order], place[order], bits, shift)


def banded_distance(pattern: np.ndarray, text: np.ndarray, diagonal: int, width: int, limit: int) -> int:
    """Least edits between ``pattern`` and any stretch of ``text`` on diagonals ``diagonal .. diagonal + width - 1``; ``limit + 1`` if more than ``limit``.

    One row of the alignment table a character of the pattern; cell j of a row is on
    diagonal ``diagonal + j``.
    """
    far = limit + 1
    at = diagonal + np.arange(width)
    row = np.where((at >= 0) & (at <= len(text)), 0, far)  # an alignment may begin anywhere
    padded = np.concatenate([np.full(max(0, -diagonal), 0xFFFFFFFF, np.uint32), text[max(0, diagonal) : max(0, diagonal + len(pattern) + width)]])
    padded = np.concatenate([padded, np.full(max(0, len(pattern) + width - len(padded)), 0xFFFFFFFF, np.uint32)])
    steps = np.arange(width)
    for i, c in enumerate(pattern):
        match = row + (padded[i : i + width] != c)  # same diagonal
        skip = np.append(row[1:], far) + 1  # a character of the pattern left out
        best = np.minimum(match, skip)
        row = np.minimum(np.minimum.accumulate(best - steps) + steps, far)  # characters of the text left out
        if row.min() >= far:
            return far
    return int(row.min())


def find(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int]]:
    """``(text number, item number, place, edits)`` of the best verified window of each leaked item.

    ``place``: where the band that holds the match begins in the plain text; the match begins at most ``edits(WINDOW)`` characters on.
    """
    found: dict[tuple[int, int], tuple[int, int]] = {}
    first = 0
    while first < len(texts):
        size, k = 0, first
        while k < len(texts) and (k == first or size < SLICE_CHARS):
            size += len(texts[k] or "") + 1
            k += 1
        _find(texts[first:k], first, index, found)
        first = k
    return [(d, i, at, e) for (d, i), (e, at) in sorted(found.items())]


def _find(texts: list[str | None], first: int, index: Index, found: dict) -> None:
    codes, bounds = plain_codes(texts)
    grams = _qgrams(codes)
    at = np.flatnonzero(index.filter[(grams >> index.shift).astype(np.int64)])
    if not len(at):
        return
    slot = np.minimum(np.searchsorted(index.distinct, grams[at]), len(index.distinct) - 1)
    real = index.distinct[slot] == grams[at]
    at, slot = at[real], slot[real]
    low, n = index.first[slot].astype(np.int64), index.count[slot].astype(np.int64)
    hit = np.repeat(low + n - np.cumsum(n), n) + np.arange(n.sum())
    place, window = np.repeat(at, n), index.window[hit].astype(np.int64)
    if not len(hit):
        return
    diagonal = place - index.place[hit]
    # the bands: of 2e + 1 diagonals, one every e + 1; a hit is in two at most
    step = index.budget[window] + 1
    band = diagonal // step
    key = np.concatenate([window * (1 << 40) + (band + (1 << 20)), window * (1 << 40) + (band - 1 + (1 << 20))])
    # most bands hold few hits: a count in hashed cells, never below the band's own, rules them out
    cell = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _COUNT_BITS)).astype(np.int64)
    busy = np.bincount(cell, minlength=1 << _COUNT_BITS)[cell] >= np.tile(index.bound[window], 2)
    # a place in the window counts once a band
    pair = _distinct_pairs(key[busy], np.tile(index.place[hit], 2)[busy])
    keys, counts = np.unique(pair[:, 0], return_counts=True)
    window = keys >> 40
    keep = counts >= index.bound[window]
    for k, w in zip(keys[keep].tolist(), window[keep].tolist()):
        budget = int(index.budget[w])
        start = ((k & ((1 << 40) - 1)) - (1 << 20)) * (budget + 1)
        pattern = _codes(index.windows[w])
        d = int(np.searchsorted(bounds, max(start + len(pattern) // 2, 0), "right"))
        d = min(d, len(texts) - 1)
        begin = int(bounds[d - 1]) if d else 0
        name = (first + d, int(index.item_of[w]))
        best = found.get(name)
        if best is not None and best[0] == 0:
            continue
        if index.phrase[w]:
            after = start + len(pattern)
            if start >= begin and np.array_equal(codes[start:after], pattern) and (start == begin or codes[start - 1] == 32) and codes[after] in (32, _END):
                found[name] = (0, start - begin)
            continue
        # e diagonals more on either side, where an alignment in the band may go
        e = banded_distance(pattern, codes[begin : bounds[d] - 1], start - begin - budget, 4 * budget + 2, budget)
        if e <= budget and (best is None or (e, start - begin) < best):
            found[name] = (e, max(start - begin, 0))


def _distinct_pairs(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    return np.stack([key[new], place[new]], 1)


def benchmark_blocks(benchmark: DataFrame, *, id_col="item_id", text_col="text", limit: int = INDEX_BYTES // BYTES_A_CHAR):
    """The items in lists of at most ``limit`` characters (or one item), read from the driver one partition at a time."""
    block, size = [], 0
    for row in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if block and size + len(row.t) > limit:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_id="item_id", item_text="text") -> DataFrame:
    """``doc_id, item_id, place, edits``: a row for each item that a document leaks."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, place int, edits int"
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kinds[1], pa.string())
    out = None
    for block in benchmark_blocks(benchmark, id_col=item_id, text_col=item_text):
        index = build_index(block)
        if index is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def answer(batches, shared=shared):
            for batch in batches:
                hits = find(batch.column(1).to_pylist(), shared.value)
                columns = list(zip(*hits)) if hits else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array([shared.value.items[k] for k in columns[1]], item_type), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["doc_id", "item_id", "place", "edits"])

        part = rows.mapInArrow(answer, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col="text") -> DataFrame:
    """``docs`` without the rows that leak an item, judged where they are read."""
    at = docs.columns.index(text_col)
    for block in benchmark_blocks(benchmark):
        index = build_index(block)
        if index is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[hit[0] for hit in find(batch.column(at).to_pylist(), shared.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op10_decontaminate(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
