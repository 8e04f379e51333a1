"""Token ids in patched frame-of-reference blocks.

A segment is a self-contained file image of consecutive documents, all little-endian:

====================  =========================================================
``GLT1``              magic
u32 x 3               documents, blocks, ids in a block
i64 x documents       document ids
u64 x documents       tokens of each document, end id included
u64 x (blocks + 1)    byte offset of each block from the first one (the index)
blocks
====================  =========================================================

A block holds up to ``block`` ids: u32 minimum, u8 width, u16 exceptions, u16 ids - 1, the
ids less the minimum packed at ``width`` bits (low bits of those that do not fit), then the
exceptions: u16 positions and u32 high parts. The width is that of the ``percentile`` of
the block's offsets, so a few outliers do not widen all.

Documents are range-partitioned by id and sorted, so segments ascend; Spark's writer stores
them as rows of a Parquet table in the shared folder. Its commit makes a rerun of a lost
task harmless, and no executor needs a file system of its own. ``start`` comes from sums
per range (one row each) and inside each range.

Cases: null and empty texts hold the end id only; null document ids come first; documents
with equal ids stay next to each other, each with a row of its own, in order of text. An
empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ensure_checkpoint_dir, partitions, table
from gridloom.llm.textcodes import _power_tables, mix

END_ID = 1
BLOCK = 1024
PERCENTILE = 90.0
SEGMENT_IDS = 1 << 18
MAGIC = b"GLT1"


# --- blocks


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = (ids - low).astype(np.uint64)
    width = int(np.percentile(rest, percentile, method="higher")).bit_length()
    over = np.flatnonzero(rest >> np.uint64(width))
    bits = ((rest[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return struct.pack("<IBHH", low, width, len(over), len(ids) - 1) + np.packbits(bits.ravel(), bitorder="little").tobytes() + over.astype("<u2").tobytes() + (rest[over] >> np.uint64(width)).astype("<u4").tobytes()


def unpack_block(data: bytes | memoryview) -> np.ndarray:
    low, width, n_over, n = struct.unpack_from("<IBHH", data)
    n += 1
    at = struct.calcsize("<IBHH")
    size = (n * width + 7) // 8
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
        padded = np.zeros((n, 32), np.uint8)
        padded[:, :width] = bits
        out = np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint64)
    else:
        out = np.zeros(n, np.uint64)
    at += size
    over = np.frombuffer(data, "<u2", n_over, at)
    out[over] |= np.frombuffer(data, "<u4", n_over, at + 2 * n_over).astype(np.uint64) << np.uint64(width)
    return (out + np.uint64(low)).astype(np.uint32)


def pack_blocks(ids: np.ndarray, block: int, percentile: float = PERCENTILE) -> list[bytes]:
    """``pack_block`` of each full block and of the rest, those of one width together."""
    full = len(ids) // block
    out: list = [None] * full
    grid = ids[: full * block].reshape(full, block)
    low = grid.min(1) if full else np.empty(0, np.uint32)
    rest = grid - low[:, None]
    nth = min(block - 1, int(np.ceil((block - 1) * percentile / 100)))
    widths = np.array([int(x).bit_length() for x in np.partition(rest, nth, axis=1)[:, nth]]) if full else np.empty(0, int)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        part = rest[rows]
        bits = np.unpackbits(part.astype("<u4").view(np.uint8).reshape(len(rows), block, 4), axis=2, bitorder="little")[:, :, :width]
        packed = np.packbits(bits.reshape(len(rows), block * width), axis=1, bitorder="little")
        high = part >> np.uint32(width) if width < 32 else np.zeros_like(part)
        for k, row, codes, over in zip(rows.tolist(), high, packed, high.astype(bool)):
            at = np.flatnonzero(over)
            out[k] = struct.pack("<IBHH", int(low[k]), width, len(at), block - 1) + codes.tobytes() + at.astype("<u2").tobytes() + row[at].astype("<u4").tobytes()
    return out + ([pack_block(ids[full * block :], percentile)] if len(ids) > full * block else [])


def unpack_blocks(view: memoryview, index: np.ndarray) -> np.ndarray:
    """All ids of the blocks that begin at ``index[:-1]``; those of one size and width together."""
    heads = [struct.unpack_from("<IBHH", view, a) for a in index[:-1].tolist()]
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (_, width, _, n) in enumerate(heads):
        groups.setdefault((width, n + 1), []).append(k)
    parts: list = [None] * len(heads)
    head = struct.calcsize("<IBHH")
    for (width, n), rows in groups.items():
        size = (n * width + 7) // 8
        codes = np.frombuffer(b"".join(bytes(view[index[k] + head : index[k] + head + size]) for k in rows), np.uint8).reshape(len(rows), size)
        wide = np.zeros((len(rows), n, 32), np.uint8)
        wide[:, :, :width] = np.unpackbits(codes, axis=1, bitorder="little", count=n * width).reshape(len(rows), n, width)
        values = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0].astype(np.uint32)
        for j, k in enumerate(rows):
            low, _, n_over, _ = heads[k]
            at = int(index[k]) + head + size
            over = np.frombuffer(view, "<u2", n_over, at)
            values[j][over] |= np.frombuffer(view, "<u4", n_over, at + 2 * n_over).astype(np.uint32) << np.uint32(width)
            parts[k] = values[j] + np.uint32(low)
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def pack_segment(doc_ids, counts, ids: np.ndarray, block: int = BLOCK) -> bytes:
    blocks = pack_blocks(ids, block)
    index = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = MAGIC + struct.pack("<III", len(doc_ids), len(blocks), block)
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(counts, "<u8").tobytes(), index.tobytes(), *blocks])


def segment_head(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """``(document ids, tokens of each, block offsets, byte position of the first block, ids in a block)``."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, blocks, block = struct.unpack_from("<III", data, 4)
    at = 16
    doc_ids, counts, index = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<u8", docs, at + 8 * docs), np.frombuffer(data, "<u8", blocks + 1, at + 16 * docs)
    return doc_ids, counts.astype(np.int64), index.astype(np.int64), at + 16 * docs + 8 * (blocks + 1), block


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document ids, tokens of each, all ids)``."""
    doc_ids, counts, index, at, _ = segment_head(data)
    view = memoryview(data)
    return doc_ids, counts, unpack_blocks(view, index + at)


def tokens_of(data: bytes, k: int) -> np.ndarray:
    """The ids of the k-th document of a segment; only the blocks that hold them are unpacked."""
    _, counts, index, at, block = segment_head(data)
    begin = int(counts[:k].sum())
    end = begin + int(counts[k])
    view = memoryview(data)
    first, last = begin // block, -(-end // block)
    ids = np.concatenate([unpack_block(view[at + index[b] : at + index[b + 1]]) for b in range(first, last)])
    return ids[begin - first * block : end - first * block]


# --- texts to ids


class PieceEncoder:
    """Ids of texts by a public tokenizer, each distinct piece encoded once.

    The tokenizer lower-cases, drops white space and takes runs of letters, single digits
    and runs of other signs, none of which depends on its neighbours. So pieces are cut in
    numpy, told apart by a 64-bit hash, and only new ones go to the library. That covers
    ASCII and the letters of U+00C0 to U+00FF; a chunk between blanks that has any other
    character, a contraction or a special token's opening goes to the library whole. The
    store is emptied when full, which costs time only.
    """

    PIECES = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.begin, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[str], odd: np.ndarray) -> None:
        """Encode new pieces: plain ones in one go, cut after each end of a word; odd chunks each by itself."""
        ids, sizes = [self.flat], np.empty(len(pieces), np.int64)
        plain = [x for x, o in zip(pieces, odd) if not o]
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        if plain:
            found = np.array(self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[found]) + 1
            if len(ends) != len(plain):
                raise ValueError("the tokenizer did not keep pieces apart")
            ids.append(found)
            sizes[: len(plain)] = np.diff(ends, prepend=0)
        if len(plain) < len(pieces):
            more = [e.ids for e in self.tokenizer.encode_batch_fast([x for x, o in zip(pieces, odd) if o], add_special_tokens=False)]
            sizes[len(plain) :] = [len(x) for x in more]
            ids.append(np.array([i for x in more for i in x], np.uint32))
        slots = len(self.size) + np.arange(len(pieces))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size, self.flat = np.concatenate([self.size, sizes]), np.concatenate(ids)
        keys, slots = np.concatenate([self.keys, keys[order]]), np.concatenate([self.slots, slots])
        by = np.argsort(keys)
        self.keys, self.slots = keys[by], slots[by]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text; and how many each text has."""
        parts = [(t or "").encode() for t in texts]
        data = b"\n".join(parts) + b"\n"
        b = np.frombuffer(data, np.uint8)
        kind, before, after = _KIND[b], np.concatenate([[10], b[:-1]]), np.concatenate([b[1:], [10]])
        ink = kind > 0
        trail = (before == 0xC3) & (b >= 0x80) & (b < 0xC0) & (b != 0x97) & (b != 0xB7)
        odd = (b >= 0x80) & (b != 0xC3) & ~trail | (b == 39) & (_KIND[after] == 1) | (b == 60) & (after == 124)
        low = np.where(trail & (b < 0x9F), b + 32, _LOWER[b]).astype(np.uint8)
        first = ink & (_KIND[before] == 0)
        start = ink & ((kind != _KIND[before]) | (kind == 2))
        odd_at = np.flatnonzero(odd)
        in_odd = np.zeros(len(b) + 1, np.int8)
        if len(odd_at):
            begin, end = np.flatnonzero(first), np.flatnonzero(ink & (_KIND[after] == 0)) + 1
            which = np.unique(np.searchsorted(begin, odd_at, "right") - 1)
            in_odd[begin[which]] += 1
            in_odd[end[which]] -= 1
            in_odd = np.cumsum(in_odd, dtype=np.int8)
            inside = in_odd[:-1] > 0
            start &= ~inside | first
            low = np.where(inside, b, low)
        starts = np.flatnonzero(start)
        counts = np.ones(len(texts), np.int64)
        if not len(starts):
            return np.full(len(texts), END_ID, np.uint32), counts
        ends = np.flatnonzero(ink & (np.concatenate([start[1:], [True]]) | (_KIND[after] == 0))) + 1
        up, down = _power_tables(len(b))
        value = _PIECE_VALUE[low]
        value *= up
        is_odd = in_odd[starts] > 0
        key = mix(np.add.reduceat(value, starts) * down[starts] + (2 * (ends - starts) + is_odd).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        distinct, at, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.PIECES:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        fresh = self.keys[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if fresh.any():
            new = at[fresh]
            self._learn(distinct[fresh], [data[s:e].decode() for s, e in zip(starts[new].tolist(), ends[new].tolist())], is_odd[new])
            place = np.searchsorted(self.keys, distinct)
        slot = self.slots[place][which]
        size, begin = self.size[slot], self.begin[slot]
        bounds = np.cumsum([len(p) + 1 for p in parts])
        pieces = np.searchsorted(starts, np.concatenate([[0], bounds]))
        upto = np.concatenate([[0], np.cumsum(size)])
        counts += upto[pieces[1:]] - upto[pieces[:-1]]
        out = np.empty(counts.sum(), np.uint32)
        last = np.cumsum(counts) - 1
        is_end = np.zeros(len(out), bool)
        is_end[last] = True
        out[last] = END_ID
        out[~is_end] = self.flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        return out, counts


_KIND = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_PIECE_VALUE[[9, 10, 11, 12, 13, 32]] = 0

_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


SEGMENT_SCHEMA = "part int, seq int, n_docs long, n_tokens long, data binary"


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list]]:
    """Documents in runs of about ``limit`` characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode_segments(docs: DataFrame, tokenizer_path: str, *, id_col="doc_id", text_col="text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Rows of ``SEGMENT_SCHEMA`` in ascending (part, seq)."""

    def segments(batches):
        encoder, part, seq = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held, counts, ids, total = [], [], [], 0

        def out():
            data = pack_segment(held, np.concatenate(counts), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "data"])

        for doc_ids, texts in _slices(batches, 1 << 21):
            flat, sizes = encoder.encode(texts)
            held += [NULL_ID if i is None else i for i in doc_ids]
            counts.append(sizes)
            ids.append(flat)
            total += len(flat)
            if total >= segment_ids:
                yield out()
                held, counts, ids, total, seq = [], [], [], 0, seq + 1
        if held:
            yield out()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(partitions(docs.sparkSession) * 2, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(segments, SEGMENT_SCHEMA)


#: Stands for a null document id inside a segment.
NULL_ID = -(2**63)


def write_segments(docs: DataFrame, path: str, tokenizer_path: str, **columns) -> None:
    encode_segments(docs, tokenizer_path, **columns).write.mode("overwrite").option("compression", "none").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the written segments alone."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def decode(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                doc_ids, counts, ids = unpack_segment(data)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": np.int32(part), "seq": np.int32(seq), "doc_id": doc_ids, "within": ends - counts, "n_tokens": counts, "ids_crc32": np.array(crc, np.int64)}), preserve_index=False)

    docs = segments.select("part", "seq", "data").mapInArrow(decode, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = segments.select("part", "seq", "n_tokens")
    along = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(along(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    starts = sizes.withColumn("seg_start", F.coalesce(F.sum("n_tokens").over(along(Window.partitionBy("part").orderBy("seq"))), F.lit(0))).join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("seg_start") + F.col("part_start")).alias("segment_start"))
    return docs.join(starts, ["part", "seq"]).select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), (F.col("segment_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark, path: str) -> DataFrame:
    """``doc_id, ids array<long>`` of every document."""

    def decode(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                doc_ids, counts, ids = unpack_segment(data)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([None if i == NULL_ID else i for i in doc_ids.tolist()], pa.int64()), lists], ["doc_id", "ids"])

    return spark.read.schema(SEGMENT_SCHEMA).parquet(path).select("data").mapInArrow(decode, "doc_id long, ids array<long>")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder beside the checkpoints and read the files back."""
    import uuid

    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/token-segments-{uuid.uuid4().hex}"
    write_segments(docs, path, tokenizer or tokenizer_path())
    return read_documents(spark, path)


def op7_token_blocks(spark, sf_dir):
    return encode_and_read(table(spark, sf_dir, "documents"))
