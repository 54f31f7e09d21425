"""Token-id output in binary blocks: ids one after the other, document boundaries Elias-Fano encoded.

The file format is a Parquet table of blocks, so any store that Spark writes to holds it and lost tasks are redone by
Spark's commit. A block has up to BLOCK_IDS ids (or one longer document): `ids` is the concatenated array of
little-endian unsigned 16-bit numbers; `bounds` and `doc_ids` are Elias-Fano encoded monotone sequences, the end offset
of each document and each doc_id less the block's first; `base_*` say where the block lies. select(k) finds the k-th
boundary in the upper bits with a sampled directory, in about 2 + log2(u/n) bits a document and no table of 64-bit
offsets; read() gets every boundary by it.

Documents are dealt to ranges of doc_id before they are encoded, so texts are tokenized once and files ascend. Ranges
are cut by doc_id, then hash of the text, then a salt, so that a doc_id of very many rows is several ranges.

Defined results: a null text gives the end id alone; documents with a null doc_id come first; rows that repeat a doc_id
follow each other, in order of their texts' hash; a very long text is a block of its own, held whole by one task; an
empty table gives no block. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pieces_of, small
from .ffd_packing import encode_batches

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1 << 20
#: Ones between two samples of the select directory.
SAMPLE = 256


def encode_monotone(values: np.ndarray) -> bytes:
    """Elias-Fano: n, low width and universe; packed low bits; upper bits in unary; sampled positions of ones."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    universe = int(v[-1]) if n else 0
    width = max(0, (universe // n).bit_length() - 1) if n else 0
    low = v & np.uint64((1 << width) - 1)
    bits = ((low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if width and n else np.zeros(0, np.uint8)
    ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n, dtype=np.int64)
    upper = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
    upper[ones] = 1
    samples = ones[::SAMPLE].astype("<u8")
    a, b = np.packbits(bits, bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes()
    # positions of samples fit the bits that the largest needs; most blocks take four bytes each
    four = int(n == 0 or int(ones[-1]) < 1 << 32)
    s = samples.astype("<u4" if four else "<u8").tobytes()
    return struct.pack("<QQBBQQ", n, universe, width, four, len(a), len(b)) + a + b + s


class EliasFano:
    """A read-only monotone sequence: len(), select (by index) and all values."""

    _HEAD = struct.calcsize("<QQBBQQ")

    def __init__(self, data: bytes):
        self.n, self.universe, self.width, four, a, b = struct.unpack_from("<QQBBQQ", data)
        at = self._HEAD
        self.low = np.frombuffer(data, np.uint8, a, at)
        self.high = np.frombuffer(data, np.uint8, b, at + a)
        self.samples = np.frombuffer(data, "<u4" if four else "<u8", offset=at + a + b)

    def __len__(self) -> int:
        return self.n

    def _ones(self, slot: int) -> np.ndarray:
        """Positions of the ones from a directory sample up to the next, from the bytes between them alone."""
        at = int(self.samples[slot])
        to = int(self.samples[slot + 1]) if slot + 1 < len(self.samples) else len(self.high) * 8
        found = np.flatnonzero(np.unpackbits(self.high[at >> 3 : (to + 7) >> 3], bitorder="little")) + (at & ~7)
        return found[(found >= at) & (found < to)]

    def select(self, k):
        """The k-th value, or the values at ascending places k: ones counted on from the directory's samples."""
        ks = np.atleast_1d(np.asarray(k, dtype=np.int64))
        if len(ks) and not (0 <= ks[0] and ks[-1] < self.n):
            raise IndexError(k)
        slots = ks // SAMPLE
        edges = np.flatnonzero(np.diff(slots, prepend=-1))
        ones = [self._ones(int(slots[a]))[ks[a:b] % SAMPLE] for a, b in zip(edges, [*edges, len(ks)][1:], strict=True)]
        out = ((np.concatenate(ones) if ones else ks) - ks).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = ks[:, None] * self.width + np.arange(self.width)
            low = (self.low[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(np.uint64)
            out |= (low << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return int(out[0]) if np.ndim(k) == 0 else out


_BLOCK = "first_doc long, part int, block int, n_docs long, n_ids long, ids binary, bounds binary, doc_ids binary"


def _blocks(parts: Iterator[pa.RecordBatch], block_ids: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, ids) of one range -> its blocks. Holds one block at a time."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    docs: list[int] = []
    data: list[bytes] = []
    size, block = 0, 0

    def made() -> pa.RecordBatch:
        ends = np.cumsum([len(x) // 2 for x in data])
        offsets = np.array([x - docs[0] for x in docs], dtype=np.uint64)
        values = [docs[0], part, block, len(docs), int(ends[-1]), b"".join(data), encode_monotone(ends), encode_monotone(offsets)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])

    for p in parts:
        for doc, ids in zip(p.column("doc_id").to_pylist(), p.column("ids").to_pylist(), strict=True):
            if docs and size + len(ids) // 2 > block_ids:
                yield made()
                block, docs, data, size = block + 1, [], [], 0
            docs.append(doc)
            data.append(ids)
            size += len(ids) // 2
    if docs:
        yield made()


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode documents with a doc_id into blocks under `path`, in ascending order of doc_id."""
    partitions = pieces_of(docs, docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    least = -(1 << 63)
    # rows alike in doc_id and text are interchangeable, so their salt decides nothing that is read back
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), "text", F.xxhash64("text").alias("_h"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
    keys = ["doc_id", "_h", "_salt"]
    ordered = plain.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    ordered.mapInArrow(lambda parts: _blocks(encode_batches(parts, tokenizer, end_id), block_ids), _BLOCK).write.parquet(path)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """Blocks under `path` with base_ids: the ids in all blocks before.

    Ranges first (a row per task that wrote), then the blocks within each, so no window holds all blocks.
    """
    blocks = spark.read.parquet(path)
    keys = blocks.select("part", "block", "n_ids")
    ranges = keys.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = ranges.withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = keys.withColumn("_in", inside).join(before.select("part", "base"), "part").select("part", "block", (F.col("base") + F.col("_in")).alias("base_ids"))
    # the blocks themselves aren't shuffled while their list, counted, is small
    return blocks.join(small(materialize(base, "token-bases"), 200_000), ["part", "block"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for first, base, ids, bounds, names in zip(*(p.column(c).to_pylist() for c in ("first_doc", "base_ids", "ids", "bounds", "doc_ids")), strict=True):
                sequence, found = EliasFano(bounds), EliasFano(names)
                every = np.arange(len(sequence))
                ends = sequence.select(every).astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                docs = [first + int(x) for x in found.select(every)]
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([None if d == -(1 << 63) else d for d in docs], pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return offsets(spark, path).select("first_doc", "base_ids", "ids", "bounds", "doc_ids").mapInArrow(batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
