"""Packing documents into fixed-length sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents become token ids with an end id and are cut to pieces at once: full sequences and a rest. Pieces are dealt to
groups at random, by a seeded hash of their task, row and number, so a group has about GROUP_PIECES pieces of at most a
sequence each, whatever the texts' lengths and however often a doc_id repeats. Each group packs alone: a full piece is a
sequence, and every rest goes whole into the first open sequence that has room, found in the tree in logarithmic time.
One shuffle carries the ids to their groups.

Defined results: a null text is empty and gives the end id alone; an empty table gives no sequence; repeated rows are
packed each; a very long text is many pieces in many groups; rests of one length are ordered by doc_id, then checksum.
Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of
from .tokens import table

LENGTH = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
GROUP_PIECES = 1500
SEED = 77
#: Text that becomes Python strings and words at once.
SLICE_BYTES = 1_000_000


class TournamentTree:
    """Leaves are bins in the order they were opened; each inner node holds the largest room below it."""

    def __init__(self, bins: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [0] * (2 * self.size)
        self.used = 0

    def open(self, room: int) -> int:
        self.used += 1
        self.set(self.used - 1, room)
        return self.used - 1

    def set(self, k: int, room: int) -> None:
        k += self.size
        tree = self.room
        tree[k] = room
        k >>= 1
        while k:
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1

    def first_fit(self, length: int) -> int | None:
        """The earliest bin with room, or None."""
        tree = self.room
        if tree[1] < length:
            return None
        k = 1
        while k < self.size:
            k *= 2
            if tree[k] < length:
                k += 1
        return k - self.size


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every item; items no longer than the capacity."""
    tree = TournamentTree(len(lengths))
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = tree.first_fit(lengths[i])
        if k is None:
            k = tree.open(capacity)
        room = tree.room[tree.size + k]
        place[i] = (k, capacity - room)
        tree.set(k, room - lengths[i])
    return place


def encode_batches(parts: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches with a column text -> the same columns with ids (little-endian unsigned 16-bit, end id last) instead.

    Slices of SLICE_BYTES of text bound what is held at once as Python strings.
    """
    end = np.array([end_id], dtype="<u2").tobytes()
    encode = table(tokenizer).encode
    for p in parts:
        keep = [c for c in p.schema.names if c != "text"]
        column = p.column("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            limit = (ends[at - 1] if at else 0) + SLICE_BYTES
            to = max(at + 1, int(np.searchsorted(ends, limit, "right")))
            ids = [x + end for x in encode([t or "" for t in column[at:to].to_pylist()])]
            yield pa.RecordBatch.from_arrays([*(p.column(c)[at:to] for c in keep), pa.array(ids, pa.binary())], names=[*keep, "ids"])
            at = to


def _dealt(task: int, row: int, pieces: int, groups: int, seed: int) -> list[int]:
    """A group for each piece of a row: mixed bits of the seed, the task, the row in it and the piece's number."""
    mask = (1 << 64) - 1
    out = []
    for k in range(pieces):
        x = (seed * 0x9E3779B97F4A7C15 + task * 0xD1B54A32D192ED03 + row * 0x8CB92BA72F3D8DD7 + k * 0xABC98388FB8FAC03) & mask
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & mask
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & mask
        out.append((x ^ (x >> 32)) % groups)
    return out


def cut(docs: DataFrame, groups: int, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = END_ID, seed: int = SEED) -> DataFrame:
    """doc_id, start, doc_tokens, group and ids of every piece; a narrow pass.

    A lost task deals its rows again alike as long as it reads them in the same order, as from files.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for p in encode_batches(parts, tokenizer, end_id):
            at, start, total, group, ids = [], [], [], [], []
            for i, data in enumerate(p.column("ids").to_pylist()):
                n = len(data) // 2
                for k, g in enumerate(_dealt(task, row, -(-n // length), groups, seed)):
                    at.append(i)
                    start.append(k * length)
                    total.append(n)
                    group.append(g)
                    ids.append(data[2 * k * length : 2 * (k + 1) * length])
                row += 1
            doc = p.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(group, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "doc_tokens", "group", "ids"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, start long, doc_tokens long, group long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, tokenizer: str = TOKENIZER, end_id: int = END_ID, seed: int = SEED) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids (binary)."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    total = size["bytes"] or 0
    # a piece for each document, and no more than one for each `length` bytes, as no id stands for less than a byte
    groups = max(1, math.ceil((size["n"] + total / length) / group_pieces))
    pieces = cut(docs, groups, length, tokenizer, end_id, seed).repartition(pieces_of(docs, total), "group")

    def pack_group(f: pd.DataFrame) -> pd.DataFrame:
        n = np.array([len(x) // 2 for x in f["ids"]], dtype=np.int64)
        f = f.assign(length=n, _crc=[zlib.crc32(x) for x in f["ids"]])
        # longest first, so the sequences that one piece fills come before the packed ones
        f = f.sort_values(["length", "doc_id", "start", "_crc"], ascending=[False, True, True, True], kind="stable", na_position="last")
        full = int((f["length"] == length).sum())
        places = [(k, 0) for k in range(full)]
        places += [(full + k, offset) for k, offset in first_fit_decreasing(f["length"].iloc[full:].tolist(), length)]
        base = int(f["group"].iloc[0]) << 32
        f = f.assign(sequence_id=np.array([base + k for k, _ in places], dtype=np.int64), offset=np.array([o for _, o in places], dtype=np.int64))
        return f[["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]]

    kind = dict(docs.dtypes)["doc_id"]
    return pieces.groupBy("group").applyInPandas(pack_group, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids as unsigned 32-bit numbers instead of the ids."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes()) for x in p.column("ids")]
            keep = [c for c in p.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(p.column(c) for c in keep), pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    fields = ", ".join(f"`{c}` {k}" for c, k in pieces.dtypes if c != "ids")
    return pieces.mapInArrow(batches, f"{fields}, ids_crc32 long")
