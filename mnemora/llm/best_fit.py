"""Packed id matrices by best-fit decreasing, the open sequences kept in a segment tree over free room."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import saved
from mnemora.llm.tokens import Encoder, default_path, together

CAPACITY = 2048
END, PAD = 1, 0
# Tokens packed by one task. Each block loses at most a part of its last sequences.
BLOCK_TOKENS = 2_000_000


class RoomTree:
    """How many open sequences have each amount of free room; finds the smallest room that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at //= 2

    def at_least(self, room: int) -> int | None:
        """The smallest room of this size or more that an open sequence has."""
        at = room + self.size
        if self.count[at]:
            return room
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences of piece numbers: longest pieces first, each where the least room is left over."""
    tree, open_, out = RoomTree(capacity), defaultdict(list), []
    for piece in np.argsort(-lengths, kind="stable"):
        length = int(lengths[piece])
        room = tree.at_least(length)
        if room is None:
            out.append([])
            sequence, room = len(out) - 1, capacity
        else:
            sequence = open_[room].pop()
            tree.add(room, -1)
        out[sequence].append(int(piece))
        if room - length:
            open_[room - length].append(sequence)
            tree.add(room - length, 1)
    return out


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids of every piece; a longer document is cut at multiples of the capacity.

    Ids take two bytes where the vocabulary allows it; a piece's own length tells which.
    """

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = np.array([END], dtype=encoder.dtype).tobytes()
        width = len(end)
        for batch in batches:
            for part in together(batch):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").fill_null("")
                rows = [
                    (doc_id, start // width, min(len(raw) - start, width * CAPACITY) // width, raw[start : start + width * CAPACITY])
                    for doc_id, raw in zip(ids, (x + end for x in encoder.encode(texts)), strict=True)
                    for start in range(0, len(raw), width * CAPACITY)
                ]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tokenised, "doc_id bigint, start bigint, length bigint, ids binary")


PACKED = (
    "block int, sequence int, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, "
    "ids binary, positions binary"
)


def _rows(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    flat = np.ascontiguousarray(matrix)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * (flat.shape[1] * flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _packed(table: pa.Table) -> pa.Table:
    order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
    sequences = best_fit(np.asarray(order["length"]))
    taken = np.concatenate(sequences)
    pieces = order.take(pa.array(taken)).combine_chunks()
    sizes = np.array([len(s) for s in sequences])
    lengths, first = np.asarray(pieces["length"]), np.concatenate([[0], np.cumsum(sizes)])
    sequence = np.repeat(np.arange(len(sequences)), sizes)
    # Where each piece starts, in all pieces and in its sequence.
    starts = np.cumsum(lengths) - lengths
    offsets = starts - starts[first[:-1]][sequence]
    raw = np.frombuffer(b"".join(pieces["ids"].to_pylist()), dtype=np.uint8)
    flat = raw.view("<u2" if len(raw) == 2 * lengths.sum() else "<u4")
    place = np.arange(len(flat)) - np.repeat(starts, lengths)
    cell = place + np.repeat(sequence * CAPACITY + offsets, lengths)
    matrix, positions = (np.full(len(sequences) * CAPACITY, fill, dtype="<u4") for fill in (PAD, 0))
    matrix[cell], positions[cell] = flat, place
    # The cumulative lengths of each sequence, one more than it has pieces.
    ends = np.zeros(len(lengths) + len(sequences), dtype=np.int32)
    ends[np.arange(len(lengths)) + sequence + 1] = offsets + lengths
    return pa.table(
        {
            "block": pa.array(np.full(len(sequences), order["block"][0].as_py()), pa.int32()),
            "sequence": pa.array(range(len(sequences)), pa.int32()),
            "doc_ids": _lists(pieces["doc_id"].combine_chunks(), first),
            "starts": _lists(pieces["start"].combine_chunks(), first),
            "cu_seqlens": _lists(pa.array(ends), first + np.arange(len(first))),
            "ids": _rows(matrix.reshape(-1, CAPACITY)),
            "positions": _rows(positions.reshape(-1, CAPACITY)),
        }
    )


def packed_matrices(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per packed sequence: block, sequence, doc_ids, starts, cu_seqlens, ids, positions.

    ``ids`` and ``positions`` are little-endian 32-bit rows of ``CAPACITY`` entries; positions restart at each
    piece, ``cu_seqlens`` are the cumulative lengths from 0. Pieces are dealt to blocks of about
    ``BLOCK_TOKENS`` tokens by a hash, and each block is packed by itself, so no task sees the corpus.
    Null and empty texts are the end token alone; repeated rows, ties and null ids are pieces like
    all others; other columns are ignored; no documents give no sequences.
    """
    pieces = saved(token_rows(docs, path or default_path()), "token-rows")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / BLOCK_TOKENS))
    # Rows that are equal in all of this are told apart by their place in the written table.
    number = F.monotonically_increasing_id()
    block = F.pmod(F.xxhash64("doc_id", "start", "ids", number), F.lit(blocks)).cast("int")
    return pieces.withColumn("block", block).groupBy("block").applyInArrow(_packed, PACKED)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet, a folder for each block; Spark commits the files."""
    packed.write.partitionBy("block").parquet(path)
