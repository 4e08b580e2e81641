"""Packing as a cutting-stock problem: column generation over the histogram of piece lengths.

Lengths are counted in units of ``UNIT`` tokens, so the program has at most ``CLASSES`` rows
whatever the corpus. A pattern says how many pieces of each length class share a sequence; the
linear program asks how often each pattern is used, and a knapsack over its prices finds the
pattern that would help most, until none does.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.llm.common import saved
from mnemora.llm.tokens import Encoder, default_path, together

CAPACITY, UNIT = 2048, 8
CLASSES = CAPACITY // UNIT
END = np.array([1], dtype="<u4").tobytes()
# The program stops at this gap to its lower bound. Prices are smoothed towards those of the best bound.
GAP, SMOOTHING, MAX_PIVOTS = 0.005, 0.9, 6000
# Pieces ranked by one task; more pieces make more ranking groups.
RANKED = 50_000


def knapsack(price: np.ndarray, width: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of the most valuable filling by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = width <= room
        value = np.where(fits, price + best[np.where(fits, room - width, 0)], 0.0)
        i = int(np.argmax(value))
        if value[i] > best[room - 1] + 1e-12:
            best[room], last[room] = value[i], i
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(width), dtype=np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        counts[last[room]] += 1
        room -= width[last[room]]
    return counts


def covering_program(width: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and their amounts that cover ``need`` with least sequences, in fractions.

    Revised simplex from patterns of one class each. A negative price lets a class be covered more than
    needed; otherwise the knapsack's pattern enters. Any stop leaves a valid cover.
    """
    n = len(width)
    columns = [np.where(np.arange(n) == i, capacity // w, 0) for i, w in enumerate(width)]
    inverse = np.diag([1.0 / (capacity // w) for w in width])
    amount, cost = inverse @ need, np.ones(n)
    center = width / capacity
    bound = float(center @ need)
    for _ in range(MAX_PIVOTS):
        if cost @ amount <= bound * (1 + GAP):
            break
        price = cost @ inverse
        k = int(np.argmin(price))
        if price[k] < -1e-9:
            new, own = -(np.arange(n) == k).astype(float), 0.0
        else:
            own = 1.0
            for p in (SMOOTHING * center + (1 - SMOOTHING) * price, price):
                new = knapsack(p, width, capacity)
                lower = float(p @ need) / max(1.0, float(p @ new))
                if lower > bound:
                    bound, center = lower, p
                if price @ new > 1 + 1e-7:
                    break
            else:
                break
        step = inverse @ new
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1.0), np.inf)
        out = int(np.argmin(ratio))
        columns[out], cost[out] = new, own
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    held = cost > 0
    return [c.astype(np.int64) for c, h in zip(columns, held, strict=True) if h], amount[held]


def patterns(demand: np.ndarray, capacity: int = CLASSES) -> list[tuple[np.ndarray, int]]:
    """(pieces of each class, times used), covering ``demand[k]`` pieces of k + 1 units exactly.

    The linear program's solution is rounded down; what is left, less than one use of each pattern,
    is filled largest piece first.
    """
    width = np.flatnonzero(demand) + 1
    need = demand[width - 1].astype(float)
    if not len(width):
        return []
    columns, amount = covering_program(width, need, capacity)
    left = demand[width - 1].astype(np.int64)
    found = []
    for column, uses in zip(columns, np.floor(np.maximum(amount, 0) + 1e-9).astype(np.int64), strict=True):
        uses = int(uses)
        while uses:
            column = np.minimum(column, left)  # a pattern may hold more pieces of a class than there are left
            used = column > 0
            if not used.any():
                break
            times = min(uses, int((left[used] // column[used]).min()))
            found.append((column, times))
            left, uses = left - times * column, uses - times
    while left.any():
        room, column = capacity, np.zeros(len(width), dtype=np.int64)
        for i in range(len(width) - 1, -1, -1):
            column[i] = min(left[i], room // width[i])
            room -= column[i] * width[i]
        used = column > 0
        times = int((left[used] // column[used]).min())
        found.append((column, times))
        left = left - times * column
    full = []
    for column, times in found:
        whole = np.zeros(capacity, dtype=np.int64)
        whole[width - 1] = column
        full.append((whole, times))
    return full


def cut_pieces(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``CAPACITY`` tokens: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    A document is its ids and the end token; it is cut at multiples of the capacity.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]
    fields += [("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("ids", pa.binary())] if with_ids else []
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for part in together(batch):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").fill_null("")
                rows = []
                for doc_id, raw in zip(ids, encoder.encode(texts), strict=True):
                    raw = np.frombuffer(raw, dtype=encoder.dtype).astype("<u4").tobytes() + END
                    for start in range(0, len(raw), 4 * CAPACITY):
                        piece = raw[start : start + 4 * CAPACITY]
                        row = (doc_id, start // 4, len(piece) // 4, crc32(piece), len(raw) // 4)
                        rows.append((*row, piece) if with_ids else row)
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    spark_type = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(cut, spark_type + (", ids binary" if with_ids else ""))


def _slots(found: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, pieces per sequence, first sequence, slot) for each pattern and class."""
    rows, at, sequence = [], np.zeros(CLASSES + 1, dtype=np.int64), 0
    for column, times in found:
        slot = 0
        for k in np.flatnonzero(column)[::-1]:
            each = int(column[k])
            rows.append((int(k) + 1, int(at[k]), int(at[k]) + each * times, each, sequence, slot))
            at[k] += each * times
            slot += each
        sequence += times
    return rows


def packed(pieces: DataFrame) -> DataFrame:
    """Add sequence_id and offset to written pieces with doc_id, start, length, ids_crc32 and a row number
    ``_number``, which goes; other columns stay.
    """
    spark = pieces.sparkSession
    size = F.ceil(F.col("length") / UNIT).cast("int")
    pieces = pieces.withColumn("_class", size)
    counted = {r["_class"]: r["count"] for r in pieces.groupBy("_class").count().collect()}  # at most CLASSES rows
    demand = np.array([counted.get(k + 1, 0) for k in range(CLASSES)], dtype=np.int64)
    groups = max(1, int(demand.sum()) // RANKED)
    slot_type = "_class int, _from bigint, _to bigint, _each bigint, _first bigint, _slot bigint"
    slots = spark.createDataFrame(_slots(patterns(demand)), slot_type)

    # Ranks within a class: within (class, group) by a window, plus the sizes of the groups before.
    order = ["doc_id", "start", "ids_crc32"]
    # The number tells equal rows apart, so that many repeats of one row are dealt over the groups too.
    mixed = pieces.withColumn("_group", F.pmod(F.xxhash64(*order, "_number"), F.lit(groups)))
    before = Window.partitionBy("_class").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = mixed.groupBy("_class", "_group").agg(F.count("*").alias("_n"))
    starts = sizes.select("_class", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_class", "_group").orderBy(*order)) - 1
    ranked = mixed.withColumn("_rank", within).join(starts, ["_class", "_group"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_start"))

    # The slot table is bounded: at most 2 * CLASSES patterns of at most CLASSES classes.
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = (
        ranked.join(F.broadcast(slots), "_class")
        .where(inside)
        .withColumn("_rank", F.col("_rank") - F.col("_from"))
        .withColumn("sequence_id", F.col("_first") + F.floor(F.col("_rank") / F.col("_each")))
        .withColumn("_slot", F.col("_slot") + F.col("_rank") % F.col("_each"))
    )
    ahead = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0))
    internal = ["_number", "_class", "_group", "_start", "_rank", "_from", "_to", "_each", "_first", "_slot"]
    return placed.withColumn("offset", offset).drop(*internal)


def pack_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null or empty text is the end token alone. Repeated rows and null ids are pieces like all
    others, ties are broken by the ids' checksum. Other columns are ignored, no documents give
    no pieces. Sequences lose at most ``UNIT`` - 1 tokens per piece to rounding.
    """
    pieces = cut_pieces(docs, path or default_path(), with_ids)
    return packed(saved(pieces.withColumn("_number", F.monotonically_increasing_id()), "pieces"))
