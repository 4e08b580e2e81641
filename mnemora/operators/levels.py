"""Level vectors: seeded orthogonal transforms of an embedding, applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_LEVELS = 4


@lru_cache(maxsize=8)
def level_parameters(dim: int, levels: int = MAX_LEVELS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Orthogonal matrix and bias of each level; their size depends on ``dim`` only.

    The orthogonal matrix is the polar factor of a seeded normal matrix, which the
    first two levels pull towards the identity.
    """
    out = {}
    for level in range(1, levels + 1):
        # fixed values: seeds, spreads and identity share per level
        draw = np.random.RandomState(42 + 10 * level).normal(0, 0.15 + 0.05 * level, (dim, dim))
        if level <= 2:
            draw = draw + (0.8 - 0.2 * level) * np.identity(dim)
        left, _, right = np.linalg.svd(draw, full_matrices=False)
        bias = np.random.RandomState(137 + 10 * level).normal(0, 0.02 + 0.01 * level, dim)
        out[level] = (left @ right, bias)
    return out


def _squash(level: int, x: np.ndarray) -> np.ndarray:
    kind = level % 3
    if kind == 1:
        return np.tanh(x * (1 + 0.1 * level))
    magnitude = np.abs(x) ** 0.8 if kind == 0 else np.log1p(np.abs(x) * (1 + 0.05 * level))
    return np.copysign(magnitude, x)


def to_level(vectors: np.ndarray, level: int, parameters: dict) -> np.ndarray:
    """Rows of unit level vectors for rows of base vectors."""
    if level == 0:
        return vectors
    matrix, bias = parameters[level]
    moved = _squash(level, vectors @ matrix + bias)
    return moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-10)


def as_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, mask) of a list column: vectors of length ``dim`` and which rows have one.

    Vectors of another length are cut or padded with zeros, as queries and stored items are.
    """
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    mask = lengths > 0
    flat = column.filter(pa.array(mask)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = lengths[mask]
    if (lengths == dim).all():
        return flat.reshape(-1, dim), mask
    rows = np.zeros((len(lengths), dim))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = at < dim
    rows[np.repeat(np.arange(len(lengths)), lengths)[inside], at[inside]] = flat[inside]
    return rows, mask


def _list_array(rows: np.ndarray) -> pa.Array:
    n, dim = rows.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(rows.astype(np.float32).ravel())
    )


def with_levels(items: DataFrame, dim: int, levels: int = 3, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Long table ``(item_id, level, vec)`` for levels 1..levels; items without a vector give no row."""
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(level_parameters(dim, max(levels, 1)))
    id_type = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, mask = as_matrix(batch.column(1), dim)
            if not len(base):
                continue
            base = base / np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-10)
            ids = batch.column(0).filter(pa.array(mask))
            for level in range(1, levels + 1):
                vec = to_level(base, level, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(vec), level, dtype=np.int32)), _list_array(vec)],
                    names=["item_id", "level", "vec"],
                )

    return items.select(id_col, vec_col).mapInArrow(run, f"item_id {id_type}, level int, vec array<float>")
