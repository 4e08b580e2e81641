"""Injecting an embedding function: a Python batch function becomes a DataFrame step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BatchEmbedder = Callable[[list[str]], "np.ndarray"]


def embedder(batch_function: BatchEmbedder, out: str = "embedding") -> Callable[[DataFrame, str], DataFrame]:
    """Wrap ``texts -> matrix`` as ``(df, text_column) -> df`` with a vector column.

    Texts arrive in Arrow batches and keep their rows, whatever order tasks finish in. A
    missing or blank text has no vector.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        have = (texts.notna() & (texts.str.strip() != "")).tolist()
        kept = [t for t, ok in zip(texts, have) if ok]
        rows = iter(np.asarray(batch_function(kept), dtype=np.float32) if kept else [])
        return pd.Series([next(rows) if ok else None for ok in have], dtype=object)

    return lambda df, text: df.withColumn(out, embed(F.col(text)))


def from_scalar(function: Callable[[str], "np.ndarray"]) -> BatchEmbedder:
    """A batch function from one that embeds a single text."""
    return lambda texts: np.stack([np.asarray(function(t), dtype=np.float32) for t in texts])


def seeded_embedding(dim: int = 64) -> BatchEmbedder:
    """Unit vectors drawn from a seed that follows from the text: reproducible, without meaning."""
    import hashlib

    def one(text: str) -> np.ndarray:
        seed = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
        v = np.random.RandomState(seed).randn(dim)
        return v / np.linalg.norm(v)

    return from_scalar(one)
