"""Batch sizing for Python steps and a chunked map that adapts to memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_for_length(mean_length: Column) -> Column:
    """Batch size by mean text length: longer texts, smaller batches."""
    return F.when(mean_length > 1000, 4).when(mean_length > 500, 8).when(mean_length > 200, 16).otherwise(32)


def size_for_memory(free_bytes: Column, bytes_per_item: Column, share: float = 0.7, low: int = 1, high: int = 32) -> Column:
    """Batch size that fills ``share`` of free memory with a fifth kept as workspace."""
    fits = F.floor(free_bytes * share * 0.8 / bytes_per_item)
    return F.greatest(F.lit(low), F.least(F.lit(high), fits)).cast("int")


def map_in_chunks(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunk_rows: int = 32, min_rows: int = 1
) -> DataFrame:
    """Apply ``function`` to chunks of rows; a chunk that runs out of memory is retried in halves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = chunk_rows
        for frame in frames:
            at = 0
            while at < len(frame):
                try:
                    yield function(frame.iloc[at : at + size])
                    at += size
                except MemoryError:
                    if size <= min_rows:
                        raise
                    size = max(min_rows, size // 2)

    return df.mapInPandas(run, schema)
