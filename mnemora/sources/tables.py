"""Table reading with a parallelism guard for small inputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SMALL_INPUT_BYTES = 256 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for a plan, used for every broadcast and spread decision."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on an input too small to fill them.

    A file of one row group is read by one task whatever its split count. Inputs
    above the limit already have enough row groups and are not shuffled.
    """
    if plan_bytes(df) > SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def require_broadcastable(df: DataFrame, limit_rows: int, what: str) -> list:
    """Rows of a side that must be small, read with a hard bound; raises beyond it."""
    rows = df.limit(limit_rows + 1).collect()
    if len(rows) > limit_rows:
        raise ValueError(f"{what}: more than {limit_rows} rows")
    return rows
