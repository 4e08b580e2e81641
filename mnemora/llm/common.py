"""What the operators share: session settings, saved intermediate tables, native array helpers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.session import configure, scratch_dir

# Bounds on one Arrow batch, so that a batch of long texts fits a Python worker.
BATCH_ROWS, BATCH_BYTES = 2048, 8 * 1024 * 1024
# Ids that one side of a join may have to be broadcast; more are shuffled, with the same rows as the result.
MAX_BROADCAST_IDS = 1_000_000


def prepared(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and bound the Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(os.path.join(folder, f"{name}.parquet"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends here and a lost executor costs nothing."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(ids: DataFrame) -> DataFrame:
    """A saved table of ids, broadcast in joins if its rows, counted here, are few enough."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside nested array functions too."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def running_sums(values: Column, block: int = 128) -> Column:
    """For each entry of an array of longs the sum of the entries before it.

    A plain fold that appends copies its array at each step. Blocks keep the copies
    short: n * block instead of n * n.
    """

    def within(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            part,
            zero,
            lambda acc, x: F.struct(
                (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
            ),
        )["out"]

    zero = F.lit(0).cast("bigint")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")),
        lambda j: F.slice(values, j * block + 1, F.lit(block)),
    )

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
        return let(
            within(sums, zero),
            lambda starts: F.flatten(F.transform(parts, lambda p, j: within(p, F.get(starts, j)))),
        )

    return F.when(F.size(values) > 0, let(blocks, joined)).otherwise(F.array().cast("array<bigint>"))
