"""Reading a table as a stream and draining a stream into a table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from mnemora.session import scratch_dir


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet table as a file stream. A micro-batch, and with it what a key can bring, is bounded by its files."""
    path = os.path.join(folder, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    # a file source wants a folder or a glob; the glob matches a table stored as one file or as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input and return what it wrote."""
    spark = stream.sparkSession
    out, progress = scratch_dir(spark, name), scratch_dir(spark, f"{name}-progress")
    run = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
