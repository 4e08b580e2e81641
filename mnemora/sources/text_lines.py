"""Line-file ingest: one fact per line, blank lines dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.text import strip


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 text files as ``line`` rows."""
    return fact_lines(spark.read.text(path), F.col("value"))


def fact_lines(df: DataFrame, line: Column) -> DataFrame:
    """Stripped, non-blank lines of a text column that holds one line per row."""
    return df.select(strip(line).alias("line")).filter(F.length("line") > 0)


def explode_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Stripped, non-blank lines of a multi-line text column with their 0-based line number."""
    return (
        df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw"))
        .select(*keys, "line_no", strip(F.col("raw")).alias("line"))
        .filter(F.length("line") > 0)
    )
