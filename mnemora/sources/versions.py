"""Versioned store on Parquet: data first, then one commit row that makes it visible.

A reader takes the newest committed version, so a failed or half-written version is
never seen and a retried writer leaves no mixed state.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedStore:
    """Items and level vectors under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._commits = os.path.join(folder, "commits")

    def version(self) -> str | None:
        """Folder name of the newest committed version."""
        try:
            log = self.spark.read.schema("seq bigint, name string").parquet(self._commits)
            row = log.orderBy(F.col("seq").desc(), F.col("name").desc()).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return row["name"] if row else None

    def save(self, items: DataFrame, levels: DataFrame | None = None) -> str:
        """Write a new version; level vectors are partitioned by level."""
        current = self.version()
        seq = int(current.split("-")[0][1:]) + 1 if current else 1
        name = f"v{seq:09d}-{uuid.uuid4().hex[:8]}"
        base = os.path.join(self.folder, "data", name)
        items.write.parquet(os.path.join(base, "items"))
        if levels is not None:
            levels.write.partitionBy("level").parquet(os.path.join(base, "levels"))
        commit = self.spark.createDataFrame([(seq, name)], "seq bigint, name string")
        commit.coalesce(1).write.mode("append").parquet(self._commits)
        return name

    def items(self, version: str | None = None) -> DataFrame:
        """Items of a version, the newest by default; ask ``version()`` once to read items and levels that belong together."""
        return self.spark.read.parquet(os.path.join(self._data(version), "items"))

    def levels(self, version: str | None = None) -> DataFrame | None:
        try:
            return self.spark.read.parquet(os.path.join(self._data(version), "levels"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _data(self, version: str | None) -> str:
        name = version or self.version()
        if name is None:
            raise FileNotFoundError(f"no committed version under {self.folder}")
        return os.path.join(self.folder, "data", name)


def import_items_json(spark: SparkSession, path: str, vectors: DataFrame | None = None) -> DataFrame:
    """Items from a JSON array of ``{id, content, metadata}``; vectors are joined by id, absent ones stay NULL."""
    items = spark.read.option("multiLine", True).json(path)
    if vectors is None:
        return items
    return items.join(vectors.select("id", "embedding"), "id", "left")


def newest_per_name(blocks: DataFrame, order: str) -> DataFrame:
    """One ``(filename, content)`` row per name: the last in ``order`` wins, combined before the shuffle."""
    return blocks.groupBy("filename").agg(F.max_by("content", order).alias("content"))


def write_files(blocks: DataFrame, folder: str) -> None:
    """Save ``(filename, content)`` rows as a table, the form that holds any number of blocks."""
    blocks.select("filename", "content").write.mode("append").parquet(folder)


def export_files(blocks: DataFrame, folder: str) -> DataFrame:
    """Write every row as a file into a folder all executors mount; returns ``filename, saved``.

    Each task writes its own rows. A file appears by one rename, so a retried task leaves
    the same files. Names must be safe and unique.
    """

    def save(frames):
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            saved = []
            for name, content in zip(frame["filename"], frame["content"]):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                try:
                    with open(part, "w", encoding="utf-8") as f:
                        f.write(content)
                    os.replace(part, os.path.join(folder, name))
                    saved.append(True)
                except OSError:
                    saved.append(False)
            yield frame[["filename"]].assign(saved=saved)

    return blocks.filter(F.col("filename").isNotNull()).select("filename", "content").mapInPandas(
        save, "filename string, saved boolean"
    )
