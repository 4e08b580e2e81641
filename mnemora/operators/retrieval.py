"""Searching a stored memory and noting what was found, one step after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.operators.search import multi_level_search
from mnemora.operators.store import record_retrievals
from mnemora.session import scratch_dir
from mnemora.sources.buckets import BucketedTable


def retrieve(
    memory: BucketedTable, queries: DataFrame, dim: int, now: Column, k: int = 5, min_similarity: float = 0.25, levels: list[int] | None = None
) -> DataFrame:
    """The hits of :func:`multi_level_search` over the stored items, counted on the items they name.

    Only the buckets of found items are rewritten. Hits are written once, so that what is returned is what
    was counted. Queries without a vector find nothing.
    """
    spark = queries.sparkSession
    path = scratch_dir(spark, "hits")
    found = multi_level_search(memory.read(), queries, dim, k, min_similarity, levels)
    found.write.parquet(path)
    hits = spark.read.schema(found.schema).parquet(path)
    used = hits.groupBy(F.col("item_id").alias(memory.key)).agg(F.count("*").alias("n"))

    def counted(rows: DataFrame, _: DataFrame) -> DataFrame:
        return record_retrievals(rows, hits, now)

    memory.change(used, counted)
    return hits
