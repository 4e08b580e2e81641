"""Keyed store operations as DataFrame transforms.

Rows are addressed by ``id`` only, so tombstones, updates and level vectors cannot drift
apart the way position-aligned lists do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.classify import enrich
from mnemora.functions.text import strip
from mnemora.functions.vectors import resize, unit
from mnemora.operators.levels import with_levels


def prepare_items(
    df: DataFrame,
    text: str,
    ts: Column,
    embed: Callable[[DataFrame, str], DataFrame] | None = None,
    dim: int | None = None,
) -> DataFrame:
    """Rows ready to be added: blank texts dropped, formatted, enriched, with a normalised vector.

    ``embed`` adds an ``embedding`` column from the ``content`` column; without it the frame
    must bring one. With ``dim`` vectors of other lengths are cut or padded with zeros to the
    store's dimension. A missing vector stays NULL.
    """
    rows = enrich(df.filter(strip(F.col(text)) != ""), text, ts)
    if embed is not None:
        rows = embed(rows, "content")
    flags = {
        "source": F.lit("unknown"),
        "hallucination_detected": F.lit(False),
        "hallucination_score": F.lit(0.0),
        "reliability_penalty": F.lit(0.7),
    }
    for name, default in flags.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), default) if name in rows.columns else default)
    vector = F.col("embedding") if dim is None else resize(F.col("embedding"), dim)
    return (
        rows.withColumn("ts", ts)
        .withColumn("embedding", unit(vector).cast("array<float>"))
        .withColumn("retrieval_count", F.lit(0).cast("bigint"))
        .withColumn("deleted", F.lit(False))
    )


def duplicate_ids(items: DataFrame) -> DataFrame:
    """Ids carried by more than one row; a short hash and six digits can collide."""
    return items.groupBy("id").agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def get(items: DataFrame, ids: list[str] | Column | DataFrame) -> DataFrame:
    """Live items by id; many ids come as a DataFrame with a column ``id``."""
    if isinstance(ids, DataFrame):
        return items.filter(~F.col("deleted")).join(ids.select("id"), "id", "left_semi")
    wanted = F.col("id").isin(ids) if isinstance(ids, list) else F.col("id") == ids
    return items.filter(wanted & ~F.col("deleted"))


def update(
    items: DataFrame,
    changes: DataFrame,
    now: Column,
    embed: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Apply ``changes(id, new_content, new_attrs, new_embedding)``.

    Content is replaced and brings its vector with it, metadata is merged, tombstones are
    left alone. ``new_embedding`` may be absent when ``embed`` can compute it.
    """
    if embed is not None:
        fresh = embed(changes.filter(F.col("new_content").isNotNull()).select("id", "new_content"), "new_content")
        changes = changes.drop("new_embedding").join(
            fresh.select("id", F.col("embedding").alias("new_embedding")), "id", "left"
        )
    joined = items.join(changes.withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & ~F.col("deleted")
    new_text = hit & F.col("new_content").isNotNull() & (F.col("new_content") != F.col("content"))
    columns = {
        "content": F.when(new_text, F.col("new_content")).otherwise(F.col("content")),
        "embedding": F.when(new_text, unit(F.col("new_embedding")).cast("array<float>")).otherwise(F.col("embedding")),
        "attrs": F.when(hit & F.col("new_attrs").isNotNull(), F.map_concat("attrs", "new_attrs")).otherwise(
            F.col("attrs")
        ),
        "modified_at": F.when(hit, now).otherwise(F.col("modified_at")),
    }
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in items.columns])


def remove(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstone the given ids."""
    marked = items.join(ids.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    return marked.withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).select(*items.columns)


def compact(items: DataFrame, levels: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Drop tombstones, and the level vectors of dropped items."""
    live = items.filter(~F.col("deleted"))
    if levels is None:
        return live, None
    gone = items.filter(F.col("deleted")).select(F.col("id").alias("item_id"))
    return live, levels.join(gone, "item_id", "left_anti")


def change_dimension(items: DataFrame, dim: int) -> DataFrame:
    """Truncate or zero-pad every vector to ``dim``."""
    return items.withColumn("embedding", resize(F.col("embedding"), dim).cast("array<float>"))


def rebuild_levels(items: DataFrame, dim: int, levels: int = 3) -> DataFrame:
    """Level vectors of all live items, from their current vectors."""
    return with_levels(items.filter(~F.col("deleted")), dim, levels)


def attach_levels(items: DataFrame, levels: DataFrame) -> DataFrame:
    """Items with their level vectors as ``level_vectors: map<int, vector>``; one entry per level."""
    packed = levels.groupBy("item_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "vec")))).alias("level_vectors")
    )
    return items.join(packed.withColumnRenamed("item_id", "id"), "id", "left")


def stats(items: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """``metric, value`` rows: item counts and the size of each level."""
    counts = items.agg(
        F.count("*").alias("total_items"),
        F.count_if(~F.col("deleted")).alias("active_items"),
        F.count_if(F.col("deleted")).alias("deleted_items"),
        F.count("embedding").alias("index_size"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("bigint").alias("index_dimension"),
    )
    wide = counts.unpivot([], counts.columns, "metric", "value")
    if levels is None:
        return wide
    return wide.unionByName(
        levels.groupBy("level")
        .agg(F.count("*").alias("value"))
        .select(F.concat(F.lit("level_"), F.col("level").cast("string"), F.lit("_size")).alias("metric"), "value")
    )


def record_retrievals(items: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Count returned hits on live items and note the access time."""
    used = hits.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("_used"))
    joined = items.join(used, "id", "left")
    hit = F.col("_used").isNotNull() & ~F.col("deleted")
    columns = {
        "retrieval_count": F.when(hit, F.col("retrieval_count") + F.col("_used")).otherwise(F.col("retrieval_count")),
        "last_access": F.when(hit, now).otherwise(F.col("last_access")),
    }
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in items.columns])


def to_json(items: DataFrame) -> DataFrame:
    """Items as JSON texts of id, content and metadata."""
    meta = [c for c in items.columns if c not in ("id", "content", "embedding")]
    return items.select(
        "id", F.to_json(F.struct("id", "content", F.struct(*meta).alias("metadata"))).alias("json")
    )


def from_json(texts: DataFrame, metadata_schema: str, column: str = "json") -> DataFrame:
    """Items back from JSON texts; the stored id wins."""
    schema = f"id string, content string, metadata struct<{metadata_schema}>"
    return texts.select(F.from_json(column, schema).alias("j")).select("j.id", "j.content", "j.metadata.*")


def most_recent(uses: DataFrame, owner: str, ts: str, keep: int = 5) -> DataFrame:
    """The ``keep`` owners used last, newest first, with their last use."""
    last = uses.groupBy(owner).agg(F.max(ts).alias("last_used"))
    # a global top-k: every task keeps its own best rows first
    top = last.orderBy(F.col("last_used").desc(), F.col(owner)).limit(keep)
    return top.withColumn(
        "recency", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("last_used").desc(), F.col(owner)))
    )
