"""Exact similarity search over one or several levels.

The item side is scanned once, in parallel, and never shuffled: every task keeps the
best rows per query of its own batches, so only ``queries x k`` rows per task go on to
the final ranking. The query side is read to the driver only up to a fixed row bound;
beyond it :func:`blocked_hits` pairs hashed blocks of queries and items by an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.arrays import let
from mnemora.functions.vectors import enhance, jaccard_distance, resize, word_set
from mnemora.operators.levels import as_matrix, level_parameters, to_level

MAX_QUERY_ROWS = 4096
MAX_BROADCAST_ROWS = 500_000
CELL_ROWS = 20_000
# Query rows that are multiplied at a time with the items of a cell, and items that set the first bound for them.
QUERY_ROWS = 256
FIRST_ITEMS = 1_000


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-10)


def _similarities(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Inner products, rounded so that copies of a vector tie whatever batch they were multiplied in."""
    return np.round(queries @ items.T, 12)


def _narrow(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns that can be among any row's best k, ties included."""
    if sims.shape[1] <= k:
        return np.arange(sims.shape[1])
    edge = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
    return np.flatnonzero((sims >= edge).any(axis=0))


def _first_copies(rows: np.ndarray, n: int) -> np.ndarray:
    """Places of the rows without further copies of a row beyond its first n."""
    _, same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(same[order]) != 0]))
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
    return np.sort(order[nth < n])


def _best_rows(queries: np.ndarray, items: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, item row, similarity)`` of each query's best items; of equal ones the earlier row.

    Single precision with a margin says which items can be among the best, double precision which are.
    """
    kept = _first_copies(np.ascontiguousarray(items), depth)
    items = items[kept]
    small = items.astype(np.float32)
    out = []
    for start in range(0, len(queries), QUERY_ROWS):
        some = queries[start : start + QUERY_ROWS]
        rough = some.astype(np.float32) @ small.T
        if rough.shape[1] > depth:
            first = rough[:, : max(FIRST_ITEMS, depth)]
            edge = -np.partition(-first, depth - 1, axis=1)[:, depth - 1 : depth] - 4e-7 * (items.shape[1] + 2)
            q, i = np.nonzero(~(rough < edge))
        else:
            q, i = (x.ravel() for x in np.indices(rough.shape))
        parts = [np.einsum("ij,ij->i", some[q[p : p + 100_000]], items[i[p : p + 100_000]]) for p in range(0, len(q), 100_000)]
        sims = np.round(np.concatenate(parts), 12) if parts else np.zeros(0)
        order = np.lexsort((i, -sims, q))
        q, i, sims = q[order], i[order], sims[order]
        starts = np.searchsorted(q, np.arange(len(some)))
        best = np.arange(len(q)) - starts[q] < depth
        out.append((q[best] + start, kept[i[best]], sims[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def level_depth(k: int, level: int) -> int:
    """Hits taken from one level: three times k on the base level, growing with the level above it."""
    return 3 * k if level == 0 else int(k * (1 + 0.5 * level))


def level_hits(
    items: DataFrame,
    queries: DataFrame,
    dim: int,
    k: int,
    levels: list[int],
    item_id: str = "id",
    item_vec: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "query_vec",
) -> tuple[DataFrame, int | None]:
    """``(query_id, level, item_id, raw, raw_rank)``: the best ``level_depth(k, level)`` items per query and level.

    The second value is the largest number of rows there can be, None when it is not known.
    """
    queries = queries.filter(F.col(query_vec).isNotNull()).select(
        F.col(query_id), resize(F.col(query_vec), dim).alias(query_vec)
    )
    rows = queries.limit(MAX_QUERY_ROWS + 1).collect()
    if len(rows) > MAX_QUERY_ROWS:
        return blocked_hits(items, queries, dim, k, levels, item_id, item_vec, query_id, query_vec), None
    spark = items.sparkSession
    qid_type = queries.schema[query_id].dataType.simpleString()
    iid_type = items.schema[item_id].dataType.simpleString()
    schema = f"query_id {qid_type}, level int, item_id {iid_type}, raw double"
    parameters = level_parameters(dim, max(levels)) if max(levels) > 0 else {}
    base = _unit_rows(np.array([r[1] for r in rows], dtype=np.float64).reshape(-1, dim))
    shared = spark.sparkContext.broadcast(
        {
            "ids": [r[0] for r in rows],
            "parameters": {lv: parameters[lv] for lv in levels if lv > 0},
            "queries": {lv: _unit_rows(to_level(base, lv, parameters)) for lv in levels} if len(rows) else {},
        }
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if side["ids"]:
            for batch in batches:
                vec, mask = as_matrix(batch.column(1), dim)
                if not len(vec):
                    continue
                ids = batch.column(0).filter(pa.array(mask)).to_numpy(zero_copy_only=False)
                vec = _unit_rows(vec)
                for lv in levels:
                    depth = level_depth(k, lv)
                    sims = _similarities(side["queries"][lv], to_level(vec, lv, side["parameters"]))
                    near = _narrow(sims, depth)
                    sims, cand = sims[:, near], np.broadcast_to(ids[near], (len(sims), len(near)))
                    if lv in kept:
                        sims = np.concatenate([kept[lv][0], sims], axis=1)
                        cand = np.concatenate([kept[lv][1], cand], axis=1)
                    order = np.lexsort((cand, -sims), axis=1)[:, :depth]
                    kept[lv] = (np.take_along_axis(sims, order, 1), np.take_along_axis(cand, order, 1))
        for lv, (sims, cand) in kept.items():
            width = sims.shape[1]
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(
                    {
                        "query_id": np.repeat(np.array(side["ids"]), width),
                        "level": np.full(sims.size, lv, dtype=np.int32),
                        "item_id": cand.ravel(),
                        "raw": sims.ravel(),
                    }
                ),
                preserve_index=False,
            )

    local = items.select(item_id, item_vec).mapInArrow(run, schema)
    return _cut(local, k, levels), len(rows) * sum(level_depth(k, lv) for lv in levels)


def _cut(hits: DataFrame, k: int, levels: list[int]) -> DataFrame:
    """Global ranking per query and level; ranks are limited before the shuffle."""
    depth = F.lit(0)
    for lv in levels:
        depth = F.when(F.col("level") == lv, level_depth(k, lv)).otherwise(depth)
    deepest = max(level_depth(k, lv) for lv in levels)
    rank = F.row_number().over(
        Window.partitionBy("query_id", "level").orderBy(F.col("raw").desc(), F.col("item_id"))
    )
    return (
        hits.withColumn("raw_rank", rank).filter(F.col("raw_rank") <= deepest).filter(F.col("raw_rank") <= depth)
    )


def blocked_hits(
    items: DataFrame,
    queries: DataFrame,
    dim: int,
    k: int,
    levels: list[int],
    item_id: str = "id",
    item_vec: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "query_vec",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The same hits for a query side of any size.

    Both sides are hashed into slices of at most about ``cell_rows`` rows; each pair of slices is
    one group, multiplied as matrices, that hands on its best rows only.
    """
    n_items, n_queries = items.count(), queries.count()
    spark = items.sparkSession
    query_slices = max(1, -(-n_queries // cell_rows))
    # enough cells for all cores
    item_slices = max(1, -(-n_items // cell_rows), -(-2 * spark.sparkContext.defaultParallelism // query_slices))
    shared = spark.sparkContext.broadcast(level_parameters(dim, max(levels)) if max(levels) > 0 else {})
    qid_type = queries.schema[query_id].dataType.simpleString()
    iid_type = items.schema[item_id].dataType.simpleString()
    schema = f"query_id {qid_type}, level int, item_id {iid_type}, raw double"
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (
        items.select(F.col(item_id).alias("i"), F.col(item_vec).alias("v"))
        .filter(F.size("v") > 0)
        .withColumn("is", F.pmod(F.xxhash64("i"), F.lit(item_slices)).cast("int"))
        .withColumn("qs", cells(query_slices))
    )
    right = (
        queries.select(F.col(query_id).alias("q"), F.col(query_vec).alias("w"))
        .filter(F.size("w") > 0)
        .withColumn("w", resize(F.col("w"), dim))
        .withColumn("qs", F.pmod(F.xxhash64("q"), F.lit(query_slices)).cast("int"))
        .withColumn("is", cells(item_slices))
    )

    def cell(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine = mine.sort_by("i")
        ids, qids = mine.column("i").combine_chunks(), theirs.column("q").combine_chunks()
        out = []
        if len(ids) and len(qids):
            iv = _unit_rows(as_matrix(mine.column("v").combine_chunks(), dim)[0])
            qv = _unit_rows(as_matrix(theirs.column("w").combine_chunks(), dim)[0])
            for lv in levels:
                q, i, sims = _best_rows(_unit_rows(to_level(qv, lv, shared.value)), to_level(iv, lv, shared.value), level_depth(k, lv))
                out.append((qids.take(pa.array(q)), pa.array(np.full(len(q), lv, dtype=np.int32)), ids.take(pa.array(i)), pa.array(sims)))
        names = ["query_id", "level", "item_id", "raw"]
        if not out:
            return pa.table([qids.slice(0, 0), pa.array([], pa.int32()), ids.slice(0, 0), pa.array([], pa.float64())], names=names)
        return pa.concat_tables([pa.table(list(columns), names=names) for columns in out])

    # a cell is heavy on the processor and light in bytes: partitions by number are not joined by their bytes
    n = item_slices * query_slices
    local = (
        left.repartition(n, "qs", "is").groupBy("qs", "is")
        .cogroup(right.repartition(n, "qs", "is").groupBy("qs", "is"))
        .applyInArrow(cell, schema)
    )
    return _cut(local, k, levels)


def attach_items(hits: DataFrame, items: DataFrame, max_rows: int | None) -> DataFrame:
    """Add the item columns to hits; the hits are broadcast when their number is bounded."""
    if max_rows is not None and max_rows <= MAX_BROADCAST_ROWS:
        hits = F.broadcast(hits)
    return items.withColumnRenamed("id", "item_id").join(hits, "item_id")


def penalised(raw: Column, flagged: Column, penalty: Column, factor: float = 0.3) -> Column:
    """Flagged items lose similarity and get no contrast; others are contrasted."""
    return F.when(flagged, raw * penalty).otherwise(enhance(raw, factor))


def standard_search(
    items: DataFrame,
    queries: DataFrame,
    dim: int,
    k: int = 5,
    min_similarity: float = 0.25,
    factor: float = 0.3,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Base-level top-k: keep similarities from ``min_similarity`` on, drop tombstones, penalise, re-rank.

    ``items`` has ``id, embedding, deleted, hallucination_detected, reliability_penalty``. Give
    ``vectors(id, embedding)`` when they are stored apart: then only they are scanned and the
    flags are joined to the few hits.
    """
    flags = items.select("id", "deleted", "hallucination_detected", "reliability_penalty")
    hits, bound = level_hits(items if vectors is None else vectors, queries, dim, k, [0])
    scored = attach_items(hits, flags, bound).filter((F.col("raw") >= min_similarity) & ~F.col("deleted")).withColumn(
        "similarity",
        penalised(F.col("raw"), F.col("hallucination_detected"), F.col("reliability_penalty"), factor),
    )
    rank = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("raw_rank"))
    )
    return (
        scored.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select(
            "query_id",
            "rank",
            "item_id",
            F.col("raw").alias("raw_similarity"),
            "similarity",
            F.col("hallucination_detected").alias("hallucination_warning"),
        )
    )


def score_level_hits(hits: DataFrame, min_similarity: float, factor: float = 0.3) -> DataFrame:
    """Thresholds and penalties on hits that carry their item's flags; adds ``base`` and ``enhanced``."""
    threshold = F.lit(min_similarity) * F.pow(F.lit(0.8), F.col("level"))
    flagged = F.col("hallucination_detected")
    base = F.when(flagged, F.col("raw") * F.col("reliability_penalty")).otherwise(F.col("raw"))
    return (
        hits.filter((F.col("raw") > threshold) & ~F.col("deleted"))
        .withColumn("base", base)
        .filter(F.col("base") > threshold)
        .withColumn("enhanced", F.when(flagged, F.col("base")).otherwise(enhance(F.col("base"), factor)))
    )


def merge_levels(scored: DataFrame) -> DataFrame:
    """One row per query and item, folding its levels in ascending order.

    The first sighting of a reliable item gets a bonus that grows with the level; a later
    level replaces the kept one only with a strictly higher rank score. The groups hold
    one entry per level, so they are small whatever the data.
    """
    entry = F.struct("level", "raw_rank", "base", "enhanced")
    grouped = scored.groupBy("query_id", "item_id").agg(
        F.sort_array(F.collect_list(entry)).alias("_e"),
        F.first("hallucination_detected").alias("hallucination_warning"),
        F.first(F.coalesce("hallucination_score", F.lit(0.0))).alias("_score"),
    )
    reliability = F.lit(1.0) - F.col("_score")

    def state(level: Column, base: Column, similarity: Column) -> Column:
        return F.struct(
            level.alias("level"),
            base.alias("raw"),
            similarity.alias("similarity"),
            base.alias("level_base"),
        )

    first = F.get("_e", F.lit(0))
    bonus = F.when(F.col("hallucination_warning"), first["enhanced"]).otherwise(
        F.least(F.lit(1.0), first["enhanced"] + first["level"] * 0.01)
    )
    folded = F.aggregate(
        F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 1, F.lit(0))),
        state(first["level"], first["base"], bonus),
        lambda acc, e: F.when(
            e["enhanced"] * reliability > acc["similarity"] * reliability,
            F.struct(
                e["level"].alias("level"),
                F.greatest(acc["raw"], e["base"]).alias("raw"),
                e["enhanced"].alias("similarity"),
                e["base"].alias("level_base"),
            ),
        ).otherwise(acc),
    )
    return (
        grouped.withColumn("_s", folded)
        .select(
            "query_id",
            "item_id",
            F.col("_s.level").alias("level"),
            F.col("_s.raw").alias("raw_similarity"),
            F.col("_s.similarity").alias("similarity"),
            (F.col("_s.similarity") * reliability).alias("rank_score"),
            "hallucination_warning",
            F.col("_s.level_base").alias("original_similarity"),
            (F.col("_s.similarity") - F.col("_s.level_base")).alias("enhancement"),
        )
    )


def cross_level_boost(scored: DataFrame, merged: DataFrame) -> DataFrame:
    """Opt-in boost for items found on two levels or more, from the hits before the merge."""
    weight = F.lit(1.0) + F.col("level") * 0.2
    agreement = (
        scored.groupBy("query_id", "item_id")
        .agg(F.count("*").alias("_n"), (F.sum(F.col("base") * weight) / F.sum(weight)).alias("_avg"))
        .filter(F.col("_n") > 1)
    )
    bonus = F.least(F.lit(0.2), F.col("_n") * 0.05)
    gain = bonus + F.col("_avg") * 0.1
    boosted = F.least(
        F.lit(1.0),
        F.col("similarity") * (F.lit(1.0) + F.when(F.col("similarity") > 0.7, gain).otherwise(gain * 0.6)),
    )
    return (
        merged.join(agreement, ["query_id", "item_id"], "left")
        .withColumn("similarity", F.when(F.col("_n").isNotNull(), boosted).otherwise(F.col("similarity")))
        .withColumn("cross_level_bonus", bonus)
        .withColumn("found_in_levels", F.coalesce("_n", F.lit(1)))
        .drop("_n", "_avg")
    )


def promote_diversity(ranked: DataFrame, k: int) -> DataFrame:
    """Greedy choice of k results per query, far from each other in words, reliable ones first.

    ``ranked`` has ``query_id, pos`` (1-based rank), ``hallucination_warning`` and ``content``.
    A query has at most a few times k candidates, so one array per query is bounded.
    Returns the chosen rows with ``pick``, the order in which they were chosen.
    """
    entry = F.struct(
        "pos",
        (~F.col("hallucination_warning")).alias("ok"),
        F.lit(float("inf")).alias("gap"),
        word_set(F.col("content")).alias("words"),
        F.struct(*[c for c in ranked.columns if c != "query_id"]).alias("row"),
    )
    grouped = (
        ranked.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("_all"))
        .withColumn("_rows", F.transform("_all", lambda c: c["row"]))
        .withColumn(
            "_pool", F.transform("_all", lambda c: F.struct(c["pos"].alias("pos"), c["ok"].alias("ok"), c["gap"].alias("gap"), c["words"].alias("words")))
        )
    )

    def step(acc: Column, _: Column) -> Column:
        pool = F.transform(
            acc["pool"],
            lambda c: F.struct(
                c["pos"].alias("pos"),
                c["ok"].alias("ok"),
                F.least(c["gap"], jaccard_distance(c["words"], acc["last"])).alias("gap"),
                c["words"].alias("words"),
            ),
        )

        def choose(p: Column) -> Column:
            best = F.array_max(
                F.transform(p, lambda c: F.struct(c["ok"].alias("ok"), c["gap"].alias("gap"), (-c["pos"]).alias("neg")))
            )
            return let(
                -best["neg"],
                lambda pick: F.struct(
                    F.concat(acc["chosen"], F.array(pick)).alias("chosen"),
                    F.filter(p, lambda c: c["pos"] != pick).alias("pool"),
                    F.get(F.filter(p, lambda c: c["pos"] == pick), F.lit(0))["words"].alias("last"),
                ),
            )

        return F.when(F.size(acc["pool"]) == 0, acc).otherwise(let(pool, choose))

    greedy = F.aggregate(
        F.sequence(F.lit(2), F.lit(max(k, 2))),
        F.struct(
            F.transform(F.slice("_pool", 1, 1), lambda c: c["pos"]).alias("chosen"),
            F.slice("_pool", F.lit(2), F.size("_pool")).alias("pool"),
            F.get("_pool", F.lit(0))["words"].alias("last"),
        ),
        step,
        lambda acc: acc["chosen"],
    )
    # with no more than k candidates the given order stays
    plain = F.transform("_pool", lambda c: c["pos"])
    order = F.slice(F.when(F.size("_pool") <= k, plain).otherwise(greedy), 1, k)
    return grouped.select("query_id", "_rows", F.posexplode(order).alias("_i", "_pos")).select(
        "query_id", (F.col("_i") + 1).alias("pick"), F.get("_rows", F.col("_pos") - 1).alias("_row")
    ).select("query_id", "pick", "_row.*")


def multi_level_search(
    items: DataFrame,
    queries: DataFrame,
    dim: int,
    k: int = 5,
    min_similarity: float = 0.25,
    levels: list[int] | None = None,
    factor: float = 0.3,
    verify: bool = False,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Search every level, merge, rank by reliability and promote diversity.

    ``items`` has ``id, content, embedding, deleted, hallucination_detected,
    hallucination_score, reliability_penalty``. Levels default to 1..3; add 0 to search
    the base level as well. ``vectors`` as for :func:`standard_search`.
    """
    levels = levels or [1, 2, 3]
    flags = items.select(
        "id", "deleted", "hallucination_detected", "hallucination_score", "reliability_penalty"
    )
    hits, bound = level_hits(items if vectors is None else vectors, queries, dim, k, levels)
    scored = score_level_hits(attach_items(hits, flags, bound), min_similarity, factor)
    merged = merge_levels(scored)
    if verify:
        merged = cross_level_boost(scored, merged)
    pos = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.col("rank_score").desc(), F.col("item_id"))
    )
    ranked = attach_items(merged.withColumn("pos", pos), items.select("id", "content"), bound)
    return promote_diversity(ranked, k).select(
        "query_id",
        F.col("pick").alias("rank"),
        "item_id",
        "level",
        "raw_similarity",
        "similarity",
        "rank_score",
        "hallucination_warning",
    )


def filter_by_metadata(hits: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Keep hits whose metadata columns equal all given values."""
    for name, value in conditions.items():
        hits = hits.filter(F.col(name).eqNullSafe(F.lit(value)))
    return hits


def deduplicate(hits: DataFrame, content: str = "content", similarity: str = "similarity", tie: str = "item_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Keep the most similar of texts that agree up to case and punctuation.

    Equal texts agree in the looser form too, so one key decides. The best row per key is
    an aggregate with map-side combine: a text copied many times leaves one row per task.
    """
    bare = F.lower(F.regexp_replace(F.col(content), r"(?U)^\s+|\s+\z", ""))
    key = F.md5(F.regexp_replace(bare, r"(?U)\W+", " "))
    others = [c for c in hits.columns if c not in by]
    best = F.max_by(F.struct(*others), F.struct(F.col(similarity).alias("s"), (-F.col(tie)).alias("t")))
    return hits.groupBy(*by, key.alias("_key")).agg(best.alias("_b")).select(*by, "_b.*")


def memory_support(hits: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Per query: number of hits, best similarity and whether it supports an answer (above 0.3)."""
    return hits.groupBy("query_id").agg(
        F.count("*").alias("memory_count"),
        F.max(similarity).alias("best_similarity"),
        (F.max(similarity) > 0.3).alias("memory_supported"),
    )
