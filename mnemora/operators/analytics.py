"""Embedding-space analytics: similarity by category, projections, fingerprints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.vectors import resize, unit


def category_similarity(items: DataFrame, category: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean cosine of all pairs between and within categories, ``(a, b, pairs, mean_similarity)``.

    The sum of cosines over all pairs of two groups is the dot product of the groups'
    summed unit vectors, so the matrix comes from one pass over the items and never
    forms a pair of items. Within a category each item's pair with itself is left out.
    """
    sums = (
        items.filter(F.col(vec).isNotNull())
        .select(F.col(category).alias("c"), F.posexplode(unit(F.col(vec))).alias("pos", "x"))
        .groupBy("c", "pos")
        .agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    )
    left = sums.select("pos", F.col("c").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"), "q")
    right = sums.select("pos", F.col("c").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"))
    both = left.join(right, "pos").filter(F.col("a") <= F.col("b")).groupBy("a", "b").agg(
        F.sum(F.col("sa") * F.col("sb")).alias("_dot"),
        F.sum("q").alias("_self"),
        F.max("na").alias("_na"),
        F.max("nb").alias("_nb"),
    )
    same = F.col("a") == F.col("b")
    pairs = F.when(same, F.col("_na") * (F.col("_na") - 1) / 2).otherwise(F.col("_na") * F.col("_nb")).cast("bigint")
    whole = F.when(same, (F.col("_dot") - F.col("_self")) / 2).otherwise(F.col("_dot"))
    return both.select("a", "b", pairs.alias("pairs"), F.when(pairs > 0, whole / pairs).alias("mean_similarity"))


def similar_pairs(items: DataFrame, dim: int, min_similarity: float, cell_rows: int = 20_000, vec: str = "embedding") -> DataFrame:
    """Pairs ``(a, b, similarity)`` of items with a cosine of at least ``min_similarity``, exact.

    Ids are hashed into slices; a pair of slices is one group, multiplied as matrices, that
    emits only the pairs above the bound. Work grows with the square of the items, as the
    full matrix does; the memory of a group does not.
    """
    import pandas as pd

    rows = items.filter(F.col(vec).isNotNull()).select("id", resize(F.col(vec), dim).alias("v"))
    slices = max(1, -(-rows.count() // cell_rows))
    sliced = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    # slice s meets every slice t >= s: it is sent as the left side to its own row, as the right side to its column
    left = sliced.select("id", "v", F.col("s").alias("i"), F.explode(F.sequence(F.col("s"), F.lit(slices - 1))).alias("j"))
    right = sliced.select("id", "v", F.explode(F.sequence(F.lit(0), F.col("s"))).alias("i"), F.col("s").alias("j"))

    def cell(key, mine, theirs):
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        scale = lambda f: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10))(
            np.array(f["v"].tolist(), dtype=np.float64)
        )
        sims = scale(mine) @ scale(theirs).T
        x, y = mine["id"].to_numpy(), theirs["id"].to_numpy()
        hit = sims >= min_similarity
        # the same slice on both sides holds each pair twice
        hit &= x[:, None] < y[None, :] if key[0] == key[1] else x[:, None] != y[None, :]
        r, c = np.nonzero(hit)
        return pd.DataFrame({"a": np.minimum(x[r], y[c]), "b": np.maximum(x[r], y[c]), "similarity": sims[r, c]})

    id_type = items.schema["id"].dataType.simpleString()
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(
        cell, f"a {id_type}, b {id_type}, similarity double"
    )


def category_ids(items: DataFrame, category: str) -> DataFrame:
    """``category, colour``: dense ids of the sorted categories; only distinct values are ranked."""
    values = items.select(F.coalesce(F.col(category).cast("string"), F.lit("unknown")).alias("category")).distinct()
    return values.withColumn("colour", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("category")) - 1))


def principal_axes(vectors: DataFrame, dim: int, k: int, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, explained share): from sums and products gathered per task, one D x D matrix each.

    Vectors of another length are resized to ``dim``.
    """
    import pandas as pd

    def moments(frames):
        n, s, p = 0, np.zeros(dim), np.zeros((dim, dim))
        for frame in frames:
            if len(frame):
                m = np.array(frame[vec].tolist(), dtype=np.float64)
                n, s, p = n + len(m), s + m.sum(0), p + m.T @ m
        if n:
            i = np.arange(dim)
            yield pd.DataFrame({"i": np.full(dim, -1), "j": i, "x": s})
            yield pd.DataFrame({"i": np.repeat(i, dim), "j": np.tile(i, dim), "x": p.ravel()})
            yield pd.DataFrame({"i": [-2], "j": [0], "x": [float(n)]})

    # the driver receives dim*dim + dim + 1 sums whatever the number of vectors
    sums = (
        vectors.filter(F.col(vec).isNotNull()).select(resize(F.col(vec), dim).alias(vec)).mapInPandas(moments, "i int, j int, x double")
        .groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    )
    mean, product, n = np.zeros(dim), np.zeros((dim, dim)), 0.0
    for i, j, x in sums:
        if i == -2:
            n = x
        elif i == -1:
            mean[j] = x
        else:
            product[i, j] = x
    mean = mean / max(n, 1.0)
    covariance = (product - n * np.outer(mean, mean)) / max(n - 1.0, 1.0)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:k]
    axes = axes[:, order].T
    # the sign of an axis is arbitrary: its largest entry is made positive
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return mean, axes, values[order] / max(values.sum(), 1e-300)


def project(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray, vec: str = "vec", names: str = "xyz") -> DataFrame:
    """Add one coordinate column per axis; vectors of another length are resized to that of the axes."""
    spread = [float(a @ mean) for a in axes]

    def coordinate(axis: np.ndarray, shift: float) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in axis])
        return F.aggregate(
            F.zip_with(resize(F.col(vec), len(axis)), weights, lambda v, w: v.cast("double") * w), F.lit(0.0), lambda a, b: a + b
        ) - F.lit(shift)

    return vectors.withColumns({names[i]: coordinate(axes[i], spread[i]) for i in range(len(axes))})


def retrieval_map(items: DataFrame, dim: int) -> DataFrame:
    """``id, x, y, retrieval_count, size``: plane projection with a mark size per retrieval count."""
    rows = items.filter(F.col("embedding").isNotNull()).withColumnRenamed("embedding", "vec")
    mean, axes, _ = principal_axes(rows, dim, 2)
    return project(rows, mean, axes).select(
        "id", "x", "y", "retrieval_count", (F.lit(50) + F.col("retrieval_count") * 20).alias("size")
    )


def with_base_level(items: DataFrame, levels: DataFrame) -> DataFrame:
    """Long table ``item_id, level, vec`` with the base vectors as level 0."""
    base = items.filter(F.col("embedding").isNotNull()).select(
        F.col("id").alias("item_id"), F.lit(0).alias("level"), F.col("embedding").alias("vec")
    )
    return base.unionByName(levels.filter(F.exists("vec", lambda x: x != 0)))


def _ranges(points: DataFrame, columns: list[str]) -> dict[int, dict[str, tuple[float, float]]]:
    """Smallest and largest coordinate per level; one row per level reaches the driver."""
    aggregates = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    rows = points.groupBy("level").agg(*aggregates).collect()
    return {r["level"]: {c: (r[f"lo_{c}"], max(1e-6, r[f"hi_{c}"] - r[f"lo_{c}"])) for c in columns} for r in rows}


def _by_level(values: dict[int, float]) -> Column:
    out = F.lit(None).cast("double")
    for level, value in values.items():
        out = F.when(F.col("level") == level, F.lit(float(value))).otherwise(out)
    return out


def flow_map(items: DataFrame, levels: DataFrame, dim: int) -> DataFrame:
    """``item_id, level, x, y``: every level in its own lane, both axes scaled per level.

    The edge of an item runs from its level 0 point to each of its other points.
    """
    long = with_base_level(items, levels)
    mean, axes, _ = principal_axes(long, dim, 2)
    points = project(long, mean, axes).drop("vec")
    ranges = _ranges(points, ["x", "y"])
    lanes = {lv: i / max(1, len(ranges) - 1) for i, lv in enumerate(sorted(ranges))}
    scaled = lambda c: (F.col(c) - _by_level({lv: r[c][0] for lv, r in ranges.items()})) / _by_level(
        {lv: r[c][1] for lv, r in ranges.items()}
    )
    return points.select(
        "item_id", "level", (_by_level(lanes) + scaled("x") * 0.2 - 0.1).alias("x"), scaled("y").alias("y")
    )


def ring_map(items: DataFrame, levels: DataFrame, dim: int) -> DataFrame:
    """``item_id, level, radius, theta``: polar coordinates, base items inside, levels in outer rings."""
    long = with_base_level(items, levels)
    mean, axes, _ = principal_axes(long, dim, 2)
    points = project(long, mean, axes).drop("vec")
    ranges = _ranges(points, ["x", "y"])
    low = lambda c: _by_level({lv: r[c][0] for lv, r in ranges.items()})
    wide = lambda c: _by_level({lv: r[c][1] for lv, r in ranges.items()})
    polar = points.withColumn(
        "_r", F.hypot((F.col("x") - low("x")) / wide("x"), (F.col("y") - low("y")) / wide("y"))
    ).withColumn("theta", F.atan2(F.col("y") - low("y"), F.col("x") - low("x")))
    longest = {r["level"]: max(r["m"], 1e-6) for r in polar.groupBy("level").agg(F.max("_r").alias("m")).collect()}
    outer = [lv for lv in sorted(longest) if lv > 0]
    width = 0.6 / max(1, len(outer))
    share = F.col("_r") / _by_level(longest)
    ring = F.lit(0.4) + _by_level({lv: i * width for i, lv in enumerate(outer)}) + share * width
    return polar.select(
        "item_id", "level", F.when(F.col("level") == 0, share * 0.4).otherwise(ring).alias("radius"), "theta"
    )


def space_map(items: DataFrame, levels: DataFrame, dim: int) -> DataFrame:
    """``item_id, level, x, y, z``: three axes fitted on the base vectors, applied to every level."""
    base = items.filter(F.col("embedding").isNotNull()).withColumnRenamed("embedding", "vec")
    mean, axes, _ = principal_axes(base, dim, 3)
    return project(with_base_level(items, levels), mean, axes).select("item_id", "level", "x", "y", "z")


def fingerprints(items: DataFrame, levels: DataFrame, top: int = 9, width: int = 50) -> DataFrame:
    """The most interesting items' vectors per level: first ``width`` values over the largest magnitude.

    Interest is 10 per retrieval, 20 for a known category and 50 for having level vectors,
    which is required. The choice is a distributed top-k.
    """
    known = F.coalesce(F.col("main_category"), F.lit("unknown")) != "unknown"
    with_level = levels.filter(F.exists("vec", lambda x: x != 0)).select(F.col("item_id").alias("id")).distinct()
    score = F.col("retrieval_count") * 10 + F.when(known, 20).otherwise(0) + 50
    chosen = (
        items.join(with_level, "id", "left_semi")
        .withColumn("score", score)
        .orderBy(F.col("score").desc(), "id")
        .limit(top)
    )
    marks = F.broadcast(chosen.select(F.col("id").alias("item_id"), "score"))
    long = with_base_level(items, levels).join(marks, "item_id")
    part = F.transform(F.slice("vec", 1, width), lambda x: x.cast("double"))
    largest = F.array_max(F.transform(part, F.abs))
    return long.select(
        "item_id", "score", "level", F.transform(part, lambda x: x / F.greatest(largest, F.lit(1e-10))).alias("values")
    )


def best_batch_size(runs: DataFrame) -> DataFrame:
    """Throughput per batch size and which size is fastest, from ``batch_size, items, seconds`` rows."""
    per_size = runs.groupBy("batch_size").agg(
        F.sum("items").alias("items"), F.sum("seconds").alias("seconds")
    ).withColumn("items_per_second", F.when(F.col("seconds") > 0, F.col("items") / F.col("seconds")).otherwise(0.0))
    best = per_size.agg(
        F.max_by("batch_size", F.struct("items_per_second", -F.col("batch_size"))).alias("best")
    )
    # one row: the fastest size
    return per_size.join(F.broadcast(best), F.col("batch_size") == F.col("best"), "left").select(
        "batch_size", "items", "items_per_second", F.col("best").isNotNull().alias("is_best")
    )


def preview(items: DataFrame, limit: int = 100, width: int = 100) -> DataFrame:
    """The first items by id with a text preview."""
    return items.orderBy("id").limit(limit).withColumn("content_preview", F.substring("content", 1, width))
