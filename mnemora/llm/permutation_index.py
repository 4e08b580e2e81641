"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. It is posted in the inverted files of its
first ``POSTED`` pivots; a query visits the files of its first ``VISITED`` pivots, ranks what it finds there
by the footrule distance of the permutations and computes true distances for the best share and its ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.llm.common import saved

# The pivots are a bounded sample of each vector length; every vector is indexed.
PIVOTS, DEPTH, POSTED, VISITED = 256, 48, 4, 64
# Share of a file that is compared exactly for vectors up to SHARE_DIM components, and the least number.
# Permutations tell less about longer vectors, so the share grows with their length.
RERANKED, SHARE_DIM, LEAST_RERANKED = 0.25, 64, 64
# Rows of a file and queries that meet in one task; longer ones are cut into blocks.
FILE_ROWS, FILE_QUERIES = 20_000, 2_000
KEY = ["dim", "pivot", "block", "query_block"]


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding) rows that can take part: not null, not zero, all components finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id is not null and embedding is not null").where(fine & some).distinct()


def permutations(rows: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """For each row the numbers of its nearest pivots, nearest first."""
    distance = (pivots**2).sum(axis=1) - 2.0 * rows @ pivots.T
    return np.argsort(distance, axis=1, kind="stable")[:, :depth].astype(np.int32)


def ranks(order: np.ndarray, pivots: int) -> np.ndarray:
    """Place of every pivot in each permutation; pivots beyond its depth get the depth."""
    depth = order.shape[1]
    out = np.full((len(order), pivots), depth, dtype=np.int16)
    out[np.arange(len(order))[:, None], order] = np.arange(depth, dtype=np.int16)
    return out


def posted(classes: DataFrame, pivots: dict[int, np.ndarray], files: int, depth: int) -> DataFrame:
    """One row per class and file: dim, pivot, class, order, embedding."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                p = pivots.get(int(dim))
                if p is None:  # only if the sample missed a rare dimension
                    p = np.zeros((1, int(dim)))
                order = permutations(np.stack(part["embedding"].to_numpy()), p, depth)
                each = min(files, order.shape[1])
                yield pd.DataFrame(
                    {
                        "dim": int(dim),
                        "pivot": order[:, :each].ravel(),
                        "class": np.repeat(part["class"].to_numpy(), each),
                        "order": list(np.repeat(order, each, axis=0)),
                        "embedding": list(np.repeat(np.stack(part["embedding"].to_numpy()), each, axis=0)),
                    }
                )

    kind = "dim int, pivot int, class bigint, order array<int>, embedding array<double>"
    return classes.select("class", "embedding").mapInPandas(post, kind)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _search(k: int, pivots: int, exact: bool):
    """Best k classes of one file block for each query of one query block."""

    def search(queries: pa.Table, file: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "class": [], "score": []}
        if len(queries) and len(file):
            rows, ids = _matrix(file["embedding"]), np.asarray(file["class"])
            places = ranks(_matrix(file["order"]), pivots)
            share = 1.0 if exact else RERANKED * max(1.0, rows.shape[1] / SHARE_DIM)
            keep = min(len(rows), max(LEAST_RERANKED, int(len(rows) * share)))
            asked = zip(
                np.asarray(queries["class"]), _matrix(queries["embedding"]),
                ranks(_matrix(queries["order"]), pivots), strict=True,
            )
            for query, vector, place in asked:
                footrule = np.abs(places - place).sum(axis=1, dtype=np.int32)
                # All that ties with the last one is compared too, so no row is left out arbitrarily.
                near = np.flatnonzero(footrule <= np.partition(footrule, keep - 1)[keep - 1])
                score = np.sqrt(((rows[near] - vector) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], score))[:k]
                out["query"].append(np.full(len(best), query))
                out["class"].append(ids[near][best])
                out["score"].append(score[best])
        types = {"query": pa.int64(), "class": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], types[c]) for c, v in out.items()})

    return search


def nearest(vectors: DataFrame, query_step: int = 100, k: int = 10, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose vec_id divides by ``query_step``.

    Equal vectors form one class, which is indexed once. Of a class only the k + 1 smallest ids can be
    among anyone's nearest, since ties go to the smaller id and a query leaves out at most its own; so
    no group of copies is expanded. Classes whose file is long are cut into blocks, and so are queries.

    With ``exact`` each vector is posted once, a query visits the files of all pivots and everything in them
    is compared, so nothing near is missed; the work is that of comparing all queries with all rows.

    Vectors that are null, zero or have null or non-finite components take no part, nor do rows of
    null id. Vectors of different lengths are never neighbours. Repeated rows count once; a table with
    fewer than k others gives all of them; an empty one gives an empty result.
    """
    rows = saved(usable(vectors), "vectors")
    spark = rows.sparkSession
    # Only the k + 1 smallest ids of a class leave the window; WindowGroupLimit drops the rest before the shuffle.
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    members = rows.withColumn("n", first).where(F.col("n") <= k + 1)
    classes = members.groupBy("embedding").agg(F.min("vec_id").alias("class"), F.collect_list("vec_id").alias("ids"))
    classes = saved(classes, "classes")
    asked = rows.where(F.col("vec_id") % query_step == 0).withColumnRenamed("vec_id", "query_id")
    asked = saved(asked.join(classes.select("embedding", "class"), "embedding").select("query_id", "class"), "asked")

    # A sample for each length; WindowGroupLimit keeps PIVOTS rows of it before the shuffle.
    drawn = F.row_number().over(Window.partitionBy(F.size("embedding")).orderBy(F.xxhash64("class"), "class"))
    picked = classes.withColumn("n", drawn).where(F.col("n") <= PIVOTS).select("embedding").collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(len(r["embedding"]), []).append(r["embedding"])
    pivots = {d: np.array(p, dtype=np.float64) for d, p in by_dim.items()}

    depth, posts, visited = (PIVOTS, 1, PIVOTS) if exact else (DEPTH, POSTED, VISITED)
    files = saved(posted(classes, pivots, posts, depth), "files")
    visits = posted(classes.join(asked.select("class").distinct(), "class", "left_semi"), pivots, visited, depth)
    visits = saved(visits, "visits")

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        """At most PIVOTS rows for each dimension."""
        return df.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    sizes = blocks(files, FILE_ROWS, "n_blocks").join(blocks(visits, FILE_QUERIES, "n_query_blocks"), ["dim", "pivot"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    left = visits.join(sizes, ["dim", "pivot"]).withColumn("query_block", own("n_query_blocks")).withColumn("block", every("n_blocks"))
    right = files.join(sizes, ["dim", "pivot"]).withColumn("block", own("n_blocks")).withColumn("query_block", every("n_query_blocks"))
    columns = [*KEY, "class", "order", "embedding"]
    found = (
        left.select(*columns)
        .groupBy(*KEY)
        .cogroup(right.select(*columns).groupBy(*KEY))
        .applyInArrow(_search(k + 1, PIVOTS, exact), "query bigint, class bigint, score double")
    )
    top = Window.partitionBy("query").orderBy("score", "class")
    best = (
        found.distinct().withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).drop("n")
    )
    listed = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.select("query_id", F.col("class").alias("query")).join(listed, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (
        pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    )
