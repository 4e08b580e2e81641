"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings.

Two levels of split points divide the vectors: each goes to the nearest split point and there to the nearest point
of the second level. Every split point stores the least and the largest distance to each sibling's subtree. A
question is a window of scores around an anchor, in space a shell between two radii; a sibling is
eliminated where the shell's distances from some split point and the stored range do not meet. Leaves that stay are
compared exactly, so the tree decides only what is skipped, never what is found.

Inner products become distances by one more coordinate: with ``|x|^2 + extra^2 = M^2`` for every row and 0 for an anchor,
``d^2 = |a|^2 + M^2 - 2 <a, x>``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.llm.common import saved

# Split points come from a bounded sample of all rows; every row is indexed.
SAMPLE_ROWS, MAX_FANOUT, LEAF_ROWS = 8192, 64, 256
# Rows that a task holds at once, by the size of the table; longer leaves are cut.
LEAST_GROUP, MOST_GROUP = 4096, 65_536
# Leaves searched first, whose finds narrow the windows.
SEED_LEAVES = 3
# Squared lengths stay below this, so that 100 times a score is a long.
MAX_NORM = 2.0**56
FAR = 2**61
# Scores computed at once.
BLOCK_SCORES = 2_000_000


@dataclass
class Tree:
    """The split points of one vector length, augmented; leaves of child j are numbered from ``first[j]``."""

    upper: np.ndarray
    lower: list[np.ndarray]
    first: np.ndarray
    ranges: dict[int, tuple[np.ndarray, np.ndarray]]
    groups: dict[int, list[int]]


def augmented(rows: np.ndarray, most: float) -> np.ndarray:
    """Rows as doubles with the coordinate that gives all of them the length of the longest."""
    x = rows.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0.0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to n distinct rows, each the farthest from those before it."""
    chosen, near = [0], distances(rows, rows[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def grown(sample: np.ndarray, rows: float, most: float) -> Tree:
    """Split points for about ``rows`` rows."""
    points = augmented(sample, most)
    fanout = int(min(MAX_FANOUT, max(1, np.ceil(np.sqrt(rows / LEAF_ROWS)))))
    upper = far_apart(points, fanout)
    child = distances(points, upper).argmin(axis=1)
    lower = [far_apart(points[child == j], fanout) if (child == j).any() else upper[j : j + 1] for j in range(len(upper))]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lower])])
    return Tree(upper, lower, first, {}, {})


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The integer rows of a list column, all of one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.int64).reshape(len(flat), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """The rows of each vector length in a batch, with their places."""
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, batch.take(pa.array(at))


def mining_classes(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(cls, dim, label, vec, norm, first_id, ids) of equal vectors of a label, and (vec_id, cls) of all rows.

    Equal rows are indexed once. Of a class only the ``keep`` smallest ids can be among anyone's first, so a group of
    copies is never expanded.
    """
    cls = F.md5(F.concat_ws(":", "label", F.concat_ws(",", F.col("vec").cast("array<string>"))))
    named = saved(rows.withColumn("cls", cls).distinct(), "mining-rows")
    first = F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))
    ids = named.select("cls", "vec_id").withColumn("n", first).where(F.col("n") <= keep)
    ids = ids.groupBy("cls").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    vectors = named.select("cls", "label", "vec").dropDuplicates(["cls"])
    classes = vectors.join(ids, "cls").withColumns({"dim": F.size("vec"), "norm": norm, "first_id": F.get("ids", F.lit(0))})
    return saved(classes, "mining-classes"), named.select("vec_id", "cls")


def indexed(classes: DataFrame) -> tuple[DataFrame, dict[int, Tree], float]:
    """Classes with their leaf and group, the trees by length, the common squared length.

    Lengths that the sample misses have no tree; their rows share blocks that all questions of such
    lengths visit.
    """
    spark = classes.sparkSession
    n, most = classes.agg(F.count("*"), F.max("norm")).first()
    most = (most or 0.0) * (1 + 1e-9) + 1.0
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE_ROWS).select("vec").toArrow()["vec"].to_pylist()
    by_dim: dict[int, list] = {}
    for vec in sample:
        by_dim.setdefault(len(vec), []).append(vec)
    trees = {
        d: grown(np.array(v, dtype=np.int64).reshape(len(v), d), n * len(v) / max(1, len(sample)), most)
        for d, v in by_dim.items()
    }
    sent = spark.sparkContext.broadcast(trees)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(len(batch), dtype=np.int32)
            for dim, at, part in _by_dim(batch):
                if dim not in sent.value:
                    leaf[at] = -1
                    continue
                tree = sent.value[dim]
                points = augmented(_vectors(part.column("vec"), dim), most)
                child = distances(points, tree.upper).argmin(axis=1)
                for j in np.unique(child):
                    own = child == j
                    leaf[at[own]] = tree.first[j] + distances(points[own], tree.lower[j]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    kind = "cls string, dim int, label bigint, vec array<bigint>, first_id bigint, leaf int"
    leaves = saved(classes.select("cls", "dim", "label", "vec", "first_id").mapInArrow(assigned, kind), "leaves")

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def widened(key: tuple[int, int], split: np.ndarray, points: np.ndarray, part: np.ndarray) -> None:
            if key not in found:
                shape = (len(split), len(split))
                found[key] = np.full(shape, np.inf), np.full(shape, -np.inf)
            low, high = found[key]
            far = distances(points, split)
            for j in np.unique(part):
                own = far[part == j]
                low[:, j] = np.minimum(low[:, j], own.min(axis=0))
                high[:, j] = np.maximum(high[:, j], own.max(axis=0))

        for batch in batches:
            for dim, _, part in _by_dim(batch):
                if dim not in sent.value:
                    continue
                tree, leaf = sent.value[dim], np.asarray(part.column("leaf"))
                points = augmented(_vectors(part.column("vec"), dim), most)
                child = np.searchsorted(tree.first, leaf, side="right") - 1
                widened((dim, -1), tree.upper, points, child)
                for j in np.unique(child):
                    own = child == j
                    widened((dim, int(j)), tree.lower[j], points[own], leaf[own] - tree.first[j])
        rows = [
            (dim, node, i, j, float(low[i, j]), float(high[i, j]))
            for (dim, node), (low, high) in found.items()
            for i, j in zip(*np.nonzero(low <= high), strict=True)
        ]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        columns = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "node", "i", "j", "low", "high"])

    kind = "dim int, node int, i int, j int, low double, high double"
    ranges = leaves.select("dim", "vec", "leaf").mapInArrow(ranged, kind)
    # At most MAX_FANOUT entries for each leaf of the trees.
    for dim, node, i, j, low, high in ranges.groupBy("dim", "node", "i", "j").agg(F.min("low"), F.max("high")).collect():
        tree = trees[dim]
        if node not in tree.ranges:
            m = len(tree.upper if node < 0 else tree.lower[node])
            tree.ranges[node] = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        tree.ranges[node][0][i, j], tree.ranges[node][1][i, j] = low, high
    return _grouped(leaves, trees, n), trees, most


def _grouped(leaves: DataFrame, trees: dict[int, Tree], n: int) -> DataFrame:
    """Leaves with ``grp``: neighbouring leaves up to a number of rows together, long leaves in several groups."""
    size = int(min(MOST_GROUP, max(LEAST_GROUP, n // 64)))
    counts = leaves.groupBy(F.when(F.col("leaf") >= 0, F.col("dim")).alias("dim"), "leaf").count().collect()
    at, filled, starts = -1, size, {}
    for dim, leaf, count in sorted(counts, key=lambda r: (r["dim"] or 0, r["leaf"])):
        blocks = -(-count // size)
        if blocks > 1 or filled + count > size:
            at, filled = at + 1, 0
        starts[-1 if dim is None else dim, leaf] = (at, blocks)
        groups = list(range(at, at + blocks))
        if dim is not None:
            trees[dim].groups[leaf] = groups
        else:
            trees[-1] = Tree(np.empty(0), [], np.empty(0), {}, {-1: groups})
        at, filled = at + blocks - 1, size if blocks > 1 else filled + count
    sent = leaves.sparkSession.sparkContext.broadcast(starts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = []
            for dim, leaf, turn in zip(*(batch.column(c).to_pylist() for c in ("dim", "leaf", "turn")), strict=True):
                start, blocks = sent.value[dim if leaf >= 0 else -1, leaf]
                grp.append(start + turn % blocks)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grp, pa.int32())], names=[*batch.schema.names, "grp"])

    turn = F.pmod(F.xxhash64("cls"), F.lit(2**31)).alias("turn")
    kind = "cls string, dim int, label bigint, vec array<bigint>, first_id bigint, leaf int, turn bigint, grp int"
    return saved(leaves.select("*", turn).mapInArrow(dealt, kind).drop("turn"), "leaf-groups")


def open_leaves(tree: Tree, anchor: np.ndarray, windows: np.ndarray, most: float) -> tuple[list[int], list[int]]:
    """Leaves that may hold a score of some window (rows: lo, hi), and the ones nearest to the anchor."""
    point = np.append(anchor.astype(np.float64), 0.0)[None, :]
    far = (point**2).sum() + most
    slack = 4.0 * np.sqrt(far * point.shape[1] * 2.3e-16)
    outer = np.sqrt(np.maximum(far - 2.0 * windows[:, 0], 0.0)) + slack
    inner = np.sqrt(np.maximum(far - 2.0 * windows[:, 1], 0.0)) - slack

    def met(node: int, from_split: np.ndarray) -> np.ndarray:
        """Which children the ranges of no split point eliminate for some window."""
        low, high = tree.ranges[node]
        d = from_split[None, :, None]
        least = np.maximum(np.maximum(d - outer[:, None, None], inner[:, None, None] - d), 0.0)
        meets = (least <= high[None] + slack) & (d + outer[:, None, None] >= low[None] - slack)
        return meets.all(axis=1).any(axis=0)

    upper = distances(point, tree.upper)[0]
    lower = {j: distances(point, tree.lower[j])[0] for j in tree.ranges if j >= 0}
    leaves = [
        int(tree.first[j] + i)
        for j in np.flatnonzero(met(-1, upper))
        if j in lower
        for i in np.flatnonzero(met(int(j), lower[j]))
        if tree.first[j] + i in tree.groups
    ]
    near = [(d, int(tree.first[j] + i)) for j, ds in lower.items() for i, d in enumerate(ds) if tree.first[j] + i in tree.groups]
    return leaves, [leaf for _, leaf in sorted(near)[:SEED_LEAVES]]


VISIT = "grp int, cls string, dim int, label bigint, vec array<bigint>, windows array<struct<w:int,lo:bigint,hi:bigint>>, leaves array<int>"


def visits(asked: DataFrame, trees, most: float, seeds: bool) -> DataFrame:
    """One row per question and group of leaves that it visits, with these leaves."""

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, groups, lists = [], [], []
            windows = batch.column("windows").to_pylist()
            for dim, at, part in _by_dim(batch):
                tree = trees.value.get(dim)
                vectors = _vectors(part.column("vec"), dim)
                for i, vector in zip(at, vectors, strict=True):
                    to: dict[int, list[int]] = {}
                    if tree is None:
                        to = {} if seeds else {g: [-1] for g in trees.value[-1].groups[-1]}
                    else:
                        shells = np.array([[w["lo"], w["hi"]] for w in windows[i]], dtype=np.float64)
                        met, near = open_leaves(tree, vector, shells, most)
                        for leaf in near if seeds else sorted(set(met) - set(near)):
                            for g in tree.groups[leaf]:
                                to.setdefault(g, []).append(leaf)
                    rows += [i] * len(to)
                    groups += to.keys()
                    lists += to.values()
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int32()), *out.columns, pa.array(lists, pa.list_(pa.int32()))],
                names=["grp", *out.schema.names, "leaves"],
            )

    return asked.select("cls", "dim", "label", "vec", "windows").mapInArrow(planned, VISIT)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    most = np.sqrt((x**2).sum(axis=1).max(initial=0.0)) * np.sqrt((y**2).sum(axis=1).max(initial=0.0))
    if most < 2**52:  # every partial sum is an exact double
        return (x @ y.T).astype(np.int64)
    return a @ b.T


def first_rows(found: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k largest allowed entries of each row; of equal ones the first columns."""
    if not allowed.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    held = np.where(allowed, found, np.iinfo(np.int64).min)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        allowed = allowed & (held >= least[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -held[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


FOUND = "cls string, w int, other string, first_id bigint, score bigint"


def compared(leaves: DataFrame, visited: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(cls, w, other, first_id, score): the first k of each question's window in each group, by exact scores.

    The rows of a group are read first and kept, at most about ``MOST_GROUP`` twice; the questions then stream by.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    base = leaves.select("grp", F.lit(0).alias("kind"), "cls", "dim", "label", "vec", "first_id", "leaf",
                         nothing("array<struct<w:int,lo:bigint,hi:bigint>>").alias("windows"), nothing("array<int>").alias("leaves"))
    asked = visited.select("grp", F.lit(1).alias("kind"), "cls", "dim", "label", "vec", nothing("bigint").alias("first_id"),
                           nothing("int").alias("leaf"), "windows", "leaves")
    # Groups that nobody visits are not sent.
    base = base.join(visited.select("grp").distinct(), "grp", "left_semi")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, kept = [], None, {}

        def opened() -> dict:
            """Rows of the group by (length, leaf), by smallest id."""
            table = pa.Table.from_batches(held).sort_by([("first_id", "ascending"), ("cls", "ascending")])
            dims, leaf = np.asarray(table["dim"]), np.asarray(table["leaf"])
            out = {}
            for dim, number in sorted(set(zip(dims.tolist(), leaf.tolist(), strict=True))):
                part = table.take(pa.array(np.flatnonzero((dims == dim) & (leaf == number))))
                out[dim, number] = (
                    _vectors(part["vec"], dim), np.asarray(part["label"]), part["cls"], part["first_id"]
                )
            return out

        for batch in batches:
            kinds, groups = np.asarray(batch.column("kind")), np.asarray(batch.column("grp"))
            cuts = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(groups) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if kinds[low] == 0:
                    if groups[low] != group:
                        held, group = [], groups[low]
                    held.append(part)
                    kept = {}
                    continue
                if held:
                    kept, held = opened(), []
                yield from _answers(part, kept if groups[low] == group else {}, k, same_label)

    spread = base.unionByName(asked).repartition("grp").sortWithinPartitions("grp", "kind")
    return spread.mapInArrow(searched, FOUND)


def _answers(asked: pa.RecordBatch, kept: dict, k: int, same_label: bool) -> Iterator[pa.RecordBatch]:
    dims, labels = np.asarray(asked.column("dim")), np.asarray(asked.column("label"))
    windows, leaves = asked.column("windows").to_pylist(), asked.column("leaves").to_pylist()
    for (dim, leaf), (vectors, own, cls, first_id) in kept.items():
        here = np.array([i for i in np.flatnonzero(dims == dim) if leaf in leaves[i]], dtype=np.int64)
        step = max(1, BLOCK_SCORES // len(vectors))
        for at in range(0, len(here), step):
            rows = here[at : at + step]
            found = scores(_vectors(asked.column("vec").take(pa.array(rows)), dim), vectors)
            fits = (labels[rows][:, None] == own[None, :]) == same_label
            for turn in range(max(len(windows[i]) for i in rows)):
                some = np.array([turn < len(windows[i]) for i in rows])
                w, low, high = (
                    np.array([windows[i][turn][c] if turn < len(windows[i]) else 0 for i in rows], dtype=np.int64)
                    for c in ("w", "lo", "hi")
                )
                inside = fits & some[:, None] & (found >= low[:, None]) & (found <= high[:, None])
                r, c = first_rows(found, inside, k)
                if len(r):
                    picked = pa.array(c)
                    yield pa.RecordBatch.from_arrays(
                        [asked.column("cls").take(pa.array(rows[r])), pa.array(w[r], pa.int32()),
                         cls.take(picked).combine_chunks(), first_id.take(picked).combine_chunks(), pa.array(found[r, c])],
                        names=["cls", "w", "other", "first_id", "score"],
                    )


def first_of_windows(asked: DataFrame, leaves: DataFrame, trees, most: float, k: int, same_label: bool) -> DataFrame:
    """The first k classes of each window: the nearest leaves first, then all that the narrowed windows leave open."""
    order = Window.partitionBy("cls", "w").orderBy(F.desc("score"), "first_id", "other")
    top = lambda found: found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    seeds = saved(top(compared(leaves, saved(visits(asked, trees, most, True), "visits"), k, same_label)), "seeds")
    bounds = seeds.where(F.col("n") == k).groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("bound"))
    narrowed = F.transform(
        "windows",
        lambda x: F.struct(
            x["w"].alias("w"), F.greatest(x["lo"], F.coalesce(F.try_element_at("bound", x["w"]), x["lo"])).alias("lo"), x["hi"].alias("hi")
        ),
    )
    again = asked.join(bounds, "cls", "left").withColumn("windows", narrowed)
    rest = compared(leaves, saved(visits(again, trees, most, False), "visits"), k, same_label)
    return saved(top(seeds.drop("n").unionByName(rest)).drop("n"), "window-finds")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` are vec_id, label, vec (integers); anchors are the rows for which ``is_anchor`` holds. Scores are inner
    products; the positives of an anchor are its first other rows of the label, a positive's negatives the first rows of
    other labels with ``least_percent`` % to 100 % of its score. Ties go to the smaller id.

    Rows without id, label or vector take no part, nor do those whose squared length is 2 ** 56 or more: a hundred
    times their scores would be no long. Rows equal in all three count once; an id with several vectors or labels
    is several rows, none of which is a positive of the other. Vectors of different lengths never meet, vectors of
    length 0 have the score 0. A negative score has no negatives, since its window is empty. Equal vectors of a label are indexed and searched
    once, so a group of copies costs as much as one row. Empty tables give no rows; other columns are ignored.
    """
    whole = "vec_id is not null and label is not null and vec is not null"
    kept = rows.where(whole).select("vec_id", F.col("label").cast("bigint").alias("label"), "vec")
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # An id that has several vectors may stand several times before its own anchor's positives.
    repeats = kept.distinct().groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    most_ids = positives + repeats
    classes, named = mining_classes(kept.where(length < MAX_NORM), most_ids)
    anchors = saved(named.where(is_anchor).withColumnRenamed("vec_id", "anchor_id"), "anchors")
    leaves, trees, most = indexed(classes)
    sent = rows.sparkSession.sparkContext.broadcast(trees)
    asked = classes.join(anchors.select("cls").distinct(), "cls", "left_semi").select("cls", "dim", "label", "vec")
    everything = F.expr(f"array(named_struct('w', 0, 'lo', {-FAR}L, 'hi', {FAR}L))")
    asked = saved(asked.withColumn("windows", everything), "asked")
    ids = classes.select(F.col("cls").alias("other"), "ids")

    near = first_of_windows(asked, leaves, sent, most, most_ids, True).join(ids, "other")
    near = near.select("cls", "score", F.explode("ids").alias("positive_id"))
    order = [F.desc("score"), F.col("positive_id")]
    near = near.distinct().withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy(*order)))
    near = saved(near.where(F.col("n") <= most_ids).drop("n"), "near")
    pairs = anchors.join(near, "cls").where("positive_id <> anchor_id")
    pairs = pairs.withColumn("n", F.row_number().over(Window.partitionBy("anchor_id", "cls").orderBy(*order)))
    pairs = saved(pairs.where(F.col("n") <= positives).drop("n").withColumnRenamed("score", "positive_score"), "positives")

    # Windows of a class are numbered by their score; at most ``most_ids`` of them.
    high = F.col("positive_score")
    numbered = pairs.where(high >= 0).select("cls", "positive_score").distinct()
    numbered = numbered.withColumn("w", F.row_number().over(Window.partitionBy("cls").orderBy("positive_score")))
    windows = numbered.groupBy("cls").agg(F.collect_list(F.struct("w", _least(high, least_percent).alias("lo"), high.alias("hi"))).alias("windows"))
    wanted = saved(asked.drop("windows").join(windows, "cls"), "asked-windows")
    other = first_of_windows(wanted, leaves, sent, most, negatives, False).join(ids, "other")
    other = other.select("cls", "w", F.col("score").alias("negative_score"), F.explode("ids").alias("negative_id")).distinct()
    rank = F.row_number().over(Window.partitionBy("cls", "w").orderBy(F.desc("negative_score"), "negative_id"))
    other = other.withColumn("rank", rank).where(F.col("rank") <= negatives).join(numbered, ["cls", "w"])
    other = saved(other.drop("w"), "negatives")
    return pairs.join(other, ["cls", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _least(score: Column, percent: int) -> Column:
    """The least integer that is ``percent`` % of a score or more, in longs."""
    product = score * F.lit(percent)
    up = F.when(F.pmod(product, F.lit(100)) > 0, 1).otherwise(0)
    return F.call_function("div", product - F.pmod(product, F.lit(100)), F.lit(100)) + up


def integer_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vec of the rows whose components are all finite: floor(256 x), every seventh label moved on by one."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return vectors.where("label is not null and embedding is not null").where(fine).select("vec_id", moved.alias("label"), vec.alias("vec"))


def mined_negatives(vectors: DataFrame) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100."""
    return hard_negatives(integer_rows(vectors), F.col("vec_id") % 100 == 0)


MINING_SQL = """
    WITH rows AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
        FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
