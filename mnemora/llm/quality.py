"""Quality rules: an isolation forest on rule statistics, thresholds calibrated from labelled rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import saved

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
STATS_TYPE = "struct<" + ",".join(f"{s}:bigint" for s in STATS) + ">"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# The forest: trees of TREE_ROWS rows each, drawn from at most SAMPLE_ROWS rows of the corpus.
SAMPLE_ROWS, TREES, TREE_ROWS, SEED = 8192, 100, 256, 17
# Calibration: scores in BINS steps; at most GOOD_LOSS of the good labelled rows may go, and
# at least PRECISION of the labelled rows that go must be bad.
BINS, GOOD_LOSS, PRECISION = 1000, 0.005, 0.8


def text_stats(text: str | None) -> tuple[int, ...]:
    """The rule statistics of one text, in the order of ``STATS``; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    codes: dict[bytes, int] = {}
    ids = [codes.setdefault(w, len(codes)) for w in words]
    return (
        n,
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(np.array(ids, dtype=np.int64), len(codes)),
        len(lines),
        len(codes),
    )


def repeated_words(ids: np.ndarray, vocabulary: int) -> int:
    """Words that lie in a window of three that occurs at least twice."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-2] * vocabulary + ids[1:-1]
    if vocabulary > 2_000_000:  # the product of three would overflow
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * vocabulary + ids[2:]
    order = np.argsort(windows, kind="stable")
    equal = windows[order][1:] == windows[order][:-1]
    if not equal.any():
        return 0
    again = np.zeros(len(windows), dtype=bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def _measured(texts: pa.Array) -> np.ndarray:
    return np.array([text_stats(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(STATS))


def stats(text: Column) -> Column:
    """A struct of ``STATS`` for each text, in Arrow batches."""

    @F.arrow_udf(STATS_TYPE)
    def measured(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in _measured(texts).T], names=list(STATS))

    return measured(text)


def scored_stats(text: Column, forest: Forest) -> Column:
    """``stats`` with the forest's score as a further field ``anomaly``; one pass through a Python worker."""

    @F.arrow_udf(STATS_TYPE[:-1] + ",anomaly:double>")
    def measured(texts: pa.Array) -> pa.Array:
        rows = _measured(texts)
        columns = [*map(pa.array, rows.T), pa.array(forest.scores(features(rows)), pa.float64())]
        return pa.StructArray.from_arrays(columns, names=[*STATS, "anomaly"])

    return measured(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def features(rows: np.ndarray) -> np.ndarray:
    """Rule ratios of rows in the order of ``STATS``."""
    words, chars, symbols, dup, repeat, lines, distinct = rows.astype(np.float64).T
    n = np.maximum(words, 1)
    return np.stack(
        [np.log1p(words), chars / n, symbols / n, dup / np.maximum(lines, 1), repeat / n, distinct / n], axis=1
    )


def mean_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


class Forest:
    """Random axis-parallel splits; a short path to a leaf marks an anomaly."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.rows = max(min(rows, len(x)), 1)
        limit = math.ceil(math.log2(max(self.rows, 2)))
        self.trees = []
        for _ in range(trees if len(x) else 0):
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(x[rng.choice(len(x), self.rows, replace=False)], 0, limit, rng, nodes)
            self.trees.append([np.array(c) for c in zip(*nodes, strict=True)])

    def _grow(self, x, depth, limit, rng, nodes) -> int:
        at = len(nodes)
        low, high = x.min(axis=0), x.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(x) < 2 or not len(open_features):
            nodes.append((0, 0.0, at, at, depth + mean_depth(len(x))))
            return at
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append((f, cut, 0, 0, 0.0))
        left = self._grow(x[x[:, f] < cut], depth + 1, limit, rng, nodes) if (x[:, f] < cut).any() else None
        right = self._grow(x[x[:, f] >= cut], depth + 1, limit, rng, nodes)
        nodes[at] = (f, cut, right if left is None else left, right, 0.0)
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1; 0.5 for all when nothing was there to learn from."""
        if not self.trees or self.rows < 2:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                to = np.where(x[rows, feature[at]] < cut[at], left[at], right[at])
                if (to == at).all():
                    break
                at = to
            total += depth[at]
        return 2.0 ** (-(total / len(self.trees)) / max(mean_depth(self.rows), 1e-9))


def anomaly(s: Column, forest: Forest) -> Column:
    """The forest's score of a struct of statistics."""

    @F.pandas_udf("double")
    def scored(s: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.scores(features(s[list(STATS)].to_numpy())))

    return scored(s)


def fit_forest(measured: DataFrame) -> Forest:
    """Fit on the ``SAMPLE_ROWS`` rows of smallest hash: a bounded sample, the same on every run.

    The id is hashed too, so a large group of copies does not enter the sample as a whole.
    """
    flat = measured.select(F.xxhash64("doc_id", *[F.col(f"s.{c}") for c in STATS]).alias("_hash"), "s.*")
    sample = flat.orderBy("_hash", *STATS).limit(SAMPLE_ROWS).toPandas()
    return Forest(features(sample[list(STATS)].to_numpy().reshape(-1, len(STATS))))


def calibrate(counts: list[tuple[int, int, int]]) -> float:
    """The score from which documents go, from (bin, good rows, bad rows); above 1 if none can go.

    Among the bins that lose at most ``GOOD_LOSS`` of the good rows at a precision of
    ``PRECISION`` or more, the one that catches most bad rows.
    """
    good_total = sum(g for _, g, _ in counts)
    best, threshold, good, bad = 0, 2.0, 0, 0
    for bin_, g, b in sorted(counts, reverse=True):
        good, bad = good + g, bad + b
        if good <= GOOD_LOSS * good_total and bad >= PRECISION * (good + bad) and bad > best:
            best, threshold = bad, bin_ / BINS
    return threshold


def fit(measured: DataFrame, labels: DataFrame) -> tuple[Forest, float]:
    """Forest and threshold. ``measured``: doc_id and s; ``labels``: doc_id and quality (1 good, 0 bad).

    The threshold rests on every labelled row that passes the base rules; only counts
    per score step reach the driver.
    """
    forest = fit_forest(measured)
    known = labels.where("quality in (0, 1)").select("doc_id", "quality")
    rows = (
        measured.where(~base_failed(F.col("s")))
        .join(known, "doc_id")
        .select("quality", F.floor(anomaly(F.col("s"), forest) * BINS).alias("bin"))
        .groupBy("bin")
        .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        .collect()
    )
    return forest, calibrate([(r["bin"], r["good"], r["bad"]) for r in rows])


def kept(s: Column, score: Column, threshold: float) -> Column:
    """The verdict on a struct of statistics and its score."""
    return ~base_failed(s) & (score < threshold)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, anomaly, kept.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged each on
    its own, ties alike. Without documents the result is empty; without labels of both kinds only
    the base rules reject. Other columns of the input are ignored.
    """
    measured = saved(docs.select("doc_id", stats(F.col("text")).alias("s")), "quality-stats")
    forest, threshold = fit(measured, labels)
    s = F.col("s")
    scored = measured.withColumn("anomaly", anomaly(s, forest))
    return scored.select(
        "doc_id", *[F.col(f"s.{c}") for c in STATS[:5]],
        base_failed(s).alias("base_failed"), "anomaly", kept(s, F.col("anomaly"), threshold).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Rows are judged in place, so repeated and null ids need no join and no column can clash:
    the row travels as one struct.
    """
    forest, threshold = fit(
        saved(docs.select("doc_id", stats(F.col("text")).alias("s")), "quality-stats"), labels
    )
    rows = docs.select(F.struct("*").alias("row"), scored_stats(F.col("text"), forest).alias("s"))
    return rows.where(kept(F.col("s"), F.col("s.anomaly"), threshold)).select("row.*")
