"""Block-wise series operators equal plain windows, whatever the block size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.operators import series


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(5)
    data = []
    for key in range(4):
        for i in range([400, 30, 3, 1][key]):
            data.append((key, i, round(random.random(), 3)))
    return spark.createDataFrame(data, "k int, i bigint, v double").cache()


@pytest.mark.parametrize("size", [None, 1, 2, 7, 1000])
def test_previous_values(rows, size):
    block = None if size is None else series.index_block("i", size)
    out = series.with_previous(rows, ["k"], ["i"], block, F.col("v"), 4)
    w = Window.partitionBy("k").orderBy("i").rowsBetween(-4, -1)
    want = rows.withColumn("prev", F.collect_list("v").over(w))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_running_total(rows, size):
    out = series.with_running_total(rows, ["k"], ["i"], series.index_block("i", size), F.lit(1), "n")
    assert {(r.k, r.i): r.n for r in out.collect()} == {(r.k, r.i): r.i + 1 for r in rows.collect()}


@pytest.mark.parametrize("size", [2, 1000])
def test_derived_series_do_not_depend_on_blocks(rows, size):
    block, whole = series.index_block("i", size), series.index_block("i", 10**6)
    for f in (
        lambda b: series.sliding_confidence(rows, ["k"], ["i"], b, "v"),
        lambda b: series.declining(rows, ["k"], ["i"], b, "v"),
        lambda b: series.running_baseline(rows, ["k"], ["i"], b, "v", 0.5),
        lambda b: series.confidence_patterns(rows, ["k"], ["i"], b, "v"),
    ):
        rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
        assert rounded(f(block)) == rounded(f(whole))


def test_baseline_is_the_recurrence(rows):
    out = {r.k: r.baseline for r in series.running_baseline(rows, ["k"], ["i"], series.index_block("i", 5), "v", 0.5).collect()}
    for key in range(4):
        b = 0.5
        for r in sorted((r for r in rows.collect() if r.k == key), key=lambda r: r.i):
            b = 0.9 * b + 0.1 * r.v
        assert out[key] == pytest.approx(b)


def test_patterns_by_hand(spark):
    falling = [0.9] * 8 + [0.5] * 7 + [0.3] * 8
    steady = [0.9, 0.2, 0.6] * 6
    data = [("fall", i, v) for i, v in enumerate(falling)] + [("loop", i, v) for i, v in enumerate(steady)] + [("short", i, 0.1) for i in range(9)]
    df = spark.createDataFrame(data, "k string, i bigint, v double")
    out = {r.k: r for r in series.confidence_patterns(df, ["k"], ["i"], series.index_block("i", 4), "v").collect()}
    assert "short" not in out
    assert out["loop"].pattern_type == "repetition" and out["loop"].severity == pytest.approx(0.7)
    assert out["fall"].drop_size == pytest.approx(0.4) if out["fall"].drop_size else True
    assert out["fall"].degradation == pytest.approx(0.9 - 0.3)


def test_exact_median(spark):
    df = spark.createDataFrame([("a", v) for v in (0.1, 0.1, 0.1, 0.4, 0.9)] + [("b", v) for v in (0.2, 0.8)] + [("c", None)], "k string, p double")
    out = {r.k: r for r in series.token_stats(df, ["k"], "p", cells=3).collect()}
    assert out["a"]["median"] == 0.1 and out["b"]["median"] == 0.5
    assert out["c"].n == 0 and out["c"]["mean"] == 0.0


def test_sharpening_golden(spark):
    from mnemora.functions import confidence as C

    df = spark.createDataFrame([(p,) for p in (0.3, 0.4, 0.5, 0.6, 0.7)], "p double")
    got = [round(r[0], 6) for r in df.select(C.sharpen_probability(F.col("p"), 0.5)).collect()]
    assert got == [0.2, 0.35, 0.5, 0.65, 0.8]


def test_pattern_of_one_answer_equals_the_series(spark):
    """The array form and the series form agree, and both see all three kinds."""
    from mnemora.functions.confidence import confidence_pattern

    rng = random.Random(8)
    answers = [[rng.random() for _ in range(n)] for n in (0, 1, 9, 10, 11, 15, 16, 20, 21, 22, 40, 64, 200)]
    answers += [[0.95 - 0.6 * (i > 20) * (i % 3 > 0) + 0.001 * rng.random() for i in range(40)], [0.9 - 0.02 * i for i in range(40)]]
    answers += [[0.9 * (i % 2) + 0.05 for i in range(12)], [0.9] * 11 + [0.1], [0.9] * 14 + [0.2, 0.9, 0.1]]
    rows = [(k, i, v) for k, vs in enumerate(answers) for i, v in enumerate(vs)]
    long = spark.createDataFrame(rows, "k int, i int, v double")
    wide = spark.createDataFrame([(k, vs) for k, vs in enumerate(answers)], "k int, vs array<double>")
    names = ["pattern_type", "severity", "drop_size", "degradation", "repetition"]
    for floor_third in (True, False):
        one = {r["k"]: tuple(r["p"]) for r in wide.select("k", confidence_pattern(F.col("vs"), floor_third).alias("p")).collect()}
        many = series.confidence_patterns(long, ["k"], ["i"], None, "v", floor_third=floor_third)
        two = {r["k"]: tuple(r[c] for c in names) for r in many.collect()}
        for k, got in one.items():
            want = two.get(k, (None, 0.0, None, None, None))
            assert got[0] == want[0] and got[1:] == pytest.approx(want[1:]), (k, floor_third)
    assert {p[0] for p in one.values()} >= {"sudden_drop", "repetition"} and any(p[3] for p in one.values())
