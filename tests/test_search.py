"""Search, level vectors and diversity against brute force and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.operators import analytics, levels, search
from mnemora.plans import inputs


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.RandomState(3)
    vecs = unit(rng.randn(300, 16))
    vecs[100:200] = vecs[7]  # a third of all items are copies
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id bigint, embedding array<float>").cache(), vecs.astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def queries(spark):
    vecs = unit(np.random.RandomState(4).randn(9, 16))
    vecs[0] = unit(np.random.RandomState(3).randn(300, 16))[7]
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "query_id bigint, query_vec array<double>").cache(), vecs


@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_hits_are_exact_and_blocks_agree(store, queries, level):
    (items, base), (asked, q) = store, queries
    parameters = levels.level_parameters(16, 4)
    sims = unit(levels.to_level(q, level, parameters)) @ unit(levels.to_level(unit(base), level, parameters)).T
    depth = search.level_depth(4, level)
    want = {(i, int(j)) for i in range(9) for j in np.lexsort((np.arange(300), -np.round(sims[i], 12)))[:depth]}
    hits, bound = search.level_hits(items, asked, 16, 4, [level])
    assert bound == 9 * depth
    assert {(r.query_id, r.item_id) for r in hits.collect()} == want
    blocked = search.blocked_hits(items, asked, 16, 4, [level], cell_rows=50)
    assert {(r.query_id, r.item_id, r.raw_rank) for r in blocked.collect()} == {(r.query_id, r.item_id, r.raw_rank) for r in hits.collect()}


def test_orthogonal_and_golden_levels():
    for level, (m, b) in levels.level_parameters(64).items():
        assert np.allclose(m @ m.T, np.eye(64), atol=1e-10) and b.shape == (64,)
    p = {1: (np.eye(2), np.zeros(2)), 2: (np.eye(2), np.zeros(2)), 3: (np.eye(2), np.zeros(2))}
    v = np.array([[0.6, -0.8]])
    t = np.tanh(v * 1.1)
    assert np.allclose(levels.to_level(v, 1, p), t / np.linalg.norm(t))
    g = np.sign(v) * np.log(1 + np.abs(v) * 1.1)
    assert np.allclose(levels.to_level(v, 2, p), g / np.linalg.norm(g))
    w = np.sign(v) * np.abs(v) ** 0.8
    assert np.allclose(levels.to_level(v, 3, p), w / np.linalg.norm(w))


def test_level_vectors_are_unit_and_skip_missing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 2.0, 0.0])], "id bigint, embedding array<float>")
    rows = levels.with_levels(df, 3, 2).collect()
    assert {(r.item_id, r.level) for r in rows} == {(1, 1), (1, 2), (3, 1), (3, 2)}
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-6 for r in rows)


def test_similar_pairs_brute_force(store):
    items, base = store
    sims = unit(base) @ unit(base).T
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if sims[i, j] >= 0.6}
    for cell in (40, 1000):
        got = [(r.a, r.b) for r in analytics.similar_pairs(items, 16, 0.6, cell_rows=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_enhancement_is_not_monotone(spark):
    from mnemora.functions.vectors import enhance

    df = spark.createDataFrame([(0.4999,), (0.5,), (0.5001,), (0.9,), (0.1,)], "s double")
    got = [round(r[0], 4) for r in df.select(enhance(F.col("s"))).collect()]
    assert got == [0.5598, 0.5, 0.4402, 1.0, 0.0]


def greedy(cands, k):
    """cands: list of (pos, warned, words) in rank order."""
    if len(cands) <= k:
        return [c[0] for c in cands]
    dist = lambda a, b: 0.0 if not a | b else 1 - len(a & b) / len(a | b)
    chosen, rest = [cands[0]], cands[1:]
    while len(chosen) < k and rest:
        pool = [c for c in rest if not c[1]] or rest
        best = max(pool, key=lambda c: (min(dist(c[2], s[2]) for s in chosen), -c[0]))
        chosen.append(best)
        rest.remove(best)
    return [c[0] for c in chosen]


def test_diversity_against_brute_force(spark):
    rng = np.random.RandomState(1)
    data, want = [], {}
    for q in range(6):
        n = [1, 3, 5, 9, 20, 44][q]
        cands = []
        for pos in range(1, n + 1):
            words = [f"w{x}" for x in rng.randint(0, 12, rng.randint(0, 6))]
            cands.append((pos, bool(rng.rand() < 0.5), set(words)))
            data.append((q, pos, cands[-1][1], " ".join(words)))
        want[q] = greedy(cands, 5)
    df = spark.createDataFrame(data, "query_id int, pos int, hallucination_warning boolean, content string")
    got = {}
    for r in search.promote_diversity(df, 5).orderBy("query_id", "pick").collect():
        got.setdefault(r.query_id, []).append(r.pos)
    assert got == want


def test_flagged_items_lose_rank_and_tombstones_take_slots(spark):
    base = [[1.0, 0.0], [0.99, 0.14], [0.98, 0.2], [0.0, 1.0]]
    items = spark.createDataFrame(
        [(i, v, i == 1, i == 0, 0.7) for i, v in enumerate(base)],
        "id bigint, embedding array<float>, deleted boolean, hallucination_detected boolean, reliability_penalty double",
    )
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, query_vec array<double>")
    rows = search.standard_search(items, q, 2, 2, 0.25).orderBy("rank").collect()
    assert [r.item_id for r in rows] == [2, 0]
    assert rows[1].similarity == pytest.approx(0.7) and rows[1].hallucination_warning


def test_projection_matches_svd(spark):
    rng = np.random.RandomState(0)
    m = rng.randn(200, 5) * [3, 2, 1, 0.5, 0.1] + 4
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id bigint, vec array<double>")
    mean, axes, share = analytics.principal_axes(df, 5, 2)
    _, s, vt = np.linalg.svd(m - m.mean(0))
    assert np.allclose(mean, m.mean(0))
    assert np.allclose(np.abs(axes @ vt[:2].T), np.eye(2), atol=1e-6)
    assert np.allclose(share, (s**2 / (s**2).sum())[:2])
    xy = np.array([[r.x, r.y] for r in analytics.project(df, mean, axes).orderBy("id").collect()])
    assert np.allclose(xy, (m - m.mean(0)) @ axes.T)


def test_maps_keep_vectors_of_other_lengths(spark):
    rng = np.random.RandomState(1)
    m = [rng.randn((48, 64, 96)[i % 3]) for i in range(60)]
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate(m)] + [(60, None, 0)]
    items = spark.createDataFrame(rows, "id bigint, embedding array<double>, retrieval_count int")
    cut = np.array([np.pad(v[:64], (0, max(0, 64 - len(v)))) for v in m])
    fitted = np.array([c if len(v) == 64 else c / np.linalg.norm(c) for c, v in zip(cut, m, strict=True)])
    mean, axes, _ = analytics.principal_axes(items, 64, 2, vec="embedding")
    assert np.allclose(mean, fitted.mean(0), atol=1e-6)
    got = analytics.retrieval_map(items, 64).orderBy("id").collect()
    assert np.allclose([[r.x, r.y] for r in got], (fitted - mean) @ axes.T, atol=1e-5)
    none = spark.createDataFrame([], "item_id bigint, level int, vec array<double>")
    for found in (analytics.space_map(items, none, 64), analytics.ring_map(items, none, 64)):
        assert not [r for r in found.collect() if None in tuple(r)] and found.count() == 60
    pairs = {(r.a, r.b) for r in analytics.similar_pairs(items, 64, -1.0).collect()}
    assert len(pairs) == 60 * 59 // 2


def test_lane_and_ring_maps_are_scaled(spark, folder):
    vectors = inputs.embeddings(spark, folder)
    long = levels.with_levels(vectors, 64, 2)
    flow = analytics.flow_map(vectors, long, 64).groupBy("level").agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).collect()
    assert all(abs(r[1]) < 1e-9 and abs(r[2] - 1) < 1e-9 and abs(r[4] - r[3] - 0.2) < 1e-9 for r in flow)
    ring = {r.level: r for r in analytics.ring_map(vectors, long, 64).groupBy("level").agg(F.min("radius").alias("lo"), F.max("radius").alias("hi")).collect()}
    assert ring[0].hi == pytest.approx(0.4) and ring[1].lo >= 0.4 and ring[2].hi == pytest.approx(1.0)


def test_text_ids(store, queries):
    items, asked = store[0].withColumn("id", F.concat(F.lit("item_"), "id")), queries[0].withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    hits, _ = search.level_hits(items, asked, 16, 4, [0, 2])
    blocked = search.blocked_hits(items, asked, 16, 4, [0, 2], cell_rows=70)
    key = lambda df: {(r.query_id, r.level, r.item_id, r.raw_rank) for r in df.collect()}
    assert len(key(hits)) == 9 * (12 + 8) and key(hits) == key(blocked)


def test_vectors_of_other_lengths_are_fitted():
    import numpy as np
    import pyarrow as pa

    from mnemora.operators.levels import as_matrix

    rows, mask = as_matrix(pa.array([[1.0], None, [1.0, 2.0, 3.0], [4.0, 5.0], []], pa.list_(pa.float32())), 2)
    assert mask.tolist() == [True, False, True, True, False]
    assert np.array_equal(rows, [[1, 0], [1, 2], [4, 5]])


def test_best_rows_of_a_cell_with_copies(monkeypatch):
    """Ties, copies and near ties below single precision, in several chunks, equal a full sort in double precision."""
    import numpy as np

    monkeypatch.setattr(search, "QUERY_ROWS", 7)
    monkeypatch.setattr(search, "FIRST_ITEMS", 20)
    draw = np.random.RandomState(8)
    items = unit(draw.randn(400, 16))
    items[100:160] = items[3]
    items[200:260] = unit(items[5] + draw.randn(60, 16) * 1e-9)
    q = unit(np.concatenate([draw.randn(30, 16), items[[3, 5, 250]]]))
    sims = np.round(np.einsum("qd,id->qid", q, items).sum(axis=2), 12)
    for depth in (1, 3, 50, 500):
        rows, found, values = search._best_rows(q, items, depth)
        for r in range(len(q)):
            want = np.lexsort((np.arange(400), -sims[r]))[:depth]
            mine = found[rows == r]
            assert len(mine) == min(depth, 400) and np.allclose(values[rows == r], sims[r][want], atol=2e-12)
            assert len(set(mine)) == len(mine) and np.allclose(sims[r][mine], values[rows == r], atol=2e-12)
        assert found[rows == 30][:depth].tolist()[:3] == [3, 100, 101][:depth]
