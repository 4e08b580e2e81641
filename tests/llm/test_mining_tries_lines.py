"""Hard negatives, the prefix trie and line dedup against plain Python on odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mnemora.llm import hard_negatives, line_dedup, prefix_trie
from mnemora.llm.common import prepared

WORD_BREAKS = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Lines


def plain_lines(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)
    key = lambda line: line.strip(WORD_BREAKS).translate(lower)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    keeper = {k: max((d for d in ds if d is not None), default=None) for k, ds in holders.items() if len(ds) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or (doc is not None and keeper[key(x)] == doc)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def line_rows():
    common, other = "This Line is found in Many Documents", "Éine Zeile, die öfter vorkommt ÄÖ"
    rows = [(i, f"own line number {i} of all\n  {common}\t\n{common.lower()}\n{other}\nshort") for i in range(6)]
    rows += [(6, common + "\x85"), (7, None), (8, ""), (9, "\n\n"), (None, common), (None, other + "\n" + common)]
    rows += [(2, other), (2, other), (10, other.lower()), (11, other), (12, "twice in one document only\n" * 3), (13, "twice in one document only")]
    rows += [(14, "held by two rows of one id"), (14, "held by two rows of one id\n"), (15, "held by two rows of one id")]
    rows += [(16, "\n".join([common, "x" * 50] * 3000)), (17, "x" * 50 + "\r"), (18, "\x0bX" + "x" * 49)]
    return rows


def test_lines_equal_plain_python(spark):
    rows = line_rows()
    table = prepared(spark).createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id bigint, text string, k1 string, lost int")
    got = sorted((tuple(r) for r in line_dedup.line_report(table).collect()), key=repr)
    assert got == plain_lines(rows)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_shared_lines(table).where("doc_id = 5").collect()}
    assert kept[5].startswith("own line number 5 of all")
    assert line_dedup.line_report(table.where("false")).count() == 0


def test_a_line_in_every_document_stays_in_the_last(spark):
    rows = [(i, "the very same notice in every document\nbody of " + "y" * i) for i in range(2000)]
    table = prepared(spark).createDataFrame(rows, "doc_id bigint, text string")
    found = line_dedup.line_report(table).groupBy("n_dropped").count().collect()
    assert {r["n_dropped"]: r["count"] for r in found} == {0: 1, 1: 1999}


# Conversations


def content(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()


def plain_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, content(role, text), role or "", text or ""))
    turns = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in by.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        path = turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        cost = (len(cs) - 1) * len([w for w in _words(node[-1][1]) if w]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += cost
            leaves[node[:d]] += kids[node] == 0
    return sorted(
        (cs[0], len(n), members[n[:-1]][0] if n else None, len(cs), kids[n], leaves[n], saved[n], sha(",".join(map(str, ends[n]))))
        for n, cs in members.items()
    ) if members else []


def _words(text):
    for b in WORD_BREAKS:
        text = text.replace(b, " ")
    return text.split(" ")


def trie_rows(seed):
    rng = random.Random(seed)
    said = ["hello there", "what is it", "", None, "a\tb\x0bc", "w" * 5000 + " end", "ä ö"]
    rows = []
    for conv in [*range(60), 100, 119, 2**40, -7, -20, -25]:
        rows += [(conv, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for t in range(rng.randrange(1, 6))]
    rows += [(200 + i, t, "user", f"copy {t}") for i in range(40) for t in range(4)]
    rows += [(300, None, "user", "first"), (300, 1, "user", "b"), (300, 1, "user", "a"), (300, 1, "user", "a"), (None, 0, "user", "lost")]
    rows += [(310, t, "user", f"turn {t}") for t in range(700)] + [(311, t, "user", f"turn {t}") for t in range(650)]
    rng.shuffle(rows)
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("bits", "nodes", "piece"), [(10, 100_000, 1_000_000), (3, 40, 10)])
def test_trie_equals_plain_python(spark, monkeypatch, bits, nodes, piece):
    """Also with many levels, shards and pieces, and conversations over several partitions."""
    monkeypatch.setattr(prefix_trie, "LEVEL_BITS", bits)
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", nodes)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = trie_rows(bits)
    table = prepared(spark).createDataFrame(
        [(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, node string"
    )
    try:
        got = prefix_trie.prefix_trie(table).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, got), key=repr) == sorted(plain_trie(rows), key=repr)


def test_trie_without_conversations_has_no_nodes(spark):
    kind = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.prefix_trie(prepared(spark).createDataFrame([], kind)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).count() == 0


def test_running_totals_go_on_over_partitions(spark):
    rows = [(7 if i % 3 else i, i) for i in range(4000)]
    table = prepared(spark).createDataFrame(rows, "conv_id bigint, at bigint").withColumn("one", prefix_trie.F.lit(1).cast("bigint"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = prefix_trie.running(table, "conv_id", ["at"], {"n": "one", "total": "at"}, "totals").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = sorted((r["at"], r["n"], r["total"]) for r in found if r["conv_id"] == 7)
    assert [n for _, n, _ in hot] == list(range(1, len(hot) + 1))
    assert [t for _, _, t in hot] == np.cumsum([a for a, _, _ in hot]).tolist()


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50_000):
        digests = rng.integers(0, 2**63, size=(n, 2)).astype(np.uint64)
        slots = prefix_trie.SlotTable(digests)
        assert sorted(slots.slots(digests)) == list(range(n))
        assert (slots.slots(rng.integers(0, 2**63, size=(500, 2)).astype(np.uint64)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.array([[1, 2], [1, 2]], dtype=np.uint64))


# Vectors


def plain_negatives(rows, positives=5, negatives=5):
    """Every anchor against all rows, in plain integers."""
    rows = {(i, l, tuple(v)) for i, l, v in rows if i is not None and l is not None and v is not None and sum(x * x for x in v) < 2**56}
    out = set()
    for i, label, vec in rows:
        if i % 100:
            continue
        near = lambda keep: sorted((-sum(a * b for a, b in zip(vec, v, strict=True)), j) for j, l, v in rows if len(v) == len(vec) and keep(j, l))  # noqa: E731, B023
        for minus, pos in near(lambda j, l: l == label and j != i)[:positives]:
            fits = [(-n, j) for n, j in near(lambda j, l: l != label) if 80 * -minus <= 100 * -n <= 100 * -minus]
            out |= {(i, pos, r, j, -minus, n) for r, (n, j) in enumerate(fits[:negatives], 1)}
    return out


def vector_rows(seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 200
    rows = [(i, int(rng.integers(4)), [int(x) for x in centres[rng.integers(12)] + rng.normal(size=8) * 40]) for i in range(900)]
    rows += [(5000 + i, 1, [100, 90, 80, 70, 60, 50, 40, 30]) for i in range(450)]  # copies, some of them anchors
    rows += [(6000 + i, 2, [99, 90, 80, 70, 60, 50, 40, 30]) for i in range(30)]
    rows += [(7000 + i, i % 3, [i % 50, 3]) for i in range(220)] + [(7300, 0, [9, 9, 9]), (7301, 1, [9, 8, 9]), (7302, 0, [9, 9, 8])]
    rows += [(7400, 0, []), (7401, 0, []), (7402, 1, [])] + [(7500, 0, [0] * 8), (7501, 0, [0] * 8)]
    rows += [(100, 1, rows[100][2]), (100, 1, [5] * 8), (101, 1, [5] * 8), (200, 0, rows[200][2])] + rows[:20]
    rows += [(None, 1, [1] * 8), (7600, None, [1] * 8), (7700, 1, None), (7800, 1, [2**28] * 8), (7801, 0, [-(2**20)] * 8), (7900, 0, [2**20] * 8)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_negatives_equal_all_pairs(spark, monkeypatch, small):
    """Also with small leaves, groups and a sample that misses whole lengths."""
    if small:
        for name, value in (("LEAF_ROWS", 8), ("SAMPLE_ROWS", 300), ("LEAST_GROUP", 50)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vector_rows()
    table = prepared(spark).createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, label bigint, vec array<bigint>, cls string, w int")
    got = hard_negatives.hard_negatives(table, hard_negatives.F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows)
    assert hard_negatives.hard_negatives(table.where("false"), hard_negatives.F.lit(True)).count() == 0


def test_odd_components_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (100, 1, [1.0, nan]), (1, 1, [inf, 1.0]), (2, 1, [None, 1.0]), (3, None, [1.0, 2.0]), (4, 1, None)]
    rows += [(5, 1, [1.5, 2.0]), (6, 2, [1.0, 2.0]), (8, 2, [3e38, 1.0]), (9, 2, [-0.001, 2.2])]
    table = prepared(spark).createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    got = {tuple(r) for r in hard_negatives.mined_negatives(table).collect()}
    # Label 1 of row 0 moves on to 2: row 6 and 9 are its positives, row 5 scores above both of them.
    kept = [(0, 2, [256, 512]), (5, 1, [384, 512]), (6, 2, [256, 512]), (9, 2, [-1, 563])]
    assert got == plain_negatives(kept)


def test_ranges_eliminate_leaves_of_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 4)) * 5000
    rows = (centres[rng.integers(16, size=4000)] + rng.normal(size=(4000, 4)) * 20).astype(np.int64)
    most = float((rows.astype(float) ** 2).sum(axis=1).max()) + 1
    tree = hard_negatives.grown(rows[:500], 4000, most)
    points = hard_negatives.augmented(rows, most)
    child = hard_negatives.distances(points, tree.upper).argmin(axis=1)
    leaf = np.zeros(len(rows), dtype=int)

    def ranges(split, pts, part):
        d, m = hard_negatives.distances(pts, split), len(split)
        low, high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for j in np.unique(part):
            low[:, j], high[:, j] = d[part == j].min(axis=0), d[part == j].max(axis=0)
        return low, high

    tree.ranges[-1] = ranges(tree.upper, points, child)
    for j in np.unique(child):
        own = child == j
        part = hard_negatives.distances(points[own], tree.lower[j]).argmin(axis=1)
        leaf[own] = tree.first[j] + part
        tree.ranges[int(j)] = ranges(tree.lower[j], points[own], part)
    tree.groups = {int(x): [0] for x in np.unique(leaf)}
    scores = rows[0] @ rows.T
    low, high = int(np.quantile(scores, 0.95)), int(scores.max())
    met, _ = hard_negatives.open_leaves(tree, rows[0], np.array([[low, high]], dtype=float), most)
    assert {int(leaf[i]) for i in np.flatnonzero((scores >= low) & (scores <= high))} <= set(met)
    assert len(met) < len(tree.groups) / 2
