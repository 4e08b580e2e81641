"""Counted searches on bucketed tables, and the best text match over all memories."""

import glob
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemora.operators import retrieval, term_join
from mnemora.session import scratch_dir
from mnemora.sources.buckets import BucketedTable


def files(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(os.path.join(table.folder, "_bucket=*", "part-*"))}


def test_a_change_rewrites_its_buckets_only(spark):
    rows = spark.range(500).select("id", F.lit(0).alias("n"), F.concat(F.lit("text "), "id").alias("text"))
    table = BucketedTable.create(rows, scratch_dir(spark, "bucketed"), buckets=16)
    before = files(table)
    assert len(before) == 16 and table.read().count() == 500
    changes = spark.createDataFrame([(7, 5), (8, 1), (9_999, 3)], "id bigint, m int")

    def merge(old, new):
        return old.join(new, "id", "full").select("id", F.coalesce("n", F.lit(0)).alias("n"), "text", "m").withColumn("n", F.col("n") + F.coalesce("m", F.lit(0)))

    touched = table.change(changes, merge)
    after = files(table)
    changed = {f.split("_bucket=")[1].split("/")[0] for f in set(before) ^ set(after)}
    assert changed == {str(b) for b in touched} and len(touched) <= 3
    got = {r["id"]: (r["n"], r["text"]) for r in table.read().collect()}
    assert len(got) == 501 and (got[7], got[8], got[9_999], got[10]) == ((5, "text 7"), (1, "text 8"), (3, None), (0, "text 10"))
    assert table.change(changes.where("false"), merge) == [] and table.read().count() == 501


def test_found_items_are_counted_and_read_again(spark):
    rng = random.Random(6)
    vec = lambda: [rng.gauss(0, 1) for _ in range(64)]
    rows = [(i, f"memory number {i}", vec(), i == 3, False, 0.0, 0.7, 0, None) for i in range(40)] + [(40, "no vector", None, False, False, 0.0, 0.7, 2, None)]
    kind = "id bigint, content string, embedding array<double>, deleted boolean, hallucination_detected boolean, hallucination_score double, reliability_penalty double, retrieval_count bigint, last_access timestamp"
    table = BucketedTable.create(spark.createDataFrame(rows, kind), scratch_dir(spark, "memory"), buckets=8)
    queries = spark.createDataFrame([(1, rows[5][2]), (2, rows[3][2]), (3, rows[5][2])], "query_id bigint, query_vec array<double>")
    now = F.lit("2024-01-02").cast("timestamp")
    first = retrieval.retrieve(table, queries, 64, now).collect()
    second = retrieval.retrieve(table, queries.where("query_id = 1"), 64, now).collect()
    used = {}
    for r in [*first, *second]:
        used[r["item_id"]] = used.get(r["item_id"], 0) + 1
    assert used[5] >= 3 and 3 not in used
    got = {r["id"]: r for r in table.read().collect()}
    assert {i: r["retrieval_count"] for i, r in got.items()} == {i: used.get(i, 0) + (2 if i == 40 else 0) for i in range(41)}
    assert all((r["last_access"] is not None) == (i in used) for i, r in got.items())
    assert [r["item_id"] for r in first if r["query_id"] == 1] == [r["item_id"] for r in second]
    assert retrieval.retrieve(table, queries.where("false"), 64, now).count() == 0


@pytest.mark.parametrize("posting_rows", [20_000, 7])
def test_best_memory_equals_all_pairs(spark, monkeypatch, posting_rows):
    """Frequent terms in nearly all memories, weights, ties, copies, texts without terms."""
    monkeypatch.setattr(term_join, "POSTING_ROWS", posting_rows)
    rng = random.Random(posting_rows)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    text = lambda n: " ".join(["the", "and"] + [words[min(int(rng.expovariate(0.05)), 119)] for _ in range(n)])
    memories = [(i, text(rng.randrange(1, 30)), rng.choice([None, 1.0, 0.7, 0.0, 0.3])) for i in range(150)]
    memories += [(1000 + i, memories[0][1], memories[0][2]) for i in range(20)] + [(2000, None, 1.0), (2001, "a b", 1.0), (2002, "Only é éclair here", 1.0)]
    answers = [(i, text(rng.randrange(1, 30))) for i in range(60)] + [(100, memories[0][1]), (101, None), (102, "x y"), (103, "unheard words alone"), (104, "here é")]
    got = term_join.best_text_similarity(
        spark.createDataFrame(answers, "id bigint, text string"), spark.createDataFrame(memories, "id bigint, text string, similarity double")
    )
    terms = lambda t: set(re.findall(r"\b[A-Za-z]{3,}\b", (t or "").lower()))
    for r in got.collect():
        mine = terms(dict(answers)[r["id"]])
        best = max(((len(mine & terms(t)) / len(mine | terms(t)) * (1.0 if w is None else w), -m) for m, t, w in memories if mine and terms(t)), default=(0.0, 0))
        assert r["text_similarity"] == pytest.approx(best[0])
        assert r["memory_id"] == (-best[1] if best[0] > 0 else None)
    assert got.count() == len(answers)


def test_a_cell_hands_on_one_row_per_answer():
    """However many memories share an answer's terms, no pairs leave the cell; ties go to the smallest id."""
    answers = pa.table({"id": [7, 8, 9], "size": pa.array([3, 2, 2], pa.int32()), "known": [[1, 2, 3], [1, 5], [9]]})
    memories = pa.table(
        {"id": list(range(500, 0, -1)), "size": pa.array([4] * 500, pa.int32()), "weight": [0.5] * 250 + [1.0] * 250, "known": [[1, 2, 3]] * 499 + [[5]]}
    )
    got = term_join._best_in_cell(answers, memories).to_pylist()
    assert got == [{"id": 7, "score": 0.75, "memory_id": 2}, {"id": 8, "score": 0.2, "memory_id": 1}]
    assert term_join._best_in_cell(answers, memories.slice(0, 0)).num_rows == 0


@pytest.mark.parametrize("bitmaps, plane_words", [(0, 8), (3, 1), (4_096, 16_384)])
def test_a_block_equals_all_pairs(monkeypatch, bitmaps, plane_words):
    """Terms in bitmaps, in lists and in both, answers of over 255 terms, many equal scores, weights of 0 and over 1, negative fingerprints."""
    monkeypatch.setattr(term_join, "BITMAPS", bitmaps)
    monkeypatch.setattr(term_join, "PLANE_WORDS", plane_words)
    rng = random.Random(bitmaps)
    near = 1 if bitmaps else 2**44  # fingerprints that differ in their last bits only, and such that do not
    words = [rng.randrange(-(2**63), 2**63) // near for _ in range(698)] + [-(2**63), 2**63 - 1]
    words += [w + 1 for w in words[:2]] if bitmaps == 3 else []
    text = lambda n: sorted({words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(n)})
    answers = [text(rng.choice([1, 2, 5, 20, 60])) for _ in range(120)] + [words[:300], words[100:600], [], [5]]
    memories = [text(rng.choice([1, 3, 10, 40, 90])) for _ in range(400)] + [words[:290], words[100:590], *answers[:5] * 3]
    weights = [rng.choice([0.0, 0.3, 0.7, 1.0, 1.0, 2.5]) for _ in memories]
    ids = rng.sample(range(-5_000, 5_000), len(memories))
    table = lambda lists, **more: pa.table({"size": pa.array([len(x) for x in lists], pa.int32()), "known": pa.array(lists, pa.list_(pa.int64())), **more})
    got = term_join._best_in_cell(table(answers, id=range(len(answers))), table(memories, id=ids, weight=weights)).to_pylist()
    want = []
    for i, mine in enumerate(map(set, answers)):
        shared = [(len(mine & (held := set(m))), len(mine), len(held), w, -key) for m, w, key in zip(memories, weights, ids)]
        best = max(((both / (n + m - both) * w, key) for both, n, m, w, key in shared if both), default=(0.0, 0))
        if best[0] > 0:
            want.append({"id": i, "score": best[0], "memory_id": -best[1]})
    assert got == want


def test_blocks_are_bounded_in_rows_and_terms():
    sizes = [3, 3, 3, 50, 1, 1, 1, 1, 1, 9, 9, 2]
    table = pa.table({"id": range(len(sizes)), "size": pa.array(sizes, pa.int32())})
    blocks = [b.column("size").to_pylist() for b in term_join._blocks(iter(table.to_batches(max_chunksize=5)), 4, 10)]
    assert blocks == [[3, 3, 3], [50], [1, 1, 1, 1], [1, 9], [9], [2]]


def test_no_side_is_copied_for_the_other(spark, monkeypatch, tmp_path):
    """With many small blocks and chunks each task hands on one row for an answer at most, and no terms are shuffled for the search."""
    for name, most in (("POSTING_ROWS", 7), ("CHUNK_TERMS", 20), ("SENT_TERMS", 100)):
        monkeypatch.setattr(term_join, name, most, raising=False)
    monkeypatch.setattr(term_join, "scratch_dir", lambda spark, name: str(tmp_path / name))
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["red", "green", "blue", "grey", "pink", "black", "white"]) for _ in range(5))
    answers = [(i, text()) for i in range(90)]
    memories = [(i, text(), 1.0) for i in range(900)]
    got = term_join.best_text_similarity(
        spark.createDataFrame(answers, "id bigint, text string"), spark.createDataFrame(memories, "id bigint, text string, similarity double")
    )
    plan = got._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Generate" not in plan
    found = spark.read.parquet(str(tmp_path / "found"))
    assert found.count() <= len(answers) * 4 * spark.sparkContext.defaultParallelism
    assert found.groupBy("id").count().count() == len(answers)
    terms = lambda t: set(t.split())
    for r in got.collect():
        mine = terms(dict(answers)[r["id"]])
        best = max((len(mine & terms(t)) / len(mine | terms(t)), -m) for m, t, _ in memories)
        assert (r["text_similarity"], r["memory_id"]) == (pytest.approx(best[0]), -best[1])
