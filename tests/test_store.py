"""Store behaviour: add, update with metadata merge, tombstones, versions, files."""

import os

import pytest
from pyspark.sql import functions as F

from mnemora.functions.embedding import embedder, seeded_embedding
from mnemora.operators import batching, store
from mnemora.session import scratch_dir
from mnemora.sources import versions

TEXTS = [
    ("Paris is the capital of France", "geography"),
    ("Python is a programming language", "programming"),
    ("The Eiffel Tower is located in Paris", "landmarks"),
    ("JavaScript is used for web development", "programming"),
    ("   ", "blank"),
]
def now():
    return F.lit("2024-01-02").cast("timestamp")


@pytest.fixture(scope="module")
def items(spark):
    raw = spark.createDataFrame(TEXTS, "text string, topic string")
    embed = embedder(seeded_embedding(64))
    rows = store.prepare_items(raw, "text", F.lit("2024-01-01").cast("timestamp"), embed)
    return (
        rows.withColumn("attrs", F.create_map(F.lit("topic"), F.col("topic")))
        .withColumn("last_access", F.lit(None).cast("timestamp"))
        .withColumn("modified_at", F.lit(None).cast("timestamp"))
        .cache()
    )


def find(items, word):
    return items.filter(F.contains("content", F.lit(word))).first()


def test_vectors_of_other_lengths_are_coerced_at_insert(spark):
    rows = [("short one", [3.0]), ("long one", [3.0, 4.0, 5.0]), ("fits", [0.0, 2.0]), ("none", None), ("zero", [0.0, 0.0])]
    raw = spark.createDataFrame(rows, "text string, embedding array<float>")
    found = store.prepare_items(raw, "text", F.lit("2024-01-01").cast("timestamp"), dim=2).collect()
    want = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0], None, [0.0, 0.0]]
    assert [r["embedding"] and [round(x, 6) for x in r["embedding"]] for r in found] == want


def test_add_and_filter(items):
    assert items.count() == 4
    assert items.filter(F.col("attrs")["topic"] == "programming").count() == 2
    assert store.duplicate_ids(items).count() == 0
    assert store.get(items, [find(items, "France").id]).first().content == "Paris is the capital of France."


def test_update_refreshes_vector_and_merges_metadata(spark, items):
    old = find(items, "France")
    changes = spark.createDataFrame(
        [(old.id, "Paris is the beautiful capital of France", {"importance": "high"})],
        "id string, new_content string, new_attrs map<string,string>",
    )
    new = store.get(store.update(items, changes, now(), embedder(seeded_embedding(64))), [old.id]).first()
    assert new.content == "Paris is the beautiful capital of France"
    assert new.attrs == {"topic": "geography", "importance": "high"}
    assert new.embedding != old.embedding and new.modified_at is not None


def test_remove_compact_and_stats(spark, items):
    gone = spark.createDataFrame([(find(items, "Python").id,)], "id string")
    left = store.remove(items, gone)
    assert store.get(left, [gone.first().id]).count() == 0
    levels = store.rebuild_levels(items, 64, 2)
    counted = {r.metric: r.value for r in store.stats(left, levels).collect()}
    assert (counted["total_items"], counted["active_items"], counted["deleted_items"], counted["level_1_size"]) == (4, 3, 1, 4)
    live, kept = store.compact(left, levels)
    assert live.count() == 3 and kept.count() == 6
    used = spark.createDataFrame([(find(items, "Python").id,), (find(items, "Eiffel").id,), (find(items, "Eiffel").id,)], "item_id string")
    seen = {r.content: r.retrieval_count for r in store.record_retrievals(left, used, now()).collect()}
    assert sorted(seen.values()) == [0, 0, 0, 2]


def test_dimension_change(items):
    for dim in (32, 96):
        v = store.change_dimension(items, dim).first().embedding
        assert len(v) == dim and abs(sum(x * x for x in v) - 1) < 1e-5
    assert store.change_dimension(items, 64).first().embedding == pytest.approx(items.first().embedding)


def test_versions(spark, items):
    where = scratch_dir(spark, "versions")
    saved = versions.VersionedStore(spark, where)
    assert saved.version() is None
    saved.save(items)
    live = items.filter(~F.contains("content", F.lit("Paris")))
    saved.save(live, store.rebuild_levels(live, 64, 2))
    again = versions.VersionedStore(spark, where)
    assert again.items().count() == 2 and again.levels().count() == 4
    # an uncommitted version is never read
    items.write.parquet(os.path.join(where, "data", "v999999999-x", "items"))
    assert again.items().count() == 2


def test_exported_files(spark):
    where = scratch_dir(spark, "files")
    blocks = spark.createDataFrame([("a.txt", "old", 1), ("a.txt", "new", 2), ("b.txt", "x\ny", 1)], "filename string, content string, n int")
    out = versions.export_files(versions.newest_per_name(blocks, "n"), where).collect()
    assert all(r.saved for r in out) and sorted(os.listdir(where)) == ["a.txt", "b.txt"]
    assert open(os.path.join(where, "a.txt")).read() == "new"


def test_line_import_and_json(spark, items):
    from mnemora.sources.text_lines import read_lines

    where = scratch_dir(spark, "lines")
    spark.createDataFrame([("first fact ",), ("",), ("  ",), ("second",)], "value string").coalesce(1).write.text(where)
    assert sorted(r.line for r in read_lines(spark, where).collect()) == ["first fact", "second"]
    back = store.from_json(store.to_json(items.select("id", "content", "embedding", "source")), "source string")
    assert {(r.id, r.content) for r in back.collect()} == {(r.id, r.content) for r in items.collect()}


def test_chunks_shrink_when_memory_is_short(spark):
    def f(frame):
        if len(frame) > 3:
            raise MemoryError
        return frame

    df = spark.range(50).coalesce(1)
    assert sorted(r.id for r in batching.map_in_chunks(df, f, "id bigint", 16).collect()) == list(range(50))
