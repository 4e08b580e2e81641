"""Streams over several micro-batches give what the batch operators give."""

import os

import pytest
from pyspark.sql import functions as F

from mnemora.operators import conversation, series
from mnemora.plans import inputs
from mnemora.session import scratch_dir
from mnemora.streaming import stateful
from mnemora.streaming.sources import drain, stream_table


@pytest.fixture(scope="module")
def split(spark, folder):
    """Conversations and events written as tables of three files each, in order."""
    where = scratch_dir(spark, "split")
    # every fifth turn has no vector
    talk = inputs.turns_with_vectors(spark, folder).withColumn("embedding", F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.col("embedding")))
    for low, high in ((0, 2), (3, 4), (5, 99)):
        talk.filter(F.col("turn").between(low, high)).coalesce(1).write.mode("append").parquet(os.path.join(where, "talk.parquet"))
    conf = inputs.confidences(spark, folder)
    for low, high in ((0, 299), (300, 599), (600, 10**9)):
        conf.filter(F.col("event_id").between(low, high)).coalesce(1).write.mode("append").parquet(os.path.join(where, "conf.parquet"))
    return where


def rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_topic_shifts(spark, split):
    stream = stream_table(spark, split, "talk", 1)
    got = drain(stateful.stream_topic_shifts(stream, "conv_id", "turn", threshold=0.1), "t")
    batch = conversation.topic_shifts(spark.read.parquet(os.path.join(split, "talk.parquet")), ["conv_id"], ["turn"], series.index_block("turn", 2), threshold=0.1)
    assert rounded(got) == rounded(batch.select("conv_id", "turn", "is_shift", "similarity"))


def test_confidence(spark, split):
    stream = stream_table(spark, split, "conf", 1)
    got = drain(stateful.stream_confidence(stream, "user_id", ["ts", "event_id"], "prob"), "c")
    conf = spark.read.parquet(os.path.join(split, "conf.parquet"))
    # a target of 5 rows cuts many users' series into blocks
    blocked, block = series.time_blocks(conf, ["user_id"], "ts", 5)
    assert block is not None and blocked.filter("block > 0").count() > 0
    batch = series.sliding_confidence(blocked, ["user_id"], ["ts", "event_id"], block, "prob")
    assert rounded(got.select("event_id", "normalized_confidence")) == rounded(batch.select("event_id", "normalized_confidence"))


@pytest.mark.parametrize("name", ["talk_topic_shifts", "talk_topic_shifts_parity", "talk_sessions", "stream_topic_shifts", "talk_verdicts", "talk_answer_actions"])
def test_gaps_in_the_vectors(spark, folder, tmp_path, name):
    """Turns whose vector is missing are passed by in the batch, in the stream and in SQL."""
    import compare

    from mnemora.plans import registry

    queries, sql = registry()
    for table in compare.TABLES:
        os.symlink(os.path.join(folder, f"{table}.parquet"), tmp_path / f"{table}.parquet")
    os.unlink(tmp_path / "embeddings.parquet")
    vectors = spark.read.parquet(os.path.join(folder, "embeddings.parquet")).where("vec_id % 7 <> 3")
    vectors.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    assert compare.difference(queries[name](spark, str(tmp_path)), compare.connect(str(tmp_path)), sql[name]) is None


def test_prefixes_hand_each_text_on_once(spark, tmp_path):
    """One row per answer and micro-batch, with the text once, not once for every count that was reached."""
    from mnemora.functions.text import prefix_checkpoints

    rows = spark.range(700).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("key"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("w"), "id").alias("token"))
    rows = rows.where("key = 1 or pos < 250")
    for low, high in ((0, 299), (300, 699)):
        rows.where(F.col("pos").between(low, high)).coalesce(1).write.mode("append").parquet(os.path.join(tmp_path, "tokens.parquet"))
    got = drain(stateful.stream_prefixes(stream_table(spark, str(tmp_path), "tokens", 1), "key", "pos"), "p").collect()
    assert sorted((r["key"], r["points"]) for r in got) == [(1, [40, 80, 160, 260]), (1, [360, 460, 560, 660]), (2, [40, 80, 160])]
    assert all(r["prefix"] == " ".join(f"w{i}" for i in range(r["points"][-1])) for r in got)
    grid = spark.range(1).select(prefix_checkpoints(F.lit(700)).alias("p")).first()["p"]
    assert sorted(p for r in got if r["key"] == 1 for p in r["points"]) == grid


def test_file_blocks_of_arrays_equal_those_of_tokens(spark, tmp_path):
    """A text's tokens in one row, or cut over two micro-batches inside a block, give the rows of single tokens."""
    texts = [(1, "a >>> FILE: x.txt\nbody one\n<<<\nafter that"), (2, "no block here"), (3, ">>> FILE: y.md\nline\n\nline <<< end >>> FILE: z\nb\n<<<")]
    df = spark.createDataFrame(texts, "id int, text string")
    singles = stateful.token_rows(df, F.col("id"), F.col("text"))
    arrays = stateful.token_arrays(df, F.col("id"), F.col("text"))
    assert arrays.count() == 3 and singles.count() > 15
    singles.coalesce(1).write.parquet(os.path.join(tmp_path, "single.parquet"))
    arrays.coalesce(1).write.parquet(os.path.join(tmp_path, "whole.parquet"))
    for low, n in ((0, 3), (3, 99)):
        cut = arrays.where(F.size("token") > low).select("key", F.lit(low).alias("pos"), F.slice("token", low + 1, n).alias("token"))
        cut.coalesce(1).write.mode("append").parquet(os.path.join(tmp_path, "cut.parquet"))
    got = {
        name: sorted(map(tuple, drain(stateful.stream_file_blocks(stream_table(spark, str(tmp_path), name, 1), "key", "pos"), name).collect()), key=repr)
        for name in ("single", "whole", "cut")
    }
    assert got["single"] == got["whole"] == got["cut"] and len(got["single"]) == singles.count()
    assert {r[3] for r in got["whole"]} == {None, "x.txt", "y.md"}
