"""Streaming queries: each replays a table as a stream and must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.arrays import r6
from mnemora.functions.text import first_repetition
from mnemora.plans import inputs
from mnemora.plans import text_plans as TP
from mnemora.plans.confidence_plans import CONF
from mnemora.plans.conversation_plans import S as TALK
from mnemora.plans.text_plans import r6s, with_
from mnemora.session import configure
from mnemora.streaming.sources import drain, stream_table
from mnemora.streaming.stateful import bare_token_rows, stream_confidence, stream_file_blocks, stream_prefixes, stream_topic_shifts, token_arrays

Q: dict = {}
S: dict[str, str] = {}


def topic_shifts(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    vectors = inputs.embeddings(spark, folder).select(F.col("id").alias("_v"), "embedding")
    n = vectors.count()
    talk = stream_table(spark, folder, "conversations").filter("role = 'user'")
    talk = talk.withColumn("_v", F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(max(n, 1)))).join(vectors, "_v", "left")
    out = drain(stream_topic_shifts(talk, "conv_id", "turn", threshold=0.1), "topic-shifts")
    return out.select("conv_id", "turn", "is_shift", r6(F.col("similarity")).alias("similarity"))


def confidence(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    events = stream_table(spark, folder, "events").select(
        "user_id", "event_id", "ts", (F.get_json_object("props", "$.k").cast("double") / 100).alias("prob")
    )
    out = drain(stream_confidence(events, "user_id", ["ts", "event_id"], "prob"), "confidence")
    return out.select("event_id", r6(F.col("normalized_confidence")).alias("normalized_confidence"), r6(F.col("baseline")).alias("baseline"))


def file_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with a file block in the middle: what is shown and what is taken out."""
    configure(spark)
    talk = stream_table(spark, folder, "conversations")
    text = F.concat("text", F.lit("\n>>> FILE: "), "role", F.lit(".txt\nbody "), F.col("turn").cast("string"), F.lit("\n<<<"), F.lit("\nafter "), "text")
    rows = token_arrays(talk, F.concat_ws(":", "conv_id", "turn"), text)
    out = drain(stream_file_blocks(rows, "key", "pos"), "file-blocks")
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "display"))), lambda x: x["display"]), "")
    # one turn's tokens per group, as in its own text
    return out.groupBy("key").agg(F.md5(shown).alias("shown"), F.max("filename").alias("filename"), F.max("content").alias("content"))


def prefix_checks(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    talk = stream_table(spark, folder, "documents")
    tail = F.lit("")
    for source, text in inputs.GARBAGE:
        tail = F.when(F.col("source") == source, text).otherwise(tail)
    rows = bare_token_rows(talk, F.col("doc_id"), F.concat("text", tail))
    prefixes = stream_prefixes(rows, "key", "pos")
    first = first_repetition(F.split("prefix", " "), F.col("points"))
    out = drain(prefixes.select("key", F.size("points").alias("n"), first.alias("f")), "prefixes")
    return out.groupBy(F.col("key").alias("doc_id")).agg(
        F.sum("n").alias("n_checks"), F.min_by("f.pattern", "f.at").alias("first_pattern"), F.min("f.at").alias("stopped_at")
    )


Q.update(
    stream_topic_shifts=topic_shifts,
    stream_confidence=confidence,
    stream_file_blocks=file_blocks,
    stream_prefix_checks=prefix_checks,
)

S["stream_topic_shifts"] = TALK["talk_topic_shifts"]
S["stream_confidence"] = with_(
    CONF,
    """pos AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM conf),
win AS (SELECT event_id, exp(avg(ln(greatest(prob, 0.01))) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS g,
  sum(prob * 0.1 * power(0.9, -i)) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) * power(0.9, i) + 0.5 * power(0.9, i) AS b FROM pos)""",
) + f"SELECT event_id, {r6s('g')} AS normalized_confidence, {r6s('b')} AS baseline FROM win"
S["stream_file_blocks"] = (
    "SELECT conv_id || ':' || turn AS key, md5(text || chr(10) || '>>> ' || 'after ' || text) AS shown, role || '.txt' AS filename, 'body ' || turn AS content FROM conversations"
)
S["stream_prefix_checks"] = TP.S["text_stream_prefix_checks"]
