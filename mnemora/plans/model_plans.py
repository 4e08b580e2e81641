"""Learned classification, embedding injection and batch sizing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.arrays import r6
from mnemora.functions.embedding import embedder, seeded_embedding
from mnemora.functions.vectors import norm
from mnemora.operators import analytics, batching, model, store
from mnemora.plans import inputs
from mnemora.plans.classify_plans import ASK
from mnemora.plans.text_plans import r6s, with_
from mnemora.session import configure
from mnemora.sources.tables import table

Q: dict = {}
S: dict[str, str] = {}


def variations(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.questions(spark, folder).select("kind", "qid", F.concat("question", F.lit("?")).alias("q"))
    return asked.select("kind", "qid", F.posexplode(model.question_variations(F.col("q"))).alias("pos", "variation"))


def learned_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Rules, then a model of the example questions, over every conversation turn and every question."""
    fitted = model.train(model.example_questions(configure(spark)))
    talk = inputs.turns(spark, folder).select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    asked = inputs.questions(spark, folder).select("kind", F.col("qid").alias("id"), F.lit(0).cast("bigint").alias("part"), F.col("question").alias("text"))
    out = model.classify(fitted, talk.unionByName(asked))
    return out.select("kind", "id", "part", "category", r6(F.col("confidence")).alias("confidence"), "decided_by")


def embedded_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns embedded by an injected function and added to the store."""
    talk = inputs.turns(spark, folder)
    rows = store.prepare_items(talk, "text", F.timestamp_seconds(F.col("conv_id")), embedder(seeded_embedding(32)))
    return rows.select("conv_id", "turn", F.size("embedding").alias("dim"), r6(norm(F.col("embedding"))).alias("norm"))


def chunked_map(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder).select("doc_id", "text")

    def measure(frame):
        return frame.assign(n=frame["text"].str.len())[["doc_id", "n"]]

    return batching.map_in_chunks(docs, measure, "doc_id bigint, n bigint")


Q.update(
    model_variations=variations,
    model_learned_categories=learned_categories,
    model_embedded_turns=embedded_turns,
    batch_chunked_map=chunked_map,
)

S["model_variations"] = with_(
    ASK,
    """q AS (SELECT kind, qid, lower(question || '?') AS q FROM ask),
l AS (SELECT kind, qid, list_filter([q[1:-2], CASE WHEN NOT regexp_matches(q, '^(what|how|who|when|where|why)') THEN 'what is ' || q END, 'I want to know ' || q, 'tell me ' || q,
  CASE WHEN contains(q, 'how to') OR contains(q, 'how do') THEN replace(q, 'how to', 'I need to') END,
  CASE WHEN contains(q, 'how to') OR contains(q, 'how do') THEN replace(q, 'how do', 'I need to know how to') END], lambda x: x IS NOT NULL) AS v FROM q)""",
) + "SELECT kind, qid, unnest(range(len(v)))::INT AS pos, unnest(v) AS variation FROM l"
S["model_embedded_turns"] = "SELECT conv_id, turn, 32::INT AS dim, 1.0::DOUBLE AS norm FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''"
S["batch_chunked_map"] = "SELECT doc_id, length(text) AS n FROM documents"
