"""Inputs the registered queries share, all derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.session import configure
from mnemora.sources.tables import spread, table

DIM = 64


def documents(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return spread(table(spark, folder, "documents"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Store vectors: ``id, embedding, label``."""
    configure(spark)
    return table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id")


def item_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Store flags per vector: low quality means removed, toxic means flagged."""
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "id")
    return embeddings(spark, folder).select("id").join(labels, "id", "left").select("id", *_flags())


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Store items: every document with its vector, if any, and its flags."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source"
    )
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "id")
    vectors = embeddings(spark, folder)
    return (
        docs.join(vectors, "id", "left")
        .join(labels, "id", "left")
        .select("id", "content", "embedding", "label", category_of(F.col("lang")).alias("main_category"), "source", *_flags())
    )


def _flags() -> list[Column]:
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return [
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("deleted"),
        toxic.alias("hallucination_detected"),
        F.when(toxic, 0.5).otherwise(0.0).alias("hallucination_score"),
        F.lit(0.7).alias("reliability_penalty"),
    ]


def category_of(lang: Column) -> Column:
    return (
        F.when(lang == "en", "declarative")
        .when(lang == "fr", "procedural_knowledge")
        .when(lang == "de", "conceptual_knowledge")
        .otherwise("experiential")
    )


def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Search queries: the mean vector of every label, pooled position by position."""
    return mean_vectors(embeddings(spark, folder), "label", "embedding").select(
        F.col("label").cast("bigint").alias("query_id"), F.col("mean").alias("query_vec")
    )


def mean_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise mean per key. Positions are averaged with map-side combine, so a key may be large."""
    return (
        df.select(key, F.posexplode(vec).alias("pos", "x"))
        .groupBy(key, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
        .select(key, F.transform("v", lambda e: e["x"]).alias("mean"))
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return table(spark, folder, "conversations")


def turns_with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns with the vector of number ``conv*8 + turn`` modulo the number of vectors, or NULL."""
    vectors = embeddings(spark, folder).select(F.col("id").alias("_v"), "embedding")
    n = vectors.count()
    return (
        turns(spark, folder)
        .withColumn("_v", F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(max(n, 1))))
        .join(vectors, "_v", "left")
        .drop("_v")
    )


def confidences(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence series: one per user, from the events' ``k`` as hundredths."""
    configure(spark)
    events = table(spark, folder, "events")
    return events.select(
        "user_id",
        "event_id",
        "ts",
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("prob"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions about every part, event and nation: ``kind, qid, question``."""
    configure(spark)

    def ask(name: str, kind: str, key: str, lead: str, subject: str) -> DataFrame:
        return table(spark, folder, name).select(
            F.lit(kind).alias("kind"),
            F.col(key).cast("bigint").alias("qid"),
            F.concat(F.lit(lead), F.col(subject)).alias("question"),
        )

    return (
        ask("part", "part", "p_partkey", "what is ", "p_name")
        .unionByName(ask("events", "event", "event_id", "how to fix ", "event_type"))
        .unionByName(ask("nation", "nation", "n_nationkey", "the scientific theory of ", "n_name"))
        .unionByName(ask("orders", "order", "o_orderkey", "calculate the market price of ", "o_orderpriority"))
    )


def marked_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with garbage appended by source, so that every detector has hits."""
    docs = documents(spark, folder)
    tail = F.lit("")
    for source, text in GARBAGE:
        tail = F.when(F.col("source") == source, text).otherwise(tail)
    return docs.withColumn("text", F.concat("text", tail))


# Garbage appended to the documents of a source; the oracle SQL uses the same rows.
GARBAGE = [
    ("src0", " $ $ $ $ "),
    ("src1", " $n$$n "),
    ("src2", " r-xr-xr-xr-x "),
    ("src3", " txt,txt,txt "),
    ("src4", " a,b,c,d,e,f "),
    ("src5", " and,and "),
    ("src6", " ``` py ``` ``` ``` "),
    ("src7", " zzzzzzzzzzzz "),
    ("src8", "\nsame line\nsame line\nsame line"),
    ("src9", " total 12K "),
    ("src10", " -rw-r--r-- 1 root root 12K "),
    ("src11", " drwxr-xr-xrwx 2 root root 4K "),
    ("src12", " ,, <|user|> "),
    ("src13", " a..b..c.. x.y.z.w "),
]


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns with the query before them and measures taken from the answer itself."""
    from mnemora.functions.text import length_class_entropy, tokens
    from mnemora.operators.conversation import exchanges
    from mnemora.operators.series import index_block, sliding_confidence

    pairs = exchanges(turns(spark, folder), ["conv_id"], ["turn"], index_block("turn"))
    measured = (
        pairs.withColumn("_tok", tokens(F.col("text")))
        .withColumn("tokens_generated", F.size("_tok"))
        .withColumn(
            "confidence", F.size(F.array_distinct("_tok")) / F.greatest(F.lit(1), F.size("_tok"))
        )
        .withColumn("entropy", length_class_entropy(F.col("_tok")))
        .withColumn("perplexity", F.pow(F.lit(2.0), F.col("entropy")))
        .drop("_tok")
    )
    # few answers end up in one shuffle partition, and what follows them is heavy on the processor
    return spread(sliding_confidence(measured, ["conv_id"], ["turn"], index_block("turn"), "confidence", 5))
