"""Store, source and sink queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import blocks as B
from mnemora.functions import vectors as V
from mnemora.functions.arrays import r6
from mnemora.operators import retrieval, store
from mnemora.operators.levels import with_levels
from mnemora.plans import inputs
from mnemora.plans.classify_plans import _closed, _form, _low, category_sql
from mnemora.plans.search_plans import S as SEARCH
from mnemora.plans.search_plans import VEC, unit_sql
from mnemora.plans.text_plans import r6s, with_
from mnemora.session import scratch_dir
from mnemora.sources.buckets import BucketedTable
from mnemora.sources.tables import table
from mnemora.sources.versions import VersionedStore

Q: dict = {}
S: dict[str, str] = {}

NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def memory(spark: SparkSession, folder: str) -> DataFrame:
    """The store as a table: text ids, tombstones, metadata map."""
    return inputs.items(spark, folder).select(
        F.concat(F.lit("doc"), F.col("id").cast("string")).alias("id"),
        "content",
        "embedding",
        F.create_map(F.lit("source"), F.col("source"), F.lit("category"), F.col("main_category")).alias("attrs"),
        F.lit(0).cast("bigint").alias("retrieval_count"),
        F.lit(None).cast("timestamp").alias("last_access"),
        F.lit(None).cast("timestamp").alias("modified_at"),
        "deleted",
    )


def add(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns prepared for the store."""
    talk = inputs.turns_with_vectors(spark, folder)
    ts = F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn") + 1700000000)
    rows = store.prepare_items(talk, "text", ts)
    return rows.select(
        "conv_id", "turn", "id", "main_category", "type", "content_length", F.md5("content").alias("digest"), r6(V.norm(F.col("embedding"))).alias("norm"),
        "retrieval_count", "deleted",
    )


def add_mixed_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Turns whose vectors have 48, 64 or 96 components, brought to the store's 64."""
    talk = inputs.turns_with_vectors(spark, folder)
    v, kind = F.col("embedding"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    mixed = F.when(kind == 1, F.slice(v, 1, 48)).when(kind == 2, F.concat(v, F.slice(v, 1, 32))).otherwise(v)
    ts = F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn") + 1700000000)
    rows = store.prepare_items(talk.withColumn("embedding", mixed), "text", ts, dim=64)
    at = lambda i: r6(F.get("embedding", F.lit(i)).cast("double"))
    return rows.select(
        "conv_id", "turn", F.size("embedding").alias("n"), at(0).alias("first"), at(63).alias("last"), r6(V.norm(F.col("embedding"))).alias("norm")
    )


def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of documents stored in the same second: equal texts collide."""
    docs = inputs.documents(spark, folder)
    from mnemora.functions.classify import item_id

    return store.duplicate_ids(docs.select(item_id(F.col("text"), F.lit("2024-01-01").cast("timestamp")).alias("id")))


def get(spark: SparkSession, folder: str) -> DataFrame:
    """Items that share the id of a benchmark row, tombstones hidden."""
    wanted = table(spark, folder, "benchmark").select(F.concat(F.lit("doc"), F.col("item_id").cast("string")).alias("id"))
    return store.get(memory(spark, folder), wanted).select("id", F.md5("content").alias("digest"))


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Updates: benchmark texts replace documents of their number, good documents get a grade."""
    bench = table(spark, folder, "benchmark").select(F.col("item_id").alias("n"), F.col("text").alias("new_content"))
    good = table(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").alias("n"), F.lit("high").alias("grade"))
    vectors = inputs.embeddings(spark, folder).select(F.col("id").alias("n"), F.reverse("embedding").alias("new_embedding"))
    return (
        bench.join(good, "n", "full_outer")
        .join(vectors, "n", "left")
        .select(
            F.concat(F.lit("doc"), F.col("n").cast("string")).alias("id"),
            "new_content",
            F.when(F.col("grade").isNotNull(), F.create_map(F.lit("grade"), F.col("grade"))).alias("new_attrs"),
            "new_embedding",
        )
    )


def update(spark: SparkSession, folder: str) -> DataFrame:
    out = store.update(memory(spark, folder), changes(spark, folder), _now())
    return out.select(
        "id",
        F.md5("content").alias("digest"),
        r6(F.get("embedding", F.lit(0)).cast("double")).alias("first"),
        F.col("attrs")["source"].alias("source"),
        F.col("attrs")["grade"].alias("grade"),
        F.date_format("modified_at", "yyyy-MM-dd").alias("modified"),
    )


def remove(spark: SparkSession, folder: str) -> DataFrame:
    toxic = table(spark, folder, "labels").filter("toxic = 1").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"))
    return store.remove(memory(spark, folder), toxic).groupBy("deleted").agg(F.count("*").alias("n"))


def compact(spark: SparkSession, folder: str) -> DataFrame:
    items = memory(spark, folder)
    levels = with_levels(items, inputs.DIM, 2)
    live, kept = store.compact(items, levels)
    return live.select(F.lit("item").alias("kind"), "id").unionByName(
        kept.select(F.concat(F.lit("level_"), F.col("level").cast("string")).alias("kind"), F.col("item_id").alias("id"))
    )


def change_dimension(spark: SparkSession, folder: str) -> DataFrame:
    out = store.change_dimension(memory(spark, folder), 48)
    return out.select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double") + 1e-9, 4).alias("first"))


def rebuilt_levels(spark: SparkSession, folder: str) -> DataFrame:
    levels = store.rebuild_levels(memory(spark, folder), inputs.DIM, 3)
    return levels.groupBy("level").agg(F.count("*").alias("n"), r6(F.avg(V.norm(F.col("vec")))).alias("mean_norm"))


def stats(spark: SparkSession, folder: str) -> DataFrame:
    items = memory(spark, folder)
    return store.stats(items, with_levels(items, inputs.DIM, 3))


def retrievals(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is one retrieval of the document with the user's number."""
    hits = table(spark, folder, "events").select(F.concat(F.lit("doc"), F.col("user_id").cast("string")).alias("item_id"))
    out = store.record_retrievals(memory(spark, folder), hits, _now())
    return out.select("id", "retrieval_count", F.date_format("last_access", "yyyy-MM-dd").alias("last_access"))


def counted_searches(spark: SparkSession, folder: str) -> DataFrame:
    """Every label's mean vector is searched twice in a stored memory, which counts what it returns."""
    fresh = {"retrieval_count": F.lit(0).cast("bigint"), "last_access": F.lit(None).cast("timestamp")}
    rows = inputs.items(spark, folder).withColumns(fresh)
    memory_table = BucketedTable.create(rows, scratch_dir(spark, "memory"))
    for _ in range(2):
        retrieval.retrieve(memory_table, inputs.label_centroids(spark, folder), inputs.DIM, _now())
    return memory_table.read().select("id", "retrieval_count", F.date_format("last_access", "yyyy-MM-dd").alias("last_access"))


def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    items = memory(spark, folder).select("id", "content", "embedding", "retrieval_count", "deleted")
    texts = store.to_json(items)
    back = store.from_json(texts, "retrieval_count bigint, deleted boolean")
    return back.select("id", F.md5("content").alias("digest"), "retrieval_count", "deleted")


def recent_owners(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "ts")
    return store.most_recent(events, "user_id", "ts").select("user_id", "recency", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


def saved_and_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions written to the shared folder; the newest committed one is read back."""
    saved = VersionedStore(spark, scratch_dir(spark, "store"))
    items = memory(spark, folder)
    saved.save(items)
    live, levels = store.compact(items, with_levels(items, inputs.DIM, 2))
    saved.save(live, levels)
    version = saved.version()
    counts = saved.levels(version).groupBy("item_id").agg(F.count("*").alias("n_levels")).withColumnRenamed("item_id", "id")
    return saved.items(version).join(counts, "id", "left").select("id", F.md5("content").alias("digest"), F.coalesce("n_levels", F.lit(0)).alias("n_levels"))


def attached_levels(spark: SparkSession, folder: str) -> DataFrame:
    items = memory(spark, folder)
    out = store.attach_levels(items, with_levels(items, inputs.DIM, 3))
    return out.select("id", F.coalesce(F.size("level_vectors"), F.lit(0)).alias("n_levels"))


def previews(spark: SparkSession, folder: str) -> DataFrame:
    from mnemora.operators.analytics import preview

    return preview(inputs.items(spark, folder)).select("id", "content_preview")


def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return pages.select("page_id", B.safe_filename(F.col("url")).alias("filename"))


def written_files(spark: SparkSession, folder: str) -> DataFrame:
    """File blocks of every document, the last of a name, saved to the shared folder and read back."""
    from mnemora.sources.versions import newest_per_name, write_files

    docs = inputs.documents(spark, folder)
    named = F.concat(F.col("text"), F.lit("\n>>> FILE: "), F.col("source"), F.lit("_"), F.col("lang"), F.lit(".txt\nbody of "), F.col("doc_id").cast("string"), F.lit("\n<<<"))
    found = docs.select("doc_id", F.explode(B.file_blocks(named)).alias("b")).select(
        "doc_id", B.safe_filename(F.col("b.filename")).alias("filename"), F.col("b.content").alias("content")
    )
    where = scratch_dir(spark, "files")
    write_files(newest_per_name(found, "doc_id"), where)
    return spark.read.parquet(where).select("filename", F.col("content").alias("body"))


Q.update(
    store_add=add,
    store_add_mixed_lengths=add_mixed_lengths,
    store_duplicate_ids=duplicate_ids,
    store_get=get,
    store_update=update,
    store_remove=remove,
    store_compact=compact,
    store_change_dimension=change_dimension,
    store_rebuilt_levels=rebuilt_levels,
    store_stats=stats,
    store_retrievals=retrievals,
    store_counted_searches=counted_searches,
    store_json_round_trip=json_round_trip,
    store_recent_owners=recent_owners,
    store_saved_and_loaded=saved_and_loaded,
    source_attached_levels=attached_levels,
    source_previews=previews,
    sink_safe_names=safe_names,
    sink_written_files=written_files,
)

MEM = """mem AS (SELECT 'doc' || d.doc_id AS id, d.doc_id AS n, d.text AS content, list_transform(e.embedding, lambda x: x::DOUBLE) AS v, d.source, coalesce(l.quality = 0, false) AS deleted
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
S["store_add"] = with_(
    "nv AS (SELECT count(*) AS n FROM embeddings)",
    f"""base AS (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS bare, {category_sql(_low)} AS category, (conv_id * 100 + turn + 1700000000) * 1000 AS ms FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''),
cl AS (SELECT *, {_closed} AS f FROM base), src AS (SELECT *, {_form} AS content FROM cl)""",
) + """SELECT conv_id, turn, 'item_' || md5(content)[1:8] || '_' || right(ms::VARCHAR, 6) AS id, category AS main_category, 'unknown' AS type,
CASE WHEN length(content) < 100 THEN 'short' WHEN length(content) < 500 THEN 'medium' ELSE 'long' END AS content_length, md5(content) AS digest, 1.0::DOUBLE AS norm,
0::BIGINT AS retrieval_count, false AS deleted FROM src"""
S["store_add_mixed_lengths"] = with_(
    VEC,
    "nv AS (SELECT count(*) AS n FROM vec)",
    """src AS (SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 1 THEN list_concat(v[1:48], list_transform(range(16), lambda x: 0.0::DOUBLE)) ELSE v END AS v
FROM conversations c CROSS JOIN nv LEFT JOIN vec ON vec.id = (c.conv_id * 8 + c.turn) % nv.n WHERE trim(text, ' ' || chr(10)) <> '')""",
    f"un AS (SELECT conv_id, turn, {unit_sql('v')} AS u FROM src)",
) + f"SELECT conv_id, turn, len(u)::INT AS n, {r6s('u[1]::FLOAT::DOUBLE')} AS first, {r6s('u[64]::FLOAT::DOUBLE')} AS last, {r6s('sqrt(list_dot_product(u, u))')} AS norm FROM un"
S["store_duplicate_ids"] = "SELECT 'item_' || md5(text)[1:8] || '_' || right((epoch_ms(TIMESTAMP '2024-01-01'))::VARCHAR, 6) AS id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1"
S["store_get"] = with_(MEM) + "SELECT id, md5(content) AS digest FROM mem WHERE NOT deleted AND n IN (SELECT item_id FROM benchmark)"
S["store_update"] = with_(MEM) + f"""SELECT m.id, md5(CASE WHEN NOT deleted AND b.text IS NOT NULL THEN b.text ELSE content END) AS digest,
{r6s('CASE WHEN NOT deleted AND b.text IS NOT NULL AND b.text <> content THEN (v[64] / sqrt(list_dot_product(v, v)))::FLOAT ELSE v[1]::FLOAT END')} AS first,
source, CASE WHEN NOT deleted AND q.quality = 1 THEN 'high' END AS grade, CASE WHEN NOT deleted AND (b.text IS NOT NULL OR q.quality = 1) THEN '2024-02-01' END AS modified
FROM mem m LEFT JOIN benchmark b ON b.item_id = m.n LEFT JOIN labels q ON q.doc_id = m.n"""
S["store_remove"] = with_(MEM) + "SELECT deleted OR n IN (SELECT doc_id FROM labels WHERE toxic = 1) AS deleted, count(*) AS n FROM mem GROUP BY 1"
S["store_compact"] = with_(MEM) + "SELECT 'item' AS kind, id FROM mem WHERE NOT deleted UNION ALL SELECT k, id FROM mem, (VALUES ('level_1'), ('level_2')) t(k) WHERE NOT deleted AND v IS NOT NULL"
S["store_change_dimension"] = with_(MEM) + "SELECT id, CASE WHEN v IS NOT NULL THEN 48 END AS dim, round((v[1] / sqrt(list_dot_product(v[1:48], v[1:48])))::FLOAT::DOUBLE + 1e-9, 4) AS first FROM mem"
S["store_rebuilt_levels"] = with_(MEM) + "SELECT level, count(*) AS n, 1.0::DOUBLE AS mean_norm FROM mem, (VALUES (1), (2), (3)) t(level) WHERE NOT deleted AND v IS NOT NULL GROUP BY level"
S["store_stats"] = with_(MEM) + """SELECT 'total_items' AS metric, count(*) AS value FROM mem UNION ALL SELECT 'active_items', count(*) FROM mem WHERE NOT deleted UNION ALL SELECT 'deleted_items', count(*) FROM mem WHERE deleted
UNION ALL SELECT 'index_size', count(v) FROM mem UNION ALL SELECT 'index_dimension', max(len(v)) FROM mem UNION ALL SELECT k, count(*) FROM mem, (VALUES ('level_1_size'), ('level_2_size'), ('level_3_size')) t(k) WHERE v IS NOT NULL GROUP BY k"""
S["store_retrievals"] = with_(MEM, "use AS (SELECT user_id, count(*) AS c FROM events GROUP BY 1)") + """SELECT id, CASE WHEN c IS NOT NULL AND NOT deleted THEN c ELSE 0 END AS retrieval_count,
CASE WHEN c IS NOT NULL AND NOT deleted THEN '2024-02-01' END AS last_access FROM mem LEFT JOIN use ON use.user_id = mem.n"""
# The memory holds documents only, so vectors without one take no slots.
_within = SEARCH["search_multi_level"].replace(" AS u FROM vec)", " AS u FROM vec WHERE id IN (SELECT doc_id FROM documents))", 1)
S["store_counted_searches"] = f"""WITH found AS (SELECT item_id, count(*) AS n FROM ({_within}) GROUP BY item_id)
SELECT doc_id AS id, coalesce(2 * n, 0)::BIGINT AS retrieval_count, CASE WHEN n > 0 THEN '2024-02-01' END AS last_access FROM documents LEFT JOIN found ON item_id = doc_id"""
S["store_json_round_trip"] = with_(MEM) + "SELECT id, md5(content) AS digest, 0::BIGINT AS retrieval_count, deleted FROM mem"
S["store_recent_owners"] = with_("u AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY last DESC, user_id) AS recency FROM u)") + "SELECT user_id, recency, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_used FROM r WHERE recency <= 5"
S["store_saved_and_loaded"] = with_(MEM) + "SELECT id, md5(content) AS digest, CASE WHEN v IS NOT NULL THEN 2 ELSE 0 END::BIGINT AS n_levels FROM mem WHERE NOT deleted"
S["source_attached_levels"] = with_(MEM) + "SELECT id, CASE WHEN v IS NOT NULL THEN 3 ELSE 0 END AS n_levels FROM mem"
S["source_previews"] = "SELECT doc_id AS id, left(text, 100) AS content_preview FROM documents ORDER BY doc_id LIMIT 100"
S["sink_safe_names"] = r"""SELECT page_id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS filename FROM pages"""
S["sink_written_files"] = "SELECT source || '_' || lang || '.txt' AS filename, 'body of ' || max(doc_id) AS body FROM documents GROUP BY source, lang"
