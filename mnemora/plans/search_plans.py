"""Vector, search and embedding-space queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import vectors as V
from mnemora.functions.arrays import r6
from mnemora.operators import analytics as A
from mnemora.operators import search as R
from mnemora.operators.levels import level_parameters, with_levels
from mnemora.operators.term_join import best_text_similarity as best_text_similarity_of
from mnemora.plans import inputs
from mnemora.plans.text_plans import W, r6s, with_

Q: dict = {}
S: dict[str, str] = {}

DIM = inputs.DIM
LEVELS = [1, 2, 3]
K, MIN = 5, 0.25


def neighbours_dot(spark: SparkSession, folder: str) -> DataFrame:
    """Inner product and cosine of every vector with its label's mean vector."""
    vectors = inputs.embeddings(spark, folder)
    means = inputs.mean_vectors(vectors, "label", "embedding")
    joined = vectors.join(means, "label")
    return joined.select(
        "id", r6(V.dot(F.col("embedding"), F.col("mean"))).alias("inner"), r6(V.cosine(F.col("embedding"), F.col("mean"))).alias("cosine")
    )


def normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors scaled by their id, then normalised; id 0 becomes a zero vector."""
    vectors = inputs.embeddings(spark, folder)
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("id"))
    out = vectors.withColumn("u", V.unit(scaled))
    return out.select("id", r6(V.norm(F.col("u"))).alias("norm"), r6(F.get("u", F.lit(0))).alias("first"), r6(F.get("u", F.lit(63))).alias("last"))


def pooled(spark: SparkSession, folder: str) -> DataFrame:
    means = inputs.mean_vectors(inputs.embeddings(spark, folder), "label", "embedding")
    return means.select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", r6(F.col("x")).alias("x"))


def resized(spark: SparkSession, folder: str) -> DataFrame:
    vectors = inputs.embeddings(spark, folder)
    short, wide = V.resize(F.col("embedding"), 48), V.resize(F.col("embedding"), 96)
    return vectors.select(
        "id",
        F.size(short).alias("n_short"),
        F.size(wide).alias("n_wide"),
        r6(F.get(short, F.lit(0))).alias("short_first"),
        r6(F.get(short, F.lit(47))).alias("short_last"),
        r6(F.get(wide, F.lit(63))).alias("wide_last"),
        r6(V.norm(short)).alias("short_norm"),
    )


def level_vectors(spark: SparkSession, folder: str) -> DataFrame:
    long = with_levels(inputs.embeddings(spark, folder), DIM, 4)
    return long.select("item_id", "level", F.posexplode("vec").alias("pos", "x")).select(
        "item_id", "level", "pos", F.round(F.col("x").cast("double") + 1e-9, 4).alias("x")
    )


def enhanced(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.confidences(spark, folder)
    return rows.select("event_id", r6(V.enhance(F.col("prob"))).alias("enhanced"), r6(V.enhance(F.col("prob"), 0.5)).alias("stronger"))


def _standard_hits(spark: SparkSession, folder: str) -> DataFrame:
    vectors = inputs.embeddings(spark, folder).select("id", "embedding")
    return R.standard_search(
        inputs.item_flags(spark, folder), inputs.label_centroids(spark, folder), DIM, K, MIN, vectors=vectors
    )


def standard(spark: SparkSession, folder: str) -> DataFrame:
    hits = _standard_hits(spark, folder)
    return hits.select("query_id", "rank", "item_id", r6(F.col("raw_similarity")).alias("raw_similarity"), r6(F.col("similarity")).alias("similarity"), "hallucination_warning")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    vectors = inputs.embeddings(spark, folder).select("id", "embedding")
    hits, bound = R.level_hits(vectors, inputs.label_centroids(spark, folder), DIM, K, LEVELS)
    return R.score_level_hits(R.attach_items(hits, inputs.item_flags(spark, folder), bound), MIN)


def level_hits(spark: SparkSession, folder: str) -> DataFrame:
    out = _scored(spark, folder)
    return out.select("query_id", "level", "raw_rank", "item_id", r6(F.col("base")).alias("base"), r6(F.col("enhanced")).alias("enhanced"))


def merged(spark: SparkSession, folder: str) -> DataFrame:
    out = R.merge_levels(_scored(spark, folder))
    names = ["raw_similarity", "similarity", "rank_score", "original_similarity", "enhancement"]
    return out.select("query_id", "item_id", "level", *[r6(F.col(n)).alias(n) for n in names], "hallucination_warning")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scored(spark, folder)
    out = R.cross_level_boost(scored, R.merge_levels(scored))
    return out.select("query_id", "item_id", "found_in_levels", r6(F.col("similarity")).alias("similarity"))


def multi_level(spark: SparkSession, folder: str) -> DataFrame:
    hits = R.multi_level_search(
        inputs.items(spark, folder), inputs.label_centroids(spark, folder), DIM, K, MIN, LEVELS,
        vectors=inputs.embeddings(spark, folder).select("id", "embedding"),
    )
    names = ["raw_similarity", "similarity", "rank_score"]
    return hits.select("query_id", "rank", "item_id", "level", *[r6(F.col(n)).alias(n) for n in names], "hallucination_warning")


def best_text_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Every assistant turn against all live memories, flagged ones at their penalty."""
    talk = inputs.turns(spark, folder).where("role = 'assistant'")
    answers = talk.select(F.struct("conv_id", "turn").alias("id"), "text")
    weight = F.when(F.col("hallucination_detected"), F.col("reliability_penalty")).otherwise(1.0)
    memories = inputs.items(spark, folder).where("not deleted").select("id", F.col("content").alias("text"), weight.alias("similarity"))
    out = best_text_similarity_of(answers, memories)
    return out.select("id.conv_id", "id.turn", r6(F.col("text_similarity")).alias("text_similarity"))


def diversity(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy choice among the merged hits before any cut."""
    found = R.merge_levels(_scored(spark, folder)).join(inputs.items(spark, folder).select(F.col("id").alias("item_id"), "content"), "item_id")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rank_score").desc(), "item_id"))
    return R.promote_diversity(found.withColumn("pos", pos), 4).select("query_id", "pick", "item_id")


def text_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Word distance between each document and the benchmark text of the same number."""
    from mnemora.sources.tables import table

    bench = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("other"))
    docs = inputs.documents(spark, folder).join(bench, "doc_id", "left")
    return docs.select(
        "doc_id",
        r6(V.jaccard_distance(V.word_set(F.col("text")), V.word_set(F.coalesce("other", F.lit(""))))).alias("distance"),
        r6(F.coalesce(V.term_similarity(F.col("text"), F.coalesce("other", F.lit("")), F.lit(0.8)), F.lit(0.0))).alias("term_similarity"),
    )


def deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder).select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"), (F.lit(1.0) / (F.col("n_chars") + 1)).alias("similarity"))
    return R.deduplicate(docs).select("item_id")


def metadata_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata conditions after the search, as the hits' categories decide."""
    hits = _standard_hits(spark, folder)
    cats = inputs.items(spark, folder).select(F.col("id").alias("item_id"), "main_category")
    return R.filter_by_metadata(hits.join(cats, "item_id"), {"main_category": "declarative"}).select("query_id", "rank", "item_id")


def metadata_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    """The same conditions before the search: only matching items compete."""
    cats = inputs.items(spark, folder).select("id", "main_category")
    store = inputs.embeddings(spark, folder).select("id", "embedding").join(inputs.item_flags(spark, folder), "id").join(cats, "id")
    store = R.filter_by_metadata(store, {"main_category": "declarative"})
    hits = R.standard_search(store, inputs.label_centroids(spark, folder), DIM, K, MIN)
    return hits.select("query_id", "rank", "item_id", r6(F.col("similarity")).alias("similarity"))


def support(spark: SparkSession, folder: str) -> DataFrame:
    hits = _standard_hits(spark, folder)
    out = R.memory_support(hits)
    return out.select("query_id", "memory_count", r6(F.col("best_similarity")).alias("best_similarity"), "memory_supported")


def memory_prompts(spark: SparkSession, folder: str) -> DataFrame:
    from mnemora.operators.conversation import memory_prompt

    hits = _standard_hits(spark, folder)
    texts = inputs.items(spark, folder).select("id", "content", "main_category")
    out = memory_prompt(R.attach_items(hits, texts, None), 0.99)
    return out.select("query_id", "n_high", "n_rest", F.md5("memory_text").alias("digest"), F.length("memory_text").alias("n_chars"))


def category_similarity(spark: SparkSession, folder: str) -> DataFrame:
    out = A.category_similarity(inputs.embeddings(spark, folder))
    return out.select("a", "b", "pairs", r6(F.col("mean_similarity")).alias("mean_similarity"))


def category_colours(spark: SparkSession, folder: str) -> DataFrame:
    return A.category_ids(inputs.documents(spark, folder), "source").select("category", F.col("colour").cast("bigint").alias("colour"))


def _store_and_levels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = inputs.embeddings(spark, folder)
    store = vectors.select(
        "id", "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("main_category"), F.col("label").cast("bigint").alias("retrieval_count")
    )
    return store, with_levels(vectors, DIM, 3)


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    store, levels = _store_and_levels(spark, folder)
    out = A.fingerprints(store, levels)
    return out.select("item_id", "score", "level", F.posexplode("values").alias("pos", "x")).select(
        "item_id", "score", "level", "pos", F.round(F.col("x") + 1e-9, 4).alias("x")
    )


def retrieval_map(spark: SparkSession, folder: str) -> DataFrame:
    return A.retrieval_map(_store_and_levels(spark, folder)[0], DIM)


def flow_map(spark: SparkSession, folder: str) -> DataFrame:
    return A.flow_map(*_store_and_levels(spark, folder), DIM)


def ring_map(spark: SparkSession, folder: str) -> DataFrame:
    return A.ring_map(*_store_and_levels(spark, folder), DIM)


def space_map(spark: SparkSession, folder: str) -> DataFrame:
    return A.space_map(*_store_and_levels(spark, folder), DIM)


Q.update(
    vector_inner_product=neighbours_dot,
    vector_normalised=normalised,
    vector_mean_pooled=pooled,
    vector_resized=resized,
    vector_levels=level_vectors,
    vector_enhanced_similarity=enhanced,
    search_standard=standard,
    search_level_hits=level_hits,
    search_merged_levels=merged,
    search_cross_level_boost=verified,
    search_multi_level=multi_level,
    search_diversity=diversity,
    search_best_text_similarity=best_text_similarity,
    search_text_distance=text_distances,
    search_deduplicated=deduplicated,
    search_metadata_filter=metadata_filter,
    search_metadata_prefilter=metadata_prefilter,
    search_memory_support=support,
    search_memory_prompts=memory_prompts,
    analytics_category_similarity=category_similarity,
    analytics_category_colours=category_colours,
    analytics_fingerprints=fingerprints,
    analytics_retrieval_map=retrieval_map,
    analytics_flow_map=flow_map,
    analytics_ring_map=ring_map,
    analytics_space_map=space_map,
)

VEC = "vec AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
CENTROID = """mp AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM vec) GROUP BY ALL),
cen AS (SELECT label::BIGINT AS query_id, list(x ORDER BY pos) AS q FROM mp GROUP BY label)"""
FLAGS = """flag AS (SELECT e.vec_id AS id, coalesce(l.quality = 0, false) AS deleted, coalesce(l.toxic = 1, false) AS flagged,
  CASE WHEN l.toxic = 1 THEN 0.5 ELSE 0.0 END AS score FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id)"""


def boost(x: str, f: float = 0.3) -> str:
    return f"CASE WHEN {x} > 0.5 THEN least(1.0, {x} + ({x} - 0.6) * {2 * f}) WHEN {x} < 0.5 THEN greatest(0.0, {x} - (0.4 - {x}) * {2 * f}) ELSE 0.5 END"


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-10))"


def level_sql(levels: list[int], source: str = "vec", key: str = "id", vec: str = "v", prefix: str = "x") -> str:
    """Level vectors of a table, with the seeded parameters written out as numbers."""
    p = prefix
    return f"""{p}b AS (SELECT {key} AS k, {unit_sql(vec)} AS u FROM {source}),
{p}s AS (SELECT b.k, m.level, m.pos, list_dot_product(b.u, m.col) + m.bias AS s FROM {p}b b, mat m),
{p}t AS (SELECT k, level, pos, CASE level % 3 WHEN 0 THEN sign(s) * power(abs(s), 0.8)
  WHEN 1 THEN (exp(2 * s * (1 + 0.1 * level)) - 1) / (exp(2 * s * (1 + 0.1 * level)) + 1)
  ELSE sign(s) * ln(1 + abs(s) * (1 + 0.05 * level)) END AS s FROM {p}s),
{p}l AS (SELECT k, level, list(s ORDER BY pos) AS w FROM {p}t GROUP BY ALL),
{p}v AS (SELECT k, level, {unit_sql('w')} AS w FROM {p}l)"""


def matrix_sql(levels: list[int]) -> str:
    parameters = level_parameters(DIM, 4)
    rows = []
    for lv in levels:
        matrix, bias = parameters[lv]
        for j in range(DIM):
            rows.append(f"({lv}, {j}, [{', '.join(repr(float(x)) for x in matrix[:, j])}]::DOUBLE[], {float(bias[j])!r}::DOUBLE)")
    return "mat AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(level, pos, col, bias))"


S["vector_inner_product"] = with_(VEC, CENTROID) + f"SELECT id, {r6s('list_dot_product(v, q)')} AS \"inner\", {r6s('list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q))')} AS cosine FROM vec JOIN cen ON cen.query_id = vec.label"
S["vector_normalised"] = with_(VEC, f"sc AS (SELECT id, list_transform(v, lambda x: x * id) AS v FROM vec), un AS (SELECT id, {unit_sql('v')} AS u FROM sc)") + f"SELECT id, {r6s('sqrt(list_dot_product(u, u))')} AS norm, {r6s('u[1]')} AS first, {r6s('u[64]')} AS last FROM un"
S["vector_mean_pooled"] = with_(VEC, CENTROID) + f"SELECT label, pos::INT AS pos, {r6s('x')} AS x FROM mp"
S["vector_resized"] = with_(VEC, f"cut AS (SELECT id, v[1:48] AS a, list_concat(v, list_transform(range(32), lambda x: 0.0::DOUBLE)) AS b FROM vec), un AS (SELECT id, {unit_sql('a')} AS a, {unit_sql('b')} AS b FROM cut)") + f"""SELECT id, len(a)::INT AS n_short, len(b)::INT AS n_wide,
{r6s('a[1]')} AS short_first, {r6s('a[48]')} AS short_last, {r6s('b[64]')} AS wide_last, {r6s('sqrt(list_dot_product(a, a))')} AS short_norm FROM un"""
S["vector_levels"] = with_(VEC, matrix_sql([1, 2, 3, 4]), level_sql([1, 2, 3, 4])) + "SELECT k AS item_id, level, unnest(range(64))::INT AS pos, round(unnest(w)::FLOAT::DOUBLE + 1e-9, 4) AS x FROM xv"
S["vector_enhanced_similarity"] = with_("c AS (SELECT event_id, (props->>'k')::DOUBLE / 100 AS p FROM events)") + f"SELECT event_id, {r6s(boost('p'))} AS enhanced, {r6s(boost('p', 0.5))} AS stronger FROM c"


def standard_sql(condition: str = "true") -> str:
    return with_(
        VEC,
        CENTROID,
        FLAGS,
        f"""sim AS (SELECT query_id, v.id, list_dot_product({unit_sql('c.q')}, {unit_sql('v.v')}) AS raw FROM cen c, vec v WHERE {condition}),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS r FROM sim),
adj AS (SELECT n.query_id, n.id, n.raw, n.r, f.flagged, CASE WHEN flagged THEN raw * 0.7 ELSE {boost('raw')} END AS s
  FROM near n JOIN flag f USING (id) WHERE n.r <= 15 AND raw >= 0.25 AND NOT deleted),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS rank FROM adj) WHERE rank <= 5)""",
    )


S["search_standard"] = standard_sql() + f"SELECT query_id, rank, id AS item_id, {r6s('raw')} AS raw_similarity, {r6s('s')} AS similarity, flagged AS hallucination_warning FROM hits"
S["search_metadata_filter"] = standard_sql() + "SELECT query_id, rank, id AS item_id FROM hits JOIN documents d ON d.doc_id = hits.id WHERE d.lang = 'en'"
S["search_metadata_prefilter"] = standard_sql("v.id IN (SELECT doc_id FROM documents WHERE lang = 'en')") + f"SELECT query_id, rank, id AS item_id, {r6s('s')} AS similarity FROM hits"
S["search_memory_support"] = standard_sql() + f"SELECT query_id, count(*) AS memory_count, {r6s('max(s)')} AS best_similarity, max(s) > 0.3 AS memory_supported FROM hits GROUP BY query_id"

def scored_sql(condition: str = "true") -> str:
    """Hits per level with their scores; hits that fail ``condition`` have taken their slots."""
    return with_(
        VEC,
        CENTROID,
        FLAGS,
        matrix_sql(LEVELS),
        level_sql(LEVELS),
        level_sql(LEVELS, "cen", "query_id", "q", "q"),
        f"""ls AS (SELECT q.k AS query_id, i.k AS id, q.level, list_dot_product(q.w, i.w) AS raw FROM qv q JOIN xv i USING (level)),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY raw DESC, id) AS raw_rank FROM ls),
lb AS (SELECT l.*, f.flagged, f.score, CASE WHEN flagged THEN raw * 0.7 ELSE raw END AS base, 0.25 * power(0.8, level) AS thr
  FROM lr l JOIN flag f USING (id) WHERE raw_rank <= floor(5 * (1 + 0.5 * level)) AND NOT deleted AND {condition}),
scored AS (SELECT *, CASE WHEN flagged THEN base ELSE {boost('base')} END AS enhanced FROM lb WHERE raw > thr AND base > thr)""",
    )


SCORED = scored_sql()
# the fold over levels, one step per level
MERGED = """,
lv AS (SELECT query_id, id, any_value(flagged) AS flagged, 1.0 - any_value(score) AS rel,
  max(CASE WHEN level = 1 THEN base END) AS b1, max(CASE WHEN level = 1 THEN enhanced END) AS e1,
  max(CASE WHEN level = 2 THEN base END) AS b2, max(CASE WHEN level = 2 THEN enhanced END) AS e2,
  max(CASE WHEN level = 3 THEN base END) AS b3, max(CASE WHEN level = 3 THEN enhanced END) AS e3 FROM scored GROUP BY ALL),
f1 AS (SELECT *, CASE WHEN b1 IS NOT NULL THEN 1 END AS level, b1 AS raw, b1 AS orig,
  CASE WHEN flagged THEN e1 ELSE least(1.0, e1 + 0.01) END AS sim FROM lv),
f2 AS (SELECT * REPLACE (CASE WHEN n2 OR up2 THEN 2 ELSE level END AS level, CASE WHEN n2 THEN b2 WHEN up2 THEN greatest(raw, b2) ELSE raw END AS raw,
  CASE WHEN n2 OR up2 THEN b2 ELSE orig END AS orig, CASE WHEN n2 AND flagged THEN e2 WHEN n2 THEN least(1.0, e2 + 0.02) WHEN up2 THEN e2 ELSE sim END AS sim)
  FROM (SELECT *, level IS NULL AND b2 IS NOT NULL AS n2, coalesce(e2 * rel > sim * rel, false) AS up2 FROM f1)),
f3 AS (SELECT * REPLACE (CASE WHEN n3 OR up3 THEN 3 ELSE level END AS level, CASE WHEN n3 THEN b3 WHEN up3 THEN greatest(raw, b3) ELSE raw END AS raw,
  CASE WHEN n3 OR up3 THEN b3 ELSE orig END AS orig, CASE WHEN n3 AND flagged THEN e3 WHEN n3 THEN least(1.0, e3 + 0.03) WHEN up3 THEN e3 ELSE sim END AS sim)
  FROM (SELECT *, level IS NULL AND b3 IS NOT NULL AS n3, coalesce(e3 * rel > sim * rel, false) AS up3 FROM f2)),
merged AS (SELECT query_id, id, level, raw, sim, sim * rel AS rank_score, orig, flagged FROM f3)"""
S["search_level_hits"] = SCORED + f"SELECT query_id, level, raw_rank, id AS item_id, {r6s('base')} AS base, {r6s('enhanced')} AS enhanced FROM scored"
S["search_merged_levels"] = SCORED.rstrip() + MERGED + f"""SELECT query_id, id AS item_id, level, {r6s('raw')} AS raw_similarity, {r6s('sim')} AS similarity, {r6s('rank_score')} AS rank_score,
{r6s('orig')} AS original_similarity, {r6s('sim - orig')} AS enhancement, flagged AS hallucination_warning FROM merged"""
S["search_cross_level_boost"] = SCORED.rstrip() + MERGED + f""",
ag AS (SELECT query_id, id, count(*) AS n, sum(base * (1 + level * 0.2)) / sum(1 + level * 0.2) AS wavg FROM scored GROUP BY ALL)
SELECT m.query_id, m.id AS item_id, n AS found_in_levels, {r6s('CASE WHEN n > 1 THEN least(1.0, sim * (1.0 + (least(0.2, 0.05 * n) + wavg * 0.1) * CASE WHEN sim > 0.7 THEN 1.0 ELSE 0.6 END)) ELSE sim END')} AS similarity
FROM merged m JOIN ag USING (query_id, id)"""


def greedy_sql(k: int) -> str:
    """Greedy choice spelled out pick by pick."""
    steps = [
        f""",
pool AS (SELECT m.*, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, id) AS pos, count(*) OVER (PARTITION BY query_id) AS n,
  list_distinct(regexp_extract_all(lower(d.text), '{W}+')) AS ws FROM merged m JOIN documents d ON d.doc_id = m.id),
g1 AS (SELECT query_id, pos, 1 AS pick FROM pool WHERE pos = 1)"""
    ]
    for i in range(2, k + 1):
        steps.append(
            f"""c{i} AS (SELECT p.query_id, p.pos, p.flagged, min(1.0 - len(list_intersect(p.ws, s.ws))::DOUBLE / nullif(len(p.ws) + len(s.ws) - len(list_intersect(p.ws, s.ws)), 0)) AS gap
  FROM pool p JOIN g{i - 1} g ON g.query_id = p.query_id JOIN pool s ON s.query_id = g.query_id AND s.pos = g.pos
  WHERE p.n > {k} AND NOT EXISTS (SELECT 1 FROM g{i - 1} t WHERE t.query_id = p.query_id AND t.pos = p.pos) GROUP BY ALL),
g{i} AS (SELECT * FROM g{i - 1} UNION ALL SELECT query_id, pos, {i} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY flagged, gap DESC, pos) AS r FROM c{i}) WHERE r = 1)"""
        )
    steps.append(f"chosen AS (SELECT * FROM g{k} UNION ALL SELECT query_id, pos, pos FROM pool WHERE n <= {k} AND pos > 1)")
    return ",\n".join(steps)


S["search_multi_level"] = scored_sql("id IN (SELECT doc_id FROM documents)").rstrip() + MERGED + greedy_sql(5) + f"""
SELECT c.query_id, c.pick::INT AS rank, p.id AS item_id, level, {r6s('raw')} AS raw_similarity, {r6s('sim')} AS similarity, {r6s('rank_score')} AS rank_score, flagged AS hallucination_warning
FROM chosen c JOIN pool p ON p.query_id = c.query_id AND p.pos = c.pos"""
S["search_diversity"] = SCORED.rstrip() + MERGED + greedy_sql(4) + "\nSELECT c.query_id, c.pick::INT AS pick, p.id AS item_id FROM chosen c JOIN pool p ON p.query_id = c.query_id AND p.pos = c.pos"
S["search_text_distance"] = with_(
    rf"""t AS (SELECT d.doc_id, list_distinct(regexp_extract_all(lower(d.text), '{W}+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(b.text, '')), '{W}+')) AS b,
  list_distinct(regexp_extract_all(regexp_replace(lower(d.text), '[\x{{C0}}-\x{{24F}}]', '_', 'g'), '\b[A-Za-z]{{3,}}\b')) AS x,
  list_distinct(regexp_extract_all(regexp_replace(lower(coalesce(b.text, '')), '[\x{{C0}}-\x{{24F}}]', '_', 'g'), '\b[A-Za-z]{{3,}}\b')) AS y
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id),
n AS (SELECT doc_id, len(a) + len(b) - len(list_intersect(a, b)) AS u, len(list_intersect(a, b)) AS i, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS ix FROM t)"""
) + f"""SELECT doc_id, {r6s('CASE WHEN u = 0 THEN 0.0 ELSE 1.0 - i::DOUBLE / u END')} AS distance,
{r6s('CASE WHEN nx > 0 AND ny > 0 THEN ix::DOUBLE / (nx + ny - ix) * 0.8 ELSE 0.0 END')} AS term_similarity FROM n"""
S["search_best_text_similarity"] = with_(
    r"""a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(regexp_replace(lower(text), '[\x{C0}-\x{24F}]', '_', 'g'), '\b[A-Za-z]{3,}\b')) AS x FROM conversations WHERE role = 'assistant'),
m AS (SELECT CASE WHEN coalesce(l.toxic = 1, false) THEN 0.7 ELSE 1.0 END AS w, list_distinct(regexp_extract_all(regexp_replace(lower(text), '[\x{C0}-\x{24F}]', '_', 'g'), '\b[A-Za-z]{3,}\b')) AS y
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT coalesce(l.quality = 0, false)),
p AS (SELECT conv_id, turn, w, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS i FROM a, m WHERE len(x) > 0 AND len(y) > 0),
b AS (SELECT conv_id, turn, max(i::DOUBLE / (nx + ny - i) * w) AS s FROM p GROUP BY ALL)"""
) + f"SELECT a.conv_id, a.turn, {r6s('coalesce(s, 0.0)')} AS text_similarity FROM a LEFT JOIN b USING (conv_id, turn)"
S["search_deduplicated"] = with_(
    r"""k AS (SELECT doc_id, n_chars, regexp_replace(lower(trim(text, ' ' || chr(10))), '[^\p{L}\p{N}_]+', ' ', 'g') AS k FROM documents),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY n_chars, doc_id) AS r FROM k)"""
) + "SELECT doc_id AS item_id FROM r WHERE r = 1"


def _prompt_sql() -> str:
    from mnemora.operators.conversation import PROMPT_HEAD, PROMPT_TAIL
    from mnemora.plans.text_plans import quote

    category = "CASE d.lang WHEN 'en' THEN 'declarative' WHEN 'fr' THEN 'procedural_knowledge' WHEN 'de' THEN 'conceptual_knowledge' ELSE 'experiential' END"
    return standard_sql().rstrip() + f""",
mh AS (SELECT h.query_id, h.s, h.id, {category} AS c, '- [' || printf('%.2f', s) || '] ' || trim(d.text, ' ' || chr(10)) || chr(10) || chr(10) AS line,
  s >= max(s) OVER (PARTITION BY query_id) * 0.99 AS high FROM hits h JOIN documents d ON d.doc_id = h.id),
hi AS (SELECT query_id, count(*) AS n, string_agg(line, '' ORDER BY s DESC, id) AS t FROM mh WHERE high GROUP BY 1),
ca AS (SELECT query_id, c, count(*) AS n, max(s) AS best, chr(10) || 'ADDITIONAL ' || upper(replace(c, '_', ' ')) || ' INFORMATION:' || chr(10) || string_agg(line, '' ORDER BY s DESC, id) AS t FROM mh WHERE NOT high GROUP BY query_id, c),
lo AS (SELECT query_id, sum(n) AS n, string_agg(t, '' ORDER BY best DESC) AS t FROM ca GROUP BY 1),
tx AS (SELECT hi.query_id, hi.n AS n_high, coalesce(lo.n, 0) AS n_rest, {quote(PROMPT_HEAD)} || chr(10) || 'HIGHLY RELEVANT INFORMATION:' || chr(10) || hi.t || coalesce(lo.t, '') || {quote(PROMPT_TAIL)} AS t FROM hi LEFT JOIN lo USING (query_id))
SELECT query_id, n_high, n_rest::BIGINT AS n_rest, md5(t) AS digest, length(t) AS n_chars FROM tx"""


S["search_memory_prompts"] = _prompt_sql()
S["analytics_category_similarity"] = with_(VEC, f"un AS (SELECT id, label, {unit_sql('v')} AS u FROM vec)") + f"""SELECT x.label AS a, y.label AS b, count(*) AS pairs, {r6s('avg(list_dot_product(x.u, y.u))')} AS mean_similarity
FROM un x JOIN un y ON x.label < y.label OR (x.label = y.label AND x.id < y.id) GROUP BY ALL"""
S["analytics_category_colours"] = "SELECT source AS category, row_number() OVER (ORDER BY source) - 1 AS colour FROM (SELECT DISTINCT source FROM documents)"
S["analytics_fingerprints"] = with_(
    VEC,
    matrix_sql(LEVELS),
    level_sql(LEVELS),
    """top AS (SELECT id, label * 10 + 70 AS score FROM vec ORDER BY score DESC, id LIMIT 9),
al AS (SELECT id, 0 AS level, list_transform(v, lambda x: x::FLOAT::DOUBLE)[1:50] AS w FROM vec UNION ALL SELECT k, level, list_transform(w, lambda x: x::FLOAT::DOUBLE)[1:50] FROM xv),
nm AS (SELECT t.id, t.score, a.level, list_transform(a.w, lambda x: x / greatest(list_max(list_transform(a.w, lambda y: abs(y))), 1e-10)) AS w FROM al a JOIN top t USING (id))""",
) + "SELECT id AS item_id, score, level, unnest(range(50))::INT AS pos, round(unnest(w)::DOUBLE + 1e-9, 4) AS x FROM nm"
