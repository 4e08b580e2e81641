"""Conversation, verdict and directive queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import blocks as B
from mnemora.functions import rules
from mnemora.functions.arrays import r6
from mnemora.functions.classify import rule_category
from mnemora.functions.confidence import confidence_pattern
from mnemora.functions.text import tokens
from mnemora.operators import conversation as V
from mnemora.operators import search
from mnemora.operators.series import index_block
from mnemora.plans import inputs
from mnemora.plans import text_plans as TP
from mnemora.plans.search_plans import VEC
from mnemora.plans.text_plans import quote, r6s, with_
from mnemora.sources.tables import table

Q: dict = {}
S: dict[str, str] = {}

KEY, ORDER = ["conv_id"], ["turn"]


def _shifts(spark: SparkSession, folder: str, **options) -> DataFrame:
    talk = inputs.turns_with_vectors(spark, folder).filter("role = 'user'")
    return V.topic_shifts(talk, KEY, ORDER, index_block("turn"), threshold=0.1, **options)


def topic_shifts(spark: SparkSession, folder: str) -> DataFrame:
    return _shifts(spark, folder).select("conv_id", "turn", "is_shift", r6(F.col("similarity")).alias("similarity"))


def topic_shifts_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Exit phrases looked for inside words, as the reference does."""
    return _shifts(spark, folder, literal_exit=True).select("conv_id", "turn", "is_shift", r6(F.col("similarity")).alias("similarity"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    out = V.sessions(_shifts(spark, folder), KEY, ORDER, index_block("turn"))
    return out.select("conv_id", "turn", "session")


def _with_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with three file blocks, two of one name, the last with loose spacing."""
    docs = inputs.documents(spark, folder)
    tail = F.concat(
        F.lit("\n>>> FILE: a_"), "lang", F.lit(".txt\nfirst\n<<<\nmiddle\n\n\n\n>>> FILE: b.txt\nline 1\nline 2\n<<<\n>>>  FILE:  a_"), "lang", F.lit(".txt \nlast\n <<<\nend"),
    )
    return docs.select("doc_id", F.concat("text", tail).alias("text"))


def file_blocks(spark: SparkSession, folder: str) -> DataFrame:
    docs = _with_blocks(spark, folder)
    return docs.select("doc_id", F.explode(B.file_map(F.col("text"))).alias("filename", "content"))


def without_blocks(spark: SparkSession, folder: str) -> DataFrame:
    docs = _with_blocks(spark, folder)
    return docs.select("doc_id", B.without_blocks(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


def command_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = _with_blocks(spark, folder).withColumn("c", B.command_lines(F.col("text")))
    return docs.select("doc_id", F.md5("c.kept").alias("kept"), F.md5(F.array_join("c.commands", "\n")).alias("commands"), F.size("c.commands").alias("n_commands"))


def directives(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.questions(spark, folder)
    text = F.concat("question", F.lit(" @{"), "kind", F.lit(".md} then !{ls "), "kind", F.lit("} "))
    return asked.select("kind", "qid", text.alias("t")).select(
        "kind",
        "qid",
        F.array_join(B.save_directives(F.col("t")), ",").alias("saves"),
        F.array_join(B.shell_directives(F.col("t")), ",").alias("shells"),
        B.without_directives(F.col("t")).alias("cleaned"),
    )


def stop_markers(spark: SparkSession, folder: str) -> DataFrame:
    talk = inputs.turns(spark, folder)
    text = F.concat("text", F.when(F.col("role") == "user", "<|assistant|> x <|user|> y").otherwise("<|user|> z <|assistant|>"))
    return talk.select("conv_id", "turn", F.md5(B.before_stop_marker(text)).alias("digest"))


def token_buffer(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader sees of a token buffer behind a cursor at the turn number."""
    talk = inputs.turns(spark, folder).withColumn("tok", tokens(F.col("text")))
    return talk.select(
        "conv_id",
        "turn",
        F.length(F.array_join("tok", "")).alias("n_text"),
        F.md5(V.unread_text(F.col("tok"), F.col("turn") * 10)).alias("unread"),
        F.contains(F.array_join("tok", ""), F.lit("the")).alias("has_the"),
    )


def generation_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per conversation and per second; a turn number stands for a second."""
    talk = inputs.turns(spark, folder).withColumn("n", F.size(tokens(F.col("text"))))
    return talk.groupBy("conv_id").agg(F.sum("n").alias("tokens"), r6(F.sum("n") / (F.max("turn") + 1)).alias("tokens_per_second"))


def query_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.questions(spark, folder).withColumn("category", rule_category(F.col("question")))
    out = asked.select(
        "kind", "qid",
        V.query_thresholds(F.col("question"), F.col("category")).alias("plain"),
        V.query_thresholds(F.col("question"), V.domain_of(F.col("category"))).alias("mapped"),
        V.sampling_settings(V.domain_of(F.col("category")), F.lit(0.7), F.lit(0.92)).alias("cfg"),
    )
    return out.select(
        "kind", "qid",
        r6(F.col("plain.confidence")).alias("confidence"),
        r6(F.col("plain.entropy")).alias("entropy"),
        r6(F.col("mapped.confidence")).alias("mapped_confidence"),
        r6(F.col("mapped.perplexity")).alias("mapped_perplexity"),
        "cfg.temperature",
        "cfg.top_p",
    )


def _supported(vectors: DataFrame, flags: DataFrame, asked: DataFrame) -> DataFrame:
    """_v, memory_supported: whether memories that are not removed support what is asked with a vector; its own memory does not count."""
    kept = vectors.join(flags.where("not deleted").select("id"), "id", "left_semi")
    hits, _ = search.level_hits(kept, asked, inputs.DIM, 1, [0])
    others = hits.where("item_id <> query_id")
    return search.memory_support(others, "raw").select(F.col("query_id").alias("_v"), "memory_supported")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on all answers. Token i of an answer has the confidence 1 - 1.3 |x| of component i of the turn's vector,
    taken in turn; what supports the answer is searched in the store with that vector."""
    vectors = inputs.embeddings(spark, folder).select("id", "embedding")
    n = max(vectors.count(), 1)
    number = F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(n))
    rows = inputs.answers(spark, folder).withColumn("_v", number)
    # every assistant turn is an answer; their numbers need no look at the turns before
    wanted = inputs.turns(spark, folder).where("role = 'assistant'").select(number.alias("id")).distinct()
    asked = vectors.join(wanted, "id", "left_semi")
    support = _supported(vectors, inputs.item_flags(spark, folder), asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")))
    told = F.transform(
        F.sequence(F.lit(1), F.col("tokens_generated")),
        lambda i: F.lit(1.0) - F.abs(F.get("embedding", (i - 1) % F.size("embedding"))).cast("double") * 1.3,
    )
    rows = rows.join(vectors.select(F.col("id").alias("_v"), "embedding"), "_v", "left").join(support, "_v", "left")
    # what follows is heavy on the processor and light in bytes, so that few partitions would be left after the joins
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(width)
    rows = rows.withColumn("_pattern", confidence_pattern(F.when((F.col("tokens_generated") > 0) & (F.size("embedding") > 0), told)))
    return V.judge_answers(
        rows.select(
            "conv_id", "turn", "text", F.coalesce("query", F.lit("")).alias("query"), "normalized_confidence", "entropy", "perplexity",
            "tokens_generated", F.coalesce("memory_supported", F.lit(False)).alias("memory_supported"),
            F.col("_pattern.pattern_type").alias("pattern_type"), F.col("_pattern.severity").alias("pattern_severity"),
        )
    )


def hallucination(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).groupBy("is_likely_hallucination").agg(F.count("*").alias("n"))


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select("conv_id", "turn", "should_filter", "reason", r6(F.col("uncertainty_score")).alias("uncertainty_score"), "is_likely_hallucination")


def final_answers(spark: SparkSession, folder: str) -> DataFrame:
    judged = _judged(spark, folder)
    query = F.concat("query", F.when(F.col("turn") > 4, F.lit(" go on")).otherwise(F.lit("")))
    commands = B.command_lines(F.col("text"))["commands"]
    out = judged.withColumn("q", query).withColumn(
        "final", V.final_answer(F.col("text"), F.col("reason"), F.col("q"), commands, F.concat_ws(":", "conv_id", "turn"))
    )
    return out.select("conv_id", "turn", F.md5("final").alias("digest"))


def answer_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Keep, disclaim or replace; and whether a stream would have been cut."""
    judged = _judged(spark, folder)
    query = F.concat("query", F.when(F.col("turn") > 4, F.lit(" go on")).otherwise(F.lit("")))
    action = F.when(~F.col("should_filter"), "keep").when(V.asks_to_continue(F.col("q")), "disclaim").otherwise("replace")
    return judged.withColumn("q", query).select(
        "conv_id", "turn", action.alias("action"),
        V.stops_stream(F.col("should_filter"), F.col("reason"), F.col("tokens_generated"), F.col("q")).alias("stops"),
    )


def overrides(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder).select("doc_id", F.concat("text", F.when(F.col("lang") == "fr", " Go ON").otherwise("")).alias("t"))
    return docs.select("doc_id", V.asks_to_continue(F.col("t")).alias("override"))


def context_history(spark: SparkSession, folder: str) -> DataFrame:
    from mnemora.operators.series import declining

    rows = inputs.answers(spark, folder)
    out = V.recent_context(rows, KEY, ORDER, index_block("turn"), ["turn", "tokens_generated"])
    out = declining(out, KEY, ORDER, index_block("turn"), "normalized_confidence")
    return out.select("conv_id", "turn", F.size("history").alias("n_history"), F.array_join(F.transform("history", lambda h: h["tokens_generated"].cast("string")), ",").alias("lengths"), "declining")


def saved_exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as they are stored: flagged ones keep their score and penalty."""
    from mnemora.operators.store import prepare_items

    judged = _judged(spark, folder).select(
        "conv_id", "turn", "text",
        F.col("is_likely_hallucination").alias("hallucination_detected"),
        F.when(F.col("is_likely_hallucination"), F.col("uncertainty_score")).otherwise(0.0).alias("hallucination_score"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    rows = prepare_items(judged, "text", F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")))
    return rows.select("conv_id", "turn", F.md5("content").alias("digest"), "hallucination_detected", r6(F.col("hallucination_score")).alias("hallucination_score"), "reliability_penalty")


def memory_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of each answered turn with a memory note before the last user message."""
    rows = inputs.answers(spark, folder)
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")),
        F.struct(F.lit("user").alias("role"), F.coalesce("query", F.lit("")).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")),
    )
    out = rows.withColumn("m", V.insert_memory(messages, F.concat(F.lit("note "), F.col("conv_id").cast("string"))))
    return out.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: x["role"]), ">").alias("roles"), F.md5(F.get("m", F.lit(1))["content"]).alias("note"))


Q.update(
    talk_topic_shifts=topic_shifts,
    talk_topic_shifts_parity=topic_shifts_parity,
    talk_sessions=sessions,
    talk_file_blocks=file_blocks,
    talk_without_blocks=without_blocks,
    talk_command_lines=command_lines,
    talk_directives=directives,
    talk_stop_markers=stop_markers,
    talk_token_buffer=token_buffer,
    talk_generation_stats=generation_stats,
    talk_query_thresholds=query_thresholds,
    talk_hallucination=hallucination,
    talk_verdicts=verdicts,
    talk_final_answers=final_answers,
    talk_answer_actions=answer_actions,
    talk_overrides=overrides,
    talk_context_history=context_history,
    talk_saved_exchanges=saved_exchanges,
    talk_memory_messages=memory_messages,
)

_go = " OR ".join(f"contains(lower(text), {quote(p)})" for p in rules.CONTINUATION_PHRASES)


def shifts_sql(leave: str) -> str:
    pairs = [f"list_dot_product(a.v, lag(a.v, {i}) OVER o) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(lag(a.v, {i}) OVER o, lag(a.v, {i}) OVER o))" for i in (1, 2, 3)]
    return with_(
        VEC,
        "nv AS (SELECT count(*) AS n FROM vec)",
        f"usr AS (SELECT conv_id, turn, v, ({_go} OR {leave}) OR v IS NULL AS skip FROM conversations c CROSS JOIN nv LEFT JOIN vec ON vec.id = (c.conv_id * 8 + c.turn) % nv.n WHERE role = 'user')",
        f"""jd AS (SELECT conv_id, turn, row_number() OVER o AS r, greatest(0.0, {', '.join(pairs)}) AS best FROM usr a WHERE NOT skip WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
sh AS (SELECT conv_id, turn, CASE WHEN r = 1 THEN 1.0 ELSE best END AS sim, r > 1 AND best < 0.1 AS is_shift FROM jd UNION ALL SELECT conv_id, turn, 1.0, false FROM usr WHERE skip)""",
    )


_whole = "trim(lower(text)) IN ('exit', 'q')"
S["talk_topic_shifts"] = shifts_sql(_whole) + f"SELECT conv_id, turn, is_shift, {r6s('sim')} AS similarity FROM sh"
S["talk_topic_shifts_parity"] = shifts_sql("contains(lower(text), 'exit') OR contains(lower(text), 'q')") + f"SELECT conv_id, turn, is_shift, {r6s('sim')} AS similarity FROM sh"
S["talk_sessions"] = shifts_sql(_whole) + "SELECT conv_id, turn, sum(is_shift::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS session FROM sh"
BLOCKS = """src AS (SELECT doc_id, text AS head, lang, text || chr(10) || '>>> FILE: a_' || lang || '.txt' || chr(10) || 'first' || chr(10) || '<<<' || chr(10) || 'middle' || chr(10) || chr(10) || chr(10) || chr(10)
 || '>>> FILE: b.txt' || chr(10) || 'line 1' || chr(10) || 'line 2' || chr(10) || '<<<' || chr(10) || '>>>  FILE:  a_' || lang || '.txt ' || chr(10) || 'last' || chr(10) || ' <<<' || chr(10) || 'end' AS text FROM documents)"""
S["talk_file_blocks"] = with_(BLOCKS) + "SELECT doc_id, 'a_' || lang || '.txt' AS filename, 'last' AS content FROM src UNION ALL SELECT doc_id, 'b.txt', 'line 1' || chr(10) || 'line 2' FROM src"
S["talk_without_blocks"] = with_(
    BLOCKS,
    r"""cut AS (SELECT doc_id, replace(replace(text, '>>> FILE: a_' || lang || '.txt' || chr(10) || 'first' || chr(10) || '<<<', ''), '>>> FILE: b.txt' || chr(10) || 'line 1' || chr(10) || 'line 2' || chr(10) || '<<<', '') AS t FROM src),
fin AS (SELECT doc_id, trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM cut)""",
) + "SELECT doc_id, length(t) AS n, md5(t) AS digest FROM fin"
S["talk_command_lines"] = with_(
    BLOCKS,
    """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM src),
mk AS (SELECT *, CASE WHEN contains(s, '>>>') AND contains(s, 'FILE:') THEN 1 WHEN contains(s, '<<<') THEN -1 END AS m FROM ln),
st AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS now FROM mk),
fl AS (SELECT *, now = 1 OR (m = -1 AND coalesce(lag(now) OVER (PARTITION BY doc_id ORDER BY i), 0) = 1) AS inside FROM st)""",
) + """SELECT doc_id, md5(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(inside, false)), '')) AS kept,
md5(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE coalesce(inside, false)), '')) AS commands, count(*) FILTER (WHERE coalesce(inside, false))::INT AS n_commands FROM fl GROUP BY doc_id"""
from mnemora.plans.classify_plans import ASK, ASKED  # noqa: E402

S["talk_directives"] = with_(ASK) + f"SELECT kind, qid, kind || '.md' AS saves, 'ls ' || kind AS shells, question || '  then {rules.SHELL_DISABLED}' AS cleaned FROM ask"
S["talk_stop_markers"] = "SELECT conv_id, turn, md5(text) AS digest FROM conversations"
S["talk_token_buffer"] = with_(r"b AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS l FROM conversations)") + """SELECT conv_id, turn, length(array_to_string(l, '')) AS n_text,
md5(CASE WHEN turn * 10 >= len(l) THEN '' ELSE array_to_string(l[turn * 10 + 1:], '') END) AS unread, contains(array_to_string(l, ''), 'the') AS has_the FROM b"""
S["talk_generation_stats"] = with_(r"b AS (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM conversations)") + f"SELECT conv_id, sum(n)::BIGINT AS tokens, {r6s('sum(n)::DOUBLE / (max(turn) + 1)')} AS tokens_per_second FROM b GROUP BY conv_id"
_map = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.LABEL_TO_DOMAIN.items())
_nudge = {n: " + ".join(f"CASE WHEN regexp_matches(question, {quote('(?i)' + p)}) THEN {a} ELSE 0 END" for p, k, a in rules.QUERY_NUDGES if k == n) for n in ("confidence", "entropy")}


def _thr(i: int, dom: str) -> str:
    return "CASE " + dom + " " + " ".join(f"WHEN '{d}' THEN {v[i]}" for d, v in rules.DOMAIN_THRESHOLDS.items()) + f" ELSE {rules.BASE_THRESHOLDS[i]} END"


def _cap(i: int, given: float) -> str:
    return "(CASE dom " + " ".join(f"WHEN '{d}' THEN least({given}, {v[i]})" for d, v in rules.DOMAIN_SAMPLING.items()) + f" ELSE {given} END)::DOUBLE"


S["talk_query_thresholds"] = with_(ASKED, f"m AS (SELECT *, CASE category {_map} ELSE category END AS dom FROM asked)") + f"""SELECT kind, qid, {r6s(_thr(0, 'category') + ' + ' + _nudge['confidence'])} AS confidence, {r6s(_thr(1, 'category') + ' + ' + _nudge['entropy'])} AS entropy,
{r6s(_thr(0, 'dom') + ' + ' + _nudge['confidence'])} AS mapped_confidence, {r6s(_thr(2, 'dom'))} AS mapped_perplexity, {_cap(0, 0.7)} AS temperature, {_cap(1, 0.92)} AS top_p FROM m"""

ANSWERED = """turned AS (SELECT *, lag(role) OVER o AS pr, lag(text) OVER o AS pt FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
asst AS (SELECT conv_id, turn, text, CASE WHEN pr = 'user' THEN pt ELSE '' END AS query, conv_id * 1000 + turn AS id FROM turned WHERE role = 'assistant'),
docs AS (SELECT id, text FROM asst)"""
JUDGED = f"""conf AS (SELECT a.*, len(t.l) AS tokens, len(list_distinct(t.l))::DOUBLE / greatest(1, len(t.l)) AS c FROM asst a JOIN tl t USING (id)),
norm AS (SELECT *, exp(avg(ln(greatest(c, 0.01))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS g FROM conf),
met AS (SELECT n.*, coalesce(e.entropy, 0.0) AS h, power(2.0, coalesce(e.entropy, 0.0)) AS p FROM norm n LEFT JOIN entropy e USING (id)),
shp AS (SELECT *, CASE WHEN g > 0.5 THEN least(1.0, g + (g - 0.5) * 0.45) ELSE greatest(0.1, g - (0.5 - g) * 0.45) END AS sc,
  CASE WHEN h < 1 THEN greatest(0.0, h - h * 0.12) ELSE h + (h - 1) * 0.12 END AS sh, CASE WHEN p < 5 THEN greatest(1.0, p - p * 0.09) ELSE p + (p - 5) * 0.09 END AS sp,
  0.45 + {_nudge['confidence'].replace('question', 'query')} AS tc, 3.5 + {_nudge['entropy'].replace('question', 'query')} AS th FROM met),
cmp AS (SELECT s.*, k.entropy AS sem, k.severity, k.repetition_score AS rep, q.is_low_quality, q.quality_issue_names, q.quality_score, o.p AS ov, greatest(0.0, least(1.0, k.entropy / 1.16 * 0.2)) AS semc
  FROM shp s JOIN content k USING (id) JOIN judged q USING (id) JOIN over o USING (id)),
token_conf AS (SELECT m.id, CASE WHEN v.v IS NULL THEN NULL ELSE list_transform(range(1, m.tokens + 1), lambda i: 1 - 1.3 * abs(v.v[((i - 1) % len(v.v)) + 1])) END AS c
  FROM (SELECT met.*, (conv_id * 8 + turn) % nv.n AS vi FROM met CROSS JOIN nv) m LEFT JOIN vec v ON v.id = m.vi),
token_mean AS (SELECT id, c, len(c) AS n, list_avg(c) AS m, len(c) // 3 AS t FROM token_conf WHERE len(c) >= 10),
token_marks AS (SELECT id, n, m, list_max(list_transform(range(2, n + 1), lambda i: CASE WHEN c[i - 1] - c[i] > 0.3 AND c[i] < m * 0.7 THEN c[i - 1] - c[i] END)) AS d,
  list_sum(c[1:t]) / t AS f, list_sum(c[n - t + 1:n]) / t AS l, greatest(SIM3, SIM4, SIM5) AS sim FROM token_mean),
token_pattern AS (SELECT id, d, CASE WHEN n > 20 AND f - l > 0.2 AND l < m * 0.8 THEN f - l END AS g, CASE WHEN n > 15 AND sim > 0.85 THEN sim - 0.85 END AS r FROM token_marks),
unit_vec AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec),
held_vec AS (SELECT unit_vec.* FROM unit_vec LEFT JOIN labels ON doc_id = id WHERE NOT coalesce(quality = 0, false)),
supports AS (SELECT q, max(list_dot_product(a.u, b.u)) > 0.3 AS supported FROM (SELECT DISTINCT (conv_id * 8 + turn) % nv.n AS q FROM met CROSS JOIN nv) JOIN unit_vec a ON a.id = q JOIN held_vec b ON b.id <> q GROUP BY q),
cmp_known AS (SELECT c.*, greatest(coalesce(tp.d, 0), coalesce(tp.g, 0), coalesce(tp.r, 0)) AS psev, coalesce(supported, false) AS supported,
  CASE WHEN tp.r IS NOT NULL THEN 'repetition' WHEN tp.g IS NOT NULL THEN 'degradation' WHEN tp.d IS NOT NULL THEN 'sudden_drop' END AS ptype
  FROM cmp c CROSS JOIN nv LEFT JOIN token_pattern tp USING (id) LEFT JOIN supports ON q = (conv_id * 8 + turn) % nv.n),
sco AS (SELECT *, sem > 1.65 OR semc > 0.28 OR severity > 0.05 OR (sem > 1.5 AND rep > 0.1) AS hall,
  greatest(0.0, least(1.0, greatest(0.0, least(1.0, (1 - sc) * 0.35)) + greatest(0.0, least(1.0, (1 - quality_score) * 0.25)) + greatest(0.0, least(1.0, sh / th * 0.15))
    + greatest(0.0, least(1.0, sp / 25.0 * 0.15)) + semc + greatest(0.0, least(1.0, psev * 0.6)) + CASE WHEN supported THEN -0.1 ELSE 0 END)) AS score FROM cmp_known),
ver AS (SELECT *, CASE WHEN sem > 2.0 OR hall THEN 'high_semantic_uncertainty'
  WHEN len(ov) > 0 THEN 'context_overflow_[' || array_to_string(list_transform(ov, lambda x: '''' || x || ''''), ', ') || ']'
  WHEN tokens < 60 THEN 'acceptable' WHEN ptype IS NOT NULL AND psev > 0.3 THEN 'pattern_detected_' || ptype WHEN is_low_quality AND quality_score < 0.4 THEN 'low_quality_' || quality_issue_names
  WHEN sc < tc * 0.7 THEN 'very_low_confidence' WHEN sh > th * 1.4 THEN 'extremely_high_entropy' WHEN sp > 25.0 * 1.5 THEN 'extremely_high_perplexity'
  WHEN score > 0.7 THEN 'high_uncertainty' ELSE 'acceptable' END AS reason FROM sco)"""


def _similar(n: int) -> str:
    gaps = " + ".join(f"abs(c[i + {j}] - c[i + {n + j}])" for j in range(n))
    return f"list_max(list_transform(range(1, n - {2 * n} + 1), lambda i: 1 - ({gaps}) / {n}))"


for _n in (3, 4, 5):
    JUDGED = JUDGED.replace(f"SIM{_n}", _similar(_n))
VERDICT = with_(VEC, "nv AS (SELECT count(*) AS n FROM vec)", ANSWERED, TP.FULL_CONTENT, TP.FULL_QUALITY, TP.PHRASES, TP.OVERFLOW, JUDGED)
S["talk_hallucination"] = VERDICT + "SELECT hall AS is_likely_hallucination, count(*) AS n FROM ver GROUP BY 1"
S["talk_verdicts"] = VERDICT + f"SELECT conv_id, turn, reason <> 'acceptable' AS should_filter, reason, {r6s('score')} AS uncertainty_score, hall AS is_likely_hallucination FROM ver"
_goes = _go.replace("text", "query") + " OR turn > 4"
S["talk_answer_actions"] = VERDICT + f"""SELECT conv_id, turn, CASE WHEN reason = 'acceptable' THEN 'keep' WHEN {_goes} THEN 'disclaim' ELSE 'replace' END AS action,
CASE WHEN tokens > 30 AND starts_with(reason, 'context_overflow') THEN true WHEN tokens < 60 THEN false WHEN reason = 'acceptable' THEN false ELSE NOT ({_goes}) END AS stops FROM ver"""
S["talk_overrides"] = with_("d AS (SELECT doc_id, text || CASE WHEN lang = 'fr' THEN ' Go ON' ELSE '' END AS text FROM documents)") + f"SELECT doc_id, {_go} AS override FROM d"
S["talk_context_history"] = with_(ANSWERED, TP.TOK, TP.ENTROPY, JUDGED.split("met AS")[0].rstrip().rstrip(",")) + """SELECT conv_id, turn, count(*) OVER p AS n_history, array_to_string(list_transform(list(tokens) OVER p, lambda x: x::VARCHAR), ',') AS lengths,
coalesce(lag(g, 2) OVER o > lag(g) OVER o AND lag(g) OVER o > g, false) AS declining FROM norm
WINDOW o AS (PARTITION BY conv_id ORDER BY turn), p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
from mnemora.plans.classify_plans import _closed, _form, _low, category_sql  # noqa: E402

S["talk_saved_exchanges"] = VERDICT.rstrip() + f""",
bs AS (SELECT conv_id, turn, hall, score, trim(text, ' ' || chr(10)) AS bare, {category_sql(_low)} AS category FROM ver), cf AS (SELECT *, {_closed} AS f FROM bs)
SELECT conv_id, turn, md5({_form}) AS digest, hall AS hallucination_detected, {r6s('CASE WHEN hall THEN score ELSE 0 END')} AS hallucination_score, 0.7::DOUBLE AS reliability_penalty FROM cf"""
S["talk_memory_messages"] = with_(ANSWERED) + f"SELECT conv_id, turn, 'system>memory>user>assistant' AS roles, md5({quote(V.PROMPT_NOTE)} || 'note ' || conv_id) AS note FROM asst"
