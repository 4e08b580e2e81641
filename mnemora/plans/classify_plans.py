"""Classification and enrichment queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import classify as C
from mnemora.functions import rules
from mnemora.functions.arrays import r6
from mnemora.functions.terms import term_hits
from mnemora.plans import inputs
from mnemora.plans.text_plans import ascii_words, quote, r6s, with_
from mnemora.sources.text_lines import explode_lines

Q: dict = {}
S: dict[str, str] = {}


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.questions(spark, folder)
    return asked.withColumn("category", C.rule_category(F.col("question")))


def question_categories(spark: SparkSession, folder: str) -> DataFrame:
    out = _classified(spark, folder)
    return out.select("kind", "qid", "category", C.rule_confidence(F.col("category")).alias("confidence"))


def subcategories(spark: SparkSession, folder: str) -> DataFrame:
    out = _classified(spark, folder).filter(F.col("category").isNotNull())
    out = out.withColumn("s", C.subcategory(F.col("question"), F.col("category")))
    return out.select("kind", "qid", F.col("s.name").alias("subcategory"), r6(F.col("s.score")).alias("score"))


def taxonomy_terms(spark: SparkSession, folder: str) -> DataFrame:
    """How many questions mention each subcategory's terms; the taxonomy has a fixed 70 rows."""
    rows = C.taxonomy()
    words = C.taxonomy_words(rows)
    number = {w: i for i, w in enumerate(words)}
    asked = inputs.questions(spark, folder).select(term_hits(F.lower("question"), words).alias("hits"))
    names = [F.count_if(F.arrays_overlap("hits", F.array(*[F.lit(number[w]) for w in terms]))).alias(name) for _, name, terms in rows]
    wide = asked.agg(*names)
    return wide.unpivot([], wide.columns, "subcategory", "n_questions")


def domain_settings(spark: SparkSession, folder: str) -> DataFrame:
    out = _classified(spark, folder)
    out = out.withColumn("s", C.category_settings(F.col("category"), F.when(F.col("category").isNotNull(), 0.95).otherwise(0.2)))
    return out.select("kind", "qid", "s.*")


def content_categories(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder).select("doc_id", F.concat("text", F.lit(" book "), "source").alias("text"))
    return docs.select("doc_id", C.content_category(F.col("text")).alias("category"))


def memory_metadata(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    out = C.enrich(docs.select("doc_id", "text"), "text", F.timestamp_seconds(F.col("doc_id") * 7 + 1700000000))
    return out.select(
        "doc_id", "id", "main_category", "type", "content_length", "content_hash", F.array_join("topics", "|").alias("topics")
    )


def topics(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    text = F.concat("text", F.lit(" Python and music meet quantum mechanics. python"))
    return docs.select("doc_id", F.array_join(C.topics(text), "|").alias("topics"))


def storage_forms(spark: SparkSession, folder: str) -> DataFrame:
    out = _classified(spark, folder)
    return out.select("kind", "qid", C.storage_form(F.col("question"), F.col("category")).alias("content"))


def key_statements(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    text = F.concat("text", F.lit("\nToday is a fine date. The first step "), "lang", F.lit(" is here. What is it?"))
    return docs.select("doc_id", F.posexplode(C.key_statements(text)).alias("rank", "statement"))


def brief_statements(spark: SparkSession, folder: str) -> DataFrame:
    talk = inputs.turns(spark, folder)
    text = F.concat(F.lit("Today it is a day of "), "role", F.lit(". "), "text")
    return talk.select("conv_id", "turn", F.posexplode(C.brief_statements(text)).alias("rank", "statement"))


def worthy_content(spark: SparkSession, folder: str) -> DataFrame:
    answers = inputs.answers(spark, folder)
    query = F.coalesce("query", F.lit(""))
    return answers.select("conv_id", "turn", F.posexplode(C.worthy_content(query, F.col("text"))).alias("rank", "w")).select(
        "conv_id", "turn", "rank", "w.content", "w.kind"
    )


def question_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Facts about parts and nations turned into question-answer texts."""
    from mnemora.sources.tables import spread, table

    part = spread(table(spark, folder, "part"))
    facts = part.select(
        F.col("p_partkey").alias("key"),
        F.explode(
            F.array(
                F.concat("p_name", F.lit(" is located in "), "p_brand", F.lit(".")),
                F.concat("p_brand", F.lit(" has "), F.col("p_size").cast("string"), F.lit(" units of "), "p_type"),
                F.concat("p_brand", F.lit(" invented the "), "p_name", F.lit(".")),
                F.concat(F.lit("Plain "), "p_name"),
            )
        ).alias("fact"),
    )
    forms = C.with_generic_form(C.question_forms(F.col("fact")), F.col("fact"))
    return facts.select("key", F.explode(forms).alias("form"))


def command_memories(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties read as command output; the event type is the command."""
    from mnemora.sources.tables import table

    events = table(spark, folder, "events")
    command = F.concat(
        F.when(F.col("event_type") == "view", "ls ").when(F.col("event_type") == "signup", "show date ").otherwise("run "),
        F.col("event_type"),
    )
    rows = events.select("event_id", command.alias("command"), "props")
    return rows.select(
        "event_id",
        C.command_route(F.col("command")).alias("route"),
        F.explode(C.command_memories(F.col("command"), F.col("props"))).alias("content"),
    )


def content_kinds(spark: SparkSession, folder: str) -> DataFrame:
    from mnemora.sources.tables import table

    pages = table(spark, folder, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("key"), F.col("html").alias("text"))
    props = table(spark, folder, "events").select(F.lit("props").alias("source"), F.col("event_id").alias("key"), F.col("props").alias("text"))
    docs = inputs.documents(spark, folder).select(F.lit("doc").alias("source"), F.col("doc_id").alias("key"), "text")
    rows = pages.unionByName(props).unionByName(docs)
    return rows.groupBy("source", C.content_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def table_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    out = docs.select("doc_id", C.table_text(F.col("text")).alias("t"))
    return out.select("doc_id", F.md5("t").alias("digest"))


def imported_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document as a fact, classified and typed."""
    lines = explode_lines(inputs.documents(spark, folder), "text", "doc_id")
    category = C.content_category(F.col("line"))
    return lines.select(
        "doc_id", "line_no", F.md5("line").alias("digest"), C.length_class(F.col("line")).alias("content_length"), category.alias("category")
    )


Q.update(
    classify_questions=question_categories,
    classify_subcategories=subcategories,
    classify_taxonomy_terms=taxonomy_terms,
    classify_domain_settings=domain_settings,
    classify_content=content_categories,
    classify_memory_metadata=memory_metadata,
    classify_topics=topics,
    classify_storage_forms=storage_forms,
    classify_key_statements=key_statements,
    classify_brief_statements=brief_statements,
    classify_worthy_content=worthy_content,
    classify_question_forms=question_forms,
    classify_command_memories=command_memories,
    classify_content_kinds=content_kinds,
    classify_table_texts=table_texts,
    source_imported_lines=imported_lines,
)

ASK = """ask AS (SELECT 'part' AS kind, p_partkey AS qid, 'what is ' || p_name AS question FROM part
UNION ALL SELECT 'event', event_id, 'how to fix ' || event_type FROM events
UNION ALL SELECT 'nation', n_nationkey, 'the scientific theory of ' || n_name FROM nation
UNION ALL SELECT 'order', o_orderkey, 'calculate the market price of ' || o_orderpriority FROM orders)"""


def cases(column: str, table: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {quote(p)}) THEN {quote(c)}" for c, p in table) + " END"


ASKED = f"{ASK},\nasked AS (SELECT *, {cases('lower(question)', rules.CATEGORY_RULES)} AS category FROM ask)"
_tax = C.taxonomy()
_position = {c: 0 for c in rules.SUBCATEGORIES}
_rows = []
for _c, _n, _t in _tax:
    _rows.append(f"({quote(_c)}, {quote(_n)}, {_position[_c]}, [{', '.join(map(quote, _t))}])")
    _position[_c] += 1
TAXONOMY = "tax AS (SELECT * FROM (VALUES " + ", ".join(_rows) + ") t(category, sub, pos, terms))"

S["classify_questions"] = with_(ASKED) + "SELECT kind, qid, category, CASE WHEN category IS NOT NULL THEN 0.95::DOUBLE END AS confidence FROM asked"
S["classify_subcategories"] = with_(
    ASKED,
    TAXONOMY,
    """sc AS (SELECT a.kind, a.qid, t.sub, t.pos, CASE WHEN contains(lower(question), replace(sub, '_', ' ')) THEN 0.7 ELSE 0.0 END
  + CASE WHEN len(list_filter(terms, lambda x: contains(lower(question), x))) > 0 THEN 0.3 ELSE 0.0 END AS score,
  len(list_filter(string_split(sub, '_'), lambda x: contains(lower(question), x)))::DOUBLE / len(string_split(sub, '_')) AS overlap
  FROM asked a JOIN tax t USING (category)),
bs AS (SELECT kind, qid, max(score) AS score, arg_min(sub, (-score, pos)) AS sub, max(overlap) AS overlap, arg_min(sub, (-overlap, pos)) AS osub FROM sc GROUP BY ALL)""",
) + f"""SELECT kind, qid, CASE WHEN score >= 0.3 THEN sub WHEN overlap > score THEN osub END AS subcategory,
{r6s('CASE WHEN score >= 0.3 THEN score WHEN overlap > score THEN overlap ELSE 0 END')} AS score FROM bs"""
S["classify_taxonomy_terms"] = with_(ASK, TAXONOMY, "low AS (SELECT lower(question) AS q, count(*) AS n FROM ask GROUP BY 1)") + """SELECT sub AS subcategory,
coalesce(sum(n) FILTER (WHERE len(list_filter(terms, lambda x: contains(q, x))) > 0), 0)::BIGINT AS n_questions FROM tax, low GROUP BY sub"""
_set = {"memory_weight": 0, "sharpening_factor": 1, "confidence_threshold": 2, "retrieval_count": 3}


def _setting(i: int) -> str:
    whens = " ".join(f"WHEN category = {quote(c)} THEN {v[i]}" for c, v in rules.CATEGORY_SETTINGS.items())
    return f"(CASE WHEN category IS NULL THEN {rules.UNSURE_SETTINGS[i]} {whens} END)::{'INT' if i == 3 else 'DOUBLE'}"


S["classify_domain_settings"] = with_(ASKED) + "SELECT kind, qid, " + ", ".join(f"{_setting(i)} AS {n}" for n, i in _set.items()) + " FROM asked"
_low = "lower(" + ascii_words("text") + ")"


def category_sql(low: str) -> str:
    return f"coalesce({cases(low, rules.CATEGORY_RULES)}, {cases(low, rules.CONTENT_RULES)}, 'unknown')"


S["classify_content"] = with_("d AS (SELECT doc_id, text || ' book ' || source AS text FROM documents)") + f"SELECT doc_id, {category_sql(_low)} AS category FROM d"


def topics_sql(text: str) -> str:
    noun = f"list_transform(list_filter(regexp_extract_all({ascii_words(text)}, {quote(rules.NOUN_PHRASE)}, 1), lambda m: length(m) BETWEEN 4 AND 30), lambda m: lower(m))"
    steps, name = [f"t0 AS (SELECT *, {noun} AS tp FROM src)"], "t0"
    for i, p in enumerate(rules.DOMAIN_TERMS, 1):
        steps.append(
            f"t{i} AS (SELECT * EXCLUDE (tp), list_concat(tp, list_filter(regexp_extract_all(lower({ascii_words(text)}), {quote(p)}, 1), lambda m: NOT list_contains(tp, m))) AS tp FROM {name})"
        )
        name = f"t{i}"
    return ",\n".join(steps)


S["classify_topics"] = with_(
    "src AS (SELECT doc_id, text || ' Python and music meet quantum mechanics. python' AS text FROM documents)", topics_sql("text")
) + "SELECT doc_id, array_to_string(tp[1:5], '|') AS topics FROM t5"
_closed = r"CASE WHEN bare <> '' AND NOT regexp_matches(bare, '[.!?]$') THEN bare || '.' ELSE bare END"
_form = "CASE " + " ".join(
    f"WHEN category = {quote(c)} {f'AND length(f) < {n}' if n else ''} AND NOT regexp_matches(lower({ascii_words('f')}), {quote(p)}) THEN {quote(lead)} || f"
    for c, n, p, lead in rules.STORAGE_FORMS
) + " ELSE f END"
S["classify_storage_forms"] = with_(ASKED, f"f AS (SELECT kind, qid, category, {_closed} AS f FROM (SELECT *, trim(question) AS bare FROM asked))") + f"SELECT kind, qid, {_form} AS content FROM f"
_types = " ".join(f"WHEN {quote(c)} THEN {quote(t)}" for c, t in rules.CATEGORY_TYPES.items())
S["classify_memory_metadata"] = with_(
    f"""base AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS bare, {category_sql(_low)} AS category, (doc_id * 7 + 1700000000) * 1000 AS ms FROM documents),
cl AS (SELECT *, {_closed} AS f FROM base), src AS (SELECT *, {_form} AS content FROM cl)""",
    topics_sql("content"),
) + f"""SELECT doc_id, 'item_' || md5(content)[1:8] || '_' || right(ms::VARCHAR, 6) AS id, category AS main_category,
CASE category {_types} ELSE 'unknown' END AS type, CASE WHEN length(content) < 100 THEN 'short' WHEN length(content) < 500 THEN 'medium' ELSE 'long' END AS content_length,
md5(content)[1:10] AS content_hash, array_to_string(tp[1:5], '|') AS topics FROM t5"""

_parts = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_factual = "regexp_matches(a, '^[A-Z].*?(?:is|are|was|were|has|have)\\b')"
S["classify_key_statements"] = with_(
    rf"""src AS (SELECT doc_id, text || chr(10) || 'Today is a fine date. The first step ' || lang || ' is here. What is it?' AS text FROM documents),
pt AS (SELECT doc_id, trim(unnest({_parts}), ' ' || chr(10)) AS s, unnest(range(len({_parts}))) AS i FROM src),
ps AS (SELECT doc_id, s, min(i) AS i, {ascii_words('s')} AS a FROM pt GROUP BY doc_id, s),
ok AS (SELECT doc_id, s, i FROM ps WHERE length(s) >= 15 AND NOT ends_with(s, '?') AND (
  ({_factual} AND (contains(s, ' is ') OR contains(s, ' are ') OR contains(s, ' was ') OR contains(s, ' have ')))
  OR regexp_matches(a, '(?i)\b(?:first|then|next|finally|step|process)\b')
  OR regexp_matches(a, '(?i)\b(?:concept|theory|principle|means|refers to)\b')
  OR (regexp_matches(lower(a), '\b(?:today|current date|the date|time is)\b') AND regexp_matches(lower(a), '\b(?:is|was)\b')))),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, i) - 1 AS rank FROM ok)"""
) + "SELECT doc_id, rank, s AS statement FROM rk WHERE rank < 5"
S["classify_brief_statements"] = with_(
    rf"""src AS (SELECT conv_id, turn, 'Today it is a day of ' || role || '. ' || text AS text FROM conversations),
pt AS (SELECT conv_id, turn, trim(unnest({_parts}), ' ' || chr(10)) AS s, unnest(range(len({_parts}))) AS i FROM src),
ps AS (SELECT *, {ascii_words('s')} AS a FROM pt WHERE length(s) >= 10),
ok AS (SELECT conv_id, turn, s, i, 0 AS j FROM ps WHERE {_factual} AND (contains(s, ' is ') OR contains(s, ' are ') OR contains(s, ' was '))
  UNION ALL SELECT conv_id, turn, s, i, 1 FROM ps WHERE regexp_matches(lower(a), '\b(?:today|current date|the date)\b') AND regexp_matches(lower(a), '\b(?:is|was)\b')),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j) - 1 AS rank FROM ok)"""
) + "SELECT conv_id, turn, rank, s AS statement FROM rk WHERE rank < 3"
S["classify_question_forms"] = """SELECT p_partkey AS key, unnest(['Q: What is ' || p_name || '?' || chr(10) || 'A: ' || p_name || ' is located in ' || p_brand || '.',
'Q: Where is ' || p_name || '?' || chr(10) || 'A: ' || p_name || ' is located in ' || p_brand || '.',
'Q: How many units of ' || p_type || ' does ' || p_brand || ' have?' || chr(10) || 'A: ' || p_brand || ' has ' || p_size || ' units of ' || p_type || '.',
'Q: Who invented the ' || p_name || '?' || chr(10) || 'A: ' || p_brand || ' invented the ' || p_name || '.',
'Q: What did ' || p_brand || ' invent?' || chr(10) || 'A: ' || p_brand || ' invented the ' || p_name || '.',
'Q: Tell me about Plain?' || chr(10) || 'A: Plain ' || p_name || '.']) AS form FROM part"""
S["classify_command_memories"] = with_(
    """cmd AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'ls ' WHEN 'signup' THEN 'show date ' ELSE 'run ' END || event_type AS c, trim(props) AS o FROM events),
rt AS (SELECT *, CASE WHEN regexp_matches(c, '(?i)date|time') THEN 'temporal' WHEN regexp_matches(c, '(?i)ls|dir') THEN 'file_system' ELSE 'generic' END AS route FROM cmd)"""
) + """SELECT event_id, route, unnest(CASE route WHEN 'temporal' THEN ['Today''s date is ' || o || '.', 'The current date is ' || o || '.', 'Today is ' || o || '.', 'Right now it is ' || o || '.']
WHEN 'file_system' THEN ['The output of command ''' || c || ''' shows these files: ' || o] ELSE ['The output of command ''' || c || ''' is: ' || o] END) AS content FROM rt"""
_code = " OR ".join(f"contains(text, {quote(c)})" for c in rules.CODE_SIGNS)
_fs = " OR ".join(f"contains(text, {quote(c)})" for c in rules.FILESYSTEM_SIGNS)
S["classify_content_kinds"] = with_(
    """src AS (SELECT 'page' AS source, html AS text FROM pages UNION ALL SELECT 'props', props FROM events UNION ALL SELECT 'doc', text FROM documents)"""
) + rf"""SELECT source, CASE WHEN contains(text, chr(9)) OR regexp_matches(text, '\S\s{{2,}}\S') THEN 'tabular' WHEN {_fs} THEN 'filesystem'
WHEN starts_with(trim(text), '{{') AND ends_with(trim(text), '}}') THEN 'json' WHEN {_code} THEN 'code' ELSE 'text' END AS kind, count(*) AS n FROM src GROUP BY ALL"""
S["classify_table_texts"] = with_(
    """src AS (SELECT doc_id, text, string_split(trim(text, ' ' || chr(10)), chr(10)) AS l FROM documents),
rw AS (SELECT doc_id, unnest(l) AS r, unnest(range(len(l))) AS i FROM src),
jn AS (SELECT doc_id, string_agg('Row ' || i || ': ' || r || chr(10), '' ORDER BY i) FILTER (WHERE i > 0) AS b FROM rw GROUP BY doc_id),
fin AS (SELECT s.doc_id, CASE WHEN len(l) < 2 THEN text ELSE 'TABLE DATA:' || chr(10) || 'Headers: ' || l[1] || chr(10) || 'Data rows:' || chr(10) || b || chr(10)
 || 'When answering questions about this table, refer to specific columns by name and rows by number.' || chr(10) END AS t FROM src s JOIN jn USING (doc_id))"""
) + "SELECT doc_id, md5(t) AS digest FROM fin"
S["source_imported_lines"] = with_(
    """ln AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"""
) + f"""SELECT doc_id, line_no, md5(text) AS digest, CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 500 THEN 'medium' ELSE 'long' END AS content_length,
{category_sql(_low)} AS category FROM ln WHERE text <> ''"""
