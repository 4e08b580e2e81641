"""Text-quality queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import rules
from mnemora.functions import text as T
from mnemora.functions.arrays import r6
from mnemora.plans import inputs

Q: dict = {}
S: dict[str, str] = {}


def _text(c: str = "text"):
    return F.col(c)


def semantic_entropy(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    return docs.select("doc_id", r6(T.length_class_entropy(T.tokens(_text()))).alias("entropy"))


def repetition(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder).withColumn("tok", T.tokens(_text()))
    return docs.select("doc_id", r6(T.repetition_score(F.col("tok"))).alias("repetition_score"))


def sentence_shapes(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.documents(spark, folder).select("doc_id", r6(T.sentence_shape_score(_text())).alias("shape_score"))


def tag_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Transition diversity and runs over coarse word classes in the place of tagger output."""
    docs = inputs.documents(spark, folder)
    tags = F.transform(
        T.tokens(_text()),
        lambda t: F.when(t.rlike(r"^\p{Lu}"), "NP").when(F.length(t) > 6, "NN").when(F.length(t) > 3, "VB").otherwise("DT"),
    )
    scored = docs.withColumn("tags", tags).withColumn("s", T.tag_sequence_score(F.col("tags")))
    return scored.select("doc_id", r6(F.col("s.transition_score")).alias("transition_score"), r6(F.col("s.run_score")).alias("run_score"))


def quality_issues(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.documents(spark, folder).select("doc_id", r6(T.quality_issues(_text())).alias("quality_issues"))


def severe_overflow(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.marked_documents(spark, folder).select("doc_id", T.severe_overflow(_text()).alias("severe"))


def content_entropy(spark: SparkSession, folder: str) -> DataFrame:
    out = T.with_content_entropy(inputs.marked_documents(spark, folder).select("doc_id", "text"))
    names = ["entropy", "base_entropy", "severity", "repetition_score", "pattern_score", "quality_issues"]
    return out.select("doc_id", *[r6(F.col(n)).alias(n) for n in names], "token_count")


def repetitive_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.marked_documents(spark, folder).select("doc_id", T.repetitive_pattern(_text()).alias("pattern"))


def duplicate_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by id, conversation texts by conversation and turn."""
    docs = inputs.marked_documents(spark, folder).select(
        F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("turn"), F.lit("doc").alias("kind"), "text"
    )
    talk = inputs.turns(spark, folder).select(F.col("conv_id").alias("id"), "turn", F.lit("turn").alias("kind"), "text")
    return docs.unionByName(talk).select("id", "turn", "kind", T.duplicate_lines(_text()).alias("duplicated"))


def context_overflow(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.marked_documents(spark, folder)
    return docs.select("doc_id", T.overflow_patterns(_text()).alias("p")).select(
        "doc_id", (F.size("p") > 0).alias("is_overflow"), F.array_join("p", ",").alias("patterns")
    )


def repeated_phrases(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    return docs.select("doc_id", F.posexplode(T.repeated_phrases(_text())).alias("rank", "r")).select(
        "doc_id", "rank", F.col("r.n").alias("n"), F.col("r.gram").alias("phrase")
    )


def content_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = T.with_content_quality(inputs.documents(spark, folder).select("doc_id", "text"))
    return out.select("doc_id", "is_low_quality", "quality_issue_names", r6(F.col("quality_score")).alias("quality_score"))


def malformed_sentences(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder).withColumn("s", T.sentences(_text()))
    return docs.select("doc_id", F.size("s").alias("n_sentences"), T.malformed_count(F.col("s")).alias("malformed"))


def section_structure(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    staged = docs.withColumn("q", T.section_qualities(T.sentences(_text())))
    return staged.select(
        "doc_id",
        F.size("q").alias("n_sections"),
        r6(F.get("q", F.lit(0))).alias("first_quality"),
        r6(F.get("q", F.size("q") - 1)).alias("last_quality"),
        F.coalesce(T.structure_declines(F.col("q")), F.lit(False)).alias("deteriorated"),
    )


def paragraph_structure(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder).withColumn("s", T.paragraph_structure(_text()))
    return docs.select("doc_id", "s.n_sections", "s.drops", F.coalesce(F.col("s.deteriorated"), F.lit(False)).alias("deteriorated"))


def sentence_topics(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.documents(spark, folder).select("doc_id", F.array_join(T.sentence_topics(_text()), "|").alias("topics"))


def post_processed(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    noted = F.concat(_text(), F.lit("\n\n"), _text(), F.lit("\nrelevance increased by 12.5% today"))
    return docs.select("doc_id", T.without_repeated_paragraphs(noted).alias("cleaned")).select(
        "doc_id", F.length("cleaned").alias("n"), F.md5("cleaned").alias("digest")
    )


def stream_prefix_checks(spark: SparkSession, folder: str) -> DataFrame:
    """First checkpoint of a growing answer at which a repetition shows."""
    docs = inputs.marked_documents(spark, folder).withColumn("tok", T.tokens(_text()))
    docs = docs.withColumn("points", T.prefix_checkpoints(F.size("tok")))
    judged = F.struct(F.size("points").cast("bigint").alias("n_checks"), T.first_repetition(F.col("tok"), F.col("points")).alias("f"))
    # a filter on the points would be pushed below the tokens and split each text once more
    found = docs.select("doc_id", F.explode(F.when(F.size("points") > 0, F.array(judged))).alias("r"))
    return found.select("doc_id", "r.n_checks", F.col("r.f.pattern").alias("first_pattern"), F.col("r.f.at").alias("stopped_at"))


Q.update(
    text_semantic_entropy=semantic_entropy,
    text_repetition=repetition,
    text_sentence_shapes=sentence_shapes,
    text_tag_transitions=tag_transitions,
    text_quality_issues=quality_issues,
    text_severe_overflow=severe_overflow,
    text_content_entropy=content_entropy,
    text_repetitive_patterns=repetitive_patterns,
    text_duplicate_lines=duplicate_lines,
    text_context_overflow=context_overflow,
    text_repeated_phrases=repeated_phrases,
    text_content_quality=content_quality,
    text_malformed_sentences=malformed_sentences,
    text_section_structure=section_structure,
    text_paragraph_structure=paragraph_structure,
    text_sentence_topics=sentence_topics,
    text_post_processed=post_processed,
    text_stream_prefix_checks=stream_prefix_checks,
)

# ------------------------------------------------------------------------------------ SQL

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A rule pattern for SQL on text whose accented letters were replaced by :func:`ascii_words`."""
    return quote(pattern.replace(r"\z", "$"))


def ascii_words(col: str) -> str:
    """Accented letters become underscores: word boundaries then agree with Unicode ones."""
    return rf"regexp_replace({col}, '[\x{{C0}}-\x{{24F}}]', '_', 'g')"


_tail = " ".join(f"WHEN source = {quote(s)} THEN {quote(g)}" for s, g in inputs.GARBAGE)
DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
MARKED = f"docs AS (SELECT doc_id AS id, text || CASE {_tail} ELSE '' END AS text FROM documents)"
ANSWERS = "docs AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'assistant')"

TOK = r"""tl AS (SELECT id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS l FROM docs),
tok AS (SELECT id, unnest(l) AS w, unnest(range(len(l))) AS i FROM tl)"""
ENTROPY = """ec AS (SELECT id, least(5, length(w) // 3) AS k, count(*) AS n FROM tok GROUP BY ALL),
et AS (SELECT id, count(*) AS total FROM tok GROUP BY 1),
entropy AS (SELECT t.id, CASE WHEN max(t.total) < 5 THEN 0.0
  ELSE -sum((n::DOUBLE / t.total) * log2(n::DOUBLE / t.total)) END AS entropy
  FROM et t JOIN ec USING (id) GROUP BY t.id)"""
_stop = ", ".join(quote(w) for w in rules.COMMON_WORDS)
REPEAT = f"""wc AS (SELECT id, lower(w) AS w, count(*) AS n FROM tok GROUP BY ALL),
bg AS (SELECT id, lower(w) || ' ' || lower(lead(w) OVER (PARTITION BY id ORDER BY i)) AS b FROM tok),
bc AS (SELECT id, b, count(*) AS n FROM bg WHERE b IS NOT NULL GROUP BY ALL),
rep AS (SELECT id, sum(p) AS rep FROM (
  SELECT id, (n - 2) * 0.1::DOUBLE AS p FROM wc WHERE n > 2 AND w NOT IN ({_stop})
  UNION ALL SELECT id, (n - 1) * 0.3::DOUBLE FROM bc WHERE n > 1) GROUP BY id)"""
SHAPE = r"""ss AS (SELECT id, list_filter(string_split_regex(unnest(string_split(text, '.')), '\s+'), lambda x: x <> '') AS l FROM docs),
sc AS (SELECT id, len(l) || '-' || lower(l[1]) || '-' || lower(l[-1]) AS k, count(*) AS n FROM ss WHERE len(l) > 2 GROUP BY ALL),
shape AS (SELECT id, sum((n - 1) * 0.3::DOUBLE) AS shape FROM sc WHERE n > 1 GROUP BY id)"""
ISSUES = r"""qs AS (SELECT id, text, string_split_regex(text, '[.!?]+') AS parts FROM docs),
qr AS (SELECT id, text,
  len(list_filter(parts, lambda p: len(list_filter(string_split_regex(p, '\s+'), lambda x: x <> '')) BETWEEN 1 AND 2))::DOUBLE / len(parts) AS tiny,
  length(regexp_replace(text, '[a-zA-Z0-9\s.,!?]', '', 'g'))::DOUBLE / greatest(1, length(text)) AS special FROM qs),
qual AS (SELECT id, (CASE WHEN regexp_matches(text, '[.!?]\s*$') THEN 0.0 ELSE 0.2 END
  + CASE WHEN tiny > 0.3 THEN tiny * 0.5 ELSE 0.0 END
  + CASE WHEN special > 0.1 THEN special * 2.0 ELSE 0.0 END)::DOUBLE AS qual FROM qr)"""


def _any(column: str, patterns: list[str]) -> str:
    return " OR ".join(f"regexp_matches({column}, {re2(p)})" for p in patterns)


SEVERE = f"severe AS (SELECT id, {_any('a', rules.SEVERE_PATTERNS)} AS severe FROM (SELECT id, {ascii_words('text')} AS a FROM docs))"
CONTENT = """measured AS (
  SELECT d.id, d.text, coalesce(t.total, 0) AS token_count, coalesce(e.entropy, 0.0) AS base,
    coalesce(r.rep, 0.0) AS rep, coalesce(s.shape, 0.0) AS shape, q.qual, v.severe
  FROM docs d LEFT JOIN et t USING (id) LEFT JOIN entropy e USING (id) LEFT JOIN rep r USING (id)
  LEFT JOIN shape s USING (id) JOIN qual q USING (id) JOIN severe v USING (id)),
content AS (SELECT id, token_count,
  CASE WHEN token_count < 3 THEN 0.5 ELSE base * CASE WHEN base < 1.0 AND rep > 0.5 THEN 0.7 ELSE 1.0 END
    * CASE WHEN base > 2.0 AND qual > 0.3 THEN 1.5 ELSE 1.0 END END AS entropy,
  CASE WHEN token_count >= 3 THEN base END AS base_entropy,
  CASE WHEN token_count < 3 THEN 0.3 ELSE greatest(CASE WHEN severe THEN 0.8 ELSE 0.0 END, least(1.0,
    CASE WHEN base < 1.0 AND rep > 0.5 THEN 0.3 ELSE 0.0 END + CASE WHEN base > 2.0 AND qual > 0.3 THEN 0.4 ELSE 0.0 END
    + rep * 0.3 + shape * 0.3 + qual * 0.2)) END AS severity,
  CASE WHEN token_count < 3 THEN 0.0 ELSE least(1.0, rep) END AS repetition_score,
  CASE WHEN token_count < 3 THEN 0.0 ELSE least(1.0, shape + CASE WHEN severe THEN 0.5 ELSE 0.0 END) END AS pattern_score,
  CASE WHEN token_count >= 3 THEN least(1.0, qual) END AS quality_issues
  FROM measured)"""
FULL_CONTENT = ",\n".join([TOK, ENTROPY, REPEAT, SHAPE, ISSUES, SEVERE, CONTENT])

_leads = ", ".join(f"lead(w, {j}) OVER o AS w{j}" for j in range(1, 9))
_grams = " ".join(f"WHEN {n} THEN w || ' ' || " + " || ' ' || ".join(f"w{j}" for j in range(1, n)) for n in (3, 5, 6, 7, 8, 9))
PHRASES = rf"""pw AS (SELECT id, regexp_extract_all(lower(text), '{W}+') AS l FROM docs WHERE length(text) >= 100),
pu AS (SELECT id, len(l) AS c, unnest(l) AS w, unnest(range(len(l))) AS pos FROM pw),
pl AS (SELECT *, {_leads} FROM pu WINDOW o AS (PARTITION BY id ORDER BY pos)),
pn AS (SELECT *, unnest(CASE WHEN c > 1000 THEN [3, 5, 7] ELSE range(5, least(10, c // 3)::BIGINT) END) AS n FROM pl),
pg AS (SELECT id, n, pos, CASE n {_grams} END AS gram FROM pn),
pc AS (SELECT id, n, gram, min(pos) AS pos, count(*) AS c FROM pg WHERE length(gram) >= 10 GROUP BY ALL HAVING count(*) >= 3),
phrases AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, pos) - 1 AS rank FROM pc) WHERE rank < 5)"""
RUNS = """ch AS (SELECT id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM docs),
cg AS (SELECT id, c, i - row_number() OVER (PARTITION BY id, c ORDER BY i) AS g FROM ch WHERE c <> chr(10)),
charrun AS (SELECT DISTINCT id FROM (SELECT id, c, g FROM cg GROUP BY ALL HAVING count(*) >= 9))"""
LINES = """dl AS (SELECT id, text, unnest(string_split(text, chr(10))) AS ln, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
dn AS (SELECT id, ln, lead(ln) OVER w AS l2, lead(ln, 2) OVER w AS l3 FROM dl WINDOW w AS (PARTITION BY id ORDER BY i)),
dupl AS (SELECT id, bool_or(coalesce(l2 <> '' AND ends_with(ln, l2) AND starts_with(l3, l2), false)) AS duplicated FROM dn GROUP BY id)"""
_garbage = " ".join(f"WHEN regexp_matches(a, {re2(p)}) THEN {quote(n)}" for n, p in rules.GARBAGE_PATTERNS)
PATTERN = f"""pp AS (SELECT id, count(*) AS c FROM phrases GROUP BY id),
pattern AS (SELECT d.id, CASE WHEN length(d.text) < 20 THEN NULL {_garbage}
  WHEN r.id IS NOT NULL THEN 'repeated_characters' WHEN u.duplicated THEN 'duplicate_lines'
  WHEN length(d.text) > 200 AND p.c >= 3 THEN 'repetitive_phrases' END AS pattern
  FROM (SELECT id, text, {ascii_words('text')} AS a FROM docs) d
  LEFT JOIN charrun r ON r.id = d.id LEFT JOIN dupl u ON u.id = d.id LEFT JOIN pp p ON p.id = d.id)"""
_over = ", ".join(f"CASE WHEN regexp_matches(a, {re2(p)}) THEN 'pattern_{i}' END" for i, p in enumerate(rules.OVERFLOW_PATTERNS))
OVERFLOW = f"""oc AS (SELECT id, count(*) AS c FROM phrases GROUP BY id),
over AS (SELECT d.id, list_filter([{_over}, CASE WHEN o.c >= 3 THEN 'repetitive_phrases' END], lambda x: x IS NOT NULL) AS p
  FROM (SELECT id, {ascii_words('text')} AS a FROM docs) d LEFT JOIN oc o ON o.id = d.id)"""
SENT = r"""sl AS (SELECT id, text, list_filter(list_transform(string_split_regex(text, '[.!?]\s+'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS l FROM docs),
sent AS (SELECT id, unnest(l) AS s, unnest(range(len(l))) AS i, len(l) AS n FROM sl)"""
_sv = rf"(^|{NW})[A-Z][a-z]+[^\p{{L}}\p{{N}}_\n](.*[^\p{{L}}\p{{N}}_\n])?[a-z]+(s|ed)({NW}|$)"
MALFORMED = rf"""malformed AS (SELECT l.id, len(l.l) AS n, coalesce(m.c, 0) AS c FROM sl l LEFT JOIN (
  SELECT id, count(*) AS c FROM sent WHERE len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) >= 5
    AND NOT regexp_matches(s, '{_sv}') GROUP BY id) m ON m.id = l.id)"""


def quality_sql(section: str) -> str:
    return rf"""(len(list_distinct(regexp_extract_all({section}, '{W}+')))::DOUBLE / greatest(1, len(regexp_extract_all({section}, '{W}+')))) * 0.7
  + CASE WHEN contains({section}, '.') OR contains({section}, ',') THEN 0.15 ELSE 0.0 END
  + CASE WHEN regexp_matches({section}, '(^|{NW})[A-Z][a-z]+({NW}|$)') THEN 0.15 ELSE 0.0 END"""


SECTIONS = f"""sk AS (SELECT id, i, s, n, greatest(5, n // 5) AS z FROM sent),
sp AS (SELECT id, i, s, unnest(CASE WHEN n < 5 THEN []::BIGINT[] WHEN n <= 20 THEN [i // 3]
  ELSE list_filter([CASE WHEN i < z THEN 0 END, CASE WHEN i >= n // 2 - z // 2 AND i < n // 2 + z // 2 THEN 1 END,
    CASE WHEN i >= n - z THEN 2 END], lambda x: x IS NOT NULL) END) AS part FROM sk),
sj AS (SELECT id, part, string_agg(s, ' ' ORDER BY i) AS t FROM sp GROUP BY ALL),
sq AS (SELECT id, part, {quality_sql('t')} AS q FROM sj WHERE length(t) >= 20),
sections AS (SELECT d.id, count(q) AS n_sections, arg_min(q, part) AS first_quality, arg_max(q, part) AS last_quality
  FROM docs d LEFT JOIN sq ON sq.id = d.id GROUP BY d.id)"""
QUALITY = r"""quality AS (SELECT l.id,
  length(trim(l.text, ' ' || chr(10))) >= 50 AND m.n >= 3 AND m.c::DOUBLE / m.n > 0.3 AS bad_ratio,
  length(trim(l.text, ' ' || chr(10))) >= 50 AND m.n >= 10 AND s.n_sections >= 3 AND s.last_quality < s.first_quality * 0.6 AS bad_shape,
  m.c::DOUBLE / greatest(m.n, 1) AS ratio
  FROM sl l JOIN malformed m USING (id) JOIN sections s USING (id)),
judged AS (SELECT id, bad_ratio OR bad_shape AS is_low_quality,
  concat_ws(',', CASE WHEN bad_ratio THEN 'high_malformed_sentence_ratio' END, CASE WHEN bad_shape THEN 'structure_deterioration' END) AS quality_issue_names,
  greatest(0.0, least(1.0, 1.0 - CASE WHEN bad_ratio THEN ratio ELSE 0.0 END - CASE WHEN bad_shape THEN 0.3 ELSE 0.0 END)) AS quality_score
  FROM quality)"""
FULL_QUALITY = ",\n".join([SENT, MALFORMED, SECTIONS, QUALITY])


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r6s(e: str) -> str:
    return f"round(({e})::DOUBLE + 1e-9, 6)"


S["text_semantic_entropy"] = with_(DOCS, TOK, ENTROPY) + f"SELECT d.id AS doc_id, {r6s('coalesce(entropy, 0)')} AS entropy FROM docs d LEFT JOIN entropy USING (id)"
S["text_repetition"] = with_(DOCS, TOK, REPEAT) + f"SELECT d.id AS doc_id, {r6s('coalesce(rep, 0)')} AS repetition_score FROM docs d LEFT JOIN rep USING (id)"
S["text_sentence_shapes"] = with_(DOCS, SHAPE) + f"SELECT d.id AS doc_id, {r6s('coalesce(shape, 0)')} AS shape_score FROM docs d LEFT JOIN shape USING (id)"
S["text_tag_transitions"] = with_(DOCS, TOK, r"""tg AS (SELECT id, i, CASE WHEN regexp_matches(w, '^\p{Lu}') THEN 'NP' WHEN length(w) > 6 THEN 'NN' WHEN length(w) > 3 THEN 'VB' ELSE 'DT' END AS t FROM tok),
tr AS (SELECT id, t || '->' || lead(t) OVER (PARTITION BY id ORDER BY i) AS x FROM tg),
tc AS (SELECT id, count(DISTINCT x) AS u, count(x) AS n FROM tr GROUP BY id),
gi AS (SELECT id, t, i - row_number() OVER (PARTITION BY id, t ORDER BY i) AS g FROM tg),
gr AS (SELECT id, max(c) AS longest FROM (SELECT id, count(*) AS c FROM gi GROUP BY id, t, g) GROUP BY id)""") + f"""SELECT d.id AS doc_id,
{r6s('CASE WHEN n > 0 AND u::DOUBLE / n < 0.3 THEN (0.3 - u::DOUBLE / n) * 2.0 ELSE 0.0 END')} AS transition_score,
{r6s('greatest(0.0, (coalesce(longest, 0) - 4) * 0.2)')} AS run_score FROM docs d LEFT JOIN tc USING (id) LEFT JOIN gr USING (id)"""
S["text_quality_issues"] = with_(DOCS, ISSUES) + f"SELECT id AS doc_id, {r6s('qual')} AS quality_issues FROM qual"
S["text_severe_overflow"] = with_(MARKED, SEVERE) + "SELECT id AS doc_id, severe FROM severe"
_names = ["entropy", "base_entropy", "severity", "repetition_score", "pattern_score", "quality_issues"]
S["text_content_entropy"] = with_(MARKED, FULL_CONTENT) + "SELECT id AS doc_id, token_count, " + ", ".join(f"{r6s(n)} AS {n}" for n in _names) + " FROM content"
S["text_repetitive_patterns"] = with_(MARKED, PHRASES, RUNS, LINES, PATTERN) + "SELECT id AS doc_id, pattern FROM pattern"
S["text_duplicate_lines"] = (
    with_(
        f"src AS (SELECT doc_id AS key, NULL::BIGINT AS turn, 'doc' AS kind, text || CASE {_tail} ELSE '' END AS text FROM documents UNION ALL SELECT conv_id, turn, 'turn', text FROM conversations)",
        "docs AS (SELECT kind || ':' || key || ':' || coalesce(turn, 0) AS id, key, turn, kind, text FROM src)",
        LINES,
    )
    + "SELECT d.key AS id, d.turn, d.kind, u.duplicated FROM docs d JOIN dupl u ON u.id = d.id"
)
S["text_context_overflow"] = with_(MARKED, PHRASES, OVERFLOW) + "SELECT id AS doc_id, len(p) > 0 AS is_overflow, array_to_string(p, ',') AS patterns FROM over"
S["text_repeated_phrases"] = with_(DOCS, PHRASES) + "SELECT id AS doc_id, rank, n, gram AS phrase FROM phrases"
S["text_content_quality"] = with_(DOCS, FULL_QUALITY) + f"SELECT id AS doc_id, is_low_quality, quality_issue_names, {r6s('quality_score')} AS quality_score FROM judged"
S["text_malformed_sentences"] = with_(DOCS, SENT, MALFORMED) + "SELECT id AS doc_id, n AS n_sentences, c AS malformed FROM malformed"
S["text_section_structure"] = with_(DOCS, SENT, SECTIONS) + f"""SELECT id AS doc_id, n_sections, {r6s('first_quality')} AS first_quality, {r6s('last_quality')} AS last_quality,
coalesce(n_sections >= 3 AND last_quality < first_quality * 0.6, false) AS deteriorated FROM sections"""
S["text_paragraph_structure"] = with_(
    DOCS,
    r"""pb AS (SELECT id, CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10))
  ELSE string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS l FROM docs),
pe AS (SELECT id, unnest(l) AS p, unnest(range(len(l))) AS i FROM pb)""",
    f"""pq AS (SELECT id, i, {quality_sql('p')} AS q FROM pe WHERE length(trim(p, ' ' || chr(10))) >= 20),
pk AS (SELECT id, i, q, lag(q, 1, 1.0) OVER w AS before, row_number() OVER w AS r, count(*) OVER (PARTITION BY id) AS n FROM pq WINDOW w AS (PARTITION BY id ORDER BY i)),
pz AS (SELECT id, count(*) AS n_sections, count(*) FILTER (WHERE i > 0 AND q < before * 0.7) AS drops,
  avg(q) FILTER (WHERE r <= n // 3) AS a, avg(q) FILTER (WHERE r > n - ceil(n / 3.0)) AS b FROM pk GROUP BY id)""",
) + """SELECT d.id AS doc_id, coalesce(n_sections, 0) AS n_sections, coalesce(drops, 0) AS drops,
coalesce(drops >= 2 OR (n_sections >= 3 AND b < a * 0.6), false) AS deteriorated FROM docs d LEFT JOIN pz USING (id)"""
S["text_sentence_topics"] = with_(
    DOCS,
    rf"""tp AS (SELECT id, unnest(list_concat(
  list_filter(list_transform(string_split_regex(text, '[.!?]\s+'), lambda s: regexp_extract(s, '[^\s]+')), lambda w: length(w) > 3 AND regexp_matches(w, '^\p{{Lu}}')),
  regexp_extract_all({ascii_words('text')}, {quote(rules.TOPIC_VERB_PHRASE)}))) AS t FROM docs),
td AS (SELECT DISTINCT id, t FROM tp), tn AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY t) AS r FROM td)""",
) + "SELECT d.id AS doc_id, coalesce(string_agg(t, '|' ORDER BY t) FILTER (WHERE r <= 5), '') AS topics FROM docs d LEFT JOIN tn USING (id) GROUP BY d.id"
S["text_post_processed"] = with_(
    r"""docs AS (SELECT doc_id AS id, text || chr(10) || chr(10) || text || chr(10) || 'relevance increased by 12.5% today' AS text FROM documents),
ln AS (SELECT id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
lb AS (SELECT id, s, i, trim(s) = '' AS blank, coalesce(lag(trim(s) = '') OVER (PARTITION BY id ORDER BY i), true) AS after FROM ln),
lp AS (SELECT *, sum(CASE WHEN blank OR after THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g FROM lb),
pa AS (SELECT id, g, CASE WHEN bool_or(blank) THEN '' ELSE string_agg(s, chr(10) ORDER BY i) END AS p FROM lp GROUP BY id, g),
pk AS (SELECT id, g, p, regexp_replace(lower(p), '[^\p{L}\p{N}_\s]', '', 'g') AS k FROM pa),
pr AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY g) AS r FROM pk),
pj AS (SELECT id, string_agg(p, chr(10) ORDER BY g) AS t FROM pr WHERE k = '' OR r = 1 GROUP BY id),
fin AS (SELECT id, regexp_replace(t, '(?:relevance|similarity)\s+(?:increased|decreased)\s+by\s+[\d.]+%', '', 'g') AS t FROM pj)"""
) + "SELECT id AS doc_id, length(t) AS n, md5(t) AS digest FROM fin"
S["text_stream_prefix_checks"] = with_(
    MARKED.replace("docs AS", "raw AS"),
    r"""rt AS (SELECT id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS l FROM raw),
cp AS (SELECT id, l, unnest(list_concat([40, 80], range(160, greatest(160, len(l) + 1), 100))) AS upto FROM rt),
docs AS (SELECT id || ':' || upto AS id, id AS doc_id, upto, array_to_string(l[1:upto], ' ') AS text FROM cp WHERE upto <= len(l))""",
    PHRASES, RUNS, LINES, PATTERN,
) + """SELECT d.doc_id, count(*) AS n_checks, arg_min(p.pattern, d.upto) FILTER (WHERE p.pattern IS NOT NULL) AS first_pattern,
min(d.upto) FILTER (WHERE p.pattern IS NOT NULL) AS stopped_at FROM docs d JOIN pattern p USING (id) GROUP BY d.doc_id"""
