"""Confidence-series queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import confidence as C
from mnemora.functions.arrays import r6
from mnemora.operators import series
from mnemora.plans import inputs
from mnemora.plans.text_plans import r6s, with_

Q: dict = {}
S: dict[str, str] = {}

KEY, ORDER = ["user_id"], ["ts", "event_id"]


def token_softmax(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector read as logits; the chosen token is its label."""
    vectors = inputs.embeddings(spark, folder)
    m = vectors.select(
        "id", C.softmax_metrics(F.transform("embedding", lambda x: x.cast("double") * 10), F.col("label")).alias("m")
    )
    return m.select("id", r6(F.col("m.prob")).alias("prob"), r6(F.col("m.entropy")).alias("entropy"))


def sharpened_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.confidences(spark, folder)
    p = F.col("prob")
    return rows.select(
        "event_id",
        r6(C.sharpen_probability(p)).alias("sharp_prob"),
        r6(C.sharpen_entropy(p * 2)).alias("sharp_entropy"),
        r6(C.sharpen_value(p, 0.5, 1.3)).alias("up"),
        r6(C.sharpen_value(p, 0.5, 1.3, False)).alias("down"),
        r6(C.sharpen_probability(p, 0.6)).alias("stronger"),
        r6(C.sharpen_probability(p, 0.0)).alias("off"),
    )


def series_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = series.series_metrics(inputs.confidences(spark, folder), KEY, "prob")
    names = ["confidence", "perplexity", "entropy", "enhancement"]
    return out.select("user_id", "tokens", *[r6(F.col(n)).alias(n) for n in names])


def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    out = series.token_stats(inputs.confidences(spark, folder), KEY, "prob")
    names = ["mean", "median", "min", "max", "std_dev"]
    return out.select("user_id", "n", *[r6(F.col(n)).alias(n) for n in names])


def sliding_window(spark: SparkSession, folder: str) -> DataFrame:
    rows, block = series.time_blocks(inputs.confidences(spark, folder), KEY, "ts")
    out = series.sliding_confidence(rows, KEY, ORDER, block, "prob", 5)
    n = F.col("normalized_confidence")
    return out.select(
        "event_id",
        r6(n).alias("normalized_confidence"),
        r6(C.sharpened_confidence(n)).alias("sharpened_confidence"),
        r6(C.sharpened_perplexity(F.col("prob") * 10)).alias("sharpened_perplexity"),
        r6(C.sharpened_entropy(F.col("prob") * 2)).alias("sharpened_entropy"),
    )


def patterns(spark: SparkSession, folder: str) -> DataFrame:
    rows, block = series.time_blocks(inputs.confidences(spark, folder), KEY, "ts")
    out = series.confidence_patterns(rows, KEY, ORDER, block, "prob")
    names = ["mean_confidence", "drop_size", "degradation", "repetition", "severity"]
    return out.select("user_id", "n_values", "pattern_type", *[r6(F.col(n)).alias(n) for n in names])


def patterns_parity(spark: SparkSession, folder: str) -> DataFrame:
    rows, block = series.time_blocks(inputs.confidences(spark, folder), KEY, "ts")
    out = series.confidence_patterns(rows, KEY, ORDER, block, "prob", floor_third=False)
    return out.select("user_id", "pattern_type", r6(F.col("degradation")).alias("degradation"), r6(F.col("severity")).alias("severity"))


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    rows, block = series.time_blocks(inputs.confidences(spark, folder), KEY, "ts")
    out = series.running_baseline(rows, KEY, ORDER, block, "prob", 0.5)
    return out.select("user_id", "n_values", r6(F.col("baseline")).alias("baseline"))


def answer_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline and variance folded over a user's days; the values of a day are one answer."""
    values = inputs.confidences(spark, folder).withColumn("day", F.date_trunc("day", "ts"))
    answers, block = series.time_blocks(series.answer_confidence(values, KEY, ["day"], "prob"), KEY, "day")
    out = series.answer_baseline(answers, KEY, ["day"], block)
    return out.select("user_id", F.col("n_values").alias("n_answers"), *[r6(F.col(n)).alias(n) for n in ("baseline", "baseline_variance")])


def colours(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.confidences(spark, folder)
    return (
        rows.select(C.colour_step(F.col("prob")).alias("step"), C.even_colour_step(F.col("prob")).alias("even_step"))
        .groupBy("step", "even_step")
        .agg(F.count("*").alias("n"))
    )


def coloured_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every token of a document with a confidence from its author's scores, the last one repeating."""
    from mnemora.functions.text import tokens

    docs = inputs.documents(spark, folder).join(
        inputs.embeddings(spark, folder).select(F.col("id").alias("doc_id"), "embedding"), "doc_id", "left"
    )
    scores = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 3)
    scores = F.coalesce(scores, F.array().cast("array<double>"))
    tok = docs.select("doc_id", scores.alias("scores"), F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    step = C.colour_step(C.confidence_at(F.col("scores"), F.col("pos")))
    return tok.groupBy("doc_id", step.alias("step")).agg(F.count("*").alias("n"))


def indicator(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.confidences(spark, folder)
    p = F.col("prob")
    count = F.floor(p * 7).cast("int")
    return rows.select(
        "event_id",
        C.percent(p).alias("confidence_pct"),
        C.percent(F.lit(1.0) - p).alias("reliability_pct"),
        C.bar(p).alias("bar"),
        C.support_tier(count, p).alias("support"),
    )


def declining(spark: SparkSession, folder: str) -> DataFrame:
    rows, block = series.time_blocks(inputs.confidences(spark, folder), KEY, "ts")
    out = series.declining(rows, KEY, ORDER, block, "prob")
    return out.select("event_id", "declining")


Q.update(
    confidence_token_softmax=token_softmax,
    confidence_sharpened_tokens=sharpened_tokens,
    confidence_series_metrics=series_metrics,
    confidence_token_stats=token_stats,
    confidence_sliding_window=sliding_window,
    confidence_patterns=patterns,
    confidence_patterns_parity=patterns_parity,
    confidence_baseline=baseline,
    confidence_answer_baseline=answer_baseline,
    confidence_colours=colours,
    confidence_coloured_tokens=coloured_tokens,
    confidence_indicator=indicator,
    confidence_declining=declining,
)

CONF = "conf AS (SELECT user_id, event_id, ts, (props->>'k')::DOUBLE / 100 AS prob FROM events)"


def sharp(p: str, f: float) -> str:
    return f"CASE WHEN {p} > 0.5 THEN least(1.0, {p} + ({p} - 0.5) * {f}) ELSE greatest(0.0, {p} - (0.5 - {p}) * {f}) END"


S["confidence_token_softmax"] = with_(
    """lg AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 10) AS l FROM embeddings),
ex AS (SELECT vec_id, label, list_transform(l, lambda x: exp(x)) AS e FROM lg),
sm AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex)"""
) + f"SELECT vec_id AS id, {r6s('p[label + 1]')} AS prob, {r6s('-list_sum(list_transform(p, lambda x: x * log2(x + 1e-10)))')} AS entropy FROM sm"
S["confidence_sharpened_tokens"] = with_(CONF) + f"""SELECT event_id, {r6s(sharp('prob', 0.3))} AS sharp_prob,
{r6s('CASE WHEN prob * 2 < 1 THEN greatest(0.0, prob * 2 - prob * 2 * 0.3 * 0.5) ELSE prob * 2 + (prob * 2 - 1) * 0.3 * 0.5 END')} AS sharp_entropy,
{r6s('CASE WHEN prob > 0.5 THEN least(1.0, prob + (prob - 0.5) * 0.3) ELSE prob * (0.8 + prob / 0.5 * 0.2) END')} AS up,
{r6s('CASE WHEN prob < 0.5 THEN prob * power(prob / 0.5, 0.3) ELSE 0.5 + (prob - 0.5) * 1.3 END')} AS down,
{r6s(sharp('prob', 0.6))} AS stronger, {r6s('prob')} AS "off" FROM conf"""
S["confidence_series_metrics"] = with_(CONF) + f"""SELECT user_id, count(prob) AS tokens, {r6s('avg(' + sharp('prob', 0.3) + ')')} AS confidence,
{r6s('exp(avg(-ln(greatest(prob, 1e-10))))')} AS perplexity, {r6s('avg(-greatest(prob, 1e-10) * log2(greatest(prob, 1e-10)))')} AS entropy,
{r6s('(avg(' + sharp('prob', 0.3) + ') - avg(prob)) / greatest(0.01, avg(prob)) * 100')} AS enhancement FROM conf GROUP BY user_id"""
S["confidence_token_stats"] = with_(CONF) + f"""SELECT user_id, count(prob) AS n, {r6s('avg(prob)')} AS mean, {r6s('median(prob)')} AS median,
{r6s('min(prob)')} AS min, {r6s('max(prob)')} AS max, {r6s('stddev_pop(prob)')} AS std_dev FROM conf GROUP BY user_id"""
S["confidence_sliding_window"] = with_(
    CONF,
    """win AS (SELECT event_id, prob, exp(avg(ln(greatest(prob, 0.01))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS g FROM conf)""",
) + f"""SELECT event_id, {r6s('g')} AS normalized_confidence,
{r6s('CASE WHEN g > 0.5 THEN least(1.0, g + (g - 0.5) * 0.45) ELSE greatest(0.1, g - (0.5 - g) * 0.45) END')} AS sharpened_confidence,
{r6s('CASE WHEN prob * 10 < 5 THEN greatest(1.0, prob * 10 - prob * 10 * 0.09) ELSE prob * 10 + (prob * 10 - 5) * 0.09 END')} AS sharpened_perplexity,
{r6s('CASE WHEN prob * 2 < 1 THEN greatest(0.0, prob * 2 - prob * 2 * 0.12) ELSE prob * 2 + (prob * 2 - 1) * 0.12 END')} AS sharpened_entropy FROM win"""


def patterns_sql(tail: str) -> str:
    def sim(n: int) -> str:
        gap = " + ".join(f"abs(lead(prob, {i}) OVER o - lead(prob, {i + n}) OVER o)" if i else f"abs(prob - lead(prob, {n}) OVER o)" for i in range(n))
        return f"CASE WHEN i < n - {2 * n} THEN 1.0 - ({gap}) / {n} END"

    return with_(
        CONF,
        """base AS (SELECT user_id, prob, ts, event_id, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
  avg(prob) OVER (PARTITION BY user_id) AS m, lag(prob) OVER o AS before FROM conf WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))""",
        f"""sims AS (SELECT *, greatest({sim(3)}, {sim(4)}, {sim(5)}) AS sim FROM base WINDOW o AS (PARTITION BY user_id ORDER BY i)),
agg AS (SELECT user_id, max(n) AS n, max(m) AS m, max(before - prob) FILTER (WHERE before - prob > 0.3 AND prob < m * 0.7) AS drop_size,
  sum(prob) FILTER (WHERE i < n // 3) / max(n // 3) AS first, sum(prob) FILTER (WHERE i >= n - {tail}) / max(n // 3) AS last,
  max(sim - 0.85) FILTER (WHERE sim > 0.85) AS rep FROM sims GROUP BY user_id HAVING max(n) >= 10),
fin AS (SELECT user_id, n, m, drop_size, CASE WHEN n > 20 AND first - last > 0.2 AND last < m * 0.8 THEN first - last END AS degradation,
  CASE WHEN n > 15 THEN rep END AS repetition FROM agg),
typed AS (SELECT *, CASE WHEN repetition IS NOT NULL THEN 'repetition' WHEN degradation IS NOT NULL THEN 'degradation' WHEN drop_size IS NOT NULL THEN 'sudden_drop' END AS pattern_type,
  greatest(coalesce(drop_size, 0), coalesce(degradation, 0), coalesce(repetition, 0)) AS severity FROM fin)""",
    )


S["confidence_patterns"] = patterns_sql("n // 3") + f"""SELECT user_id, n AS n_values, pattern_type, {r6s('m')} AS mean_confidence, {r6s('drop_size')} AS drop_size,
{r6s('degradation')} AS degradation, {r6s('repetition')} AS repetition, {r6s('severity')} AS severity FROM typed"""
S["confidence_patterns_parity"] = patterns_sql("ceil(n / 3.0)") + f"SELECT user_id, pattern_type, {r6s('degradation')} AS degradation, {r6s('severity')} AS severity FROM typed"
S["confidence_baseline"] = with_(
    CONF,
    "base AS (SELECT user_id, prob, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM conf)",
) + f"SELECT user_id, max(n) AS n_values, {r6s('sum(prob * 0.1 * power(0.9, back)) + 0.5 * power(0.9, max(n))')} AS baseline FROM base GROUP BY user_id"
S["confidence_answer_baseline"] = with_(
    CONF,
    "per AS (SELECT user_id, date_trunc('day', ts) AS day, avg(prob) AS m, var_pop(prob) AS v FROM conf GROUP BY ALL)",
    "base AS (SELECT user_id, m, v, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM per)",
) + f"""SELECT user_id, max(n) AS n_answers, {r6s('sum(m * 0.1 * power(0.9, back)) + 0.5 * power(0.9, max(n))')} AS baseline,
{r6s('sum(v * 0.1 * power(0.9, back)) + 0.1 * power(0.9, max(n))')} AS baseline_variance FROM base GROUP BY user_id"""
_step = "CASE WHEN {p} >= 0.8 THEN 0 WHEN {p} >= 0.7 THEN 1 WHEN {p} >= 0.6 THEN 2 WHEN {p} >= 0.5 THEN 3 WHEN {p} >= 0.4 THEN 4 WHEN {p} >= 0 THEN 5 END"
_even = "CASE " + " ".join(f"WHEN prob >= {10 - i} / 10.0 THEN {i}" for i in range(10)) + " ELSE 9 END"
S["confidence_colours"] = with_(CONF) + f"SELECT {_step.format(p='prob')} AS step, {_even} AS even_step, count(*) AS n FROM conf GROUP BY ALL"
S["confidence_coloured_tokens"] = with_(
    r"""dl AS (SELECT d.doc_id, e.embedding, list_filter(string_split_regex(d.text, '\s+'), lambda x: x <> '') AS l FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
tk AS (SELECT doc_id, embedding, unnest(range(len(l))) AS i FROM dl),
cf AS (SELECT doc_id, coalesce(abs(embedding[least(i + 1, len(embedding))]::DOUBLE) * 3, 1.0) AS c FROM tk)"""
) + f"SELECT doc_id, {_step.format(p='c')} AS step, count(*) AS n FROM cf GROUP BY ALL"
S["confidence_indicator"] = with_(CONF) + """SELECT event_id, floor(prob * 100)::INT AS confidence_pct, floor((1.0 - prob) * 100)::INT AS reliability_pct,
repeat('█', floor(prob * 30)::INT) || repeat('░', 30 - floor(prob * 30)::INT) AS bar,
CASE WHEN floor(prob * 7) <= 0 THEN 'None' WHEN prob > 0.8 THEN 'Excellent' WHEN prob > 0.6 THEN 'Good' WHEN prob > 0.4 THEN 'Moderate' ELSE 'Limited' END AS support FROM conf"""
S["confidence_declining"] = with_(CONF) + """SELECT event_id, coalesce(lag(prob, 2) OVER o > lag(prob) OVER o AND lag(prob) OVER o > prob, false) AS declining
FROM conf WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)"""
