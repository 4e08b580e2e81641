"""Conversation operators: topic shifts, sessions, answers' verdicts and memory prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions import rules
from mnemora.functions.arrays import let
from mnemora.functions.confidence import sharpened_confidence, sharpened_entropy, sharpened_perplexity
from mnemora.functions.text import contains_any, matches, overflow_patterns, strip, with_content_entropy, with_content_quality
from mnemora.functions.vectors import cosine
from mnemora.operators.series import with_previous, with_running_total


def asks_to_continue(text: Column, phrases: list[str] | None = None) -> Column:
    """Whether a message holds one of the phrases, in lower case; the default ones if none are given."""
    return let(F.lower(text), lambda low: contains_any(low, phrases or rules.CONTINUATION_PHRASES))


def asks_to_exit(text: Column, literal: bool = False) -> Column:
    """Exit words as whole messages; ``literal=True`` looks for them anywhere, even inside words."""
    if literal:
        return contains_any(F.lower(text), rules.EXIT_PHRASES)
    return strip(F.lower(text)).isin(rules.EXIT_PHRASES)


def topic_shifts(
    turns: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | None,
    text: str = "text",
    vec: str = "embedding",
    threshold: float = 0.35,
    ring: int = 3,
    literal_exit: bool = False,
    phrases: list[str] | None = None,
) -> DataFrame:
    """Add ``is_shift`` and ``similarity``: the best cosine with the last ``ring`` topics.

    Turns that ask to continue (by ``phrases``) or to exit, or have no vector, are neither judged nor remembered.
    """
    skip = asks_to_continue(F.col(text), phrases) | asks_to_exit(F.col(text), literal_exit) | F.col(vec).isNull()
    marked = turns.withColumn("_skip", F.coalesce(skip, F.lit(False)))
    judged = with_previous(marked.filter(~F.col("_skip")), keys, order, block, F.col(vec), ring, "_ring")
    best = F.greatest(
        F.lit(0.0),
        F.array_max(F.transform("_ring", lambda v: cosine(F.col(vec), v))),
    )
    judged = judged.withColumn("similarity", F.when(F.size("_ring") == 0, 1.0).otherwise(best)).withColumn(
        "is_shift", (F.size("_ring") > 0) & (F.col("similarity") < threshold)
    )
    passed = marked.filter(F.col("_skip")).withColumn("similarity", F.lit(1.0)).withColumn("is_shift", F.lit(False))
    return judged.drop("_ring", "_skip").unionByName(passed.drop("_skip"))


def sessions(turns: DataFrame, keys: list[str], order: list[str], block: Column | None, shift: str = "is_shift") -> DataFrame:
    """Add ``session``: 0 at the start, one more at every shift."""
    return with_running_total(turns, keys, order, block, F.col(shift).cast("bigint"), "session")


def query_thresholds(query: Column, domain: Column | None = None, base: tuple = rules.BASE_THRESHOLDS) -> Column:
    """``struct<confidence, entropy, perplexity, memory_weight>`` for a query and its domain."""
    names = ("confidence", "entropy", "perplexity", "memory_weight")
    picked = {n: F.lit(base[i]) for i, n in enumerate(names)}
    if domain is not None:
        for label, values in rules.DOMAIN_THRESHOLDS.items():
            for i, n in enumerate(names):
                picked[n] = F.when(domain == label, values[i]).otherwise(picked[n])
    for pattern, name, amount in rules.QUERY_NUDGES:
        hit = matches(F.coalesce(query, F.lit("")), "(?i)" + pattern)
        picked[name] = picked[name] + F.when(hit, amount).otherwise(0.0)
    return F.struct(*[picked[n].alias(n) for n in names])


def domain_of(category: Column) -> Column:
    """Threshold domain of a classifier label; opt-in, since the labels themselves match no domain."""
    found = category
    for label, domain in rules.LABEL_TO_DOMAIN.items():
        found = F.when(category == label, domain).otherwise(found)
    return found


def sampling_settings(domain: Column, temperature: Column, top_p: Column) -> Column:
    """``struct<temperature, top_p>``: the smaller of the given values and the domain's caps."""
    t, p = temperature, top_p
    for label, (cap_t, cap_p) in rules.DOMAIN_SAMPLING.items():
        t = F.when(domain == label, F.least(temperature, F.lit(cap_t))).otherwise(t)
        p = F.when(domain == label, F.least(top_p, F.lit(cap_p))).otherwise(p)
    return F.struct(t.alias("temperature"), p.alias("top_p"))


def likely_hallucination(entropy: Column, severity: Column, repetition: Column, semantic: Column) -> Column:
    return (
        (entropy > 1.65) | (semantic > 0.28) | (severity > 0.05) | ((entropy > 1.5) & (repetition > 0.1))
    )


def judge_answers(
    answers: DataFrame,
    text: str = "text",
    query: str = "query",
    domain: Column | None = None,
    min_tokens: int = 60,
    factor: float = 0.3,
    pattern_weight: float = 0.6,
) -> DataFrame:
    """Decide for every answer whether it should be filtered and why.

    Needs ``normalized_confidence, entropy, perplexity, tokens_generated, memory_supported,
    pattern_type, pattern_severity``. Adds ``should_filter, reason, uncertainty_score,
    is_likely_hallucination``. One projection, no shuffle.
    """
    t = F.col(text)
    content = answers.select(
        *[F.col(c) for c in answers.columns if c not in ("entropy", "perplexity")],
        sharpened_entropy(F.col("entropy"), factor).alias("_h"),
        sharpened_perplexity(F.col("perplexity"), factor).alias("_p"),
        sharpened_confidence(F.col("normalized_confidence"), factor).alias("_c"),
    )
    content = with_content_entropy(content, text)
    content = content.withColumnsRenamed({"quality_issues": "_issues", "severity": "_severity", "entropy": "_semantic"})
    content = with_content_quality(content, text)
    content = content.withColumn("_over", overflow_patterns(t)).withColumn(
        "_thr", query_thresholds(F.col(query), domain)
    )

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    semantic = clamp(F.col("_semantic") / 1.16 * 0.2)
    severity = F.coalesce(F.col("pattern_severity"), F.lit(0.0))
    thr_c, thr_h, thr_p = F.col("_thr.confidence"), F.col("_thr.entropy"), F.col("_thr.perplexity")
    score = clamp(
        clamp((F.lit(1.0) - F.col("_c")) * 0.35)
        + clamp((F.lit(1.0) - F.col("quality_score")) * 0.25)
        + clamp(F.col("_h") / thr_h * 0.15)
        + clamp(F.col("_p") / thr_p * 0.15)
        + semantic
        + clamp(severity * pattern_weight)
        + F.when(F.col("memory_supported"), -0.1).otherwise(0.0)
    )
    content = content.withColumn("uncertainty_score", score).withColumn(
        "is_likely_hallucination",
        likely_hallucination(F.col("_semantic"), F.col("_severity"), F.col("repetition_score"), semantic),
    )
    over = F.size("_over") > 0
    reason = (
        F.when((F.col("_semantic") > 2.0) | F.col("is_likely_hallucination"), "high_semantic_uncertainty")
        .when(over, F.concat(F.lit("context_overflow_["), F.array_join(F.transform("_over", lambda o: F.concat(F.lit("'"), o, F.lit("'"))), ", "), F.lit("]")))
        .when(F.col("tokens_generated") < min_tokens, "acceptable")
        .when(
            F.col("pattern_type").isNotNull() & (severity > 0.3),
            F.concat(F.lit("pattern_detected_"), F.col("pattern_type")),
        )
        .when(
            F.col("is_low_quality") & (F.col("quality_score") < 0.4),
            F.concat(F.lit("low_quality_"), F.col("quality_issue_names")),
        )
        .when(F.col("_c") < thr_c * 0.7, "very_low_confidence")
        .when(F.col("_h") > thr_h * 1.4, "extremely_high_entropy")
        .when(F.col("_p") > thr_p * 1.5, "extremely_high_perplexity")
        .when(F.col("uncertainty_score") > 0.7, "high_uncertainty")
        .otherwise("acceptable")
    )
    return (
        content.withColumn("reason", reason)
        .withColumn("should_filter", F.col("reason") != "acceptable")
        .select(
            *[c for c in answers.columns if c not in ("entropy", "perplexity")],
            "should_filter",
            "reason",
            "uncertainty_score",
            "quality_score",
            "is_likely_hallucination",
        )
    )


def fallback_text(reason: Column, query: Column, pick_by: Column, messages: list[str] | None = None) -> Column:
    """The fallback for a reason; which of the base texts is used follows from ``pick_by``, not chance."""
    messages = messages or rules.FALLBACK_MESSAGES
    texts = F.array(*[F.lit(m) for m in messages])
    base = F.get(texts, F.pmod(F.xxhash64(pick_by), F.lit(len(messages))).cast("int"))
    led = (
        F.when(F.startswith(reason, F.lit("context_overflow")), F.concat(F.lit(rules.OVERFLOW_LEAD), base))
        .when(F.startswith(reason, F.lit("low_quality")), F.concat(F.lit(rules.LOW_QUALITY_LEAD), base))
        .otherwise(base)
    )
    q = F.coalesce(query, F.lit(""))
    topic = F.regexp_extract(q, rules.java(r"(?:about|on|regarding)\s+([\"']?[\w\s]+[\"']?)"), 1)

    def named(text: Column) -> Column:
        about = F.replace(text, F.lit("this topic"), F.concat(F.lit("'"), topic, F.lit("'")))
        return F.when((topic == "") | F.contains(text, topic), text).otherwise(
            F.replace(
                about, F.lit("this question"), F.concat(F.lit("this question about '"), topic, F.lit("'"))
            )
        )

    hint = F.when(contains_any(F.lower(q), ["file", "table", "csv"]), rules.FILE_HINT).otherwise("")
    return F.concat(let(led, named), hint)


def final_answer(
    text: Column,
    reason: Column,
    query: Column,
    commands: Column,
    pick_by: Column,
    messages: list[str] | None = None,
    phrases: list[str] | None = None,
) -> Column:
    """The answer, the answer with a disclaimer, or the fallback with the kept file blocks.

    ``messages`` are the caller's fallback texts, ``phrases`` those that ask to continue.
    """
    tail = F.when(F.size(commands) > 0, F.concat(F.lit("\n\n"), F.array_join(commands, "\n"))).otherwise("")
    return (
        F.when(reason == "acceptable", text)
        .when(asks_to_continue(F.coalesce(query, F.lit("")), phrases), F.concat(F.lit(rules.DISCLAIMER), text))
        .otherwise(F.concat(fallback_text(reason, query, pick_by, messages), tail))
    )


def stops_stream(should_filter: Column, reason: Column, tokens: Column, query: Column, min_tokens: int = 60, phrases: list[str] | None = None) -> Column:
    """Whether a growing answer is cut: overflow after 30 tokens, other reasons from ``min_tokens`` on."""
    return (
        F.when((tokens > 30) & F.startswith(reason, F.lit("context_overflow")), True)
        .when(tokens < min_tokens, False)
        .when(~should_filter, False)
        .otherwise(~asks_to_continue(F.coalesce(query, F.lit("")), phrases))
    )


def repeated_drafts(
    drafts: DataFrame, keys: list[str], order: list[str], toks: str = "tokens", remembered: int = 5
) -> DataFrame:
    """Add ``is_repetitive``: an n-gram inside repeats, or the start equals a remembered draft's end.

    A draft is remembered only when it was not repetitive itself, so each verdict rests on
    all earlier ones: a true fold. The inner test runs in Spark expressions; the fold only
    sees the first and last three tokens, in order, and keeps ``remembered`` of them.
    """
    import pandas as pd

    from mnemora.functions.classify import repeats_ngram

    t = F.col(toks)
    edges = drafts.select(
        *keys,
        *order,
        repeats_ngram(t).alias("_inner"),
        F.when(F.size(t) >= 3, F.array_join(F.slice(t, 1, 3), "\u0001")).alias("_head"),
        F.when(F.size(t) >= 3, F.array_join(F.slice(t, -3, 3), "\u0001")).alias("_tail"),
    )
    ordered = edges.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [*keys, *order]

    def fold(frames):
        series, ring = None, []
        for frame in frames:
            verdicts = []
            for row in frame.itertuples(index=False):
                key = tuple(row[: len(keys)])
                if key != series:
                    series, ring = key, []
                inner, head, tail = row[-3:]
                bad = bool(inner) or (head is not None and head in ring)
                verdicts.append(bad)
                if not bad:
                    ring = [*ring, tail][-remembered:]
            yield pd.concat([frame[names], pd.Series(verdicts, name="is_repetitive", index=frame.index)], axis=1)

    schema = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in names) + ", is_repetitive boolean"
    return ordered.mapInPandas(fold, schema)


def draft_rates(df: DataFrame) -> DataFrame:
    """Acceptance, success and utilisation rates with zero guards, from summed counters."""
    rate = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return df.select(
        *df.columns,
        rate("tokens_from_draft", "total_draft_tokens").alias("efficiency"),
        rate("successful_attempts", "speculative_attempts").alias("success_rate"),
        rate("tokens_from_draft", "total_tokens_generated").alias("utilization"),
    )


def memory_prompt(hits: DataFrame, relevance: float = 1.05) -> DataFrame:
    """One prompt text per query from its hits (``content, similarity, main_category``).

    Hits that reach ``relevance`` times the best similarity, helped by search terms found in
    a question-like best hit, come first; the rest follow by category in first-seen order.
    The hits of a query are a top-k result, so a group is small.
    """
    entry = F.struct(
        (-F.col("similarity")).alias("neg"), "item_id", "similarity", F.coalesce("main_category", F.lit("unknown")).alias("category"), strip(F.col("content")).alias("content")
    )
    grouped = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("_h"))
    lead = F.lower(F.get("_h", F.lit(0))["content"])
    question = F.regexp_extract(lead, rules.java(r"(?:who|what|when|where|why|how).*?([\w\s]+)(?:\?|$)"), 1)
    terms = F.when(
        F.contains(lead, F.lit("who")) & F.contains(lead, F.lit("what")),
        F.filter(F.split(strip(question), r"(?U)\s+"), lambda w: F.length(w) > 3),
    ).otherwise(F.array().cast("array<string>"))
    best = F.get("_h", F.lit(0))["similarity"]
    staged = (
        grouped.withColumn("_terms", terms)
        .withColumn("_best", best)
        .withColumn(
            "_marked",
            F.transform(
                "_h",
                lambda h: F.struct(
                    h["category"].alias("category"),
                    F.format_string("- [%.2f] %s\n\n", h["similarity"], h["content"]).alias("line"),
                    (
                        h["similarity"]
                        + F.size(F.filter("_terms", lambda w: F.contains(F.lower(h["content"]), w))) * 0.2
                        >= F.col("_best") * relevance
                    ).alias("high"),
                ),
            ),
        )
        .withColumn("_high", F.filter("_marked", lambda m: m["high"]))
        .withColumn("_rest", F.filter("_marked", lambda m: ~m["high"]))
    )
    categories = F.array_distinct(F.transform("_rest", lambda m: m["category"]))
    parts = F.transform(
        categories,
        lambda c: F.concat(
            F.lit("\nADDITIONAL "),
            F.upper(F.replace(c, F.lit("_"), F.lit(" "))),
            F.lit(" INFORMATION:\n"),
            F.array_join(F.transform(F.filter("_rest", lambda m: m["category"] == c), lambda m: m["line"]), ""),
        ),
    )
    text = F.concat(
        F.lit(PROMPT_HEAD),
        F.when(
            F.size("_high") > 0,
            F.concat(F.lit("\nHIGHLY RELEVANT INFORMATION:\n"), F.array_join(F.transform("_high", lambda m: m["line"]), "")),
        ).otherwise(""),
        F.array_join(parts, ""),
        F.lit(PROMPT_TAIL),
    )
    return staged.select("query_id", F.size("_high").alias("n_high"), F.size("_rest").alias("n_rest"), text.alias("memory_text"))


# --- fixed values: frame of the memory prompt ---
PROMPT_HEAD = (
    "\nUse the following retrieved memories\n\n"
    "Consider a memory relevant if: \n"
    "        1. It's in the list under the HIGHLY RELEVANT INFORMATION \n"
    "         2. The ones with higher score are to be used first \n"
    "         3. Other memories in ADDITIONAL [category] INFORMATION are here to support the memories selected in 1. and 2.\n"
)
PROMPT_TAIL = "\nUSE THE INFORMATION ABOVE TO ANSWER THE QUERY, PRIORITIZING THE HIGHLY RELEVANT INFORMATION.\n"
PROMPT_NOTE = (
    "IMPORTANT: Pay careful attention to the HIGHLY RELEVANT INFORMATION section below, "
    "which directly answers the query.\n\n"
)


def insert_memory(messages: Column, memory_text: Column) -> Column:
    """Insert a memory message before the last user message of ``array<struct<role, content>>``."""
    users = F.filter(
        F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull()
    )
    note = F.struct(F.lit("memory").alias("role"), F.concat(F.lit(PROMPT_NOTE), memory_text).alias("content"))
    return let(
        F.array_max(users),
        lambda at: F.when(at.isNull(), messages).otherwise(
            F.concat(
                F.filter(messages, lambda m, i: i < at), F.array(note), F.filter(messages, lambda m, i: i >= at)
            )
        ),
    )


def unread_text(tokens: Column, cursor: Column) -> Column:
    """Text behind a read cursor."""
    return F.when(cursor >= F.size(tokens), "").otherwise(
        F.array_join(F.filter(tokens, lambda t, i: i >= cursor), "")
    )


def exchanges(turns: DataFrame, keys: list[str], order: list[str], block: Column | None, text: str = "text") -> DataFrame:
    """Assistant turns with the user text right before them as ``query``."""
    pair = F.struct(F.col("role").alias("role"), F.col(text).alias("text"))
    prev = F.get("_prev", F.lit(0))
    return (
        with_previous(turns, keys, order, block, pair, 1, "_prev")
        .filter(F.col("role") == "assistant")
        .withColumn("query", F.when(prev["role"] == "user", prev["text"]))
        .drop("_prev")
    )


def recent_context(df: DataFrame, keys: list[str], order: list[str], block: Column | None, columns: list[str], keep: int = 5) -> DataFrame:
    """Add ``history``: the last ``keep`` exchanges including this one, oldest first."""
    row = F.struct(*columns)
    return (
        with_previous(df, keys, order, block, row, keep - 1, "_prev")
        .withColumn("history", F.concat("_prev", F.array(row)))
        .drop("_prev")
    )
