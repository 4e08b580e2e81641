"""Text quality and repetition measures as Column expressions.

Every measure works on one row: texts are split into arrays and counted by
sorting inside the row, so no word ever crosses the network and a long or
frequent text cannot form a hot group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions import rules
from mnemora.functions.arrays import indexes, keep_first, let, run_starts, total, value_counts

SPACE = r"(?U)\s+"
WORD = r"[\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rules.java(pattern))


def tokens(text: Column) -> Column:
    """Whitespace tokens."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def words(text: Column) -> Column:
    """Maximal runs of letters, digits and underscore."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def contains_any(text: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


# ---------------------------------------------------------------- entropy and repetition


def length_class_entropy(toks: Column, classes: Callable[[Column], Column] | None = None) -> Column:
    """Shannon entropy (bits) over token classes; 0 below five tokens.

    The default class is the token length in steps of three, capped at 5. A
    part-of-speech tagger can be given as ``classes`` (token -> class column).
    """
    pick = classes or (lambda t: F.least(F.lit(5), F.floor(F.length(t) / 3).cast("int")))
    n = F.size(toks).cast("double")
    entropy = total(
        F.transform(
            value_counts(F.transform(toks, pick)),
            lambda c: -(c["n"] / n) * F.log2(c["n"] / n),
        )
    )
    return F.when(F.size(toks) < 5, F.lit(0.0)).otherwise(entropy)


def repetition_score(toks: Column) -> Column:
    """Uncapped penalty for repeated words (0.1 each beyond two) and bigrams (0.3 each beyond one)."""
    low = F.transform(toks, F.lower)
    stop = F.array(*[F.lit(w) for w in rules.COMMON_WORDS])
    word_part = total(
        F.transform(
            value_counts(low),
            lambda c: F.when((c["n"] > 2) & ~F.array_contains(stop, c["value"]), (c["n"] - 2) * 0.1).otherwise(0.0),
        )
    )
    pair_part = let(
        low,
        lambda w: total(
            F.transform(
                value_counts(
                    F.transform(
                        indexes(F.size(w) - 1),
                        lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)),
                    )
                ),
                lambda c: F.when(c["n"] > 1, (c["n"] - 1) * 0.3).otherwise(0.0),
            )
        ),
    )
    return word_part + pair_part


def sentence_shape_score(text: Column) -> Column:
    """0.3 for every further sentence with the same length, first and last word."""

    def shape(sentence: Column) -> Column:
        return let(
            tokens(sentence),
            lambda t: F.when(
                F.size(t) > 2,
                F.concat_ws(
                    "-", F.size(t).cast("string"), F.lower(F.get(t, 0)), F.lower(F.get(t, F.size(t) - 1))
                ),
            ),
        )

    shapes = F.filter(F.transform(F.split(text, r"\."), shape), lambda s: s.isNotNull())
    return total(
        F.transform(value_counts(shapes), lambda c: F.when(c["n"] > 1, (c["n"] - 1) * 0.3).otherwise(0.0))
    )


def tag_sequence_score(tags: Column) -> Column:
    """Transition-diversity penalty and longest-run penalty of a tag sequence.

    ``tags`` is an array of part-of-speech tags from any tagger column; the first
    two characters count. Returns ``struct<transition_score, run_score>``.
    """
    short = F.transform(tags, lambda t: F.substring(t, 1, 2))
    return let(
        short,
        lambda s: let(
            F.transform(indexes(F.size(s) - 1), lambda i: F.concat_ws("->", F.get(s, i), F.get(s, i + 1))),
            lambda tr: let(
                run_starts(s, lambda a, b: a == b),
                lambda st: F.struct(
                    F.when(
                        (F.size(tr) > 0) & (F.size(F.array_distinct(tr)) / F.size(tr) < 0.3),
                        (F.lit(0.3) - F.size(F.array_distinct(tr)) / F.size(tr)) * 2.0,
                    )
                    .otherwise(0.0)
                    .alias("transition_score"),
                    F.greatest(
                        F.lit(0.0),
                        (
                            F.coalesce(
                                F.array_max(
                                    F.transform(st, lambda p, j: F.coalesce(F.get(st, j + 1), F.size(s)) - p)
                                ),
                                F.lit(0),
                            )
                            - 4
                        )
                        * 0.2,
                    ).alias("run_score"),
                ),
            ),
        ),
    )


def quality_issues(text: Column) -> Column:
    """Uncapped penalty: no closing mark, many tiny sentences, many special characters."""
    open_end = F.when(matches(text, r"[.!?]\s*\z"), 0.0).otherwise(0.2)
    parts = F.transform(F.split(text, r"[.!?]+"), lambda s: F.size(tokens(s)))
    tiny = let(
        parts,
        lambda p: F.size(F.filter(p, lambda k: (k > 0) & (k < 3))) / F.size(p),
    )
    special = F.length(F.regexp_replace(text, r"(?U)[a-zA-Z0-9\s.,!?]+", "")) / F.greatest(F.lit(1), F.length(text))
    return (
        open_end
        + let(tiny, lambda r: F.when(r > 0.3, r * 0.5).otherwise(0.0))
        + let(special, lambda r: F.when(r > 0.1, r * 2.0).otherwise(0.0))
    )


def severe_overflow(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in rules.SEVERE_PATTERNS:
        hit = hit | matches(text, pattern)
    return hit


def with_content_entropy(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``entropy, base_entropy, severity, repetition_score, pattern_score,
    quality_issues, pos_transition_score, token_count`` for a text column."""
    t = F.col(text)
    staged = (
        df.withColumn("_tok", tokens(t))
        .withColumn("_base", length_class_entropy(F.col("_tok")))
        .withColumn("_rep", repetition_score(F.col("_tok")))
        .withColumn("_shape", sentence_shape_score(t))
        .withColumn("_qual", quality_issues(t))
        .withColumn("_severe", severe_overflow(t))
    )
    brief = F.size("_tok") < 3
    repeated = (F.col("_base") < 1.0) & (F.col("_rep") > 0.5)
    garbled = (F.col("_base") > 2.0) & (F.col("_qual") > 0.3)
    severity = F.least(
        F.lit(1.0),
        F.when(repeated, 0.3).otherwise(0.0)
        + F.when(garbled, 0.4).otherwise(0.0)
        + F.col("_rep") * 0.3
        + F.col("_shape") * 0.3
        + F.col("_qual") * 0.2,
    )
    return staged.select(
        *[F.col(c) for c in df.columns],
        F.when(brief, 0.5)
        .otherwise(F.col("_base") * F.when(repeated, 0.7).otherwise(1.0) * F.when(garbled, 1.5).otherwise(1.0))
        .alias("entropy"),
        F.when(brief, F.lit(None)).otherwise(F.col("_base")).alias("base_entropy"),
        F.when(brief, 0.3)
        .when(F.col("_severe"), F.greatest(severity, F.lit(0.8)))
        .otherwise(severity)
        .alias("severity"),
        F.when(brief, 0.0).otherwise(F.least(F.lit(1.0), F.col("_rep"))).alias("repetition_score"),
        F.when(brief, 0.0)
        .otherwise(F.least(F.lit(1.0), F.col("_shape") + F.when(F.col("_severe"), 0.5).otherwise(0.0)))
        .alias("pattern_score"),
        F.when(brief, F.lit(None)).otherwise(F.least(F.lit(1.0), F.col("_qual"))).alias("quality_issues"),
        F.lit(0.0).alias("pos_transition_score"),
        F.size("_tok").alias("token_count"),
    )


# ---------------------------------------------------------------- repeated phrases and patterns


def _repeats(word_list: Column, n: Column) -> Column:
    """n-grams seen three times or more, as ``struct<n, pos, gram>`` with the first position."""
    grams = F.sort_array(
        F.transform(
            indexes(F.size(word_list) - n + 1),
            lambda i: F.struct(F.array_join(F.slice(word_list, i + 1, n), " ").alias("g"), i.alias("i")),
        )
    )
    return let(
        grams,
        lambda s: let(
            run_starts(s, lambda a, b: a["g"] == b["g"]),
            lambda st: F.filter(
                F.transform(
                    st,
                    lambda p, j: F.when(
                        F.coalesce(F.get(st, j + 1), F.size(s)) - p >= 3,
                        F.struct(n.alias("n"), F.get(s, p)["i"].alias("pos"), F.get(s, p)["g"].alias("gram")),
                    ),
                ),
                lambda r: r.isNotNull() & (F.length(r["gram"]) >= 10),
            ),
        ),
    )


def _may_repeat(word_list: Column, n: Column) -> Column:
    """True when some hashed n-gram occurs three times: a longer repeat implies a shorter one."""
    return let(
        F.sort_array(
            F.transform(indexes(F.size(word_list) - n + 1), lambda i: F.xxhash64(F.slice(word_list, i + 1, n)))
        ),
        lambda h: F.exists(indexes(F.size(h) - 2), lambda i: F.get(h, i) == F.get(h, i + 2)),
    )


def repeated_phrases(text: Column) -> Column:
    """Up to five phrases that occur at least three times, shortest and earliest first."""
    none = F.array().cast("array<struct<n:int,pos:int,gram:string>>")

    def phrases(w: Column) -> Column:
        many = F.size(w) > 1000
        low = F.when(many, 3).otherwise(5)
        high = F.least(F.lit(9), F.floor(F.size(w) / 3).cast("int") - 1)
        sizes = F.when(many, F.array(*[F.lit(x) for x in (3, 5, 7)])).when(
            high >= 5, F.sequence(F.lit(5), high)
        ).otherwise(F.array().cast("array<int>"))
        found = F.slice(F.sort_array(F.flatten(F.transform(sizes, lambda n: _repeats(w, n)))), 1, 5)
        return F.when((many | (high >= 5)) & _may_repeat(w, low), found).otherwise(none)

    return F.when(F.length(text) < 100, none).otherwise(let(words(F.lower(text)), phrases))


def duplicate_lines(text: Column) -> Column:
    """True when a line repeats at least three times in a row.

    The first copy may end a longer line and the last may start one; this is what a
    back-referencing search finds, in one pass over neighbouring lines.
    """
    return let(
        F.split(text, "\n"),
        lambda ln: F.exists(
            indexes(F.size(ln) - 2),
            lambda i: (F.get(ln, i + 1) != "")
            & F.endswith(F.get(ln, i), F.get(ln, i + 1))
            & F.startswith(F.get(ln, i + 2), F.get(ln, i + 1)),
        ),
    )


def repeated_characters(text: Column) -> Column:
    """True when one character occurs nine times in a row."""
    return text.rlike(r"(?d)(.)\1{8}")


def first_garbage_pattern(text: Column) -> Column:
    """Name of the first garbage pattern in the text, else NULL."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(rules.GARBAGE_PATTERNS):
        found = F.when(matches(text, pattern), name).otherwise(found)
    return found


def repetitive_pattern(text: Column) -> Column:
    """The first kind of repetition found, else NULL; texts under 20 characters are skipped."""
    later = (
        F.when(repeated_characters(text), "repeated_characters")
        .when(duplicate_lines(text), "duplicate_lines")
        .when((F.length(text) > 200) & (F.size(repeated_phrases(text)) >= 3), "repetitive_phrases")
    )
    return F.when(F.length(text) >= 20, F.coalesce(first_garbage_pattern(text), later))


def overflow_patterns(text: Column) -> Column:
    """Names of all overflow signs found, ``array<string>``."""
    names = [
        F.when(matches(text, pattern), f"pattern_{i}") for i, pattern in enumerate(rules.OVERFLOW_PATTERNS)
    ]
    names.append(F.when(F.size(repeated_phrases(text)) >= 3, "repetitive_phrases"))
    return F.array_compact(F.array(*names))


def overflow_matches(text: Column) -> Column:
    """Up to three matched texts for every overflow sign."""
    found = [
        F.slice(F.regexp_extract_all(text, F.lit(rules.java(p)), F.lit(0)), 1, 3) for p in rules.OVERFLOW_PATTERNS
    ]
    return F.flatten(F.array(*found))


# ---------------------------------------------------------------- sentence structure


def sentences(text: Column) -> Column:
    """Sentences split after a closing mark and white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?U)[.!?]\s+"), strip), lambda s: s != "")


def malformed_count(sents: Column) -> Column:
    """Sentences of five words or more without a subject-verb shape."""
    return F.size(
        F.filter(sents, lambda s: (F.size(tokens(s)) >= 5) & ~matches(s, rules.starting(rules.SUBJECT_VERB, "A-Z")))
    )


def section_quality(section: Column) -> Column:
    """0.7 x share of distinct words + 0.15 for punctuation + 0.15 for a capitalised word."""
    return let(
        words(section),
        lambda w: (F.size(F.array_distinct(w)) / F.greatest(F.lit(1), F.size(w))) * 0.7
        + F.when(F.contains(section, F.lit(".")) | F.contains(section, F.lit(",")), 0.15).otherwise(0.0)
        + F.when(matches(section, rules.starting(rules.CAPITALISED_WORD, "A-Z")), 0.15).otherwise(0.0),
    )


def section_qualities(sents: Column) -> Column:
    """Quality of begin, middle and end for long texts, of groups of three sentences for others."""

    def wide(s: Column) -> Column:
        n = F.size(s)
        size = F.greatest(F.lit(5), F.floor(n / 5).cast("int"))
        half = F.floor(size / 2).cast("int")
        mid = F.floor(n / 2).cast("int")
        return F.array(
            F.slice(s, F.lit(1), size), F.slice(s, mid - half + 1, half * 2), F.slice(s, n - size + 1, size)
        )

    def narrow(s: Column) -> Column:
        return F.transform(
            indexes(F.ceil(F.size(s) / 3).cast("int")), lambda i: F.slice(s, i * 3 + 1, F.lit(3))
        )

    joined = F.transform(
        F.when(F.size(sents) > 20, wide(sents)).otherwise(narrow(sents)), lambda part: F.array_join(part, " ")
    )
    kept = F.filter(joined, lambda part: F.length(part) >= 20)
    return F.when(F.size(sents) < 5, F.array().cast("array<double>")).otherwise(
        F.transform(kept, section_quality)
    )


def structure_declines(qualities: Column) -> Column:
    """The last of at least three sections lost over 40 % against the first."""
    return (F.size(qualities) >= 3) & (
        F.get(qualities, F.size(qualities) - 1) < F.get(qualities, F.lit(0)) * 0.6
    )


def with_content_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``is_low_quality, quality_issue_names, quality_score`` from all sentences of a text."""
    t = F.col(text)
    staged = (
        df.withColumn("_sent", sentences(t))
        .withColumn("_n", F.size("_sent"))
        .withColumn("_ratio", F.when(F.col("_n") > 0, malformed_count(F.col("_sent")) / F.col("_n")).otherwise(0.0))
        .withColumn("_down", (F.col("_n") >= 10) & structure_declines(section_qualities(F.col("_sent"))))
        .withColumn("_judged", (F.length(strip(t)) >= 50) & (F.col("_n") >= 3))
    )
    bad_ratio = F.col("_judged") & (F.col("_ratio") > 0.3)
    bad_shape = F.col("_judged") & F.col("_down")
    score = (
        F.lit(1.0) - F.when(bad_ratio, F.col("_ratio")).otherwise(0.0) - F.when(bad_shape, 0.3).otherwise(0.0)
    )
    return staged.select(
        *[F.col(c) for c in df.columns],
        (bad_ratio | bad_shape).alias("is_low_quality"),
        F.concat_ws(
            ",",
            F.when(bad_ratio, "high_malformed_sentence_ratio"),
            F.when(bad_shape, "structure_deterioration"),
        ).alias("quality_issue_names"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("quality_score"),
    )


def paragraph_structure(text: Column) -> Column:
    """``struct<n_sections, drops, deteriorated>`` over paragraphs, or sentences when there are none."""

    def judge(parts: Column) -> Column:
        kept = F.filter(
            F.transform(
                parts,
                lambda p, i: F.when(
                    F.length(strip(p)) >= 20, F.struct(i.alias("i"), section_quality(p).alias("q"))
                ),
            ),
            lambda s: s.isNotNull(),
        )
        return let(
            kept,
            lambda k: let(
                F.transform(k, lambda s: s["q"]),
                lambda q: let(
                    F.size(
                        F.filter(
                            indexes(F.size(k)),
                            lambda j: (F.get(k, j)["i"] > 0)
                            & (F.get(q, j) < F.when(j > 0, F.get(q, j - 1)).otherwise(1.0) * 0.7),
                        )
                    ),
                    lambda drops: F.struct(
                        F.size(q).alias("n_sections"),
                        drops.alias("drops"),
                        (
                            (drops >= 2)
                            | (
                                (F.size(q) >= 3)
                                & (
                                    _mean(F.slice(q, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(q) / 3).cast("int"))))
                                    * 0.6
                                    > _mean(
                                        F.slice(
                                            q,
                                            F.size(q) - F.ceil(F.size(q) / 3).cast("int") + 1,
                                            F.ceil(F.size(q) / 3).cast("int"),
                                        )
                                    )
                                )
                            )
                        ).alias("deteriorated"),
                    ),
                ),
            ),
        )

    # an empty array cannot be sliced from its end, so texts without sections are answered first
    paragraphs = F.split(text, "\n\n")
    parts = F.when(F.size(paragraphs) > 1, paragraphs).otherwise(F.split(text, r"(?U)(?<=[.!?])\s+"))
    return judge(parts)


def _mean(values: Column) -> Column:
    return total(values) / F.size(values)


def sentence_topics(text: Column) -> Column:
    """Capitalised sentence starts and noun phrases before a verb, sorted, at most five."""
    starts = F.filter(
        F.transform(F.split(text, r"(?U)[.!?]\s+"), lambda s: F.get(tokens(s), F.lit(0))),
        lambda w: w.isNotNull() & (F.length(w) > 3) & w.rlike(r"^\p{Lu}"),
    )
    phrases = F.regexp_extract_all(text, F.lit(rules.java(rules.starting(rules.TOPIC_VERB_PHRASE, "A-Z"))), F.lit(0))
    return F.slice(F.sort_array(F.array_distinct(F.concat(starts, phrases))), 1, 5)


def without_repeated_paragraphs(text: Column) -> Column:
    """Drop paragraphs already seen (ignoring case and punctuation) and similarity debug notes."""

    def rebuild(lines: Column) -> Column:
        blank = F.transform(lines, lambda ln: strip(ln) == "")
        return let(
            blank,
            lambda b: let(
                F.filter(
                    indexes(F.size(lines)), lambda i: F.get(b, i) | (i == 0) | F.coalesce(F.get(b, i - 1), F.lit(False))
                ),
                lambda st: let(
                    F.transform(
                        st,
                        lambda p, j: F.when(F.get(b, p), F.lit("")).otherwise(
                            F.array_join(
                                F.slice(lines, p + 1, F.coalesce(F.get(st, j + 1), F.size(lines)) - p), "\n"
                            )
                        ),
                    ),
                    lambda para: let(
                        F.transform(
                            para,
                            lambda p, i: let(
                                F.regexp_replace(F.lower(p), r"(?U)[^\w\s]", ""),
                                # blank keys are never duplicates: give each its own
                                lambda k: F.when(k == "", F.concat(F.lit("\u0001"), i.cast("string"))).otherwise(k),
                            ),
                        ),
                        lambda keys: F.array_join(
                            F.transform(keep_first(keys), lambda i: F.get(para, i)), "\n"
                        ),
                    ),
                ),
            ),
        )

    cleaned = let(F.split(text, "\n"), rebuild)
    return F.regexp_replace(
        cleaned, r"(?U)(?:relevance|similarity)\s+(?:increased|decreased)\s+by\s+[\d.]+%", ""
    )


def may_be_repetitive(text: Column) -> Column:
    """False only when no prefix of the text can show a repetition.

    A prefix with a garbage pattern, a character run or repeated lines leaves them in the
    text, and a phrase of three words or more that repeats in a prefix makes three words repeat.
    """
    return (
        first_garbage_pattern(text).isNotNull()
        | repeated_characters(text)
        | duplicate_lines(text)
        | let(words(F.lower(text)), lambda w: _may_repeat(w, F.lit(3)))
    )


def prefix_checkpoints(token_count: Column) -> Column:
    """Token counts at which a growing answer is checked: 40, 80, 160, then every 100."""
    grid = F.concat(
        F.array(F.lit(40), F.lit(80)),
        F.when(token_count >= 160, F.sequence(F.lit(160), token_count, F.lit(100))).otherwise(
            F.array().cast("array<int>")
        ),
    )
    return F.filter(grid, lambda p: p <= token_count)


def _first_true(count: Column, holds: Callable[[Column], Column]) -> Column:
    """The smallest index below ``count`` where a condition holds that stays true from there on; else ``count``.

    The last index is looked at first, then the middle of what is left.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(count + 1)).cast("int"))

    def step(acc: Column, i: Column) -> Column:
        middle = F.when(i == 0, acc["high"] - 1).otherwise(F.shiftright(acc["low"] + acc["high"], 1))
        narrower = let(
            middle,
            lambda m: F.when(holds(m), F.struct(acc["low"].alias("low"), m.alias("high"))).otherwise(
                F.struct((m + 1).alias("low"), acc["high"].alias("high"))
            ),
        )
        return F.when(acc["low"] < acc["high"], narrower).otherwise(acc)

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), count.alias("high")), step, lambda acc: acc["high"])


def first_repetition(toks: Column, points: Column) -> Column:
    """``struct<pattern, at>``: the first of the ascending token counts whose prefix shows a repetition; NULL if none does.

    A kind of repetition that a prefix shows stays in longer ones, but for phrases, whose sizes change beyond 1,000
    words. So both parts of the points are halved until the first one is found, and few prefixes are looked at.
    """
    prefix = lambda at: F.array_join(F.slice(toks, F.lit(1), at), " ")

    def first(part: Column) -> Column:
        """Of points on one side of 1,000 words."""
        shown = lambda i: repetitive_pattern(prefix(F.get(part, i))).isNotNull()
        return let(_first_true(F.size(part), shown), lambda i: F.get(part, i))

    def search(p: Column) -> Column:
        cut = _first_true(F.size(p), lambda i: F.size(words(F.lower(prefix(F.get(p, i))))) > 1000)
        return let(
            cut,
            lambda c: F.coalesce(
                let(F.slice(p, F.lit(1), c), first), let(F.slice(p, c + 1, F.size(p) - c), first)
            ),
        )

    found = F.when(may_be_repetitive(F.array_join(toks, " ")), let(points, search))
    return let(found, lambda at: F.when(at.isNotNull(), F.struct(repetitive_pattern(prefix(at)).alias("pattern"), at.alias("at"))))
