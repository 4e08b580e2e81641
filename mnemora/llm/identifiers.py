"""Personal data: fixed patterns seed a bootstrapped contextual extraction, in DataFrame expressions only.

The fixed patterns give the base spans. Their texts are the seed instances; the two words before
a span in the whole text are its pattern. Patterns and instances form a graph over the whole corpus, which is scored
in rounds: a pattern is trusted by the share of its instances that are known, an instance by the
patterns around it, and trusted instances are known in the next round. Identifier-like runs of tokens that
a trusted pattern introduces and whose score is high enough become spans too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import let, running_sums, saved

# Kinds in the order of the report. The lookbehind and the possessive loops keep the leftmost,
# longest matches of the plain patterns and make the search linear; \G allows a match right
# after another.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# Cheap tests that a text must pass before a pattern is searched.
MARKS = (r"@", r"[0-9]\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){12}", r"\+[0-9]")
OCTETS = r"^(?:0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
# Stands for every character of a base span while candidates are searched; a noncharacter of Unicode.
TAKEN = "\ufdd0"
_TOKEN = rf"(?=[^\s0-9@{TAKEN}]*+[0-9])[^\s@{TAKEN}]++(?![^\s])"
_JOIN = r"(?<=[0-9A-Za-z().-])\x20++(?:[().-]++\x20++)?"
# A run of neighbouring tokens with a digit, or one token with an at sign.
CANDIDATE = rf"(?<![^\s])(?:{_TOKEN}(?:{_JOIN}{_TOKEN})*+|(?=[^\s@{TAKEN}]*+@)[^\s{TAKEN}]++(?![^\s]))"
CONTEXT_CHARS, CONTEXT_WORDS = 64, 2

# A pattern is trusted with MIN_SEEDS distinct known instances and this share of known ones.
MIN_SEEDS, PATTERN_TRUST, INSTANCE_TRUST, ROUNDS = 3, 0.5, 0.8, 3

SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string,pattern:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    count = F.length(_digits(value))
    return (
        F.lit(True),
        value.rlike(OCTETS),
        F.when(count.between(13, 19), luhn(_digits(value))).otherwise(False),
        count.between(9, 15),
    )[kind]


def _valid_of(kind: int):
    return lambda span: _valid(kind, span["value"])


def context(before: Column) -> Column:
    """The last words of the text before a span, lower-cased; empty where there are none."""
    words = F.filter(F.split(F.lower(F.right(before, F.lit(CONTEXT_CHARS))), r"\s+"), lambda w: w != "")
    last = let(words, lambda w: F.slice(w, F.greatest(F.size(w) - CONTEXT_WORDS + 1, F.lit(1)), F.lit(CONTEXT_WORDS)))
    return F.array_join(last, " ")


def before(text: Column, start: Column) -> Column:
    """The last characters of a text before a place, whatever other spans they hold."""
    first = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    return F.substring(text, (first + 1).cast("int"), (start - first).cast("int"))


def _found(text: Column, pattern: str, mark: str, kind: int | None, keep, source: Column | None = None) -> Column:
    """All matches as spans of code points, with the context before each.

    Splitting at the matches gives the texts between them, whose lengths give the positions. The context
    is read from ``source``, a text of the same places, if it is given.
    """
    source = text if source is None else source

    def spans(parts: Column, hits: Column) -> Column:
        steps = F.transform(hits, lambda h, i: (F.length(h) + F.length(F.get(parts, i))).cast("bigint"))
        return let(
            let(steps, running_sums),
            lambda sums: F.transform(
                hits,
                lambda h, i: F.struct(
                    F.lit(kind).cast("int").alias("kind"),
                    (F.get(sums, i) + F.length(F.get(parts, i))).alias("start"),
                    (F.get(sums, i) + F.length(F.get(parts, i)) + F.length(h)).alias("end"),
                    h.alias("value"),
                    context(before(source, F.get(sums, i) + F.length(F.get(parts, i)))).alias("pattern"),
                ),
            ),
        )

    all_hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    found = let(F.split(text, pattern, -1), lambda parts: let(all_hits, lambda hits: spans(parts, hits)))
    return F.when(text.rlike(mark), F.filter(found, keep)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by kind and start."""
    each = [
        _found(text, p, m, k, _valid_of(k))
        for k, (p, m) in enumerate(zip(PATTERNS, MARKS, strict=True))
    ]
    return F.concat(*each)


def without_spans(text: Column, spans: Column) -> Column:
    """The text with every character of a span replaced by TAKEN, so that places stay."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(s["start"], acc["at"])
        gap = F.substring(text, acc["at"].cast("int") + 1, (start - acc["at"]).cast("int"))
        parts = F.concat(acc["out"], F.array(gap, F.repeat(F.lit(TAKEN), (s["end"] - start).cast("int"))))
        return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), parts.alias("out"))).otherwise(acc)

    def rest(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"].cast("int") + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(by_start, zero, step, rest)).otherwise(text)


def candidate_spans(text: Column, base: Column) -> Column:
    """Runs of tokens with a digit, and tokens with an at sign, without the punctuation around them.

    Neighbouring tokens with a digit are one candidate if blanks, dots, hyphens or brackets join them, so
    an identifier in groups is whole. Tokens that a base span touches take no part and end a run.
    """
    trim = lambda s: let(
        F.length(F.regexp_extract(s["value"], "^[^0-9A-Za-z+@]*+", 0)),
        lambda lead: let(
            F.regexp_extract(s["value"], "[0-9A-Za-z+@](?:.*[0-9A-Za-z])?", 0),
            lambda value: F.struct(
                s["kind"],
                (s["start"] + lead).alias("start"),
                (s["start"] + lead + F.length(value)).alias("end"),
                value.alias("value"),
                F.when(lead > 0, context(before(text, s["start"] + lead))).otherwise(s["pattern"]).alias("pattern"),
            ),
        ),
    )
    free = without_spans(text, base)
    trimmed = let(free, lambda f: F.transform(_found(f, CANDIDATE, "[0-9@]", None, lambda s: F.lit(True), text), trim))
    return F.filter(trimmed, lambda s: s["value"] != "")


def scored_graph(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind) and known instances (value, kind) of edges (pattern, value, kind).

    ``edges`` has each pair once, its kind is null for values no fixed pattern matched. Counts and
    products are aggregates; every round is written to the shared folder.
    """
    known = edges.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind"))
    pairs = edges.select("pattern", "value")
    for _ in range(rounds):
        held = pairs.join(known, "value", "left")
        counts = held.groupBy("pattern").agg(
            F.count("*").alias("total"),
            *[F.count(F.when(F.col("kind") == k, True)).alias(f"k{k}") for k in range(len(KINDS))],
        )
        best = F.array_max(F.array(*[F.struct(F.col(f"k{k}").alias("n"), F.lit(k).alias("kind")) for k in range(len(KINDS))]))
        patterns = (
            counts.select("pattern", "total", best.alias("best"))
            .select("pattern", F.col("best.kind").alias("kind"), "best.n", (F.col("best.n") / F.col("total")).alias("trust"))
            .where((F.col("n") >= MIN_SEEDS) & (F.col("trust") >= PATTERN_TRUST))
        )
        patterns = saved(patterns.select("pattern", "kind", "trust"), "patterns")
        doubt = F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.99)))))
        instances = (
            pairs.join(patterns, "pattern")
            .groupBy("value", "kind")
            .agg((1 - doubt).alias("score"))
            .where(F.col("score") >= INSTANCE_TRUST)
            .groupBy("value")
            .agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        )
        known = saved(known.union(instances.join(known, "value", "left_anti")), "known")
    return patterns.select("pattern", "kind"), known


def found_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, text_key (hash of the text), base and spans, arrays of (kind, start, end).

    Spans count code points, the end is exclusive; both arrays are ordered by kind and start, and
    ``spans`` holds all of ``base``. Null and empty texts have none. Repeated rows get the same
    spans each; ids may be null or repeated, since rows are told apart by id and text. Other
    columns are ignored, an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("more", candidate_spans(F.col("text"), F.col("base")))
    rows = saved(rows.select("doc_id", "text_key", "base", "more"), "spans")

    each = rows.select(F.explode(F.concat("base", "more")).alias("s")).select("s.pattern", "s.value", "s.kind")
    edges = each.where("pattern <> ''").groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    patterns, known = scored_graph(saved(edges, "edges"), rounds)

    new = (
        rows.select("doc_id", "text_key", F.explode("more").alias("s"))
        .select("doc_id", "text_key", "s.start", "s.end", "s.pattern", "s.value")
        .join(patterns, "pattern")
        .join(known, ["value", "kind"])
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))
    )
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key"))
    plain = F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    joined = rows.alias("l").join(new.alias("r"), same, "left")
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return joined.select(
        "l.doc_id", "l.text_key", plain.alias("base"), F.coalesce("found", empty).alias("found")
    ).select("doc_id", "text_key", "base", F.array_sort(F.concat("base", "found")).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def identifier_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found_spans(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        parts = F.concat(acc["out"], F.array(gap, F.get(names, s["kind"])))
        return F.when(
            s["start"] >= acc["at"], F.struct(s["end"].alias("at"), parts.alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    def rest(acc: Column) -> Column:
        tail = F.substring(text, acc["at"].cast("int") + 1, F.length(text))
        return F.concat(F.array_join(acc["out"], ""), tail)

    return F.when(F.size(spans) > 0, F.aggregate(by_start, zero, step, rest)).otherwise(text)


def mask_identifiers(docs: DataFrame) -> DataFrame:
    """The documents with every span masked; all columns stay, n_chars follows the text if it is there.

    A null text stays null. Rows keep their struct while they are joined, so no name can clash.
    """
    spans = found_spans(docs).where(F.size("spans") > 0).select("doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"])
    row = docs.select(F.struct("*").alias("row"))
    key = F.xxhash64(F.coalesce("row.text", F.lit("")))
    same = F.col("row.doc_id").eqNullSafe(F.col("s.doc_id")) & (key == F.col("s.text_key"))
    joined = row.join(spans.alias("s"), same, "left").select("row", "spans")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(masked(F.col("row.text"), F.col("spans")))
    changed = joined.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        changed = changed.withColumn(
            "row", F.col("row").withField("n_chars", F.coalesce(F.length("row.text").cast(docs.schema["n_chars"].dataType), "row.n_chars"))
        )
    return changed.select("row.*")
