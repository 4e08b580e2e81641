"""Rule-based classification and metadata enrichment as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions import rules
from mnemora.functions.arrays import let, value_counts
from mnemora.functions.terms import term_hits
from mnemora.functions.text import contains_any, matches, strip, tokens


def leading_words(pattern: str) -> list[str]:
    """The literals one of which every match of a rule pattern starts with."""
    body = pattern.removeprefix(r"\b")
    if body.startswith("("):
        return body[1 : body.index(")")].split("|")
    return [body.split(r"\b")[0]]


def _quick(pattern: str) -> str:
    return rules.starting(pattern, "".join(sorted({w[0] for w in leading_words(pattern)})))


def _mentions(text: Column, literals: list[str]) -> Column:
    """Any of many literals occurs; a loop over a constant array keeps generated code small."""
    return F.exists(F.array(*[F.lit(w) for w in literals]), lambda w: F.contains(text, w))


def _first_rule(text: Column, table: list[tuple[str, str]]) -> Column:
    """First matching rule. Plain substring tests settle most texts before any pattern is tried."""
    found = F.lit(None).cast("string")
    for category, pattern in reversed(table):
        found = F.when(matches(text, _quick(pattern)), category).otherwise(found)
    literals = sorted({w for _, pattern in table for w in leading_words(pattern)})
    return F.when(_mentions(text, literals), found)


def rule_category(text: Column) -> Column:
    """Category of the first matching rule on the lower-cased text, else NULL."""
    return let(F.lower(text), lambda low: _first_rule(low, rules.CATEGORY_RULES))


def content_category(text: Column, fallback: Column | None = None, ruled: Column | None = None) -> Column:
    """Rule category, then ``fallback`` (for example a trained model's label), then plain heuristics."""
    steps = [rule_category(text) if ruled is None else ruled]
    if fallback is not None:
        steps.append(F.when(fallback != "unknown", fallback))
    steps.append(let(F.lower(text), lambda low: _first_rule(low, rules.CONTENT_RULES)))
    blank = strip(text) == ""
    return F.when(blank | text.isNull(), "unknown").otherwise(F.coalesce(*steps, F.lit("unknown")))


def rule_confidence(category: Column) -> Column:
    return F.when(category.isNotNull(), 0.95)


def stem(word: str) -> str:
    """Default related term of a subcategory word: long words lose their last three letters."""
    return word[:-3] if len(word) >= 7 else word


def taxonomy(related: dict[str, list[str]] | None = None) -> list[tuple[str, str, list[str]]]:
    """(category, subcategory, related terms) rows in match order.

    ``related`` gives the terms of each subcategory; without it they follow from the
    subcategory's own words by :func:`stem`.
    """
    rows = []
    for category, names in rules.SUBCATEGORIES.items():
        for name in names:
            terms = (related or {}).get(name) or [stem(w) for w in name.split("_")]
            rows.append((category, name, terms))
    return rows


def taxonomy_words(rows: list[tuple[str, str, list[str]]]) -> list[str]:
    """All that a text is searched for: names, their words and related terms, each once."""
    found: dict[str, None] = {}
    for _, name, terms in rows:
        found |= dict.fromkeys([name.replace("_", " "), *terms, *name.split("_")])
    return list(found)


def subcategory(text: Column, category: Column, rows: list[tuple[str, str, list[str]]] | None = None) -> Column:
    """Best subcategory of a text within its category, ``struct<name, score>``.

    0.7 for a literal mention, 0.3 for any related term; the first best wins. Below 0.3
    the share of the name's words found in the text decides. One pass over the text finds all names and terms.
    """
    rows = rows or taxonomy()
    words = taxonomy_words(rows)
    number = {w: i for i, w in enumerate(words)}
    # one constant map, folded to a literal; a row looks at the entries of its category only
    by_category: dict[str, list[dict]] = {}
    for i, (cat, name, terms) in enumerate(rows):
        entry = {"order": -i, "name": name, "readable": number[name.replace("_", " ")]}
        entry |= {"terms": [number[w] for w in terms], "words": [number[w] for w in name.split("_")]}
        by_category.setdefault(cat, []).append(entry)
    table = F.from_json(
        F.lit(json.dumps(by_category)),
        "map<string,array<struct<order:int,name:string,readable:int,terms:array<int>,words:array<int>>>>",
    )
    entries = F.try_element_at(table, category)

    def result(score: Column, e: Column) -> Column:
        return F.struct(score.alias("score"), e["order"].alias("order"), e["name"].alias("name"))

    def pick(hits: Column) -> Column:
        def mention(e: Column) -> Column:
            direct = F.when(F.array_contains(hits, e["readable"]), 0.7).otherwise(0.0)
            return result(direct + F.when(F.arrays_overlap(hits, e["terms"]), 0.3).otherwise(0.0), e)

        def overlap(e: Column) -> Column:
            return result(F.size(F.filter(e["words"], lambda w: F.array_contains(hits, w))) / F.size(e["words"]), e)

        return let(
            F.array_max(F.transform(entries, mention)),
            lambda best: F.when(best["score"] >= 0.3, best).otherwise(
                let(F.array_max(F.transform(entries, overlap)), lambda o: F.when(o["score"] > best["score"], o))
            ),
        )

    return let(
        let(term_hits(F.lower(text), words), pick),
        lambda f: F.struct(f["name"].alias("name"), F.coalesce(f["score"], F.lit(0.0)).alias("score")),
    )


def category_settings(category: Column, confidence: Column) -> Column:
    """``struct<memory_weight, sharpening_factor, confidence_threshold, retrieval_count>``."""

    def row(values: tuple) -> Column:
        w, s, c, n = values
        return F.struct(
            F.lit(w).alias("memory_weight"),
            F.lit(s).alias("sharpening_factor"),
            F.lit(c).alias("confidence_threshold"),
            F.lit(n).alias("retrieval_count"),
        )

    picked = row(rules.DEFAULT_SETTINGS)
    for cat, values in rules.CATEGORY_SETTINGS.items():
        picked = F.when(category == cat, row(values)).otherwise(picked)
    return F.when(confidence < 0.4, row(rules.UNSURE_SETTINGS)).otherwise(picked)


def item_type(category: Column) -> Column:
    found = F.lit("unknown")
    for cat, kind in rules.CATEGORY_TYPES.items():
        found = F.when(category == cat, kind).otherwise(found)
    return found


def length_class(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 100, "short").when(n < 500, "medium").otherwise("long")


def content_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 10)


def item_id(text: Column, ts: Column) -> Column:
    """``item_<8 hex of md5>_<last 6 digits of the millisecond timestamp>``."""
    millis = F.unix_millis(ts).cast("string")
    return F.concat(F.lit("item_"), F.substring(F.md5(text), 1, 8), F.lit("_"), F.right(millis, F.lit(6)))


def topics(text: Column) -> Column:
    """Up to five topics: capitalised phrases of 4 to 30 characters, then domain terms not yet listed."""
    phrases = F.transform(
        F.filter(
            F.regexp_extract_all(text, F.lit(rules.java(rules.starting(rules.NOUN_PHRASE, "A-Z"))), F.lit(1)),
            lambda m: F.length(m).between(4, 30),
        ),
        F.lower,
    )
    def add_new(hits: Column):
        return lambda t: F.concat(t, F.filter(hits, lambda m: ~F.array_contains(t, m)))

    def listed(low: Column) -> Column:
        found = phrases
        for pattern in rules.DOMAIN_TERMS:
            hits = F.when(
                _mentions(low, leading_words(pattern)),
                F.regexp_extract_all(low, F.lit(rules.java(_quick(pattern))), F.lit(1)),
            ).otherwise(F.array().cast("array<string>"))
            found = let(found, add_new(hits))
        return found

    return F.slice(let(F.lower(text), listed), 1, 5)


def storage_form(text: Column, category: Column) -> Column:
    """Stripped text with a closing mark and, where its category is not evident, a lead-in."""
    bare = strip(text)
    closed = F.when((bare != "") & ~matches(bare, r"[.!?]\z"), F.concat(bare, F.lit("."))).otherwise(bare)

    def lead(t: Column) -> Column:
        out = t
        for cat, below, pattern, prefix in rules.STORAGE_FORMS:
            wanted = (category == cat) & ~matches(F.lower(t), pattern)
            if below is not None:
                wanted = wanted & (F.length(t) < below)
            out = F.when(wanted, F.concat(F.lit(prefix), t)).otherwise(out)
        return out

    return let(closed, lead)


def enrich(df: DataFrame, text: str, ts: Column, category: Column | None = None) -> DataFrame:
    """Format a text for storage and add the stored item's metadata columns."""
    staged = df.withColumn("_rule", rule_category(F.col(text)))
    cat = category if category is not None else content_category(F.col(text), ruled=F.col("_rule"))
    staged = staged.withColumn("main_category", cat).withColumn("_sub", subcategory(F.col(text), F.col("main_category")))
    staged = staged.withColumn("content", storage_form(F.col(text), F.col("main_category")))
    kept = [F.col(c) for c in df.columns if c not in ("content", "main_category")]
    return staged.select(
        *kept,
        "content",
        item_id(F.col("content"), ts).alias("id"),
        "main_category",
        F.col("_sub.name").alias("subcategory"),
        item_type(F.col("main_category")).alias("type"),
        F.when(F.col("_rule").isNotNull(), 0.95).otherwise(0.5).alias("classification_confidence"),
        F.col("_sub.score").alias("subcategory_confidence"),
        length_class(F.col("content")).alias("content_length"),
        content_hash(F.col("content")).alias("content_hash"),
        topics(F.col("content")).alias("topics"),
    )


def key_statements(text: Column) -> Column:
    """Up to five longest statements: factual, procedural, conceptual or about the date."""

    def wanted(s: Column) -> Column:
        factual = matches(s, r"^[A-Z].*?(?:is|are|was|were|has|have)\b") & contains_any(
            s, [" is ", " are ", " was ", " have "]
        )
        steps = matches(s, r"(?i)\b(?:first|then|next|finally|step|process)\b")
        ideas = matches(s, r"(?i)\b(?:concept|theory|principle|means|refers to)\b")
        dated = matches(F.lower(s), r"\b(?:today|current date|the date|time is)\b") & matches(
            F.lower(s), r"\b(?:is|was)\b"
        )
        return factual | steps | ideas | dated

    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip)
    kept = F.array_distinct(
        F.filter(parts, lambda s: (F.length(s) >= 15) & ~F.endswith(s, F.lit("?")) & wanted(s))
    )
    ranked = F.sort_array(
        F.transform(kept, lambda s, i: F.struct((-F.length(s)).alias("l"), i.alias("i"), s.alias("s")))
    )
    return F.transform(F.slice(ranked, 1, 5), lambda r: r["s"])


def brief_statements(text: Column) -> Column:
    """The first three factual or dated sentences, a sentence that is both counting twice."""

    def copies(s: Column) -> Column:
        factual = matches(s, r"^[A-Z].*?(?:is|are|was|were|has|have)\b") & contains_any(s, [" is ", " are ", " was "])
        dated = matches(F.lower(s), r"\b(?:today|current date|the date)\b") & matches(F.lower(s), r"\b(?:is|was)\b")
        return F.array_compact(F.array(F.when(factual, s), F.when(dated, s)))

    parts = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: F.length(s) >= 10)
    return F.slice(F.flatten(F.transform(parts, copies)), 1, 3)


def question_forms(fact: Column) -> Column:
    """Question-and-answer texts derived from a factual statement."""
    clean = F.regexp_replace(strip(fact), r"\.\z", "")

    def forms(c: Column) -> Column:
        def group(pattern: str, k: int) -> Column:
            return strip(F.regexp_extract(c, rules.java(pattern), k))

        is_a, has_n, made = (
            r"^(.+?)\s+(?:is|are|was|were)\s+(.+)",
            r"(.+?)\s+has\s+(\d+)\s+(.+)",
            r"(.+?)\s+(?:invented|created|discovered)\s+(.+)",
        )
        subject, predicate = group(is_a, 1), group(is_a, 2)
        answer = F.concat(F.lit("\nA: "), subject, F.lit(" is "), predicate, F.lit("."))
        holder, number, item = group(has_n, 1), group(has_n, 2), group(has_n, 3)
        person, thing = group(made, 1), group(made, 2)
        inventor = F.concat(F.lit("\nA: "), person, F.lit(" invented "), thing, F.lit("."))
        plain = matches(c, is_a)
        return F.array_compact(
            F.array(
                F.when(plain, F.concat(F.lit("Q: What is "), subject, F.lit("?"), answer)),
                F.when(
                    plain & contains_any(predicate, ["located in", "found in"]),
                    F.concat(F.lit("Q: Where is "), subject, F.lit("?"), answer),
                ),
                F.when(
                    plain & contains_any(predicate, ["defined as", "means"]),
                    F.concat(F.lit("Q: Define "), subject, F.lit("?"), answer),
                ),
                F.when(
                    matches(c, has_n),
                    F.concat(
                        F.lit("Q: How many "), item, F.lit(" does "), holder, F.lit(" have?\nA: "),
                        holder, F.lit(" has "), number, F.lit(" "), item, F.lit("."),
                    ),
                ),
                F.when(matches(c, made), F.concat(F.lit("Q: Who invented "), thing, F.lit("?"), inventor)),
                F.when(matches(c, made), F.concat(F.lit("Q: What did "), person, F.lit(" invent?"), inventor)),
            )
        )

    return let(clean, forms)


def with_generic_form(forms: Column, fact: Column) -> Column:
    """The given forms, or one generic question when there are none."""
    clean = F.regexp_replace(strip(fact), r"\.\z", "")
    generic = F.concat(F.lit("Q: Tell me about "), F.get(tokens(clean), F.lit(0)), F.lit("?\nA: "), clean, F.lit("."))
    return let(forms, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(generic)))


def worthy_content(query: Column, response: Column) -> Column:
    """Up to five ``struct<content, kind>`` worth remembering from one exchange."""
    brief = (F.length(query) <= 100) & (F.length(response) <= 200)
    entry = "array<struct<content:string,kind:string>>"

    def entries(texts: Column, kind: str, low: int, high: int) -> Column:
        return F.transform(
            F.filter(texts, lambda m: (F.length(m) > low) & (F.length(m) < high)),
            lambda m: F.struct(m.alias("content"), F.lit(kind).alias("kind")),
        )

    short_form = F.array_compact(
        F.array(
            F.struct(
                F.concat_ws(" ", strip(query), strip(response)).alias("content"), F.lit("conversation").alias("kind")
            ),
            F.when(
                F.length(strip(response)) > 20,
                F.struct(strip(response).alias("content"), F.lit("direct_answer").alias("kind")),
            ),
        )
    )
    verbs = "is|are|was|were|has|have|had"
    factual = F.regexp_extract_all(
        response, F.lit(rules.java(rf"(?:{verbs}|will be)\s+([A-Z][a-z]+\s+(?:{verbs})\s+[^.!?]+[.!?])")), F.lit(1)
    )
    defined = F.regexp_extract_all(
        response,
        F.lit(rules.java(r"([A-Z][a-z]+\s+(?:refers to|is defined as|means|is|are)\s+[^.!?]+[.!?])")),
        F.lit(1),
    )
    # a header line ending in a colon and the list lines right below it, closed by another text line;
    # 150 lines are more than the 300 characters a kept list may have
    lists = F.regexp_extract_all(
        response,
        F.lit(
            rules.java(
                r"(?:^|\n)([^-*\d\n]*:\n(?:\s*(?:[-*]|\d+\.)[^\n]*\n){2,150})"
                r"(?=\s*(?![-*]|\d+\.)(?![^-*\d\n]*:\s*(?:\n|\z))\S)"
            )
        ),
        F.lit(1),
    )
    lists = F.transform(lists, lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != ""), "\n"))
    structured = F.concat(entries(factual, "factual", 10, 200), entries(defined, "definition", 10, 200), entries(lists, "list", 20, 300))
    key_lines = F.slice(
        F.transform(
            F.filter(
                F.transform(F.split(response, r"[.!?]"), strip),
                lambda s: (F.length(s) >= 10)
                & matches(
                    s,
                    r"\b(?:key|important|significant|essential|critical|always|never|must|should|typically|generally)\b",
                ),
            ),
            lambda s: F.concat(s, F.lit(".")),
        ),
        1,
        3,
    )
    found = let(structured, lambda s: F.when(F.size(s) > 0, s).otherwise(entries(key_lines, "key_info", 10, 200)))
    chosen = F.when(brief, short_form).otherwise(found).cast(entry)

    def distinct(e: Column) -> Column:
        from mnemora.functions.arrays import keep_first

        keys = F.transform(e, lambda x: F.regexp_replace(F.lower(x["content"]), r"(?U)\s+", " "))
        return F.slice(F.transform(keep_first(keys), lambda i: F.get(e, i)), 1, 5)

    return let(chosen, distinct)


def command_memories(command: Column, output: Column) -> Column:
    """Texts stored for a command's output: four phrasings for dates, a listing, or a plain report."""
    out = strip(output)
    dated = matches(command, r"(?i)date|time")
    listing = matches(command, r"(?i)ls|dir")
    return (
        F.when(
            dated,
            F.array(
                F.concat(F.lit("Today's date is "), out, F.lit(".")),
                F.concat(F.lit("The current date is "), out, F.lit(".")),
                F.concat(F.lit("Today is "), out, F.lit(".")),
                F.concat(F.lit("Right now it is "), out, F.lit(".")),
            ),
        )
        .when(
            listing,
            F.array(F.concat(F.lit("The output of command '"), command, F.lit("' shows these files: "), out)),
        )
        .otherwise(F.array(F.concat(F.lit("The output of command '"), command, F.lit("' is: "), out)))
    )


def command_route(command: Column) -> Column:
    return (
        F.when(matches(command, r"(?i)date|time"), "temporal")
        .when(matches(command, r"(?i)ls|dir"), "file_system")
        .otherwise("generic")
    )


def content_kind(text: Column) -> Column:
    """tabular, filesystem, json, code or text, tested in that order."""
    bare = strip(text)
    return (
        F.when(F.contains(text, F.lit("\t")) | matches(text, r"\S\s{2,}\S"), "tabular")
        .when(contains_any(text, rules.FILESYSTEM_SIGNS), "filesystem")
        .when(F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}")), "json")
        .when(contains_any(text, rules.CODE_SIGNS), "code")
        .otherwise("text")
    )


def table_text(text: Column) -> Column:
    """A table's header and numbered rows as prose; one-line texts are left alone."""

    def form(lines: Column) -> Column:
        rows = F.transform(
            F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
            lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), r, F.lit("\n")),
        )
        return F.when(F.size(lines) < 2, text).otherwise(
            F.concat(
                F.lit("TABLE DATA:\nHeaders: "),
                F.get(lines, F.lit(0)),
                F.lit("\nData rows:\n"),
                F.array_join(rows, ""),
                F.lit(
                    "\nWhen answering questions about this table, refer to specific columns by name and rows by number.\n"
                ),
            )
        )

    return let(F.split(strip(text), "\n"), form)


def repeats_ngram(toks: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Some n-gram of the token array occurs twice (needs at least four tokens)."""
    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), "\u0001"))

    hit = F.lit(False)
    for n in sizes:
        hit = hit | ((F.size(toks) >= 2 * n) & F.exists(value_counts(grams(n)), lambda c: c["n"] >= 2))
    return (F.size(toks) >= 4) & hit
