"""Text measures against direct Python readings of their rules and hand-made cases."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemora.functions import blocks as B
from mnemora.functions import classify as C
from mnemora.functions import text as T


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[1] for r in df.select("i", expr).orderBy("i").collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n", max_size=14), min_size=30, max_size=30))
def test_duplicate_lines_equals_the_regex(spark, texts):
    want = [bool(re.search(r"(.+)\n\1(\n\1)+", t)) for t in texts]
    assert column(spark, texts, T.duplicate_lines(F.col("text"))) == want


def phrases(text):
    if len(text) < 100:
        return []
    w = re.findall(r"\w+", text.lower())
    sizes = [3, 5, 7] if len(w) > 1000 else range(5, min(10, len(w) // 3))
    found = []
    for n in sizes:
        counts = {}
        for i in range(len(w) - n + 1):
            g = " ".join(w[i : i + n])
            if len(g) >= 10:
                counts[g] = counts.get(g, 0) + 1
        found += [g for g, c in counts.items() if c >= 3]
    return found[:5]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["aa", "bbb", "c", "dddd"]), max_size=90), min_size=12, max_size=12))
def test_repeated_phrases_brute_force(spark, lists):
    texts = [" ".join(x) for x in lists] + ["one two three four five. " * 6, "ab cd ef " * 400]
    got = column(spark, texts, F.transform(T.repeated_phrases(F.col("text")), lambda r: r["gram"]))
    assert got == [phrases(t) for t in texts]


def test_repetition_kinds(spark):
    texts = [
        "Paris is the capital of France\n" * 4,
        "line one\nline two\nline three\nline four",
        "short",
        "aaaaaaaaaaaaaaaaaaaaaaaaa",
        "price is $ $ $ $ $ for all of you",
        "nothing special happens in this text",
    ]
    assert column(spark, texts, T.repetitive_pattern(F.col("text"))) == [
        "duplicate_lines", None, None, "repeated_characters", "repeated_dollar_signs", None,
    ]


def test_file_blocks(spark):
    text = "This is a response\n>>> FILE: test.py\nprint('hello')\n<<<\nbye"
    df = spark.createDataFrame([(text,), ("a\n>>> FILE: x\nnever closed",), ("plain",)], "text string")
    rows = df.select(
        B.file_map(F.col("text")).alias("m"), B.without_blocks(F.col("text")).alias("w"), B.command_lines(F.col("text")).alias("c")
    ).collect()
    assert rows[0].m == {"test.py": "print('hello')"} and rows[0].w == "This is a response\n\nbye"
    assert rows[0].c["commands"] == [">>> FILE: test.py", "print('hello')", "<<<"]
    assert rows[1].m == {} and rows[1].c["kept"] == "a" and len(rows[1].c["commands"]) == 2
    assert rows[2].w == "plain" and rows[2].c["commands"] == []


def test_file_names(spark):
    names = ["a/b.txt", "..", ".", "../x", 'q?"*.md', "ok.py"]
    assert column(spark, names, B.safe_filename(F.col("text"))) == ["a_b.txt", None, None, ".._x", "q___.md", "ok.py"]


def test_storage_and_topics(spark):
    t = ["Fix a tire  ", "Paris", "What a day! "]
    assert column(spark, t, C.storage_form(F.col("text"), F.lit("procedural_knowledge"))) == ["How to: Fix a tire.", "How to: Paris.", "How to: What a day!"]
    got = column(spark, ["Marie Curie met Marie Curie. She knew physics and chemistry."], C.topics(F.col("text")))
    assert got == [["marie curie", "marie curie", "physics", "chemistry"]]


def test_own_related_terms(spark):
    rows = C.taxonomy({"geographic": ["capital", "river"]})
    got = column(spark, ["what is the capital of France"], C.subcategory(F.col("text"), F.lit("declarative"), rows))
    assert got[0]["name"] == "geographic" and got[0]["score"] == 0.3


def test_worthy_content(spark):
    long = (
        "Here are some facts you may want:\n- one item\n- two items\n3. three items\nThat was the list. "
        "Water is a liquid at room temperature. " + "Filler words go here to make it long enough for this test case. " * 3
    )
    df = spark.createDataFrame([("q?", "A short answer that is kept."), ("q", long)], "q string, text string")
    rows = [[(e["content"], e["kind"]) for e in r[0]] for r in df.select(C.worthy_content(F.col("q"), F.col("text"))).collect()]
    assert rows[0] == [("q? A short answer that is kept.", "conversation"), ("A short answer that is kept.", "direct_answer")]
    assert ("Water is a liquid at room temperature.", "definition") in rows[1]
    assert ("Here are some facts you may want:\n- one item\n- two items\n3. three items", "list") in rows[1]


def test_verdict_ladder(spark):
    from mnemora.operators.conversation import judge_answers

    even = "Cats like warm beds and dogs like cold baths. " * 1
    df = spark.createDataFrame(
        [
            ("calm", even, "", 0.85, 1.5, 5.0, 80, None, 0.0),
            ("low", even, "", 0.2, 1.5, 5.0, 80, None, 0.0),
            ("entropy", even, "", 0.9, 6.0, 5.0, 80, None, 0.0),
            ("perplexity", even, "", 0.9, 1.5, 60.0, 80, None, 0.0),
            ("short", even, "", 0.2, 6.0, 60.0, 10, None, 0.0),
            ("pattern", even, "", 0.9, 1.5, 5.0, 80, "sudden_drop", 0.5),
            ("overflow", "Cats like warm,,beds now. ", "", 0.9, 1.5, 5.0, 80, None, 0.0),
        ],
        "k string, text string, query string, normalized_confidence double, entropy double, perplexity double, "
        "tokens_generated int, pattern_type string, pattern_severity double",
    ).withColumn("memory_supported", F.lit(False))
    got = {r.k: (r.reason, r.is_likely_hallucination) for r in judge_answers(df).collect()}
    assert not got["calm"][1], got
    assert {k: v[0] for k, v in got.items()} == {
        "calm": "acceptable",
        "low": "very_low_confidence",
        "entropy": "extremely_high_entropy",
        "perplexity": "extremely_high_perplexity",
        "short": "acceptable",
        "pattern": "pattern_detected_sudden_drop",
        "overflow": "context_overflow_['pattern_9']",
    }


def test_fallbacks(spark):
    from mnemora.operators.conversation import fallback_text, final_answer

    df = spark.createDataFrame([("low_quality_x", "tell me about cats"), ("context_overflow_[]", "a csv"), ("x", None)], "reason string, q string")
    a, b, c = (r[0] for r in df.select(fallback_text(F.col("reason"), F.col("q"), F.col("reason"))).collect())
    assert a.startswith("I'm having trouble") and "this question about 'cats'" in a
    assert b.startswith("I started generating") and b.endswith("retry your question.")
    assert c
    kept = df.select(final_answer(F.lit("text"), F.lit("acceptable"), F.col("q"), F.array(F.lit("z")), F.lit(1))).first()[0]
    assert kept == "text"


def test_phrases_and_fallbacks_of_the_caller(spark):
    from mnemora.operators.conversation import final_answer, stops_stream
    from mnemora.functions import rules

    asked = ["weiter bitte", "please continue", None]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    none = F.array().cast("array<string>")
    own = dict(messages=["Unknown."], phrases=["weiter"])
    said = [r[0] for r in df.select(final_answer(F.lit("text"), F.lit("x"), F.col("q"), none, F.lit(1), **own)).collect()]
    assert said == [rules.DISCLAIMER + "text", "Unknown.", "Unknown."]
    usual = [r[0] for r in df.select(final_answer(F.lit("text"), F.lit("x"), F.col("q"), none, F.lit(1))).collect()]
    assert usual[1] == rules.DISCLAIMER + "text" and usual[0] in rules.FALLBACK_MESSAGES
    cut = df.select(stops_stream(F.lit(True), F.lit("x"), F.lit(99), F.col("q"), phrases=["weiter"])).collect()
    assert [r[0] for r in cut] == [False, True, True]


def test_all_terms_are_found_in_one_pass(spark):
    """Overlapping, nested and empty terms, against a search for each."""
    from mnemora.functions.terms import term_hits

    terms = ["art", "artist", "how-to", "st", "user guide", "é", "", "zzz", "a"]
    texts = ["the artist's how-to", "a user guide", "", None, "é" * 3, "ART"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["h"] for r in rows.select("i", term_hits(F.col("t"), terms).alias("h")).collect()}
    assert got == {i: None if t is None else [k for k, w in enumerate(terms) if w in t] for i, t in enumerate(texts)}
    assert [r["h"] for r in rows.where("i = 0").select(term_hits(F.col("t"), []).alias("h")).collect()] == [[]]


def test_subcategories_follow_the_given_terms(spark, tmp_path):
    """A caller's table of terms: mention and term, term alone, words of the name, nothing; first best wins."""
    from mnemora.functions.terms import read_related_terms

    related = {"historical": ["history", "ancient"], "scientific": ["science", "data"], "problem_solving": ["solve", "fix"], "sports": ["game"]}
    table = [(s, i, w) for s, words in related.items() for i, w in enumerate(words)]
    spark.createDataFrame(table, "subcategory string, position int, term string").write.parquet(str(tmp_path / "terms"))
    assert read_related_terms(spark, str(tmp_path / "terms")) == related
    rows = C.taxonomy(related)
    cases = [
        ("Historical and ancient DATA", "declarative", ("historical", 1.0)),
        ("ancient data", "declarative", ("historical", 0.3)),
        ("some data", "declarative", ("scientific", 0.3)),
        ("a problem of mine", "procedural_knowledge", ("problem_solving", 0.5)),
        ("nothing of the kind", "procedural_knowledge", (None, 0.0)),
        ("any", "no category", (None, 0.0)),
        (None, "declarative", (None, 0.0)),
    ]
    frame = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(cases)], "i int, t string, c string")
    got = {r["i"]: (r["s"]["name"], r["s"]["score"]) for r in frame.select("i", C.subcategory(F.col("t"), F.col("c"), rows).alias("s")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_question_forms_use_all_cores(spark, folder):
    """A table of one row group is one task however many rows it has, unless it is dealt out before the patterns."""
    from mnemora.plans import classify_plans

    assert classify_plans.question_forms(spark, folder).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_first_repetition_equals_all_prefixes(spark):
    """Halving the points finds what a look at every prefix finds, on both sides of 1,000 words and across."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    phrase = "these five words come again here"
    texts = [" ".join(word() for _ in range(n)) for n in (10, 39, 40, 100, 400, 1300)]
    for n, k in ((300, 3), (300, 8), (1400, 3), (1400, 12), (2300, 4)):
        for _ in range(3):
            w = [word() for _ in range(n)]
            for _ in range(k):
                w.insert(rng.randrange(len(w)), phrase)
            texts.append(" ".join(w))
    texts += [texts[5] + " and,and " + texts[4], texts[4] + " zzzzzzzzzzzz " + texts[5], "one two " * 900, texts[5] + " $ $ $ $ "]
    # three short words make phrases of three beyond 1,000 words only
    texts.append(" ".join(word() + (" alpha beta gamma " + word() + " delta omega sigma " if i % 100 == 0 else "") for i in range(1500)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("tok", T.tokens(F.col("text"))).withColumn("points", T.prefix_checkpoints(F.size("tok")))
    got = {r["i"]: (r["f"]["pattern"], r["f"]["at"]) if r["f"] else None for r in df.select("i", T.first_repetition(F.col("tok"), F.col("points")).alias("f")).collect()}
    every = df.select("i", F.col("tok"), F.explode("points").alias("at")).select("i", "at", T.repetitive_pattern(F.array_join(F.slice("tok", F.lit(1), F.col("at")), " ")).alias("p"))
    want = dict.fromkeys(got)
    for r in sorted(every.where("p is not null").collect(), key=lambda r: -r["at"]):
        want[r["i"]] = (r["p"], r["at"])
    assert got == want
    assert sum(x is not None and x[1] < 1000 for x in want.values()) >= 3 and sum(x is not None and x[1] > 1000 for x in want.values()) >= 3
