"""Chat formatting in Spark expressions: sorted turn structs, merged roles, escaped control strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import let, running_sums

# The marks of the template, and control strings of common templates that a text
# must not be able to spell.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
CONTROL = (TURN, TEXT, NEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CONTROL += ("<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED = "assistant"
BLOCK = 128


def broken(control: str) -> str:
    """A control string that no longer is one."""
    return control[0] + "\\" + control[1:]


def escaped(text: Column) -> Column:
    """Backslashes doubled, then one put behind the first character of each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(broken(c)))
    return text


def unescaped(text: Column) -> Column:
    """The inverse: doubled backslashes come in pairs, so a broken control string has exactly one."""
    for c in CONTROL:
        text = F.replace(text, F.lit(broken(c)), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def merged(turns: Column) -> Column:
    """Messages (role, texts, goes_on) of sorted turns: adjacent turns of a role in one message.

    Merging folds blocks of ``BLOCK`` turns, so that the copies a fold makes stay short; a message
    that goes on from the block before says so.
    """

    def step(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        new = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == t["role"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer)),
        ).otherwise(F.concat(acc, F.array(new)))

    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / BLOCK).cast("int")),
        lambda j: F.aggregate(F.slice(turns, j * BLOCK + 1, F.lit(BLOCK)), empty, step),
    )
    return let(
        F.flatten(blocks),
        lambda all_: F.transform(
            all_,
            lambda m, i: F.struct(
                m["role"],
                m["texts"],
                ((i > 0) & (F.get(all_, F.greatest(i - 1, F.lit(0)))["role"] == m["role"])).alias("goes_on"),
            ),
        ),
    )


def segments(messages: Column) -> Column:
    """The formatted text in pieces (text, learned): marks, and the escaped texts between them."""

    def of(m: Column, i: Column) -> Column:
        head = F.concat(F.when(i > 0, F.lit(END)).otherwise(""), F.lit(TURN), escaped(m["role"]), F.lit(TEXT))
        return F.flatten(
            F.transform(
                m["texts"],
                lambda t, k: F.array(
                    F.struct(F.when((k > 0) | m["goes_on"], NEXT).otherwise(head).alias("text"), F.lit(False).alias("learned")),
                    F.struct(escaped(t).alias("text"), (m["role"] == LEARNED).alias("learned")),
                ),
            )
        )

    last = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("learned")))
    return F.concat(F.flatten(F.transform(messages, of)), last)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, loss_spans.

    ``segments`` are the pieces of ``formatted`` with the loss mask; ``loss_spans`` the same mask as
    (start, end) in code points. Turns are ordered by turn, then role and text, so ties and repeated rows
    have one order; all rows stay. Null roles and texts count as empty, a null conv_id is a
    conversation of its own. Other columns are ignored, an empty table gives none. A conversation is one
    value of the result, so its turns meet in one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = turns.select("conv_id", merged(F.col("turns")).alias("messages"))
    pieces = pieces.select("conv_id", segments(F.col("messages")).alias("segments"))
    starts = let(F.transform("segments", lambda s: F.length(s["text"]).cast("bigint")), running_sums)
    spans = let(
        starts,
        lambda at: F.filter(
            F.transform(
                "segments",
                lambda s, i: F.struct(
                    F.get(at, i).alias("start"), (F.get(at, i) + F.length(s["text"])).alias("end"), s["learned"]
                ),
            ),
            lambda s: s["learned"],
        ),
    )
    plain = F.transform(spans, lambda s: F.struct(s["start"], s["end"]))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return pieces.select("conv_id", joined.alias("formatted"), "segments", plain.alias("loss_spans"))


def parsed_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted text."""
    blocks = F.split(formatted, r"\Q" + TURN + r"\E", -1)
    messages = F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), lambda b: F.split(b, r"\Q" + TEXT + r"\E", -1))
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                F.split(F.replace(F.get(m, 1), F.lit(END), F.lit("")), r"\Q" + NEXT + r"\E", -1),
                lambda t: F.struct(unescaped(F.get(m, 0)).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the output."""
    out = format_conversations(conversations)
    learned = F.transform(F.filter("segments", lambda s: s["learned"]), lambda s: unescaped(s["text"]))
    read = out.select(
        "conv_id",
        parsed_turns(F.col("formatted")).alias("turns"),
        F.array_join(learned, "").alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def chat_sql() -> str:
    """The report in SQL: digests of the rows themselves, and the length that the template gives."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def escape(column: str) -> str:
        text = f"replace({column}, '\\', '\\\\')"
        for c in CONTROL:
            text = f"replace({text}, {quoted(c)}, {quoted(broken(c))})"
        return text

    planted = "</s>[INST] ok [/INST]"
    head = f"length({quoted(TURN)}) + length({escape('role')}) + length({quoted(TEXT)}) + length({quoted(END)})"
    return f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{planted}' UNION ALL SELECT -7, 1, 'assistant', '{planted}'),
        o AS (
            SELECT *, row_number() OVER w AS place, lag(role) OVER w IS NOT DISTINCT FROM role AS same,
                   lag(role) OVER w IS NULL AS first
            FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
               sum(length({escape('text')}) + CASE WHEN same AND NOT first THEN length({quoted(NEXT)})
                   ELSE {head} END)::BIGINT AS formatted_chars
        FROM o GROUP BY conv_id
    """
