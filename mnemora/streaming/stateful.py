"""Stateful stream operators. State per key is a short ring, a buffer or two numbers.

Rows of a key are put in order inside a micro-batch; between micro-batches the source
order has to hold, as for any ordered state.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemora.functions import rules
from mnemora.functions.text import tokens
from mnemora.operators.conversation import asks_to_continue, asks_to_exit

OPENER = ">>> FILE:"


def _batch(frames, order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, ignore_index=True)


def stream_topic_shifts(
    turns: DataFrame, key: str, order: str, text: str = "text", vec: str = "embedding", threshold: float = 0.35, ring: int = 3
) -> DataFrame:
    """``key, order, is_shift, similarity``: the same rule as the batch operator, with the ring as state."""
    skip = F.coalesce(asks_to_continue(F.col(text)) | asks_to_exit(F.col(text)), F.lit(False)) | F.col(vec).isNull()
    rows = turns.select(key, order, skip.alias("skip"), F.col(vec).cast("array<double>").alias("vec"))
    key_type, order_type = (rows.schema[c].dataType.simpleString() for c in (key, order))

    def step(_, frames, state: GroupState):
        flat, kept = state.get if state.exists else ([], 0)
        dim = len(flat) // kept if kept else 0
        past = [np.array(flat[i * dim : (i + 1) * dim]) for i in range(kept)]
        batch = _batch(frames, [order])
        shift, similarity = [], []
        for pass_by, vector in zip(batch["skip"], batch["vec"]):
            if pass_by:
                shift.append(False)
                similarity.append(1.0)
                continue
            v = np.asarray(vector, dtype=np.float64)
            if past:
                size = np.linalg.norm(v)
                sims = [0.0 if size < 1e-10 or np.linalg.norm(p) < 1e-10 else float(v @ p / size / np.linalg.norm(p)) for p in past]
                best = max(0.0, max(sims))
                shift.append(best < threshold)
                similarity.append(best)
            else:
                shift.append(False)
                similarity.append(1.0)
            past = [*past, v][-ring:]
        state.update(([float(x) for p in past for x in p], len(past)))
        yield pd.DataFrame({key: batch[key], order: batch[order], "is_shift": shift, "similarity": similarity})

    return rows.groupBy(key).applyInPandasWithState(
        step,
        f"{key} {key_type}, {order} {order_type}, is_shift boolean, similarity double",
        "ring array<double>, kept int",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def stream_confidence(
    rows: DataFrame, key: str, order: list[str], value: str, window: int = 5, start: float = 0.5, keep: float = 0.9
) -> DataFrame:
    """``key, order..., normalized_confidence, baseline``: sliding geometric mean and running mean."""
    types = {c: rows.schema[c].dataType.simpleString() for c in [key, *order]}

    def step(_, frames, state: GroupState):
        ring, base = state.get if state.exists else ([], start)
        ring = list(ring)
        batch = _batch(frames, order)
        means, bases = [], []
        for x in batch[value]:
            ring = [*ring, float(x)][-window:]
            means.append(float(np.exp(np.mean(np.log(np.maximum(ring, 0.01))))))
            base = keep * base + (1 - keep) * float(x)
            bases.append(base)
        state.update((ring, base))
        yield batch[[key, *order]].assign(normalized_confidence=means, baseline=bases)

    schema = ", ".join(f"{c} {t}" for c, t in types.items())
    return (
        rows.select(key, *order, value)
        .groupBy(key)
        .applyInPandasWithState(
            step,
            f"{schema}, normalized_confidence double, baseline double",
            "ring array<double>, baseline double",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def stream_file_blocks(rows: DataFrame, key: str, order: str, token: str = "token") -> DataFrame:
    """``key, order, display, filename, content`` per token.

    A token is shown until an opener is complete, then held back until its block closes;
    the closing token carries the block. While no opener is in sight only as many
    characters are kept as an opener could have begun with.

    A row brings one token, or an array of tokens of which the first has the number ``order``; an array crosses
    into Python and back as one row.
    """
    types = {c: rows.schema[c].dataType.simpleString() for c in (key, order)}
    block = re.compile(rules.FILE_BLOCK)
    tokens_of = F.col(token) if rows.schema[token].dataType.typeName() == "array" else F.array(token)

    def step(_, frames, state: GroupState):
        buffer = state.get[0] if state.exists else ""
        batch = _batch(frames, [order])
        shown, names, bodies = [], [], []
        for toks in batch["_tokens"]:
            displays, found_names, found_bodies = [], [], []
            for t in toks if toks is not None else ():
                buffer += t
                display, name, body = t, None, None
                if OPENER in buffer:
                    display = ""
                    found = block.search(buffer) if "<<<" in buffer else None
                    if found:
                        name, body, buffer = found.group(1).strip(), found.group(2), ""
                else:
                    buffer = buffer[-(len(OPENER) - 1) :]
                displays.append(display)
                found_names.append(name)
                found_bodies.append(body)
            shown.append(displays)
            names.append(found_names)
            bodies.append(found_bodies)
        state.update((buffer,))
        yield pd.DataFrame({key: batch[key], order: batch[order], "display": shown, "filename": names, "content": bodies})

    judged = (
        rows.select(key, order, tokens_of.alias("_tokens"))
        .groupBy(key)
        .applyInPandasWithState(
            step,
            f"{key} {types[key]}, {order} {types[order]}, display array<string>, filename array<string>, content array<string>",
            "buffer string",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )
    single = judged.select(key, order, F.posexplode(F.arrays_zip("display", "filename", "content")).alias("_i", "_t"))
    return single.select(key, (F.col(order) + F.col("_i")).cast(types[order]).alias(order), "_t.display", "_t.filename", "_t.content")


def stream_prefixes(rows: DataFrame, key: str, order: str, token: str = "token") -> DataFrame:
    """``key, points, prefix`` per key and micro-batch: the answer so far, at the last of the token counts 40, 80, 160 and
    then every 100 that the micro-batch reached, and these counts.

    What the prefixes show is judged downstream by Column expressions; each is a part of the one handed on.
    """
    types = {c: rows.schema[c].dataType.simpleString() for c in (key,)}

    def step(_, frames, state: GroupState):
        text, n = state.get if state.exists else ("", 0)
        batch = _batch(frames, [order])
        parts = [*([text] if n else []), *batch[token]]
        points = [k for k in range(n + 1, n + len(batch) + 1) if k in (40, 80) or (k >= 160 and k % 100 == 60)]
        if points:
            reached = len(parts) - (n + len(batch) - points[-1])
            yield pd.DataFrame({key: batch[key].iloc[:1], "points": [points], "prefix": [" ".join(parts[:reached])]})
        state.update((" ".join(parts), n + len(batch)))

    return (
        rows.select(key, order, token)
        .groupBy(key)
        .applyInPandasWithState(
            step, f"{key} {types[key]}, points array<int>, prefix string", "text string, n int", "append", GroupStateTimeout.NoTimeout
        )
    )


def token_rows(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, pos, token`` rows of a text column, white space kept with the token before it."""
    return df.select(
        key.alias("key"), F.posexplode(F.regexp_extract_all(text, F.lit(r"\S*\s*"), F.lit(0))).alias("pos", "token")
    ).filter(F.length("token") > 0)


def token_arrays(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, pos, token``: all tokens of a text in one row, as :func:`token_rows` has them one by one."""
    toks = F.filter(F.regexp_extract_all(text, F.lit(r"\S*\s*"), F.lit(0)), lambda t: F.length(t) > 0)
    return df.select(key.alias("key"), F.lit(0).alias("pos"), toks.alias("token"))


def bare_token_rows(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, pos, token`` rows of white-space tokens."""
    return df.select(key.alias("key"), F.posexplode(tokens(text)).alias("pos", "token"))
