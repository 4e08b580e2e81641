"""License scans: exact set-similarity join of text blocks with license templates, and fixed phrases.

A block is any run of ``WINDOW`` times as many words as a template has distinct ones, at every place
of the text and across line breaks. A template is found in
a block that contains at least ``CONTAINMENT`` of its distinct words. Only template words can be
shared, so a block is reduced to those; the words are ordered by the number of texts that hold them. For a needed overlap of a words, a block can only match if one of its first |B| - a + 1
words is among the template's first |T| - a + 1 (prefix filter), if it has a words at all (length
filter), and if enough words are left behind the first shared one (positional filter). The filters
hold for the whole text as for each of its blocks, so the blocks of a text are looked at only for the
templates that pass them on the text. What passes is counted exactly.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.9
# Words of a window for each distinct word of its template: room for repeated words and comment marks.
WINDOW = 2
# Phrases and their labels.
PHRASES = (
    (b"cc by", "cc-by"),
    (b"general public license", "gpl"),
    (b"all rights reserved", "reserved"),
)
# Sentences of well-known public license texts.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike License"),
    ("reserved", "Copyright all rights reserved"),
)

# Word characters stay (A-Z in lower case), all other ASCII becomes a blank.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def template_sets(templates=TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words_of(text.encode()))) for label, text in templates]


class Index:
    """Templates filed under the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], frequency: dict[bytes, int]):
        self.words = frozenset().union(*[t for _, t in templates]) if templates else frozenset()
        self.order = {w: i for i, w in enumerate(sorted(self.words, key=lambda w: (frequency.get(w, 0), w)))}
        self.least = min((needed(t) for _, t in templates), default=1)
        self.posts: dict[bytes, list] = defaultdict(list)
        for label, t in templates:
            ordered = sorted(t, key=self.order.__getitem__)
            for at, w in enumerate(ordered[: len(t) - needed(t) + 1]):
                self.posts[w].append((label, t, needed(t), at))

    def passing(self, block_words: list[bytes]) -> list[tuple[str, frozenset[bytes], int]]:
        """(label, template, shared words) of the templates found in one block."""
        if len(block_words) < self.least:
            return []
        block = self.words.intersection(block_words)
        if len(block) < self.least:
            return []
        ordered = sorted(block, key=self.order.__getitem__)
        out = []
        seen = set()
        for at, w in enumerate(ordered[: len(ordered) - self.least + 1]):
            for label, t, need, post in self.posts.get(w, ()):
                if (label, t) in seen or len(block) < need or min(len(t) - post, len(block) - at) < need:
                    continue
                seen.add((label, t))
                if len(block & t) >= need:
                    out.append((label, t, len(block & t)))
        return out

    def found(self, words: list[bytes]) -> dict[str, float]:
        """Labels with their best containment over all blocks of a text."""
        out: dict[str, float] = {}
        for label, t, _ in self.passing(words):
            shared = most_in_window(words, t, WINDOW * len(t))
            if shared >= needed(t):
                out[label] = max(out.get(label, 0.0), shared / len(t))
        return out


def most_in_window(words: list[bytes], template: frozenset[bytes], width: int) -> int:
    """Most distinct template words in any ``width`` neighbouring words, in one pass."""
    last: dict[bytes, int] = {}  # latest place of each template word, oldest first
    most = 0
    for at, word in enumerate(words):
        if word in template:
            last.pop(word, None)
            last[word] = at
            while last[oldest := next(iter(last))] <= at - width:
                del last[oldest]
            most = max(most, len(last))
    return most


def needed(template: frozenset[bytes]) -> int:
    """Words that must be shared."""
    return math.ceil(round(CONTAINMENT * len(template), 9))


def word_frequency(docs: DataFrame, templates: list[tuple[str, frozenset[bytes]]]) -> dict[bytes, int]:
    """In how many texts of the corpus each template word stands; as many rows as there are such words."""
    words = frozenset().union(*[t for _, t in templates]) if templates else frozenset()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(words.intersection(words_of((text.as_py() or "").encode("utf-8", "surrogatepass"))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    rows = docs.select("text").mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of a phrase in a list of words."""
    places, at, n = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return places
        if words[at : at + n] == phrase:
            places.append(at)


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64())]
    + [("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)
SPARK_SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a fixed phrase stands, else the best containment of a template found, else 0.
    Null and empty texts have no words and no labels (empty strings, null places). Repeated rows are
    scanned each, words of equal frequency are ordered by themselves, other columns are ignored, an
    empty table gives an empty result. Whole texts are scanned, however long.
    """
    sets = template_sets(templates)
    frequency = word_frequency(docs, sets)
    phrases = [(p.split(), label) for p, label in PHRASES]

    def row(doc_id: int | None, text: str | None, index: Index) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = words_of(raw)
        found = index.found(words)
        places, base = [], set()
        lower = raw.lower()
        for phrase, label in phrases:
            if all(p in lower for p in phrase):
                at = phrase_places(words, phrase)
                places += at
                base |= {label} if at else set()
        score = 1.0 if base else max(found.values(), default=0.0)
        ends = (min(places), max(places)) if places else (None, None)
        return doc_id, len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | set(found))), score

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sets, frequency)
        for batch in batches:
            rows = [row(d.as_py(), t.as_py(), index) for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(scanned, SPARK_SCHEMA)
