"""Many terms in one pass over each text: an automaton of all terms, built once in a worker."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# A list of terms goes to every task; a longer one belongs into a join.
MAX_TERMS = 100_000


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]):
    """Finds every term that occurs in a text, inside words too, whatever the number of terms."""
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        if term:
            found.add_word(term, i)
    if len(found):
        found.make_automaton()
    return found


def term_hits(text: Column, terms: list[str]) -> Column:
    """Ascending numbers of the terms that a text contains, ``array<int>``; NULL for a NULL text.

    Terms must be distinct. An empty term is contained in every text.
    """
    if len(terms) > MAX_TERMS or len(set(terms)) < len(terms):
        raise ValueError(f"at most {MAX_TERMS} distinct terms")
    listed = tuple(terms)

    @pandas_udf("array<int>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = automaton(listed)
        always = {i for i, t in enumerate(listed) if not t}
        for batch in batches:
            yield batch.map(
                lambda t: None if t is None else sorted({i for _, i in found.iter(t)} | always) if len(found) else sorted(always)
            )

    return hits(text)


def read_related_terms(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Related terms of each subcategory from a table ``subcategory, position, term``, in order of position."""
    rows = spark.read.parquet(path).select("subcategory", "position", "term").where("subcategory is not null and term is not null")
    found = rows.limit(MAX_TERMS + 1).collect()
    if len(found) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms in {path}")
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["subcategory"], r["position"] or 0, r["term"])):
        out.setdefault(r["subcategory"], []).append(r["term"])
    return out
