"""Vector and similarity expressions; sums are taken in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions.arrays import let, total
from mnemora.functions.text import words

TINY = 1e-10


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def unit(v: Column) -> Column:
    """v / max(|v|, 1e-10) as ``array<double>``; a zero vector stays zero."""
    return let(
        F.greatest(norm(v), F.lit(TINY)), lambda n: F.transform(v, lambda x: x.cast("double") / n)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0.0 when either vector is close to zero."""
    return let(
        F.struct(norm(a).alias("a"), norm(b).alias("b")),
        lambda n: F.when((n["a"] < TINY) | (n["b"] < TINY), 0.0).otherwise(dot(a, b) / (n["a"] * n["b"])),
    )


def resize(v: Column, dim: int) -> Column:
    """Truncate or zero-pad to ``dim`` and normalise; vectors of that length are left alone."""
    size = F.size(v)
    fitted = F.when(size > dim, F.slice(v, F.lit(1), F.lit(dim))).otherwise(
        F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - size, F.lit(0))))
    )
    return F.when(size == dim, F.transform(v, lambda x: x.cast("double"))).otherwise(unit(fitted))


def enhance(sim: Column, factor: float = 0.3) -> Column:
    """Contrast a similarity around one half. Not monotone, so it must come before any ranking cut."""
    if factor <= 0:
        return sim
    return (
        F.when(sim > 0.5, F.least(F.lit(1.0), sim + (sim - 0.6) * factor * 2.0))
        .when(sim < 0.5, F.greatest(F.lit(0.0), sim - (F.lit(0.4) - sim) * factor * 2.0))
        .otherwise(0.5)
    )


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a ∩ b| / |a ∪ b| of two word sets, 0.0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 0.0).otherwise(F.lit(1.0) - both / either)


def term_similarity(text: Column, memory: Column, weight: Column) -> Column:
    """Jaccard similarity over ASCII terms of three letters or more, times the memory's own similarity."""
    term = r"(?U)\b[A-Za-z]{3,}\b"

    def terms(t: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(term), F.lit(0)))

    return let(
        F.struct(terms(text).alias("a"), terms(memory).alias("b")),
        lambda s: F.when(
            (F.size(s["a"]) > 0) & (F.size(s["b"]) > 0),
            (F.lit(1.0) - jaccard_distance(s["a"], s["b"])) * weight,
        ),
    )
