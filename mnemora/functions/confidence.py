"""Confidence measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions import rules
from mnemora.functions.arrays import let, total


def softmax_metrics(logits: Column, token: Column) -> Column:
    """``struct<prob, entropy>`` of a logit array and a 0-based chosen token."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    return let(
        weights,
        lambda w: let(
            total(w),
            lambda z: F.struct(
                (F.get(w, token) / z).alias("prob"),
                (-total(F.transform(w, lambda x: (x / z) * F.log2(x / z + F.lit(1e-10))))).alias("entropy"),
            ),
        ),
    )


def sharpen_probability(p: Column, factor: float = 0.3) -> Column:
    """Push a probability away from 0.5; a factor of 0 leaves it alone."""
    if factor <= 0:
        return p
    return F.when(p > 0.5, F.least(F.lit(1.0), p + (p - 0.5) * factor)).otherwise(
        F.greatest(F.lit(0.0), p - (F.lit(0.5) - p) * factor)
    )


def sharpen_entropy(h: Column, factor: float = 0.3) -> Column:
    """Push an entropy away from 1.0."""
    if factor <= 0:
        return h
    return F.when(h < 1.0, F.greatest(F.lit(0.0), h - h * factor * 0.5)).otherwise(h + (h - 1.0) * factor * 0.5)


def sharpen_value(value: Column, threshold: float, factor: float, higher_is_better: bool = True) -> Column:
    """Contrast a metric against a threshold."""
    ratio = value / threshold
    if higher_is_better:
        return F.when(
            value > threshold, F.least(F.lit(1.0), value + (value - threshold) * (factor - 1.0))
        ).otherwise(value * (F.lit(0.8) + ratio * 0.2))
    return F.when(value < threshold, value * F.pow(ratio, F.lit(factor - 1.0))).otherwise(
        F.lit(threshold) + (value - threshold) * factor
    )


def geometric_mean(values: Column) -> Column:
    """Geometric mean with a floor of 0.01; 0.8 for no values at all."""
    n = F.size(values)
    return F.when(
        n > 0, F.exp(total(F.transform(values, lambda v: F.log(F.greatest(v, F.lit(0.01))))) / n)
    ).otherwise(0.8)


def sharpened_confidence(c: Column, factor: float = 0.3) -> Column:
    if factor <= 0:
        return c
    return F.when(c > 0.5, F.least(F.lit(1.0), c + (c - 0.5) * factor * 1.5)).otherwise(
        F.greatest(F.lit(0.1), c - (F.lit(0.5) - c) * factor * 1.5)
    )


def sharpened_perplexity(p: Column, factor: float = 0.3) -> Column:
    if factor <= 0:
        return p
    return F.when(p < 5.0, F.greatest(F.lit(1.0), p - p * factor * 0.3)).otherwise(p + (p - 5.0) * factor * 0.3)


def sharpened_entropy(h: Column, factor: float = 0.3) -> Column:
    if factor <= 0:
        return h
    return F.when(h < 1.0, F.greatest(F.lit(0.0), h - h * factor * 0.4)).otherwise(h + (h - 1.0) * factor * 0.4)


def confidence_pattern(values: Column, floor_third: bool = True) -> Column:
    """What the token confidences of one answer show, ``struct<pattern_type, severity, drop_size, degradation, repetition>``.

    As :func:`mnemora.operators.series.confidence_patterns` finds it in a series, inside the row: sudden drops, then
    degradation from the first to the last third, then repetition of 3 to 5 values; a later finding names the type, the
    severity is the largest. Fewer than ten values, or none, show nothing.
    """
    n = F.size(values)

    def drops(mean: Column) -> Column:
        steps = F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), lambda a, b: F.when((a - b > 0.3) & (b < mean * 0.7), a - b))
        return F.array_max(steps)

    def degradation(mean: Column) -> Column:
        third = F.floor(n / 3).cast("int")
        tail = third if floor_third else F.ceil(n / 3).cast("int")
        first = total(F.slice(values, F.lit(1), third)) / third
        last = total(F.slice(values, n - tail + 1, tail)) / third
        return F.when((n > 20) & (first - last > 0.2) & (last < mean * 0.8), first - last)

    def repetition(length: int) -> Column:
        """Largest similarity of a run with the run after it; runs start before n - 2 * length."""
        gaps = F.zip_with(F.slice(values, F.lit(1), n - length), F.slice(values, F.lit(length + 1), n - length), lambda a, b: F.abs(a - b))

        def similarity(g: Column, i: Column) -> Column:
            gap = F.get(g, i)
            for j in range(1, length):
                gap = gap + F.get(g, i + j)
            return F.lit(1.0) - gap / length

        return F.array_max(let(gaps, lambda g: F.transform(F.sequence(F.lit(0), n - 2 * length - 1), lambda i: similarity(g, i))))

    def found(mean: Column) -> Column:
        best = F.greatest(*[repetition(k) for k in (3, 4, 5)])
        return F.struct(drops(mean).alias("d"), degradation(mean).alias("g"), F.when(n > 15, let(best, lambda b: F.when(b > 0.85, b - 0.85))).alias("r"))

    def named(x: Column) -> Column:
        kind = F.when(x["r"].isNotNull(), "repetition").when(x["g"].isNotNull(), "degradation").when(x["d"].isNotNull(), "sudden_drop")
        worst = F.greatest(*[F.coalesce(x[c], F.lit(0.0)) for c in ("d", "g", "r")])
        return F.struct(
            kind.alias("pattern_type"), worst.alias("severity"), x["d"].alias("drop_size"), x["g"].alias("degradation"), x["r"].alias("repetition")
        )

    nothing = F.struct(
        F.lit(None).cast("string").alias("pattern_type"), F.lit(0.0).alias("severity"),
        *[F.lit(None).cast("double").alias(c) for c in ("drop_size", "degradation", "repetition")],
    )
    return F.when(n >= 10, let(let(total(values) / n, found), named)).otherwise(nothing)


def colour_step(confidence: Column) -> Column:
    """Index of the colour step, 0 for the most confident; NULL below the last step."""
    step = F.lit(None).cast("int")
    for i, low in reversed(list(enumerate(rules.COLOUR_STEPS))):
        step = F.when(confidence >= low, i).otherwise(step)
    return step


def even_colour_step(confidence: Column, steps: int = 10) -> Column:
    """Index among evenly spaced colour steps, 0 for a confidence of 1."""
    step = F.lit(steps - 1)
    for i in reversed(range(steps)):
        step = F.when(confidence >= (steps - i) / steps, i).otherwise(step)
    return step


def confidence_at(confidences: Column, position: Column) -> Column:
    """Confidence shown for a 0-based position: the last one beyond the end, 1.0 when there is none."""
    n = F.size(confidences)
    return F.when(n == 0, 1.0).otherwise(F.get(confidences, F.least(position, n - 1)))


def support_tier(count: Column, best: Column) -> Column:
    """Name of the memory-support tier."""
    return (
        F.when(count <= 0, "None")
        .when(best > 0.8, "Excellent")
        .when(best > 0.6, "Good")
        .when(best > 0.4, "Moderate")
        .otherwise("Limited")
    )


def bar(value: Column, width: int = 30) -> Column:
    filled = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def percent(value: Column) -> Column:
    return F.floor(value * 100).cast("int")
