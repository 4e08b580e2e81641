"""Ordered-series operators that stay parallel when one series holds most rows.

A plain window partitioned by the series key puts a whole series into one task.
Here a series is cut into blocks along its order. Rows are shuffled by (key,
block); what crosses a block border is only a short tail or a running total per
block, and those summaries are the only thing ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_BLOCK_ROWS = 1_000_000


MAX_HOT_KEYS = 1_000_000


def time_blocks(
    df: DataFrame, keys: list[str], ts: str, target_rows: int = TARGET_BLOCK_ROWS
) -> tuple[DataFrame, Column | None]:
    """The rows and a block number by time, or None when no series can exceed ``target_rows``.

    One aggregate over min, max and count decides. Only series above the target are cut,
    into spans that hold ``target_rows`` rows of all keys together; there can be no more
    than ``rows / target_rows`` of them, which bounds what is broadcast.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high, rows = df.select(F.min(seconds), F.max(seconds), F.count("*")).first()
    if rows <= target_rows:
        return df, None
    count = -(-rows // target_rows)
    width = max(1, (high - low + count) // count)
    hot = df.groupBy(*keys).agg(F.count("*").alias("_c")).filter(F.col("_c") > target_rows)
    hot = hot.select(*keys, F.lit(True).alias("_hot"))
    if rows // target_rows <= MAX_HOT_KEYS:
        hot = F.broadcast(hot)
    span = F.floor((seconds - F.lit(low)) / F.lit(width))
    marked = df.join(hot, keys, "left").withColumn("block", F.when(F.col("_hot"), span).otherwise(F.lit(0)))
    return marked.drop("_hot"), F.col("block")


def index_block(position: str, target_rows: int = TARGET_BLOCK_ROWS) -> Column:
    """Block number from a dense 0-based position inside the series."""
    return F.floor(F.col(position) / F.lit(target_rows))


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], block: Column | None, value: Column, n: int, out: str = "prev"
) -> DataFrame:
    """Add ``out``: the up to ``n`` values before each row in its series, oldest first.

    ``block`` is None when every series is known to be small. Blocks are numbered from 0; a
    series that has no other block needs nothing carried over and takes part in no summary.
    """
    if block is None:
        plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
        return df.withColumn(out, F.collect_list(value).over(plain))
    held = df.withColumn("_block", block).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block")
    ahead = inside.orderBy(*order)
    local = held.withColumn("_local", F.collect_list("_value").over(ahead.rowsBetween(-n, -1))).withColumn(
        "_nth", F.row_number().over(ahead)
    )
    # the last n values of every block, then what earlier blocks hand over to each block
    cut = held.filter(F.col("_block") > 0).select(*keys).distinct()
    tails = (
        held.join(cut, keys, "left_semi")
        .withColumn("_last", F.row_number().over(inside.orderBy(*[F.col(o).desc() for o in order])))
        .filter(F.col("_last") <= n)
        .groupBy(*keys, "_block")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_last")).alias("p"), F.col("_value").alias("v")))).alias("_t"))
        .select(*keys, "_block", F.transform("_t", lambda x: x["v"]).alias("_tail"))
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-n, -1)
    carry = (
        tails.withColumn("_carry", F.flatten(F.collect_list("_tail").over(before)))
        .filter(F.size("_carry") > 0)
        .select(*keys, "_block", F.slice("_carry", -F.least(F.lit(n), F.size("_carry")), n).alias("_carry"))
    )
    # only the first n rows of a block look across its border
    joined = local.join(carry, [*keys, "_block"], "left")
    whole = F.when(
        F.col("_carry").isNotNull() & (F.col("_nth") <= n), F.concat("_carry", "_local")
    ).otherwise(F.col("_local"))
    last_n = F.when(F.size(whole) > n, F.slice(whole, -n, n)).otherwise(whole)
    return joined.select(*[F.col(c) for c in df.columns], last_n.alias(out))


def with_running_total(
    df: DataFrame, keys: list[str], order: list[str], block: Column | None, value: Column, out: str
) -> DataFrame:
    """Add ``out``: the running sum of ``value`` up to and including each row."""
    if block is None:
        plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(plain))
    held = df.withColumn("_block", block).withColumn("_value", value)
    ahead = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = held.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = (
        sums.withColumn("_offset", F.sum("_sum").over(before))
        .filter(F.col("_offset").isNotNull())
        .select(*keys, "_block", "_offset")
    )
    return (
        held.withColumn("_run", F.sum("_value").over(ahead))
        .join(offset, [*keys, "_block"], "left")
        .select(*[F.col(c) for c in df.columns], (F.col("_run") + F.coalesce("_offset", F.lit(0))).alias(out))
    )


def with_key_values(df: DataFrame, summary: DataFrame, keys: list[str], salt_by: list[str], salts: int = 32) -> DataFrame:
    """Join per-key values back to rows; a hot key is split over ``salts`` tasks."""
    fanned = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    return salted.join(fanned, [*keys, "_salt"], "left").drop("_salt")


def sliding_confidence(
    df: DataFrame, keys: list[str], order: list[str], block: Column | None, value: str, window: int = 5
) -> DataFrame:
    """Add ``normalized_confidence``: geometric mean of the last ``window`` values."""
    from mnemora.functions.confidence import geometric_mean

    return (
        with_previous(df, keys, order, block, F.col(value), window - 1, "_prev")
        .withColumn("normalized_confidence", geometric_mean(F.concat("_prev", F.array(value))))
        .drop("_prev")
    )


def declining(df: DataFrame, keys: list[str], order: list[str], block: Column | None, value: str) -> DataFrame:
    """Add ``declining``: the value fell strictly over the last three rows."""
    prev = F.col("_prev")
    return (
        with_previous(df, keys, order, block, F.col(value), 2, "_prev")
        .withColumn(
            "declining",
            (F.size(prev) == 2) & (F.get(prev, F.lit(0)) > F.get(prev, F.lit(1))) & (F.get(prev, F.lit(1)) > F.col(value)),
        )
        .drop("_prev")
    )


def _folded(
    df: DataFrame, keys: list[str], order: list[str], block: Column | None, folds: dict[str, tuple[str, float]], keep: float
) -> DataFrame:
    """``n_values`` per series and, for each name of ``folds``, ``b = keep*b + (1-keep)*x`` over (value, start).

    The recurrence unrolls to a weighted sum whose weight depends only on the distance to the
    end, so it needs no ordered fold.
    """
    placed = with_running_total(df, keys, order, block, F.lit(1), "_n")
    lengths = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    weight = (1 - keep) * F.pow(F.lit(keep), F.col("_rows") - F.col("_n"))
    return (
        with_key_values(placed, lengths, keys, order)
        .groupBy(*keys)
        .agg(
            F.max("_rows").alias("n_values"),
            *[F.sum(F.col(value) * weight).alias(f"_{name}") for name, (value, _) in folds.items()],
        )
        .select(
            *keys,
            "n_values",
            *[
                (F.col(f"_{name}") + F.lit(start) * F.pow(F.lit(keep), F.col("n_values"))).alias(name)
                for name, (_, start) in folds.items()
            ],
        )
    )


def running_baseline(
    df: DataFrame, keys: list[str], order: list[str], block: Column | None, value: str, start: float, keep: float = 0.9
) -> DataFrame:
    """Exponential running mean of single values per series after its last row."""
    return _folded(df, keys, order, block, {"baseline": (value, start)}, keep)


def answer_confidence(df: DataFrame, keys: list[str], answer: list[str], value: str) -> DataFrame:
    """Mean and population variance of the confidences of each answer of a series."""
    return df.groupBy(*keys, *answer).agg(F.avg(value).alias("mean_confidence"), F.var_pop(value).alias("variance"))


def answer_baseline(
    answers: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | None,
    starts: tuple[float, float] = (0.5, 0.1),
    keep: float = 0.9,
) -> DataFrame:
    """Baseline confidence and variance per series, folded over the answers of ``answer_confidence``."""
    folds = {"baseline": ("mean_confidence", starts[0]), "baseline_variance": ("variance", starts[1])}
    return _folded(answers, keys, order, block, folds, keep)


def confidence_patterns(
    df: DataFrame, keys: list[str], order: list[str], block: Column | None, value: str, floor_third: bool = True
) -> DataFrame:
    """One row per series of ten values or more: pattern type, severity and the parts behind them.

    Sudden drops, then degradation from the first to the last third, then repetition of
    3 to 5 values; a later finding names the type, the severity is the largest.
    ``floor_third=False`` sums ceil(n/3) values of the last third as the reference does.
    """
    v = F.col(value)
    # ten earlier values are enough for a pattern of five followed by its copy plus the row after it
    rows = with_previous(df, keys, order, block, v, 10, "_prev")
    rows = with_running_total(rows, keys, order, block, F.lit(1), "_n")
    stats = df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.avg(v).alias("_mean"))
    rows = with_key_values(rows, stats, keys, order)
    prev = F.col("_prev")
    last = F.get(prev, F.size(prev) - 1)
    third = F.floor(F.col("_rows") / 3)
    tail = third if floor_third else F.ceil(F.col("_rows") / 3)

    def similarity(length: int) -> Column:
        # values of the two copies end one row before this one
        gaps = [
            F.abs(F.get(prev, F.size(prev) - 2 * length + i) - F.get(prev, F.size(prev) - length + i))
            for i in range(length)
        ]
        gap = gaps[0]
        for g in gaps[1:]:
            gap = gap + g
        return F.when(F.size(prev) >= 2 * length, F.lit(1.0) - gap / length)

    best = F.greatest(*[similarity(k) for k in (3, 4, 5)])
    drop = last - v
    return (
        rows.groupBy(*keys)
        .agg(
            F.max("_rows").alias("n_values"),
            F.max("_mean").alias("mean_confidence"),
            F.max(F.when((drop > 0.3) & (v < F.col("_mean") * 0.7), drop)).alias("drop_size"),
            F.sum(F.when(F.col("_n") <= third, v)).alias("_first"),
            F.sum(F.when(F.col("_n") > F.col("_rows") - tail, v)).alias("_last"),
            F.max(F.when(best > 0.85, best - 0.85)).alias("_repeat"),
        )
        .filter(F.col("n_values") >= 10)
        .withColumn("_third", F.floor(F.col("n_values") / 3))
        .withColumn("_degradation", F.col("_first") / F.col("_third") - F.col("_last") / F.col("_third"))
        .withColumn(
            "degradation",
            F.when(
                (F.col("n_values") > 20)
                & (F.col("_degradation") > 0.2)
                & (F.col("_last") / F.col("_third") < F.col("mean_confidence") * 0.8),
                F.col("_degradation"),
            ),
        )
        .withColumn("repetition", F.when(F.col("n_values") > 15, F.col("_repeat")))
        .select(
            *keys,
            "n_values",
            "mean_confidence",
            "drop_size",
            "degradation",
            "repetition",
            F.when(F.col("repetition").isNotNull(), "repetition")
            .when(F.col("degradation").isNotNull(), "degradation")
            .when(F.col("drop_size").isNotNull(), "sudden_drop")
            .alias("pattern_type"),
            F.greatest(
                F.coalesce("drop_size", F.lit(0.0)),
                F.coalesce("degradation", F.lit(0.0)),
                F.coalesce("repetition", F.lit(0.0)),
            ).alias("severity"),
        )
    )


def series_metrics(df: DataFrame, keys: list[str], prob: str, factor: float = 0.3) -> DataFrame:
    """Confidence, perplexity, entropy, token count and sharpening gain per series."""
    from mnemora.functions.confidence import sharpen_probability

    p = F.col(prob)
    safe = F.greatest(p, F.lit(1e-10))
    return (
        df.groupBy(*keys)
        .agg(
            F.avg(sharpen_probability(p, factor)).alias("_sharp"),
            F.avg(p).alias("_plain"),
            F.exp(F.avg(-F.log(safe))).alias("perplexity"),
            F.avg(-safe * F.log2(safe)).alias("entropy"),
            F.count(p).alias("tokens"),
        )
        .select(
            *keys,
            F.coalesce("_sharp", F.lit(0.8)).alias("confidence"),
            F.coalesce("perplexity", F.lit(2.0)).alias("perplexity"),
            F.coalesce("entropy", F.lit(1.0)).alias("entropy"),
            "tokens",
            ((F.col("_sharp") - F.col("_plain")) / F.greatest(F.lit(0.01), F.col("_plain")) * 100).alias("enhancement"),
        )
    )


def token_stats(df: DataFrame, keys: list[str], prob: str, cells: int = 4096) -> DataFrame:
    """Count, mean, median, min, max and population deviation per series.

    The median is exact: equal values are counted first, then the counts are summed in
    value order over ``cells`` value ranges, so a hot series is never held in one task.
    """
    p = F.col(prob)
    base = df.groupBy(*keys).agg(
        F.count(p).alias("n"),
        F.avg(p).alias("mean"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
        F.stddev_pop(p).alias("std_dev"),
    )
    counts = df.filter(p.isNotNull()).groupBy(*keys, p.alias("_v")).agg(F.count("*").alias("_c"))
    ranked = with_running_total(counts, keys, ["_v"], F.floor(F.col("_v") * cells), F.col("_c"), "_upto")
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    middle = (
        with_key_values(ranked, base.select(*keys, "n"), keys, ["_v"])
        .groupBy(*keys)
        .agg(
            (
                (F.min(F.when(F.col("_upto") > low, F.col("_v"))) + F.min(F.when(F.col("_upto") > high, F.col("_v"))))
                / 2
            ).alias("median")
        )
    )
    names = ["mean", "median", "min", "max", "std_dev"]
    return base.join(middle, keys, "left").select(
        *keys, "n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names]
    )
