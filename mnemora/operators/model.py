"""Learned fallback of the question classifier: margin models over word 1- and 2-grams, calibrated by cross-fitting.

For each fold and category a linear model with squared hinge loss separates the category from the others on
the other folds. What it says about the fold it has not seen fits a sigmoid from margin to probability. A
prediction is the mean over folds of these probabilities, brought to a sum of one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import rules
from mnemora.functions.classify import content_category, rule_category
from mnemora.functions.example_questions import EXAMPLES

CATEGORIES = list(rules.SUBCATEGORIES)
FOLDS = 5
# Bounds of the training sample: rows by hash, features by frequency.
MAX_EXAMPLES, MAX_FEATURES = 2_000, 50_000
PENALTY = 1.0
WORD = re.compile(r"\b\w\w+\b")


def question_variations(question: Column) -> Column:
    """Other wordings of a training question: without its mark, with lead-ins, as a need."""
    q = F.lower(question)
    asks = q.rlike("^(what|how|who|when|where|why)")
    how = F.contains(q, F.lit("how to")) | F.contains(q, F.lit("how do"))
    return F.array_compact(
        F.array(
            F.when(F.endswith(q, F.lit("?")), F.regexp_replace(q, r"\?\z", "")),
            F.when(~asks, F.concat(F.lit("what is "), q)),
            F.concat(F.lit("I want to know "), q),
            F.concat(F.lit("tell me "), q),
            F.when(how, F.replace(q, F.lit("how to"), F.lit("I need to"))),
            F.when(how, F.replace(q, F.lit("how do"), F.lit("I need to know how to"))),
        )
    )


def with_variations(examples: DataFrame, text: str = "text", category: str = "category") -> DataFrame:
    """Training rows together with their variations."""
    return examples.select(
        F.explode(F.concat(F.array(text), question_variations(F.col(text)))).alias(text), category
    ).distinct()


def example_questions(spark: SparkSession) -> DataFrame:
    """(text, category): the built-in examples with their variations, copies kept as they weigh."""
    rows = [(q, c) for c, questions in EXAMPLES.items() for q in questions]
    frame = spark.createDataFrame(rows, "text string, category string")
    return frame.select(F.explode(F.concat(F.array("text"), question_variations(F.col("text")))).alias("text"), "category")


def grams(text: str | None) -> list[str]:
    """Words of two letters or more and pairs of neighbours."""
    words = WORD.findall((text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@dataclass
class Counts:
    """Gram counts of texts, row by row: ``columns[starts[i]:starts[i + 1]]`` hold ``values``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], vocabulary: dict[str, int]) -> Counts:
        starts, columns, values = [0], [], []
        for text in texts:
            found = Counter(vocabulary[g] for g in grams(text) if g in vocabulary)
            columns += found.keys()
            values += found.values()
            starts.append(len(columns))
        return cls(np.array(starts), np.array(columns, dtype=np.int64), np.array(values, dtype=np.float64))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def products(self, width: int, step: int = 2048) -> np.ndarray:
        """Inner products of all rows, added up over blocks of columns."""
        n, row = len(self.starts) - 1, self.rows()
        out = np.zeros((n, n))
        for low in range(0, width, step):
            here = (self.columns >= low) & (self.columns < low + step)
            block = np.zeros((n, min(step, width - low)))
            block[row[here], self.columns[here] - low] = self.values[here]
            out += block @ block.T
        return out

    def weighted(self, weights: np.ndarray, width: int) -> np.ndarray:
        """The sum of all rows, each times its weight."""
        return np.bincount(self.columns, weights=self.values * weights[self.rows()], minlength=width)

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """Every row times every column of weights (features x models)."""
        out = np.zeros((len(self.starts) - 1, weights.shape[1]))
        np.add.at(out, self.rows(), weights[self.columns] * self.values[:, None])
        return out


def margin_fit(products: np.ndarray, sign: np.ndarray, cost: np.ndarray, turns: int = 100) -> np.ndarray:
    """Row weights of the minimum of |w|^2 / 2 + sum of cost * max(0, 1 - sign * margin)^2.

    Newton steps: rows inside the margin have a linear system, the others weigh nothing. A step is halved while it
    makes the loss larger.
    """
    def loss(b: np.ndarray) -> float:
        f = products @ b
        return 0.5 * b @ f + (cost * np.maximum(0.0, 1.0 - sign * f) ** 2).sum()

    beta = np.zeros(len(sign))
    for _ in range(turns):
        inside = sign * (products @ beta) < 1.0
        new = np.zeros(len(sign))
        if inside.any():
            system = products[np.ix_(inside, inside)] + np.diag(0.5 / cost[inside])
            new[inside] = np.linalg.solve(system, sign[inside])
        share, before = 1.0, loss(beta)
        while share > 1e-6 and loss(beta + share * (new - beta)) > before + 1e-12:
            share /= 2
        moved = beta + share * (new - beta)
        if np.allclose(moved, beta, atol=1e-10):
            break
        beta = moved
    return beta


def sigmoid_fit(margin: np.ndarray, positive: np.ndarray, turns: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a * margin + b)) by maximum likelihood; targets are drawn in by the class counts."""
    n = positive.sum()
    target = np.where(positive, (n + 1.0) / (n + 2.0), 1.0 / (len(margin) - n + 2.0))
    x = np.column_stack([margin, np.ones(len(margin))])
    at = np.array([0.0, np.log((len(margin) - n + 1.0) / (n + 1.0))])
    loss = lambda v: (np.logaddexp(0.0, x @ v) - (1.0 - target) * (x @ v)).sum()
    for _ in range(turns):
        p = 1.0 / (1.0 + np.exp(np.clip(x @ at, -500, 500)))
        slope = x.T @ (target - p)
        curve = (x * (p * (1.0 - p))[:, None]).T @ x + 1e-12 * np.eye(2)
        step, share = np.linalg.solve(curve, slope), 1.0
        while share > 1e-8 and loss(at - share * step) > loss(at):
            share /= 2
        at = at - share * step
        if np.abs(share * step).max() < 1e-10:
            break
    return float(at[0]), float(at[1])


@dataclass
class CalibratedModel:
    """Weights (features x models), intercepts and sigmoids; model number fold * categories + category."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    intercepts: np.ndarray
    sigmoids: np.ndarray

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        margin = Counts.of(texts, self.vocabulary).margins(self.weights) + self.intercepts
        p = 1.0 / (1.0 + np.exp(np.clip(margin * self.sigmoids[:, 0] + self.sigmoids[:, 1], -500, 500)))
        p = p.reshape(len(texts), -1, len(self.categories))
        return (p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300)).mean(axis=1)


def train(
    examples: DataFrame, text: str = "text", category: str = "category", folds: int = FOLDS,
    max_examples: int = MAX_EXAMPLES, max_features: int = MAX_FEATURES,
) -> CalibratedModel:
    """Fit on labelled examples, a category's own rows weighted against its frequency.

    At most ``max_examples`` rows, drawn by the hash of text and category, come to the driver and are sent to the
    tasks; one task fits each fold of each category. Categories with a single row are not learned; rows
    of null text or category are left out.
    """
    spark = examples.sparkSession
    known = examples.select(F.col(text).alias("t"), F.col(category).alias("c")).where("t is not null and c is not null")
    drawn = known.orderBy(F.xxhash64("t", "c"), "t", "c").limit(max_examples).collect()
    sizes = Counter(r["c"] for r in drawn)
    names = [c for c in [*CATEGORIES, *sorted(set(sizes) - set(CATEGORIES))] if sizes[c] > 1]
    drawn = [r for r in drawn if r["c"] in names]
    folds = min(folds, min((sizes[c] for c in names), default=0))
    if folds < 2 or len(names) < 2:
        raise ValueError("two categories with two examples each are needed")
    frequent = Counter(g for r in drawn for g in set(grams(r["t"])))
    order = sorted(frequent, key=lambda g: (-frequent[g], g))[:max_features]
    vocabulary = {g: i for i, g in enumerate(order)}
    label = np.array([names.index(r["c"]) for r in drawn])
    # Folds take each category's rows in turn, so every fold has all of them.
    fold = np.zeros(len(drawn), dtype=np.int64)
    for c in range(len(names)):
        fold[label == c] = np.arange(sizes[names[c]]) % folds
    shared = spark.sparkContext.broadcast((Counts.of([r["t"] for r in drawn], vocabulary), label, fold))
    width, n_names = len(vocabulary), len(names)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, label, fold = shared.value
        products = None
        for batch in batches:
            if products is None:
                products = counts.products(width) + 1.0  # the intercept is a feature of every row
            for k in batch["id"]:
                f, c = divmod(int(k), n_names)
                seen, own = fold != f, label == c
                balance = seen.sum() / (n_names * max(1, (seen & own).sum()))
                cost = np.where(own, PENALTY * balance, PENALTY)[seen]
                beta = np.zeros(len(label))
                beta[seen] = margin_fit(products[np.ix_(seen, seen)], np.where(own, 1.0, -1.0)[seen], cost)
                a, b = sigmoid_fit((products @ beta)[~seen], own[~seen])
                weights = counts.weighted(beta, width)
                yield pd.DataFrame({"id": [k], "w": [weights.tobytes()], "i": [beta.sum()], "a": [a], "b": [b]})

    numbers = spark.range(0, folds * n_names, 1, min(folds * n_names, max(1, spark.sparkContext.defaultParallelism)))
    found = sorted(numbers.mapInPandas(fit, "id bigint, w binary, i double, a double, b double").collect())
    weights = np.column_stack([np.frombuffer(r["w"]) for r in found])
    return CalibratedModel(
        names, vocabulary, weights, np.array([r["i"] for r in found]), np.array([(r["a"], r["b"]) for r in found])
    )


def predict(model: CalibratedModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``model_category`` and its probability as ``model_confidence``; ties go to the first category."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(batch.column(batch.schema.get_field_index(text)).to_pylist())
            best = p.argmax(axis=1)
            names = pa.array([shared.value.categories[i] for i in best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, names, pa.array(p[np.arange(len(best)), best])],
                names=[*batch.schema.names, "model_category", "model_confidence"],
            )

    return df.mapInArrow(named, f"{schema}, model_category string, model_confidence double")


def classify(model: CalibratedModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``category``, ``confidence`` and ``decided_by``: a rule, else the model, else plain heuristics.

    A blank or missing text is ``unknown`` with a confidence of 0.5. Only texts that no rule places go to the model.
    """
    ruled = df.withColumn("_rule", rule_category(F.col(text)))
    blank = F.coalesce(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")) == "", F.lit(True))
    placed = ruled.where(F.col("_rule").isNotNull() | blank)
    placed = placed.select(
        *df.columns,
        F.when(blank, "unknown").otherwise(F.col("_rule")).alias("category"),
        F.when(blank, 0.5).otherwise(0.95).alias("confidence"),
        F.when(blank, "nothing").otherwise(F.lit("rule")).alias("decided_by"),
    )
    open_ = predict(model, ruled.where(F.col("_rule").isNull() & ~blank).drop("_rule"), text)
    learned = open_.select(
        *df.columns,
        content_category(F.col(text), F.col("model_category"), F.lit(None).cast("string")).alias("category"),
        F.col("model_confidence").alias("confidence"),
        F.lit("model").alias("decided_by"),
    )
    return placed.unionByName(learned)
