"""The calibrated margin model: optimum, calibration on held-out rows, all categories reachable."""

import numpy as np
from pyspark.sql import functions as F

from mnemora.functions.example_questions import EXAMPLES
from mnemora.operators import model


def test_margin_fit_is_the_minimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 7))
    sign = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    cost = np.where(sign > 0, 1.7, 1.0)
    k = x @ x.T + 1.0
    beta = model.margin_fit(k, sign, cost)
    w = np.append(x.T @ beta, beta.sum())
    xi = np.column_stack([x, np.ones(60)])
    slack = np.maximum(0.0, 1.0 - sign * (xi @ w))
    assert np.abs(w - 2 * xi.T @ (cost * sign * slack)).max() < 1e-8  # the gradient vanishes


def test_sigmoid_fit_recovers_probabilities():
    rng = np.random.default_rng(3)
    margin = rng.normal(size=20_000) * 2
    a, b = model.sigmoid_fit(margin, rng.random(20_000) < 1 / (1 + np.exp(-1.5 * margin + 0.4)))
    assert abs(a + 1.5) < 0.1 and abs(b - 0.4) < 0.1


def test_every_category_is_reached_where_no_rule_matches(spark):
    fitted = model.train(model.example_questions(spark))
    asked = [
        ("divide 90 by 3", "declarative"), ("assembling a shelf on Windows", "procedural_knowledge"),
        ("growing up in the 1980s, win an Olympic medal, climb a mountain", "experiential"),
        ("should I trust someone in my situation and quit my job", "tacit"),
        ("translate bread to Spanish", "explicit"), ("explain the idea of quantum mechanics", "conceptual_knowledge"),
        ("does the legal influence affect businesses and investment strategies", "contextual"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(asked)] + [(90, None), (91, " \n"), (92, "how to swim")], "n int, text string")
    found = {r["n"]: r for r in model.classify(fitted, rows).collect()}
    assert {found[i]["category"] for i in range(len(asked)) if found[i]["decided_by"] == "model"} == set(model.CATEGORIES)
    assert (found[90]["category"], found[91]["decided_by"], found[92]["decided_by"]) == ("unknown", "nothing", "rule")


def test_probabilities_are_calibrated_on_held_out_rows(spark):
    """Noisy words of two classes: among rows given probability p, a share near p is right."""
    rng = np.random.default_rng(4)
    words = {"declarative": "alpha beta gamma".split(), "tacit": "delta epsilon zeta".split()}

    def drawn(n):
        rows = []
        for _ in range(n):
            c = "declarative" if rng.random() < 0.5 else "tacit"
            other = words["tacit" if c == "declarative" else "declarative"]
            rows.append((" ".join(rng.choice(words[c] if rng.random() < 0.65 else other) for _ in range(3)), c))
        return rows

    fitted = model.train(spark.createDataFrame(drawn(1500), "text string, category string"))
    held = spark.createDataFrame(drawn(4000), "text string, category string")
    out = model.predict(fitted, held).select((F.col("category") == F.col("model_category")).cast("int").alias("right"), "model_confidence").toPandas()
    assert abs(out["right"].mean() - out["model_confidence"].mean()) < 0.04
    for _, part in out.groupby((out["model_confidence"] * 5).astype(int)):
        if len(part) > 300:
            assert abs(part["right"].mean() - part["model_confidence"].mean()) < 0.08


def test_held_out_examples_are_mostly_placed(spark):
    """Every fifth example is held out; far more than one in seven is placed right."""
    rows = [(q, c) for c, qs in EXAMPLES.items() for q in qs]
    held, kept = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    fitted = model.train(model.with_variations(spark.createDataFrame(kept, "text string, category string")))
    out = model.predict(fitted, spark.createDataFrame(held, "text string, category string"))
    assert out.where("category = model_category").count() > len(held) * 0.5
