"""Logistic regression by reweighted least squares next to a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keytempo.operators import models


def plain(x, y, rounds=6, ridge=1.0):
    """Coefficients of each fitted class on all rows at once."""
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    z = np.c_[np.ones(len(z)), z]
    found, counts = np.unique(y, return_counts=True)
    weight = (len(y) / (len(found) * counts))[np.searchsorted(found, y)]
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    out = {}
    for c in found[1:] if len(found) == 2 else found:
        b = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z @ b))
            square = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty
            b = b + np.linalg.solve(square, z.T @ (weight * ((y == c) - p)) - penalty @ b)
        out[int(c)] = b
    return out, z


def sample(classes, n=600, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n) * rng.integers(0, 2, n)  # class 0 holds more than half
    x = rng.normal(0, 1, (n, 3)) + y[:, None] * np.array([0.8, -0.4, 0.0])
    x[:, 2] = 5.0  # a constant input
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(y, x)], "label_id int, a double, b double, c double")


@pytest.mark.parametrize("classes", [2, 4])
def test_coefficients_and_probabilities(spark, classes):
    x, y = sample(classes)
    df = frame(spark, x, y)
    model = models.fit_newton_logistic(df, ["a", "b", "c"])
    want, z = plain(x, y)
    assert sorted(model.coefficients) == sorted(want)
    for c, b in want.items():
        assert np.allclose(model.coefficients[c], b, atol=1e-8)
    p = np.stack([1 / (1 + np.exp(-z @ want[c])) for c in sorted(want)], 1)
    p = np.c_[1 - p, p] if classes == 2 else p / p.sum(1, keepdims=True)
    scored, rejected = models.score_windows(model, df.withColumn("n", F.monotonically_increasing_id()), ["a", "b", "c"])
    got = scored.orderBy("n").collect()
    assert np.allclose([r.probabilities for r in got], p, atol=1e-8)
    assert [r.predicted_id for r in got] == list(p.argmax(1))
    assert np.allclose([r.confidence for r in got], p.max(1), atol=1e-8)
    assert rejected.count() == 0


def test_unusable_rows_are_not_learned_and_rejected(spark):
    x, y = sample(2)
    df = frame(spark, x, y)
    odd = spark.createDataFrame([(1, None, 1.0, 1.0), (0, float("nan"), 1.0, 1.0), (-1, 90.0, 1.0, 1.0), (None, 90.0, 1.0, 1.0),
                                 (1, float("inf"), 1.0, 1.0)], df.schema)
    model = models.fit_newton_logistic(df.union(odd), ["a", "b", "c"])
    want, _ = plain(x, y)
    assert np.allclose(model.coefficients[1], want[1], atol=1e-8)
    scored, rejected = models.score_windows(model, odd, ["a", "b", "c"])
    assert scored.count() == 2 and rejected.count() == 3
    assert {r.reason for r in rejected.collect()} == {"non_finite_values"}


def test_separable_classes_have_finite_scores(spark):
    x = np.c_[np.arange(40.0), np.zeros(40), np.zeros(40)]
    model = models.fit_newton_logistic(frame(spark, x, (x[:, 0] >= 20).astype(int)), ["a", "b", "c"], rounds=20)
    assert np.isfinite(model.coefficients[1]).all()
    with pytest.raises(ValueError, match="two classes"):
        models.fit_newton_logistic(frame(spark, x, np.ones(40, int)), ["a", "b", "c"])


def test_classes_seen_only_in_scoring_get_probability_zero(spark):
    x, y = sample(2)
    model = models.fit_newton_logistic(frame(spark, x, y * 2), ["a", "b", "c"])
    scored, _ = models.score_windows(model, frame(spark, x[:5], y[:5]), ["a", "b", "c"])
    assert {len(r.probabilities) for r in scored.collect()} == {3}
    assert {r.probabilities[1] for r in scored.collect()} == {0.0}
