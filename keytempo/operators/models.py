"""Classical classifiers on window vectors, batch scoring and session probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytempo.operators.groups import pin
from keytempo.operators.scaling import class_weights


def fit_baseline_classifier(
    train: DataFrame, features: Sequence[str], label: str = "label_id",
    kind: str = "random_forest", seed: int = 42,
) -> PipelineModel:
    """Random forest (100 trees of depth 6) or logistic regression with balanced weights."""
    weights = class_weights(train, label).select(label, "class_weight")
    # One row per class.
    weighted = train.join(weights, label)
    common = {"featuresCol": "_vector", "labelCol": label, "weightCol": "class_weight"}
    if kind == "logistic_regression":
        model = LogisticRegression(maxIter=1000, **common)
    elif kind == "random_forest":
        model = RandomForestClassifier(numTrees=100, maxDepth=6, seed=seed, **common)
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    assembler = VectorAssembler(inputCols=list(features), outputCol="_vector",
                                handleInvalid="skip")
    return Pipeline(stages=[assembler, model]).fit(weighted)


@dataclass(frozen=True)
class NewtonLogistic:
    """Coefficients (intercept first) per fitted class on standardised features.

    Two classes have one fitted class, the larger number; more classes are fitted each against the rest and their
    probabilities are divided by their sum.  ``classes`` is one more than the largest class number.
    """

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: dict[int, tuple[float, ...]]
    other: int | None
    classes: int

    def probabilities(self) -> Column:
        """An array with a probability per class number; 0 for numbers that training has not seen."""
        inputs = [(F.col(f) - m) / s for f, m, s in zip(self.features, self.means, self.scales)]
        each = {c: _logistic(b, inputs) for c, b in self.coefficients.items()}
        if self.other is not None:
            each[self.other] = 1.0 - next(iter(each.values()))
            return F.array(*[each.get(c, F.lit(0.0)) for c in range(self.classes)])
        raw = F.array(*[each.get(c, F.lit(0.0)) for c in range(self.classes)])
        total = F.aggregate(raw, F.lit(0.0), lambda a, p: a + p)
        return F.transform(raw, lambda p: p / total)


def _logistic(coefficients: Sequence[float], inputs: Sequence[Column]) -> Column:
    eta = reduce(lambda a, bx: a + F.lit(float(bx[0])) * bx[1], zip(coefficients[1:], inputs),
                 F.lit(float(coefficients[0])))
    return 1.0 / (1.0 + F.exp(-eta))


def fit_newton_logistic(
    train: DataFrame, features: Sequence[str], label: str = "label_id", rounds: int = 6, ridge: float = 1.0,
) -> NewtonLogistic:
    """Logistic regression with balanced weights by ``rounds`` steps of iteratively reweighted least squares.

    A step sums the normal equations over all training rows, with partial sums before the shuffle; only these sums, one
    square of the number of features per class, reach the driver, where they are solved.  ``ridge`` is added to the
    diagonal but for the intercept, so repeated or constant features and separable classes have a solution.  Rows with
    a null or negative label or a value that is not finite are not learned from; the columns of other names are ignored.
    """
    rows = train.filter((F.col(label) >= 0) & ~_unusable(features)).select(F.col(label).cast("int").alias("_y"), *features)
    rows = pin(rows)
    moments = rows.agg(*[g(f).alias(f"{n}_{i}") for i, f in enumerate(features)
                         for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    # One row per class.
    weights = {r["_y"]: r["class_weight"] for r in class_weights(rows, "_y").collect()}
    if len(weights) < 2:
        raise ValueError("training needs rows of two classes at least")
    means = tuple(moments[f"m_{i}"] for i in range(len(features)))
    scales = tuple(moments[f"s_{i}"] or 1.0 for i in range(len(features)))
    fitted = [max(weights)] if len(weights) == 2 else sorted(weights)
    inputs = [(F.col(f) - m) / s for f, m, s in zip(features, means, scales)]
    terms = [F.lit(1.0), *inputs]
    weight = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])[F.col("_y")]
    size = len(terms)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    penalty = np.diag([0.0] + [ridge] * len(features))
    beta = {c: np.zeros(size) for c in fitted}
    for _ in range(rounds):
        sums = []
        for c in fitted:
            p = _logistic(beta[c], inputs)
            curve, slope = weight * p * (1.0 - p), weight * ((F.col("_y") == c).cast("double") - p)
            sums += [F.sum(curve * terms[i] * terms[j]) for i, j in upper] + [F.sum(slope * t) for t in terms]
        got = np.array(rows.agg(*[s.alias(f"v{k}") for k, s in enumerate(sums)]).first(), float)
        for c, part in zip(fitted, got.reshape(len(fitted), -1)):
            square = np.zeros((size, size))
            for (i, j), v in zip(upper, part):
                square[i, j] = square[j, i] = v
            beta[c] = beta[c] + np.linalg.solve(square + penalty, part[len(upper):] - penalty @ beta[c])
    other = min(weights) if len(weights) == 2 else None
    return NewtonLogistic(tuple(features), means, scales, {c: tuple(map(float, b)) for c, b in beta.items()},
                          other, max(weights) + 1)


def _unusable(features: Sequence[str]) -> Column:
    """Whether a value is null or not finite."""
    return reduce(lambda a, b: a | b, [
        F.col(f).isNull() | F.isnan(f) | (F.abs(F.col(f)) == F.lit(float("inf"))) for f in features], F.lit(False))


def score_windows(
    model: PipelineModel | NewtonLogistic, windows: DataFrame, features: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, rejected rows).  Rows with values that are not finite are rejected."""
    marked = windows.withColumn("_bad", _unusable(features))
    usable = marked.filter(~F.col("_bad"))
    if isinstance(model, NewtonLogistic):
        scored = usable.withColumn("probabilities", model.probabilities()).drop("_bad")
        best = F.array_max("probabilities")
        scored = scored.withColumns({
            "predicted_id": (F.array_position("probabilities", best) - 1).cast("int"), "confidence": best})
    else:
        probs = vector_to_array("probability")
        scored = model.transform(usable).withColumns({
            "probabilities": probs,
            "predicted_id": F.col("prediction").cast("int"),
            "confidence": F.array_max(probs),
        }).drop("_bad", "_vector", "rawPrediction", "probability", "prediction")
    rejected = marked.filter("_bad").drop("_bad").withColumn(
        "reason", F.lit("non_finite_values"))
    return scored, rejected


def session_probability(
    scored: DataFrame, keys: Sequence[str] = ("user_id", "session_id"),
    probabilities: str = "probabilities",
) -> DataFrame:
    """Mean probability per class over the windows of a session.

    A single output is the probability of class 1; class 0 gets the rest.
    """
    p = F.col(probabilities)
    full = F.when(F.size(p) == 1, F.array(1.0 - p[0], p[0])).otherwise(p)
    return (
        scored.select(*keys, F.posexplode(full).alias("class_id", "_p"))
        .groupBy(*keys, "class_id").agg(F.avg("_p").alias("mean_probability"),
                                        F.count(F.lit(1)).alias("windows"))
    )
