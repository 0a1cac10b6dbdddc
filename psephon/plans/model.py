"""Boosted trees on Spark ML: fit, predict, a seeded grid search over folds, ranked importances.

Missing values are replaced by the training median and flagged by a column of their own. Penalties on leaf weights
have no counterpart in Spark's trees, so scores are not those of other libraries.
"""

from __future__ import annotations

import itertools
import random
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephon.operators import evaluation as ev


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    doubles = {f"x_{c}": F.col(c).cast("double") for c in features}
    return df.withColumns(doubles | {f"x_{c}_missing": F.col(c).isNull().cast("double") for c in features})


def fit(df: DataFrame, features: list[str], label: str, **params):
    filled = [f"i_{c}" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=[f"x_{c}" for c in features], outputCols=filled),
        VectorAssembler(inputCols=[*filled, *[f"x_{c}_missing" for c in features]], outputCol="vector"),
        GBTClassifier(featuresCol="vector", labelCol=label, seed=42, **params),
    ]
    return Pipeline(stages=stages).fit(prepared(df, features))


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(prepared(df, features)).withColumn("p", vector_to_array("probability")[1])


def grid_search(df: DataFrame, features: list[str], label: str, fold: str, folds: list[int], grid: dict, n: int = 150, seed: int = 0) -> dict:
    """Of ``n`` seeded points of the grid, that of best mean area over the folds; the first of equals."""
    points = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    random.Random(seed).shuffle(points)
    df = df.persist()
    best, best_mean = points[0], float("-inf")
    for point in points[:n]:
        areas = []
        for k in folds:
            scored = predict(fit(df.filter(F.col(fold) != k), features, label, **point), df.filter(F.col(fold) == k), features)
            areas.append(ev.auc(scored, [], label, "p").first()[0])
        known = [a for a in areas if a is not None]
        mean = sum(known) / len(known) if known else float("-inf")
        if mean > best_mean:
            best, best_mean = point, mean
    df.unpersist()
    return best


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: list[int], params: dict) -> DataFrame:
    """All rows of ``folds``, labelled or not, with ``p`` by the model of the other folds' labelled rows."""
    known = df.filter(F.col(label).isNotNull())
    parts = [predict(fit(known.filter(F.col(fold) != k), features, label, **params), df.filter(F.col(fold) == k), features) for k in folds]
    return reduce(DataFrame.unionByName, [p.select(*df.columns, "p") for p in parts])


def importances(df: DataFrame, features: list[str], label: str, params: dict) -> DataFrame:
    """(feature, gain_importance, rank)."""
    model = fit(df, features, label, **params).stages[-1]
    names = [*features, *[f"{c}_missing" for c in features]]
    ordered = sorted(zip(names, model.featureImportances.toArray().tolist(), strict=True), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame([(f, g, i) for i, (f, g) in enumerate(ordered, 1)], "feature string, gain_importance double, rank int")
