"""Classifiers over a feature table: a column of features, a column ``label``.

A model here has ``fit(df)`` and gives something with ``transform(df)`` that adds ``prediction``
and the vector ``probability``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.operators.nearest import nearest
from sessionlore.plans.trees import Settings, Trees

FEATURES, LABEL = "features", "label"

# Recorded settings of the forests: number of trees and what else was set.
FOREST_SETTINGS = {
    "holdout": Settings(1000),
    "bake_off": Settings(83),
    "selection": Settings(50),
    "small": Settings(33),
    "bagged": Settings(10_000, depth=6),
    "tuned": Settings(1400, depth=80, leaf=4, split=5),
}


def assemble(df: DataFrame, columns: Sequence[str], label: str = "accuracy_group") -> DataFrame:
    """Adds the feature vector and, where there is one, the label. Missing features count as 0."""
    filled = df.fillna(0, subset=[c for c in columns])
    out = VectorAssembler(inputCols=list(columns), outputCol=FEATURES).transform(filled)
    return out.withColumn(LABEL, F.col(label).cast("double")) if label in df.columns else out


def forest(trees: int = 100, depth: int | None = None, seed: int = 42, **more) -> Trees:
    return Trees(Settings(trees, depth, seed=seed, **more))


def forest_of(name: str, seed: int = 42) -> Trees:
    return Trees(FOREST_SETTINGS[name]).copy(seed=seed)


def boosted_multi(rounds: int = 100, depth: int = 3, seed: int = 42) -> Trees:
    """Boosted trees for several classes: in each round one regression tree per class on what is left of it."""
    return Trees(Settings(rounds, depth, "all", kind="softmax", seed=seed))


def tree(depth: int | None = None, seed: int = 42) -> Trees:
    return Trees(Settings(1, depth, "all", draw=False, seed=seed))


def bagging(trees: int = 10, depth: int | None = None, seed: int = 42) -> Trees:
    return Trees(Settings(trees, depth, "all", seed=seed))


def extra_trees(trees: int = 10, depth: int | None = None, seed: int = 42) -> Trees:
    """Trees on all rows with random features, each with one random threshold."""
    return Trees(Settings(trees, depth, draw=False, drawn_thresholds=True, seed=seed))


def boosted_stumps(rounds: int = 50, depth: int = 1, seed: int = 42) -> Trees:
    """Multi-class boosting of one-split trees, each fitted to rows reweighted by the misses so far."""
    return Trees(Settings(rounds, depth, "all", kind="stumps", seed=seed))


def logistic(iterations: int = 100) -> LogisticRegression:
    return LogisticRegression(maxIter=iterations)


def one_vs_rest_logistic(iterations: int = 100) -> OneVsRest:
    return OneVsRest(classifier=LogisticRegression(maxIter=iterations))


def network(inputs: int, classes: int, hidden: Sequence[int] = (100,), iterations: int = 200,
            seed: int = 42) -> Pipeline:
    scaler = StandardScaler(inputCol=FEATURES, outputCol="scaled", withMean=True)
    net = MultilayerPerceptronClassifier(
        featuresCol="scaled", layers=[inputs, *hidden, classes], maxIter=iterations, seed=seed
    )
    return Pipeline(stages=[scaler, net])


def classes_of(df: DataFrame, label: str = LABEL) -> list[float]:
    rows = df.select(label).distinct().collect()
    return sorted(r[0] for r in rows)


def first_largest(scores: Column) -> Column:
    """0-based place of the largest value, the first on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def shares(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.transform(scores, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


@dataclass
class NearestVote:
    """Vote of the k nearest rows; ``key`` names the columns that tell rows apart."""

    k: int = 5
    key: Sequence[str] = ("row_key",)

    def fit(self, df: DataFrame) -> NearestVoteModel:
        return NearestVoteModel(df.select(*self.key, FEATURES, LABEL), self.k, list(self.key), int(max(classes_of(df))) + 1)


@dataclass
class NearestVoteModel:
    known: DataFrame
    k: int
    key: list
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        name = F.to_json(F.struct(*self.key))  # the key itself, as one value

        def side(d, *more):
            return d.select(name.alias("id"), vector_to_array(FEATURES).alias("vector"), *more)

        found = nearest(side(self.known, LABEL), side(df), self.k)
        votes = found.groupBy(F.col("query").alias("_id")).agg(*[
            F.sum((F.col(LABEL) == c).cast("double")).alias(f"v{c}") for c in range(self.classes)
        ]).withColumn("_votes", F.array(*[f"v{c}" for c in range(self.classes)]))
        votes = votes.select(
            "_id", first_largest(F.col("_votes")).alias("prediction"),
            array_to_vector(shares(F.col("_votes"))).alias("probability"),
        )
        return df.withColumn("_id", name).join(votes, "_id").drop("_id")


@dataclass
class Ordinal:
    """One two-class model per threshold; class probabilities are differences of theirs.

    Thresholds are places in the sorted classes, so classes should be 0..K-1. Nothing is fitted
    for two classes or fewer.
    """

    base: object
    models: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> OrdinalModel:
        classes = classes_of(df)
        models = []
        if len(classes) > 2:
            for value in classes[:-1]:
                above = df.withColumn(LABEL, (F.col(LABEL) > value).cast("double"))
                models.append(self.base.copy().fit(above))
        return OrdinalModel(models, len(classes))


def ordinal_shares(above: Sequence[Column]) -> Column:
    """Class probabilities from P(y > v) per threshold."""
    first = 1 - above[0]
    middle = [above[i - 1] - above[i] for i in range(1, len(above))]
    return F.array(first, *middle, above[-1])


@dataclass
class OrdinalModel:
    models: list
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.models:
            raise ValueError("an ordinal model needs more than two classes")
        out = df
        for i, model in enumerate(self.models):
            out = model.transform(out).withColumn(f"_above{i}", vector_to_array("probability")[1])
            out = out.drop("rawPrediction", "probability", "prediction")
        above = [F.col(f"_above{i}") for i in range(len(self.models))]
        out = out.withColumn("_shares", ordinal_shares(above))
        return out.withColumns({
            "prediction": first_largest(F.col("_shares")), "probability": array_to_vector(F.col("_shares")),
        }).drop("_shares", *[f"_above{i}" for i in range(len(self.models))])


def importances(model, columns: Sequence[str]):
    values = model.featureImportances
    return sorted(((c, float(values[i])) for i, c in enumerate(columns)), key=lambda p: (-p[1], p[0]))


def importance_table(spark, model, columns: Sequence[str]) -> DataFrame:
    """(feature, importance), descending: one row per column of the table."""
    rows = importances(model, columns)
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
