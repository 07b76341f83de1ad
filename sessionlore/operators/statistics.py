"""Counts, summaries, correlation and agreement of two ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlore.functions.scalars import clip, fisher_z, inverse_fisher_z
from sessionlore.operators.history import Blocks, Total
from sessionlore.session import materialize

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def count_bounds(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest class count."""
    return value_counts(df, column).agg(F.min("count").alias("smallest"), F.max("count").alias("largest"))


def proportions(df: DataFrame, column: str) -> DataFrame:
    """Share of each value, ascending."""
    counts = value_counts(df, column)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select(column, (F.col("count") / total).alias("proportion")).orderBy("proportion", column)


def least_frequent(df: DataFrame, column: str) -> DataFrame:
    """The rarest value, the smallest of them on a tie."""
    return value_counts(df, column).orderBy("count", column).limit(1)


def row_mode(predictions: DataFrame, keys: Sequence[str], column: str = "prediction") -> DataFrame:
    """Most frequent prediction per key, the smallest on a tie."""
    return predictions.groupBy(*keys).agg(F.mode(column, True).cast("int").alias(column))


def weighted_vote(predictions: DataFrame, keys: Sequence[str], column: str = "prediction",
                  weight: str = "weight") -> DataFrame:
    """Prediction of the largest total weight per key, the smallest on a tie."""
    sums = predictions.groupBy(*keys, column).agg(F.sum(weight).alias("w"))
    best = F.max(F.struct(F.col("w"), (-F.col(column)).alias("p")))
    return sums.groupBy(*keys).agg((-best["p"]).cast("int").alias(column))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, of all numeric ones if none are named; quartiles
    are interpolated.

    Values are counted first, then a running count over all distinct values gives the ranks: no
    task sees a whole column.
    """
    columns = numeric_columns(df) if columns is None else columns
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column", "value")
    long = long.where(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = Blocks().over(counts, ["column"], ["value"], {"upto": Total(F.col("n"))})
    # One row per column name, which are as few as the columns of a table.
    ranked = ranked.join(F.broadcast(moments.select("column", "count")), "column")
    picks = []
    for name, share in QUARTILES.items():
        place = (F.col("count") - 1) * share
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"{name}_{side}"))
    found = ranked.groupBy("column").agg(*picks)
    both = moments.join(found, "column")
    quartiles = []
    for name, share in QUARTILES.items():
        place = (F.col("count") - 1) * share
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        quartiles.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return both.select("column", "count", "mean", "std", "min", *quartiles, "max")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null for a constant column."""
    x, y = x.cast("double"), y.cast("double")
    known = F.when(x.isNotNull() & y.isNotNull(), x), F.when(x.isNotNull() & y.isNotNull(), y)
    return F.try_divide(F.covar_pop(*known), F.stddev_pop(known[0]) * F.stddev_pop(known[1]))


def correlations(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Correlation of every column with the label, in one pass: rows (feature, correlation)."""
    wide = df.agg(*[correlation(F.col(f"`{c}`"), F.col(label)).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("correlation")) for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(pairs))


#: Ratings between the lowest and the highest up to which a grid of them is made; a stray value beyond is an error.
MOST_RATINGS = 1000


def _range(cells: DataFrame, columns: Sequence[str], lowest: int | None, highest: int | None) -> tuple[int, int]:
    ends = [f(c) for c in columns for f in (F.min, F.max)]
    found = [v for v in cells.agg(*ends).first() if v is not None]
    low, high = [v for v in (lowest, *found) if v is not None], [v for v in (highest, *found) if v is not None]
    low, high = min(low, default=0), max(high, default=0)
    if high - low >= MOST_RATINGS:
        raise ValueError(f"ratings from {low} to {high}: more than {MOST_RATINGS} classes")
    return low, high


def confusion(df: DataFrame, a: str, b: str, lowest: int | None = None, highest: int | None = None) -> DataFrame:
    """Counts for every pair of ratings in the range, zeros kept; ratings outside a given range widen it."""
    counts = df.groupBy(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # The few cells are written, so that their range does not cost another pass over the data.
    counts = materialize(counts)
    lowest, highest = _range(counts, ["a", "b"], lowest, highest)
    ratings = F.sequence(F.lit(lowest), F.lit(highest))
    grid = df.sparkSession.range(1).select(F.explode(ratings).alias("a")).select(
        "a", F.explode(ratings).alias("b")
    )
    return grid.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, rating: str, lowest: int | None = None, highest: int | None = None) -> DataFrame:
    counts = df.groupBy(F.col(rating).cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts)
    lowest, highest = _range(counts, ["rating"], lowest, highest)
    grid = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(lowest), F.lit(highest))).alias("rating"))
    return grid.join(counts, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))


def quadratic_kappa(a: str, b: str) -> Column:
    """Quadratic weighted kappa as one aggregate; null when only one rating occurs.

    The expected squared distance of two independent ratings needs their first two moments only,
    so no matrix is built.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    seen = F.avg((x - y) * (x - y))
    chance = F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)
    return 1 - F.try_divide(seen, chance)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unweighted kappa: one row."""
    cells = df.groupBy(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n")
    agreed = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0))
    seen = cells.agg(total.cast("double").alias("n"), agreed.cast("double").alias("agreed"))
    # Each cell once as a rating of the first and once of the second: the marginals side by side.
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("a").alias("r"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")),
        F.struct(F.col("b").alias("r"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")),
    )).alias("m")).select("m.*").groupBy("r").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    chance = sides.agg(
        F.try_divide(
            F.sum(F.col("na").cast("double") * F.col("nb")), F.sum("na").cast("double") * F.sum("na")
        ).alias("chance")
    )
    one = seen.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k")
    return one.select(
        (1 - F.try_divide(1 - F.col("agreed") / F.col("n"), 1 - F.col("chance"))).alias("kappa")
    )


def mean_kappa(kappas: DataFrame, kappa_column: str = "kappa", weight: str | None = None) -> DataFrame:
    """Mean of kappas in Fisher's z, weights scaled to a mean of 1."""
    z = fisher_z(clip(F.col(kappa_column)))
    mean = F.avg(z) if weight is None else F.sum(z * F.col(weight)) / F.sum(weight)
    return kappas.agg(inverse_fisher_z(mean).alias("mean_kappa"))


def group_kappa(solution: DataFrame, submission: DataFrame, key: str, group: str = "essay_set",
                score: str = "essay_score", weight: str = "essay_weight",
                predicted: str = "predicted_score") -> DataFrame:
    """Kappa per group with the first weight of the group (by ``key``)."""
    joined = solution.join(submission.select(key, predicted), key, "left")
    return joined.groupBy(group).agg(
        quadratic_kappa(score, predicted).alias("kappa"), F.min_by(weight, key).alias("weight")
    )


def accuracy(label: str, prediction: str) -> Column:
    return F.avg((F.col(label) == F.col(prediction)).cast("double"))


def report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then their plain and weighted averages."""
    cells = df.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    marks = F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"),
                 F.lit(0).cast("long").alias("hit")),
    )
    classes = cells.select(F.inline(marks)).groupBy("c").agg(
        F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit")
    )
    zero = F.lit(0.0)
    scores = classes.select(
        F.col("c").cast("string").alias("class"),
        F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("said")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("said") + F.col("support")), zero).alias("f1"),
        "support",
    )
    names = ["precision", "recall", "f1"]
    macro = scores.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = scores.agg(
        *[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names],
        F.sum("support").alias("support"),
    )
    return (
        scores.unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )


def improvement(base: Column, better: Column) -> Column:
    """Relative gain in percent."""
    return 100 * F.try_divide(better - base, base)
