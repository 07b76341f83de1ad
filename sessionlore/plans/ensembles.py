"""Votes, bagged votes, stacking, feature selection and tuning: driver loops of Spark fits."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.operators.history import Before, Blocks
from sessionlore.operators.sampling import draw_counts
from sessionlore.operators.statistics import accuracy, correlations, quadratic_kappa, row_mode, weighted_vote
from sessionlore.plans import models as m
from sessionlore.plans import trees as tr
from sessionlore.session import materialize

#: Jobs of independent fits and predictions that are submitted at once.
AT_ONCE = 4


def at_once(work: Callable, items: Sequence) -> list:
    """``work`` of all items, a few Spark jobs at a time."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(work, items))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def long_predictions(fitted: dict, df: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(key, model, prediction) of several fitted models."""
    parts = [
        model.transform(df).select(*keys, *keep, F.lit(name).alias("model"), "prediction")
        for name, model in fitted.items()
    ]
    return union(parts)


def vote(fitted: dict, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hard vote, the smallest class on a tie."""
    return row_mode(long_predictions(fitted, df, keys), keys)


def vote_weighted(fitted: dict, df: DataFrame, keys: Sequence[str], weights: dict) -> DataFrame:
    if set(weights) != set(fitted):
        raise ValueError("a weight is needed for each model")
    rows = long_predictions(fitted, df, keys)
    weight = reduce(
        lambda c, name: F.when(F.col("model") == name, float(weights[name])).otherwise(c), weights, F.lit(0.0)
    )
    return weighted_vote(rows.withColumn("weight", weight), keys)


def bagged_vote(train: DataFrame, test: DataFrame, keys: Sequence[str], columns: Sequence[str], rounds: int = 40,
                settings: tr.Settings | None = None, mode: str = "over", label: str = "accuracy_group",
                chained: bool = False, seed: int = 42) -> DataFrame:
    """Mode of the predictions of ``rounds`` forests, each on a rebalanced sample.

    ``chained`` draws each sample from the one before instead of from the table. The rows are binned and all samples
    drawn once; the trees of all forests are grown in one job.
    """
    settings = settings or m.FOREST_SETTINGS["bagged"]
    seeds = [seed + i for i in range(rounds)]
    train = materialize(train)
    drawn = draw_counts(train, label, [*keys, *columns], mode, seeds, chained)
    rows = m.assemble(drawn, columns, label).withColumn("_vector", vector_to_array(m.FEATURES))
    data = tr.binned(rows, "_vector", tr.one_hot(m.LABEL, tr.class_count(rows, m.LABEL)),
                     counts=[F.get("draws", F.lit(i)) for i in range(rounds)])
    trees = tr.grow_forests(data, [tr.Fit(replace(settings, seed=s), counts=i) for i, s in enumerate(seeds)])
    asked = materialize(m.assemble(test.drop(label), columns).select(*keys, m.FEATURES, F.monotonically_increasing_id().alias("_row")))
    shares = tr.shares_of(tr.vote_sums(trees, asked, m.FEATURES, data.values, data.stat_count), ["fit", "_row"], settings.kind, data.stat_count)
    bags = shares.select("fit", "_row", m.first_largest(F.col("_shares")).alias("prediction"))
    return row_mode(bags.join(asked.drop(m.FEATURES), "_row"), keys)


def correlated_columns(df: DataFrame, columns: Sequence[str], label: str, above: float = 0.05) -> list[str]:
    rows = correlations(df, columns, label).where(F.abs("correlation") > above).collect()
    found = {r["feature"] for r in rows}
    return [c for c in columns if c in found]


def _split(train: DataFrame, test: DataFrame | None, columns: Sequence[str], label: str) -> tr.Binned:
    """Binned rows, those of ``test`` as part 1."""
    parts = [m.assemble(d, columns, label).select(m.FEATURES, m.LABEL, F.lit(i).alias("part"))
             for i, d in enumerate([train, test]) if d is not None]
    rows = union(parts).withColumn("_vector", vector_to_array(m.FEATURES))
    return tr.binned(rows, "_vector", tr.one_hot(m.LABEL, tr.class_count(rows, m.LABEL)), part=F.col("part"))


def eliminate(data: tr.Binned, to: int, settings: tr.Settings, leave_out: int | None = None, last: bool = False):
    """Drop the least important feature until ``to`` are left; yields the numbers of the columns of each step and its
    trees, which the last step has if ``last`` asks for them.

    The rows are binned once; a step is one job on some of their columns.
    """
    left = list(range(len(data.values)))
    while True:
        more = len(left) > to
        trees = tr.grow_forests(data, [tr.Fit(settings, leave_out, columns=tuple(left))]) if more or last else None
        yield list(left), trees
        if not more:
            return
        values = tr.importances(trees, 0, len(left))
        left.pop(max(range(len(left)), key=lambda i: (-values[i], left[i])))


def elimination_table(df: DataFrame, columns: Sequence[str], to: int, settings: tr.Settings | None = None,
                      label: str = "accuracy_group") -> DataFrame:
    """(feature, ranking, support): kept features rank 1, the last dropped 2, and so on."""
    steps = [left for left, _ in eliminate(_split(df, None, columns, label), to, settings or m.FOREST_SETTINGS["selection"])]
    rank = {c: 1 for c in steps[-1]}
    for back, (before, after) in enumerate(zip(reversed(steps[:-1]), reversed(steps[1:]))):
        (gone,) = set(before) - set(after)
        rank[gone] = back + 2
    rows = [(c, rank[i], rank[i] == 1) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int, support boolean")


def elimination_sweep(train: DataFrame, test: DataFrame, columns: Sequence[str], settings: tr.Settings | None = None,
                      label: str = "accuracy_group") -> tuple[DataFrame, int]:
    """Hold-out accuracy at each number of features, and the first number with the best one."""
    settings = settings or tr.Settings(100)
    data = _split(train, test, columns, label)
    steps, grown = zip(*eliminate(data, 1, settings, leave_out=1, last=True))
    trees = union([g.withColumn("fit", F.lit(i)) for i, g in enumerate(grown)])
    found = left_out_scores(data, [tr.Fit(settings, 1, columns=tuple(left)) for left in steps], trees)
    rows = sorted((len(left), found[i]) for i, left in enumerate(steps))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return train.sparkSession.createDataFrame(rows, "features int, accuracy double"), best


def left_out_scores(data: tr.Binned, fits: Sequence[tr.Fit], trees: DataFrame | None = None) -> list[float]:
    """Accuracy of each fit on the part that it did not see: a number for each fit reaches the driver."""
    shares = tr.left_out_shares(data, fits, trees).join(data.rows.select("place", "stats", F.get("counts", F.lit(0)).alias("n")), "place")
    right = F.get("stats", m.first_largest(F.col("shares")).cast("int")) == 1
    rows = shares.groupBy("fit").agg((F.sum(F.when(right, F.col("n")).otherwise(0)) / F.sum("n")).alias("score")).collect()
    found = {r["fit"]: float(r["score"]) for r in rows}
    return [found.get(i, 0.0) for i in range(len(fits))]


# ---- stacking ---------------------------------------------------------------------------------

def fold_of(key: Sequence[str], folds: int, seed: int = 42) -> Column:
    """Fold of a row from its key alone, so that every evaluation puts it in the same one."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(folds)).cast("int")


def fold_of_number(key: str, folds: int) -> Column:
    """Fold of a row that is numbered already."""
    return F.pmod(F.col(key), F.lit(folds)).cast("int")


def base_models(key: Sequence[str], seed: int = 42) -> dict:
    return {
        "tree": m.tree(seed=seed), "nearest": m.NearestVote(5, key), "stumps": m.boosted_stumps(50, seed=seed),
        "bagging": m.bagging(10, seed=seed), "forest": m.forest(10, seed=seed), "extra": m.extra_trees(10, seed=seed),
    }


def _padded(probability: str, classes: int) -> Column:
    """Class probabilities of fixed width: a fold may lack the last classes."""
    values = vector_to_array(probability)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(F.get(values, i), F.lit(0.0)))


def meta_features(fitted: dict, df: DataFrame, key: Sequence[str], classes: int) -> DataFrame:
    """(key, array of all models' class probabilities)."""
    out = df
    for name, model in fitted.items():
        out = model.transform(out).withColumn(f"p_{name}", _padded("probability", classes)).drop("probability", "prediction")
    return out.select(*key, F.concat(*[f"p_{name}" for name in fitted]).alias("meta"))


def out_of_fold(df: DataFrame, models: dict, key: Sequence[str], classes: int, folds: int = 10, seed: int = 42) -> DataFrame:
    """Meta-features of every row from models that did not see it: (key, fold, label, meta).

    Rows are binned once, with their fold; the tree models of all folds are fitted in one job, each without the rows of
    its fold. Nearest neighbours are searched fold by fold.
    """
    data = materialize(df.select(*key, m.FEATURES, m.LABEL, fold_of(key, folds, seed).alias("fold")))
    names = [n for n, model in models.items() if isinstance(model, tr.Trees)]
    out = data.drop(m.FEATURES)
    if names:
        rows = data.withColumn("_vector", vector_to_array(m.FEATURES))
        coded = tr.binned(rows, "_vector", tr.one_hot(m.LABEL, classes), part=F.col("fold"), keys=[*key, "fold", m.LABEL])
        shares = tr.left_out_shares(coded, [tr.Fit(models[n].settings, f) for n in names for f in range(folds)])
        of = F.floor(F.col("fit") / folds)
        wide = shares.groupBy("place").agg(*[
            F.first(F.when(of == i, F.col("shares")), ignorenulls=True).alias(f"p_{n}") for i, n in enumerate(names)])
        out = coded.by_row(wide).drop("part")
    for n in [n for n in models if n not in names]:
        def held(fold, n=n):
            seen, asked = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
            if asked.isEmpty() or seen.isEmpty():
                return None
            found = models[n].fit(seen).transform(asked)
            return materialize(found.select(*key, _padded("probability", classes).alias(f"p_{n}")))

        parts = [p for p in at_once(held, range(folds)) if p is not None]
        out = out.join(union(parts), list(key))
    return out.select(*key, "fold", m.LABEL, F.concat(*[f"p_{n}" for n in models]).alias("meta"))


def fit_base(df: DataFrame, models: dict, classes: int) -> dict:
    """All models fitted to all rows, the tree models in one job."""
    names = [n for n, model in models.items() if isinstance(model, tr.Trees)]
    if not names:
        return {n: model.fit(df) for n, model in models.items()}
    data = tr.binned(df.withColumn("_vector", vector_to_array(m.FEATURES)), "_vector", tr.one_hot(m.LABEL, classes))
    trees = tr.grow_forests(data, [tr.Fit(models[n].settings) for n in names])
    return {n: tr.load_model(trees, data, names.index(n), models[n].settings.kind) if n in names else model.fit(df)
            for n, model in models.items()}


def fit_meta(meta: DataFrame, model=None):
    return (model or m.one_vs_rest_logistic()).fit(meta.withColumn(m.FEATURES, array_to_vector("meta")))


def stacked_predict(df: DataFrame, fitted: dict, meta_model, key: Sequence[str], classes: int) -> DataFrame:
    meta = meta_features(fitted, df, key, classes).withColumn(m.FEATURES, array_to_vector("meta"))
    return meta_model.transform(meta).select(*key, "prediction")


# ---- scores of models -------------------------------------------------------------------------

def score_models(predictions: DataFrame, label: str = m.LABEL) -> DataFrame:
    """Accuracy and kappa per model from (model, label, prediction)."""
    return predictions.groupBy("model").agg(
        accuracy(label, "prediction").alias("accuracy"), quadratic_kappa(label, "prediction").alias("kappa")
    )


def tree_sweep(train: DataFrame, test: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """Kappa on train and test for each number of trees; inputs are assembled.

    What a tree draws follows from its number: a forest of n trees is the first n trees of the largest one.
    """
    rows = train.withColumn("_vector", vector_to_array(m.FEATURES))
    data = tr.binned(rows, "_vector", tr.one_hot(m.LABEL, tr.class_count(rows, m.LABEL)))
    settings, classes = m.forest(max(numbers)).settings, data.stat_count
    trees = tr.grow_forests(data, [tr.Fit(settings)], together=1).withColumn("fit", F.col("first").cast("int"))
    both = materialize(union([d.select(m.FEATURES, m.LABEL, F.lit(name).alias("split")) for name, d in (("train", train), ("test", test))])
                       .withColumn("_row", F.monotonically_increasing_id()))
    so_far = Window.partitionBy("_row").orderBy("fit").rowsBetween(Window.unboundedPreceding, 0)
    votes = F.array(*[F.sum(F.get("votes", F.lit(k))).over(so_far) for k in range(classes)])
    found = tr.vote_sums(trees, both, m.FEATURES, data.values, classes).select(
        "_row", (F.col("fit") + 1).alias("trees"), votes.alias("votes")).where(F.col("trees").isin(list(numbers)))
    said = tr.shares_of(found, ["_row", "trees"], settings.kind, classes).select("_row", "trees", m.first_largest(F.col("_shares")).alias("prediction"))
    scores = said.join(both.drop(m.FEATURES), "_row").groupBy("trees", "split").agg(quadratic_kappa(m.LABEL, "prediction").alias("kappa"))
    return scores.orderBy("trees", "split").select("trees", "split", "kappa")


# Recorded grid of the search: names of settings and their values; None is no limit.
SEARCH_GRID = {
    "trees": list(range(200, 2001, 200)),
    "features": ["sqrt", "sqrt"],  # the two recorded names mean the same for classes
    "depth": [*range(10, 111, 10), None],
    "split": [2, 5, 10],
    "leaf": [1, 2, 4],
    "draw": [True, False],
}


def random_search(train: DataFrame, key: Sequence[str], grid: dict | None = None, draws: int = 100, folds: int = 3,
                  seed: int = 42) -> DataFrame:
    """Mean cross-validated accuracy of settings drawn from the grid; ``train`` is assembled.

    Rows are binned once with their fold; all fits are grown in one job, each without the rows of its fold.
    """
    grid = grid or SEARCH_GRID
    rng = random.Random(seed)
    drawn = [{name: rng.choice(values) for name, values in grid.items()} for _ in range(draws)]
    rows = train.withColumn("_vector", vector_to_array(m.FEATURES))
    data = tr.binned(rows, "_vector", tr.one_hot(m.LABEL, tr.class_count(rows, m.LABEL)), part=fold_of(key, folds, seed))
    found = left_out_scores(data, [tr.Fit(tr.Settings(**d, seed=seed), f) for d in drawn for f in range(folds)])
    out = [(i, ", ".join(f"{k}={v}" for k, v in d.items()), sum(found[i * folds:(i + 1) * folds]) / folds)
           for i, d in enumerate(drawn)]
    return train.sparkSession.createDataFrame(out, "draw int, settings string, score double")


def best_settings(search: DataFrame, grid: dict | None = None, draws: int = 100, seed: int = 42) -> tr.Settings:
    """The settings of the best draw of ``random_search``, the first on a tie."""
    grid = grid or SEARCH_GRID
    rng = random.Random(seed)
    drawn = [{name: rng.choice(values) for name, values in grid.items()} for _ in range(draws)]
    return tr.Settings(**drawn[search.orderBy(F.desc("score"), "draw").first()["draw"]], seed=seed)


def permutation_importance(model, df: DataFrame, columns: Sequence[str], key: Sequence[str],
                           label: str = "accuracy_group", seed: int = 42) -> DataFrame:
    """Loss of kappa when one column is exchanged between rows.

    Each row takes the value of the row before it along a hash; the first keeps its own.
    """
    def score(rows):  # a model may write the rows that it gets: only what it needs
        rows = m.assemble(rows, columns, label).select(m.FEATURES, m.LABEL)
        return model.transform(rows).agg(quadratic_kappa(m.LABEL, "prediction")).first()[0]

    base = score(df)
    mixed = df.withColumn("_mix", F.xxhash64(*key, F.lit(seed)))
    moved = materialize(Blocks().over(
        mixed, [], ["_mix", *key], {f"_moved{i}": Before(F.col(f"`{c}`"), None) for i, c in enumerate(columns)}
    ))
    rows = []
    for i, c in enumerate(columns):
        swapped = moved.withColumn(c, F.coalesce(F.col(f"_moved{i}"), F.col(f"`{c}`")))
        rows.append((c, (base or 0.0) - (score(swapped) or 0.0)))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
