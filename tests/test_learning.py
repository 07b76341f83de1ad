"""Sampling, neighbours, models and ensembles on the smallest tables."""

import inspect
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sessionlore.catalog import learning
from sessionlore.catalog.base import QUERIES
from sessionlore.operators import nearest as nearest_module
from sessionlore.operators.nearest import _shortlist, _within, nearest
from sessionlore.operators.sampling import chain, number_within, rebalance
from sessionlore.operators.statistics import describe, value_counts
from sessionlore.plans import ensembles as e
from sessionlore.plans import models as m


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 4, 240)
    x = rng.normal(size=(240, 3)) + label[:, None] * 1.5
    rows = [(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(label, x))]
    df = spark.createDataFrame(rows, "row_key long, accuracy_group int, a double, b double, c double")
    return m.assemble(df, ["a", "b", "c"]).cache()


def test_rebalance_counts_are_exact(spark, points):
    sizes = {r["accuracy_group"]: r["count"] for r in value_counts(points, "accuracy_group").collect()}
    raw = points.drop("features", "label")
    for mode, size in (("down", min(sizes.values())), ("over", max(sizes.values()))):
        drawn = rebalance(raw, "accuracy_group", ["row_key"], mode)
        assert {r["count"] for r in value_counts(drawn, "accuracy_group").collect()} == {size}
        assert drawn.join(raw, raw.columns, "left_anti").count() == 0
    again = rebalance(raw.repartition(3), "accuracy_group", ["row_key"], "down")
    assert sorted(again.collect()) == sorted(rebalance(raw, "accuracy_group", ["row_key"], "down").collect())
    *_, last = chain(raw, "accuracy_group", ["row_key"], "over", [1, 2])
    assert {r["count"] for r in value_counts(last, "accuracy_group").collect()} == {max(sizes.values())}


def test_places_are_dense_over_buckets(spark, monkeypatch):
    monkeypatch.setattr("sessionlore.operators.sampling.ROWS_PER_BUCKET", 7)
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 80, "big").otherwise("small"))
    rows = number_within(df, "g", ["id"], {"big": 80, "small": 20}).collect()
    for group, size in (("big", 80), ("small", 20)):
        assert sorted(r["place"] for r in rows if r["g"] == group) == list(range(size))


def test_nearest_equals_brute_force(spark, points, monkeypatch):
    monkeypatch.setattr("sessionlore.operators.nearest.ROWS_PER_CHUNK", 37)
    df = points.select(F.col("row_key").alias("id"), vector_to_array("features").alias("vector"), "label")
    # A third of the rows are copies of one vector.
    copies = df.where("id = 0").select(F.explode(F.sequence(F.lit(1000).cast("long"), F.lit(1119).cast("long"))).alias("id"), "vector", "label")
    known = df.unionByName(copies)
    rows = known.collect()
    x, ids = np.array([r["vector"] for r in rows]), np.array([r["id"] for r in rows])
    found = {}
    for r in nearest(known, known.drop("label"), 4, skip_same_id=True).collect():
        found.setdefault(r["query"], []).append((r["rank"], r["id"]))
    for i, key in enumerate(ids):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [n for _, n in sorted(found[key])] == list(ids[np.lexsort((ids, d))[:4]]), key


@pytest.mark.parametrize("chunk", [13, 4000])
def test_neighbours_that_tie_at_the_bound_are_kept(spark, monkeypatch, chunk):
    """Whole coordinates, so that many distances are equal; ids come twice on the side that asks."""
    monkeypatch.setattr("sessionlore.operators.nearest.ROWS_PER_CHUNK", chunk)
    rng = np.random.default_rng(11)
    x, asked = rng.integers(0, 5, (600, 3)) * 1.0 + 1e6, rng.integers(0, 5, (90, 3)) * 1.0 + 1e6
    known = spark.createDataFrame([(f"k{i:03}", v.tolist(), i % 4) for i, v in enumerate(x)], "id string, vector array<double>, label int")
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id int, vector array<double>")
    found = {}
    for r in nearest(known, asks, 6).collect():
        found.setdefault(r["query"], []).append((r["rank"], r["id"], r["distance"], r["label"]))
    for i, v in enumerate(asked):
        d = np.sqrt(((x - v) ** 2).sum(1))
        best = np.lexsort((np.arange(600), d))[:6]
        assert sorted(found[i]) == [(n + 1, f"k{j:03}", d[j], j % 4) for n, j in enumerate(best)]


def test_other_groups_give_only_rows_within_the_bound():
    rng = np.random.default_rng(2)
    points, asks = rng.normal(size=(500, 8)), rng.normal(size=(40, 8))
    d = np.sqrt(((points[None] - asks[:, None]) ** 2).sum(2))
    bounds = np.sort(d, axis=1)[:, 2]
    bounds[::2] = 0.0
    got = [(i, j, x) for part in _within(asks, points, bounds, 5) for i, j, x in zip(*part)]
    assert got == [(i, j, d[i, j]) for i in range(1, 40, 2) for j in np.argsort(d[i])[:3]]


def test_few_queries_meet_a_chunk_once(spark, monkeypatch):
    """Known rows are sent once for all groups of queries that make one block, not once for each of them."""
    rng = np.random.default_rng(4)
    vectors = lambda n: [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 6)))]
    known, asks = (spark.createDataFrame(vectors(n), "id long, vector array<double>") for n in (2000, 100))
    count = spark.sparkContext.accumulator(0)
    within = nearest_module._within

    def counted(*a):
        count.add(1)
        return within(*a)

    monkeypatch.setattr(nearest_module, "_within", counted)
    met = nearest(known, asks, 5).collect()
    assert len(met) == 500 and 0 < count.value <= 2 * 11  # 11 centres, one block


def test_describe(spark):
    df = spark.createDataFrame([(float(i % 17),) for i in range(100)] + [(None,)], "x double")
    row = describe(df, ["x"]).first()
    values = np.array([i % 17 for i in range(100)], float)
    assert row["count"] == 100 and row["std"] == pytest.approx(values.std(ddof=1))
    assert [row["q25"], row["q50"], row["q75"]] == list(np.quantile(values, [0.25, 0.5, 0.75]))


def score(model, points):
    out = model.fit(points).transform(points)
    return out.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


MODELS = {
    "forest": lambda: m.forest(5, 5), "tree": lambda: m.tree(4), "bagging": lambda: m.bagging(3, 4),
    "extra": lambda: m.extra_trees(3, 4), "logistic": lambda: m.logistic(20), "stumps": lambda: m.boosted_stumps(5),
    "nearest": lambda: m.NearestVote(5, ["row_key"]), "ordinal": lambda: m.Ordinal(m.logistic(20)),
    "boosted": lambda: m.boosted_multi(2, 2), "network": lambda: m.network(3, 4, (5,), 40),
}


@pytest.mark.parametrize("name", MODELS)
def test_models_beat_guessing(points, name):
    assert score(MODELS[name](), points) > 0.4


def test_same_seed_same_result(points):
    first, second = (m.forest(5, 4).fit(points).transform(points).select("row_key", "prediction") for _ in range(2))
    assert sorted(first.collect()) == sorted(second.collect())


def test_ordinal_needs_three_classes(points):
    with pytest.raises(ValueError):
        m.Ordinal(m.tree(2)).fit(points.where("label < 2")).transform(points)


def test_stack(points):
    models = {"tree": m.tree(3), "logistic": m.logistic(10), "nearest": m.NearestVote(5, ["row_key"])}
    meta = e.out_of_fold(points, models, ["row_key"], 4, folds=3)
    rows = meta.collect()
    assert len(rows) == 240 and {len(r["meta"]) for r in rows} == {12} and {r["fold"] for r in rows} == {0, 1, 2}
    fitted = e.fit_base(points, models, 4)
    out = e.stacked_predict(points, fitted, e.fit_meta(meta), ["row_key"], 4)
    assert out.count() == 240 and {r["prediction"] for r in out.collect()} <= {0.0, 1.0, 2.0, 3.0}


def test_selection(points):
    raw = points.drop("features", "label")
    table = e.elimination_table(raw, ["a", "b", "c"], 1, m.forest(3, 3).settings).collect()
    assert sorted(r["ranking"] for r in table) == [1, 2, 3]
    assert e.correlated_columns(raw, ["a", "b"], "accuracy_group") == ["a", "b"]
    sweep, best = e.elimination_sweep(raw, raw, ["a", "b"], m.forest(3, 3).settings)
    assert sweep.count() == 2 and best in (1, 2)


def test_votes(points):
    fitted = {"tree": m.tree(3).fit(points), "forest": m.forest(3, 3).fit(points)}
    assert e.vote(fitted, points, ["row_key"]).count() == 240
    with pytest.raises(ValueError):
        e.vote_weighted(fitted, points, ["row_key"], {"tree": 1})
    heavy = e.vote_weighted(fitted, points, ["row_key"], {"tree": 3, "forest": 1})
    tree = fitted["tree"].transform(points).select("row_key", F.col("prediction").cast("int").alias("prediction"))
    assert sorted(heavy.collect()) == sorted(tree.collect())


class Asked(Exception):
    """Arguments with which a query calls a plan."""


class Rows:
    train = test = score = predict = "rows"
    columns = ["a", "b", "c"]

    def predictions(self, model):
        return model


@pytest.fixture
def asked(spark, monkeypatch):
    """What a query asks of a plan, which is not run."""
    monkeypatch.setattr(learning, "Learning", lambda t: Rows())

    def run(name, plan):
        function = getattr(e, plan)

        def record(*args, **more):
            bound = inspect.signature(function).bind(*args, **more)
            bound.apply_defaults()
            raise Asked(bound.arguments)

        monkeypatch.setattr(e, plan, record)
        with pytest.raises(Asked) as found:
            QUERIES[name](spark, "/root/testdata/sf0.001")
        monkeypatch.setattr(e, plan, function)
        return found.value.args[0]

    return run


SIX = {"tree", "nearest", "stumps", "bagging", "forest", "extra"}


@pytest.mark.parametrize("name", ["stk_oof", "stk_fit_meta", "stk_predict"])
def test_stacking_queries_use_all_models_and_folds(asked, name):
    found = asked(name, "out_of_fold")
    assert set(found["models"]) == SIX and found["folds"] == 10 and found["models"]["stumps"].settings.trees == 50
    assert {found["models"][k].settings.trees for k in ("bagging", "forest", "extra")} == {10}
    assert {found["models"][k].settings.depth for k in ("tree", "bagging", "forest", "extra")} == {None}


def test_queries_run_at_full_size(spark, asked, monkeypatch):
    assert set(asked("stk_fit_base", "fit_base")["models"]) == SIX
    sweep = asked("tune_trees", "tree_sweep")
    assert list(sweep["numbers"]) == list(range(1, 100))
    search = asked("tune_random_search", "random_search")
    assert search["draws"] == 100 and search["folds"] == 3 and (search["grid"] or e.SEARCH_GRID) == e.SEARCH_GRID
    for name, chained in (("smp_bagged_vote", False), ("smp_bagged_vote_chained", True)):
        vote = asked(name, "bagged_vote")
        assert vote["rounds"] == 40 and vote["settings"] is None and vote["chained"] is chained
    monkeypatch.setattr(learning, "_submitted", lambda t, model: "sent" if model.settings.trees == 1000 else None)
    model = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")
    assert model("fit_gbt_multi").settings.trees == 100 and model("fit_adaboost").settings.trees == 50
    assert model("fit_forest").settings == m.FOREST_SETTINGS["tuned"] and model("job_holdout") == "sent"
    assert model("fit_logistic").getMaxIter() == 100
    network = model("fit_mlp").getStages()[-1]
    assert network.getLayers() == [3, 100, 4] and network.getMaxIter() == 200


def test_bagged_job_runs_at_full_size(monkeypatch):
    vote = MagicMock()
    for module, name, stub in ((learning.assemble, "create_features", MagicMock()), (learning.assemble, "with_labels", MagicMock()),
                               (learning.assemble, "feature_columns", MagicMock()), (learning.holdout, "last_assessment", MagicMock()),
                               (learning, "materialize", lambda df: df), (e, "correlated_columns", lambda *a: ["a"]),
                               (e, "bagged_vote", vote), (learning, "_submitted", lambda t, rows: rows)):
        monkeypatch.setattr(module, name, stub)
    learning.job_bagged(MagicMock())
    (_, _, _, columns), more = vote.call_args
    assert columns == ["a"] and more.get("rounds", 40) == 40 and more.get("settings") is None


def test_nearest_holds_few_distances_at_once(monkeypatch):
    monkeypatch.setattr("sessionlore.operators.nearest.DISTANCES_AT_ONCE", 400)
    sizes, plain = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **more: sizes.append(x.size) or plain(x, *a, **more))
    x = np.random.default_rng(1).normal(size=(90, 4))
    found = [*_shortlist(x, x[:50], 3)]
    assert max(sizes) <= 400 and len(found) == 90
    for ask, near in zip(x, found):
        assert {*np.argsort(((x[:50] - ask) ** 2).sum(1))[:3]} <= {*near}


def test_nearest_with_bounds_from_home_groups_of_uneven_width(spark):
    x = np.random.default_rng(2).normal(size=(1200, 2)) ** 3
    rows = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, vector array<double>")
    found = {}
    for r in nearest(rows, rows, 3).collect():
        found.setdefault(r["query"], []).append((r["rank"], r["id"]))
    for i in range(len(x)):
        assert [n for _, n in sorted(found[i])] == np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:3].tolist()


def test_permutation_hands_over_no_more_than_a_model_needs(points):
    class Constant:
        def transform(self, df):
            assert set(df.columns) == {m.FEATURES, m.LABEL}
            return df.withColumn("prediction", F.lit(1.0))

    rows = points.drop("features", "label")
    found = e.permutation_importance(Constant(), rows, ["a", "b", "c"], ["row_key"]).collect()
    assert [(r["feature"], r["importance"]) for r in found] == [("a", 0.0), ("b", 0.0), ("c", 0.0)]
