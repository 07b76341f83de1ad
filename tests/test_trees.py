"""Trees against a plain version, whole trees in tasks against levels as jobs, and boosting."""

import math
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sessionlore.operators.sampling import draw_counts, rebalance
from sessionlore.plans import ensembles as e
from sessionlore.plans import models as m
from sessionlore.plans import trees as t
from sessionlore.plans.explain import explain, ranking, shapley


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 40, 200), rng.integers(0, 3, 200), np.round(rng.normal(size=200), 1), np.ones(200)], 1)
    y = (x[:, 0] > 20).astype(int) + (x[:, 1] == 1) + (x[:, 2] > 0.3)
    y = np.where(rng.random(200) < 0.1, rng.integers(0, 4, 200), y)
    values = [np.unique(x[:, f]) for f in range(4)]
    padded = np.full((4, max(map(len, values))), np.inf)
    for f, v in enumerate(values):
        padded[f, :len(v)] = v
    counts = rng.integers(1, 4, (200, 1))
    return t.Rows(t.to_bins(x, padded), np.eye(4)[y], counts, np.arange(200) % 3, t.mix(np.arange(200, dtype=np.uint64)),
                  np.arange(200)), padded


def plain(rows, values, s, seed, weight):
    """One tree, node by node: {path: (feature, bin)} with paths of 0 (left) and 1."""
    out, width = {}, len(values)
    most = max(1, round(math.sqrt(width))) if s.features == "sqrt" else width

    def gini(w):
        return (w ** 2).sum() / w.sum()

    def go(at, key, path):
        total = (weight[at, None] * rows.stats[at]).sum(0)
        if total.sum() < max(s.split, 2 * s.leaf) or total.max() >= total.sum() or len(path) == s.depth:
            return
        order = t._candidates(np.array([key], np.uint64), width, s)[0]
        for offered in (order[:most], order[most:]):
            best = None
            for f in offered:
                own = sorted(set(rows.bins[at, f].tolist()))
                cuts = [(values[f, a] + values[f, b]) / 2 for a, b in zip(own, own[1:])]
                if s.drawn_thresholds and cuts:
                    k = np.array([key], np.uint64)
                    u = t.uniform(t.mix(t.mix(k + np.uint64(7)) ^ t.mix(np.array([f + 11], np.uint64))))[0]
                    cuts = [values[f, own[0]] + u * (values[f, own[-1]] - values[f, own[0]])]
                for cut in cuts:
                    left = values[f, rows.bins[at, f]] <= cut
                    a = (weight[at[left], None] * rows.stats[at[left]]).sum(0)
                    if min(a.sum(), (total - a).sum()) >= s.leaf:
                        score = gini(a) + gini(total - a)
                        if best is None or score > best[0] + 1e-9 * abs(best[0]):
                            best = score, f, int((values[f] <= cut).sum() - 1)
            if best:
                break
        if not best:
            return
        out[path] = best[1:]
        left = rows.bins[at, best[1]] <= best[2]
        for side, own in ((0, left), (1, ~left)):
            go(at[own], int(t.mix(np.array([key], np.uint64) * np.uint64(2) + np.uint64(side + 1))[0]), (*path, side))

    go(np.flatnonzero(weight > 0), int(t.mix(seed[None])[0]), ())
    return out


def paths(grown, root):
    out = {}

    def go(node, path):
        if grown.feature[node] >= 0:
            out[path] = int(grown.feature[node]), int(grown.split[node])
            go(grown.left[node], (*path, 0))
            go(grown.left[node] + 1, (*path, 1))

    go(root, ())
    return out


SETTINGS = {
    "forest": t.Settings(6), "bagging": t.Settings(4, features="all"), "tree": t.Settings(1, features="all", draw=False),
    "extra": t.Settings(6, draw=False, drawn_thresholds=True), "small": t.Settings(5, depth=3, leaf=4, split=12),
    "extra_bagged": t.Settings(5, depth=6, drawn_thresholds=True, features="all"),
}


@pytest.mark.parametrize("name", SETTINGS)
def test_splits_equal_a_plain_version(rows, name):
    data, values = rows
    s = SETTINGS[name]
    fit, seeds = t.Fit(s, leave_out=1), t.tree_seeds(s, 0, s.trees)
    weights = data.weights(fit, seeds)
    grown = t.grow(t.Local(data, weights, t.bin_sizes(values)), seeds, values, s)
    for i in range(s.trees):
        found = paths(grown, i)
        assert found == plain(data, values, s, seeds[i], weights[i]) and found


def test_draws_are_poisson(rows):
    data, _ = rows
    s = t.Settings(4000)
    weights = data.weights(t.Fit(s), t.tree_seeds(s, 0, s.trees))
    n = data.counts[:, 0]
    assert abs((weights.mean(0) / n).mean() - 1) < 0.01 and abs((weights.var(0) / n).mean() - 1) < 0.02
    many = t.Rows(data.bins[:1], data.stats[:1], np.array([[50_000]]), data.part[:1], data.ids[:1], data.places[:1])
    drawn = many.weights(t.Fit(s), t.tree_seeds(s, 0, s.trees))
    assert abs(drawn.mean() / 50_000 - 1) < 0.001 and abs(drawn.var() / 50_000 - 1) < 0.1
    assert (data.weights(t.Fit(s, leave_out=2), t.tree_seeds(s, 0, 3))[:, data.part == 2] == 0).all()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(150, 4)), 1)
    y = np.digitize(x[:, 0] + x[:, 1] ** 2, [0, 1])
    out = [(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))]
    df = spark.createDataFrame(out + [(150 + i, *r[1:]) for i, r in enumerate(out[:30])], "row_key long, accuracy_group int, a double, b double, c double, d double")
    return m.assemble(df, ["a", "b", "c", "d"]).withColumn("_vector", vector_to_array("features")).repartition(3).cache()


KINDS = {
    "forest": t.Settings(9, depth=5), "extra": t.Settings(5, depth=4, draw=False, drawn_thresholds=True),
    "stumps": t.Settings(4, 1, "all", kind="stumps"), "softmax": t.Settings(2, 2, "all", kind="softmax"),
}


def test_levels_as_jobs_give_the_same_trees(table, monkeypatch):
    monkeypatch.setattr(t, "NODES_IN_JOB", 7)
    data = t.binned(table, "_vector", t.one_hot("label", 3), part=F.col("row_key") % 2, keys=["row_key"])
    assert data.rows.count() < 180 and data.rows.agg(F.sum(data.rows["counts"][0])).first()[0] == 180
    fits = [t.Fit(s, leave_out=0) for s in KINDS.values()]
    whole = t.grow_forests(data, fits)
    shares = {(r.fit, r.place): r.shares for r in t.left_out_shares(data, fits).collect()}
    monkeypatch.setattr(t, "ROWS_IN_TASK", 0)
    spread = t.Binned(data.rows, data.values, data.stat_count, data.coded)
    jobs = t.grow_forests(spread, fits)
    for i, (name, s) in enumerate(KINDS.items()):
        a, b = (t.load_model(x, data, i, s.kind).grown for x in (whole, jobs))
        assert a.trees == b.trees and all(paths(a, k) == paths(b, k) for k in range(a.trees)), name
    found = {(r.fit, r.place): r.shares for r in t.left_out_shares(spread, fits[:2]).collect()}
    assert found and all(np.allclose(v, shares[k]) for k, v in found.items())


def test_models_of_one_column_take_the_majority(spark):
    """With a single 0/1 feature every model must say the most frequent class of each side."""
    out = [(i, i % 2, (0 if i % 10 else 2) if i % 2 else (1 if i % 6 else 3)) for i in range(240)]
    df = m.assemble(spark.createDataFrame(out, "row_key long, x int, accuracy_group int"), ["x"])
    counts = df.groupBy("x", "accuracy_group").count().collect()
    want = {x: max((r for r in counts if r.x == x), key=lambda r: r["count"]).accuracy_group for x in (0, 1)}
    for model in (m.forest(20), m.tree(), m.bagging(5), m.extra_trees(5), m.boosted_stumps(3), m.boosted_multi(5)):
        found = model.fit(df).transform(df).select("x", "prediction").distinct().collect()
        assert {r.x: int(r.prediction) for r in found} == want


def test_boosting_lowers_the_loss_in_every_round(table):
    losses = []
    for rounds in range(1, 9):
        found = m.boosted_multi(rounds).fit(table).transform(table).select("label", vector_to_array("probability").alias("p")).collect()
        assert all(abs(sum(r.p) - 1) < 1e-9 for r in found)
        losses.append(-sum(math.log(r.p[int(r.label)]) for r in found))
    assert all(b < a for a, b in zip(losses, losses[1:]))


def test_depth_beyond_thirty(spark):
    """A staircase that needs a split for each row."""
    df = m.assemble(spark.createDataFrame([(i, i % 2, float(2 ** i)) for i in range(60)], "row_key long, accuracy_group int, x double"), ["x"])
    model = m.tree().fit(df)
    assert model.transform(df).where("prediction <> label").count() == 0
    assert m.tree(40).fit(df).grown.levels <= 40


def test_drawn_counts_equal_the_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 5 == 0], i % 7) for i in range(90)], "k long, c string, v int")
    found = draw_counts(df, "c", ["k"], "over", [5, 6])
    for i, seed in enumerate((5, 6)):
        want = {r.k: r["count"] for r in rebalance(df, "c", ["k"], "over", seed).groupBy("k").count().collect()}
        assert {r.k: r.draws[i] for r in found.collect() if r.draws[i]} == want
    chained = draw_counts(df, "c", ["k"], "over", [5, 6, 7], chained=True).collect()
    for i in range(3):
        assert {c: sum(r.draws[i] for r in chained if r.c == c) for c in "ab"} == {"a": 72, "b": 72}
    kept = [{r.k for r in chained if r.draws[i]} for i in range(3)]
    assert kept[2] <= kept[1] <= kept[0]


def test_search_and_votes(table):
    raw = table.drop("features", "label", "_vector")
    voted = e.bagged_vote(raw, raw, ["row_key"], ["a", "b", "c", "d"], rounds=3, settings=t.Settings(30, 6))
    joined = voted.join(raw, "row_key")
    assert joined.count() == 180 and joined.where("prediction = accuracy_group").count() > 150
    grid = {"trees": [5, 10], "depth": [2, 80, None], "split": [2, 10]}
    search = e.random_search(table, ["row_key"], grid, draws=6, folds=3)
    scores = [r.score for r in search.collect()]
    assert len(scores) == 6 and all(0.5 < s <= 1 for s in scores)
    best = e.best_settings(search, grid, draws=6)
    assert best.trees in (5, 10) and f"trees={best.trees}" in search.orderBy(F.desc("score"), "draw").first().settings


def test_shapley_values_against_all_subsets(rows):
    data, values = rows
    rng = np.random.default_rng(6)
    x = np.stack([*(np.round(rng.normal(size=120), 1) for _ in range(6))], 1)
    y = np.digitize(x[:, 0] * x[:, 1] + x[:, 2] - x[:, 5], [-0.5, 0.5])
    own = [np.unique(x[:, f]) for f in range(6)]
    values = np.full((6, max(map(len, own))), np.inf)
    for f, v in enumerate(own):
        values[f, :len(v)] = v
    data = t.Rows(t.to_bins(x, values), np.eye(3)[y], np.ones((120, 1), np.int64), np.zeros(120, int),
                  t.mix(np.arange(120, dtype=np.uint64)), np.arange(120))
    s = t.Settings(5, depth=6)
    grown = t.build(lambda f, seeds: t.Local(data, data.weights(f, seeds), t.bin_sizes(values)), t.Fit(s), 0, 5, values, 3)
    found, base = shapley(grown, data.bins[:12], 6)
    assert np.allclose(found.sum(1) + base, t.votes(grown, data.bins[:12]) / 5)
    cover = grown.stats.sum(1)

    def expected(node, row, known):
        f = grown.feature[node]
        if f < 0:
            return grown.value[node]
        left = grown.left[node]
        if f in known:
            return expected(left + (row[f] > grown.split[node]), row, known)
        return sum(cover[c] / cover[node] * expected(c, row, known) for c in (left, left + 1))

    for i in range(12):
        worth = {k: sum(expected(r, data.bins[i], k) for r in range(5)) / 5
                 for n in range(7) for k in map(frozenset, combinations(range(6), n))}
        for f in range(6):
            want = sum(math.factorial(len(k)) * math.factorial(5 - len(k)) / math.factorial(6) * (worth[k | {f}] - v)
                       for k, v in worth.items() if f not in k)
            assert np.allclose(found[i, f], want)


def test_explained_rows(table):
    columns = ["a", "b", "c", "d"]
    model = m.forest(10, 4).fit(table)
    explained = explain(model, table, ["row_key"], columns)
    sums = {(r["row_key"], r["class"]): r["s"] for r in explained.groupBy("row_key", "class").agg(F.sum("value").alias("s")).collect()}
    rows = model.transform(table).select("row_key", vector_to_array("probability").alias("p")).collect()
    base = [rows[0].p[c] - sums[rows[0].row_key, c] for c in range(3)]
    assert all(abs(r.p[c] - sums[r.row_key, c] - base[c]) < 1e-9 for r in rows for c in range(3))
    assert {r.feature for r in ranking(explained).limit(2).collect()} == {"a", "b"}


def test_no_features_at_all(table):
    """Where no column correlates with the label, a bag still votes: for what its samples have most of."""
    raw = table.drop("features", "label", "_vector")
    voted = e.bagged_vote(raw, raw, ["row_key"], [], rounds=2, settings=t.Settings(5, 6))
    assert voted.count() == 180 and voted.select("prediction").distinct().count() == 1


def test_trees_and_rows_meet_without_the_driver(table, monkeypatch):
    """A model whose trees are too many to be sent says the same, gives the same importances, and is never gathered."""
    model = m.forest(23).fit(table)
    sent = {r.row_key: r.p for r in model.transform(table).select("row_key", vector_to_array("probability").alias("p")).collect()}
    grown, want = model.grown, t.gains(model.grown, 4)

    def gathered(self):
        raise AssertionError("trees on the driver")

    monkeypatch.setattr(t, "NODES_SENT", 50)
    monkeypatch.setattr(t, "BYTES_OF_ROWS", 400)
    monkeypatch.setattr(t.TreesModel, "grown", property(gathered))
    model = m.forest(23).fit(table)
    assert not model.small and len(grown.feature) > 50
    apart = {r.row_key: r.p for r in model.transform(table).select("row_key", vector_to_array("probability").alias("p")).collect()}
    assert apart.keys() == sent.keys() and all(np.allclose(apart[k], sent[k], atol=1e-8) for k in sent)
    assert np.allclose(model.featureImportances, want / want.sum())
    assert explain(model, table, ["row_key"], ["a", "b", "c", "d"]).count() == 180 * 4 * 3


def test_a_sweep_equals_forests_of_their_own(table):
    found = {(r.trees, r.split): r.kappa for r in e.tree_sweep(table, table, [1, 4, 9]).collect()}
    assert len(found) == 6
    for n in (1, 4, 9):
        own = m.forest(n).fit(table).transform(table).agg(e.quadratic_kappa("label", "prediction")).first()[0]
        assert found[n, "train"] == found[n, "test"] == pytest.approx(own)


def test_forests_that_share_trees_score_as_on_their_own(table):
    data = t.binned(table, "_vector", t.one_hot("label", 3), part=F.col("row_key") % 2, keys=["row_key"])
    fits = [t.Fit(t.Settings(n, depth), 1) for n, depth in ((3, None), (9, 2), (9, None), (5, 80))]
    models, spans, members = t.families(fits)
    assert spans == [(0, 3), (3, 5), (5, 9)] and members == [[0, 1, 2, 3], [1, 2, 3], [1, 2]]
    together = {(r.fit, r.place): r.shares for r in t.left_out_shares(data, fits).collect()}
    for i, fit in enumerate(fits):
        for r in t.left_out_shares(data, [fit]).collect():
            assert np.allclose(together[i, r.place], r.shares)


def test_forests_that_differ_in_the_rows_to_split_share_trees(table, monkeypatch):
    monkeypatch.setattr(t, "ENTRIES", 0)  # a tree at a time, whose votes are added up
    data = t.binned(table, "_vector", t.one_hot("label", 3), part=F.col("row_key") % 2, keys=["row_key"])
    fits = [t.Fit(t.Settings(n, depth, split=split, leaf=2, draw=False), 1) for n, depth, split in ((6, None, 2), (6, 3, 10), (4, None, 25))]
    models, spans, members = t.families(fits)
    assert spans == [(0, 4), (4, 6)] and [model.settings.split for model in models] == [2, 2]
    together = {(r.fit, r.place): r.shares for r in t.left_out_shares(data, fits).collect()}
    alone = {(i, r.place): r.shares for i, fit in enumerate(fits) for r in t.left_out_shares(data, [fit]).collect()}
    assert together.keys() == alone.keys() and all(np.allclose(v, alone[k]) for k, v in together.items())
    trees = t.grow_forests(data, fits)
    grown = {(r.fit, r.place): r.shares for r in t.left_out_shares(data, fits, trees).collect()}
    assert grown.keys() == alone.keys() and all(np.allclose(v, alone[k]) for k, v in grown.items())


def test_a_feature_sweep_grows_each_forest_once(spark, table, monkeypatch):
    jobs, plain = [], t._in_tasks
    monkeypatch.setattr(t, "_in_tasks", lambda data, fits, *a, **more: jobs.append(sum(f.settings.trees for f in fits)) or plain(data, fits, *a, **more))
    raw = table.select("row_key", "accuracy_group", "a", "b", "c")
    sweep, _ = e.elimination_sweep(raw, raw, ["a", "b", "c"], t.Settings(4))
    assert sweep.count() == 3 and jobs == [4, 4, 4]


def test_boosting_keeps_the_votes_of_earlier_trees(rows, monkeypatch):
    """Each row meets each tree of a boosted model once while it grows."""
    data, values = rows
    data, met, plain = t.replace(data), [], t.votes
    monkeypatch.setattr(t, "votes", lambda grown, bins, **more: met.append(grown.trees - more.get("first", 0)) or plain(grown, bins, **more))
    s, classes = t.Settings(6, 2, "all", kind="softmax"), data.stats.shape[1]
    t.build(lambda f, seeds: t.Local(data.facing(f), data.weights(f, seeds), t.bin_sizes(values)), t.Fit(s), 0, 6, values, classes)
    assert sum(met) == 5 * classes


def test_split_between_neighbouring_numbers():
    """Their middle rounds to the upper one: rows of its bin must not go left of a split that counted them right."""
    low = np.nextafter(1.0, 2.0)
    high = np.nextafter(low, 2.0)
    assert (low + high) / 2 == high
    values = np.array([[low, high, 2.0]])
    bins = np.array([[0]] * 3 + [[1]] * 4, np.uint8)
    stats = np.eye(2)[bins[:, 0].astype(int)]
    rows = t.Rows(bins, stats, np.ones((7, 1), np.int64), np.zeros(7, np.int32), np.arange(7, dtype=np.uint64), np.arange(7))
    settings = t.Settings(1, None, "all", draw=False)
    grown = t.build(lambda f, seeds: t.Local(rows.facing(f), rows.weights(f, seeds), t.bin_sizes(values)), t.Fit(settings), 0, 1, values, 2)
    assert np.array_equal(t.votes(grown, bins), stats)


@pytest.mark.parametrize("name", SETTINGS)
@pytest.mark.parametrize("classes, most", [(4, 3), (4, 9000), (11, 60)])
def test_nodes_searched_some_at_a_time_split_as_all_at_once(monkeypatch, name, classes, most):
    monkeypatch.setattr(t, "SEARCHED", 300)
    monkeypatch.setattr(t, "COUNTED", 8)
    monkeypatch.setattr(t, "COUNTED_ALONE", 60)
    rng = np.random.default_rng(classes)
    bins = np.stack([rng.integers(0, k, 300) for k in (30, 2, 1, 12, 5)], 1).astype(np.uint8)
    values = np.full((5, 30), np.inf)
    for f, k in enumerate((30, 2, 1, 12, 5)):
        values[f, :k] = np.sort(rng.normal(size=k))
    y = (bins[:, 0] // 4 + rng.integers(0, 3, 300)) % classes
    rows = t.Rows(bins, np.eye(classes)[y], rng.integers(1, most, (300, 1)), np.zeros(300, int),
                  t.mix(np.arange(300, dtype=np.uint64)), np.arange(300))
    s, sizes = SETTINGS[name], t.bin_sizes(values)
    fit, seeds = t.Fit(s), t.tree_seeds(s, 0, s.trees)
    found = t.grow(t.Local(rows, rows.weights(fit, seeds), sizes), seeds, values, s)
    at_once = t.Local(rows, rows.weights(fit, seeds), sizes)
    at_once.whole = False
    expected = t.grow(at_once, seeds, values, s)
    for part in ("feature", "split", "left", "stats"):
        assert (getattr(found, part) == getattr(expected, part)).all(), part
    assert found.levels > 2


def test_memory_of_a_tree_follows_its_rows_not_their_candidates():
    rng = np.random.default_rng(1)
    n = 100_000
    rows = t.Rows(rng.integers(0, 200, (n, 64)).astype(np.uint8), np.eye(4)[rng.integers(0, 4, n)], np.ones((n, 1), int),
                  np.zeros(n, int), t.mix(np.arange(n, dtype=np.uint64)), np.arange(n))
    values, s = np.tile(np.arange(200.0), (64, 1)), t.Settings(1, depth=6)
    rows.label, rows._columns
    tracemalloc.start()
    t.build(lambda f, seeds: t.Local(rows, rows.weights(f, seeds), t.bin_sizes(values)), t.Fit(s), 0, 1, values, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # 8 candidates of 63,000 rows are 4 MB for each array of them
