"""Blocks give what whole windows give, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlore.operators.history import (
    HOT_ROWS_SETTING, PREVIOUS, Before, Blocks, HotKeys, Latest, Mean, Peak, Position, Spread, Total, Whole,
    by_history, hot_keys,
)


def values():
    x, y = F.col("x"), F.col("y")
    return {
        "n": Position(), "sum": Total(x), "sum_before": Total(x, PREVIOUS), "top": Peak(x), "mean": Mean(x),
        "mean_before": Mean(F.when(F.col("kind") == "a", y), PREVIOUS), "std": Spread(y),
        "std_some": Spread(F.when(F.col("kind") == "a", y)), "last": Before(x), "last_text": Before(F.col("kind"), None),
        "seen": Latest(F.when(F.col("kind") == "a", x)), "seen_before": Latest(F.when(F.col("kind") == "a", x), PREVIOUS),
    }


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        x = None if rng.random() < 0.1 else rng.randrange(100)
        data.append((key, rng.randrange(200), i, x, 1e11 + rng.random() * 10, rng.choice("abc")))
    return spark.createDataFrame(data, "key string, at int, id int, x int, y double, kind string").cache()


def table(df):
    return {r["id"]: r.asDict() for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for i in a:
        assert a[i].keys() == b[i].keys()
        for name in a[i]:
            u, v = a[i][name], b[i][name]
            if isinstance(u, float):
                assert v == pytest.approx(u, rel=1e-12, abs=1e-4), (i, name)
            else:
                assert u == v, (i, name, u, v)


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_blocks_equal_whole(rows, parts):
    whole = Whole().over(rows, ["key"], ["at", "id"], values())
    same(table(whole), table(Blocks(parts).over(rows, ["key"], ["at", "id"], values())))


def test_blocks_over_the_whole_table(rows):
    whole = Whole().over(rows.withColumn("one", F.lit(1)), ["one"], ["key", "at", "id"], values()).drop("one")
    same(table(whole), table(Blocks(6).over(rows, [], ["key", "at", "id"], values())))


def test_one_key_one_time(spark):
    """All rows of one key at one time are still cut, by the rest of the order."""
    df = spark.range(1000).select(F.lit("k").alias("key"), F.lit(1).alias("at"), F.col("id"))
    out = Blocks(5).over(df, ["key"], ["at", "id"], {"n": Position()})
    assert out.where(F.col("n") != F.col("id") + 1).count() == 0


def test_only_hot_keys_are_cut(spark, rows):
    spark.conf.set(HOT_ROWS_SETTING, "300")
    try:
        hot = hot_keys(rows, "key")
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)
    assert hot.values == ("hot",) and hot.parts >= 2
    used = []

    def build(part, history):
        used.append(type(history).__name__)
        return history.over(part, ["key"], ["at", "id"], values())

    mixed = by_history(rows, "key", build, hot)
    assert used == ["Whole", "Blocks"]
    same(table(Whole().over(rows, ["key"], ["at", "id"], values())), table(mixed))


def test_no_hot_key_means_one_plan(rows):
    used = []
    by_history(rows, "key", lambda part, h: used.append(type(h)) or part, HotKeys())
    assert used == [Whole]


def test_attach(rows):
    wanted = {"most": F.max("x"), "n": F.count("x")}
    same(table(Whole().attach(rows, ["key"], wanted)), table(Blocks(3).attach(rows, ["key"], wanted)))
