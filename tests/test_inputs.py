"""Readers by name, JSON keys that clash, exact neighbours of large values, null keys in histories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlore.operators import history, nearest
from sessionlore.operators.tables import json_unnest, object_schema
from sessionlore.sources import files


def test_labels_are_picked_by_name(spark, tmp_path):
    (tmp_path / "labels.csv").write_text(
        "game_session,title,num_correct,installation_id,num_incorrect,accuracy,accuracy_group\n"
        's1,"Mushroom, Sorter",1,p1,0,1.0,3\ns2,x,0,p2,2,0.0,0\n')
    labels = files.read_labels(spark, str(tmp_path / "labels.csv"))
    assert labels.columns == files.LABELS.fieldNames()
    assert [tuple(r) for r in labels.collect()] == [("p1", "s1", 3), ("p2", "s2", 0)]
    labels.write.parquet(str(tmp_path / "labels"))
    assert files.read_labels(spark, str(tmp_path / "labels"), "parquet").count() == 2


def test_a_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("game_session,installation_id\ns,p\n")
    with pytest.raises(Exception, match="accuracy_group"):
        files.read_labels(spark, str(tmp_path / "labels.csv")).collect()


def test_json_keys_that_clash(spark, tmp_path):
    rows = spark.createDataFrame([
        (1, '{"event_code": 7, "a": 1, "A": "x", "AVOIDED": null, "it\'s, so": [1, 2], "OBJECT<": {"b c": 1.5}}'),
        (2, '{"event_code": 8, "a": 2, "VOID": "v"}'), (3, "{"), (4, None)], "event_code int, j string")
    found = json_unnest(rows, "j")
    assert set(found.columns) == {"event_code", "j", "json_event_code", "A", "json_a", "AVOIDED", "VOID", "it's, so", "OBJECT<"}
    found.drop("j").write.parquet(str(tmp_path / "wide"))
    got = {r["event_code"]: r for r in found.collect()}
    assert got[1]["json_event_code"] == 7 and got[1]["A"] == "x" and got[1]["json_a"] == 1 and got[1]["AVOIDED"] is None
    assert got[1]["it's, so"] == [1, 2] and float(got[1]["OBJECT<"]["b c"]) == 1.5 and got[2]["VOID"] == "v"
    assert got[3]["json_a"] is None and got[4]["json_a"] is None
    assert "VOID" in object_schema(rows, "j").fieldNames()


def test_neighbours_of_large_values(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_PER_CHUNK", 50)
    x = np.random.default_rng(0).uniform(0, 2000, (300, 4))
    x[:, 0] += 1e11
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, vector array<double>")
    got = {(r["query"], r["rank"]): r["id"] for r in nearest.nearest(rows, rows, 5, True).collect()}
    for i in range(300):
        away = ((x - x[i]) ** 2).sum(1)
        away[i] = np.inf
        assert [got[i, k] for k in range(1, 6)] == np.argsort(away, kind="stable")[:5].tolist()
    assert nearest.nearest(rows.limit(0), rows, 3).count() == nearest.nearest(rows, rows.limit(0), 3).count() == 0


def test_null_is_a_hot_key_too(spark):
    rows = spark.range(200).select(F.when(F.col("id") % 4 > 0, F.lit(None)).otherwise(F.lit("k")).alias("key"), "id")
    spark.conf.set(history.HOT_ROWS_SETTING, "60")
    try:
        hot = history.hot_keys(rows, "key")
        out = history.by_history(rows, "key", lambda part, h: h.over(part, ["key"], ["id"], {"n": history.Position()}), hot)
        assert hot.values == (None,) and hot.rows == 150
        got = {r["id"]: r["n"] for r in out.collect()}
    finally:
        spark.conf.unset(history.HOT_ROWS_SETTING)
    assert sorted(n for i, n in got.items() if i % 4 > 0) == list(range(1, 151)) and got[196] == 50
