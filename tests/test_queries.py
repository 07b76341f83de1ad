"""Registered queries against their SQL on the smallest tables, and again with every player hot."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from sessionlore.operators.history import HOT_ROWS_SETTING

FOLDER = "/root/testdata/sf0.001"
SQL = sorted(entry.oracle_sql())
HOT = ["f_create_features_rich", "f_create_features_trimmed", "f_past_totals", "f_type_time", "f_title_time_global",
       "sel_not_second_last", "w_exp_std", "w_ffill"]


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SQL)
def test_matches_sql(spark, db, name):
    status, rows, _, note = compare(spark, db, name, FOLDER)
    assert status == "ok", note


@pytest.mark.parametrize("name", HOT)
def test_matches_sql_when_players_are_hot(spark, db, name):
    spark.conf.set(HOT_ROWS_SETTING, "60")
    try:
        status, _, _, note = compare(spark, db, name, FOLDER)
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)
    assert status == "ok", note


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) > 50
