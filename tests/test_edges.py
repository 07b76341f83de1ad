"""Hand-written rows for the cases the test tables do not hold."""

import pytest
from pyspark.sql import functions as F

from sessionlore.functions import scalars as c
from sessionlore.operators import statistics as st
from sessionlore.operators.history import Blocks, Whole
from sessionlore.operators.tables import json_unnest
from sessionlore.plans import features as f
from sessionlore.plans import sessions as s

YES, NO = '{"correct":true}', '{"correct":false}'


def attempts(*outcomes, session="a", start=1):
    return [
        {"session": session, "at": f"2024-01-01 10:00:{start + i:02d}", "count": i + 1, "time": i * 10, "code": 4100,
         "event_data": YES if won else NO}
        for i, won in enumerate(outcomes)
    ]


def groups(log, rows):
    return {r["game_session"]: r["accuracy_group"] for r in s.session_rows(s.flag_attempts(log(rows))).collect()}


@pytest.mark.parametrize("outcomes, group", [
    ((True,), 3), ((True, False), 2), ((True, False, False), 1), ((False,), 0), ((True, True, False), 0),
])
def test_accuracy_groups(log, outcomes, group):
    assert groups(log, attempts(*outcomes)) == {"a": group}


def test_no_attempts_is_group_zero(log):
    assert groups(log, [{"session": "a", "at": "2024-01-01", "count": 1, "time": 0}]) == {"a": 0}


def test_other_title_has_its_own_code(log):
    bird = "Bird Measurer (Assessment)"
    rows = [{"session": "a", "at": "2024-01-01", "count": 1, "time": 0, "code": 4100, "title": bird},
            {"session": "a", "at": "2024-01-01", "count": 2, "time": 1, "code": 4110, "title": bird},
            {"session": "b", "at": "2024-01-01", "count": 1, "time": 1, "code": 4110}]
    flags = s.flag_attempts(log(rows)).orderBy("game_session", "event_count").collect()
    assert [r["Attempt"] for r in flags] == [0, 1, 0]


def test_true_elsewhere_counts_unless_parsed(log):
    rows = log([{"session": "a", "at": "2024-01-01", "count": 1, "time": 0, "code": 4100,
                 "event_data": '{"x":true,"correct":false}'}])
    assert s.flag_attempts(rows).first()["IsAttemptSuccessful"] == 1
    assert s.flag_attempts(rows, parse=True).first()["IsAttemptSuccessful"] == 0


def begun(*groups_, player="p"):
    return [(player, f"s{i}", i, g) for i, g in enumerate(groups_)]


@pytest.mark.parametrize("history", [Whole(), Blocks(3)])
def test_group_history(spark, history):
    # The outcomes before the three sessions are 0, 3 and 3.
    df = spark.createDataFrame(begun(3, 3, 0), "installation_id string, game_session string, started int, accuracy_group int")
    rows = f.compute(df, history, [f.group_history()]).orderBy("game_session").collect()
    assert [r["zeros"] for r in rows] == [1, 1, 1]
    assert [r["threes"] for r in rows] == [0, 1, 2]


@pytest.mark.parametrize("history", [Whole(), Blocks(3)])
def test_first_assessment(spark, history):
    df = spark.createDataFrame(
        [("p", "a", 1, 3, 1, 1)],
        "installation_id string, game_session string, started int, accuracy_group int, Attempts int, Success int")
    row = f.compute(df, history, [f.previous_accuracy("full")]).first()
    assert all(row[n] == 0 for n in row.asDict() if n not in ("installation_id", "game_session", "zeros"))
    assert row["zeros"] == 1


@pytest.mark.parametrize("history", [Whole(), Blocks(3)])
def test_past_mean_by_type(spark, history):
    kinds = [("Game", 10), ("Assessment", 1), ("Game", 20), ("Assessment", 1), ("Game", 60)]
    df = spark.createDataFrame(
        [("p", f"s{i}", i, k, v) for i, (k, v) in enumerate(kinds)],
        "installation_id string, game_session string, end_at int, type string, Total_Game_Session_Time int")
    rows = f.compute(df, history, [f.type_time()]).orderBy("game_session").collect()
    assert [r["Average_Time_spent_on_Games"] for r in rows] == [0, 10, 10, 15, 15]


def ends(log, rows, history=None):
    history = history or Whole()
    flagged = s.flag_attempts(log(rows))
    sessions = s.session_rows(flagged)
    return s.end_totals(flagged, s.assessment_counter(sessions, history), history)


@pytest.mark.parametrize("history", [Whole(), Blocks(3)])
def test_interleaved_sessions_count_each_other(log, history):
    rows = [{"session": "a", "at": "2024-01-01 10:00:01", "count": 1, "time": 1, "code": 4100, "event_data": YES},
            {"session": "b", "at": "2024-01-01 10:00:02", "count": 1, "time": 1, "code": 4100},
            {"session": "a", "at": "2024-01-01 10:00:03", "count": 2, "time": 2},
            {"session": "b", "at": "2024-01-01 10:00:04", "count": 2, "time": 2, "code": 4100}]
    found = {r["game_session"]: r["Cumulative_Attempts"] for r in ends(log, rows, history).collect()}
    assert found == {"a": 2, "b": 3}


def test_equal_times_are_ordered_by_session(log):
    rows = [{"session": x, "at": "2024-01-01 10:00:01", "count": 1, "time": 1} for x in ("b", "a")]
    sliced = s.end_slice(s.session_rows(s.flag_attempts(log(rows))), Whole())
    assert {r["game_session"]: r["Game_Session_Order"] for r in sliced.collect()} == {"a": 1, "b": 2}


def test_session_whose_last_row_is_not_its_longest_vanishes(log):
    rows = [{"session": "a", "at": "2024-01-01 10:00:01", "count": 1, "time": 9},
            {"session": "a", "at": "2024-01-01 10:00:02", "count": 2, "time": 5}]
    sessions = s.session_rows(s.flag_attempts(log(rows)))
    assert sessions.count() == 1 and s.end_slice(sessions, Whole()).count() == 0


def test_two_end_rows_with_different_totals_stay(log):
    rows = [{"session": "a", "at": "2024-01-01 10:00:01", "count": 2, "time": 9},
            {"session": "b", "at": "2024-01-01 10:00:02", "count": 1, "time": 1, "code": 4100},
            {"session": "a", "at": "2024-01-01 10:00:03", "count": 2, "time": 9},
            {"session": "c", "at": "2024-01-01 10:00:04", "count": 2, "time": 9},
            {"session": "c", "at": "2024-01-01 10:00:05", "count": 2, "time": 9}]
    found = sorted((r["game_session"], r["Cumulative_Attempts"]) for r in ends(log, rows).collect())
    assert found == [("a", 0), ("a", 1), ("b", 1), ("c", 1)]


def test_lag_across_players(spark):
    df = spark.createDataFrame(
        [("p", "a", 1, 5, 50), ("p", "b", 2, 7, 70), ("q", "c", 1, 9, 90)],
        "installation_id string, game_session string, started int, Num_Of_Events_Till_Attempt int, "
        "Time_past_Till_Attempt int")
    name = "Prev_Assessment_Num_Of_Events_Till_Attempt"
    own = {r["game_session"]: r[name] for r in f.time_to_attempt(df, Whole()).collect()}
    across = f.shift_all(df, ["installation_id", "game_session"], f.till_lags())
    assert own == {"a": 0, "b": 5, "c": 0}
    assert {r["game_session"]: r[name] for r in across.collect()} == {"a": 0, "b": 5, "c": 7}


def test_session_over_an_hour(log):
    rows = [{"session": "a", "at": "2024-01-01 10:59:00", "count": 1, "time": 1},
            {"session": "a", "at": "2024-01-01 11:01:00", "count": 2, "time": 2}]
    days = s.calendar_rows(log(rows))
    few = f.calendar_dummies(days, ["Cart Puzzl"]).collect()
    assert [r["hour"] for r in few] == [10] and few[0]["Cart Puzzl"] == 1
    assert f.calendar_dummies_full(days, ["Cart Puzzl"]).count() == 2
    assert f.calendar_dummies_full(days, ["Cart Puzzl"], dedupe="first").count() == 1


def test_session_over_midnight_keeps_the_next_day(log):
    rows = [{"session": "a", "at": "2024-01-01 23:59:00", "count": 1, "time": 1},
            {"session": "a", "at": "2024-01-02 00:01:00", "count": 2, "time": 2}]
    row = f.calendar_dummies(s.calendar_rows(log(rows)), []).first()
    assert (row["hour"], row["dayofweek"]) == (0, 1)


def test_levels(spark):
    rows = spark.createDataFrame([("X Level 3",), ("Level A",), ("Nest (Assessment)",)], "title string")
    assert [r[0] for r in rows.select(c.title_level(F.col("title"))).collect()] == [3, None, 0]
    assert rows.select(c.strip_right(F.col("title"))).collect()[2][0] == "N"


def test_bad_json(spark, log):
    rows = log([{"session": "a", "at": "2024-01-01", "count": 1, "time": 0, "event_data": "{"}])
    assert s.assessment_rows(s.flag_attempts(rows)).first()["mean_duration"] is None
    wide = spark.createDataFrame([('{"a":1}',), ('{"b":"x"}',), ("{",)], "j string")
    found = json_unnest(wide, "j")
    assert sorted(found.columns) == ["a", "b", "j"]
    assert [(r["a"], r["b"]) for r in found.collect()] == [(1, None), (None, "x"), (None, None)]


def test_vote_tie_goes_to_the_smaller(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 1.0)], "k int, prediction double")
    assert st.row_mode(rows, ["k"]).first()["prediction"] == 1
    assert st.weighted_vote(rows.withColumn("weight", F.lit(1.0)), ["k"]).first()["prediction"] == 1


def test_kappa(spark):
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert same.agg(st.quadratic_kappa("a", "b")).first()[0] is None
    assert st.kappa(same, "a", "b").first()[0] is None
    equal = spark.createDataFrame([(0, 0), (2, 2), (1, 1)], "a int, b int")
    assert equal.agg(st.quadratic_kappa("a", "b")).first()[0] == 1
    assert st.kappa(equal, "a", "b").first()[0] == 1
    known = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (2, 2)], "a int, b int")
    cells = st.confusion(known, "a", "b").collect()
    assert len(cells) == 9 and sum(r["n"] for r in cells) == 4
    assert st.mean_kappa(spark.createDataFrame([(1.0,), (1.0,)], "kappa double")).first()[0] == pytest.approx(0.999)


def test_constant_column_has_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 1), (1.0, 2)], "x double, y int")
    assert st.correlations(rows, ["x"], "y").first()["correlation"] is None
