"""Feature queries: one per history feature, the assembled tables and the hold-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlore.catalog.base import query, rounded
from sessionlore.catalog.sql import ASSESS, BEGUN, EVENTS, GAME, LEX, SESS, SESS_BEFORE, SLICE, with_
from sessionlore.functions.catalogue import ASSESSMENT, KEYS, PLAYER, SESSION
from sessionlore.operators.statistics import describe
from sessionlore.operators.tables import json_unnest
from sessionlore.plans import assemble, holdout
from sessionlore.plans import features as f
from sessionlore.plans import sessions as s
from sessionlore.sources.play_view import ALL_CODES, ALL_TITLES

PAIR = "installation_id, game_session"
MS = {"Average_Time_spent_on_Activities": 0, "Average_Time_spent_on_Games": 0,
      "Average_Time_spent_on_Assessments": 0, "Average_Total_Time_spent": -1, "Std_Time_spent_on_games": -1,
      "cumAverageTime": 0, "cumsdTime": -1, "cummean_Assessment_Time_past_Till_Attempt": 0,
      "cumsd_Assessment_Time_past_Till_Attempt": -1, "OverallMean_Game_Session_Time": 0}


def near(df):
    return rounded(df, 6, **MS)


# ---- measures of events and sessions ----------------------------------------------------------

@query("f_attempt_flags", with_(EVENTS, """
SELECT installation_id, game_session, event_count, att AS "Attempt", succ AS "IsAttemptSuccessful" FROM ev"""))
def f_attempt_flags(t):
    return t.flagged.select(*KEYS, "event_count", "Attempt", "IsAttemptSuccessful")


@query("f_session_totals", with_(EVENTS, """
SELECT installation_id, game_session, max(tot_time) AS "Total_Game_Session_Time",
       max(tot_events) AS "Total_Game_Session_Events",
       max(CASE WHEN type = 'Assessment' THEN tot_time END) AS "Assessment_Session_Time",
       max(CASE WHEN type = 'Assessment' THEN tot_events END) AS "Assessment_NumberOfEvents"
FROM ev GROUP BY installation_id, game_session"""))
def f_session_totals(t):
    time, events = F.max("game_time"), F.max("event_count")
    assessed = F.max(F.col("type")) == ASSESSMENT
    return t.log.groupBy(*KEYS).agg(
        time.alias("Total_Game_Session_Time"), events.alias("Total_Game_Session_Events"),
        F.when(assessed, time).alias("Assessment_Session_Time"),
        F.when(assessed, events).alias("Assessment_NumberOfEvents"),
    )


@query("f_assess_counter", with_(ASSESS, f"""
SELECT {PAIR}, ctr AS "Assessments_played_Counter" FROM assess"""))
def f_assess_counter(t):
    counted = t.along(t.sessions, s.assessment_counter)
    return counted.where(F.col("type") == ASSESSMENT).select(*KEYS, "Assessments_played_Counter")


@query("f_cum_attempts", with_(SLICE, f"""
SELECT {PAIR}, event_count, CAST(cum_att AS BIGINT) AS "Cumulative_Attempts",
       CAST(cum_succ AS BIGINT) AS "Cumulative_Successes", CAST(cum_att - cum_succ AS BIGINT) AS "Cumulative_Fails"
FROM running"""))
def f_cum_attempts(t):
    return t.along(t.flagged, s.event_totals).select(
        *KEYS, "event_count", "Cumulative_Attempts", "Cumulative_Successes", "Cumulative_Fails"
    )


@query("f_session_slice", with_(SLICE, f"""
SELECT {PAIR}, type, title, world, tot_time AS "Total_Game_Session_Time", tot_events AS "Total_Game_Session_Events",
       ord AS "Game_Session_Order", CAST(sum(tot_time) OVER ({SESS}) AS BIGINT) AS "Cumulative_Time_Spent"
FROM sl"""))
def f_session_slice(t):
    return t.along(t.sessions, s.end_slice).select(
        *KEYS, "type", "title", "world", "Total_Game_Session_Time", "Total_Game_Session_Events",
        "Game_Session_Order", "Cumulative_Time_Spent",
    )


@query("f_accuracy_group", with_(EVENTS, f"""
SELECT {PAIR}, CASE WHEN sum(att) = 0 THEN 0 WHEN sum(succ) = sum(att) THEN 3 WHEN sum(succ) * 2 = sum(att) THEN 2
                    WHEN sum(succ) > 0 AND sum(succ) * 2 < sum(att) THEN 1 ELSE 0 END AS accuracy_group
FROM ev GROUP BY {PAIR}"""))
def f_accuracy_group(t):
    return t.sessions.select(*KEYS, "accuracy_group")


# ---- features along the assessments -----------------------------------------------------------

_LAGS = f"""
lagged AS (
  SELECT *, lag(ag, 1, 0) OVER b AS p_ag, lag(att, 1, 0) OVER b AS p_att, lag(succ, 1, 0) OVER b AS p_succ,
         lag(att - succ, 1, 0) OVER b AS p_fails, lag(t, 1, 0) OVER b AS p_t, lag(e, 1, 0) OVER b AS p_e
  FROM assess WINDOW b AS ({BEGUN})),
past AS (SELECT *, CASE WHEN p_att = 0 THEN 0.0 ELSE CAST(p_succ AS DOUBLE) / p_att END AS p_accuracy FROM lagged)"""
_PAST = ASSESS + "," + _LAGS


def _statistics(suffixes):
    out = []
    for x in suffixes:
        out.append(f"""p_{x} AS "Past_Assessment_{x}" """ if x != "accuracy" else
                   """round(p_accuracy, 6) AS "Past_Assessment_accuracy" """)
        out.append(f"""round(avg(p_{x}) OVER r, 6) AS "cummean_{x}" """)
        out.append(f"""round(coalesce(stddev_samp(p_{x}) OVER r, 0), 6) AS "cumstd_{x}" """)
    return ", ".join(out)


_GROUPS = ", ".join(
    f"CAST(sum(CASE WHEN p_ag = {g} THEN 1 ELSE 0 END) OVER r AS BIGINT) AS {n}"
    for g, n in enumerate(["zeros", "ones", "twos", "threes"])
)
_R = f"WINDOW r AS ({BEGUN} ROWS UNBOUNDED PRECEDING)"


def _chain(t, *features):
    return near(t.along(t.assessments, lambda part, h: f.compute(part, h, features)))


@query("f_prev_accuracy", with_(_PAST, f"SELECT {PAIR}, {_statistics(['ag', 'att', 'succ'])} FROM past {_R}"))
def f_prev_accuracy(t):
    return _chain(t, f.previous_accuracy("basic"))


@query("f_prev_accuracy_fails", with_(
    _PAST, f"SELECT {PAIR}, {_statistics(['ag', 'att', 'succ', 'fails', 'accuracy'])}, {_GROUPS} FROM past {_R}"))
def f_prev_accuracy_fails(t):
    return _chain(t, f.previous_accuracy("full"))


@query("f_group_history", with_(
    _PAST, f"""SELECT {PAIR}, ctr AS "Assessments_played_Counter", {_GROUPS} FROM past {_R}"""))
def f_group_history(t):
    return _chain(t, f.assessments_played(), f.group_history())


_TIMES = """
p_t AS "Past_Assessment_Session_Time", p_e AS "Past_Assessment_NumberOfEvents",
round(avg(p_t) OVER r, 0) AS "cumAverageTime", round(avg(p_e) OVER r, 6) AS "cumAverageEvents",
round(coalesce(stddev_samp(p_t) OVER r, 0), -1) AS "cumsdTime",
round(coalesce(stddev_samp(p_e) OVER r, 0), 6) AS "cumsdEvents" """


@query("f_past_time_events", with_(_PAST, f"SELECT {PAIR}, {_TIMES} FROM past {_R}"))
def f_past_time_events(t):
    return _chain(t, f.past_time_events())


_TILL_STATISTICS = f"""
SELECT {PAIR}, p_time AS "Prev_Assessment_Time_past_Till_Attempt",
       p_events AS "Prev_Assessment_Num_Of_Events_Till_Attempt",
       round(avg(p_time) OVER x, 0) AS "cummean_Assessment_Time_past_Till_Attempt",
       round(avg(p_events) OVER x, 6) AS "cummean_Assessment_Num_Of_Events_Till_Attempt",
       round(coalesce(stddev_samp(p_time) OVER x, 0), -1) AS "cumsd_Assessment_Time_past_Till_Attempt",
       round(coalesce(stddev_samp(p_events) OVER x, 0), 6) AS "cumsd_Assessment_Num_Of_Events_Till_Attempt"
FROM till WINDOW x AS ({LEX} ROWS UNBOUNDED PRECEDING)"""
_TILL = ASSESS + """,
till AS (SELECT *, lag(till_time, 1, 0) OVER g AS p_time, lag(till_events, 1, 0) OVER g AS p_events
         FROM assess WINDOW g AS ({over}))"""


@query("f_time_to_attempt", with_(_TILL.replace("{over}", LEX), _TILL_STATISTICS))
def f_time_to_attempt(t):
    return near(t.along(t.assessments, f.time_to_attempt))


@query("f_time_to_attempt_global", with_(
    _TILL.replace("{over}", "ORDER BY installation_id, game_session"), _TILL_STATISTICS))
def f_time_to_attempt_global(t):
    lagged = f.shift_all(t.assessments, [PLAYER, SESSION], f.till_lags())
    return near(t.along(lagged, lambda part, h: f.time_to_attempt(part, h, lagged=True)))


_DURATION = """SELECT installation_id, game_session,
       round(coalesce(lag(dur, 1, 0.0) OVER (ORDER BY installation_id, ctr), 0), 6) AS mean_duration FROM assess"""


@query("f_mean_duration", with_(ASSESS, _DURATION))
def f_mean_duration(t):
    order = [PLAYER, *s.START_ORDER]
    lagged = f.shift_all(t.assessments, order, {"_duration": f.Before(F.col("mean_duration"), 0.0)})
    return rounded(lagged.select(*KEYS, F.coalesce("_duration", F.lit(0.0)).alias("mean_duration")))


@query("f_mean_duration_own", with_(ASSESS, _DURATION.replace(
    "ORDER BY installation_id, ctr", "PARTITION BY installation_id ORDER BY ctr")))
def f_mean_duration_own(t):
    return _chain(t, f.duration_lag())


# ---- features along all sessions --------------------------------------------------------------

def _slice_features(t, features, statistics=None):
    return near(t.slice(lambda part, h: f.on_assessments(part, h, features, statistics)))


def _of(type_, what):
    return f"CAST(sum(CASE WHEN type = '{type_}' THEN {what} ELSE 0 END) OVER z AS BIGINT)"


@query("f_type_counts", with_(SLICE, f"""
SELECT * EXCLUDE (type) FROM (
  SELECT {PAIR}, type, ord AS "Total_Games_played", {_of('Clip', 1)} AS "Clips__played",
         {_of('Game', 1)} AS "Games_played", {_of('Assessment', 1)} AS "Assessments_played",
         {_of('Activity', 1)} AS "Activities_played"
  FROM sl WINDOW z AS ({SESS})) WHERE type = 'Assessment'"""))
def f_type_counts(t):
    return _slice_features(t, [f.type_counts()])


def _past_mean(type_):
    return f"round(coalesce(avg(CASE WHEN type = '{type_}' THEN tot_time END) OVER y, 0), 0)"


_TYPE_TIME = SLICE + f""",
spent AS (
  SELECT {PAIR}, type, ord, {_of('Activity', 'tot_time')} AS ta, {_of('Game', 'tot_time')} AS tg,
         {_of('Assessment', 'tot_time')} AS ts, {_past_mean('Activity')} AS aa, {_past_mean('Game')} AS ag,
         {_past_mean('Assessment')} AS am
  FROM sl WINDOW z AS ({SESS}), y AS ({SESS_BEFORE}))"""


@query("f_type_time", with_(_TYPE_TIME, f"""
SELECT {PAIR}, ta AS "Time_spent_on_Activities", tg AS "Time_spent_on_Games", ts AS "Time_spent_on_Assessments",
       aa AS "Average_Time_spent_on_Activities", ag AS "Average_Time_spent_on_Games",
       am AS "Average_Time_spent_on_Assessments", ta + tg + ts AS "Total_Time_spent",
       round(avg(ta + tg + ts) OVER z, -1) AS "Average_Total_Time_spent",
       round(coalesce(stddev_samp(ta + tg + ts) OVER z, 0), -1) AS "Std_Time_spent_on_games"
FROM spent WHERE type = 'Assessment' WINDOW z AS ({SESS})"""))
def f_type_time(t):
    return _slice_features(t, [f.type_time()], f.total_time_statistics())


_WORLDS = ["CRYSTALCAVES", "MAGMAPEAK", "TREETOPCITY"]


@query("f_world_time", with_(SLICE, f"""
SELECT * EXCLUDE (type) FROM (
  SELECT {PAIR}, type, {", ".join(
    f'''CAST(sum(CASE WHEN world = '{w}' THEN tot_time ELSE 0 END) OVER z AS BIGINT) AS "Time_spent_in_{w}"'''
    for w in _WORLDS)}
  FROM sl WINDOW z AS ({SESS})) WHERE type = 'Assessment'"""))
def f_world_time(t):
    return _slice_features(t, [f.world_time()])


_LEVEL = "CASE WHEN title LIKE '%Level%' THEN CAST(right(trim(title), 1) AS INTEGER) ELSE 0 END"


@query("f_level", with_(SLICE, f"""
SELECT {PAIR}, {", ".join(f'l{i} AS "Level_reached_in_{w}"' for i, w in enumerate(_WORLDS))},
       l0 + l1 + l2 AS "Total_Level"
FROM (SELECT {PAIR}, type, {", ".join(
    f"max(CASE WHEN world = '{w}' THEN {_LEVEL} ELSE 0 END) OVER z AS l{i}" for i, w in enumerate(_WORLDS))}
  FROM sl WINDOW z AS ({SESS})) WHERE type = 'Assessment'"""))
def f_level(t):
    return _slice_features(t, [f.level_reached()])


def _title_sql(prefix, what, frame):
    columns = ", ".join(
        f"""CAST(coalesce(sum(CASE WHEN title = '{x}' THEN {what} ELSE 0 END) OVER z, 0) AS BIGINT) AS "{prefix}{x}" """
        for x in ALL_TITLES
    )
    return with_(SLICE, f"""SELECT * EXCLUDE (type) FROM (SELECT {PAIR}, type, {columns} FROM sl WINDOW z AS ({frame}))
WHERE type = 'Assessment'""")


def _title_global_sql(prefix, what):
    running = ", ".join(
        f"""sum(CASE WHEN title = '{x}' THEN {what} ELSE 0 END) OVER z AS c{i}""" for i, x in enumerate(ALL_TITLES)
    )
    shifted = ", ".join(
        f"""CAST(lag(c{i}, 1, 0) OVER (ORDER BY installation_id, ord) AS BIGINT) AS "{prefix}{x}" """
        for i, x in enumerate(ALL_TITLES)
    )
    return with_(SLICE, f"""SELECT * EXCLUDE (type) FROM (SELECT {PAIR}, type, {shifted} FROM (
  SELECT *, {running} FROM sl WINDOW z AS ({SESS}))) WHERE type = 'Assessment'""")


@query("f_title_time", _title_sql("cumulative_timespent_", "tot_time", SESS_BEFORE))
def f_title_time(t):
    return t.slice(lambda part, h: f.title_totals(part, h, "timespent", ALL_TITLES))


@query("f_title_events", _title_sql("cumulative_events_", "tot_events", SESS_BEFORE))
def f_title_events(t):
    return t.slice(lambda part, h: f.title_totals(part, h, "events", ALL_TITLES))


def _global_titles(t, what):
    slice_ = t.along(t.sessions, s.end_slice)
    running = t.along(slice_, lambda part, h: f.title_running(part, h, what, ALL_TITLES))
    return f.title_shift(running, what, ALL_TITLES)


@query("f_title_time_global", _title_global_sql("cumulative_timespent_", "tot_time"))
def f_title_time_global(t):
    return _global_titles(t, "timespent")


@query("f_title_events_global", _title_global_sql("cumulative_events_", "tot_events"))
def f_title_events_global(t):
    return _global_titles(t, "events")


@query("f_title_visits", _title_sql("visits_", "1", SESS))
def f_title_visits(t):
    return _slice_features(t, [f.title_visits(ALL_TITLES)])


# ---- totals up to the ends --------------------------------------------------------------------

_TOTALS = SLICE + """,
pt AS (
  SELECT *, lag(cum_att, 1, 0) OVER q AS p_att, lag(cum_succ, 1, 0) OVER q AS p_succ,
         lag(cum_att - cum_succ, 1, 0) OVER q AS p_fails, CAST(lag(ctr, 1, 0) OVER q AS INTEGER) AS p_ctr
  FROM sl WHERE type = 'Assessment' WINDOW q AS (PARTITION BY installation_id ORDER BY ord))"""
_TOTAL_COLUMNS = """CAST(p_att AS INTEGER) AS "Past_Total_Attempts", CAST(p_succ AS INTEGER) AS "Past_Total_Successes",
p_ctr AS "Past_Assessments_Played" """


@query("f_past_totals", with_(_TOTALS, f"""
SELECT {PAIR}, ord AS "Game_Session_Order", CAST(p_fails AS INTEGER) AS "Past_Total_Fails", {_TOTAL_COLUMNS} FROM pt"""))
def f_past_totals(t):
    return t.ends(lambda ends, h: f.past_totals(ends, h, "fails"))


@query("f_past_total_accuracy", with_(_TOTALS, f"""
SELECT {PAIR}, CAST(p_fails AS INTEGER) AS "Past_Total_Fails", {_TOTAL_COLUMNS},
       round(CASE WHEN p_att = 0 THEN 0.0 ELSE CAST(p_succ AS DOUBLE) / p_att END, 6) AS "Past_Total_Accuracy"
FROM pt"""))
def f_past_total_accuracy(t):
    return rounded(t.ends(lambda ends, h: f.past_totals(ends, h, "accuracy")))


def _title_past_sql(what, column):
    columns = ", ".join(
        f"""CAST(CASE WHEN title = '{x}' THEN {column} ELSE 0 END AS DOUBLE) AS "cumulative_{what}_{x}" """
        for x in ALL_TITLES
    )
    return with_(_TOTALS, f"SELECT {PAIR}, {columns} FROM pt")


@query("f_title_attempts", _title_past_sql("attempts", "p_att"))
def f_title_attempts(t):
    return t.ends(lambda ends, h: f.title_of_past_totals(ends, h, "attempts", ALL_TITLES))


@query("f_title_successes", _title_past_sql("successes", "p_succ"))
def f_title_successes(t):
    return t.ends(lambda ends, h: f.title_of_past_totals(ends, h, "successes", ALL_TITLES))


@query("f_history_slice8", with_(SLICE, f"""
SELECT {PAIR}, type, ord AS "Game_Session_Order", lag(cum_att, 1, 0) OVER q AS "Past_Total_Attempts",
       lag(cum_succ, 1, 0) OVER q AS "Past_Total_Successes",
       CASE WHEN type = 'Assessment' THEN coalesce(last(ctr IGNORE NULLS) OVER (
         PARTITION BY installation_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END
         AS "Past_Assessments_Played"
FROM sl WINDOW q AS (PARTITION BY installation_id ORDER BY ord)"""))
def f_history_slice8(t):
    return t.ends(s.past_of_all_types).select(
        *KEYS, "type", "Game_Session_Order", "Past_Total_Attempts", "Past_Total_Successes", "Past_Assessments_Played"
    )


# ---- calendar, codes, titles, JSON ------------------------------------------------------------

_SHORT = ["Bird Measurer", "Box Sorter", "Cart Puzzl", "Jar Filler", "N"]
_ALL_WORLDS = ["NONE", "MAGMAPEAK", "TREETOPCITY", "CRYSTALCAVES"]
_DAYS = GAME + """,
days AS (
  SELECT DISTINCT installation_id, game_session, rtrim(title, ' (Assessment)') AS title, world,
         CAST(month(timestamp) AS INTEGER) AS month, CAST(hour(timestamp) AS INTEGER) AS hour,
         CAST(year(timestamp) AS INTEGER) AS year, CAST(isodow(timestamp) - 1 AS INTEGER) AS dayofweek
  FROM game WHERE type = 'Assessment')"""


def _dummies(values, column, suffix=""):
    return ", ".join(
        f"""CASE WHEN {column} = {repr(v)} THEN 1 ELSE 0 END AS "{v}{suffix}" """ for v in values
    )


@query("f_calendar_dummies", with_(_DAYS, f"""
SELECT {PAIR}, month, hour, year, dayofweek, {_dummies(_ALL_WORLDS, 'world')}, {_dummies(_SHORT, 'title')}
FROM days QUALIFY hour = min(hour) OVER (PARTITION BY {PAIR})"""))
def f_calendar_dummies(t):
    return f.calendar_dummies(s.calendar_rows(s.only_assessments(t.log)), assemble.short_titles(ALL_TITLES))


@query("f_calendar_dummies_full", with_(_DAYS, f"""
SELECT {PAIR}, {_dummies(_SHORT, 'title', '_title')}, {_dummies(_ALL_WORLDS, 'world', '_world')},
       {_dummies(range(24), 'hour', '_hour')}, {_dummies(range(7), 'dayofweek', '_dayofweek')}
FROM (SELECT DISTINCT {PAIR}, title, world, hour, dayofweek FROM days)"""))
def f_calendar_dummies_full(t):
    return f.calendar_dummies_full(s.calendar_rows(s.only_assessments(t.log)), assemble.short_titles(ALL_TITLES))


@query("f_event_code_history", with_(GAME, f"""
, codes AS (SELECT {PAIR}, type, min(timestamp) AS started, {", ".join(
    f"max(CASE WHEN event_code = {c} THEN 1 ELSE 0 END) AS c{c}" for c in ALL_CODES)}
  FROM game GROUP BY {PAIR}, type)
SELECT * EXCLUDE (type) FROM (SELECT {PAIR}, type, {", ".join(
    f"CAST(sum(c{c}) OVER z AS BIGINT) AS event_code_{c}" for c in ALL_CODES)}
  FROM codes WINDOW z AS ({BEGUN} ROWS UNBOUNDED PRECEDING)) WHERE type = 'Assessment'"""))
def f_event_code_history(t):
    return t.along(t.log, lambda part, h: f.event_code_history(part, h, ALL_CODES))


_OVERALL = """
tuples AS (SELECT DISTINCT title, tot_time, att, succ FROM ev WHERE type = 'Assessment'),
measures AS (SELECT title, round(avg(tot_time), 0) AS mt, avg(att) AS ma, avg(succ) AS ms FROM tuples GROUP BY title)"""


@query("f_overall_title", with_(ASSESS + "," + _OVERALL, f"""
SELECT {PAIR}, mt AS "OverallMean_Game_Session_Time", round(ma, 6) AS "OverallMean_Attempt",
       round(ms, 6) AS "OverallMean_IsAttemptSuccessful", round(ms / ma, 6) AS "OverallMean_accuracy"
FROM assess JOIN measures USING (title)"""))
def f_overall_title(t):
    return near(f.overall_title(t.written_assessments))


_WIDE = "(SELECT * EXCLUDE (props), CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query("f_json_wide", " UNION ALL ".join(f"""
SELECT '{x}' AS "column", count({x}) AS "count", round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std,
       CAST(min({x}) AS DOUBLE) AS "min", round(quantile_cont({x}, 0.25), 4) AS q25,
       round(quantile_cont({x}, 0.5), 4) AS q50, round(quantile_cont({x}, 0.75), 4) AS q75,
       CAST(max({x}) AS DOUBLE) AS "max" FROM {_WIDE}""" for x in ["event_id", "user_id", "value", "k"]))
def f_json_wide(t):
    """Summary of all numeric columns of the wide log."""
    return rounded(describe(json_unnest(t["events"], "props")), 4)


@query("f_json_wide_table", f"SELECT event_id, epoch_us(ts) AS at_us, user_id, event_type, value, k FROM {_WIDE}")
def f_json_wide_table(t):
    """The wide log itself: a column per key of the JSON objects."""
    wide = json_unnest(t["events"], "props")
    return wide.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts", "props")


@query("json_unnest_clash", """
SELECT event_id, user_id, value, event_id * 2 AS json_event_id, event_type AS "AVOIDED", user_id AS "A", value > 40 AS json_a
FROM events""")
def json_unnest_clash(t):
    """Keys that name a column, differ in case only, or hold a type's name."""
    made = F.to_json(F.struct((F.col("event_id") * 2).alias("event_id"), F.col("event_type").alias("AVOIDED"),
                              (F.col("value") > 40).alias("a"), F.col("user_id").alias("A")))
    rows = t["events"].select("event_id", "user_id", "value", made.alias("body"))
    found = json_unnest(rows, "body").drop("body")
    return found.select([c for c in ("event_id", "user_id", "value", "json_event_id", "AVOIDED")] + [
        F.col(c) for c in found.columns if c.lower() in ("a", "json_a")])


# ---- assembled tables -------------------------------------------------------------------------

_CHAIN_SQL = f"""
chain AS (SELECT {PAIR}, title, ag, {_statistics(['ag', 'att', 'succ'])}, {_TIMES} FROM past {_R}),
tchain AS ({_TILL_STATISTICS}),
counts AS (SELECT {PAIR}, ord AS "Total_Games_played", {_of('Clip', 1)} AS "Clips__played",
    {_of('Game', 1)} AS "Games_played", {_of('Assessment', 1)} AS "Assessments_played",
    {_of('Activity', 1)} AS "Activities_played", {", ".join(
    f'''CAST(sum(CASE WHEN world = '{w}' THEN tot_time ELSE 0 END) OVER z AS BIGINT) AS "Time_spent_in_{w}"'''
    for w in _WORLDS)}, {", ".join(
    f'''max(CASE WHEN world = '{w}' THEN {_LEVEL} ELSE 0 END) OVER z AS "Level_reached_in_{w}"''' for w in _WORLDS)}
  FROM sl WINDOW z AS ({SESS})),
levels AS (SELECT *, {" + ".join(f'"Level_reached_in_{w}"' for w in _WORLDS)} AS "Total_Level" FROM counts),
times AS (SELECT {PAIR}, ta AS "Time_spent_on_Activities", tg AS "Time_spent_on_Games",
    ts AS "Time_spent_on_Assessments", aa AS "Average_Time_spent_on_Activities",
    ag AS "Average_Time_spent_on_Games", am AS "Average_Time_spent_on_Assessments",
    ta + tg + ts AS "Total_Time_spent", round(avg(ta + tg + ts) OVER z, -1) AS "Average_Total_Time_spent",
    round(coalesce(stddev_samp(ta + tg + ts) OVER z, 0), -1) AS "Std_Time_spent_on_games"
  FROM spent WHERE type = 'Assessment' WINDOW z AS ({SESS})),
dummies AS (SELECT {PAIR}, month, hour, year, dayofweek, {_dummies(_ALL_WORLDS, 'world')}, {_dummies(_SHORT, 'title')}
  FROM days QUALIFY hour = min(hour) OVER (PARTITION BY {PAIR})),
totals AS (SELECT {PAIR}, ord AS "Game_Session_Order", {_TOTAL_COLUMNS} FROM pt)"""

FEATURE_TABLE = ",".join([
    _TYPE_TIME, _LAGS, _TILL.replace("{over}", LEX)[len(ASSESS) + 1:], _DAYS[len(GAME) + 1:],
    _TOTALS[len(SLICE) + 1:], _CHAIN_SQL,
])
_JOINED = f"""FROM times JOIN levels USING ({PAIR}) JOIN dummies USING ({PAIR}) JOIN totals USING ({PAIR})
JOIN tchain USING ({PAIR}) JOIN chain USING ({PAIR})"""


@query("f_create_features", with_(FEATURE_TABLE, f"SELECT * EXCLUDE (title, ag) {_JOINED}"))
def f_create_features(t):
    return near(assemble.create_features(t.log, ALL_TITLES, assemble.BASIC, t.hot))


@query("join_inner_n", with_(FEATURE_TABLE, f"SELECT * EXCLUDE (title, ag) {_JOINED}"))
def join_inner_n(t):
    """The feature table as a literal join of nine separate feature frames."""
    sessions = t.written_sessions
    assessments = s.only_assessments(sessions)
    slice_ = t.along(sessions, s.end_slice)

    def along(*features, statistics=None):
        return t.along(slice_, lambda part, h: f.on_assessments(part, h, features, statistics))

    def begun(feature):
        return t.along(assessments, lambda part, h: f.compute(part, h, [feature]))

    return near(assemble.join_all([
        along(f.type_counts()),
        along(f.type_time(), statistics=f.total_time_statistics()),
        f.calendar_dummies(s.calendar_rows(s.only_assessments(t.log)), assemble.short_titles(ALL_TITLES)),
        t.ends(f.past_totals),
        begun(f.past_time_events()),
        t.along(assessments, f.time_to_attempt),
        along(f.world_time()),
        along(f.level_reached()),
        begun(f.previous_accuracy("basic")),
    ]))


_FAILS = """
totals AS (SELECT installation_id, game_session, ord AS "Game_Session_Order", CAST(p_fails AS INTEGER) AS "Past_Total_Fails", """
_HISTORY_CHAIN = f"""
chain AS (SELECT {PAIR}, title, ag, {_statistics(['ag', 'att', 'succ'])}, {_TIMES}, {_GROUPS},
                 ctr AS "Assessments_played_Counter" FROM past {_R})"""
_PLAIN_CHAIN = f"""
chain AS (SELECT {PAIR}, title, ag, {_statistics(['ag', 'att', 'succ'])}, {_TIMES} FROM past {_R})"""
_PLAIN_TOTALS = f"""
totals AS (SELECT {PAIR}, ord AS "Game_Session_Order", {_TOTAL_COLUMNS} FROM pt)"""
_STACKED = FEATURE_TABLE.replace(_PLAIN_CHAIN, _HISTORY_CHAIN).replace(
    _PLAIN_TOTALS, f"{_FAILS}{_TOTAL_COLUMNS} FROM pt)")


@query("f_create_features_stacked", with_(_STACKED, f"SELECT * EXCLUDE (title, ag) {_JOINED}"))
def f_create_features_stacked(t):
    return near(assemble.create_features(t.log, ALL_TITLES, assemble.STACKED, t.hot))


_FULL_DUMMIES = f"""
full_dummies AS (SELECT {PAIR}, {_dummies(_SHORT, 'title', '_title')}, {_dummies(_ALL_WORLDS, 'world', '_world')},
       {_dummies(range(24), 'hour', '_hour')}, {_dummies(range(7), 'dayofweek', '_dayofweek')}
  FROM (SELECT DISTINCT {PAIR}, title, world, hour, dayofweek FROM days))"""


@query("f_create_features_trimmed", with_(_STACKED + "," + _FULL_DUMMIES, f"""
SELECT * EXCLUDE (title, ag, "Game_Session_Order", "cumAverageTime", "cumAverageEvents", "cumsdTime", "cumsdEvents",
  "Std_Time_spent_on_games"), ag AS accuracy_group {_JOINED.replace('dummies', 'full_dummies')}"""))
def f_create_features_trimmed(t):
    return near(assemble.create_features(t.log, ALL_TITLES, assemble.TRIMMED, t.hot))


_RICH = FEATURE_TABLE.replace(_PLAIN_CHAIN, f"""
chain AS (SELECT {PAIR}, title, {_statistics(['ag', 'att', 'succ', 'fails', 'accuracy'])}, {_TIMES}, {_GROUPS},
  round(coalesce(lag(dur, 1, 0.0) OVER ({BEGUN}), 0), 6) AS mean_duration FROM past {_R})""").replace(
    _PLAIN_TOTALS, f"""
totals AS (SELECT {PAIR}, CAST(p_fails AS INTEGER) AS "Past_Total_Fails", {_TOTAL_COLUMNS},
       round(CASE WHEN p_att = 0 THEN 0.0 ELSE CAST(p_succ AS DOUBLE) / p_att END, 6) AS "Past_Total_Accuracy" FROM pt)"""
) + "," + _OVERALL


@query("f_create_features_rich", with_(_RICH, f"""
SELECT * EXCLUDE (title, year, "Assessments_played", mt, ma, ms), mt AS "OverallMean_Game_Session_Time",
       round(ma, 6) AS "OverallMean_Attempt", round(ms, 6) AS "OverallMean_IsAttemptSuccessful",
       round(ms / ma, 6) AS "OverallMean_accuracy"
FROM (SELECT DISTINCT ON ({PAIR}, month, hour, dayofweek) * {_JOINED}) JOIN measures USING (title)"""))
def f_create_features_rich(t):
    return near(assemble.create_features(t.log, ALL_TITLES, assemble.RICH, t.hot))


# ---- hold-outs --------------------------------------------------------------------------------

_LAST = f"count(*) OVER (PARTITION BY installation_id)"


@query("sel_last", with_(ASSESS, f"SELECT {PAIR} FROM assess QUALIFY ctr = {_LAST}"))
def sel_last(t):
    return holdout.last_assessment(t.assessments).select(*KEYS)


@query("sel_second_last", with_(
    ASSESS, f"SELECT {PAIR}, ag AS accuracy_group FROM assess QUALIFY ctr = {_LAST} - 1"))
def sel_second_last(t):
    return t.along(t.assessments, holdout.second_last_assessment)


@query("sel_not_second_last", with_(
    ASSESS, f"SELECT {PAIR}, ag AS accuracy_group FROM assess QUALIFY ctr <> {_LAST} - 1"))
def sel_not_second_last(t):
    return t.along(t.assessments, holdout.all_but_second_last)


@query("split_last", with_(SLICE, f"""
, played AS (SELECT {PAIR}, row_number() OVER (PARTITION BY installation_id ORDER BY ord) AS n FROM sl
             WHERE type = 'Assessment'),
marked AS (SELECT *, n = max(n) OVER (PARTITION BY installation_id) AS last FROM played)
SELECT {PAIR}, n AS "Assessments_played",
       CASE WHEN game_session IN (SELECT game_session FROM marked WHERE last) THEN 'predict' ELSE 'score' END AS part
FROM marked"""))
def split_last(t):
    played = t.slice(lambda part, h: f.on_assessments(part, h, [f.type_counts()]))
    predict, score = holdout.split_last(played.select(*KEYS, "Assessments_played"))
    return predict.withColumn("part", F.lit("predict")).unionByName(score.withColumn("part", F.lit("score")))
