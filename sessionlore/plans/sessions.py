"""From events to one row per session.

The log is read once into a map-side combined aggregate, so what is shuffled is about one row per
session and task and not the log; a session of any size costs its tasks no more than that.
Histories are then computed on the session rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.functions.catalogue import ASSESSMENT, KEYS, PLAYER, SESSION
from sessionlore.functions.scalars import accuracy_group, is_attempt, is_success, json_value
from sessionlore.operators.history import PREVIOUS, Before, History, Latest, Position, Total

END_ORDER = ["end_at", SESSION]
START_ORDER = ["started", SESSION]
ENDS_ORDER = ["timestamp", SESSION, "Cumulative_Attempts", "Cumulative_Successes"]


def flag_attempts(log: DataFrame, parse: bool = False) -> DataFrame:
    """Adds ``Attempt`` and ``IsAttemptSuccessful``, both 0 or 1."""
    return log.withColumn("Attempt", F.coalesce(is_attempt(), F.lit(False)).cast("int")).withColumn(
        "IsAttemptSuccessful",
        F.when((F.col("Attempt") == 1) & is_success(parse=parse), 1).otherwise(0),
    )


def _measures() -> dict[str, Column]:
    """Session measures of a flagged log."""
    micros = F.unix_micros("timestamp")
    tried = F.col("Attempt") == 1
    assessed = F.col("type") == ASSESSMENT
    duration = F.when(assessed, json_value("event_data", "duration", "double"))
    return {
        "started": F.min("timestamp"),
        "Total_Game_Session_Time": F.max("game_time"),
        "Total_Game_Session_Events": F.max("event_count"),
        "events": F.count(F.lit(1)),
        "Attempts": F.sum("Attempt"),
        "Success": F.sum("IsAttemptSuccessful"),
        "Num_Of_Events_Till_Attempt": F.max(F.when(tried, F.col("event_count")).otherwise(0)),
        "Time_past_Till_Attempt": F.max(F.when(tried, F.col("game_time")).otherwise(0)),
        "duration_sum": F.sum(duration),
        "duration_rows": F.count(duration),
        # The row of the largest counter, then the largest time, then the earliest clock.
        "end": F.max(F.struct(
            F.col("event_count").alias("count"), F.col("game_time").alias("time"),
            (-micros).alias("at"), "type", "title", "world",
        )),
        "end_latest": F.max(F.struct(
            F.col("event_count").alias("count"), F.col("game_time").alias("time"), micros.alias("at"),
        )),
    }


DESCRIBED = ["type", "title", "world"]


def _finish(sessions: DataFrame) -> DataFrame:
    at = F.timestamp_micros(-F.col("end.at"))
    if "duration_rows" in sessions.columns:
        mean = F.try_divide(F.col("duration_sum"), F.col("duration_rows"))
        sessions = sessions.withColumn("mean_duration", mean).drop("duration_sum", "duration_rows")
    return sessions.withColumns({
        "type": F.col("end.type"), "title": F.col("end.title"), "world": F.col("end.world"),
        # A session without a row at both maxima has no end row.
        "has_end": F.col("end.time") == F.col("Total_Game_Session_Time"),
        "end_at": at,
        "tied_end": F.col("end_latest.at") != -F.col("end.at"),
        "accuracy_group": accuracy_group(F.col("Attempts"), F.col("Success")),
    }).drop("end", "end_latest")


def session_rows(flagged: DataFrame, durations: bool = True) -> DataFrame:
    """One row per (player, session) with its totals, start, end row and outcome.

    Without ``durations`` the JSON of the log is not parsed.
    """
    measures = {n: c for n, c in _measures().items() if durations or not n.startswith("duration")}
    return _finish(flagged.groupBy(*KEYS).agg(*[c.alias(n) for n, c in measures.items()]))


def calendar_rows(log: DataFrame) -> DataFrame:
    """Distinct calendar values of each session."""
    t = F.col("timestamp")
    return log.select(
        *KEYS, *DESCRIBED, F.month(t).alias("month"), F.hour(t).alias("hour"), F.year(t).alias("year"),
        F.weekday(t).alias("dayofweek"),
    ).distinct()


def assessment_rows(flagged: DataFrame) -> DataFrame:
    """``session_rows`` of assessments only, filtered before the aggregate."""
    return session_rows(flagged.where(F.col("type") == ASSESSMENT))


def only_assessments(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("type") == ASSESSMENT)


def end_slice(sessions: DataFrame, history: History) -> DataFrame:
    """Sessions that have an end row, numbered in the order of those rows."""
    return history.over(
        sessions.where("has_end"), [PLAYER], END_ORDER,
        {"Game_Session_Order": Position(), "Cumulative_Time_Spent": Total(F.col("Total_Game_Session_Time"))},
    )


def assessment_counter(sessions: DataFrame, history: History) -> DataFrame:
    """Adds ``Assessments_played_Counter``: number of assessments begun so far; null elsewhere."""
    assessed = F.col("type") == ASSESSMENT
    counted = history.over(
        sessions, [PLAYER], START_ORDER, {"_begun": Total(F.when(assessed, 1).otherwise(0))}
    )
    return counted.withColumn(
        "Assessments_played_Counter", F.when(assessed, F.col("_begun"))
    ).drop("_begun")


def _end_markers(sessions: DataFrame, flagged: DataFrame, tied: bool) -> DataFrame:
    """End rows by clock. A tied session brings each of its end rows from the log."""
    kept = [*KEYS, "type", "title", "Assessments_played_Counter",
            F.col("Total_Game_Session_Events").alias("event_count")]
    ends = sessions.where("has_end")
    if not tied:
        return ends.select(*kept, F.col("end_at").alias("timestamp"))
    single = ends.where(~F.col("tied_end")).select(*kept, F.col("end_at").alias("timestamp"))
    several = ends.where("tied_end").select(
        *kept, F.col("Total_Game_Session_Time").alias("game_time")
    )
    times = flagged.select(*KEYS, "event_count", "game_time", "timestamp")
    many = several.join(times, [*KEYS, "event_count", "game_time"]).drop("game_time").distinct()
    return single.unionByName(many)


def end_totals(flagged: DataFrame, sessions: DataFrame, history: History,
               tied: bool | None = None) -> DataFrame:
    """Attempts and successes of the player up to each end row, other open sessions included.

    Only attempt rows and end rows take part in the running sum, so interleaved sessions are
    counted exactly without ordering the whole log. ``sessions`` carries the assessment counter.
    """
    if tied is None:
        tied = not sessions.where("has_end AND tied_end").isEmpty()
    markers = _end_markers(sessions, flagged, tied).withColumns(
        {"is_end": F.lit(1), "Attempt": F.lit(0), "IsAttemptSuccessful": F.lit(0)}
    )
    attempts = flagged.where("Attempt = 1").select(
        *KEYS, "timestamp", "event_count", "Attempt", "IsAttemptSuccessful", F.lit(0).alias("is_end")
    )
    both = markers.unionByName(attempts, allowMissingColumns=True)
    summed = history.over(
        both, [PLAYER], ["timestamp", SESSION, "event_count", "is_end"],
        {"Cumulative_Attempts": Total(F.col("Attempt")),
         "Cumulative_Successes": Total(F.col("IsAttemptSuccessful"))},
    )
    ends = summed.where("is_end = 1").drop("is_end", "Attempt", "IsAttemptSuccessful", "event_count")
    if tied:
        # Tied end rows that agree in everything but the clock are one row, at its first clock.
        names = [c for c in ends.columns if c != "timestamp"]
        ends = ends.groupBy(*names).agg(F.min("timestamp").alias("timestamp"))
    return ends.withColumn(
        "Cumulative_Fails", F.col("Cumulative_Attempts") - F.col("Cumulative_Successes")
    )


def numbered_ends(ends: DataFrame, history: History) -> DataFrame:
    return history.over(ends, [PLAYER], ENDS_ORDER, {"Game_Session_Order": Position()})


def event_totals(flagged: DataFrame, history: History) -> DataFrame:
    """Running attempts, successes and fails on every event row."""
    return history.over(
        flagged, [PLAYER], ["timestamp", SESSION, "event_count"],
        {"Cumulative_Attempts": Total(F.col("Attempt")),
         "Cumulative_Successes": Total(F.col("IsAttemptSuccessful"))},
    ).withColumn("Cumulative_Fails", F.col("Cumulative_Attempts") - F.col("Cumulative_Successes"))


def past_of_all_types(ends: DataFrame, history: History) -> DataFrame:
    """Past totals with the lag taken before any filter on the type."""
    counter = F.col("Assessments_played_Counter")
    lagged = history.over(
        numbered_ends(ends, history), [PLAYER], ENDS_ORDER,
        {"Past_Total_Attempts": Before(F.col("Cumulative_Attempts")),
         "Past_Total_Successes": Before(F.col("Cumulative_Successes")),
         "_played": Latest(counter, PREVIOUS)},
    )
    return lagged.withColumn(
        "Past_Assessments_Played",
        F.when(F.col("type") == ASSESSMENT, F.coalesce(F.col("_played"), F.lit(0))),
    ).drop("_played")
