"""History features of assessed sessions.

Most features are declared as a ``Feature``: values lagged or accumulated along an order, values
derived from them, then statistics of those along the same order. Features of one frame and order
are computed together, so that they share their exchange and sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.functions.catalogue import (
    ASSESSMENT, KEYS, PLAYER, SESSION, TIMED_WORLDS, WORLDS,
)
from sessionlore.functions.scalars import round_int, row_sum, safe_divide, strip_right, title_level
from sessionlore.operators.history import (
    PREVIOUS, Before, Blocks, History, Mean, Peak, Position, Running, Spread, Total,
)
from sessionlore.operators.tables import join_counted
from sessionlore.plans.sessions import END_ORDER, ENDS_ORDER, START_ORDER, numbered_ends, only_assessments

INSTALLATION, GLOBAL = "installation", "global"


@dataclass
class Feature:
    order: list[str]
    first: dict[str, Running] = field(default_factory=dict)
    derived: dict[str, Column] = field(default_factory=dict)
    second: dict[str, Running] = field(default_factory=dict)
    out: list[str] = field(default_factory=list)


def compute(frame: DataFrame, history: History, features: Sequence[Feature],
            keep: Sequence[str] = KEYS) -> DataFrame:
    """``keep`` and the outputs of ``features``, which all follow one order."""
    first, derived, second, out = {}, {}, {}, []
    for feature in features:
        first |= feature.first
        derived |= feature.derived
        second |= feature.second
        out += [name for name in feature.out if name not in out]
    order = features[0].order
    df = history.over(frame, [PLAYER], order, first)
    df = df.withColumns(derived) if derived else df
    df = history.over(df, [PLAYER], order, second)
    return df.select(*keep, *[name for name in out if name not in keep])


# ---- assessments in the order they were begun -------------------------------------------------

_OUTCOMES = {"ag": "accuracy_group", "att": "Attempts", "succ": "Success"}
_GROUP_NAMES = ["zeros", "ones", "twos", "threes"]


def previous_accuracy(variant: str = "basic") -> Feature:
    """Outcome of the assessment before, and running mean and deviation of those outcomes.

    ``history`` adds how often each accuracy group was the last outcome, ``full`` also the fails
    and the ratio. The 0 before the first assessment counts in the statistics.
    """
    names = dict(_OUTCOMES)
    first = {f"Past_Assessment_{s}": Before(F.col(c)) for s, c in names.items()}
    derived = {}
    suffixes = list(names)
    if variant == "full":
        first["Past_Assessment_fails"] = Before(F.col("Attempts") - F.col("Success"))
        derived["Past_Assessment_accuracy"] = safe_divide(
            F.col("Past_Assessment_succ"), F.col("Past_Assessment_att")
        )
        suffixes += ["fails", "accuracy"]
    second = {f"cummean_{s}": Mean(F.col(f"Past_Assessment_{s}")) for s in suffixes}
    second |= {f"cumstd_{s}": Spread(F.col(f"Past_Assessment_{s}")) for s in suffixes}
    out = [f"Past_Assessment_{s}" for s in suffixes] + list(second)
    feature = Feature(START_ORDER, first, derived, second, out)
    if variant in ("history", "full"):
        counts = group_history()
        feature.second |= counts.second
        feature.out += _GROUP_NAMES
    return feature


def group_history() -> Feature:
    second = {
        name: Total(F.when(F.col("Past_Assessment_ag") == group, 1).otherwise(0))
        for group, name in enumerate(_GROUP_NAMES)
    }
    return Feature(
        START_ORDER, {"Past_Assessment_ag": Before(F.col("accuracy_group"))}, {}, second, list(second)
    )


def assessments_played() -> Feature:
    return Feature(
        START_ORDER, {"Assessments_played_Counter": Position()}, out=["Assessments_played_Counter"]
    )


def past_time_events(statistics: bool = True) -> Feature:
    time, events = "Past_Assessment_Session_Time", "Past_Assessment_NumberOfEvents"
    first = {
        time: Before(F.col("Total_Game_Session_Time")), events: Before(F.col("Total_Game_Session_Events"))
    }
    second = {
        "cumAverageTime": Mean(F.col(time)), "cumAverageEvents": Mean(F.col(events)),
        "cumsdTime": Spread(F.col(time)), "cumsdEvents": Spread(F.col(events)),
    } if statistics else {}
    return Feature(START_ORDER, first, {}, second, [time, events, *second])


def shift_all(df: DataFrame, order: Sequence[str], values: dict[str, Running]) -> DataFrame:
    """Values along the order of the whole table, players following each other."""
    return Blocks().over(df, [], list(order), values)


_TILL = {
    "Time_past_Till_Attempt": "Assessment_Time_past_Till_Attempt",
    "Num_Of_Events_Till_Attempt": "Assessment_Num_Of_Events_Till_Attempt",
}


def till_lags() -> dict[str, Running]:
    return {f"Prev_{name}": Before(F.col(source)) for source, name in _TILL.items()}


def time_to_attempt(assessments: DataFrame, history: History, lagged: bool = False,
                    keep: Sequence[str] = KEYS) -> DataFrame:
    """Counter and time of the last attempt in the previous session **by session id**.

    ``lagged`` says that the rows already carry the lags, taken over the whole table.
    """
    if not lagged:
        assessments = history.over(assessments, [PLAYER], [SESSION], till_lags())
    second = {}
    for name in _TILL.values():
        second[f"cummean_{name}"] = Mean(F.col(f"Prev_{name}"))
        second[f"cumsd_{name}"] = Spread(F.col(f"Prev_{name}"))
    out = [f"Prev_{n}" for n in _TILL.values()] + list(second)
    return compute(assessments, history, [Feature([SESSION], second=second, out=out)], keep)


def duration_lag(lagged: bool = False) -> Feature:
    """Mean ``duration`` of the assessment before; 0 where there is none."""
    first = {} if lagged else {"_duration": Before(F.col("mean_duration"), 0.0)}
    return Feature(
        START_ORDER, first, {"mean_duration": F.coalesce("_duration", F.lit(0.0))}, {}, ["mean_duration"]
    )


def global_lags(assessments: DataFrame, durations: bool = True) -> DataFrame:
    """The lags that run on across players: the first row of a player takes the last of another."""
    till = shift_all(assessments, [PLAYER, SESSION], till_lags())
    return till if not durations else shift_all(
        till, [PLAYER, *START_ORDER], {"_duration": Before(F.col("mean_duration"), 0.0)}
    )


# ---- all sessions in the order of their ends --------------------------------------------------

_BY_NUMBER = ["Game_Session_Order"]


def _of_type(type_: str, value: Column) -> Column:
    return F.when(F.col("type") == type_, value).otherwise(0)


def type_counts(with_assessments: bool = True) -> Feature:
    names = {"Clips__played": "Clip", "Games_played": "Game", "Assessments_played": ASSESSMENT,
             "Activities_played": "Activity"}
    if not with_assessments:
        del names["Assessments_played"]
    first = {name: Total(_of_type(type_, F.lit(1))) for name, type_ in names.items()}
    derived = {"Total_Games_played": F.col("Game_Session_Order")}
    return Feature(END_ORDER, first, derived, {}, ["Total_Games_played", *first])


_TIMED = {"Activities": "Activity", "Games": "Game", "Assessments": ASSESSMENT}


def type_time() -> Feature:
    """Time spent per type, this session included; its average per type, this session excluded."""
    time = F.col("Total_Game_Session_Time")
    first = {f"Time_spent_on_{n}": Total(_of_type(t, time)) for n, t in _TIMED.items()}
    first |= {
        f"Average_Time_spent_on_{n}": Mean(F.when(F.col("type") == t, time), PREVIOUS)
        for n, t in _TIMED.items()
    }
    derived = {"Total_Time_spent": row_sum(*[f"Time_spent_on_{n}" for n in _TIMED])}
    return Feature(END_ORDER, first, derived, {}, ["Total_Time_spent", *first])


def total_time_statistics(with_std: bool = True) -> Feature:
    """Running statistics of ``Total_Time_spent`` over the assessments alone.

    The mean has a name of its own: by type it would differ from the average on games in case only.
    """
    second = {"Average_Total_Time_spent": Mean(F.col("Total_Time_spent"))}
    if with_std:
        second["Std_Time_spent_on_games"] = Spread(F.col("Total_Time_spent"))
    return Feature(END_ORDER, second=second, out=list(second))


def world_time() -> Feature:
    first = {
        f"Time_spent_in_{w}": Total(F.when(F.col("world") == w, F.col("Total_Game_Session_Time")).otherwise(0))
        for w in TIMED_WORLDS
    }
    return Feature(END_ORDER, first, out=list(first))


def level_reached() -> Feature:
    first = {
        f"Level_reached_in_{w}": Peak(F.when(F.col("world") == w, title_level(F.col("title"))).otherwise(0))
        for w in TIMED_WORLDS
    }
    derived = {"Total_Level": sum((F.col(n) for n in first), F.lit(0))}
    return Feature(END_ORDER, first, derived, {}, [*first, "Total_Level"])


def title_visits(titles: Sequence[str]) -> Feature:
    first = {f"visits_{t}": Total(F.when(F.col("title") == t, 1).otherwise(0)) for t in titles}
    return Feature(END_ORDER, first, out=list(first))


_PER_TITLE = {"timespent": "Total_Game_Session_Time", "events": "Total_Game_Session_Events"}


def _title_values(what: str, titles: Sequence[str]) -> dict[str, Column]:
    source = F.col(_PER_TITLE[what])
    return {f"cumulative_{what}_{t}": F.when(F.col("title") == t, source).otherwise(0) for t in titles}


def title_totals(slice_: DataFrame, history: History, what: str, titles: Sequence[str]) -> DataFrame:
    """Running time or events per title up to the player's session before."""
    values = _title_values(what, titles)
    lagged = history.over(slice_, [PLAYER], END_ORDER, {n: Total(v, PREVIOUS) for n, v in values.items()})
    return only_assessments(lagged).select(*KEYS, *[F.col(f"`{n}`") for n in values])


def title_running(slice_: DataFrame, history: History, what: str, titles: Sequence[str]) -> DataFrame:
    """The running totals that ``title_shift`` moves on, this session included."""
    values = _title_values(what, titles)
    running = history.over(slice_, [PLAYER], END_ORDER, {n: Total(v) for n, v in values.items()})
    return running.select(*KEYS, "type", *_BY_NUMBER, *[F.col(f"`{n}`") for n in values])


def title_shift(running: DataFrame, what: str, titles: Sequence[str]) -> DataFrame:
    """``title_totals`` with the shift over the whole table, players following each other."""
    names = list(_title_values(what, titles))
    lagged = shift_all(running, [PLAYER, *_BY_NUMBER], {n: Before(F.col(f"`{n}`")) for n in names})
    return only_assessments(lagged).select(*KEYS, *[F.col(f"`{n}`") for n in names])


def on_assessments(slice_: DataFrame, history: History, features: Sequence[Feature],
                   statistics: Feature | None = None) -> DataFrame:
    """Features along all sessions, then ``statistics`` along the assessments, for those."""
    carried = [*KEYS, "type", "end_at"]
    rows = only_assessments(compute(slice_, history, features, carried))
    names = [c for c in rows.columns if c not in carried]
    if statistics is None:
        return rows.select(*KEYS, *[F.col(f"`{n}`") for n in names])
    return compute(rows, history, [statistics], [*KEYS, *names])


# ---- totals up to the end rows ----------------------------------------------------------------

def past_totals(ends: DataFrame, history: History, variant: str = "basic",
                keep: Sequence[str] = ()) -> DataFrame:
    """Attempts, successes and assessments of the player before, as of the last assessment's end.

    ``fails`` adds the fails, ``accuracy`` also the ratio.
    """
    rows = only_assessments(numbered_ends(ends, history))
    lags = {"Past_Total_Attempts": "Cumulative_Attempts", "Past_Total_Successes": "Cumulative_Successes",
            "Past_Assessments_Played": "Assessments_played_Counter"}
    if variant != "basic":
        lags["Past_Total_Fails"] = "Cumulative_Fails"
    lagged = history.over(rows, [PLAYER], ENDS_ORDER, {n: Before(F.col(c)) for n, c in lags.items()})
    lagged = lagged.withColumns({n: round_int(F.col(n)) for n in lags})
    out = [*KEYS, *keep, "Game_Session_Order", *lags]
    if variant == "accuracy":
        lagged = lagged.withColumn(
            "Past_Total_Accuracy", safe_divide(F.col("Past_Total_Successes"), F.col("Past_Total_Attempts"))
        )
        out.remove("Game_Session_Order")
        out.append("Past_Total_Accuracy")
    return lagged.select(*out)


def title_of_past_totals(ends: DataFrame, history: History, what: str, titles: Sequence[str]) -> DataFrame:
    """``Past_Total_Attempts`` or ``..._Successes`` in the column of the session's title.

    The value is spread over the title columns and is not summed again.
    """
    source = {"attempts": "Past_Total_Attempts", "successes": "Past_Total_Successes"}[what]
    titled = past_totals(ends, history, keep=["title"])
    return titled.select(*KEYS, *[
        F.when(F.col("title") == t, F.col(source)).otherwise(0).cast("double").alias(f"cumulative_{what}_{t}")
        for t in titles
    ])


# ---- calendar and titles ----------------------------------------------------------------------

def one_hot(values: Sequence, column: str, suffix: str = "") -> dict[str, Column]:
    return {f"{v}{suffix}": F.when(F.col(column) == v, 1).otherwise(0) for v in values}


def calendar_dummies(calendar: DataFrame, short_titles: Sequence[str], with_year: bool = True,
                     worlds: Sequence[str] = WORLDS) -> DataFrame:
    """Calendar values at the smallest hour of each assessment, with world and title as 0/1 columns.

    More than one row stays where a session has several calendar values at that hour.
    """
    # A session has a bounded number of distinct calendar values, so its window is small.
    session = Window.partitionBy(*KEYS)
    parts = ["month", "hour", *(["year"] if with_year else []), "dayofweek"]
    rows = only_assessments(calendar).withColumn("title", strip_right(F.col("title")))
    rows = rows.select(*KEYS, "title", "world", *parts).distinct()
    rows = rows.withColumn("_first", F.min("hour").over(session)).where(F.col("hour") == F.col("_first"))
    columns = {**one_hot(worlds, "world"), **one_hot(short_titles, "title")}
    return rows.select(*KEYS, *parts, *[c.alias(n) for n, c in columns.items()])


def calendar_dummies_full(calendar: DataFrame, short_titles: Sequence[str],
                          worlds: Sequence[str] = WORLDS, dedupe: str | None = None) -> DataFrame:
    """Title, world, hour and day as 0/1 columns; one row per distinct hour and day of a session.

    Joining it multiplies the session's other rows. ``dedupe='first'`` keeps the first hour only.
    """
    rows = only_assessments(calendar).withColumn("title", strip_right(F.col("title")))
    rows = rows.select(*KEYS, "title", "world", "hour", "dayofweek").distinct()
    if dedupe == "first":
        rows = rows.groupBy(*KEYS).agg(F.min(F.struct("hour", "dayofweek", "title", "world")).alias("f"))
        rows = rows.select(*KEYS, "f.*")
    columns = {
        **one_hot(short_titles, "title", "_title"), **one_hot(worlds, "world", "_world"),
        **one_hot(range(24), "hour", "_hour"), **one_hot(range(7), "dayofweek", "_dayofweek"),
    }
    return rows.select(*KEYS, *[c.alias(n) for n, c in columns.items()])


def event_code_history(log: DataFrame, history: History, codes: Sequence[int]) -> DataFrame:
    """Per assessment, in how many of the sessions so far each code occurred."""
    seen = {f"event_code_{c}": F.max(F.when(F.col("event_code") == c, 1).otherwise(0)) for c in codes}
    sessions = log.groupBy(*KEYS, "type").agg(
        F.min("timestamp").alias("started"), *[c.alias(n) for n, c in seen.items()]
    )
    running = history.over(sessions, [PLAYER], START_ORDER, {n: Total(F.col(n)) for n in seen})
    return only_assessments(running).select(*KEYS, *seen)


_MEASURED = {
    "OverallMean_Game_Session_Time": "Total_Game_Session_Time",
    "OverallMean_Attempt": "Attempt",
    "OverallMean_IsAttemptSuccessful": "IsAttemptSuccessful",
}


def overall_by_title(assessments: DataFrame) -> DataFrame:
    """Means per title over the distinct (session time, attempt, success) values of its events."""
    tried, won = F.col("Attempts"), F.col("Success")
    flags = F.filter(F.array(
        F.when(F.col("events") > tried, F.struct(F.lit(0).alias("a"), F.lit(0).alias("s"))),
        F.when(tried > won, F.struct(F.lit(1).alias("a"), F.lit(0).alias("s"))),
        F.when(won > 0, F.struct(F.lit(1).alias("a"), F.lit(1).alias("s"))),
    ), lambda f: f.isNotNull())
    rows = assessments.select("title", "Total_Game_Session_Time", F.explode(flags).alias("f")).select(
        "title", "Total_Game_Session_Time",
        F.col("f.a").alias("Attempt"), F.col("f.s").alias("IsAttemptSuccessful"),
    ).distinct()
    means = rows.groupBy("title").agg(*[F.avg(c).alias(n) for n, c in _MEASURED.items()])
    return means.withColumn(
        "OverallMean_accuracy",
        F.try_divide(F.col("OverallMean_IsAttemptSuccessful"), F.col("OverallMean_Attempt")),
    )


def overall_title(assessments: DataFrame) -> DataFrame:
    """The measures of each assessment's title."""
    return join_counted(assessments.select(*KEYS, "title"), overall_by_title(assessments), "title").drop("title")


