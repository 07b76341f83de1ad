"""The feature table: one job chain from the log to assessment rows with all features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.functions.catalogue import KEYS, PLAYER, WORLDS
from sessionlore.functions.scalars import strip_right
from sessionlore.operators.history import History, HotKeys, by_history, hot_keys
from sessionlore.plans import features as f
from sessionlore.plans import sessions as s
from sessionlore.session import materialize


@dataclass(frozen=True)
class Settings:
    """Which form of each feature the table takes."""

    previous_accuracy: str = "basic"
    past_totals: str = "basic"
    past_time_statistics: bool = True
    dummies: str = "min_hour"
    with_year: bool = True
    assessments_played: bool = True
    type_time_std: bool = True
    title_measures: bool = False
    mean_duration: bool = False
    label: str = "external"
    lag_scope: str = f.INSTALLATION


BASIC = Settings()
STACKED = Settings(previous_accuracy="history", past_totals="fails")
TRIMMED = Settings(
    previous_accuracy="history", past_totals="fails", past_time_statistics=False, dummies="full",
    type_time_std=False, label="internal",
)
RICH = Settings(
    previous_accuracy="full", past_totals="accuracy", with_year=False, assessments_played=False,
    title_measures=True, mean_duration=True,
)


def join_all(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS, how: str = "inner") -> DataFrame:
    return reduce(lambda left, right: left.join(right, list(keys), how), frames)


def short_titles(titles: Sequence[str]) -> list[str]:
    """Stripped titles of the assessments among ``titles``, sorted as the 0/1 columns are."""
    tail = " (Assessment)"
    return sorted({t.rstrip(tail) for t in titles if t.endswith(tail)})


def known_values(df: DataFrame, column: str, most: int | None = None) -> list:
    """The distinct values of a column that is to become columns; an error above ``most``, if given."""
    rows = df.select(column).distinct().collect()
    if most is not None and len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(r[0] for r in rows if r[0] is not None)


def assessment_features(settings: Settings) -> list[f.Feature]:
    chosen = [
        f.previous_accuracy(settings.previous_accuracy),
        f.past_time_events(settings.past_time_statistics),
    ]
    if settings.previous_accuracy == "history":
        chosen.append(f.assessments_played())
    if settings.mean_duration:
        chosen.append(f.duration_lag(settings.lag_scope == f.GLOBAL))
    return chosen


def session_features(settings: Settings) -> list[f.Feature]:
    return [f.type_counts(settings.assessments_played), f.type_time(), f.world_time(), f.level_reached()]


def create_features(log: DataFrame, titles: Sequence[str], settings: Settings = BASIC,
                    hot: HotKeys | None = None) -> DataFrame:
    """All features of each assessment, joined on (player, session).

    A session without end row drops out, several end rows or calendar rows multiply it. The log
    is read for the session measures, filtered to assessments for their calendar, and filtered to
    attempts for the totals up to the ends.
    """
    flagged = s.flag_attempts(log)
    sessions = materialize(s.session_rows(flagged, durations=settings.mean_duration))
    if hot is None:
        hot = hot_keys(sessions, PLAYER, weight=1 + F.col("Attempts"))
    tied = not sessions.where("has_end AND tied_end").isEmpty()
    overall = f.overall_by_title(s.only_assessments(sessions)) if settings.title_measures else None
    across = settings.lag_scope == f.GLOBAL
    tables = [sessions, s.calendar_rows(s.only_assessments(log)), flagged]
    if across:
        tables.append(f.global_lags(s.only_assessments(sessions), settings.mean_duration))

    def build(sessions: DataFrame, days: DataFrame, flagged: DataFrame, *rest) -> DataFrame:
        history: History = rest[-1]
        assessments = rest[0] if across else s.only_assessments(sessions)
        carried = [*KEYS, "title", "accuracy_group", "Num_Of_Events_Till_Attempt", "Time_past_Till_Attempt"]
        lags = list(f.till_lags()) if across else []
        chain = f.compute(assessments, history, assessment_features(settings), [*carried, *lags])
        kept = [c for c in chain.columns if c not in (*carried[4:], *lags)]
        chain = f.time_to_attempt(chain, history, across, kept)
        if settings.label != "internal":
            chain = chain.drop("accuracy_group")
        along = f.on_assessments(
            s.end_slice(sessions, history), history, session_features(settings),
            f.total_time_statistics(settings.type_time_std),
        )
        ends = s.end_totals(flagged, s.assessment_counter(sessions, history), history, tied)
        totals = f.past_totals(ends, history, settings.past_totals)
        if settings.label == "internal":
            totals = totals.drop("Game_Session_Order")
        short = short_titles(titles)
        dummies = (
            f.calendar_dummies_full(days, short) if settings.dummies == "full"
            else f.calendar_dummies(days, short, settings.with_year)
        )
        return join_all([along, dummies, totals, chain])

    table = by_history(tables, PLAYER, build, hot)
    if overall is not None:
        table = table.join(overall, "title")
    return table.drop("title")


def with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels.select(*KEYS, "accuracy_group"), KEYS)


def feature_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in (*KEYS, "accuracy_group")]


__all__ = ["BASIC", "STACKED", "TRIMMED", "RICH", "Settings", "WORLDS", "assessment_features",
           "create_features", "feature_columns", "join_all", "known_values", "session_features",
           "short_titles", "strip_right", "with_labels"]
