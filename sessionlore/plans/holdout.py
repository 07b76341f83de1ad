"""Choice of the sessions to predict and of those to score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.functions.catalogue import KEYS, PLAYER, SESSION
from sessionlore.operators.history import History, Position
from sessionlore.operators.tables import attach_group, not_in_sessions
from sessionlore.plans.sessions import START_ORDER


def last_assessment(assessments: DataFrame) -> DataFrame:
    """Last begun assessment per player, as an aggregate: no history is put together for it."""
    last = F.max_by(SESSION, F.struct(*START_ORDER))
    return assessments.groupBy(PLAYER).agg(last.alias(SESSION))


def from_last(assessments: DataFrame, history: History) -> DataFrame:
    """Adds ``order`` and ``LastGame``, the player's number of assessments."""
    numbered = history.over(assessments, [PLAYER], START_ORDER, {"order": Position()})
    return history.attach(numbered, [PLAYER], {"LastGame": F.max("order")})


def _chosen(rows: DataFrame, where: Column) -> DataFrame:
    return rows.where(where).select(*KEYS, "accuracy_group")


def second_last_assessment(assessments: DataFrame, history: History) -> DataFrame:
    """Second-last assessment per player with its outcome."""
    return _chosen(from_last(assessments, history), F.col("order") == F.col("LastGame") - 1)


def all_but_second_last(assessments: DataFrame, history: History) -> DataFrame:
    return _chosen(from_last(assessments, history), F.col("order") != F.col("LastGame") - 1)


def split_last(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to predict, rows to score): the former have the most assessments played."""
    marked = attach_group(features, [PLAYER], {"_most": F.max("Assessments_played")})
    predict = marked.where(F.col("Assessments_played") == F.col("_most")).drop("_most")
    return predict, not_in_sessions(features, predict)
