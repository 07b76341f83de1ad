"""Registry of queries and the tables they start from."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlore.functions.catalogue import PLAYER
from sessionlore.operators.history import by_history, hot_keys
from sessionlore.plans import sessions as s
from sessionlore.session import materialize, prepare, scratch_path
from sessionlore.sources.play_view import play_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(prepare(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


class Tables:
    """The tables of a folder, and the play log seen in its events."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self) -> str:
        return scratch_path(self.spark)

    @cached_property
    def hot(self):
        return hot_keys(self["events"], "user_id")

    @cached_property
    def log(self) -> DataFrame:
        return play_view(self["events"], self.hot)

    @cached_property
    def flagged(self) -> DataFrame:
        return s.flag_attempts(self.log)

    @cached_property
    def sessions(self) -> DataFrame:
        return s.session_rows(self.flagged)

    @cached_property
    def assessments(self) -> DataFrame:
        return s.assessment_rows(self.flagged)

    @cached_property
    def written_assessments(self) -> DataFrame:
        """For plans that use the assessments more than once: the log is read once for them."""
        return materialize(self.assessments)

    @cached_property
    def written_sessions(self) -> DataFrame:
        return materialize(self.sessions)

    @cached_property
    def labels(self) -> DataFrame:
        """Outcome per assessment, as a label table gives it."""
        return self.written_assessments.select("installation_id", "game_session", "accuracy_group")

    def along(self, tables, build) -> DataFrame:
        return by_history(tables, PLAYER, build, self.hot)

    def slice(self, build) -> DataFrame:
        return self.along(self.sessions, lambda part, h: build(s.end_slice(part, h), h))

    def ends(self, build) -> DataFrame:
        """``build(ends, history)`` over the end rows with their running totals."""
        sessions = self.written_sessions
        tied = not sessions.where("has_end AND tied_end").isEmpty()

        def run(part, flagged, h):
            return build(s.end_totals(flagged, s.assessment_counter(part, h), h, tied), h)

        return self.along([sessions, self.flagged], run)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Floating columns rounded for comparison, ``special`` ones to their own digits."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, special.get(f.name, digits)).alias(f.name)
        out.append(c)
    return df.select(*out)
