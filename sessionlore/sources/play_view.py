"""A generic event table (user, time, kind, value, props) seen as a play log.

Five successive events of a user make a session; the session number decides type, title and
world. The values below are fixed by the description of the test inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.functions.scalars import json_value
from sessionlore.operators.history import HotKeys, Position, by_history

EVENTS_PER_SESSION = 5
LONG_BREAK_MS = 100_000_000_000
EVENT_CODES = {"purchase": 4100, "error": 4110, "signup": 2000, "click": 4070}
OTHER_CODE = 3010
ALL_CODES = [2000, 3010, 4070, 4100, 4110]
SESSION_TYPES = ["Assessment", "Game", "Activity", "Clip"]
SESSION_WORLDS = ["NONE", "MAGMAPEAK", "TREETOPCITY", "CRYSTALCAVES"]
ASSESSMENT_TITLES = [
    "Bird Measurer (Assessment)", "Cart Puzzle (Assessment)", "Jar Filler (Assessment)",
    "Nest (Assessment)", "Box Sorter (Assessment)",
]
GAME_TITLES = ["Cave Game 0", "Cave Game 1", "Cave Game 2"]
ACTIVITY_TITLES = ["Pond Activity 0", "Pond Activity 1"]
CLIP_TITLES = ["Climb Level 1", "Climb Level 2", "Climb Level 3"]
ALL_TITLES = [*ASSESSMENT_TITLES, *GAME_TITLES, *ACTIVITY_TITLES, *CLIP_TITLES]
SHORT_TITLES = ["Bird Measurer", "Box Sorter", "Cart Puzzl", "Jar Filler", "N"]


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def play_view(events: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    order = ["ts", "event_id"]
    numbered = by_history(
        events, "user_id",
        lambda part, history: history.over(part, ["user_id"], order, {"n": Position()}), hot,
    )
    # At most five rows per (user, chunk), whatever the user.
    chunk = Window.partitionBy("user_id", "chunk")
    number = F.col("n").cast("long") - 1
    chunked = numbered.withColumns({
        "chunk": F.floor(number / EVENTS_PER_SESSION),
        "event_count": (number % EVENTS_PER_SESSION + 1).cast("int"),
    }).withColumns({"sid": F.min("event_id").over(chunk), "t0": F.min("ts").over(chunk)})
    sid, k = F.col("sid"), json_value("props", "k", "int")
    slot = F.floor(sid / 4)
    code = F.lit(OTHER_CODE)
    for kind, value in EVENT_CODES.items():
        code = F.when(F.col("event_type") == kind, value).otherwise(code)
    elapsed = F.floor((F.unix_micros("ts") - F.unix_micros("t0")) / 1000)
    paused = (sid % 11 == 0) & (F.col("event_count") == 2)
    title = (
        F.when(sid % 4 == 0, _pick(ASSESSMENT_TITLES, slot % 5))
        .when(sid % 4 == 1, _pick(GAME_TITLES, slot % 3))
        .when(sid % 4 == 2, _pick(ACTIVITY_TITLES, slot % 2))
        .otherwise(_pick(CLIP_TITLES, slot % 3))
    )
    return chunked.select(
        F.col("user_id").alias("installation_id"),
        sid.alias("game_session"),
        F.col("ts").alias("timestamp"),
        "event_count",
        (elapsed + F.when(paused, LONG_BREAK_MS).otherwise(0)).alias("game_time"),
        code.alias("event_code"),
        _pick(SESSION_TYPES, sid % 4).alias("type"),
        title.alias("title"),
        _pick(SESSION_WORLDS, F.floor(sid / 20) % 4).alias("world"),
        F.concat(
            F.when(F.col("value") >= 40, '{"correct":true').otherwise('{"correct":false'),
            F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(',"duration":'), k * 100)),
            F.lit("}"),
        ).alias("event_data"),
    )
