import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sessionlore.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EVENT = ("installation_id string, game_session string, timestamp string, event_count int, game_time long, "
         "event_code int, title string, type string, world string, event_data string")


@pytest.fixture(scope="session")
def log(spark):
    """Builds a log from short rows: (player, session, time, count, game_time, code, ...)."""
    from pyspark.sql import functions as F

    def build(rows):
        full = []
        for r in rows:
            r = {"title": "Cart Puzzle (Assessment)", "type": "Assessment", "world": "NONE",
                 "event_data": '{"correct":false}', "code": 2000, "player": "p", **r}
            full.append((r["player"], r["session"], r["at"], r["count"], r["time"], r["code"], r["title"],
                         r["type"], r["world"], r["event_data"]))
        return spark.createDataFrame(full, EVENT).withColumn("timestamp", F.to_timestamp("timestamp"))

    return build
