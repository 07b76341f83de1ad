"""Queries on aggregates, pivots, statistics and running values."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlore.catalog.base import query, rounded
from sessionlore.catalog.sql import ASSESS, EVENTS, GAME, SESS, SLICE, with_
from sessionlore.functions.catalogue import ASSESSMENT, KEYS, PLAYER, SESSION, TYPES, WORLDS
from sessionlore.functions.scalars import json_value, title_level
from sessionlore.operators import statistics as st
from sessionlore.operators import tables as tb
from sessionlore.operators.history import PREVIOUS, Before, Latest, Mean, Peak, Position, Spread, Total
from sessionlore.plans import features as f
from sessionlore.plans import holdout
from sessionlore.plans import sessions as s
from sessionlore.sources.play_view import ALL_CODES, ALL_TITLES

PAIR = "installation_id, game_session"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# ---- groups -----------------------------------------------------------------------------------


@query("agg_max", with_(GAME, f"""
SELECT {PAIR}, max(game_time) AS game_time, max(event_count) AS event_count FROM game GROUP BY {PAIR}"""))
def agg_max(t):
    return t.log.groupBy(*KEYS).agg(F.max("game_time").alias("game_time"), F.max("event_count").alias("event_count"))


@query("agg_mean_title", with_(GAME, "SELECT title, round(avg(event_count), 6) AS mean_count FROM game GROUP BY title"))
def agg_mean_title(t):
    return rounded(t.log.groupBy("title").agg(F.avg("event_count").alias("mean_count")))


@query("agg_tf_sum", with_(EVENTS, f"""
SELECT {PAIR}, event_count, CAST(sum(att) OVER (PARTITION BY {PAIR}) AS BIGINT) AS "Attempts" FROM ev"""))
def agg_tf_sum(t):
    rows = tb.attach_group(t.flagged, KEYS, {"Attempts": F.sum("Attempt")})
    return rows.select(*KEYS, "event_count", "Attempts")


@query("agg_tf_max", with_(EVENTS, f"""
SELECT {PAIR}, event_count, tot_time, CASE WHEN type = 'Assessment' THEN tot_events END AS assessment_events FROM ev"""))
def agg_tf_max(t):
    assessed = F.when(F.col("type") == ASSESSMENT, F.col("event_count"))
    rows = tb.attach_group(t.log, KEYS, {"tot_time": F.max("game_time"), "assessment_events": F.max(assessed)})
    return rows.select(*KEYS, "event_count", "tot_time", "assessment_events")


@query("agg_tf_min", with_(GAME, f"""
SELECT {PAIR}, event_count, CAST(min(hour(timestamp)) OVER (PARTITION BY {PAIR}) AS INTEGER) AS first_hour FROM game"""))
def agg_tf_min(t):
    rows = tb.attach_group(t.log, KEYS, {"first_hour": F.min(F.hour("timestamp"))})
    return rows.select(*KEYS, "event_count", "first_hour")


@query("agg_tf_mean", with_(GAME, f"""
SELECT {PAIR}, event_count, round(avg(CAST(json_extract_string(event_data, '$.duration') AS DOUBLE))
  OVER (PARTITION BY {PAIR}), 6) AS mean_duration FROM game"""))
def agg_tf_mean(t):
    rows = tb.attach_group(
        t.log, KEYS, {"mean_duration": F.avg(json_value("event_data", "duration", "double"))}
    )
    return rounded(rows.select(*KEYS, "event_count", "mean_duration"))


@query("distinct_rows", with_(GAME, f"SELECT DISTINCT {PAIR}, type, title, world FROM game"))
def distinct_rows(t):
    return t.log.select(*KEYS, "type", "title", "world").dropDuplicates()


@query("distinct_vals", with_(GAME, "SELECT DISTINCT title FROM game"))
def distinct_vals(t):
    return t.log.select("title").distinct()


def _pivot_sql(values, column, prefix, cell):
    return ", ".join(f"""{cell.replace('?', f"{column} = '{v}'")} AS "{prefix}{v}" """ for v in values)


@query("pv_count", with_(SLICE, f"""
SELECT installation_id, {_pivot_sql(TYPES, 'type', 'n_', 'count(CASE WHEN ? THEN 1 END)')}
FROM sl GROUP BY installation_id"""))
def pv_count(t):
    ends = t.sessions.where("has_end")
    return tb.pivot(ends, [PLAYER], "type", {v: f"n_{v}" for v in TYPES}, F.count(F.lit(1)))


@query("pv_mean", with_(SLICE, f"""
SELECT installation_id, {_pivot_sql(ALL_TITLES, 'title', 'events_',
    'round(coalesce(avg(CASE WHEN ? THEN tot_events END), 0), 6)')} FROM sl GROUP BY installation_id"""))
def pv_mean(t):
    ends = t.sessions.where("has_end")
    names = {v: f"events_{v}" for v in ALL_TITLES}
    return rounded(tb.pivot(ends, [PLAYER], "title", names, F.avg("Total_Game_Session_Events")))


@query("pv_sum", with_(SLICE, f"""
SELECT installation_id, {_pivot_sql(WORLDS, 'world', 'time_',
    'CAST(coalesce(sum(CASE WHEN ? THEN tot_time END), 0) AS BIGINT)')} FROM sl GROUP BY installation_id"""))
def pv_sum(t):
    ends = t.sessions.where("has_end")
    return tb.pivot(ends, [PLAYER], "world", {v: f"time_{v}" for v in WORLDS}, F.sum("Total_Game_Session_Time"))


@query("pv_max", with_(SLICE, f"""
SELECT installation_id, {_pivot_sql(WORLDS, 'world', 'level_',
    "coalesce(max(CASE WHEN ? THEN CASE WHEN contains(title, 'Level') THEN CAST(right(title, 1) AS INTEGER) ELSE 0 END END), 0)")}
FROM sl GROUP BY installation_id"""))
def pv_max(t):
    ends = t.sessions.where("has_end").withColumn("level", title_level(F.col("title")))
    return tb.pivot(ends, [PLAYER], "world", {v: f"level_{v}" for v in WORLDS}, F.max("level"))


@query("pv_nunique", with_(GAME, f"""
SELECT {PAIR}, {_pivot_sql(ALL_CODES, 'event_code', 'code_', 'count(DISTINCT CASE WHEN ? THEN event_code END)')}
FROM game GROUP BY {PAIR}"""))
def pv_nunique(t):
    return tb.pivot_presence(t.log, KEYS, "event_code", {v: f"code_{v}" for v in ALL_CODES})


@query("pv_nunique_null", with_(GAME, f"""
SELECT {PAIR}, {_pivot_sql(ALL_CODES, 'event_code', 'code_', 'max(CASE WHEN ? THEN 1 END)')}
FROM game GROUP BY {PAIR}"""))
def pv_nunique_null(t):
    return tb.pivot_presence(t.log, KEYS, "event_code", {v: f"code_{v}" for v in ALL_CODES}, absent=None)


@query("one_hot", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS "A_flag",
       CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS "N_flag",
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "R_flag" FROM lineitem""")
def one_hot(t):
    hot = f.one_hot(["A", "N", "R"], "l_returnflag", "_flag")
    return t["lineitem"].select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in hot.items()])


@query("agg_value_counts", """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, n AS "count", min(n) OVER () AS smallest, max(n) OVER () AS largest FROM c""")
def agg_value_counts(t):
    counts = st.value_counts(t["orders"], "o_orderpriority")
    bounds = st.count_bounds(t["orders"], "o_orderpriority")
    return counts.select("*", bounds.select("smallest").scalar().alias("smallest"),
                         bounds.select("largest").scalar().alias("largest"))


@query("agg_proportion", """
SELECT o_orderstatus, round(count(*) / (SELECT count(*) FROM orders), 6) AS proportion FROM orders GROUP BY 1""")
def agg_proportion(t):
    return rounded(st.proportions(t["orders"], "o_orderstatus"))


@query("agg_describe", " UNION ALL ".join(f"""
SELECT '{x}' AS "column", count({x}) AS "count", round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std,
       min({x})::DOUBLE AS "min", round(quantile_cont({x}, 0.25), 4) AS q25, round(quantile_cont({x}, 0.5), 4) AS q50,
       round(quantile_cont({x}, 0.75), 4) AS q75, max({x})::DOUBLE AS "max" FROM lineitem"""
                                       for x in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMERIC]))
def agg_describe(t):
    """All numeric columns of the table."""
    return rounded(st.describe(t["lineitem"]), 4)


@query("agg_corr", " UNION ALL ".join(f"""
SELECT '{x}' AS feature,
       round(covar_pop({x}, l_extendedprice) / nullif(stddev_pop({x}) * stddev_pop(l_extendedprice), 0), 6) AS correlation
FROM (SELECT *, 1.0::DOUBLE AS one FROM lineitem)"""
                                   for x in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMERIC, "one"]))
def agg_corr(t):
    """All numeric columns of the table, and a constant one."""
    rows = t["lineitem"].withColumn("one", F.lit(1.0))
    return rounded(st.correlations(rows, st.numeric_columns(rows), "l_extendedprice"))


@query("agg_confusion", """
SELECT g.a, h.b, CAST(count(l.doc_id) AS BIGINT) AS n FROM range(0, 2) g(a) CROSS JOIN range(0, 2) h(b)
LEFT JOIN labels l ON l.quality = g.a AND l.toxic = h.b GROUP BY g.a, h.b""")
def agg_confusion(t):
    return st.confusion(t["labels"], "quality", "toxic")


@query("agg_hist", """
SELECT g.r AS rating, count(l.l_orderkey) AS n FROM range(0, 10) g(r) LEFT JOIN lineitem l ON l.l_linenumber = g.r
GROUP BY g.r""")
def agg_hist(t):
    return st.histogram(t["lineitem"], "l_linenumber", 0, 9)


@query("agg_mode_row", """
SELECT l_orderkey, CAST(q AS INTEGER) AS prediction FROM (
  SELECT l_orderkey, l_linenumber % 3 AS q, count(*) AS n FROM lineitem GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, q) = 1""")
def agg_mode_row(t):
    rows = t["lineitem"].select("l_orderkey", (F.col("l_linenumber") % 3).alias("prediction"))
    return st.row_mode(rows, ["l_orderkey"])


@query("agg_least_frequent", """
SELECT l_suppkey, count(*) AS "count" FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 1""")
def agg_least_frequent(t):
    return st.least_frequent(t["lineitem"], "l_suppkey")


# ---- running values ---------------------------------------------------------------------------

def _over_slice(t, values, order=("Game_Session_Order",)):
    rows = t.slice(lambda part, h: h.over(part, [PLAYER], list(order), values))
    return rows.select(*KEYS, *values)


def _slice_sql(columns):
    return with_(SLICE, f"SELECT {PAIR}, {columns} FROM sl WINDOW z AS ({SESS})")


def _seen():
    return F.col("Total_Game_Session_Events")


@query("w_rownum", with_(SLICE, f"SELECT {PAIR}, ord AS n FROM sl"))
def w_rownum(t):
    rows = t.along(t.sessions.where("has_end"), lambda part, h: h.over(part, [PLAYER], s.END_ORDER, {"n": Position()}))
    return rows.select(*KEYS, "n")


@query("w_factorize", with_(GAME, f"""
, firsts AS (SELECT *, min(timestamp) OVER (PARTITION BY {PAIR}) AS started FROM game)
SELECT {PAIR}, event_count, dense_rank() OVER (PARTITION BY installation_id ORDER BY started, game_session) AS place
FROM firsts"""))
def w_factorize(t):
    """Place of each event's session by first appearance."""
    firsts = t.log.groupBy(*KEYS).agg(F.min("timestamp").alias("started"))
    placed = t.along(firsts, lambda part, h: h.over(part, [PLAYER], s.START_ORDER, {"place": Position()}))
    return t.log.select(*KEYS, "event_count").join(placed.select(*KEYS, "place"), KEYS)


@query("w_lag0", _slice_sql('lag(tot_events, 1, 0) OVER (PARTITION BY installation_id ORDER BY ord) AS "before"'))
def w_lag0(t):
    return _over_slice(t, {"before": Before(_seen())})


@query("w_lag_global", _slice_sql('lag(tot_events, 1, 0) OVER (ORDER BY installation_id, ord) AS "before"'))
def w_lag_global(t):
    rows = f.shift_all(t.along(t.sessions, s.end_slice), [PLAYER, "Game_Session_Order"], {"before": Before(_seen())})
    return rows.select(*KEYS, "before")


@query("w_cumsum", with_(GAME, f"""
SELECT {PAIR}, event_count, CAST(sum(game_time) OVER (PARTITION BY installation_id
  ORDER BY timestamp, game_session, event_count ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM game"""))
def w_cumsum(t):
    order = ["timestamp", SESSION, "event_count"]
    rows = t.along(t.log, lambda part, h: h.over(part, [PLAYER], order, {"total": Total(F.col("game_time"))}))
    return rows.select(*KEYS, "event_count", "total")


@query("w_cumsum_nan", _slice_sql("""CASE WHEN type = 'Game' THEN CAST(sum(CASE WHEN type = 'Game' THEN tot_events END)
  OVER z AS BIGINT) END AS total"""))
def w_cumsum_nan(t):
    """Null rows are skipped by the sum and stay null."""
    value = F.when(F.col("type") == "Game", _seen())
    rows = t.slice(lambda part, h: h.over(part, [PLAYER], ["Game_Session_Order"], {"total": Total(value)}))
    return rows.select(*KEYS, F.when(value.isNotNull(), F.col("total")).alias("total"))


@query("w_cummax", _slice_sql("max(tot_time) OVER z AS longest"))
def w_cummax(t):
    return _over_slice(t, {"longest": Peak(F.col("Total_Game_Session_Time"))})


@query("w_exp_mean", _slice_sql("round(avg(tot_events) OVER z, 6) AS mean"))
def w_exp_mean(t):
    return rounded(_over_slice(t, {"mean": Mean(_seen())}))


@query("w_exp_std", _slice_sql("round(coalesce(stddev_samp(tot_events) OVER z, 0), 6) AS std"))
def w_exp_std(t):
    return rounded(_over_slice(t, {"std": Spread(_seen())}))


@query("w_ffill", _slice_sql("""last(CASE WHEN type = 'Game' THEN title END IGNORE NULLS) OVER z AS last_game"""))
def w_ffill(t):
    return _over_slice(t, {"last_game": Latest(F.when(F.col("type") == "Game", F.col("title")))})


@query("w_cond_exp_mean", with_(SLICE, f"""
SELECT {PAIR}, round(coalesce(avg(CASE WHEN type = 'Game' THEN tot_events END) OVER (PARTITION BY installation_id
  ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS mean FROM sl"""))
def w_cond_exp_mean(t):
    return rounded(_over_slice(t, {"mean": Mean(F.when(F.col("type") == "Game", _seen()), PREVIOUS)}))


def _from_last_sql(expression):
    return with_(ASSESS, f"""SELECT {PAIR}, CASE WHEN ctr = {expression} THEN 1 ELSE 0 END AS chosen FROM assess""")


def _from_last(t, back):
    rows = t.along(t.assessments, holdout.from_last)
    return rows.select(*KEYS, (F.col("order") == F.col("LastGame") - back).cast("int").alias("chosen"))


@query("w_last_flag", _from_last_sql("count(*) OVER (PARTITION BY installation_id)"))
def w_last_flag(t):
    return _from_last(t, 0)


@query("w_second_last", _from_last_sql("count(*) OVER (PARTITION BY installation_id) - 1"))
def w_second_last(t):
    return _from_last(t, 1)
