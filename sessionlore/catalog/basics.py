"""Queries on sources, columns, filters, joins, sorts and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlore.catalog.base import query, rounded
from sessionlore.catalog.sql import ASSESS, EVENTS, GAME, SLICE, with_
from sessionlore.functions import scalars as c
from sessionlore.functions.catalogue import ASSESSMENT, KEYS, OTHER_ATTEMPT_TITLE, PLAYER
from sessionlore.operators import tables as tb
from sessionlore.operators.sampling import union_classes
from sessionlore.plans import assemble, holdout
from sessionlore.plans import features as f
from sessionlore.plans import sessions as s
from sessionlore.sources import files

PAIR = "installation_id, game_session"

# ---- sources and sinks ------------------------------------------------------------------------


@query("src_csv", with_(GAME, f"""
SELECT {PAIR}, epoch_us(timestamp) AS at_us, event_count, game_time, event_code, type, title, world, event_data
FROM game"""))
def src_csv(t):
    """The log written as CSV with a header, read again with its schema."""
    path = t.scratch()
    whole = t.log.withColumn("event_id", F.lit("e")).select(*files.EVENT_LOG.fieldNames())
    whole.write.option("header", True).option("escape", '"').option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    log = files.read_log(t.spark, path)
    return log.select(
        *[F.col(k).cast("long").alias(k) for k in KEYS], F.unix_micros("timestamp").alias("at_us"),
        "event_count", "game_time", "event_code", "type", "title", "world", "event_data",
    )


_PREV = """
SELECT installation_id, game_session, lag(ag, 1, 0) OVER b AS "Past_Assessment_ag",
       lag(att, 1, 0) OVER b AS "Past_Assessment_att", ag AS accuracy_group
FROM assess WINDOW b AS (PARTITION BY installation_id ORDER BY ctr)"""


@query("src_features", with_(ASSESS, _PREV))
def src_features(t):
    """A feature table with its label, saved and read again."""
    path = t.scratch()
    table = t.along(t.assessments, lambda part, h: f.compute(
        part, h, [f.previous_accuracy()], [*KEYS, "accuracy_group"]))
    files.write_features(table, path)
    saved, columns = files.read_features(t.spark, path)
    return saved.select(*KEYS, *[n for n in columns if n in ("Past_Assessment_ag", "Past_Assessment_att")],
                        "accuracy_group")


_LAST_GROUP = """SELECT installation_id, ag AS accuracy_group FROM assess
QUALIFY ctr = count(*) OVER (PARTITION BY installation_id)"""


@query("sink_submission", with_(ASSESS, _LAST_GROUP))
def sink_submission(t):
    """The file a submission is, read again."""
    path = t.scratch()
    files.write_submission(holdout.last_assessment(t.written_assessments).join(t.labels, KEYS), path)
    return files.read_csv(t.spark, path, "installation_id long, accuracy_group int")


@query("src_labels", with_(ASSESS, f"SELECT {PAIR}, ag AS accuracy_group FROM assess"))
def src_labels(t):
    """A label file with more columns, in another order, of which three are picked by name."""
    path = t.scratch()
    t.written_assessments.select(
        F.lit(0).alias("num_attempts"), "accuracy_group", "game_session", F.lit("a, b").alias("title"), "installation_id",
    ).write.option("header", True).option("escape", '"').csv(path)
    labels = files.read_labels(t.spark, path)
    return labels.select(*[F.col(k).cast("long").alias(k) for k in KEYS], "accuracy_group")


@query("src_ids", with_(GAME, f"SELECT DISTINCT {PAIR} FROM game"))
def src_ids(t):
    return files.key_pairs(t.log)


# ---- projections and filters ------------------------------------------------------------------

@query("proj_cols", with_(GAME, f"SELECT {PAIR}, type, event_count, event_code, game_time FROM game"))
def proj_cols(t):
    return t.log.select(*KEYS, "type", "event_count", "event_code", "game_time")


@query("proj_exclude", with_(ASSESS, """
SELECT t AS "Total_Game_Session_Time", e AS "Total_Game_Session_Events", att AS "Attempts", succ AS "Success"
FROM assess"""))
def proj_exclude(t):
    kept = t.assessments.select(*KEYS, "accuracy_group", "Total_Game_Session_Time", "Total_Game_Session_Events",
                                "Attempts", "Success")
    return tb.without(kept, [*KEYS, "accuracy_group"])


@query("proj_include", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def proj_include(t):
    numeric = [n for n, kind in t["lineitem"].dtypes if kind == "double"]
    return tb.only(t["lineitem"], numeric)


@query("proj_rename_drop", with_(SLICE, f"""
SELECT {PAIR}, ord AS "Total_Games_played" FROM sl WHERE type = 'Assessment'"""))
def proj_rename_drop(t):
    rows = s.only_assessments(t.along(t.sessions, s.end_slice)).select(*KEYS, "type", "Game_Session_Order")
    return rows.withColumnRenamed("Game_Session_Order", "Total_Games_played").drop("type")


@query("flt_eq", with_(GAME, f"SELECT {PAIR}, event_count, title FROM game WHERE type = 'Assessment'"))
def flt_eq(t):
    return t.log.where(F.col("type") == ASSESSMENT).select(*KEYS, "event_count", "title")


@query("flt_compound", with_(EVENTS, f"SELECT {PAIR}, event_count, event_code, title FROM ev WHERE att = 1"))
def flt_compound(t):
    return t.log.where(c.is_attempt()).select(*KEYS, "event_count", "event_code", "title")


@query("flt_notin_list", with_(GAME, f"""
SELECT {PAIR}, event_count, title FROM game WHERE title NOT IN ('Bird Measurer (Assessment)')"""))
def flt_notin_list(t):
    return t.log.where(F.col("title") != OTHER_ATTEMPT_TITLE).select(*KEYS, "event_count", "title")


@query("flt_session_end", with_(EVENTS, f"""
SELECT DISTINCT {PAIR}, type, title, world, tot_time AS "Total_Game_Session_Time",
       tot_events AS "Total_Game_Session_Events"
FROM ev WHERE game_time = tot_time AND event_count = tot_events"""))
def flt_session_end(t):
    return t.sessions.where("has_end").select(
        *KEYS, "type", "title", "world", "Total_Game_Session_Time", "Total_Game_Session_Events"
    )


# ---- scalars ----------------------------------------------------------------------------------

@query("sc_contains", with_(GAME, f"SELECT {PAIR}, event_count, contains(event_data, 'true') AS has_true FROM game"))
def sc_contains(t):
    return t.log.select(*KEYS, "event_count", F.col("event_data").contains("true").alias("has_true"))


@query("sc_case", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount / 0.1 = 1 THEN 3 WHEN l_discount / 0.1 = 0.5 THEN 2
            WHEN l_discount / 0.1 < 0.5 AND l_discount > 0 THEN 1 ELSE 0 END AS band
FROM lineitem""")
def sc_case(t):
    """The outcome bands on discounts of at most a tenth: between one half and one falls to 0."""
    band = c.accuracy_group(F.lit(0.1), F.col("l_discount"))
    return t["lineitem"].select("l_orderkey", "l_linenumber", band.alias("band"))


@query("sc_safe_div", """
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END, 6) AS ratio FROM lineitem""")
def sc_safe_div(t):
    ratio = c.safe_divide(F.col("l_discount"), F.col("l_tax"))
    return rounded(t["lineitem"].select("l_orderkey", "l_linenumber", ratio.alias("ratio")))


@query("sc_fill0", with_(GAME, f"""
SELECT {PAIR}, event_count, coalesce(CAST(json_extract_string(event_data, '$.duration') AS DOUBLE), 0) AS duration
FROM game"""))
def sc_fill0(t):
    rows = t.log.select(*KEYS, "event_count", c.json_value("event_data", "duration", "double").alias("duration"))
    return rows.select(*KEYS, "event_count", *c.fill0("duration"))


@query("sc_mask_assign", with_(EVENTS, f"""
SELECT {PAIR}, event_count, CASE WHEN att = 1 THEN event_count END AS at_attempt,
       CASE WHEN att = 1 THEN 1 ELSE 0 END AS attempt FROM ev"""))
def sc_mask_assign(t):
    tried = c.is_attempt()
    return t.log.select(
        *KEYS, "event_count", c.assign_where(tried, F.col("event_count")).alias("at_attempt"),
        c.assign_where(tried, F.lit(1), F.lit(0)).alias("attempt"),
    )


@query("sc_round_int", "SELECT o_orderkey, CAST(round(o_totalprice) AS INTEGER) AS price FROM orders")
def sc_round_int(t):
    return t["orders"].select("o_orderkey", c.round_int(F.col("o_totalprice")).alias("price"))


@query("sc_to_ts", "SELECT event_id, epoch_us(ts) AS at_us FROM events")
def sc_to_ts(t):
    text = t["events"].select("event_id", F.col("ts").cast("string").alias("text"))
    return text.select("event_id", F.unix_micros(c.parse_time(F.col("text"))).alias("at_us"))


@query("sc_dateparts", with_(GAME, f"""
SELECT {PAIR}, event_count, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date,
       CAST(month(timestamp) AS INTEGER) AS month, CAST(hour(timestamp) AS INTEGER) AS hour,
       CAST(year(timestamp) AS INTEGER) AS year, CAST(isodow(timestamp) - 1 AS INTEGER) AS dayofweek FROM game"""))
def sc_dateparts(t):
    rows = t.log.withColumns(c.date_parts("timestamp"))
    return rows.select(*KEYS, "event_count", F.col("date").cast("string").alias("date"), "month", "hour", "year",
                       "dayofweek")


@query("sc_rstrip_set", with_(GAME, f"SELECT {PAIR}, event_count, rtrim(title, ' (Assessment)') AS short FROM game"))
def sc_rstrip_set(t):
    return t.log.select(*KEYS, "event_count", c.strip_right(F.col("title")).alias("short"))


@query("sc_level", with_(GAME, f"""
SELECT {PAIR}, event_count,
       CASE WHEN contains(title, 'Level') THEN CAST(right(trim(title), 1) AS INTEGER) ELSE 0 END AS level FROM game"""))
def sc_level(t):
    return t.log.select(*KEYS, "event_count", c.title_level(F.col("title")).alias("level"))


@query("sc_row_sum", """
SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS total FROM lineitem""")
def sc_row_sum(t):
    total = c.row_sum("l_quantity", "l_discount", "l_tax")
    return rounded(t["lineitem"].select("l_orderkey", "l_linenumber", total.alias("total")))


@query("sc_abs", "SELECT c_custkey, abs(c_acctbal) AS balance FROM customer")
def sc_abs(t):
    return t["customer"].select("c_custkey", F.abs("c_acctbal").alias("balance"))


@query("sc_json_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def sc_json_get(t):
    return t["events"].select("event_id", c.json_value("props", "k", "int").alias("k"))


@query("json_unnest", with_(GAME, f"""
SELECT {PAIR}, event_count, json_extract_string(event_data, '$.correct') = 'true' AS correct,
       CAST(json_extract_string(event_data, '$.duration') AS BIGINT) AS duration FROM game"""))
def json_unnest(t):
    return tb.json_unnest(t.log.select(*KEYS, "event_count", "event_data"), "event_data").drop("event_data")


@query("sc_paste", """
SELECT r_name, string_agg(CAST(n_nationkey AS VARCHAR) || '-' || n_name, ',' ORDER BY n_nationkey) AS pasted
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def sc_paste(t):
    named = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return c.collapse(named, ["n_nationkey", "n_name"], ["n_nationkey"], ",", ["r_name"], sep="-")


@query("sc_paste_rows", """
SELECT c_custkey, c_name || '/' || c_mktsegment AS pasted FROM customer""")
def sc_paste_rows(t):
    return t["customer"].select("c_custkey", c.paste("c_name", "c_mktsegment", sep="/").alias("pasted"))


@query("sc_prefix_cols", "SELECT l_orderkey, l_linenumber, l_quantity AS seen_l_quantity, l_tax AS seen_l_tax FROM lineitem")
def sc_prefix_cols(t):
    names = ["l_quantity", "l_tax"]
    new = c.prefixed("seen_", names)
    return t["lineitem"].select("l_orderkey", "l_linenumber", *[F.col(a).alias(b) for a, b in zip(names, new)])


@query("sc_minmax_clip", """
WITH x AS (SELECT l_orderkey, l_linenumber, greatest(least((l_quantity - 25) / 24, 0.999), -0.999) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, round(k, 6) AS k, round(0.5 * ln((1 + k) / (1 - k)), 6) AS z,
       round(tanh(0.5 * ln((1 + k) / (1 - k))), 6) AS back FROM x""")
def sc_minmax_clip(t):
    rows = t["lineitem"].select(
        "l_orderkey", "l_linenumber", c.clip((F.col("l_quantity") - 25) / 24).alias("k")
    ).withColumn("z", c.fisher_z(F.col("k")))
    return rounded(rows.withColumn("back", c.inverse_fisher_z(F.col("z"))))


@query("chk_width", with_(ASSESS, """
SELECT installation_id, game_session, lag(ag, 1, 0) OVER b AS "Past_Assessment_ag" FROM assess
WINDOW b AS (PARTITION BY installation_id ORDER BY ctr)
QUALIFY ctr = count(*) OVER (PARTITION BY installation_id)"""))
def chk_width(t):
    """Rows to score pass only with the columns of the training table."""
    def build(part, h):
        return f.compute(part, h, [f.previous_accuracy()])

    train = t.along(t.written_assessments, build)
    scored = train.join(holdout.last_assessment(t.written_assessments), KEYS)
    if not tb.same_width(train, scored):
        raise ValueError("tables differ in width")
    return tb.require_columns(scored, train.columns).select(*KEYS, "Past_Assessment_ag")


# ---- joins ------------------------------------------------------------------------------------

_BEFORE = """, past AS (SELECT installation_id, game_session, lag(att, 1, 0) OVER (
  PARTITION BY installation_id ORDER BY ctr) AS before, ag FROM assess),
last AS (SELECT installation_id, game_session FROM assess QUALIFY ctr = count(*) OVER (PARTITION BY installation_id)),
second AS (SELECT installation_id, game_session, ag FROM assess
           QUALIFY ctr = count(*) OVER (PARTITION BY installation_id) - 1)"""


def _before(t):
    rows = t.along(t.written_assessments, lambda part, h: f.compute(part, h, [f.previous_accuracy()]))
    return rows.select(*KEYS, F.col("Past_Assessment_att").alias("before"))


@query("join_label", with_(ASSESS + _BEFORE, f"SELECT {PAIR}, before, ag AS accuracy_group FROM past"))
def join_label(t):
    return assemble.with_labels(_before(t), t.labels)


_ENDS_TIME = with_(SLICE + _BEFORE, """SELECT l.installation_id, l.game_session, s.ord AS "Game_Session_Order"
FROM last l LEFT JOIN sl s USING (installation_id, game_session)""")


@query("join_left", _ENDS_TIME)
def join_left(t):
    """Every session to score stays, also one without an end row."""
    order = t.along(t.sessions, s.end_slice).select(*KEYS, "Game_Session_Order")
    return tb.keep_left(holdout.last_assessment(t.written_assessments), order).select(*KEYS, "Game_Session_Order")


@query("join_right", _ENDS_TIME)
def join_right(t):
    order = t.along(t.sessions, s.end_slice).select(*KEYS, "Game_Session_Order")
    return tb.keep_right(order, holdout.last_assessment(t.written_assessments))


@query("join_semi_cols", with_(ASSESS + _BEFORE, f"""
SELECT {PAIR}, before FROM past WHERE game_session IN (SELECT game_session FROM second)
AND installation_id IN (SELECT installation_id FROM second)"""))
def join_semi_cols(t):
    second = t.along(t.written_assessments, holdout.second_last_assessment)
    return tb.in_both(_before(t), second).select(*KEYS, "before")


@query("join_anti", with_(ASSESS + _BEFORE, f"""
SELECT {PAIR}, before FROM past WHERE game_session NOT IN (SELECT game_session FROM last)"""))
def join_anti(t):
    return tb.not_in_sessions(_before(t), holdout.last_assessment(t.written_assessments)).select(*KEYS, "before")


_TITLE = "title_means AS (SELECT title, avg(t) AS mean_time, avg(e) AS mean_events, avg(att) AS mean_attempts FROM assess GROUP BY title)"


def _title_means(t):
    """Three measures per title in one aggregate."""
    return t.written_assessments.groupBy("title").agg(
        F.avg("Total_Game_Session_Time").alias("mean_time"), F.avg("Total_Game_Session_Events").alias("mean_events"),
        F.avg("Attempts").alias("mean_attempts"),
    )


@query("join_dim", with_(ASSESS + "," + _TITLE, f"""
SELECT {PAIR}, round(mean_time, 0) AS mean_time, round(mean_attempts, 6) AS mean_attempts
FROM assess JOIN title_means USING (title)"""))
def join_dim(t):
    joined = tb.join_counted(t.written_assessments.select(*KEYS, "title"), _title_means(t), "title")
    return rounded(joined.select(*KEYS, "mean_time", "mean_attempts"), mean_time=0)


@query("join_reduce_dim", with_(ASSESS + "," + _TITLE, """
SELECT title, round(mean_time, 0) AS mean_time, round(mean_events, 6) AS mean_events,
       round(mean_attempts, 6) AS mean_attempts FROM title_means"""))
def join_reduce_dim(t):
    return rounded(_title_means(t), mean_time=0)


@query("join_positional", with_(GAME, f"""
SELECT {PAIR}, event_count, CASE WHEN type = 'Game' THEN 1 ELSE 0 END AS "Game",
       CASE WHEN type = 'Clip' THEN 1 ELSE 0 END AS "Clip" FROM game"""))
def join_positional(t):
    """Columns put beside a table stay on its rows: nothing is matched by position."""
    return t.log.select(*KEYS, "event_count", *[v.alias(n) for n, v in f.one_hot(["Game", "Clip"], "type").items()])


@query("join_index_left", """
SELECT d.doc_id, d.lang, l.toxic AS predicted_score FROM documents d LEFT JOIN labels l USING (doc_id)""")
def join_index_left(t):
    scores = t["labels"].select("doc_id", F.col("toxic").alias("predicted_score"))
    return tb.keep_left(t["documents"].select("doc_id", "lang"), scores, ["doc_id"])


# ---- sorts, top rows, unions ------------------------------------------------------------------

@query("sort_multi", with_(GAME, f"""
SELECT {PAIR}, epoch_us(timestamp) AS at_us, event_code FROM game ORDER BY installation_id, timestamp, game_session"""))
def sort_multi(t):
    ordered = t.log.orderBy(PLAYER, "timestamp", "game_session")
    return ordered.select(*KEYS, F.unix_micros("timestamp").alias("at_us"), "event_code")


@query("topk_last", with_(ASSESS, _LAST_GROUP))
def topk_last(t):
    order = F.struct("started", "game_session")
    return t.assessments.groupBy(PLAYER).agg(F.max_by("accuracy_group", order).alias("accuracy_group"))


@query("topk_second_last", with_(ASSESS, """
SELECT installation_id, t AS "Total_Game_Session_Time" FROM assess
QUALIFY ctr = count(*) OVER (PARTITION BY installation_id) - 1"""))
def topk_second_last(t):
    def build(part, h):
        return holdout.from_last(part, h).where("order = LastGame - 1")

    return t.along(t.assessments, build).select(PLAYER, "Total_Game_Session_Time")


@query("set_union", with_(ASSESS, f"SELECT {PAIR}, ag AS accuracy_group FROM assess"))
def set_union(t):
    return union_classes(t.labels, "accuracy_group", [0, 1, 2, 3])
