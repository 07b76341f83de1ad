"""Shared parts of the comparison SQL, written straight from the definitions."""

GAME = """
raw AS (
  SELECT user_id, event_id, ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS chunk
  FROM events),
cut AS (
  SELECT *, min(event_id) OVER (PARTITION BY user_id, chunk) AS sid,
         min(ts) OVER (PARTITION BY user_id, chunk) AS t0,
         CAST(row_number() OVER (PARTITION BY user_id, chunk ORDER BY ts, event_id) AS INTEGER) AS ec
  FROM raw),
game AS (
  SELECT user_id AS installation_id, sid AS game_session, ts AS timestamp, ec AS event_count,
         (epoch_us(ts) - epoch_us(t0)) // 1000
           + CASE WHEN sid % 11 = 0 AND ec = 2 THEN 100000000000 ELSE 0 END AS game_time,
         CASE event_type WHEN 'purchase' THEN 4100 WHEN 'error' THEN 4110 WHEN 'signup' THEN 2000
                         WHEN 'click' THEN 4070 ELSE 3010 END AS event_code,
         CASE sid % 4 WHEN 0 THEN 'Assessment' WHEN 1 THEN 'Game' WHEN 2 THEN 'Activity' ELSE 'Clip' END AS type,
         CASE sid % 4
           WHEN 0 THEN CASE (sid // 4) % 5 WHEN 0 THEN 'Bird Measurer (Assessment)'
             WHEN 1 THEN 'Cart Puzzle (Assessment)' WHEN 2 THEN 'Jar Filler (Assessment)'
             WHEN 3 THEN 'Nest (Assessment)' ELSE 'Box Sorter (Assessment)' END
           WHEN 1 THEN 'Cave Game ' || CAST((sid // 4) % 3 AS VARCHAR)
           WHEN 2 THEN 'Pond Activity ' || CAST((sid // 4) % 2 AS VARCHAR)
           ELSE 'Climb Level ' || CAST((sid // 4) % 3 + 1 AS VARCHAR) END AS title,
         CASE (sid // 20) % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'MAGMAPEAK' WHEN 2 THEN 'TREETOPCITY'
                              ELSE 'CRYSTALCAVES' END AS world,
         CASE WHEN value >= 40 THEN '{"correct":true' ELSE '{"correct":false' END
           || CASE WHEN k % 5 = 0 THEN '' ELSE ',"duration":' || CAST(k * 100 AS VARCHAR) END || '}' AS event_data
  FROM cut)"""

EVENTS = GAME + """,
tried AS (
  SELECT *, CASE WHEN type = 'Assessment' AND (
      (event_code = 4100 AND title <> 'Bird Measurer (Assessment)')
      OR (event_code = 4110 AND title = 'Bird Measurer (Assessment)')) THEN 1 ELSE 0 END AS att
  FROM game),
ev AS (
  SELECT *, CASE WHEN att = 1 AND contains(event_data, 'true') THEN 1 ELSE 0 END AS succ,
         max(game_time) OVER (PARTITION BY installation_id, game_session) AS tot_time,
         max(event_count) OVER (PARTITION BY installation_id, game_session) AS tot_events
  FROM tried)"""

ASSESS = EVENTS + """,
a0 AS (
  SELECT installation_id, game_session, min(timestamp) AS started, max(title) AS title, max(world) AS world,
         CAST(sum(att) AS BIGINT) AS att, CAST(sum(succ) AS BIGINT) AS succ,
         max(game_time) AS t, max(event_count) AS e,
         max(CASE WHEN att = 1 THEN event_count ELSE 0 END) AS till_events,
         max(CASE WHEN att = 1 THEN game_time ELSE 0 END) AS till_time,
         avg(CAST(json_extract_string(event_data, '$.duration') AS DOUBLE)) AS dur
  FROM ev WHERE type = 'Assessment' GROUP BY installation_id, game_session),
assess AS (
  SELECT *, CASE WHEN att = 0 THEN 0 WHEN succ = att THEN 3 WHEN succ * 2 = att THEN 2
                 WHEN succ > 0 AND succ * 2 < att THEN 1 ELSE 0 END AS ag,
         row_number() OVER (PARTITION BY installation_id ORDER BY started, game_session) AS ctr
  FROM a0)"""

SLICE = ASSESS + """,
running AS (
  SELECT *, sum(att) OVER o AS cum_att, sum(succ) OVER o AS cum_succ
  FROM ev WINDOW o AS (PARTITION BY installation_id ORDER BY timestamp, game_session, event_count
                       ROWS UNBOUNDED PRECEDING)),
ends AS (
  SELECT DISTINCT r.installation_id, r.game_session, r.timestamp, r.type, r.title, r.world, r.tot_time,
         r.tot_events, CAST(r.cum_att AS BIGINT) AS cum_att, CAST(r.cum_succ AS BIGINT) AS cum_succ,
         x.ctr
  FROM running r LEFT JOIN assess x USING (installation_id, game_session)
  WHERE r.game_time = r.tot_time AND r.event_count = r.tot_events),
sl AS (
  SELECT *, row_number() OVER (PARTITION BY installation_id ORDER BY timestamp, game_session) AS ord
  FROM ends)"""

SESS = "PARTITION BY installation_id ORDER BY ord ROWS UNBOUNDED PRECEDING"
SESS_BEFORE = "PARTITION BY installation_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
BEGUN = "PARTITION BY installation_id ORDER BY started, game_session"
LEX = "PARTITION BY installation_id ORDER BY game_session"


def with_(parts: str, select: str) -> str:
    return f"WITH {parts.strip()}\n{select.strip()}"
