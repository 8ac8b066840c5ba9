"""Queries of problems 2, 3 and 5: late events, change feed, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.operators import late_events as late
from mnemora.operators import sessions as ses
from mnemora.operators import wal_replay as wal
from mnemora.sources.tables import table


def _in_batches(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log in two batches by arrival: all but the last day of arrivals, then that day; rows without arrival come first."""
    arrival = late.arrival_millis("received_at")
    last = log.agg(F.max(arrival)).first()[0] or 0
    new = F.coalesce(arrival > last - ses.DAY_MS, F.lit(False))
    return log.where(~new), log.where(new)


def pane_store(spark: SparkSession, d: str) -> late.PaneStore:
    store = late.PaneStore(spark, workspace.new_dir(spark, "panes"))
    for number, batch in enumerate(_in_batches(table(spark, d, "analytics_log").select("id", "event_type", "timestamp", "received_at"))):
        store.apply(batch, number)
    return store


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pane_store(spark, d).events().where("outcome <> 'on_time'").select("id", F.expr("pane_start div 1000").alias("hour_start"), "outcome")


def p2_hourly(spark: SparkSession, d: str) -> DataFrame:
    return pane_store(spark, d).panes().select("event_type", F.expr("pane_start div 1000").alias("hour_start"), "on_time", "corrected", "dropped")


def p2_windows(spark: SparkSession, d: str) -> DataFrame:
    w = late.compose_windows(pane_store(spark, d).panes(), size_panes=3)
    return w.select("event_type", F.expr("window_start div 1000").alias("window_start"), "at_close", "events")


def p2_revisions(spark: SparkSession, d: str) -> DataFrame:
    r = late.revisions(pane_store(spark, d).partials())
    return r.select("event_type", F.expr("pane_start div 1000").alias("hour_start"), "revision", "events")


def replica(spark: SparkSession, d: str) -> wal.Replica:
    """The log applied as two batches in the order of storage, and the end of the feed."""
    log = table(spark, d, "wal")
    lo, hi = log.agg(F.min("id"), F.max("id")).first()
    first = F.coalesce(F.col("id") <= ((lo or 0) + (hi or 0)) // 2, F.lit(True))
    return wal.Replica(spark, workspace.new_dir(spark, "replica")).apply(log.where(first), 0).apply(log.where(~first), 1).close()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return replica(spark, d).live().select("node_id", "clock", "origin")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    return replica(spark, d).live()


def session_table(spark: SparkSession, d: str) -> ses.SessionTable:
    store = ses.SessionTable(spark, workspace.new_dir(spark, "sessions"))
    for batch in _in_batches(table(spark, d, "analytics_log").select("id", "user_id", "session_id", "timestamp", "received_at")):
        store.apply(batch)
    return store


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return session_table(spark, d).read().select("actor", "first_id", "last_id")


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = session_table(spark, d).read()
    return s.select("actor", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "events")


_EVENTS = """
ev AS (
  SELECT id, min(lower(trim(event_type))) AS event_type,
         min(CASE WHEN "timestamp" > 0 AND "timestamp" < 1e17 THEN
               CAST(round(CASE WHEN "timestamp" < 1e11 THEN "timestamp" * 1000
                               WHEN "timestamp" < 1e14 THEN "timestamp" ELSE "timestamp" / 1000 END) AS BIGINT) END) AS event_ms,
         min(CASE WHEN regexp_full_match(trim(received_at), '[+-]?[0-9]+(\\.[0-9]+)?')
                  THEN CAST(round(CAST(trim(received_at) AS DOUBLE) * 1000) AS BIGINT)
                  ELSE epoch_ms(TRY_CAST(trim(received_at) AS TIMESTAMPTZ)) END) AS arrival_ms
  FROM analytics_log WHERE trim(id) <> '' GROUP BY id),
late AS (
  SELECT *, arrival_ms - pane_start - 3600000 AS late_ms FROM (
    SELECT *, event_ms - event_ms % 3600000 AS pane_start FROM ev WHERE event_ms IS NOT NULL AND arrival_ms IS NOT NULL)),
sliced AS (
  SELECT *, CASE WHEN late_ms < 300000 THEN 'on_time' WHEN late_ms <= 86400000 THEN 'corrected' ELSE 'dropped' END AS outcome FROM late)
"""

_SESSIONS = """
rows1 AS (
  SELECT id, CASE WHEN "timestamp" > 0 AND "timestamp" < 1e17 THEN
               CAST(round(CASE WHEN "timestamp" < 1e11 THEN "timestamp" * 1000
                               WHEN "timestamp" < 1e14 THEN "timestamp" ELSE "timestamp" / 1000 END) AS BIGINT) END AS event_ms,
         lower(CASE WHEN trim(user_id) <> '' THEN trim(user_id) ELSE trim(session_id) END) AS actor
  FROM analytics_log WHERE trim(id) <> ''),
one AS (SELECT id, min(event_ms) AS event_ms, min(actor) AS actor FROM rows1
        WHERE event_ms IS NOT NULL AND actor <> '' AND actor <> 'default' GROUP BY id),
gaps AS (SELECT *, CASE WHEN event_ms - lag(event_ms) OVER w <= 1800000 THEN 0 ELSE 1 END AS fresh FROM one
         WINDOW w AS (PARTITION BY actor ORDER BY event_ms, id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY actor ORDER BY event_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM gaps)
"""

_STATE = """
j AS (SELECT clock, origin, CASE WHEN json_valid(mutation) THEN CAST(mutation AS JSON) END AS v FROM wal),
b AS (SELECT clock, origin, lower(trim(coalesce(v->>'$.op', v->>'$.action'))) AS op,
             coalesce(v->'$.payload', v->'$.data', v) AS b FROM j WHERE v IS NOT NULL),
c AS (SELECT DISTINCT clock, origin,
        CASE WHEN op IN ('add','add_node','create','insert') THEN 'add' WHEN op IN ('update','update_node','patch') THEN 'update'
             WHEN op IN ('delete','delete_node','remove') THEN 'delete' END AS kind,
        b->>'$.node_id' AS one, CAST(b->'$.node_ids' AS VARCHAR[]) AS many,
        coalesce(b->>'$.content.text', b->>'$.content') AS content, CAST(b->>'$.salience' AS DOUBLE) AS salience, b->>'$.modality' AS modality,
        json_extract(b, '$.content') IS NOT NULL AS has_content FROM b),
n AS (SELECT * FROM (SELECT * EXCLUDE (one, many), unnest(CASE WHEN one IS NULL THEN many ELSE list_append(coalesce(many, []), one) END) AS node_id FROM c WHERE kind IS NOT NULL) WHERE node_id <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY clock, origin) AS k FROM (SELECT DISTINCT * FROM n)),
e AS (SELECT node_id, max(k) FILTER (kind = 'add') AS a, coalesce(max(k) FILTER (kind = 'delete'), 0) AS d, max(k) AS z FROM r GROUP BY node_id HAVING a > d)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_hourly": p2_hourly,
    "p2_windows": p2_windows,
    "p2_revisions": p2_revisions,
    "p3_found": p3_found,
    "p3_state": p3_state,
    "p5_found": p5_found,
    "p5_sessions": p5_sessions,
}
SQL = {
    "p2_found": f"WITH {_EVENTS} SELECT id, pane_start // 1000 AS hour_start, outcome FROM sliced WHERE outcome <> 'on_time'",
    "p2_hourly": f"""WITH {_EVENTS} SELECT event_type, pane_start // 1000 AS hour_start,
        CAST(count(*) FILTER (outcome = 'on_time') AS BIGINT) AS on_time, CAST(count(*) FILTER (outcome = 'corrected') AS BIGINT) AS corrected,
        CAST(count(*) FILTER (outcome = 'dropped') AS BIGINT) AS dropped FROM sliced GROUP BY ALL""",
    "p2_windows": f"""WITH {_EVENTS} SELECT event_type, (pane_start - k * 3600000) // 1000 AS window_start,
        CAST(count(*) FILTER (outcome = 'on_time') AS BIGINT) AS at_close, CAST(count(*) FILTER (outcome <> 'dropped') AS BIGINT) AS events
        FROM sliced, range(3) AS r(k) GROUP BY ALL""",
    "p2_revisions": f"""WITH {_EVENTS}, t AS (SELECT event_type, pane_start, CASE WHEN outcome = 'on_time' THEN 0 ELSE arrival_ms // 3600000 + 1 END AS tick,
        count(*) AS n FROM sliced WHERE outcome <> 'dropped' GROUP BY ALL)
        SELECT event_type, pane_start // 1000 AS hour_start, row_number() OVER w - 1 AS revision, CAST(sum(n) OVER w AS BIGINT) AS events
        FROM t WINDOW w AS (PARTITION BY event_type, pane_start ORDER BY tick ROWS UNBOUNDED PRECEDING)""",
    "p3_found": f"WITH {_STATE} SELECT r.node_id, r.clock, r.origin FROM e JOIN r ON r.node_id = e.node_id AND r.k = e.z",
    "p3_state": f"""WITH {_STATE} SELECT e.node_id, max_by(clock, k) AS clock, max_by(origin, k) AS origin,
        arg_max_null(content, k) FILTER (kind = 'add' OR has_content) AS content,
        arg_max_null(salience, k) FILTER (kind = 'add' OR salience IS NOT NULL) AS salience,
        arg_max_null(modality, k) FILTER (kind = 'add' OR modality IS NOT NULL) AS modality
        FROM e JOIN r ON r.node_id = e.node_id AND r.k >= e.a GROUP BY e.node_id""",
    "p5_found": f"WITH {_SESSIONS} SELECT actor, arg_min(id, (event_ms, id)) AS first_id, arg_max(id, (event_ms, id)) AS last_id FROM numbered GROUP BY actor, k",
    "p5_sessions": f"""WITH {_SESSIONS} SELECT actor, min(event_ms) AS start_ms, max(event_ms) AS end_ms,
        max(event_ms) - min(event_ms) AS duration_ms, count(*) AS events FROM numbered GROUP BY actor, k""",
}
