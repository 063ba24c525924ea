"""Queries on references and sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import references, sessions
from lodestrand.tables import table

_TABLES = ("event_index", "code_entities", "graph_edges", "event_vectors", "chunks")


def _tables(s: SparkSession, d: str):
    return {n: table(s, d, n) for n in _TABLES}


def queries():
    return {
        "p2_found": lambda s, d: references.references_found(_tables(s, d)),
        "p2_counts": lambda s, d: references.bad_reference_counts(_tables(s, d)).withColumn("day", F.col("day").cast("string")),
        "p5_found": lambda s, d: sessions.sessions_found(table(s, d, "session_records")),
        "p5_sessions": lambda s, d: sessions.session_sizes(table(s, d, "session_records")),
    }


_BAD = """
    WITH refs AS (
        SELECT 'graph_edges' AS ref_table, 'source' AS ref_field, source AS key,
               source || '|' || target || '|' || relation AS record_key, created_at AS seen_at FROM graph_edges
        UNION ALL SELECT 'graph_edges', 'target', target, source || '|' || target || '|' || relation, created_at FROM graph_edges
        UNION ALL SELECT 'event_vectors', 'event_id', event_id, event_id || '#' || CAST(chunk_seq AS VARCHAR), embedded_at FROM event_vectors
        UNION ALL SELECT 'chunks', 'source_event_id', source_event_id, chunk_id, created_at FROM chunks),
    ranked AS (
        SELECT id, status, mtime, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST) AS r FROM event_index),
    par AS (SELECT id, max(CASE WHEN r = 1 THEN status END) AS status, min(mtime) AS first_seen FROM ranked GROUP BY id),
    bad AS (
        SELECT DISTINCT ref_table, ref_field, record_key,
               CASE WHEN p.id IS NULL THEN 'missing' WHEN p.status = 'deleted' THEN 'deleted' WHEN p.first_seen > seen_at THEN 'late' END AS state,
               CASE WHEN seen_at IS NOT NULL THEN CAST(to_timestamp(floor(seen_at)) AT TIME ZONE 'UTC' AS DATE) END AS day
        FROM refs LEFT JOIN par p ON p.id = key
        WHERE key IS NOT NULL AND key <> '' AND key NOT IN (SELECT id FROM code_entities WHERE id IS NOT NULL))
"""

_JOBS = """
    WITH said AS (
        SELECT record_uuid, session_id, ts, row_number() OVER (PARTITION BY record_uuid ORDER BY arrived_at, ts, session_id) AS r
        FROM session_records
        WHERE type = 'user' AND ts IS NOT NULL AND session_id IS NOT NULL AND regexp_matches(text, '\\S')),
    once AS (SELECT session_id, epoch_us(ts) AS us FROM said WHERE r = 1 OR record_uuid IS NULL),
    marked AS (
        SELECT *, CASE WHEN us - lag(us) OVER w >= 600000000 THEN 1 ELSE 0 END AS opens,
               count(*) OVER (PARTITION BY session_id) AS in_all
        FROM once WINDOW w AS (PARTITION BY session_id ORDER BY us)),
    runs AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM marked),
    jobs AS (
        SELECT session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS message_count
        FROM runs WHERE in_all >= 2 GROUP BY session_id, run)
"""


def oracle_sql():
    return {
        "p2_found": _BAD + "SELECT DISTINCT ref_table, ref_field, record_key, state FROM bad WHERE state IS NOT NULL",
        "p2_counts": _BAD + "SELECT ref_table, ref_field, CAST(day AS VARCHAR) AS day, state, count(*) AS n FROM bad WHERE state IS NOT NULL GROUP BY ALL",
        "p5_found": _JOBS + "SELECT session_id, start_us, end_us, message_count FROM jobs",
        "p5_sessions": _JOBS
        + """SELECT session_id, count(*) AS n_jobs, CAST(sum(message_count) AS BIGINT) AS n_messages, min(start_us) AS first_us,
             max(end_us) AS last_us, CAST(sum(end_us - start_us) AS BIGINT) AS active_us FROM jobs GROUP BY session_id""",
    }
