"""Queries on the event index: filters, layers, windows, aggregates, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import events as E
from lodestrand.operators import slots
from lodestrand.tables import table

# every reading of the index goes through the latest-wins view
_LATEST = """WITH ev AS (
    SELECT * EXCLUDE (r) FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, '-inf'::DOUBLE) DESC, mtime DESC, status DESC, markdown_path DESC) AS r
        FROM event_index) WHERE r = 1) """
_US = "epoch_us(timestamp)"


def _ev(s, d, *columns):
    """The latest-wins view; with columns, only those (and the ones that decide) are read."""
    return E.latest(table(s, d, "event_index"), list(columns) if columns else None)


def _us(df):
    return df.withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp")))


def _cols(df, *names):
    return _us(df).select(*names)


CORE = ["id", "type", "source", "status", "job_id", "us"]
_CORE = f"id, type, source, status, job_id, {_US} AS us"
_META = "json_extract_string(json_cache, '$.metadata.{}')"

QUERIES = {
    "sk3_latest_wins": (
        lambda s, d: _cols(_ev(s, d, "type", "source", "job_id", "timestamp", "date"), *CORE, "updated_at"),
        _LATEST + f"SELECT {_CORE}, updated_at FROM ev",
    ),
    "fl1_filters": (
        lambda s, d: _cols(E.query(_ev(s, d, "type", "source", "job_id", "timestamp", "date"), status="active", source="claude_code", date_from="2026-01-07", date_to="2026-01-20"), *CORE),
        _LATEST + f"SELECT {_CORE} FROM ev WHERE status = 'active' AND source = 'claude_code' AND date BETWEEN '2026-01-07' AND '2026-01-20'",
    ),
    "fl2_newest_page": (
        lambda s, d: _cols(E.newest(E.query(_ev(s, d, "type", "source", "job_id", "timestamp", "date"), status="active"), 100, 10), *CORE),
        _LATEST + f"SELECT {_CORE} FROM ev WHERE status = 'active' ORDER BY timestamp DESC, id LIMIT 100 OFFSET 10",
    ),
    "fl3_count": (
        lambda s, d: E.query(_ev(s, d, "type"), type="decision").agg(F.count("*").alias("n")),
        _LATEST + "SELECT count(*) AS n FROM ev WHERE type = 'decision'",
    ),
    "fl4_by_path": (
        lambda s, d: _cols(_ev(s, d, "type", "source", "job_id", "timestamp", "date").where("markdown_path like 'docs/events/2026/01/05/%'"), "markdown_path", *CORE),
        _LATEST + f"SELECT markdown_path, {_CORE} FROM ev WHERE markdown_path LIKE 'docs/events/2026/01/05/%'",
    ),
    "fl6_types": (
        lambda s, d: _cols(E.newest(_ev(s, d, "type", "source", "job_id", "timestamp", "date").where(F.col("type").isin("decision", "incident")), 50), *CORE),
        _LATEST + f"SELECT {_CORE} FROM ev WHERE type IN ('decision', 'incident') ORDER BY timestamp DESC, id LIMIT 50",
    ),
    "fl7_range": (
        lambda s, d: _us(_ev(s, d, "type", "source", "job_id", "timestamp", "date")).where("us >= 1767787200000000 and us < 1768392000000000").select(*CORE),
        _LATEST + f"SELECT {_CORE} FROM ev WHERE {_US} >= 1767787200000000 AND {_US} < 1768392000000000",
    ),
    "fl8_id_prefixes": (
        lambda s, d: _ev(s, d, "mtime").groupBy(F.substring("id", 1, 6).alias("prefix")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).withColumn("ambiguous", F.col("n") > 1),
        _LATEST + "SELECT substr(id, 1, 6) AS prefix, count(*) AS n, min(id) AS first_id, count(*) > 1 AS ambiguous FROM ev GROUP BY 1",
    ),
    "fl9_like": (
        lambda s, d: _cols(_ev(s, d, "type", "source", "job_id", "timestamp", "date").where("id like 'evt_a%'"), *CORE),
        _LATEST + f"SELECT {_CORE} FROM ev WHERE id LIKE 'evt_a%'",
    ),
    "fl10_logs": (
        lambda s, d: _cols(_last_days(_ev(s, d, "type", "source", "job_id", "timestamp", "date"), 14).where((F.col("status") == "active") & F.col("type").isin("task", "incident", "git_commit") & F.col("job_id").contains("7")), *CORE),
        _LATEST + f"SELECT {_CORE} FROM ev WHERE date > (SELECT max(date) FROM ev) - 14 AND status = 'active' AND type IN ('task', 'incident', 'git_commit') AND contains(job_id, '7')",
    ),
    "fl12_pending_chunks": (
        lambda s, d: table(s, d, "chunks").where("needs_extraction and not extraction_failed").select("chunk_id", "session_id", "created_at").distinct().orderBy("created_at", "chunk_id"),
        "SELECT DISTINCT chunk_id, session_id, created_at FROM chunks WHERE needs_extraction AND NOT extraction_failed",
    ),
    "fl13_fresh_cache": (
        lambda s, d: _ev(s, d, "json_cache", "cache_updated_at").select("id", (F.col("json_cache").isNotNull() & F.coalesce(F.abs(F.col("cache_updated_at") - F.col("mtime")) < 0.001, F.lit(False))).alias("fresh")),
        _LATEST + "SELECT id, json_cache IS NOT NULL AND coalesce(abs(cache_updated_at - mtime) < 0.001, FALSE) AS fresh FROM ev",
    ),
    "fl15_context": (
        lambda s, d: _ev(s, d, "json_cache", "job_id").groupBy(E.context_key(E.metadata("session_id"), F.col("job_id")).alias("context")).agg(F.count("*").alias("n")),
        _LATEST
        + f"""SELECT CASE WHEN nullif({_META.format('session_id')}, '') IS NOT NULL AND nullif(job_id, '') IS NOT NULL THEN 'session=' || {_META.format('session_id')} || ' | job=' || job_id
            WHEN nullif({_META.format('session_id')}, '') IS NOT NULL THEN 'session=' || {_META.format('session_id')}
            WHEN nullif(job_id, '') IS NOT NULL THEN 'job=' || job_id ELSE 'ungrouped' END AS context, count(*) AS n FROM ev GROUP BY 1""",
    ),
    "fl16_author": (
        lambda s, d: _ev(s, d, "source", "type").select("id", F.when(F.col("source") == "manual", "User").otherwise(F.col("source")).alias("author"), F.when(F.col("type").isin("git_commit", "code_change"), "committed").otherwise("recorded").alias("state")),
        _LATEST + "SELECT id, CASE WHEN source = 'manual' THEN 'User' ELSE source END AS author, CASE WHEN type IN ('git_commit', 'code_change') THEN 'committed' ELSE 'recorded' END AS state FROM ev",
    ),
    "fl17_projection": (
        lambda s, d: _ev(s, d, "summary").select(
            F.concat(F.lit("mat_"), "id").alias("material_id"), F.concat(F.lit("clm_"), "id").alias("claim_id"),
            T.clipped(F.trim("summary"), 280).alias("statement"), F.lit("proposed").alias("claim_status"), F.lit("grounded_in").alias("relation"), F.lit("candidate").alias("relation_status"),
        ),
        _LATEST + """SELECT 'mat_' || id AS material_id, 'clm_' || id AS claim_id,
            CASE WHEN length(trim(summary)) <= 280 THEN trim(summary) ELSE substr(trim(summary), 1, 277) || '...' END AS statement,
            'proposed' AS claim_status, 'grounded_in' AS relation, 'candidate' AS relation_status FROM ev""",
    ),
    "fl20_decisions": (
        lambda s, d: _cols(E.newest(_ev(s, d).where((F.col("type") == "decision") & (F.col("date") >= F.lit("2026-01-06").cast("date")) & (F.lower("summary").contains("the") | F.lower("json_cache").contains("the"))), 20), *CORE),
        _LATEST + f"SELECT {_CORE} FROM ev WHERE type = 'decision' AND date >= DATE '2026-01-06' AND (contains(lower(summary), 'the') OR contains(lower(json_cache), 'the')) ORDER BY timestamp DESC, id LIMIT 20",
    ),
    "fl22_hydrated": (
        lambda s, d: _ev(s, d, "json_cache", "summary").select("id", F.coalesce(F.get_json_object("json_cache", "$.summary"), "summary").alias("summary"), F.when(F.col("json_cache").isNull(), "file").otherwise("cache").alias("origin")),
        _LATEST + "SELECT id, coalesce(json_extract_string(json_cache, '$.summary'), summary) AS summary, CASE WHEN json_cache IS NULL THEN 'file' ELSE 'cache' END AS origin FROM ev",
    ),
    "jn1_by_file": (
        lambda s, d: _cols(E.by_file(_ev(s, d), E.file_refs(_ev(s, d)), "pipeline", 100000), "id", "branch"),
        _LATEST
        + f""", refs AS (
            SELECT DISTINCT event_id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM (
                SELECT id AS event_id, regexp_replace(replace({_META.format('module_path')}, '\\', '/'), '/+', '/', 'g') AS path FROM ev
                UNION ALL SELECT id, regexp_replace(replace(markdown_path, '\\', '/'), '/+', '/', 'g') FROM ev) WHERE path <> ''),
        direct AS (SELECT id FROM ev WHERE id IN (SELECT event_id FROM refs WHERE path = 'pipeline' OR path LIKE '%/pipeline' OR name = 'pipeline'))
        SELECT id, 1 AS branch FROM direct
        UNION ALL SELECT id, 2 FROM ev WHERE (contains(json_cache, 'pipeline') OR contains(summary, 'pipeline')) AND id NOT IN (SELECT id FROM direct)""",
    ),
    "jn2_coalesced": (
        lambda s, d: _cols(E.coalesced(_ev(s, d, "source_chunk_id", "source_layer", "timestamp")), "id", "source_chunk_id", "source_layer"),
        _LATEST + """SELECT id, source_chunk_id, source_layer FROM ev e WHERE source_chunk_id IS NULL OR source_layer = 'l2'
            OR (source_layer = 'l1' AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.source_chunk_id = e.source_chunk_id AND x.source_layer = 'l2'))""",
    ),
    "jn3_representative": (
        lambda s, d: _cols(E.representative(_ev(s, d, "source_chunk_id", "source_layer", "type", "timestamp")), "id", "source_chunk_id", "source_layer"),
        _LATEST + """SELECT id, source_chunk_id, source_layer FROM ev e WHERE source_chunk_id IS NOT NULL AND (source_layer = 'l2'
            OR (source_layer = 'l1' AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.source_chunk_id = e.source_chunk_id AND x.type = e.type AND x.source_layer = 'l2')))""",
    ),
    "jn5_not_embedded": (
        lambda s, d: _ev(s, d, "mtime").select("id").join(table(s, d, "event_vectors").where("event_id is not null").select(F.col("event_id").alias("id")), "id", "left_anti"),
        _LATEST + "SELECT id FROM ev WHERE id NOT IN (SELECT event_id FROM event_vectors WHERE event_id IS NOT NULL)",
    ),
    "jn12_decision_context": (
        lambda s, d: _decision_context(_ev(s, d, "type", "date", "timestamp")),
        _LATEST + """SELECT commit_id, decision_id, rank FROM (
            SELECT c.id AS commit_id, x.id AS decision_id, row_number() OVER (PARTITION BY c.id ORDER BY x.timestamp DESC, x.id) AS rank
            FROM ev c JOIN ev x ON x.type = 'decision' AND x.date BETWEEN c.date - 1 AND c.date WHERE c.type = 'git_commit') WHERE rank <= 5""",
    ),
    "jn18_repair_scan": (
        lambda s, d: _repair(s, d),
        _LATEST + """SELECT id, CASE WHEN v.event_id IS NULL AND g.source IS NULL THEN 'both' WHEN v.event_id IS NULL THEN 'missing_vector' ELSE 'missing_graph' END AS issue
            FROM ev LEFT JOIN (SELECT DISTINCT event_id FROM event_vectors) v ON v.event_id = id LEFT JOIN (SELECT DISTINCT source FROM (SELECT source FROM graph_edges UNION ALL SELECT target FROM graph_edges)) g ON g.source = id
            WHERE v.event_id IS NULL OR g.source IS NULL""",
    ),
    "ag1_daily": (
        lambda s, d: _ev(s, d, "date").groupBy(F.col("date").cast("string").alias("day")).agg(F.count("*").alias("n")),
        _LATEST + "SELECT CAST(date AS VARCHAR) AS day, count(*) AS n FROM ev GROUP BY 1",
    ),
    "ag2_by_type": (
        lambda s, d: _ev(s, d, "type").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type"),
        _LATEST + "SELECT type, count(*) AS n FROM ev GROUP BY 1",
    ),
    "ag3_legacy_types": (
        lambda s, d: _ev(s, d, "type").where(F.col("type").isin(LEGACY)).groupBy("type").agg(F.count("*").alias("n")),
        _LATEST + "SELECT type, count(*) AS n FROM ev WHERE type IN ('diagnostic','research','discussion','task','resource','unknown','failed_attempt','abandoned_idea','ai_conversation','reasoning','convention') GROUP BY 1",
    ),
    "ag4_log_stats": (
        lambda s, d: _ev(s, d, "date").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.count_if(F.col("status") == "active").alias("active"), F.max(F.col("date")).cast("string").alias("last_day")),
        _LATEST + "SELECT count(*) AS n, count(DISTINCT date) AS days, count(*) FILTER (status = 'active') AS active, CAST(max(date) AS VARCHAR) AS last_day FROM ev",
    ),
    "ag5_trend": (
        lambda s, d: _last_days(_ev(s, d, "date", "source"), 7).groupBy(F.col("date").cast("string").alias("day"), "source").agg(F.count("*").alias("n")),
        _LATEST + "SELECT CAST(date AS VARCHAR) AS day, source, count(*) AS n FROM ev WHERE date > (SELECT max(date) FROM ev) - 7 GROUP BY ALL",
    ),
    "ag6_tokens": (
        lambda s, d: _tokens(s, d),
        """WITH r AS (SELECT CAST(ts AS DATE) AS day, text FROM session_records WHERE text IS NOT NULL AND ts IS NOT NULL), b AS (SELECT CAST(created_at AS DATE) AS day, text FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL),
            x AS (SELECT * FROM r UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE text <> '')),
            t AS (SELECT day, CASE """ + " ".join(f"WHEN regexp_matches(lower(text), '{rx}') THEN '{n}'" for n, rx in T.MODELS) + """ ELSE 'unknown' END AS model, CAST(trunc(han / 1.5 + (length(text) - han) / 4.0) AS BIGINT) AS n, (SELECT max(day) FROM x) AS last
                FROM (SELECT *, len(regexp_extract_all(text, '[一-鿿]')) AS han FROM x))
            SELECT coalesce(model, 'all') AS model, CAST(coalesce(sum(n) FILTER (day = last), 0) AS BIGINT) AS tokens_day, CAST(coalesce(sum(n) FILTER (day > last - 7), 0) AS BIGINT) AS tokens_week, CAST(coalesce(sum(n) FILTER (day > last - 30), 0) AS BIGINT) AS tokens_month
            FROM t GROUP BY GROUPING SETS ((model), ())""",
    ),
    "ag7_dashboard": (
        lambda s, d: E.dashboard_days(_ev(s, d, "date")).select(F.col("date").cast("string").alias("day"), "n"),
        _LATEST + """, span AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS dd FROM ev)
            SELECT CAST(dd AS VARCHAR) AS day, count(id) AS n FROM span LEFT JOIN ev ON date = dd GROUP BY 1""",
    ),
    "ag7_top_tags": (
        lambda s, d: E.tag_counts(_ev(s, d, "tags")).orderBy(F.desc("n"), "tag").limit(10),
        _LATEST + "SELECT tag, count(*) AS n FROM (SELECT trim(unnest(string_split(tags, ','))) AS tag FROM ev) WHERE tag <> '' GROUP BY 1 ORDER BY n DESC, tag LIMIT 10",
    ),
    "ag8_daily_stats": (
        lambda s, d: E.daily_stats(_ev(s, d, "date", "type", "timestamp", "json_cache", "job_id")).withColumn("date", F.col("date").cast("string")),
        _LATEST
        + f""", e AS (SELECT CAST(date AS VARCHAR) AS date, type, CAST(hour(timestamp) AS VARCHAR) AS hour, nullif({_META.format('session_id')}, '') AS session, nullif(job_id, '') AS job FROM ev)
            SELECT date, 'total' AS kind, '' AS value, count(*) AS n FROM e GROUP BY date
            UNION ALL SELECT date, 'type', type, count(*) FROM e GROUP BY ALL UNION ALL SELECT date, 'hour', hour, count(*) FROM e GROUP BY ALL
            UNION ALL SELECT date, 'session', session, count(*) FROM e WHERE session IS NOT NULL GROUP BY ALL UNION ALL SELECT date, 'job', job, count(*) FROM e WHERE job IS NOT NULL GROUP BY ALL""",
    ),
    "ag11_chunk_states": (
        lambda s, d: table(s, d, "chunks").groupBy("status", "confidence").agg(F.countDistinct("chunk_id").alias("n"), F.max("retry_count").alias("most_retries")),
        "SELECT status, confidence, count(DISTINCT chunk_id) AS n, max(retry_count) AS most_retries FROM chunks GROUP BY 1, 2",
    ),
    "ag12_repair_stats": (
        lambda s, d: _repair(s, d).groupBy("issue").agg(F.count("*").alias("n"), F.min("id").alias("first_id")),
        _LATEST + """SELECT issue, count(*) AS n, min(id) AS first_id FROM (
            SELECT id, CASE WHEN v.event_id IS NULL AND g.source IS NULL THEN 'both' WHEN v.event_id IS NULL THEN 'missing_vector' ELSE 'missing_graph' END AS issue
            FROM ev LEFT JOIN (SELECT DISTINCT event_id FROM event_vectors) v ON v.event_id = id LEFT JOIN (SELECT DISTINCT source FROM (SELECT source FROM graph_edges UNION ALL SELECT target FROM graph_edges)) g ON g.source = id
            WHERE v.event_id IS NULL OR g.source IS NULL) GROUP BY 1""",
    ),
    "ag13_value_stats": (
        lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")),
        "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1",
    ),
    "ag15_duplicate_names": (
        lambda s, d: _duplicates(s, d),
        """WITH e AS (SELECT name, file_path, min(line_start) AS line FROM code_entities WHERE name NOT IN ('__init__', 'main') GROUP BY 1, 2)
           SELECT name, file_path, line FROM e WHERE name IN (SELECT name FROM e GROUP BY 1 HAVING count(*) >= 2)""",
    ),
    "ag16_vector_stats": (
        lambda s, d: table(s, d, "event_vectors").agg(F.count("*").alias("n_rows"), F.countDistinct("event_id", "chunk_seq").alias("n_vectors"), F.countDistinct("event_id").alias("n_events"), F.count_if(F.col("embedding").isNull()).alias("n_null")),
        "SELECT count(*) AS n_rows, count(DISTINCT (event_id, chunk_seq)) AS n_vectors, count(DISTINCT event_id) AS n_events, count(*) FILTER (embedding IS NULL) AS n_null FROM event_vectors",
    ),
    "ag20_shares": (
        lambda s, d: _shares(_ev(s, d, "type")),
        _LATEST + "SELECT type, count(*) AS n, round(100.0 * count(*) / (SELECT greatest(count(*), 1) FROM ev), 6) AS percent FROM ev GROUP BY 1",
    ),
    "wn1_neighbours": (
        lambda s, d: E.neighbours(_ev(s, d, "timestamp"), 3),
        _LATEST + f""", e AS (SELECT id, {_US} AS us FROM ev)
            SELECT id, 'before' AS side, CAST(r AS INTEGER) AS rank, near_id FROM (SELECT a.id, b.id AS near_id, row_number() OVER (PARTITION BY a.id ORDER BY b.us DESC, b.id) AS r FROM e a JOIN e b ON b.us < a.us) WHERE r <= 3
            UNION ALL SELECT id, 'after', CAST(r AS INTEGER), near_id FROM (SELECT a.id, b.id AS near_id, row_number() OVER (PARTITION BY a.id ORDER BY b.us, b.id) AS r FROM e a JOIN e b ON b.us > a.us) WHERE r <= 3""",
    ),
    "wn2_gaps": (
        lambda s, d: E.day_gaps(_ev(s, d, "date", "timestamp")).select(F.col("date").cast("string").alias("day"), "from_us", "to_us", F.round("hours", 6).alias("hours")),
        _LATEST + f"""SELECT CAST(date AS VARCHAR) AS day, before AS from_us, us AS to_us, round((us - before) / 3.6e9, 6) AS hours FROM (
            SELECT date, {_US} AS us, lag({_US}) OVER (PARTITION BY date ORDER BY timestamp) AS before FROM ev) WHERE us - before > 4 * 3600000000""",
    ),
    "wn6_context_changes": (
        lambda s, d: _context_changes(_ev(s, d, "date", "job_id", "timestamp")),
        _LATEST + """SELECT id, CAST(date AS VARCHAR) AS day, job_id FROM (SELECT id, date, job_id, lag(job_id) OVER (PARTITION BY date ORDER BY timestamp, id) AS p FROM ev) WHERE p IS NULL OR p <> job_id""",
    ),
    "wn7_token_chunks": (
        lambda s, d: _char_chunks(s, d),
        """SELECT doc_id, CAST(pos / 2720 AS INTEGER) AS seq, CAST(pos AS INTEGER) AS pos, substr(text, CAST(pos AS INTEGER) + 1, 3200) AS chunk, CAST(length(substr(text, CAST(pos AS INTEGER) + 1, 3200)) // 4 AS INTEGER) AS token_count
           FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(0, ceil((length(text) - 3200) / 2720.0)) AS BIGINT) * 2720, 2720)) AS pos FROM documents)""",
    ),
    "wn9_first_last_text": (
        lambda s, d: _first_last(s, d),
        """WITH t AS (SELECT DISTINCT record_uuid, session_id, type, ts, text FROM session_records WHERE session_id IS NOT NULL AND ts IS NOT NULL AND regexp_matches(text, '\\S') AND type IN ('user', 'assistant'))
           SELECT session_id, substr(arg_min(text, (ts, record_uuid)) FILTER (type = 'user'), 1, 500) AS first_user, substr(arg_max(text, (ts, record_uuid)) FILTER (type = 'assistant'), 1, 1000) AS last_assistant FROM t GROUP BY 1""",
    ),
    "wn10_last_session": (
        lambda s, d: table(s, d, "session_records").where("ts is not null and session_id is not null").groupBy("session_id").agg(F.min("ts").alias("t")).agg(F.max(F.struct("t", "session_id"))["session_id"].alias("session_id")),
        "SELECT arg_max(session_id, (t, session_id)) AS session_id FROM (SELECT session_id, min(ts) AS t FROM session_records WHERE ts IS NOT NULL AND session_id IS NOT NULL GROUP BY 1)",
    ),
    "tk8_top_modules": (
        lambda s, d: _ev(s, d, "json_cache").select(F.element_at(F.split(E.metadata("module_path"), "/"), 1).alias("module")).where("module is not null").groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(10),
        _LATEST + f"SELECT string_split({_META.format('module_path')}, '/')[1] AS module, count(*) AS n FROM ev WHERE {_META.format('module_path')} IS NOT NULL GROUP BY 1 ORDER BY n DESC, module LIMIT 10",
    ),
    "st2_file_refs": (
        lambda s, d: E.file_refs(_ev(s, d, "json_cache")),
        _LATEST + f"""SELECT DISTINCT event_id, file_path, regexp_extract(file_path, '([^/]*)$', 1) AS file_name FROM (
            SELECT id AS event_id, regexp_replace(replace({_META.format('module_path')}, '\\', '/'), '/+', '/', 'g') AS file_path FROM ev
            UNION ALL SELECT id, regexp_replace(replace(markdown_path, '\\', '/'), '/+', '/', 'g') FROM ev) WHERE file_path <> ''""",
    ),
    "sc14_sessions": (
        lambda s, d: _sessions(s, d),
        """WITH t AS (SELECT session_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, min(slug) AS slug, min(git_branch) AS branch, count(*) AS n FROM session_records WHERE session_id IS NOT NULL GROUP BY 1)
           SELECT session_id, first_us, last_us, slug, branch, n FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n DESC, session_id) AS r FROM t WHERE first_us <= 1768435200000000 + 300000000 AND last_us >= 1767830400000000 - 3600000000) WHERE slug IS NULL OR r = 1""",
    ),
    "sc15_records": (
        lambda s, d: _us(table(s, d, "session_records").withColumn("timestamp", F.col("ts"))).where(F.col("type").isin("user", "assistant") & (F.col("ts").isNull() | F.col("us").between(1767830400000000, 1768435200000000))).groupBy("type").agg(F.count("*").alias("n"), F.min("us").alias("first_us")),
        "SELECT type, count(*) AS n, min(epoch_us(ts)) AS first_us FROM session_records WHERE type IN ('user', 'assistant') AND (ts IS NULL OR epoch_us(ts) BETWEEN 1767830400000000 AND 1768435200000000) GROUP BY 1",
    ),
    "jn21_overlaps": (
        lambda s, d: _overlaps(s, d),
        """WITH j AS (SELECT DISTINCT session_id, epoch_us(start_ts) AS a, epoch_us(coalesce(end_ts, start_ts)) AS z FROM detected_jobs)
           SELECT x.session_id, x.a AS start_us, count(*) AS n FROM j x JOIN j y ON x.a <= y.z AND y.a <= x.z AND (x.session_id, x.a) <> (y.session_id, y.a) GROUP BY 1, 2""",
    ),
    "jn22_open_jobs": (
        lambda s, d: table(s, d, "detected_jobs").where("end_ts is null").select("session_id", F.unix_micros(F.col("start_ts").cast("timestamp")).alias("start_us")).distinct().join(
            table(s, d, "detected_jobs").where("end_ts is not null").select("session_id", F.unix_micros(F.col("start_ts").cast("timestamp")).alias("start_us")), ["session_id", "start_us"], "left_anti"),
        "SELECT DISTINCT session_id, epoch_us(start_ts) AS start_us FROM detected_jobs a WHERE end_ts IS NULL AND NOT EXISTS (SELECT 1 FROM detected_jobs b WHERE b.end_ts IS NOT NULL AND b.session_id = a.session_id AND b.start_ts = a.start_ts)",
    ),
}

# fixed values: the older event types that may still be written
LEGACY = ["diagnostic", "research", "discussion", "task", "resource", "unknown", "failed_attempt", "abandoned_idea", "ai_conversation", "reasoning", "convention"]


def _decision_context(ev):
    """The five newest decisions of the day and the day before, per commit: equi-join on the exploded days.

    Only five decisions of a day can be among a commit's five, so each day is cut to its
    newest five before the join; a busy day never meets its commits whole.
    """
    from pyspark.sql import Window

    c = ev.where("type = 'git_commit'").select(F.col("id").alias("commit_id"), F.explode(F.array("date", F.date_sub("date", 1))).alias("date"))
    day = Window.partitionBy("date").orderBy(F.desc("timestamp"), "id")
    x = ev.where("type = 'decision'").select(F.col("id").alias("decision_id"), "id", "date", "timestamp")
    x = x.withColumn("r", F.row_number().over(day)).where("r <= 5").select("decision_id", "date", "timestamp")
    w = Window.partitionBy("commit_id").orderBy(F.desc("timestamp"), "decision_id")
    return c.join(x, "date").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("commit_id", "decision_id", F.col("rank").cast("long").alias("rank"))


def _repair(s, d):
    ev = _ev(s, d, "mtime").select("id")
    vec = table(s, d, "event_vectors").select(F.col("event_id").alias("id")).distinct().withColumn("v", F.lit(True))
    g = table(s, d, "graph_edges")
    ends = g.select(F.col("source").alias("id")).union(g.select("target")).distinct().withColumn("g", F.lit(True))
    both = ev.join(vec, "id", "left").join(ends, "id", "left").where("v is null or g is null")
    return both.select("id", F.when(F.col("v").isNull() & F.col("g").isNull(), "both").when(F.col("v").isNull(), "missing_vector").otherwise("missing_graph").alias("issue"))


def _last_days(ev, days):
    """Rows of the last ``days`` days, counted from the newest row."""
    last = ev.agg(F.max("date").alias("_last"))  # one row
    return ev.join(F.broadcast(last)).where(F.col("date") > F.date_sub("_last", days)).drop("_last")


def _tokens(s, d):
    """Tokens of the last day, week and month, by model and in all; of the documents where no session says anything."""
    r = table(s, d, "session_records").where("text is not null and ts is not null").select(F.to_date("ts").alias("day"), "text")
    b = table(s, d, "documents").where("text is not null and created_at is not null").select(F.to_date("created_at").alias("day"), "text")
    some = r.where("text <> ''").agg((F.count("*") > 0).alias("some"))  # one row
    x = r.unionByName(b.join(F.broadcast(some)).where("not some").drop("some"))
    last = x.agg(F.max("day").alias("last"))  # one row
    t = x.join(F.broadcast(last)).select("day", "last", F.coalesce(T.model_of(F.col("text")), F.lit("unknown")).alias("model"), T.estimate_tokens(F.col("text")).cast("long").alias("n"))
    since = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    sums = [since(F.col("day") == F.col("last")).alias("tokens_day"), since(F.col("day") > F.date_sub("last", 7)).alias("tokens_week"), since(F.col("day") > F.date_sub("last", 30)).alias("tokens_month")]
    return t.groupingSets([["model"], []], "model").agg(*sums).withColumn("model", F.coalesce("model", F.lit("all")))


def _duplicates(s, d):
    """Where names stand that are defined in two files or more, but for names that may be."""
    e = table(s, d, "code_entities").where(~F.col("name").isin("__init__", "main")).groupBy("name", "file_path").agg(F.min("line_start").alias("line"))
    return e.join(e.groupBy("name").agg(F.count("*").alias("n")).where("n >= 2").select("name"), "name", "left_semi")


def _shares(ev):
    from pyspark.sql import Window

    n = ev.groupBy("type").agg(F.count("*").alias("n"))  # one row a type
    total = F.greatest(F.sum("n").over(Window.partitionBy(F.lit(0))), F.lit(1))
    return n.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / total, 6))


def _context_changes(ev):
    x = ev.select("id", "date", "job_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"))
    return slots.changed_rows(x, ["date"], "us", "id", "job_id").select("id", F.col("date").cast("string").alias("day"), "job_id")


def _char_chunks(s, d, size: int = 3200, step: int = 2720):
    t = table(s, d, "documents").select("doc_id", "text")
    last = F.greatest(F.lit(0), F.ceil((F.char_length("text") - size) / F.lit(float(step)))).cast("int") * step
    t = t.withColumn("pos", F.explode(F.sequence(F.lit(0), last, F.lit(step))))
    chunk = F.substring(F.col("text"), F.col("pos") + 1, F.lit(size))
    return t.select("doc_id", (F.col("pos") / step).cast("int").alias("seq"), "pos", chunk.alias("chunk"), F.floor(F.char_length(chunk) / 4).cast("int").alias("token_count"))


def _first_last(s, d):
    r = table(s, d, "session_records").where("session_id is not null and ts is not null").where(F.col("type").isin("user", "assistant") & F.col("text").rlike(r"\S"))
    key = F.struct("ts", "record_uuid")
    said = lambda kind: F.when(F.col("type") == kind, key)
    return r.groupBy("session_id").agg(
        F.substring(F.min_by("text", said("user")), 1, 500).alias("first_user"),
        F.substring(F.max_by("text", said("assistant")), 1, 1000).alias("last_assistant"),
    )


def _sessions(s, d):
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = table(s, d, "session_records").where("session_id is not null").groupBy("session_id").agg(
        F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.min("slug").alias("slug"), F.min("git_branch").alias("branch"), F.count("*").alias("n"))
    t = t.where("first_us <= 1768435200000000 + 300000000 and last_us >= 1767830400000000 - 3600000000")
    best = t.where("slug is not null").groupBy("slug").agg(F.min(F.struct((-F.col("n")).alias("m"), "session_id")).alias("b")).select(F.col("b.session_id").alias("session_id"))
    return t.where("slug is null").unionByName(t.where("slug is not null").join(best, "session_id", "left_semi"))


def _overlaps(s, d):
    """Jobs that overlap each other, counted without pairing: starts before my end less ends before my start.

    Both counts are ranks in one order of all bounds; the order is kept per hour with the sums
    of the hours before, so no task holds more than an hour's bounds.
    """
    from pyspark.sql import Window

    j = table(s, d, "detected_jobs").select("session_id", F.unix_micros(F.col("start_ts").cast("timestamp")).alias("a"), F.unix_micros(F.coalesce("end_ts", "start_ts").cast("timestamp")).alias("z")).distinct()
    at = lambda c, kind: j.select("session_id", "a", F.col(c).alias("t"), F.lit(kind).alias("kind"))
    b = at("a", 0).unionByName(at("z", 1)).withColumn("h", F.floor(F.col("t") / 3_600_000_000))
    hours = b.groupBy("h").agg(F.sum(1 - F.col("kind")).alias("s"), F.sum("kind").alias("e"))
    wh = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)  # one row an hour
    hours = hours.select("h", F.coalesce(F.sum("s").over(wh), F.lit(0)).alias("s0"), F.coalesce(F.sum("e").over(wh), F.lit(0)).alias("e0"))
    upto = Window.partitionBy("h").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("h").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    r = b.withColumn("started", F.sum(1 - F.col("kind")).over(upto)).withColumn("ended", F.coalesce(F.sum("kind").over(below), F.lit(0))).join(hours, "h")
    r = r.groupBy("session_id", "a").agg(F.max(F.when(F.col("kind") == 1, F.col("started") + F.col("s0"))).alias("started"), F.max(F.when(F.col("kind") == 0, F.col("ended") + F.col("e0"))).alias("ended"))
    return r.select("session_id", F.col("a").alias("start_us"), (F.col("started") - F.col("ended") - 1).alias("n")).where("n > 0")


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
