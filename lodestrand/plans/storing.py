"""Queries on keyed storage, code facts and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import code as C
from lodestrand.operators import storage as K
from lodestrand.plans.graphs import _merged_sql
from lodestrand.plans.timeline import _LATEST, _ev
from lodestrand.tables import table


def _log(s, d):
    """The chunks read as a write-ahead log: a pending entry each, a completed or failed one where they got there."""
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"])
    entry = lambda kind, at: F.struct(F.lit(kind).alias("event_type"), F.col(at).alias("timestamp"))
    e = F.array(entry("pending", "created_at"), F.when(F.col("extraction_failed"), entry("failed", "updated_at")), F.when(F.col("status") == "extracted", entry("completed", "updated_at")))
    c = c.select("chunk_id", "retry_count", F.explode(F.filter(e, lambda x: x.isNotNull())).alias("e"))
    return c.select(F.col("chunk_id").alias("id"), "e.timestamp", "e.event_type", "retry_count")


_LOG = """WITH c AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at) AS r FROM chunks) WHERE r = 1),
    log AS (SELECT chunk_id AS id, created_at AS timestamp, 'pending' AS event_type, retry_count FROM c
        UNION ALL SELECT chunk_id, updated_at, 'failed', retry_count FROM c WHERE extraction_failed
        UNION ALL SELECT chunk_id, updated_at, 'completed', retry_count FROM c WHERE status = 'extracted') """


def _changes(s, d):
    ev = table(s, d, "events")
    to = F.element_at(F.array(F.lit("embedded"), F.lit("extracted"), F.lit("raw")), (F.col("event_id") % 3 + 1).cast("int"))
    return ev.select(F.col("user_id").cast("string").alias("chunk_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), to.alias("to"))


def _enclosing(s, d):
    """Each call of a file with the first definition whose lines hold it: equi-join on the file, then the interval."""
    f = table(s, d, "code_entities").where("line_end is not null and type in ('function', 'method')").select("id", "file_path", "line_start", "line_end").distinct()
    calls = C.facts(table(s, d, "raw_data").where("source = 'file'")).where("kind = 'call'").select("file_path", "line", "name").distinct()
    j = calls.join(f, "file_path").where("line between line_start and line_end")
    return j.groupBy("file_path", "line", "name").agg(F.min(F.struct("line_start", "id"))["id"].alias("symbol"))


def _files(s, d):
    return table(s, d, "raw_data").where("source = 'file'").dropDuplicates(["id"])


def _impacted(s, d):
    """Symbols that the changes of modified entities meet: every line of an entity a commit modifies is changed."""
    e = table(s, d, "code_entities").where("line_end is not null").select("id", "file_path", "line_start", F.col("line_end").cast("int").alias("line_end")).distinct()
    mod = table(s, d, "graph_edges").where("relation = 'modifies'").select(F.col("target").alias("id")).distinct()
    lines = e.join(mod, "id", "left_semi").where("line_end >= line_start").select("file_path", F.explode(F.sequence("line_start", "line_end")).alias("line"))
    return C.impacted(e, lines)


def _code_refs(s, d):
    files = table(s, d, "code_entities").select("file_path").distinct()
    names = files.select("file_path", F.explode(T.module_names(F.col("file_path"))).alias("module"))
    symbols = table(s, d, "code_entities").where("type in ('function', 'method')").select(F.element_at(F.split("name", r"\."), -1).alias("name"), "file_path")
    return C.references(C.facts(_files(s, d)), names, symbols)


_QV = [round((i * 0.37) % 1.0 - 0.5, 6) for i in range(64)]


def _hydrated(s, d):
    """The events of the 300 best chunk hits for a fixed vector, each at its best place, with what is shown of it."""
    from pyspark.sql import Window

    v = table(s, d, "event_vectors").where((F.size("embedding") == 64) & (F.col("event_id") != ""))
    v = v.select("event_id", "chunk_seq", "chunk_text", T.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in _QV])).alias("c")).where("c is not null").distinct()
    top = v.orderBy(F.desc("c"), "event_id", "chunk_seq", "chunk_text").limit(300)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("c"), "event_id", "chunk_seq", "chunk_text")))  # 300 rows
    best = top.groupBy("event_id").agg(F.min(F.struct("place", "chunk_text")).alias("b")).select("event_id", "b.place", "b.chunk_text")
    j = best.join(_ev(s, d, "type", "json_cache").select(F.col("id").alias("event_id"), "type", "json_cache"), "event_id", "left")
    origin = F.when(F.col("json_cache").isNotNull(), "cache").when(F.col("chunk_text").isNotNull(), "chunk").otherwise("stub")
    shown = F.coalesce("json_cache", "chunk_text", F.concat(F.lit("stub "), "event_id"))
    return j.select("event_id", F.col("place").cast("long").alias("place"), origin.alias("origin"), F.coalesce("type", F.lit("unknown")).alias("type"), F.md5(shown).alias("digest"))


def _synced(s, d):
    """The index against its own files: a file's text is the cached record behind its frontmatter, where there is one."""
    ix = table(s, d, "event_index")
    found = ix.where("markdown_path is not null and status <> 'deleted'").select(F.col("markdown_path").alias("path"), "mtime", F.when(F.col("json_cache").isNotNull(), F.concat(F.lit("---\n"), "json_cache")).otherwise(F.lit("")).alias("text"))
    stored = ix.where("markdown_path is not null and cache_updated_at is not null").select(F.col("markdown_path").alias("path"), F.when(F.col("source_layer") == "l2", F.col("mtime")).otherwise(F.col("cache_updated_at")).alias("mtime"))
    return K.sync_status(found, stored)


def _log_records(s, d):
    """What a path tells of a log record: five parts with ``jobs`` end a job, three end a session; one row a path, the latest wins."""
    parts = F.split(F.regexp_replace("markdown_path", "^docs/events/", ""), "/")
    r = _ev(s, d, "date", "job_id", "type").select("markdown_path", "date", "type", F.nullif("job_id", F.lit("")).alias("job_id"), "updated_at", F.size(parts).alias("n"))
    kind = F.when((F.col("n") == 5) & F.col("markdown_path").contains("/jobs/"), "job-end").when(F.col("n") == 3, "session-end").when(F.col("n") == 4, "event").otherwise("other")
    return r.groupBy("markdown_path").agg(F.max_by(F.struct("date", kind.alias("kind"), "job_id"), F.struct(F.coalesce("updated_at", F.lit(float("-inf"))), "type")).alias("r")).select("markdown_path", F.col("r.date").cast("string").alias("day"), "r.kind", "r.job_id")


def _views(s, d):
    """Job and session ends as a hot list of the last seven days and an archive, newest first, then by job."""
    from pyspark.sql import Window

    r = _ev(s, d, "date", "type", "job_id").where("type in ('task', 'incident')").select("id", "date", F.coalesce("job_id", F.lit("")).alias("job_id"))
    last = r.agg(F.max("date").alias("last"))  # one row
    r = r.join(F.broadcast(last)).withColumn("view", F.when(F.col("date") >= F.date_sub("last", 7), "hot").otherwise("archive"))
    # a day is a slot: places inside it, and the days before it
    day = r.groupBy("view", "date").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("view").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("view", "date").orderBy("job_id", "id"))
    return r.withColumn("r", inside).join(day.select("view", "date", "before"), ["view", "date"]).select("view", "id", (F.col("before") + F.col("r")).alias("place"))


def _jsonld(s, d):
    g = table(s, d, "graph_edges").where("relation is not null and target is not null")
    return K.jsonld(_ev(s, d, "type").select("id", "type"), g)


def _migrated(s, d):
    r = _ev(s, d, "schema_version", "timestamp", "date", "type", "summary", "json_cache").select(
        "id", F.when(F.col("schema_version") > 1, F.col("schema_version")).alias("version"), F.when(F.col("schema_version") > 1, F.col("timestamp")).alias("timestamp"), "date",
        F.regexp_replace("type", "_", "-").alias("type"), F.col("summary").alias("description"), F.concat(F.lit("# "), "type", F.lit("\n"), F.coalesce("json_cache", F.lit(""))).alias("content"),
    )
    return K.migrated(r).select("id", "version", "type", F.md5("content").alias("digest"))


# what is written behind each Python file, so that every rule has a finding there
_BEHIND = "\n\ndef one():\n    try:\n        pass\n    except:\n        pass\n\n\nasync def two():\n    \"\"\"Nothing.\"\"\"\n    ...\n\n\ndef three():\n    try:\n        go()\n    except Exception:\n        raise\n"
_SMELLS = r"""WITH f AS (SELECT unnest(m) AS file_path, len(regexp_split_to_array(content, '\r\n|\n|\r')) AS n FROM (SELECT id, any_value(content) AS content, any_value(files_mentioned) AS m FROM raw_data WHERE source = 'file' AND content IS NOT NULL GROUP BY id)),
    x AS (SELECT file_path, unnest(['bare_except', 'swallowed_error', 'empty_function', 'broad_catch']) AS rule, unnest(['P0', 'P0', 'P2', 'P1']) AS severity, CAST(n + unnest([5, 5, 9, 17]) AS INTEGER) AS line FROM f WHERE file_path LIKE '%.py')"""


def _smelly(s, d):
    return _files(s, d).where("content is not null").select("files_mentioned", F.concat("content", F.lit(_BEHIND)).alias("content"))


QUERIES = {
    "sk4_absent_events": (
        lambda s, d: K.insert_absent(table(s, d, "event_index").select("id"), table(s, d, "event_vectors").where("event_id is not null").select(F.col("event_id").alias("id")), ["id"]),
        "SELECT DISTINCT event_id AS id FROM event_vectors WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT id FROM event_index WHERE id IS NOT NULL)",
    ),
    "sk5_removed": (
        lambda s, d: K.delete_where(_ev(s, d, "status").select("id", "status"), _ev(s, d, "status").where("status = 'deleted'").select("id"), ["id"]),
        _LATEST + "SELECT id, status FROM ev WHERE status <> 'deleted'",
    ),
    "sk6_layer_deletes": (
        lambda s, d: K.removed_rows(*_layers(s, d))[1],
        _LATEST + """, gone AS (SELECT DISTINCT chunk_id FROM chunks WHERE extraction_failed OR status = 'extracted') SELECT source_chunk_id, source_layer, count(*) AS n FROM ev WHERE source_layer = 'l2' AND source_chunk_id IN (SELECT chunk_id FROM gone) GROUP BY 1, 2""",
    ),
    "sk6_layer_kept": (
        lambda s, d: K.removed_rows(*_layers(s, d))[0],
        _LATEST + """, gone AS (SELECT DISTINCT chunk_id FROM chunks WHERE extraction_failed OR status = 'extracted') SELECT id, source_chunk_id, source_layer FROM ev WHERE NOT coalesce(source_layer = 'l2' AND source_chunk_id IN (SELECT chunk_id FROM gone), FALSE)""",
    ),
    "sk7_merged_links": (
        lambda s, d: K.merge_links(table(s, d, "graph_edges"), table(s, d, "event_index").select("id")),
        _merged_sql("(SELECT * FROM graph_edges WHERE source IN (SELECT id FROM event_index WHERE id IS NOT NULL))", ""),
    ),
    "sk11_vector_upsert": (
        lambda s, d: K.upsert(_vec(s, d).where("chunk_pos < 700"), _vec(s, d).where("chunk_pos >= 0"), ["event_id", "chunk_seq"], "embedded_at"),
        "SELECT event_id, chunk_seq, arg_max(chunk_pos, embedded_at) AS chunk_pos, max(embedded_at) AS embedded_at FROM event_vectors GROUP BY 1, 2",
    ),
    "sk13_new_chunks": (
        lambda s, d: K.insert_absent(table(s, d, "event_index").select(F.col("source_chunk_id").alias("chunk_id")), table(s, d, "chunks").select("chunk_id"), ["chunk_id"]),
        "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT source_chunk_id FROM event_index WHERE source_chunk_id IS NOT NULL)",
    ),
    "sk15_recovered": (
        lambda s, d: K.recover(_log(s, d)).select("id", "timestamp"),
        _LOG + "SELECT id, max(timestamp) AS timestamp FROM log WHERE event_type = 'pending' AND id NOT IN (SELECT id FROM log WHERE event_type IN ('completed', 'failed')) GROUP BY 1",
    ),
    "sk16_compacted": (
        lambda s, d: K.compact(_log(s, d)).select("id", "event_type", "timestamp"),
        _LOG + """SELECT id, event_type, timestamp FROM log WHERE event_type = 'pending' AND id NOT IN (SELECT id FROM log WHERE event_type = 'completed')
            UNION ALL SELECT id, 'failed', max(timestamp) FROM log WHERE event_type = 'failed' GROUP BY 1""",
    ),
    "sk17_log_stats": (lambda s, d: K.log_stats(_log(s, d)), _LOG + "SELECT event_type, count(*) AS n FROM log GROUP BY 1"),
    "sk19_sync": (
        _synced,
        """WITH f AS (SELECT markdown_path AS path, max((mtime, CASE WHEN json_cache IS NOT NULL THEN '---' ELSE '' END)) AS f FROM event_index WHERE markdown_path IS NOT NULL AND status <> 'deleted' GROUP BY 1),
           o AS (SELECT markdown_path AS path, max(CASE WHEN source_layer = 'l2' THEN mtime ELSE cache_updated_at END) AS o FROM event_index WHERE markdown_path IS NOT NULL AND cache_updated_at IS NOT NULL GROUP BY 1)
           SELECT path, CASE WHEN f IS NULL THEN 'removed' WHEN abs(f[1] - o) < 0.001 THEN 'skipped' WHEN f[2] <> '---' THEN 'error' WHEN o IS NULL THEN 'added' ELSE 'updated' END AS state FROM f FULL JOIN o USING (path)""",
    ),
    "sk21_log_records": (
        _log_records,
        _LATEST + """, p AS (SELECT *, string_split(regexp_replace(markdown_path, '^docs/events/', ''), '/') AS parts FROM ev),
            k AS (SELECT markdown_path, date, nullif(job_id, '') AS job_id, updated_at, type, CASE WHEN len(parts) = 5 AND contains(markdown_path, '/jobs/') THEN 'job-end' WHEN len(parts) = 3 THEN 'session-end' WHEN len(parts) = 4 THEN 'event' ELSE 'other' END AS kind FROM p)
            SELECT markdown_path, CAST(date AS VARCHAR) AS day, kind, job_id FROM (SELECT *, row_number() OVER (PARTITION BY markdown_path ORDER BY coalesce(updated_at, '-inf'::DOUBLE) DESC, type DESC) AS r FROM k) WHERE r = 1""",
    ),
    "sk22_hot_archive": (
        _views,
        _LATEST + """, r AS (SELECT id, date, coalesce(job_id, '') AS job_id FROM ev WHERE type IN ('task', 'incident')), v AS (SELECT *, CASE WHEN date >= (SELECT max(date) FROM r) - 7 THEN 'hot' ELSE 'archive' END AS view FROM r)
            SELECT view, id, row_number() OVER (PARTITION BY view ORDER BY date DESC, job_id, id) AS place FROM v""",
    ),
    "sk23_jsonld": (
        _jsonld,
        _LATEST + """, t AS (SELECT source, relation, list(DISTINCT target ORDER BY target) AS targets FROM graph_edges WHERE relation IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2),
            l AS (SELECT source, string_agg('"' || relation || '":' || to_json(targets)::VARCHAR, ',' ORDER BY relation) AS links FROM t GROUP BY 1)
            SELECT id, '{"@id":"dev://event/' || id || '","@type":"' || type || '"' || coalesce(',"links":{' || links || '}', '') || '}' AS doc FROM ev LEFT JOIN l ON l.source = id""",
    ),
    "sk24_cache_backfill": (
        lambda s, d: _backfill(s, d),
        _LATEST + r"""SELECT DISTINCT id, CASE WHEN cache_updated_at IS NULL THEN 'cache_time' ELSE 'refs' END AS missing, regexp_replace(replace(json_extract_string(json_cache, '$.metadata.module_path'), '\', '/'), '/+', '/', 'g') AS file_path
            FROM ev WHERE json_cache IS NOT NULL AND (cache_updated_at IS NULL OR (json_extract_string(json_cache, '$.metadata.module_path') <> '' AND id NOT IN (SELECT source FROM graph_edges WHERE source IS NOT NULL)))""",
    ),
    "sk26_nodes": (
        lambda s, d: _ev(s, d, "type", "timestamp", "summary").select("id", "type", F.substring("summary", 1, 100).alias("label"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us")),
        _LATEST + "SELECT id, type, substr(summary, 1, 100) AS label, epoch_us(timestamp) AS us FROM ev",
    ),
    "sk26_edges": (
        lambda s, d: _linked(s, d),
        _LATEST + """, l AS (SELECT DISTINCT source_event_id AS source, unnest(from_json(event_ids, '["VARCHAR"]')) AS target FROM chunks WHERE source_event_id <> '')
            SELECT l.source, l.target, a.type AS source_type, coalesce(b.type, 'unknown') AS target_type FROM l JOIN ev a ON a.id = l.source LEFT JOIN ev b ON b.id = l.target""",
    ),
    "sk27_migrated": (
        _migrated,
        _LATEST + r"""SELECT id, CASE WHEN schema_version > 2 THEN schema_version ELSE 2 END AS version, CASE WHEN schema_version > 1 THEN replace(type, '_', '-') ELSE type END AS type,
            md5(CASE WHEN schema_version > 1 OR coalesce(summary, '') = '' OR contains('# ' || type || chr(10) || coalesce(json_cache, ''), summary) THEN '# ' || type || chr(10) || coalesce(json_cache, '')
                ELSE '# ' || type || chr(10) || chr(10) || summary || chr(10) || coalesce(json_cache, '') END) AS digest FROM ev""",
    ),
    "sk27_versions": (
        lambda s, d: _ev(s, d, "schema_version", "source_chunk_id", "timestamp", "date").select("id", K.schema_version(F.when(F.col("schema_version") > 1, F.col("schema_version")), F.col("source_chunk_id"), F.col("timestamp"), F.col("date")).alias("version")),
        _LATEST + "SELECT id, CASE WHEN schema_version > 1 THEN schema_version WHEN source_chunk_id IS NOT NULL AND timestamp IS NOT NULL THEN 2 WHEN date IS NOT NULL THEN 1 ELSE 0 END AS version FROM ev",
    ),
    "stm7_chunk_states": (
        lambda s, d: K.fold_chunk_states(_changes(s, d)),
        """WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS chunk_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
           f AS (SELECT chunk_id, 0::BIGINT AS n, 0 AS s, 0 AS bad FROM (SELECT DISTINCT chunk_id FROM c)
               UNION ALL SELECT f.chunk_id, c.n, CASE WHEN c.r = s + 1 THEN s + 1 ELSE s END, CASE WHEN c.r = s + 1 THEN bad ELSE bad + 1 END FROM f JOIN c ON c.chunk_id = f.chunk_id AND c.n = f.n + 1)
           SELECT chunk_id, CASE s WHEN 0 THEN 'raw' WHEN 1 THEN 'embedded' ELSE 'extracted' END AS state, s < 2 AS needs_extraction, bad AS n_rejected
           FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC) AS last FROM f) WHERE last = 1""",
    ),
    "jn15_code_refs": (_code_refs, None),
    "jn16_enclosing_symbol": (_enclosing, None),
    "jn17_impacted_symbols": (
        _impacted,
        """WITH e AS (SELECT DISTINCT id, file_path, line_start, line_end FROM code_entities WHERE line_end IS NOT NULL AND line_end >= line_start),
           c AS (SELECT * FROM e WHERE id IN (SELECT target FROM graph_edges WHERE relation = 'modifies'))
           SELECT DISTINCT e.id FROM e JOIN c USING (file_path) WHERE c.line_start <= e.line_end AND c.line_end >= e.line_start""",
    ),
    "jn20_hydrated_hits": (
        _hydrated,
        _LATEST + f""", v AS (SELECT DISTINCT event_id, chunk_seq, chunk_text, list_cosine_similarity(embedding::DOUBLE[], {_QV}::DOUBLE[]) AS c FROM event_vectors WHERE len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND event_id <> ''),
            t AS (SELECT *, row_number() OVER (ORDER BY c DESC, event_id, chunk_seq, chunk_text NULLS FIRST) AS place FROM v ORDER BY place LIMIT 300),
            b AS (SELECT event_id, min(place) AS place, arg_min(coalesce(chunk_text, chr(1)), place) AS chunk_text FROM t GROUP BY 1)
            SELECT event_id, place, CASE WHEN json_cache IS NOT NULL THEN 'cache' WHEN chunk_text <> chr(1) THEN 'chunk' ELSE 'stub' END AS origin, coalesce(type, 'unknown') AS type, md5(coalesce(json_cache, nullif(chunk_text, chr(1)), 'stub ' || event_id)) AS digest
            FROM b LEFT JOIN ev ON ev.id = event_id""",
    ),
    "tx22_code_smells": (lambda s, d: C.smells(_smelly(s, d)), _SMELLS + " SELECT file_path, rule, severity, line FROM x"),
    "tk6_by_severity": (
        lambda s, d: C.smells(_smelly(s, d)).select(F.substring("severity", 2, 1).cast("int").alias("rank"), "rule", "file_path", "line").orderBy("rank", "file_path", "line", "rule").limit(100),
        _SMELLS + " SELECT CAST(substr(severity, 2, 1) AS INTEGER) AS rank, rule, file_path, line FROM x ORDER BY rank, file_path, line, rule LIMIT 100",
    ),
    "id_hashes": (
        lambda s, d: table(s, d, "chunks").where("content is not null").select("chunk_id", F.concat(F.lit("chk_"), F.substring(F.sha2(F.concat_ws(":", "source_event_id", F.substring("content", 1, 64)), 256), 1, 16)).alias("derived")).distinct(),
        "SELECT DISTINCT chunk_id, 'chk_' || substr(sha256(concat_ws(':', source_event_id, substr(content, 1, 64))), 1, 16) AS derived FROM chunks WHERE content IS NOT NULL",
    ),
}


def _vec(s, d):
    return table(s, d, "event_vectors").select("event_id", "chunk_seq", "chunk_pos", "embedded_at")


def _layers(s, d):
    """The index's layers, and the second layers of the chunks that were or are to be extracted anew."""
    rows = _ev(s, d, "source_chunk_id", "source_layer").select("id", "source_chunk_id", "source_layer")
    gone = table(s, d, "chunks").where("extraction_failed or status = 'extracted'").select(F.col("chunk_id").alias("source_chunk_id"), F.lit("l2").alias("source_layer"))
    return rows, gone, ["source_chunk_id", "source_layer"]


def _backfill(s, d):
    """Records with a cached text but without what is derived from it: the time of the cache, or references."""
    ev = _ev(s, d, "json_cache", "cache_updated_at").where("json_cache is not null")
    linked = table(s, d, "graph_edges").where("source is not null").select(F.col("source").alias("id")).distinct().withColumn("has", F.lit(True))
    path = T.normal_path(F.get_json_object("json_cache", "$.metadata.module_path"))
    j = ev.join(linked, "id", "left").withColumn("file_path", path)
    bare = F.col("cache_updated_at").isNull()
    return j.where(bare | ((F.col("file_path") != "") & F.col("has").isNull())).select("id", F.when(bare, "cache_time").otherwise("refs").alias("missing"), "file_path").distinct()


def _linked(s, d):
    """The links of chunks joined with the events at their ends: an unknown target stays, an unknown source doesn't."""
    l = table(s, d, "chunks").where("source_event_id <> ''").select(F.col("source_event_id").alias("source"), F.explode(F.from_json("event_ids", "array<string>")).alias("target")).distinct()
    ev = _ev(s, d, "type")
    j = l.join(ev.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source").join(ev.select(F.col("id").alias("target"), F.col("type").alias("t")), "target", "left")
    return j.select("source", "target", "source_type", F.coalesce("t", F.lit("unknown")).alias("target_type"))


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
