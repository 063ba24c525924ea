"""Queries on links, tasks, retries, anchors and marks in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import events as E
from lodestrand.operators import graph as G
from lodestrand.operators import slots
from lodestrand.plans.graphs import _cycle_sql
from lodestrand.plans.timeline import _LATEST, _ev
from lodestrand.tables import table

_ANCHORS = """a AS (SELECT id, unnest([ 'session:' || json_extract_string(json_cache, '$.metadata.session_id'), 'service:' || json_extract_string(json_cache, '$.metadata.service_name'), 'module:' || json_extract_string(json_cache, '$.metadata.module_path'), 'job:' || nullif(job_id, '')]) AS anchor FROM ev)"""


def _anchors(s, d):
    a = F.array(F.concat(F.lit("session:"), E.metadata("session_id")), F.concat(F.lit("service:"), E.metadata("service_name")), F.concat(F.lit("module:"), E.metadata("module_path")), F.concat(F.lit("job:"), F.nullif("job_id", F.lit(""))))
    return _ev(s, d, "json_cache", "job_id").select("id", F.explode(a).alias("anchor")).where("anchor is not null")


def _conversations(s, d):
    return table(s, d, "raw_data").where("source <> 'file'").select("id", "files_mentioned", "project_path").distinct()


QUERIES = {
    "sc13_status_as_of": (
        lambda s, d: slots.asof_join(
            table(s, d, "graph_edges").select("source", "target", "relation", "created_at").distinct(),
            table(s, d, "event_index").where("id is not null and mtime is not null").groupBy(F.col("id").alias("source"), "mtime").agg(F.max("status").alias("status")),
            ["source"], "created_at", "mtime", "status", 86_400.0),
        """SELECT e.source, e.target, e.relation, e.created_at, x.status FROM (SELECT DISTINCT source, target, relation, created_at FROM graph_edges) e
           ASOF LEFT JOIN (SELECT id, mtime, max(status) AS status FROM event_index GROUP BY 1, 2) x ON e.source = x.id AND e.created_at >= x.mtime""",
    ),
    "fl5_links": (
        lambda s, d: table(s, d, "graph_edges").select("source", "target", "relation").distinct().join(_ev(s, d, "type").where("type = 'incident'").select(F.col("id").alias("source")), "source", "left_semi"),
        _LATEST + "SELECT DISTINCT source, target, relation FROM graph_edges WHERE source IN (SELECT id FROM ev WHERE type = 'incident')",
    ),
    "fl11_tasks": (
        lambda s, d: E.newest(_ev(s, d, "type", "timestamp", "summary").where("type = 'task' and status = 'active'"), 1000).select("id", "summary"),
        _LATEST + "SELECT id, summary FROM ev WHERE type = 'task' AND status = 'active' ORDER BY timestamp DESC, id LIMIT 1000",
    ),
    "fl18_result_views": (
        lambda s, d: _ev(s, d, "json_cache", "summary", "source_layer").select("id", F.coalesce(E.metadata("module_path"), "markdown_path").alias("path"), F.coalesce(F.nullif("summary", F.lit("")), "id").alias("title"), F.coalesce("source_layer", F.lit("event")).alias("label")),
        _LATEST + "SELECT id, coalesce(json_extract_string(json_cache, '$.metadata.module_path'), markdown_path) AS path, coalesce(nullif(summary, ''), id) AS title, coalesce(source_layer, 'event') AS label FROM ev",
    ),
    "jn14_touching_links": (
        lambda s, d: _touching(s, d),
        _LATEST + ", n AS (SELECT id FROM ev ORDER BY timestamp DESC, id LIMIT 20) SELECT source, target, relation, max(weight) AS weight FROM graph_edges WHERE source IN (SELECT id FROM n) OR target IN (SELECT id FROM n) GROUP BY 1, 2, 3",
    ),
    "ag21_index_status": (
        lambda s, d: _ev(s, d, "type", "date").groupBy("type").agg(F.count("*").alias("n"), F.min("date").cast("string").alias("first_day"), F.max("date").cast("string").alias("last_day"), F.countDistinct("markdown_path").alias("n_files")),
        _LATEST + "SELECT type, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, count(DISTINCT markdown_path) AS n_files FROM ev GROUP BY 1",
    ),
    "sk25_to_embed": (
        lambda s, d: _ev(s, d, "date").select("id").join(table(s, d, "event_vectors").where("embedding is not null").select(F.col("event_id").alias("id")), "id", "left_anti").orderBy("id").limit(100),
        _LATEST + "SELECT id FROM ev WHERE id NOT IN (SELECT event_id FROM event_vectors WHERE embedding IS NOT NULL) ORDER BY id LIMIT 100",
    ),
    "sr7_graph_hits": (
        lambda s, d: E.newest(_ev(s, d, "timestamp").join(table(s, d, "graph_edges").where(F.col("target").contains("cache") & (F.col("relation") == "modifies")).select(F.col("source").alias("id")), "id", "left_semi"), 500).select("id"),
        _LATEST + "SELECT id FROM ev WHERE id IN (SELECT source FROM graph_edges WHERE contains(target, 'cache') AND relation = 'modifies') ORDER BY timestamp DESC, id LIMIT 500",
    ),
    "ax2_decision_cycles": (
        lambda s, d: G.all_cycles(_overriding(s, d)).select(F.col("cycle"), F.element_at(F.split("cycle", " -> "), 1).alias("first_id")),
        _LATEST.replace("WITH ev", "WITH RECURSIVE ev") + ", " + _cycle_sql("SELECT DISTINCT source AS a, target AS b FROM graph_edges WHERE relation = 'overrides' AND source IN (SELECT id FROM ev WHERE type = 'decision') AND target IN (SELECT id FROM ev WHERE type = 'decision')", "cycle, first_id").replace("WITH RECURSIVE ", "", 1),
    ),
    "stm6_context": (
        lambda s, d: _conversations(s, d).select("id", F.size(F.array_distinct(F.coalesce("files_mentioned", F.array()))).cast("long").alias("n_files"), F.when(F.size(F.array_distinct("files_mentioned")) == 1, T.normal_path(F.col("files_mentioned")[0])).alias("module_path")),
        "SELECT DISTINCT id, coalesce(len(list_distinct(files_mentioned)), 0) AS n_files, CASE WHEN len(list_distinct(files_mentioned)) = 1 THEN regexp_replace(replace(files_mentioned[1], '\\', '/'), '/+', '/', 'g') END AS module_path FROM raw_data WHERE source <> 'file'",
    ),
    "cg2_anchors": (
        lambda s, d: _anchors(s, d).groupBy("anchor").agg(F.count("*").alias("n")),
        _LATEST + f", {_ANCHORS} SELECT anchor, count(*) AS n FROM a WHERE anchor IS NOT NULL GROUP BY 1",
    ),
    "st3_shared_anchors": (
        lambda s, d: _shared(s, d),
        _LATEST + f""", {_ANCHORS}, e AS (SELECT DISTINCT source, target FROM graph_edges WHERE relation = 'leads_to')
            SELECT e.source, e.target, count(*) AS n FROM e JOIN a x ON x.id = e.source JOIN a y ON y.id = e.target AND y.anchor = x.anchor GROUP BY 1, 2""",
    ),
    "st7_trace_union": (
        lambda s, d: _traced(s, d),
        _LATEST + """, f AS (SELECT DISTINCT path FROM (SELECT regexp_replace(replace(json_extract_string(json_cache, '$.metadata.module_path'), '\\', '/'), '/+', '/', 'g') AS path FROM ev UNION ALL SELECT regexp_replace(replace(markdown_path, '\\', '/'), '/+', '/', 'g') FROM ev) WHERE path <> '')
            SELECT DISTINCT file_path AS path, 'code' AS kind FROM code_entities UNION ALL SELECT path, 'file' FROM f WHERE path NOT IN (SELECT file_path FROM code_entities)
            UNION ALL SELECT id, 'event' FROM ev WHERE summary ILIKE '%cache%' OR tags ILIKE '%cache%' OR json_cache ILIKE '%cache%'""",
    ),
    "st6_missing_chunks": (
        lambda s, d: _ev(s, d, "source_chunk_id").where("source_chunk_id is not null").select(F.col("source_chunk_id").alias("chunk_id")).distinct().subtract(table(s, d, "chunks").select("chunk_id")),
        _LATEST + "SELECT source_chunk_id AS chunk_id FROM ev WHERE source_chunk_id IS NOT NULL EXCEPT SELECT chunk_id FROM chunks",
    ),
}


def _traced(s, d):
    """Code, files that are no code, and the events that say it."""
    ev = _ev(s, d, "json_cache", "summary", "tags")
    code = table(s, d, "code_entities").select(F.col("file_path").alias("path")).distinct()
    files = E.file_refs(ev).select(F.col("file_path").alias("path")).distinct().join(code, "path", "left_anti")
    said = ev.where(F.col("summary").ilike("%cache%") | F.col("tags").ilike("%cache%") | F.col("json_cache").ilike("%cache%")).select(F.col("id").alias("path"))
    return code.withColumn("kind", F.lit("code")).unionByName(files.withColumn("kind", F.lit("file"))).unionByName(said.withColumn("kind", F.lit("event")))


def _touching(s, d):
    new = E.newest(_ev(s, d, "timestamp"), 20).select("id")  # twenty rows
    e = table(s, d, "graph_edges").select("source", "target", "relation", "weight")
    a = e.join(F.broadcast(new.withColumnRenamed("id", "source")), "source", "left_semi")
    b = e.join(F.broadcast(new.withColumnRenamed("id", "target")), "target", "left_semi").select("source", "target", "relation", "weight")
    return a.unionByName(b).groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"))


def _overriding(s, d):
    """Edges by which a decision overrides a decision."""
    x = _ev(s, d, "type").where("type = 'decision'").select("id")
    e = table(s, d, "graph_edges").where("relation = 'overrides'").select("source", "target").distinct()
    return e.join(x.withColumnRenamed("id", "source"), "source", "left_semi").join(x.withColumnRenamed("id", "target"), "target", "left_semi")


def _shared(s, d):
    """Anchors met per event as arrays; the intersection is inside the row."""
    per = _anchors(s, d).groupBy("id").agg(F.collect_set("anchor").alias("a"))  # at most four a row
    e = table(s, d, "graph_edges").where("relation = 'leads_to'").select("source", "target").distinct()
    j = e.join(per.select(F.col("id").alias("source"), F.col("a").alias("x")), "source").join(per.select(F.col("id").alias("target"), F.col("a").alias("y")), "target")
    return j.select("source", "target", F.size(F.array_intersect("x", "y")).cast("long").alias("n")).where("n > 0")


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
