"""Queries that read turns, tasks, tables, marks and events out of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import chunks
from lodestrand.functions import markup as M
from lodestrand.functions import text as T
from lodestrand.operators import events as E
from lodestrand.plans.searches import _plain_sql, _turn_sql, _type_sql
from lodestrand.plans.timeline import _LATEST, _ev
from lodestrand.sources import files, logs, markdown
from lodestrand.streaming import pipeline
from lodestrand.tables import table

# the USER and ASSISTANT blocks of a text, each from its heading to the next
_BLOCKS = r"""p AS (SELECT id, unnest(regexp_split_to_array(chr(10) || regexp_replace(content, '\r\n?', chr(10), 'g'), '\n### ')) AS b, generate_subscripts(regexp_split_to_array(chr(10) || regexp_replace(content, '\r\n?', chr(10), 'g'), '\n### '), 1) AS i FROM {src}),
    q AS (SELECT id, i, regexp_extract(b, '^(USER|ASSISTANT) \(', 1) AS who, regexp_replace(regexp_extract(b, '^\w+ \((?s:.*?)\)\n\n((?s:.*))$', 1), '\A\s+|\s+\z', '', 'g') AS said, row_number() OVER (PARTITION BY id, regexp_extract(b, '^(USER|ASSISTANT) \(', 1) ORDER BY i) AS n
        FROM p WHERE regexp_matches(b, '^(USER|ASSISTANT) \((?s:.*?)\)\n\n')),
    turn AS (SELECT u.id, u.n - 1 AS turn, u.said AS user_text, coalesce(a.said, '') AS assistant_text FROM q u LEFT JOIN q a ON a.id = u.id AND a.n = u.n AND a.who = 'ASSISTANT' WHERE u.who = 'USER')"""
_RAW = r"(SELECT id, regexp_replace(any_value(content), '(### (?:USER|ASSISTANT) \([^)\r\n]*\))\r?\n', '\1' || chr(10) || chr(10), 'g') AS content FROM raw_data WHERE source <> 'file' AND content IS NOT NULL GROUP BY id)"
_MARK_SQL = "CASE c " + " ".join(f"WHEN '{k}' THEN '{m}: '" for k, m in M.TURN_MARKS.items()) + " END || replace(substr(user_text, 1, 100), chr(10), ' ') || '...'"


def _talks(s, d):
    """Conversations, with the blank line behind a turn's heading that a transcript has."""
    r = table(s, d, "raw_data").where("source <> 'file' and content is not null").dropDuplicates(["id"])
    return r.select("id", F.regexp_replace("content", r"(### (?:USER|ASSISTANT) \([^)\r\n]*\))\r?\n", "$1\n\n").alias("content"))


def _notes(s, d):
    """Each event as a note with its open tasks, boxes, a table of two rows and a mark of its own."""
    text = F.concat(
        F.lit("# "), "id", F.lit("\n<!-- X_SYNC_ID: "), F.regexp_replace("id", "_", "-"), F.lit(" -->\n\n[TODO]\n- look at "), "id", F.lit("\n* ab\n  - tell "), "type", F.lit("\n- look at "), "id",
        F.lit("\n\n## Notes\n- nothing to do\n- [x] read "), "id", F.lit("\n- [ ] check "), "type", F.lit("\n- [ ]  \n\n| Date | Job | Status |\n|---|---|---|\n| **"), F.col("date").cast("string"), F.lit("** | ["), "id",
        F.lit("](x.md) | "), "status", F.lit(" |\n| | plain | |\n\n## 明日计划\n- go on with "), "type", F.lit("\r\n"),
    )
    return _ev(s, d, "type", "date").select("id", "type", "date", "status", text.alias("text"))


def _round_trip(s, d):
    """Events written as Markdown and read again."""
    ev = _ev(s, d, "type", "source", "timestamp", "summary", "tags").select(
        "id", "type", "source", F.col("timestamp").cast("timestamp").alias("timestamp"), F.regexp_replace("summary", r"\s+", " ").alias("summary"), F.lit("Text of it.").alias("content"),
        F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), F.trim), lambda x: x != "").alias("tags"), F.lit(0.5).alias("confidence"),
    )
    texts = markdown.to_markdown(ev).select(F.concat(F.lit("/x/"), "id", F.lit(".md")).alias("path"), "text")
    back = markdown.parse_events(texts)
    return back.select("id", "type", "source", F.unix_seconds("timestamp").alias("at"), "summary", "content", F.array_join("tags", ",").alias("tags"), "confidence")


def _answers(s, d):
    """Cached records as a model might give them: bare, fenced, with words around, or broken off."""
    ev = _ev(s, d, "json_cache").where("json_cache is not null")
    k = F.pmod(F.ascii(F.right("id", F.lit(1))), F.lit(4))
    j = F.col("json_cache")
    text = F.when(k == 0, j).when(k == 1, F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```\nDone."))).when(k == 2, F.concat(F.lit("The answer is "), j, F.lit(" as asked."))).otherwise(F.substring(j, 1, 20))
    return ev.select("id", text.alias("text"))


def _broken_lists(s, d):
    """Lists of two records, every second one cut off inside the second."""
    ev = _ev(s, d, "json_cache").where("json_cache is not null and json_cache not like '%]%'")
    cut = F.pmod(F.ascii(F.right("id", F.lit(1))), F.lit(2)) == 0
    return ev.select("id", F.when(cut, F.concat(F.lit("```json\n["), "json_cache", F.lit(', {"id": "cut'))).otherwise(F.concat(F.lit("```json\n["), "json_cache", F.lit(","), "json_cache", F.lit("]\n```"))).alias("text"))


_ID4 = "ascii(right(id, 1))"

QUERIES = {
    "wn8_turn_pairs": (
        lambda s, d: _talks(s, d).select("id", F.posexplode(M.turns(F.col("content"))).alias("turn", "t")).select("id", F.col("turn").cast("long").alias("turn"), F.col("t.user").alias("user_text"), F.col("t.assistant").alias("assistant_text")),
        "WITH " + _BLOCKS.format(src=_RAW) + " SELECT id, turn, user_text, assistant_text FROM turn",
    ),
    "tx11_turn_lists": (
        lambda s, d: M.classified_turns(_talks(s, d), "id", "content").select("id", "category", F.col("place").cast("long").alias("place"), "summary"),
        "WITH " + _BLOCKS.format(src=_RAW) + f", k AS (SELECT *, {_turn_sql('said')} AS c FROM (SELECT *, user_text || chr(10) || assistant_text AS said FROM turn)) SELECT id, c AS category, row_number() OVER (PARTITION BY id, c ORDER BY turn) AS place, {_MARK_SQL} AS summary FROM k WHERE c <> 'other'",
    ),
    "tx12_first_layer": (
        lambda s, d: M.first_layer(table(s, d, "chunks")),
        r"WITH w AS (SELECT DISTINCT chunk_id AS id, session_id, '### USER (2024-01-01 00:00:00)' || chr(10) || chr(10) || content || chr(10) || chr(10) || '### ASSISTANT (2024-01-01 00:00:01)' || chr(10) || chr(10) || 'Assistant response.' AS content FROM chunks WHERE content <> ''), "
        + _BLOCKS.format(src="w")
        + f""", k AS (SELECT *, {_turn_sql('said')} AS c FROM (SELECT *, user_text || chr(10) || assistant_text AS said FROM turn)),
            o AS (SELECT id, turn, c, {_MARK_SQL} AS summary, list_position(['completed_task', 'problem', 'decision', 'pending'], c) AS pos, row_number() OVER (PARTITION BY id, c ORDER BY turn) AS place FROM k WHERE c IN ('completed_task', 'problem', 'decision', 'pending')),
            n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, place) - 1 AS nth FROM o WHERE place <= 5)
            SELECT n.id AS chunk_id, 'evt_' || substr(sha256(n.id || ':l1:' || nth), 1, 16) AS id, CASE c WHEN 'problem' THEN 'diagnostic' WHEN 'pending' THEN 'task' ELSE 'decision' END AS type, substr(summary, 1, 50) AS summary, w.session_id
            FROM n JOIN (SELECT DISTINCT id, session_id FROM w) w ON w.id = n.id""",
    ),
    "tx14_todo_items": (
        lambda s, d: _notes(s, d).select("id", F.posexplode(M.todo_items(F.col("text"))).alias("place", "item")).withColumn("place", F.col("place").cast("long")),
        _LATEST + "SELECT id, unnest([0, 1, 2]) AS place, unnest(['look at ' || id, 'tell ' || type, 'go on with ' || type]) AS item FROM ev",
    ),
    "tx15_table_rows": (
        lambda s, d: M.index_rows(_notes(s, d), "id", "text"),
        _LATEST + "SELECT id, unnest([0, 1]) AS row, CAST(date AS VARCHAR) AS day, unnest([id, 'plain']) AS job, unnest([status, '']) AS status, '' AS summary, '' AS tags FROM ev",
    ),
    "tx31_field_rows": (
        lambda s, d: _field_rows(s, d),
        r"""SELECT DISTINCT doc_id, trim(regexp_extract(l, '^\|([^|]*)\|([^|]*)\|', 1)) AS field, trim(regexp_extract(l, '^\|([^|]*)\|([^|]*)\|', 2)) AS value FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS l FROM documents)
            WHERE regexp_matches(l, '^\|([^|]*)\|([^|]*)\|') AND NOT regexp_matches(l, '^\|\s*-+') AND NOT regexp_matches(l, '^\| field')""",
    ),
    "tx16_task_items": (
        lambda s, d: _notes(s, d).select("id", F.explode(T.task_items(F.col("text"), True)).alias("item"), F.lit(True).alias("checked")).unionByName(_notes(s, d).select("id", F.explode(T.task_items(F.col("text"), False)).alias("item"), F.lit(False).alias("checked"))),
        _LATEST + "SELECT id, 'read ' || id AS item, TRUE AS checked FROM ev UNION ALL SELECT id, 'check ' || type, FALSE FROM ev",
    ),
    "tx16_sections": (
        lambda s, d: _notes(s, d).select("id", M.section(F.col("text"), ["nowhere", "明日"]).alias("body")),
        _LATEST + "SELECT id, '- go on with ' || type AS body FROM ev",
    ),
    "tx17_sync_ids": (
        lambda s, d: _notes(s, d).select("id", F.explode(M.sync_ids(F.col("text"))).alias("sync_id")),
        _LATEST + "SELECT id, replace(id, '_', '-') AS sync_id FROM ev",
    ),
    "tx20_path_dates": (
        lambda s, d: _ev(s, d, "date").select("id", F.explode(F.array(F.concat(F.lit("logs/"), F.date_format("date", "yyyy/MM-dd"), F.lit("/end.md")), F.concat(F.lit("logs/"), F.date_format("date", "yyyy-MM-dd"), F.lit("-jobs/2026-02-31/x.md")), F.lit("logs/2026/02-31/x.md"))).alias("path")).select("id", "path", M.path_day(F.col("path")).cast("string").alias("day")),
        _LATEST + "SELECT id, 'logs/' || strftime(date, '%Y/%m-%d') || '/end.md' AS path, CAST(date AS VARCHAR) AS day FROM ev UNION ALL SELECT id, 'logs/' || strftime(date, '%Y-%m-%d') || '-jobs/2026-02-31/x.md', CAST(date AS VARCHAR) FROM ev UNION ALL SELECT id, 'logs/2026/02-31/x.md', NULL FROM ev",
    ),
    "tx28_tolerant_json": (
        lambda s, d: _answers(s, d).select("id", F.get_json_object(T.tolerant_json(F.col("text")), "$.type").alias("type")),
        _LATEST + f"SELECT id, CASE WHEN {_ID4} % 4 < 3 THEN json_extract_string(json_cache, '$.type') END AS type FROM ev WHERE json_cache IS NOT NULL",
    ),
    "tx7_model_events": (
        lambda s, d: _model_events(s, d),
        _LATEST + f"""SELECT id, CAST(unnest(CASE WHEN {_ID4} % 2 = 0 THEN [0] ELSE [0, 1] END) AS INTEGER) AS place, type, substr(json_extract_string(json_cache, '$.summary'), 1, 100) AS summary FROM ev WHERE json_cache IS NOT NULL AND json_cache NOT LIKE '%]%'""",
    ),
    "sc3_markdown_round_trip": (
        _round_trip,
        _LATEST + r"""SELECT id, type, CASE WHEN source IN ('claude_code', 'cursor', 'continue_dev', 'windsurf', 'manual', 'file') THEN source ELSE 'claude_code' END AS source, epoch_us(timestamp) // 1000000 AS at, coalesce(nullif(trim(regexp_replace(summary, '\s+', ' ', 'g')), ''), 'Text of it.') AS summary, 'Text of it.' AS content,
            array_to_string(list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: x <> ''), ',') AS tags, 0.5::DOUBLE AS confidence FROM ev""",
    ),
    "sc21_time_ranges": (
        lambda s, d: _ranges(s, d),
        _LATEST + "SELECT id, epoch_us(timestamp) // 1000000 AS first_s, epoch_us(timestamp) // 1000000 + 7200 AS last_s FROM ev WHERE timestamp IS NOT NULL",
    ),
}


QUERIES |= {
    "sc5_typed_frontmatter": (
        lambda s, d: _typed(s, d),
        _LATEST + f"""SELECT '/x/' || id || '.md' AS path, CASE {_ID4} % 4 WHEN 0 THEN 'session-start' WHEN 1 THEN 'job-end' END AS kind, CASE WHEN {_ID4} % 4 < 2 THEN CAST(date AS VARCHAR) END AS day, CASE WHEN {_ID4} % 4 < 2 THEN 'active' END AS status,
            CASE WHEN {_ID4} % 4 = 1 THEN replace(id, '_', '-') END AS job_id, CASE {_ID4} % 4 WHEN 2 THEN 'bad job id' WHEN 3 THEN 'bad date' END AS error FROM ev""",
    ),
    "sc17_session_files": (
        lambda s, d: files.of_session(table(s, d, "event_index").where("markdown_path is not null").select("markdown_path", "mtime").distinct(), 1768467600.0, 1768474800.0).select("markdown_path", "mtime", "how"),
        "SELECT DISTINCT markdown_path, mtime, CASE WHEN mtime BETWEEN 1768464000 AND 1768475100 THEN 'window' ELSE 'day' END AS how FROM event_index WHERE markdown_path IS NOT NULL AND (mtime BETWEEN 1768464000 AND 1768475100 OR floor(mtime / 86400) = floor(1768467600 / 86400))",
    ),
    "wn7_token_windows": (lambda s, d: chunks.token_chunks(table(s, d, "documents"), "doc_id", "text").select("id", "seq", "pos", "token_count", F.md5("text").alias("digest")), None),
    "stm5_pipeline": (
        lambda s, d: pipeline.extracted(table(s, d, "raw_data").dropDuplicates(["id"])).select("id", "type", F.md5("summary").alias("summary"), F.md5("content").alias("content"), F.array_join("files", ",").alias("files"), F.array_join("functions", ",").alias("functions")),
        r"""WITH r AS (SELECT id, any_value(content) AS content, any_value(files_mentioned) AS m FROM raw_data WHERE content <> '' GROUP BY id), t AS (SELECT id, m, """ + _plain_sql("content") + r""" AS safe FROM r)
            SELECT id, """ + _type_sql("safe") + r""" AS type, md5(substr(safe, 1, 100)) AS summary, md5(safe) AS content, array_to_string(list_sort(list_distinct(list_transform(coalesce(m, []), lambda x: regexp_replace(replace(x, '\', '/'), '/+', '/', 'g')))), ',') AS files,
                array_to_string(list_sort(list_distinct(regexp_extract_all(safe, '(?:def|function)\s+(\w+)\s*\(', 1))), ',') AS functions FROM t""",
    ),
    "stm8_two_layers": (
        lambda s, d: _layered(s, d),
        _LATEST + """, old AS (SELECT id, source_chunk_id, source_layer FROM ev), c AS (SELECT DISTINCT chunk_id FROM chunks WHERE content <> ''),
            l2 AS (SELECT 'evt_' || substr(sha256(chunk_id || ':l2:0'), 1, 16) AS id, chunk_id FROM c WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE status = 'extracted')), l1 AS (SELECT 'evt_' || substr(sha256(chunk_id || ':l1:0'), 1, 16) AS id, chunk_id FROM c),
            k AS (SELECT * FROM old WHERE NOT coalesce(source_layer = 'l2' AND source_chunk_id IN (SELECT chunk_id FROM l2), FALSE)), a AS (SELECT * FROM k UNION ALL SELECT id, chunk_id, 'l1' FROM l1 WHERE id NOT IN (SELECT id FROM k))
            SELECT * FROM a WHERE id NOT IN (SELECT id FROM l2) UNION ALL SELECT id, chunk_id, 'l2' FROM l2""",
    ),
    "stm10_retries": (
        lambda s, d: pipeline.retried(table(s, d, "chunks").groupBy(F.col("chunk_id").alias("id")).agg(F.max("retry_count").alias("retry_count"), F.min(F.col("last_error").isNull()).alias("ok"))),
        "SELECT chunk_id AS id, CASE WHEN bool_and(last_error IS NULL) THEN max(retry_count) ELSE max(retry_count) + 1 END AS retry_count, CASE WHEN bool_and(last_error IS NULL) THEN 'done' WHEN max(retry_count) + 1 >= 3 THEN 'failed' ELSE 'pending' END AS state FROM chunks GROUP BY 1",
    ),
    "tx25_excerpts": (
        lambda s, d: table(s, d, "raw_data").where("content is not null").dropDuplicates(["id"]).select("id", F.md5(T.excerpt(F.col("content"), 20, 400)).alias("digest")),
        r"""WITH r AS (SELECT id, regexp_split_to_array(any_value(content), '\r\n|\n|\r') AS l FROM raw_data WHERE content IS NOT NULL GROUP BY id), h AS (SELECT id, len(l) AS n, array_to_string(l[1:20], chr(10)) AS head FROM r)
            SELECT id, md5(substr(head, 1, 400) || CASE WHEN n > 20 OR length(head) > 400 THEN chr(10) || '... (truncated)' ELSE '' END) AS digest FROM h""",
    ),
    "tx29_name_times": (
        lambda s, d: _ev(s, d, "timestamp").where("timestamp is not null").select("id", F.unix_seconds(T.name_time(F.concat(F.lit("a/"), "id", F.lit("_"), F.date_format("timestamp", "yyyyMMddHHmmss"), F.lit(".md")))).alias("at")),
        _LATEST + "SELECT id, epoch_us(timestamp) // 1000000 AS at FROM ev WHERE timestamp IS NOT NULL",
    ),
    "wn11_next_sequence": (
        lambda s, d: _ev(s, d, "date").groupBy(F.col("date").cast("string").alias("day")).agg(F.count("*").alias("n")).select("day", T.next_hex(F.array(F.lit(0).cast("long"), F.col("n"))).alias("next")),
        _LATEST + "SELECT CAST(date AS VARCHAR) AS day, CASE WHEN count(*) < 255 THEN upper(lpad(to_hex(count(*) + 1), 2, '0')) END AS next FROM ev GROUP BY 1",
    ),
}


def _typed(s, d):
    """Logs of each type, some under an old name, with a bad job id or a bad date."""
    k = F.pmod(F.ascii(F.right("id", F.lit(1))), F.lit(4))
    kind = F.when(k == 0, "daily-start").when(k == 3, "session-end").otherwise("job-end")
    day = F.when(k == 0, F.date_format("date", "dd-MM-yyyy")).when(k == 3, F.lit("2026-13-45")).otherwise(F.date_format("date", "yyyy/MM/dd"))
    job = F.when(k == 1, F.regexp_replace("id", "_", "-")).otherwise(F.lit("Not An Id"))
    text = F.concat(F.lit("---\ntype: "), kind, F.lit("\ndate: '"), day, F.lit("'\nJob-Id: "), job, F.lit("\n---\ntext\n"))
    t = _ev(s, d, "date").select(F.concat(F.lit("/x/"), "id", F.lit(".md")).alias("path"), text.alias("text"), k.alias("k"))
    r = markdown.typed_frontmatter(t.select("path", "text"))
    return r.select("path", "kind", F.col("date").cast("string").alias("day"), "status", F.when(F.col("kind") == "job-end", F.col("job_id")).alias("job_id"), "error")


def _layered(s, d):
    """The index after a new pass over the chunks: one first-layer event each, one second-layer event where it was extracted."""
    c = table(s, d, "chunks").where("content <> ''").select(F.col("chunk_id").alias("source_chunk_id"), "status").distinct()
    make = lambda df, layer: df.select("source_chunk_id").distinct().select(F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat("source_chunk_id", F.lit(f":{layer}:0")), 256), 1, 16)).alias("id"), "source_chunk_id")
    return pipeline.two_layers(_ev(s, d, "source_chunk_id", "source_layer").select("id", "source_chunk_id", "source_layer"), make(c, "l1"), make(c.join(table(s, d, "chunks").where("status = 'extracted'").select(F.col("chunk_id").alias("source_chunk_id")), "source_chunk_id", "left_semi"), "l2"))


def _field_rows(s, d):
    rx = r"^\|([^|]*)\|([^|]*)\|"
    lines = table(s, d, "documents").where(F.col("text").contains("|")).select("doc_id", F.explode(F.split("text", r"\r\n|\n|\r")).alias("l"))
    lines = lines.where(F.col("l").rlike(rx) & ~F.col("l").rlike(r"^\|\s*-+") & ~F.col("l").rlike(r"^\| field"))
    return lines.select("doc_id", F.trim(F.regexp_extract("l", rx, 1)).alias("field"), F.trim(F.regexp_extract("l", rx, 2)).alias("value")).distinct()


def _model_events(s, d):
    """The events of a model's list, each with a type the index knows."""
    e = _broken_lists(s, d).select("id", F.posexplode(F.from_json(T.repaired_list(F.col("text")), "array<struct<type:string,summary:string>>")).alias("place", "e"))
    kind = F.lower("e.type")
    return e.select("id", "place", F.when(kind.isin(markdown.EVENT_TYPES), kind).otherwise("unknown").alias("type"), F.substring("e.summary", 1, 100).alias("summary"))


def _ranges(s, d):
    """A log of three shapes of time stamps an event, longer than what is looked at; the one in the middle is not."""
    ev = _ev(s, d, "timestamp").where("timestamp is not null").select("id", F.col("timestamp").cast("timestamp").alias("t"))
    at = lambda col, f: F.date_format(col, f)
    log = F.concat(at(F.col("t") + F.expr("interval 1 hour"), "yyyy/MM/dd HH:mm:ss"), F.lit(" a\n"), at(F.col("t"), "yyyy-MM-dd HH:mm:ss"), F.lit(" b\n"), F.repeat(F.lit("x"), F.lit(3000)), F.lit(" 1999-01-01 00:00:00 "), F.repeat(F.lit("y"), F.lit(3000)), F.lit("\n"), at(F.col("t") + F.expr("interval 2 hour"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" z"))
    lo, hi = logs.time_range(log)
    return ev.select("id", F.unix_seconds(lo).alias("first_s"), F.unix_seconds(hi).alias("last_s"))


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
