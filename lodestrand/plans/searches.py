"""Queries of the search channels and of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import search as S
from lodestrand.plans.timeline import _LATEST, _ev
from lodestrand.tables import table

_Q = "tokenizer"
# a fixed query vector: the first 64 multiples of 0.37, centred
_VEC = [round((i * 0.37) % 1.0 - 0.5, 6) for i in range(64)]
_VEC_SQL = "[" + ",".join(f"{x}" for x in _VEC) + "]::DOUBLE[]"
_COS_SQL = f"list_cosine_similarity(embedding::DOUBLE[], {_VEC_SQL})"


def _doc(s, d):
    return table(s, d, "documents")


def _raw(s, d):
    return table(s, d, "raw_data").dropDuplicates(["id"])


def _search(s, d, mode, k, scorer=None):
    return S.search(mode, _Q, _VEC, _ev(s, d), table(s, d, "graph_edges"), table(s, d, "event_vectors"), _entities(s, d), _doc(s, d), k, scorer)


_TEXT_SQL = "SELECT * FROM ev WHERE date >= (SELECT max(date) FROM ev) - 30 AND (contains(lower(summary), 'tokenizer') OR contains(lower(json_cache), 'tokenizer')) ORDER BY date, markdown_path, id LIMIT {k}"
_GRAPH_SQL = "SELECT * FROM ev WHERE id IN (SELECT source FROM graph_edges WHERE contains(target, 'tokenizer') AND relation = 'modifies') ORDER BY timestamp DESC, id LIMIT {k}"
_SEM_SQL = f"""SELECT event_id AS id, max({_COS_SQL}) AS score FROM event_vectors WHERE len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND event_id <> '' GROUP BY 1 ORDER BY score DESC, id LIMIT {{k}}"""
_UNIX_SQL = """SELECT *, (CASE kind WHEN 'events' THEN 0.9 WHEN 'code' THEN 0.85 ELSE 0.8 END)::DOUBLE + (CASE WHEN lower(nm) = 'tokenizer' THEN 0.15 WHEN lower(regexp_replace(nm, '\\.[^.]*$', '')) = 'tokenizer' THEN 0.10 WHEN contains(lower(path), 'tokenizer') THEN 0.05 ELSE 0.0 END)::DOUBLE
             + (CASE WHEN lower(trim(snippet)) = 'tokenizer' THEN 0.05 ELSE 0.0 END)::DOUBLE AS score
        FROM (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS nm FROM (
            SELECT id, 'events' AS kind, NULL::BIGINT AS line_no, coalesce(markdown_path, '') AS path, summary AS snippet FROM ev WHERE contains(lower(summary), 'tokenizer')
            UNION ALL SELECT id, 'code', c[1]::BIGINT, c[2], coalesce(c[3], '') FROM (SELECT id, min((line_start, file_path, name)) AS c FROM code_entities WHERE contains(lower(name), 'tokenizer') OR contains(lower(file_path), 'tokenizer') GROUP BY 1)
            UNION ALL SELECT 'doc_' || doc_id, 'docs', i, 'doc_' || doc_id, substr(l[i], 1, 80) FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l, list_position(list_transform(l, lambda x: contains(lower(x), 'tokenizer')), true) AS i FROM documents) WHERE i > 0))
        ORDER BY score DESC, kind, id LIMIT {k}"""


def _fused_sql(k: int) -> str:
    """The four channels with the weights of their hits, added up."""
    place = "row_number() OVER (ORDER BY {o}) - 1 AS p, count(*) OVER () AS n"
    return _LATEST + f""",
    t AS (SELECT id, 0.7::DOUBLE AS w, {place.format(o='date, markdown_path, id')} FROM ({_TEXT_SQL.format(k=k)})),
    g AS (SELECT id, 0.9::DOUBLE AS w, {place.format(o='timestamp DESC, id')} FROM ({_GRAPH_SQL.format(k=k)})),
    m AS (SELECT id, 1.0::DOUBLE AS w, {place.format(o='score DESC, id')} FROM ({_SEM_SQL.format(k=k)})),
    u AS (SELECT id, 0.8 * (CASE kind WHEN 'events' THEN 1.0 WHEN 'code' THEN 0.92 ELSE 0.84 END)::DOUBLE + least(greatest(score - (CASE kind WHEN 'events' THEN 0.9 WHEN 'code' THEN 0.85 ELSE 0.8 END)::DOUBLE, 0), 0.2) + CASE WHEN line_no > 0 THEN 0.02 ELSE 0 END AS w,
        {place.format(o='score DESC, kind, id')} FROM ({_UNIX_SQL.format(k=k)})),
    f AS (SELECT id, sum(w * (n - p) / n) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM g UNION ALL SELECT * FROM m UNION ALL SELECT * FROM u) GROUP BY id),
    fused AS (SELECT f.id, f.score FROM f LEFT JOIN ev USING (id) ORDER BY round(f.score, 9) DESC, timestamp DESC NULLS LAST, f.id LIMIT {k})"""


def _scorer():
    """A stand-in for a model that compares the query with a text: how many of its words are said."""
    return S.keyword_score(F.coalesce("summary", F.lit("")), ["cache", "token", "queue", "the"])


_SCORER_SQL = " + ".join(f"contains(lower(coalesce(summary, '')), '{w}')::INT" for w in ("cache", "token", "queue", "the"))

_LINES = "regexp_split_to_array(text, '\\r\\n|\\n|\\r')"


def _sql(pattern: str) -> str:
    return pattern.replace("\\'", "'").replace("'", "''")


def _type_sql(col: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({col}), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in T.TYPE_RULES)
    return f"CASE {arms} ELSE 'unknown' END"


def _turn_sql(col: str) -> str:
    counts = {n: " + ".join(f"contains(lower({col}), '{w}')::INT" for w in ws) for n, ws in T.TURN_RULES}
    best = "greatest(" + ", ".join(counts.values()) + ")"
    return f"CASE WHEN {best} = 0 THEN 'other' " + " ".join(f"WHEN ({c}) = {best} THEN '{n}'" for n, c in counts.items()) + " END"


def _plain_sql(col: str) -> str:
    for n, p in T.PLAIN_PATTERNS:
        col = f"regexp_replace({col}, '{_sql(p)}', '[REDACTED]_{n.upper()}', 'g')"
    return col


QUERIES = {
    "sr1_dispatch": (
        lambda s, d: _dispatched(s, d),
        _LATEST + f""", t AS ({_TEXT_SQL.format(k=20)}), g AS ({_GRAPH_SQL.format(k=20)}), m AS ({_SEM_SQL.format(k=20)}), u AS ({_UNIX_SQL.format(k=20)}),
            r AS (SELECT 'text' AS mode, id, row_number() OVER (ORDER BY date, markdown_path, id) AS place, count(*) OVER () AS n FROM t UNION ALL SELECT 'graph', id, row_number() OVER (ORDER BY timestamp DESC, id), count(*) OVER () FROM g
                UNION ALL SELECT 'semantic', id, row_number() OVER (ORDER BY score DESC, id), count(*) OVER () FROM m UNION ALL SELECT 'unix', id, row_number() OVER (ORDER BY score DESC, kind, id), count(*) OVER () FROM u)
            SELECT mode, id, round(1.0::DOUBLE - (place - 1)::DOUBLE / n, 9) AS score FROM r""",
    ),
    "sr2_text": (lambda s, d: S.text_search(_ev(s, d), _Q, 1000).select("id", "markdown_path"), _LATEST + f"SELECT id, markdown_path FROM ({_TEXT_SQL.format(k=1000)})"),
    "sr4_event_scores": (lambda s, d: S.semantic_search(table(s, d, "event_vectors"), _VEC, 100).select(F.col("id").alias("event_id"), F.round("score", 6).alias("score")), f"SELECT id AS event_id, round(score, 6) AS score FROM ({_SEM_SQL.format(k=100)})"),
    "sr9_hybrid": (lambda s, d: _search(s, d, "hybrid", 60).withColumn("score", F.round("score", 9)), _fused_sql(60) + " SELECT id, round(score, 9) AS score FROM fused"),
    "sr10_reranked": (
        lambda s, d: _search(s, d, "hybrid", 10, _scorer()).select("id", "rerank_score"),
        _fused_sql(30) + f" SELECT id, {_SCORER_SQL} AS rerank_score FROM fused LEFT JOIN ev USING (id) ORDER BY rerank_score DESC, round(score, 9) DESC, id LIMIT 10",
    ),
    "sr12_trace": (
        lambda s, d: _event_trace(s, d),
        _LATEST + "SELECT id, matched, row_number() OVER (ORDER BY timestamp DESC, id) AS place FROM (SELECT id, timestamp, CASE WHEN tags ILIKE '%cache%' THEN 'tag' ELSE 'text' END AS matched FROM ev WHERE summary ILIKE '%cache%' OR tags ILIKE '%cache%' OR json_cache ILIKE '%cache%' ORDER BY timestamp DESC, id LIMIT 200)",
    ),
    "sr13_fixed_string": (
        lambda s, d: S.first_files(_files(s, d), "return ", "path", "content").withColumn("line_no", F.col("line_no").cast("long")),
        r"""WITH f AS (SELECT DISTINCT unnest(files_mentioned) AS path, content FROM raw_data WHERE source = 'file'),
            l AS (SELECT path, regexp_split_to_array(content, '\r\n|\n|\r') AS l, list_position(list_transform(l, lambda x: contains(x, 'return ')), true) AS i FROM f WHERE NOT starts_with(path, 'docs/logs/'))
            SELECT path, (min((i, l[i])))[1] AS line_no, (min((i, l[i])))[2] AS line FROM l WHERE i > 0 GROUP BY 1""",
    ),
    "tk4_rerank": (
        lambda s, d: _search(s, d, "semantic", 10, _scorer()).select("id", "rerank_score"),
        _LATEST + f", m AS ({_SEM_SQL.format(k=30)}) SELECT id, {_SCORER_SQL} AS rerank_score FROM m LEFT JOIN ev USING (id) ORDER BY rerank_score DESC, score DESC, id LIMIT 10",
    ),
    "sr3_vector_topk": (
        lambda s, d: S.vector_topk(table(s, d, "embeddings"), _VEC, 10).withColumn("score", F.round("score", 6)),
        f"SELECT vec_id AS id, round({_COS_SQL}, 6) AS score FROM embeddings ORDER BY {_COS_SQL} DESC, vec_id LIMIT 10",
    ),
    "sr5_grep": (
        lambda s, d: S.first_line_hits(_doc(s, d), "tokenizer|lexer", "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long")),
        f"""SELECT doc_id AS id, i AS line_no, substr(({_LINES})[i], 1, 80) AS snippet FROM (
              SELECT doc_id, text, list_position(list_transform({_LINES}, lambda x: regexp_matches(lower(x), 'tokenizer|lexer')), true) AS i FROM documents) WHERE i > 0""",
    ),
    "sr6_hit_scores": (
        lambda s, d: _entities(s, d).select("id", F.round(S.hit_score(F.lit("code"), F.col("file_path"), F.coalesce("name", F.lit("")), _Q), 6).alias("score")).where("score > 0.85"),
        """SELECT id, round(0.85 + CASE WHEN lower(n) = 'tokenizer' THEN 0.15 WHEN lower(regexp_replace(n, '\\.[^.]*$', '')) = 'tokenizer' THEN 0.10 WHEN contains(lower(file_path), 'tokenizer') THEN 0.05 ELSE 0.0 END
             + CASE WHEN lower(trim(name)) = 'tokenizer' THEN 0.05 ELSE 0.0 END, 6)::DOUBLE AS score FROM (SELECT DISTINCT id, name, file_path, regexp_extract(file_path, '([^/]*)$', 1) AS n FROM code_entities) WHERE score > 0.85""",
    ),
    "sr11_hit_ids": (
        lambda s, d: S.first_line_hits(_doc(s, d), "tokenizer", "doc_id", "text").select(S.hit_id(F.lit("docs"), F.col("id").cast("string"), F.col("line_no"), F.col("snippet")).alias("hit_id"), "id"),
        f"""SELECT 'unix_docs_' || substr(sha1('docs|' || doc_id || '|' || i || '|' || substr(({_LINES})[i], 1, 80)), 1, 12) AS hit_id, doc_id AS id FROM (
              SELECT doc_id, text, list_position(list_transform({_LINES}, lambda x: regexp_matches(lower(x), 'tokenizer')), true) AS i FROM documents) WHERE i > 0""",
    ),
    "sr14_symbols": (
        lambda s, d: _entities(s, d).where((F.col("name") == _Q) | (F.col("id") == _Q) | F.col("name").ilike(f"%{_Q}%")).select("id", "name", "type").distinct(),
        "SELECT DISTINCT id, name, type FROM code_entities WHERE name ILIKE '%tokenizer%' OR id = 'tokenizer'",
    ),
    "sr15_keyword_scores": (
        lambda s, d: _doc(s, d).select("doc_id", S.keyword_score(F.col("text"), ["cache", "lexer", "queue", "vector"]).alias("score")).where("score > 0"),
        "SELECT doc_id, contains(lower(text), 'cache')::INT + contains(lower(text), 'lexer')::INT + contains(lower(text), 'queue')::INT + contains(lower(text), 'vector')::INT AS score FROM documents WHERE score > 0",
    ),
    "tx2_plain_redaction": (
        lambda s, d: _doc(s, d).select("doc_id", T.plain_redact(F.col("text")).alias("redacted")),
        f"SELECT doc_id, {_plain_sql('text')} AS redacted FROM documents",
    ),
    "tx2_redaction": (lambda s, d: _raw(s, d).select("id", T.exact_redact(F.col("content")).alias("redacted")), None),
    "tx1_pattern_counts": (
        lambda s, d: _raw(s, d).select("id", *[c.cast("long").alias(n) for n, c in T.pattern_counts(F.col("content"))]),
        "SELECT id, " + ", ".join(f"len(regexp_extract_all(content, '{_sql(p)}')) AS {n}" for n, p in T.PLAIN_PATTERNS) + " FROM (SELECT id, any_value(content) AS content FROM raw_data GROUP BY id)",
    ),
    "tx3_event_types": (
        lambda s, d: _doc(s, d).select("doc_id", T.event_type(F.col("text")).alias("kind")),
        f"SELECT doc_id, {_type_sql('text')} AS kind FROM documents",
    ),
    "tx4_file_mentions": (
        lambda s, d: _doc(s, d).select("doc_id", F.explode(T.file_mentions(F.col("text"))).alias("file")),
        f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{T.SQL_FILE_RE}')) AS file FROM documents",
    ),
    "tx5_function_mentions": (
        lambda s, d: _raw(s, d).select("id", F.explode(T.function_mentions(F.col("content"))).alias("name")),
        r"SELECT DISTINCT id, unnest(regexp_extract_all(content, '(?:def|function)\s+(\w+)\s*\(', 1)) AS name FROM raw_data",
    ),
    "tx6_regex_events": (
        lambda s, d: _doc(s, d).select("doc_id", F.when(F.char_length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text")).alias("summary"), F.lit(0.5).alias("confidence")),
        "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS summary, 0.5::DOUBLE AS confidence FROM documents",
    ),
    "tx8_noise": (
        lambda s, d: _raw(s, d).where("source <> 'file'").select("id", F.md5(T.without_noise(F.regexp_replace("content", r"\r\n?", "\n"))).alias("digest")),
        r"SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '" + _sql(T.NOISE_RE) + r"', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+|\s+\z', '', 'g')) AS digest FROM (SELECT id, any_value(content) AS content FROM raw_data WHERE source <> 'file' GROUP BY id)",
    ),
    "tx9_turn_classes": (
        lambda s, d: table(s, d, "session_records").where("text is not null and record_uuid is not null").select("record_uuid", T.turn_class(F.col("text")).alias("category")).distinct(),
        f"SELECT DISTINCT record_uuid, {_turn_sql('text')} AS category FROM session_records WHERE text IS NOT NULL AND record_uuid IS NOT NULL",
    ),
    "tx13_keywords": (
        lambda s, d: _ev(s, d, "summary").select("id", F.explode(T.keywords(F.col("summary"))).alias("word")),
        _LATEST + "SELECT DISTINCT id, word FROM (SELECT id, regexp_replace(w, '" + _sql(T.KEYWORD_EDGES) + "', '', 'g') AS word FROM (SELECT id, unnest(regexp_split_to_array(lower(trim(summary)), '\\s+')) AS w FROM ev) WHERE length(w) >= 3 AND w NOT IN ("
        + ",".join(f"'{w}'" for w in T.STOP_WORDS)
        + ")) WHERE word <> ''",
    ),
    "tx18_token_estimates": (
        lambda s, d: _doc(s, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens")),
        "SELECT doc_id, CAST(trunc(len(regexp_extract_all(text, '[一-鿿]')) / 1.5 + (length(text) - len(regexp_extract_all(text, '[一-鿿]'))) / 4.0) AS INTEGER) AS tokens FROM documents",
    ),
    "tx23_module_names": (
        lambda s, d: _entities(s, d).select("file_path").distinct().select("file_path", F.explode(T.module_names(F.col("file_path"))).alias("module")),
        r"""SELECT file_path, array_to_string(p[len(p) - k + 1:], '.') AS module FROM (SELECT DISTINCT file_path, string_split(regexp_replace(file_path, '\.\w+$', ''), '/') AS p FROM code_entities), LATERAL (SELECT unnest(generate_series(1, len(p))) AS k)""",
    ),
    "sc10_document_rows": (
        lambda s, d: _doc_rows(s, d),
        r"""SELECT 'doc_' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS id, CASE WHEN length(l) < 100 THEN l ELSE CAST(doc_id AS VARCHAR) END AS summary FROM (
            SELECT doc_id, trim(regexp_replace(list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(x) <> '')[1], '^#+\s*', '')) AS l FROM documents WHERE trim(text) <> '')""",
    ),
    "ag18_documented": (
        lambda s, d: _entities(s, d).groupBy(F.element_at(F.split("file_path", "/"), 1).alias("top")).agg(F.countDistinct("id").alias("n"), F.countDistinct(F.when(F.col("docstring").isNull(), F.col("id"))).alias("bare")).withColumn("score", F.greatest(F.lit(0), 100 - 10 * F.col("bare"))),
        "SELECT string_split(file_path, '/')[1] AS top, count(DISTINCT id) AS n, count(DISTINCT CASE WHEN docstring IS NULL THEN id END) AS bare, greatest(0, 100 - 10 * count(DISTINCT CASE WHEN docstring IS NULL THEN id END)) AS score FROM code_entities GROUP BY 1",
    ),
}


def _entities(s, d):
    return table(s, d, "code_entities")


def _dispatched(s, d):
    """The 20 best of each single channel."""
    out = None
    for mode in ("text", "graph", "semantic", "unix"):
        hits = _search(s, d, mode, 20).select(F.lit(mode).alias("mode"), "id", F.round("score", 9).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    return out


def _event_trace(s, d):
    """The 200 newest events that say it, newest first."""
    from pyspark.sql import Window

    ev = _ev(s, d, "summary", "tags", "json_cache", "timestamp").where(F.col("summary").ilike("%cache%") | F.col("tags").ilike("%cache%") | F.col("json_cache").ilike("%cache%"))
    top = ev.orderBy(F.desc("timestamp"), "id").limit(200)
    place = F.row_number().over(Window.orderBy(F.desc("timestamp"), "id"))  # 200 rows
    return top.select("id", F.when(F.col("tags").ilike("%cache%"), "tag").otherwise("text").alias("matched"), place.cast("long").alias("place"))


def _files(s, d):
    return table(s, d, "raw_data").where("source = 'file' and content is not null").select(F.explode("files_mentioned").alias("path"), "content").distinct()


def _doc_rows(s, d):
    line = F.trim(F.regexp_replace(F.try_element_at(F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: F.trim(x) != ""), F.lit(1)), r"^#+\s*", ""))
    key = F.col("doc_id").cast("string")
    return _doc(s, d).where(F.trim("text") != "").select(F.concat(F.lit("doc_"), F.substring(F.md5(key), 1, 12)).alias("id"), F.when(F.char_length(line) < 100, line).otherwise(key).alias("summary"))


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
