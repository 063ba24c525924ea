"""Queries that link, extract and audit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import code as C
from lodestrand.operators import events as E
from lodestrand.operators import graph as G
from lodestrand.operators import similarity as V
from lodestrand.operators import slots
from lodestrand.plans.graphs import _CLASSES, _ONTOLOGY, JN6_SQL, _classes
from lodestrand.plans.searches import _sql, _type_sql
from lodestrand.plans.timeline import _LATEST, LEGACY, _ev
from lodestrand.streaming import state
from lodestrand.tables import table

_US = "epoch_us(timestamp)"
# which of the 48 newest others share session, job, module or a file; the first 12
_CANDIDATES = f""", x AS (SELECT id, {_US} AS us, nullif(job_id, '') AS j, nullif(json_extract_string(json_cache, '$.metadata.session_id'), '') AS se, nullif(json_extract_string(json_cache, '$.metadata.module_path'), '') AS m,
        list_filter([regexp_replace(replace(json_extract_string(json_cache, '$.metadata.module_path'), '\\', '/'), '/+', '/', 'g'), regexp_replace(replace(markdown_path, '\\', '/'), '/+', '/', 'g')], lambda p: p <> '') AS f FROM ev),
    nx AS (SELECT * FROM x ORDER BY us DESC, id LIMIT 49),
    n AS (SELECT a.id, b.id AS other, b.us, coalesce(a.j = b.j, FALSE) OR coalesce(a.se = b.se, FALSE) OR coalesce(a.m = b.m, FALSE) OR list_has_any(a.f, b.f) AS shares, row_number() OVER (PARTITION BY a.id ORDER BY b.us DESC, b.id) AS r FROM x a JOIN nx b ON a.id <> b.id),
    cand AS (SELECT id, other, rank FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY us DESC, other) AS rank FROM n WHERE r <= 48 AND shares) WHERE rank <= 12)"""
_SEMANTIC = _LATEST + _CANDIDATES + f""", {_CLASSES}, {_ONTOLOGY},
    vec AS (SELECT event_id AS id, arg_max(embedding, (embedded_at, embedding))::DOUBLE[] AS e FROM event_vectors WHERE event_id <> '' AND chunk_seq = 0 AND len(embedding) = 64 GROUP BY 1),
    node AS (SELECT id, class, e FROM classes JOIN vec USING (id)), pr AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM cand),
    ps AS (SELECT a, b, x.class AS ca, y.class AS cb, CASE WHEN list_dot_product(x.e, x.e) > 0 AND list_dot_product(y.e, y.e) > 0 THEN list_cosine_similarity(x.e, y.e) END AS weight FROM pr JOIN node x ON x.id = a JOIN node y ON y.id = b),
    pl AS (SELECT a, b, weight, (SELECT arg_min(rel, ord) FROM ontology WHERE dom = ca AND rng = cb) AS fwd, (SELECT arg_min(rel, ord) FROM ontology WHERE dom = cb AND rng = ca) AS rev FROM ps WHERE weight >= 0.85),
    sem AS (SELECT CASE WHEN fwd IS NULL THEN b ELSE a END AS source, CASE WHEN fwd IS NULL THEN a ELSE b END AS target, coalesce(fwd, rev) AS relation, weight FROM pl WHERE coalesce(fwd, rev) IS NOT NULL)"""
_HISTORY = _LATEST.replace("WITH ev", "WITH RECURSIVE ev") + """, refs AS (SELECT DISTINCT id AS start, regexp_replace(replace(json_extract_string(json_cache, '$.metadata.module_path'), '\\', '/'), '/+', '/', 'g') AS file FROM ev),
    seeds AS (SELECT start, file FROM refs WHERE file <> '' AND file NOT LIKE '%.md'),
    ce AS (SELECT DISTINCT source, target FROM graph_edges WHERE relation IN ('caused_by','triggers','leads_to','correlated_with','depends_on_causal','resulted_in')),
    w(start, id, level) AS (SELECT DISTINCT start, start, 0 FROM seeds UNION SELECT w.start, ce.source, level + 1 FROM w JOIN ce ON ce.target = w.id WHERE level < 2),
    c AS (SELECT DISTINCT file, w.id FROM w JOIN seeds USING (start) WHERE w.id <> w.start AND w.id IN (SELECT id FROM ev))
    SELECT DISTINCT file, start AS id, 'direct' AS how FROM seeds UNION ALL SELECT file, id, 'causal' FROM c WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.file = c.file AND seeds.start = c.id)"""
_MARKERS = "rewr|replac|instead|supersed|overr|swap|rebuil|demot"


def _us(df, col="timestamp"):
    return df.withColumn("us", F.unix_micros(F.col(col).cast("timestamp")))


def _explicit(s, d):
    """Links of a chunk's event to the events the chunk lists, with the relation the ontology infers; causal ones pass the gate, the others are written as they are."""
    c = table(s, d, "chunks").select(F.col("source_event_id").alias("source"), F.explode(F.from_json("event_ids", "array<string>")).alias("target")).where("source <> '' and source <> target").distinct()
    cl = _classes(s, d)
    j = c.join(cl.select(F.col("id").alias("source"), F.col("class").alias("a")), "source", "left").join(cl.select(F.col("id").alias("target"), F.col("class").alias("b")), "target", "left")
    rel, _ = G.inferred_relation(F.col("a"), F.col("b"))
    links = j.select("source", "target", F.coalesce(rel, F.lit("related_to")).alias("relation"), F.lit(1.0).alias("weight"))
    ends = _us(_ev(s, d)).select("id", "us", _anchor_list().alias("anchors"), E.metadata("session_id").alias("session"))
    p = links.join(ends.select(F.col("id").alias("source"), F.col("us").alias("s_us"), F.col("anchors").alias("s_anchors")), "source", "left")
    p = p.join(ends.select(F.col("id").alias("target"), F.col("us").alias("t_us"), F.col("anchors").alias("t_anchors"), F.col("session").alias("t_session")), "target", "left")
    g = G.causal_gate(p.withColumn("s_global", F.lit(False)))
    gate = F.when(~F.col("relation").isin(G.CAUSAL), "semantic").when(F.col("s_us").isNull() | F.col("t_us").isNull(), "missing").otherwise(F.coalesce("reason", F.lit("causal")))
    return g.select("source", "target", "relation", "weight", gate.alias("gate"))


def _anchor_list():
    """Session, service, module and job of an event, those it has."""
    named = [F.concat(F.lit(f"{k}:"), E.metadata(f)) for k, f in (("session", "session_id"), ("service", "service_name"), ("module", "module_path"))]
    return F.filter(F.array(*named, F.concat(F.lit("job:"), F.nullif("job_id", F.lit("")))), lambda a: a.isNotNull())


def _semantic(s, d, least=0.85):
    """Links between an event and its reasoning candidates of a cosine of ``least``, where the ontology knows a relation of their classes.

    An event's vector is its first chunk's, the latest embedded; twelve candidates an event at most.
    """
    v = table(s, d, "event_vectors").where("event_id <> '' and chunk_seq = 0 and size(embedding) = 64")
    v = v.groupBy(F.col("event_id").alias("id")).agg(F.max_by("embedding", F.struct("embedded_at", "embedding")).alias("e"))
    cl = _classes(s, d)
    n = cl.join(v, "id")
    c = _candidates(s, d).select(F.least("id", "other").alias("source"), F.greatest("id", "other").alias("target")).distinct()
    j = c.join(n.select(F.col("id").alias("source"), F.col("class").alias("a"), F.col("e").alias("x")), "source").join(n.select(F.col("id").alias("target"), F.col("class").alias("b"), F.col("e").alias("y")), "target")
    rel, turned = G.inferred_relation(F.col("a"), F.col("b"))
    j = j.withColumn("relation", rel).withColumn("turned", turned).where("relation is not null").withColumn("weight", T.cosine(F.col("x"), F.col("y"))).where(F.col("weight") >= least)
    return j.select(F.when(F.col("turned"), F.col("target")).otherwise(F.col("source")).alias("source"), F.when(F.col("turned"), F.col("source")).otherwise(F.col("target")).alias("target"), "relation", "weight")


def _history(s, d):
    """Events of each source file with the causes of those events, two levels back: (file, id, how), direct before causal.

    All files at once: seeds by path or name, then one traversal for all seeds.
    """
    ev = _ev(s, d, "json_cache")
    seeds = E.file_refs(ev).where(~F.col("file_path").endswith(".md")).select(F.col("file_path").alias("file"), F.col("event_id").alias("start")).distinct()
    chain = G.causal_chain(table(s, d, "graph_edges"), seeds.select("start"), 2).join(ev.select("id"), "id", "left_semi")
    causal = seeds.join(chain, "start").select("file", "id", F.lit("causal").alias("how")).distinct()
    direct = seeds.select("file", F.col("start").alias("id"), F.lit("direct").alias("how"))
    return direct.unionByName(causal.join(direct.select("file", "id"), ["file", "id"], "left_anti"))


def _overrides(s, d):
    """Related decisions of which the later one says that it replaces: later to earlier."""
    ev = _us(_ev(s, d)).where("type in ('decision', 'convention', 'requirement')").select("id", "us", "summary")
    e = table(s, d, "graph_edges").select("source", "target").distinct()
    j = e.join(ev.select(F.col("id").alias("source"), F.col("us").alias("su"), F.col("summary").alias("ss")), "source").join(ev.select(F.col("id").alias("target"), F.col("us").alias("tu"), F.col("summary").alias("ts")), "target")
    later = F.struct("su", "source") > F.struct("tu", "target")
    said = F.when(later, F.col("ss")).otherwise(F.col("ts"))
    j = j.where(F.lower(said).rlike(_MARKERS) & (F.col("source") != F.col("target")))
    return j.select(F.when(later, F.col("source")).otherwise(F.col("target")).alias("newer"), F.when(later, F.col("target")).otherwise(F.col("source")).alias("older")).distinct()


def _correlated(s, d):
    """Every commit and document of at most three days apart of which the text contains a keyword of the commit, with the number contained.

    Each document is searched for the distinct keywords of its day; what it holds meets the commits by day and word.
    """
    c = _ev(s, d).where("type = 'git_commit'").select("id", F.explode(T.keywords(F.col("summary"))).alias("word"), "date")
    c = c.select("id", "word", F.explode(F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda k: F.date_add("date", k))).alias("day"))
    words = c.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("word")), "\n").alias("words"))  # a keyword holds no blank

    def run(batches):
        kept = {}
        for b in batches:
            rows = []
            for doc, day, text, said in zip(b.doc_id, b.day, b.text, b.words):
                if said not in kept:
                    kept = {said: said.split("\n")} if len(kept) > 64 else kept | {said: said.split("\n")}
                if hit := [w for w in kept[said] if w in text]:
                    rows.append((doc, day, hit))
            yield pd.DataFrame(rows, columns=["doc_id", "day", "words"])

    t = table(s, d, "documents").where("text is not null").select("doc_id", F.to_date("created_at").alias("day"), F.lower("text").alias("text")).distinct()
    held = t.join(words, "day").select("doc_id", "day", "text", "words").mapInPandas(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, day date, words array<string>")
    held = held.select("doc_id", "day", F.explode("words").alias("word")).distinct()
    return c.join(held, ["day", "word"]).groupBy("id", "doc_id").agg(F.countDistinct("word").alias("score"))


def _candidates(s, d):
    """For every event: which of the 48 newest others share session, job, module or a file; the first 12."""
    from pyspark.sql import Window

    ev = _us(_ev(s, d)).select("id", "us", "json_cache", "markdown_path", F.array(F.concat(F.lit("j:"), F.nullif("job_id", F.lit(""))), F.concat(F.lit("s:"), F.nullif(E.metadata("session_id"), F.lit(""))), F.concat(F.lit("m:"), F.nullif(E.metadata("module_path"), F.lit("")))).alias("k"))
    files = lambda e: E.file_refs(e).select(F.col("event_id").alias("id"), F.concat(F.lit("f:"), "file_path").alias("key"))
    keys = lambda e: e.select("id", F.explode("k").alias("key")).where("key is not null").unionByName(files(e))
    newest = ev.orderBy(F.desc("us"), "id").limit(49)  # 49 rows
    place = newest.select("id", F.row_number().over(Window.orderBy(F.desc("us"), "id")).alias("place"))
    b = keys(newest).join(place, "id").select(F.col("id").alias("other"), "place", "key")
    own = place.select("id", F.col("place").alias("own"))
    j = keys(ev).join(F.broadcast(b), "key").where("id <> other").select("id", "other", "place").distinct().join(F.broadcast(own), "id", "left")
    j = j.where(F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0) <= 48)  # 48 others than itself
    w = Window.partitionBy("id").orderBy("place")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("id", "other", F.col("rank").cast("long").alias("rank"))


def _best_prompt(s, d):
    """The best of five prompt vectors for each vector, where the cosine exceeds 0.7; five columns, no join."""
    v = table(s, d, "embeddings")
    p = {r.vec_id: [float(x) for x in r.embedding] for r in v.where("vec_id < 5").select("vec_id", "embedding").collect()}  # five rows by definition
    scores = F.array(*[F.struct(T.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in e])).alias("c"), F.lit(-k).alias("k")) for k, e in sorted(p.items())])
    return v.select("vec_id", F.array_max(scores).alias("b")).where("b.c > 0.7").select("vec_id", (-F.col("b.k")).cast("long").alias("prompt"), F.round("b.c", 6).alias("score"))


def _stream(s, d, name, build, mode):
    """A stream over the events table run to its end; results go to the shared folder, never to the driver.

    A batch that is replayed overwrites its own folder. In complete mode the last batch is the result.
    """
    import uuid

    from lodestrand.tables import ensure_checkpoint_dir

    schema = table(s, d, "events").schema
    at = f"{ensure_checkpoint_dir(s).rstrip('/')}/streams/{name}_{uuid.uuid4().hex[:8]}"
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    folder = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = s.readStream.schema(schema)  # a file source watches folders
    df = build(reader.parquet(f"{d}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(d))

    def put(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{'all' if mode == 'complete' else f'b{number}'}")

    run = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.option("recursiveFileLookup", True).schema(df.schema).parquet(f"{at}/out")


QUERIES = {
    "jn7_similar_vectors": (
        lambda s, d: _similar(s, d),
        """SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
           WHERE q.vec_id % 100 = 0 AND list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) >= 0.3""",
    ),
    "jn9_overrides": (
        _overrides,
        _LATEST + f""", x AS (SELECT id, {_US} AS us, lower(summary) AS said FROM ev WHERE type IN ('decision', 'convention', 'requirement')),
            p AS (SELECT DISTINCT source, target FROM graph_edges WHERE source <> target),
            j AS (SELECT a.id AS a, b.id AS b, (a.us, a.id) > (b.us, b.id) AS later, CASE WHEN (a.us, a.id) > (b.us, b.id) THEN a.said ELSE b.said END AS said FROM p JOIN x a ON a.id = p.source JOIN x b ON b.id = p.target)
            SELECT DISTINCT CASE WHEN later THEN a ELSE b END AS newer, CASE WHEN later THEN b ELSE a END AS older FROM j WHERE regexp_matches(said, '{_MARKERS}')""",
    ),
    "jn10_explicit_links": (
        _explicit,
        _LATEST + f""", {_CLASSES}, {_ONTOLOGY}, c AS (SELECT DISTINCT source_event_id AS source, unnest(from_json(event_ids, '["VARCHAR"]')) AS target FROM chunks WHERE source_event_id <> ''),
            j AS (SELECT c.source, c.target, a.class AS a, b.class AS b FROM c LEFT JOIN classes a ON a.id = c.source LEFT JOIN classes b ON b.id = c.target WHERE c.source <> c.target),
            r AS (SELECT source, target, coalesce((SELECT arg_min(rel, ord) FROM ontology WHERE dom = a AND rng = b), (SELECT arg_min(rel, ord) FROM ontology WHERE dom = b AND rng = a), 'related_to') AS relation FROM j),
            n AS (SELECT id, epoch_us(timestamp) AS us, json_extract_string(json_cache, '$.metadata.session_id') AS se, json_extract_string(json_cache, '$.metadata.service_name') AS sv, json_extract_string(json_cache, '$.metadata.module_path') AS mo, nullif(job_id, '') AS jo FROM ev)
            SELECT source, target, relation, 1.0::DOUBLE AS weight, CASE WHEN relation <> 'triggers' THEN 'semantic' WHEN x.id IS NULL OR y.id IS NULL THEN 'missing' WHEN y.us + 1000000 < x.us THEN 'time'
                WHEN NOT (coalesce(x.se = y.se, FALSE) OR coalesce(x.sv = y.sv, FALSE) OR coalesce(x.mo = y.mo, FALSE) OR coalesce(x.jo = y.jo, FALSE)) THEN 'isolation' ELSE 'causal' END AS gate
            FROM r LEFT JOIN n x ON x.id = source LEFT JOIN n y ON y.id = target""",
    ),
    "jn11_correlated_documents": (
        _correlated,
        _LATEST + """, k AS (SELECT DISTINCT id, date, regexp_replace(w, '""" + _sql(T.KEYWORD_EDGES) + """', '', 'g') AS word FROM (SELECT id, date, unnest(regexp_split_to_array(lower(trim(summary)), '\\s+')) AS w FROM ev WHERE type = 'git_commit') WHERE length(w) >= 3 AND w NOT IN ("""
        + ",".join(f"'{w}'" for w in T.STOP_WORDS)
        + """)), t AS (SELECT DISTINCT doc_id, CAST(created_at AS DATE) AS day, lower(text) AS said FROM documents)
            SELECT id, doc_id, count(*) AS score FROM k JOIN t ON t.day BETWEEN k.date - 3 AND k.date + 3 AND contains(said, word) WHERE word <> '' GROUP BY 1, 2""",
    ),
    "jn13_candidates": (_candidates, _LATEST + _CANDIDATES + " SELECT id, other, rank FROM cand"),
    "re1_all_links": (
        lambda s, d: G.time_links(_ev(s, d)).withColumn("origin", F.lit("time")).unionByName(_semantic(s, d).withColumn("origin", F.lit("semantic"))).select("origin", "source", "target", "relation", F.round("weight", 6).alias("weight")),
        _SEMANTIC + JN6_SQL[len(_LATEST) :].replace("\n            SELECT CASE", ", time_links AS (SELECT CASE") + """)
            SELECT 'time' AS origin, source, target, relation, weight FROM time_links UNION ALL SELECT 'semantic', source, target, relation, round(weight, 6) FROM sem""",
    ),
    "jn7_semantic_links": (lambda s, d: _semantic(s, d, 0.0).withColumn("weight", F.round("weight", 6)), _SEMANTIC.replace(">= 0.85", ">= 0.0") + " SELECT source, target, relation, round(weight, 6) AS weight FROM sem"),
    "jn19_causal_history": (_history, _HISTORY),
    "tx10_best_prompt": (
        _best_prompt,
        """SELECT vec_id, prompt, round(c, 6) AS score FROM (SELECT v.vec_id, p.vec_id AS prompt, list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS c,
             row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]) DESC, p.vec_id) AS r FROM embeddings v JOIN embeddings p ON p.vec_id < 5) WHERE r = 1 AND c > 0.7""",
    ),
    "tx19_models": (
        lambda s, d: _model(s, d),
        "SELECT source, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{rx}') THEN '{n}'" for n, rx in T.MODELS) + " END AS model, count(*) AS n FROM documents GROUP BY 1, 2",
    ),
    "tx21_python_definitions": (
        lambda s, d: C.facts(table(s, d, "raw_data").where("source = 'file'")).where(F.col("file_path").endswith(".py") & F.col("kind").isin("function", "method", "class")).select(F.concat_ws(":", "file_path", "name").alias("id"), "kind").distinct(),
        "SELECT DISTINCT id, type AS kind FROM code_entities WHERE file_path LIKE '%.py'",
    ),
    "gr11_dependencies": (
        lambda s, d: C.facts(table(s, d, "raw_data").where("source = 'file'")).where("kind in ('call', 'import')").groupBy("kind", "name").agg(F.countDistinct("file_path").alias("n_files"), F.countDistinct("file_path", "owner", "line").alias("n")),
        None,
    ),
    "tx27_sections": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(#{1,6} [^\r\n]+)"), F.lit(1))).alias("h")).groupBy("h").agg(F.count("*").alias("n")),
        r"SELECT h, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?m)^(#{1,6} [^\r\n]+)', 1)) AS h FROM documents) GROUP BY 1",
    ),
    "tx29_reclassified": (
        lambda s, d: _ev(s, d, "type", "summary", "json_cache").where("type = 'unknown'").select("id", T.event_type(F.concat_ws(" ", "summary", "json_cache")).alias("kind")),
        _LATEST + f"SELECT id, {_type_sql(chr(34) + 'both' + chr(34))} AS kind FROM (SELECT id, concat_ws(' ', summary, json_cache) AS both FROM ev WHERE type = 'unknown')",
    ),
    "fl14_type_policies": (
        lambda s, d: _ev(s, d, "type").select("id", F.coalesce(G.class_of(F.col("type")), F.when(F.col("type").isin(LEGACY), "legacy")).alias("class"), F.col("type").isin(LEGACY).alias("is_legacy")),
        _LATEST + """SELECT id, CASE type WHEN 'decision' THEN 'Decision' WHEN 'git_commit' THEN 'Commit' WHEN 'code_change' THEN 'Commit' WHEN 'incident' THEN 'Incident' WHEN 'experiment' THEN 'Experiment' WHEN 'requirement' THEN 'Requirement' WHEN 'convention' THEN 'Convention' ELSE 'legacy' END AS class,
            type IN ('diagnostic','research','discussion','task','resource','unknown','failed_attempt','abandoned_idea','ai_conversation','reasoning','convention') AS is_legacy FROM ev""",
    ),
    "fl21_prefix_outcomes": (
        lambda s, d: _by_prefix(s, d),
        _LATEST + """, q AS (SELECT DISTINCT substr(id, 1, 9) AS prefix FROM ev UNION ALL SELECT unnest(['evt', 'evt_zzzz'])),
            m AS (SELECT prefix, count(id) AS n, count(id) FILTER (type = 'decision') AS nd, min(id) FILTER (type = 'decision') AS id FROM q LEFT JOIN ev ON starts_with(id, prefix) AND length(prefix) >= 4 GROUP BY 1),
            o AS (SELECT prefix, CASE WHEN length(prefix) < 4 THEN 'too_short' WHEN n = 0 THEN 'missing' WHEN nd = 0 THEN 'wrong_type' WHEN nd > 1 THEN 'ambiguous' ELSE 'unique' END AS outcome, CASE WHEN nd = 1 THEN id END AS id FROM m)
            SELECT prefix, outcome, o.id, CASE WHEN o.id IS NULL THEN 0 ELSE least(3, (SELECT count(*) FROM ev b WHERE b.timestamp < e.timestamp)) + least(3, (SELECT count(*) FROM ev b WHERE b.timestamp > e.timestamp)) END AS n_near FROM o LEFT JOIN ev e ON e.id = o.id""",
    ),
    "wn4_adjacent_pairs": (
        lambda s, d: _adjacent(s, d),
        _LATEST + f"SELECT previous, id FROM (SELECT id, {_US} AS us, lag(id) OVER (ORDER BY timestamp, id) AS previous FROM ev) WHERE previous IS NOT NULL ORDER BY us DESC, id LIMIT 20",
    ),
    "wn6_source_changes": (
        lambda s, d: slots.changed_rows(_us(_ev(s, d, "timestamp", "date", "source")).select("id", "us", "date", "source"), ["date"], "us", "id", "source").select("id", F.col("date").cast("string").alias("day"), "source"),
        _LATEST + "SELECT id, CAST(date AS VARCHAR) AS day, source FROM (SELECT id, date, source, lag(source) OVER w AS p, row_number() OVER w AS r FROM ev WINDOW w AS (PARTITION BY date ORDER BY timestamp, id)) WHERE r = 1 OR p IS DISTINCT FROM source",
    ),
    "stm4_state_changes": (
        lambda s, d: slots.changed_rows(_us(table(s, d, "events"), "ts").select("event_id", "user_id", "us", "event_type"), ["user_id"], "us", "event_id", "event_type").select("user_id", "us", "event_type"),
        "SELECT user_id, us, event_type FROM (SELECT user_id, epoch_us(ts) AS us, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR p <> event_type",
    ),
    "stm_tumbling": (
        lambda s, d: _stream(s, d, "tumbling", lambda df: state.tumbling(df, "ts", "1 hour", "1 day", ["event_type"]), "complete"),
        "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "stm_sliding": (
        lambda s, d: _stream(s, d, "sliding", lambda df: state.tumbling(df, "ts", "2 hours", "1 day", ["event_type"], "1 hour"), "complete"),
        "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) - k * 3600000000 AS start_us, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2",
    ),
    "stm_sessions": (
        lambda s, d: _stream(s, d, "sessions", lambda df: state.sessions(df, "user_id", "ts", 600, "0 seconds", "event_id"), "append"),
        """WITH m AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 600000000 THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
           r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM m)
           SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM r GROUP BY user_id, run HAVING max(us) + 599999999 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)""",
    ),
    "stm2_debounced": (
        lambda s, d: _stream(s, d, "debounced", lambda df: state.debounce(df, "user_id", "ts", 3600.0), "append"),
        """WITH RECURSIVE k(user_id, us) AS (SELECT user_id, min(epoch_us(ts)) FROM events GROUP BY 1
             UNION ALL SELECT k.user_id, (SELECT min(epoch_us(e.ts)) FROM events e WHERE e.user_id = k.user_id AND epoch_us(e.ts) - k.us > 3600000000) FROM k WHERE us IS NOT NULL)
           SELECT CAST(user_id AS VARCHAR) AS user_id, us FROM k WHERE us IS NOT NULL""",
    ),
    "ag19_findings_by_source": (
        lambda s, d: table(s, d, "sensitive_findings").join(table(s, d, "raw_data").select(F.col("id").alias("raw_id"), "source").distinct(), "raw_id").groupBy("source", "type").agg(F.count("*").alias("n"), F.countDistinct("raw_id").alias("n_records")),
        "SELECT r.source, f.type, count(*) AS n, count(DISTINCT f.raw_id) AS n_records FROM sensitive_findings f JOIN (SELECT DISTINCT id, source FROM raw_data) r ON r.id = f.raw_id GROUP BY 1, 2",
    ),
    "ag22_audit": (
        lambda s, d: _audit(s, d),
        _LATEST + f""", {_CLASSES}, {_ONTOLOGY}, f AS (SELECT 'commit_without_cause' AS check_name, FALSE AS blocking, count(*) AS n FROM ev WHERE type LIKE '%commit' AND id NOT IN (SELECT source FROM graph_edges WHERE relation IN ('realizes', 'fixes') AND source IS NOT NULL)
            UNION ALL SELECT 'duplicate_name', TRUE, count(*) FROM (SELECT name FROM code_entities GROUP BY 1 HAVING count(DISTINCT file_path) > 1)
            UNION ALL SELECT 'self_edge', TRUE, count(*) FROM (SELECT DISTINCT source, target, relation FROM graph_edges WHERE source = target)
            UNION ALL SELECT 'bad_relation', FALSE, count(*) FROM (SELECT DISTINCT source, target, relation FROM graph_edges LEFT JOIN ontology o ON o.rel = relation LEFT JOIN classes a ON a.id = source LEFT JOIN classes b ON b.id = target WHERE o.rel IS NULL OR a.class IS DISTINCT FROM o.dom OR b.class IS DISTINCT FROM o.rng)
            UNION ALL SELECT 'untraced_function', FALSE, count(DISTINCT target) FROM graph_edges WHERE relation = 'modifies' AND source NOT IN (SELECT source FROM graph_edges WHERE relation = 'realizes' AND source IS NOT NULL)
            UNION ALL SELECT 'events_of_last_day', FALSE, count(*) FROM ev WHERE date = (SELECT max(date) FROM ev))
            SELECT *, blocking AND n > 0 AS fails FROM f UNION ALL SELECT 'exit_code', TRUE, bool_or(blocking AND n > 0)::INT, bool_or(blocking AND n > 0) FROM f""",
    ),
    "ag23_daily_messages": (
        lambda s, d: _messages(s, d),
        _LATEST + "SELECT CAST(date AS VARCHAR) AS day, sum(n) || ' events: ' || string_agg(type || '=' || n, ', ' ORDER BY type) AS message FROM (SELECT date, type, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1",
    ),
    "ax6_modules": (
        lambda s, d: table(s, d, "code_entities").select(F.regexp_extract("file_path", r"([^/]*?)(?:\.py)?$", 1).alias("module")).distinct(),
        r"SELECT DISTINCT regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.py$', '') AS module FROM code_entities",
    ),
    "ax7_mermaid": (
        lambda s, d: table(s, d, "graph_edges").where("source is not null and target is not null").select(F.format_string("%s -->|%s| %s", "source", "relation", "target").alias("line")).distinct(),
        "SELECT DISTINCT source || ' -->|' || relation || '| ' || target AS line FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL",
    ),
    "tk5_trace": (
        lambda s, d: _trace(s, d),
        _LATEST + f"""SELECT id, kind, relevance FROM (SELECT id, 'event' AS kind, CASE WHEN contains(lower(tags), 'cache') THEN 0.9 ELSE 0.6 END::DOUBLE AS relevance, {_US} AS us FROM ev WHERE contains(lower(tags), 'cache') OR contains(lower(summary), 'cache')
            UNION ALL SELECT DISTINCT id, 'code', CASE WHEN lower(name) = 'cache' THEN 1.0 ELSE 0.8 END::DOUBLE, 0 FROM code_entities WHERE contains(lower(name), 'cache')) ORDER BY relevance DESC, us DESC, id LIMIT 200""",
    ),
}


def _similar(s, d):
    v = table(s, d, "embeddings")
    return V.similar_to(v.where("vec_id % 100 = 0"), v, 0.3, "vec_id").withColumn("score", F.round("score", 6))


def _model(s, d):
    return table(s, d, "documents").groupBy("source", T.model_of(F.col("text")).alias("model")).agg(F.count("*").alias("n"))


def _adjacent(s, d):
    p = slots.with_previous(_us(_ev(s, d, "timestamp")).select("id", "us"), [], "us", "id", "id", 24 * slots.HOUR)
    return p.where("has_previous").orderBy(F.desc("us"), "id").limit(20).select("previous", "id")


def _by_prefix(s, d):
    """What a prefix of an id leads to: too short, missing, no decision, several, or one with its neighbours."""
    ev = _ev(s, d, "type", "timestamp")
    asked = ev.select(F.substring("id", 1, 9).alias("prefix")).distinct().unionByName(s.createDataFrame([("evt",), ("evt_zzzz",)], "prefix string"))
    # ids by each length a prefix may have here: an equi-join
    ids = ev.select("id", "type", F.explode(F.array(*[F.substring("id", 1, n) for n in (8, 9)])).alias("prefix"))
    m = asked.join(ids, "prefix", "left").groupBy("prefix").agg(F.count("id").alias("n"), F.count_if(F.col("type") == "decision").alias("nd"), F.min(F.when(F.col("type") == "decision", F.col("id"))).alias("one"))
    outcome = F.when(F.char_length("prefix") < 4, "too_short").when(F.col("n") == 0, "missing").when(F.col("nd") == 0, "wrong_type").when(F.col("nd") > 1, "ambiguous").otherwise("unique")
    o = m.select("prefix", outcome.alias("outcome"), F.when(F.col("nd") == 1, F.col("one")).alias("id"))
    near = E.neighbours(ev, 3).groupBy("id").agg(F.count("*").alias("n_near"))
    return o.join(near, "id", "left").select("prefix", "outcome", "id", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def _audit(s, d):
    """Every check with its findings, the statistics of the last day, and 1 as exit code where a blocking check fails."""
    one = lambda name, blocking, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), F.lit(blocking).alias("blocking"), "n")
    e, ev = table(s, d, "graph_edges"), _ev(s, d)
    found = one("commit_without_cause", False, G.commits_without_cause(ev.select("id", "type"), e))
    found = found.unionByName(one("duplicate_name", True, table(s, d, "code_entities").groupBy("name").agg(F.countDistinct("file_path").alias("f")).where("f > 1")))
    found = found.unionByName(one("self_edge", True, e.where("source = target").select("source", "target", "relation").distinct()))
    found = found.unionByName(one("bad_relation", False, G.unknown_relations(e, _classes(s, d))))
    found = found.unionByName(one("untraced_function", False, G.untraced_functions(e)))
    last = _ev(s, d, "date").groupBy("date").agg(F.count("*").alias("n")).agg(F.max(F.struct("date", "n"))["n"].alias("n"))
    found = found.unionByName(last.select(F.lit("events_of_last_day").alias("check_name"), F.lit(False).alias("blocking"), F.coalesce("n", F.lit(0)).alias("n")))
    found = found.withColumn("fails", F.col("blocking") & (F.col("n") > 0))
    exit_code = found.agg(F.max("fails").alias("fails")).select(F.lit("exit_code").alias("check_name"), F.lit(True).alias("blocking"), F.col("fails").cast("long").alias("n"), "fails")
    return found.unionByName(exit_code)


def _messages(s, d):
    n = _ev(s, d, "date", "type").groupBy("date", "type").agg(F.count("*").alias("n"))  # few types a day
    parts = F.array_sort(F.collect_list(F.concat("type", F.lit("="), F.col("n").cast("string"))))
    return n.groupBy(F.col("date").cast("string").alias("day")).agg(F.concat(F.sum("n").cast("string"), F.lit(" events: "), F.array_join(parts, ", ")).alias("message"))


def _trace(s, d):
    ev = _us(_ev(s, d)).where(F.lower("tags").contains("cache") | F.lower("summary").contains("cache"))
    ev = ev.select("id", F.lit("event").alias("kind"), F.when(F.lower("tags").contains("cache"), 0.9).otherwise(0.6).alias("relevance"), "us")
    code = table(s, d, "code_entities").where(F.lower("name").contains("cache")).select("id", F.lit("code").alias("kind"), F.when(F.lower("name") == "cache", 1.0).otherwise(0.8).alias("relevance"), F.lit(0).cast("long").alias("us")).distinct()
    return ev.unionByName(code).orderBy(F.desc("relevance"), F.desc("us"), "id").limit(200).select("id", "kind", "relevance")


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
