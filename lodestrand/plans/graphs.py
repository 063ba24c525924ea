"""Queries on the edge table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import code as C
from lodestrand.operators import events as E
from lodestrand.operators import graph as G
from lodestrand.plans.timeline import _LATEST, _ev
from lodestrand.tables import table

_CAUSAL_SQL = "('caused_by','triggers','leads_to','correlated_with','depends_on_causal','resulted_in')"
# the starts of the traversals: every incident of the index
_STARTS = "starts AS (SELECT DISTINCT id AS start FROM event_index WHERE type = 'incident')"


def _edges(s, d):
    return table(s, d, "graph_edges")


def _starts(s, d, kind="incident"):
    return table(s, d, "event_index").where(F.col("type") == kind).select(F.col("id").alias("start")).distinct()


def _classes(s, d):
    ev = _ev(s, d).select("id", G.class_of(F.col("type")).alias("class")).where("class is not null")
    code = table(s, d, "code_entities").where(F.col("type").isin("function", "method")).select("id", F.lit("Function").alias("class")).distinct()
    return ev.unionByName(code)


_CLASSES = """classes AS (
    SELECT id, CASE type WHEN 'decision' THEN 'Decision' WHEN 'git_commit' THEN 'Commit' WHEN 'code_change' THEN 'Commit' WHEN 'incident' THEN 'Incident'
        WHEN 'experiment' THEN 'Experiment' WHEN 'requirement' THEN 'Requirement' WHEN 'convention' THEN 'Convention' END AS class
    FROM ev WHERE type IN ('decision','git_commit','code_change','incident','experiment','requirement','convention')
    UNION ALL SELECT DISTINCT id, 'Function' FROM code_entities WHERE type IN ('function','method'))"""
_ONTOLOGY = "ontology(rel, dom, rng, ord) AS (VALUES ('implements','Decision','Requirement',1),('realizes','Commit','Decision',2),('modifies','Commit','Function',3),('triggers','Incident','Decision',4),('validates','Experiment','Decision',5),('overrides','Decision','Decision',6),('fixes','Commit','Incident',7))"


# dependencies no module may have; a rule may name any module
_FORBIDDEN = [("src/watermark", "*"), ("*", "lib/cache"), ("tools/descendant", "src/watermark")]


def _cycle_sql(edges: str, columns: str) -> str:
    """Every simple cycle of the edges (a, b), found from its least node."""
    return f"""WITH RECURSIVE e AS ({edges}), w(path, last) AS (
            SELECT [a, b], b FROM e WHERE a < b UNION ALL SELECT list_append(path, b), b FROM w JOIN e ON e.a = w.last WHERE b > path[1] AND NOT list_contains(path, b)),
        c AS (SELECT [a] AS path FROM e WHERE a = b UNION ALL SELECT path FROM w JOIN e ON e.a = w.last AND e.b = path[1])
        SELECT DISTINCT {columns} FROM (SELECT array_to_string(path, ' -> ') AS cycle, CAST(len(path) AS INTEGER) AS length, path[1] AS first_id FROM c)"""


def _chain_sql() -> str:
    """Three levels of causes, each node at the first place where it is met."""
    sql = f"""WITH {_STARTS}, e AS (SELECT source, target, max(created_at) AS c, arg_min(relation, (-created_at, relation)) AS relation FROM graph_edges WHERE relation IN {_CAUSAL_SQL} GROUP BY 1, 2),
        s0 AS (SELECT start, start AS id, 0 AS level, 0 AS place FROM starts)"""
    for k in (1, 2, 3):
        sql += f""", f{k} AS (SELECT n.start, e.source AS id, {k} AS level, min((n.place, -e.c, e.source, e.relation)) AS o FROM s{k - 1} n JOIN e ON e.target = n.id WHERE n.level = {k - 1} AND NOT EXISTS (SELECT 1 FROM s{k - 1} x WHERE x.start = n.start AND x.id = e.source) GROUP BY 1, 2),
        s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT start, id, level, row_number() OVER (PARTITION BY start ORDER BY o) FROM f{k})"""
    return sql + " SELECT start, id, CAST(level AS INTEGER) AS level, row_number() OVER (PARTITION BY start ORDER BY level, place) AS position FROM s3 WHERE level > 0"


def _merged_sql(table_name: str, more: str) -> str:
    """Greatest weight and, of each key of the metadata, the value of the latest row; for metadata without lists."""
    return f"""WITH p AS (SELECT source, target, relation, created_at, metadata, unnest(json_keys(metadata)) AS k FROM {table_name} WHERE metadata IS NOT NULL),
        v AS (SELECT source, target, relation, k, arg_max(json_extract(metadata, '$.' || k)::VARCHAR, (created_at, metadata)) AS j FROM p GROUP BY 1, 2, 3, 4),
        m AS (SELECT source, target, relation, '{{' || string_agg('"' || k || '":' || j, ',' ORDER BY k) || '}}' AS metadata FROM v GROUP BY 1, 2, 3),
        b AS (SELECT source, target, relation, max(weight) AS weight{more} FROM {table_name} GROUP BY 1, 2, 3)
        SELECT b.*, coalesce(m.metadata, '{{}}') AS metadata FROM b LEFT JOIN m ON m.source IS NOT DISTINCT FROM b.source AND m.target IS NOT DISTINCT FROM b.target AND m.relation IS NOT DISTINCT FROM b.relation"""


def _reasoned(s, d):
    """Edges between decisions, reasonings and conventions."""
    x = _ev(s, d, "type").where("type in ('decision', 'reasoning', 'convention')").select("id")
    e = _edges(s, d).select("source", "target").distinct()
    return e.join(x.withColumnRenamed("id", "source"), "source", "left_semi").join(x.withColumnRenamed("id", "target"), "target", "left_semi")


def _file_imports(s, d):
    """Files and the files their imports name, by any of the names a file has."""
    files = table(s, d, "code_entities").select("file_path").distinct()
    names = files.select("file_path", F.explode(T.module_names(F.col("file_path"))).alias("module"))
    return G.file_imports(C.facts(table(s, d, "raw_data").where("source = 'file'")), names)


def _gate(s, d):
    ev = _ev(s, d).select(
        "id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), E.metadata("session_id").alias("session"),
        F.filter(F.array(F.concat(F.lit("session:"), E.metadata("session_id")), F.concat(F.lit("module:"), E.metadata("module_path")), F.when(F.col("job_id") != "", F.concat(F.lit("job:"), "job_id"))), lambda a: a.isNotNull()).alias("anchors"),
    )
    e = _edges(s, d).where(F.col("relation").isin(G.CAUSAL)).select("source", "target").distinct()
    p = e.join(ev.select(F.col("id").alias("source"), F.col("us").alias("s_us"), F.col("anchors").alias("s_anchors")), "source")
    p = p.join(ev.select(F.col("id").alias("target"), F.col("us").alias("t_us"), F.col("anchors").alias("t_anchors"), F.col("session").alias("t_session")), "target")
    return G.causal_gate(p.withColumn("s_global", F.lit(False))).select("source", "target", F.size("shared").alias("n_shared"), F.coalesce("reason", F.lit("accepted")).alias("verdict"))


def _inferred(s, d):
    c = _classes(s, d)
    e = _edges(s, d).where("relation = 'related_to'").select("source", "target").distinct()
    p = e.join(c.select(F.col("id").alias("source"), F.col("class").alias("a")), "source").join(c.select(F.col("id").alias("target"), F.col("class").alias("b")), "target")
    rel, rev = G.inferred_relation(F.col("a"), F.col("b"))
    return p.select("source", "target", rel.alias("relation"), rev.alias("is_reversed")).where("relation is not null")


def _file_history(s, d):
    from pyspark.sql import Window

    m = _edges(s, d).where("relation = 'modifies'").select("source", "target").distinct().join(_ev(s, d).select(F.col("id").alias("source"), "timestamp"), "source")
    # a hot file keeps only its newest ten per salt before they meet
    salted = Window.partitionBy("target", F.pmod(F.xxhash64("source"), F.lit(64))).orderBy(F.desc("timestamp"), "source")
    w = Window.partitionBy("target").orderBy(F.desc("timestamp"), "source")
    m = m.withColumn("r", F.row_number().over(salted)).where("r <= 10").drop("r")
    return m.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("target", "source", F.col("rank").cast("long").alias("rank"))


JN6_SQL = (
    _LATEST + """, e AS (SELECT * FROM (SELECT id, epoch_us(timestamp) AS us, lower(summary) AS said,
              CASE WHEN type IN ('git_commit','code_change') THEN 'c' WHEN type = 'decision' THEN 'd'
                   WHEN type = 'incident' OR (type IN ('diagnostic','unknown') AND regexp_matches(lower(summary), 'error|fail|exception|bug|crash')) THEN 'i' END AS k FROM ev) WHERE k IS NOT NULL),
            p AS (SELECT c.id AS cid, b.id AS pid, CASE WHEN c.k = 'c' AND b.k = 'i' AND regexp_matches(c.said, 'fix|resolv|close') THEN 'fixes'
                  WHEN c.k = 'c' AND b.k = 'd' AND regexp_matches(c.said, 'implement|feat|reali') THEN 'realizes'
                  WHEN c.k = 'd' AND b.k = 'i' AND regexp_matches(c.said, 'incident|outage|fail|fix') THEN 'triggers' END AS relation
                FROM e c JOIN e b ON c.us - b.us BETWEEN 0 AND 7200000000 AND (b.us < c.us OR (b.us = c.us AND b.id < c.id)))
            SELECT CASE WHEN relation = 'triggers' THEN pid ELSE cid END AS source, CASE WHEN relation = 'triggers' THEN cid ELSE pid END AS target, relation, 0.7::DOUBLE AS weight FROM p WHERE relation IS NOT NULL"""
)

QUERIES = {
    "gr1_related": (
        lambda s, d: G.related(_edges(s, d), _starts(s, d)),
        f"""WITH {_STARTS}, e AS (SELECT source AS start, target AS id FROM graph_edges UNION SELECT target, source FROM graph_edges)
            SELECT start, id FROM e WHERE start IN (SELECT start FROM starts) AND start <> id""",
    ),
    "gr2_file_history": (
        _file_history,
        _LATEST + """SELECT target, source, rank FROM (SELECT g.target, g.source, row_number() OVER (PARTITION BY g.target ORDER BY ev.timestamp DESC, g.source) AS rank
            FROM (SELECT DISTINCT source, target FROM graph_edges WHERE relation = 'modifies') g JOIN ev ON ev.id = g.source) WHERE rank <= 10""",
    ),
    "gr3_causal_chain": (
        lambda s, d: G.causal_chain(_edges(s, d), _starts(s, d), 3).select("start", "id", "level", F.col("position").cast("long").alias("position")),
        _chain_sql(),
    ),
    "gr4_two_hops": (
        lambda s, d: G.edges_within(_edges(s, d), _starts(s, d), 2),
        f"""WITH RECURSIVE {_STARTS}, e AS (SELECT source AS a, target AS b FROM graph_edges UNION SELECT target, source FROM graph_edges),
            walk(start, id, level) AS (SELECT start, start, 0 FROM starts UNION SELECT w.start, e.b, w.level + 1 FROM walk w JOIN e ON e.a = w.id WHERE w.level < 2),
            n AS (SELECT start, id, CAST(min(level) AS INTEGER) AS level FROM walk GROUP BY 1, 2), g AS (SELECT DISTINCT source, target, relation FROM graph_edges)
            SELECT start, source, target, relation, min(level) AS level FROM (SELECT start, g.*, level FROM g JOIN n ON n.id = source UNION ALL SELECT start, g.*, level FROM g JOIN n ON n.id = target) GROUP BY 1, 2, 3, 4""",
    ),
    "gr5_descendants": (
        lambda s, d: G.reach(_edges(s, d).where("relation = 'triggers'"), _starts(s, d)),
        f"""WITH RECURSIVE {_STARTS}, e AS (SELECT DISTINCT source, target FROM graph_edges WHERE relation = 'triggers'),
            walk(start, id) AS (SELECT s.start, e.target FROM starts s JOIN e ON e.source = s.start UNION SELECT w.start, e.target FROM walk w JOIN e ON e.source = w.id)
            SELECT start, id FROM walk WHERE start <> id""",
    ),
    "gr5_ancestors": (
        lambda s, d: G.reach(_edges(s, d).where("relation = 'caused_by'"), _starts(s, d), backward=True),
        f"""WITH RECURSIVE {_STARTS}, e AS (SELECT DISTINCT source, target FROM graph_edges WHERE relation = 'caused_by'),
            walk(start, id) AS (SELECT s.start, e.source FROM starts s JOIN e ON e.target = s.start UNION SELECT w.start, e.source FROM walk w JOIN e ON e.target = w.id)
            SELECT start, id FROM walk WHERE start <> id""",
    ),
    "gr6_cycles": (
        lambda s, d: G.all_cycles(_reasoned(s, d)),
        _LATEST.replace("WITH ev", "WITH RECURSIVE ev") + ", " + _cycle_sql("SELECT DISTINCT source AS a, target AS b FROM graph_edges WHERE source IN (SELECT id FROM ev WHERE type IN ('decision', 'reasoning', 'convention')) AND target IN (SELECT id FROM ev WHERE type IN ('decision', 'reasoning', 'convention'))", "cycle, length").replace("WITH RECURSIVE ", "", 1),
    ),
    "gr7_import_cycles": (lambda s, d: G.all_cycles(_file_imports(s, d)), None),
    "gr8_experts": (
        lambda s, d: _edges(s, d).where("relation = 'modifies'").select(F.col("target").alias("file"), F.col("source").alias("expert")).distinct(),
        "SELECT DISTINCT target AS file, source AS expert FROM graph_edges WHERE relation = 'modifies'",
    ),
    "gr9_derived_edges": (
        lambda s, d: _derived(s, d),
        """WITH f AS (SELECT DISTINCT id, file FROM (SELECT id, unnest(files_mentioned) AS file FROM raw_data WHERE source <> 'file'))
           SELECT id AS source, file AS target, 'mentions' AS relation FROM f
           UNION ALL SELECT DISTINCT x.file, y.file, 'co_modified' FROM f x JOIN f y ON x.id = y.id AND x.file < y.file""",
    ),
    "cg1_causal_gate": (
        _gate,
        _LATEST + f""", a AS (SELECT id, epoch_us(timestamp) AS us, json_extract_string(json_cache, '$.metadata.session_id') AS se, json_extract_string(json_cache, '$.metadata.module_path') AS mo, nullif(job_id, '') AS jo FROM ev),
            e AS (SELECT DISTINCT source, target FROM graph_edges WHERE relation IN {_CAUSAL_SQL}),
            p AS (SELECT source, target, s.us AS su, t.us AS tu, coalesce((s.se = t.se)::INT, 0) + coalesce((s.mo = t.mo)::INT, 0) + coalesce((s.jo = t.jo)::INT, 0) AS n FROM e JOIN a s ON s.id = source JOIN a t ON t.id = target)
            SELECT source, target, n AS n_shared, CASE WHEN tu + 1000000 < su THEN 'time' WHEN n = 0 THEN 'isolation' ELSE 'accepted' END AS verdict FROM p""",
    ),
    "jn6_time_links": (
        lambda s, d: G.time_links(_ev(s, d, "type", "summary", "timestamp")),
        JN6_SQL,
    ),
    "jn8_inferred": (
        _inferred,
        _LATEST + f""", {_CLASSES}, {_ONTOLOGY}, p AS (SELECT DISTINCT source, target, a.class AS a, b.class AS b FROM graph_edges JOIN classes a ON a.id = source JOIN classes b ON b.id = target WHERE relation = 'related_to'),
            r AS (SELECT source, target, (SELECT arg_min(rel, ord) FROM ontology WHERE dom = a AND rng = b) AS fwd, (SELECT arg_min(rel, ord) FROM ontology WHERE dom = b AND rng = a) AS rev FROM p)
            SELECT source, target, coalesce(fwd, rev) AS relation, fwd IS NULL AS is_reversed FROM r WHERE coalesce(fwd, rev) IS NOT NULL""",
    ),
    "ax1_commits_without_cause": (
        lambda s, d: G.commits_without_cause(_ev(s, d, "type").select("id", "type"), _edges(s, d)),
        _LATEST + "SELECT id FROM ev WHERE type LIKE '%commit' AND id NOT IN (SELECT source FROM graph_edges WHERE relation IN ('realizes', 'fixes') AND source IS NOT NULL)",
    ),
    "ax3_untraced_functions": (
        lambda s, d: G.untraced_functions(_edges(s, d)),
        """SELECT target AS function, count(DISTINCT source) AS n_commits, min(source) AS first_commit FROM graph_edges WHERE relation = 'modifies'
           AND source NOT IN (SELECT source FROM graph_edges WHERE relation = 'realizes' AND source IS NOT NULL) GROUP BY 1""",
    ),
    "ax4_bad_relations": (
        lambda s, d: G.unknown_relations(_edges(s, d), _classes(s, d)),
        _LATEST + f""", {_CLASSES}, {_ONTOLOGY} SELECT source, target, relation, reason FROM (
            SELECT DISTINCT source, target, relation, CASE WHEN o.rel IS NULL THEN 'undefined' WHEN a.class IS DISTINCT FROM o.dom THEN 'domain' WHEN b.class IS DISTINCT FROM o.rng THEN 'range' END AS reason
            FROM graph_edges LEFT JOIN ontology o ON o.rel = relation LEFT JOIN classes a ON a.id = source LEFT JOIN classes b ON b.id = target) WHERE reason IS NOT NULL""",
    ),
    "ax5_layers": (
        lambda s, d: G.layer_violations(_module_edges(s, d), ["lib", "src", "tools"]),
        """WITH m AS (SELECT DISTINCT string_split(x.file_path, '/')[1] || '/' || string_split(x.file_path, '/')[2] AS source, string_split(y.file_path, '/')[1] || '/' || string_split(y.file_path, '/')[2] AS target
              FROM code_entities x JOIN code_entities y ON x.name = y.name AND x.file_path <> y.file_path),
           r AS (SELECT *, CASE WHEN contains(source, 'lib') THEN 0 WHEN contains(source, 'src') THEN 1 WHEN contains(source, 'tools') THEN 2 END AS a, CASE WHEN contains(target, 'lib') THEN 0 WHEN contains(target, 'src') THEN 1 WHEN contains(target, 'tools') THEN 2 END AS b FROM m)
           SELECT DISTINCT source, target FROM r WHERE a > b""",
    ),
    "ax5_forbidden": (
        lambda s, d: G.forbidden_dependencies(_module_edges(s, d), _FORBIDDEN),
        """WITH m AS (SELECT DISTINCT string_split(x.file_path, '/')[1] || '/' || string_split(x.file_path, '/')[2] AS source, string_split(y.file_path, '/')[1] || '/' || string_split(y.file_path, '/')[2] AS target
              FROM code_entities x JOIN code_entities y ON x.name = y.name AND x.file_path <> y.file_path), r(n, a, b) AS (VALUES """
        + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_FORBIDDEN))
        + """) SELECT source, target, arg_min(a || ' -> ' || b, n) AS rule FROM m JOIN r ON (a = '*' OR a = source) AND (b = '*' OR b = target) GROUP BY 1, 2""",
    ),
    "ag9_relations": (
        lambda s, d: _edges(s, d).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets")),
        "SELECT relation, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM graph_edges GROUP BY 1",
    ),
    "ag10_centrality": (
        lambda s, d: G.degrees(_edges(s, d)).orderBy(F.desc("degree"), "id").limit(10),
        """SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, count(*) AS degree FROM (SELECT source AS id, 1 AS o, 0 AS i FROM graph_edges UNION ALL SELECT target, 0, 1 FROM graph_edges) GROUP BY 1 ORDER BY degree DESC, id LIMIT 10""",
    ),
    "ag17_out_links": (
        lambda s, d: _edges(s, d).groupBy("source", "relation").agg(F.countDistinct("target").alias("n"), F.max("weight").alias("most")),
        "SELECT source, relation, count(DISTINCT target) AS n, max(weight) AS most FROM graph_edges GROUP BY 1, 2",
    ),
    "sk8_merged_edges": (lambda s, d: G.merged_edges(_edges(s, d)), _merged_sql("graph_edges", ", min(created_at) AS created_at")),
    "sk8_unknown_nodes": (
        lambda s, d: _ends(s, d).join(table(s, d, "event_index").select("id").union(table(s, d, "code_entities").select("id")), "id", "left_anti"),
        "SELECT DISTINCT id FROM (SELECT source AS id FROM graph_edges UNION ALL SELECT target FROM graph_edges) WHERE id IS NOT NULL AND id <> '' AND id NOT IN (SELECT id FROM event_index WHERE id IS NOT NULL) AND id NOT IN (SELECT id FROM code_entities WHERE id IS NOT NULL)",
    ),
    "sk9_write_gates": (
        lambda s, d: _edges(s, d).select("source", "target", "relation", F.when(F.col("relation").isin(G.STRUCTURAL), "structural").when(F.col("relation").isin(G.CAUSAL), "causal").when(F.col("relation").isin([r for r, _, _ in G.ONTOLOGY]), "semantic").otherwise("rejected").alias("gate")).groupBy("gate").agg(F.count("*").alias("n")),
        f"""SELECT CASE WHEN relation IN ('calls','imports','contains','depends_on') THEN 'structural' WHEN relation IN {_CAUSAL_SQL} THEN 'causal'
            WHEN relation IN ('implements','realizes','modifies','triggers','validates','overrides','fixes') THEN 'semantic' ELSE 'rejected' END AS gate, count(*) AS n FROM graph_edges GROUP BY 1""",
    ),
}


def _ends(s, d):
    e = _edges(s, d)
    return e.select(F.col("source").alias("id")).union(e.select("target")).where("id is not null and id <> ''").distinct()


def _derived(s, d):
    """Mentions per record, and pairs of files of one record: a record's own list, self-joined inside the row."""
    r = table(s, d, "raw_data").where("source <> 'file' and files_mentioned is not null").select("id", F.array_sort(F.array_distinct("files_mentioned")).alias("f")).distinct()
    mentions = r.select(F.col("id").alias("source"), F.explode("f").alias("target"), F.lit("mentions").alias("relation")).distinct()
    pairs = r.select(F.posexplode("f").alias("i", "a"), "f").select("a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("b"))
    return mentions.unionByName(pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("co_modified").alias("relation")).distinct())


def _module_edges(s, d):
    """Modules that define a function of the same name; names are aggregated to modules before they meet."""
    m = table(s, d, "code_entities").select("name", "file_path", F.array_join(F.slice(F.split("file_path", "/"), 1, 2), "/").alias("m")).distinct()
    # two files of one module that share a name relate the module to itself
    per = m.groupBy("name", "m").agg(F.min("file_path").alias("lo"), F.max("file_path").alias("hi"))
    a, b = per.select("name", F.col("m").alias("source"), "lo", "hi"), per.select("name", F.col("m").alias("target"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return a.join(b, "name").where("source <> target or lo <> hi").select("source", "target").distinct()


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
