"""Search: text, pattern, vector and symbol channels, and their fusion.

Every channel gives (id, channel, place, n): its hits in order. Fusion is one aggregate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T

# fixed values: channel weights, and base score and weight factor of the pattern search by kind of source
WEIGHTS = {"semantic": 1.0, "graph": 0.9, "unix": 0.8, "text": 0.7}
HIT_BASE = {"events": 0.9, "code": 0.85, "docs": 0.8}
UNIX_FACTOR = {"events": 1.0, "code": 0.92, "docs": 0.84}


def text_search(events: DataFrame, q: str, k: int = 20, days: int | None = 30) -> DataFrame:
    """Events of the last ``days`` (counted from the newest) whose summary or content contains ``q``, case ignored; oldest path first."""
    if days is not None:
        last = events.agg(F.max("date").alias("_last"))  # one row
        events = events.join(F.broadcast(last)).where(F.col("date") >= F.date_sub("_last", days)).drop("_last")
    said = F.lower("summary").contains(q.lower()) | F.coalesce(F.lower("json_cache").contains(q.lower()), F.lit(False))
    return events.where(said).orderBy("date", "markdown_path", "id").limit(k)


def graph_search(events: DataFrame, edges: DataFrame, q: str, k: int = 20) -> DataFrame:
    """The newest events that modify something whose name contains ``q``."""
    hit = edges.where(F.col("target").contains(q) & (F.col("relation") == "modifies")).select(F.col("source").alias("id")).distinct()
    return events.join(hit, "id", "left_semi").orderBy(F.desc("timestamp"), "id").limit(k)


def semantic_search(vectors: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    """(id, score): the events of highest cosine to the query by their best chunk."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vectors.where((F.size("embedding") == len(query)) & (F.col("event_id") != ""))
    best = v.select(F.col("event_id").alias("id"), T.cosine(F.col("embedding"), q).alias("c")).where("c is not null").groupBy("id").agg(F.max("c").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(k)


def unix_search(events: DataFrame, code: DataFrame, docs: DataFrame, q: str, k: int = 20) -> DataFrame:
    """(id, kind, line_no, score): pattern hits in events, code and documents, best first; each source gives its first hit a record."""
    low = q.lower()
    e = events.where(F.lower("summary").contains(low)).select("id", F.lit("events").alias("kind"), F.lit(None).cast("long").alias("line_no"), F.col("markdown_path").alias("path"), F.col("summary").alias("snippet"))
    c = code.where(F.lower("name").contains(low) | F.lower("file_path").contains(low)).groupBy("id").agg(F.min(F.struct("line_start", "file_path", "name")).alias("c"))
    c = c.select("id", F.lit("code").alias("kind"), F.col("c.line_start").cast("long").alias("line_no"), F.col("c.file_path").alias("path"), F.coalesce("c.name", F.lit("")).alias("snippet"))
    d = first_line_hits(docs, re.escape(q), "doc_id", "text").select(F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("id"), F.lit("docs").alias("kind"), F.col("line_no").cast("long").alias("line_no"), F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("path"), "snippet")
    every = e.unionByName(c).unionByName(d).withColumn("score", hit_score(F.col("kind"), F.coalesce("path", F.lit("")), F.coalesce("snippet", F.lit("")), q))
    return every.orderBy(F.desc("score"), "kind", "id").limit(k).select("id", "kind", "line_no", "score")


def unix_weight(kind: Column, score: Column, line: Column) -> Column:
    """The pattern channel's weight of one hit: by kind of source, plus what its score exceeds the base, plus a bonus for a line."""
    factor, base = F.lit(0.8), F.lit(None).cast("double")
    for k, v in UNIX_FACTOR.items():
        factor, base = F.when(kind == k, v).otherwise(factor), F.when(kind == k, HIT_BASE[k]).otherwise(base)
    more = F.coalesce(F.least(F.greatest(score - base, F.lit(0.0)), F.lit(0.2)), F.lit(0.0))
    return WEIGHTS["unix"] * factor + more + F.when(F.coalesce(line, F.lit(0)) > 0, 0.02).otherwise(0.0)


def search(mode: str, q: str, query: list[float], events: DataFrame, edges: DataFrame, vectors: DataFrame, code: DataFrame, docs: DataFrame, k: int = 10, scorer: Column | None = None) -> DataFrame:
    """(id, score): the k best by one channel (text, semantic, graph, unix); any other mode fuses all four.

    With a ``scorer`` (over the event's columns) three times as many are fetched and re-ordered
    by it; ties keep their order. A channel without score of its own gives its place, best first.
    """
    n = 3 * k if scorer is not None else k
    order = {"text": ["date", "markdown_path", "id"], "graph": [F.desc("timestamp"), "id"], "semantic": [F.desc("score"), "id"], "unix": [F.desc("score"), "kind", "id"]}
    make = {
        "text": lambda: text_search(events, q, n),
        "graph": lambda: graph_search(events, edges, q, n),
        "semantic": lambda: semantic_search(vectors, query, n),
        "unix": lambda: unix_search(events, code, docs, q, n),
    }
    if mode in make:
        hits = ranked(make[mode](), mode, order[mode]).select("id", (1.0 - F.col("place") / F.col("n")).alias("score"))
    else:
        unix = ranked(make["unix"](), "unix", order["unix"], unix_weight(F.col("kind"), F.col("score"), F.col("line_no")))
        hits = fuse([ranked(make[m](), m, order[m]) for m in ("text", "graph", "semantic")] + [unix], events.select("id", "timestamp"), n)
    if scorer is not None:
        hits = rerank(hits.join(events, "id", "left"), scorer, k).select("id", "score", "rerank_score")
    return hits


def first_files(files: DataFrame, fixed: str, path_col: str, text_col: str, skip: str = "docs/logs/") -> DataFrame:
    """(path, line_no, line): the first line of each file that holds a fixed string, as it is written; files under ``skip`` are left out."""
    some = files.where(F.col(text_col).contains(fixed) & ~F.col(path_col).startswith(skip))
    lines = F.transform(F.split(text_col, r"\r\n|\n|\r"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    hit = F.try_element_at(F.filter(lines, lambda x: x["line"].contains(fixed)), F.lit(1))
    return some.select(F.col(path_col).alias("path"), hit.alias("h")).where("h is not null").groupBy("path").agg(F.min("h").alias("h")).select("path", "h.line_no", "h.line")


def first_line_hits(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, snippet): the first matching line of each text; the split stays in the row."""
    lines = F.transform(F.split(text_col, r"\r\n|\n|\r"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("snippet")))
    hit = F.try_element_at(F.filter(lines, lambda x: x["snippet"].rlike("(?i)" + pattern)), F.lit(1))
    some = docs.where(F.col(text_col).rlike("(?i)" + pattern)).select(F.col(id_col).alias("id"), hit.alias("h"))
    return some.where("h is not null").select("id", "h.line_no", F.substring("h.snippet", 1, 80).alias("snippet"))


def hit_score(kind: Column, path: Column, snippet: Column, q: str) -> Column:
    """Base by kind, plus the best of name, stem or path agreement, plus an exact snippet."""
    base = F.lit(0.75)
    for k, v in HIT_BASE.items():
        base = F.when(kind == k, v).otherwise(base)
    ql = q.lower()
    name = F.lower(T.base_name(path))
    more = F.when(name == ql, 0.15).when(F.regexp_replace(name, r"\.[^.]*$", "") == ql, 0.10).when(F.lower(path).contains(ql), 0.05).otherwise(0.0)
    return base + more + F.when(F.lower(F.trim(snippet)) == ql, 0.05).otherwise(0.0)


def hit_id(source: Column, path: Column, line: Column, snippet: Column) -> Column:
    return F.concat(F.lit("unix_"), source, F.lit("_"), F.substring(F.sha1(F.concat_ws("|", source, path, line.cast("string"), snippet)), 1, 12))


def vector_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id") -> DataFrame:
    """(id, score): the k vectors of highest cosine to one query; a top-k, never a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), T.cosine(F.col("embedding"), q).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def ranked(hits: DataFrame, channel: str, order: list, weight: Column | None = None) -> DataFrame:
    """(id, channel, place, n, weight) of one channel's hits; hits are a bounded top-k."""
    w = Window.partitionBy(F.lit(channel))
    weight = F.lit(WEIGHTS.get(channel, 0.0)) if weight is None else weight
    return hits.select("id", F.lit(channel).alias("channel"), (F.row_number().over(w.orderBy(*order)) - 1).alias("place"), F.count("*").over(w).alias("n"), weight.alias("weight"))


def fuse(channels: list[DataFrame], times: DataFrame, k: int = 20) -> DataFrame:
    """(id, score): sum over the channels of weight * (n - place) / n; ties go to the later event."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    score = every.groupBy("id").agg(F.sum(F.col("weight") * (F.col("n") - F.col("place")) / F.col("n")).alias("score"))
    return score.join(times, "id", "left").orderBy(F.desc(F.round("score", 9)), F.desc_nulls_last("timestamp"), "id").limit(k).select("id", "score")


def rerank(hits: DataFrame, scorer: Column, k: int) -> DataFrame:
    """The k best of an over-fetched list by another score; ties keep their order."""
    return hits.withColumn("rerank_score", scorer).orderBy(F.desc("rerank_score"), F.desc("score"), "id").limit(k)


def keyword_score(col: Column, words: list[str]) -> Column:
    """How many of the keywords a text contains."""
    return T.count_contained(col, words)
