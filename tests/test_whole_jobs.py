"""Queries over whole tables against plain Python on the smallest tables."""

from collections import defaultdict
from datetime import timedelta

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import code as C
from lodestrand.operators import events as E
from lodestrand.plans import catalog
from lodestrand.plans.timeline import _ev
from lodestrand.tables import table
from tests.conftest import rows

Q = catalog.queries()


def test_correlated_by_substring(spark, small):
    docs = [(r.doc_id, r.created_at.date(), r.low) for r in table(spark, small, "documents").selectExpr("doc_id", "created_at", "lower(text) low").distinct().collect()]
    commits = _ev(spark, small).where("type = 'git_commit'").withColumn("k", T.keywords(F.col("summary")))
    want = []
    for c in commits.select("id", "date", "k").collect():
        for doc, day, text in docs:
            score = sum(w in text for w in c.k or [])
            if score and abs(day - c.date) <= timedelta(days=3):
                want.append((c.id, doc, score))
    got = rows(Q["jn11_correlated_documents"](spark, small).select("id", "doc_id", "score"))
    assert got == sorted(want, key=repr) and any(s == 1 for *_, s in got)


def test_candidates_of_every_event(spark, small):
    ev = _ev(spark, small).select("id", "timestamp", "job_id", E.metadata("session_id").alias("s"), E.metadata("module_path").alias("m")).collect()
    files = defaultdict(set)
    for r in E.file_refs(_ev(spark, small)).collect():
        files[r.event_id].add(r.file_path)
    order = sorted(sorted(ev, key=lambda r: r.id), key=lambda r: r.timestamp, reverse=True)
    want = []
    for a in ev:
        others = [b for b in order if b.id != a.id][:48]
        share = [b for b in others if (a.job_id and a.job_id == b.job_id) or (a.s and a.s == b.s) or (a.m and a.m == b.m) or files[a.id] & files[b.id]]
        want += [(a.id, b.id, i) for i, b in enumerate(share[:12], 1)]
    got = rows(Q["jn13_candidates"](spark, small).select("id", "other", "rank"))
    assert got == sorted(want, key=repr)


def test_calls(spark, small):
    e = {tuple(r) for r in table(spark, small, "code_entities").select("id", "file_path", "type", "line_start", "line_end").collect()}
    calls = {(r.file_path, r.line, r.name) for r in C.facts(table(spark, small, "raw_data").where("source = 'file'")).where("kind = 'call'").collect()}
    want = []
    for p, line, name in calls:
        if hold := sorted((lo, i) for i, f, t, lo, hi in e if f == p and t in ("function", "method") and hi is not None and lo <= line <= hi):
            want.append((p, line, name, hold[0][1]))
    assert rows(Q["jn16_enclosing_symbol"](spark, small).select("file_path", "line", "name", "symbol")) == sorted(want, key=repr) and want
