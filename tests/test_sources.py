import datetime as dt
import json

from pyspark.sql import functions as F

from lodestrand.sources import files, logs, markdown
from tests.conftest import rows


def test_markdown_round_trip(spark, tmp_path):
    ev = spark.createDataFrame(
        [("e1", "decision", "manual", dt.datetime(2026, 1, 5, 10), "Use it", "Because\n\nof reasons", ["a", "b"], 0.5), ("e2", "task", "cursor", dt.datetime(2026, 1, 7, 11), "Do it", "", [], 1.0)],
        "id string, type string, source string, timestamp timestamp, summary string, content string, tags array<string>, confidence double",
    )
    markdown.write_markdown(ev, str(tmp_path))
    got = markdown.parse_events(markdown.read_texts(spark, str(tmp_path))).orderBy("id").collect()
    assert [(r.id, r.type, r.source, r.summary, r.content, r.tags, r.confidence) for r in got] == [tuple(r)[:3] + tuple(r)[4:] for r in ev.orderBy("id").collect()]
    some = markdown.read_texts(spark, str(tmp_path), dt.date(2026, 1, 6), dt.date(2026, 1, 9))
    assert [r.path.rsplit("/", 1)[-1] for r in some.collect()] == ["e2.md"]
    assert markdown.read_texts(spark, str(tmp_path), dt.date(2025, 1, 6), dt.date(2025, 1, 6)).count() == 0


def test_markdown_fallbacks(spark):
    texts = [
        ("/x/odd.md", "---\ntype: nonsense\nSource: mars\nconfidence: 7\nJob-Id: 'j 1'\ntags: [x, \"y\"]\n---\n# Head\n\nBody"),
        ("/x/plain.md", "Only text that is rather long and goes on and on and on and on."), ("/x/kv.md", "type: task\nsummary: From keys\n\nrest"), ("/x/crlf.md", "---\r\nid: q\r\nid: r\r\n---\r\nBody"), ("/x/empty.md", ""),
    ]
    got = {r.path: r for r in markdown.parse_events(spark.createDataFrame(texts, "path string, text string")).collect()}
    odd = got["/x/odd.md"]
    assert (odd.id, odd.type, odd.source, odd.confidence, odd.summary, odd.content, odd.tags, odd.metadata["job_id"]) == ("odd", "unknown", "claude_code", 1.0, "Head", "Body", ["x", "y"], "j 1")
    assert got["/x/plain.md"].summary == texts[1][1][:50] and got["/x/kv.md"].type == "task" and got["/x/crlf.md"].id == "r" and got["/x/empty.md"].id == "empty"


def test_folder(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.txt").write_text("no")
    (tmp_path / "a.txt").write_bytes("日志".encode("gb18030"))
    (tmp_path / "b.html").write_text("<html><style>p{}</style><p>One</p><script>x</script><b>Two</b></html>")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.md").write_text("\n# Title here\n\nx")
    (tmp_path / "e.txt").write_text("  ")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.html", "c.docx", "d.md", "e.txt"}
    assert got["a.txt"].text == "日志" and got["b.html"].text == "One\nTwo" and got["c.docx"].text is None and "BadZipFile" in got["c.docx"].error
    res = {r.summary for r in files.to_resources(files.read_folder(spark, str(tmp_path))).collect()}
    assert res == {"日志", "One", "Title here"}


def test_sessions(spark, tmp_path):
    def write(name, recs):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in recs) + "\nnot json\n")

    rec = lambda u, k, t, text, **x: {"uuid": u, "sessionId": "s", "type": k, "timestamp": t, "message": {"role": k, "content": text}, "slug": "sl"} | x
    write("a.jsonl", [rec("1", "user", "2026-01-05T10:00:00Z", "goal " * 200), rec("2", "assistant", "2026-01-05T10:05:00Z", "done")])
    write("b.jsonl", [rec("3", "user", "2026-01-05T10:00:00Z", "x")])
    write("c.jsonl", [rec("4", "user", "2026-01-09T10:00:00Z", "x", slug="other")])
    r = logs.read_sessions(spark, str(tmp_path))
    assert r.count() == 4
    got = logs.session_files(r, "2026-01-05 10:30:00", "2026-01-05 11:00:00").collect()
    assert [(x.file.rsplit("/", 1)[-1], x.n) for x in got] == [("a.jsonl", 2)]
    job = {x.file.rsplit("/", 1)[-1]: x for x in logs.agent_jobs(r).collect()}["a.jsonl"]
    assert len(job.goal) == 500 and job.result == "done"
    text = {x.text for x in logs.transcript(r.where("slug = 'other'")).collect()}
    assert text == {"### USER (10:00)\n\nx"}


def test_commits_and_logs(spark):
    lines = spark.createDataFrame([("ab|2026-01-05 10:00:00|Bo|fix: a|b",), ("bad line",)], "value string")
    assert [(r.id, r.author, r.summary) for r in logs.parse_commits(lines).collect()] == [("git_ab", "Bo", "fix: a|b")]
    v = spark.createDataFrame([("f", 1, "a"), ("f", 5, "b"), ("g", 3, "c")], "path string, ts int, hash string")
    d = spark.createDataFrame([("f", 4), ("f", 5), ("f", 0), ("g", 9)], "path string, date int")
    assert rows(logs.snapshots(v, d)) == [("f", 4, "a"), ("f", 5, "b"), ("g", 9, "c")]
    t = spark.createDataFrame([("2026-01-05 10:00:00 a\n" + "x" * 9000 + "\n2026-01-05T12:00:00 z",), ("none",)], "t string")
    lo, hi = logs.time_range(F.col("t"))
    got = t.select(lo.alias("lo"), hi.alias("hi"), logs.is_relevant(hi, F.lit("2026-01-05 12:30:00").cast("timestamp")).alias("ok")).collect()
    assert got[0].lo.hour == 10 and got[0].hi.hour == 12 and got[0].ok and got[1].lo is None and got[1].ok
    chat = spark.createDataFrame([('{"messages": [{"role": "user", "content": "hi"}, {"type": "bot", "text": "yo"}]}',), ('[{"role": "user", "message": "m"}]',)], "j string")
    assert [r.t for r in chat.select(logs.chat_text(F.col("j")).alias("t")).collect()] == ["### USER\n\nhi\n\n### BOT\n\nyo", "### USER\n\nm"]
