"""Texts of notes, transcripts and model answers, against what they hold."""

import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrand.functions import chunks
from lodestrand.functions import markup as M
from lodestrand.functions import text as T
from lodestrand.sources import files, logs, markdown
from tests.conftest import rows


def col(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_turns(spark):
    talk = "### USER (a)\n\nfirst\n### not a heading\n\n### ASSISTANT (b)\r\n\r\nanswer\n\n### USER (c)\n\nsecond "
    got = col(spark, [talk, "### ASSISTANT (x)\n\nalone", "", None, "### USER (a)\nno blank line"], M.turns)
    assert [(t.user, t.assistant) for t in got[0]] == [("first", "answer"), ("second", "")]
    assert got[1:] == [[], [], None, []]


def test_first_layer(spark):
    said = "### USER (1)\n\nthe error is back\n\n### ASSISTANT (2)\n\nok\n\n" * 7
    c = spark.createDataFrame([("c1", "s", said, 1), ("c1", "s", said, 2), ("c2", "s", "nothing of note", 1), ("c3", None, None, 1), ("c4", "s", "", 1)], "chunk_id string, session_id string, content string, type int")
    got = M.first_layer(c).collect()
    assert {r.chunk_id for r in got} == {"c1"} and len(got) == 5 and len({r.id for r in got}) == 5 and {r.type for r in got} == {"diagnostic"}
    assert M.first_layer(c.limit(0)).count() == 0


def test_todo_items(spark):
    texts = ["## TODO\n- write it\n* ab\n - write it\n## Next\n- not this", "[Next Step]\n- early\n" + "x" * 600 + "\n- too far", "no heading\n- x", None, "## 待办\r\n- 复查日志文件\r\n"]
    assert col(spark, texts, M.todo_items) == [["write it"], ["early"], [], None, ["复查日志文件"]]


def test_tables_marks_sections(spark):
    table = "intro\n| Date | Job |\n|---|---|\n| **01-05** | [a](b) | done | x | y |\n|  | plain |\n| 01-06 | c\nend"
    assert M.table_rows(table) == [("01-05", "a", "done", "x", "y"), ("01-05", "plain", "", "", ""), ("01-06", "c", "", "", "")]
    df = spark.createDataFrame([(1, table), (2, None), (3, "| a |")], "k int, t string")
    assert M.index_rows(df, "k", "t").count() == 3 and M.table_rows("| 1 | 2 |") == []
    assert col(spark, ["<!-- MY_SYNC_ID: a-1 --> x <!--SYNC_ID:b-->", "none", None], M.sync_ids) == [["a-1", "b"], [], None]
    assert col(spark, ["# A\nx\n## The Goal\ny\nz\n# C\nw", "# A", None], lambda c: M.section(c, ["goal", "aim"])) == ["y\nz", "", None]
    assert col(spark, ["- [x] done it\n- [ ] open\n- [ ]  ", "", None], lambda c: T.task_items(c, False)) == [["open"], [], None]
    assert [str(d) for d in col(spark, ["a/2026/01-05/x", "a/2026-01-05.md", "a/2026/02-31", "none"], M.path_day)] == ["2026-01-05", "2026-01-05", "None", "None"]


def test_model_answers(spark):
    texts = ['{"a": 1}', "x ```json\n{\"a\": 2}\n``` y", 'so {"a": 3} it is', '{"a": ', "none", None]
    assert col(spark, texts, lambda c: F.get_json_object(T.tolerant_json(c), "$.a")) == ["1", "2", "3", None, None, None]
    lists = ['```json\n[{"a": 1}, {"a": 2}]\n```', 'Here: [{"a": 1}] ok', '[{"a": 1}, {"a": "cu', "[", None]
    assert col(spark, lists, lambda c: F.variant_get(F.try_parse_json(T.repaired_list(c)), "$[0].a", "int")) == [1, 1, 1, None, None]
    assert col(spark, lists, lambda c: F.size(F.try_parse_json(T.repaired_list(c)).cast("array<variant>"))) == [2, 1, 1, None, None]


def test_overlapping_redaction():
    def plain(text):
        """Replaced one after the other on the text as it has become."""
        found = [(m.start(), m.end(), n) for n, p in T.PLAIN_PATTERNS for m in re.finditer(p, text)]
        for lo, hi, n in sorted(found, key=lambda f: -f[0]):
            text = f"{text[:lo]}[REDACTED]_{n.upper()}{text[hi:]}"
        return text

    some = ["api_key = sk-" + "a1B2" * 12, "password: " + "Z9" * 25, "mail bob@example.org, card 1234-5678-9012-3456 and ghp_" + "aB3" * 12, "eyJabc.eyJdef.ghi-jkl " + "A" * 40, "api_key=" + "x" * 45 + " ssn 123-45-6789"]
    some += [a + b for a in some for b in some] + ["", "none"]
    assert T.redact_overlapping(pd.Series(some)).tolist() == [plain(t) for t in some]
    assert T.redact_overlapping(pd.Series([None])).tolist() == [None]


def test_log_times(spark):
    texts = ["2026/01-05", "a_2026-01-05 10:00:00", "2026-01-05 10:00:00.log", "2026/01/05  10:00:00 and 2026-01-05T09:00:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lo, hi = logs.time_range(F.col("t"))
    got = [(str(r.lo), str(r.hi)) for r in df.select(lo.alias("lo"), hi.alias("hi")).collect()]
    assert got == [("None", "None")] * 3 + [("2026-01-05 09:00:00", "2026-01-05 10:00:00"), ("None", "None")]
    assert rows(df.limit(0)) == []


def test_token_windows(spark):
    assert chunks.windows(0) == [(0, 0)] and chunks.windows(800) == [(0, 800)] and chunks.windows(801) == [(0, 800), (680, 801)] and chunks.windows(1481) == [(0, 800), (680, 1480), (1360, 1481)]
    path = chunks.TOKENIZER
    if not os.path.exists(path):
        pytest.skip("no tokenizer")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = {1: "plain words of a text " * 60, 2: "", 4: "日志记录 " * 90, 5: "x"}
    df = spark.createDataFrame([*texts.items(), (3, None)], "doc_id long, text string")
    got = {}
    for r in chunks.token_chunks(df, "doc_id", "text", size=50, step=40).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == set(texts) and [(r.text, r.token_count) for r in got[2]] == [("", 0)]
    for k, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        at, want = 0, []
        while True:
            want.append((len(want), at, len(ids[at : at + 50])))
            if at + 50 >= len(ids):
                break
            at += 40
        assert [(r.seq, r.pos, r.token_count) for r in got[k]] == want


def test_typed_frontmatter(spark):
    texts = [("a", "---\ntype: daily-end\ndate: 05-01-2026\ntags: [x, y]\n---\n"), ("b", "---\ntype: job-start\ndate: 2026/01/05\n---\n"), ("c", "---\ntype: decision\nid: e1\n---\n"), ("d", "---\ntype: decision\n---\n"), ("e", "no"), ("f", None)]
    got = {r.path: r for r in markdown.typed_frontmatter(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert (got["a"].kind, str(got["a"].date), got["a"].tags, got["a"].error) == ("session-end", "2026-01-05", ["x", "y"], None)
    assert [got[k].error for k in "bcdef"] == ["bad job id", None, "no id", "no frontmatter", "no frontmatter"] and got["b"].date is None
    f = spark.createDataFrame([("in", 7000.0), ("early", 1000.0), ("next", 90_000.0), ("none", None)], "path string, mtime double")
    assert [(r.path, r.how) for r in files.of_session(f, 7200.0, 9000.0).orderBy("path").collect()] == [("early", "day"), ("in", "window")]
