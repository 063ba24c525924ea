import random

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import truncated as T
from tests.conftest import rows

DOC = "doc_id long, text string, source string, n_chars long, h string"


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, "blank"), ("", "blank"), (" \n\t", "blank"), ("All is well.", "complete"), ("好的。", "complete"), ("Done?\n\n", "complete"), ("He said “yes.”", "complete"), ("(see the log.)", "complete"),
        ("The job ended becau", "open"), ("The job ended and then, ", "open"), ("分支锁定了迟", "open"), ("The job ended [truncated]", "open"), ("The job end…", "open"), ("The job end...", "open"), ("cut here [...]", "open"),
        ("Text.\n\n```python\nx = 1", "open"), ("Text.\n\n```python\nx = 1\n```", "complete"), ('{"a": [1, 2', "open"), ('{"a": "b', "open"), ('{"a": [1, 2]}', "complete"), ('[{"a": 1}, {"b"', "open"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "complete"), ("| a | b |\n|---|---|\n| 1 | 2", "open"), ("Text.\n\n- one thing\n- another", "loose"), ("Text.\n\n-- cache desk, shift 3", "loose"), ("fix(cache): drop old rows", "loose"),
        ("Text.\n\n## Links\n\ndocs/a/b.md", "loose"), ("# Title", "loose"), ('Text.\n{\n  "a": {\n    "b": 1\n  }\n}', "complete"), ('Text.\n{\n  "a": {\n    "b": 1\n  }', "open"), ("Text.\n\nhttps://a.example/x", "loose"), ("See you.\n\nKind regards\nBob Smith", "loose"),
        ("The job ended [truncated: " + "much more of it " * 30 + "]", "open"), ("The job ended [" + " " * 500 + "cut off]", "open"),
    ],
)
def test_tail_state(text, state):
    assert T.tail_state(text) == state


def frame(spark, texts):
    return spark.createDataFrame([(i, t, s, None, "x") for i, (t, s) in enumerate(texts)], DOC)


def test_prefix_join(spark, monkeypatch):
    r = random.Random(1)
    long = [" ".join(r.choice(["red", "green", "blue", "日志"]) for _ in range(60)) + "." for _ in range(80)]
    texts = [(t, "a") for t in long]
    texts += [(t[: r.randrange(25, 150)], "b") for t in long[:40]] + [(t[:90] + "…", "b") for t in long[:10]] + [(long[0], "a"), (None, "a"), ("", None)]
    texts += [(x, "c") for x in ("r", "gr", "日", "blue red", "no such")]
    docs = frame(spark, texts)
    hits = {(x.core_n, x.h): x.goes_on for x in T.prefix_hits(docs, T.judge(docs)).collect()}
    cores = {T.without_mark(t)[0] for t, _ in texts if t}
    want = {(len(c), T._hash(c)) for c in cores if any(o != c and o.startswith(c) for o in cores)}
    assert set(hits) == want and len(want) >= 40 and all(hits.values())
    monkeypatch.setattr(T, "BROADCAST_IDS", 0)
    assert {(x.core_n, x.h): x.goes_on for x in T.prefix_hits(docs, T.judge(docs)).collect()} == hits


def test_hash_is_sparks(spark):
    texts = ["", "a", "日志 x", "longer text " * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: T._hash(t) for t in texts}


def test_shared_openings(spark):
    """Many texts behind one opening, one of them a cut list item; copies count once."""
    head = "### Notes of the day\n\n"
    texts = [(head + f"- point {k} of the list with more to say", "a") for k in range(200)] + [(head + "- point 7 of the li", "b")] * 3
    got = {r.doc_id for r in T.truncated_documents(frame(spark, texts)).where("truncated and has_longer_copy").collect()}
    assert got == {200, 201, 202}


def test_longer_copy_decides_lists(spark):
    full = "Things to do today.\n\n- wash the car\n- water the garden"
    docs = frame(spark, [(full, "A b"), (full[:-4], "a-b"), ("Things to do today.\n\n- wash the car", "a_b"), ("Other list.\n\n- wash the car\n- feed the do", None)])
    assert rows(T.truncated_found(docs)) == [(1,)]
    rate = {x.source: (x.n_docs, x.n_truncated, x.n_by_copy, x.n_by_tail, x.usual_limit) for x in T.truncation_rates(docs).collect()}
    assert rate == {"a_b": (3, 1, 1, 0, len(full) - 4), None: (1, 0, 0, 0, None)}


def test_copies_and_empty(spark):
    docs = frame(spark, [("This sentence was cut in the mid", "a")] * 3 + [("Whole.", "a")])
    assert rows(T.truncated_found(docs)) == [(0,), (1,), (2,)]
    assert rows(T.truncated_found(docs.limit(0))) == []
