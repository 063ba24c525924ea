import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import split as S
from tests.conftest import rows

WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "日志归档了旧的记录。", "zeta.", "eta,", "theta!\n", "iota\n\n", "kappa\r\n"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def check(text, limit, overlap):
    spans = S.split_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and (c < b or overlap == 0)  # they overlap, without overlap they meet, and go on
    assert all(0 < b - a <= limit for a, b in spans)
    return spans


def test_bounds_and_overlap():
    text = prose(1, 4000)
    spans = check(text, 3200, 480)
    for (_, b), (c, _) in zip(spans, spans[1:]):
        assert 440 <= b - c <= 520
        assert text[b - 1].isspace() or text[b - 1] in "。.,!" or text[b].isspace()


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_any_text(text, limit, overlap):
    if text:
        check(text, limit, overlap)
    else:
        assert S.split_spans(text, limit, overlap) == []


def test_no_boundaries():
    assert S.split_spans("x" * 10_000) == [(0, 3200), (2720, 5920), (5440, 8640), (8160, 10_000)]
    assert S.split_spans("x" * 3200) == [(0, 3200)]


def test_pairs_stay_together():
    text = ("á" * 40 + "\r\n") * 200
    for a, b in S.split_spans(text, 300, 40)[:-1]:
        assert text[b] != "́" and text[b - 1 : b + 1] != "\r\n"


def test_edits_stay_local():
    kept = []
    for seed in range(12):
        text = prose(seed, 6000)
        edited = text[:700] + "one inserted clause, " + text[700:]
        a = {text[x:y] for x, y in S.split_spans(text)}
        b = {edited[x:y] for x, y in S.split_spans(edited)}
        kept.append(len(a & b) / len(a))
    assert sum(kept) / len(kept) > 0.6


def test_operator(spark):
    long, longer = prose(2, 900), prose(3, 2500)
    items = spark.createDataFrame(
        [("e", 0, 0, "short", 1.0), ("e", 1, 680, long, 1.0), ("e", 1, 680, long, 1.0), ("e", 2, 1360, "tail", 1.0), ("e", 3, 2040, longer, 2.0), ("f", 0, 0, None, 1.0), ("g", 0, None, "", 1.0), ("h", 5000, 9, long, 0.0), ("h", 7, 9, "x", 0.0)],
        "event_id string, chunk_seq int, chunk_pos int, chunk_text string, piece double",
    )
    assert rows(S.split_found(items)) == [("e", 1), ("e", 3), ("h", 5000)]
    got = [r for r in S.split_items(items).orderBy("event_id", "chunk_seq").collect() if r.event_id == "e"]
    n1, n3 = len(S.split_spans(long)), len(S.split_spans(longer))
    assert [r.chunk_seq for r in got] == [1 + i for i in range(n1)] + [1 + n1 + 1 + i for i in range(n3)]
    assert got[0].chunk_text == long[: len(got[0].chunk_text)] and got[0].chunk_pos == 680 and got[n1 - 1].chunk_text == long[S.split_spans(long)[-1][0] :]
    assert [r.chunk_seq for r in S.split_items(items).orderBy("chunk_seq").collect() if r.event_id == "h"][0] == 1
    assert rows(S.split_items(items.limit(0))) == []
