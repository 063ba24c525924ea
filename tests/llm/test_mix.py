import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import mix as M

DOC, TARGET = "doc_id long, text string, source string, n_tokens string", "source string, target_share double, max_repeats int"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 6)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 400))
def test_subset_sum(hist, goal):
    lengths, counts = np.array([h[0] for h in hist]), np.array([h[1] for h in hist])
    take = M.subset_sum(lengths, counts, goal)
    assert (take >= 0).all() and (take <= counts).all()
    reach = {0}
    for n, c in hist:
        reach = {r + n * k for r in reach for k in range(c + 1)}
    assert abs(int((take * lengths).sum()) - goal) == min(abs(r - goal) for r in reach)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(1, 50)), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.floats(0, 3.5), st.integers(1, 3))
def test_fit_budget(hist, share, repeats):
    lengths, counts = np.array([h[0] for h in hist]), np.array([h[1] for h in hist])
    total = int((lengths * counts).sum())
    budget = int(total * share)
    rounds, extra = M.fit_budget(lengths, counts, budget, repeats)
    assert (extra >= 0).all() and (extra <= counts).all() and rounds + (1 if extra.any() else 0) <= repeats
    got = rounds * total + int((extra * lengths).sum())
    assert abs(got - min(budget, total * repeats)) <= lengths.max()


def test_mix(spark):
    docs = [(i, f"word {'and more ' * (i % 17)} end {i}", ["big", "Big", "BIG ", "big-two"][i % 4], "clash") for i in range(400)]
    docs += [(1000 + i, f"small text number {i}", "little", None) for i in range(12)] + [(2000, None, "big", None), (2001, "", "big", None), (2002, "x", None, None), (2003, "no target", "other", None)]
    chosen, report = M.mix(spark.createDataFrame(docs, DOC), spark.createDataFrame([("big", 0.5, 1), ("little", 0.3, 3), ("big two", 0.1, 2), ("absent", 0.1, 2)], TARGET))
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"big", "little", "big_two", "absent"} and rep["absent"].actual_share == 0
    for s in ("big", "little", "big_two"):
        assert abs(rep[s].actual_share - rep[s].feasible_share) < 0.01 and rep[s].most_copies <= rep[s].max_repeats
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.copies >= 1 for r in got) and not {2000, 2001, 2002, 2003} & {r.doc_id for r in got}
    again, _ = M.mix(spark.createDataFrame(docs, DOC).repartition(7), spark.createDataFrame([("big", 0.5, 1), ("little", 0.3, 3), ("big two", 0.1, 2), ("absent", 0.1, 2)], TARGET))
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))


def test_asked_total(spark):
    docs = spark.createDataFrame([(i, "some words here " * (1 + i % 9), "ab"[i % 2], None) for i in range(300)], DOC)
    _, report = M.mix(docs, spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 1)], TARGET), total_tokens=2000)
    assert {r.source: r.tokens_used for r in report.collect()} == {"a": 1500, "b": 500}


def test_one_length(spark):
    docs = spark.createDataFrame([(i, "same words", "a", None) for i in range(3000)] + [(9000, "same words", "b", None)], DOC)
    chosen, report = M.mix(docs, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGET))
    assert {r.source: r.n_docs for r in report.collect()} == {"a": 2, "b": 1}
    assert {r.doc_id: r.copies for r in chosen.collect()}[9000] == 2


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOC), spark.createDataFrame([("a", 1.0, 1)], TARGET)
    chosen, report = M.mix(docs, targets)
    assert chosen.count() == 0 and [r.tokens_used for r in report.collect()] == [0]
    assert M.mix(spark.createDataFrame([(1, "x y", "a", None)], DOC), targets.limit(0))[0].count() == 0
