import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.operators import references as R
from tests.conftest import rows

EVENT = "id string, status string, mtime double, updated_at double, extra string"


def tables(spark, events=(), code=(), edges=(), vectors=(), chunks=()):
    mk = spark.createDataFrame
    return {
        "event_index": mk(list(events), EVENT),
        "code_entities": mk([(c,) for c in code], "id string"),
        "graph_edges": mk(list(edges), "source string, target string, relation string, created_at double, day int"),
        "event_vectors": mk(list(vectors), "event_id string, chunk_seq int, embedded_at double"),
        "chunks": mk(list(chunks), "chunk_id string, source_event_id string, created_at double"),
    }


def test_states(spark):
    day = 86_400.0
    t = tables(
        spark,
        events=[
            ("live", "active", 10.0, None, "x"),
            ("gone", "active", 1.0, 5.0, None), ("gone", "deleted", 2.0, 6.0, None),
            ("back", "deleted", 1.0, 5.0, None), ("back", "active", 2.0, 6.0, None),
            ("late", "active", 3 * day + 7, 1.0, None), ("late", "active", 5 * day, 2.0, None),
            ("no_time", "active", None, None, None),
        ],
        code=["f.py:run"],
        edges=[
            ("live", "f.py:run", "modifies", 2 * day, 1), ("live", "none", "fixes", 2 * day, 1), ("live", "none", "fixes", 2 * day, 1),
            ("gone", "back", "triggers", day, 1), ("late", "late", "leads_to", 3 * day + 6, 1), ("late", "", "x", 4 * day, 1),
            (None, "live", "x", 5.0, 1), ("late", "live", "t", None, 1), ("no_time", "no_time", "n", 0.0, 1),
        ],
        vectors=[("late", 0, 3 * day + 7), ("none", 1, None), ("", 2, 1.0), ("late", 3, 3 * day + 6.9)],
        chunks=[("c1", "gone", 1.0), ("c2", None, 1.0), ("c3", "live", 9.0), ("c4", "live", 10.0)],
    )
    assert rows(R.references_found(t)) == sorted(
        [
            ("graph_edges", "target", "live|none|fixes", "missing"),
            ("graph_edges", "source", "gone|back|triggers", "deleted"),
            ("graph_edges", "source", "late|late|leads_to", "late"),
            ("graph_edges", "target", "late|late|leads_to", "late"),
            ("graph_edges", "target", "None|live|x".replace("None|", ""), "late"),
            ("event_vectors", "event_id", "none#1", "missing"),
            ("event_vectors", "event_id", "late#3", "late"),
            ("chunks", "source_event_id", "c1", "deleted"),
            ("chunks", "source_event_id", "c3", "late"),
        ],
        key=repr,
    )
    days = {(r.record_key, r.state): r.day for r in R.bad_references(t).collect()}
    assert days[("none#1", "missing")] is None and str(days[("late#3", "late")]) == "1970-01-04"


def test_empty(spark):
    assert rows(R.references_found(tables(spark))) == []
    assert rows(R.bad_reference_counts(tables(spark))) == []


def test_hot_key(spark):
    t = tables(spark, edges=[("hub", f"t{i}", "fixes", float(i), 0) for i in range(2000)])
    got = R.bad_reference_counts(t).where("ref_field = 'source'").collect()
    assert [(r.state, r.n) for r in got] == [("missing", 2000)]


def test_many_ranges(spark):
    refs = R.references(tables(spark, edges=[(f"s{i}", f"t{i % 7}", "fixes", 1.0, 0) for i in range(500)]))
    known = R.parents(spark.createDataFrame([(f"s{i}", "active", 0.0, 0.0, "") for i in range(0, 500, 2)], EVENT), spark.createDataFrame([], "id string"))
    one = {r.key for r in R.suspicious(refs, known, 1).collect()}
    assert one == {r.key for r in R.suspicious(refs, known, 37).collect()}
    assert one == {f"s{i}" for i in range(1, 500, 2)} | {f"t{i}" for i in range(7)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 200_000), max_size=200), st.sets(st.integers(0, 200_000), max_size=200), st.booleans(), st.booleans())
def test_bitmap(a, b, dense_a, dense_b):
    a = a | set(range(0, 60_000, 3)) if dense_a else a
    b = b | set(range(0, 70_000, 2)) if dense_b else b
    left = R.Bitmap(np.array(sorted(a), dtype=np.int64)).and_not(R.Bitmap(np.array(sorted(b), dtype=np.int64)))
    assert left.decode().tolist() == sorted(a - b)
