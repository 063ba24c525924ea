import datetime as dt
import random

from lodestrand.operators import sessions as S
from tests.conftest import rows

SCHEMA = "record_uuid string, session_id string, type string, ts timestamp_ntz, arrived_at timestamp_ntz, text string, key string"
T0 = dt.datetime(2026, 1, 5)


def records(spark, some):
    """(uuid, session, type, seconds, text)"""
    return spark.createDataFrame(
        [(u, s, k, None if x is None else T0 + dt.timedelta(seconds=x), T0, t, "clash") for u, s, k, x, t in some], SCHEMA
    )


def plain(some):
    by, seen = {}, set()
    for u, s, k, x, t in some:
        if k != "user" or x is None or s is None or not (t or "").strip() or (u is not None and u in seen):
            continue
        seen.add(u)
        by.setdefault(s, []).append(round(x * 1e6))
    out = []
    for s, xs in by.items():
        if len(xs) < 2:
            continue
        xs.sort()
        run = [xs[0]]
        for x in xs[1:]:
            if x - run[-1] >= 600_000_000:
                out.append((s, run[0], run[-1], len(run)))
                run = []
            run.append(x)
        out.append((s, run[0], run[-1], len(run)))
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    return sorted(((s, a + base, z + base, n) for s, a, z, n in out), key=repr)


def test_boundary_and_rules(spark):
    some = [
        ("a", "s", "user", 0, "x"), ("b", "s", "user", 599.999999, "x"), ("c", "s", "user", 1199.999999, "x"),
        ("c", "s", "user", 1199.999999, "x"), ("d", "s", "assistant", 700, "x"), ("e", "s", "user", 900, " \t\n"),
        ("f", "s", "user", None, "x"), ("g", None, "user", 5, "x"), ("h", "one", "user", 5, "x"),
        (None, "n", "user", 5, "x"), (None, "n", "user", 5, "x"), ("i", "two", "user", 0, "x"), ("j", "two", "user", 5000, "x"),
    ]
    assert rows(S.sessions_found(records(spark, some))) == plain(some)


def test_random(spark):
    rnd = random.Random(3)
    some = [(f"u{rnd.randrange(900)}" if rnd.random() < 0.9 else None, rnd.choice(["hot"] * 5 + list("abcd")), "user", None, "x") for _ in range(1000)]
    at = {}
    some = [(u, s, k, at.setdefault((u, s) if u else object(), rnd.choice([rnd.randrange(0, 200_000), rnd.randrange(0, 300) * 600])), t) for u, s, k, x, t in some]
    first = {}
    some = [(u, *first.setdefault(u, (s, k, x, t))) if u else (u, s, k, x, t) for u, s, k, x, t in some]
    assert rows(S.sessions_found(records(spark, some))) == plain(some)


def test_empty(spark):
    assert rows(S.sessions_found(records(spark, []))) == []


def test_earliest_arrival_counts(spark):
    df = spark.createDataFrame(
        [("u", "s", "user", T0, T0 + dt.timedelta(days=2), "x", ""), ("u", "s", "user", T0 + dt.timedelta(hours=1), T0, "x", ""), ("v", "s", "user", T0 + dt.timedelta(hours=1), T0, "x", "")], SCHEMA
    )
    assert [r.message_count for r in S.sessions_found(df).collect()] == [2]
