import datetime as dt
import random

from pyspark.sql import functions as F

from lodestrand.operators import sessions as S
from lodestrand.streaming import pipeline, state
from tests.conftest import rows

T0 = dt.datetime(2026, 1, 5)


def stream(spark, tmp_path, batches, schema):
    """A file stream that gives the batches one by one."""
    src = tmp_path / "src"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src / f"b{i:03d}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))


def run(spark, df, tmp_path, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table("out")


def test_sessions_equal_batch(spark, tmp_path):
    r = random.Random(2)
    schema = "u string, k string, ts timestamp_ntz"
    events = [(f"u{i}", r.choice("aab"), T0 + dt.timedelta(seconds=r.choice([r.randrange(0, 20_000), 600 * r.randrange(0, 30)]))) for i in range(120)]
    batches = [events[i::3] for i in range(3)]
    batches[2] = batches[2] + batches[0][:10]  # come twice
    batches.append([("end", "z", T0 + dt.timedelta(days=30))])
    got = run(spark, state.sessions(stream(spark, tmp_path, batches, schema), "k", "ts", id_col="u"), tmp_path, "append")
    batch = spark.createDataFrame(events, schema).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    assert rows(got) == rows(S.merge_intervals(batch, "k", "us"))


def test_tumbling(spark, tmp_path):
    ev = [(T0 + dt.timedelta(seconds=s), k) for s, k in ((0, "a"), (59, "a"), (60, "a"), (61, "b"))]
    got = run(spark, state.tumbling(stream(spark, tmp_path, [ev, [(T0 + dt.timedelta(days=9), "z")]], "ts timestamp_ntz, k string"), "ts", "1 minute", "1 hour", ["k"]), tmp_path, "append")
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert rows(got) == [(base, "a", 2), (base + 60_000_000, "a", 1), (base + 60_000_000, "b", 1)]


def test_debounce(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    b = [[("p", at(0)), ("p", at(0.5)), ("q", at(0.2))], [("p", at(1.0)), ("p", at(1.1)), ("p", at(2.2))]]
    got = run(spark, state.debounce(stream(spark, tmp_path, b, "path string, ts timestamp_ntz"), "path", "ts"), tmp_path, "append")
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert sorted((p, (u - base) / 1e6) for p, u in rows(got)) == [("p", 0.0), ("p", 1.1), ("p", 2.2), ("q", 0.2)]


def test_changed(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    b = [[("r", at(0), "x"), ("r", at(1), "x"), ("r", at(2), "y")], [("r", at(3), "y"), ("r", at(4), "x")]]
    got = run(spark, state.changed(stream(spark, tmp_path, b, "repo string, ts timestamp_ntz, head string"), "repo", "ts", "head"), tmp_path, "append")
    assert [v for _, _, v in rows(got)] == ["x", "y", "x"]


def test_upserts_and_replay(spark, tmp_path):
    path = str(tmp_path / "table")
    b = [[("a", 1.0, "x"), ("b", 1.0, "x")], [("a", 2.0, "y"), ("b", 0.5, "old"), ("c", 1.0, "z")]]
    state.upsert_batches(stream(spark, tmp_path, b, "id string, at double, v string"), path, ["id"], "at", str(tmp_path / "cp")).awaitTermination(120)
    assert rows(state.current(spark, path)) == [("a", 2.0, "y"), ("b", 1.0, "x"), ("c", 1.0, "z")]
    assert rows(state.current(spark, path, before=1)) == [("a", 1.0, "x"), ("b", 1.0, "x")]


def test_upsert_in_buckets(spark, tmp_path):
    make = lambda some: spark.createDataFrame(some, "k string, n int, v string")
    at = str(tmp_path / "t")
    put = lambda some, n: state.put(make(some), at, ["k"], "n", n, buckets=4)
    assert state.current(spark, at) is None
    put([("a", 1, "x"), ("b", 1, "x"), ("c", None, "x"), (None, 1, "x")], 0)
    put([("a", 2, "y"), ("b", 0, "y")], 1)
    put([], 2)
    put([("a", 2, "y"), ("b", 0, "y")], 1)  # replayed
    assert rows(state.current(spark, at)) == sorted([("a", 2, "y"), ("b", 1, "x"), ("c", None, "x"), (None, 1, "x")], key=repr)
    assert rows(state.current(spark, at, before=1)) == sorted([("a", 1, "x"), ("b", 1, "x"), ("c", None, "x"), (None, 1, "x")], key=repr)
    assert len(list((tmp_path / "t" / "v000000001").glob("_b=*"))) <= 2  # only the buckets of its keys
    state.rebuild(spark, at, make([("z", 1, "q"), ("z", 3, "r")]), ["k"], "n", 7)
    assert rows(state.current(spark, at)) == [("z", 3, "r")]


def test_pipeline(spark, tmp_path):
    raw = spark.createDataFrame(
        [("r1", "we decide on password: hunter2secret", ["a/b.py", "a\\\\b.py"], 1.0), ("r2", None, None, 2.0), ("r3", "def go(x): an error", None, 3.0), ("r3", "def go(x): an error", None, 3.0), (None, "x", None, 1.0)],
        "id string, content string, files_mentioned array<string>, timestamp double",
    )
    root = str(tmp_path / "p")
    for _ in range(2):  # the second run changes nothing but the log
        pipeline.process(raw, 0, root)
    ev = {r.id: r for r in state.current(spark, f"{root}/events").collect()}
    assert set(ev) == {"r1", "r3"} and "hunter2" not in ev["r1"].content and ev["r1"].type == "decision" and list(ev["r1"].files) == ["a/b.py"] and list(ev["r3"].functions) == ["go"]
    assert rows(state.current(spark, f"{root}/links")) == [("r1", "a/b.py", "mentions", 1.0)]
    log = spark.read.parquet(f"{root}/log")
    assert {(r.id, r.event_type) for r in log.collect()} == {("r1", "pending"), ("r2", "pending"), ("r3", "pending"), ("r1", "completed"), ("r3", "completed"), ("r2", "failed")}
    assert pipeline.recovered(spark, root, raw).count() == 0
    pipeline.append(pipeline.entries(spark.createDataFrame([("r9",)], "id string"), "pending"), root)
    assert [r.id for r in pipeline.recovered(spark, root, raw.limit(1).withColumn("id", F.lit("r9"))).collect()] == ["r9"]
    q = spark.createDataFrame([("a", 0, True), ("b", 1, False), ("c", 2, False)], "id string, retry_count int, ok boolean")
    assert rows(pipeline.retried(q)) == [("a", 0, "done"), ("b", 2, "pending"), ("c", 3, "failed")]


def test_two_layers(spark):
    old = spark.createDataFrame([("o1", "c1", "l2"), ("o2", "c2", "l2"), ("o3", "c1", "l1"), ("n", None, None)], "id string, source_chunk_id string, source_layer string")
    first = spark.createDataFrame([("o3", "c1"), ("f2", "c2")], "id string, source_chunk_id string")
    second = spark.createDataFrame([("s1", "c1"), ("s1", "c1")], "id string, source_chunk_id string")
    assert rows(pipeline.two_layers(old, first, second)) == sorted([("o2", "c2", "l2"), ("o3", "c1", "l1"), ("n", None, None), ("f2", "c2", "l1"), ("s1", "c1", "l2")], key=repr)
