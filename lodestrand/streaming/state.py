"""Stateful streams: sessions with a watermark, debounce, change detection, windows, micro-batch upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def utc(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; a TIMESTAMP_NTZ column means UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def sessions(events: DataFrame, key: str, ts: str, gap_s: int = 600, late: str = "2 days", id_col: str | None = None) -> DataFrame:
    """(key, start_us, end_us, n): merging interval state with a watermark.

    An event opens [ts, ts + gap); overlapping intervals of a key merge, also when an event
    that came late bridges two. The window is a microsecond shorter than the gap, as two
    events exactly a gap apart belong to different sessions. A record id counts once within the
    watermark.
    """
    e = utc(events, ts).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    if id_col:
        e = e.dropDuplicatesWithinWatermark([id_col])
    gap = F.lit(f"{gap_s * 1_000_000 - 1} microseconds")
    g = e.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count("*").alias("n"))
    return g.select(key, F.unix_micros("lo").alias("start_us"), F.unix_micros("hi").alias("end_us"), "n")


def tumbling(events: DataFrame, ts: str, width: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts per window and key, with a watermark."""
    e = utc(events, ts).withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), *by, "n")


def debounce(changes: DataFrame, key: str, ts: str, quiet_s: float = 1.0) -> DataFrame:
    """(key, us): changes kept at the leading edge; one at most ``quiet_s`` after the last kept one is dropped."""
    quiet = int(quiet_s * 1_000_000)

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for us in sorted(int(x) for b in batches for x in b.us):
            if last is None or us - last > quiet:
                kept.append(us)
                last = us
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), "us": kept})

    c = utc(changes, ts).select(F.col(key).cast("string").alias(key), F.unix_micros(ts).alias("us"))
    return c.groupBy(key).applyInPandasWithState(run, f"{key} string, us long", "last long", "append", GroupStateTimeout.NoTimeout)


def changed(values: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, us, value): rows whose value differs from the one before of their key."""

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for us, v in sorted((int(u), v) for b in batches for u, v in zip(b.us, b.v)):
            if v != last:
                out.append((k[0], us, v))
                last = v
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "us", value])

    c = utc(values, ts).select(F.col(key).cast("string").alias(key), F.unix_micros(ts).alias("us"), F.col(value).cast("string").alias("v"))
    return c.groupBy(key).applyInPandasWithState(run, f"{key} string, us long, {value} string", "last string", "append", GroupStateTimeout.NoTimeout)


def interval_join(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Pairs of one key whose times are at most ``seconds`` apart, right before left; both sides bounded by watermarks."""
    a = utc(left, ts).withWatermark(ts, late).alias("a")
    b = utc(right, ts).withWatermark(ts, late).select(*[F.col(c).alias(f"past_{c}") for c in right.columns]).alias("b")
    cond = (F.col(key) == F.col(f"past_{key}")) & (F.col(ts) >= F.col(f"past_{ts}")) & (F.col(ts) <= F.col(f"past_{ts}") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return a.join(b, cond)


BUCKETS = 64  # parts of an upserted table; a batch rewrites those its keys fall into


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS):
    """A started query that keeps ``path`` at the latest row of each key; see ``put``."""
    return stream.writeStream.foreachBatch(lambda batch, n: put(batch, path, keys, order, n, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def put(batch: DataFrame, path: str, keys: list[str], order: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Merges one batch into the table: the buckets its keys fall into are written anew under the batch's number.

    A batch that is replayed writes the same folder again from the same older ones, so nothing
    is applied twice. Buckets without a row of the batch are not read.
    """
    from lodestrand.operators.storage import upsert

    b = batch.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = [r._b for r in b.select("_b").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    where = {k: v for k, v in _folders(batch.sparkSession, path, before=batch_id).items() if k in touched}
    old = _read(batch.sparkSession, where) if where else b.drop("_b").limit(0)
    merged = upsert(old, b.drop("_b"), keys, order).withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    merged.write.mode("overwrite").partitionBy("_b").parquet(f"{path}/v{batch_id:09d}")


def _folders(spark, path: str, before: int | None = None) -> dict[int, str]:
    """The newest complete folder of each bucket."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(p):
        return {}
    names = lambda at: sorted(s.getPath().getName() for s in system.listStatus(fs.Path(at)))
    out = {}
    for v in names(path):
        if v[:1] == "v" and system.exists(fs.Path(f"{path}/{v}/_SUCCESS")) and (before is None or int(v[1:]) < before):
            out |= {int(n[3:]): f"{path}/{v}/{n}" for n in names(f"{path}/{v}") if n.startswith("_b=")}
    return out


def _read(spark, folders: dict[int, str]) -> DataFrame:
    return spark.read.parquet(*[folders[k] for k in sorted(folders)])


def current(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The table as it stands, or as it stood before a batch; None where nothing was written."""
    folders = _folders(spark, path, before)
    return _read(spark, folders) if folders else None


def rebuild(spark, path: str, rows: DataFrame, keys: list[str], order: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """The table from all rows anew: every older version is removed after the new one is complete."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in system.listStatus(fs.Path(path))] if system.exists(fs.Path(path)) else []
    from lodestrand.operators.storage import upsert

    whole = upsert(rows.limit(0), rows, keys, order).withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    whole.write.mode("overwrite").partitionBy("_b").parquet(f"{path}/v{batch_id:09d}")
    for p in old:
        if p.getName() != f"v{batch_id:09d}":
            system.delete(p, True)
