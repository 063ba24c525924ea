"""Grouping activity into sessions by inactivity gaps.

Method: merging interval state. Every event opens the interval [ts, ts + gap); the
overlapping intervals of a key merge. State is merged in two steps:

* events of one key within one slot as wide as the gap always overlap, so a slot's
  state (first, last, count) is a plain aggregate with map-side combine. A hot key is
  spread over its slots and never sorted event by event;
* the slots of a key, at most span / gap however many events there are, are merged in
  order of time.

Late events only change the slot they fall into; ``lodestrand.streaming.sessions`` keeps
the same state with a watermark.

Defined cases: events without key, time or (where asked) text don't count; repeated
record ids count once, at their earliest arrival, records without an id each count;
equal times belong together; an event exactly ``gap`` after the one before starts a new
session; empty input gives no session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_S = 600


def merge_intervals(events: DataFrame, key: str, ts_us: str, gap_s: int = GAP_S) -> DataFrame:
    """(key, start_us, end_us, n) of the maximal runs of events less than ``gap_s`` apart."""
    gap = int(gap_s * 1_000_000)
    slots = (
        events.where(F.col(key).isNotNull() & F.col(ts_us).isNotNull())
        .groupBy(F.col(key), F.floor(F.col(ts_us) / F.lit(gap)).alias("_slot"))
        .agg(F.min(ts_us).alias("_lo"), F.max(ts_us).alias("_hi"), F.count("*").alias("_n"))
    )
    w = Window.partitionBy(key).orderBy("_slot")
    opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) >= F.lit(gap), F.lit(True))
    runs = slots.withColumn("_run", F.sum(opens.cast("int")).over(w))
    return runs.groupBy(key, "_run").agg(
        F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"), F.sum("_n").alias("n")
    ).drop("_run")


def user_messages(records: DataFrame) -> DataFrame:
    """(session_id, ts_us) of the user messages that count, each record once."""
    said = records.where(
        (F.col("type") == "user")
        & F.col("ts").isNotNull()
        & F.col("session_id").isNotNull()
        & F.col("text").rlike(r"\S")
    ).select("record_uuid", "session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("at_us"))
    once = (
        said.where("record_uuid is not null")
        .groupBy("record_uuid")
        .agg(F.min(F.struct("at_us", "ts_us", "session_id")).alias("r"))
        .select("r.session_id", "r.ts_us")
    )
    return once.unionByName(said.where("record_uuid is null").select("session_id", "ts_us"))


def jobs(records: DataFrame, gap_s: int = GAP_S, least_messages: int = 2) -> DataFrame:
    """Jobs of each session: (session_id, start_us, end_us, message_count, duration_us).

    A session with fewer than ``least_messages`` messages in all has no job.
    """
    found = merge_intervals(user_messages(records), "session_id", "ts_us", gap_s)
    total = F.sum("n").over(Window.partitionBy("session_id"))
    return (
        found.withColumn("_all", total)
        .where(F.col("_all") >= least_messages)
        .select("session_id", "start_us", "end_us", F.col("n").alias("message_count"), (F.col("end_us") - F.col("start_us")).alias("duration_us"))
    )


def sessions_found(records: DataFrame) -> DataFrame:
    """(session_id, start_us, end_us, message_count) of each job."""
    return jobs(records).select("session_id", "start_us", "end_us", "message_count")


def session_sizes(records: DataFrame) -> DataFrame:
    """Per session: jobs, messages, first and last time, seconds active."""
    return jobs(records).groupBy("session_id").agg(
        F.count("*").alias("n_jobs"),
        F.sum("message_count").alias("n_messages"),
        F.min("start_us").alias("first_us"),
        F.max("end_us").alias("last_us"),
        F.sum("duration_us").alias("active_us"),
    )
