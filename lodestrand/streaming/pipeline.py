"""Records to events: a log of what is pending, redaction, extraction, storing and linking, a micro-batch at a time.

Layout of ``root``: ``log`` (append only), ``events`` and ``links`` (latest row a key, in
buckets). A batch is logged as pending, stored, and logged as completed or failed; whatever
is pending without either is replayed by ``recovered``. All steps can run again with the
same batch: stored rows are keyed, and log entries of one id and kind count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import storage
from lodestrand.streaming import state

MOST_TRIES = 3  # fixed value: tries a failed record has


def extracted(raw: DataFrame) -> DataFrame:
    """(id, type, summary, content, files, functions, timestamp): the event of each record with content, its secrets redacted."""
    safe = raw.where("id is not null and content is not null and content <> ''").select("id", "timestamp", F.coalesce("files_mentioned", F.array().cast("array<string>")).alias("m"), T.plain_redact(F.col("content")).alias("content"))
    return safe.select(
        "id", T.event_type(F.col("content")).alias("type"), F.substring("content", 1, 100).alias("summary"), "content",
        F.array_sort(F.array_distinct(F.transform("m", T.normal_path))).alias("files"), T.function_mentions(F.col("content")).alias("functions"), "timestamp",
    )


def links(events: DataFrame) -> DataFrame:
    """(source, target, relation, weight): each event and the files it mentions."""
    return events.select(F.col("id").alias("source"), F.explode("files").alias("target"), F.lit("mentions").alias("relation"), F.lit(1.0).alias("weight")).distinct()


def entries(ids: DataFrame, kind: str, tries: int = 0) -> DataFrame:
    """Log entries of one kind: (id, timestamp, event_type, retry_count)."""
    return ids.select("id", F.current_timestamp().cast("double").alias("timestamp"), F.lit(kind).alias("event_type"), F.lit(tries).alias("retry_count"))


def append(log: DataFrame, root: str) -> None:
    """Adds entries to the log; a torn write leaves no rows, as files count once committed."""
    log.write.mode("append").parquet(f"{root}/log")


def process(raw: DataFrame, batch_id: int, root: str) -> None:
    """One micro-batch; for ``foreachBatch``."""
    raw = raw.where("id is not null").dropDuplicates(["id"])
    append(entries(raw, "pending"), root)
    events = extracted(raw)
    state.put(events, f"{root}/events", ["id"], "timestamp", batch_id)
    state.put(links(events), f"{root}/links", ["source", "target", "relation"], "weight", batch_id)
    good = F.col("content").isNotNull() & (F.col("content") != "")
    append(entries(raw.where(good), "completed").unionByName(entries(raw.where(~F.coalesce(good, F.lit(False))), "failed")), root)


def recovered(spark: SparkSession, root: str, raw: DataFrame) -> DataFrame:
    """The records that were begun and neither completed nor failed."""
    return raw.join(storage.recover(spark.read.parquet(f"{root}/log")).select("id"), "id", "left_semi")


def retried(queue: DataFrame) -> DataFrame:
    """(id, retry_count, state) after one more try of each entry (id, retry_count, ok): done, pending again, or failed after ``MOST_TRIES``."""
    n = F.when(F.col("ok"), F.col("retry_count")).otherwise(F.col("retry_count") + 1)
    return queue.select("id", n.alias("retry_count"), F.when(F.col("ok"), "done").when(n >= MOST_TRIES, "failed").otherwise("pending").alias("state"))


def two_layers(old: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows (id, source_chunk_id, source_layer) after both layers were written: the first adds what isn't there, the second takes the place of its chunk's earlier second layer."""
    kept = storage.delete_where(old, second.select("source_chunk_id").distinct().withColumn("source_layer", F.lit("l2")), ["source_chunk_id", "source_layer"])
    kept = kept.unionByName(storage.insert_absent(kept, first.select("id", "source_chunk_id", F.lit("l1").alias("source_layer")), ["id"]))
    return storage.delete_where(kept, second.select("id"), ["id"]).unionByName(second.select("id", "source_chunk_id", F.lit("l2").alias("source_layer")).dropDuplicates(["id"]))
