"""Keyed storage: upserts, write-ahead log, incremental sync, chunk states, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.graph import merged_edges

# fixed values: the states of a chunk and the steps between them
CHUNK_STATES = ["raw", "embedded", "extracted"]
CHUNK_STEPS = {("raw", "embedded"), ("embedded", "extracted")}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest-wins merge: of each key the row of greatest ``order``, new rows winning ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))), "_new")).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key isn't there yet, each key once."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*new.columns)


def delete_where(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose key is in ``gone``; null keys stay."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def merge_links(links: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Links merged on (source, target, relation): greatest weight, metadata updated by key in order of ``created_at``.

    ``owners`` (id): links whose source is none of them are refused; null sources are too.
    """
    if owners is not None:
        links = links.join(owners.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    return merged_edges(links, unite_lists=False).drop("created_at")


# --- write-ahead log: id, timestamp, event_type (pending, completed, failed), data, retry_count
def recover(log: DataFrame) -> DataFrame:
    """Last pending entry of each id that was never completed or failed."""
    done = log.where(F.col("event_type").isin("completed", "failed")).select("id").distinct()
    rest = [c for c in log.columns if c != "id"]
    last = log.where("event_type = 'pending'").groupBy("id").agg(F.max_by(F.struct(*rest), "timestamp").alias("r"))
    return last.join(done, "id", "left_anti").select("id", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*log.columns)


def compact(log: DataFrame) -> DataFrame:
    """Pending entries that aren't completed, and the last failure of each id."""
    done = log.where("event_type = 'completed'").select("id").distinct()
    pending = log.where("event_type = 'pending'").join(done, "id", "left_anti").select(*log.columns)
    rest = [c for c in log.columns if c != "id"]
    failed = log.where("event_type = 'failed'").groupBy("id").agg(F.max_by(F.struct(*rest), "timestamp").alias("r"))
    return pending.unionByName(failed.select("id", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*log.columns))


def log_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type").agg(F.count("*").alias("n"))


def sync_status(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, state): added, updated, skipped (mtime within 1 ms), error or removed. ``found``: (path, mtime, text); ``stored``: (path, mtime).

    A file that has to be read must begin with a line of three dashes, or it counts as an error.
    """
    f = found.groupBy("path").agg(F.max(F.struct("mtime", F.substring("text", 1, 3).alias("head"))).alias("f"))
    s = stored.groupBy("path").agg(F.max("mtime").alias("o"), F.lit(True).alias("there"))
    both = f.withColumn("here", F.lit(True)).join(s, "path", "full_outer")
    same = F.coalesce(F.abs(F.col("f.mtime") - F.col("o")) < 0.001, F.lit(False))
    state = F.when(F.col("here").isNull(), "removed").when(same, "skipped").when(~F.coalesce(F.col("f.head") == "---", F.lit(False)), "error").when(F.col("there").isNull(), "added").otherwise("updated")
    return both.select("path", state.alias("state"))


def removed_rows(rows: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and (keys, n) how many of each key were deleted; null keys stay."""
    hit = rows.join(gone.select(*keys).distinct(), keys, "left_semi")
    return delete_where(rows, gone, keys), hit.groupBy(*keys).agg(F.count("*").alias("n"))


def migrated(records: DataFrame) -> DataFrame:
    """(id, version, type, content): records of any version as version 2; a second run changes nothing.

    Expects id, version, timestamp, date, type, description, content. A version 0 or 1 record
    gets ``-`` of its type as ``_`` and its description under the first heading, or before the
    text where there is none; an absent id is made from the date and the content.
    """
    v = schema_version(F.col("version"), F.col("id"), F.col("timestamp"), F.col("date"))
    old = v < 2
    text = F.coalesce("content", F.lit(""))
    about = F.coalesce("description", F.lit(""))
    head = F.regexp_extract(text, r"(?m)^#[^\n]*$", 0)
    first = F.when(head == "", 0).otherwise(F.position(head, text) + F.char_length(head) - 1)
    injected = F.concat(F.substr(text, F.lit(1), first), F.when(first > 0, F.lit("\n\n")).otherwise(F.lit("")), about, F.when(first > 0, F.lit("")).otherwise(F.lit("\n\n")), F.substr(text, first + 1))
    made = F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", F.col("date").cast("string"), text), 256), 1, 16))
    return records.select(
        F.coalesce("id", made).alias("id"), F.greatest(v, F.lit(2)).alias("version"), F.when(old, F.regexp_replace("type", "-", "_")).otherwise(F.col("type")).alias("type"),
        F.when(old & (about != "") & ~text.contains(about), injected).otherwise(text).alias("content"),
    )


def legal_step(before: Column, after: Column) -> Column:
    """Whether a chunk may go from one state to the other."""
    ok = F.lit(False)
    for a, b in sorted(CHUNK_STEPS):
        ok = ok | ((before == a) & (after == b))
    return ok


def fold_chunk_states(changes: DataFrame) -> DataFrame:
    """(chunk_id, state, needs_extraction, n_rejected) after ordered changes (chunk_id, at, to); illegal steps are rejected.

    States only go forward, so the fold is two least times: the first ``embedded``, and the
    first ``extracted`` not before it. Both are aggregates; no chunk's changes meet in a list.
    """
    first = changes.groupBy("chunk_id").agg(F.min(F.when(F.col("to") == "embedded", F.col("at"))).alias("t1"), F.count("*").alias("n"))
    second = changes.where("to = 'extracted'").join(first.where("t1 is not null").select("chunk_id", "t1"), "chunk_id").where("at >= t1").select("chunk_id").distinct().withColumn("s2", F.lit(1))
    done = first.join(second, "chunk_id", "left").withColumn("s", F.when(F.col("s2").isNotNull(), 2).when(F.col("t1").isNotNull(), 1).otherwise(0))
    state = F.element_at(F.array(*[F.lit(x) for x in CHUNK_STATES]), F.col("s") + 1)
    return done.select("chunk_id", state.alias("state"), (F.col("s") < 2).alias("needs_extraction"), (F.col("n") - F.col("s")).alias("n_rejected"))


def schema_version(version: Column, id: Column, timestamp: Column, date: Column) -> Column:
    """Explicit version, else 2 with id and timestamp, 1 with date, 0 otherwise."""
    return F.coalesce(version, F.when(id.isNotNull() & timestamp.isNotNull(), 2).when(date.isNotNull(), 1).otherwise(0))


def jsonld(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, doc): one JSON-LD document a node, its out-edges grouped by relation, targets distinct and sorted.

    Targets meet per (source, relation); a hub's list is that node's own document.
    """
    out = edges.select("source", "relation", "target").distinct().groupBy("source", "relation").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    maps = out.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "targets")))).alias("links"))
    j = nodes.join(maps, nodes["id"] == maps["source"], "left")
    return j.select("id", F.to_json(F.struct(F.concat(F.lit("dev://event/"), F.col("id")).alias("@id"), F.col("type").alias("@type"), F.col("links").alias("links"))).alias("doc"))
