"""Session logs (JSON lines), commit logs and plain logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators.slots import asof_join

SESSION_SCHEMA = "uuid string, sessionId string, type string, timestamp string, isSidechain boolean, slug string, gitBranch string, message struct<role:string,content:string>"


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Records of ``*.jsonl`` session files; lines that are no record are dropped, times are UTC."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    r = lines.select(F.input_file_name().alias("file"), F.from_json("value", SESSION_SCHEMA).alias("r")).where("r.type is not null").select("file", "r.*")
    return r.select("file", F.col("uuid").alias("record_uuid"), F.col("sessionId").alias("session_id"), "type", F.try_to_timestamp("timestamp").alias("ts"), F.coalesce("isSidechain", F.lit(False)).alias("side"), "slug", F.col("gitBranch").alias("git_branch"), F.col("message.content").alias("text"))


def session_files(records: DataFrame, start: str, end: str) -> DataFrame:
    """Per file first and last time, slug, branch and count, of files that overlap [start - 1 h, end + 5 min]; the fullest of each slug."""
    f = records.groupBy("file").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("slug").alias("slug"), F.min("git_branch").alias("branch"), F.count("*").alias("n"))
    lo, hi = F.lit(start).cast("timestamp") - F.expr("INTERVAL 1 HOUR"), F.lit(end).cast("timestamp") + F.expr("INTERVAL 5 MINUTES")
    f = f.where((F.col("first_ts") <= hi) & (F.col("last_ts") >= lo))
    best = f.groupBy(F.coalesce("slug", "file").alias("k")).agg(F.min(F.struct((-F.col("n")).alias("m"), "file"))["file"].alias("file"))
    return f.join(best.select("file"), "file", "left_semi")


def agent_jobs(records: DataFrame) -> DataFrame:
    """Per file first and last time, goal (first user text, 500) and result (last assistant text, 1000)."""
    said = lambda kind: F.when((F.col("type") == kind) & F.col("text").isNotNull(), F.col("ts"))
    return (
        records.where("ts is not null")
        .groupBy("file")
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.substring(F.min_by("text", said("user")), 1, 500).alias("goal"), F.substring(F.max_by("text", said("assistant")), 1, 1000).alias("result"))
    )


def transcript(records: DataFrame) -> DataFrame:
    """(session_id, part, text): the turns of a session as Markdown in parts of an hour, in order of time.

    Parts bound what meets in one task; a session is its parts one after the other.
    """
    turn = F.concat(F.lit("### "), F.upper("type"), F.lit(" ("), F.date_format("ts", "HH:mm"), F.lit(")\n\n"), F.coalesce("text", F.lit("")))
    r = records.where(F.col("type").isin("user", "assistant") & F.col("ts").isNotNull()).withColumn("part", F.floor(F.unix_timestamp("ts") / 3600))
    parts = F.array_sort(F.collect_list(F.struct("ts", "record_uuid", turn.alias("t"))))
    return r.groupBy("session_id", "part").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def parse_commits(lines: DataFrame, col: str = "value") -> DataFrame:
    """``hash|date|author|subject`` lines to commits; the subject may hold the separator."""
    p = F.split(F.col(col), r"\|", 4)
    return lines.where(F.size(p) == 4).select(
        F.concat(F.lit("git_"), p[0]).alias("id"), F.lit("git_commit").alias("type"), F.try_to_timestamp(p[1]).alias("timestamp"), p[2].alias("author"), p[3].alias("summary")
    )


def snapshots(versions: DataFrame, dates: DataFrame, slot: float = 30) -> DataFrame:
    """(path, date, hash): the version of each file as of each date; versions (path, ts, hash), dates (path, date)."""
    return asof_join(dates, versions, ["path"], "date", "ts", "hash", slot).where("hash is not null").select("path", "date", "hash")


def time_range(text: Column) -> tuple[Column, Column]:
    """First and last time stamp in the first and last 2,000 characters of a log; with dashes, slashes or a T, none that is part of a file's name."""
    ends = F.when(F.char_length(text) > 4000, F.concat(F.substring(text, 1, 2000), F.lit("\n"), F.right(text, F.lit(2000)))).otherwise(text)
    shapes = r"(?<![/_])(\d{4}-\d{2}-\d{2}(?:\s+|T)\d{2}:\d{2}:\d{2}|\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})(?!\.(?:md|json|txt|log))"
    stamp = lambda x: F.try_to_timestamp(F.regexp_replace(F.translate(x, "/T", "- "), r"\s+", " "))
    found = F.transform(F.regexp_extract_all(ends, F.lit(shapes), F.lit(1)), stamp)
    return F.array_min(found), F.array_max(found)


def is_relevant(last: Column, session_start: Column, tolerance_s: int = 3600) -> Column:
    """A log counts when it ends after the session's start less the tolerance, or has no times."""
    return F.coalesce(F.unix_timestamp(last) >= F.unix_timestamp(session_start) - tolerance_s, F.lit(True))


def chat_text(json: Column) -> Column:
    """Transcript of a JSON chat: ``messages`` of role and text under any of the usual keys."""
    m = F.from_json(F.coalesce(F.get_json_object(json, "$.messages"), F.get_json_object(json, "$.history"), json), "array<struct<role:string,type:string,content:string,text:string,message:string>>")
    line = lambda x: F.concat(F.lit("### "), F.upper(F.coalesce(x["role"], x["type"], F.lit("unknown"))), F.lit("\n\n"), F.coalesce(x["content"], x["text"], x["message"], F.lit("")))
    return F.array_join(F.transform(m, line), "\n\n")
