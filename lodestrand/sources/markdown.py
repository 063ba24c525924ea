"""Markdown events with frontmatter: date-partitioned folders in, one file an event out."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the event types and sources an event may have
EVENT_TYPES = ["decision", "code_change", "diagnostic", "research", "discussion", "task", "resource", "unknown", "failed_attempt", "abandoned_idea", "ai_conversation", "reasoning", "convention", "git_commit", "incident", "experiment", "requirement"]
SOURCES = ["claude_code", "cursor", "continue_dev", "windsurf", "manual", "file"]
RESERVED = ["id", "type", "source", "timestamp", "summary", "tags", "confidence"]


def day_folders(root: str, start: dt.date, end: dt.date) -> list[str]:
    """``root/YYYY/MM/DD`` for each day of an inclusive range."""
    return [f"{root}/{start + dt.timedelta(days=i):%Y/%m/%d}" for i in range((end - start).days + 1)]


def read_texts(spark: SparkSession, root: str, start: dt.date | None = None, end: dt.date | None = None, glob: str = "*.md") -> DataFrame:
    """(path, text) of whole files, only of the days asked for: folders are listed, not filtered after reading."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if start is None or end is None:
        paths = [root]
    else:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        there = lambda p: (q := fs.Path(p)).getFileSystem(conf).exists(q)
        paths = [p for p in day_folders(root, start, end) if there(p)]
    if not paths:
        return spark.createDataFrame([], "path string, text string")
    return reader.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def frontmatter(text: Column) -> Column:
    """Map of the ``key: value`` lines of the block between two ``---`` lines, or of leading such lines.

    Keys are lower-cased with ``-`` as ``_``; quotes around values are dropped.
    """
    body = F.regexp_replace(text, r"\r\n?", "\n")
    block = F.regexp_extract(body, r"\A\s*(?:---\n((?s:.*?))\n---(?:\n|\z))", 1)
    block = F.when(block != "", block).otherwise(F.regexp_extract(body, r"\A((?:[\w \-]+:[^\n]*(?:\n|\z))+)", 1))
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[\w \-]+:"))
    key = lambda x: F.regexp_replace(F.lower(F.trim(F.regexp_extract(x, r"^([\w \-]+):", 1))), r"[- ]", "_")
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w \-]+:(.*)$", 1)), r"^([\"'])(.*)\1$", "$2")
    entries = F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    # of a repeated key the last line counts
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def listed(value: Column) -> Column:
    """``[a, b]`` or ``a, b`` as an array."""
    items = F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), r"^([\"'])(.*)\1$", "$2"))
    return F.filter(items, lambda x: x != "")


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def parse_events(texts: DataFrame) -> DataFrame:
    """(path, text) to events: id, type, source, timestamp, summary, content, tags, confidence, metadata, path.

    Unknown types become ``unknown``, bad sources ``claude_code``, bad confidence 1.0; a missing
    id is the file's stem, a missing summary the first heading or 50 characters; a missing or
    bad timestamp is null, so the result doesn't depend on the time of reading.
    """
    body = F.regexp_replace(F.col("text"), r"\r\n?", "\n")
    content = stripped(F.regexp_replace(body, r"\A\s*---\n(?s:.*?)\n---(?:\n|\z)", ""))
    e = texts.select("path", frontmatter(F.col("text")).alias("m"), content.alias("body"))
    get = lambda k: F.nullif(F.try_element_at("m", F.lit(k)), F.lit(""))
    heading = F.nullif(F.regexp_extract("body", r"(?m)^# +(.+)$", 1), F.lit(""))
    conf = get("confidence").try_cast("double")
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    when = F.coalesce(F.try_to_timestamp(get("timestamp")), F.try_to_timestamp(get("timestamp"), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(get("timestamp"), F.lit("yyyy-MM-dd")))
    return e.select(
        F.coalesce(get("id"), stem).alias("id"),
        F.when(get("type").isin(EVENT_TYPES), get("type")).otherwise("unknown").alias("type"),
        F.when(get("source").isin(SOURCES), get("source")).otherwise("claude_code").alias("source"),
        when.alias("timestamp"),
        F.coalesce(get("summary"), heading, F.substring("body", 1, 50)).alias("summary"),
        stripped(F.regexp_replace("body", r"\A# +[^\n]*\n*", "")).alias("content"),
        F.coalesce(listed(get("tags")), F.array()).alias("tags"),
        F.when(conf.between(0, 1), conf).otherwise(1.0).alias("confidence"),
        F.map_filter("m", lambda k, v: ~k.isin(RESERVED)).alias("metadata"),
        "path",
    )


# fixed values: the log types with a frontmatter of their own, and the names two of them had
LOG_TYPES = ["session-start", "session-end", "job-start", "job-end"]
OLD_TYPES = {"daily-start": "session-start", "daily-end": "session-end"}


def typed_frontmatter(texts: DataFrame) -> DataFrame:
    """(path, kind, date, status, job_id, description, tags, error): the frontmatter of logs by their type, with what is wrong with it.

    Dates may be written Y-m-d, Y/m/d or d-m-Y; a job needs an id of small letters, digits, - and _.
    Any other type is an event's and needs an id. A bad one has an error and null in its fields.
    """
    m = texts.select("path", frontmatter(F.col("text")).alias("m"))
    get = lambda k: F.nullif(F.try_element_at("m", F.lit(k)), F.lit(""))
    kind = get("type")
    for old, new in OLD_TYPES.items():
        kind = F.when(get("type") == old, new).otherwise(kind)
    date = F.coalesce(*[F.when(get("date").rlike(rx), F.to_date(F.try_to_timestamp(get("date"), F.lit(f)))) for rx, f in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"))])
    r = m.select("path", kind.alias("kind"), date.alias("date"), F.coalesce(get("status"), F.lit("active")).alias("status"), get("job_id").alias("job_id"), F.coalesce(get("description"), F.lit("")).alias("description"), F.coalesce(listed(get("tags")), F.array()).alias("tags"), get("id").alias("id"))
    log = F.coalesce(F.col("kind").isin(LOG_TYPES), F.lit(False))
    job = F.coalesce(F.col("kind").startswith("job-"), F.lit(False))
    error = F.when(F.col("kind").isNull(), "no frontmatter").when(~log & F.col("id").isNull(), "no id").when(log & F.col("date").isNull(), "bad date").when(log & job & ~F.coalesce(F.col("job_id").rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False)), "bad job id")
    fields = [F.when(error.isNull(), F.col(c)).alias(c) for c in ("kind", "date", "status", "job_id", "description", "tags")]
    return r.select("path", *fields, error.alias("error"))


def to_markdown(events: DataFrame) -> DataFrame:
    """(id, day, text): frontmatter without empty values, heading (where there is a summary) and content."""
    line = lambda k, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), v))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]")))
    head = F.concat_ws("\n", line("id", F.col("id")), line("type", F.col("type")), line("source", F.col("source")), line("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")), line("tags", tags), line("confidence", F.col("confidence").cast("string")))
    text = F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), F.coalesce(F.concat(F.lit("# "), F.nullif(F.trim("summary"), F.lit("")), F.lit("\n\n")), F.lit("")), F.coalesce("content", F.lit("")), F.lit("\n"))
    return events.select("id", F.date_format("timestamp", "yyyy/MM/dd").alias("day"), text.alias("text"))


def write_markdown(events: DataFrame, root: str) -> None:
    """One ``YYYY/MM/DD/<id>.md`` an event under ``root``, a folder that all executors share.

    Each task writes its own rows through the folder's own file system (named by its URI; one
    without a scheme is Hadoop's default). The path of a row is fixed, so a retry overwrites it.
    On a cluster, a ``file:`` folder must be a shared mount.
    """
    sc = events.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()

    def put(rows) -> None:
        from pyarrow import fs as filesystems

        system, base = filesystems.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
        made = set()
        for r in rows:
            folder = f"{base}/{r.day or 'undated'}"
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{PurePosixPath(r.id).name}.part"
            with system.open_output_stream(part) as out:
                out.write(r.text.encode("utf-8", "surrogatepass"))
            system.move(part, f"{folder}/{PurePosixPath(r.id).name}.md")

    to_markdown(events.where("id is not null and id <> ''")).foreachPartition(put)
