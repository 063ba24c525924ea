"""Filters, joins, windows and aggregates over the event index.

The index may hold an id several times; ``latest`` is the upsert view the others read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T


ORDER = ["updated_at", "mtime", "status", "markdown_path"]


def latest(index: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Latest-wins upsert on id: greatest updated_at (null least), then mtime, then status.

    ``columns``: those wanted besides; an aggregate of whole rows can't be pruned by the optimizer.

    An aggregate rather than a window: it combines map-side, so an id repeated without
    bound never gathers in one task.
    """
    if columns is not None:
        index = index.select("id", *dict.fromkeys([*ORDER, *columns]))
    rest = [c for c in index.columns if c != "id"]
    order = F.struct(F.coalesce("updated_at", F.lit(float("-inf"))), "mtime", "status", "markdown_path")
    best = index.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select("id", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*index.columns)


def query(events: DataFrame, type=None, source=None, status=None, date_from=None, date_to=None, job_id=None) -> DataFrame:
    """Conjunctive filters; arguments that are empty are skipped."""
    for col, v in (("type", type), ("source", source), ("status", status), ("job_id", job_id)):
        events = events.where(F.col(col) == v) if v else events
    events = events.where(F.col("date") >= F.lit(date_from).cast("date")) if date_from else events
    return events.where(F.col("date") <= F.lit(date_to).cast("date")) if date_to else events


def newest(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, ties by id: a top-k, not a sort of all rows."""
    return events.orderBy(F.desc("timestamp"), "id").offset(offset).limit(limit)


def metadata(field: str, json: str = "json_cache") -> Column:
    return F.get_json_object(F.col(json), f"$.metadata.{field}")


def context_key(session: Column, job: Column) -> Column:
    """session and job, session, job, or ungrouped."""
    s, j = F.nullif(session, F.lit("")), F.nullif(job, F.lit(""))
    return (
        F.when(s.isNotNull() & j.isNotNull(), F.concat(F.lit("session="), s, F.lit(" | job="), j))
        .when(s.isNotNull(), F.concat(F.lit("session="), s))
        .when(j.isNotNull(), F.concat(F.lit("job="), j))
        .otherwise("ungrouped")
    )


def coalesced(events: DataFrame) -> DataFrame:
    """Rows without chunk, all second-layer rows, and first-layer rows of chunks without a second layer."""
    l2 = events.where("source_layer = 'l2'").select("source_chunk_id").distinct()
    alone = events.where("source_layer = 'l1' and source_chunk_id is not null").join(l2, "source_chunk_id", "left_anti")
    none = events.where("source_chunk_id is null")
    second = events.where("source_layer = 'l2' and source_chunk_id is not null")
    return none.unionByName(second).unionByName(alone.select(*events.columns))


def representative(events: DataFrame) -> DataFrame:
    """Layered rows where a second-layer row stands for first-layer rows of the same chunk and type."""
    l2 = events.where("source_layer = 'l2'").select("source_chunk_id", "type").distinct()
    alone = events.where("source_layer = 'l1' and source_chunk_id is not null").join(l2, ["source_chunk_id", "type"], "left_anti")
    second = events.where("source_layer = 'l2' and source_chunk_id is not null")
    return second.unionByName(alone.select(*events.columns))


def file_refs(events: DataFrame) -> DataFrame:
    """(event_id, file_path, file_name): the module path and the own path of each event, normalised and distinct."""
    paths = F.array_distinct(F.filter(F.array(T.normal_path(metadata("module_path")), T.normal_path(F.col("markdown_path"))), lambda p: p.isNotNull() & (p != "")))
    return events.select(F.col("id").alias("event_id"), F.explode(paths).alias("file_path")).withColumn("file_name", T.base_name(F.col("file_path")))


def by_file(events: DataFrame, refs: DataFrame, target: str, limit: int = 50) -> DataFrame:
    """Events that refer to a file (rank 1), topped up with those that mention it (rank 2)."""
    base = target.rsplit("/", 1)[-1]
    hit = refs.where((F.col("file_path") == target) | F.col("file_path").endswith("/" + target) | (F.col("file_name") == base))
    direct = events.join(hit.select(F.col("event_id").alias("id")).distinct(), "id", "left_semi")
    said = events.where(F.col("json_cache").contains(target) | F.col("summary").contains(target)).join(direct.select("id"), "id", "left_anti")
    both = direct.withColumn("branch", F.lit(1)).unionByName(said.withColumn("branch", F.lit(2)))
    return both.orderBy("branch", F.desc("timestamp"), "id").limit(limit)


def first_k(df: DataFrame, by: list[str], col: str, k: int) -> DataFrame:
    """The k least different values of ``col`` per group as an array; a map task sends k of a group at most."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(col))
    few = df.select(*by, col).distinct().withColumn("_r", r).where(F.col("_r") <= k)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list(col)).alias("first"))


def neighbours(events: DataFrame, n: int = 3) -> DataFrame:
    """(id, side, rank, near_id): the n events before and after each event, equal times excluded.

    Whole-table order without one task: equal times are one row, rows are ordered inside day
    slots, and each slot also gets the n last and first times of the n slots next to it.
    """
    e = events.select("id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us")).where("us is not null")
    times = first_k(e, ["us"], "id", n).withColumn("slot", F.floor(F.col("us") / 86_400_000_000))
    # one row a day
    slots = times.select("slot").distinct().withColumn("i", F.row_number().over(Window.orderBy("slot")))
    own = times.join(slots, "slot").select("i", "us", "first", F.lit(True).alias("own"))
    rank = lambda o: F.row_number().over(Window.partitionBy("i").orderBy(o))
    ends = own.withColumn("a", rank(F.asc("us"))).withColumn("z", rank(F.desc("us")))
    beside = lambda sign: F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.col("i") + k * sign))
    later = ends.where(F.col("z") <= n).select(beside(1).alias("i"), "us", "first", F.lit(False).alias("own"))
    sooner = ends.where(F.col("a") <= n).select(beside(-1).alias("i"), "us", "first", F.lit(False).alias("own"))
    seen = own.unionByName(later).unionByName(sooner)
    w = Window.partitionBy("i").orderBy("us")
    near = F.struct("us", "first")
    pick = (
        seen.withColumn("before", F.collect_list(near).over(w.rowsBetween(-n, -1)))
        .withColumn("after", F.collect_list(near).over(w.rowsBetween(1, n)))
        .where("own")
    )
    names = lambda arr: F.slice(F.flatten(F.transform(arr, lambda x: x["first"])), 1, n)
    sides = pick.select("us", names(F.sort_array("before", asc=False)).alias("before"), names(F.sort_array("after")).alias("after"))
    each = e.join(sides, "us")
    one = lambda side: each.select("id", F.lit(side).alias("side"), F.posexplode(side).alias("r", "near_id")).select("id", "side", (F.col("r") + 1).alias("rank"), "near_id")
    return one("before").unionByName(one("after"))


def neighbours_of(events: DataFrame, at_us: int, n: int = 3) -> DataFrame:
    """The n events before and after one moment: two top-k."""
    e = events.select("id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"))
    before = e.where(F.col("us") < at_us).orderBy(F.desc("us"), "id").limit(n).withColumn("side", F.lit("before"))
    return before.unionByName(e.where(F.col("us") > at_us).orderBy("us", "id").limit(n).withColumn("side", F.lit("after")))


def day_gaps(events: DataFrame, hours: float = 4.0) -> DataFrame:
    """(date, from_us, to_us, hours): gaps of more than ``hours`` between consecutive events of a day.

    Hour slots first (a slot keeps first and last only), so a busy day costs 24 rows.
    """
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    slots = events.select("date", us.alias("us")).groupBy("date", F.floor(F.col("us") / 3_600_000_000).alias("h")).agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    w = Window.partitionBy("date").orderBy("h")
    g = slots.withColumn("from_us", F.lag("hi").over(w)).where(F.col("from_us").isNotNull())
    g = g.select("date", "from_us", F.col("lo").alias("to_us"), ((F.col("lo") - F.col("from_us")) / 3.6e9).alias("hours"))
    return g.where(F.col("hours") > hours)


def daily_stats(events: DataFrame) -> DataFrame:
    """(date, kind, value, n): totals, and counts by type, hour, session and job, in one pass of grouping sets."""
    e = events.select("date", "type", F.hour("timestamp").cast("string").alias("hour"), F.nullif(metadata("session_id"), F.lit("")).alias("session"), F.nullif(F.col("job_id"), F.lit("")).alias("job"))
    g = e.groupingSets([["date"], ["date", "type"], ["date", "hour"], ["date", "session"], ["date", "job"]], "date", "type", "hour", "session", "job").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 15, "total").when(F.col("gid") == 7, "type").when(F.col("gid") == 11, "hour").when(F.col("gid") == 13, "session").otherwise("job")
    return g.select("date", kind.alias("kind"), F.coalesce("type", "hour", "session", "job", F.lit("")).alias("value"), "n").where("kind = 'total' or value <> ''")


def dashboard_days(events: DataFrame) -> DataFrame:
    """(date, n) over the whole span, days without events as 0."""
    per = events.groupBy("date").agg(F.count("*").alias("n"))
    span = per.agg(F.min("date").alias("a"), F.max("date").alias("z")).where("a is not null").select(F.explode(F.sequence("a", "z")).alias("date"))
    return span.join(per, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"))


def tag_counts(events: DataFrame) -> DataFrame:
    """(tag, n) over the comma-separated tags."""
    return events.select(F.explode(F.split("tags", ",")).alias("tag")).select(F.trim("tag").alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))
