"""What stands in Markdown notes and transcripts: turns, open tasks, index tables, marks, sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T

# fixed values: the headings under which open tasks stand
TASK_HEADINGS = [
    r"\[待办\]", r"\[TODO\]", r"\[遗留\]", r"\[遗留问题\]", r"\[明日切入点\]", r"\[Next Steps?\]",
    r"\[下一步\]", r"##\s*待办", r"##\s*TODO", r"##\s*遗留", r"##\s*明日", r"##\s*⏭️",
]
# fixed values: what the summary of a turn begins with, by category
TURN_MARKS = {"completed_task": "完成", "problem": "问题", "decision": "决策", "pending": "待办", "code_change": "代码变更"}
# fixed values: the type of event a category becomes, in the order they are listed; changes of code become none
LAYER_TYPES = {"completed_task": "decision", "problem": "diagnostic", "decision": "decision", "pending": "task"}
SYNC_MARK = "SYNC_ID"


def _lines(col: Column) -> Column:
    return F.regexp_replace(col, r"\r\n?", "\n")


def turns(col: Column) -> Column:
    """Array of (user, assistant): the i-th USER block with the i-th ASSISTANT block; surplus users with ''."""
    t = _lines(col)
    said = lambda who: F.regexp_extract_all(t, F.lit(rf"### {who} \((?s:.*?)\)\n\n((?s:.*?))(?=\n### |\z)"), F.lit(1))
    strip = lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")
    users, answers = said("USER"), said("ASSISTANT")
    return F.transform(users, lambda u, i: F.struct(strip(u).alias("user"), F.coalesce(strip(F.get(answers, i)), F.lit("")).alias("assistant")))


def turn_summary(category: Column, user: Column) -> Column:
    """The category's mark and the first 100 characters of what the user said, on one line."""
    said = F.replace(F.substring(user, 1, 100), F.lit("\n"), F.lit(" "))
    out = F
    for k, mark in TURN_MARKS.items():
        out = out.when(category == k, F.concat(F.lit(f"{mark}: "), said, F.lit("...")))
    return out.otherwise(said)


def classified_turns(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, turn, category, place, summary): the turns of each text but those of no category, numbered within their category."""
    t = texts.select(F.col(id_col).alias("id"), F.posexplode(turns(F.col(text_col))).alias("turn", "t"))
    t = t.withColumn("category", T.turn_class(F.concat_ws("\n", "t.user", "t.assistant"))).where("category <> 'other'")
    t = t.select("id", "turn", "category", turn_summary(F.col("category"), F.col("t.user")).alias("summary"))
    place = F.row_number().over(Window.partitionBy("id", "category").orderBy("turn"))  # the turns of one text
    return t.withColumn("place", place)


def first_layer(chunks: DataFrame, most: int = 5) -> DataFrame:
    """(chunk_id, id, type, summary, session_id): events of a chunk's own turns, at most ``most`` of a category, in the order of the categories.

    A chunk without turns of its own is one turn. Ids count the chunk's events from 0.
    """
    wrapped = F.concat(F.lit("### USER (2024-01-01 00:00:00)\n\n"), F.col("content"), F.lit("\n\n### ASSISTANT (2024-01-01 00:00:01)\n\nAssistant response."))
    c = chunks.where("content is not null and content <> ''").select("chunk_id", "session_id", wrapped.alias("said")).distinct()
    names = F.array(*[F.lit(k) for k in LAYER_TYPES])
    t = classified_turns(c, "chunk_id", "said").where(F.col("category").isin(*LAYER_TYPES) & (F.col("place") <= most))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.array_position(names, F.col("category")), "place")) - 1  # at most 4 * most rows
    kind = F.create_map(*[F.lit(x) for p in LAYER_TYPES.items() for x in p])[F.col("category")]
    t = t.withColumn("n", nth).select(F.col("id").alias("chunk_id"), "n", kind.alias("type"), F.substring("summary", 1, 50).alias("summary"))
    key = F.concat_ws(":", "chunk_id", F.lit("l1"), F.col("n").cast("string"))
    t = t.select("chunk_id", F.concat(F.lit("evt_"), F.substring(F.sha2(key, 256), 1, 16)).alias("id"), "type", "summary")
    return t.join(c.select("chunk_id", "session_id").distinct(), "chunk_id")


def todo_items(col: Column) -> Column:
    """Distinct list items of more than three characters under each task heading, up to the next heading, else within 500 characters."""
    t = _lines(col)
    found = []
    for h in TASK_HEADINGS:
        behind = rf"(?i){h}(?=((?s:.*?))\n##|((?s:.{{0,500}})))"
        found.append(F.concat(F.regexp_extract_all(t, F.lit(behind), F.lit(1)), F.regexp_extract_all(t, F.lit(behind), F.lit(2))))
    items = F.flatten(F.transform(F.flatten(F.array(*found)), lambda x: F.regexp_extract_all(x, F.lit(r"(?m)^\s*[-*]\s*(.+)$"), F.lit(1))))
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: F.char_length(x) > 3))


INDEX_ROW = "id string, row int, day string, job string, status string, summary string, tags string"


def table_rows(text: str | None) -> list[tuple[str, str, str, str, str]]:
    """(day, job, status, summary, tags) of the rows of an index table; a row without day has that of the row before."""
    out, inside, day = [], False, ""
    for line in re.split(r"\r\n|\n|\r", text or ""):
        line = line.strip()
        if "| Date" in line or "| Job" in line:
            inside = True
        elif inside and line.startswith("|") and "---" not in line:
            cells = [c.strip() for c in line.split("|")][1:]
            cells = cells[:-1] if cells and not cells[-1] else cells
            if len(cells) >= 2:
                day = cells[0].replace("**", "").strip() or day
                name = re.search(r"\[([^\]]+)\]", cells[1])
                out.append((day, name[1] if name else cells[1], *[cells[i] if len(cells) > i else "" for i in (2, 3, 4)]))
    return out


def index_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, day, job, status, summary, tags) of the index tables of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *r) for k, t in zip(b.id, b.text) for i, r in enumerate(table_rows(t))]
            yield pd.DataFrame(rows, columns=["id", "row", "day", "job", "status", "summary", "tags"]).astype({"row": "int32"})

    return texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("text").contains("|")).mapInPandas(run, INDEX_ROW)


def sync_ids(col: Column, mark: str = SYNC_MARK) -> Column:
    """The ids in comments ``<!-- ...SYNC_ID: id -->``, in their order; what stands before the mark is free."""
    return F.regexp_extract_all(col, F.lit(rf"<!--\s*\w*{mark}:\s*([a-zA-Z0-9\-]+)\s*-->"), F.lit(1))


def section(col: Column, words: list[str]) -> Column:
    """The text under the first heading that holds one of the words, up to the next heading; '' where there is none."""
    any_of = "|".join(re.escape(w) for w in words)
    return F.regexp_replace(F.regexp_extract(_lines(col), rf"(?im)^#[^\n]*(?:{any_of})[^\n]*\n?((?:(?!#)[^\n]*(?:\n|\z))*)", 1), r"\A\s+|\s+\z", "")


def path_day(path: Column) -> Column:
    """The date in a path of the shape YYYY/MM-DD or YYYY-MM-DD, as a date; null where there is none or it is no date."""
    got = lambda rx: F.try_to_date(F.concat_ws("-", *[F.regexp_extract(path, rx, i) for i in (1, 2, 3)]))
    return F.coalesce(got(r"(\d{4})/(\d{2})-(\d{2})"), got(r"(\d{4})-(\d{2})-(\d{2})"))
