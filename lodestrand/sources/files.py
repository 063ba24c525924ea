"""Folders of mixed documents: text with encoding fallback, HTML, optional PDF and Office formats."""

from __future__ import annotations

import io
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = r"/(?:\.git|node_modules|__pycache__|\.venv)/"


def decode(data: bytes) -> str:
    """utf-8, else gb18030, else latin-1."""
    for name in ("utf-8", "gb18030"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1", "replace")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style") and self.off > 0

    def handle_data(self, data):
        if not self.off and data.strip():
            self.parts.append(data.strip())


def html_text(html: str) -> str:
    """The text of an HTML document, a line a text node; scripts and styles dropped."""
    p = _Text()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


def _pdf(data: bytes) -> str:
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def _docx(data: bytes) -> str:
    import re
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
    return "\n".join("".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", p)) for p in paragraphs)


def _xlsx(data: bytes) -> str:
    import re
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = re.findall(r"<si>.*?</si>", z.read("xl/sharedStrings.xml").decode("utf-8"), re.S) if "xl/sharedStrings.xml" in z.namelist() else []
    return "\n".join("".join(re.findall(r"<t[^>]*>([^<]*)</t>", s)) for s in shared)


def _pptx(data: bytes) -> str:
    import re
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        return "\n".join(" ".join(re.findall(r"<a:t>([^<]*)</a:t>", z.read(n).decode("utf-8"))) for n in names)


_BINARY = {"pdf": _pdf, "docx": _docx, "xlsx": _xlsx, "pptx": _pptx}


def text_of(path: str, data: bytes) -> tuple[str | None, str | None]:
    """Text of a file by its suffix, and the error where it couldn't be read."""
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        if suffix in _BINARY:
            return _BINARY[suffix](data), None
        text = decode(data)
        return (html_text(text) if suffix in ("html", "htm", "xhtml") else text), None
    except Exception as e:  # noqa: BLE001 - a bad file is reported, not raised
        return None, f"{type(e).__name__}: {e}"[:200]


def read_folder(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, modified, text, error) of every file below ``root``; bad files keep a row with their error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    files = files.where(~F.col("path").rlike(SKIPPED)).select("path", F.col("modificationTime").alias("modified"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [text_of(p, c) for p, c in zip(b.path, b.content)]
            yield pd.DataFrame({"path": b.path, "modified": b.modified, "text": [t for t, _ in got], "error": [e for _, e in got]})

    return files.mapInPandas(run, "path string, modified timestamp, text string, error string")


def of_session(files: DataFrame, start: float, end: float) -> DataFrame:
    """Files changed from an hour before a session's start to five minutes after its end, else on its first day (UTC). ``files``: with mtime in epoch seconds."""
    inside = F.col("mtime").between(start - 3600, end + 300)
    same_day = F.floor(F.col("mtime") / 86_400) == F.floor(F.lit(start) / 86_400)
    return files.where(inside | same_day).withColumn("how", F.when(inside, "window").otherwise("day"))


def to_resources(files: DataFrame) -> DataFrame:
    """Files with text as resource events: (id, type, timestamp, summary, content, path)."""
    line = F.trim(F.regexp_replace(F.try_element_at(F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: F.trim(x) != ""), F.lit(1)), r"^#+\s*", ""))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return files.where("text is not null and trim(text) <> ''").select(
        F.concat(F.lit("doc_"), F.substring(F.md5("path"), 1, 12)).alias("id"), F.lit("resource").alias("type"), F.col("modified").alias("timestamp"),
        F.when(F.char_length(line) < 100, line).otherwise(stem).alias("summary"), F.col("text").alias("content"), "path",
    )
