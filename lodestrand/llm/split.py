"""Splitting oversized items at natural boundaries.

Method: content-defined chunking. A rolling hash over the characters (a gear hash with
a window of 32) marks landmarks where its low bits are zero; the position of a landmark
depends on the text around it only. From a piece's start the first landmark within the
allowed sizes is taken and snapped to the nearest natural boundary (paragraph, line,
sentence, clause, word, in that order of worth). An edit therefore moves the cuts near
it; the following cuts meet the old ones at the next shared landmark.

Each piece but the first starts ``overlap`` characters before the cut, or at the natural
boundary nearest to that. A piece never exceeds ``limit`` characters and never cuts a
surrogate pair, a CR LF pair or a base character from its combining marks.

Numbering: the items of an event are renumbered over all its pieces without sorting an
event in one task: piece counts are summed per block of 1,024 old numbers first.

Defined cases: null and empty texts have no piece; items within the limit are one
unchanged piece; a text without any boundary is cut at the limit; repeated rows of one
(event_id, chunk_seq) give their pieces once, from the least text if they differ; extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 3200
OVERLAP = 480
LEAST = 1200  # new characters a piece has at least, where the text goes on
_MASK = 0xFF  # a landmark every 256 characters on average
_SNAP = 200  # characters a landmark may move to a boundary
_CHARS_PER_TOKEN = 4

_GEAR = np.random.default_rng(20260105).integers(0, 2**32, 1024, dtype=np.uint32)

_BOUNDARIES = [
    (5, re.compile(r"\n[ \t\r]*\n+|\r\n[ \t]*(?:\r\n)+")),
    (4, re.compile(r"\r\n|\n|\r")),
    (3, re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？；]+[”’」』）]*\s*")),
    (2, re.compile(r"[,;:，、：]\s*")),
    (1, re.compile(r"\s+")),
]


def landmarks(text: str) -> np.ndarray:
    """Positions where the rolling hash of the 32 characters before has its low bits zero."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    g = _GEAR[(codes ^ (codes >> np.uint32(10))) & np.uint32(1023)]
    h = np.zeros(n, dtype=np.uint32)
    for back in range(min(32, n)):  # h[i] = sum of g[i - back] << back; older characters are shifted out
        h[back:] += g[: n - back] << np.uint32(back)
    # the high bits hold the whole window
    return np.flatnonzero((h >> np.uint32(24)) & np.uint32(_MASK) == 0) + 1


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions at which the text may be cut, and their worth from 1 (word) to 5 (paragraph)."""
    worth: dict[int, int] = {}
    for w, rx in _BOUNDARIES:
        for m in rx.finditer(text):
            worth.setdefault(m.end(), w)
    at = np.array(sorted(p for p in worth if 0 < p < len(text)), dtype=np.int64)
    return at, np.array([worth[p] for p in at], dtype=np.int64)


def _safe(text: str, at: int, least: int) -> int:
    """The nearest position not after ``at`` that parts nothing that belongs together."""
    p = at
    while p > least and p < len(text) and (
        text[p - 1 : p + 1] == "\r\n" or unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍"
        or "\udc00" <= text[p] <= "\udfff"
    ):
        p -= 1
    return p if p > least else at


def _snap(at: np.ndarray, worth: np.ndarray, mark: int, lo: int, hi: int) -> int | None:
    """The boundary nearest to ``mark`` within [lo, hi], of the highest worth within reach."""
    i, j = np.searchsorted(at, [max(lo, mark - _SNAP), min(hi, mark + _SNAP) + 1])
    if i == j:
        return None
    near, w = at[i:j], worth[i:j]
    best = w.max()
    near = near[w == best]
    return int(near[np.argmin(np.abs(near - mark))])


def split_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the pieces; a piece starts before the end of the one before it."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half of limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    least = max(1, min(least, limit - overlap - 1))
    marks, (at, worth) = landmarks(text), boundaries(text)
    spans, start, new = [], 0, 0  # new: where the piece's own characters begin
    while True:
        hi = start + limit
        if hi >= n:
            spans.append((start, n))
            return spans
        lo = min(new + least, hi - 1)
        cut = None
        i = np.searchsorted(marks, lo)
        if i < len(marks) and marks[i] <= hi:
            cut = _snap(at, worth, int(marks[i]), lo, hi)
        if cut is None:  # no landmark, or none near a boundary: the last boundary of the highest worth
            i, j = np.searchsorted(at, [lo, hi + 1])
            if i < j:
                best = worth[i:j].max()
                cut = int(at[i:j][worth[i:j] == best][-1])
            else:
                cut = _safe(text, hi, lo)
        spans.append((start, cut))
        want = cut - overlap
        i, j = np.searchsorted(at, [max(start + 1, want - overlap // 2), min(cut - 1, want + overlap // 2) + 1])
        if want > start and i < j:
            near = at[i:j]
            start = int(near[np.argmin(np.abs(near - want))])
        else:
            start = _safe(text, max(start + 1, want), start + 1)
        new = cut


PIECES = "event_id string, chunk_seq int, chunk_pos int, piece int, n_pieces int, start_char int, chunk_text string"


def split_long(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the items longer than ``limit``; only those cross into Python.

    Columns: event_id, chunk_seq (old), chunk_pos (old), piece, n_pieces, start_char, chunk_text.
    """
    long = (
        items.where(F.char_length("chunk_text") > limit)
        .groupBy("event_id", "chunk_seq")
        .agg(F.min(F.struct("chunk_text", "chunk_pos")).alias("i"))
        .select("event_id", "chunk_seq", "i.chunk_pos", "i.chunk_text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e, s, p, t in zip(b.event_id, b.chunk_seq, b.chunk_pos, b.chunk_text):
                spans = split_spans(t, limit, overlap)
                rows += [(e, s, p, k, len(spans), lo, t[lo:hi]) for k, (lo, hi) in enumerate(spans)]
            out = pd.DataFrame(rows, columns=["event_id", "chunk_seq", "chunk_pos", "piece", "n_pieces", "start_char", "chunk_text"])
            yield out.astype({"chunk_seq": "Int32", "chunk_pos": "Int32"})

    return long.mapInPandas(run, PIECES)


def renumber(items: DataFrame, pieces: DataFrame) -> DataFrame:
    """The pieces with their new chunk_seq and chunk_pos.

    new_seq counts over all pieces of the event, items within the limit being one piece
    each; new_pos is the item's position plus the characters before the piece in tokens.
    """
    sizes = pieces.where("piece = 0").select("event_id", "chunk_seq", "n_pieces")
    every = items.where("event_id is not null and chunk_seq is not null").select("event_id", "chunk_seq").distinct()
    every = every.join(pieces.select("event_id").distinct(), "event_id", "left_semi")
    counted = every.join(sizes, ["event_id", "chunk_seq"], "left").select(
        "event_id", "chunk_seq", F.floor(F.col("chunk_seq") / 1024).alias("block"), F.coalesce("n_pieces", F.lit(1)).alias("n")
    )
    # blocks of an event first, then the at most 1,024 items of a block
    blocks = counted.groupBy("event_id", "block").agg(F.sum("n").alias("bn"))
    wb = Window.partitionBy("event_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("event_id", "block", F.coalesce(F.sum("bn").over(wb), F.lit(0)).alias("before"))
    wi = Window.partitionBy("event_id", "block").orderBy("chunk_seq").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.withColumn("in_block", F.coalesce(F.sum("n").over(wi), F.lit(0))).join(blocks, ["event_id", "block"])
    firsts = firsts.select("event_id", "chunk_seq", (F.col("before") + F.col("in_block")).alias("first_seq"))
    return pieces.join(firsts, ["event_id", "chunk_seq"]).select(
        "event_id",
        F.col("chunk_seq").alias("old_seq"),
        (F.col("first_seq") + F.col("piece")).cast("long").alias("chunk_seq"),
        (F.coalesce("chunk_pos", F.lit(0)) + F.floor(F.col("start_char") / _CHARS_PER_TOKEN)).cast("long").alias("chunk_pos"),
        "piece",
        "n_pieces",
        "chunk_text",
    )


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Every piece of every item longer than ``limit``, renumbered."""
    return renumber(items, split_long(items, limit, overlap))


def split_found(items: DataFrame) -> DataFrame:
    """(event_id, chunk_seq) of each item that had to be split, from its pieces."""
    return split_long(items).where("piece = 0").select("event_id", F.col("chunk_seq").cast("long").alias("chunk_seq"))


def rebuilt(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(event_id, chunk_seq, n_chars, digest, within_limit, overlaps): each split item put together again from its pieces.

    ``overlaps``: every piece but the first begins before the end of the one before it.
    """
    w = Window.partitionBy("event_id", "chunk_seq").orderBy("piece")  # the pieces of one item
    p = split_long(items, limit, overlap).withColumn("end", F.col("start_char") + F.char_length("chunk_text"))
    p = p.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    own = F.struct("piece", F.expr("substring(chunk_text, before - start_char + 1)").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["t"]), "")
    per = p.groupBy("event_id", "chunk_seq").agg(text.alias("t"), F.max(F.char_length("chunk_text")).alias("most"), F.min((F.col("piece") == 0) | (F.col("start_char") < F.col("before"))).alias("overlaps"))
    return per.select("event_id", F.col("chunk_seq").cast("long").alias("chunk_seq"), F.char_length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"), (F.col("most") <= limit).alias("within_limit"), "overlaps")
