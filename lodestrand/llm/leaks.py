"""Evaluation texts leaking into training text.

A document leaks an item when it holds at least ``MIN_WORDS`` words in a row of it;
words are runs of letters and digits, case and all between them are ignored.

Method: prefix-filtered set join with positions.

* Tokens are shingles of ``SHINGLE`` words. A shared run of ``MIN_WORDS`` words holds
  t = MIN_WORDS - SHINGLE + 1 shingles in a row, so of every t shingles in a row of an
  item one must be shared by any document that shares the run.
* Shingles are ordered by rarity, counted over all documents. Of every window of t the
  rarest is kept: these are the necessary prefix tokens, the only ones joined on.
* The documents are read once. A bit filter of fixed size (``FILTER_BITS``, whatever the
  number of items) drops positions that hold no item's shingle; what it lets through is
  counted, and of a document only stretches of t such positions in a row go on with their
  words (length bound), as no shorter one can hold a shared run.
* In those stretches positions of prefix tokens, found by a second filter of that size, join
  the items on the shingle's hash, with the words around them that a run can reach (position
  bound). Each candidate is verified on the words: the run of equal words around the shingle
  must reach ``MIN_WORDS``.

A filter that lets too much through costs time, never rows: every shingle is compared exactly
in the join. Skewed hashes (a passage in a third of all documents) are split by adaptive
execution, as the items' side of a hash is small.

Defined cases: null and empty texts hold no words; texts and items under ``MIN_WORDS``
words can't match; repeated items and documents are reported for each id; empty tables
give no rows; rows without doc_id are left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.tables import cut

MIN_WORDS = 8
SHINGLE = 4
FILTER_BITS = 1 << 25  # 4 MB
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], dtype=np.uint64)


def words(text: str | None) -> list[str]:
    """The words of a text, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def _shingle_hashes(lists: list[list[str]], q: int) -> list[np.ndarray]:
    """Per list the hash of the shingle at each position; word hashes are made once a batch."""
    flat = [w for ws in lists for w in ws]
    codes, uniques = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    of_word = np.array([xxhash.xxh64_intdigest(u) for u in uniques], dtype=np.uint64)
    h = of_word[codes] if flat else np.zeros(0, np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for ws in lists:
            n = len(ws) - q + 1
            if n < 1:
                out.append(np.zeros(0, np.int64))
            else:
                x = np.zeros(n, np.uint64)
                for j in range(q):
                    x = (x ^ h[at + j : at + j + n]) * _MIX[j % 8]
                    x ^= x >> np.uint64(29)
                out.append(x.view(np.int64))
            at += len(ws)
    return out


_TOKEN = "item_id long, pos int, h long, around array<string>, left int"


def _around(ws: list[str], at: int, q: int, least: int) -> tuple[list[str], int]:
    """The words that a run of ``least`` words through the shingle at ``at`` can reach, and how many stand before it."""
    lo, hi = max(0, at - (least - q)), min(len(ws), at + least)
    return ws[lo:hi], at - lo


def item_shingles(items: DataFrame, q: int = SHINGLE, least: int = MIN_WORDS) -> DataFrame:
    """(item_id, pos, h, around, left) of every shingle of every item that is long enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [words(t) for t in b.text]
            rows = []
            for item, ws, hs in zip(b.item_id, lists, _shingle_hashes(lists, q)):
                if len(ws) >= least:
                    rows += [(item, p, int(h), *_around(ws, p, q, least)) for p, h in enumerate(hs)]
            yield pd.DataFrame(rows, columns=["item_id", "pos", "h", "around", "left"])

    return items.where("text is not null").select("item_id", "text").distinct().mapInPandas(run, _TOKEN)


def bit_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bits set for the hashes of column ``h``; set in the cluster, ``bits`` / 64 words at most reach the driver."""
    words = hashes.selectExpr(f"cast(pmod(h, {bits}) div 64 as int) as w", f"shiftleft(1L, cast(pmod(h, {bits}) % 64 as int)) as b")
    some = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(-(-bits // 64), np.uint64)
    out[some.w.to_numpy(np.int64)] = some.b.to_numpy(np.int64).view(np.uint64)
    return out


def _may_hold(hs: np.ndarray, filled: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the filter lets through: all it was filled with and few others."""
    slot = np.mod(hs, bits)
    return (filled[slot // 64] >> (slot % 64).astype(np.uint64)) & np.uint64(1) == 1


def _stretches(held: np.ndarray, t: int) -> list[tuple[int, int]]:
    """(first, past the last) of the runs of at least ``t`` true values."""
    edge = np.diff(np.concatenate([[0], held.astype(np.int8), [0]]))
    return [(int(a), int(z)) for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)) if z - a >= t]


_SEEN = "h long, n long, doc_id long, words array<string>"


def scan(documents: DataFrame, shingles: DataFrame, q: int = SHINGLE, least: int = MIN_WORDS, bits: int = FILTER_BITS) -> DataFrame:
    """One pass over the documents: (h, n) how often a shingle occurs, summed per batch, and (doc_id, words) of the stretches that may match."""
    filled, t = bit_filter(shingles, bits), least - q + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [words(x) for x in b.text]
            parts, rows = [], []
            for doc, ws, hs in zip(b.doc_id, lists, _shingle_hashes(lists, q)):
                held = _may_hold(hs, filled, bits)
                parts.append(hs[held])
                rows += [(None, None, doc, ws[a : z + q - 1]) for a, z in _stretches(held, t)]
            h, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
            counted = pd.DataFrame({"h": pd.array(h, "Int64"), "n": pd.array(n, "Int64"), "doc_id": pd.array([None] * len(h), "Int64"), "words": None})
            found = pd.DataFrame(rows, columns=["h", "n", "doc_id", "words"]).astype({"h": "Int64", "n": "Int64", "doc_id": "Int64"})
            yield pd.concat([counted, found]) if len(found) else counted

    return documents.where("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(run, _SEEN)


def shingle_counts(seen: DataFrame) -> DataFrame:
    """(h, n): how often the shingles occur over all documents."""
    return seen.where("h is not null").groupBy("h").agg(F.sum("n").alias("n"))


def prefix_tokens(shingles: DataFrame, counts: DataFrame, q: int = SHINGLE, least: int = MIN_WORDS) -> DataFrame:
    """The rarest of every t shingles in a row of an item; ties go to the smaller hash, then position.

    One group per item: as large as an item, whatever the corpus.
    """
    t = least - q + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        order = np.lexsort((pdf.pos, pdf.h, pdf.n))
        rank = np.empty(len(pdf), np.int64)
        rank[order] = np.arange(len(pdf))
        kept = {int(i + np.argmin(rank[i : i + t])) for i in range(max(1, len(pdf) - t + 1))}
        return pdf.loc[sorted(kept), ["item_id", "pos", "h", "around", "left"]]

    rare = shingles.join(counts, "h", "left").select(*shingles.columns, F.coalesce("n", F.lit(0)).alias("n"))
    return rare.groupBy("item_id").applyInPandas(run, _TOKEN)


def _candidates(seen: DataFrame, tokens: DataFrame, q: int, least: int, bits: int) -> DataFrame:
    """(doc_id, h, d_around, d_left) of the stretches' positions that may hold a prefix token."""
    filled = bit_filter(tokens, bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [list(w) for w in b.words]
            rows = []
            for doc, ws, hs in zip(b.doc_id, lists, _shingle_hashes(lists, q)):
                rows += [(doc, int(hs[p]), *_around(ws, int(p), q, least)) for p in np.flatnonzero(_may_hold(hs, filled, bits))]
            yield pd.DataFrame(rows, columns=["doc_id", "h", "d_around", "d_left"])

    return seen.where("words is not null").select("doc_id", "words").mapInPandas(run, "doc_id long, h long, d_around array<string>, d_left int")


def _run_length(a: list[str], i: int, b: list[str], j: int, q: int) -> int:
    """Length of the run of equal words through the shingles at ``i`` and ``j``; 0 if they differ."""
    if list(a[i : i + q]) != list(b[j : j + q]):
        return 0
    lo = 0
    while lo < min(i, j) and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    hi = q
    while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
        hi += 1
    return lo + hi


def leaks(documents: DataFrame, items: DataFrame, q: int = SHINGLE, least: int = MIN_WORDS, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id) of every document and every item of which it holds at least ``least`` words in a row."""
    shingles = item_shingles(items, q, least)
    seen = cut(scan(documents, shingles, q, least, bits))  # written once: the texts are read once
    # as many rows as the items have shingles
    tokens = cut(prefix_tokens(shingles, shingle_counts(seen), q, least))
    pairs = _candidates(seen, tokens, q, least, bits).join(tokens, "h")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [_run_length(a, i, c, j, q) >= least for a, i, c, j in zip(b.d_around, b.d_left, b.around, b.left)]
            yield b.loc[ok, ["doc_id", "item_id"]].drop_duplicates()

    kept = pairs.select("doc_id", "item_id", "d_around", "d_left", "around", "left")
    return kept.mapInPandas(verify, "doc_id long, item_id long").distinct()


def leaks_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of each leak."""
    return leaks(documents, items)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, task, n_docs): the items that leaked."""
    per = leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return per.join(items.groupBy("item_id").agg(F.min("suite").alias("suite"), F.min("task").alias("task")), "item_id")
