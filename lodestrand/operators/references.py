"""References to records that do not exist, are deleted or arrive later.

Method. The distinct (key, reference field, day) triples are pre-aggregated map-side,
so a hub costs a row per field and day however often it is referred to. Keys are spread
over ranges of bounded size by their hash; each range is one group, in which

1. a dictionary encodes its keys as integers,
2. per field and day the referenced codes, and per day the codes of good parents (live
   and there before the day began, or a code entity) become compressed bitmaps,
3. ``reference AND-NOT parent`` leaves the suspicious bits, which are decoded to keys.

The survivors, with their parent's facts, are joined to the references for an exact
check against the time of each record. Everything a bitmap clears is provably good.

Defined cases: null and '' are no references; a reference without a time is never late;
a parent without a time is never late; repeated rows give one row; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE_KEYS = 32_768  # keys aimed at per range: one container of a bitmap
DAY = 86_400
_NO_DAY = 2**31 - 1  # a reference without a time is checked against all parents

#: table -> (reference fields, record key, time of the record)
REFERENCES = {
    "graph_edges": (("source", "target"), lambda: F.concat_ws("|", "source", "target", "relation"), "created_at"),
    "event_vectors": (("event_id",), lambda: F.concat_ws("#", "event_id", F.col("chunk_seq").cast("string")), "embedded_at"),
    "chunks": (("source_event_id",), lambda: F.col("chunk_id"), "created_at"),
}


class Bitmap:
    """A compressed set of integers: per 65,536 a sorted array, or a bit field when dense."""

    DENSE = 4096

    def __init__(self, codes: np.ndarray):
        self.parts: dict[int, np.ndarray] = {}
        codes = np.unique(np.asarray(codes, dtype=np.int64))
        for high in np.unique(codes >> 16):
            low = (codes[codes >> 16 == high] & 0xFFFF).astype(np.uint16)
            self.parts[int(high)] = self._pack(low)

    @classmethod
    def _pack(cls, low: np.ndarray) -> np.ndarray:
        if len(low) <= cls.DENSE:
            return low
        bits = np.zeros(65_536, dtype=bool)
        bits[low] = True
        return np.packbits(bits)

    @staticmethod
    def _bits(part: np.ndarray) -> np.ndarray:
        if part.dtype == np.uint8:
            return part
        bits = np.zeros(65_536, dtype=bool)
        bits[part] = True
        return np.packbits(bits)

    def and_not(self, other: Bitmap) -> Bitmap:
        out = Bitmap(np.zeros(0, dtype=np.int64))
        for high, mine in self.parts.items():
            theirs = other.parts.get(high)
            if theirs is None:
                out.parts[high] = mine
            elif mine.dtype == np.uint8:
                left = np.flatnonzero(np.unpackbits(mine & ~self._bits(theirs))).astype(np.uint16)
                if len(left):
                    out.parts[high] = self._pack(left)
            else:
                if theirs.dtype == np.uint8:
                    gone = (theirs[mine >> 3] >> (7 - (mine & 7))) & 1 == 1
                else:
                    gone = np.isin(mine, theirs, assume_unique=True)
                if not gone.all():
                    out.parts[high] = mine[~gone]
        return out

    def decode(self) -> np.ndarray:
        some = [
            (high << 16) + (np.flatnonzero(np.unpackbits(p)) if p.dtype == np.uint8 else p.astype(np.int64))
            for high, p in sorted(self.parts.items())
        ]
        return np.concatenate(some) if some else np.zeros(0, dtype=np.int64)

    @property
    def nbytes(self) -> int:
        return sum(p.nbytes for p in self.parts.values())


def parents(event_index: DataFrame, code_entities: DataFrame) -> DataFrame:
    """One row per known id: (key, is_code, deleted, first_seen)."""
    latest = F.max(F.struct("updated_at", "status"))  # null sorts least
    events = (
        event_index.where("id is not null and id <> ''")
        .groupBy(F.col("id").alias("key"))
        .agg(latest["status"].alias("status"), F.min("mtime").alias("first_seen"))
        .select("key", F.lit(False).alias("is_code"), (F.coalesce("status", F.lit("")) == "deleted").alias("deleted"), "first_seen")
    )
    code = (
        code_entities.where("id is not null and id <> ''")
        .select(F.col("id").alias("key"))
        .distinct()
        .select("key", F.lit(True).alias("is_code"), F.lit(False).alias("deleted"), F.lit(None).cast("double").alias("first_seen"))
    )
    return events.unionByName(code)


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """Every reference as (ref_table, ref_field, key, record_key, at, day)."""
    out = None
    for name, (fields, record_key, time) in REFERENCES.items():
        one = tables[name].select(
            F.lit(name).alias("ref_table"),
            F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("key")) for f in fields])).alias("r"),
            record_key().alias("record_key"),
            F.col(time).alias("at"),
        )
        one = one.select("ref_table", "r.ref_field", "r.key", "record_key", "at").where("key is not null and key <> ''")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("day", F.coalesce(F.floor(F.col("at") / DAY).cast("int"), F.lit(_NO_DAY)))


_SURVIVOR = "ref_table string, ref_field string, day int, key string, known boolean, deleted boolean, first_seen double"


def _and_not(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, code = np.unique(pdf.key.to_numpy(dtype=object).astype(str), return_inverse=True)
    n = len(keys)
    is_ref = pdf.ref_table.notna().to_numpy()
    par = ~is_ref
    known, deleted, good = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    seen = np.full(n, -np.inf)
    event = par & ~(pdf.is_code == True).to_numpy(dtype=bool)  # noqa: E712 - null is no
    known[code[event]] = True
    deleted[code[event]] = (pdf.deleted == True).to_numpy(dtype=bool)[event]  # noqa: E712
    seen[code[event]] = pdf.first_seen.fillna(-np.inf).to_numpy(dtype=float)[event]
    good[code[par & ~event]] = True  # code entities
    rows = []
    refs = pdf[is_ref].assign(code=code[is_ref])
    for day, of_day in refs.groupby("day", sort=True):
        there = good | (known & ~deleted & (seen <= day * float(DAY)))
        parent = Bitmap(np.flatnonzero(there))
        for (table, field), one in of_day.groupby(["ref_table", "ref_field"], sort=False):
            for c in Bitmap(one.code.to_numpy()).and_not(parent).decode():
                rows.append((table, field, day, keys[c], bool(known[c]), bool(deleted[c]), None if np.isinf(seen[c]) else float(seen[c])))
    return pd.DataFrame(rows, columns=["ref_table", "ref_field", "day", "key", "known", "deleted", "first_seen"])


def suspicious(refs: DataFrame, known: DataFrame, ranges: int) -> DataFrame:
    """Reference AND-NOT parent, per key range, field and day: keys that may be bad, with their parent's facts.

    ``ranges``: so many that a range gets about ``RANGE_KEYS`` keys; the rows bound the keys.
    """
    asked = refs.groupBy("ref_table", "ref_field", "day", "key").count().drop("count")
    both = asked.select(
        "key", "ref_table", "ref_field", "day",
        F.lit(None).cast("boolean").alias("is_code"), F.lit(None).cast("boolean").alias("deleted"), F.lit(None).cast("double").alias("first_seen"),
    ).unionByName(known, allowMissingColumns=True)
    return both.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges))).groupBy("range").applyInPandas(_and_not, _SURVIVOR)


def bad_references(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per bad reference: (ref_table, ref_field, record_key, state, day); day is null without a time."""
    refs = references(tables)
    # row counts come from the files' footers
    rows = sum(tables[t].count() * len(fields) for t, (fields, _, _) in REFERENCES.items()) + tables["event_index"].count() + tables["code_entities"].count()
    left = suspicious(refs, parents(tables["event_index"], tables["code_entities"]), rows // RANGE_KEYS + 1)
    joined = refs.join(left, ["ref_table", "ref_field", "day", "key"])
    state = (
        F.when(~F.col("known"), "missing")
        .when(F.col("deleted"), "deleted")
        .when(F.col("first_seen") > F.col("at"), "late")
    )
    return (
        joined.select("ref_table", "ref_field", "record_key", state.alias("state"), F.when(F.col("day") < _NO_DAY, F.date_from_unix_date("day")).alias("day"))
        .where("state is not null")
        .distinct()
    )


def references_found(tables: dict[str, DataFrame]) -> DataFrame:
    """(ref_table, ref_field, record_key, state) of each bad reference."""
    return bad_references(tables).select("ref_table", "ref_field", "record_key", "state").distinct()


def bad_reference_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(ref_table, ref_field, day, state, n): bad references per table, field and day."""
    return bad_references(tables).groupBy("ref_table", "ref_field", "day", "state").agg(F.count("*").alias("n"))
