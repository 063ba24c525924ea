"""Cosine search of a stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 4096, 65_536  # vectors of either side that meet in one task


def similar_to(queries: DataFrame, vectors: DataFrame, least: float, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score): rows of cosine >= ``least`` to a query, itself left out; null, zero and odd vectors skipped.

    Both sides are cut into blocks by hash; every block of queries meets every block of rows in
    a task of its own, as one matrix product. Nothing reaches the driver but the two counts.
    """
    kind = queries.schema[id_col].dataType.simpleString()
    pick = lambda df: df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    q, r = pick(queries), pick(vectors)
    nq, nr = max(1, -(-q.count() // (QUERY_BLOCK // 2))), max(1, -(-r.count() // (ROW_BLOCK // 2)))  # hashing is uneven
    h = F.xxhash64("id")
    q = q.withColumn("qb", F.pmod(h, F.lit(nq))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).withColumn("rb", F.col("rb").cast("long"))
    r = r.withColumn("rb", F.pmod(h, F.lit(nr))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("qb", F.col("qb").cast("long"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"query_id": a["id"].slice(0, 0), "id": b["id"].slice(0, 0), "score": pa.array([], pa.float64())}
        parts = []
        for width, (qi, qm) in _by_width(a).items():
            ri, rm = _by_width(b).get(width, (None, None))
            if ri is None:
                continue
            score = qm @ rm.T
            i, j = np.nonzero(score >= least)
            left, right = a["id"].take(pa.array(qi[i])), b["id"].take(pa.array(ri[j]))
            keep = pa.array(np.array([x != y for x, y in zip(left.to_pylist(), right.to_pylist())], dtype=bool))
            parts.append(pa.table({"query_id": left, "id": right, "score": score[i, j]}).filter(keep))
        return pa.concat_tables(parts) if parts else pa.table(out)

    both = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb"))
    return both.applyInArrow(meet, f"query_id {kind}, id {kind}, score double")


def _by_width(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of each width; zero vectors and such with nulls are left out."""
    rows: dict[int, list] = {}
    for n, v in enumerate(t["v"].to_pylist()):
        if None not in v:
            rows.setdefault(len(v), []).append((n, v))
    out = {}
    for width, some in rows.items():
        m = np.array([v for _, v in some], dtype=np.float64)
        norm = np.linalg.norm(m, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        out[width] = (np.array([n for n, _ in some])[ok], m[ok] / norm[ok, None])
    return out


def hash_vector(words, width: int = 64) -> F.Column:
    """Feature-hashed term counts of an array of words: a stand-in where no embedding model is at hand."""
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int")
    slots = F.transform(words, slot)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))
