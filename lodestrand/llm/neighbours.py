"""The k most similar vectors of every vector, by randomly rotated one-bit codes.

Method.

* Index. Vectors are grouped into lists of ``LIST_SIZE`` on average around centroids that are
  fitted on a bounded sample (``LIST_SAMPLE`` rows a list, between ``LEAST_SAMPLE`` and
  ``MOST_SAMPLE``, chosen by hash) in two levels: groups, as many as the root of the number of
  lists, and the lists of each group. Every vector is indexed; it is compared with the lists
  of its ``GROUPS`` nearest groups only. Each gets a code: it is
  multiplied by a seeded random matrix with orthonormal columns that spreads it over three
  times its dimensions, and the signs are packed into bits. The correction scalar is the
  inner product of the vector with its own code.
* Search. A vector visits the lists of its ``PROBES`` nearest centroids. There the share of
  equal bits and the two correction scalars estimate the inner product; the estimate's error
  bound is ``EPSILON`` standard deviations of that share. Only vectors whose upper bound
  reaches the k-th best exact value so far are reranked exactly (by one matrix product where
  they are many of a tile).
* The size of a list and the number of visits are the same at every size of the table, so
  work and shuffle grow with the number of vectors; centroids cost 256 bytes a list, and the
  bounded sample allows ``MOST_SAMPLE`` / 2 lists (0.8 billion vectors; beyond, lists grow). Lists
  larger than a block are split on both sides, so no task holds more than ``BLOCK`` vectors
  of either kind; each vector is shuffled once as data and once for each further list.

Equal vectors are one indexed vector with members, told apart by a hash of 128 bits; the
members are expanded at the end and at most the first k + 1 members of a group can be among
anyone's k nearest, so a group of copies costs a row per member.

Recall depends on the list size and the visits; ``recall_at_k`` measures it by brute force
for the rows whose hash is divisible by a given number.

Defined cases: null, all-zero, non-finite and differently wide vectors are left out;
repeated rows of one key and vector are one vector; ties go to the smaller key; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.tables import cut

WIDTH = 64
K = 10
LIST_SIZE = 6144  # vectors a list holds on average
PROBES = 5
GROUPS = 8  # groups of lists a vector is compared with
LIST_SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 16, 8192, 262_144  # rows the centroids are fitted on
SPREAD = 3  # bits of a code per dimension
DENSE = 64  # a tile of which more than one in so many pairs is reranked is multiplied out
BLOCK = 65_536
EPSILON = 2.2
SEED = 7


def rotation(width: int, bits: int | None = None, seed: int = SEED) -> np.ndarray:
    """A (width, bits) matrix with orthonormal rows: a random rotation of the padded space; ``bits`` is a multiple of 64."""
    bits = bits or -(-SPREAD * width // 64) * 64
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return np.ascontiguousarray(q[:width]).astype(np.float32)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (as 64-bit words) and correction scalars of unit vectors."""
    y = unit @ turn
    bits = y > 0
    fix = np.abs(y).sum(axis=1) / np.sqrt(turn.shape[1])  # inner product with its own code
    return np.packbits(bits, axis=1).view(np.uint64), fix.astype(np.float32)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        n = np.linalg.norm(total, axis=1)
        empty = n < 1e-9
        c = np.where(empty[:, None], sample[rng.choice(len(sample), lists)], total / np.where(empty, 1, n)[:, None])
    return c.astype(np.float32)


def keyed_vectors(event_vectors: DataFrame, vectors_index: DataFrame) -> DataFrame:
    """(key, embedding) of both tables."""
    a = event_vectors.where("event_id is not null and chunk_seq is not null").select(
        F.concat_ws("#", "event_id", F.col("chunk_seq").cast("string")).alias("key"), "embedding"
    )
    b = vectors_index.where("vec_rowid is not null").select(F.concat(F.lit("vec#"), F.col("vec_rowid").cast("string")).alias("key"), "embedding")
    return a.unionByName(b)


def _good(embeddings: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and matrix of the usable vectors."""
    rows = [i for i, e in enumerate(embeddings) if e is not None and len(e) == width]
    m = np.array([embeddings.iat[i] for i in rows], dtype=np.float32).reshape(len(rows), width)
    ok = np.isfinite(m).all(axis=1) & (np.abs(m).max(axis=1, initial=0) > 0)
    return np.array(rows, dtype=np.int64)[ok], m[ok]


def _unit(m: np.ndarray) -> np.ndarray:
    d = m.astype(np.float64)
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, vec): the raw float32 values as bytes, without unusable vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, m = _good(b.embedding, width)
            yield pd.DataFrame({"key": b.key.to_numpy()[rows], "vec": [x.tobytes() for x in m]})

    return vectors.where(F.size("embedding") == width).mapInPandas(run, "key string, vec binary")


class Index:
    """Centroids of groups and of their lists, and the code parameters; fit for a closure."""

    def __init__(self, groups: np.ndarray, centroids: np.ndarray, starts: np.ndarray, probes: int, width: int):
        self.groups, self.centroids, self.starts = groups, centroids, starts  # group g has the lists starts[g] to starts[g + 1]
        self.probes, self.width = min(probes, len(centroids)), width

    def visits(self, unit: np.ndarray) -> np.ndarray:
        """The nearest lists of each vector, its own first."""
        p, n = self.probes, len(unit)
        near = unit @ self.groups.T
        take = min(GROUPS, len(self.groups))
        some = np.argpartition(-near, take - 1, axis=1)[:, :take]
        best, which = np.full((n, take * p), -3, np.float32), np.zeros((n, take * p), np.int32)
        for j in range(take):
            order = np.argsort(some[:, j], kind="stable")
            cuts = np.searchsorted(some[order, j], np.arange(len(self.groups) + 1))
            for g in np.unique(some[:, j]):
                rows, lo, hi = order[cuts[g] : cuts[g + 1]], self.starts[g], self.starts[g + 1]
                s = unit[rows] @ self.centroids[lo:hi].T
                k = min(p, hi - lo)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best[rows, j * p : j * p + k] = np.take_along_axis(s, top, 1)
                which[rows, j * p : j * p + k] = top + lo
        order = np.argsort(-best, axis=1, kind="stable")[:, :p]
        return np.take_along_axis(which, order, 1)


def fit_lists(sample: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids of the groups, centroids of the lists, where each group's lists begin): lists by a group's share of the sample."""
    groups = fit_centroids(sample, int(np.ceil(np.sqrt(lists))))
    own = np.concatenate([(sample[a : a + 65_536] @ groups.T).argmax(axis=1) for a in range(0, len(sample), 65_536)])
    parts = [sample[own == g] if (own == g).any() else groups[g : g + 1] for g in range(len(groups))]
    some = [fit_centroids(m, max(1, round(lists * len(m) / len(sample)))) for m in parts]
    return groups, np.concatenate(some), np.concatenate([[0], np.cumsum([len(c) for c in some])])


def fit_index(vecs: DataFrame, width: int = WIDTH, lists: int | None = None, probes: int | None = None) -> Index:
    """The index fitted on a bounded sample of the distinct vectors."""
    n = vecs.count()
    lists = lists or max(1, min(n // LIST_SIZE, MOST_SAMPLE // 2))
    size = min(MOST_SAMPLE, max(LEAST_SAMPLE, LIST_SAMPLE * lists))
    # by hash of the values: the same rows whatever the partitioning; at most ``size`` rows reach the driver
    part = max(1, n // size)
    picked = vecs.where(F.pmod(F.xxhash64("vec", F.lit(SEED)), F.lit(part)) == 0).select("vec").limit(size).toPandas()
    m = np.frombuffer(b"".join(picked.vec), dtype=np.float32).reshape(-1, width) if len(picked) else np.zeros((0, width), np.float32)
    none = np.zeros((1, width), np.float32)
    return Index(*(fit_lists(_unit(m), lists) if len(m) else (none, none, np.array([0, 1]))), probes or PROBES, width)


_POINT = "id long, vec binary, visits array<int>"


def place(vecs: DataFrame, index: Index) -> DataFrame:
    """(id, vec, visits): the lists a vector visits, its own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) == 0:
                continue
            unit = _unit(np.frombuffer(b"".join(b.vec), dtype=np.float32).reshape(-1, index.width))
            yield pd.DataFrame({"id": b.id, "vec": b.vec, "visits": list(index.visits(unit))})

    return vecs.mapInPandas(run, _POINT)


def search_block(q: np.ndarray, d: np.ndarray, q_id: np.ndarray, d_id: np.ndarray, k: int, turn: np.ndarray, beat: np.ndarray | None = None, counts: dict | None = None):
    """The k best of ``d`` for each of ``q`` (raw float32), never itself: (query row, data row, cosine).

    ``beat``: cosines that a result must reach, where the k-th best of other vectors is known.
    """
    qu, du = _unit(q), _unit(d)
    (qc, qf), (dc, df) = encode(qu, turn), encode(du, turn)
    bits, nd, dt = turn.shape[1], len(d), np.ascontiguousarray(dc.T)
    out = []
    lead = min(nd, 512) if beat is None else 0
    for lo in range(0, len(q), 256):
        hi = min(len(q), lo + 256)
        have, floor = [], beat[lo:hi].astype(np.float32) if beat is not None else np.full(hi - lo, -1.0, np.float32)
        if lead:  # an exact start on the first rows gives the value to beat
            s = qu[lo:hi] @ du[:lead].T
            s[q_id[lo:hi, None] == d_id[None, :lead]] = -2
            kk = min(k, lead)
            best = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
            top = np.take_along_axis(s, best, 1)
            have.append((np.repeat(np.arange(hi - lo), kk), best.ravel(), top.ravel()))
            floor = top.min(axis=1) if kk == k else floor
        for a in range(lead, nd, 1024):
            z = min(nd, a + 1024)
            diff = np.zeros((hi - lo, z - a), dtype=np.uint8 if bits < 256 else np.uint16)
            for w in range(qc.shape[1]):
                diff += np.bitwise_count(qc[lo:hi, w, None] ^ dt[w, None, a:z])
            # share of equal less unequal bits = corrections * asin(inner product), within the slack
            angle = np.arcsin(np.clip(floor, -1, 1))
            p = np.clip(0.5 - angle / np.pi, 1e-3, 0.5)
            slack = 2 * EPSILON * np.sqrt(p * (1 - p) / bits)
            fix = float(df[a:z].max()) if len(df[a:z]) else 1.0
            need = np.where(angle > 0, angle * qf[lo:hi] * fix, angle) - slack
            limit = np.clip(np.floor(bits * (1 - need) / 2), 0, bits).astype(diff.dtype)
            near = diff <= limit[:, None]
            many = np.count_nonzero(near) * DENSE > near.size
            tile = qu[lo:hi] @ du[a:z].T if many else None
            qi, di = np.nonzero(near & (tile >= floor[:, None]) if many else near)
            # once more with each vector's own correction
            est = (1 - 2 * diff[qi, di].astype(np.float32) / bits + slack[qi]) / (qf[lo:hi][qi] * df[a:z][di])
            keep = est >= angle[qi]
            qi, di = qi[keep], di[keep] + a
            if counts is not None:
                counts["seen"] = counts.get("seen", 0) + diff.size
                counts["reranked"] = counts.get("reranked", 0) + len(qi)
            exact = tile[qi, di - a] if many else np.einsum("ij,ij->i", qu[lo:hi][qi], du[di])
            exact[q_id[lo:hi][qi] == d_id[di]] = -2
            win = exact >= floor[qi]
            have.append((qi[win], di[win], exact[win]))
            if z < nd:
                have, floor = _top([np.concatenate(x) for x in zip(*have)], hi - lo, k, floor)
        if have:
            (qi, di, s) = _top([np.concatenate(x) for x in zip(*have)], hi - lo, k, floor)[0][0]
            ok = s > -2
            out.append((qi[ok] + lo, di[ok], s[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*out))


def _top(have, n, k, beat):
    """The k best of each query row, and the values to beat from now on."""
    qi, di, s = have
    order = np.lexsort((di, -s, qi))
    qi, di, s = qi[order], di[order], s[order]
    first = np.searchsorted(qi, np.arange(n))
    rank = np.arange(len(qi)) - first[qi]
    keep = rank < k
    qi, di, s, rank = qi[keep], di[keep], s[keep], rank[keep]
    beat = beat.copy()
    last = rank == k - 1
    beat[qi[last]] = np.maximum(beat[qi[last]], s[last])
    return [(qi, di, s)], beat


def _exact(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    a, b = q.astype(np.float64), d.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, width)


def _lists(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """The values (sorted by row) as one list per row."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


_OWN = "id long, vec binary, visits array<int>, beat double, cosines array<double>, others array<long>"
_FOUND = "id long, cosines array<double>, others array<long>"


def knn_join(vecs: DataFrame, width: int = WIDTH, k: int = K, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """(id, near): the k nearest of each distinct vector, best first. ``vecs``: (id, vec), ids unique.

    A vector's own list is searched first; its k-th best cosine there is what vectors of the
    other lists must beat, so those estimates discard nearly all and little is sent on. Fitting,
    counting and both searches read ``vecs``: it should be written already.
    """
    index = fit_index(vecs, width, lists, probes)
    placed = place(vecs, index)
    n_lists, turn = len(index.centroids), rotation(width)
    # (list, data, queries, nd, nq): one row a list; into how many blocks its vectors and its visitors are cut
    seen = placed.select(F.posexplode("visits").alias("rank", "list")).groupBy("list")
    sizes = seen.agg(F.sum((F.col("rank") == 0).cast("long")).alias("data"), F.sum((F.col("rank") > 0).cast("long")).alias("queries"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    sizes = cut(sizes.select("list", "data", "queries", blocks("data").alias("nd"), blocks("queries").alias("nq")))
    cuts = F.broadcast(sizes.select("list", "nd", "nq"))
    nd, nq = F.col("nd"), F.col("nq")
    h = F.xxhash64("id", F.lit(SEED))

    # --- a vector's own list: every block against every block
    own = placed.select("id", "vec", "visits", F.element_at("visits", 1).alias("list")).join(cuts, "list")
    as_query = own.select("id", "vec", "visits", "list", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), nd - 1)).alias("db"), F.pmod(h, nd).cast("int").alias("qb"))
    as_data = own.select("id", "vec", F.lit(None).cast("array<int>").alias("visits"), "list", F.lit(False).alias("asks"), F.pmod(h, nd).cast("int").alias("db"), F.explode(F.sequence(F.lit(0), nd - 1)).alias("qb"))
    # within the diagonal blocks the queries are the data: sent once
    units = as_query.unionByName(as_data.where("db <> qb"))

    def search_own(t: pa.Table) -> pa.Table:
        m, ids = _matrix(t["vec"], width), t["id"].to_numpy()
        asks = t["asks"].to_numpy()
        diagonal = t["db"][0].as_py() == t["qb"][0].as_py()
        qs, ds = np.flatnonzero(asks), np.arange(len(ids)) if diagonal else np.flatnonzero(~asks)
        qi, di, _ = search_block(m[qs], m[ds], ids[qs], ids[ds], k, turn)
        cos = _exact(m[qs][qi], m[ds][di])
        full = np.bincount(qi, minlength=len(qs)) >= k
        beat = np.full(len(qs), 2.0)
        np.minimum.at(beat, qi, cos)
        first = t["db"][0].as_py() == 0  # one block of a vector's list sends it on its visits
        q = t.filter(t["asks"])
        return pa.table(
            {
                "id": q["id"],
                "vec": q["vec"] if first else pa.nulls(len(qs), pa.binary()),
                "visits": q["visits"] if first else pa.nulls(len(qs), pa.list_(pa.int32())),
                "beat": np.where(full, beat, -1.0),
                "cosines": _lists(qi, cos, len(qs), pa.float64()),
                "others": _lists(qi, ids[ds][di], len(qs), pa.int64()),
            }
        )

    found = units.groupBy("list", "db", "qb").applyInArrow(search_own, _OWN)
    if index.probes > 1:
        # --- the other lists; the first visit (or a row without list, from further blocks) carries what the own list gave
        at = F.posexplode_outer(F.slice("visits", 2, index.probes)).alias("nth", "list")
        some = found.select("id", "vec", "beat", "cosines", "others", at)
        carried = F.coalesce(F.col("nth"), F.lit(0)) == 0
        goes = some.select(
            "id", "vec", "beat", F.coalesce("list", -1 - F.pmod(h, F.lit(n_lists)).cast("int")).alias("list"),
            F.when(carried, F.col("cosines")).alias("cosines"), F.when(carried, F.col("others")).alias("others"),
        )
        goes = goes.join(cuts, "list", "left").withColumn("nd", F.coalesce(nd, F.lit(1))).withColumn("nq", F.coalesce(nq, F.lit(1)))
        goes = goes.select("id", "vec", "beat", "list", "cosines", "others", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("db"), F.pmod(h, F.col("nq")).cast("int").alias("qb"))
        goes = goes.withColumn("cosines", F.when(F.col("db") == 0, F.col("cosines"))).withColumn("others", F.when(F.col("db") == 0, F.col("others")))
        # lists of one block each are the ones just searched: the same shuffle serves again
        single = (sizes.agg(F.max(F.greatest("data", "queries"))).first()[0] or 0) <= BLOCK
        stays = units if single else own.select("id", "vec", "list", F.pmod(h, nd).cast("int").alias("db"), F.explode(F.sequence(F.lit(0), nq - 1)).alias("qb"))

        def search_visits(q: pa.Table, d: pa.Table) -> pa.Table:
            with_vec = q["vec"].is_valid().to_numpy()
            carry = pa.table({"id": q["id"], "cosines": q["cosines"], "others": q["others"]}).filter(q["others"].is_valid())
            if not len(d) or not with_vec.any():
                return carry
            q = q.filter(q["vec"].is_valid())
            mq, md, qid, did = _matrix(q["vec"], width), _matrix(d["vec"], width), q["id"].to_numpy(), d["id"].to_numpy()
            qi, di, _ = search_block(mq, md, qid, did, k, turn, q["beat"].to_numpy())
            rows = np.unique(qi)
            at_row = np.searchsorted(rows, qi)
            new = pa.table({"id": qid[rows], "cosines": _lists(at_row, _exact(mq[qi], md[di]), len(rows), pa.float64()), "others": _lists(at_row, did[di], len(rows), pa.int64())})
            return pa.concat_tables([carry, new.cast(carry.schema)])

        keys = ["list", "db", "qb"]
        found = goes.groupBy(*keys).cogroup(stays.groupBy(*keys)).applyInArrow(search_visits, _FOUND)
    # at most one row of k neighbours a visit and block meets for one id
    zipped = F.flatten(F.collect_list(F.arrays_zip(F.col("cosines").alias("cosine"), F.col("others").alias("id"))))
    best = F.slice(F.sort_array(zipped, asc=False), 1, k)
    return found.select("id", "cosines", "others").groupBy("id").agg(best.alias("near"))


def _named(vec: str = "vec") -> list[F.Column]:
    """A hash of 128 bits in two columns; two different vectors don't share it (chance of 10^-17 at 10^11 vectors)."""
    return [F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(SEED), vec).alias("h2")]


def distinct_vectors(keyed: DataFrame) -> DataFrame:
    """(id, vec, h1, h2): equal vectors once, numbered and written to the shared folder, so that a number stays the same."""
    return cut(keyed.select("vec").distinct().select(F.monotonically_increasing_id().alias("id"), "vec", *_named()))


def members(keyed: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, key) of every key, repeated rows once."""
    return keyed.select(*_named(), "key").distinct().join(distinct.select("id", "h1", "h2"), ["h1", "h2"]).select("id", "key")


def heads(member: DataFrame, k: int = K) -> DataFrame:
    """(id, keys): the first k + 1 keys of each group; a map task sends k + 1 keys of a group at most."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("key"))
    return member.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def nearest(event_vectors: DataFrame, vectors_index: DataFrame, k: int = K, width: int = WIDTH, **index) -> tuple[DataFrame, DataFrame]:
    """(id, near) of the distinct vectors and (id, key) of their members."""
    keyed = usable(keyed_vectors(event_vectors, vectors_index), width)
    distinct = distinct_vectors(keyed)
    return knn_join(distinct.select("id", "vec"), width, k, **index), members(keyed, distinct)


def key_lists(near: DataFrame, member: DataFrame, least: float | None = None, k: int = K) -> DataFrame:
    """(x, of): for every key its k nearest other keys as (d, key) with d the negated cosine, copies included; with ``least`` only those of that cosine.

    A group of m equal vectors gives its members' first k others: m * k rows at most.
    """
    groups = heads(member, k)
    copies = groups.where(F.size("keys") > 1).select("id", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    close = near.select("id", F.explode("near").alias("n"))
    if least is not None:
        close = close.where(F.col("n.cosine") >= least)
    hits = close.select("id", F.col("n.id").alias("other"), F.col("n.cosine").alias("cosine")).unionByName(copies)
    hits = hits.join(groups.withColumnRenamed("id", "other"), "other").select("id", F.explode("keys").alias("other_key"), "cosine")
    # at most k + 1 groups of k + 1 keys for one id
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col("other_key").alias("key"))))
    lists = hits.groupBy("id").agg(F.slice(ranked, 1, k + 1).alias("of"))
    return member.join(lists, "id").select(F.col("key").alias("x"), F.slice(F.filter("of", lambda o: o["key"] != F.col("key")), 1, k).alias("of"))


def similar_pairs(near: DataFrame, member: DataFrame, least: float = 0.9, k: int = K) -> DataFrame:
    """(key_a, key_b, cosine): pairs of keys of at least ``least`` of which one is among the other's k nearest."""
    pairs = key_lists(near, member, least, k).select("x", F.explode("of").alias("o"))
    return (
        pairs.groupBy(F.least("x", "o.key").alias("key_a"), F.greatest("x", "o.key").alias("key_b"))
        .agg(F.max(-F.col("o.d")).alias("cosine"))
    )


def neighbours_found(event_vectors: DataFrame, vectors_index: DataFrame) -> DataFrame:
    """(key_a, key_b) of each pair of cosine >= 0.90 of which one is among the other's 10 nearest."""
    near, member = nearest(event_vectors, vectors_index)
    return similar_pairs(near, member).select("key_a", "key_b")


def neighbour_lists(event_vectors: DataFrame, vectors_index: DataFrame, **index) -> DataFrame:
    """(key, rank, near_key, cosine): the 10 nearest of every key; copies of its vector are among them, equal cosines go by key."""
    lists = key_lists(*nearest(event_vectors, vectors_index, **index)).select(F.col("x").alias("key"), F.posexplode("of").alias("rank", "o"))
    return lists.select("key", (F.col("rank") + 1).alias("rank"), F.col("o.key").alias("near_key"), (-F.col("o.d")).alias("cosine"))


def recall_at_k(vecs: DataFrame, near: DataFrame, k: int = K, width: int = WIDTH, every: int = 100) -> float:
    """Share of the true k nearest that ``near`` holds, for the ids whose hash is divisible by ``every``.

    The stated query set goes against all rows in blocks; its size is bounded by the caller's choice of ``every``.
    """
    asked = vecs.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).toPandas()
    if not len(asked):
        return 1.0
    q = _unit(np.frombuffer(b"".join(asked.vec), dtype=np.float32).reshape(-1, width))
    q_id = asked.id.to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = q @ _unit(np.frombuffer(b"".join(b.vec), dtype=np.float32).reshape(-1, width)).T
            ids = b.id.to_numpy()
            s[q_id[:, None] == ids[None, :]] = -2
            kk = min(k, s.shape[1])
            top = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
            yield pd.DataFrame({"id": np.repeat(q_id, kk), "other": ids[top.ravel()], "s": np.take_along_axis(s, top, 1).ravel().astype(float)})

    w = Window.partitionBy("id").orderBy(F.desc("s"), "other")
    true = vecs.mapInPandas(run, "id long, other long, s double").where("s > -2").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    got = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("other"), F.lit(1).alias("hit"))
    row = true.join(got, ["id", "other"], "left").agg(F.count("*"), F.count("hit")).first()
    return row[1] / row[0] if row[0] else 1.0
