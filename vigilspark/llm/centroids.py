"""Operator 11: centroid clustering by Lloyd's rounds over distinct quantised vectors.

Each component x becomes the integer floor(scale * x).  Equal quantised vectors
are one row with a multiplicity, found by one aggregation, and only those rows are
read again: a round is a narrow pass that assigns each to its nearest centroid and
sums its components times its multiplicity, so a task sends one row for each
centroid.  Assignments are joined back to the vectors at the end.  All arithmetic
is on integers: single tasks take the fastest kind of number that holds every
intermediate value exactly, and sums travel in digits of 40 bits, which no number
of tasks can overflow.

The driver holds the centroids: k vectors and k sums.

Cases.  Vectors that are null, of another length or with null or non-finite
components are left out.  Ties go to the centroid of the smaller number; an empty
centroid stays where it is.  Seeds are the vectors of the least hashes of their
ids, equal hashes (repeated ids) in the order of their bytes, null ids last; with
fewer vectors than k there are fewer centroids.  A distance, or a sum of them, above 2^63-1
is null.  Repeated rows are rows of their own.  Other columns pass through; those
named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import textkit
from vigilspark.llm.store import discard, settle

DIGIT = 40  # bits
MOST = (1 << 63) - 1
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of an integer matrix as bytes, the narrowest width that holds the row first; rows are equal as their bytes are."""
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), bool)
    for width in (2, 4, 8):
        most = 1 << (8 * width - 1)
        fits = left & ((x >= -most) & (x < most)).all(1)
        at = np.flatnonzero(fits)
        wide = np.empty((len(at), 1 + width * x.shape[1]), np.uint8)
        wide[:, 0] = width
        wide[:, 1:] = np.ascontiguousarray(x[at].astype(f"<i{width}")).view(np.uint8)
        for i, row in zip(at, wide):
            out[i] = row.tobytes()
        left &= ~fits
    for i in np.flatnonzero(left):
        out[i] = b"\0" + ",".join(str(int(v)) for v in x[i]).encode()
    return out


def unpack(keys: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their integer matrix, one for each width."""
    bounds = np.frombuffer(keys.buffers()[1], np.int64 if pa.types.is_large_binary(keys.type) else np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    data = np.frombuffer(keys.buffers()[2], np.uint8)
    width = data[bounds[:-1]]
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            size = int(bounds[rows[0] + 1] - bounds[rows[0]]) - 1
            yield rows, np.ascontiguousarray(data[bounds[rows][:, None] + 1 + np.arange(size)]).view(f"<i{w}").astype(np.int64)
        else:
            yield rows, np.array([[int(v) for v in data[bounds[i] + 1 : bounds[i + 1]].tobytes().split(b",")] for i in rows], object)


def _most(x: np.ndarray) -> int:
    return int(max(abs(x.max()), abs(x.min()))) if x.size else 0


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the nearest centroid (the first of equals) and the squared distance to it."""
    reach = x.shape[1] * (_most(x) + _most(centroids)) ** 2
    if reach < 1 << 51:  # twice the largest product and all partial sums are exact in doubles
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        far = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
        best = far.argmin(1)
        return best, far[np.arange(len(best)), best].astype(np.int64)
    kind = np.int64 if reach <= MOST else object
    a, c = x.astype(kind), centroids.astype(kind)
    best, least = np.empty(len(a), np.int64), np.empty(len(a), kind)
    for first in range(0, len(a), 256):
        far = ((a[first : first + 256, None, :] - c[None]) ** 2).sum(-1)
        best[first : first + 256] = at = far.argmin(1)
        least[first : first + 256] = far[np.arange(len(at)), at]
    return best, least


def summed(x: np.ndarray, n: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Exact sums of the rows times n, for each cluster."""
    total = int(n.sum())
    kind = np.int64 if x.dtype != object and _most(x) * total <= MOST else object
    order = np.argsort(cluster, kind="stable")
    present, first = np.unique(cluster[order], return_index=True)
    out = np.zeros((k, x.shape[1]), object)
    out[present] = np.add.reduceat((x.astype(kind) * n.astype(kind)[:, None])[order], first, axis=0).astype(object)
    return out


def digits(sums: np.ndarray) -> Iterator[np.ndarray]:
    """Digits of 40 bits of exact sums, the lowest first, with the sums' signs."""
    sign, rest = np.where(sums < 0, -1, 1).astype(object), abs(sums)
    first = True
    while first or rest.any():
        yield (sign * (rest & ((1 << DIGIT) - 1))).astype(np.int64)
        rest, first = rest >> DIGIT, False


def _quantise(scale: int, columns: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = part.column(part.schema.get_field_index("vector_in"))
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
                if scale * np.abs(x).max() < 2.0**62:
                    whole = np.floor(scale * x).astype(np.int64)
                else:  # from 2^53 on a double is a whole number
                    whole = np.array([[int(c) * scale if abs(c) >= 2.0**53 else math.floor(scale * c) for c in row] for row in x.tolist()], object)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in columns], pa.array(pack(whole), pa.binary())], names=[*columns, "key"])

    return run


def _sum_by_centroid(centroids: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, counts, sums = len(centroids), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, object)
        for batch in it:
            n_all = batch.column("n").to_numpy()
            for rows, x in unpack(batch.column("key")) if batch.num_rows else ():
                cluster, n = nearest(x, centroids)[0], n_all[rows]
                np.add.at(counts, cluster, n)
                sums += summed(x, n, cluster, k)
        live = np.flatnonzero(counts)
        if len(live):
            for place, digit in enumerate(digits(sums[live])):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(live, pa.int32()), pa.array(np.full(len(live), place), pa.int32()), pa.array(counts[live] if not place else np.zeros(len(live), np.int64)), pa.ListArray.from_arrays(np.arange(len(live) + 1, dtype=np.int32) * digit.shape[1], pa.array(digit.ravel()))],
                    names=["cluster", "place", "n", "s"],
                )

    return run


def _assign(centroids: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.empty(batch.num_rows, object)
            for rows, x in unpack(batch.column("key")) if batch.num_rows else ():
                cluster[rows], far = nearest(x, centroids)
                distance[rows] = [d if d <= MOST else None for d in far.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())], names=[*batch.schema.names, "cluster", "distance"])

    return run


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's mean after one round over (key, n), rounded down; empty ones stay."""
    width = centroids.shape[1]
    sent = distinct.mapInArrow(_sum_by_centroid(centroids), "cluster int, place int, n long, s array<long>")
    out, sums, counts = centroids.astype(object), np.zeros(centroids.shape, object), [0] * len(centroids)
    # One row for each centroid and digit.
    for r in sent.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).collect():
        counts[r.cluster] += r.n
        sums[r.cluster] += np.array([v << DIGIT * r.place for v in r.s], object)
    for i, n in enumerate(counts):
        if n:
            out[i] = sums[i] // n
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if _most(x) < 1 << 62 else x


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """The vectors of dims finite components (without the vector itself) with cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = vectors.sparkSession
    names = [c for c in vectors.columns if c == vec_id or c not in (*ADDED, vector)]
    rows = textkit.numbered(vectors.select(*names, vector))
    columns = [f"in{i}" for i in range(len(names))]
    v = F.col(f"in{len(names)}")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.filter(v.isNotNull() & (F.size(v) == dims) & finite).select(*columns, v.alias("vector_in"))
    schema = good.select(*columns, F.lit(b"").alias("key")).schema
    held = settle(good.mapInArrow(_quantise(scale, columns), schema), "quantised")
    distinct = settle(held.groupBy("key").agg(F.count("*").alias("n")), "distinct")
    own: Column = F.col(f"in{names.index(vec_id)}")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), own.cast("string")), 256)
    seeds = [r.key for r in held.select(hashed.alias("h"), "key").orderBy(F.asc_nulls_last("h"), "key").limit(k).collect()]
    at = _narrow(np.concatenate([x.astype(object) for s in seeds for _, x in unpack(pa.array([bytes(s)], pa.binary()))])) if seeds else np.zeros((0, dims), np.int64)
    for _ in range(rounds if seeds else 0):
        before, at = at, _narrow(moved(distinct, at))
        if (before == at).all():
            break
    assigned = settle(distinct.mapInArrow(_assign(at), "key binary, n long, cluster int, distance long"), "assigned")
    spread = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.sum((F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).cast("decimal(38,0)")).alias("d"), F.bool_or(F.col("distance").isNull()).alias("far"), F.sum("n").alias("n")).collect()}
    within = {c: None if r.far or r.d > MOST else int(r.d) for c, r in spread.items()}
    whole = None if any(d is None for d in within.values()) or sum(within.values()) > MOST else sum(within.values())
    told = spark.createDataFrame([(c, d, whole, hashlib.sha256(",".join(str(int(x)) for x in at[c]).encode()).hexdigest()) for c, d in sorted(within.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    named = textkit.meet(held, assigned, "key", "n", sum(r.n for r in spread.values())).join(F.broadcast(told), "cluster")  # k rows at most
    discard(distinct)
    return named.select(*textkit.restored(names), *ADDED)
