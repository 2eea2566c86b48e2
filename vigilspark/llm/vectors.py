"""Operator 9: embedding near-duplicates by an exact metric range join.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2-2t).
Pivots partition the vectors: each is at home in the cell of its nearest pivot.
If y, within r of x, is at home in cell j, then x is no further than r from the
plane that halves the way between its own pivot and pivot j (the triangle
inequality applied to the two cells), so x visits exactly the cells for which
this holds.  All links of a vector are then found in its home cell, and cells
join independently: homes against homes and visitors, in blocks.

A cell of many homes is dealt as several blocks of homes, which all its members
visit.  A block streams its members past its homes, so it holds BLOCK vectors and
a batch.  It counts the links of its homes and passes on a spanning forest of
them, not the pairs.  Distances are screened in single precision with a margin
that covers its error and confirmed in double precision.

Vectors of a length have cells of their own.  Lengths of more than CELL vectors
have pivots, those of the least hashes, MAX_PIVOTS in all, which bounds what is
broadcast; each other length is one cell.

Cases.  Null, empty or zero vectors and those with null or non-finite components
link with nothing, and vectors of different lengths not with each other.  Rows that
agree in everything are rows of their own and link with each other.  A null id
takes part but names no component while another does.  Other columns pass
through; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import textkit
from vigilspark.llm.components import components
from vigilspark.llm.store import discard, settle

CELL = 4096
BLOCK = 2048
MAX_PIVOTS = 1024
MARGIN = 1e-4
ADDED = ("n_links", "component_id", "kept")


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes as a-b, one less than nodes for each part."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _cells(pivots: dict[int, np.ndarray], radius: float):
    apart = {d: np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(-1), 0)) for d, p in pivots.items()}

    def of_length(batch: pa.RecordBatch, d: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        if d not in pivots:
            return batch, np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
        near = _unit(batch.column("v")) @ pivots[d].T
        home = near.argmax(1)
        gap = near[np.arange(len(home)), home][:, None] - near
        visits = gap <= radius * apart[d][home] + 1e-9
        visits[np.arange(len(home)), home] = True
        row, cell = np.nonzero(visits)
        return batch.take(pa.array(row)), cell, home[row] == cell

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                length = batch.column("d").to_numpy()
                for d in np.unique(length).tolist():
                    part, cell, home = of_length(batch.filter(pa.array(length == d)), d)
                    yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(cell, pa.int64()), pa.array(home, pa.bool_()), part.column("rid"), part.column("v")], names=["d", "cell", "home", "rid", "v"])

    return run


def _join(threshold: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, homes, counts = None, [], [], None

        def flush():
            if now is not None and counts is not None and len(counts):
                i = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([i, i, pa.array(counts)], names=["a", "b", "n"])

        for batch in it:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("d", "cell", "block", "visitor")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                k, part = tuple(key[first][:3]), batch.slice(first, last - first)
                if k != now:
                    yield from flush()
                    now, ids, homes, counts = k, [], [], None
                rid, v = part.column("rid").to_numpy(), _unit(part.column("v"))
                if not key[first][3]:
                    ids.append(rid)
                    homes.append(v)
                    continue
                if not homes:
                    continue
                if counts is None:
                    own_id, own = np.concatenate(ids), np.concatenate(homes)
                    own32, counts = own.astype(np.float32), np.zeros(len(own_id), np.int64)
                    ids, homes = [own_id], [own]
                for at in range(0, len(rid), 512):
                    x, y = np.nonzero(own32 @ v[at : at + 512].astype(np.float32).T >= threshold - MARGIN)
                    y += at
                    sure = np.concatenate([(own[x[c : c + 65536]] * v[y[c : c + 65536]]).sum(1) >= threshold for c in range(0, len(x), 65536)] or [np.zeros(0, bool)])
                    sure &= own_id[x] != rid[y]
                    x, y = x[sure], y[sure]
                    if len(x):
                        counts += np.bincount(x, minlength=len(counts))
                        a, b = forest(own_id[x], rid[y])
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "n"])
        yield from flush()

    return run


def cluster(vectors: DataFrame, threshold: float = 0.9, vector: str = "embedding", vec_id: str = "vec_id", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vectors with n_links, component_id and kept."""
    spark = vectors.sparkSession
    names = [c for c in vectors.columns if c in (vector, vec_id) or c not in ADDED]
    rows = textkit.numbered(vectors.select(*names))
    v, own_id = F.col(f"in{names.index(vector)}"), F.col(f"in{names.index(vec_id)}")
    # The rows' own numbers are settled with the table.
    held = settle(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # As doubles, a single-precision component keeps its value.
    good = held.filter(v.isNotNull() & finite).select(F.size(v).cast("long").alias("d"), F.col("row").alias("rid"), v.alias("v"))
    # Only lengths with pivots come to the driver, and only MAX_PIVOTS of them.
    lengths = good.groupBy("d").agg(F.count("*").alias("n")).filter(F.col("n") > cell).orderBy(F.desc("n"), "d").limit(MAX_PIVOTS).collect()
    wanted = {r.d: -(-r.n // cell) for r in lengths}
    pivots = {}
    for d, n in wanted.items():
        n = min(n, max(1, MAX_PIVOTS * n // sum(wanted.values())))
        picked = good.filter(F.col("d") == d).select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(n).toArrow()["v"].combine_chunks()
        pivots[d] = _unit(picked.chunk(0) if isinstance(picked, pa.ChunkedArray) else picked)
    placed = settle(good.mapInArrow(_cells(pivots, float(np.sqrt(2 - 2 * threshold))), good.select("d", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "rid", "v").schema), "cells")
    sizes = settle(placed.groupBy("d", "cell").agg(F.ceil(F.count_if("home") / block).cast("long").alias("blocks"), F.count("*").alias("members")), "sizes")
    met = textkit.meet(placed, sizes, ["d", "cell"], "members", sizes.agg(F.sum("members")).first()[0] or 0)
    own = F.pmod(F.xxhash64("rid"), F.col("blocks"))
    homes = met.filter("home").select("d", "cell", own.alias("block"), F.lit(0).cast("long").alias("visitor"), "rid", "v")
    others = met.select("d", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).cast("long").alias("visitor"), "rid", "v")
    dealt = homes.unionByName(others).repartition("d", "cell", "block").sortWithinPartitions("d", "cell", "block", "visitor")
    found = settle(dealt.mapInArrow(_join(threshold), "a long, b long, n long"), "vector-links")
    discard(placed, sizes)
    counts = found.filter("n is not null").groupBy(F.col("a").alias("counted")).agg(F.sum("n").alias("n"))
    parts = settle(components(found.filter("n is null").select("a", "b")), "parts")
    ids = parts.join(held.select(F.col("row").alias("node"), own_id.alias("own")), "node")
    least = settle(ids.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("nodes")), "least")
    named = textkit.meet(parts, least, "root", "nodes", parts.count()).select(F.col("node").alias("member"), "least")
    joined = held.join(counts, F.col("row") == F.col("counted"), "left").join(named, F.col("row") == F.col("member"), "left")
    component = F.coalesce(F.col("least"), own_id)
    return joined.select(*textkit.restored(names), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), own_id.eqNullSafe(component).alias("kept"))
