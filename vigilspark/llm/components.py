"""Connected components of a table of links, by alternating stars.

Large star: each node's greater neighbours link to the least of its
neighbourhood.  Small star: each node's lesser neighbours do.  Both are an
aggregation and a join.  A node of very many links is one key of that join;
there are few such nodes whatever the size of the table, so they are met by
broadcast (textkit.meet).  Before each exchange of links a task replaces those it
holds, CHUNK at a time, by stars to the least node they reach, as a combiner
would: that keeps what is connected, leaves no more links than before, and saves
rounds.  Rounds are logarithmic; each is written to the shared folder, which cuts
lineage, and the one before is deleted.  A round takes as many tasks as its links
ask for, SHARE each, so that few links are few tasks whatever the session's number
of shuffle partitions is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import textkit
from vigilspark.llm.store import discard, settle

CHUNK = 1 << 20
SHARE = 1 << 16  # links


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a, b as stars: each node but the least of those it reaches, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _dealt(rows: DataFrame, n: int | None) -> DataFrame:
    """The n rows or less in no more partitions than they ask for, by joining neighbours, without an exchange."""
    return rows if n is None else rows.coalesce(max(2, -(-n // SHARE)))


def _contracted(links: DataFrame, n: int | None = None) -> DataFrame:
    """n links (a, b) or less without nulls, each task's as stars, once each."""

    def chunks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, rows = [], 0
        for batch in it:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= CHUNK:
                yield tuple(np.concatenate(side) for side in zip(*held))
                held, rows = [], 0
        if rows:
            yield tuple(np.concatenate(side) for side in zip(*held))

    def contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in chunks(it):
            child, root = stars(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], names=["a", "b"])

    return _dealt(_dealt(links.select("a", "b"), n).mapInArrow(contract, "a long, b long").distinct(), n)


def _neighbourhoods(links: DataFrame, large: bool, n: int) -> tuple[DataFrame, DataFrame]:
    """Sides (u, v) of n links (a > b), and as a table to discard the least node m of each neighbourhood of u."""
    sides = links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    around = sides if large else sides.filter("v < u")
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    return around, settle(_dealt(least, 2 * n), "least")


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, root): the least node that each linked node reaches."""
    now = settle(_contracted(links.filter("a <> b")), "links")
    n = now.count()
    large = True
    while True:
        around, least = _neighbourhoods(now, large, n)
        # Stars alone are left once each node with a lesser neighbour has no other.
        seen = least.agg(F.sum("degree").alias("n"), F.bool_or((F.col("m") < F.col("u")) & (F.col("degree") > 1)).alias("more")).first()
        if large and not seen.more:
            discard(least)
            break
        met = textkit.meet(around, least, "u", "degree", seen.n)
        moved = met.filter("v > u") if large else met.filter("v <> m").select("u", "v", "m").unionByName(least.select("u", F.col("u").alias("v"), "m"))
        n = seen.n  # of sides, no fewer than links
        before, now = now, settle(_contracted(moved.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b"), n), "links")
        discard(before, least)
        large = not large
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
