"""Operator 3: near-duplicate documents by MinHash with sequential Bayesian verification.

A document is its set of word shingles.  Documents of equal sets are one class:
128 bits of BLAKE2b over the sorted shingles tell the sets apart.  Signatures of
classes are cut into bands; classes that share a band are candidates.  Their
signatures are compared batch by batch: with m of n values equal, the similarity
has the posterior Beta(m+1, n-m+1), and a pair goes once its chance of reaching
the threshold is below MISS.  Survivors are confirmed on the full sets, which is
exact.

Three things keep groups of near copies from being all their pairs.  Within a
group only pairs not yet connected are compared, what leaves it is a spanning
forest; groups above BLOCK members are dealt as pairs of blocks; and the sets,
the bulk of the data, are made only of one document of each class that has a
surviving candidate.  The forest's own pairs are confirmed first, each with its
two sets, a node of many pairs in shares; where all of a group's are confirmed,
as among near copies of one text, that is the end of it.  Only groups in which
a pair failed meet in block pairs with their sets, for the pairs still apart.

A link of similarity s shares a band with probability 1-(1-s^ROWS)^BANDS, at
least 0.99997 for s of 0.8.

Cases.  Documents of fewer words than a shingle are one shingle, those without
words an empty set that links with nothing.  Null texts are empty.  Repeated
rows are of one class.  A null id takes part but names no component while
another does.  Other columns pass through; those named like an output are
replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.llm import textkit
from vigilspark.llm.components import components
from vigilspark.llm.store import discard, settle

ROWS, BANDS, BATCH = 4, 20, 16
MISS = 1e-6
BLOCK = 1024
ADDED = ("n_shingles", "component_id", "kept")
_U = np.uint64
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, ROWS * BANDS, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def shingles(w: textkit.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, sorted within each, and the offsets of the texts."""
    h = w.hashes(fold=True)
    starts = np.flatnonzero(textkit.inside(w.at, k))
    row, grams = textkit.row_of(w.at), textkit.windows(h, k)[starts]
    owner = row[starts]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        grams = np.concatenate([grams, textkit.span_hashes(h, w.at[short], w.at[short + 1])])
        owner = np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(w.n + 1))


def signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values (upper halves of products with odd numbers) of the sets that aren't empty; others are 0."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, len(_MULTIPLIERS)), np.uint32)
    if len(full):
        for i, a in enumerate(_MULTIPLIERS):
            out[full, i] = np.minimum.reduceat(grams * a, at[:-1][full]) >> _U(32)
    return out


def thresholds(similarity: float, miss: float, n_values: int, batch: int) -> list[tuple[int, int]]:
    """(values compared, matches needed): fewer, and the posterior chance of the similarity is below miss."""
    out = []
    for n in range(batch, n_values + 1, batch):
        chance, m = 0.0, 0
        while m <= n:
            chance += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append((n, m))
    return out


class Forest:
    """Union-find with all labels at hand."""

    def __init__(self, n: int, label: np.ndarray | None = None):
        self.label, self.links = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1], []

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
            self.links.append((i, j))


def survivors(sig: np.ndarray, i: int, among: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Those of among that the batches of i's signature don't rule out."""
    matches, before = np.zeros(len(among), np.int64), 0
    for n, least in steps:
        matches += (sig[among, before:n] == sig[i, before:n]).sum(1)
        stay = matches >= least
        among, matches, before = among[stay], matches[stay], n
        if not len(among):
            break
    return among


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least percent of their union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    inter = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def linked(sig: np.ndarray, side: np.ndarray | None, steps: list[tuple[int, int]], sets: list[np.ndarray] | None = None, percent: int = 80, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of a group; side tells two blocks apart, whose inner pairs others compare, label what is connected already."""
    n = len(sig)
    forest = Forest(n, label)
    index = np.arange(n)
    for i in range(n):
        open_ = (index > i) if side is None else (side != side[i]) if not side[i] else np.zeros(n, bool)
        among = index[open_ & (forest.label != forest.label[i])]
        if not len(among):
            continue
        for j in survivors(sig, i, among, steps):
            if sets is None:
                forest.join(i, int(j))
            elif forest.label[i] != forest.label[j] and alike(sets[i], sets[j], percent):
                forest.join(i, int(j))
    return forest.links


def runs(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by long keys."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in keys], 1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if [last.column(c)[0].as_py() for c in keys] != k[0].tolist():
                yield pa.Table.from_batches(held)
                held = []
        if len(cuts):
            held.append(batch.slice(0, cuts[-1]))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _links_of(similarity: float, miss: float, with_sets: bool):
    keys, steps = ["of", "i", "j"], thresholds(similarity, miss, ROWS * BANDS, BATCH)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(it, keys):
            k = np.stack([table[c].to_numpy() for c in keys], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
            nodes, sig, block = table["node"].to_numpy(), _matrix(table["sig"], np.uint32, ROWS * BANDS), table["block"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()] if with_sets else None
            part = table["part"].to_numpy() if with_sets else None
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2:
                    continue
                side = None if k[a, 1] == k[a, 2] else (block[a:b] == k[a, 2]).astype(np.int8)
                found = linked(sig[a:b], side, steps, sets[a:b] if sets else None, round(100 * similarity), part[a:b] if with_sets else None)
                out += [(nodes[a + x], nodes[a + y]) for x, y in found]
            if out:
                x = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return run


def in_blocks(members: DataFrame, of: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """members (node, ...) of groups of two or more, with i, j and block: one copy for each pair of blocks to compare it in; and a table to discard."""
    sizes = settle(members.groupBy(of).agg(F.count("*").alias("members")).filter("members > 1"), "sizes")
    total = sizes.agg(F.sum("members")).first()[0] or 0
    met = textkit.meet(members, sizes, of, "members", total).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    return met.select(F.col(of).alias("of"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *[c for c in members.columns if c != of]), sizes


def _compared(members: DataFrame, similarity: float, miss: float, with_sets: bool = False) -> DataFrame:
    ordered = members.repartition("of", "i", "j").sortWithinPartitions("of", "i", "j", "node")
    return ordered.mapInArrow(_links_of(similarity, miss, with_sets), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, share: int) -> DataFrame:
    """pairs (a, b) with ok: whether their sets are alike.  A node of many pairs is dealt in shares of about so many."""
    met = pairs
    for side in ("a", "b"):
        other = "b" if side == "a" else "a"
        degree = settle(pairs.groupBy(side).agg(F.count("*").alias("degree")).withColumn("shares", F.ceil(F.col("degree") / share).cast("long")), "degree")
        dealt = sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")).join(degree, side).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("degree", "shares")
        shared = textkit.meet(met, degree, side, "degree", pairs.count()).withColumn("share", F.pmod(F.xxhash64(other), F.col("shares"))).drop("degree", "shares")
        met = shared.join(dealt, [side, "share"]).drop("share")

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ok = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return met.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long, ok boolean")


def cluster(docs: DataFrame, k: int = 5, similarity: float = 0.8, miss: float = MISS, block: int = BLOCK, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and kept of each row."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), textkit.row_key(text, doc_id).alias("row_key"))

    def sign(w: textkit.Words, _) -> list[pa.Array]:
        grams, at = shingles(w, k)
        sig = signatures(grams, at)
        same = [hashlib.blake2b(grams[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
        return [pa.array(np.diff(at), pa.int64()), pa.array(same, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())]

    signed = settle(textkit.map_texts(named, "text", ["doc_id", "row_key"], {"n_shingles": T.LongType(), "same": T.BinaryType(), "sig": T.BinaryType()}, sign), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    grouped = signed.filter("n_shingles > 0").groupBy("same").agg(first.alias("first"), F.any_value("sig").alias("sig"), F.count("*").alias("rows"))
    # The numbers are settled with the table, so they name the classes from here on.
    classes = settle(grouped.select("same", F.monotonically_increasing_id().alias("node"), "first.doc_id", "first.row_key", "sig", "rows"), "classes")

    def bands(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sig = _matrix(b.column("sig"), np.uint32, ROWS * BANDS).astype(_U)
            h = np.full((len(sig), BANDS), 0, _U)
            for r in range(ROWS):
                h = textkit.mix(h * _U(31) + sig[:, r::ROWS] + _U(1))
            h = textkit.mix(h + np.arange(BANDS, dtype=_U) * _U(0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], names=["band", "node"])

    banded = classes.select("node", "sig").mapInArrow(bands, "band long, node long")
    banded = settle(banded, "bands")
    placed, sizes = in_blocks(banded, "band", block)
    pairs = settle(_compared(placed.join(classes.select("node", "sig"), "node"), similarity, miss).distinct(), "pairs")
    discard(banded, sizes)
    candidates = settle(components(pairs), "candidates")

    wanted = candidates.join(classes, "node").select(F.col("node"), F.col("root"), F.col("sig"), F.col("doc_id").alias("w_id"), F.col("row_key").alias("w_key"))
    held = named.join(wanted, named["doc_id"].eqNullSafe(wanted["w_id"]) & (named["row_key"] == wanted["w_key"])).dropDuplicates(["node"])

    def full_sets(w: textkit.Words, _) -> list[pa.Array]:
        grams, at = shingles(w, k)
        return [pa.array([grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())]

    sets = settle(textkit.map_texts(held.select("text", "node", "root", "sig"), "text", ["node", "root", "sig"], {"set": T.BinaryType()}, full_sets), "sets")
    checked = settle(_confirmed(pairs, sets, round(100 * similarity), block // 4), "checked")
    found = checked.filter("ok").select("a", "b")
    parts = settle(components(found), "parts")
    failed, confirmed = checked.filter("not ok"), parts
    if not failed.isEmpty():
        roots = failed.select(F.col("a").alias("node")).join(candidates, "node").select("root").distinct()
        open_ = sets.join(roots, "root", "left_semi").join(parts.withColumnRenamed("root", "part"), "node", "left")
        open_ = settle(open_.withColumn("part", F.coalesce("part", "node")), "open")
        apart, sizes = in_blocks(open_, "root", block // 4)
        later = settle(_compared(apart, similarity, miss, True), "later")
        if not later.isEmpty():
            confirmed = settle(components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(later)), "confirmed")
        discard(open_, sizes, later)
    discard(sets, checked, pairs, candidates)

    reached = confirmed.join(classes.select("node", "doc_id"), "node")
    least = settle(reached.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("nodes")), "least")
    named_ = textkit.meet(confirmed, least, "root", "nodes", confirmed.count()).select("node", "least")
    of_class = settle(classes.select("node", "same", "rows", F.col("doc_id").alias("own")).join(named_, "node", "left").select("same", F.coalesce("least", "own").alias("class_id"), "rows"), "of-class")
    some = signed.drop("sig").filter("n_shingles > 0")
    joined = textkit.meet(some, of_class, "same", "rows", some.count()).select("doc_id", "row_key", "n_shingles", F.col("class_id").alias("component_id"))
    joined = joined.unionByName(signed.filter("n_shingles = 0").select("doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id")))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """docs with n_shingles, component_id and kept."""
    found = cluster(docs, text=text, doc_id=doc_id, **settings).distinct().withColumnsRenamed({"doc_id": "found_id", "row_key": "found_key"})
    kept = docs.drop(*ADDED)
    keyed = kept.withColumn(key := textkit.free_name(kept, "row_key"), textkit.row_key(text, doc_id))
    joined = keyed.join(found, keyed[doc_id].eqNullSafe(found["found_id"]) & (keyed[key] == found["found_key"]))
    return joined.select(*[keyed[c] for c in kept.columns], *ADDED)
