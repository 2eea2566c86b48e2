"""Operator 10: mixing sources to target weights by pivotal dependent rounding.

A source's target in words, over its size, is the number of copies that each of
its documents is due: a whole part, and a fraction that must become 0 or 1.
Pairs of fractions exchange words, in a random direction that keeps both
expectations, until one of the two is integral (dependent rounding with
weights).  A pair's words stay what they were, so only the one fraction left at
the end, which is rounded to the nearer side, parts a source from its target: by
half a document at most.

The rounding is a tree: hash blocks of a source's documents run as separate
groups, each leaves one fraction, and groups of FAN_IN such rests meet in the
next level until a source has one.  A source that holds
most of the rows is many blocks.  Random numbers come from the seed, the source,
the level and the block, so reruns agree.

Sources are a table throughout, however many there are; the driver holds the unit
of weight and counts of its rounds.

Cases.  Null texts have size 0; a null source is a source, the last one.  A
source without words has target 0 and takes nothing.  Rows that agree in id,
source and text are rounded as one and share the outcome.  An empty table gives an empty
table.  Other columns pass through; those named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.llm import textkit
from vigilspark.llm.store import settle

BLOCK = 4_000
FAN_IN = 64
ADDED = ("size", "source_size", "target", "copies", "taken")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """due() for a list of sources in memory: share of all words by weight, none above cap times its size."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        unit = max(0.0, total - sum(out)) / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        for i in full or open_:
            out[i] = cap * sizes[i] if full else unit * weights[i]
        if not full:
            break
        open_ = [i for i in open_ if i not in set(full)]
    return out


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """p rounded to 0 and 1 but for one place at most, and that place (-1: none)."""
    x, held = p.astype(float).copy(), -1
    coins = rng.random(len(x))
    eps = 1e-9
    for j in range(len(x)):
        if x[j] < eps or x[j] > 1 - eps:
            x[j] = round(x[j])
            continue
        if size[j] <= 0:
            x[j] = float(coins[j] < x[j])
            continue
        if held < 0:
            held = j
            continue
        a, b, r = x[held], x[j], size[j] / size[held]
        up, down = min(1 - a, b * r), min(a, (1 - b) * r)
        move = up if coins[j] * (up + down) < down else -down
        a, b = a + move, b - move / r
        a, b = (round(v) if min(abs(v), abs(1 - v)) < eps else v for v in (a, b))
        x[held], x[j] = a, b
        if 0 < a < 1:
            continue
        held = j if 0 < b < 1 else -1
    return x, held


def _rounded(seed: int, level: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("words", "descending"), ("doc_id", "ascending"), ("row_key", "ascending")])
        name = f"{seed}|{level}|{part['source_no'][0]}|{part['block'][0]}"
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
        x, _ = pivot(part["p"].to_numpy(), part["words"].to_numpy(), rng)
        return part.set_column(part.schema.get_field_index("p"), "p", pa.array(x, pa.float64()))

    return run


def ranked(sources: DataFrame) -> DataFrame:
    """A table of sources with rank: their place by code point, null last.  Ranges are sorted apart; only their sizes come to the driver."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = settle(sources.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    sizes = dict(sorted((r.part, r.n) for r in sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()))
    starts, at = [], 0
    for p, n in sizes.items():
        starts.append((p, at))
        at += n
    starts = sources.sparkSession.createDataFrame(starts, "part long, start long")  # a row for each partition
    return sorted_.withColumn("part", part.cast("long")).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "start", "place")


def due(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Ranked sources (n: words) with target.  Each round counts, over all sources, what those at their cap leave to the
    others; the unit only grows, so the rounds end with the first that adds none.  Sums are of integers, so reruns agree."""
    k = (F.col("rank") % len(weights)).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), k)
    unit, capped = 0.0, -1
    while True:
        full = F.lit(unit) * weight > cap * F.col("n")
        seen = sources.filter("n > 0").groupBy(k.alias("k")).agg(F.count_if(~full).alias("open"), F.count_if(full).alias("full"), F.sum("n").alias("n"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("full_n")).collect()
        total, open_ = sum(r.n for r in seen), sum(weights[r.k] * r.open for r in sorted(seen, key=lambda r: r.k))
        if sum(r.full for r in seen) == capped or not open_:
            break
        capped, unit = sum(r.full for r in seen), max(0.0, share * total - cap * sum(r.full_n for r in seen)) / open_
    target = F.when(F.col("n") <= 0, 0.0).when(F.lit(unit) * weight > cap * F.col("n"), cap * F.col("n")).otherwise(unit * weight)
    return sources.withColumn("target", target)


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document that differs in id, source or text: doc_id, row_key, rows, size, source_size, target, copies."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"), textkit.row_key(text, doc_id, source).alias("row_key"))
    counted = textkit.map_texts(named, "text", ["doc_id", "source", "row_key"], {"size": T.LongType()}, lambda w, _: [pa.array(w.counts, pa.int64())])
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("site")
    units = settle(counted.groupBy("doc_id", "source", "row_key", "size").agg(F.count("*").alias("rows")).select("*", site), "sizes")
    known = ranked(units.groupBy("source", "site").agg(F.sum(F.col("size") * F.col("rows")).alias("n"), F.count("*").alias("units")))
    rate = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    rates = due(settle(known, "ranked"), weights, share, cap)
    rates = settle(rates.select("site", F.col("rank").alias("source_no"), F.col("n").alias("source_size"), "target", rate.alias("rate"), F.greatest(F.lit(1), F.ceil(F.col("units") / BLOCK)).cast("long").alias("blocks"), "units"), "rates")
    most, n_units = rates.agg(F.max("blocks"), F.sum("units")).first()
    due_units = textkit.meet(units, rates, "site", "units", n_units or 0).select("doc_id", "row_key", "rows", "size", "source_no", "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed)), F.col("blocks")).alias("block"), (F.col("size") * F.col("rows")).alias("words"))
    rounded = settle(due_units.groupBy("source_no", "block").applyInArrow(_rounded(seed, 0), due_units.schema), "rounded")

    open_ = rounded.filter((F.col("p") > 0) & (F.col("p") < 1)).select("doc_id", "row_key", "words", "source_no", "block", "p")
    blocks, level, decided = most or 1, 0, []
    while blocks > 1:
        level, blocks = level + 1, -(-blocks // FAN_IN)
        met = open_.withColumn("block", F.floor(F.col("block") / FAN_IN))
        met = settle(met.groupBy("source_no", "block").applyInArrow(_rounded(seed, level), met.schema), "rests")
        decided.append(met.filter((F.col("p") <= 0) | (F.col("p") >= 1)))
        open_ = met.filter((F.col("p") > 0) & (F.col("p") < 1))
    rests = open_.withColumn("p", (F.col("p") >= 0.5).cast("double"))
    for d in decided:
        rests = rests.unionByName(d)
    rests = rests.select("doc_id", "row_key", F.col("p").alias("p_last"))
    joined = rounded.join(rests, textkit.same_row(rounded, rests), "left").select(rounded["*"], "p_last")
    return joined.select("doc_id", "row_key", "rows", "size", "source_size", "target", (F.col("whole") + F.coalesce("p_last", "p")).cast("long").alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **settings) -> DataFrame:
    """docs with size, source_size, target, copies (times that the mix holds the row) and taken (size times copies)."""
    planned = plan(docs, text=text, source=source, doc_id=doc_id, **settings)
    names = [c for c in docs.columns if c in (text, source, doc_id) or c not in ADDED]
    at = {c: f"in{i}" for i, c in enumerate(names)}
    rows = textkit.numbered(docs.select(*names)).withColumn("key", textkit.row_key(at[text], at[doc_id], at[source]))
    joined = rows.join(planned, F.col(at[doc_id]).eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("row_key")))
    added = [F.col(c) for c in ("size", "source_size", "target", "copies")]
    return joined.select(*textkit.restored(names), *added, (F.col("size") * F.col("copies")).alias("taken"))


def draw(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of docs as many times as it has copies, with the columns of docs."""
    mixed = mix(docs.toDF(*[f"{c}_" if c in ADDED else c for c in docs.columns]), **settings)
    drawn = mixed.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return drawn.select(*[F.col(f"{c}_" if c in ADDED else c).alias(c) for c in docs.columns])


def report(docs: DataFrame, **settings) -> DataFrame:
    """The contract's columns, from sizes alone: the texts are read once and not moved."""
    planned = plan(docs, **settings)
    each = planned.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
