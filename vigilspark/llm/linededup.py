"""Operator 8: removal of lines that spread over many sites.

Lines are normalised (A-Z lower-cased, runs of white space one space, ends
trimmed) and hashed.  Sketches (HyperLogLog) of the sites of each line merge by
aggregation and estimate the distinct sites.  Lines whose estimate is within a
margin of the threshold are counted exactly.  A line on at least min_sites
distinct sites is boilerplate: it stays where it stands first in the documents
of the smallest id that holds it, and goes everywhere else, so no content is
lost altogether.

The first pass leaves 64-bit hashes of lines; a site and line count once per
document.  The texts move once, to meet the lines that they lose.

Cases.  Lines without words are never removed.  A null text is an empty one, a
single empty line; a null site is a site.  A line whose documents all have null ids has
no keeper and goes.  Repeated rows are treated alike.  Other columns pass
through; those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.llm import textkit
from vigilspark.llm.store import settle

MIN_SITES = 10
MARGIN = 0.25
LG_K = 11
ADDED = {"n_lines": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType(), "kept_words": T.LongType()}


def line_hashes(w: textkit.Words) -> tuple[textkit.Lines, np.ndarray, np.ndarray]:
    """Lines, the ones with a word, and those lines' hashes."""
    lines = textkit.lines_of(w)
    worded = np.flatnonzero(lines.last > lines.first)
    return lines, worded, textkit.span_hashes(w.hashes(fold=True), lines.first[worded], lines.last[worded])


def _hashes(w: textkit.Words, _) -> list[pa.Array]:
    lines, worded, h = line_hashes(w)
    return [textkit.lists(pa.array(h.view(np.int64)), np.searchsorted(worded, lines.at))]


def spread(named: DataFrame, min_sites: int, margin: float) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, row_key, site, text) rows: their line hashes (a table), the boilerplate lines with keepers, the number of lines."""
    hashed = settle(textkit.map_texts(named, "text", ["doc_id", "row_key", "site"], {"lines": T.ArrayType(T.LongType())}, _hashes), "lines")
    total = hashed.agg(F.sum(F.size("lines"))).first()[0] or 0
    each = hashed.select("doc_id", "row_key", "site", F.explode(F.array_distinct("lines")).alias("line"))
    # A line of fewer rows than min_sites cannot be on so many sites: it needs no sketch.
    rows = each.groupBy("line").agg(F.count("*").alias("rows"), F.min("doc_id").alias("keeper")).filter(F.col("rows") >= min_sites * (1 - margin))
    rows = settle(rows, "frequent")
    some = textkit.meet(each, rows, "line", "rows", total).select("line", "site")
    sketched = some.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    guess = sketched.select("line", F.hll_sketch_estimate("sketch").alias("sites")).join(rows, "line")
    guess = settle(guess.filter(F.col("sites") >= min_sites * (1 - margin)), "guess")
    near = guess.filter(F.col("sites") <= min_sites * (1 + margin))
    exact = textkit.meet(each.select("line", "site"), near.select("line", "rows"), "line", "rows", total).groupBy("line").agg(F.count_distinct("site").alias("exact"))
    sure = guess.filter(F.col("sites") > min_sites * (1 + margin)).select("line", "keeper", "rows")
    found = sure.unionByName(near.join(exact.filter(F.col("exact") >= min_sites), "line").select("line", "keeper", "rows"))
    return hashed, settle(found, "boilerplate"), total


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with n_lines, n_removed, kept_text and kept_words."""
    names = [c for c in docs.columns if c == text or c not in ADDED]
    rows = textkit.numbered(docs.select(*names))
    at = {c: f"in{i}" for i, c in enumerate(names)}
    keyed = rows.withColumn("key", textkit.row_key(at[text], at[doc_id]))
    named = keyed.select(F.col(at[doc_id]).alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(at[site]).cast("string")), F.lit("null")).alias("site"), F.col(at[text]).alias("text"), F.col("key").alias("row_key"))
    hashed, found, total = spread(named, min_sites, margin)
    each = hashed.select("doc_id", "row_key", F.explode("lines").alias("line"))
    lost = textkit.meet(each, found, "line", "rows", total).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("line", (F.col("keeper") == F.col("doc_id")).alias("keeps"))).alias("lost"))
    lost = lost.select("doc_id", "row_key", F.transform("lost", lambda x: x["line"]).alias("lost_lines"), F.transform(F.filter("lost", lambda x: x["keeps"]), lambda x: x["line"]).alias("kept_lines"))
    joined = keyed.join(lost, F.col(at[doc_id]).eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("row_key")), "left").select(*rows.columns, "lost_lines", "kept_lines")
    cleaned = textkit.map_texts(joined, at[text], joined.columns, ADDED, lambda w, part: cut(w, part.column("lost_lines"), part.column("kept_lines")))
    return cleaned.select(*textkit.restored(names), *ADDED)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each item of a list column."""
    items = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    counts = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64) if column.null_count else np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), counts), items


def cut(w: textkit.Words, lost: pa.Array, own: pa.Array) -> list[pa.Array]:
    lines, worded, h = line_hashes(w)
    row = textkit.row_of(lines.at)
    of_row = lambda hashes, rows: textkit.mix(hashes + rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    h = of_row(h, row[worded])
    going = np.isin(h, of_row(*_flat(lost)[::-1]))
    _, firsts = np.unique(h, return_index=True)
    first = np.zeros(len(h), bool)
    first[firsts] = True
    going &= ~(first & np.isin(h, of_row(*_flat(own)[::-1])))
    gone = np.zeros(len(row), bool)
    gone[worded[going]] = True
    removed = textkit.per_row(gone, lines.at)
    words = w.counts - np.bincount(row[worded[going]], (lines.last - lines.first)[worded[going]], w.n).astype(np.int64)
    texts = []
    for i in range(w.n):
        if removed[i]:
            stay = [j for j in range(lines.at[i], lines.at[i + 1]) if not gone[j]]
            texts.append(b"\n".join([w.data[lines.starts[j] : lines.ends[j]].tobytes() for j in stay]))
        else:
            texts.append(w.text_of(i))
    return [pa.array(np.diff(lines.at), pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words, pa.int64())]
