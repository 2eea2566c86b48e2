"""Operator 4: quality rules, with line frequency across the documents of a host.

Two base rules look at a document alone: too few words, or too many of them in
five-word windows that the document repeats.  The third looks across documents:
each line, normalised (A-Z lower-cased, runs of white space one space, ends
trimmed) and hashed, is counted over the distinct documents of its host; lines in
more than LINE_DOCS of them are furniture, whatever the host's size, and a
document that keeps too little without them is depleted and rejected.  Copies of
a text under ids of their own are documents of their own.

The texts are read once; what follows moves 64-bit line hashes only, and the
count of a line is spread over the documents that hold it, a line of very many
by broadcast.  judge() gives verdicts; clean() also moves the texts once, to cut
the furniture out of them.

Cases.  Null and empty texts have no words and fail the base rules; lines
without a word count nowhere.  A null host is a host.  Repeated rows (alike in id,
host and text) count once and are judged alike.  Other columns pass through; those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.llm import linededup, textkit
from vigilspark.llm.store import settle

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LINE_DOCS = 20  # a line is furniture in more documents of a host than this
LINE_SHARE = 0.0  # and, if set, than this share of them
KEPT_SHARE = 0.3  # a document keeps at least this share of its words
_U = np.uint64

MEASURES = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType()}
VERDICTS = ("base_failed", "left_words", "kept", "kept_text")
LINES = {"lines": T.ArrayType(T.LongType()), "line_words": T.ArrayType(T.IntegerType())}


def _of_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return textkit.mix(h + row.astype(_U) * _U(0xD6E8FEB86659FD93))


def repeat_words(w: textkit.Words) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    k, n = REPEAT_WINDOW, len(w.starts)
    starts = np.flatnonzero(textkit.inside(w.at, k))
    h = _of_row(textkit.windows(w.hashes(), k)[starts], textkit.row_of(w.at)[starts])
    _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
    steps, twice = np.zeros(n + 1, np.int64), starts[counts[which] > 1]
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + k, -1)
    return textkit.per_row(np.cumsum(steps[:n]) > 0, w.at)


def measure(w: textkit.Words) -> list[pa.Array]:
    """The base measures, then each text's normalised lines: hashes and words."""
    sums = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((~textkit.SPACE[w.data]) & ((w.data & 0xC0) != 0x80), out=sums[1:])
    lines, row = (found := textkit.lines_of(w)), textkit.row_of(found.at)
    worded = np.flatnonzero(lines.last > lines.first)
    exact = _of_row(textkit.byte_hashes(w.data, lines.starts[worded], lines.ends[worded]), row[worded])
    _, firsts = np.unique(exact, return_index=True)
    again = np.ones(len(worded), bool)
    again[firsts] = False
    n_dup = np.bincount(row[worded][again], minlength=w.n)
    folded = textkit.span_hashes(w.hashes(fold=True), lines.first[worded], lines.last[worded])
    at = np.searchsorted(worded, lines.at)
    counts = [w.counts, sums[w.rows[1:]] - sums[w.rows[:-1]], textkit.per_row(SYMBOLS[w.data], w.rows), n_dup, repeat_words(w)]
    return [*[pa.array(c, pa.int64()) for c in counts], textkit.lists(pa.array(folded.view(np.int64)), at), textkit.lists(pa.array((lines.last - lines.first)[worded].astype(np.int32)), at)]


def _judged(docs: DataFrame, text: str, host: str, doc_id: str, line_texts: int, line_share: float, kept_share: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows, numbered and without the text, with uid, the measures and verdicts; (uid, line) of each line they lose; the columns' names."""
    names = [c for c in docs.columns if c == text or c not in (*MEASURES, *VERDICTS)]
    rows = textkit.numbered(docs.select(*names))
    at = {c: f"in{i}" for i, c in enumerate(names)}
    others = [at[c] for c in names if c != text]
    site = F.coalesce(F.concat(F.lit("s"), F.col(at[host]).cast("string")), F.lit("null"))
    named = rows.select(*others, F.col(at[text]).alias("text"), textkit.row_key(at[text], at[doc_id], at[host]).alias("row_key"), site.alias("site"))
    # The rows' own numbers are settled with the table.
    measured = settle(textkit.map_texts(named, "text", [*others, "row_key", "site"], MEASURES | LINES, lambda w, _: measure(w)).withColumn("uid", F.monotonically_increasing_id()), "quality")

    # The key holds the id, so it stands for the document; a document's equal lines count once.
    each = measured.select("site", "row_key", F.explode(F.array_distinct("lines")).alias("line"))
    often = each.groupBy("site", "line").agg(F.count_distinct("row_key").alias("docs"), F.count("*").alias("rows")).filter(F.col("docs") > line_texts)
    if line_share > 0:
        hosts = measured.groupBy("site").agg(F.count_distinct("row_key").alias("host_docs"))
        often = often.join(hosts, "site").filter(F.col("docs") > line_share * F.col("host_docs"))
    often = settle(often.select("site", "line", "rows"), "furniture")

    total = measured.agg(F.sum(F.size("lines"))).first()[0] or 0
    zipped = measured.select("uid", "site", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("uid", "site", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    hit = textkit.meet(zipped, often, ["site", "line"], "rows", total)
    lost = hit.groupBy("uid").agg(F.sum("words").alias("lost"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    joined = measured.join(lost, "uid", "left")
    judged = joined.select("uid", *others, *MEASURES, failed.alias("base_failed"), left.cast("long").alias("left_words"), (~failed & (left >= kept_share * F.col("n_words"))).alias("kept"))
    return judged, hit.select("uid", "line"), names


def judge(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", line_texts: int = LINE_DOCS, line_share: float = LINE_SHARE, kept_share: float = KEPT_SHARE) -> DataFrame:
    """docs, but for the text, with the measures, base_failed, left_words (in lines that stay) and kept."""
    judged, _, names = _judged(docs, text, host, doc_id, line_texts, line_share, kept_share)
    return judged.select(*textkit.restored(names, text), *MEASURES, *VERDICTS[:3])


def clean(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", line_texts: int = LINE_DOCS, line_share: float = LINE_SHARE, kept_share: float = KEPT_SHARE) -> DataFrame:
    """judge()'s columns for docs with their texts, and kept_text: the text without the lines that the host repeats."""
    numbers = settle(docs.withColumn(n := textkit.free_name(docs, "row_number"), F.monotonically_increasing_id()), "numbered")
    judged, gone, names = _judged(numbers, text, host, doc_id, line_texts, line_share, kept_share)
    number = f"in{names.index(n)}"
    lines = gone.groupBy("uid").agg(F.collect_set("line").alias("lost"))
    verdicts = judged.join(lines, "uid", "left").select(F.col(number).alias("of"), *MEASURES, *VERDICTS[:3], "lost")
    plain = textkit.numbered(numbers.select(*names))
    joined = plain.join(verdicts, F.col(number) == F.col("of")).withColumn("own", F.array().cast("array<bigint>"))
    column = f"in{names.index(text)}"
    cut = textkit.map_texts(joined.drop("of"), column, [c for c in joined.columns if c != "of"], {"kept_text": T.StringType()}, lambda w, part: linededup.cut(w, part.column("lost"), part.column("own"))[2:3])
    return cut.select(*[c for c, name in zip(textkit.restored(names), names) if name != n], *MEASURES, *VERDICTS)
