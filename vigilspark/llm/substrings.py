"""Operator 2: removal of repeated windows of words.

Every window of WINDOW consecutive words of a document gets a Rabin-Karp hash.
A window whose words also start at another place is repeated; the words that
repeated windows cover, as maximal intervals, are removed.

The texts are dealt once to slices of about SLICE_BYTES, by a hash of the row.
A slice sends each of its distinct hashes once, with a bit that says whether the
slice has it twice: a passage that a third of all documents share is sent by a
slice once and not by each document.  Hashes go to buckets by range, so a slice
sends one packed list per bucket.  A bucket counts in which slices a hash is, and
answers each slice with a bit per hash.  Equal hashes are a suspicion only: the
words of suspected windows are compared, in a second exchange of the same form,
by 128 bits of BLAKE2b of the words themselves.  The slice, which meets its
answers in the same partitioning (the exchange of the texts is reused), cuts.

Slices and buckets are as many as the texts' bytes ask for, and so are the tasks
that take them, so none of them grows with the corpus.

Cases.  Null and empty texts have no words and lose none.  Rows alike in id and
text repeat each other's windows, as any two rows do.  Other columns pass
through; those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.llm import textkit

WINDOW = 35
SLICE_BYTES = 4 << 20
BUCKET_BYTES = 3 << 20  # of text; a bucket has a hash for each window, so about four megabytes of them
TASK_BYTES = 16 << 20
ADDED = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType()}
_REQUEST = "bucket long, slice long, keys binary, twice binary"
_ANSWER = "slice long, bucket long, repeated binary"
_WORDS = np.dtype("V16")  # a digest of a window's words


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    head = keys if keys.dtype == np.uint64 else keys.view(">u8").reshape(-1, 2)[:, 0].astype(np.uint64)
    return ((head >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, which of them each key is, and how often each occurs."""
    if keys.dtype == np.uint64:
        return np.unique(keys, return_inverse=True, return_counts=True)
    pairs = keys.view(">u8").reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(len(keys), bool)
    new[1:] = (pairs[order[1:]] != pairs[order[:-1]]).any(1)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return keys[order[new]], which, np.bincount(which, minlength=int(new.sum()))


def _requests(keys: np.ndarray, at: int, buckets: int) -> pa.Table:
    """One row for each bucket: the slice's distinct keys of it, and a bit for those it has twice."""
    keys, _, counts = _distinct(keys)
    bucket = _bucket(keys, buckets)
    firsts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    bounds = list(zip(firsts, [*firsts[1:], len(keys)]))
    return pa.table({
        "bucket": pa.array(bucket[firsts].astype(np.int64)), "slice": pa.array([at] * len(bounds), pa.int64()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in bounds], pa.binary()), "twice": pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in bounds], pa.binary()),
    })


def _answers(kind: type | np.dtype) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        """For each slice of one bucket, a bit for each key that it sent."""
        sent = [np.frombuffer(x, kind) for x in part["keys"].to_pylist()]
        counts = np.array([len(x) for x in sent])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(part["twice"].to_pylist(), counts)]).astype(bool)
        _, which, often = _distinct(np.concatenate(sent))
        del sent
        many = often > 1
        many[which[twice]] = True
        bits = [np.packbits(x).tobytes() if x.any() else None for x in np.split(many[which], np.cumsum(counts)[:-1])]
        keep = pa.array([i for i, b in enumerate(bits) if b is not None], pa.int64())
        return pa.table({"slice": part["slice"].take(keep), "bucket": part["bucket"].take(keep), "repeated": pa.array([b for b in bits if b is not None], pa.binary())})

    return run


def _told(keys: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """For each key of a slice, whether the answers say that it is elsewhere too."""
    distinct, which, _ = _distinct(keys)
    bucket = _bucket(distinct, buckets)
    repeated = np.zeros(len(distinct), bool)
    for b, bits in zip(answers["bucket"].to_pylist(), answers["repeated"].to_pylist()):
        first, last = np.searchsorted(bucket, np.array([b, b + 1], np.uint64))
        repeated[first:last] = np.unpackbits(np.frombuffer(bits, np.uint8))[: last - first]
    return repeated[which] if len(keys) else np.zeros(0, bool)


class _Slice:
    """The texts of a slice, in order, and their windows."""

    def __init__(self, part: pa.Table, key: str, text: str, window: int):
        self.part = part.sort_by([(key, "ascending")]).combine_chunks()
        column = self.part[text].combine_chunks() if part.num_rows else pa.array([], pa.string())
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        self.window, self.chunks, hashes = window, [], [np.zeros(0, np.uint64)]
        for w in textkit.word_chunks(column):
            starts = np.flatnonzero(textkit.inside(w.at, window))
            self.chunks.append((w, starts))
            hashes.append(textkit.windows(w.hashes(), window)[starts])
        self.hashes = np.concatenate(hashes)

    def spread(self, flags: np.ndarray) -> list[np.ndarray]:
        """Flags of all windows, chunk by chunk."""
        return np.split(flags, np.cumsum([len(starts) for _, starts in self.chunks])[:-1]) if self.chunks else []

    def words(self, wanted: np.ndarray) -> np.ndarray:
        """Digests of the words of the wanted windows."""
        out = []
        for (w, starts), flags in zip(self.chunks, self.spread(wanted)):
            if flags.any():
                joined, begins, ends = textkit.spaced(w)
                first = starts[flags]
                out += [hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(begins[first].tolist(), ends[first + self.window - 1].tolist())]
        return np.frombuffer(b"".join(out), _WORDS)


def _cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    steps[starts] += 1
    ends = starts + window
    np.subtract.at(steps, ends, 1)
    return np.cumsum(steps[:n]) > 0


def dedup(docs: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    kept = docs.drop(*ADDED)
    key, at = textkit.free_name(kept, "row_key"), textkit.free_name(kept, "slice")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    columns = kept.columns
    slices, buckets = max(parts, -(-total // slice_bytes)), max(parts, -(-total // BUCKET_BYTES))
    keyed = kept.withColumn(key, textkit.row_key(text, doc_id))
    dealt = keyed.withColumn(at, F.pmod(F.col(key), F.lit(slices))).repartition(parts, at)

    def requests(part: pa.Table) -> pa.Table:
        return _requests(_Slice(part, key, text, window).hashes, part[at][0].as_py(), buckets)

    def confirm(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return _requests(np.zeros(0, _WORDS), 0, buckets)
        one = _Slice(part, key, text, window)
        return _requests(one.words(_told(one.hashes, answers, buckets)), part[at][0].as_py(), buckets)

    def cut(part: pa.Table, answers: pa.Table) -> pa.Table:
        one = _Slice(part, key, text, window)
        by_words = answers["by_words"].to_numpy()
        gone = _told(one.hashes, answers.filter(pa.array(~by_words)), buckets)
        gone[gone] = _told(one.words(gone), answers.filter(pa.array(by_words)), buckets)
        n_words, n_removed, texts = [], [], []
        for (w, starts), flags in zip(one.chunks, one.spread(gone)):
            covered = _cover(starts[flags], len(w.starts), window)
            n_words.append(w.counts)
            n_removed.append(textkit.per_row(covered, w.at))
            texts += textkit.joined_words(w, ~covered)
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table([*[one.part[c] for c in columns], flat(n_words), flat(n_removed), pa.array(texts, pa.binary()).cast(pa.string())], names=[*columns, *ADDED])

    asked = dealt.groupBy(at).applyInArrow(requests, _REQUEST).repartition(parts, "bucket")
    suspected = asked.groupBy("bucket").applyInArrow(_answers(np.uint64), _ANSWER)
    compared = dealt.groupBy(at).cogroup(suspected.repartition(parts, "slice").groupBy("slice")).applyInArrow(confirm, _REQUEST).repartition(parts, "bucket")
    sure = compared.groupBy("bucket").applyInArrow(_answers(_WORDS), _ANSWER)
    answered = suspected.withColumn("by_words", F.lit(False)).unionByName(sure.withColumn("by_words", F.lit(True)))
    schema = T.StructType([*kept.schema.fields, *[T.StructField(k, v) for k, v in ADDED.items()]])
    return dealt.groupBy(at).cogroup(answered.repartition(parts, "slice").groupBy("slice")).applyInArrow(cut, schema)
