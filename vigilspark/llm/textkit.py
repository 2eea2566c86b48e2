"""Vectorised words, windows and hashes of Arrow text columns.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR,
which over UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` over characters.  A
batch is cut into chunks of whole texts of about a megabyte, so that memory
follows the longest text and not the batch.

A word's hash takes its bytes, eight at a time, through a mixer; long words go
through BLAKE2b.  Runs of words are Rabin-Karp polynomials over the word hashes
modulo two primes below 2^32, taken from running sums: a run's hash is the
difference of two sums times the inverse power of its start, 64 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
_U = np.uint64
PRIMES = ((_U(4294967291), 3141592653), (_U(4294967279), 2718281828))  # each with the base of its polynomials
LONG = 256  # bytes

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)

_powers: dict[int, list[np.ndarray]] = {}


def powers(which: int, n: int) -> list[np.ndarray]:
    """Powers 0..n of a prime's base and of the base's inverse."""
    prime, base = PRIMES[which]
    known = _powers.get(which)
    if known is None or len(known[0]) <= n:
        known = []
        for b in (base, pow(base, -1, int(prime))):
            x = np.ones(1, _U)
            while len(x) <= n:
                x = np.concatenate([x, x * _U(pow(b, len(x), int(prime))) % prime])
            known.append(x)
        _powers[which] = known
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    left = ends - starts
    h = mix(left.astype(_U) + _U(0x9E3779B97F4A7C15))
    long = np.flatnonzero(left > LONG)
    live = np.flatnonzero((left > 0) & (left <= LONG))
    at, left = starts[live], left[live]
    while len(live):
        h[live] = mix(h[live] ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def _runs(h: np.ndarray, first: np.ndarray | slice, last: np.ndarray | slice) -> np.ndarray:
    """The polynomials of the runs first..last-1 of h, both residues in 64 bits."""
    out = None
    for which, (prime, _) in enumerate(PRIMES):
        up, down = powers(which, len(h))
        sums = np.zeros(len(h) + 1, _U)
        np.cumsum(h % prime * up[: len(h)] % prime, out=sums[1:])
        part = (sums[last] - sums[first]) % prime * down[: len(h) + 1][first] % prime
        out = part if out is None else out << _U(32) | part
    return out


@dataclass
class Words:
    """Words of some whole texts: rows first..first+n of the batch."""

    first: int
    data: np.ndarray  # bytes of the texts, one after the other
    rows: np.ndarray  # n+1 byte offsets of the texts
    starts: np.ndarray  # of each word
    ends: np.ndarray
    at: np.ndarray  # n+1 word offsets of the texts

    @property
    def n(self) -> int:
        return len(self.rows) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z lower-cased if wished."""
        return byte_hashes(FOLD[self.data] if fold else self.data, self.starts, self.ends)

    def text_of(self, row: int) -> bytes:
        return self.data[self.rows[row] : self.rows[row + 1]].tobytes()


def word_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Whole texts of a string column in chunks; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield split_words(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def split_words(first: int, data: np.ndarray, rows: np.ndarray) -> Words:
    word = ~SPACE[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = rows[:-1][rows[:-1] < len(data)]
    starts[edge] = word[edge]
    edge = rows[1:][rows[1:] > 0] - 1
    ends[edge] = word[edge]
    begin = np.flatnonzero(starts)
    return Words(first, data, rows, begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, rows))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values, also those that cross texts."""
    n = len(h) - k + 1
    return mix(_runs(h, slice(0, n), slice(k, n + k))) if n > 0 else np.zeros(0, _U)


def inside(at: np.ndarray, k: int) -> np.ndarray:
    """For each start of a run of k words, whether it lies within one text."""
    counts = np.diff(at)
    room = np.repeat(at[1:], counts) - np.arange(at[0], at[-1])
    return (room >= k)[: max(0, int(at[-1] - at[0]) - k + 1)]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def row_of(at: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def span_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs first..last-1 of h."""
    return mix(mix(_runs(h, first, last)) + (last - first).astype(_U))


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of flags between neighbouring offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


@dataclass
class Lines:
    """Lines (text between line feeds) of some whole texts."""

    starts: np.ndarray  # byte offsets
    ends: np.ndarray
    first: np.ndarray  # word offsets
    last: np.ndarray
    at: np.ndarray  # n+1 line offsets of the texts


def lines_of(w: Words) -> Lines:
    breaks = np.flatnonzero(w.data == 0x0A)
    # A text has one line more than line feeds, an empty one too.
    at = np.searchsorted(breaks, w.rows) + np.arange(len(w.rows))
    owner = row_of(at)
    begin = np.empty(int(at[-1]), np.int64)
    begin[at[:-1]] = w.rows[:-1]
    inner = np.ones(len(begin), bool)
    inner[at[:-1]] = False
    begin[inner] = breaks + 1
    end = np.empty_like(begin)
    end[:-1] = begin[1:] - 1
    tail = at[1:] - 1
    end[tail] = w.rows[1:][owner[tail]]
    return Lines(begin, end, np.searchsorted(w.starts, begin), np.searchsorted(w.starts, end), at)


def row_key(text: str = "text", doc_id: str = "doc_id", *others: str) -> Column:
    """Tells rows apart together with the id: rows of the same id, text and other columns given are alike to the operator."""
    return F.xxhash64(F.col(doc_id), F.col(text), *[F.col(c) for c in others], F.lit(17))


def same_row(a: DataFrame, b: DataFrame, doc_id: str = "doc_id", key: str = "row_key") -> Column:
    return a[doc_id].eqNullSafe(b[doc_id]) & (a[key] == b[key])


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named in0, in1, ..., which clash with no helper column."""
    return df.toDF(*[f"in{i}" for i in range(len(df.columns))])


def restored(names: list[str], but: str = "") -> list[Column]:
    """The columns of numbered() under their own names, without one of them if wished."""
    return [F.col(f"in{i}").alias(c) for i, c in enumerate(names) if c != but]


def map_texts(docs: DataFrame, text: str, keep: list[str], added: dict[str, T.DataType], fn: Callable[[Words, pa.RecordBatch], list[pa.Array]], limit: int = CHUNK_BYTES) -> DataFrame:
    """docs with the columns keep and, for each chunk of whole texts, what fn makes of it; a narrow pass."""
    df = docs.select(F.col(text).alias(inner := free_name(docs, "text_in")), *[c for c in keep])
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(k, v) for k, v in added.items()]])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            passed = batch.select(keep)
            for w in word_chunks(batch.column(inner), limit):
                part = passed.slice(w.first, w.n)
                yield pa.RecordBatch.from_arrays([*part.columns, *fn(w, part)], names=[*keep, *added])

    return df.mapInArrow(batches, schema)


def spaced(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins and ends in that."""
    length = w.ends - w.starts
    ends = np.cumsum(length + 1) - 1
    begins = ends - length
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    word = np.flatnonzero(~SPACE[w.data])
    out[word + np.repeat(begins - w.starts, length)] = w.data[word]
    return out.tobytes(), begins, ends


def meet(left: DataFrame, right: DataFrame, on: str | list[str], weight: str, total: int, how: str = "inner", shares: int = 256) -> DataFrame:
    """left joined to right, which has one row for each value of on and, as weight, about the rows of left that have it.

    Values above a 256th of all rows would be one task's work, and there are fewer than 256 of them whatever the
    size of the tables: they are broadcast, the rest is left to Spark.  right is read twice, so it should be a table.
    total is the sum of weight; how is inner or left."""
    on = [on] if isinstance(on, str) else on
    hot = right.filter(F.col(weight) * shares > total)
    cold = right.filter(F.col(weight) * shares <= total)
    often, seldom = left.join(F.broadcast(hot.select(*on)), on, "left_semi"), left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return often.join(F.broadcast(hot), on).unionByName(seldom.join(cold, on, how))


def lists(values: pa.Array, at: np.ndarray) -> pa.Array:
    """values cut at the offsets."""
    return pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), values)


def joined_words(w: Words, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    starts, ends = w.starts[keep], w.ends[keep]
    inner = ends < w.rows[1:][row_of(w.at)[keep]]
    data = w.data.copy()
    data[ends[inner]] = 0x20
    steps = np.zeros(len(data) + 2, np.int8)
    steps[starts] += 1
    np.add.at(steps, ends + inner, -1)
    taken = np.cumsum(steps[: len(data)], dtype=np.int8) > 0
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(taken, out=sums[1:])
    out, at = data[taken], sums[w.rows]
    return [out[a:b].tobytes().rstrip(b" ") for a, b in zip(at[:-1], at[1:])]
