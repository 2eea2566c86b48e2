"""Operator 13: best-fit packing of tokenised documents by bin completion.

Documents become token ids, longer ones are cut, and pieces of a length are alike
to the packing: it is found for the table of lengths and their counts, which has as
many rows as a sequence has tokens however large the corpus is.

Bin completion branches on the fillings of the sequence around the largest piece
left.  Fillings come by waste, least first, larger pieces first, and only those that
no piece left over dominates (one that could replace pieces of the filling and still
fit).  A filling is used as often as its pieces last.  Branches that cannot come
below the incumbent are cut by the bound on waste (Martello and Toth's second
bound of what is left); the first incumbent is best-fit decreasing.  The search
ends at the lower bound or after looking at NODES fillings, so that its time does not grow with
the corpus; what it found last is then used.

The search yields fillings and how often each is used.  A piece's rank among those of
its length says which copy of which filling it belongs to: tasks number the pieces
of a length while they cut, and a running sum over tasks makes these the ranks.
Each use of a filling exhausts a length or leaves fewer than one sequence holds,
so there are at most some thousands of fillings; they are broadcast.

Texts are encoded a cut at a time: a text may be cut before a single space between
two characters that are no white space, where every byte-level pre-token ends.
Cuts met before in a worker are looked up by 64-bit hashes and not encoded again,
in a table of bounded size.

Cases.  Null and empty texts are the end token alone.  An empty table gives none.
Repeated rows are documents of their own.  Other columns pass through; those named
like an output are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.llm import textkit
from vigilspark.llm.store import settle

CAPACITY, END, NODES = 1024, 2, 6000
REMEMBERED = 1 << 20  # cuts
ADDED = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# Encoding.


def cuts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Byte offsets at which texts may be encoded apart, the texts' own included."""
    n = len(data)
    space = textkit.SPACE[data] | (data < 0x20)
    # The last and first bytes of white space outside ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
    at = np.flatnonzero((data == 0x20)[1 : n - 1] & ~space[: n - 2] & ~space[2:]) + 1 if n > 2 else np.zeros(0, np.int64)
    a, b, c = data[np.maximum(at - 3, 0)], data[np.maximum(at - 2, 0)], data[at - 1]
    d, e, f = data[at + 1], data[np.minimum(at + 2, n - 1)], data[np.minimum(at + 3, n - 1)]
    at = at[~(_blank2(b, c) | _blank3(a, b, c) | _blank2(d, e) | _blank3(d, e, f))]
    return np.union1d(at, rows)


def _blank2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == 0xC2) & ((b == 0x85) | (b == 0xA0))


def _blank3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return general | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)


class Encoder:
    """Token ids of texts by a tokenizer file, remembering cuts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and which list each has
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts one after the other, and n+1 offsets into them; rows are byte offsets of the texts."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
        at = cuts(data, rows)
        starts, ends = at[:-1], at[1:]
        if len(self.hashes) > REMEMBERED:
            self._forget()
        met, first, which = np.unique(textkit.byte_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, met)
        known = np.zeros(len(met), bool)
        inner = place < len(self.hashes)
        known[inner] = self.hashes[place[inner]] == met[inner]
        new = np.flatnonzero(~known)
        if len(new):
            found = self.tokenizer.encode_batch_fast([data[starts[i] : ends[i]].tobytes().decode() for i in first[new]], add_special_tokens=False)
            lists = [np.array(e.ids, np.int32) for e in found]
            slots = len(self.bounds) - 1 + np.arange(len(new))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in lists])])
            self.ids = np.concatenate([self.ids, *lists])
            order = np.argsort(np.concatenate([self.hashes, met[new]]), kind="stable")
            self.hashes, self.slots = np.concatenate([self.hashes, met[new]])[order], np.concatenate([self.slots, slots])[order]
            place = np.searchsorted(self.hashes, met)
        slot = self.slots[place][which]
        size = self.bounds[slot + 1] - self.bounds[slot]
        sums = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.bounds[slot] - sums[:-1], size) + np.arange(sums[-1])]
        return ids, sums[np.searchsorted(at, rows)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bytes_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and byte offsets of some whole texts, about a megabyte at a time."""
    for w in textkit.word_chunks(column):
        yield w.first, w.data, w.rows


def cut_pieces(docs: DataFrame, path: str, text: str, capacity: int, end: int) -> DataFrame:
    """docs without their text, a row for each piece: piece, start, length, ids_crc32, and the task and the piece's number there among those of its length."""
    kept = [c for c in docs.columns if c not in (*ADDED, text)]
    df = docs.select(F.coalesce(F.col(text), F.lit("")).alias(inner := textkit.free_name(docs, "text_in")), *kept)
    added = {textkit.free_name(docs, c): k for c, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task_at", T.LongType()), ("ordinal", T.LongType()))}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, task, seen = _encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in it:
            for first, data, rows in bytes_of(batch.column(0)):
                ids, at = encoder.encode(data, rows)
                total = np.diff(at) + 1
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                short = total - (n - 1) * capacity  # the first piece takes what the others leave
                start = np.where(piece > 0, short[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, short[row])
                crc = []
                for r, a, size in zip(row.tolist(), start.tolist(), length.tolist()):
                    whole = ids[at[r] + a : min(at[r] + a + size, at[r + 1])]
                    crc.append(zlib.crc32(b"" if a + size < total[r] else int(end).to_bytes(4, "little"), zlib.crc32(whole.astype("<u4").tobytes())))
                order = np.argsort(length, kind="stable")
                kinds, begin, many = np.unique(length[order], return_index=True, return_counts=True)
                ordinal = np.empty(len(length), np.int64)
                ordinal[order] = np.arange(len(length)) - np.repeat(begin, many) + np.repeat(seen[kinds], many)
                seen[kinds] += many
                passed = batch.slice(first, len(n)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*passed.columns[1:], pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task)), pa.array(ordinal)],
                    names=[*kept, *added],
                )

    fields = df.select(*kept).schema.fields
    return df.mapInArrow(run, T.StructType([*fields, *[T.StructField(k, v) for k, v in added.items()]]))


# The search.

Filling = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


@dataclass
class Plan:
    fillings: list[tuple[Filling, int]]  # with how often each is used
    sequences: int
    bound: int  # no packing has fewer
    nodes: int


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's second bound, by all thresholds at once."""
    size = np.arange(capacity + 1)
    n, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * size)])
    half = capacity // 2
    k = np.arange(0, half + 1)
    alone = n[-1] - n[capacity - k + 1]  # longer than capacity - k
    n2, mass2 = n[capacity - k + 1] - n[half + 1], mass[capacity - k + 1] - mass[half + 1]
    small = mass[half + 1] - mass[np.maximum(k, 0)]
    return int((alone + n2 + np.maximum(0, -(-(small - (n2 * capacity - mass2)) // capacity))).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, whole groups of like sequences at once."""
    open_: dict[int, list[list]] = {capacity: []}  # room -> [filling, how many such sequences]
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            room = min((r for r in open_ if r >= size and open_[r]), default=None)
            if room is None:
                uses, filling, many = capacity // size, (), left
                room = capacity
            else:
                uses = room // size
                filling, many = open_[room].pop()
            full = min(many, left // uses)
            rest = left - full * uses if full < many else 0
            for n, u in ((full, uses), (1 if rest else 0, rest)):
                if n:
                    open_.setdefault(room - u * size, []).append([(*filling, (size, u)), n])
            untouched = many - full - (1 if rest else 0)
            if room < capacity and untouched:
                open_[room].append([filling, untouched])
            left -= full * uses + rest
    return [(f, n) for groups in open_.values() for f, n in groups]


def _reach(counts: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Lengths left, ascending, and after each the sums that those up to it can make, as bits."""
    sizes, sums, now, mask = [], [], 1, (1 << capacity + 1) - 1
    for size in range(1, capacity + 1):
        many, step = min(counts[size], capacity // size), 1
        if not many:
            continue
        while many:
            take = min(step, many)
            now |= now << take * size & mask
            many, step = many - take, step * 2
        sizes.append(size)
        sums.append(now)
    return sizes, sums


def _exactly(target: int, last: int, sizes: list[int], sums: list[int], counts: list[int]) -> Iterator[Filling]:
    """The sets of lengths up to place last that sum to target, larger lengths first."""
    if not target:
        yield ()
        return
    for i in range(last, -1, -1):
        if not sums[i] >> target & 1:
            return
        for uses in range(min(counts[sizes[i]], target // sizes[i]), 0, -1):
            rest = target - uses * sizes[i]
            if not rest:
                yield ((sizes[i], uses),)
            elif i and sums[i - 1] >> rest & 1:
                for more in _exactly(rest, i - 1, sizes, sums, counts):
                    yield ((sizes[i], uses), *more)


def dominated(filling: Filling, slack: int, left_over: int) -> bool:
    """Whether a piece left over (lengths as bits) could replace pieces of the filling and still fit."""
    one, many = 0, 0
    for size, uses in filling:
        for _ in range(uses):
            many |= many << size | one << size
            one |= 1 << size
    spread = many
    for more in range(1, slack + 1):
        spread |= (many | one) << more
    return bool(spread & left_over)


def fillings(counts: list[int], largest: int, capacity: int, waste: int) -> Iterator[tuple[Filling | None, int]]:
    """Fillings around the largest piece with their waste, least waste first; None for a dominated one."""
    room, rest = capacity - largest, list(counts)
    rest[largest] -= 1
    sizes, sums = _reach([c if s <= room else 0 for s, c in enumerate(rest)], capacity)
    there = sum(1 << s for s in sizes)
    for slack in range(min(waste, room) + 1):
        if not sizes:
            if slack == room:
                yield ((largest, 1),), slack
            continue
        for found in _exactly(room - slack, len(sizes) - 1, sizes, sums, rest):
            used_up = sum(1 << size for size, uses in found if uses == rest[size])
            if dominated(found, slack, there & ~used_up):
                yield None, slack
                continue
            merged = {largest: 1}
            for size, uses in found:
                merged[size] = merged.get(size, 0) + uses
            yield tuple(sorted(merged.items(), reverse=True)), slack


def complete(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Fillings for counts[length] pieces of each length, in as few sequences as the search finds."""
    counts = np.asarray(counts, np.int64)
    bound, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    fewest, seen = sum(n for _, n in best), 0
    left, mass, used, path, stack = counts.tolist(), int((counts * np.arange(capacity + 1)).sum()), 0, [], []

    def branches() -> Iterator[tuple[Filling | None, int]]:
        largest = next(s for s in range(capacity, 0, -1) if left[s])
        # Fewer sequences than the incumbent leave only so many tokens empty.
        return fillings(left, largest, capacity, (fewest - 1 - used) * capacity - mass)

    if mass and fewest > bound:
        stack.append(branches())
    while stack and seen < nodes and fewest > bound:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                filling, times = path.pop()
                for size, uses in filling:
                    left[size] += uses * times
                    mass += size * uses * times
                used -= times
            continue
        seen += 1
        filling, slack = step
        if filling is None:
            continue
        times = min(left[size] // uses for size, uses in filling)
        # A filling that wastes is used only as often as the bound on waste allows.
        spare = (fewest - 1 - used) * capacity - mass
        times = min(times, spare // slack) if slack else times
        if times < 1:
            continue
        for size, uses in filling:
            left[size] -= uses * times
            mass -= size * uses * times
        used += times
        path.append((filling, times))
        if not mass:
            if used < fewest:
                fewest, best = used, list(path)
        elif used + lower_bound(np.array(left), capacity) < fewest:
            stack.append(branches())
            continue
        filling, times = path.pop()
        for size, uses in filling:
            left[size] += uses * times
            mass += size * uses * times
        used -= times
    return Plan(best, fewest, bound, seen)


# Places.


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, text: str = "text", nodes: int = NODES) -> DataFrame:
    """docs without their text, a row for each piece with piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in (*ADDED, text)]
    rows = textkit.numbered(docs.select(*names, text))
    cut = settle(cut_pieces(rows, path, f"in{len(names)}", capacity, end), "pieces")
    by_task = settle(cut.groupBy("task_at", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = by_task.groupBy("length").agg(F.sum("n").alias("n"))
    before = by_task.select("task_at", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task_at")) - F.col("n")).alias("before"))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(capacity + 1, np.int64)
        for batch in it:
            counts[batch.column("length").to_numpy()] += batch.column("n").to_numpy()
        plan = complete(counts, capacity, nodes)
        ranks, sequence = np.zeros(capacity + 1, np.int64), 0
        out = []
        for filling, times in plan.fillings:
            offset = 0
            for size, uses in filling:
                out.append((size, int(ranks[size]), uses, sequence, offset))
                ranks[size] += uses * times
                offset += uses * size
            sequence += times
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, names=["length", "rank", "uses", "sequence", "offset"])

    # One row for each length: the search is one task's at any size of the table.
    found = settle(histogram.coalesce(1).mapInArrow(search, "length long, rank long, uses long, sequence long, offset long"), "fillings").toArrow()
    kind, rank = found["length"].to_numpy(), found["rank"].to_numpy()
    order = np.lexsort((rank, kind))
    shared = spark.sparkContext.broadcast([found[c].to_numpy()[order] for c in ("length", "rank", "uses", "sequence", "offset")])
    columns = [f"in{i}" for i in range(len(names))]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, uses, sequence, offset = shared.value
        begins = np.searchsorted(length, np.arange(capacity + 2))
        for batch in it:
            size, mine = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                of = size == s
                at[of] = begins[s] + np.searchsorted(rank[begins[s] : begins[s + 1]], mine[of], "right") - 1
            within = mine - rank[at]
            named = {"sequence_id": pa.array(sequence[at] + within // uses[at]), "offset": pa.array(offset[at] + within % uses[at] * size)}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*columns, *ADDED[:4])], *named.values()], names=[*columns, *ADDED])

    ranked = cut.join(before, ["task_at", "length"]).select(*columns, *ADDED[:4], (F.col("before") + F.col("ordinal")).alias("rank"))
    schema = T.StructType([*ranked.select(*columns, *ADDED[:4]).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = ranked.mapInArrow(place, schema)
    return placed.select(*textkit.restored(names), *ADDED)
