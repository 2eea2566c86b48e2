"""Operator 7: toxicity by subword-bag embeddings and a linear softmax.

A word is the average of the vectors of its character n-grams (with its edges
as a character), a document the average of its words, and a softmax reads that
average; vectors and softmax are trained together, in numpy, so a misspelling
that training never saw still shares n-grams with the word it hides.  The
n-grams with vectors are those that documents of the two classes hold unequally
(chi-square of at least CHI, the 0.1 % level, however many rows train: 11 rows of
one class suffice where classes are of a size; chosen by an inner split of the rows
that train); other n-grams, and words that
have none with a vector, are out of the vocabulary and not averaged, so the
ordinary words of a long text don't drown the few that matter.

Training takes at most TRAIN_ROWS labelled rows of each class, those of the least
hashes, and of these as many whole texts as TRAIN_BYTES hold, in one task;
only the model comes to the driver.  Every document is scored, whole.
For scoring, vectors and softmax fold into one number per n-gram bucket: a table
of fixed size, looked up for all n-grams of a chunk of text at once.

Cases.  Null and empty texts get the score of the bias alone.  Null labels, and
ids labelled both 0 and 1, don't train; of texts of one id the one of the least
hash does; with one class or none the score is that class's share (0 with none).
Repeated rows are scored each for itself.  Other columns pass through; those
named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.llm import textkit

TRAIN_ROWS = 3000
TRAIN_BYTES = 24 << 20
CHUNK = 1 << 18  # bytes of text whose n-grams are held at once
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
DIM = 4
CHI = 10.83
EPOCHS = 120
RATE = 0.05
SHRINK = 1e-4
FOLDS = 5
ADDED = {"score": T.DoubleType(), "predicted": T.IntegerType()}
_U = np.uint64


@dataclass
class Model:
    grams: np.ndarray  # logit of each n-gram bucket
    known: np.ndarray  # whether it has a vector
    bias: float


def _folded(w: textkit.Words) -> np.ndarray:
    """The bytes with A-Z lower-cased, and white space and text ends alike."""
    data = np.where((w.data >= 0x41) & (w.data <= 0x5A), w.data + np.uint8(0x20), w.data)
    data[textkit.SPACE[w.data]] = 0x20
    return np.concatenate([np.array([0x20], np.uint8), data, np.full(max(GRAMS), 0x20, np.uint8)])


def word_grams(w: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, word by word, and each word's number of them.

    An n-gram is n characters (a character starts at each byte that doesn't
    continue one) of the word with a space at either end."""
    data = _folded(w)
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # where characters start, at offset 1 the first
    code = textkit.byte_hashes(data, heads, np.append(heads[1:], len(data)))
    first = np.searchsorted(heads, w.starts + 1) - 1
    last = np.searchsorted(heads, w.ends + 1) + 1
    length = last - first
    space = code[0]
    counts = np.stack([np.maximum(length - n + 1, 0) for n in GRAMS])
    total = counts.sum(0)
    at = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(at[-1], np.int64)
    offset = at[:-1].copy()
    for k, n in enumerate(GRAMS):
        reps = counts[k]
        word = np.repeat(np.arange(len(first)), reps)
        step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        begin = first[word] + step
        h = np.full(len(begin), n, _U)
        for j in range(n):
            c = code[begin + j]
            if j == 0:
                c = np.where(step == 0, space, c)
            if j == n - 1:
                c = np.where(step == reps[word] - 1, space, c)
            h = (h ^ c) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
        out[offset[word] + step] = (textkit.mix(h) % _U(BUCKETS)).astype(np.int64)
        offset += reps
    return out, total


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return sums[at[1:]] - sums[at[:-1]]


def scores(model: Model, w: textkit.Words) -> np.ndarray:
    """Of each text, the probability of the label 1."""
    buckets, counts = word_grams(w)
    at = np.concatenate([[0], np.cumsum(counts)])
    known = _sums(model.known[buckets], at)
    logits = _sums(model.grams[buckets], at) / np.maximum(known, 1)
    z = _sums(logits, w.at) / np.maximum(_sums(known > 0, w.at), 1) + model.bias
    # Nine places: the last ones depend on what else a batch holds.
    return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9)


class _Sums:
    """Weighted sums of rows by a list of (target, source, weight), both ways."""

    def __init__(self, target: np.ndarray, source: np.ndarray, weight: np.ndarray, targets: int, sources: int):
        self.ways = []
        for a, b, n in ((target, source, targets), (source, target, sources)):
            order = np.argsort(a, kind="stable")
            a = a[order]
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            self.ways.append((b[order].astype(np.int32), weight[order].astype(np.float32), starts, a[starts], n))

    def __call__(self, x: np.ndarray, way: int) -> np.ndarray:
        source, weight, starts, rows, n = self.ways[way]
        out = np.zeros((n, x.shape[1]), np.float32)
        if len(starts):
            for k in range(x.shape[1]):  # a column at a time holds less
                out[rows, k] = np.add.reduceat(x[:, k][source] * weight, starts)
        return out


def train(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS, dim: int = DIM, chi: float = CHI, seed: int = 3) -> Model:
    """share: of label 1 among all rows that could train, which the sample's weights restore."""
    y = np.array(labels, np.int64)
    known = np.zeros(BUCKETS, bool)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(share, 1e-9, 1 - 1e-9))
        return Model(np.zeros(BUCKETS, np.float32), known, float(np.log(p / (1 - p))))
    chunks, base = [], 0
    holds = np.zeros((2, BUCKETS))  # documents of each class with an n-gram
    for w in textkit.word_chunks(pa.array(texts, pa.string()), CHUNK):
        buckets, n = word_grams(w)
        pair = np.unique(np.repeat(textkit.row_of(w.at), n) * BUCKETS + buckets)
        for c in (0, 1):
            holds[c] += np.bincount(pair[y[base + pair // BUCKETS] == c] % BUCKETS, minlength=BUCKETS)
        base += w.n
    totals = np.bincount(y, minlength=2)[:, None]
    each = holds.sum(0) / totals.sum()
    expected = np.maximum(each * (1 - each), 1e-12) * (totals.prod() / totals.sum())
    known = (holds[1] - totals[1] * each) ** 2 / expected >= chi
    base, seen = 0, np.zeros(0, _U)
    for w in textkit.word_chunks(pa.array(texts, pa.string()), CHUNK):
        buckets, n = word_grams(w)
        at = np.concatenate([[0], np.cumsum(n)])
        has = np.flatnonzero(_sums(known[buckets], at) > 0)
        distinct, first, word = np.unique(w.hashes(fold=True)[has], return_index=True, return_inverse=True)
        v = max(1, len(distinct))
        pair, times = np.unique((base + textkit.row_of(w.at)[has]) * v + word, return_counts=True)
        new = np.flatnonzero(~np.isin(distinct, seen))  # a word's n-grams are kept once
        own = np.concatenate([np.zeros(0, np.int64), *[np.arange(at[i], at[i + 1]) for i in has[first[new]]]])
        whose = np.repeat(distinct[new], n[has[first[new]]])
        stay = known[buckets[own]]
        chunks.append(((pair // v).astype(np.int32), distinct[pair % v], times.astype(np.int32), whose[stay], buckets[own][stay].astype(np.int32)))
        seen = np.union1d(seen, distinct)
        base += w.n
        del buckets, at, has, word, pair, own, whose, w
    doc, word, often, whose, gram = (np.concatenate(x) for x in zip(*chunks))
    del chunks
    hashes, word = np.unique(word, return_inverse=True)
    word = word.astype(np.int32)
    used, gram = np.unique(gram, return_inverse=True)
    g, v = max(1, len(used)), max(1, len(hashes))
    pair, times = np.unique(np.searchsorted(hashes, whose) * g + gram, return_counts=True)
    shares = times / np.bincount(pair // g, times, v)[pair // g]
    to_words = _Sums(pair // g, pair % g, shares, len(hashes), len(used))
    shares = (often / np.bincount(doc, often, len(y))[doc]).astype(np.float32)
    to_docs = _Sums(doc, word, shares, len(y), len(hashes))
    del doc, word, often, whose, gram, pair, times, shares

    rng = np.random.default_rng(seed)
    state = [rng.normal(0, 0.1, (len(used), dim)).astype(np.float32), rng.normal(0, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)]
    state[2][:] = [np.log(1 - share), np.log(share)]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    target = np.eye(2, dtype=np.float32)[y]
    rows = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)[:, None] / len(y)
    for t in range(1, epochs + 1):
        vectors = to_docs(to_words(state[0], 0), 0)
        z = vectors @ state[1] * 10 + state[2]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - target) * rows
        gradients = [to_words(to_docs(d @ state[1].T * 10, 1), 1) + SHRINK * state[0], vectors.T @ d * 10, d.sum(0)]
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            state[i] -= RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    table = np.zeros(BUCKETS, np.float32)
    table[used] = state[0] @ (state[1][:, 1] - state[1][:, 0]) * 10
    return Model(table, known, float(state[2][1] - state[2][0]))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, text: str, doc_id: str, label: str, most_bytes: int = TRAIN_BYTES) -> tuple[DataFrame | None, float]:
    """(d_id, t, y): texts and labels of at most rows documents of each class outside the held-out fold; and the share of label 1."""
    y = F.col(label).cast("int")
    marked = labels.select(F.col(doc_id).alias("l_id"), y.alias("y")).filter(F.col("y").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    marked = marked.groupBy("l_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    counts = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = None
    for y in sorted(counts):
        picked = marked.filter(F.col("y") == y).withColumn("h", F.xxhash64("l_id")).orderBy("h", "l_id").limit(rows)
        some = picked if some is None else some.unionByName(picked)
    if some is None:
        return None, 0.0
    ids = {r.l_id: (r.h, r.y) for r in some.collect()}  # 2 * rows rows at most
    spark, kind = docs.sparkSession, marked.schema["l_id"].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("d_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    of = lambda wanted: texts.join(F.broadcast(spark.createDataFrame([(i, ids[i][1]) for i in wanted], f"d_id {kind}, y int")), "d_id")
    # Of rows of one id, the text of the least hash trains.
    one = F.struct(F.xxhash64("t").alias("h"), F.octet_length("t").alias("bytes"))
    sizes = {r.d_id: r.one for r in of(ids).groupBy("d_id").agg(F.min(one).alias("one")).collect()}
    taken, room = [], most_bytes
    for i in sorted(sizes, key=lambda i: (ids[i][0], i)):
        if sizes[i].bytes <= room:
            taken.append(i)
            room -= sizes[i].bytes
    least = F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"]
    return of(taken).groupBy("d_id", "y").agg(least.alias("t")).select("d_id", "t", "y"), counts.get(1, 0) / max(1, sum(counts.values()))


def fitted(sample: DataFrame | None, share: float) -> Model:
    """The model of a sample, trained in one task: the sample is bounded, and only the model comes to the driver."""
    none = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, bool)
    if sample is None:
        return Model(*none, -40.0)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in it if b.num_rows]
        if batches:
            rows = pa.Table.from_batches(batches).sort_by("d_id")
            model = train(rows["t"].to_pylist(), rows["y"].to_pylist(), share)
            yield pa.RecordBatch.from_arrays([pa.array([model.grams.tobytes()]), pa.array([model.known.tobytes()]), pa.array([model.bias])], names=["grams", "known", "bias"])

    made = sample.repartition(1).mapInArrow(run, "grams binary, known binary, bias double").collect()
    if not made:
        return train([], [], share)
    return Model(np.frombuffer(made[0].grams, np.float32), np.frombuffer(made[0].known, bool), made[0].bias)


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % FOLDS == 0


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """docs with score and predicted."""
    model = fitted(*training_rows(docs, labels, rows, text, doc_id, label))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*ADDED)

    def add(w: textkit.Words, _) -> list[pa.Array]:
        p = scores(shared.value, w)
        return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]

    return textkit.map_texts(kept, text, kept.columns, ADDED, add, CHUNK)
