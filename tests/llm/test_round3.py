"""Centroid clustering, source divergence and packing against brute force, and their cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from vigilspark.llm import centroids, divergence, packing

# Centroids.


def lloyd(rows, k, rounds, dims, scale=256, seed="2"):
    kept = [(i, [math.floor(scale * x) if abs(x) < 2.0**53 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    at = [q for _, q in ranked[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(at))
    for _ in range(rounds):
        members = {}
        for _, q in kept:
            members.setdefault(near(q)[1], []).append(q)
        at = [[sum(x) // len(members[i]) for x in zip(*members[i])] if i in members else c for i, c in enumerate(at)]
    found = [(i, near(q)) for i, q in kept]
    inside = Counter()
    for _, (d, c) in found:
        inside[c] += d
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, fits(d), fits(inside[c]), fits(sum(inside.values())), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, (d, c) in found), key=repr)


def clustered(spark, rows, kind="array<float>", **how):
    table = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    out = centroids.cluster(table, **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_centroids_against_brute_force(spark):
    rng = random.Random(3)
    vectors = [[rng.choice([-1, 0, 0.5, 1, 1.25]) * rng.random() for _ in range(4)] for _ in range(60)]
    rows = [(i, vectors[i % 60] if i % 3 else vectors[0]) for i in range(200)] + [(7, vectors[3]), (7, vectors[3]), (8, [0.1] * 4)]
    odd = [(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [0.0] * 4), (907, [-0.0] * 4)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows + odd]
    assert clustered(spark, rows, k=6, rounds=4, dims=4) == lloyd(rows, 6, 4, 4)
    few = rows[:3]
    assert clustered(spark, few, k=6, rounds=4, dims=4) == lloyd(few, 6, 4, 4)
    assert clustered(spark, odd[:6], k=6, rounds=4, dims=4) == []


@pytest.mark.parametrize("size", [1.0, 3e5, 3e7, 1e12, 1e30])
def test_centroids_of_any_size(spark, size):
    rng = random.Random(5)
    rows = [(i, [size * rng.uniform(-1, 1) for _ in range(3)]) for i in range(40)]
    assert clustered(spark, rows, "array<double>", k=4, rounds=3, dims=3) == lloyd(rows, 4, 3, 3)


def test_centroid_digits_and_bytes():
    sums = np.array([[0, -1, 5], [1 << 39, -(1 << 40), 1 << 41], [-(1 << 100) + 3, 7, (1 << 90) - 1]], object)
    back = sum(d.astype(object) << centroids.DIGIT * i for i, d in enumerate(centroids.digits(sums)))
    assert (back == sums).all()
    x = np.array([[1, -2], [40000, 1], [-(1 << 40), 5], [-32768, 32767]], np.int64)
    for rows, got in centroids.unpack(pa.array(centroids.pack(x), pa.binary())):
        assert (got == x[rows]).all()


def test_centroids_pass_columns(spark):
    table = spark.createDataFrame([(1, [0.5, 0.25], "a", 9), (2, [0.5, 0.25], None, 8)], "vec_id long, embedding array<float>, in0 string, cluster int")
    out = centroids.cluster(table, k=2, rounds=2, dims=2)
    assert out.columns == ["vec_id", "in0", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((r.vec_id, r.in0, r.cluster) for r in out.collect()) == [(1, "a", 0), (2, None, 0)]


# Divergence.


def audited(rows, min_docs, top):
    groups, docs = {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.setdefault((lang, source), Counter()).update(found)
        docs.setdefault(lang, Counter()).update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        counts = {s: c for (of, s), c in groups.items() if of == lang}
        whole = sum(counts.values(), Counter())
        p = lambda c, n=len(kept): {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + n) for t in kept}
        q, ps = p(whole), {s: p(c) for s, c in counts.items()}
        for s in counts:
            far = lambda a, b: (a - b) * (a - b) // b
            pairs = sorted((-sum(far(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-far(ps[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    rng = random.Random(1)
    words = ["Und", "der", "Straße", "ÄRGER", "the", "THE", "x1y", "日本", "𝒳z", "It's", " ", "a-b"]
    rows = [(rng.choice(["de", "en", None, ""]), rng.choice(["s1", "s2", "S1", "é", None]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 40)))])) for _ in range(120)]
    rows += [("fr", "only", "un deux"), ("it", "a", "uno"), ("it", "b", None), ("en", "s1", "the " * 5000)] + [("en", "s2", "copy of the")] * 30
    table = spark.createDataFrame(rows, "lang string, source string, text string")
    for min_docs, top in ((3, 200), (1, 2)):
        got = sorted(tuple(r) for r in divergence.audit(table, min_docs, top).collect())
        assert got == audited(rows, min_docs, top)
    assert divergence.audit(table.limit(0)).collect() == []


def test_probability_is_exact(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    pairs = [(n, n + rng.randint(1, 10**15)) for n in [0, 1, 10**12, *[rng.randint(0, 10**14) for _ in range(50)]]]
    got = spark.createDataFrame(pairs, "n long, size long").select("n", "size", divergence.probability(F.col("n"), F.col("size")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.size for r in got)


# Packing.


def used(plan):
    total = Counter()
    for filling, times in plan.fillings:
        for size, uses in filling:
            total[size] += uses * times
    return total


def test_plans_hold_every_piece_and_reach_the_best():
    def fewest(pieces, capacity):
        best = len(pieces)

        def go(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(pieces):
                best = len(rooms)
                return
            for r in {*rooms}:
                if r >= pieces[i]:
                    rest = list(rooms)
                    rest.remove(r)
                    go(i + 1, [*rest, r - pieces[i]])
            go(i + 1, [*rooms, capacity - pieces[i]])

        pieces.sort(reverse=True)
        go(0, [])
        return best

    rng = random.Random(4)
    for trial in range(60):
        capacity = rng.choice([10, 20, 33])
        pieces = [rng.randint(1, capacity) if trial % 2 else rng.randint(capacity // 4, capacity // 2 + 1) for _ in range(rng.randint(1, 9))]
        plan = packing.complete(np.bincount(pieces, minlength=capacity + 1), capacity)
        assert used(plan) == Counter(pieces)
        assert all(sum(s * u for s, u in f) <= capacity for f, _ in plan.fillings)
        assert plan.sequences == sum(n for _, n in plan.fillings) == fewest(pieces, capacity) >= plan.bound


def test_completion_beats_best_fit_and_large_counts_are_no_more_work():
    counts = np.bincount(np.random.default_rng(1).integers(300, 600, 50), minlength=1025)
    assert packing.complete(counts).sequences < sum(n for _, n in packing.best_fit(counts, 1024))
    many = packing.complete(np.bincount(np.random.default_rng(2).integers(1, 1025, 3000), minlength=1025) * 10**9, nodes=500)
    assert len(many.fillings) < 5000 and used(many).total() == 3000 * 10**9


def test_best_fit_is_that_of_single_pieces():
    rng = random.Random(9)
    for _ in range(20):
        pieces, rooms = sorted((rng.randint(1, 100) for _ in range(200)), reverse=True), []
        for p in pieces:
            room = min((r for r in rooms if r >= p), default=None)
            if room is not None:
                rooms.remove(room)
            rooms.append((room or 100) - p)
        assert sum(n for _, n in packing.best_fit(np.bincount(pieces, minlength=101), 100)) == len(rooms)


TEXTS = ["", None, "a b", "one  two\n three  four  five", " é à  x", "a<|endoftext|> b", "don't 've 1234 'S", "日本 語　 x", "\u0085 y \x1f z \x1c q", " ".join(map(str, range(900))), "word " * 3000, "x" * 5000]


def test_encoding_in_cuts_is_that_of_whole_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(6)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(" \n\t  　\u0085abé'1.,日", k=60)) for _ in range(500)]
    encoder, got = packing.Encoder(path), []
    for _, data, rows in packing.bytes_of(pa.array(texts)):
        ids, at = encoder.encode(data, rows)
        got += [ids[a:b].tolist() for a, b in pairwise(at)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_packing_of_documents(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(8)
    rows = [(i, t, "o") for i, t in enumerate(TEXTS + ["same text"] * 40 + [" ".join(rng.choices(["ab", "c", "def"], k=rng.randint(1, 700))) for _ in range(60)])] + [(3, TEXTS[3], "o"), (None, "no id", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(5)
    out = [r.asDict() for r in packing.pack(table, path).collect()]
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        cut = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(pairwise(cut))]
    assert sorted(([r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] for r in out), key=repr) == sorted(map(list, want), key=repr)
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(places)) and sum(places[-1]) <= 1024
    assert len(held) == packing.complete(np.bincount([w[3] for w in want], minlength=1025)).sequences
    assert packing.pack(table.limit(0), path).collect() == []
