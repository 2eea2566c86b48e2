"""Cases that random tables don't hold: words of equal polynomial hashes, helper columns' names, very long texts, repeated rows."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import bpe, components, linededup, mixing, neardup, pii, quality, substrings, textkit, toxicity, urlfilter, vectors


BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIR = [thue_morse(2048, "ab"), thue_morse(2048, "ba")]  # equal under every polynomial modulo 2^64 with an odd base


def test_words_of_equal_polynomials_are_told_apart(spark):
    rows = [(i, w) for i, w in enumerate(PAIR)]
    rows += [(10 + i, " ".join([w] * 34 + ["end"])) for i, w in enumerate(PAIR)]
    rows += [(20 + i, "\n".join(["own line"] * 3 + [w])) for i, w in enumerate(PAIR)]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in rows], "doc_id long, text string, source string")
    assert {r.n_removed for r in substrings.dedup(docs).collect()} == {0}
    assert all(r.component_id == r.doc_id for r in neardup.cluster(docs.filter("doc_id < 20"), k=4).collect())
    cut = {r.doc_id: r.n_removed for r in linededup.dedup(docs, min_sites=2).collect()}
    assert cut == {0: 0, 1: 0, 10: 0, 11: 0, 20: 3, 21: 4}  # the words of 0 and 1 are lines of 20 and 21, one each


def test_hashes_of_bytes():
    rng = np.random.default_rng(1)
    spans = [bytes(rng.integers(33, 127, n, dtype=np.uint8)) for n in (*range(1, 40), 255, 256, 257, 5000)]
    data = np.frombuffer(b" ".join(spans + spans), np.uint8)
    ends = np.cumsum([len(s) + 1 for s in spans + spans]) - 1
    h = textkit.byte_hashes(data, ends - [len(s) for s in spans + spans], ends)
    assert (h[: len(spans)] == h[len(spans) :]).all() and len(set(h.tolist())) == len(spans)


def test_windows_are_polynomials():
    h = np.random.default_rng(2).integers(0, 2**63, 300).astype(np.uint64)
    got = textkit.windows(h, 35)
    want = []
    for i in range(266):
        parts = [sum(int(x) % int(p) * pow(b, j, int(p)) for j, x in enumerate(h[i : i + 35])) % int(p) for p, b in textkit.PRIMES]
        want.append(parts[0] << 32 | parts[1])
    assert (got == textkit.mix(np.array(want, np.uint64))).all()


HELPERS = [
    "row_key", "uid", "key", "n", "of", "line", "lines", "line_words", "lost", "site", "host_key", "best", "rule", "hit", "slice", "place", "stack", "rows", "least", "node", "root", "row", "rid", "rid_", "v", "d", "cell", "block",
    "member", "counted", "mix_id", "f_id", "t_id", "term", "share", "base", "terms", "pii", "size", "copies", "score", "kept", "n_words", "text_in", "found_id", "component_id", "in0", "in1", "in2", "in3", "lost_id", "c_id", "m_id",
]


def test_no_helper_column_clashes(spark):
    texts = ["some words are here to be read by all of them", "some words are here to be read by all of them", None, "", "mail a@b.de and words"]
    rows = [(i, t, f"s{i % 2}", [1.0, float(i)], f"http://a.org/{i}", *["x"] * len(HELPERS)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, source string, embedding array<double>, url string, " + ", ".join(f"{h} string" for h in HELPERS)
    df = spark.createDataFrame(rows, schema).cache()
    rules = urlfilter.rule_table(spark, [("block", "org/"), ("allow", "org/"), ("allow", "a.org/"), ("block", "a.org/")])
    marks = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    for name, out, added in [
        ("substrings", substrings.dedup(df, 3), substrings.ADDED), ("neardup", neardup.dedup(df, k=4), neardup.ADDED), ("quality", quality.judge(df), ("kept", "n_words", "left_words", "text", "kept_text")),
        ("clean", quality.clean(df), ("kept", "n_words")), ("lines", linededup.dedup(df, min_sites=2), linededup.ADDED), ("urls", urlfilter.judge(df, rules), ("rule", "host", "path", "verdict")), ("pii", pii.sanitise(df), ("pii",)),
        ("toxicity", toxicity.score(df, marks), ("score",)), ("vectors", vectors.cluster(df, vec_id="doc_id"), vectors.ADDED), ("mixing", mixing.mix(df), mixing.ADDED), ("bpe", bpe.encode(df, BPE, "\\S+|\\s+"), ()),
    ]:
        assert out.count() == 5, name
        assert [c for c in df.columns if c not in added] == [c for c in out.columns if c in df.columns and c not in added], name
        assert all(r[h] == "x" for r in out.collect() for h in HELPERS if h not in added and h in out.columns), name
    judged = urlfilter.judge(df, rules).select("doc_id", F.col("rule").alias("r"), F.col("verdict").alias("v")).collect()
    assert {(r.r, r.v) for r in judged} == {("a.org/", "block")}
    assert [c for c in mixing.draw(df).columns] == df.columns



def test_two_patterns_on_the_same_ranks(spark):
    docs = spark.createDataFrame([(0, "two words")], "doc_id long, text string").coalesce(1)
    by = [bpe.encode(docs, BPE, p).first() for p in ("\\S+|\\s+", ".")]
    assert by[0].n_tokens < by[1].n_tokens == 9 and bytes(by[0].decoded) == bytes(by[1].decoded) == b"two words"


def test_empty_tables_of_urls_and_texts(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), urlfilter.rule_table(spark, [("allow", "org/")])).count() == 0
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(none).count() == 0 and pii.sanitise(none).count() == 0


def test_many_rules_of_a_host(spark):
    rng = random.Random(3)
    rules = sorted({("block" if i % 2 else "allow", "big.org/" + "".join(rng.choices("ab/", k=rng.randint(0, 7)))) for i in range(400)}, key=lambda r: r[1])
    rules = list({r: (v, r) for v, r in rules}.values())
    urls = ["http://x.big.org/" + "".join(rng.choices("ab/", k=rng.randint(0, 10))) for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in urlfilter.judge(pages, urlfilter.rule_table(spark, rules)).collect()}
    for i, u in enumerate(urls):
        fits = [r for _, r in rules if u[len("http://x.") :].startswith(r)]
        assert got[i] == (max(fits, key=len) if fits else None)


def test_twenty_thousand_addresses_in_one_text(spark):
    text = " ".join(f"word{i}x u{i}@site{i}.org" for i in range(20_000))
    docs = spark.createDataFrame([(0, text), (1, "other words"), (2, None)], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert time.time() - began < 60
    want = [(m.start(), m.end()) for m in re.finditer(r"\S+@\S+", text)]
    assert [(s.start, s.end) for s in found[0].base] == want
    assert len(found[0].terms) == 20_000 and all(text[s.start : s.end] == f"word{i}x" for i, s in enumerate(found[0].terms))


def test_markers_in_a_text_are_no_separators(spark):
    dot, gap = pii.DOT, pii.GAP
    texts = [f"1234 5678 9012 34 4111{gap}1111{gap}1111{gap}1111", f"a{dot}b@c{dot}de x@y.z", "4111 1111-1111 1111"]
    found = {r.doc_id: [(s.kind, s.start, s.end, s.value) for s in r.base] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [k for k, *_ in found[0] if k == "card"] == [] and found[1] == [("email", len(texts[1]) - 5, len(texts[1]), "x@y.z")]
    assert found[2] == [("card", 0, 19, "4111111111111111")]


@pytest.mark.parametrize("pairs", [pii.PAIRS, 4])
def test_terms_against_a_plain_count(spark, monkeypatch, pairs):
    monkeypatch.setattr(pii, "PAIRS", pairs)  # with 4, most documents are dealt to several rows
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(3, 5))) for _ in range(60)]
    people = [f"p{i}@mail.org" for i in range(12)]
    texts = []
    for i in range(80):
        words = rng.choices(vocabulary, k=rng.randint(3, 25))
        for p in rng.sample(people, rng.choice([0, 0, 1, 2])):
            words.insert(rng.randrange(len(words)), rng.choice(["", "é"]) + p)
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")  # repeated rows count once
    got = {r.doc_id: [(s.start, s.end, s.value) for s in r.terms] for r in pii.find(docs).collect()}
    term, mail = re.compile(r"[^\W\d_]\w{2,}"), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    seen, who = [set(term.findall(t.lower())) for t in texts], [{m.lower() for m in mail.findall(t)} for t in texts]
    for i, t in rows:
        want = []
        for m in term.finditer(t):
            shares = []
            for e in who[i]:
                holds = [j for j in range(len(texts)) if e in who[j]]
                both, n = sum(m[0].lower() in seen[j] for j in holds), sum(m[0].lower() in s for s in seen)
                shares.append(math.log2(both * len(texts) / (len(holds) * n)) / math.log2(len(texts) / len(holds)))
            if shares and max(shares) >= pii.GENERALISE and not any(a.start() < m.end() and m.start() < a.end() for a in mail.finditer(t)):
                want.append((m.start(), m.end(), "" if max(shares) >= pii.REMOVE else "[WORD]"))
        assert got[i] == want, t


def test_scores_against_a_plain_average():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("aeiouénrst", k=rng.randint(1, 9))) for _ in range(80)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) + (" Grimblezorp" if i % 3 == 0 else "") for i in range(300)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(300)], 1 / 3)
    texts += ["", "éé", "zzz qqq", "GRIMBLEZORP x\ty\n"]
    (chunk,) = textkit.word_chunks(pa.array(texts, pa.string()))
    for text, got in zip(texts, toxicity.scores(model, chunk)):
        logits = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", text):
            (one,) = textkit.word_chunks(pa.array([word], pa.string()))
            grams, _ = toxicity.word_grams(one)
            assert len(grams) == sum(max(0, len(word) + 2 - n + 1) for n in toxicity.GRAMS)
            known = [model.grams[g] for g in grams.tolist() if model.known[g]]
            logits += [sum(map(float, known)) / len(known)] if known else []
        z = (sum(logits) / len(logits) if logits else 0.0) + model.bias
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-5


def test_misspellings_that_training_never_saw(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(400)]
    bad = ["wretchkopf", "grumblezwerg", "flabberdonk"]
    spoil = lambda w: rng.choice([w[:k] + w[k] + w[k:] for k in range(3, 8)] + [w[:k] + "*" + w[k + 1 :] for k in (1, len(w) - 2)] + [w + "z", "x" + w])
    rows, marks = [], []
    for i in range(1500):
        words, toxic = rng.choices(vocabulary, k=rng.randint(5, 60)), i % 3 == 0
        held = spark_held(i)
        if toxic:
            word = rng.choice(bad)
            words.insert(rng.randrange(len(words)), spoil(word) if held else word)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    scored = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    held = {r.doc_id: r.predicted for r in scored.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    assert sum(held[i] for i in held if i % 3 == 0) / sum(i % 3 == 0 for i in held) > 0.9
    assert sum(held[i] == 0 for i in held if i % 3) / sum(i % 3 > 0 for i in held) > 0.97


def spark_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_repeated_and_contradictory_labels(spark):
    docs = spark.createDataFrame([(i, f"text {j} {'foul' if i % 2 else 'fair'}words") for i in range(60) for j in range(2)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(i, 1 - i % 2) for i in range(0, 20)], "doc_id long, toxic int")
    rows = lambda n, **more: sorted(map(tuple, toxicity.training_rows(docs.repartition(n), marks.repartition(n), 50, "text", "doc_id", "toxic", **more)[0].collect()))
    one, two = rows(2), rows(5)
    assert one == two and len(one) == sum(not spark_held(i) for i in range(20, 60)) and all(y == i % 2 for i, _, y in one)
    assert 0 < sum(len(t) for _, t, _ in rows(2, most_bytes=100)) <= 100
    scores = [sorted(map(tuple, toxicity.score(docs.repartition(n), marks).select("doc_id", "text", "score").collect())) for n in (1, 3)]
    assert scores[0] == scores[1]


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 3.0]), (102, [1.0, 2.0]), (103, [2.0, 4.0]), (104, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for cell in (4096, 10, 1):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.cluster(table, 0.9, cell=cell).collect()}
        assert got[100] == got[101] == (1, 100) and got[102] == got[103] == (1, 102) and got[104] == (0, 104)


def test_hubs_and_chains(spark):
    links = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(2999, 5040), (7000, 7001), (7001, 7000), (8, 8)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in (*range(3000), *range(5000, 5041))}, 7000: 7000, 7001: 7000}


def test_components_of_random_links(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", 7)
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1000 + (i * 7 + 1) % 50) for i in range(50)]
    least = {x: x for pair in links for x in pair}
    for _ in range(len(least)):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(links + links[:40], "a long, b long").repartition(5)).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert sorted((r.node, r.root) for r in got) == sorted((x, least[x]) for x in linked)
    assert components.components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def test_groups_with_failing_pairs(spark):
    """A chain of documents, each like the next and not like those further on, beside unlike ones that share most words."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(120)]
    texts = []
    for i in range(60):
        if i % 3 == 2:
            base = base[6:] + [word() for _ in range(6)]
        texts.append(" ".join(base if i % 2 else base[:-1] + [word()]))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    least = list(range(60))
    for _ in range(60):
        for i in range(60):
            least[i] = min(least[j] for j in range(60) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1024, 8):
        assert {r.doc_id: r.component_id for r in neardup.cluster(docs, k=4, block=block).collect()} == dict(enumerate(least))


def test_cleaned_texts(spark):
    rows = [(i, f"Shared  HEADER\nown words {i} " + "and more " * 6 + "\n\nshared header ", "s") for i in range(5)] + [(9, None, "s"), (10, "shared header\n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.clean(docs, line_texts=4).collect()}
    assert all(got[i].kept_text == f"own words {i} " + "and more " * 6 + "\n" for i in range(5))
    assert got[9].kept_text == "" and got[10].kept_text == "shared header\n" and not got[10].kept


def test_sources_by_code_point(spark):
    names = ["b", "a", "Z", "é", None, "ab", "_"]
    docs = spark.createDataFrame([(i * 100 + j, " ".join(["w"] * (5 + i)), s) for i, s in enumerate(names) for j in range(20)], "doc_id long, text string, source string")
    sizes = {s: 20 * (5 + i) for i, s in enumerate(names)}
    order = [*sorted((s for s in names if s is not None), key=lambda s: [ord(c) for c in s]), None]
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [[5, 2, 1][k % 3] for k in range(7)], 1.5, 2.0)))
    got = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert got == {s: pytest.approx(want[s]) for s in names}
    assert mixing.draw(docs).count() > 0
