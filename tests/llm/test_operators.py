"""Operators 2 to 10 against brute force on small tables with nulls, empties, copies and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import linededup, mixing, neardup, pii, quality, substrings, toxicity, urlfilter, vectors

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mi", "été", "ñu") for b in ("x", "ter", "Sun", "é", "q9")]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = say(60)
    texts = [None, "", " \n\t ", "one two", "one two", "One  two", "\n\nsingle\n\n", "ends here\n"]
    for i in range(40):
        texts.append("\n".join([say(rng.randint(3, 60)) for _ in range(rng.randint(1, 6))]))
    base = say(200).split()
    for i in range(12):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(200)] = "changed"
        texts.append(" ".join(copy))
    texts += [say(10) + " " + passage + "\n" + say(5) for _ in range(6)]
    texts += ["Shared line\n" + say(30) + "\nshared  LINE \n" for _ in range(20)]
    texts += [say(20_000), "word " * 3000, texts[20], texts[20], "a b c d e a b c d e"]
    return [(i if i != 4 else 3, t, None if i % 17 == 3 else f"src{i % 5 if i % 3 else 0}", "clash", "clash") for i, t in enumerate(texts)]


ROWS = corpus()
SCHEMA = "doc_id long, text string, source string, kept string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_substrings(docs, none):
    k = 8
    words = [WORDS.findall(t or "") for _, t, *_ in ROWS]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    want = []
    for (doc_id, *_), w in zip(ROWS, words):
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        want.append((doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    cut = substrings.dedup(docs, k, slice_bytes=4000)
    assert cut.columns == ["doc_id", "text", "source", "kept", "size", "n_words", "n_removed", "kept_text"]
    assert rows_of(cut.select("doc_id", "n_words", "n_removed", "kept_text")) == sorted(want, key=repr)
    assert substrings.dedup(none).count() == 0


def test_near_copies(docs, none):
    k, sets, parent = 4, {}, {}
    for doc_id, t, *_ in ROWS:
        w = WORDS.findall((t or "").translate(FOLD))
        sets[doc_id, t] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        parent[doc_id, t] = (doc_id, t)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for a in keys:
        least[find(a)] = min(least[find(a)], a[0])
    want = sorted((i, len(sets[i, t]), least[find((i, t))], i == least[find((i, t))]) for i, t, *_ in ROWS)
    for block in (1024, 8):
        found = neardup.cluster(docs, k=4, block=block).drop("row_key")
        assert sorted(map(tuple, found.collect())) == want
    whole = neardup.dedup(docs, k=4)
    assert whole.count() == len(ROWS) and whole.columns == ["doc_id", "text", "source", "size", "n_shingles", "component_id", "kept"]
    assert neardup.cluster(none).count() == 0


def test_pruning_keeps_pairs_of_the_similarity():
    steps, rng = neardup.thresholds(0.8, neardup.MISS, 80, 16), np.random.default_rng(1)
    same = rng.random((20000, 80)) < 0.8
    assert all((same[:, :n].sum(1) >= least).mean() > 0.9995 for n, least in steps)
    assert (rng.random((20000, 80)) < 0.3)[:, :16].sum(1).max() < 17 and steps[-1][1] > 30


def test_quality(docs, none):
    texts_of, holds = defaultdict(set), defaultdict(set)
    norm = lambda line: " ".join(WORDS.findall(line.translate(FOLD)))
    for _, t, s, *_ in ROWS:
        lines = tuple(norm(x) for x in (t or "").split("\n") if norm(x))
        texts_of[s].add((lines, len("".join(WORDS.findall(t or "")))))
    for s, texts in texts_of.items():
        for text in texts:
            for line in set(text[0]):
                holds[s, line].add(text)
    want = []
    for doc_id, t, s, *_ in ROWS:
        t = t or ""
        w = WORDS.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = Counter(grams)
        repeated = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        left = sum(len(WORDS.findall(x)) for x in lines if not (len(holds[s, norm(x)]) > 3 and len(holds[s, norm(x)]) > 0.2 * len(texts_of[s])))
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        want.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), failed, left, not failed and left >= 0.9 * len(w)))
    got = quality.judge(docs, line_texts=3, line_share=0.2, kept_share=0.9).select("doc_id", *quality.MEASURES, "base_failed", "left_words", "kept")
    assert rows_of(got) == sorted(want, key=repr)
    assert quality.judge(none).count() == 0


def test_lines(docs, none):
    norm = lambda line: " ".join(WORDS.findall(line.translate(FOLD)))
    sites, keeper = defaultdict(set), {}
    for doc_id, t, s, *_ in ROWS:
        for x in (t or "").split("\n"):
            sites[norm(x)].add(s)
            keeper[norm(x)] = min(keeper.get(norm(x), doc_id), doc_id)
    want = []
    for doc_id, t, *_ in ROWS:
        stay, had = [], set()
        for x in (t or "").split("\n"):
            n = norm(x)
            gone = n and len(sites[n]) >= 3 and not (keeper[n] == doc_id and n not in had)
            had.add(n)
            stay += [] if gone else [x]
        want.append((doc_id, len((t or "").split("\n")), len((t or "").split("\n")) - len(stay), "\n".join(stay)))
    cut = linededup.dedup(docs, min_sites=3)
    assert rows_of(cut.select("doc_id", "n_lines", "n_removed", "kept_text")) == sorted(want, key=repr)
    assert linededup.dedup(none).count() == 0


def test_url_rules(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/es/old/"), ("allow", "a.example.org/es/"), ("block", "com/de/"), ("block", "com/de/")]
    urls = [None, "", "no scheme", "http://ORG", "http://x.example.org/es/old/1?q", "https://a.example.org/es/old/1#f", "https://badexample.org/es/", "http://example.com/de/x/y", "http://com/de/", "http://example.com/d", "http://Example.ORG/ES/", "x://y://z.org/", "http://org/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[4:6])], "page_id long, url string, rule string")

    def judged(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.translate(FOLD)
        fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rule_table(spark, rules), slices=3).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls + urls[4:6])}


def test_personal_data(spark):
    texts = [None, "", "a@b.com_c@d.org x..y@z..q a@b@c.de", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-11112 12345678901234", "+1 (555) 010-9999. +1-5 +12345678901234567", "é +49 30 1234567 ñ@x.y", "9" * 5000 + "@", "1 2 3 " * 4000, "a." * 4000 + "b@c", "x@" + "a." * 4000 + "b"]
    texts += [f"Zorblat wrote to bob@site.com about {w}" for w in ("it", "that", "them", "us")] + [f"nothing about {w} here" for w in ("it", "that", "them", "us")] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    good = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(re.sub(r"\D", "", m)))) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in good.items() for m in re.finditer(p, t or "") if ok(m[0]))
        assert sorted((s.start, s.kind, s.end) for s in found[i].base) == want, t[:80]
    assert [s.start for s in found[11].terms] == [0, 8]  # "Zorblat" and "wrote" are only where the address is
    assert found[16].terms == []
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(docs).collect()}
    assert clean[11] == "  to [EMAIL] about it".replace("  to", "  to") and clean[0] is None and clean[16] == texts[16]


def test_mixing(spark, docs, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    got = mixing.report(docs).collect()
    size = Counter()
    for _, t, s, *_ in ROWS:
        size[s] += len(WORDS.findall(t or ""))
    taken = Counter()
    source = {i: s for i, _, s, *_ in ROWS}
    of_size = {n: s for s, n in size.items()}
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.doc_id == 3 or r.source_size == size[source[r.doc_id]]) and r.taken in (0, r.size, 2 * r.size)
        taken[of_size[r.source_size]] += r.taken
    due = {of_size[r.source_size]: r.target for r in got}
    assert abs(sum(due.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for s, t in due.items():
        longest = max(len(WORDS.findall(x or "")) for _, x, z, *_ in ROWS if z == s)
        assert t <= 2 * size[s] + 1e-6 and abs(taken[s] - t) <= longest / 2 + 1e-6 * t
    assert rows_of(mixing.report(docs.repartition(2))) == rows_of(mixing.report(docs))
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    copies = mixing.mix(docs).agg(F.count("*"), F.sum("copies")).first()
    assert copies[0] == len(ROWS) and drawn.count() == copies[1]
    assert mixing.report(none).count() == 0
    assert mixing.targets([100, 10, 0, 50], [5, 2, 1, 5], 1.5, 2) == pytest.approx([140, 20, 0, 80], abs=40) and sum(mixing.targets([100, 10, 0, 50], [5, 2, 1, 5], 1.5, 2)) == pytest.approx(240)


def test_pivot_keeps_words_and_chances():
    rng, size = np.random.default_rng(2), np.sort(np.random.default_rng(3).integers(1, 500, 60))[::-1]
    total = np.zeros(60)
    for _ in range(3000):
        x, held = mixing.pivot(np.full(60, 0.3), size, rng)
        assert set(np.delete(x, held) if held >= 0 else x) <= {0.0, 1.0}
        assert abs((x * size).sum() - 0.3 * size.sum()) < 1e-6
        total += x
    assert np.abs(total / 3000 - 0.3).max() < 0.06


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    near = x[rng.integers(0, 60, 80)] + rng.normal(size=(80, 8)) * 0.25
    rows = [(i, v) for i, v in enumerate(np.concatenate([x, near]).tolist())]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (204, [1.0, 2.0]), (205, []), (206, x[0].tolist()), (207, (x[0] * 1e200).tolist())]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, kept string")
    ok = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j, w in ok.items() if j != i and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9} for i, v in ok.items()}
    least = {i: i for i, _ in rows}
    for _ in rows:
        for i in links:
            least[i] = min([least[i], *(least[j] for j in links[i])])
    want = sorted((i, len(links.get(i, ())), least[i], least[i] == i) for i, _ in rows)
    for cell, block in ((4096, 2048), (20, 6)):
        got = vectors.cluster(table, 0.9, cell=cell, block=block)
        assert sorted(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == want
    assert vectors.cluster(table.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words, bad = rng.choices(vocabulary, k=rng.randint(5, 120)), i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["wretchkopf", "wretchkopfs", "grumblezwerg", "Grumblezwergy"]) + rng.choice(["", "!", "x"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1001, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, marks).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    assert len(got) == 902 and all(0 <= r.score <= 1 for r in got.values())
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held for i, _ in held)
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.97
    assert {r.predicted for r in toxicity.score(docs, marks.limit(0)).collect()} == {0}
    assert toxicity.score(docs.limit(0), marks).count() == 0


def test_terms_of_rare_entities(spark):
    filler = " ".join(["plain words"] * 40)  # 480 characters
    texts = [f"the plain words of number {i % 7}" for i in range(60)]
    texts += [f"Quonkery {filler} mail ann@site.com and {filler} quonkery"] + [f"+49 30 1234567 {filler} Vimbledon the"] * 2 + ["", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[60:62], "doc_id long, text string")  # rows alike count once
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    seen = [set(re.findall(r"[^\W\d_]\w{2,}", (t or "").lower())) for t in texts]
    entities = {60: [60], 61: [61, 62], 62: [61, 62]}
    for i, t in enumerate(texts):
        want = []
        for m in re.finditer(r"[^\W\d_]\w{2,}", t or ""):
            holders = entities.get(i, [])
            if holders and not any(s.start < m.end() and m.start() < s.end for s in found[i].base):
                both, n = sum(m[0].lower() in seen[j] for j in holders), sum(m[0].lower() in x for x in seen)
                share = np.log2(both * len(texts) / (len(holders) * n)) / np.log2(len(texts) / len(holders))
                want += [(m.start(), m.end(), "" if share >= 0.95 else "[WORD]")] if share >= 0.8 else []
        assert [(s.start, s.end, s.value) for s in found[i].terms] == want
    assert [s.start for s in found[60].terms][0] == 0 and len(found[60].terms) == 4  # "quonkery" at either end, "mail" and "and"
    assert texts[61][found[61].terms[0].start :].startswith("Vimbledon")


def test_many_rare_toxic_words(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(400)]
    bad = ["".join(rng.choices("bcdfghkmpvwxyz", k=7)) for _ in range(70)]  # each in about 1.4 % of the toxic documents
    rows = []
    for i in range(3000):
        words = rng.choices(vocabulary, k=rng.randint(5, 60))
        if i % 2:
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "!", "x"]))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    held = toxicity.score(docs, marks).filter(toxicity.held_out(F.col("doc_id"))).collect()
    for y in (0, 1):
        of = [r.predicted == y for r in held if r.doc_id % 2 == y]
        assert len(of) > 200 and sum(of) / len(of) > 0.95


def test_lines_of_copies_and_of_large_hosts(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    copies = [(i, own("copy"), "a") for i in range(21)] + [(21, own("fewer"), "a")] * 30 + [(30 + i, own("twenty"), "a") for i in range(20)]
    large = [(100 + i, " ".join(f"always{j}" for j in range(12)) + "\n" + f"only {i}", "b") for i in range(21)] + [(200 + i, own(i), "b") for i in range(2000)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(copies + large, "doc_id long, text string, source string")).collect()}
    assert {i for i, kept in got.items() if not kept} == {*range(21), *range(100, 121)}
