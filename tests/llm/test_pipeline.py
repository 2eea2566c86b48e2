"""The pipeline's stages against plain versions on a small corpus; the classifier's verdicts and the mix's copies are taken as given."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
import public_tokenizers
from vigilspark.llm import bpe, linededup, mixing, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("aeioulnrstéñ", k=rng.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [None, "", "\n \n", "One line only on many sites"]
    for i in range(160):
        body = "\n".join([say(rng.randint(10, 40)) for _ in range(rng.randint(1, 3))])
        texts.append(body + ("\nOne  line ONLY on many sites" if i % 4 == 0 else "") + (" Wretchkopf grumblezwerg" if i % 5 == 0 else ""))
    base = say(150).split()
    for i in range(8):
        copy = list(base)
        copy[rng.randrange(150)] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[30], texts[30], texts[31]]
    rows = [(i, t, "en", f"site{i % 14}", len(t or "")) for i, t in enumerate(texts)]
    marks = [(i, int("Wretchkopf" in (t or ""))) for i, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    stages, docs = {"documents": spark.read.parquet(f"{at}/documents.parquet")}, spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(at)).write.parquet(f"{at}/{name}")
        stages[name] = docs = spark.read.parquet(f"{at}/{name}")
    return str(at), {name: df.collect() for name, df in stages.items()}


def test_stages(spark, corpus):
    at, got = corpus
    columns = list(got["documents"][0].asDict())
    assert all(list(got[s][0].asDict()) == columns for s in ("toxicity", "line_dedup", "minhash", "mixing"))
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)

    docs = spark.read.parquet(f"{at}/documents.parquet")
    verdict = {r.doc_id: r.predicted for r in toxicity.score(docs, spark.read.parquet(f"{at}/labels.parquet")).collect()}
    assert plain(got["toxicity"]) == plain(r for r in got["documents"] if not verdict[r.doc_id])
    foul = [r.doc_id for r in got["documents"] if "Wretchkopf" in (r.text or "")]
    assert sum(verdict[i] for i in foul) > 0.9 * len(foul) and sum(verdict.values()) < 1.1 * len(foul)
    assert any(zlib.crc32(str(i).encode()) % 5 == 0 for i in foul)

    norm = lambda line: " ".join(WORDS.findall(line.translate(FOLD)))
    sites, keeper = defaultdict(set), {}
    for r in got["toxicity"]:
        for line in (r.text or "").split("\n"):
            sites[norm(line)].add(r.source)
            keeper[norm(line)] = min(keeper.get(norm(line), r.doc_id), r.doc_id)
    want = []
    for r in got["toxicity"]:
        stay, had, lines = [], set(), (r.text or "").split("\n")
        for line in lines:
            n = norm(line)
            if not (n and len(sites[n]) >= linededup.MIN_SITES and not (keeper[n] == r.doc_id and n not in had)):
                stay.append(line)
            had.add(n)
        text = r.text if len(stay) == len(lines) else "\n".join(stay)
        if len(stay) == len(lines) or WORDS.search(text):
            want.append((r.doc_id, text, r.lang, r.source, r.n_chars if len(stay) == len(lines) else len(text)))
    assert plain(got["line_dedup"]) == sorted(want, key=repr) and any(w[4] < len(got["documents"][0].text or "x" * 99) for w in want)

    sets = {}
    for r in got["line_dedup"]:
        w = WORDS.findall((r.text or "").translate(FOLD))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {i: i for i in sets}
    for _ in range(4):
        for i in sets:
            least[i] = min([least[i], *(least[j] for j in sets if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))])
    assert plain(got["minhash"]) == plain(r for r in got["line_dedup"] if least[r.doc_id] == r.doc_id)
    assert len(got["minhash"]) < len(got["line_dedup"])

    copies = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{at}/minhash")).collect()}
    assert plain(got["mixing"]) == plain(r for r in got["minhash"] for _ in range(copies[r.doc_id]))

    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids = lambda t: ",".join(map(str, coder.encode_ordinary(t or "")))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((r.doc_id, r.source, ids(r.text), sha(ids(r.text)), sha(r.text or "")) for r in got["mixing"])
    assert Counter((r.doc_id, r.source, r.ids, r.ids_sha256, r.decoded_sha256) for r in got["byte_bpe"]) == want


def test_run_gives_the_last_stage(spark, corpus):
    at, got = corpus
    rows = corpus_pipeline.run(spark, at).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, got["byte_bpe"]))
