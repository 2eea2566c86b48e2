"""The registered queries of the corpus operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import bpe, centroids, divergence, linededup, mixing, neardup, packing, pii, quality, substrings, toxicity, urlfilter, vectors

CENTROIDS, ROUNDS = 40, 5
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, similarity=0.8).drop("row_key")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "left_words", "kept")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rule_table(spark, URL_RULES)).drop("url")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", "kept_words", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.9).drop("embedding")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=CENTROIDS, rounds=ROUNDS)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filters": op5_url_filters,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_embedding_neardup": op9_embedding_neardup,
    "op10_mixing": op10_mixing,
    "op11_centroids": op11_centroids,
    "op12_source_divergence": op12_source_divergence,
    "op13_best_fit_packing": op13_best_fit_packing,
}

_UPPER, _LOWER = urlfilter.UPPER, urlfilter.LOWER
_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)
_LINE = rf"regexp_replace(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g')"


def _lloyd() -> str:
    """Lloyd's rounds over all kept vectors, unrolled."""
    near = "SELECT {what} FROM (SELECT x.vec_id, x.q, c.i, list_sum(list_transform(list_zip(x.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x CROSS JOIN {c} c) GROUP BY vec_id"
    steps = [f"""
x AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS i, q AS c FROM (SELECT sha256('2:' || vec_id) AS h, q FROM x ORDER BY h LIMIT {CENTROIDS}))"""]
    for r in range(ROUNDS):
        steps.append(f"""
a{r} AS MATERIALIZED ({near.format(what="arg_min(i, (d, i)) AS i, any_value(q) AS q", c=f"c{r}")}),
m{r} AS (SELECT i, list(m ORDER BY j) AS c FROM (SELECT i, j, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT i, unnest(q) AS v, unnest(range(64)) AS j FROM a{r}) GROUP BY i, j) GROUP BY i),
c{r + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (i))""")
    steps.append(f"\nf AS ({near.format(what='vec_id, arg_min(i, (d, i)) AS i, min(d) AS d', c=f'c{ROUNDS}')})")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, f.i::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY f.i))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} c USING (i)"""


SQL: dict[str, str] = {
    "op11_centroids": _lloyd(),
    "op12_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM n WHERE n.lang = d.lang AND n.source = d.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v USING (lang)),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (g.total + g.v)::HUGEINT AS p
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v))::HUGEINT AS q
  FROM n JOIN v USING (lang) GROUP BY lang, term),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p > q),
every AS (SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term', * FROM term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op9_embedding_neardup": """
WITH RECURSIVE u AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM part LEFT JOIN n USING (vec_id)""",
    "op2_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - {substrings.WINDOW - 2})) AS pos FROM d WHERE len(words) >= {substrings.WINDOW}),
h AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + {substrings.WINDOW - 1}], ' ')) AS h FROM s),
twice AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {substrings.WINDOW})) AS pos FROM h SEMI JOIN twice USING (h)),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
k AS (SELECT w.doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY w.pos) FILTER (g.pos IS NULL) AS kept FROM w LEFT JOIN gone g USING (doc_id, pos) GROUP BY w.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op3_minhash_neardup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
part AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM part LEFT JOIN n USING (doc_id)""",
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'null') AS site, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
p AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS pos FROM d WHERE len(w) >= 5)),
again AS (SELECT doc_id, pos FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS place FROM again) GROUP BY doc_id),
l AS (SELECT doc_id, site, line, {_LINE} AS norm FROM (SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line FROM d)),
worded AS (SELECT *, length(norm) - length(replace(norm, ' ', '')) + 1 AS n FROM l WHERE norm <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
often AS (SELECT site, norm FROM worded GROUP BY site, norm HAVING count(DISTINCT doc_id) > {quality.LINE_DOCS}),
lost AS (SELECT doc_id, sum(n) AS n FROM worded SEMI JOIN often USING (site, norm) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    (len(w) - coalesce(lost.n, 0))::BIGINT AS left_words
  FROM d LEFT JOIN repeated r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, NOT base_failed AND left_words >= {quality.KEPT_SHARE}::DOUBLE * n_words AS kept FROM m""",
    "op5_url_filters": f"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(verdict, rule, host, path) AS (VALUES {_RULES}),
fits AS (
  SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS k
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (page_id)""",
    "op8_line_dedup": f"""
WITH l AS (
  SELECT doc_id, coalesce('s' || source, 'null') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
n AS (SELECT doc_id, site, pos, line, {_LINE} AS norm FROM l),
found AS (SELECT norm, min(doc_id) AS keeper FROM n WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= {linededup.MIN_SITES}),
marked AS (
  SELECT n.*, f.norm IS NOT NULL AND NOT (f.keeper = n.doc_id AND row_number() OVER (PARTITION BY n.doc_id, n.norm ORDER BY pos) = 1) AS gone
  FROM n LEFT JOIN found f USING (norm)),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(sum(CASE WHEN norm = '' THEN 0 ELSE length(norm) - length(replace(norm, ' ', '')) + 1 END) FILTER (NOT gone), 0)::BIGINT AS kept_words,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, kept_words, sha256(kept_text) AS kept_sha256 FROM kept""",
}
