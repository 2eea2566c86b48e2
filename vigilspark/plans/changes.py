"""Queries of the analyzers that read a change as a whole: Go flows, parse errors, budgets, context.

Their lines come from the tables' texts: each document is a change of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.operators import cache, context, rules, secrets, trust
from vigilspark.operators import goflows as G
from vigilspark.operators.rules import Rule
from vigilspark.plans import catalogue as C
from vigilspark.plans import queries as Q
from vigilspark.sources import lines
from vigilspark.streaming import arrivals


def at(items, i: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in items]), (i % len(items)).cast("int"))


# Go hunks: what opens and closes around a flow, where a value comes from, how it moves, and where it ends; documents stand between as comments.
WRAPS = (
    ("", ""), ("if ok {", "} else if no {\n\treturn\n}"), ('mux.Handle("/", func(w W, r *R) error {', "return nil\n})"), ("for i := 0; i < 3; i++ {", "}"),
    ("}\n\nfunc (s *S) next(a, b int) error {", "return nil"), ("switch x := y.(type) {\ncase int, *T:", "default:\n}"), ("select {\ncase m := <-c:\n\tlog(m)", "}"), ("func named() {", "}"), ("x := T{a: [2]int{1, 2}, f: func() {", "}}"), ("{", "}"), ("if ok {", ""), ("go func(n int) {", "}(1)"), ("again:", "goto again"),
)
COMES = ('u := c.Query("k")', 'u := r.Header.Get("X")', 'u := "fixed"', "u, err := io.ReadAll(r.Body)\nw = readBody(r)\nu = w", "var u = c.Param(1)")
MOVES = ("v := u", 'v := strings.Trim(u, " ")', 'v := "p" + u.host', "v := (u)", "v, w := 1, u\nv = w", "v := u\nv = clean()", "if v := u; v != nil {\n\tlog(v)\n}")
ENDS = ("http.Get(v)", 'exec.Command("sh", v)', "os.Open(v)", "template.New(v).Parse(v)", "res, err := http.Get(v)", "defer os.Open(v)", "p := unsafe.Pointer(&v)", "http.Get(f(v).x)\ntemplate.New(v)", "HTTP.Get(v[0])\nhttp.Get([]byte(v))", "os.Open(v\n", "os.Open(prefix + v)\nreturn http.Get(v)")
GO_PATHS = ("a/b.go", "cmd/main.go", "src/engine/x.go", "a/b_test.go", "lib/b.ts")


def go_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a hunk of Go with its lines as comments, eight documents are a diff."""
    d = F.col("doc_id")
    parts = [(at([w[0] for w in WRAPS], d), "context"), (at(COMES, d), "added"), (at(MOVES, d), "added"), (F.concat(F.lit("// "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n// "))), "context"), (at(ENDS, d), "added"), (at([w[1] for w in WRAPS], d), "context")]
    tagged = lambda text, kind: F.transform(F.split(text, "\n"), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    tagged_lines = F.flatten(F.array(*[tagged(text, kind) for text, kind in parts]))
    made = spark.read.parquet(f"{sf_dir}/documents.parquet").select(d, F.posexplode(tagged_lines).alias("line_ix", "l"))
    return made.select(F.floor(d / 8).cast("string").alias("diff_id"), (d % 8).cast("int").alias("file_ix"), d.alias("hunk_ix"), "line_ix", at(GO_PATHS, F.floor(d / 3)).alias("path"), "l.kind", "l.text", (F.col("line_ix") + 1).alias("old_no"), (F.col("line_ix") + d % 50).alias("new_no"))


def go_flow_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.go_flows(go_lines(spark, sf_dir)).select(*C._SHOWN)


# Each document is a file that imports others, each conversation a change of some of them.
IMPORTS = (("import a from './d{}'", 3, 1), ("const b = require('./d{}')", 5, 2), ("export * from '../app/d{}.ts'", 7, 3), ("import('./e{}')", 1, 1))
LIMITS = {"max_files": 4, "max_bytes": 30_000, "max_total": 24_000}
CONTEXT_RULES = (
    Rule("context.number", category="privacy", severity="medium", target="added", require=(r"[0-9]{4}",)),
    Rule("context.mail", category="privacy", severity="high", target="any", any=(r"[a-z]+@[a-z]+\.", r"(?i)password"), absent=(r"(?i)license",)),
    Rule("context.import", category="supply", severity="low", target="added", paths=("app/**",), require=(r"^import ",), near=(r"require\(",)),
)


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    first = F.concat_ws("\n", *[F.replace(F.lit(text), F.lit("{}"), (d * a + b).cast("string")) for text, a, b in IMPORTS])
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("app/d"), d.cast("string"), F.lit(".ts")).alias("path"), F.concat(first, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("content"))


def talk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation changes a file; those of users are added, the others deleted."""
    c, t = F.col("conv_id"), F.col("turn")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("turn is not null").select(c, t, "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_ix", "text"))
    kind = F.when(F.col("role") == "user", "added").otherwise("deleted")
    return turns.select(c.cast("string").alias("diff_id"), t.cast("int").alias("file_ix"), t.cast("int").alias("hunk_ix"), "line_ix", F.concat(F.lit("app/d"), (c * 7 + t).cast("string"), F.lit(".ts")).alias("path"), kind.alias("kind"), "text", F.when(kind == "deleted", F.col("line_ix") + 1).alias("old_no"), F.when(kind == "added", F.col("line_ix") + 1).alias("new_no"))


def discover_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.suggestions(talk_lines(spark, sf_dir), corpus_files(spark, sf_dir), **LIMITS).select("diff_id", "path", F.col("from").alias("origin"), "reason", "depth", "place")


def context_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = context.with_context(talk_lines(spark, sf_dir), corpus_files(spark, sf_dir), **LIMITS)
    return rules.evaluate(read.drop("context"), CONTEXT_RULES).select(*C._SHOWN)


# Headers of diffs, good and bad, and lines between; each document is a diff.
FILE_HEADS = ("diff --git a/x.go b/x.go", "diff --git a/x.go", "diff --git a/x.go b/x.go\nnew file mode 100644\n--- /dev/null\n+++ b/x.go", "no header", "diff --git a/x.go b/x.go\nindex 1..2")
HUNK_HEADS = ("@@ -1,2 +1,9 @@", "@@ -1 +1 @@ f(x)", "@@ -1", "@@ -x,2 +1 @@", "@@ -1,2 +1,y @@", "@@ -+1 +-1 @@", "@@ -1,0,3 +1,7 @@", "@@ -99999999999999999999 +1 @@", "@@ - + @@", "@@@ -1 +1 @@", "@@ -1,1 +1,12 @@")
MARKS = ("+", " ", "-", "+", "+", "+", "*")
TAILS = ("", "\\ No newline at end of file", "\\ No newline", "\ttab", "diff --git a/y.go b/y.go\nloose line\n@@ -1 +1 @@\n-a\n+b", "diff --git y", "@@ -5 +5 @@\n one")


def raw_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.concat(at(MARKS, F.floor(d / 5)), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n+")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(d.cast("string").alias("diff_id"), F.concat_ws("\n", F.lit("before"), at(FILE_HEADS, d), at(HUNK_HEADS, d), F.lit(" kept"), text, at(TAILS, d)).alias("raw"))


def diff_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.diff_errors(raw_diffs(spark, sf_dir))


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that can be read of the same diffs, counted for each hunk and side."""
    read = lines.diff_lines(raw_diffs(spark, sf_dir))
    return read.groupBy("diff_id", "file_ix", "hunk_ix", "path", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("old_no").alias("old_no"), F.max("new_no").alias("new_no"))


# Functions that promise protection, and what a change makes of the first line in them; each document is a file and a change of it.
NAMES = ("sanitizeInput", "plainName", "verifyToken", "requireMFA", "check_permission")
BODIES = ("return escape(v)", "x = 1", "claims.verify(signature)", "challenge(totp)", "owner = find(tenant)")
NOW = ("return v", "return encode(v) // sanitize", "", "x = 2", "audience expiry owner")
RADIUS = 2


def guarded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    code = F.concat(F.lit("\nfunction "), at(NAMES, d), F.lit("(v) {\n  "), at(BODIES, d), F.lit("\n}\n"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(at(("lib/a_b/", "src/", ".github/", "x/testdata/"), F.floor(d / 5)), F.lit("F-"), d.cast("string"), F.lit(".ts")).alias("path"), F.concat(F.coalesce("text", F.lit("")), code).alias("content"))


def guarded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    row = lambda i, kind, text: F.struct(F.lit(i).alias("line_ix"), F.lit(kind).alias("kind"), text.alias("text"))
    rows = F.array(row(0, "context", F.concat(F.lit("function "), at(NAMES, d), F.lit("(v) {"))), row(1, "deleted", at(BODIES, d)), row(2, "added", at(NOW, F.floor(d / 3))))
    made = spark.read.parquet(f"{sf_dir}/documents.parquet").select(d, F.explode(rows).alias("r"))
    path = F.concat(at(("lib/a_b/", "src/", ".github/", "x/testdata/"), F.floor(d / 5)), F.lit("F-"), d.cast("string"), F.lit(".ts"))
    return made.select(F.floor(d / 4).cast("string").alias("diff_id"), (d % 4).cast("int").alias("file_ix"), d.alias("hunk_ix"), "r.line_ix", path.alias("path"), "r.kind", "r.text", (d + F.col("r.line_ix")).alias("old_no"), (d + F.col("r.line_ix")).alias("new_no"))


def anchor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = guarded_files(spark, sf_dir)
    found = trust.repository_anchors(files, "lib/**").drop("expected")
    return trust.window_tokens(lines.file_lines(files), found, RADIUS).withColumn("tokens", F.array_join("tokens", ","))


def anchor_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = trust.recorded(trust.repository_anchors(guarded_files(spark, sf_dir)))
    return trust.snapshots_of(guarded_lines(spark, sf_dir), table).select(*C._SHOWN)


def versions(spark: SparkSession, sf_dir: str, later: bool, documents: DataFrame | None = None) -> DataFrame:
    """The secret scan's files, with size and time; later every seventh has another text and time, and every eleventh is gone."""
    d = F.col("doc_id")
    docs = (documents or spark.read.parquet(f"{sf_dir}/documents.parquet")).select(d, F.coalesce("text", F.lit("")).alias("text"))
    changed = (d % 7 == 0) & F.lit(later)
    line = F.replace(at(Q.SECRETS, F.when(changed, d + 3).otherwise(d)), F.lit("{n}"), (d % 9000 + 1000).cast("string"))
    files = docs.select(d, F.concat(F.lit("src/"), d.cast("string"), F.lit(".py")).alias("path"), F.concat("text", F.lit("\n"), line).alias("content"), F.when(changed, 2).otherwise(1).cast("long").alias("mod_time"))
    kept = files.filter(d % 11 != 0) if later else files
    return kept.select("path", "content", F.octet_length("content").cast("long").alias("size"), "mod_time")


def warm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan with the first one's findings at hand: findings, and whether they were made anew."""
    first, then, key = versions(spark, sf_dir, False), versions(spark, sf_dir, True), cache.key_of(["secrets"])
    none = spark.createDataFrame([], "key string, path string, size long, mod_time long, findings array<struct<id:string,rule_id:string,severity:string,confidence:string,path:string,line:int,side:string,snippet:string,entropy:double>>")
    run = lambda files: secrets.scan(files.select("path", "content"))
    kept = cache.through(first, none, key, run)[1]
    found = cache.through(then, kept, key, run)[0]
    anew = cache.split(then, kept, key)[1].select("path", F.lit(True).alias("anew"))
    return found.join(anew, "path", "left").select("id", "rule_id", "path", "line", "snippet", F.coalesce("anew", F.lit(False)).alias("anew"))


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings of a tree as a stream: the findings of the second, and how often each was made."""
    at, key = f"{sf_dir}/documents.parquet", cache.key_of(["secrets"])
    documents = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at.removesuffix("t") + "[t]")  # a glob, as the table may be one file
    listings = versions(spark, sf_dir, False, documents).unionByName(versions(spark, sf_dir, True, documents))
    run = lambda files: secrets.scan(files, keep=("size", "mod_time"))
    folder = arrivals.shared_folder(spark)
    arrivals.advance(listings, folder, key, run)
    found = arrivals.current(versions(spark, sf_dir, True), folder, key, run)
    return found.groupBy("id", "rule_id", "path", "line", "snippet", "mod_time").agg(F.count("*").alias("times"))


QUERIES = {"warm_scan": warm_scan, "stream_scan": stream_scan, "anchor_windows": anchor_windows, "anchor_review": anchor_review, "diff_errors": diff_errors, "diff_lines": diff_lines, "go_flow_review": go_flow_review, "discover_review": discover_review, "context_review": context_review}


class Duck:
    """How DuckDB writes what the transitions of the Go parser need."""

    none = "[]::VARCHAR[]"

    @staticmethod
    def one(x: str) -> str:
        return f"[{x}]"

    @staticmethod
    def init(x: str) -> str:
        return f"{x}[1:len({x}) - 1]"

    @staticmethod
    def read(x: str) -> str:
        return f"[{{{', '.join(f'{k!r}: {v}' for k, v in zip(G.READS, G._split(x)))}}}]"

    @staticmethod
    def frame(fields: dict[str, str]) -> str:
        return f"[{{{', '.join(f'{k!r}: {v}' for k, v in fields.items())}}}]"


_s = C._s
_TYPES = {"string": "VARCHAR", "int": "INT", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}
_refs = {"$": 'q."{}"', "^": 'q.stack[len(q.stack)]."{}"', "@": 'q."{}"', "%": 'q."{}"'}
_duck = lambda formula: G.render(formula, Duck, _refs)
_cast = lambda k, v: f"({v})::{_TYPES[G.FRAME[k][0]]}"
_STARTS = {k: _cast(k, _duck(v)) for k, v in G.BODY.items()} | {"ok": "true", "prev": "''", "pc": "''", "stack": Duck.frame({k: _cast(k, _duck(v)) for k, v in G.FILE.items()}), "reads": f"[]::STRUCT({', '.join(f'"{k}" {_TYPES[t]}' for k, t in G.READS.items())})[]", "unsafe": "false"}
_NEXTS = {k: _cast(k, _duck(v)) for k, (_, _, v) in G.FRAME.items()} | {k: _duck(v) for k, v in G.REST.items()}
_names = lambda fields, of="": ", ".join(f'{of}"{k}"' for k in fields)
_worth = " OR ".join("({})".format(" AND ".join(f"contains(lower(hunk), '{w}')" for w in s[1].split("."))) for s in (*G.SINKS, G.UNSAFE))
_GO_PATH = f"NOT regexp_matches(lower(path), {_s(T.ARTIFACT)}) AND regexp_matches(lower(path), '\\.go$')"
_SINK_INFO = ", ".join(f"({_s(n)}, {_s(r)}, {_s(t)}, {_s(level)})" for r, n, t, _, level in (*G.SINKS, G.UNSAFE))
#: From h(hunk_ix, hunk, first_no, path, diff_id, file_ix): gosinks, with the columns of findings.
GO_CTES = f"""gh AS MATERIALIZED (SELECT *, regexp_extract_all(hunk || chr(10) || '}}', {_s(G.TOKEN)}) AS toks FROM h WHERE {_GO_PATH} AND ({_worth})),
gt AS MATERIALIZED (SELECT id, i, lower(raw) AS t, {G.token_class("raw")} AS c FROM (SELECT hunk_ix AS id, unnest(toks) AS raw, unnest(range(len(toks))) AS i FROM gh)),
gp AS (SELECT hunk_ix AS id, 0::BIGINT AS i, {", ".join(f'{v} AS "{k}"' for k, v in _STARTS.items())} FROM gh UNION ALL
  SELECT id, i + 1, {", ".join(_NEXTS.values())} FROM (SELECT q.*, {_duck(G.ACTION)} AS a, {_duck(G.COLLECTED)} AS fl FROM (SELECT q.*, {_duck(G.NEXT_KIND)} AS nk FROM (SELECT gp.*, gt.t, gt.c FROM gp JOIN gt ON gt.id = gp.id AND gt.i = gp.i) q) q) q),
gd AS MATERIALIZED (SELECT gp.id, gp.reads, gp."unsafe" FROM gp JOIN gh ON gh.hunk_ix = gp.id AND gp.i = len(toks) WHERE ok AND kind = 'F' AND head = 'done'),
gr AS MATERIALIZED (SELECT id, r.lhs, r.names, r.sink, row_number() OVER (PARTITION BY id ORDER BY r."start") - 1 AS k FROM (SELECT id, unnest(reads) AS r FROM gd)),
gl AS (SELECT id, 0::BIGINT AS k, []::VARCHAR[] AS live, []::VARCHAR[] AS hits FROM gd UNION ALL
  SELECT id, k + 1, CASE WHEN sink <> '' THEN live WHEN dirty THEN list_distinct(live || lhs) ELSE list_filter(live, lambda v: NOT list_contains(lhs, v)) END, CASE WHEN sink <> '' AND dirty THEN hits || [sink] ELSE hits END
  FROM (SELECT gl.*, lhs, sink, len(list_filter(names, lambda n: n = '!' OR list_contains(live, n))) > 0 AS dirty FROM gl JOIN gr ON gr.id = gl.id AND gr.k = gl.k)),
ga AS (SELECT DISTINCT id, unnest(hits) AS sink FROM gl UNION SELECT id, {_s(G.UNSAFE[1])} FROM gd WHERE "unsafe"),
gi(sink, rule_id, title, severity) AS (VALUES {_SINK_INFO}),
gosinks AS (SELECT diff_id, left(sha256(rule_id || '|' || path || '|' || first_no || '|added|' || title), 16) AS id, rule_id, severity, 'medium' AS confidence, path, first_no AS line, 'added' AS side, 'semantic correlation inside diff hunk' AS snippet
  FROM ga JOIN gi USING (sink) JOIN gh ON gh.hunk_ix = ga.id QUALIFY row_number() OVER (PARTITION BY gh.diff_id, rule_id, path, first_no ORDER BY file_ix, hunk_ix) = 1)"""
_pick = lambda items, i: f"({C._list(items)})[({i}) % {len(items)} + 1]"
_GO_LINES = f"""h AS (SELECT doc_id AS hunk_ix, (doc_id // 8)::VARCHAR AS diff_id, (doc_id % 8)::INT AS file_ix, {_pick(GO_PATHS, "doc_id // 3")} AS path, doc_id % 50 AS first_no,
  coalesce({_pick([w[0] for w in WRAPS], "doc_id")}, '') || chr(10) || {_pick(COMES, "doc_id")} || chr(10) || {_pick(MOVES, "doc_id")} || chr(10) || '// ' || replace(coalesce(text, ''), chr(10), chr(10) || '// ') || chr(10) || {_pick(ENDS, "doc_id")} || chr(10) || coalesce({_pick([w[1] for w in WRAPS], "doc_id")}, '') AS hunk FROM documents)"""
SQL = {"go_flow_review": f"WITH RECURSIVE {_GO_LINES}, {GO_CTES} SELECT diff_id, id, rule_id, severity, confidence, path, line, side, snippet FROM gosinks"}

_kinds = ("imported", "required", "re-exported", "dynamically imported")


def _level(k: int) -> str:
    """The candidates of level k in order, and the fold over them, from the states s{k-1}(diff_id, frontier, total, seen, taken)."""
    return f"""
w{k} AS MATERIALIZED (SELECT s.diff_id, e.path, e.origin, e.reason, e.bytes, row_number() OVER (PARTITION BY s.diff_id ORDER BY s.pos, e.nth) AS k FROM (SELECT diff_id, unnest(frontier) AS path, unnest(range(len(frontier))) AS pos FROM s{k - 1}) s JOIN edges e ON e.origin = s.path),
r{k}(diff_id, k, total, seen, taken) AS (SELECT diff_id, 0::BIGINT, total, seen, taken FROM s{k - 1} UNION ALL
  SELECT r.diff_id, w.k, CASE WHEN ok THEN total + bytes ELSE total END, CASE WHEN ok THEN seen || [path] ELSE seen END, CASE WHEN ok THEN taken || [{{'path': path, 'origin': origin, 'reason': reason, 'depth': {k}}}] ELSE taken END
  FROM (SELECT r{k}.diff_id, w{k}.k, total, seen, taken, path, origin, reason, bytes, len(taken) < {LIMITS["max_files"]} AND NOT list_contains(seen, path) AND total + bytes <= {LIMITS["max_total"]} AS ok FROM r{k} JOIN w{k} ON w{k}.diff_id = r{k}.diff_id AND w{k}.k = r{k}.k + 1) r JOIN w{k} w USING (diff_id, k, path, origin, reason, bytes)),
s{k} AS MATERIALIZED (SELECT diff_id, list_transform(list_filter(taken, lambda x: x.depth = {k}), lambda x: x.path) AS frontier, total, seen, taken FROM r{k} QUALIFY row_number() OVER (PARTITION BY diff_id ORDER BY k DESC) = 1)"""


_CONTENT = " || chr(10) || ".join(f"replace({_s(text)}, '{{}}', (doc_id * {a} + {b})::VARCHAR)" for text, a, b in IMPORTS)
_DISCOVER = f"""talk AS (SELECT conv_id::VARCHAR AS diff_id, turn AS file_ix, 'app/d' || (conv_id * 7 + turn) || '.ts' AS path, CASE WHEN role = 'user' THEN 'added' ELSE 'deleted' END AS kind, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_ix FROM conversations WHERE turn IS NOT NULL),
files AS MATERIALIZED (SELECT doc_id, 'app/d' || doc_id || '.ts' AS path, {_CONTENT} || chr(10) || coalesce(text, '') AS content FROM documents),
sizes AS (SELECT path, strlen(content) AS bytes FROM files),
edges AS MATERIALIZED (SELECT f.path AS origin, t.path, x.nth, x.reason, t.bytes FROM files f CROSS JOIN (VALUES {", ".join(f"({i}, {a}, {b}, '{_kinds[i]}')" for i, (_, a, b) in enumerate(IMPORTS[:3]))}) x(nth, a, b, reason) JOIN sizes t ON t.path = 'app/d' || (f.doc_id * x.a + x.b) || '.ts' WHERE t.bytes <= {LIMITS["max_bytes"]}),
s0 AS MATERIALIZED (SELECT diff_id, list(path ORDER BY path) AS frontier, sum(bytes)::BIGINT AS total, list(path ORDER BY path) AS seen, []::STRUCT(path VARCHAR, origin VARCHAR, reason VARCHAR, depth INT)[] AS taken FROM (SELECT DISTINCT diff_id, path FROM talk) JOIN sizes USING (path) WHERE bytes <= 1048576 GROUP BY diff_id),{_level(1)},{_level(2)},
found AS (SELECT diff_id, x.path, x.origin, x.reason, x.depth, place::INT AS place FROM (SELECT diff_id, unnest(taken) AS x, unnest(range(len(taken))) AS place FROM s2))"""
_CONTEXT = rf"""alllines AS (SELECT diff_id, file_ix, line_ix, path, kind, text, line_ix + 1 AS no FROM talk UNION ALL
  SELECT diff_id, (SELECT max(file_ix) FROM talk t WHERE t.diff_id = x.diff_id) + place + 1, line_ix, path, 'added', text, line_ix + 1
  FROM (SELECT f.diff_id, f.place, f.path, unnest(string_split(body, chr(10))) AS text, unnest(range(len(string_split(body, chr(10))))) AS line_ix FROM found f JOIN (SELECT path, regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\n$', '') AS body FROM files) USING (path) WHERE (f.diff_id, f.path) NOT IN (SELECT diff_id, path FROM talk)) x),
hk AS (SELECT diff_id, file_ix, string_agg(text, chr(10) ORDER BY line_ix) AS hunk FROM alllines GROUP BY ALL),
hit AS (SELECT l.*, hunk, r.rule_ix, r.rule_id, r.severity, r.confidence FROM alllines l JOIN hk USING (diff_id, file_ix) JOIN (VALUES (0, 'context.number', 'medium', 'medium'), (1, 'context.mail', 'high', 'medium'), (2, 'context.import', 'low', 'high')) r(rule_ix, rule_id, severity, confidence)
  ON CASE rule_ix WHEN 0 THEN kind = 'added' AND regexp_matches(text, '[0-9]{{4}}') WHEN 1 THEN (regexp_matches(text, '[a-z]+@[a-z]+\.') OR regexp_matches(text, '(?i)password')) AND NOT regexp_matches(hunk, '(?i)license') ELSE kind = 'added' AND starts_with(text, 'import ') AND contains(hunk, 'require(') END)"""
SQL["discover_review"] = f"WITH RECURSIVE {_DISCOVER} SELECT * FROM found"
SQL["context_review"] = rf"""WITH RECURSIVE {_DISCOVER}, {_CONTEXT} SELECT diff_id, left(sha256(rule_id || '|' || path || '|' || no || '|' || kind || '|' || text), 16) AS id, rule_id, severity, confidence, path, no AS line, kind AS side, text AS snippet FROM hit
QUALIFY row_number() OVER (PARTITION BY diff_id, rule_id, path, no, kind, text ORDER BY file_ix, line_ix) = 1"""

_mix = lambda items, i: f"(['{"', '".join(x.replace("'", "''") for x in items)}'])[({i}) % {len(items)} + 1]"
_DIFFS = f"""raw AS (SELECT doc_id::VARCHAR AS diff_id, 'before' || chr(10) || {_mix(FILE_HEADS, "doc_id")} || chr(10) || {_mix(HUNK_HEADS, "doc_id")} || chr(10) || ' kept' || chr(10) || {_mix(MARKS, "doc_id // 5")} || replace(coalesce(text, ''), chr(10), chr(10) || '+') || chr(10) || {_mix(TAILS, "doc_id")} AS raw FROM documents),
v AS (SELECT diff_id, unnest(string_split(replace(raw, chr(13) || chr(10), chr(10)), chr(10))) AS value, unnest(range(len(string_split(replace(raw, chr(13) || chr(10), chr(10)), chr(10))))) AS ix FROM raw),
m0 AS (SELECT *, starts_with(value, 'diff --git ') AS is_file, starts_with(value, '@@ ') AS is_hunk, string_split_regex(trim(value, ' ' || chr(9)), '[ \t]+') AS f,
  CASE WHEN starts_with(value, '+') THEN 'added' WHEN starts_with(value, '-') THEN 'deleted' WHEN starts_with(value, ' ') THEN 'context' END AS side,
  regexp_matches(value, '^(diff --git |--- |\\+\\+\\+ |rename (from|to) |(new|deleted) file mode )') AS meta FROM v),
m AS (SELECT *, (sum(is_file::INT) OVER w)::BIGINT - 1 AS file_ix, (sum(is_hunk::INT) OVER w)::BIGINT - 1 AS hunk_ix, coalesce(max(CASE WHEN is_hunk THEN ix END) OVER w > max(CASE WHEN is_file THEN ix END) OVER w, false) AS inside, CASE WHEN NOT meta AND NOT is_hunk THEN side END AS kind FROM m0 WINDOW w AS (PARTITION BY diff_id ORDER BY ix)),
n AS (SELECT *, string_split(regexp_replace(f[2], '^-', ''), ',') AS a, string_split(regexp_replace(f[3], '^\\+', ''), ',') AS b FROM m WHERE file_ix >= 0),
r AS (SELECT *, CASE WHEN is_hunk THEN try_cast(a[1] AS BIGINT) END AS os, CASE WHEN is_hunk THEN CASE WHEN len(a) > 1 THEN try_cast(a[2] AS BIGINT) ELSE 1 END END AS om, CASE WHEN is_hunk THEN try_cast(b[1] AS BIGINT) END AS ns, CASE WHEN is_hunk THEN CASE WHEN len(b) > 1 THEN try_cast(b[2] AS BIGINT) ELSE 1 END END AS nm FROM n)"""
SQL["diff_errors"] = f"""WITH {_DIFFS},
e AS (SELECT *, CASE WHEN is_file AND len(f) < 4 THEN 'file header' WHEN is_hunk AND len(f) < 3 THEN 'hunk header' WHEN is_hunk AND (os IS NULL OR om IS NULL OR ns IS NULL OR nm IS NULL) THEN 'range'
  WHEN inside AND NOT meta AND NOT is_hunk AND kind IS NULL AND value NOT IN ('', chr(92) || ' No newline at end of file') THEN 'line prefix' END AS error FROM r),
bad AS (SELECT diff_id, ix, error, value FROM e WHERE error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY diff_id ORDER BY ix) = 1),
h AS (SELECT diff_id, hunk_ix, min(ix) AS ix, max(ix) AS until, max(om) AS om, max(nm) AS nm, count(*) FILTER (kind IN ('deleted', 'context')) AS olds, count(*) FILTER (kind IN ('added', 'context')) AS news, max(CASE WHEN is_hunk THEN f[2] || ' ' || f[3] END) AS value FROM e WHERE inside GROUP BY ALL)
SELECT diff_id, ix::INT + 1 AS line_no, error, value, true AS fatal FROM bad
UNION ALL SELECT h.diff_id, h.ix::INT + 1, 'line count', h.value, false FROM h LEFT JOIN bad USING (diff_id) WHERE (om <> olds OR nm <> news) AND (bad.ix IS NULL OR bad.ix > until)"""
SQL["diff_lines"] = f"""WITH {_DIFFS},
s AS (SELECT *, CASE WHEN is_file THEN f[4] WHEN starts_with(value, '+++ ') THEN trim(substr(value, 5)) END AS p FROM r),
t AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY diff_id, file_ix ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS path, max(os) OVER g AS o0, max(ns) OVER g AS n0,
  count(*) FILTER (kind IN ('deleted', 'context')) OVER (g ORDER BY ix) AS od, count(*) FILTER (kind IN ('added', 'context')) OVER (g ORDER BY ix) AS nd FROM s WINDOW g AS (PARTITION BY diff_id, file_ix, hunk_ix))
SELECT diff_id, file_ix, hunk_ix, coalesce(regexp_replace(regexp_replace(path, '^a/', ''), '^b/', ''), '') AS path, kind, count(*) AS n, sum(length(substr(value, 2)))::BIGINT AS chars, min(CASE WHEN kind <> 'added' THEN o0 + od - 1 END)::INT AS old_no, max(CASE WHEN kind <> 'deleted' THEN n0 + nd - 1 END)::INT AS new_no
FROM t WHERE inside AND kind IS NOT NULL AND o0 IS NOT NULL AND n0 IS NOT NULL GROUP BY ALL"""

_INTENT_OF = {n: next((x for x in trust.INTENTS if any(w in n.lower() for w in x[0])), None) for n in NAMES}
_GUARDS = ", ".join(f"({i}, {_s(n)}, {_s(BODIES[i])}, {_s(x[1]) if x else 'NULL'}, {_s(x[2]) if x else 'NULL'}, {C._list(x[3]) if x else '[]'})" for i, (n, x) in enumerate(_INTENT_OF.items()))
#: Of each document: its file's path and lines before the function, the function's name and intent.
_GUARDED = f"""gn(k, name, body, category, severity, need) AS (VALUES {_GUARDS}),
gf AS (SELECT doc_id, {_pick(("lib/a_b/", "src/", ".github/", "x/testdata/"), "doc_id // 5")} || 'F-' || doc_id || '.ts' AS path, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS said, gn.* FROM documents JOIN gn ON doc_id % {len(NAMES)} = k),
ga AS (SELECT *, name AS anchor, len(said) + 1 AS line_no FROM gf WHERE category IS NOT NULL AND NOT starts_with(path, '.git') AND NOT contains(path, '/testdata/'))"""
SQL["anchor_windows"] = f"""WITH {_GUARDED}, w AS (SELECT *, array_to_string(said[greatest(len(said) - {RADIUS - 1}, 1):], chr(10)) || chr(10) || 'function ' || name || '(v) {{' || chr(10) || body || chr(10) || '}}' AS near FROM ga WHERE starts_with(path, 'lib'))
SELECT path, line_no::INT AS line_no, anchor AS name, category, severity, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(near, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: lower(t)), lambda t: length(t) > 1))), ',') AS tokens FROM w"""
SQL["anchor_review"] = f"""WITH {_GUARDED}, s AS (SELECT *, regexp_replace(lower(path || '.' || anchor), '[/_-]', '.', 'g') AS rule_id, lower(CASE WHEN contains(lower(body), lower(anchor)) THEN '' ELSE body END) AS gone, lower(coalesce({_pick(NOW, "doc_id // 3")}, '')) AS come FROM ga),
f AS (SELECT *, doc_id + 1 AS line FROM s WHERE len(list_filter(need, lambda w: contains(gone, w))) > 0 AND NOT len(list_filter(need, lambda w: contains(CASE WHEN contains(come, lower(anchor)) THEN '' ELSE come END, w))) > 0)
SELECT (doc_id // 4)::VARCHAR AS diff_id, left(sha256(rule_id || '|' || path || '|' || line || '|added|' || anchor), 16) AS id, rule_id, severity, 'high' AS confidence, path, line, 'added' AS side, 'snapshot anchor: ' || anchor AS snippet FROM f"""
SQL["warm_scan"] = Q._SCAN.replace(Q._FILES, f"""f AS (SELECT doc_id, 'src/' || doc_id || '.py' AS path, coalesce(text, '') || chr(10) || replace(({Q._SECRETS})[(CASE WHEN doc_id % 7 = 0 THEN doc_id + 3 ELSE doc_id END) % {len(Q.SECRETS)} + 1], '{{n}}', (doc_id % 9000 + 1000)::VARCHAR) AS content FROM documents WHERE doc_id % 11 <> 0)""") + " SELECT id, rule_id, path, line, snippet, replace(replace(path, 'src/', ''), '.py', '')::BIGINT % 7 = 0 AS anew FROM found"
SQL["stream_scan"] = SQL["warm_scan"].replace("replace(replace(path, 'src/', ''), '.py', '')::BIGINT % 7 = 0 AS anew", "CASE WHEN replace(replace(path, 'src/', ''), '.py', '')::BIGINT % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS mod_time, 1::BIGINT AS times")
