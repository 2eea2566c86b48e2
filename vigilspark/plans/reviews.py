"""Queries of whole reviews over lines made for the catalogue and the analyzers, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.operators import analyzers, controls, findings, review, rules, trust
from vigilspark.operators.catalogue import BUILTIN
from vigilspark.plans import catalogue as C
from vigilspark.plans import changes
from vigilspark.plans.samples import SAMPLES
from vigilspark.sinks import reports


def _path_of(r: rules.Rule) -> str:
    """A path in a rule's first scope."""
    return r.paths[0].replace("**/", "app/").replace("**", "x").replace("*", "main")


#: Of each rule: (text, context, path) of its line, in variants that it should and should not find.
_GONE = "other words"
VARIANTS = [
    [(line, near or _GONE, _path_of(r), r.target) for r, (line, near, absent) in zip(BUILTIN, SAMPLES)],
    [("\t  " + line + " ", near or _GONE, _path_of(r), r.target) for r, (line, near, absent) in zip(BUILTIN, SAMPLES)],
    [(line, absent or _GONE, _path_of(r), r.target) for r, (line, near, absent) in zip(BUILTIN, SAMPLES)],
    [(line, near or _GONE, _path_of(r), "context" if r.target != "any" else "deleted") for r, (line, near, absent) in zip(BUILTIN, SAMPLES)],
    [(line, near or _GONE, "app/docs/notes.md", r.target) for r, (line, near, absent) in zip(BUILTIN, SAMPLES)],
    [(line[1:], near or _GONE, _path_of(r), r.target) for r, (line, near, absent) in zip(BUILTIN, SAMPLES)],
]
FLAT = [x for v in VARIANTS for x in v]


def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a hunk of two lines: a variant of a rule's sample, and its context."""
    e, at = F.col("event_id"), lambda k: F.get(F.array(*[F.lit(x[k]) for x in FLAT]), (F.col("event_id") % len(FLAT)).cast("int"))
    kind = F.when(at(3) == "any", "added").otherwise(at(3))
    rows = F.array(F.struct(F.lit(0).alias("at"), kind.alias("kind"), at(0).alias("text")), F.struct(F.lit(1).alias("at"), F.lit("context").alias("kind"), at(1).alias("text")))
    made = spark.read.parquet(f"{sf_dir}/events.parquet").select(e, at(2).alias("path"), F.explode(rows).alias("r"))
    number = e * 2 + F.col("r.at")
    return made.select((e % 7).cast("string").alias("diff_id"), F.lit(0).alias("file_ix"), e.alias("hunk_ix"), number.alias("line_ix"), "path", "r.kind", "r.text", number.alias("old_no"), number.alias("new_no"))


# Hunks for the analyzers: a path and four lines (a added, d deleted, c context).  Each event is one line; hunks repeat
# with {n} changed, with their sides swapped, and under other paths; eight hunks are a diff.
HUNKS = (
    ("package.json", ("c", '"dependencies": {'), ("a", '"left-pad": "1.{n}.0"'), ("a", '"postinstall": "node x{n}.js"'), ("a", '  "@corp/tool": "2.{n}",')),
    ("package.json", ("c", '"devDependencies": {'), ("a", '"evil-lib": "0.{n}"'), ("a", '\t"Other": "latest"'), ("d", '"expres": "4.{n}"')),
    (".npmrc", ("d", "registry=https://npm.corp.example/{n}"), ("a", "registry=https://registry.npmjs.org"), ("c", "x"), ("a", "always-auth=true")),
    (".npmrc", ("a", "registry = https://other{n}.example/"), ("c", "#"), ("d", "registry=https://npm.corp.example/"), ("c", "y")),
    ("src/a.go", ("c", "func VerifyToken(t string) error {"), ("d", "  claims.verify(signature{n})"), ("a", "return nil // {n}"), ("c", "}")),
    ("lib/b.ts", ("c", "function sanitizeInput(v) {"), ("d", "return escape(v{n})"), ("a", "return v{n}"), ("c", "}")),
    ("lib/b.ts", ("c", "const authorizeUser = (u) => {"), ("d", "owner = find(tenant{n})"), ("a", "owner = find(tenant) || true"), ("a", "log(u{n})")),
    ("src/c.py", ("c", "function requireMFA(u) {"), ("d", "challenge(totp{n})"), ("a", "challenge(totp, {n})"), ("c", "func other() {")),
    ("src/a.go", ("a", "nonce := make([]byte, 12)"), ("a", "ct := gcm.Seal(nil, nonce, pt{n})"), ("a", "dt := gcm.Open(nil, nonce, ct)"), ("c", "x")),
    ("lib/b.ts", ("a", "iv = random(16)"), ("a", "encrypt(iv, data{n})"), ("d", "decrypt(iv, data)"), ("a", "let a{n} = 1")),
    ("lib/b.ts", ("a", "const target = req.query.url{n}"), ("a", "  fetch(target)"), ("c", "x"), ("a", "db.find(target)")),
    ("src/c.py", ("a", "target = request.args"), ("a", "name = allowlist(target)"), ("a", "exec('ls ' + name)"), ("a", "rows = select a from b where c = target{n}")),
    ("src/c.py", ("a", "path{n} = req.params.p"), ("a", "q = path{n}"), ("a", "\tos.Open(q) "), ("a", "template.New(q)")),
    ("src/c.py", ("a", "exec(request.body{n})"), ("a", "spawn('fixed')"), ("c", "y"), ("a", "subprocess.run(body)")),
    ("lib/b.ts", ("d", "bcrypt.hash(pw, 12)"), ("a", "bcrypt.hash(pw, {n})"), ("d", "maxAttempts = 5"), ("a", "maxAttempts = {n}")),
    ("conf/app.yaml", ("d", "sameSite: 'strict'"), ("a", "  sameSite=lax "), ("d", "timeout: 5s"), ("a", "timeout: {n}m")),
    ("conf/app.yaml", ("d", "requireMFA: true"), ("a", "skipMFA() {n}"), ("d", "session maxAge: 1h"), ("a", "session maxAge: {n}d")),
    ("lib/b.ts", ("d", "requireRole(x{n})"), ("a", "router.get('/x{n}', handler)"), ("d", "verify(t)"), ("a", "jwt.decode(t)")),
    ("src/c.py", ("a", 'alg = header["alg"]'), ("a", 'key = keys[header["kid"]]'), ("a", "jwk = http.get(url{n})"), ("c", "publicKey as hmac")),
    ("go.mod", ("a", "replace x => github.com/y/x{n}"), ("a", '"requets" "*"'), ("c", "z"), ("d", "tenant where")),
)
_KINDS = {"a": "added", "d": "deleted", "c": "context"}
_SWAPPED = {"a": "deleted", "d": "added", "c": "context"}
PATHS = ("package.json", "src/a.go", "web/package.json", "lib/b.ts", ".npmrc", "src/c.py", "yarn.lock", "x/testdata/package.json", "conf/app.yaml", "docs/readme.md", "lib/d.js")
POLICY = review.Policy(
    severity="medium", fail_on="high", restricted=("lib/**", "src/a.go"), critical=("src/**",), deny_packages=("evil-*",), allow_packages=("@corp/*", "left-pad", ""), trusted_registries=("npm.corp.example",),
    snapshots=(trust.Snapshot("snapshot.verify", "src/a.go", "VerifyToken", ("verify", "signature"), "token", "critical"), trust.Snapshot("snapshot.input", "lib/**", "sanitizeInput", ("escape",), "input", "high")),
)


LINES = [(path, kinds[k], text) for kinds in (_KINDS, _SWAPPED) for path, *four in HUNKS for k, text in four]


def trust_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = F.col("event_id"), lambda items, i: F.get(F.array(*[F.lit(x) for x in items]), i.cast("int"))
    hunk, place = F.floor(e / 4), e % len(LINES)
    text = F.replace(at([x[2] for x in LINES], place), F.lit("{n}"), (F.floor(e / len(LINES)) % 9 + 4).cast("string"))
    # Every third round of hunks stands under a path of its own number instead.
    path = F.when(F.floor(e / len(LINES)) % 3 == 2, at(PATHS, hunk % len(PATHS))).otherwise(at([x[0] for x in LINES], place))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(hunk / 8).cast("string").alias("diff_id"), (hunk % 8).cast("int").alias("file_ix"), hunk.alias("hunk_ix"), e.alias("line_ix"), path.alias("path"), at([x[1] for x in LINES], place).alias("kind"), text.alias("text"), e.alias("old_no"), (e + 1).alias("new_no"))


def coverage_review(spark, sf_dir):
    return rules.evaluate(sample_lines(spark, sf_dir), BUILTIN, skip_artifacts=True).select(*C._SHOWN)


def supply_review(spark, sf_dir):
    return trust.supply(trust_lines(spark, sf_dir), POLICY.allow_packages, POLICY.deny_packages, POLICY.trusted_registries).select(*C._SHOWN)


def intent_review(spark, sf_dir):
    return trust.intents(trust_lines(spark, sf_dir)).select(*C._SHOWN)


def snapshot_review(spark, sf_dir):
    return trust.snapshots(trust_lines(spark, sf_dir), POLICY.snapshots).select(*C._SHOWN)


def nonce_review(spark, sf_dir):
    return trust.nonces(trust_lines(spark, sf_dir)).select(*C._SHOWN)


def weakening_review(spark, sf_dir):
    return rules.downgrades(trust_lines(spark, sf_dir)).select(*C._SHOWN, "key", "was", "now")


def taint_review(spark, sf_dir):
    return analyzers.flows(trust_lines(spark, sf_dir)).select(*C._SHOWN)


def full_review(spark, sf_dir):
    return review.review(trust_lines(spark, sf_dir), POLICY).select(*C._SHOWN, "stage", "zone", "base_severity", "effective_fail_on")


def review_report(spark, sf_dir):
    return review.report(trust_lines(spark, sf_dir), POLICY)[1]


def sarif_review(spark, sf_dir):
    """The results of the SARIF documents of a review under a profile, one document for each diff, read again."""
    found = review.review(trust_lines(spark, sf_dir), replace(POLICY, profile="fintech"))
    return reports.sarif_results(reports.sarif(found, controls.infos(spark), profile="fintech"))


def control_matrix(spark, sf_dir):
    """Each control with its rules, in order, and how many findings they have among the samples."""
    infos = controls.infos(spark)
    found = coverage_review(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"))
    counted = infos.join(found, F.col("id") == F.col("rule_id"), "left").select(F.explode("standards").alias("of"), F.coalesce("n", F.lit(0)).alias("n")).groupBy("of").agg(F.sum("n").alias("findings"))
    return findings.matrix(infos).join(counted, F.col("control") == F.col("of")).select("control", F.array_join("rules", ",").alias("rules"), "findings")


QUERIES = {"control_matrix": control_matrix, "coverage_review": coverage_review, "supply_review": supply_review, "intent_review": intent_review, "snapshot_review": snapshot_review, "nonce_review": nonce_review, "weakening_review": weakening_review, "taint_review": taint_review, "full_review": full_review, "review_report": review_report, "sarif_review": sarif_review}

_s, _list, _or = C._s, C._list, C._or
_FLAT = ", ".join(f"({i}, {_s(a)}, {_s(b)}, {_s(p)}, {_s(k)})" for i, (a, b, p, k) in enumerate(FLAT))
_H = "h AS (SELECT hunk_ix, string_agg(text, chr(10) ORDER BY line_ix) AS hunk, arg_min(no, line_ix) AS first_no, any_value(path) AS path, any_value(diff_id) AS diff_id, any_value(file_ix) AS file_ix FROM l GROUP BY hunk_ix)"
_SAMPLE_LINES = f"""f(ix, text, near, path, kind) AS (VALUES {_FLAT}), e AS (SELECT event_id, f.* FROM events JOIN f ON event_id % {len(FLAT)} = ix),
two AS (SELECT event_id, path, 0 AS pos, CASE kind WHEN 'any' THEN 'added' ELSE kind END AS kind, coalesce(text, '') AS text FROM e UNION ALL SELECT event_id, path, 1, 'context', coalesce(near, '') FROM e),
l AS (SELECT (event_id % 7)::VARCHAR AS diff_id, 0 AS file_ix, event_id AS hunk_ix, event_id * 2 + pos AS line_ix, path, kind, text, event_id * 2 + pos AS old_no, event_id * 2 + pos AS new_no, event_id * 2 + pos AS no FROM two), {_H}"""
_N = len(LINES)
_TRUST_LINES = f"""tl(ix, own, kind, text) AS (VALUES {", ".join(f"({i}, {_s(p)}, '{k}', {_s(t)})" for i, (p, k, t) in enumerate(LINES))}),
l AS (SELECT (event_id // 4 // 8)::VARCHAR AS diff_id, (event_id // 4 % 8)::INT AS file_ix, event_id // 4 AS hunk_ix, event_id AS line_ix, CASE WHEN event_id // {_N} % 3 = 2 THEN ({_list(PATHS)})[event_id // 4 % {len(PATHS)} + 1] ELSE own END AS path,
  kind, replace(text, '{{n}}', (event_id // {_N} % 9 + 4)::VARCHAR) AS text, event_id AS old_no, event_id + 1 AS new_no, CASE WHEN kind = 'deleted' THEN event_id ELSE event_id + 1 END AS no FROM events JOIN tl ON event_id % {_N} = ix), {_H}"""
_RULES = C._RULE_CTES
_FOUND = "diff_id, id, rule_id, severity, confidence, path, line, side, snippet"
_NOT_FIXTURE = f"NOT regexp_matches(lower(path), {_s(T.FIXTURE)})"
_SYNTH = "left(sha256(rule_id || '|' || path || '|' || first_no || '|added|' || title), 16) AS id"
_once = "QUALIFY row_number() OVER (PARTITION BY diff_id, id ORDER BY file_ix, hunk_ix) = 1"
_cases = lambda k, name: f"CASE {' '.join(f'WHEN {_or(f'lower({name})', words[0])} THEN {words[k] if isinstance(words[k], int) else _s(words[k]) if isinstance(words[k], str) else _list(words[k])}' for words in trust.INTENTS)} END"
_any = lambda text, words: f"len(list_filter({words}, lambda w: contains({text}, w))) > 0"
_hit = lambda p: f"regexp_matches(text, {_s(p)})"

_SUPPLY_CTES = f"""dl AS (SELECT *, lower(text) AS low, regexp_replace(text, '^[ \t]+|[ \t]+$', '', 'g') AS bare FROM l WHERE {_NOT_FIXTURE}),
pk AS (SELECT *, CASE WHEN kind = 'added' AND starts_with(bare, '"') AND contains(bare, ':') THEN trim(string_split(bare, ':')[1], '" ') ELSE '' END AS raw FROM dl),
pn AS (SELECT *, CASE WHEN raw IN ('dependencies', 'devDependencies', 'optionalDependencies', 'peerDependencies', 'scripts') THEN '' ELSE raw END AS pkg FROM pk),
sf AS (SELECT hunk_ix, bool_or(kind = 'deleted' AND contains(low, 'registry') AND contains(low, 'https://') AND NOT contains(low, 'registry.npmjs.org') AND NOT contains(low, 'pypi.org/simple')) AND bool_or(kind = 'added' AND contains(low, 'registry=https://registry.npmjs.org')) AS drift,
  bool_or(kind = 'added' AND contains(low, 'registry') AND NOT contains(low, 'npm.corp.example')) AS outside, bool_or(pkg <> '' AND starts_with(lower(pkg), 'evil-')) AS denied,
  bool_or(pkg <> '' AND NOT starts_with(lower(pkg), 'evil-') AND NOT starts_with(lower(pkg), '@corp/') AND lower(pkg) <> 'left-pad') AS unlisted, bool_or(pkg <> '') AS named,
  bool_or(kind = 'added' AND (contains(low, 'postinstall') OR contains(low, 'preinstall') OR contains(low, 'prepare'))) AS script FROM pn GROUP BY hunk_ix),
sh AS (SELECT h.*, sf.* EXCLUDE (hunk_ix) FROM h JOIN sf USING (hunk_ix)),
sfound AS ({" UNION ALL ".join(f"SELECT diff_id, file_ix, hunk_ix, path, first_no, {_s(r)} AS rule_id, {_s(t)} AS title, {_s(s)} AS severity FROM sh WHERE {flag}" for (r, t, s), flag in zip(trust.OF_HUNK, ("drift", "outside", "denied", "unlisted")))}),
sd AS (SELECT diff_id, bool_or(ends_with(path, 'package.json') AND (contains(lower(hunk), '"dependencies"') OR contains(lower(hunk), '"devdependencies"') OR contains(lower(hunk), '"optionaldependencies"')) AND named) AS dep, bool_or(ends_with(path, 'package.json') AND script) AS script FROM sh GROUP BY diff_id),
sl AS (SELECT diff_id, bool_or(regexp_matches(lower(path), '(package-lock\\.json|bun\\.lockb?|pnpm-lock\\.yaml|yarn\\.lock)$')) AS locked FROM l GROUP BY diff_id),
supply AS (SELECT diff_id, {_SYNTH}, rule_id, severity, 'medium' AS confidence, path, first_no AS line, 'added' AS side, '{trust.SYNTHETIC}' AS snippet FROM sfound {_once}
  {" ".join(f"UNION ALL SELECT diff_id, left(sha256({_s(r + t + m)}), 16), {_s(r)}, {_s(s)}, 'medium', '<branch>', 1, 'branch', 'branch-level regression correlation' FROM sd JOIN sl USING (diff_id) WHERE dep AND {test}" for (r, t, s, m), test in zip(trust.OF_DIFF, ("script", "NOT locked")))})"""
_INTENT_CTES = f"""an AS (SELECT *, coalesce({", ".join(f"nullif(regexp_extract(text, {_s(trust.DECLARED)}, {k}), '')" for k in range(1, 6))}) AS name FROM l WHERE {C._CODE}),
ai AS (SELECT *, {_cases(2, "name")} AS grade, {_cases(3, "name")} AS wanted, {_cases(4, "name")} AS around FROM an WHERE name IS NOT NULL),
asides AS (SELECT ai.hunk_ix, ai.line_ix, ai.grade, ai.wanted, ai.around, coalesce(string_agg(lower(x.text), chr(10)) FILTER (x.kind = 'deleted' AND NOT contains(lower(x.text), lower(name))), '') AS gone,
  coalesce(string_agg(lower(x.text), chr(10)) FILTER (x.kind = 'added' AND NOT contains(lower(x.text), lower(name))), '') AS come FROM ai JOIN l x USING (hunk_ix) WHERE ai.grade IS NOT NULL GROUP BY ALL),
ah AS (SELECT hunk_ix, arg_min(grade, line_ix) AS severity FROM asides WHERE {_any('gone', 'wanted')} AND ({_any('come', 'around')} OR NOT {_any('come', 'wanted')}) GROUP BY hunk_ix),
ax AS (SELECT h.*, severity, {_s(trust.INTENT[0])} AS rule_id, {_s(trust.INTENT[1])} AS title FROM h JOIN ah USING (hunk_ix)),
intents AS (SELECT diff_id, {_SYNTH}, rule_id, severity, 'medium' AS confidence, path, first_no AS line, 'added' AS side, '{trust.SYNTHETIC}' AS snippet FROM ax {_once})"""
_SNAPS = ", ".join(f"({i}, {_s(s.id)}, {_s(T.glob_regex(s.path))}, {_s(s.anchor)}, {_s(s.severity)}, {_list([w.lower() for w in s.require])})" for i, s in enumerate(POLICY.snapshots))
_SNAP_CTES = f"""sn(ix, rule_id, globs, anchor, severity, need) AS (VALUES {_SNAPS}),
so AS (SELECT h.diff_id, h.file_ix, h.hunk_ix, h.path, sn.*, coalesce(arg_min(x.no, x.line_ix) FILTER (x.kind <> 'context'), 1) AS no,
  coalesce(string_agg(lower(x.text), chr(10)) FILTER (x.kind = 'deleted' AND NOT contains(lower(x.text), lower(anchor))), '') AS gone, coalesce(string_agg(lower(x.text), chr(10)) FILTER (x.kind = 'added' AND NOT contains(lower(x.text), lower(anchor))), '') AS come
  FROM h JOIN sn ON regexp_matches(h.path, globs) AND contains(lower(h.hunk), lower(anchor)) JOIN l x USING (hunk_ix) GROUP BY ALL),
sq AS (SELECT * FROM so WHERE {_any('gone', 'need')} AND NOT {_any('come', 'need')} QUALIFY row_number() OVER (PARTITION BY diff_id, file_ix, ix ORDER BY hunk_ix) = 1),
snaps AS (SELECT diff_id, left(sha256(rule_id || '|' || path || '|' || no || '|added|' || anchor), 16) AS id, rule_id, severity, 'high' AS confidence, path, no AS line, 'added' AS side, 'snapshot anchor: ' || anchor AS snippet FROM sq {_once})"""
_NONCE_CTES = f"""nv AS (SELECT DISTINCT hunk_ix, name FROM (SELECT hunk_ix, lower(text) AS low, lower(regexp_extract(text, {_s(trust.NONCE_ASSIGN)}, 1)) AS name FROM l WHERE kind = 'added' AND {C._CODE})
  WHERE name <> '' AND (contains(name, 'nonce') OR starts_with(name, 'iv') OR ends_with(name, 'iv') OR contains(low, 'nonce') OR contains(low, ' iv'))),
nu AS (SELECT DISTINCT hunk_ix FROM (SELECT nv.hunk_ix, name FROM nv JOIN l USING (hunk_ix) WHERE kind = 'added' AND {_hit(trust.CIPHER_USE)} AND contains(lower(text), name) GROUP BY ALL HAVING count(*) >= 2)),
nh AS (SELECT h.*, {_s(trust.NONCE[0])} AS rule_id, {_s(trust.NONCE[1])} AS title FROM h JOIN nu USING (hunk_ix)),
nonces AS (SELECT diff_id, {_SYNTH}, rule_id, 'critical' AS severity, 'medium' AS confidence, path, first_no AS line, 'added' AS side, '{trust.SYNTHETIC}' AS snippet FROM nh {_once})"""
_DOWN = ", ".join(f"({_s(r)}, {_s(s)}, {(w == 'higher')})" for r, _, _, s, w in rules.DOWNGRADES)
_DOWN_CTES = f"""dr(rule_id, severity, up) AS (VALUES {_DOWN}),
dx AS (SELECT l.*, lower(text) AS low, regexp_replace(lower(regexp_extract(text, {_s(rules.DURATION)}, 1)), '[_.-]', '', 'g') AS tname, regexp_extract(text, {_s(rules.DURATION)}, 2) AS tv, regexp_extract(text, {_s(rules.DURATION)}, 3) AS tu,
  lower(coalesce(nullif(regexp_extract(text, {_s(rules.SAMESITE[0])}, 2), ''), regexp_extract(text, {_s(rules.SAMESITE[1])}, 2))) AS site, coalesce(nullif(regexp_extract(text, {_s(rules.BCRYPT[0])}, 2), ''), regexp_extract(text, {_s(rules.BCRYPT[1])}, 2)) AS cost,
  regexp_replace(lower(regexp_extract(text, {_s(rules.RATE_LIMIT)}, 1)), '[_.-]', '', 'g') AS rname, regexp_extract(text, {_s(rules.RATE_LIMIT)}, 2) AS rv, lower(regexp_extract(text, {_s(rules.MFA)}, 2)) AS mfa FROM l WHERE kind <> 'context'),
dy AS (SELECT *, try_cast(tv AS BIGINT) * CASE lower(tu) WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 ELSE 1 END AS ms, tname IN ('maxage', 'expiresin', 'expiration', 'expiry', 'ttl') AS life FROM dx),
dz AS (SELECT *, 'downgrade.cookie.samesite' AS rule_id, 'samesite' AS key, CASE site WHEN 'strict' THEN 3 WHEN 'lax' THEN 2 ELSE 1 END AS v, site AS shown FROM dy WHERE site <> ''
  UNION ALL SELECT *, 'downgrade.cookie.lifetime', 'lifetime', ms, tv || tu FROM dy WHERE life AND NOT contains(low, 'cache-control') AND regexp_matches(low, 'cookie|session|token|auth') UNION ALL SELECT *, 'downgrade.crypto.bcrypt', 'bcrypt', cost::BIGINT, cost FROM dy WHERE cost <> ''
  UNION ALL SELECT *, 'downgrade.auth.ratelimit', rname, rv::BIGINT, rv FROM dy WHERE rv <> '' UNION ALL SELECT *, 'downgrade.timeout', tname, ms, tv || tu FROM dy WHERE tname <> '' AND NOT life AND NOT contains(low, 'cache')
  UNION ALL SELECT *, 'downgrade.auth.mfa', 'mfa', (mfa = 'true')::BIGINT, CASE WHEN mfa = '' THEN 'optional' ELSE mfa END FROM dy WHERE mfa <> '' OR regexp_matches(low, 'skipmfa|disablemfa|mfaoptional|optionalmfa')),
dw AS (SELECT dz.*, severity, up, CASE WHEN up THEN -v ELSE v END AS strength FROM dz JOIN dr USING (rule_id)),
dg AS (SELECT diff_id, file_ix, hunk_ix, path, rule_id, key, severity, up, arg_max(v, (strength, -line_ix)) FILTER (kind = 'deleted') AS was, arg_min({{'v': v, 'shown': shown, 'text': text, 'no': new_no, 'ix': line_ix}}, (strength, line_ix)) FILTER (kind = 'added') AS a FROM dw GROUP BY ALL),
di AS (SELECT *, left(sha256(rule_id || '|' || path || '|' || a.no || '|added|' || a.shown), 16) AS id FROM dg WHERE (up AND a.v > was) OR (NOT up AND a.v < was)),
downs AS (SELECT diff_id, id, rule_id, severity, 'high' AS confidence, path, a.no AS line, 'added' AS side, regexp_replace(a.text, '^[ \t]+|[ \t]+$', '', 'g') AS snippet, key, was, a.v AS now FROM di QUALIFY row_number() OVER (PARTITION BY diff_id, id ORDER BY file_ix, hunk_ix, a.ix, rule_id, key) = 1)"""
_A = analyzers
_FLOW_CTES = f"""fa AS (SELECT l.*, row_number() OVER (PARTITION BY hunk_ix ORDER BY line_ix) AS k, lower(regexp_extract(text, {_s(_A.ASSIGN)}, 1)) AS name, lower(regexp_extract(text, {_s(_A.ASSIGN)}, 3)) AS rhs FROM l WHERE kind = 'added' AND {C._CODE}),
fs(hunk_ix, k, live) AS (SELECT DISTINCT hunk_ix, 0::BIGINT, []::VARCHAR[] FROM fa UNION ALL
  SELECT fa.hunk_ix, fa.k, CASE WHEN name = '' THEN live WHEN {_or('rhs', _A.GUARDS)} THEN list_filter(live, lambda v: v <> name)
    WHEN regexp_matches(rhs, {_s(_A.SOURCE)}) OR len(list_filter(live, lambda v: contains(rhs, v))) > 0 THEN list_distinct(list_append(live, name)) ELSE live END FROM fs JOIN fa ON fa.hunk_ix = fs.hunk_ix AND fa.k = fs.k + 1),
fn AS (SELECT hunk_ix, hunk, list_distinct(list_transform(regexp_extract_all(hunk, {_s(_A.SOURCE_ASSIGN)}, 1), lambda v: lower(v))) AS names, {_or('lower(hunk)', _A.GUARDS)} AS guarded FROM h),
fu AS (SELECT fa.*, guarded, CASE WHEN len(names) > 0 OR len(live) > 0 THEN len(list_filter(list_concat(names, live), lambda v: contains(lower(text), v))) > 0 ELSE {_hit(_A.SOURCE)} END AS used,
  CASE WHEN len(names) > 0 THEN len(list_filter(names, lambda v: contains(lower(hunk), v))) > 0 ELSE regexp_matches(hunk, {_s(_A.SOURCE)}) END AS in_hunk FROM fa JOIN fs USING (hunk_ix, k) JOIN fn USING (hunk_ix)),
fr AS (SELECT *, 'semantic.ssrf.flow' AS rule_id, 'critical' AS severity FROM fu WHERE {_hit(_A.FETCH)} AND used AND NOT guarded UNION ALL SELECT *, 'semantic.command.flow', 'critical' FROM fu WHERE {_hit(_A.EXEC)} AND used AND NOT guarded
  UNION ALL SELECT *, 'semantic.traversal.flow', 'high' FROM fu WHERE {_hit(_A.PATH)} AND used AND NOT guarded UNION ALL SELECT *, 'semantic.sql.flow', 'high' FROM fu WHERE {_hit(_A.QUERY)} AND used
  UNION ALL SELECT *, 'semantic.idor.flow', 'high' FROM fu WHERE {_hit(_A.LOOKUP)} AND NOT {_hit(_A.FETCH)} AND used AND NOT guarded UNION ALL SELECT *, 'semantic.template.flow', 'high' FROM fu WHERE {_hit(_A.TEMPLATE)} AND in_hunk),
flows AS (SELECT diff_id, left(sha256(rule_id || '|' || path || '|' || text), 16) AS id, rule_id, severity, 'medium' AS confidence, path, no AS line, 'added' AS side, regexp_replace(text, '^[ \t]+|[ \t]+$', '', 'g') AS snippet FROM fr
  QUALIFY row_number() OVER (PARTITION BY diff_id, rule_id, path, text ORDER BY file_ix, hunk_ix, line_ix) = 1)"""
_SIGNAL_CTES = f"sig AS ({C._SIGNAL_ROWS}), signals AS ({C._SIGNAL_OUT})"
_BRANCH_CTES = f"br AS ({C._BRANCH_ROWS}), branches AS ({C._BRANCH_OUT})"
_ALL = f"""WITH RECURSIVE {_TRUST_LINES}, {_RULES}, {_FLOW_CTES}, {changes.GO_CTES}, {_NONCE_CTES}, {_SIGNAL_CTES}, {_SUPPLY_CTES}, {_DOWN_CTES}, {_INTENT_CTES}, {_SNAP_CTES}, {_BRANCH_CTES},
byrule AS (SELECT {C._OUT} FROM n {C._ONCE}),
every AS (SELECT {_FOUND}, 0 AS stage FROM byrule UNION ALL SELECT {_FOUND}, 1 FROM flows UNION ALL SELECT {_FOUND}, 2 FROM gosinks UNION ALL SELECT {_FOUND}, 3 FROM nonces UNION ALL SELECT {_FOUND}, CASE WHEN rule_id LIKE 'crypto%' THEN 4 ELSE 5 END FROM signals
  UNION ALL SELECT {_FOUND}, 6 FROM supply UNION ALL SELECT {_FOUND}, 7 FROM downs UNION ALL SELECT {_FOUND}, 8 FROM intents UNION ALL SELECT {_FOUND}, 9 FROM snaps UNION ALL SELECT {_FOUND}, 10 FROM branches),
zoned AS (SELECT *, CASE WHEN starts_with(path, 'src/') THEN 'critical' WHEN starts_with(path, 'lib/') THEN 'restricted' END AS zone, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank FROM every),
moved AS (SELECT * REPLACE (least(4, rank + CASE zone WHEN 'critical' THEN 2 WHEN 'restricted' THEN 1 ELSE 0 END) AS rank) FROM zoned),
final AS (SELECT diff_id, id, rule_id, (['low', 'medium', 'high', 'critical'])[rank] AS severity, confidence, path, line::INT AS line, side, snippet, stage, zone, CASE WHEN zone IS NOT NULL THEN severity END AS base_severity,
  CASE zone WHEN 'critical' THEN 'low' WHEN 'restricted' THEN 'medium' END AS effective_fail_on FROM moved WHERE rank >= 2)"""
_only = lambda ctes, name, more="", rec="": f"WITH {rec}{_TRUST_LINES}, {ctes} SELECT {_FOUND}{more} FROM {name}"
_PAIRS = ", ".join(f"({_s(c)}, {_s(row[0])})" for row in controls.known() for c in controls.standards(row[0]))
SQL = {
    "flow_review": f"WITH RECURSIVE {C._LINES}, {_FLOW_CTES.replace('file_ix, hunk_ix', 'hunk_ix')} SELECT {_FOUND} FROM flows",
    "control_matrix": f"""WITH {_SAMPLE_LINES}, {_RULES}, found AS (SELECT {C._OUT} FROM n {C._ONCE}), pairs(control, id) AS (VALUES {_PAIRS}), c AS (SELECT rule_id, count(*) AS n FROM found GROUP BY rule_id)
SELECT control, string_agg(id, ',' ORDER BY id) AS rules, coalesce(sum(n), 0)::BIGINT AS findings FROM pairs LEFT JOIN c ON c.rule_id = pairs.id GROUP BY control""",
    "coverage_review": f"WITH {_SAMPLE_LINES}, {_RULES} SELECT {C._OUT} FROM n {C._ONCE}",
    "supply_review": _only(_SUPPLY_CTES, "supply"),
    "intent_review": _only(_INTENT_CTES, "intents"),
    "snapshot_review": _only(_SNAP_CTES, "snaps"),
    "nonce_review": _only(_NONCE_CTES, "nonces"),
    "weakening_review": _only(_DOWN_CTES, "downs", ", key, was, now"),
    "taint_review": _only(_FLOW_CTES, "flows", rec="RECURSIVE "),
    "full_review": f"{_ALL} SELECT * FROM final",
    "review_report": f"""{_ALL}, c AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT diff_id, file_ix FROM l)) AS files, count(*) AS findings, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in T.SEVERITIES)},
  coalesce(bool_or(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END >= CASE coalesce(effective_fail_on, 'high') WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END), false) AS blocked FROM final),
v AS (SELECT *, (10 * critical + 7 * high + 4 * medium + low)::DOUBLE / greatest(files, 1) AS x FROM c)
SELECT * EXCLUDE (x), floor(x * 100 + 0.5) / 100 AS value, CASE WHEN x = 0 THEN 'none' WHEN x <= 1.5 THEN 'low' WHEN x <= 3.5 THEN 'medium' WHEN x <= 6.0 THEN 'high' ELSE 'critical' END AS rating FROM v""",
    "sarif_review": f"""{_ALL}, told(rule_id, message) AS (VALUES {", ".join(f"({_s(row[0])}, {_s(controls.ADVICE[row[2]][0])})" for row in controls.known())}),
ordered AS (SELECT k.*, coalesce(message, {_s(controls.OTHER[0])}) AS message, row_number() OVER (PARTITION BY diff_id ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, path, line, rule_id, id) - 1 AS place FROM final k LEFT JOIN told USING (rule_id))
SELECT diff_id, place::INT AS place, rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, message, path, line, zone, base_severity, effective_fail_on, 'fintech' AS profile FROM ordered""",
}
