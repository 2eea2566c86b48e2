"""Analyzers that read a hunk or a whole diff: tainted flows, signature and manifest signals, branch regressions.

One shuffle by hunk puts a hunk's lines in order; a hunk is at most a file.
Branch flags are booleans per diff, combined before they are shuffled.  Lines
with null text are not read.  All return diff_id, id, rule_id, category,
severity, confidence, path, line, side, snippet; the first of equal ids stays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.operators.rules import HUNK

# Sources, guards and sinks of tainted flows.
SOURCE = r"(?i)(query|params|param|header|cookie|body|input|request|ctx\.(query|params)|urlparam|formvalue)"
SOURCE_ASSIGN = r"(?i)\b([A-Za-z_][A-Za-z0-9_]*)\b\s*(:=|=).*(query|params|param|header|cookie|body|input|request|ctx\.(query|params)|urlparam|formvalue)"
ASSIGN = r"(?i)\b([A-Za-z_][A-Za-z0-9_]*)\b\s*(:=|=)\s*(.+)$"
GUARDS = ("authorize", "requireauth", "requirerole", "permission", "tenant", "owner", "scope", "validateredirect", "allowlist", "filepath.clean", "path.clean")
FETCH = r"(?i)(fetch\(|http\.Get\(|http\.Post\(|axios\.|requests\.(get|post)|urlopen\()"
EXEC = r"(?i)(exec\(|spawn\(|system\(|subprocess\.|sh\s+-c|bash\s+-c)"
PATH = r"(?i)(ReadFile|WriteFile|os\.Open|os\.OpenFile|filepath\.Join|path\.Join|os\.Create)"
QUERY = r"(?i)(select\b.+\bfrom\b|insert\b.+\binto\b|update\b.+\bset\b|delete\b.+\bfrom\b|fmt\.sprint|sprintf)"
LOOKUP = r"(?i)(\bfind\b|\bfirst\b|getby|get\(|\bload\b|\bselect\b|\bdelete\b|\bupdate\b)"
TEMPLATE = r"(?i)(template\.New|template\.Parse|ParseFiles\(|ParseGlob\(|ParseFS\(|render_template_string|Handlebars\.compile|ejs\.render|eval\(|new Function\()"
# Widely used package names, in the order in which a near miss is sought.
POPULAR = ("react", "express", "lodash", "axios", "requests", "flask", "django", "jsonwebtoken", "chalk", "typescript")
MANIFESTS = ("package.json", "go.mod", ".npmrc", "pip.conf", "poetry.toml")
# Rule, title, category, severity of the hunk signals; title and message of the branch rules, which their ids hash.
SIGNATURE = (
    ("crypto.alg.trusted", "Verification algorithm taken from untrusted token header", "crypto", "critical"),
    ("crypto.kid.trusted", "Key selection appears to trust unvalidated kid header data", "crypto", "high"),
    ("crypto.jku.remote", "Verification keys fetched from token-controlled metadata", "crypto", "critical"),
    ("crypto.key.confusion", "Potential HMAC and public-key confusion introduced", "crypto", "critical"),
)
SUPPLY = (
    ("supply.registry.public", "Registry source points to a broad public index", "supply", "high"),
    ("supply.version.floating", "Floating dependency version introduced", "supply", "medium"),
    ("supply.replace.remote", "Remote Go module replacement introduced", "supply", "high"),
    ("supply.typosquat", "Package name resembles a likely typosquat", "supply", "high"),
)
BRANCH = (
    ("branch.guard.regression", "Branch diff removes a guard while exposing a route", "authorization", "The diff removes an authentication or authorization guard while also adding or changing a route or handler.", ("authorize", "requireauth", "requirerole", "permission"), ("router.", "app.", "handlefunc", "get(", "post(")),
    ("branch.scope.regression", "Branch diff weakens resource scoping while adding direct lookups", "authorization", "The diff removes tenant or owner scoping while also adding direct object lookup behavior.", ("tenant", "owner", "workspace", "org_id"), ("find", "first", "get", "query")),
    ("branch.token.regression", "Branch diff removes verification while adding decode-like token usage", "token", "The diff removes a verification path and introduces decode or accept-invalid token behavior in the same branch.", ("verify", "parsewithclaims", "hmac.equal"), ("decode", "acceptinvalid", "allowunsigned")),
)


def _has(low: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def _hunks(lines: DataFrame) -> DataFrame:
    """One row per hunk: its lines in order, its text and its first line's number."""
    number = F.when(F.col("kind") == "deleted", F.col("old_no")).otherwise(F.col("new_no"))
    rows = F.sort_array(F.collect_list(F.struct("line_ix", "kind", "text", number.alias("number"))))
    grouped = lines.filter("text is not null").groupBy(*HUNK, "path").agg(rows.alias("rows"))
    return grouped.withColumns({"hunk_text": F.array_join(F.transform("rows", lambda x: x["text"]), "\n"), "first_no": F.get("rows", F.lit(0))["number"], "added": F.filter("rows", lambda x: x["kind"] == "added")})


def _first(found: DataFrame) -> DataFrame:
    rest = ["rule_id", "category", "severity", "confidence", "path", "line", "side", "snippet"]
    return found.groupBy("diff_id", "id").agg(F.min_by(F.struct(*rest), F.struct("file_ix", "hunk_ix", "line_ix", "rule_id")).alias("f")).select("diff_id", "id", "f.*")


SYNTHETIC = "semantic correlation inside diff hunk"


FOUND = "array<struct<line_ix:bigint,id:string,rule_id:string,category:string,severity:string,confidence:string,line:bigint,side:string,snippet:string,reasons:array<string>>>"


def found(rule_id: Column, category: Column, severity: Column, line: Column, snippet: Column, ident: Column, line_ix: Column | None = None, confidence: str = "medium", reasons: Column | None = None) -> Column:
    """A finding of a hunk, as a struct that all analyzers share."""
    none = F.array().cast("array<string>")
    at = F.lit(0) if line_ix is None else line_ix
    return F.struct(at.cast("long").alias("line_ix"), ident.alias("id"), rule_id.alias("rule_id"), category.alias("category"), severity.alias("severity"), F.lit(confidence).alias("confidence"), line.cast("long").alias("line"), F.lit("added").alias("side"), snippet.alias("snippet"), (none if reasons is None else reasons).alias("reasons"))


def listed(items: Sequence[Column]) -> Column:
    """Those that aren't null, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def info(when: Column, rule: str, title: str, category: Column | str, severity: Column | str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(title).alias("title"), lit(category).alias("category"), lit(severity).alias("severity")))


def synthetic(infos: Column) -> Column:
    """Findings of a hunk as a whole, at its first line, from infos."""
    return F.transform(infos, lambda r: found(r["rule_id"], r["category"], r["severity"], F.col("first_no"), F.lit(SYNTHETIC), T.identity(r["rule_id"], F.col("path"), F.col("first_no"), F.lit("added"), r["title"])))


def spread(hunks: DataFrame, findings: Column) -> DataFrame:
    """The findings of hunks as rows, of equal ids the first."""
    return _first(hunks.select(*HUNK, "path", F.explode(findings).alias("r")).select(*HUNK, "path", "r.*"))


def tainted_uses(added: Column, known: Column) -> Column:
    """For each added line (text), whether it uses a tainted name: one known in the hunk, or one that an earlier line, or itself, taints and no guard has cleaned.

    The names that are tainted so far are the state of an aggregation over the lines in order."""
    kind = "struct<live:array<string>,uses:array<boolean>>"

    def step(state: Column, line: Column) -> Column:
        text, live, low, name, right = line["text"], state["live"], line["low"], line["name"], line["right"]
        dirty = right.rlike(T.re2(SOURCE)) | F.exists(live, lambda v: F.contains(right, v))
        now = F.when(name == "", live).when(_has(right, *GUARDS), F.array_remove(live, name)).when(dirty, F.array_union(live, F.array(name))).otherwise(live)
        within = lambda names: F.exists(names, lambda v: F.contains(low, v))
        return F.transform(F.array(now), lambda n: F.struct(n.alias("live"), F.array_append(state["uses"], F.when((F.size(known) > 0) | (F.size(n) > 0), within(known) | within(n)).otherwise(text.rlike(T.re2(SOURCE)))).alias("uses")))[0]

    start = F.struct(F.array().cast("array<string>").alias("live"), F.array().cast("array<boolean>").alias("uses")).cast(kind)
    # The parts of a line are taken once, before the state asks for them many times.
    part = lambda x, k: F.when(F.contains(x["text"], F.lit("=")), F.lower(F.regexp_extract(x["text"], T.re2(ASSIGN), k))).otherwise("")
    read = F.transform(added, lambda x: F.struct(x["text"].alias("text"), F.lower(x["text"]).alias("low"), part(x, 1).alias("name"), part(x, 3).alias("right")))
    return F.aggregate(read, start, step, lambda state: state["uses"])


def flows_found() -> Column:
    """Findings of a hunk's added lines (added, hunk_text) where tainted values reach a sink."""
    low, none = F.lower("hunk_text"), F.array().cast("array<string>")
    assigned = F.regexp_extract_all("hunk_text", F.lit(T.re2(SOURCE_ASSIGN)), F.lit(1))
    names = F.array_distinct(F.transform(F.when(T.may_fit(T.folded(F.col("hunk_text")), SOURCE_ASSIGN), assigned).otherwise(none), F.lower))
    read = lambda names: F.struct(names.alias("names"), _has(low, *GUARDS).alias("guarded"), F.when(F.size(names) > 0, F.exists(names, lambda v: F.contains(low, v))).otherwise(F.col("hunk_text").rlike(T.re2(SOURCE))).alias("in_hunk"))

    def of(h: Column) -> Column:
        def tests(z: Column) -> Column:
            line = z["added"]["text"]
            hit, open_use = lambda p: line.rlike(T.re2(p)), z["uses"] & ~h["guarded"]
            rules = [
                ("semantic.ssrf.flow", "ssrf", "critical", open_use & hit(FETCH)), ("semantic.command.flow", "injection", "critical", open_use & hit(EXEC)),
                ("semantic.traversal.flow", "file", "high", open_use & hit(PATH)), ("semantic.sql.flow", "injection", "high", z["uses"] & hit(QUERY)),
                ("semantic.idor.flow", "authorization", "high", open_use & hit(LOOKUP) & ~hit(FETCH)), ("semantic.template.flow", "template", "high", h["in_hunk"] & hit(TEMPLATE)),
            ]
            # The id has no line number: a text that repeats in a file is one finding.
            return listed([F.when(test, found(F.lit(r), F.lit(c), F.lit(s), z["added"]["number"], T.trim_space(line), T.identity(F.lit(r), F.col("path"), line), z["added"]["line_ix"])) for r, c, s, test in rules])

        return F.flatten(F.transform(F.arrays_zip(F.col("added").alias("added"), tainted_uses(F.col("added"), h["names"]).alias("uses")), tests))

    # A hunk that has nothing of what sinks need is not read further.
    sinks = T.let(T.folded(F.col("hunk_text")), lambda folded: T.may_fit(folded, FETCH, EXEC, PATH, QUERY, LOOKUP, TEMPLATE))
    return F.when(sinks, T.let(names, lambda n: T.let(read(n), of))).otherwise(F.array().cast(FOUND))


def flows(lines: DataFrame) -> DataFrame:
    """Added lines where tainted values reach a sink, in code outside documents and fixtures."""
    return spread(_hunks(lines.filter(T.executable(F.col("path")))).filter(F.size("added") > 0), flows_found())


def _near_miss(token: Column) -> Column:
    """Whether a token is one edit away from a popular name, sought in order; the name itself ends the search."""
    low = F.regexp_replace(F.lower(T.trim_space(token)), "^[\"']+|[\"']+$", "")
    parts = F.split(low, "/")
    bare = F.when(low.startswith("@") & (F.size(parts) == 2), F.get(parts, F.lit(1))).otherwise(low)
    named = T.trim_space(F.regexp_replace(bare, "(?s)[ =:<>@].*$", ""))
    steps = lambda name: [F.when(name == p, False).when(F.levenshtein(name, F.lit(p)) == 1, True) for p in POPULAR]
    return T.let(named, lambda name: (name != "") & F.coalesce(*steps(name), F.lit(False)))


def signatures_found() -> Column:
    low = F.lower("hunk_text")
    tests = [_has(low, 'header["alg"]', "token.header.alg"), _has(low, 'header["kid"]', "token.header.kid"), _has(low, "jku", "jwk", "x5u") & _has(low, "http.get", "fetch(", "axios"), _has(low, "publickey") & _has(low, "hmac")]
    return synthetic(listed([info(test, r, t, c, s) for (r, t, c, s), test in zip(SIGNATURE, tests)]))


def signatures(lines: DataFrame) -> DataFrame:
    """Words of a hunk of code that together weaken signatures."""
    return spread(_hunks(lines.filter(T.executable(F.col("path")))), signatures_found())


def is_manifest(path: Column) -> Column:
    named = reduce(lambda a, b: a | b, [path.endswith(m) for m in MANIFESTS])
    return ~T.fixture(path) & ((T.language(path) == "config") | named)


def manifests_found() -> Column:
    low = F.lower("hunk_text")
    tokens = F.flatten(F.transform("added", lambda x: F.split(T.trim_space(x["text"]), '[": =><]+')))
    tests = [_has(low, "registry=https://registry.npmjs.org", "index-url = https://pypi.org/simple"), _has(low, '"latest"', '"*"', '"next"'), _has(low, "replace ") & _has(low, "github.com"), F.exists(tokens, _near_miss)]
    return synthetic(listed([info(test, r, t, c, s) for (r, t, c, s), test in zip(SUPPLY, tests)]))


def manifests(lines: DataFrame) -> DataFrame:
    """Words of a hunk of a manifest or configuration that together weaken the supply of packages."""
    return spread(_hunks(lines.filter(is_manifest(F.col("path")))), manifests_found())


def signals(lines: DataFrame) -> DataFrame:
    """signatures() and manifests()."""
    return signatures(lines).unionByName(manifests(lines))


def branches(lines: DataFrame) -> DataFrame:
    """What a diff deletes in one place and opens in another, over all its code."""
    low, any_line = F.lower("text"), lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    code = lines.filter(T.executable(F.col("path")) & F.col("kind").isin("added", "deleted"))
    flags = [(any_line((F.col("kind") == "deleted") & _has(low, *gone)) & any_line((F.col("kind") == "added") & _has(low, *come))).alias(rule.replace(".", "_")) for rule, _, _, _, gone, come in BRANCH]
    infos = [F.when(F.col(rule.replace(".", "_")), F.struct(F.lit(rule).alias("rule_id"), F.lit(c).alias("category"), F.substring(F.sha2(F.lit(rule + title + message), 256), 1, 16).alias("id"))) for rule, title, c, message, _, _ in BRANCH]
    rows = code.groupBy("diff_id").agg(*flags).withColumn("r", F.explode(F.filter(F.array(*infos), lambda x: x.isNotNull())))
    return rows.select("diff_id", "r.id", "r.rule_id", "r.category", F.lit("critical").alias("severity"), F.lit("medium").alias("confidence"), F.lit("<branch>").alias("path"), F.lit(1).alias("line"), F.lit("branch").alias("side"), F.lit("branch-level regression correlation").alias("snippet"))
