"""Analyzers of what a change does to trust: package sources and names, the intent of named functions, recorded anchors, nonces.

Like the other analyzers they read hunks, one group of at most a file, and
flags over a whole diff, combined before they are shuffled.  Policies are
settings of a run, so they are literals of the plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.operators.analyzers import SYNTHETIC, _first, _has, _hunks, found, info, listed, spread, synthetic
from vigilspark.operators.rules import HUNK
from vigilspark.sources.lines import file_lines

# Lockfiles, parts of a manifest, public registries, life-cycle words, section names that are no packages.
LOCKFILES = ("package-lock.json", "bun.lock", "bun.lockb", "pnpm-lock.yaml", "yarn.lock")
SECTIONS = ('"dependencies"', '"devdependencies"', '"optionaldependencies"')
PUBLIC = ("registry=https://registry.npmjs.org", "index-url = https://pypi.org/simple")
PUBLIC_HOSTS = ("registry.npmjs.org", "pypi.org/simple")
LIFECYCLE = ("postinstall", "preinstall", "prepare")
NOT_PACKAGES = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies", "scripts")
# Rule, title, severity of the hunk's; rule, title, severity, message of the whole diff's, which their ids hash.
OF_HUNK = (
    ("supply.registry.drift", "Private registry drifted to public registry", "critical"),
    ("supply.registry.untrusted", "Registry is outside trusted allowlist", "high"),
    ("supply.package.denied", "Dependency is denied by trust policy", "critical"),
    ("supply.package.untrusted", "Dependency falls outside package allowlist", "high"),
)
OF_DIFF = (
    ("supply.lifecycle.dependency", "Dependency addition paired with lifecycle script", "critical", "The branch adds package dependencies while also enabling install-time lifecycle scripts."),
    ("supply.lock.missing", "Dependency manifest changed without lockfile update", "high", "The branch changes dependency manifests without updating a matching lockfile."),
)
# How functions are declared; the words in names, category, severity, expected and bypassing words of each intent, in the order in which they are tried.
DECLARED = r"(?i)(?:func\s+([A-Za-z_][A-Za-z0-9_]*)|function\s+([A-Za-z_][A-Za-z0-9_]*)|const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\(|let\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\(|var\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\()"
INTENTS = (
    (("ownership", "authorize", "permission"), "authorization", "critical", ("owner", "tenant", "org", "permission", "policy", "query", "find", "verify"), ("skip", "allow", "permitall", "return", "true")),
    (("sanitize", "escape"), "input", "high", ("sanitize", "escape", "strip", "encode", "allowlist", "validate"), ("noop", "identity", "raw", "unsafe", "return")),
    (("mfa", "otp", "totp", "webauthn"), "auth", "critical", ("verify", "challenge", "totp", "otp", "webauthn", "mfa"), ("skip", "disable", "optional", "allow", "return")),
    (("token", "jwt", "validate", "verify"), "token", "high", ("verify", "signature", "issuer", "audience", "claims", "expiry", "exp", "nbf"), ("decode", "skip", "allowunsigned", "acceptinvalid", "return")),
)
INTENT = ("intent.mismatch", "Security intent no longer matches implementation")
NONCE = ("crypto.nonce.reuse", "Nonce or IV appears reused inside the diff hunk")
# Assignments, and uses of a cipher.
NONCE_ASSIGN = r"(?i)\b([A-Za-z_][A-Za-z0-9_]*)\b\s*(:=|=).*$"
CIPHER_USE = r"(?i)(seal\(|open\(|encrypt\(|decrypt\(|gcm\.|chacha20|ctr\(|cbc\()"


def package_name(line: Column) -> Column:
    """The package that a manifest's line adds, or an empty string."""
    name = lambda trimmed: F.regexp_replace(F.split(trimmed, ":", 2)[0], r'^[" ]+|[" ]+\z', "")
    named = lambda trimmed: F.when(F.startswith(trimmed, F.lit('"')), T.let(name(trimmed), lambda n: F.when(~n.isin(*NOT_PACKAGES), n).otherwise(""))).otherwise("")
    return F.when(F.contains(line, F.lit('"')) & F.contains(line, F.lit(":")), T.let(T.trim_space(line), named)).otherwise("")


def _named(name: Column, patterns: Sequence[str]) -> Column:
    """Whether a name is one of the patterns, of which a trailing * stands for anything."""
    wanted = [p for p in (w.strip().lower() for w in patterns) if p]
    low = F.lower(name)
    tests = [F.startswith(low, F.lit(p[:-1])) | (low == p) if p.endswith("*") else low == p for p in wanted]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _packages() -> Column:
    """The packages that a hunk adds."""
    return F.filter(F.transform("added", lambda x: package_name(x["text"])), lambda n: n != "")


def _some_line(kind: str, test: Callable[[Column], Column]) -> Column:
    return F.exists(F.transform(F.filter("rows", lambda x: x["kind"] == kind), lambda x: F.lower(x["text"])), test)


def supply_found(allow: Sequence[str] = (), deny: Sequence[str] = (), trusted: Sequence[str] = ()) -> Column:
    """Registries and packages of a hunk outside the policy."""
    private = _some_line("deleted", lambda t: F.contains(t, F.lit("registry")) & F.contains(t, F.lit("https://")) & ~_has(t, *PUBLIC_HOSTS))
    public = _some_line("added", lambda t: _has(t, *PUBLIC))
    outside = _some_line("added", lambda t: F.contains(t, F.lit("registry")) & ~_has(t, *[w.lower() for w in trusted])) if trusted else F.lit(False)
    denied = lambda names: F.exists(names, lambda n: _named(n, deny))
    unknown = lambda names: F.exists(names, lambda n: ~_named(n, deny) & ~_named(n, allow)) if allow else F.lit(False)
    return T.let(_packages(), lambda names: synthetic(listed([info(test, rule, title, "supply", severity) for (rule, title, severity), test in zip(OF_HUNK, (private & public, outside, denied(names), unknown(names)))])))


def adds_dependency() -> Column:
    """Whether a hunk of a manifest adds packages; whether it adds a life-cycle script; both of hunks outside fixtures."""
    return F.endswith("path", F.lit("package.json")) & _has(F.lower("hunk_text"), *SECTIONS) & (F.size(_packages()) > 0)


def adds_script() -> Column:
    return F.endswith("path", F.lit("package.json")) & _some_line("added", lambda t: _has(t, *LIFECYCLE))


def is_lockfile(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(F.lower(path), F.lit(w)) for w in LOCKFILES])


def supply_of_diff(script: Column, locked: Column) -> Column:
    """Of a diff that adds packages: (rule_id, category, severity, id) of what is wrong with it."""
    return listed([F.when(test, F.struct(F.lit(r).alias("rule_id"), F.lit("supply").alias("category"), F.lit(s).alias("severity"), F.substring(F.sha2(F.lit(r + t + m), 256), 1, 16).alias("id"))) for (r, t, s, m), test in zip(OF_DIFF, (script, ~locked))])


def supply(lines: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = (), trusted: Sequence[str] = ()) -> DataFrame:
    """Registries and packages outside the policy, per hunk; dependencies with life-cycle scripts or without a lockfile, per diff."""
    hunks = _hunks(lines.filter(~T.fixture(F.col("path"))))
    of_hunks = spread(hunks, supply_found(allow, deny, trusted))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = hunks.groupBy("diff_id").agg(any_(adds_dependency()).alias("dependency"), any_(adds_script()).alias("script")).filter("dependency")
    locks = lines.groupBy("diff_id").agg(any_(is_lockfile(F.col("path"))).alias("locked"))
    rows = flags.join(locks, "diff_id").withColumn("r", F.explode(supply_of_diff(F.col("script"), F.col("locked"))))
    return of_hunks.unionByName(rows.select("diff_id", "r.id", "r.rule_id", "r.category", "r.severity", F.lit("medium").alias("confidence"), F.lit("<branch>").alias("path"), F.lit(1).cast("long").alias("line"), F.lit("branch").alias("side"), F.lit("branch-level regression correlation").alias("snippet")))


def declared_name(line: Column) -> Column:
    """The function that a line declares, or an empty string."""
    names = F.coalesce(*[F.nullif(F.regexp_extract(line, T.re2(DECLARED), k), F.lit("")) for k in range(1, 6)], F.lit(""))
    return F.when(T.may_fit(T.folded(line), DECLARED), names).otherwise("")


def intent_of(name: Column) -> Column:
    """The number of a name's intent, or null."""
    return reduce(lambda out, i: out.when(_has(F.lower(name), *INTENTS[i][0]), i), range(1, len(INTENTS)), F.when(_has(F.lower(name), *INTENTS[0][0]), 0))


def anchors(lines: DataFrame) -> DataFrame:
    """(path, line_no, text) of code -> path, line_no, name, category, severity: functions whose names promise protection."""
    named = lines.filter(T.executable(F.col("path"))).select("path", "line_no", declared_name(F.col("text")).alias("name")).filter("name <> ''").withColumn("i", intent_of(F.col("name"))).filter("i is not null")
    at = lambda k: F.get(F.array(*[F.lit(x[k]) for x in INTENTS]), F.col("i"))
    return named.select("path", "line_no", "name", at(1).alias("category"), at(2).alias("severity"))


def tokens(text: Column) -> Column:
    """The names in a text, in lower case, of two characters at least, once each, in order."""
    names = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), F.lower)
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: F.length(n) > 1)))


def in_folder(path: Column, glob: str) -> Column:
    """Globs of the snapshot command: a star stays within a folder; one that ends in /** takes all paths that begin as it does before that."""
    fits = path.rlike("^(?:" + T.glob_regex(glob.replace("**", "*"))[1:-1] + ")$")
    return fits | F.startswith(path, F.lit(glob[:-3])) if glob.endswith("/**") else fits


def repository_anchors(files: DataFrame, glob: str = "") -> DataFrame:
    """Anchors of a tree's code (path, content): path, line_no, name, category, severity, expected; nothing in folders that begin with .git."""
    path = F.col("path")
    seen = files.filter(~F.exists(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda p: F.startswith(p, F.lit(".git"))))
    found = anchors(file_lines(seen.filter(in_folder(path, glob)) if glob else seen))
    words = F.array(*[F.array(*[F.lit(w) for w in x[3]]) for x in INTENTS])
    return found.withColumn("expected", F.get(words, intent_of(F.col("name"))))


def window_tokens(lines: DataFrame, marks: DataFrame, radius: int) -> DataFrame:
    """marks (path, line_no) with tokens, the names on the lines (path, line_no, text) at most radius from each."""
    own = marks.select("path", "line_no").distinct()
    near = own.select("path", F.col("line_no").alias("mark"), F.explode(F.sequence(F.col("line_no") - radius, F.col("line_no") + radius)).alias("line_no"))
    read = near.join(lines.select("path", "line_no", "text"), ["path", "line_no"]).groupBy("path", F.col("mark").alias("line_no")).agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.col("line_no").alias("n"), "text")))["text"], "\n").alias("text"))
    found = read.select("path", "line_no", tokens(F.col("text")).alias("tokens"))
    return marks.join(found, ["path", "line_no"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def recorded(anchored: DataFrame) -> DataFrame:
    """Anchors as the snapshots that record them: id (path and name with dots), path, anchor, require, category, severity."""
    slug = F.regexp_replace(F.lower(F.concat_ws(".", "path", "name")), "[/_-]", ".")
    return anchored.select(slug.alias("id"), "path", F.col("name").alias("anchor"), F.col("expected").alias("require"), "category", "severity").distinct()


def snapshots_of(lines: DataFrame, table: DataFrame) -> DataFrame:
    """snapshots() with the recorded anchors as a table, whose paths are paths and no globs: hunks meet the anchors of their file by a join."""
    kept = table.select("path", F.col("id").alias("rule_id"), "anchor", "require", "category", "severity")
    changed = F.coalesce(F.get(F.filter("rows", lambda x: x["kind"] != "context"), F.lit(0))["number"], F.lit(1))
    hunks = _hunks(lines.join(kept.select("path").distinct(), "path", "left_semi")).join(kept, "path").filter(F.contains(F.lower("hunk_text"), F.lower("anchor")))
    sides = hunks.select(*HUNK, "path", "rule_id", "anchor", "category", "severity", "require", changed.cast("long").alias("line"), _side("deleted", F.col("anchor")).alias("gone"), _side("added", F.col("anchor")).alias("come"))
    has = lambda side: F.exists("require", lambda w: F.contains(F.col(side), F.lower(w)))
    lost = sides.filter(has("gone") & ~has("come")).drop("gone", "come", "require")
    first = lost.groupBy("diff_id", "file_ix", "rule_id", "anchor").agg(F.min_by(F.struct("hunk_ix", "path", "line", "category", "severity"), "hunk_ix").alias("f")).select("diff_id", "file_ix", "rule_id", "anchor", "f.*", F.lit(0).alias("line_ix"))
    return _first(first.withColumns({"id": T.identity(F.col("rule_id"), F.col("path"), F.col("line"), F.lit("added"), F.col("anchor")), "confidence": F.lit("high"), "side": F.lit("added"), "snippet": F.concat(F.lit("snapshot anchor: "), "anchor")}))


def _side(kind: str, but: Column) -> Column:
    """The lower-cased lines of a side that don't name the anchor."""
    mine = F.filter("rows", lambda x: (x["kind"] == kind) & ~F.contains(F.lower(x["text"]), F.lower(but)))
    return F.lower(F.array_join(F.transform(mine, lambda x: x["text"]), "\n"))


def intents_found() -> Column:
    """The first function of a hunk that is named for a protection which the hunk takes out."""
    names = F.filter(F.transform("rows", lambda x: declared_name(x["text"])), lambda n: (n != "") & intent_of(n).isNotNull())
    words = lambda k, n, text: reduce(lambda out, i: F.when(intent_of(n) == i, _has(text, *INTENTS[i][k])).otherwise(out), range(len(INTENTS)), F.lit(False))
    lost = F.filter(names, lambda n: words(3, n, _side("deleted", n)) & (words(4, n, _side("added", n)) | ~words(3, n, _side("added", n))))
    first = F.slice(F.transform(lost, intent_of), 1, 1)
    at = lambda k, i: F.get(F.array(*[F.lit(x[k]) for x in INTENTS]), i)
    return synthetic(F.transform(first, lambda i: info(F.lit(True), *INTENT, at(1, i), at(2, i))))


def intents(lines: DataFrame) -> DataFrame:
    """Functions named for a protection whose hunk takes the protection out; of a hunk the first one."""
    return spread(_hunks(lines.filter(T.executable(F.col("path")))), intents_found())


@dataclass(frozen=True)
class Snapshot:
    """What must stay in the hunks of a path that name the anchor."""

    id: str
    path: str
    anchor: str
    require: tuple[str, ...]
    category: str = "intent"
    severity: str = "high"


def _recorded_at(s: Snapshot) -> Column:
    return (F.col("path") == s.path) | T.any_glob(F.col("path"), [s.path])


def snapshots_found(recorded: Sequence[Snapshot]) -> Column:
    """Recorded anchors whose required words a hunk deletes and doesn't add; line_ix is the snapshot's number."""
    changed = F.coalesce(F.get(F.filter("rows", lambda x: x["kind"] != "context"), F.lit(0))["number"], F.lit(1))

    def test(i: int, s: Snapshot) -> Column:
        fits = _recorded_at(s) & F.contains(F.lower("hunk_text"), F.lit(s.anchor.lower()))
        words = [w.lower() for w in s.require]
        gone, come = (_has(_side(k, F.lit(s.anchor)), *words) if words else F.lit(False) for k in ("deleted", "added"))
        ident = T.identity(F.lit(s.id), F.col("path"), changed, F.lit("added"), F.lit(s.anchor))
        return F.when(fits & gone & ~come, found(F.lit(s.id), F.lit(s.category), F.lit(s.severity), changed, F.lit("snapshot anchor: " + s.anchor), ident, F.lit(i), "high"))

    return listed([test(i, s) for i, s in enumerate(recorded)])


def snapshots(lines: DataFrame, recorded: Sequence[Snapshot]) -> DataFrame:
    """Recorded anchors whose required words a hunk deletes and doesn't add; of a file the first hunk."""
    touched = lines.filter(reduce(lambda a, b: a | b, [_recorded_at(s) for s in recorded], F.lit(False)))
    none = F.array(found(*[F.lit("")] * 3, F.lit(0), F.lit(""), F.lit("")))
    rows = _hunks(touched).select(*HUNK, "path", F.explode(snapshots_found(recorded) if recorded else F.slice(none, 1, 0)).alias("r")).select(*HUNK, "path", "r.*")
    rest = [c for c in rows.columns if c not in ("diff_id", "file_ix", "line_ix")]
    return _first(rows.groupBy("diff_id", "file_ix", "line_ix").agg(F.min_by(F.struct(*rest), "hunk_ix").alias("f")).select("diff_id", "file_ix", "line_ix", "f.*"))


def nonces_found() -> Column:
    """Whether one added nonce or initialisation vector is in two added cipher calls of a hunk or more."""
    low = F.transform("added", lambda x: F.struct(F.lower(x["text"]).alias("low"), F.when(F.contains(x["text"], F.lit("=")), F.lower(F.regexp_extract(x["text"], T.re2(NONCE_ASSIGN), 1))).otherwise("").alias("name")))
    is_nonce = lambda n, t: _has(n, "nonce") | F.startswith(n, F.lit("iv")) | F.endswith(n, F.lit("iv")) | _has(t, "nonce", " iv")
    names = F.array_distinct(F.transform(F.filter(low, lambda x: (x["name"] != "") & is_nonce(x["name"], x["low"])), lambda x: x["name"]))
    uses = F.transform(F.filter(low, lambda x: x["low"].rlike(T.re2(CIPHER_USE))), lambda x: x["low"])
    reused = F.exists(names, lambda n: F.size(F.filter(uses, lambda u: F.contains(u, n))) >= 2)
    return synthetic(listed([info(reused, *NONCE, "crypto", "critical")]))


def nonces(lines: DataFrame) -> DataFrame:
    """Hunks of code in which one added nonce or initialisation vector is in two added cipher calls or more."""
    return spread(_hunks(lines.filter(T.executable(F.col("path")))), nonces_found())
