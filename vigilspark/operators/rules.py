"""Declarative rules over diff lines.

A rule is a side, path scopes, patterns of the line (all of require, one of any)
and of its hunk (all of near, none of absent), and an entropy floor; typed rules
read imports, settings or required calls instead.  All rules of a run become one
projection: a line carries an array of the rules that it matches, so the fact
table is read once however many rules there are, and the patterns are literals
that compile once per task.  If rules read hunks, one shuffle puts each hunk's
lines together before they are tested, and a hunk, at most a file, is judged once
for the rules that touch it.  Patterns are RE2's (functions.text.re2)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import text as T

HUNK = ("diff_id", "file_ix", "hunk_ix")


@dataclass(frozen=True)
class Rule:
    id: str
    category: str = ""
    severity: str = "medium"
    confidence: str = "medium"
    target: str = "added"  # added, deleted or any
    paths: tuple[str, ...] = ()
    from_paths: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    require: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    near: tuple[str, ...] = ()
    absent: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    entropy: float = 0.0
    mask: bool = False
    type: str = ""  # one of TYPES, or none: patterns only
    forbidden_paths: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    calls: tuple[str, ...] = ()  # of requiredCall and requiredMiddleware: none may be in the hunk
    allowed_values: tuple[str, ...] = ()
    forbidden_values: tuple[str, ...] = ()
    constraint_key: str = ""
    constraint_pattern: str = ""
    min_value: float = 0.0  # 0: no bound
    max_value: float = 0.0


TYPES = ("forbiddenImport", "deletedLineGuard", "forbiddenEnv", "requiredMiddleware", "requiredCall", "configKeyConstraint", "pathBoundary")
# How imports and settings are written.
IMPORT = r"""(?i)(import\s+.*from\s+["']([^"']+)["']|require\(["']([^"']+)["']\)|import\s+["']([^"']+)["'])"""
ENV = r"^\s*([A-Za-z_][A-Za-z0-9_\.-]*)\s*[:=]\s*(.+)$"
SETTING = r"""(?i)^\s*["']?([A-Za-z0-9_\.-]+)["']?\s*[:=]\s*([^#]+)$"""


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _some(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _like(value: Column, patterns: Sequence[str]) -> list[Column]:
    return [value.rlike(T.re2(p)) for p in patterns]


def _import() -> Column:
    """What a line imports, or an empty string."""
    return F.coalesce(*[F.nullif(T.trim_space(F.regexp_extract("text", T.re2(IMPORT), k)), F.lit("")) for k in (2, 3, 4)], F.lit(""))


def _value(raw: Column) -> Column:
    """A setting's value without its comma and quotes."""
    return F.regexp_replace(T.trim_space(F.regexp_replace(T.trim_space(raw), r",\z", "")), "^[\"']+|[\"']+\\z", "")


def _one_of(value: Column, words: Sequence[str]) -> Column:
    return F.lower(value).isin(*[w.strip().lower() for w in words])


def _typed(r: Rule) -> Column:
    line, trimmed = F.col("text"), T.trim_space(F.col("text"))
    if r.type in ("forbiddenImport", "pathBoundary"):
        module = _import()
        imports = _some(_like(module, r.imports) + _like(line, r.imports))
        fits = module != ""
        if r.type == "forbiddenImport" or r.imports:
            return fits & imports
        return fits & (T.any_glob(module, r.forbidden_paths) | imports) if r.forbidden_paths else fits
    if r.type == "deletedLineGuard":
        return (F.col("kind") == "deleted") & _all(_like(line, r.require))
    if r.type in ("requiredCall", "requiredMiddleware"):
        return (F.col("kind") == "added") & (_some(_like(line, r.require)) if r.require else F.lit(True))
    if r.type == "forbiddenEnv":
        key, value = (F.regexp_extract(trimmed, T.re2(ENV), k) for k in (1, 2))
        fits = (F.col("kind") == "added") & (key != "") & _some(_like(key, r.keys) + _like(F.lower(key), r.keys))
        return fits & _one_of(_value(value), r.forbidden_values) if r.forbidden_values else fits
    if r.type == "configKeyConstraint":
        key, value = F.regexp_extract(trimmed, T.re2(SETTING), 1), _value(F.regexp_extract(trimmed, T.re2(SETTING), 2))
        fits = (F.col("kind") == "added") & (key != "")
        if r.constraint_key:
            fits = fits & (F.lower(key) == r.constraint_key.lower())
        elif r.keys:
            fits = fits & _some(_like(key, r.keys))
        wrong = [~_one_of(value, r.allowed_values)] if r.allowed_values else []
        wrong += [_one_of(value, r.forbidden_values)] if r.forbidden_values else []
        wrong += [~value.rlike(T.re2(r.constraint_pattern))] if r.constraint_pattern else []
        number = value.try_cast("double")
        wrong += [number.isNull()] if r.min_value or r.max_value else []
        wrong += [F.coalesce(number < r.min_value, F.lit(False))] if r.min_value else []
        wrong += [F.coalesce(number > r.max_value, F.lit(False))] if r.max_value else []
        return fits & _some(wrong)
    raise ValueError(f"{r.id}: unknown type {r.type}")


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hints(patterns: Sequence[str]) -> list[str]:
    """Whether the folded line has what one of the patterns needs, if something can be said of all of them."""
    needs = [T.literals(p) for p in patterns]
    return [" OR ".join(f"contains(folded, {_quoted(w)})" for w in sorted({w for n in needs for w in n}))] if needs and all(needs) else []


def _line_test(r: Rule) -> Column:
    """From cheap to dear, as each part is only tried on lines that pass those before: side, literals, paths, patterns.

    One SQL text: a rule set has thousands of these parts."""
    parts = [] if r.target == "any" else [f"kind = {_quoted(r.target)}"]
    if not r.type:
        parts += [hint for p in r.require for hint in _hints([p])] + _hints(r.any)
    glob = lambda globs: f"trim(path) rlike {_quoted(T.globs_regex(globs))}" if T.globs_regex(globs) else "false"
    parts += [glob(r.paths)] if r.paths else []
    parts += [glob(r.from_paths)] if r.from_paths else []
    parts += [f"NOT ({glob(r.ignore)})"] if r.ignore else []
    if not r.type:
        parts += [f"text rlike {_quoted(T.re2(p))}" for p in r.require]
        parts += [" OR ".join(f"text rlike {_quoted(T.re2(p))}" for p in r.any)] if r.any else []
    cheap = F.expr(" AND ".join(f"({p})" for p in parts)) if parts else F.lit(True)
    if r.type:
        return cheap & _typed(r)
    return cheap & (T.entropy(F.col("text"), skip_blanks=True) >= r.entropy) if r.entropy else cheap


def _hunk_test(r: Rule) -> Column:
    near, absent = () if r.type else r.near, r.calls if r.type else r.absent
    return F.expr(" AND ".join([*[f"hunk_text rlike {_quoted(T.re2(p))}" for p in near], *[f"NOT hunk_text rlike {_quoted(T.re2(p))}" for p in absent]]) or "true")


def _confidences(r: Rule) -> tuple[str, str]:
    """A pattern rule's confidence, which near patterns and a path scope raise, and what it is with entropy well above the floor."""
    if r.type:
        return r.confidence, r.confidence
    names = ("low", "medium", "high")
    base = (names.index(r.confidence) if r.confidence in names else 0) + bool(r.near) + bool(r.paths)
    return names[min(base, 2)], names[min(base + 1, 2)]


def _why(r: Rule) -> list[str]:
    """What a finding of the rule rests on, besides its path."""
    if r.type:
        return [f"the typed rule {r.type} applies"]
    parts = [(r.require, "{} required patterns match the line"), (r.any, "one of {} alternative patterns matches the line"), (r.near, "{} patterns match elsewhere in the hunk"), (r.absent, "none of {} mitigating patterns is in the hunk")]
    out = [text.format(len(patterns)) for patterns, text in parts if patterns]
    out += [f"the line's entropy is {r.entropy:.2f} bits or more"] if r.entropy else []
    return out if out or r.paths else ["the hunk meets the rule"]


def check(rules: Sequence[Rule], allow_regexes: Sequence[str] = ()) -> None:
    """Raises for what no run should start with: equal ids, unknown names, patterns that don't compile."""
    seen: set[str] = set()
    for r in rules:
        wrong = None
        if not r.id or r.id in seen:
            wrong = "empty or used twice"
        elif r.severity not in T.SEVERITIES:
            wrong = f"unknown severity {r.severity}"
        elif r.confidence not in ("low", "medium", "high"):
            wrong = f"unknown confidence {r.confidence}"
        elif r.target not in ("added", "deleted", "any"):
            wrong = f"unknown target {r.target}"
        elif r.type and r.type not in TYPES:
            wrong = f"unknown type {r.type}"
        if wrong:
            raise ValueError(f"rule {r.id!r}: {wrong}")
        seen.add(r.id)
        for pattern in (*r.require, *r.any, *r.near, *r.absent, *r.imports, *r.keys, *r.calls, *filter(None, [r.constraint_pattern])):
            _compiles(pattern, f"rule {r.id!r}")
    for pattern in allow_regexes:
        _compiles(pattern, "allow list")


@lru_cache(maxsize=4096)
def _compiles(pattern: str, where: str) -> None:
    """Raises for a pattern that RE2 refuses or that doesn't compile in the dialect which runs."""
    try:
        translated = T.re2(pattern)
    except T.PatternError as e:
        raise ValueError(f"{where}: {e}") from e
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(translated)
        except IllegalArgumentException as e:
            raise ValueError(f"{where}: pattern {pattern!r}: {e}") from e


#: Other names under which a custom rule may give its patterns.
SYNONYMS = {"forbidden": "require", "protected": "require", "required": "require", "when": "require", "context": "near", "mitigate": "absent", "middleware": "calls"}


def from_records(records: Sequence[dict]) -> tuple[Rule, ...]:
    """Custom rules from mappings, as a parsed file has them: lists or single values, synonyms merged, unknown keys left out."""
    fields = Rule.__dataclass_fields__
    rules = []
    for record in records:
        given: dict = {}
        for key, value in record.items():
            name = SYNONYMS.get(key, key)
            if name not in fields or value is None:
                continue
            if isinstance(fields[name].default, tuple):
                given[name] = (*given.get(name, ()), *((value,) if isinstance(value, str) else value))
            else:
                given[name] = type(fields[name].default)(value) if name != "id" else str(value)
        rules.append(Rule(**given))
    check(rules)
    return tuple(rules)


def evaluate(lines: DataFrame, rules: Sequence[Rule], allow_values: Sequence[str] = (), allow_regexes: Sequence[str] = (), ignore: Sequence[str] = (), allow_paths: Sequence[str] = (), skip_artifacts: bool = False) -> DataFrame:
    """Findings of the rules: id, rule_id, category, severity, confidence, path, line, side, snippet, and the order columns; first of equal ids wins.

    Lines with an allowed value or pattern, paths that an ignore glob fits and,
    if wished, documents and fixtures have none; null texts match nothing."""
    # Hunks meet before their lines are tested: the exchange carries no rules, and the tests run on all its tasks.
    seen = tagged(lines.repartition("diff_id", "hunk_ix") if reads_hunks(rules) else lines, rules, allow_values, allow_regexes, ignore, allow_paths, skip_artifacts, drop=True)
    line = ["line_ix", "path", "kind", "text", "old_no", "new_no"]
    hits = seen.select(*HUNK, *line, "rules")
    if reads_hunks(rules):
        hunks = hits.groupBy(*HUNK).agg(F.sort_array(F.collect_list(F.struct(*line, "rules"))).alias("rows"))
        hunks = hunks.filter(F.exists("rows", lambda x: F.size(x["rules"]) > 0)).withColumn("hunk_text", F.array_join(F.transform("rows", lambda x: x["text"]), "\n"))
        hits = hunks.select(*HUNK, "rows", failed(rules).alias("fails")).select(*HUNK, "fails", F.explode("rows").alias("row")).select(*HUNK, "row.*", "fails")
        hits = hits.withColumn("rules", F.array_except("rules", "fails"))
    # An outer explode: a filter on the rules would be pushed below them and run them twice.
    hits = hits.select(*HUNK, *line, F.explode_outer("rules").alias("rule_ix")).filter("rule_ix is not null")
    # The table of rules has one row for each rule of the call, however many lines there are.
    found = hits.join(F.broadcast(infos(lines.sparkSession, rules)), "rule_ix").withColumn("number", F.when(F.col("kind") == "deleted", F.col("old_no")).otherwise(F.col("new_no")))
    shaped = found.select("diff_id", "rule_id", "category", "severity", raised_confidence().alias("confidence"), "path", F.col("number").alias("line"), F.col("kind").alias("side"), shown().alias("snippet"), explained().alias("reasons"), "file_ix", "hunk_ix", "line_ix", "rule_ix")
    shaped = shaped.withColumn("id", T.identity(F.col("rule_id"), F.col("path"), F.col("line"), F.col("side"), F.col("snippet")))
    order = F.struct("file_ix", "hunk_ix", "line_ix", "rule_ix")
    rest = [c for c in shaped.columns if c not in ("diff_id", "id")]
    return shaped.groupBy("diff_id", "id").agg(F.min_by(F.struct(*rest), order).alias("f")).select("diff_id", "id", "f.*")


def tagged(lines: DataFrame, rules: Sequence[Rule], allow_values: Sequence[str] = (), allow_regexes: Sequence[str] = (), ignore: Sequence[str] = (), allow_paths: Sequence[str] = (), skip_artifacts: bool = False, drop: bool = False) -> DataFrame:
    """lines with rules, the numbers of the rules whose line tests each meets; lines that no rule reads have none, or with drop are left out."""
    check(rules, allow_regexes)
    skipped = [*ignore, *allow_paths]
    read = ~T.any_glob(F.col("path"), skipped) if skipped else F.lit(True)
    read = read & ~T.artifact(F.col("path")) if skip_artifacts else read
    seen = lines.filter(read) if drop else lines
    none = F.array().cast("array<int>")
    tests = F.filter(F.array(*[F.when(_line_test(r), F.lit(i)) for i, r in enumerate(rules)]), lambda i: i.isNotNull()) if rules else none
    allow_values = [v for v in allow_values if v]
    if allow_values or allow_regexes:
        allowed = _some([F.contains("text", F.lit(v)) for v in allow_values] + _like(F.col("text"), allow_regexes))
        tests = F.when(~allowed, tests)
    tests = tests if drop else F.when(read, tests)
    return seen.withColumn("folded", T.folded(F.col("text"))).withColumn("rules", F.coalesce(tests, none)).drop("folded")


def reads_hunks(rules: Sequence[Rule]) -> bool:
    return any(r.near or r.absent or r.calls for r in rules)


def failed(rules: Sequence[Rule]) -> Column:
    """Of a hunk (rows with rules, hunk_text), the rules that its lines meet and its text doesn't."""
    wanted = F.array_distinct(F.flatten(F.transform("rows", lambda x: x["rules"])))
    wide = [i for i, r in enumerate(rules) if r.near or r.absent or r.calls]
    fails = lambda w: F.array(*[F.when(F.array_contains(w, i) & ~_hunk_test(rules[i]), F.lit(i)) for i in wide])
    return F.transform(F.array(wanted), fails)[0] if wide else F.array().cast("array<int>")


def infos(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """What findings show of their rules, one row for each."""
    return spark.createDataFrame([(i, r.id, r.category, r.severity, *_confidences(r), float(r.entropy), r.mask, bool(r.type), bool(r.paths), _why(r)) for i, r in enumerate(rules)], "rule_ix int, rule_id string, category string, severity string, confidence string, raised string, floor double, mask boolean, typed boolean, scoped boolean, why array<string>")


def raised_confidence() -> Column:
    return F.when((F.col("floor") > 0) & (T.entropy(F.col("text"), skip_blanks=True) >= F.col("floor") + 0.4), F.col("raised")).otherwise(F.col("confidence"))


def shown() -> Column:
    """A pattern's snippet is the line as it stands, a typed rule's has no blanks at its ends."""
    return F.when(F.col("typed"), T.trim_space(F.col("text"))).when(F.col("mask"), T.mask_tokens(F.col("text"))).otherwise(F.col("text"))


def explained() -> Column:
    return F.filter(F.concat(F.when(F.col("scoped"), F.array(F.concat(F.lit("the path is in the rule's scope: "), F.col("path")))).otherwise(F.array().cast("array<string>")), F.col("why")), lambda x: x.isNotNull())


# How a control's strength is read from a line.
SAMESITE = (r"""(?i)(sameSite|samesite)\s*[:=]\s*["']?(strict|lax|none)""", r"(?i)(samesite)=(strict|lax|none)")
DURATION = r"""(?i)(maxAge|max-age|expiresIn|expiration|expiry|ttl|idleTimeout|sessionTimeout|requestTimeout|readTimeout|writeTimeout|headerTimeout|timeout)\s*[:=]?\s*["']?([0-9]+)\s*(ms|s|m|h|d)?"""
LIFETIMES = ("maxage", "expiresin", "expiration", "expiry", "ttl")
BCRYPT = (r"(?i)(bcrypt)\.[A-Za-z0-9_]+\([^\n,]+,\s*(\d{1,3})\)", r"(?i)(bcrypt(?:cost|rounds)?|password(?:cost|rounds)?|salt(?:rounds)?|workfactor)\s*[:=]\s*(\d{1,3})")
RATE_LIMIT = r"(?i)(rateLimit|rate_limit|maxAttempts|maxLoginAttempts|maxRequests|requestsPerMinute|requestsPerSecond|burst|throttle|limitPerIP|limitPerUser|tooManyRequestsAfter)\s*[:=]\s*(\d{1,7})"
MFA = r"(?i)(requireMFA|mfaRequired|mfaEnforced|enforceMFA|requireOtp|otpRequired)\s*[:=]\s*(true|false)"
NO_MFA = ("skipmfa", "disablemfa", "mfaoptional", "optionalmfa")
UNITS = {"": 1, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


# Rule, title, category, severity, whether a lower or a higher value is the weaker one.
DOWNGRADES = (
    ("downgrade.cookie.samesite", "SameSite policy weakened", "session", "high", "lower"),
    ("downgrade.cookie.lifetime", "Cookie or token lifetime increased", "session", "high", "higher"),
    ("downgrade.crypto.bcrypt", "bcrypt cost factor reduced", "crypto", "high", "lower"),
    ("downgrade.auth.ratelimit", "Rate limit threshold increased", "auth", "high", "higher"),
    ("downgrade.timeout", "Security-relevant timeout increased", "config", "medium", "higher"),
    ("downgrade.auth.mfa", "MFA requirement weakened", "auth", "critical", "lower"),
)


def _signals(line: Column) -> Column:
    """The strengths that a line sets: an array of (rule_id, key, value, shown), shown as in the line.  A pattern is only tried on lines that have what it needs, and its parts are taken once."""
    asked = {"site0": (SAMESITE[0], 2), "site1": (SAMESITE[1], 2), "name": (DURATION, 1), "spent": (DURATION, 2), "unit": (DURATION, 3), "cost0": (BCRYPT[0], 2), "cost1": (BCRYPT[1], 2), "limit": (RATE_LIMIT, 1), "rate": (RATE_LIMIT, 2), "mfa": (MFA, 2)}
    part = lambda folded, p, k: F.when(T.may_fit(folded, p), F.regexp_extract(line, T.re2(p), k))
    taken = lambda folded: F.struct(F.lower(line).alias("low"), *[part(folded, p, k).alias(name) for name, (p, k) in asked.items()])
    patterns = (*SAMESITE, DURATION, *BCRYPT, RATE_LIMIT, MFA)
    any_ = lambda folded: T.may_fit(folded, *patterns) | _some([F.contains(folded, F.lit(w)) for w in NO_MFA])
    none = F.array().cast("array<struct<rule_id:string,key:string,value:bigint,shown:string>>")
    return T.let(T.folded(line), lambda folded: F.when(any_(folded), T.let(taken(folded), _strengths)).otherwise(none))


def _strengths(g: Column) -> Column:
    """_signals() of the parts that a line's settings have."""
    low, part = g["low"], lambda name: F.nullif(g[name], F.lit(""))
    has = lambda *words: _some([F.contains(low, F.lit(w)) for w in words])
    key = lambda c: F.regexp_replace(F.lower(c), "[_.-]", "")
    signal = lambda rule, k, v, shown, when: F.when(v.isNotNull() & when, F.struct(F.lit(rule).alias("rule_id"), k.alias("key"), v.alias("value"), shown.alias("shown")))
    site = F.lower(F.coalesce(part("site0"), part("site1")))
    unit = F.coalesce(part("unit"), F.lit(""))
    spent = part("spent").try_cast("long") * reduce(lambda out, u: F.when(F.lower(unit) == u, UNITS[u]).otherwise(out), UNITS, F.lit(None).cast("long"))
    named, always, time = key(part("name")), F.lit(True), F.concat(part("spent"), unit)
    mfa, cost, rate = F.lower(part("mfa")), F.coalesce(part("cost0"), part("cost1")), part("rate")
    return F.array(
        signal("downgrade.cookie.samesite", F.lit("samesite"), F.when(site == "strict", 3).when(site == "lax", 2).when(site == "none", 1).cast("long"), site, always),
        signal("downgrade.cookie.lifetime", F.lit("lifetime"), spent, time, named.isin(*LIFETIMES) & has("cookie", "session", "token", "auth") & ~has("cache-control")),
        signal("downgrade.crypto.bcrypt", F.lit("bcrypt"), cost.try_cast("long"), cost, always),
        signal("downgrade.auth.ratelimit", key(part("limit")), rate.try_cast("long"), rate, always),
        signal("downgrade.timeout", named, spent, time, ~named.isin(*LIFETIMES) & ~has("cache")),
        signal("downgrade.auth.mfa", F.lit("mfa"), F.when(mfa == "true", 1).when((mfa == "false") | has(*NO_MFA), 0).cast("long"), F.coalesce(mfa, F.lit("optional")), always),
    )


def downgrades(lines: DataFrame) -> DataFrame:
    """Controls that a hunk weakens, per rule and key: the strongest deleted value, was, against the weakest added one, now.

    Findings, with hunk_ix, key, was and now; of equal values the first line's counts, and the first of equal ids stays."""
    signals = F.explode(F.filter(_signals(F.col("text")), lambda s: s.isNotNull()))
    found = lines.filter(F.col("kind").isin("added", "deleted")).withColumn("s", signals).select(*HUNK, "line_ix", "path", "kind", "text", "new_no", "s.*")
    lower = F.col("rule_id").isin(*[r for r, *_, worse in DOWNGRADES if worse == "lower"])
    # The weaker a value, the less its strength; of equal ones the first line wins in either order.
    strength = F.when(lower, F.col("value")).otherwise(-F.col("value"))
    at = F.struct("value", "shown", "text", F.col("new_no").alias("line"), "line_ix")
    paired = found.groupBy(*HUNK, "path", "rule_id", "key").agg(
        F.max_by(F.when(F.col("kind") == "deleted", at), F.when(F.col("kind") == "deleted", F.struct(strength, -F.col("line_ix")))).alias("d"),
        F.min_by(F.when(F.col("kind") == "added", at), F.when(F.col("kind") == "added", F.struct(strength, F.col("line_ix")))).alias("a"),
    )
    was, now = F.col("d.value"), F.col("a.value")
    paired = paired.filter((lower & (now < was)) | (~lower & (now > was)))
    of = lambda k: reduce(lambda out, d: out.when(F.col("rule_id") == d[0], d[k]), DOWNGRADES[1:], F.when(F.col("rule_id") == DOWNGRADES[0][0], DOWNGRADES[0][k]))
    reasons = F.array(F.concat(F.lit("deleted value: "), "d.shown"), F.concat(F.lit("added value: "), "a.shown"))
    rows = paired.select(
        *HUNK, F.col("a.line_ix").alias("line_ix"), T.identity(F.col("rule_id"), F.col("path"), F.col("a.line"), F.lit("added"), F.col("a.shown")).alias("id"), "rule_id", of(2).alias("category"), of(3).alias("severity"),
        F.lit("high").alias("confidence"), "path", F.col("a.line").alias("line"), F.lit("added").alias("side"), T.trim_space(F.col("a.text")).alias("snippet"), reasons.alias("reasons"), "key", was.alias("was"), now.alias("now"),
    )
    rest = [c for c in rows.columns if c not in ("diff_id", "id")]
    return rows.groupBy("diff_id", "id").agg(F.min_by(F.struct(*rest), F.struct("file_ix", "hunk_ix", "line_ix", "rule_id", "key")).alias("f")).select("diff_id", "id", "f.*")


def weakened(rows: Column) -> Column:
    """downgrades() of one hunk's rows (line_ix, kind, text, number) in order: (rule_id, key, a, d) with the weakest added and the strongest deleted setting."""
    changed = F.filter(rows, lambda x: x["kind"].isin("added", "deleted"))
    lower = lambda s: s["rule_id"].isin(*[r for r, *_, worse in DOWNGRADES if worse == "lower"])
    strength = lambda s: F.when(lower(s), s["value"]).otherwise(-s["value"])
    tell = lambda x, s: F.struct(s["rule_id"].alias("rule_id"), s["key"].alias("key"), x["kind"].alias("kind"), s["value"].alias("value"), strength(s).alias("strength"), s["shown"].alias("shown"), x["text"].alias("text"), x["number"].alias("number"), x["line_ix"].alias("line_ix"))
    every = F.flatten(F.transform(changed, lambda x: F.transform(F.filter(_signals(x["text"]), lambda s: s.isNotNull()), lambda s: tell(x, s))))

    def pairs(signals: Column) -> Column:
        keys = F.array_distinct(F.transform(F.filter(signals, lambda s: s["kind"] == "added"), lambda s: F.struct(s["rule_id"].alias("rule_id"), s["key"].alias("key"))))
        mine = lambda k, kind: F.filter(signals, lambda s: (s["rule_id"] == k["rule_id"]) & (s["key"] == k["key"]) & (s["kind"] == kind))
        # Of equal strengths the first line counts on either side.
        weakest = lambda k: F.array_min(F.transform(mine(k, "added"), lambda s: F.struct(s["strength"].alias("x"), s["line_ix"].alias("ix"), s.alias("s"))))["s"]
        strongest = lambda k: F.array_max(F.transform(mine(k, "deleted"), lambda s: F.struct(s["strength"].alias("x"), (-s["line_ix"]).alias("ix"), s.alias("s"))))["s"]
        both = F.transform(keys, lambda k: F.struct(k["rule_id"].alias("rule_id"), weakest(k).alias("a"), strongest(k).alias("d")))
        return F.filter(both, lambda p: F.coalesce(p["a"]["strength"] < p["d"]["strength"], F.lit(False)))

    return F.transform(F.array(every), pairs)[0]
