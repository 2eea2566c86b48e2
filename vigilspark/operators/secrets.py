"""Secret scan: patterns with entropy over the lines of files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.operators.findings import at_least
from vigilspark.sources.lines import file_lines

MAX_LINE_BYTES = 64 * 1024


@dataclass(frozen=True)
class Pattern:
    id: str
    severity: str
    confidence: str
    regex: str
    group: int = 0
    entropy: float = 0.0
    path: str = ""


# The patterns of the file scan.
PATTERNS = (
    Pattern("secret.scan.aws.access", "critical", "high", r"\b(AKIA|ASIA)[0-9A-Z]{16}\b"),
    Pattern("secret.scan.github.token", "critical", "high", r"\b(gh[pousr]_[A-Za-z0-9_]{30,}|github_pat_[A-Za-z0-9_]{20,}_[A-Za-z0-9_]{20,})\b", 1, 3.5),
    Pattern("secret.scan.slack.token", "critical", "high", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", 0, 3.2),
    Pattern("secret.scan.stripe.key", "critical", "high", r"\bsk_(live|test)_[A-Za-z0-9]{16,}\b", 0, 3.2),
    Pattern("secret.scan.google.api", "high", "high", r"\bAIza[0-9A-Za-z\-_]{35}\b", 0, 3.2),
    Pattern("secret.scan.privatekey", "critical", "high", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----"),
    Pattern("secret.scan.dotenv", "high", "medium", r"(?i)^\s*([A-Z0-9_]*(SECRET|TOKEN|KEY|PASSWORD|PASSWD|PRIVATE)[A-Z0-9_]*)\s*=\s*['\"]?([^'\"\s#]{12,})", 3, 3.0, r"(^|/)\.env(\.|$)"),
    Pattern("secret.scan.generic", "high", "medium", r"(?i)(secret|token|api[_-]?key|client[_-]?secret|private[_-]?key|password|passwd)\s*[:=]\s*['\"]?([A-Za-z0-9_./+=\-]{16,})", 2, 3.6),
)
GENERIC = "secret.scan.generic"


def scan(files: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, allow_values: tuple[str, ...] = (), allow_regexes: tuple[str, ...] = (), ignore: tuple[str, ...] = (), allow_paths: tuple[str, ...] = (), severity: str = "low", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) files -> findings: id, rule_id, severity, confidence, path, line, side, snippet, entropy, and the files' columns to keep.

    A narrow pass: lines explode, one filter drops those that hold nothing which a
    pattern needs, and on the rest each such pattern takes its value once."""
    skipped = (*ignore, *allow_paths)
    files = files.filter(~T.any_glob(F.col("path"), skipped)) if skipped else files
    lines = file_lines(files.filter(F.instr("content", "\0") == 0), as_review=False, keep=keep).filter(F.octet_length("text") <= MAX_LINE_BYTES)
    some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    hint = lambda p, folded: T.may_fit(folded, p.regex)
    # Bound by a lambda: a filter on a column is pushed below it and folds the line once for each literal.
    lines = lines.filter(F.exists(F.array(T.folded(F.col("text"))), lambda folded: T.may_fit(folded, *[p.regex for p in patterns])))
    allowed = lambda c: some([*[F.contains(c, F.lit(v)) for v in allow_values if v], *[c.rlike(T.re2(r)) for r in allow_regexes]])

    def taken(p: Pattern, folded: Column) -> Column:
        fits = hint(p, folded) & F.col("path").rlike(T.re2(p.path)) if p.path else hint(p, folded)
        value = F.regexp_extract("text", T.re2(p.regex), p.group)
        return F.when(fits, F.struct(F.lit(p.id).alias("rule_id"), F.lit(p.severity).alias("severity"), F.lit(p.confidence).alias("confidence"), value.alias("value"), F.lit(p.entropy).alias("floor")))

    values = F.filter(T.let(T.folded(F.col("text")), lambda folded: F.array(*[taken(p, folded) for p in patterns])), lambda h: h.isNotNull() & (h["value"] != ""))
    strong = F.when(~allowed(F.col("text")), F.filter(values, lambda h: ~allowed(h["value"]) & ((h["floor"] == 0) | (T.entropy(h["value"]) >= h["floor"]))))
    # The generic pattern gives way to any other on its line.
    hits = F.transform(F.array(strong), lambda hs: F.filter(hs, lambda h: (h["rule_id"] != GENERIC) | (F.size(hs) == 1)))[0]
    found = lines.select("path", *keep, "line_no", "text", F.explode(hits).alias("h")).select("path", *keep, "line_no", "text", "h.*")
    first = F.instr("text", F.col("value"))
    snippet = T.trim_space(F.concat(F.substr("text", F.lit(1), first - 1), T.mask_value(F.col("value")), F.substr("text", first + F.length("value"))))
    shaped = found.select("rule_id", "severity", "confidence", "path", F.col("line_no").alias("line"), F.lit("file").alias("side"), snippet.alias("snippet"), F.round(T.entropy(F.col("value")), 2).alias("entropy"), *keep)
    return at_least(shaped.select(T.identity(F.col("rule_id"), F.col("path"), F.col("line"), F.col("snippet")).alias("id"), "*"), severity)
