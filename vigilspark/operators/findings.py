"""What happens to findings: profile, zones, floor, order, baseline, summary, score, gate, and the matrix of controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import text as T

# Zones by strength (steps of severity, threshold of the gate), and what each profile takes.
ZONES = {"critical": (2, "low"), "restricted": (1, "medium")}
_COMMON = ("auth", "session", "token", "boundary", "intent")
PROFILES = {
    "auth": ((*_COMMON, "authorization", "oauth", "crypto"), ("observe.auth.", "downgrade.auth.", "downgrade.cookie.", "downgrade.crypto.")),
    "backend": ((*_COMMON, "authorization", "oauth", "crypto", "injection", "ssrf", "deserialization", "file", "transport", "logging", "error", "privacy", "supply", "config", "template", "cors"), ("observe.", "config.", "downgrade.")),
    "frontend": ((*_COMMON, "cors", "xss", "logging", "error", "privacy", "config"), ("observe.", "config.", "downgrade.cookie.", "downgrade.timeout")),
}
EVERYTHING = ("", "fintech")
BRANCH = "<branch>"


def in_profile(profile: str, rule_id: str, category: str) -> bool:
    categories, prefixes = PROFILES.get(profile, ((), ()))
    return profile in EVERYTHING or category in categories or rule_id.startswith(prefixes or ("\0",))


def of_profile(findings: DataFrame, profile: str) -> DataFrame:
    """The same for findings; of an unknown profile there are none."""
    if profile in EVERYTHING:
        return findings
    categories, prefixes = PROFILES.get(profile, ((), ()))
    fits = F.col("category").isin(*categories) if categories else F.lit(False)
    for p in prefixes:
        fits = fits | F.startswith("rule_id", F.lit(p))
    return findings.filter(fits)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(T.severity_rank(F.col("severity")) >= (T.SEVERITIES.index(severity) + 1 if severity in T.SEVERITIES else 0))


def zoned(findings: DataFrame, restricted: Sequence[str] = (), critical: Sequence[str] = (), fail_on: str = "high") -> DataFrame:
    """findings with zone, base_severity and effective_fail_on, null outside zones: the strongest zone of the path raises the severity and may lower the threshold."""
    globs = {"critical": critical, "restricted": restricted}
    path = F.col("path")
    zone = F.lit(None).cast("string")
    for name in reversed(ZONES):
        zone = F.when(T.any_glob(path, globs[name]) & (path != BRANCH) & (path != ""), name).otherwise(zone)
    rank = lambda s: T.SEVERITIES.index(s) + 1 if s in T.SEVERITIES else 0
    strict = {n: t if fail_on == "" or rank(t) < rank(fail_on) else fail_on for n, (_, t) in ZONES.items()}
    named = findings.withColumn("zone", zone)
    by = lambda value: F.when(F.col("zone") == "critical", value("critical")).when(F.col("zone") == "restricted", value("restricted"))
    own = T.severity_rank(F.col("severity"))
    raised = F.get(F.array(*[F.lit(s) for s in T.SEVERITIES]), F.least(F.lit(4), own + F.coalesce(by(lambda n: F.lit(ZONES[n][0])), F.lit(0))) - 1)
    return named.withColumns({"base_severity": F.when(F.col("zone").isNotNull(), F.col("severity")), "effective_fail_on": by(lambda n: F.lit(strict[n])), "severity": F.when(F.col("zone").isNotNull() & (own > 0), raised).otherwise(F.col("severity"))})


def in_order(findings: DataFrame) -> DataFrame:
    """The gravest first, then by path, line, rule and id."""
    return findings.orderBy(F.desc(T.severity_rank(F.col("severity"))), "path", "line", "rule_id", "id")


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose (rule, path, line) the baseline doesn't hold; Spark broadcasts it only while it is small."""
    known = baseline.select(F.col("rule").alias("rule_id"), "path", "line").distinct()
    return findings.join(known, ["rule_id", "path", "line"], "left_anti")


def _blocked(fail_on: str) -> Column:
    threshold = T.severity_rank(F.coalesce(F.col("effective_fail_on"), F.lit(fail_on)))
    return F.coalesce(F.bool_or(T.severity_rank(F.col("severity")) >= threshold), F.lit(False)).alias("blocked")


def summary(findings: DataFrame, files: DataFrame, fail_on: str | None = None) -> DataFrame:
    """One row: files, findings and the number of each severity; with fail_on also blocked, as gate() has it."""
    counts = findings.agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in T.SEVERITIES], *([] if fail_on is None else [_blocked(fail_on)]))
    return files.agg(F.count("*").alias("files")).crossJoin(counts)  # two single rows


def score(summarised: DataFrame) -> DataFrame:
    """summary rows with the weighted findings per file, to two places, and their rating."""
    total = 10.0 * F.col("critical") + 7.0 * F.col("high") + 4.0 * F.col("medium") + 1.0 * F.col("low")
    value = total / F.greatest(F.col("files"), F.lit(1))
    rating = F.when(value == 0, "none").when(value <= 1.5, "low").when(value <= 3.5, "medium").when(value <= 6.0, "high").otherwise("critical")
    # Of the double times a hundred, as it stands: 1.005 is 1.0.
    return summarised.withColumns({"value": F.floor(value * 100 + 0.5) / 100, "rating": rating})


def gate(findings: DataFrame, fail_on: str = "high") -> DataFrame:
    """One row, blocked: whether a finding reaches its threshold, its zone's or the one given; without one, any does."""
    return findings.agg(_blocked(fail_on))


def matrix(infos: DataFrame, prefix: str = "OWASP-ASVS-") -> DataFrame:
    """(id, standards) of rules -> control, rules: the ids under each control, in order."""
    rows = infos.select("id", F.explode("standards").alias("control")).filter(F.startswith("control", F.lit(prefix)))
    return rows.groupBy("control").agg(F.sort_array(F.collect_list("id")).alias("rules"))


def matched(infos: DataFrame, findings: DataFrame) -> DataFrame:
    """The rules that have findings."""
    return infos.join(findings.select(F.col("rule_id").alias("id")).distinct(), "id", "left_semi")
