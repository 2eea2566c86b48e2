"""A whole review: rules and analyzers over the lines of diffs, with one policy.

Each finding has a stage, the place of its analyzer in the run.  Ids hash the
rule, so equal ids meet only within a stage, which keeps the first; profile,
zone and floor then apply to each finding alone.  A hunk's lines meet once, and
all stages read that row.  Lists of paths and lines that the rules pass over don't
bind the analyzers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.operators import analyzers, findings, goflows, rules, trust
from vigilspark.operators.catalogue import BUILTIN
from vigilspark.operators.rules import HUNK, Rule


@dataclass(frozen=True)
class Policy:
    severity: str = "low"  # findings below it are left out
    fail_on: str = "high"
    profile: str = ""
    restricted: tuple[str, ...] = ()  # path globs of the two zones
    critical: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    allow_paths: tuple[str, ...] = ()
    allow_values: tuple[str, ...] = ()
    allow_regexes: tuple[str, ...] = ()
    allow_packages: tuple[str, ...] = ()
    deny_packages: tuple[str, ...] = ()
    trusted_registries: tuple[str, ...] = ()
    snapshots: tuple[trust.Snapshot, ...] = ()


COLUMNS = ("diff_id", "id", "stage", "rule_id", "category", "severity", "confidence", "path", "line", "side", "snippet", "reasons", "zone", "base_severity", "effective_fail_on")
OF_DIFF, RULES, FLOWS, GO, NONCES, SIGNATURES, MANIFESTS, SUPPLY, DOWNGRADES, INTENTS, SNAPSHOTS, BRANCHES = range(-1, 11)
NO_FINDINGS = "array<struct<line_ix:bigint,id:string,rule_id:string,category:string,severity:string,confidence:string,line:bigint,side:string,snippet:string,reasons:array<string>>>"
# Bits of what a hunk says about its diff: packages, life-cycle scripts, lockfiles, and for each branch rule what goes and what comes.
DEPENDENCY, SCRIPT, LOCKED, GONE = 1, 2, 4, 8


def _downgrades_found() -> Column:
    of = lambda r, k: F.element_at(F.create_map(*[F.lit(x) for d in rules.DOWNGRADES for x in (d[0], d[k])]), r)
    reasons = lambda p: F.array(F.concat(F.lit("deleted value: "), p["d"]["shown"]), F.concat(F.lit("added value: "), p["a"]["shown"]))
    ident = lambda p: T.identity(p["rule_id"], F.col("path"), p["a"]["number"], F.lit("added"), p["a"]["shown"])
    return F.transform(rules.weakened(F.col("rows")), lambda p: analyzers.found(p["rule_id"], of(p["rule_id"], 2), of(p["rule_id"], 3), p["a"]["number"], T.trim_space(p["a"]["text"]), ident(p), p["a"]["line_ix"], "high", reasons(p)))


def _flags(code: Column, fixture: Column) -> Column:
    """What a hunk says about its diff, as bits."""
    said = lambda kind, words: trust._some_line(kind, lambda low: analyzers._has(low, *words))
    bits = [(~fixture & trust.adds_dependency(), DEPENDENCY), (~fixture & trust.adds_script(), SCRIPT), (trust.is_lockfile(F.col("path")), LOCKED)]
    for i, (*_, gone, come) in enumerate(analyzers.BRANCH):
        bits += [(code & said("deleted", gone), GONE << 2 * i), (code & said("added", come), GONE << 2 * i + 1)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce(test, F.lit(False)), bit).otherwise(0) for test, bit in bits])


def _of_diff() -> Column:
    """Findings of a diff's bits, with their stage."""
    has = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    branch = [F.when(has(GONE << 2 * i) & has(GONE << 2 * i + 1), F.struct(F.lit(r).alias("rule_id"), F.lit(c).alias("category"), F.lit("critical").alias("severity"), F.substring(F.sha2(F.lit(r + t + m), 256), 1, 16).alias("id"))) for i, (r, t, c, m, *_) in enumerate(analyzers.BRANCH)]
    shaped = lambda stage, rows: F.transform(rows, lambda r: F.struct(F.lit(stage).alias("stage"), F.lit("<branch>").alias("path"), _shape(r["id"], r["rule_id"], r["category"], r["severity"]).alias("f")))
    none = F.array().cast("array<struct<rule_id:string,category:string,severity:string,id:string>>")
    return F.concat(shaped(SUPPLY, F.when(has(DEPENDENCY), trust.supply_of_diff(has(SCRIPT), has(LOCKED))).otherwise(none)), shaped(BRANCHES, analyzers.listed(branch)))


def _shape(ident: Column, rule_id: Column, category: Column, severity: Column) -> Column:
    return F.struct(F.lit(0).cast("long").alias("line_ix"), ident.alias("id"), rule_id.alias("rule_id"), category.alias("category"), severity.alias("severity"), F.lit("medium").alias("confidence"), F.lit(1).cast("long").alias("line"), F.lit("branch").alias("side"), F.lit("branch-level regression correlation").alias("snippet"), F.array().cast("array<string>").alias("reasons"))


def review(lines: DataFrame, policy: Policy = Policy(), catalogue: Sequence[Rule] = BUILTIN, custom: Sequence[Rule] = (), whole_files: bool = False) -> DataFrame:
    """Findings (COLUMNS) of diff lines; of whole files only by rules and by the analyzers that need no second side.

    One exchange puts the lines of a hunk together, where they are tagged with the rules
    they meet, and all that reads hunks runs on that row; the findings, and what a hunk
    says about its diff, meet by (diff, finding) in the second and last exchange."""
    chosen = [r for r in (*catalogue, *custom) if findings.in_profile(policy.profile, r.id, r.category)]
    marked = rules.tagged(lines.repartition("diff_id", "hunk_ix"), chosen, policy.allow_values, policy.allow_regexes, policy.ignore, policy.allow_paths, skip_artifacts=True)
    number = F.when(F.col("kind") == "deleted", F.col("old_no")).otherwise(F.col("new_no"))
    together = F.sort_array(F.collect_list(F.struct("line_ix", "kind", "text", number.cast("long").alias("number"), "rules")))
    hunks = marked.groupBy(*HUNK, "path").agg(together.alias("rows"))
    texts = F.filter("rows", lambda x: x["text"].isNotNull())
    hunks = hunks.withColumns({"hunk_text": F.array_join(F.transform("rows", lambda x: x["text"]), "\n")})
    hunks = hunks.withColumn("fails", rules.failed(chosen)).withColumn("hits", _hits(F.col("rows"), F.col("fails"))).withColumn("rows", texts)
    hunks = hunks.withColumns({"first_no": F.get("rows", F.lit(0))["number"], "added": F.filter("rows", lambda x: x["kind"] == "added")})

    path = F.col("path")
    code, fixture, any_ = T.executable(path), T.fixture(path), F.size("rows") > 0
    stages = [(FLOWS, code & (F.size("added") > 0), analyzers.flows_found()), (GO, goflows.reads_go(path), goflows.go_found()), (NONCES, code, trust.nonces_found()), (SIGNATURES, code, analyzers.signatures_found())]
    if not whole_files:
        stages += [(MANIFESTS, analyzers.is_manifest(path), analyzers.manifests_found()), (SUPPLY, ~fixture, trust.supply_found(policy.allow_packages, policy.deny_packages, policy.trusted_registries)), (DOWNGRADES, F.lit(True), _downgrades_found()), (INTENTS, code, trust.intents_found())]
        stages += [(SNAPSHOTS, F.lit(True), trust.snapshots_found(policy.snapshots))] if policy.snapshots else []
    none, empty = F.array().cast(NO_FINDINGS), F.lit(None)
    of = lambda stage, rows: F.transform(rows, lambda f: F.struct(F.lit(stage).alias("stage"), empty.cast("int").alias("rule_ix"), path.alias("path"), empty.cast("string").alias("text"), f.alias("f")))
    found = [F.col("hits"), *[of(stage, F.when(fits & any_, rows).otherwise(none)) for stage, fits, rows in stages]]
    if not whole_files:
        hunks = hunks.withColumn("flags", F.when(any_, _flags(code, fixture)).otherwise(0))
        found.append(of(OF_DIFF, F.when(F.col("flags") > 0, F.array(empty.cast(NO_FINDINGS[6:-1]))).otherwise(none)))
    else:
        hunks = hunks.withColumn("flags", F.lit(0))
    rows = hunks.select(*HUNK, "flags", F.explode(F.concat(*found)).alias("x")).select(*HUNK, "flags", "x.*")
    # The table of rules has one row for each rule of the call, however many findings there are.
    named = rows.join(F.broadcast(rules.infos(lines.sparkSession, chosen)), "rule_ix", "left").withColumns({"confidence": rules.raised_confidence(), "snippet": rules.shown(), "reasons": rules.explained()})
    ident = T.identity(F.col("rule_id"), path, F.col("f.line"), F.col("f.side"), F.col("snippet"))
    by_rule = F.struct("f.line_ix", ident.alias("id"), "rule_id", "category", "severity", "confidence", "f.line", "f.side", "snippet", "reasons")
    filled = named.select(*HUNK, "flags", "stage", "rule_ix", "path", F.when(F.col("rule_ix").isNotNull(), by_rule).otherwise(F.col("f")).alias("f"))
    # Findings meet by their ids, those of a snapshot by its number and path, what is said of a diff by nothing else.
    key = F.when(F.col("stage") == OF_DIFF, "").when(F.col("stage") == SNAPSHOTS, F.concat_ws("|", "f.line_ix", "path")).otherwise(F.col("f.id"))
    order = F.struct("file_ix", "hunk_ix", "f.line_ix", F.coalesce("rule_ix", F.lit(0)), "f.rule_id")
    recorded = F.collect_list(F.when(F.col("stage") == SNAPSHOTS, F.struct("file_ix", "hunk_ix", "path", "f")))
    met = filled.groupBy("diff_id", "stage", key.alias("key")).agg(F.min_by(F.struct("path", "f"), order).alias("first"), F.bit_or("flags").alias("flags"), F.sort_array(recorded).alias("recorded"))
    final = F.when(F.col("stage") == OF_DIFF, _of_diff()).when(F.col("stage") == SNAPSHOTS, _of_files(F.col("recorded"))).otherwise(F.array(F.struct("stage", "first.path", "first.f")))
    union = met.select("diff_id", F.explode(final).alias("x")).select("diff_id", "x.stage", "x.path", "x.f.*").withColumn("line", F.col("line").cast("int"))
    zoned = findings.zoned(findings.of_profile(union, policy.profile), policy.restricted, policy.critical, policy.fail_on)
    return findings.at_least(zoned, policy.severity).select(*COLUMNS)


def _of_files(recorded: Column) -> Column:
    """Of a snapshot's findings in the hunks of a path, in order: the first of each file, and of equal ids the first."""
    firsts = F.filter(recorded, lambda x, i: (i == 0) | (F.get(recorded, i - 1)["file_ix"] != x["file_ix"]))
    alone = F.filter(firsts, lambda x, i: ~F.exists(F.slice(firsts, 1, i), lambda y: y["f"]["id"] == x["f"]["id"]))
    return F.transform(alone, lambda x: F.struct(F.lit(SNAPSHOTS).alias("stage"), x["path"].alias("path"), x["f"].alias("f")))


def _hits(rows: Column, fails: Column) -> Column:
    """The rules that lines meet, as findings to be named by their rules."""
    bare = lambda x: F.struct(x["line_ix"].cast("long").alias("line_ix"), *[F.lit(None).cast("string").alias(c) for c in ("id", "rule_id", "category", "severity", "confidence")], x["number"].alias("line"), x["kind"].alias("side"), F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("array<string>").alias("reasons"))
    each = lambda x: F.transform(F.array_except(x["rules"], fails), lambda i: F.struct(F.lit(0).alias("stage"), i.alias("rule_ix"), F.col("path").alias("path"), x["text"].alias("text"), bare(x).alias("f")))
    return F.flatten(F.transform(F.filter(rows, lambda x: F.size(x["rules"]) > 0), each))


def report(lines: DataFrame, policy: Policy = Policy(), baseline: DataFrame | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """Findings in order, without those of a baseline; and one row: files, counts, score, rating, blocked."""
    found = review(lines, policy, **settings)
    found = findings.without_baseline(found, baseline) if baseline is not None else found
    # Every file of the diffs counts, also those that nothing reads.
    return findings.in_order(found), findings.score(findings.summary(found, lines.select("diff_id", "file_ix").distinct(), policy.fail_on))
