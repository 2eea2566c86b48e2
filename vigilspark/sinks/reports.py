"""Findings as a baseline, as JSON and as SARIF: rows of text, made and written by Spark.

A whole-document sink collects its findings into one row, so it is for the
report of one change; for a corpus of changes there is one document for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.operators import controls
from vigilspark.operators import findings as ops

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
TOOL = "vigilspark"


def baseline(findings: DataFrame) -> DataFrame:
    """rule, path, line of the findings, once each, in order: what findings.without_baseline() takes."""
    return findings.select(F.col("rule_id").alias("rule"), "path", "line").distinct().orderBy("path", "line", "rule")


def write_baseline(findings: DataFrame, path: str) -> None:
    baseline(findings).write.mode("overwrite").json(path)


def read_baseline(spark, path: str) -> DataFrame:
    """A baseline written before; where there is none, an empty one."""
    schema = "rule string, path string, line int"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).filter("rule is not null")


SNAPSHOTS = "id string, path string, anchor string, require array<string>, category string, severity string"


def write_snapshots(table: DataFrame, path: str) -> None:
    """The rows of trust.recorded(), in the order of their paths."""
    table.orderBy("path", "id").write.mode("overwrite").json(path)


def read_snapshots(spark, path: str) -> DataFrame:
    """What trust.snapshots_of() takes; rows without an id or a path are left out."""
    return spark.read.schema(SNAPSHOTS).json(path).filter("id is not null and path is not null")


def _ordered(findings: DataFrame, row: Column) -> Column:
    """row of each finding, the gravest first."""
    rank = -ops.T.severity_rank(F.col("severity"))
    return F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "path", "line", "rule_id", "id", row.alias("row")))), lambda x: x["row"])


def json_reports(findings: DataFrame, infos: DataFrame) -> DataFrame:
    """(diff_id, json): summary, findings and the rules that have any, for each diff with findings."""
    findings = controls.told(findings, infos)
    columns = [c for c in ("id", "rule_id", "title", "category", "severity", "base_severity", "confidence", "path", "line", "side", "zone", "effective_fail_on", "message", "snippet", "remediation", "reasons", "standards") if c in findings.columns]
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ops.T.SEVERITIES]
    of_diff = findings.groupBy("diff_id").agg(F.count("*").alias("findings"), *counts, _ordered(findings, F.struct(*columns)).alias("list"))
    used = findings.select("diff_id", F.col("rule_id").alias("id")).distinct().join(infos, "id").groupBy("diff_id").agg(F.sort_array(F.collect_list(F.struct("id", "title", "category", "severity", "standards"))).alias("rules"))
    summary = F.struct("findings", *ops.T.SEVERITIES)
    return of_diff.join(used, "diff_id", "left").select("diff_id", F.to_json(F.struct(summary.alias("summary"), F.col("list").alias("findings"), F.coalesce("rules", F.array()).alias("rules"))).alias("json"))


def sarif(findings: DataFrame, infos: DataFrame, version: str = "1", profile: str = "") -> DataFrame:
    """(diff_id, sarif): a SARIF 2.1.0 document for each diff with findings; all rules, and the findings as results."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    text = lambda c: F.struct(c.alias("text"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    zone = [F.col(c) if c in findings.columns else F.lit(None).cast("string").alias(c) for c in ("zone", "base_severity", "effective_fail_on")]
    named = F.lit(profile or None).cast("string")
    properties = F.when(zone[0].isNotNull() | named.isNotNull(), F.struct(zone[0].alias("zone"), zone[1].alias("baseSeverity"), zone[2].alias("effectiveFailOn"), named.alias("profile")))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), text(F.col("message")).alias("message"), F.array(place).alias("locations"), properties.alias("properties"))
    titled = controls.told(findings, infos)
    results = titled.groupBy("diff_id").agg(_ordered(titled, result).alias("results"))
    rule = F.struct("id", F.col("title").alias("name"), text(F.col("title")).alias("shortDescription"), F.struct("severity", "category", "standards").alias("properties"))
    known = infos.agg(F.sort_array(F.collect_list(rule)).alias("rules"))  # one row: the rules of a run
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(version).alias("version"), F.col("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))
    return results.crossJoin(F.broadcast(known)).select("diff_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit(SARIF_SCHEMA).alias("$schema"), F.array(run).alias("runs"))).alias("sarif"))


RESULTS = "struct<version:string,runs:array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>,properties:struct<zone:string,baseSeverity:string,effectiveFailOn:string,profile:string>>>>>>"


def sarif_results(documents: DataFrame) -> DataFrame:
    """(diff_id, sarif) documents -> their results as rows: diff_id, place, rule_id, level, message, path, line, zone, base_severity, effective_fail_on, profile."""
    run = F.explode(F.from_json("sarif", RESULTS)["runs"]["results"])
    rows = documents.select("diff_id", run.alias("results")).select("diff_id", F.posexplode("results").alias("place", "r"))
    at = F.col("r.locations")[0]["physicalLocation"]
    return rows.select("diff_id", "place", F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), at["artifactLocation"]["uri"].alias("path"), at["region"]["startLine"].alias("line"), "r.properties.zone", F.col("r.properties.baseSeverity").alias("base_severity"), F.col("r.properties.effectiveFailOn").alias("effective_fail_on"), "r.properties.profile")
