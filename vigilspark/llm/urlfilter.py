"""Operator 5: URL filters by a sorted sweep over reversed-host keys.

A rule is a host and a path prefix.  The canonical key of a url is its host with
the labels reversed ("com.example.www"), then its path; a rule then covers an
interval of keys: those of one host whose path starts with the rule's, from the
prefix itself to the prefix and a byte that no UTF-8 text has.  A url belongs to
its host and to every parent of it, so it has a key for each.  Within a host the
keys and both ends of all intervals are sorted together.  Intervals of prefixes
are nested or apart, so the sweep keeps a stack: a rule's beginning puts it on
top of the rules that enclose it, its end leaves those.  A url's key meets the
stack that the last such event before it left, whose top is the longest rule.
Of the hosts of a url, the longest rule wins.

The rules that enclose a rule are found by an equal join with the beginnings of
its prefix, so that a host of many rules costs no more than their text.

Keys of hosts without rules leave before the sort.  A host that many urls share
is split by its own traffic: its rules go to each of its slices, its urls to one
each, and a slice takes at least as many urls as the host has events, so that
copied rules are never more than urls and rules together.  A pair of host and path
is judged once and met again by its rows; a pair of very many rows, and a host of
very many urls, is broadcast.  Everything is DataFrame operations.

Cases.  A null url, or one without "://", has an empty host and path and fits no
rule.  Repeated rows are judged each for itself; equal rules count once, and
where a rule is both allowed and blocked the block wins.  Other columns pass
through; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm import textkit
from vigilspark.llm.store import settle

SLICE_URLS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.")))


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as rows: host_key, prefix, rule, verdict."""
    rows = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        host = host.translate(str.maketrans(UPPER, LOWER))
        key = (".".join(reversed(host.split("."))), slash + path)
        rows[key] = (rule, "block" if "block" in (verdict, rows.get(key, ("", ""))[1]) else verdict)
    return spark.createDataFrame([(h, p, *v) for (h, p), v in rows.items()], "host_key string, prefix string, rule string, verdict string")


_STACK = "array<struct<n:int,rule:string,verdict:string>>"


def stacks(rules: DataFrame) -> DataFrame:
    """The events of the sweep: host_key, place (bytes), kind (0 begins, 2 ends) and the stack of rules open after it, the longest last."""
    begins = rules.select("host_key", "prefix", F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("n")).select("host_key", "prefix", F.left("prefix", F.col("n")).alias("outer"))
    outer = rules.select("host_key", F.col("prefix").alias("outer"), F.struct(F.length("prefix").alias("n"), "rule", "verdict").alias("open"))
    opened = begins.join(outer, ["host_key", "outer"]).groupBy("host_key", "prefix").agg(F.array_sort(F.collect_list("open")).alias("stack"))
    place = F.encode("prefix", "utf-8")
    first = F.struct(place.alias("place"), F.lit(0).alias("kind"), F.col("stack"))
    last = F.struct(F.concat(place, F.unhex(F.lit("FF"))).alias("place"), F.lit(2).alias("kind"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))
    return opened.select("host_key", F.explode(F.array(first, last)).alias("e")).select("host_key", "e.*")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", slices: int | None = None) -> DataFrame:
    """pages with host, path, rule and verdict (default where no rule fits).

    slices: parts that a host's urls are dealt to; by default one for each SLICE_URLS of them, or for as many as its rules have ends."""
    names = [c for c in pages.columns if c == url or c not in ("host", "path", "rule", "verdict")]
    rows = textkit.numbered(pages.select(*names))
    given = F.col(f"in{names.index(url)}")
    parsed = rows.withColumns({"host": host_of(given), "path": path_of(given)})

    # What a rule says depends on host and path alone, so each such pair is judged once.
    asked = settle(parsed.filter("host <> ''").groupBy("host", "path").agg(F.count("*").alias("rows")), "asked")
    labels = F.reverse(F.split("host", r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, 1, k)))
    keys = asked.withColumn("host_key", F.explode(parents))
    ends = stacks(rules)
    traffic = keys.groupBy("host_key").agg(F.count("*").alias("urls")).join(ends.groupBy("host_key").agg(F.count("*").alias("ends")), "host_key")
    parts = settle(traffic.select("host_key", "urls", (F.lit(slices) if slices else F.ceil(F.col("urls") / F.greatest(F.lit(SLICE_URLS), "ends"))).cast("int").alias("parts")), "traffic")
    met = textkit.meet(keys, parts, "host_key", "urls", parts.agg(F.sum("urls")).first()[0] or 0)
    points = met.select("host_key", F.pmod(F.xxhash64("host", "path"), "parts").cast("int").alias("slice"), F.encode("path", "utf-8").alias("place"), F.lit(1).alias("kind"), "host", "path", "rows", F.lit(None).cast(_STACK).alias("stack"))
    events = ends.join(parts, "host_key").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    events = events.select("host_key", "slice", "place", "kind", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("rows"), F.col("stack").cast(_STACK).alias("stack"))

    sweep = Window.partitionBy("host_key", "slice").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = points.unionByName(events).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    fits = swept.select("host", "path", "host_key", "rows", F.try_element_at("stack", F.lit(-1)).alias("hit")).filter("hit is not null")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("hit.rule").alias("n"), F.length("host_key").alias("h"), F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))).alias("best"), F.any_value("rows").alias("rows"))
    best = settle(best.select("host", "path", "best.rule", "best.verdict", "rows"), "urls")
    total = best.agg(F.sum("rows")).first()[0] or 0
    judged = textkit.meet(parsed.filter("host <> ''"), best, ["host", "path"], "rows", total, "left").drop("rows")
    blank = parsed.filter("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return judged.unionByName(blank).select(*textkit.restored(names), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
