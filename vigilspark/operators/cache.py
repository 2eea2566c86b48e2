"""Findings kept from run to run: files unchanged in size and time aren't read again.

The cache is a table (key, path, size, mod_time, findings) under the key of the
run's settings.  A run splits its files by an equal join with it, evaluates the
misses only, and writes a new table: hits and misses of the files that are still
there, which drops the others."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1  # of what a cache holds; another version's is not read


def key_of(parts: Sequence[str]) -> str:
    """The key of a run's settings, in whatever order they are named."""
    return hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest()


def split(files: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """files in those that the cache knows, with their findings, and those it doesn't."""
    known = cache.filter(F.col("key") == key).select("path", "size", "mod_time", "findings").dropDuplicates(["path"])
    on = ["path", "size", "mod_time"]
    return files.select(*on).join(known, on), files.join(known, on, "left_anti")


def through(files: DataFrame, cache: DataFrame, key: str, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(findings of all files, the next cache); run makes findings, which have a path, of the files it is given."""
    hits, misses = split(files, cache, key)
    found = run(misses)
    packed = found.groupBy("path").agg(F.collect_list(F.struct(*found.columns)).alias("findings"))
    kind = packed.schema["findings"].dataType.simpleString()  # names and types, whatever may be null
    fresh = misses.select("path", "size", "mod_time").join(packed, "path", "left").withColumn("findings", F.coalesce("findings", F.array().cast(kind)))
    kept = hits.withColumn("findings", F.col("findings").cast(kind)).unionByName(fresh).select(F.lit(key).alias("key"), "path", "size", "mod_time", "findings")
    return kept.select(F.explode("findings").alias("f")).select("f.*"), kept


def _runs(spark: SparkSession, path: str) -> list[str]:
    """The folders of runs that were written to their end, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={VERSION}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    whole = [s.getPath() for s in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(p.toString() for p in whole)


def load(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The cache that the last whole run saved, or an empty one.  Parts that can't be read are left out, so their files are read again."""
    runs = _runs(spark, path)
    return spark.read.option("ignoreCorruptFiles", "true").schema(schema).parquet(runs[-1]) if runs else spark.createDataFrame([], schema)


def save(kept: DataFrame, path: str) -> None:
    """Write the next cache; the one before stays for whoever reads it, older ones go."""
    spark = kept.sparkSession
    before = _runs(spark, path)
    number = int(before[-1].rpartition("=")[2]) + 1 if before else 0
    kept.write.mode("overwrite").parquet(f"{path}/version={VERSION}/run={number:09d}")  # over a run that broke off
    for old in before[:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
