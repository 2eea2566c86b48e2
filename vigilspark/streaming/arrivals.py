"""Files as they arrive, as streams: each file once, or each version of a file once.

scanned() is stateless: its source remembers the files it has read.  A tree that is
listed again and again is a stream of listings (path, size, mod_time, content):
changed() keeps the versions seen as keyed state and drops a file that a listing
names unchanged, advance() appends the findings of new versions to a table under
the key of the run's settings, and current() gives the findings of one listing, as
a scan of that tree alone would.  A file that went back to an earlier version isn't
read again either; one that is gone has no row in the listing, and its findings
stay for the day it returns.

The state is one key for each version and lives in the checkpoint beside the
findings, so a stream that broke off goes on where it was and writes each finding
once.  For very many versions, set Spark's RocksDB state store in the session.
Cases: a path with a null size or time is a version too; rows alike in all three
are one version, whatever else they hold; an empty listing has no findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.operators import secrets
from vigilspark.sources import files
from vigilspark.sources.tables import shared_folder as shared_folder

VERSION = ["path", "size", "mod_time"]


def scanned(spark: SparkSession, folder: str, **settings) -> DataFrame:
    """A stream of the findings in files that come to a folder; the source remembers which files it has read."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    rows = raw.select("path", "content", F.col("length").alias("size"))
    return secrets.scan(files.readable(rows).select("path", "content"), **settings)


def changed(listings: DataFrame) -> DataFrame:
    """The rows of a stream of listings whose version of the file hasn't come before."""
    return listings.dropDuplicates(VERSION)


def advance(listings: DataFrame, folder: str, key: str, run: Callable[[DataFrame], DataFrame]) -> None:
    """Read what has come since the last time and append its findings; run makes findings of files and keeps VERSION's columns.

    folder must be shared by driver and executors; key is cache.key_of() of the settings, so others start anew."""
    at = f"{folder}/{key}"
    found = run(changed(listings))
    found.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/findings").trigger(availableNow=True).start().awaitTermination()


def current(listing: DataFrame, folder: str, key: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The findings of the listed versions, from the table that advance() wrote with the same run."""
    spark, at = listing.sparkSession, f"{folder}/{key}/findings"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    schema = run(spark.createDataFrame([], "path string, size long, mod_time long, content string")).schema
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    named = listing.select(*[F.col(c).alias(f"now_{c}") for c in VERSION]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"now_{c}")) for c in VERSION]
    return spark.read.schema(schema).parquet(at).join(named, same, "left_semi")
