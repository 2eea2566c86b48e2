"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and everything runs in one machine, as in tests, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = getattr(shared_dir, "own", None)
        if not at:
            at = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="vigilspark-")
    return at.rstrip("/")


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    The result has no lineage, so lost executors cost nothing that came before
    it, and several readers share one computation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = (table, path)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for table in tables:
        held, path = _paths.pop(id(table), (None, ""))
        if held is table:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables settled so far, once the results that read them are written."""
    discard(*[table for table, _ in list(_paths.values())])
