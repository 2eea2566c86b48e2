"""Changes with their context: the files that changed files import are read along.

Each review (diff_id) is extended by itself; all reviews are found and extended in
the same joins.  Files of the context follow a review's own files, in the order in
which they were found, as one added hunk each.  What is found is written when
with_context() is called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.operators import imports
from vigilspark.sources.lines import file_lines
from vigilspark.sources.tables import written


def seeds(lines: DataFrame) -> DataFrame:
    """(diff_id, path) of the files that a change touches; a deleted one has no path."""
    return lines.filter("path is not null and trim(path) <> ''").select("diff_id", F.trim("path").alias("path")).distinct()


def suggestions(lines: DataFrame, files: DataFrame, **limits) -> DataFrame:
    """diff_id, path, from, reason, depth, place: what each change's files import, among files (path, content)."""
    found = imports.discover_each(seeds(lines).withColumnRenamed("diff_id", "review_id"), files, **limits)
    return found.withColumnRenamed("review_id", "diff_id")


def with_context(lines: DataFrame, files: DataFrame, **limits) -> DataFrame:
    """lines and those of the files that suggestions() finds, but of files that a change has itself; of those, context is true."""
    own = lines.select("diff_id", "path").distinct()
    # Written, as it is read twice; and a small table of paths picks the files, so that the texts of the others stay where they are.
    found = written(suggestions(lines, files, **limits).join(own, ["diff_id", "path"], "left_anti"), "context")
    after = lines.groupBy("diff_id").agg(F.max("file_ix").alias("last_file"), F.max("hunk_ix").alias("last_hunk"))
    placed = found.join(after, "diff_id").select("diff_id", "path", (F.col("last_file") + F.col("place") + 1).alias("file_ix"), (F.col("last_hunk") + F.col("place") + 1).alias("hunk_ix"))
    # A file is read once, however many changes have it in their context.
    read = file_lines(files.join(found.select("path"), "path", "left_semi"))
    typed = {f.name: f.dataType for f in lines.schema.fields}
    added = placed.join(read, "path").select("diff_id", "file_ix", "hunk_ix", (F.col("line_no") - 1).alias("line_ix"), "path", F.lit("added").alias("kind"), "text", F.lit(None).alias("old_no"), F.col("line_no").alias("new_no"))
    added = added.select(*[F.col(c).cast(typed[c]).alias(c) for c in added.columns])
    return lines.select(*added.columns, F.lit(False).alias("context")).unionByName(added.withColumn("context", F.lit(True)))
