"""Files of a tree as rows: path, content, size, mod_time; and which of them a review reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import text as T

MAX_FILES = 20_000
MAX_BYTES = 1 << 20
# Folders that no walk enters.
IGNORED = (".git", "node_modules", "vendor", ".venv", "__pycache__", "dist", "build", ".next", "target", "bin", "obj")


def read(spark: SparkSession, root: str, glob: str = "") -> DataFrame:
    """All files below root, by path relative to it; the content is bytes until readable() turns it into text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), "^.*?" + T.re.escape(base) + "/", "")
    return raw.select(relative.alias("path"), "content", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mod_time"))


def outside_ignored(path: Column) -> Column:
    """Whether none of a path's folders is an ignored one."""
    return ~F.exists(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda part: part.isin(*IGNORED))


def gitignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a line of an ignore file fits: from the root if it begins with a slash, else at any depth.  As in the
    review tool, a negated pattern ignores too."""
    tests = []
    for line in patterns:
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        pattern = bare.removeprefix("!")
        name = pattern.removesuffix("/")
        if pattern.startswith("/"):
            name = name.removeprefix("/")
            tests.append(T.any_glob(path, [name]) if any(c in name for c in "*?[") else (path == name) | F.startswith(path, F.lit(name + "/")))
        else:
            tests.append(T.any_glob(path, [f"**/{name}", name, f"**/{name}/**"]))
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def readable(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files of text that aren't too large, their content as a string.  The sizes are tested before a byte is read; bytes that aren't UTF-8 become U+FFFD."""
    small = files.filter(F.col("size") <= max_bytes)
    text = small.filter(F.position(F.lit(b"\0"), F.col("content")) == 0)
    return text.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def every(files: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """What a review of a whole tree reads: no ignored folder, no ignored path; unreadable and large files are passed over."""
    kept = files.filter(outside_ignored(F.col("path")))
    return readable(kept.filter(~gitignored(F.col("path"), patterns)) if patterns else kept)


def named(files: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Files named one by one, by folder or by glob.  A target that names nothing, is absolute or leaves the root is an
    error, and so are more than MAX_FILES of them, and a file named itself that is too large or no text."""
    for t in targets:
        if t.startswith("/") or ".." in t.split("/"):
            raise ValueError(f"target outside the root: {t}")
    path = F.col("path")
    fits = [T.any_glob(path, [t]) if any(c in t for c in "*?[") else (path == t.rstrip("/")) | (F.startswith(path, F.lit(t.rstrip("/") + "/")) if t.strip("./") else F.lit(True)) for t in targets]
    chosen = files.filter(outside_ignored(path)).withColumn("targets", F.filter(F.array(*[F.when(f, i) for i, f in enumerate(fits)]), lambda x: x.isNotNull())).filter(F.size("targets") > 0)
    bad = path.isin(*targets) & ((F.col("size") > MAX_BYTES) | (F.position(F.lit(b"\0"), F.col("content")) > 0))
    found = chosen.agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("targets"))).alias("seen"), F.min(F.when(bad, path)).alias("bad")).first()
    if missing := [t for i, t in enumerate(targets) if i not in found.seen]:
        raise ValueError(f"no file for {', '.join(missing)}")
    if found.bad is not None:
        raise ValueError(f"{found.bad} is no text or larger than {MAX_BYTES} bytes")
    if found.n > MAX_FILES:
        raise ValueError(f"{found.n} files, more than {MAX_FILES}")
    return readable(chosen.drop("targets"))


def for_secrets(files: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """What a secret scan reads: as every(), without test files."""
    return every(files.filter(~F.endswith("path", F.lit("_test.go"))), patterns)
