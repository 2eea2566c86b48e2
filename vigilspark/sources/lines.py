"""Tables of lines: from unified diffs, and from whole files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import text as T


def _trim(path: Column) -> Column:
    bare = F.trim(path)
    for side in ("a/", "b/"):
        bare = F.when(bare.startswith(side), F.substring(bare, 3, 1 << 30)).otherwise(bare)
    return F.nullif(bare, F.lit("/dev/null"))


FIELDS = f"{T.BLANK}+"
RANGE = r"^[+-]?[0-9]+$"


def _is_file(v: Column) -> Column:
    return v.startswith("diff --git ")


def _is_hunk(v: Column) -> Column:
    return v.startswith("@@ ")


def _is_head(v: Column) -> Column:
    return v.rlike(r"^(?:diff --git |@@ |--- |\+\+\+ |rename (?:from|to) |(?:new|deleted) file mode )")


def _kind(v: Column) -> Column:
    kind = F.when(v.startswith("+"), "added").when(v.startswith("-"), "deleted").when(v.startswith(" "), "context")
    return F.when(~_is_head(v), kind)


def _fields(v: Column) -> Column:
    """What stands between blanks.  A split at one character compiles no pattern for each line."""
    return F.split(F.trim(F.regexp_replace(v, T.re2(FIELDS), " ")), " ")


def _places(lines: Column, test: Callable[[Column], Column]) -> Column:
    """The places from 0 of the lines that a test fits, in order."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: test(F.get(lines, i)))


def _from(lines: Column, start: Column, next_start: Column) -> Column:
    """The lines from a place up to the next, or to the end."""
    return F.slice(lines, start + 1, F.coalesce(next_start, F.size(lines)) - start)


def _files(diffs: DataFrame) -> DataFrame:
    """diff_id, file_ix, at, hunks, lines: the files of (diff_id, raw) diffs with their lines, the place of the first one and how many hunks the diff has before it.

    A diff is one row, so its parts are cut from the array of its lines and nothing is
    exchanged or sorted.  Before a diff's first file nothing is read, but hunks count."""
    lines = diffs.select("diff_id", F.split(F.replace("raw", F.lit("\r\n"), F.lit("\n")), "\n").alias("lines"))
    all_ = F.col("lines")
    heads = lines.withColumn("heads", _places(all_, lambda v: _is_file(v) | _is_hunk(v)))
    # The j-th head is the f-th of a file: j - f hunks stand before it.
    files = heads.withColumn("files", F.filter(F.transform("heads", lambda p, j: F.struct(p.alias("at"), j.alias("j"))), lambda x: _is_file(F.get(all_, x["at"]))))
    cut = F.transform("files", lambda x, f: F.struct(f.cast("long").alias("file_ix"), x["at"].alias("at"), (x["j"] - f).cast("long").alias("hunks"), _from(all_, x["at"], F.get(F.col("files"), f + 1)["at"]).alias("lines")))
    return files.select("diff_id", F.explode(cut).alias("f")).select("diff_id", "f.*")


def _hunks(files: DataFrame) -> DataFrame:
    """diff_id, file_ix, hunk_ix, at, path, head, lines, and what the header (lines[0]) says, of _files().  A hunk ends with its file."""
    v, lines = F.col("head"), F.col("lines")
    # The last path of a file's headers holds for all its lines.
    renamed = lambda v: v.startswith("rename to ")
    said = lambda v: F.struct(renamed(v).alias("bare"), F.when(_is_file(v), F.get(_fields(v), F.lit(3))).when(renamed(v), F.substring(v, 11, 1 << 30)).otherwise(F.substring(v, 5, 1 << 30)).alias("path"))
    named = F.filter(F.transform(F.filter(lines, lambda v: v.rlike(r"^(?:diff --git |\+\+\+ |rename to )")), said), lambda x: x["path"].isNotNull())
    placed = files.withColumns({"named": F.try_element_at(named, F.lit(-1)), "places": _places(lines, _is_hunk)})
    placed = placed.withColumn("path", F.coalesce(F.when(F.col("named.bare"), F.trim("named.path")).otherwise(_trim(F.col("named.path"))), F.lit("")))
    cut = F.transform("places", lambda p, h: F.struct((F.col("hunks") + h).alias("hunk_ix"), (F.col("at") + p).alias("at"), F.get(lines, p).alias("head"), _from(lines, p, F.get(F.col("places"), h + 1)).alias("lines")))
    whole = lambda c: F.when(c.rlike(T.re2(RANGE)), c.try_cast("long"))
    span = lambda k, sign: F.split(F.regexp_replace(F.get("fields", F.lit(k)), "^" + sign, ""), ",")
    start = lambda k, sign: whole(F.get(span(k, sign), F.lit(0)))
    many = lambda k, sign: F.when(F.size(span(k, sign)) > 1, whole(F.get(span(k, sign), F.lit(1)))).otherwise(F.lit(1))
    hunks = placed.select("diff_id", "file_ix", "path", F.explode(cut).alias("h")).select("diff_id", "file_ix", "path", "h.*").withColumn("fields", _fields(v))
    return hunks.withColumns({
        "old_start": start(1, "-"), "old_many": many(1, "-"), "new_start": start(2, r"\+"), "new_many": many(2, r"\+"),
        "ranges": F.concat_ws(" ", F.get("fields", F.lit(1)), F.get("fields", F.lit(2))), "fields": F.size("fields"),
    })


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, raw) unified diffs as diff_id, file_ix, hunk_ix, line_ix, path, kind, text, old_no, new_no.

    Files and hunks are running counts of their headers within a diff, line
    numbers the hunk's start plus the lines so far.  A diff is read where its row
    is.  As in the review tool whose results these are, a header inside a hunk is
    a header, and deleted files have an empty path.  Lines that diff_errors() is
    about are left out."""
    hunks, numbered = _hunks(_files(diffs)), F.col("old_start").isNotNull() & F.col("new_start").isNotNull()
    # k counts the lines that bear numbers, p those of them on one side.  A context line is the c-th of its kind, so k - p lines before it are on the other side only, and c on both.
    said = F.filter(F.transform("lines", lambda v, i: F.struct(i.alias("i"), _kind(v).alias("kind"), v.alias("v"))), lambda x: x["kind"].isNotNull())
    counted = lambda rows, n, *kept: F.transform(rows, lambda x, at: F.struct(*[x[c].alias(c) for c in ("i", "kind", "v", *kept)], at.alias(n)))
    side = lambda other: counted(F.filter("said", lambda x: x["kind"] != other), "p", "k")
    of = lambda rows, kind: F.filter(rows, lambda x: x["kind"] == kind)
    row = lambda x, old, new: F.struct(x["i"].alias("i"), x["kind"].alias("kind"), x["v"].alias("v"), (F.col("old_start") + old).cast("int").alias("old_no"), (F.col("new_start") + new).cast("int").alias("new_no"))
    no = F.lit(None).cast("int")
    each = hunks.withColumn("said", counted(said, "k")).withColumns({"olds": side("added"), "added": of(side("deleted"), "added")})
    rows = F.concat(F.transform(of("olds", "context"), lambda x, c: row(x, x["p"], c + x["k"] - x["p"])), F.transform(of("olds", "deleted"), lambda x: row(x, x["p"], no)), F.transform("added", lambda x: row(x, no, x["p"])))
    return each.select("diff_id", "file_ix", "hunk_ix", "at", "path", F.explode(F.when(numbered, rows)).alias("x")).select("diff_id", "file_ix", "hunk_ix", (F.col("at") + F.col("x.i")).alias("line_ix"), "path", "x.kind", F.substring("x.v", 2, 1 << 30).alias("text"), "x.old_no", "x.new_no")


def diff_errors(diffs: DataFrame) -> DataFrame:
    """diff_id, line_no, error, value, fatal: what is wrong with (diff_id, raw) diffs.

    Fatal is the first line of a diff that can't be read: a file header of less than four
    fields, a hunk header of less than three or with a range that is no number, a line of a
    hunk with another first character than blank, plus or minus.  Not fatal, and told of the
    hunks before that, is a number of lines other than the header's.  Only what is wrong is
    exchanged."""
    files = _files(diffs)
    told = lambda at, error, value: F.struct(at.alias("line_ix"), error.alias("error"), value.alias("value"))
    nothing = lambda kind: F.lit(None).cast(kind)
    first = F.get("lines", F.lit(0))
    of_files = files.filter(F.size(_fields(first)) < 4).select("diff_id", told(F.col("at"), F.lit("file header"), first).alias("e"), nothing("struct<line_ix:int,end:int,value:string>").alias("short"))
    hunks = _hunks(files).withColumn("counted", F.transform("lines", _kind))
    range_ok = F.col("old_start").isNotNull() & F.col("old_many").isNotNull() & F.col("new_start").isNotNull() & F.col("new_many").isNotNull()
    passed = lambda v: (v == "") | (v == "\\ No newline at end of file")
    loose = F.get(F.filter(F.transform("lines", lambda v, i: F.when(~_is_head(v) & F.get("counted", i).isNull() & ~passed(v), told(F.col("at") + i, F.lit("line prefix"), v))), lambda x: x.isNotNull()), F.lit(0))
    e = F.when(F.col("fields") < 3, told(F.col("at"), F.lit("hunk header"), F.col("head"))).when(~range_ok, told(F.col("at"), F.lit("range"), F.col("head"))).otherwise(loose)
    count = lambda *kinds: F.size(F.filter("counted", lambda k: k.isin(*kinds)))
    short = F.when((F.col("old_many") != count("deleted", "context")) | (F.col("new_many") != count("added", "context")), F.struct(F.col("at").alias("line_ix"), (F.col("at") + F.size("lines") - 1).alias("end"), F.col("ranges").alias("value")))
    wrong = of_files.unionByName(hunks.select("diff_id", e.alias("e"), short.alias("short")).filter("e is not null or short is not null"))
    met = wrong.groupBy("diff_id").agg(F.min("e").alias("e"), F.collect_list("short").alias("short"))
    before = F.filter("short", lambda h: F.col("e").isNull() | (F.col("e.line_ix") > h["end"]))
    row = lambda at, error, value, fatal: F.struct((at + 1).alias("line_no"), error.alias("error"), value.alias("value"), F.lit(fatal).alias("fatal"))
    rows = F.concat(F.filter(F.array(F.when(F.col("e").isNotNull(), row(F.col("e.line_ix"), F.col("e.error"), F.col("e.value"), True))), lambda x: x.isNotNull()), F.transform(before, lambda h: row(h["line_ix"], F.lit("line count"), h["value"], False)))
    return met.select("diff_id", F.explode(rows).alias("x")).select("diff_id", "x.*")


def file_lines(files: DataFrame, as_review: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(path, content) files as path, line_no, text, and the columns to keep.  For a review, CRLF is LF and one empty last line is dropped; a secret scan splits as it is."""
    content = F.regexp_replace("content", "\r\n", "\n") if as_review else F.col("content")
    content = F.regexp_replace(content, "\n\\z", "") if as_review else content
    return files.select("path", *keep, F.posexplode(F.split(content, "\n")).alias("line_ix", "text")).select("path", *keep, (F.col("line_ix") + 1).alias("line_no"), "text")


def files_as_diff(files: DataFrame) -> DataFrame:
    """Files as an all-added diff of one hunk each."""
    return file_lines(files).select(F.col("path").alias("diff_id"), F.lit(0).alias("file_ix"), F.lit(0).alias("hunk_ix"), (F.col("line_no") - 1).alias("line_ix"), "path", F.lit("added").alias("kind"), "text", F.lit(None).cast("int").alias("old_no"), F.col("line_no").alias("new_no"))
