"""The import graph of a tree: what files import, which files those are, and what a review should read beside its files.

Imports are matches of patterns over contents or lines; a module's possible
files are probes in order, and the first that exists is met by an equal join.
Discovery goes by depth: each level is a join of the files taken last with the
edges, and a greedy choice in each review.  Go's package clauses are read by their usual layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.sources.files import outside_ignored
from vigilspark.sources.tables import written

MAX_IMPORTS, MAX_DEPTH, MAX_FILES, MAX_BYTES, MAX_TOTAL, GO_FILES, SEED_BYTES = 64, 2, 50, 256 << 10, 2 << 20, 16, 1 << 20
# How the languages import, and what their files end in.
SCRIPT = (("import", r"""(?s)import\s+.*?\s+from\s+['"]([^'"]+)['"]"""), ("require", r"""require\(\s*['"]([^'"]+)['"]\s*\)"""), ("export-from", r"""(?s)export\s+.*?\s+from\s+['"]([^'"]+)['"]"""), ("dynamic-import", r"""import\(\s*['"]([^'"]+)['"]\s*\)"""))
PY_FROM, PY_IMPORT = r"^\s*from\s+([.A-Za-z_][A-Za-z0-9_.]*)\s+import\s+(.+)$", r"^\s*import\s+(.+)$"
JVM_IMPORT = r"^\s*import\s+(?:static\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*;"
GO_BLOCK, GO_ONE = r'(?s)\bimport\s*\(([^)]*)\)', r'^\s*import\s+(?:[A-Za-z_.][A-Za-z0-9_]*\s+)?"([^"]+)"'
SCRIPT_ENDS = (".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs")
JVM_ROOTS = ("src/main/java/", "src/main/kotlin/", "src/test/java/", "src/test/kotlin/", "")
REASONS = {"require": "required", "export-from": "re-exported", "dynamic-import": "dynamically imported"}


_FOUND = "array<struct<at:int,line:int,module:string,kind:string>>"


def _entry(at: Column, line: Column, module: Column, kind: str) -> Column:
    return F.struct(at.cast("int").alias("at"), line.cast("int").alias("line"), module.alias("module"), F.lit(kind).alias("kind"))


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _put(found: Column, e: Column) -> Column:
    """found with one more import, unless it has MAX_IMPORTS or the same of that line."""
    new = (e["module"] != "") & (F.size(found) < MAX_IMPORTS) & ~F.exists(found, lambda f: (f["kind"] == e["kind"]) & (f["module"] == e["module"]) & (f["line"] == e["line"]))
    return F.when(new, F.array_append(found, e)).otherwise(found)


def _matches(content: Column, kind: str, pattern: str) -> Column:
    """The first MAX_IMPORTS matches of a pattern, each at its place.

    Nothing between two matches fits the pattern, so a match is where its text next stands."""
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("breaks"), F.array().cast(_FOUND).alias("found"))

    def step(s: Column, match: Column) -> Column:
        def taken(at: Column) -> Column:
            breaks = s["breaks"] + _breaks(F.substring(content, s["next"], at - s["next"]))
            module = F.trim(F.regexp_extract(match, T.re2(pattern), 1))
            return T.let(_entry(at - 1, breaks + 1, module, kind), lambda e: F.struct((at + F.length(match)).alias("next"), (e["line"] - 1 + _breaks(match)).alias("breaks"), _put(s["found"], e).alias("found")))

        return F.when(F.size(s["found"]) < MAX_IMPORTS, T.let(F.position(match, content, s["next"]), taken)).otherwise(s)

    return F.aggregate(F.regexp_extract_all(content, F.lit(T.re2(pattern)), F.lit(0)), start, step, lambda s: s["found"])


def _of_lines(content: Column, of: Callable[[Column, Column], Column]) -> Column:
    """What of (text, line number) finds in each line, an array."""
    return F.flatten(F.transform(F.split(content, "\n"), lambda text, i: of(text, i + 1)))


def imported(path: Column, content: Column) -> Column:
    """imports() of one file: an array of (at, line, module, kind) in order.  The file is read where its row is."""
    group = lambda text, pattern, k: F.regexp_extract(text, T.re2(pattern), k)
    first = lambda c: F.split(F.trim(c), r"\s+")[0]
    bare = lambda c: F.trim(F.split(c, "#")[0])
    zero, none = F.lit(0), F.array().cast(_FOUND)

    def whole(module: Column, kind: str, line: Column) -> Column:
        return F.when(module != "", F.array(_entry(zero, line, module, kind))).otherwise(none)

    def python(text: Column, line: Column) -> Column:
        source, names, plain = group(text, PY_FROM, 1), group(text, PY_FROM, 2), group(text, PY_IMPORT, 1)
        dots_only = F.regexp_replace(source, r"\.", "") == ""
        module = F.when(~dots_only, source).otherwise(F.concat(source, first(F.split(F.regexp_replace(bare(names), r"^[()]+|[()]+$", ""), ",")[0])))
        listed = F.transform(F.split(bare(plain), ","), lambda part, at: _entry(at, line, first(part), "import"))
        return F.when(source != "", F.array(_entry(zero, line, module, "from-import"))).when(plain != "", listed).otherwise(none)

    def go_block(content: Column) -> Column:
        one = r'^\s*(?:[A-Za-z_.][A-Za-z0-9_]*\s+)?"([^"]+)"'
        before = lambda block: _breaks(F.left(content, F.position(block, content) - 1))
        return T.let(group(content, GO_BLOCK, 1), lambda block: F.when(block != "", T.let(before(block), lambda n: _of_lines(block, lambda text, i: whole(F.regexp_extract(text, one, 1), "import", n + i)))).otherwise(none))

    def found(f: Column) -> Column:
        language, content = f["language"], f["content"]
        script = F.concat(*[_matches(content, kind, pattern) for kind, pattern in SCRIPT])
        jvm = _of_lines(content, lambda text, line: whole(group(text, JVM_IMPORT, 1), "import", line))
        go = F.concat(_of_lines(content, lambda text, line: whole(group(text, GO_ONE, 1), "import", line)), go_block(content))
        return F.when(language.isin("javascript", "typescript"), script).when(language == "python", _of_lines(content, python)).when(language == "jvm", jvm).when(language == "go", go).otherwise(none)

    rows = F.sort_array(T.let(F.struct(T.language(path).alias("language"), content.alias("content")), found))
    return F.aggregate(rows, none, _put)


def imports(files: DataFrame) -> DataFrame:
    """(path, content) -> path, module, kind, line, nth: a file's first MAX_IMPORTS imports, equal ones of a line once."""
    return _numbered(files.select("path", imported(F.col("path"), F.col("content")).alias("imports")))


def _numbered(read: DataFrame) -> DataFrame:
    return read.select("path", F.posexplode("imports").alias("i", "x")).select("path", "x.module", "x.kind", "x.line", (F.col("i") + 1).alias("nth"))


def _clean(path: Column) -> Column:
    """A path without . and .. parts; one that leaves the root is null."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(s: Column, p: Column) -> Column:
        up = p == ".."
        return F.struct(F.when(up, F.slice(s["parts"], F.lit(1), F.greatest(F.size(s["parts"]) - 1, F.lit(0)))).otherwise(F.array_append(s["parts"], p)).alias("parts"), (s["out"] | (up & (F.size(s["parts"]) == 0))).alias("out"))

    return F.aggregate(parts, start, step, lambda s: F.when(~s["out"], F.array_join(s["parts"], "/")))


#: How a module's path names a file: by itself, without the ending, or as the folder of its index.
AS_IT_IS, WITH_END, INDEX = 1, 2, 4


def _listed(files: DataFrame) -> DataFrame:
    """target, key, way, rank: the names under which modules may ask for each file, at most three; a lower rank goes first.

    So a module is one row of the join, and not one for each file that it may mean."""
    path, ends = F.col("path"), F.array(*[F.lit(e) for e in SCRIPT_ENDS])
    end = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    nth = F.array_position(ends, end).cast("int")
    stem = F.left(path, F.length(path) - F.length(end))
    folder = F.when(stem == "index", "").when(F.endswith(stem, F.lit("/index")), F.left(stem, F.length(stem) - 6))
    way = lambda key, way, rank: F.struct(key.alias("key"), F.lit(way).alias("way"), rank.alias("rank"))
    ways = F.array(way(path, AS_IT_IS, F.lit(0)), way(F.when(nth > 0, stem), WITH_END, nth), way(F.when(nth > 0, folder), INDEX, nth + len(SCRIPT_ENDS)))
    return files.select(path.alias("target"), F.explode(ways).alias("w")).select("target", "w.*").filter("key is not null")


def resolved(refs: DataFrame, files: DataFrame, go_module: str = "") -> DataFrame:
    """imports() rows with target: the local file that each means, if there is one (of a Go package its first files)."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    asked = refs.withColumn("language", T.language(F.col("path"))).withColumn("ref", F.monotonically_increasing_id())
    module = F.col("module")
    base, last = F.concat_ws("/", folder, module), F.regexp_extract(module, r"([^/]*)$", 1)
    bare_end, named = ~last.rlike(r"\.[^./]+$") | last.isin("..", "."), ~last.isin("", ".", "..")
    probe = lambda key, fits, place=0: F.struct(key.alias("key"), F.lit(fits).alias("fits"), F.lit(place).alias("place"))
    # What an ending is put to differs from the path itself only where that ends in no name.
    before_end = _clean(F.concat(base, F.lit(".js")))
    apart = F.array(probe(_clean(base), AS_IT_IS | INDEX), probe(F.left(before_end, F.length(before_end) - 3), WITH_END))
    relative = F.startswith(module, F.lit("./")) | F.startswith(module, F.lit("../"))
    script = F.when(relative, F.when(~bare_end, F.array(probe(_clean(base), AS_IT_IS))).when(named, F.array(probe(_clean(base), AS_IT_IS | WITH_END | INDEX))).otherwise(apart))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    up = F.when(dots > 0, F.concat(folder, F.repeat(F.lit("/.."), dots - 1))).otherwise("")
    within = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    python = F.when(within != "", F.array(F.concat(up, F.lit("/"), within, F.lit(".py")), F.concat(up, F.lit("/"), within, F.lit("/__init__.py")))).otherwise(F.array(F.concat(up, F.lit("/__init__.py"))))
    slashed = F.replace(module, F.lit("."), F.lit("/"))
    jvm = F.array(*[F.concat(F.lit(root), slashed, F.lit(end)) for root in JVM_ROOTS for end in (".java", ".kt")])
    in_order = lambda raws: F.transform(raws, lambda raw, i: F.struct(_clean(raw).alias("key"), F.lit(AS_IT_IS).alias("fits"), i.alias("place")))
    probes = F.when(F.col("language").isin("javascript", "typescript"), script).when(F.col("language") == "python", in_order(python)).when(F.col("language") == "jvm", in_order(jvm))
    tried = asked.filter("language <> 'go'").select("*", F.explode(probes).alias("probe")).select("ref", *refs.columns, "probe.*").filter("key is not null")
    hits = tried.join(_listed(files), "key").filter(F.col("fits").bitwiseAND(F.col("way")) != 0)
    hits = hits.groupBy("ref", "path", "module", "kind", "line", "nth").agg(F.min_by("target", F.col("place") + F.col("rank")).alias("target")).drop("ref")
    if not go_module:
        return hits
    package = F.regexp_replace(F.substring(module, len(go_module) + 1, 1 << 30), "^/", "")
    sources = files.select(F.col("path").alias("target"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("package")).filter(F.endswith("target", F.lit(".go")) & ~F.endswith("target", F.lit("_test.go"))).distinct()
    first = sources.withColumn("n", F.row_number().over(Window.partitionBy("package").orderBy("target"))).filter(F.col("n") <= GO_FILES).drop("n")
    go = asked.filter((F.col("language") == "go") & F.startswith(module, F.lit(go_module))).withColumn("package", package).join(first, "package")
    return hits.unionByName(go.select("path", "module", "kind", "line", "nth", "target"))


def discover(seeds: DataFrame, files: DataFrame, go_module: str = "", depth: int = MAX_DEPTH, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, max_total: int = MAX_TOTAL) -> DataFrame:
    """path, from, reason, depth of the files that the seeds (path) import, directly or through others: discover_each() of one review."""
    return discover_each(seeds.select(F.lit(0).alias("review_id"), "path"), files, go_module, depth, max_files, max_bytes, max_total).select("path", "from", "reason", "depth")


def discover_each(seeds: DataFrame, files: DataFrame, go_module: str = "", depth: int = MAX_DEPTH, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, max_total: int = MAX_TOTAL) -> DataFrame:
    """review_id, path, from, reason, depth, place: what the seeds (review_id, path) of each review import, directly or through others, nearest first.

    Files are taken greedily in the order of a search by breadth: seeds by path, imports
    as they stand, and then those of the files taken.  One of more than max_bytes, or
    that would bring a review above max_total together with its seeds and what it took
    before, is left out alone, and so is what it imports; a review ends at max_files.

    A level is a join with the edges; a review's candidates, MAX_IMPORTS of each seed or
    file taken at most, are one group, over which a fold carries what is taken.
    The tree's imports and edges are written when this is called."""
    # The texts are read once; what they import is small.
    size = F.octet_length("content").cast("long")
    texts = files.filter(~F.contains("content", F.lit("\0")) & (size <= max(max_bytes, SEED_BYTES)))
    sized = written(texts.select("path", size.alias("bytes"), imported(F.col("path"), F.col("content")).alias("imports")), "tree")
    known = sized.filter((F.col("bytes") <= max_bytes) & outside_ignored(F.col("path")))
    edges = resolved(_numbered(sized), known, go_module).select(F.col("path").alias("from"), F.col("target").alias("path"), "kind", "nth").join(sized.select("path", "bytes"), "path")
    edges, sized = written(edges, "edges"), sized.select("path", "bytes")
    own = seeds.select("review_id", "path").distinct().join(sized.filter(F.col("bytes") <= SEED_BYTES), "path")
    taken_type = "array<struct<path:string,from:string,kind:string,depth:int>>"
    state = own.groupBy("review_id").agg(F.sort_array(F.collect_list("path")).alias("frontier"), F.sum("bytes").alias("total"))
    state = state.withColumns({"seen": F.col("frontier"), "taken": F.array().cast(taken_type)})
    for level in range(1, depth + 1):
        asking = state.select("review_id", F.posexplode("frontier").alias("at", "from"))
        wanted = asking.join(edges, "from").groupBy("review_id").agg(F.sort_array(F.collect_list(F.struct("at", "nth", "path", "from", "kind", "bytes"))).alias("wanted"))
        step = _taken(F.col("wanted"), level, max_files, max_total)
        state = state.join(wanted, "review_id", "left").select("review_id", F.size("taken").alias("before"), step.alias("s"))
        state = state.select("review_id", F.transform(F.slice("s.taken", F.col("before") + 1, F.size("s.taken")), lambda x: x["path"]).alias("frontier"), "s.total", "s.seen", "s.taken")
    reason = F.lit("imported")
    for kind, text in REASONS.items():
        reason = F.when(F.col("x.kind") == kind, text).otherwise(reason)
    return state.select("review_id", F.posexplode("taken").alias("place", "x")).select("review_id", "x.path", "x.from", reason.alias("reason"), "x.depth", "place")


def _taken(wanted: Column, level: int, max_files: int, max_total: int) -> Column:
    """The state (total, seen, taken) of a review after its candidates of a level, in order."""
    start = F.struct("total", "seen", "taken")

    def step(s: Column, c: Column) -> Column:
        fits = (F.size(s["taken"]) < max_files) & ~F.array_contains(s["seen"], c["path"]) & (s["total"] + c["bytes"] <= max_total)
        new = F.struct(c["path"].alias("path"), c["from"].alias("from"), c["kind"].alias("kind"), F.lit(level).alias("depth"))
        return F.when(fits, F.struct((s["total"] + c["bytes"]).alias("total"), F.array_append(s["seen"], c["path"]).alias("seen"), F.array_append(s["taken"], new).alias("taken"))).otherwise(s)

    return F.when(wanted.isNull(), start).otherwise(F.aggregate(wanted, start, step))
