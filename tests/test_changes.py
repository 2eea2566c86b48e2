"""Changes read as a whole: parse errors, context and its budget, the one pass of a review."""

from pyspark.sql import functions as F

from vigilspark.operators import context, imports, review, rules
from vigilspark.sources import lines


def wrong(spark, *raws):
    rows = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "diff_id string, raw string")
    return sorted((r.diff_id, r.line_no, r.error, r.value, r.fatal) for r in lines.diff_errors(rows).collect())


HEAD = "diff --git a/x b/x\n"


def test_errors_of_diffs(spark):
    got = wrong(
        spark, HEAD + "@@ -1 +1 @@\n-a\n+b\n", "diff --git a/x\n@@ -1\n", HEAD + "@@ -1\n", HEAD + "@@ -1,x +1 @@", HEAD + "@@ -a +1 @@\nzz", HEAD + "@@ -1 +1 @@\n-a\n+b\n*c\n*d", "@@ -1\n*a", HEAD + "*loose\n--- a/x\n@@ -1 +1 @@\n\n\\ No newline at end of file\n-a\n+b",
        HEAD + "@@ -1,2 +1 @@\n-a\n+b\n@@ -9 +9 @@\n*", "", None, HEAD + "@@ -1 +1 @@\n-a\r\n+b\r\n", HEAD + "@@ -1 +1 @@\n-a\n+b\n" + HEAD + "*not in a hunk",
    )
    assert got == [
        ("1", 1, "file header", "diff --git a/x", True), ("2", 2, "hunk header", "@@ -1", True), ("3", 2, "range", "@@ -1,x +1 @@", True), ("4", 2, "range", "@@ -a +1 @@", True), ("5", 5, "line prefix", "*c", True),
        ("8", 2, "line count", "-1,2 +1", False), ("8", 6, "line prefix", "*", True),
    ]


def test_lines_of_broken_diffs(spark):
    raw = HEAD + "@@ -3 +5 @@\n-a\n*b\n+c\n@@ -x +1 @@\n+lost\ndiff --git a/q b/w\nloose\n+loose\n@@ -1 +1,2 @@\n+d\n+++ b/n\n e"
    got = [(r.path, r.kind, r.text, r.old_no, r.new_no) for r in lines.diff_lines(spark.createDataFrame([("0", raw)], "diff_id string, raw string")).orderBy("line_ix").collect()]
    assert got == [("x", "deleted", "a", 3, None), ("x", "added", "c", None, 5), ("n", "added", "d", None, 1), ("n", "context", "e", 1, 2)]


def tree(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def found(spark, files, seeds, **limits):
    rows = spark.createDataFrame([(r, p) for r, ps in seeds.items() for p in ps], "review_id string, path string")
    out = {r: [] for r in seeds}
    for x in sorted(imports.discover_each(rows, tree(spark, files), **limits).collect(), key=lambda x: x.place):
        out[x.review_id].append((x.path, x["from"], x.reason, x.depth))
    return out


def greedy(edges, sizes, seeds, max_files, max_bytes, max_total, depth):
    """The same search, one file after the other."""
    queue, seen = [(s, 0) for s in sorted(set(seeds)) if s in sizes], {s for s in seeds if s in sizes}
    total, out = sum(sizes[s] for s, _ in queue), []
    while queue:
        now, at = queue.pop(0)
        for to in edges.get(now, []) if at < depth else []:
            if len(out) >= max_files:
                return out
            if to not in sizes or sizes[to] > max_bytes or total + sizes[to] > max_total or to in seen:
                continue
            seen.add(to)
            total += sizes[to]
            out.append((to, now, at + 1))
            queue.append((to, at + 1))
    return out


def test_a_large_file_loses_only_itself(spark):
    files = {"a.ts": "import x from './b'\nimport x from './c'\nimport x from './d'\n", "b.ts": "b", "c.ts": "import x from './e'\n" + "c" * 900, "d.ts": "d", "e.ts": "e"}
    got = found(spark, files, {"r": ["a.ts"], "all": ["a.ts", "c.ts", "gone.ts"], "none": ["e.ts"]}, max_total=len(files["a.ts"]) + 500)
    assert got == {"r": [("b.ts", "a.ts", "imported", 1), ("d.ts", "a.ts", "imported", 1)], "all": [], "none": []}
    assert [p for p, *_ in found(spark, files, {"r": ["a.ts"]})["r"]] == ["b.ts", "c.ts", "d.ts", "e.ts"]
    assert [p for p, *_ in found(spark, files, {"r": ["a.ts"]}, max_bytes=500)["r"]] == ["b.ts", "d.ts"]


def test_greedy_budgets_of_many_reviews(spark):
    import random

    rng = random.Random(2)
    edges = {f"f{i:02}.ts": [f"f{rng.randrange(45):02}.ts" for _ in range(rng.randrange(6))] for i in range(40)}
    files = {p: "".join(f"import x from './{t[:-3]}'\n" for t in ts) + "x" * rng.randrange(400) for p, ts in edges.items()}
    sizes, once = {p: len(c) for p, c in files.items()}, {p: list(dict.fromkeys(ts)) for p, ts in edges.items()}
    seeds = {f"r{i}": [f"f{rng.randrange(42):02}.ts" for _ in range(rng.randrange(1, 4))] for i in range(25)}
    for max_files, max_total, depth in ((50, 2 << 20, 2), (4, 1500, 2), (3, 900, 3)):
        got = found(spark, files, seeds, max_files=max_files, max_total=max_total, max_bytes=350, depth=depth)
        want = {r: greedy(once, sizes, s, max_files, 350, max_total, depth) for r, s in seeds.items()}
        assert {r: [(p, f, d) for p, f, _, d in x] for r, x in got.items()} == want


DIFF = "diff --git a/app/a.ts b/app/a.ts\n+++ b/app/a.ts\n@@ -1 +1,2 @@\n import b from './b'\n+call(1)\ndiff --git a/app/c.ts b/app/c.ts\n+++ b/app/c.ts\n@@ -1 +1 @@\n+c()\n"


def test_context_follows_a_change(spark):
    files = {"app/a.ts": "import b from './b'\nimport c from './c'\ncall(1)\n", "app/b.ts": "password = 'x'\n\n", "app/c.ts": "import d from './d'", "app/d.ts": "", "app/z.ts": "unread"}
    read = lines.diff_lines(spark.createDataFrame([("1", DIFF), ("2", DIFF.replace("app/a", "app/q").replace("./b", "./d"))], "diff_id string, raw string"))
    out = context.with_context(read, tree(spark, files))
    added = [(r.diff_id, r.path, r.file_ix, r.hunk_ix, r.line_ix, r.new_no, r.text) for r in out.filter("context").orderBy("diff_id", "file_ix", "line_ix").collect()]
    assert added == [("1", "app/b.ts", 2, 2, 0, 1, "password = 'x'"), ("1", "app/b.ts", 2, 2, 1, 2, ""), ("1", "app/d.ts", 3, 3, 0, 1, ""), ("2", "app/d.ts", 2, 2, 0, 1, "")]
    assert out.filter("not context").count() == read.count() and dict(out.drop("context").dtypes) == dict(read.dtypes)
    assert {(r.diff_id, r.path, r.line) for r in rules.evaluate(out.drop("context"), [rules.Rule("p", target="added", require=("password",))]).collect()} == {("1", "app/b.ts", 1)}


def test_a_review_is_one_scan_and_two_exchanges(spark):
    read = lines.files_as_diff(tree(spark, {"a.go": "x"})).withColumn("hunk_ix", F.monotonically_increasing_id())
    plan = review.review(read)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan


def test_documents_of_findings(spark):
    from vigilspark.operators import controls
    from vigilspark.sinks import reports

    read = lines.diff_lines(spark.createDataFrame([("1", DIFF.replace("call(1)", "h := md5(password)"))], "diff_id string, raw string"))
    found = review.review(read, review.Policy(critical=("app/**",), profile="auth"), custom=[rules.Rule("own", category="auth", target="added", require=("c\\(",))])
    told = {r.rule_id: r for r in controls.told(found, controls.infos(spark)).collect()}
    assert told["own"].title == "own" and told["own"].message == controls.OTHER[0] and told["own"].standards == []
    assert all(r.message and r.remediation for r in told.values()) and len(told) > 1
    rows = reports.sarif_results(reports.sarif(found, controls.infos(spark), profile="auth")).collect()
    assert {(r.rule_id, r.path, r.line, r.message, r.zone, r.profile) for r in rows} == {(r.rule_id, r.path, r.line, r.message, r.zone, "auth") for r in controls.told(found, controls.infos(spark)).collect()}
    text = reports.json_reports(found, controls.infos(spark)).first().json
    assert '"remediation"' in text and '"message"' in text


def test_snapshots_from_a_tree_and_back(spark, tmp_path):
    from vigilspark.operators import trust
    from vigilspark.sinks import reports

    files = {"src/a-b/V.ts": "x\nfunction verifyToken(t) {\n  one two_b É c\n}", "src/plain.ts": "function other() {}", ".github/w.js": "function verifyToken() {}", "src/x_test.go": "func verifyToken() {", "source/q.py": "function sanitizeIt() {}"}
    found = trust.repository_anchors(tree(spark, files))
    assert {(r.path, r.line_no, r.name) for r in found.collect()} == {("src/a-b/V.ts", 2, "verifyToken"), ("source/q.py", 1, "sanitizeIt")}
    assert {r.path for r in trust.repository_anchors(tree(spark, files), "src/**").collect()} == {"src/a-b/V.ts"}
    assert {r.path for r in trust.repository_anchors(tree(spark, files), "s*/**").collect()} == {"source/q.py"}
    near = trust.window_tokens(lines.file_lines(tree(spark, files)), found, 1).collect()
    assert {r.path: r.tokens for r in near} == {"src/a-b/V.ts": ["function", "one", "two_b", "verifytoken"], "source/q.py": ["function", "sanitizeit"]}
    reports.write_snapshots(trust.recorded(found), str(tmp_path / "s"))
    table = reports.read_snapshots(spark, str(tmp_path / "s"))
    assert {(r.id, r.path, r.anchor) for r in table.collect()} == {("src.a.b.v.ts.verifytoken", "src/a-b/V.ts", "verifyToken"), ("source.q.py.sanitizeit", "source/q.py", "sanitizeIt")}
    diff = "diff --git a/src/a-b/V.ts b/src/a-b/V.ts\n@@ -9,2 +9,2 @@\n function verifyToken(t) {\n-  signature(t)\n+  return 1\n@@ -50 +50 @@ verifyToken\n-verifyToken.verify()\n+verifyToken.issuer()\n"
    read = lines.diff_lines(spark.createDataFrame([("1", diff)], "diff_id string, raw string"))
    from_table = [tuple(r) for r in trust.snapshots_of(read, table).collect()]
    recorded = [trust.Snapshot(r.id, r.path, r.anchor, tuple(r.require), r.category, r.severity) for r in table.collect()]
    assert [r[2] for r in from_table] == ["src.a.b.v.ts.verifytoken"] and from_table == [tuple(r) for r in trust.snapshots(read, recorded).collect()]


def test_caches_from_run_to_run(spark, tmp_path):
    from vigilspark.operators import cache

    read, path = [], str(tmp_path / "c")

    def run(files):
        return files.filter("content <> ''").select("path", F.col("content").alias("found"))

    def next_run(rows):
        files = spark.createDataFrame([(p, len(c), t, c) for p, c, t in rows], "path string, size long, mod_time long, content string")
        empty = "key string, path string, size long, mod_time long, findings array<struct<path:string,found:string>>"
        old = cache.load(spark, path, spark.createDataFrame([], empty).schema)
        read[:] = sorted(r.path for r in cache.split(files, old, "k")[1].collect())
        found, kept = cache.through(files, old, "k", run)
        cache.save(kept, path)
        return sorted((r.path, r.found) for r in found.collect())

    first = [("a", "x", 1), ("b", "y", 1), ("c", "", 1)]
    assert next_run(first) == [("a", "x"), ("b", "y")] and read == ["a", "b", "c"]
    assert next_run(first) == [("a", "x"), ("b", "y")] and read == []
    assert next_run([("a", "z", 2), ("c", "", 1), ("d", "w", 1)]) == [("a", "z"), ("d", "w")] and read == ["a", "d"]
    runs = sorted((tmp_path / "c" / f"version={cache.VERSION}").iterdir())
    assert len(runs) == 2
    (runs[-1] / "_SUCCESS").unlink()  # the last run broke off: the one before counts
    assert next_run(first) == [("a", "x"), ("b", "y")] and read == []
    for part in sorted((tmp_path / "c" / f"version={cache.VERSION}").iterdir())[-1].glob("part-*.parquet"):
        part.chmod(0o600)
        part.write_bytes(b"broken")
        (part.parent / f".{part.name}.crc").unlink()
    assert next_run(first) == [("a", "x"), ("b", "y")] and read == ["a", "b", "c"]


def test_diffs_are_read_where_their_rows_are(spark):
    """No task gathers the lines of many diffs: a diff's row is exchanged for nothing, and many hunks keep their numbers."""
    files = "".join(f"diff --git a/f{i} b/f{i}\n@@ -{i + 1},2 +{2 * i + 1},2 @@\n a{i}\n-b\n+c\n@@ -90 +90 @@\n+++ b/g{i}\n+d\n" for i in range(300))
    rows = spark.createDataFrame([("1", "@@ -1 +1 @@\n+early\n" + files), ("2", None), ("3", "")], "diff_id string, raw string")
    read = lines.diff_lines(rows)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    got = [(r.file_ix, r.hunk_ix, r.line_ix, r.path, r.kind, r.text, r.old_no, r.new_no) for r in read.orderBy("line_ix").collect()]
    want = []
    for i in range(300):
        at = 2 + 8 * i
        want += [(i, 2 * i + 1, at + 2, f"g{i}", "context", f"a{i}", i + 1, 2 * i + 1), (i, 2 * i + 1, at + 3, f"g{i}", "deleted", "b", i + 2, None), (i, 2 * i + 1, at + 4, f"g{i}", "added", "c", None, 2 * i + 2), (i, 2 * i + 2, at + 7, f"g{i}", "added", "d", None, 90)]
    assert got == want
    # A line count is told of each hunk that lacks its lines; only what is wrong is exchanged.
    told = lines.diff_errors(rows).collect()
    assert sorted((r.line_no, r.error, r.value, r.fatal) for r in told) == sorted((2 + 8 * i + 6, "line count", "-90 +90", False) for i in range(300))
