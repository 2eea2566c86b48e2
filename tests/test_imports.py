"""Imports are found where a file's row is, and a module is one row of a join."""

import random
import re

from vigilspark.operators import context, imports
from vigilspark.sources import lines


def tree(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def naive(content):
    """The imports of a script, one pattern after the other."""
    found = {}
    for kind, pattern in imports.SCRIPT:
        for m in re.finditer(pattern, content):
            line, module = content.count("\n", 0, m.start()) + 1, m.group(1).strip(" ")
            if module:
                found.setdefault((kind, module, line), m.start())
    rows = sorted((at, line, module, kind) for (kind, module, line), at in found.items())
    return [(module, kind, line, i + 1) for i, (_, line, module, kind) in enumerate(rows[: imports.MAX_IMPORTS])]


def test_imports_of_scripts_are_read_in_place(spark):
    rng = random.Random(4)
    parts = ["import a from './a'", 'import {\n b } from "./b"', "require('./c')", "require( ' d ' )", "export * from './e'", "import('./f')", "import('./f')", "é字", "\n", "\n", " ", ";", "import x", " from ", "export y", "'"]
    files = {f"r{i}.ts": "".join(rng.choice(parts) for _ in range(n)) for i, n in enumerate((0, 1, 5, 5, 20, 20, 60, 60, 150, 900))}
    files |= {"many.js": "".join(f"import x from './m{i // 2}'\n" for i in range(100)), "one_line.js": "require('./s');" * 300 + "require('./t')"}
    rows = imports.imports(tree(spark, files))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {p: [] for p in files}
    for r in sorted(rows.collect(), key=lambda r: r.nth):
        got[r.path].append((r.module, r.kind, r.line, r.nth))
    assert got == {p: naive(c) for p, c in files.items()}
    assert len(got["many.js"]) == imports.MAX_IMPORTS and [m for m, *_ in got["one_line.js"]] == ["./s", "./t"]


def meant(path, module, files):
    """The file that a script's module means, by all its probes in order."""
    if not module.startswith(("./", "../")):
        return None
    base, last = f"{path.rpartition('/')[0]}/{module}", module.rpartition("/")[2]
    bare = last in (".", "..") or not re.search(r"\.[^./]+$", last)
    for end in ["", *imports.SCRIPT_ENDS, *[f"/index{e}" for e in imports.SCRIPT_ENDS]] if bare else [""]:
        parts, out = [], False
        for part in (base + end).split("/"):
            if part == "..":
                out, parts = out or not parts, parts[:-1]
            elif part not in ("", "."):
                parts.append(part)
        if not out and "/".join(parts) in files:
            return "/".join(parts)
    return None


def test_modules_mean_the_first_of_their_files(spark):
    files = ["web/a.ts", "web/x.ts", "web/x.js", "web/x/index.tsx", "web/x/index.ts", "web/.ts", "web/..ts", "web/lib/index.mjs", "web/lib/index", "index.tsx", "root.cjs", "up.mjs", "web/n.d.ts", "web/n.d", "web/only/index.jsx", "web/index.js", "web.ts", "...js", "web/y.py", "web/lib/.js"]
    modules = ["./x", "./x.ts", "./x/", "./", ".", "..", "../", "./.", "./..", "../..", "./lib", "./lib/.", "./lib/..", "./lib/../x", "../../x", "../../../x", "../up", "./n.d", "./n.d.ts", "./n", "./x/index", "./only//", "../web", "./index", "x", "./lib/index", "./y.py", "./gone"]
    froms = ["web/a.ts", "root.cjs", "web/x/index.ts"]
    refs = spark.createDataFrame([(p, m, "import", 1, i) for p in froms for i, m in enumerate(modules)], "path string, module string, kind string, line int, nth int")
    rows = imports.resolved(refs, tree(spark, dict.fromkeys(files, "")))
    got = {(r.path, r.module): r.target for r in rows.collect()}
    want = {(p, m): meant(p, m, files) for p in froms for m in modules}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 30
    # A module isn't multiplied by the files that it may mean.
    assert "/index.tsx" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_discovery_reads_texts_once(spark):
    """What is joined, level by level, is the table of edges, and no text."""
    files = {"a.ts": "import x from './b'\nimport y from './c'", "b.ts": "import('./c')", "c.ts": "export * from './d'", "d.ts": ""}
    seeds = spark.createDataFrame([("r", "a.ts")], "review_id string, path string")
    rows = imports.discover_each(seeds, tree(spark, files))
    assert [(r.path, r["from"], r.depth) for r in sorted(rows.collect(), key=lambda r: r.place)] == [("b.ts", "a.ts", 1), ("c.ts", "a.ts", 1), ("d.ts", "c.ts", 2)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "regexp_extract_all" not in plan


def test_context_is_found_once(spark):
    """The lines of a change's context come from a table of what was found: the search isn't run again for each reader."""
    files = tree(spark, {"a.ts": "import x from './b'\nimport y from './a'", "b.ts": "one\ntwo", "c.ts": "unread"})
    change = spark.createDataFrame([("1", "diff --git a/a.ts b/a.ts\n+++ b/a.ts\n@@ -1 +1 @@\n+x\n")], "diff_id string, raw string")
    out = context.with_context(lines.diff_lines(change), files)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and plan.count("LeftSemi") == 1
    assert [(r.path, r.line_ix, r.text) for r in out.filter("context").orderBy("line_ix").collect()] == [("b.ts", 0, "one"), ("b.ts", 1, "two")]
