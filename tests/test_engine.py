"""The review as a whole: trust, sources, sinks, cache, import graph, custom rules, and the catalogue's coverage."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_review import _lines
from vigilspark.operators import cache, controls, findings, imports, review, rules, trust
from vigilspark.operators.catalogue import BUILTIN
from vigilspark.plans import reviews
from vigilspark.plans.samples import SAMPLES
from vigilspark.sinks import reports
from vigilspark.sources import files as F_


def test_every_rule_but_the_dead_one_fires(spark, tmp_path):
    n = len(reviews.FLAT)
    spark.range(n).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    found = reviews.coverage_review(spark, str(tmp_path)).collect()
    assert {r.id for r in BUILTIN} - {r.rule_id for r in found} == {"supply.workflow.env.secrets"}
    assert len(SAMPLES) == len(BUILTIN) == 175
    assert any(r.snippet.startswith("\t  ") and r.snippet.endswith(" ") for r in found)  # a pattern's snippet is the line as it stands


def test_every_secret_pattern_fires(spark, tmp_path):
    from vigilspark.operators.secrets import PATTERNS
    from vigilspark.plans import queries

    spark.createDataFrame([(i, "prose", "s") for i in range(8 * len(queries.SECRETS))], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.secret_scan(spark, str(tmp_path)).collect()
    assert {r.rule_id for r in found} == {p.id for p in PATTERNS}


def test_trust(spark):
    lines = _lines(
        spark, (0, "package.json", "context", '"dependencies": {'), (0, "package.json", "added", ' "evil-x": "1"'), (0, "package.json", "added", '"fine": "1"'), (0, "package.json", "added", '"prepare": "x"'),
        (1, ".npmrc", "deleted", "registry=https://own.example"), (1, ".npmrc", "added", "registry=https://registry.npmjs.org"),
        (2, "a/v.go", "added", "func VerifyJwt(t) {"), (2, "a/v.go", "deleted", "check(signature)"), (2, "a/v.go", "added", "return nil"),
        (3, "a/w.go", "added", "iv = x"), (3, "a/w.go", "added", "encrypt(iv)"), (3, "a/w.go", "added", "decrypt(iv)"), (4, "x/testdata/package.json", "added", '"evil-y": "1"'),
    )
    got = {r.rule_id for r in trust.supply(lines, ("fine",), ("evil-*",), ("own.example",)).collect()}
    assert got == {"supply.package.denied", "supply.package.untrusted", "supply.registry.drift", "supply.registry.untrusted", "supply.lifecycle.dependency", "supply.lock.missing"}
    assert [(r.rule_id, r.category) for r in trust.intents(lines).collect()] == [("intent.mismatch", "token")]
    assert [(r.rule_id, r.line) for r in trust.nonces(lines).collect()] == [("crypto.nonce.reuse", 10)]
    kept = trust.Snapshot("s.one", "a/*.go", "VerifyJwt", ("signature",))
    assert [(r.rule_id, r.line, r.snippet) for r in trust.snapshots(lines, [kept]).collect()] == [("s.one", 7, "snapshot anchor: VerifyJwt")]
    assert trust.snapshots(lines, []).count() == 0
    code = spark.createDataFrame([("a/v.go", 3, "func Sanitize(x)"), ("a/v.go", 4, "func other()"), ("d.md", 1, "func verify()")], "path string, line_no int, text string")
    assert [(r.name, r.category) for r in trust.anchors(code).collect()] == [("Sanitize", "input")]


def test_review_with_policy(spark):
    lines = _lines(spark, (0, "a/x.go", "added", "h := md5(data)"), (0, "a/x.go", "deleted", "verify(t)"), (0, "a/x.go", "added", "jwt.decode(t)"), (1, "b/y.js", "added", "fetch(req.query.u)"), (2, "package.json", "added", '"left": "latest"'))
    every = review.review(lines)
    assert {"crypto.weakhash", "branch.token.regression", "semantic.ssrf.flow", "supply.version.floating"} <= {r.rule_id for r in every.collect()}
    alone = review.review(lines, whole_files=True)
    assert not {"branch.token.regression", "supply.version.floating"} & {r.rule_id for r in alone.collect()}
    strict = review.Policy(profile="frontend", critical=("b/**",), severity="high", ignore=("a/**",))
    assert {r.category for r in review.review(lines, strict).collect()} <= set(findings.PROFILES["frontend"][0])
    assert review.review(lines, review.Policy(profile="unknown")).count() == 0
    listed, row = review.report(lines, review.Policy(critical=("b/**",)), baseline=spark.createDataFrame([("crypto.weakhash", "a/x.go", 1)], "rule string, path string, line int"))
    ranks = ["critical", "high", "medium", "low"]
    assert [ranks.index(r.severity) for r in listed.collect()] == sorted(ranks.index(r.severity) for r in listed.collect())
    assert row.first().files == 1 and row.first().blocked and "crypto.weakhash" not in {r.rule_id for r in listed.collect()}
    zones = {r.path: (r.zone, r.effective_fail_on) for r in listed.collect()}
    assert zones["b/y.js"] == ("critical", "low") and zones["<branch>"] == (None, None)


def test_gate(spark):
    rows = spark.createDataFrame([("low", None), ("medium", "medium")], "severity string, effective_fail_on string")
    assert [findings.gate(rows.filter(f), t).first().blocked for f, t in (("true", "high"), ("severity = 'low'", "high"), ("severity = 'low'", ""), ("false", "low"))] == [True, False, True, False]


def test_custom_rules():
    with pytest.raises(ValueError, match="pattern"):
        rules.from_records([{"id": "own.one", "forbidden": "x("}])
    made = rules.from_records([{"id": "own.one", "forbidden": r"x\(", "require": ["y"], "mitigate": ["z"], "context": ["near"], "severity": "high", "what": 1, "entropy": 3}, {"id": "own.two", "type": "requiredCall", "when": "r", "middleware": ["m"]}])
    assert made[0].require == (r"x\(", "y") and made[0].absent == ("z",) and made[0].near == ("near",) and made[0].entropy == 3.0 and made[1].calls == ("m",)
    for wrong in ({"id": ""}, {"id": "a", "severity": "bad"}, {"id": "a", "target": "context"}, {"id": "a", "confidence": "sure"}, {"id": "a", "type": "none"}):
        with pytest.raises(ValueError, match="rule"):
            rules.from_records([wrong])
    with pytest.raises(ValueError, match="twice"):
        rules.check([rules.Rule("a"), rules.Rule("a")])


def test_reasons_and_blanks(spark):
    lines = _lines(spark, (0, "a/x.go", "added", "  Port: 90, "), (0, "a/x.go", "added", "\t token"))
    made = [rules.Rule("typed", type="configKeyConstraint", constraint_key="port", max_value=80), rules.Rule("plain", require=("token",), near=("Port",), paths=("a/*",), from_paths=("**/x.go",))]
    got = {r.rule_id: (r.snippet, r.reasons) for r in rules.evaluate(lines, made, allow_values=("",)).collect()}
    assert got["typed"][0] == "Port: 90," and got["plain"][0] == "\t token" and len(got["plain"][1]) == 3


def test_files_of_a_tree(spark, tmp_path):
    for name, data in {"src/a.go": b"package a\r\n", "src/b.bin": b"a\0b", "node_modules/x.js": b"x", "out/c.js": b"c", "src/big.txt": b"x" * (1 << 20) + b"y", "src/a_test.go": b"t", "README": b"r"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    tree = F_.read(spark, str(tmp_path)).cache()
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(F_.every(tree, ["/out/", "# no", "", "!READ*"])) == ["src/a.go", "src/a_test.go"]
    assert paths(F_.for_secrets(tree)) == ["README", "out/c.js", "src/a.go"]
    assert paths(F_.named(tree, ["src/*.go", "out"])) == ["out/c.js", "src/a.go", "src/a_test.go"]
    for wrong in ("../x", "/etc", "nothing/*.go"):
        with pytest.raises(ValueError, match="target|no file"):
            F_.named(tree, [wrong])
    first = F_.every(tree).filter("path = 'src/a.go'").first()
    assert first.content == "package a\r\n" and first.size == 11 and first.mod_time > 0
    ignored = [F_.gitignored(F.lit(p), [g]) for p, g in (("a/b.log", "*.log"), ("a/b.log", "/*.log"), ("x/build/y", "build/"), ("build/y", "/build"), ("builder/y", "/build"))]
    assert list(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(ignored)]).first()) == [True, False, True, True, False]


def test_cache(spark):
    files = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("c", 1, 1, "z")], "path string, size long, mod_time long, content string")
    asked = []

    def run(some):
        asked.append(sorted(r.path for r in some.collect()))
        return some.filter("content <> 'z'").select("path", F.lit(1).alias("line"), F.col("content").alias("snippet"))

    empty = spark.createDataFrame([], "key string, path string, size long, mod_time long, findings array<struct<path:string,line:int,snippet:string>>")
    found, kept = cache.through(files, empty, "k", run)
    assert found.count() == 2 and kept.count() == 3 and asked == [["a", "b", "c"]]
    later = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 5, "y2"), ("d", 1, 1, "w")], files.schema)
    found, kept = cache.through(later, kept, "k", run)
    assert sorted((r.path, r.snippet) for r in found.collect()) == [("a", "x"), ("b", "y2"), ("d", "w")] and asked[1] == ["b", "d"]
    assert sorted(r.path for r in kept.collect()) == ["a", "b", "d"]
    assert cache.split(later, kept, "other")[0].count() == 0 and cache.key_of(["a", "b"]) == cache.key_of(["b", "a"])


def test_sinks(spark, tmp_path):
    lines = _lines(spark, (0, "a/x.go", "added", "h := md5(data)"), (1, "b/y.js", "added", "fetch(req.query.u)"))
    found = review.review(lines, review.Policy(restricted=("a/**",)))
    infos = controls.infos(spark)
    document = json.loads(reports.sarif(found, infos).first().sarif)
    results = document["runs"][0]["results"]
    assert document["version"] == "2.1.0" and len(results) == found.count() and len(document["runs"][0]["tool"]["driver"]["rules"]) == infos.count()
    hashed = next(r for r in results if r["ruleId"] == "crypto.weakhash")
    assert hashed["level"] == "error" and hashed["properties"]["zone"] == "restricted" and hashed["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    written = json.loads(reports.json_reports(found, infos).first().json)
    assert written["summary"]["findings"] == len(written["findings"]) == found.count() and {r["id"] for r in written["rules"]} == {r.rule_id for r in found.collect()}
    at = f"{tmp_path}/base"
    assert findings.without_baseline(found, reports.read_baseline(spark, at)).count() == found.count()
    reports.write_baseline(found, at)
    assert findings.without_baseline(found, reports.read_baseline(spark, at)).count() == 0
    assert controls.explain("crypto.weakhash")["standards"] == ("OWASP-ASVS-V6.2",) and controls.standards("x", ("A", "A")) == ("A",)
    with pytest.raises(KeyError):
        controls.explain("none")


def test_import_graph(spark):
    tree = {
        "web/a.ts": "import x,\n  { y } from './b'\nconst q = require('./lib')\nexport * from '../up'\nawait import('./b')\nimport z from 'react'",
        "web/b.tsx": "import './no'\nimport c from './c.js'", "web/lib/index.js": "", "up.ts": "x", "web/c.js": "import d from './d'", "web/d.js": "import e from './e'", "web/e.js": " ",
        "pkg/m.py": "import os, pkg.n  # both\nfrom . import o\nfrom .p import q\nfrom ..up import r", "pkg/n.py": "1", "pkg/o.py": "1", "pkg/p/__init__.py": "1",
        "src/main/java/com/x/A.java": "import com.x.B;\nimport static com.x.B.c;", "src/main/java/com/x/B.java": "class B {}",
        "cmd/main.go": 'package main\nimport (\n  "fmt"\n  u "corp.example/app/util"\n)\n', "util/u.go": "package util", "util/u_test.go": "package util", "util/v.go": "package util",
    }
    files = spark.createDataFrame(list(tree.items()), "path string, content string")
    refs = {(r.path, r.module, r.kind, r.line) for r in imports.imports(files).collect()}
    assert {x for x in refs if x[0] == "web/a.ts"} == {("web/a.ts", "./b", "import", 1), ("web/a.ts", "./lib", "require", 3), ("web/a.ts", "../up", "export-from", 4), ("web/a.ts", "./b", "dynamic-import", 5), ("web/a.ts", "react", "import", 6)}
    assert {x[1:] for x in refs if x[0] == "pkg/m.py"} == {("os", "import", 1), ("pkg.n", "import", 1), (".o", "from-import", 2), (".p", "from-import", 3), ("..up", "from-import", 4)}
    assert {x[1:] for x in refs if x[0] == "cmd/main.go"} == {("fmt", "import", 3), ("corp.example/app/util", "import", 4)}
    edges = {(r.path, r.target) for r in imports.resolved(imports.imports(files), files, "corp.example/app").collect()}
    assert {("web/a.ts", "web/b.tsx"), ("web/a.ts", "web/lib/index.js"), ("web/a.ts", "up.ts"), ("web/b.tsx", "web/c.js"), ("pkg/m.py", "pkg/n.py"), ("pkg/m.py", "pkg/o.py"), ("pkg/m.py", "pkg/p/__init__.py"), ("src/main/java/com/x/A.java", "src/main/java/com/x/B.java"), ("cmd/main.go", "util/u.go"), ("cmd/main.go", "util/v.go")} <= edges
    assert not [e for e in edges if "_test.go" in e[1] or e[1].startswith("..")]
    found = {r.path: (r["from"], r.reason, r.depth) for r in imports.discover(files.filter("path = 'web/a.ts'"), files).collect()}
    assert found == {"web/b.tsx": ("web/a.ts", "imported", 1), "web/lib/index.js": ("web/a.ts", "required", 1), "up.ts": ("web/a.ts", "re-exported", 1), "web/c.js": ("web/b.tsx", "imported", 2)}
    assert imports.discover(files.filter("path = 'web/a.ts'"), files, max_files=1).count() == 1
