"""Parts of a line are taken once."""

from vigilspark.operators import analyzers, rules


def test_a_line_s_parts_are_taken_once(spark):
    """The analyzers' plans name a pattern as often as it has parts that are asked for, not as often as they are used."""
    rows = [("d", 0, 0, i, "a.js", kind, text, i, i) for i, (kind, text) in enumerate([("deleted", "sameSite: strict"), ("added", "SAMESITE=lax"), ("added", "let u = req.query.x"), ("added", "v := u; v = clean"), ("added", "fetch(v)"), ("added", None), ("deleted", "timeout: 5s"), ("added", "timeout = 1M")])]
    lines = spark.createDataFrame(rows, "diff_id string, file_ix int, hunk_ix int, line_ix int, path string, kind string, text string, old_no int, new_no int")
    plan = lambda found: found._jdf.queryExecution().optimizedPlan().toString()
    weak, flows = rules.downgrades(lines), analyzers.flows(lines)
    generate = next(line for line in plan(weak).splitlines() if "Generate" in line)
    assert generate.count("idleTimeout|sessionTimeout") <= 3
    assert max(line.count(r"\s*(.+)") for line in plan(flows).splitlines()) <= 2
    assert sorted((r.rule_id, r.was, r.now) for r in weak.collect()) == [("downgrade.cookie.samesite", 3, 2), ("downgrade.timeout", 5000, 60000)]
    assert [(r.rule_id, r.line) for r in flows.collect()] == [("semantic.ssrf.flow", 4)]
