"""Operator 12 rates pairs of sources as rows."""

from vigilspark.llm import divergence


def test_pairs_are_rated_as_rows(spark):
    docs = spark.createDataFrame([(i, "aa bb" if i % 2 else "aa cc", "en", f"s{i % 3}") for i in range(12)] + [(12, None, None, None), (13, "", "en", "s3")], "doc_id long, text string, lang string, source string")
    found = divergence.audit(docs)
    assert "posexplode(transform(p" not in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = {(r.lang, r.source, r.item): r.value for r in found.filter("part = 'pair'").collect()}
    assert set(pairs) == {("en", a, b) for a in ("s0", "s1", "s2", "s3") for b in ("s0", "s1", "s2", "s3") if a != b}
    assert pairs[("en", "s0", "s1")] == 0  # equal counts: no row is rated, the value is 0

    def p(counts):
        return [1 + 10**9 * (n + 1) // (sum(counts) + 3) for n in counts]

    one, none = p((4, 2, 2)), p((0, 0, 0))
    assert pairs[("en", "s0", "s3")] == sum((a - b) ** 2 // b for a, b in zip(one, none))
