"""Patterns of RE2 in the dialect that runs, and the files that reviews read."""

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.operators import rules
from vigilspark.operators.catalogue import BUILTIN
from vigilspark.sources import files

FITS = [
    (r"\p{L}+", "é", True), (r"\pN", "a", False), (r"^\p{Greek}$", "λ", True), (r"\p{^Greek}", "λ", False), (r"\P{Lu}", "A", False), (r"foo\z", "foo\n", False), (r"foo$", "foo\n", False), (r"(?m)foo$", "foo\nx", True), (r"(?m)^x", "foo\nx", True),
    (r"^[[:alnum:]]+x$", "ab1x", True), (r"^[[:alnum:]]+x$", "a-x", False), (r"[[:^space:]-]", " ", False), (r"[[:word:]]", "_", True), (r"[]a]", "]", True), (r"[^]a]", "]", False), (r"[a&&b]", "&", True), (r"[a[b]", "[", True),
    (r"\Qa.b\E+", "a.bb", True), (r"\Qa.b\E", "axb", False), (r"\Q[", "[", True), (r"(?s-i:a.)B", "a\nB", True), (r"(?i)k", "\u212a", True), (r"(?i:s)", "\u017f", True), (r"a.c", "a\rc", True), (r"a.c", "a\nc", False),
    (r"(?P<year_of>\d)x", "1x", True), (r"\x41\x{42}", "AB", True), (r"\101", "A", True), (r"\v", "\x0b", True), (r"\s", "\x0b", False), (r"[\S]", "\x0b", True), (r"\Bb", "ab", True), (r"a{,2}", "a{,2}", True), (r"a{2,3}$", "aaa", True), (r"\bé", "é", False), (r"", "", True), (r"a||b", "", True),
]
REFUSED = [r"(?=a)", r"(?<!a)b", r"(a)\1", r"a*+", r"a**", r"*a", r"a{1001}", r"a{3,2}", r"[a", r"(a", r"a)", r"\y", r"\Z", r"\C", r"[[:nope:]]", r"\p{Nope}", r"\pé", r"(?x)a", r"(?P=a)", r"a|*", r"[b-a]", "\\"]


def test_patterns_mean_what_they_mean_in_re2(spark):
    cells = [spark.range(1).select(F.lit(t).rlike(T.re2(p)).alias("x")).first().x for p, t, _ in FITS]
    assert [(p, t) for (p, t, fits), x in zip(FITS, cells) if x is not fits] == []


def test_ungreedy_patterns(spark):
    got = spark.range(1).select(*[F.regexp_extract(F.lit("aaab"), T.re2(p), 0).alias(str(i)) for i, p in enumerate(["(?U)a+", "(?U)a+?", "a+?", "(?U:a+)b", "(?U)(?-U)a+", "(?U)a{2,}"])]).first()
    assert list(got) == ["a", "aaa", "a", "aaab", "aaa", "aa"]


@pytest.mark.parametrize("pattern", REFUSED)
def test_patterns_that_are_refused(spark, pattern):
    with pytest.raises(ValueError):
        rules.check([rules.Rule("r", require=(pattern,))])


def test_catalogue_compiles(spark):
    rules.check(BUILTIN)


def tree(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").withColumn("size", F.octet_length("content"))


def test_bytes_that_are_not_utf8(spark):
    got = {r.path: r.content for r in files.every(tree(spark, [("a.txt", b"caf\xe9 x"), ("b.txt", "é".encode()), ("c.txt", b""), ("d.bin", b"a\0b"), ("e.txt", b"\xff\xfe")])).collect()}
    assert got == {"a.txt": "caf\ufffd x", "b.txt": "é", "c.txt": "", "e.txt": "\ufffd\ufffd"}


def test_named_files_that_are_no_text(spark):
    rows = [("a/x.go", b"x"), ("a/y.bin", b"\0"), ("a/z.go", b"z" * (files.MAX_BYTES + 1))]
    assert {r.path for r in files.named(tree(spark, rows), ["a"]).collect()} == {"a/x.go"}
    for target in ("a/y.bin", "a/z.go"):
        with pytest.raises(ValueError, match=target):
            files.named(tree(spark, rows), ["a/x.go", target])


LITERALS = [
    (r"(?i)md5\(", ("md5(",)), (r"a|b.c", ("a", "b")), (r"ab?cd", ("cd",)), (r"(foo|bar)+x", ("bar", "foo")), (r"(foo|b*)x", ("x",)), (r"[ab]+", ()), (r"x*", ()), (r"\bjwt\.decode\s*\(", ("jwt.decode",)), (r"(?:a{0,3}|b)", ()), (r"q{2,}longer", ("longer",)),
    (r"\x41bc", ()), (r"[]x]abc", ("abc",)), (r"(a(b|c)d)?e", ("e",)), (r"É", ()), (r"", ()), (r"a||b", ()), (r"[[:alpha:]]]yes", ("]yes",)),
]


@pytest.mark.parametrize("pattern, needs", LITERALS)
def test_what_a_pattern_needs(pattern, needs):
    assert T.literals(pattern) == needs


def test_no_line_that_a_rule_fits_lacks_what_it_needs(spark):
    """All patterns of all rules, on lines that rules find, with the letters that case folding takes for others."""
    from vigilspark.operators.secrets import PATTERNS
    from vigilspark.plans.samples import SAMPLES

    patterns = sorted({p for r in BUILTIN for p in (*r.require, *r.any)} | {p.regex for p in PATTERNS})
    texts = sorted({t for s in SAMPLES for t in s if t} | {"AKIA" + "A" * 16, "ghp_" + "aB3" * 12, "api_key = 'abcd1234efgh5678'"})
    swaps = [str.upper, str.title, lambda t: t.replace("s", "ſ").replace("k", "K"), lambda t: t.upper().replace("I", "İ"), lambda t: t.replace("i", "ı"), lambda t: "é" + t + "ſı"]
    lines = spark.createDataFrame([(t,) for t in sorted({*texts, *[f(t) for f in swaps for t in texts]})], "text string").withColumn("folded", T.folded(F.col("text")))
    fits = lambda p: F.col("text").rlike(T.re2(p))
    hint = lambda p: F.expr(" OR ".join(f"contains(folded, {rules._quoted(w)})" for w in T.literals(p)) or "true")
    wrong = F.filter(F.array(*[F.when(fits(p) & ~hint(p), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())
    found = lines.select(F.size(F.filter(F.array(*[fits(p) for p in patterns]), lambda x: x)).alias("n"), wrong.alias("wrong")).cache()
    assert found.agg(F.sum("n")).first()[0] > len(patterns)
    assert found.filter(F.size("wrong") > 0).collect() == []
    assert sum(not T.literals(p) for p in patterns) <= 2
