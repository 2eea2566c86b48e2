"""Go hunks whose flows are known by reading the language's grammar."""

import pytest

from vigilspark.operators.goflows import go_sinks

TAINTED = 'u := c.Query("u")\n'
GET, EXEC, OPEN, NEW, UNSAFE = "http.get", "exec.command", "os.open", "template.new", "unsafe.pointer"
CASES = [
    (TAINTED + "http.Get(u)", [GET]),
    (TAINTED + "v := u\nw, k := 1, v\nos.Open(k)", [OPEN]),
    (TAINTED + "http.Get(\"x\")", []),
    ('exec.Command(r.Header.Get("x"))', [EXEC]),
    ('http.Get(r.URL.Query().Get("u"))', []),  # the outer call is named Get
    (TAINTED + 'u = "fixed"\nhttp.Get(u)', []),
    (TAINTED + "u += x\nhttp.Get(u)", []),
    (TAINTED + "http.Get(prefix + u)\nHTTP.get(u)", [GET, GET]),
    (TAINTED + "http.Get(*u)\nhttp.Get(-u)\nhttp.Get((u))\nhttp.Get(u[0])\nhttp.Get(u.(string))\nhttp.Get([]string{u})", []),
    (TAINTED + "http.Get(u.host)\nhttp.Get(f(u))\nhttp.Get(f(u).x)", [GET, GET, GET]),
    (TAINTED + "http.Get(f(u).g())\nhttp.Get(f(u)(1))", []),
    (TAINTED + "http.Get([]byte(u))\nhttp.Get(string(u), nil...)", [GET, GET]),
    (TAINTED + "res, err := http.Get(u)\nif err != nil {\n\treturn err\n}", []),
    (TAINTED + "go http.Get(u)\ndefer http.Get(u)\nreturn http.Get(u)", []),
    (TAINTED + "if ok { http.Get(u) } else if no { os.Open(u) } else { exec.Command(u) }", [GET, OPEN, EXEC]),
    (TAINTED + "if http.Get(u); ok { x() }", [GET]),
    (TAINTED + "if http.Get(u) { x() }", []),
    (TAINTED + "for i := 0; i < 3; http.Get(u) { x++ }", [GET]),
    (TAINTED + "for _, v := range u { http.Get(v) }", []),  # a range is no assignment
    ("switch v := u.(type) {\ncase int:\n\thttp.Get(v)\ndefault:\n}", []),
    (TAINTED + "switch {\ncase a, b:\n\tv := u\n\thttp.Get(v)\n}", [GET]),
    ("select {\ncase v := <-c:\n\thttp.Get(v)\ncase d <- 1:\n}", []),
    (TAINTED + "mux.HandleFunc(\"/\", func(w http.ResponseWriter, r *http.Request) {\n\thttp.Get(u)\n})", [GET]),
    ("h := func() { x := c.Param(\"a\"); os.Open(x) }\nh()", [OPEN]),
    (TAINTED + "again:\nhttp.Get(u)\ngoto again", [GET]),
    (TAINTED + "x := T{a: u, b: []T{{1}, {2}}}\nhttp.Get(x)", []),
    (TAINTED + "http.Get[int](u)\nm[u].http.Get(u)", [GET]),
    (TAINTED + "// a ' comment {\n/* ( */ http.Get(u) // )", [GET]),
    (TAINTED + "s := `raw { \" ` + \"}\\\"\" + string('\\'')\nhttp.Get(u)", [GET]),
    ("p := (*int)(unsafe.Pointer(&x))", [UNSAFE]),
    ("var p = unsafe.Pointer(&x)", [UNSAFE]),
    ("y = *(*T)(unsafe . \n Pointer(q))", [UNSAFE]),
    ("}\n\nfunc (s *S) next(a, b int) (string, error) {\n" + TAINTED + "http.Get(u)", [GET]),
    ("x()\n}\n\nvar z = 1\n\ntype T struct {\n\ta int\n}\n\nfunc g[K any](k K) map[string]func(int) error {\n" + TAINTED + "http.Get(u)", [GET]),
    (TAINTED + "var (\n\ta = 1\n\tb string\n)\nconst k = 2\ntype L struct{ n *L }\nhttp.Get(u)", [GET]),
    (TAINTED + "x := map[string]func(int) error{\"a\": nil}\ny := make(chan int, 2)\nz := interface{}(u)\nhttp.Get(z)", [GET]),
    (TAINTED + "a.b[u], c = u, u\nhttp.Get(c)\nhttp.Get(a)", [GET]),
    (TAINTED + "http.Get(\n\tu,\n)", [GET]),
    # What doesn't parse gives nothing.
    (TAINTED + "http.Get(u", []),
    (TAINTED + "http.Get(u\n)", []),
    (TAINTED + "http.Get(u))", []),
    (TAINTED + "http.Get(u) http.Get(u)", []),
    (TAINTED + "func named() {\n}\nhttp.Get(u)", []),
    (TAINTED + "import \"x\"\nhttp.Get(u)", []),
    (TAINTED + "http.Get(u)\nx := ", []),
    (TAINTED + "http.Get(u)\nx := 'a", []),
    (TAINTED + "http.Get(u)\nif x {\n}\nelse {\n}", []),
    (TAINTED + "http.Get(u)\na b", []),
    (TAINTED + "http.Get(u)\nx = a +* / b", []),
    (TAINTED + "http.Get(u)\n# comment", []),
    (TAINTED + "http.Get(u)\n}", []),
    ("", []), ("\n\n", []), ("}\nfunc f() {", []),
]


def test_go_hunks(spark):
    table = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(CASES)], "i int, body string")
    got = {r.i: r.sinks for r in table.select("i", go_sinks("body").alias("sinks")).collect()}
    wrong = [(CASES[i][0], CASES[i][1], got[i]) for i in got if got[i] != CASES[i][1]]
    assert not wrong, wrong


@pytest.mark.parametrize("filler", ["f(1)\n", "x := y.z[1:2]\n", "if a { b() }\n"])
def test_long_hunks(spark, filler):
    bodies = [(0, TAINTED + filler * 700 + "http.Get(u)"), (1, TAINTED + "http.Get(u)\n" + filler * 700 + ")"), (2, TAINTED + "f(" * 300 + "u" + ")" * 300 + "\nhttp.Get(u)")]
    table = spark.createDataFrame(bodies, "i int, body string")
    assert {r.i: r.sinks for r in table.select("i", go_sinks("body").alias("sinks")).collect()} == {0: [GET], 1: [], 2: [GET]}
