"""Flows in Go syntax: tainted values that reach a call, and conversions by unsafe.Pointer, in hunks that are statements of Go.

A hunk's text is cut into tokens by one pattern and read by one aggregation over
them, a parser with a stack: its state is the innermost bracket's frame, the frames
around it, and the statements read so far.  A frame knows whether an operand is
due, which names and calls the operand at hand is made of, and, in a block, the
statement's keyword and left side.  A token out of place ends the reading, and a
hunk that doesn't parse as the inside of a function gives nothing.  A second, short
aggregation goes through the assignments and calls in the order in which they
begin, with the tainted names as its state.

What taints a value: names tainted before, as operands, arguments or selected from,
and calls with one of WORDS in their name.  Unary operands, indexed and composite
values, grouped expressions and conversions by assertion taint nothing.  Types and
declarations are read for their brackets and function bodies only.

The transitions are written once as SQL over $field (of the frame at hand), ^field
(of the frame around it), @token parts and %values of the step, so that they can
be tested in any engine; here Spark runs them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.operators.analyzers import _hunks, spread, synthetic

# Rule, the sink's name, title (which ids hash), category, severity; words of calls that give what a request holds.
SINKS = (
    ("semantic.go.ssrf", "http.get", "Go AST found tainted flow into http.Get", "ssrf", "critical"),
    ("semantic.go.exec", "exec.command", "Go AST found tainted flow into exec.Command", "injection", "critical"),
    ("semantic.go.path", "os.open", "Go AST found tainted flow into os.Open", "file", "high"),
    ("semantic.go.template", "template.new", "Go AST found tainted flow into template construction", "template", "high"),
)
UNSAFE = ("semantic.go.unsafe", "unsafe.pointer", "Go AST found unsafe.Pointer usage", "memory", "high")
WORDS = ("query", "param", "header", "cookie", "body")

#: Comments, strings, names, numbers, operators (longest first), and any other character.
TOKEN = (
    r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
    r'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|`[^`]*`'
    r"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
    r"|[\pL_][\pL\pN_]*|\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*"
    r"|<<=|>>=|&\^=|\.\.\.|:=|\+\+|--|<-|&&|\|\||==|!=|<=|>=|<<|>>|&\^|[-+*/%&|^]=|[^ \t\r]"
)
KEYWORDS = {
    "ctl": ("if", "for", "switch", "select"), "jump": ("return", "break", "continue", "fallthrough"), "call": ("go", "defer", "goto"), "decl": ("var", "const", "type"),
    **{w: (w,) for w in ("case", "default", "else", "func", "range", "map", "chan", "struct", "interface")}, "bad": ("import", "package"),
}


def _in(x: str, words) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in words)})"


def token_class(t: str) -> str:
    """What kind of token t is."""
    keywords = " ".join(f"WHEN {_in(t, words)} THEN '{kind}'" for kind, words in KEYWORDS.items())
    return f"""CASE
  WHEN {t} LIKE '//%' THEN 'skip' WHEN {t} LIKE '/*%*/' THEN CASE WHEN instr({t}, chr(10)) > 0 THEN 'nl' ELSE 'skip' END WHEN {t} = chr(10) THEN 'nl'
  WHEN length({t}) > 1 AND ({t} LIKE '"%' OR {t} LIKE '`%' OR {t} LIKE '''%') THEN 'lit'
  {keywords}
  WHEN {_in(t, ('(', '[', '{'))} THEN 'open' WHEN {_in(t, (')', ']', '}'))} THEN 'close'
  WHEN {_in(t, (',', ':', '.', ';', '...'))} THEN {t}
  WHEN {_in(t, (':=', '=', '+=', '-=', '*=', '/=', '%=', '&=', '|=', '^=', '<<=', '>>=', '&^='))} THEN 'set' WHEN {_in(t, ('++', '--'))} THEN 'inc'
  WHEN {_in(t, ('+', '-', '!', '^', '*', '&', '<-', '~'))} THEN 'un'
  WHEN {_in(t, ('&&', '||', '==', '!=', '<=', '>=', '<', '>', '<<', '>>', '&^', '/', '%', '|'))} THEN 'bin'
  WHEN {_in(f"substr({t}, 1, 1)", '0123456789')} OR {t} LIKE '.%' THEN 'lit'
  WHEN lower({t}) <> upper({t}) OR substr({t}, 1, 1) = '_' OR length({t}) > 1 OR ascii({t}) > 255 THEN 'id'
  ELSE 'bad' END"""


# Frames: B block, C arguments, P group, I index, A array type, L composite value; read for their brackets only: F file, S signature or type, T body of a type, D group of declarations, Y assertion.
_LENIENT = "($sig OR $kind IN ('S', 'T', 'D', 'Y', 'F') OR $head IN ('var', 'const', 'type'))"
_ENDS = "$pc IN ('id', 'lit', 'close', 'jump', 'inc')"
_HEADS = "('if', 'for', 'switch', 'select', 'range')"
NEXT_KIND = f"""CASE
  WHEN @t = '(' THEN CASE
    WHEN $kind IN ('B', 'F') AND $prev IN ('var', 'const', 'type') THEN 'D' WHEN {_LENIENT} THEN 'S' WHEN $prev = '.' THEN 'Y' WHEN $want THEN 'P' ELSE 'C' END
  WHEN @t = '[' THEN CASE WHEN {_LENIENT} THEN 'S' WHEN $prev = '.' THEN '' WHEN $want THEN 'A' ELSE 'I' END
  WHEN @t <> '{{' OR $prev = '.' THEN ''
  WHEN $prev IN ('struct', 'interface') THEN 'T' WHEN $sig AND $typ THEN 'L' WHEN $sig THEN 'B' WHEN {_LENIENT} THEN 'T'
  WHEN $kind = 'B' AND ($fresh OR $head = 'else') THEN 'B'
  WHEN $kind = 'B' AND $head IN {_HEADS} THEN CASE WHEN NOT $want OR $prev = $head AND $head <> 'if' OR $prev = ';' AND $head IN ('for', 'switch') THEN 'B' ELSE '' END
  WHEN $kind = 'L' AND $want THEN 'L' WHEN NOT $want AND ($name <> '' OR $typ) THEN 'L' ELSE '' END"""
ACTION = f"""CASE
  WHEN NOT $ok OR @c = 'skip' OR @c = 'nl' AND NOT {_ENDS} THEN 'skip'
  WHEN @c = 'bad' THEN 'bad'
  WHEN @c IN ('nl', ';') THEN CASE
    WHEN $kind IN ('T', 'D') THEN 'pass' WHEN $kind = 'F' THEN 'end' WHEN $kind <> 'B' THEN 'bad'
    WHEN $head IN ('if', 'for', 'switch') AND @c = ';' THEN CASE WHEN $want AND NOT $prev IN ($head, ';') OR $semis >= CASE WHEN $head = 'for' THEN 2 ELSE 1 END THEN 'bad' ELSE 'piece' END
    WHEN $head IN {_HEADS} OR $head IN ('else', 'case', 'default') THEN 'bad'
    WHEN $head IN ('var', 'const', 'type', 'done', 'after') THEN 'end'
    WHEN $want AND NOT $fresh AND $pc <> 'jump' THEN 'bad' ELSE 'end' END
  WHEN $kind IN ('B', 'F') AND $head IN ('after', 'done') AND @c <> 'close' THEN CASE WHEN $head = 'after' AND @c = 'else' THEN 'else' ELSE 'bad' END
  WHEN $kind = 'B' AND $head = 'else' AND @t = 'if' THEN 'elseif'
  WHEN $kind = 'B' AND $head = 'else' AND @t <> '{{' THEN 'bad'
  WHEN $prev = 'func' AND $kind <> 'F' AND @t <> '(' THEN 'bad'
  WHEN @c = 'open' THEN CASE WHEN %nk = '' THEN 'bad' ELSE 'push' END
  WHEN @c = 'close' THEN CASE
    WHEN NOT ($open = '(' AND @t = ')' OR $open = '[' AND @t = ']' OR $open = '{{' AND @t = '}}') THEN 'bad'
    WHEN $kind IN ('S', 'T', 'D', 'Y', 'A') THEN 'pop'
    WHEN $kind = 'B' THEN CASE WHEN $head IN {_HEADS} OR $head IN ('else', 'case', 'default') THEN 'bad' WHEN $head IN ('var', 'const', 'type', 'done', 'after') THEN 'pop' WHEN $want AND NOT $fresh AND $pc <> 'jump' THEN 'bad' ELSE 'pop' END
    WHEN NOT $want OR $kind = 'C' AND $prev IN ('(', ',') OR $kind = 'L' AND $prev IN ('{{', ',') OR $kind = 'I' AND $prev = ':' THEN 'pop' ELSE 'bad' END
  WHEN $kind = 'F' AND $fresh THEN CASE WHEN @c IN ('func', 'decl') THEN 'stmt' ELSE 'bad' END
  WHEN {_LENIENT} AND NOT ($sig AND @c IN (',', ':') AND $kind IN ('B', 'C', 'L', 'I', 'P')) THEN CASE WHEN @c = 'func' THEN 'sig' WHEN @c = 'set' AND $kind = 'B' AND $head IN ('var', 'const') THEN 'values' ELSE 'pass' END
  WHEN $prev = '.' THEN CASE WHEN @c = 'id' THEN 'sel' ELSE 'bad' END
  WHEN @c = ',' THEN CASE WHEN $want OR $kind = 'P' THEN 'bad' ELSE 'comma' END
  WHEN @c = ':' THEN CASE
    WHEN $kind = 'I' OR $kind = 'L' AND NOT $want THEN 'colon'
    WHEN $kind = 'B' AND ($head = 'case' AND NOT $want OR $head = 'default' AND $prev = 'default') THEN 'case'
    WHEN $kind = 'B' AND $head = '' AND NOT $want AND $single AND $base <> '' AND $name = $base THEN 'label' ELSE 'bad' END
  WHEN @c = 'set' THEN CASE WHEN $kind = 'B' AND NOT $want AND NOT $assign AND $head IN ('', 'if', 'for', 'switch', 'case') THEN 'assign' ELSE 'bad' END
  WHEN @c = 'inc' THEN CASE WHEN $kind = 'B' AND NOT $want AND NOT $assign AND $head IN ('', 'if', 'for', 'switch') THEN 'inc' ELSE 'bad' END
  WHEN @c = '.' THEN CASE WHEN $want THEN 'bad' ELSE 'pass' END
  WHEN @c = '...' THEN CASE WHEN $kind = 'C' AND NOT $want THEN 'pass' WHEN $kind = 'A' THEN 'operand' ELSE 'bad' END
  WHEN @c = 'un' AND $want THEN 'unary'
  WHEN @c IN ('un', 'bin') THEN CASE WHEN $want OR @t IN ('!', '~') THEN 'bad' ELSE 'binary' END
  WHEN @c IN ('id', 'lit', 'func', 'map', 'chan', 'struct', 'interface') THEN CASE WHEN NOT $want THEN 'bad' WHEN @c = 'id' THEN 'ident' WHEN @c = 'lit' THEN 'operand' WHEN @c = 'func' THEN 'sig' ELSE 'type' END
  WHEN @c = 'range' THEN CASE WHEN $kind = 'B' AND $head = 'for' AND $want THEN 'range' ELSE 'bad' END
  WHEN $kind = 'B' AND $fresh AND @c IN ('ctl', 'jump', 'call', 'decl', 'case', 'default') THEN 'stmt'
  ELSE 'bad' END"""
#: What the frame has collected, with the operand at hand.
COLLECTED = "$got || CASE WHEN $unary THEN {none} ELSE $pend || CASE WHEN $base = '' THEN {none} ELSE {one:$base} END END"
_NEW = "%a IN ('end', 'piece', 'case', 'label', 'push', 'elseif')"
_KEEP = "%a IN ('pass', 'skip', 'bad')"
_PASSED = "$kind IN ('S', 'D')"
_STATEMENT = "(%a = 'end' OR %a = 'pop' AND $kind = 'B') AND $head = '' OR %a = 'piece' AND $semis = 0"
_LOOP_END = "%a = 'push' AND %nk = 'B' AND NOT $sig AND $head = 'for' AND $semis = 2"
_PLAIN = "$lhs || CASE WHEN $base <> '' AND $name = $base AND NOT $unary THEN {one:$base} ELSE {none} END"
_SOURCE = " OR ".join(f"instr(^name, '{w}') > 0" for w in WORDS)
#: field -> (type, start in a new frame, next value)
FRAME = {
    "kind": ("string", "''", "CASE %a WHEN 'push' THEN %nk WHEN 'pop' THEN ^kind ELSE $kind END"),
    "open": ("string", "''", "CASE %a WHEN 'push' THEN @t WHEN 'pop' THEN ^open ELSE $open END"),
    "head": ("string", "''", f"CASE WHEN %a = 'pop' THEN CASE WHEN $kind <> 'B' THEN ^head WHEN ^sig THEN CASE WHEN ^head = 'func' THEN 'done' ELSE ^head END WHEN ^head = 'if' THEN 'after' ELSE 'done' END WHEN %a = 'piece' THEN $head WHEN %a = 'elseif' THEN 'if' WHEN {_NEW} THEN '' WHEN %a IN ('stmt', 'else', 'range') THEN @t WHEN %a = 'values' THEN 'values' ELSE $head END"),
    "start": ("int", "0", f"CASE WHEN %a = 'pop' THEN ^start WHEN {_NEW} THEN @i ELSE $start END"),
    "semis": ("int", "0", f"CASE WHEN %a = 'pop' THEN ^semis WHEN %a = 'piece' THEN $semis + 1 WHEN {_NEW} THEN 0 ELSE $semis END"),
    "want": ("boolean", "true", f"CASE WHEN %a = 'pop' THEN CASE WHEN {_PASSED} THEN ^want ELSE $kind = 'A' END WHEN %a IN ('ident', 'operand', 'sel', 'sig', 'inc') THEN false WHEN {_KEEP} THEN $want ELSE true END"),
    "fresh": ("boolean", "true", "CASE WHEN %a IN ('end', 'case', 'label', 'push') THEN true WHEN %a = 'skip' THEN $fresh ELSE false END"),
    "sig": ("boolean", "false", f"CASE WHEN %a = 'pop' THEN NOT $kind IN ('B', 'L') AND ^sig WHEN %a = 'sig' OR %a = 'stmt' AND @t = 'func' THEN true WHEN {_KEEP} THEN $sig ELSE false END"),
    "name": ("string", "''", f"CASE WHEN %a = 'pop' THEN CASE WHEN $kind = 'I' AND NOT $slice OR {_PASSED} THEN ^name ELSE '' END WHEN $typ AND %a IN ('ident', 'sel') THEN '' WHEN %a = 'ident' OR %a = 'sel' AND $name = '' THEN @t WHEN %a = 'sel' THEN $name || '.' || @t WHEN {_KEEP} THEN $name ELSE '' END"),
    "base": ("string", "''", f"CASE WHEN %a = 'pop' THEN CASE WHEN {_PASSED} THEN ^base ELSE '' END WHEN %a = 'ident' AND NOT $typ THEN @t WHEN %a = 'sel' OR {_KEEP} THEN $base ELSE '' END"),
    "pend": ("array<string>", "{none}", f"CASE WHEN %a = 'pop' THEN CASE WHEN $kind = 'C' THEN %fl || CASE WHEN {_SOURCE} THEN {{one:'!'}} ELSE {{none}} END WHEN {_PASSED} THEN ^pend ELSE {{none}} END WHEN %a = 'sel' OR {_KEEP} THEN $pend ELSE {{none}} END"),
    "call": ("boolean", "false", f"CASE WHEN %a = 'pop' THEN $kind = 'C' OR {_PASSED} AND ^call WHEN {_KEEP} THEN $call ELSE false END"),
    "callee": ("string", "''", f"CASE WHEN %a = 'pop' AND $kind = 'C' THEN ^name WHEN {_KEEP} THEN $callee ELSE '' END"),
    "args": ("array<string>", "{none}", f"CASE WHEN %a = 'pop' AND $kind = 'C' THEN %fl WHEN {_KEEP} THEN $args ELSE {{none}} END"),
    "unary": ("boolean", "false", f"CASE WHEN %a = 'pop' THEN ^unary WHEN %a = 'unary' THEN true WHEN {_NEW} OR %a IN ('comma', 'colon', 'binary', 'assign', 'stmt', 'values', 'range') THEN false ELSE $unary END"),
    "typ": ("boolean", "false", f"CASE WHEN %a = 'pop' THEN $kind = 'A' OR $kind = 'T' AND NOT ^sig OR $kind IN ('S', 'D', 'T') AND ^typ WHEN %a = 'type' THEN true WHEN %a IN ('ident', 'sel', 'sig', 'unary') OR {_KEEP} THEN $typ ELSE false END"),
    "got": ("array<string>", "{none}", f"CASE WHEN %a = 'pop' THEN ^got WHEN %a IN ('comma', 'colon', 'binary') THEN %fl WHEN {_NEW} OR %a IN ('assign', 'stmt') THEN {{none}} ELSE $got END"),
    "lhs": ("array<string>", "{none}", f"CASE WHEN %a = 'pop' THEN ^lhs WHEN %a = 'assign' OR %a = 'comma' AND $kind = 'B' AND NOT $assign THEN {_PLAIN} WHEN {_NEW} THEN {{none}} ELSE $lhs END"),
    "assign": ("boolean", "false", f"CASE WHEN %a = 'pop' THEN ^assign WHEN %a = 'assign' THEN true WHEN {_NEW} THEN false ELSE $assign END"),
    "single": ("boolean", "true", f"CASE WHEN %a = 'pop' THEN ^single WHEN {_NEW} THEN true WHEN %a IN ('unary', 'binary', 'comma', 'assign', 'inc', 'range') THEN false ELSE $single END"),
    "slice": ("boolean", "false", "CASE %a WHEN 'pop' THEN ^slice WHEN 'push' THEN false WHEN 'colon' THEN true ELSE $slice END"),
}
READS = {"start": "int", "lhs": "array<string>", "names": "array<string>", "sink": "string"}
_ASSIGNED = f"$assign AND ({_STATEMENT} OR %a = 'case' OR {_LOOP_END} OR %a = 'push' AND %nk = 'B' AND NOT $sig AND $head = 'switch')"
_CALLED = f"NOT $assign AND $single AND $call AND $callee <> '' AND ({_STATEMENT} OR {_LOOP_END})"
#: The parser's state beside the frame at hand.
REST = {
    "ok": "$ok AND %a <> 'bad'",
    "prev": "CASE WHEN %a IN ('skip', 'bad') THEN $prev WHEN @c = 'nl' THEN ';' ELSE @t END",
    "pc": "CASE WHEN %a IN ('skip', 'bad') THEN $pc WHEN @c = 'nl' THEN ';' ELSE @c END",
    "stack": "CASE %a WHEN 'push' THEN $stack || {frame} WHEN 'pop' THEN {init:$stack} ELSE $stack END",
    "reads": f"CASE WHEN {_ASSIGNED} THEN $reads || {{read:$start, $lhs, %fl, ''}} WHEN {_CALLED} THEN $reads || {{read:$start, {{none}}, $args, $callee}} ELSE $reads END",
    "unsafe": f"$unsafe OR %a = 'pop' AND $kind = 'C' AND ^name = '{UNSAFE[1]}'",
}


def _frame(**given: str) -> dict[str, str]:
    return {k: given.get(k, start) for k, (_, start, _) in FRAME.items()}


#: The body of a function, in its declaration.
BODY, FILE = _frame(kind="'B'", open="'{'", start="-1"), _frame(kind="'F'", head="'func'", sig="true", fresh="false")


class Spark:
    """How Spark writes what the transitions need."""

    none = "cast(array() AS array<string>)"

    @staticmethod
    def one(x: str) -> str:
        return f"array({x})"

    @staticmethod
    def init(x: str) -> str:
        return f"slice({x}, 1, size({x}) - 1)"

    @staticmethod
    def read(x: str) -> str:
        return f"array(named_struct({', '.join(f'{k!r}, {v}' for k, v in zip(READS, _split(x)))}))"

    @staticmethod
    def frame(fields: dict[str, str]) -> str:
        return f"array(named_struct({', '.join(f'{k!r}, {v}' for k, v in fields.items())}))"


def _split(x: str) -> list[str]:
    """The parts between commas outside brackets."""
    out, depth = [""], 0
    for c in x:
        depth += c in "([" or -(c in ")]")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out]


def render(formula: str, dialect, refs: dict[str, str]) -> str:
    """A formula in a dialect; refs says how fields ($), the frame around (^), the token (@) and the step's values (%) are read."""
    out = formula.replace("{none}", dialect.none)
    while m := re.search(r"\{(one|init|read):([^{}]*)\}", out):
        out = out[: m.start()] + getattr(dialect, m[1])(m[2]) + out[m.end() :]
    out = out.replace("{frame}", dialect.frame({k: f"${k}" for k in FRAME}))
    return re.sub(r"([$^@%])([a-z]+)", lambda m: refs[m[1]].format(m[2]), out)


def _spark(formula: str, refs: dict[str, str]) -> str:
    return render(formula, Spark, refs)


def _parsed(text: str) -> str:
    """The state after reading a Go function's body, as a Spark expression."""
    state = {"$": "s.{}", "^": "get(s.stack, size(s.stack) - 1).{}", "@": "x.{}"}
    value = lambda formula: _spark(formula, state | {"%": "v.{}"})
    fixed = lambda formula: _spark(formula, {})
    frame_type = f"struct<{','.join(f'{k}:{t}' for k, (t, _, _) in FRAME.items())}>"
    read_type = f"struct<{','.join(f'{k}:{t}' for k, t in READS.items())}>"
    typed = {k: f"cast({fixed(v)} AS {FRAME[k][0]})" for k, v in BODY.items()}
    around = Spark.frame({k: f"cast({fixed(v)} AS {FRAME[k][0]})" for k, v in FILE.items()})
    start = typed | {"ok": "true", "prev": "''", "pc": "''", "stack": f"cast({around} AS array<{frame_type}>)", "reads": f"cast(array() AS array<{read_type}>)", "unsafe": "false"}
    struct = lambda fields: f"named_struct({', '.join(f'{k!r}, {v}' for k, v in fields.items())})"
    let = lambda name, bound, body: f"transform(array({bound}), {name} -> {body})[0]"
    after = struct({k: f"cast({value(v)} AS {FRAME[k][0]})" for k, (_, _, v) in FRAME.items()} | {k: value(v) for k, v in REST.items()})
    kinds = struct({"nk": _spark(NEXT_KIND, state)})
    acted = struct({"a": _spark(ACTION, state | {"%": "w.{}"}), "nk": "w.nk", "fl": _spark(COLLECTED, state)})
    step = let("w", kinds, let("v", acted, after))
    pattern = T.re2(TOKEN).replace("\\", "\\\\").replace("'", "\\'")
    tokens = f"transform(regexp_extract_all({text} || chr(10) || '}}', '{pattern}', 0), (t, i) -> {struct({'t': 'lower(t)', 'c': token_class('t'), 'i': 'i'})})"
    return f"aggregate({tokens}, {struct(start)}, (s, x) -> {step}, s -> named_struct('ok', s.ok AND s.kind = 'F' AND s.head = 'done', 'reads', array_sort(s.reads), 'unsafe', s.unsafe))"


def go_sinks(text: str) -> Column:
    """The sinks (lower-case names, unsafe.pointer last) that a hunk's text holds, empty if it doesn't parse."""
    tainted = "exists(r.names, n -> n = '!' OR array_contains(s.live, n))"
    live = f"CASE WHEN r.sink <> '' THEN s.live WHEN {tainted} THEN array_union(s.live, r.lhs) ELSE array_except(s.live, r.lhs) END"
    hits = f"CASE WHEN {_in('r.sink', [s[1] for s in SINKS])} AND {tainted} THEN array_append(s.hits, r.sink) ELSE s.hits END"
    none = Spark.none
    flows = f"aggregate(p.reads, named_struct('live', {none}, 'hits', {none}), (s, r) -> named_struct('live', {live}, 'hits', {hits}), s -> s.hits)"
    whole = f"CASE WHEN p.ok THEN {flows} || CASE WHEN p.unsafe THEN array('{UNSAFE[1]}') ELSE {none} END ELSE {none} END"
    return F.expr(f"transform(array({_parsed(text)}), p -> {whole})[0]")


def worth_reading(low: Column) -> Column:
    """Whether a lower-cased text names a sink at all: both parts of one's name."""
    both = [F.contains(low, F.lit(a)) & F.contains(low, F.lit(b)) for a, b in (s[1].split(".") for s in (*SINKS, UNSAFE))]
    return both[0] | both[1] | both[2] | both[3] | both[4]


def reads_go(path: Column) -> Column:
    return (T.language(path) == "go") & ~T.artifact(path)


def go_found() -> Column:
    """Findings of a hunk of Go, one of each rule."""
    sinks = F.when(worth_reading(F.lower("hunk_text")), F.array_distinct(go_sinks("hunk_text")))
    infos = F.array(*[F.struct(F.lit(n).alias("sink"), F.lit(r).alias("rule_id"), F.lit(t).alias("title"), F.lit(c).alias("category"), F.lit(s).alias("severity")) for r, n, t, c, s in (*SINKS, UNSAFE)])
    return F.transform(F.array(sinks), lambda s: synthetic(F.filter(infos, lambda r: F.coalesce(F.array_contains(s, r["sink"]), F.lit(False)))))[0]


def go_flows(lines: DataFrame) -> DataFrame:
    """Findings of hunks of Go outside documents and fixtures, one of each rule for a hunk."""
    hunks = _hunks(lines.filter(reads_go(F.col("path"))))
    return spread(hunks.filter(worth_reading(F.lower("hunk_text"))), go_found())
