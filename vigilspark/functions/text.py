"""Column functions over lines, paths and findings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    """critical 4 ... low 1, anything else 0."""
    return reduce(lambda out, s: out.when(severity == s, SEVERITIES.index(s) + 1), SEVERITIES[1:], F.when(severity == SEVERITIES[0], 1)).otherwise(0)


def entropy(value: Column, skip_blanks: bool = False) -> Column:
    """Shannon bits per character; the empty string has 0."""
    plain = F.regexp_replace(value, "[ \t]", "") if skip_blanks else value
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    shares = F.transform(F.array_sort(F.transform(F.array_distinct(chars), lambda c: F.length(plain) - F.length(F.replace(plain, c, F.lit(""))))), lambda n: n / F.length(plain))
    return F.when(F.length(plain) > 0, F.abs(F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p)))).otherwise(0.0)


def mask_value(value: Column) -> Column:
    """First and last four characters; short values whole."""
    return F.when(F.octet_length(value) <= 8, F.lit("********")).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("****"), F.right(value, F.lit(4))))


def mask_tokens(line: Column) -> Column:
    """Each run of 12 or more token characters masked."""
    return F.regexp_replace(line, r"([A-Za-z0-9_\-./+=]{4})[A-Za-z0-9_\-./+=]{4,}([A-Za-z0-9_\-./+=]{4})", "$1****$2")


# What counts as white space at the ends of a text.
BLANK = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim_space(value: Column) -> Column:
    """value without Unicode white space at its ends."""
    return F.regexp_replace(value, rf"^{BLANK}+|{BLANK}+\z", "")


def identity(*parts: Column) -> Column:
    """16 hexadecimal digits that name a finding."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? stay within one; [..] only without **, and a set may be negated by ^."""
    pattern = pattern.strip().replace("\\", "/")
    out, i, sets = [], 0, "**" not in pattern
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif sets and pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out.append(pattern[i : end + 1])
            i = end + 1
        else:
            out.append("." if pattern[i] == "?" else re.escape(pattern[i]))
            i += 1
    return "^" + "".join(out) + "$"


def globs_regex(patterns: Iterable[str]) -> str:
    """One regular expression for paths that one of the globs fits; empty without globs."""
    exprs = [glob_regex(p)[1:-1] for p in patterns if p.strip()]
    return "^(?:" + "|".join(exprs) + ")$" if exprs else ""


def any_glob(path: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the globs matches, as one regular expression; without globs none does."""
    fits = globs_regex(patterns)
    return F.trim(path).rlike(fits) if fits else F.lit(False)


_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?-iu:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_BLANKS = r"\t\n\f\r "


# Named character classes of RE2 in Java's names.
_CLASSES = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}


class PatternError(ValueError):
    """A pattern that RE2 doesn't have, or that has no equal in Java's dialect."""


@lru_cache(maxsize=4096)
def re2(pattern: str) -> str:
    """An RE2 pattern in Java's dialect: ASCII word edges and blanks, $ only at the end of the text, Unicode case folding, and a dot that only stops at line feeds.

    Knows quoted runs, POSIX classes, scripts, octal escapes, flags of a group, ungreedy
    patterns and names of groups; what RE2 refuses (looking around, references back,
    possessive and nested repetition, unknown escapes) is a PatternError."""
    return "(?d)" + _Re2(pattern).read()


class _Re2:
    def __init__(self, pattern: str):
        self.p, self.i, self.out = pattern, 0, []
        self.flags, self.around = {"m": False, "U": False}, []
        self.atom = False  # whether something stands before that may repeat

    def wrong(self, what: str) -> PatternError:
        return PatternError(f"pattern {self.p!r}: {what}")

    def put(self, text: str, atom: bool = True) -> None:
        self.out.append(text)
        self.atom = atom

    def read(self) -> str:
        p = self.p
        while self.i < len(p):
            c = p[self.i]
            if c == "\\":
                self.escape()
            elif c == "[":
                self.put(self.set())
            elif c == "(":
                self.open()
            elif c == ")":
                if not self.around:
                    raise self.wrong("unexpected )")
                self.flags = self.around.pop()
                self.put(")")
                self.i += 1
            elif c in "*+?" or c == "{" and re.match(r"\{\d+(,\d*)?\}", p[self.i :]):
                self.repeat()
            else:
                self.i += 1
                if c == "$":
                    self.put("$" if self.flags["m"] else r"\z")
                elif c == "^":
                    self.put(r"(?:^|(?<=\n))" if self.flags["m"] else "^")
                else:
                    self.put("\\{" if c == "{" else c, c != "|")
        if self.around:
            raise self.wrong("missing )")
        return "".join(self.out)

    def escape(self) -> None:
        p = self.p
        if p.startswith(r"\Q", self.i):
            end = p.find(r"\E", self.i + 2)
            quoted = p[self.i + 2 : end if end >= 0 else len(p)]
            self.put("".join(c if c.isalnum() or c == "_" else "\\" + c for c in quoted), bool(quoted) or self.atom)
            self.i = end + 2 if end >= 0 else len(p)
            return
        c = p[self.i + 1 : self.i + 2]
        if c in "bBAz" and c:
            self.i += 2
            self.put({"b": _EDGE, "B": f"(?!{_EDGE})"}.get(c, "\\" + c))
        else:
            self.put(self.character(False))

    def character(self, in_set: bool) -> str:
        """An escape that stands for a character or some of them."""
        p, start = self.p, self.i
        c = p[start + 1 : start + 2]
        self.i += 2
        if c in "dDwWtnrfa" and c:
            return "\\" + c
        if c == "s":
            return _BLANKS if in_set else f"[{_BLANKS}]"
        if c == "S":
            return f"[^{_BLANKS}]"
        if c == "v":
            return r"\x0B"
        if c in "pP" and c:
            m = re.match(r"\\[pP](?:([A-Z])|\{(\^?)([A-Za-z_]+)\})", p[start:])
            if not m:
                raise self.wrong("unknown property")
            self.i = start + m.end()
            name, no = m[1] or m[3], (c == "P") != bool(m[2])
            if name == "Any":
                return (r"[^\x{0}-\x{10FFFF}]" if no else r"[\x{0}-\x{10FFFF}]")
            return f"\\{'P' if no else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if m := re.match(r"\\x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})", p[start:]):
            self.i = start + m.end()
            if int(m[1] or m[2], 16) > 0x10FFFF:
                raise self.wrong("no such character")
            return f"\\x{{{m[1] or m[2]}}}"
        if m := re.match(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})", p[start:]):
            self.i = start + m.end()
            return f"\\x{{{int(m[1], 8):x}}}"
        if not c or c.isalnum() or ord(c) >= 0x80:
            raise self.wrong(f"unknown escape \\{c}")
        return "\\" + c

    def set(self) -> str:
        p, start = self.p, self.i
        self.i += 1
        out = "["
        if p.startswith("^", self.i):
            out, self.i = "[^", self.i + 1
        first = True
        while True:
            c = p[self.i : self.i + 1]
            if not c:
                raise self.wrong(f"missing ] after {p[start:]}")
            if c == "]" and not first:
                self.i += 1
                return out + "]"
            if m := re.match(r"\[:(\^?)([a-z]+):\]", p[self.i :]):
                self.i += m.end()
                if m[2] != "word" and m[2] not in _CLASSES:
                    raise self.wrong(f"unknown class {m[2]}")
                out += ("\\W" if m[1] else "\\w") if m[2] == "word" else f"\\{'P' if m[1] else 'p'}{{{_CLASSES[m[2]]}}}"
            elif c == "\\":
                out += self.character(True)
            else:
                self.i += 1
                out += "\\" + c if c in "[]&~^" else c
            first = False

    def open(self) -> None:
        p = self.p
        self.around.append(dict(self.flags))
        if not p.startswith("(?", self.i):
            self.put("(", False)
            self.i += 1
        elif m := re.match(r"\(\?P?<([A-Za-z0-9_]+)>", p[self.i :]):
            self.put("(", False)  # by number alone: Java's names have no underscores
            self.i += m.end()
        elif m := re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", p[self.i :]):
            if m[3] == ")" and not m[1] and not m[2]:
                raise self.wrong("missing argument")
            for names, on in ((m[1], True), (m[2] or "", False)):
                self.flags.update({f: on for f in names if f in self.flags})
            on, off = m[1].replace("U", "").replace("i", "iu"), (m[2] or "").replace("U", "").replace("i", "iu")
            off = "-" + off if off else ""
            if m[3] == ":":
                self.put(f"(?{on}{off}:", False)
            else:
                self.around.pop()  # holds for the rest of the group around
                self.put(f"(?{on}{off})" if on or off else "", False)
            self.i += m.end()
        else:
            raise self.wrong(f"no group {p[self.i : self.i + 4]}")

    def repeat(self) -> None:
        m = re.match(r"([*+?]|\{(\d+)(?:,(\d*))?\})(\??)", self.p[self.i :])
        if not self.atom:
            raise self.wrong("nothing to repeat")
        if m[2] and (int(m[2]) > 1000 or m[3] and (int(m[3]) > 1000 or int(m[3]) < int(m[2]))):
            raise self.wrong(f"bad repetition {m[1]}")
        self.i += m.end()
        # What follows is nested repetition, which RE2 has not and Java reads as possessive.
        self.put(m[1] + ("?" if bool(m[4]) != self.flags["U"] else ""), False)


def folded(line: Column) -> Column:
    """line in lower case, with the characters outside ASCII that a pattern without case takes for letters of it: what to look for literals() in."""
    low = F.lower(line)
    return F.when(F.octet_length(line) == F.length(line), low).otherwise(F.translate(low, "\u017f\u0131\u0307", "si"))


@lru_cache(maxsize=4096)
def literals(pattern: str) -> tuple[str, ...]:
    """Lower-case texts of which a folded() line that the RE2 pattern fits has at least one; none if nothing can be said."""
    found, at = _required(re.sub(r"\(\?[imsU]*(?:-[imsU]+)?\)", "", pattern), 0)
    return tuple(sorted(found)) if at is not None else ()


def _required(p: str, i: int) -> tuple[frozenset[str], int | None]:
    """What the alternatives from place i on need, up to a bracket that closes, and its place."""
    needs: list[frozenset[str]] = []
    run, parts = "", []

    def better(sets: list[frozenset[str]]) -> frozenset[str]:
        """The choice that says most: its shortest text is the longest, and few texts are."""
        return max((s for s in sets if s), key=lambda s: (min(min(map(len, s)), 4), -len(s)), default=frozenset())

    while True:
        c = p[i : i + 1]
        if c in ("", "|", ")"):
            parts.append(frozenset([run]) if run else frozenset())
            needs.append(better(parts))
            run, parts = "", []
            if c != "|":
                return (frozenset() if any(not n for n in needs) else frozenset().union(*needs)), i
            i += 1
            continue
        atom, inner = "", frozenset()
        if c == "(":
            opened = re.match(r"\((?:\?(?:P?<\w+>|[imsU]*(?:-[imsU]+)?:))?", p[i:])
            inner, i = _required(p, i + opened.end())
            if i is None or p[i : i + 1] != ")":
                return frozenset(), None
            i += 1
        elif c == "[":
            closed = re.match(r"\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]", p[i:], re.DOTALL)
            if not closed:
                return frozenset(), None
            i += closed.end()
        elif c == "\\":
            if p[i + 1 : i + 2] in ("Q", "x", "p", "P", "") or p[i + 1 : i + 2].isdigit():
                return frozenset(), None
            atom = "" if p[i + 1].isalnum() else p[i + 1]
            i += 2
        else:
            atom = "" if c in ".^$" or ord(c) >= 0x80 else c.lower()
            i += 1
        if m := re.match(r"(?:[*+?]|\{(\d+)(?:,\d*)?\})\??", p[i:]):
            i += m.end()
            needed = m[0][0] == "+" or (m[1] is not None and int(m[1]) > 0)
            parts += [frozenset([run])] if run else []
            run = ""
            parts += [inner or (frozenset([atom]) if atom else frozenset())] if needed else []
        elif atom:
            run += atom
        else:
            parts += [frozenset([run])] if run else []
            parts.append(inner)
            run = ""


def may_fit(line_folded: Column, *patterns: str) -> Column:
    """Whether a folded() text has what one of the patterns needs; true if nothing can be said of one of them."""
    needs = [literals(p) for p in patterns]
    if not all(needs):
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(line_folded, F.lit(w)) for w in sorted({w for n in needs for w in n})])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is found once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def language(path: Column) -> Column:
    """The language that a path's ending names, or unknown."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    known = {"go": (".go",), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".tsx"), "python": (".py",), "ruby": (".rb",), "jvm": (".java", ".kt"), "config": (".json", ".yaml", ".yml", ".toml")}
    return F.coalesce(*[F.when(ending.isin(*ends), name) for name, ends in known.items()], F.lit("unknown"))


# What paths of fixtures, and of documents and other reviewed matter, look like; in lower case.
FIXTURE = r"_test\.go$|/testdata/|/fixtures/|/examples/"
ARTIFACT = rf"\.(md|rst|txt)$|/docs/|{FIXTURE}|(^|/)src/(rule|engine|analyze|tui)/"


def fixture(path: Column) -> Column:
    return F.lower(path).rlike(FIXTURE)


def artifact(path: Column) -> Column:
    """Documents, fixtures and a rule engine's own sources, which no rule reads."""
    return F.lower(path).rlike(ARTIFACT)


def executable(path: Column) -> Column:
    return (language(path) != "unknown") & ~artifact(path)
