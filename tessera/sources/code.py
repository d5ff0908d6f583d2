"""Declarations, imports, exports and identifiers of source files, by one pass over a file's tokens.

JavaScript and TypeScript are cut into tokens (comments, strings, templates and regular
expressions are one each), brackets are paired, and statements are read at the top, in
functions' bodies, in classes and in objects; what lies in other blocks is not searched.
If brackets don't pair, lines that begin a declaration are taken instead. Python is
read by indentation. A file is a row: Spark deals files to tasks, and nothing here
holds more than one.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

#: Declarations that a line may begin, for files whose brackets don't pair: kind and pattern, the first that fits.
LINES = (
    ("class", r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("function", r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("function", r"\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)"),
    ("type", r"\s*(?:export\s+)?(?:interface|type)\s+([A-Za-z_$][\w$]*)"),
    ("enum", r"\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    ("export", r"\s*export\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)"),
)
_LEX = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")|(?P<id>[A-Za-z_$\#][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|[^\w\s])""", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_WORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof let new null return super switch this throw true try typeof var void while with yield async await static get set of type interface as from implements".split())
_OPEN, _CLOSED = frozenset("([{"), frozenset(")]}")
_MODIFIERS = frozenset("public private protected static readonly async get set abstract override declare accessor".split())


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    column: int
    last: int  # the line that it ends on


class Entry(NamedTuple):
    """What is found: what is block, definition, import, export or reference."""

    what: str
    kind: str
    name: str
    start: int
    end: int
    exported: bool = False
    other: str = ""  # a signature, a local name
    source: str = ""
    column: int = 0


def _template(text: str, at: int) -> int:
    """Where a template that begins at a backquote ends; templates within its braces may nest to any depth."""
    depths, at = [0], at + 1  # of braces in each open template
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif not depths[-1] and c == "`":
            depths.pop()
            if not depths:
                return at + 1
        elif text.startswith("${", at):
            depths[-1], at = depths[-1] + 1, at + 1
        elif depths[-1] and c in "{}":
            depths[-1] += 1 if c == "{" else -1
        elif depths[-1] and c == "`":
            depths.append(0)
        at += 1
    return at


def lex(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, begin = 0, 1, 0
    while at < len(text):
        before = out[-1] if out else None
        value = before is not None and (before.kind in ("num", "str") or before.kind == "id" and before.text not in _WORDS - {"this", "super"} or before.text in (")", "]", "}"))
        m = None
        if text[at] == "`":
            end, kind = _template(text, at), "str"
        elif text[at] == "/" and not value and (m := _REGEX.match(text, at)):
            end, kind = m.end(), "str"
        else:
            m = _LEX.match(text, at)
            end, kind = (m.end(), m.lastgroup) if m else (at + 1, "op")
        raw = text[at:end]
        last = line + raw.count("\n")
        if kind != "skip":
            out.append(Token(kind, raw, line, at - begin, last))
        if last > line:
            begin = at + raw.rindex("\n") + 1
        at, line = end, last
    return out


def _pairs(tokens: list[Token]) -> list[int] | None:
    """For each opening bracket the place of its closing one; None if they don't pair."""
    close, open_ = [-1] * len(tokens), []
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text in "([{":
            open_.append(i)
        elif t.kind == "op" and t.text in ")]}":
            if not open_ or tokens[open_[-1]].text + t.text not in ("()", "[]", "{}"):
                return None
            close[open_.pop()] = i
    return None if open_ else close


class Reader:
    """The statements of a file, and what they declare."""

    def __init__(self, tokens: list[Token], close: list[int]):
        self.t, self.close, self.out, self.names = tokens, close, [], set()

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].text in texts and self.t[i].kind != "str"

    def after(self, i: int) -> int:
        return self.close[i] + 1 if self.close[i] > i else i + 1

    def until(self, i: int, end: int, *texts: str) -> int:
        """The first of some operators at this depth."""
        while i < end and not self.is_(i, *texts):
            i = self.after(i)
        return i

    def statement_end(self, i: int, end: int) -> int:
        """Behind a statement: at a semicolon, or where a new line can't go on with it."""
        while i < end:
            if self.is_(i, ";"):
                return i + 1
            i = self.after(i)
            if i < end and self.t[i].line > self.t[i - 1].last:
                last, next_ = self.t[i - 1], self.t[i]
                goes_on = next_.kind == "op" and next_.text not in "{@#" or next_.text in ("in", "of", "instanceof", "as", "else", "catch", "finally", "extends", "from")
                if not goes_on and (last.kind != "op" or last.text in ")]}") and last.text not in ("=", "return", "extends", "else", "new"):
                    return i
        return end

    def body(self, i: int, end: int) -> int:
        """The bracket of a function's body behind its parameters and type, or -1."""
        i = self.until(i, end, "(", ";")
        if not self.is_(i, "("):
            return -1
        i = self.after(i)
        typed = self.is_(i, ":")
        while i < end and not self.is_(i, ";", "=>"):
            if self.is_(i, "{") and not (typed and self.is_(i - 1, ":", "|", "&", "<", ",", "(")):
                return i
            i = self.after(i)
        return -1

    def function(self, i: int, end: int) -> tuple[bool, int]:
        """Whether a value is a function, and the bracket of its body (-1: an expression)."""
        i += self.is_(i, "async") and not self.is_(i + 1, "=>")
        if self.is_(i, "function"):
            return True, self.body(i, end)
        if self.is_(i, "<"):
            i = self.until(i, end, "(")
        if not (self.is_(i, "(") or i < end and self.t[i].kind == "id"):
            return False, -1
        j = self.after(i)
        if self.is_(j, ":"):
            j = self.until(j, end, "=>", ";", ",")
        return (True, j + 1 if self.is_(j + 1, "{") else -1) if self.is_(j, "=>") else (False, -1)

    def add(self, what: str, kind: str, name: str, i: int, j: int, exported: bool = False, node: str = "") -> None:
        last = max(i, j - 1)
        while last > i and self.is_(last, ";"):
            last -= 1
        self.out.append(Entry(what, kind, name, self.t[i].line, self.t[last].last, exported, f"{node or kind}@{self.t[i].line}"))

    def both(self, kind: str, name: str, block: tuple[int, int], own: tuple[int, int], scope: str, exported: bool, bare: bool = False) -> str:
        scoped = f"{scope}.{name}" if scope else name
        self.add("block", kind, name if bare else scoped, *block)
        self.add("definition", kind, scoped, *own, exported)
        return scoped

    def inside(self, bracket: int, scope: str, exported: bool) -> None:
        if bracket >= 0:
            self.statements(bracket + 1, self.close[bracket], scope, exported)

    def statements(self, i: int, end: int, scope: str = "", exported: bool = False) -> None:
        while i < end:
            i = max(i + 1, self.statement(i, end, scope, exported))

    def statement(self, i: int, end: int, scope: str, exported: bool) -> int:
        begin, top = i, False
        while self.is_(i, "@"):
            i = self.after(i + 2) if self.is_(i + 2, "(") else i + 2
        begin = i
        if self.is_(i, "import") and not self.is_(i + 1, "(", "."):
            return self.imports(i, end)
        if self.is_(i, "export"):
            i, exported, top = i + 1, True, True
            if self.is_(i, "default"):
                i += 1
                k = i + self.is_(i, "async", "abstract")
                if self.is_(k, "function", "class"):
                    k += 1 + self.is_(k + 1, "*")
                local = self.t[k].text if k < end and self.t[k].kind == "id" and self.t[k].text not in _WORDS else "default"
                self.out.append(Entry("export", "", "default", self.t[begin].line, self.t[begin].line, other=local))
            elif self.is_(i, "{"):
                return self.specifiers(begin, i, end)
            elif self.is_(i, "*"):
                return self.statement_end(i, end)
        i += self.is_(i, "declare", "abstract")
        if self.is_(i, "function") or self.is_(i, "async") and self.is_(i + 1, "function"):
            k = i + self.is_(i, "async") + 1
            k += self.is_(k, "*")
            name = self.t[k].text if k < end and self.t[k].kind == "id" else "default"
            body = self.body(k, end)
            stop = self.close[body] + 1 if body >= 0 else self.statement_end(k, end)
            scoped = self.both("function", name, (begin, stop), (i, stop), scope, exported)
            self.declared(top, name, i, k)
            self.inside(body, scoped, exported)
            return stop
        if self.is_(i, "class"):
            return self.class_(i, end, begin, i, scope, exported, top)
        if i + 1 < end and self.t[i + 1].kind == "id" and (self.is_(i, "interface", "type", "enum") or self.is_(i, "const") and self.is_(i + 1, "enum")):
            k = i + 1 + self.is_(i + 1, "enum")
            stop = self.after(self.until(k, end, "{", ";")) if not self.is_(i, "type") else self.statement_end(k, end)
            kind = "enum" if self.is_(k - 1, "enum") else "type"
            self.both(kind, self.t[k].text, (begin, stop), (i, stop), scope, exported, bare=True)
            self.declared(top, self.t[k].text, i, k)
            return stop
        if self.is_(i, "const", "let", "var"):
            stop = self.statement_end(i, end)
            self.variables(i + 1, stop, (begin, stop), scope, exported, top)
            return stop
        return self.statement_end(i, end)

    def declared(self, top: bool, name: str, i: int, k: int) -> None:
        self.names.add(k)
        if top and name != "default":
            self.out.append(Entry("export", "", name, self.t[i].line, self.t[i].line, other=name))

    def variables(self, i: int, stop: int, block: tuple[int, int], scope: str, exported: bool, top: bool) -> None:
        while i < stop:
            end = self.until(i, stop, ",", ";")
            equals = self.until(i, end, "=")
            if self.t[i].kind == "id":
                name, value, scoped = self.t[i].text, equals + 1, f"{scope}.{self.t[i].text}" if scope else self.t[i].text
                function, body = self.function(value, end) if value < end else (False, -1)
                if function:
                    self.both("function", name, block, (i, end), scope, exported)
                    self.inside(body, scoped, exported)
                elif value < end and self.is_(value, "class"):
                    self.both("class", name, block, (i, end), scope, exported)
                    self.members(self.until(value, end, "{"), scoped, exported)
                else:
                    if top:
                        self.add("block", "export", name, *block)
                    if exported:
                        self.add("definition", "export", scoped, i, end, True)
                    if value < end and self.is_(value, "{"):
                        self.members(value, scoped, exported)
                self.declared(top, name, block[0], i)
            i = end + 1

    def class_(self, i: int, end: int, begin: int, own: int, scope: str, exported: bool, top: bool) -> int:
        named = i + 1 < end and self.t[i + 1].kind == "id" and not self.is_(i + 1, "extends", "implements")
        name, bracket = self.t[i + 1].text if named else "default", self.until(i, end, "{")
        stop = self.after(bracket) if bracket < end else end
        scoped = self.both("class", name, (begin, stop), (own, stop), scope, exported)
        self.declared(top, name, i, i + 1)
        if bracket < end:
            self.members(bracket, scoped, exported)
        return stop

    def members(self, bracket: int, scope: str, exported: bool) -> None:
        """Methods and function-valued members of a class or an object."""
        i, end = bracket + 1, self.close[bracket]
        while i < end:
            while self.is_(i, ";", ","):
                i += 1
            while self.is_(i, "@"):
                i = self.after(i + 2) if self.is_(i + 2, "(") else i + 2
            if i >= end:
                return
            begin = i
            while i + 1 < end and (self.is_(i, "*") or self.t[i].text in _MODIFIERS and not self.is_(i + 1, "(", "=", ":", ",", ";", "?")):
                i += 1
            name = self.t[i].text.strip("'\"") if self.t[i].kind in ("id", "str", "num") else ""
            k = self.after(i) + self.is_(self.after(i), "?", "!")
            scoped = f"{scope}.{name}"
            if self.is_(k, "(", "<"):
                body = self.body(k, end)
                stop = self.close[body] + 1 if body >= 0 else self.statement_end(k, end)
                if name and body >= 0:
                    self.names.add(i)
                    self.both("method", name, (begin, stop), (begin, stop), scope, exported)
                    self.inside(body, scoped, exported)
                i = stop
                continue
            stop = self.until(k, end, ",", ";")
            if self.is_(k, ":", "="):
                value = k if self.is_(k, "=") else self.until(k, stop, "=") if self.until(k, stop, "=") < stop and not self.function(k + 1, stop)[0] else k
                stop = min(stop, self.statement_end(value + 1, end))
                function, body = self.function(value + 1, stop)
                if function and name:
                    last = stop if not self.is_(stop - 1, ";", ",") else stop - 1
                    self.names.add(i)
                    self.both("method", name, (begin, last), (begin, last), scope, exported)
                    self.inside(body, scoped, exported)
            elif k < end and self.t[k].line > self.t[i].line:
                stop = k
            i = max(stop, begin + 1)

    def imports(self, i: int, end: int) -> int:
        stop = self.statement_end(i + 1, end)
        line = self.t[i].line
        source = next((t.text[1:-1] for t in reversed(self.t[i:stop]) if t.kind == "str"), "")
        found, k = [], i + 1 + (self.is_(i + 1, "type") and not self.is_(i + 2, "from", ","))
        if not self.is_(k, "{", "*") and k < stop and self.t[k].kind == "id":
            found.append(("default", self.t[k].text))
            k += 1
        for j in range(k, stop):
            if self.is_(j, "*") and self.is_(j + 1, "as"):
                found.append(("*", self.t[j + 2].text))
            if self.is_(j, "{"):
                found += self.listed(j)
        self.names.update(range(i, stop))
        for imported, local in found or [("*", "*")]:
            self.out.append(Entry("import", "", imported, line, line, other=local, source=source))
        return stop

    def listed(self, bracket: int) -> list[tuple[str, str]]:
        """The names of a list in braces: the first one and, after "as", the last one."""
        out, own = [], []
        for t in [*self.t[bracket + 1 : self.close[bracket]], Token("op", ",", 0, 0, 0)]:
            if t.text == "," and own:
                out.append((own[0], own[-1]))
                own = []
            elif t.kind in ("id", "str") and not (t.text in ("as", "type") and (t.text == "as" or not own)):
                own.append(t.text.strip("'\""))
        return out

    def specifiers(self, begin: int, bracket: int, end: int) -> int:
        stop = self.statement_end(bracket, end)
        self.names.update(range(begin, stop))
        for local, name in self.listed(bracket):
            self.add("block", "export", name, begin, stop)
            self.out.append(Entry("export", "", name, self.t[begin].line, self.t[begin].line, other=local))
        return stop

    def references(self) -> Iterator[Entry]:
        """Identifiers that are neither declared there, nor members, nor keys of objects."""
        for i, t in enumerate(self.t):
            if t.kind == "id" and t.text not in _WORDS and i not in self.names and not self.is_(i - 1, ".", "?.") * (i > 0) and not (self.is_(i + 1, ":") and self.is_(i - 1, "{", ",") * (i > 0)):
                yield Entry("reference", "identifier", t.text, t.line, t.line, column=t.column)


def javascript(text: str) -> list[Entry]:
    """All entries of a file; of one whose brackets don't pair, the declarations that lines begin."""
    tokens = lex(text)
    close = _pairs(tokens)
    if close is None:
        return list(by_lines(text.split("\n")))
    reader = Reader(tokens, close)
    with _nested(tokens):
        reader.statements(0, len(tokens))
    return [*reader.out, *reader.references()]


@contextmanager
def _nested(tokens: list[Token]) -> Iterator[None]:
    """Room for a few calls for each open bracket; such calls lie on the heap, so depth costs memory alone."""
    depth = most = 0
    for t in tokens:
        depth += (t.text in _OPEN) - (t.text in _CLOSED)
        most = max(most, depth)
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, before + 16 * most))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


_QUIET = re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`|//.*|/\*.*?\*/")


def by_lines(lines: list[str]) -> Iterator[Entry]:
    plain = [_QUIET.sub("", line) for line in lines]  # each line once, however many declarations look at it
    rise = [code.count("{") - code.count("}") for code in plain]
    opens, ends, blank = ["{" in code for code in plain], [code.rstrip().endswith(";") for code in plain], [not code.strip() for code in plain]
    for i, line in enumerate(lines):
        for kind, pattern in LINES:
            if m := re.match(pattern, line):
                depth, seen, end = 0, False, i
                for end in range(i, len(lines)):
                    seen = seen or opens[end]
                    depth += rise[end]
                    if seen and depth <= 0 or not seen and ends[end]:
                        break
                    if end > i and not seen and blank[end]:
                        end -= 1
                        break
                yield Entry("block", kind, m[1], i + 1, end + 1)
                yield Entry("definition", kind, m[1], i + 1, end + 1, bool(re.match(r"\s*export\b", line)), f"{kind}@{i + 1}")
                break


def python(lines: list[str]) -> Iterator[Entry]:
    """Functions and classes with their decorators; a function's name carries its nearest container's."""
    width = lambda s: len(s[: len(s) - len(s.lstrip(" \t"))].replace("\t", "    "))
    found: list[tuple[str, str, int, int, int]] = []
    for i, line in enumerate(lines):
        if not (m := re.match(r"\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", line)):
            continue
        indent, first, last = width(line), i, i
        while first and lines[first - 1].lstrip().startswith("@") and width(lines[first - 1]) == indent:
            first -= 1
        for j in range(i + 1, len(lines)):
            if (code := lines[j].strip()) and not code.startswith("#"):
                if width(lines[j]) <= indent:
                    break
                last = j
        found.append(("class" if m[1] == "class" else "function", m[2], first, last, indent))
    for kind, name, first, last, indent in found:
        around = [f for f in found if f[2] <= first and f[3] >= last and f[4] < indent]
        if around and kind == "function":
            name = f"{max(around, key=lambda f: (f[4], f[2]))[1]}.{name}"
        yield Entry("block", kind, name, first + 1, last + 1)


def blocks_of(text: str, language: str) -> list[Entry]:
    """The blocks of a file in order: by first line, the longest first, by name."""
    lines = re.split(r"\r?\n", text)
    found = python(lines) if language == "python" else javascript("\n".join(lines)) if language in ("javascript", "typescript") else ()
    return sorted((e for e in found if e.what == "block" and e.start <= e.end), key=lambda e: (e.start, -e.end, e.name))


def chunked(text: str, language: str, most: int = 80, overlap: int = 8) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """First line, last line, symbol, whether it is a gap, and text of each chunk: gaps, blocks and the blocks within them, windowed."""
    lines, blocks = re.split(r"\r?\n", text), blocks_of(text, language)
    marks = sorted((b.start, b.name, b.kind) for b in blocks)

    def windows(first: int, last: int, symbol: str | None) -> Iterator[tuple[int, int, str | None, bool, str]]:
        at = first
        while at <= last:
            end = min(last, at + most - 1)
            near = next((f"{kind}:{name}" for line, name, kind in reversed(marks) if line <= at), None)
            if body := "\n".join(lines[at - 1 : end]).strip():
                yield at, end, symbol or near, symbol is None, body
            if end == last:
                return
            at = max(end - overlap + 1, at + 1)

    cursor = 1
    for b in blocks:
        if b.start < cursor:
            continue
        yield from windows(cursor, b.start - 1, None)
        yield from windows(b.start, b.end, f"{b.kind}:{b.name}")
        for n in blocks:
            if n is not b and n.start >= b.start and n.end <= b.end and (n.start, n.end) != (b.start, b.end):
                yield from windows(n.start, n.end, f"{n.kind}:{n.name}")
        cursor = b.end + 1
    yield from windows(cursor, len(lines), None)
