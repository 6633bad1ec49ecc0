"""Declarations of a source text: a lexer, pairs of brackets, and a stack of scopes that knows where declarations can stand."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

LOOK_BACK = 9
_NOT_CALLS = frozenset("if for while switch catch return new super this function def class print synchronized func elif assert with and or not in is lambda await yield typeof sizeof".split())
_DECLARING = frozenset(("function", "def", "class", "func", "interface", "enum"))

_SHARED = r"(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)"
_C_COMMENT = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_LEXERS = {
    "python": r"(?P<comment>#[^\n]*)|(?P<string>(?i:[rbuft]{0,2})(?:\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'''(?:\\.|.)*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))|(?P<join>\\\r?\n)|" + _SHARED + r"|(?P<line>\n)|(?P<mark>[^\s])",
    "java": _C_COMMENT + r"|(?P<string>\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|" + _SHARED + r"|(?P<mark>->|[^\s])",
    "go": _C_COMMENT + r"|(?P<string>`[^`]*`?|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|" + _SHARED + r"|(?P<mark>[^\s])",
    "javascript": _C_COMMENT + r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[^\W\d]\w*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|[^\s])",
}
_LEXERS = {name: re.compile(pattern, re.DOTALL) for name, pattern in _LEXERS.items()}
_LEXERS["typescript"] = _LEXERS["javascript"]
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.DOTALL)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: After these a slash opens a pattern, not a division.
_BEFORE_PATTERN = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => return typeof case in of delete void throw new else do".split())


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def lex(source: str, language: str) -> list[Token]:
    """Words, numbers, strings and marks; comments are left out. Python also gives line ends. Templates give their strings and, between them, the tokens of what they hold."""
    find, out = _LEXERS[language].match, []
    scripted = language in ("javascript", "typescript")
    templates: list[int] = []  # depth of braces at which a template goes on
    at, depth, size = 0, 0, len(source)

    def template(begin: int) -> int:
        m = _TEMPLATE.match(source, begin)
        out.append(Token("string", source[begin - 1 : m.end()], begin - 1, m.end()))
        if m[1] == "${":
            templates.append(depth)
        return m.end()

    while at < size:
        c = source[at]
        if c.isspace() and (c != "\n" or language != "python"):
            at += 1
            continue
        if scripted:
            if c == "`":
                at = template(at + 1)
                continue
            if c == "}" and templates and templates[-1] == depth:
                templates.pop()
                at = template(at + 1)
                continue
            if c == "/" and source[at + 1 : at + 2] not in ("/", "*") and (not out or out[-1].text in _BEFORE_PATTERN) and (m := _PATTERN.match(source, at)):
                out.append(Token("string", m[0], at, m.end()))
                at = m.end()
                continue
        m = find(source, at)
        if m is None:
            at += 1
            continue
        if m.lastgroup not in ("comment", "join"):
            out.append(Token(m.lastgroup, m[0], at, m.end()))
            depth += (m[0] == "{") - (m[0] == "}") if m.lastgroup == "mark" else 0
        at = m.end()
    return out


def pairs(tokens: list[Token]) -> list[int]:
    """For each opening bracket the place of the one that closes it, the number of tokens if none does; for others their own place."""
    out, stack = list(range(len(tokens))), []
    closes = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.text in "([{":
            stack.append(i)
            out[i] = len(tokens)
        elif t.text in closes and any(tokens[j].text == closes[t.text] for j in stack):
            while tokens[j := stack.pop()].text != closes[t.text]:  # what the braces leave open ends here
                out[j] = i - 1
            out[j] = i
    return out


def docstring_before(lines: list[str], start: int) -> str | None:
    """The comment above line ``start`` (0-based): up to nine lines back, past blank and annotation lines, without comment marks."""
    found = []
    for line in map(str.strip, reversed(lines[max(0, start - LOOK_BACK) : start])):
        if line.startswith(("//", "#", "--")):
            found.append(line.lstrip("/#-").strip())
        elif line.startswith(("/*", "*")):
            found.append(line.lstrip("/*").strip())
        elif line and not line.startswith("@"):
            break
    return "\n".join(reversed(found)) if found else None


def _relation(kind: str, name: str, target: str) -> dict:
    return {"type": kind, "target_name": name, "target_type": target, "properties": {}}


class Scan:
    """Collects the entities of one file."""

    def __init__(self, source: str, language: str):
        self.source, self.language, self.found = source, language, []
        self.lines = source.split("\n")
        self.starts = [0]
        for line in self.lines[:-1]:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.tokens = lex(source, language)
        self.pair = pairs(self.tokens)

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1

    def is_at(self, i: int, *texts: str) -> bool:
        return i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind != "string"

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def end_of(self, i: int) -> int:
        """Place of the token that closes group i, or the last one."""
        return min(self.pair[i], len(self.tokens) - 1) if i < len(self.pair) else i

    def add(self, kind: str, name: str, first: int, last: int, body: int | None = None, notes: list[int] = (), doc: bool = True) -> dict:
        """An entity of the tokens ``first`` to ``last``; ``body``: the token that ends its signature; ``notes``: annotation marks before it."""
        a, z = self.tokens[first].start, self.tokens[last].end
        body = body if body is None or body < len(self.tokens) else None
        head = self.line(a)
        signature = self.source[a : z if body is None else self.tokens[body].start].strip()
        e = {
            "type": kind, "name": name, "language": self.language, "start_line": head + 1, "end_line": self.line(z - 1) + 1, "signature": signature if kind != "Field" else None,
            "docstring": docstring_before(self.lines, self.line(self.tokens[notes[0]].start) if notes else head) if doc else None, "code": self.source[a:z],
            "annotations": [self.dotted(i + 1) for i in notes], "relations": [],
        }
        self.found.append(e)
        return e

    def dotted(self, i: int) -> str:
        out = self.tokens[i].text if self.word(i) else ""
        while self.is_at(i + 1, ".") and self.word(i + 2):
            i += 2
            out += f".{self.tokens[i].text}"
        return out

    def has(self, owner: dict, kind: str, name: str) -> None:
        owner["relations"].append(_relation(f"HAS_{kind.upper()}", name, kind))

    def calls(self, e: dict, first: int, last: int, target: str) -> None:
        """Names before an opening bracket, in order, each once, without the entity's own."""
        t = self.tokens
        names = (t[i].text for i in range(first, last) if t[i].kind == "word" and self.is_at(i + 1, "(") and not (i and t[i - 1].text in _DECLARING))
        e["relations"] += [_relation("CALLS", n, target) for n in dict.fromkeys(names) if n not in _NOT_CALLS and n != e["name"]]

    def angled(self, i: int, end: int) -> int:
        """Past the type arguments that may stand at i."""
        if not self.is_at(i, "<"):
            return i
        depth = 0
        while i < end:
            depth += self.is_at(i, "<") - self.is_at(i, ">")
            i += 1
            if depth == 0:
                break
        return i

    def names(self, i: int, end: int) -> tuple[list[str], int]:
        """Types parted by commas from i on, without packages and type arguments, and where they end."""
        out = []
        while self.word(i) and i < end:
            name = self.dotted(i)
            i = self.angled(i + 1 + 2 * name.count("."), end)
            out.append(name.split(".")[-1])
            if not self.is_at(i, ","):
                break
            i += 1
        return out, i

    # Python: logical lines, whose indents open and close scopes.

    def python(self) -> None:
        t, rows, at = self.tokens, [], 0
        while at < len(t):  # a line ends at a line end outside brackets
            end = at
            while end < len(t) and t[end].kind != "line":
                end = min(self.pair[end], len(t) - 1) + 1 if self.pair[end] != end else end + 1
            if end > at:
                rows.append((at, end))
            at = end + 1
        indent = lambda i: len(self.source[self.starts[self.line(t[i].start)] : t[i].start].expandtabs())
        scopes: list[tuple[int, str, dict | None]] = []  # indent, kind, entity
        notes: list[int] = []
        for n, (a, z) in enumerate(rows):
            level = indent(a)
            while scopes and level <= scopes[-1][0]:
                scopes.pop()
            if self.is_at(a, "@"):
                notes.append(a)
                continue
            at = a + self.is_at(a, "async")
            kind, name = t[at].text, at + 1
            if kind in ("class", "def") and self.word(name):
                colon = name + 1
                while colon < z and not self.is_at(colon, ":"):
                    colon = self.end_of(colon) + 1
                stop = n + 1
                while stop < len(rows) and indent(rows[stop][0]) > level:
                    stop += 1
                last = rows[stop - 1][1] - 1
                owner = scopes[-1] if scopes else (-1, "", None)
                if kind == "class" and owner[1] != "function":
                    e = self.add("Class", t[name].text, a, last, colon, notes)
                    if self.is_at(name + 1, "("):
                        e["relations"] += [_relation("EXTENDS", b, "Class") for b in self.bases(name + 2, self.pair[name + 1])]
                    scopes.append((level, "class", e))
                elif kind == "def" and owner[1] in ("", "class"):
                    what = "Method" if owner[1] else "Function"
                    e = self.add(what, t[name].text, a, last, colon, notes)
                    self.calls(e, colon, last + 1, what)
                    if owner[2]:
                        self.has(owner[2], "Method", t[name].text)
                    scopes.append((level, "method" if owner[1] else "function", None))
                else:
                    scopes.append((level, owner[1], None))
            elif scopes and scopes[-1][1] == "class" and scopes[-1][2]:
                name = a + 2 if self.is_at(a, "self") and self.is_at(a + 1, ".") else a
                if self.word(name) and (self.is_at(name + 1, ":") or self.is_at(name + 1, "=") and not self.is_at(name + 2, "=")) and any(self.is_at(i, "=") for i in range(name + 1, z)):
                    self.add("Field", t[name].text, a, z - 1, doc=False)
                    self.has(scopes[-1][2], "Field", t[name].text)
            notes = []

    def bases(self, i: int, end: int) -> list[str]:
        out = []
        while i < end:
            start = i
            while i < end and not self.is_at(i, ","):
                i = self.end_of(i) + 1
            if self.word(start) and not any(self.is_at(j, "=") for j in range(start, i)):
                out.append(self.dotted(start).split(".")[-1])
            i += 1
        return out

    # Java: statements of a type's body are members; other code is searched for types only.

    def java(self) -> None:
        self.java_types(0, len(self.tokens))

    def java_types(self, i: int, end: int) -> None:
        """Types in code; a declaration starts after the last end of a statement."""
        first = i
        while i < end:
            if self.is_type(i):
                while self.is_at(first, "@") and self.word(first + 1):
                    first = self.past_note(first)
                i = self.java_type(first, i, end, self.notes_before(first))
                first = i
                continue
            if self.is_at(i, ";", "{", "}"):
                first = i + 1
            i += 1

    def is_type(self, i: int) -> bool:
        if not self.is_at(i, "class", "interface", "enum", "record") or not self.word(i + 1) or i and self.is_at(i - 1, ".", "@"):
            return False
        return not self.is_at(i, "record") or self.is_at(self.angled(i + 2, len(self.tokens)), "(")

    def past_note(self, i: int) -> int:
        """Past the annotation at i."""
        i += 2 + 2 * self.dotted(i + 1).count(".")
        return self.end_of(i) + 1 if self.is_at(i, "(") else i

    def notes_before(self, first: int) -> list[int]:
        """Marks of the annotations that end where ``first`` stands."""
        out, i = [], first
        while i > 0:
            j = next((k for k in range(i - 2, max(-1, i - 400), -1) if self.is_at(k, "@") and self.past_note(k) == i), None)
            if j is None:
                break
            out.insert(0, j)
            i = j
        return out

    def java_type(self, first: int, key: int, end: int, notes: list[int]) -> int:
        """The type whose keyword stands at ``key``; returns the place past it."""
        t, kind = self.tokens, self.tokens[key].text
        i = self.angled(key + 2, end)
        if kind == "record":
            i = self.end_of(i) + 1
        extends, implements = [], []
        while i < end and not self.is_at(i, "{", ";"):
            if self.is_at(i, "extends", "implements", "permits"):
                found, j = self.names(i + 1, end)
                (extends if t[i].text == "extends" else implements if t[i].text == "implements" else []).extend(found)
                i = max(j, i + 1)
            else:
                i += 1
        if not self.is_at(i, "{"):
            return i + 1
        close = self.end_of(i)
        e = self.add({"interface": "Interface", "enum": "Enum"}.get(kind, "Class"), t[key + 1].text, first, close, i, notes)
        e["relations"] += [_relation("EXTENDS", n, "Class") for n in extends] + [_relation("IMPLEMENTS", n, "Interface") for n in implements]
        inside = i + 1
        if kind == "enum":
            inside = self.java_constants(e, inside, close)
        self.java_members(e, inside, close)
        return close + 1

    def java_constants(self, owner: dict, i: int, end: int) -> int:
        while i < end and not self.is_at(i, ";"):
            while self.is_at(i, "@"):
                i = self.past_note(i)
            if self.word(i):
                last = i
                while last + 1 < end and self.is_at(last + 1, "(", "{"):
                    last = self.end_of(last + 1)
                self.add("Field", self.tokens[i].text, i, last, doc=False)
                self.has(owner, "Field", self.tokens[i].text)
                i = last
            i += 1
        return i + 1

    def java_members(self, owner: dict, i: int, end: int) -> None:
        t = self.tokens
        while i < end:
            notes = []
            while self.is_at(i, "@") and not self.is_at(i + 1, "interface"):
                notes.append(i)
                i = self.past_note(i)
            if i >= end:
                return
            first, key, name, equals = i, None, None, False
            names: list[int] = []  # of variables
            while i < end and not self.is_at(i, ";"):
                if key is None and name is None and not equals and self.is_type(i):
                    key = i
                    break
                if self.is_at(i, "@"):
                    if self.is_at(i + 1, "interface"):
                        name = -1
                        i += 1
                    else:  # an annotation among modifiers or types
                        if not names and name is None:
                            notes.append(i)
                        i = self.past_note(i)
                        continue
                elif self.is_at(i, "="):
                    equals = True
                elif self.is_at(i, ",") and equals:
                    equals = False
                    if self.word(i + 1):
                        names.append(i + 1)
                elif self.is_at(i, "<") and not equals:
                    i = self.angled(i, end)
                    continue
                elif self.is_at(i, "(") and not equals and name is None and self.word(i - 1):
                    name = i - 1
                elif self.is_at(i, "{") and not equals:
                    break
                elif not equals and self.word(i) and i > first and self.is_at(self.past_brackets(i + 1), "=", ",", ";"):
                    names.append(i)
                i = self.end_of(i) + 1
            if key is not None:
                i = self.java_type(first, key, end, notes)
                continue
            closed = i < end and self.is_at(i, "{")
            last = self.end_of(i) if closed else min(i, end - 1)
            if name is not None and name >= 0 and t[name].text not in _NOT_CALLS:
                e = self.add("Method", t[name].text, first, last, i if closed else None, notes)
                self.calls(e, i, last, "Method")
                self.has(owner, "Method", t[name].text)
            elif name is None and names and self.is_at(i, ";"):
                for n in dict.fromkeys(names):
                    self.add("Field", t[n].text, first, last, doc=False)
                    self.has(owner, "Field", t[n].text)
            if closed and name != -1:
                self.java_types(i + 1, last)
            i = last + 1

    def past_brackets(self, i: int) -> int:
        while self.is_at(i, "["):
            i = self.end_of(i) + 1
        return i

    # JavaScript and TypeScript: any code may hold functions and classes, but for the bodies of functions.

    def javascript(self) -> None:
        i, end = 0, len(self.tokens)
        while i < end:
            i = self.script_step(i, end)

    typescript = javascript

    def head(self, i: int, *modifiers: str) -> int:
        while i and self.is_at(i - 1, *modifiers):
            i -= 1
        return i

    def script_step(self, i: int, end: int) -> int:
        t = self.tokens
        free = not (i and self.is_at(i - 1, "."))
        if free and self.is_at(i, "class") and (self.word(i + 1) or self.is_at(i + 1, "{")) and not self.is_at(i + 1, "="):
            return self.script_class(i, end)
        if free and self.is_at(i, "function"):
            name = i + 1 + self.is_at(i + 1, "*")
            body = self.script_body(self.angled(name + self.word(name), end), end)
            if body is None:
                return i + 1
            if self.word(name) and (not i or not self.is_at(i - 1, "=", "(", ",", ":", "return", "=>", "?")):
                first = self.head(i, "async", "default", "export", "declare")
                e = self.add("Function", t[name].text, first, self.end_of(body), body)
                self.calls(e, body, self.end_of(body), "Function")
            return self.end_of(body) + 1
        if self.is_at(i, "const", "let", "var") and self.word(i + 1):
            return self.script_variable(i, end)
        return i + 1

    def script_variable(self, i: int, end: int) -> int:
        """``const name = (a, b) => body``, with a type or async perhaps; a body without braces ends with its line or statement."""
        t, at = self.tokens, i + 2
        while at < end and not self.is_at(at, "=", ";", "const", "let", "var", "{") and self.line(t[at].start) - self.line(t[at - 1].end) <= 1:
            at = self.end_of(at) + 1
        if not self.is_at(at, "="):
            return i + 2
        value = at + 1 + self.is_at(at + 1, "async")
        if self.is_at(value, "function"):
            name = value + 1 + self.is_at(value + 1, "*")
            body = self.script_body(self.angled(name + self.word(name), end), end)
        else:
            arrow = self.angled(value, end)
            arrow = self.end_of(arrow) + 1 if arrow < end else end
            while arrow < end and not self.is_at(arrow, "=>", ";", "=", "{", "}", ")"):
                if not self.is_at(value, "(", "<"):
                    break
                arrow = self.end_of(arrow) + 1
            body = arrow + 1 if self.is_at(arrow, "=>") else None
        if body is None or body >= end:
            return at + 1
        last = self.end_of(body) if self.is_at(body, "{") else self.script_end(body, end)
        e = self.add("Function", t[i + 1].text, self.head(i, "export", "declare"), last, body)
        self.calls(e, body, last, "Function")
        return last + 1

    def script_end(self, i: int, end: int) -> int:
        """Last token of the expression at i: before a semicolon or closing bracket, or at the end of a line that doesn't go on."""
        while i < end:
            i = self.end_of(i)
            if i + 1 >= end or self.is_at(i + 1, ";", ")", "]", "}", ","):
                break
            here, after = self.tokens[i], self.tokens[i + 1]
            if self.line(after.start) > self.line(here.end - 1) and not (here.kind == "mark" and here.text not in ")]}") and not (after.kind == "mark" and after.text in ".?:+-*/%&|<>=,("):
                break
            i += 1
        return min(i, end - 1)

    def script_body(self, i: int, end: int) -> int | None:
        """The opening brace of a function whose parameters open at i, past a return type."""
        if not self.is_at(i, "("):
            return None
        i = self.end_of(i) + 1
        if self.is_at(i, ":"):
            i += 1
            while i < end and not (self.is_at(i, "{") and not self.is_at(i - 1, ":", "|", "&", "=>", "<", ",", "is")):
                if self.is_at(i, ";", "}"):
                    return None
                i = self.end_of(i) + 1
        return i if self.is_at(i, "{") and i < end else None

    def script_class(self, key: int, end: int) -> int:
        t = self.tokens
        named = self.word(key + 1) and not self.is_at(key + 1, "extends", "implements")
        i, base = self.angled(key + 1 + named, end), None
        while i < end and not self.is_at(i, "{"):
            if self.is_at(i, "extends") and self.word(i + 1):
                base = self.dotted(i + 1).split(".")[-1]
                i = self.angled(i + 2 + 2 * self.dotted(i + 1).count("."), end)
            else:
                i = self.end_of(i) + 1
        if i >= end:
            return key + 1
        close = self.end_of(i)
        first = self.head(key, "abstract", "default", "export", "declare")
        e = self.add("Class", t[key + 1].text if named else "", first, close, i, self.notes_before(first))
        if base:
            e["relations"].append(_relation("EXTENDS", base, "Class"))
        self.script_members(e, i + 1, close)
        return close + 1

    def script_members(self, owner: dict, i: int, end: int) -> None:
        t = self.tokens
        while i < end:
            notes = []
            while self.is_at(i, "@") and self.word(i + 1):
                notes.append(i)
                i = self.past_note(i)
            first = i
            while i < end and self.is_at(i, "static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*") and not self.is_at(i + 1, "(", "=", ";"):
                i += 1
            i += self.is_at(i, "#")
            name = i
            i = self.end_of(i) + 1  # a name in brackets is a group
            i = self.angled(i + self.is_at(i, "?", "!"), end)
            body = self.script_body(i, end) if i < end else None
            if body is not None:
                last = self.end_of(body)
                if self.word(name) or t[name].kind == "string":
                    title = t[name].text if self.word(name) else t[name].text.strip("'\"")
                    e = self.add("Method", title, first, last, body, notes)
                    self.calls(e, body, last, "Method")
                    self.has(owner, "Method", title)
                i = last + 1
            elif self.is_at(name, "{"):  # static { }
                i = self.end_of(name) + 1
            elif self.is_at(name, ";"):
                i = name + 1
            else:
                i = self.script_end(name, end) + 1
                i += self.is_at(i, ";", ",")

    # Go: declarations stand at the outermost level only.

    def go(self) -> None:
        i, end = 0, len(self.tokens)
        while i < end:
            if self.is_at(i, "type") and self.is_at(i + 1, "("):
                close, at = self.end_of(i + 1), i + 2
                while at < close:
                    at = self.go_type(at, at, close)
                i = close + 1
            elif self.is_at(i, "type") and self.word(i + 1):
                i = self.go_type(i, i + 1, end)
            elif self.is_at(i, "func"):
                i = self.go_function(i, end)
            else:
                i = self.end_of(i) + 1

    def go_line_end(self, i: int, end: int) -> int:
        """Last token of the statement at i: a line ends it outside brackets."""
        while True:
            i = self.end_of(i)
            if i + 1 >= end or self.is_at(i + 1, ";") or self.line(self.tokens[i + 1].start) > self.line(self.tokens[i].end - 1):
                return min(i, end - 1)
            i += 1

    def go_type(self, first: int, name: int, end: int) -> int:
        if not self.word(name):
            return first + 1
        last = self.go_line_end(name, end)
        at = name + 1
        if self.is_at(at, "[") and self.pair[at] > at + 1 and self.word(at + 1) and not self.is_at(at + 2, "]"):
            at = self.end_of(at) + 1  # type parameters
        if self.is_at(at, "=") or at > last:
            return last + 1
        brace = next((j for j in range(at, last + 1) if self.is_at(j, "{")), None)
        kind = "Interface" if self.is_at(at, "interface") else "Struct"
        e = self.add(kind, self.tokens[name].text, first, last, brace)
        if kind == "Interface" and brace is not None:
            i, close = brace + 1, self.end_of(brace)
            while i < close:
                z = self.go_line_end(i, close)
                if self.word(i) and self.is_at(i + 1, "("):
                    self.add("Method", self.tokens[i].text, i, z)
                    self.has(e, "Method", self.tokens[i].text)
                i = z + 1 + self.is_at(z + 1, ";")
        return last + 1 + self.is_at(last + 1, ";")

    def go_function(self, i: int, end: int) -> int:
        method = self.is_at(i + 1, "(")
        name = self.end_of(i + 1) + 1 if method else i + 1
        if not self.word(name):
            return i + 1
        last = self.go_line_end(i, end)
        at = name + 1
        while at <= last and not (self.is_at(at, "{") and not self.is_at(at - 1, "interface", "struct")):
            at = self.end_of(at) + 1
        body = at if at <= last else None
        e = self.add("Method" if method else "Function", self.tokens[name].text, i, last, body, doc=False)
        if body is not None:
            self.calls(e, body, last, "Function")
        return last + 1


def scan_source(source: str, language: str) -> list[dict]:
    scan = Scan(source, language)
    getattr(scan, language)()
    return scan.found
