"""Complexity of each function, by a walk over the tokens of source text in an Arrow function.

No parser of the language is at hand; the walk knows statements, brackets and
the forms of functions, which is what these measures need. Quoted texts,
comments and types are passed over. Text that breaks off early, or nests deeper
than Python's stack goes, gives the functions that were complete before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.workers import ship_code

_TOKEN = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`)|(?P<word>[A-Za-z_$][\w$]*|[0-9][\w.]*)|(?P<mark>=>|&&|\|\||\?\?|\?\.|\.\.\.|.)", re.S)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_LOGIC = {"&&", "||", "??"}
_LOOPS = {"for", "while"}
_BEGINS = {"if", "for", "while", "do", "switch", "try", "return", "const", "let", "var", "class", "function", "break", "continue", "throw", "import", "export", "interface", "enum", "abstract", "async"}
_NO_METHOD = {"if", "for", "while", "switch", "catch", "function", "return", "new", "typeof", "await"}


@dataclass
class Frame:
    """A function that is being walked: what it has so far, and how deep its control flow is here."""

    name: str | None
    parent: str | None
    params: int
    line: int
    cyclomatic: int = 1
    cognitive: int = 0
    depth: int = 0
    nesting: int = 0


@dataclass
class Walk:
    tokens: list[str]
    lines: list[int]
    found: list[tuple] = field(default_factory=list)
    frames: list[Frame] = field(default_factory=list)
    classes: list[str | None] = field(default_factory=list)

    @staticmethod
    def of(text: str) -> Walk:
        tokens, lines, line = [], [], 1
        for m in _TOKEN.finditer(text):
            if m.lastgroup != "skip":
                tokens.append("''" if m.lastgroup == "text" else m[0])
                lines.append(line)
            line += m[0].count("\n")
        return Walk(tokens, lines)

    def at(self, i: int) -> str:
        return self.tokens[i] if i < len(self.tokens) else ""

    def run(self) -> list[tuple]:
        i = 0
        try:
            while i < len(self.tokens):
                i = self.statement(i)
        except RecursionError:
            pass
        return self.found

    # What the measures count

    def decision(self) -> None:
        if self.frames:
            self.frames[-1].cyclomatic += 1

    def enter(self) -> None:
        """Control flow costs 1 and its depth in every function around it, and what it holds is deeper."""
        for f in self.frames:
            f.cognitive += 1 + f.depth
            f.depth += 1
            f.nesting = max(f.nesting, f.depth)

    def leave(self, times: int = 1) -> None:
        for f in self.frames:
            f.depth -= times

    def flat(self) -> None:
        for f in self.frames:
            f.cognitive += 1

    # Brackets and heads

    def closing(self, i: int) -> int:
        """Where the bracket that opens at i closes."""
        left = 0
        while i < len(self.tokens):
            if self.tokens[i] in _OPEN:
                left += 1
            elif self.tokens[i] in _CLOSE:
                left -= 1
                if not left:
                    return i
            i += 1
        return i

    def params(self, i: int) -> int:
        """How many parameters stand in the brackets that open at i."""
        end, n, k, fresh, angle = self.closing(i), 0, i + 1, True, 0
        while k < end:
            t = self.tokens[k]
            n, fresh = n + (fresh and t != ","), fresh and t == ","
            angle = max(0, angle + (t == "<") - (t == ">"))
            if t in _OPEN:
                k = self.closing(k)
            elif t == "," and not angle:
                fresh = True
            k += 1
        return n

    def body_after(self, i: int, arrow: bool) -> int | None:
        """Where the body begins behind the brackets that close at i, past a return type; None if no body follows."""
        k, angle = i + 1, 0
        if self.at(k) == ":":
            k += 1
            while k < len(self.tokens) and (angle or self.at(k) not in {",", "="}) and self.at(k) not in {";", ")", "}"}:
                t = self.at(k)
                if not angle and (t == "=>" or (t == "{" and not arrow and self.at(k - 1) not in {":", "|", "&"})):
                    break
                angle = max(0, angle + (t == "<") - (t == ">"))
                k = self.closing(k) + 1 if t in _OPEN else k + 1
        wanted = "=>" if arrow else "{"
        return k if self.at(k) == wanted else None

    def function(self, name: str | None, params: int, begin: int, body: int, stops: set[str]) -> int:
        """Walks a function whose body begins at a brace or behind an arrow."""
        if self.frames:
            self.enter()
        self.frames.append(Frame(name, self.classes[-1] if self.classes else None, params, self.lines[min(begin, len(self.lines) - 1)]))
        inside, self.classes = self.classes, []
        end = self.statement(body) if self.at(body) == "{" else self.expression(body, stops)
        self.classes = inside
        f = self.frames.pop()
        if self.frames:
            self.leave()
        last = self.lines[min(max(end - 1, 0), len(self.lines) - 1)]
        if name:
            self.found.append((name, f.parent, f.cyclomatic, f.cognitive, f.nesting, last - f.line + 1, f.params))
        return end

    # Statements

    def statement(self, i: int) -> int:
        """Walks the statement at i; a bracket that nothing opened is passed over."""
        return max(self.stated(i), i + 1)

    def stated(self, i: int) -> int:
        t = self.at(i)
        if t == "{":
            i += 1
            while i < len(self.tokens) and self.at(i) != "}":
                i = self.statement(i)
            return i + 1
        if t == "if":
            self.decision()
            self.enter()
            i = self.statement(self.brackets(i + 1))
            i = self.statement(i + 1) if self.at(i) == "else" else i
            self.leave()
            return i
        if t in _LOOPS:
            self.decision()
            self.enter()
            i = self.statement(self.brackets(i + 1 + (self.at(i + 1) == "await")))
            self.leave()
            return i
        if t == "do":
            self.decision()
            self.enter()
            i = self.statement(i + 1)
            i = self.brackets(i + 1) if self.at(i) == "while" else i
            self.leave()
            return i + (self.at(i) == ";")
        if t == "switch":
            self.enter()
            i = self.brackets(i + 1) + 1
            while i < len(self.tokens) and self.at(i) != "}":
                if self.at(i) == "case":
                    self.decision()
                    i = self.expression(i + 1, {":"}) + 1
                elif self.at(i) == "default" and self.at(i + 1) == ":":
                    i += 2
                else:
                    i = self.statement(i)
            self.leave()
            return i + 1
        if t == "catch":
            self.decision()
            self.enter()
            i = self.statement(self.closing(i + 1) + 1 if self.at(i + 1) == "(" else i + 1)
            self.leave()
            return i
        if t in {"try", "finally", "else"}:
            return self.statement(i + 1)
        if t in {"break", "continue"}:
            labelled = re.match(r"[A-Za-z_$]", self.at(i + 1)) and self.lines[i + 1] == self.lines[i]
            if labelled:
                self.flat()
            i += 1 + bool(labelled)
            return i + (self.at(i) == ";")
        if t in {"interface", "enum"} or (t == "type" and self.at(i + 2) in {"=", "<"}):
            while i < len(self.tokens) and self.at(i) not in {"{", ";"}:
                i += 1
            return self.closing(i) + 1 if self.at(i) == "{" and t != "type" else self.past(i)
        if t in {"export", "default", "declare", "abstract"}:
            return self.statement(i + 1)
        i = self.expression(i, {";"})
        return i + (self.at(i) == ";")

    def past(self, i: int) -> int:
        while i < len(self.tokens) and self.at(i) != ";":
            i = self.closing(i) + 1 if self.at(i) in _OPEN else i + 1
        return i + 1

    def brackets(self, i: int) -> int:
        """Walks what stands in the round brackets at i."""
        if self.at(i) != "(":
            return i
        return self.listed(i + 1, ")", {";", ","})

    def listed(self, i: int, end: str, stops: set[str]) -> int:
        """Walks expressions with stops between them up to a bracket."""
        while i < len(self.tokens) and self.at(i) != end:
            k = self.expression(i, stops)
            i = max(k + (self.at(k) in stops), i + 1)
        return i + 1

    # Expressions

    def expression(self, i: int, stops: set[str]) -> int:
        """Walks to one of stops, to a bracket that closes, or to a line on which a statement begins."""
        begin, name, ternaries, run, seen = i, None, 0, None, set()
        while i < len(self.tokens):
            t = self.at(i)
            if t in stops or t in _CLOSE or (i > begin and t in _BEGINS and self.lines[i] > self.lines[i - 1] and self.at(i - 1) not in {"=", "return", ",", "(", "=>", "async", "default", "?", ":"} | _LOGIC):
                break
            if t in _LOGIC:
                self.decision()
                # An and-run is a chain of its own wherever it stands; the other operators make one chain each.
                if (t == "&&" and run != "&&") or (t != "&&" and t not in seen):
                    self.flat()
                run = t
                seen.add(t)
            elif t == "?" and self.at(i + 1) not in {":", ")", ",", ";"}:
                self.decision()
                self.enter()
                ternaries += 1
            elif t == "=" and re.match(r"[A-Za-z_$]", self.at(i - 1)):
                name = self.at(i - 1)
            elif t == "function":
                k = i + 1 + (self.at(i + 1) == "*")
                own = self.at(k) if self.at(k) != "(" else name
                k += self.at(k) != "("
                while k < len(self.tokens) and self.at(k) != "(":
                    k += 1
                body = self.body_after(self.closing(k), False)
                i = self.function(own, self.params(k), i, body, stops) if body is not None else self.closing(k) + 1
                if i > begin and self.at(begin) in {"function", "async"}:
                    return i
                continue
            elif t == "class":
                i = self.members(i)
                continue
            elif re.match(r"[A-Za-z_$]", t) and self.at(i + 1) == "=>":
                i = self.function(name, 1, i, i + 2, stops | {","})
                continue
            elif t == "(":
                end = self.closing(i)
                arrow = self.body_after(end, True)
                if arrow is not None:
                    i = self.function(name, self.params(i), i, arrow + 1, stops | {","})
                else:
                    i = self.brackets(i)
                continue
            elif t == "[":
                i = self.listed(i + 1, "]", {","})
                continue
            elif t == "{":
                i = self.held(i + 1, {","}, None)
                continue
            i += 1
        self.leave(ternaries)
        return i

    def members(self, i: int) -> int:
        """Walks a class that begins at i."""
        name = self.at(i + 1) if re.match(r"[A-Za-z_$]", self.at(i + 1)) and self.at(i + 1) not in {"extends", "implements"} else None
        while i < len(self.tokens) and self.at(i) != "{":
            i += 1
        return self.held(i + 1, {";"}, name)

    def held(self, i: int, stops: set[str], name: str | None) -> int:
        """Walks the entries of an object, or of a class, up to its closing brace: methods, and values."""
        self.classes.append(name)
        while i < len(self.tokens) and self.at(i) != "}":
            k = i
            while self.at(k) in {"public", "private", "protected", "static", "async", "override", "readonly", "get", "set", "*"} and self.at(k + 1) not in {"(", ":", "=", ",", "}"}:
                k += 1
            head = self.at(k)
            g = k + 1
            if self.at(g) == "<":
                while g < len(self.tokens) and self.at(g) != "(":
                    g += 1
            body = self.body_after(self.closing(g), False) if self.at(g) == "(" and head not in _NO_METHOD else None
            if body is not None:
                i = self.function(head, self.params(g), i, body, stops)
            else:
                i = max(self.value(i, stops), i + 1)
            while self.at(i) in {",", ";"}:
                i += 1
        self.classes.pop()
        return i + 1

    def value(self, i: int, stops: set[str]) -> int:
        """Walks a property: its type is passed over in a class, its value walked."""
        if self.classes[-1] is None or self.at(i + 1) not in {":", "?", "!"}:
            return self.expression(i, stops) if self.at(i + 1) != ":" else self.expression(i + 2, stops)
        start = self.lines[i]
        while i < len(self.tokens) and self.at(i) not in {"=", ";", "}"}:
            if self.lines[i] > start and self.at(i - 1) not in {"|", "&", ":"} and re.match(r"[A-Za-z_$]", self.at(i)):
                return i
            i = self.closing(i) + 1 if self.at(i) in _OPEN else i + 1
        return self.expression(i + 1, stops) if self.at(i) == "=" else i


COLUMNS = "name string, parent string, cyclomatic int, cognitive int, nesting int, lines int, params int"


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["module_id", *(c.split()[0] for c in COLUMNS.split(", "))]
    for batch in batches:
        rows = [(module, *f) for module, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for f in Walk.of(text or "").run()]
        types = [batch.schema.field("id").type, pa.string(), pa.string(), *[pa.int32()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def functions(modules: DataFrame) -> DataFrame:
    """module_id, name, parent (a class, or null), cyclomatic, cognitive, nesting, lines and params of every named function.

    modules: id, text. Cyclomatic counts decisions in the function itself;
    cognitive counts nested functions' too, each control by how deep it stands.
    A null text has no functions.
    """
    ship_code(modules.sparkSession)
    kind = modules.schema["id"].dataType.simpleString()
    # A function has a body in braces or behind an arrow.
    bodied = F.contains("text", F.lit("{")) | F.contains("text", F.lit("=>"))
    return modules.select("id", "text").filter(bodied).mapInArrow(_measured, f"module_id {kind}, {COLUMNS}")
