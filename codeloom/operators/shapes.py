"""Where declarations, functions and calls begin and end in source text, from one pass with a stack of brackets.

An Arrow function blanks what is quoted or commented, pairs the brackets, and
reads heads and members off what is left. It tells stretches of text and what
stands in their heads; which declaration a member or a call belongs to follows
from containment, in Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeloom.workers import ship_code

SHAPE = (
    "kind string, name string, begin long, stop long, line int, last_line int, mods array<string>, extends string, others array<string>, "
    "params array<struct<name:string,type:string,is_optional:boolean,is_rest:boolean,has_default:boolean>>, n_params int, type string, body string, documented boolean"
)

_QUOTED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|[`{}]|/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/", re.S)
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{|\Z)", re.S)
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|void|delete))\s*\Z")
_HEAD = re.compile(r"(?<![\w$.])((?:(?:export|default|declare|abstract|async|const)\s+)*)(class|interface|enum|type|function)\b\s*\*?\s*([A-Za-z_$][\w$]*)?")
_MODS = re.compile(r"(?:(?:public|private|protected|static|readonly|abstract|override|declare|async|accessor|get|set)\s+)+(?=[\w$#*\[\"'])")
_NAME = re.compile(r"\*?\s*(#?[A-Za-z_$][\w$]*|\d[\w.]*|(['\"])_*['\"])")
_CALL = re.compile(r"(?<![\w$])(#?[A-Za-z_$][\w$]*+)\s*+(?:<[^<>()=;{}]*>)?\s*+(?:\?\.)?\(")
_CHAIN = re.compile(r"((?:[\w$#]+\s*[!?]?\.\s*)*)\Z")
_NAMED = re.compile(r"([A-Za-z_$#][\w$]*)\s*(?::[^=(){};]*)?[=:]\s*\Z")
_GOES_ON = re.compile(r"\s*(?:[|&?:.,+*/=)\]}%<>-]|(?:extends|in|instanceof|as|is)\b|\Z)")
_WORD = re.compile(r"([\w$]*)\s*\Z")
_UNNAMED = re.compile(r"=>|(?<![\w$.])function\b\s*\*?\s*\(")
_BRACKET = re.compile(r"[()\[\]{}]")
_SPACE = re.compile(r"\s*")
_PARAMETER = re.compile(r"\s*(?:@[\w$.]+(?:\([^()]*\))?\s*)*(?:(?:public|private|protected|readonly|override)\s+)*(\.\.\.)?\s*([A-Za-z_$][\w$]*)\s*(\?)?\s*(:)?")
_BODY = re.compile(r"\s*(?::[^;{}=()]*)?\{")
#: The words of heads, and all kinds of shapes.
_HEADS = ("class", "interface", "enum", "type", "function")
KINDS = frozenset((*_HEADS, "method", "property", "closure", "call"))
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Words that look like calls and are none.
NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "import", "typeof", "await", "super", "with", "void", "in", "of", "case", "do", "else", "new", "throw", "delete", "yield", "keyof", "instanceof", "constructor", "async"}


class Source:
    """One text: bare (as long, without what is quoted or commented) and its pairs of brackets."""

    def __init__(self, text: str) -> None:
        self.text, self.bare = text, self._blanked(text)
        self.pairs: dict[int, int] = {}
        self.openers: dict[int, int] = {}
        self.lines = [m.start() for m in re.finditer("\n", text)]
        stack: list[int] = []
        for m in _BRACKET.finditer(self.bare):
            if m[0] in _OPEN:
                stack.append(m.start())
            elif any(self.bare[k] == _CLOSE[m[0]] for k in stack[-8:]):
                while self.bare[stack[-1]] != _CLOSE[m[0]]:
                    stack.pop()
                self.openers[m.start()] = stack.pop()
                self.pairs[self.openers[m.start()]] = m.start()

    @staticmethod
    def _blanked(text: str) -> str:
        out, at, holes = [], 0, []  # holes: braces that are open in each hole of a template

        def blank(part: str, by: str) -> str:
            return re.sub(r"[^\n]", by, part)

        def template(k: int) -> int:
            m = _TEMPLATE.match(text, k)
            out.append(blank(text[k : m.start(1)], "_"))
            if m[1] == "${":
                holes.append(0)
                out.append(" {")
            else:
                out.append(m[1])
            return m.end()

        while m := _QUOTED.search(text, at):
            out.append(text[at : m.start()])
            part, at = m[0], m.end()
            if part == "`":
                out.append(part)
                at = template(at)
            elif part == "{" or part == "}":
                out.append(part)
                if holes:
                    holes[-1] += 1 if part == "{" else -1
                    if holes[-1] < 0:
                        holes.pop()
                        at = template(at)
            elif part[:2] in ("//", "/*"):
                out.append(blank(part, " "))
            elif part[0] == "/" and not _BEFORE_PATTERN.search("".join(out[-3:])[-40:]):
                out.append("/")
                at = m.start() + 1
            else:
                out.append(part[0] + blank(part[1:-1], "_") + part[-1] if len(part) > 1 else part)
        out.append(text[at:])
        return "".join(out)

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at - 1) + 1

    def end(self, opened: int) -> int:
        """Where the bracket closes; an open one at the end of the text."""
        return self.pairs.get(opened, len(self.bare))

    def space(self, k: int) -> int:
        return _SPACE.match(self.bare, k).end()

    def word(self, k: int, least: int) -> int:
        """Where the word before k begins, at least at least."""
        while k > least and (self.bare[k - 1].isalnum() or self.bare[k - 1] in "_$"):
            k -= 1
        return k

    def back(self, k: int) -> int:
        """Behind the last character before k that is no white space."""
        while k and self.bare[k - 1].isspace():
            k -= 1
        return k

    def angles(self, k: int) -> int:
        """Behind the type arguments that begin at k, if any do."""
        if self.bare[k : k + 1] != "<":
            return k
        depth, i = 0, k
        while i < len(self.bare):
            c = self.bare[i]
            if c in _OPEN:
                i = self.end(i)
            elif c == "<":
                depth += 1
            elif c == ">" and self.bare[i - 1] != "=":
                depth -= 1
                if not depth:
                    return i + 1
            elif c == ";" or c in _CLOSE:
                break
            i += 1
        return k

    def until(self, k: int, stops: str, limit: int, lines: bool = True, types: bool = True) -> int:
        """The first of stops from k on that no bracket encloses, or where a line ends and nothing goes on.

        types: a brace may begin a type, which is no stop.
        """
        start = k = self.space(k)
        while k < limit:
            c = self.bare[k]
            if c in stops and not (c == "=" and self.bare[k + 1 : k + 2] == ">") and not (c == "{" and types and self.opens_type(start, k)):
                return k
            if c in _OPEN:
                k = self.end(k)
            elif c == "<" and (after := self.angles(k)) > k:
                k = after - 1
            elif lines and c == "\n" and k > start and not self.goes_on(k):
                return k
            k += 1
        return limit

    def goes_on(self, k: int) -> bool:
        """Whether what stands before the end of a line at k goes on behind it."""
        last = self.back(k)
        return self.bare[last - 1] in "=|&?:,.+-*/<([{" or self.bare[last - 2 : last] == "=>" or bool(_GOES_ON.match(self.bare, k))

    def opens_type(self, start: int, k: int) -> bool:
        """Whether the brace at k begins a type, not a body."""
        last = self.back(k)
        return last <= start or self.bare[last - 1] in "|&:<,(" or self.bare[last - 2 : last] == "=>"

    def parameters(self, opened: int) -> tuple[list[dict], int]:
        """Plain parameters of the brackets at opened, and how many there are of all forms."""
        found, n, k, stop = [], 0, opened + 1, self.end(opened)
        while self.space(k) < stop:
            end = self.until(k, ",", stop, lines=False)
            n += 1
            m = _PARAMETER.match(self.bare[k:end])
            if m:
                value = self.until(k + m.end(), "=", end, lines=False)
                typed = self.text[k + m.end() : value].strip() if m[4] else None
                found.append({"name": m[2], "type": _flat(typed), "is_optional": bool(m[3]), "is_rest": bool(m[1]), "has_default": value < end})
            k = end + 1
        return found, n

    def documented(self, begin: int) -> bool:
        last = begin
        while last and self.text[last - 1].isspace():
            last -= 1
        return self.text[last - 2 : last] == "*/" and self.text.startswith("/**", self.text.rfind("/*", 0, last - 2))

    def shape(self, kind: str, name: str | None, begin: int, stop: int, mods: Iterable[str] = (), **more: object) -> dict:
        own = {"kind": kind, "name": name, "begin": begin, "stop": stop, "line": self.line(begin), "last_line": self.line(max(stop - 1, begin)), "mods": sorted(mods), "extends": None, "others": [], "params": [], "n_params": None, "type": None, "body": None}
        return own | {"documented": self.documented(begin)} | more

    def shapes(self, kinds: frozenset[str] = KINDS) -> Iterator[dict]:
        """All declarations, members, functions and calls of these kinds."""
        return (s for s in self._found(kinds) if s["kind"] in kinds)

    def _found(self, kinds: frozenset[str]) -> Iterator[dict]:
        """What is of these kinds, and more where that has to be known to tell them."""
        names: set[int] = set()  # where functions and methods are named, which are no calls
        bodies: set[int] = set()
        inner = not kinds.isdisjoint(("call", "closure"))
        heads = kinds | {"class", "interface", "function"} if inner else kinds
        heads = heads | {"class", "interface"} if not heads.isdisjoint(("method", "property")) else heads
        if any(word in self.bare for word in _HEADS):
            for m in _HEAD.finditer(self.bare):
                if m[2] in heads:
                    yield from self.declared(m, names, bodies)
        if "closure" in kinds:
            for m in _UNNAMED.finditer(self.bare):
                yield from self.unnamed(m, bodies)
        for m in _CALL.finditer(self.bare) if inner else ():
            last = self.back(m.start())
            member = self.bare[last - 1 : last] == "."
            chain = _CHAIN.search(self.bare, max(0, m.start() - 200), m.start()) if member else None
            first, chained = (chain.start(), chain[1]) if chain else (m.start(), "")
            before = self.bare[self.back(first) - 1 : self.back(first)]
            word = _WORD.search(self.bare, self.word(self.back(first), max(0, first - 40)), first)[1]
            stop = self.end(m.end() - 1) + 1
            if m.start(1) in names or word in ("new", "function") or (m[1] in NO_CALLS and not member):
                continue
            if not member and (before in "{,;}" or word in ("async", "get", "set")) and _BODY.match(self.bare, stop):
                # A method of an object.
                body = self.bare.index("{", stop)
                yield self.shape("closure", m[1], m.start(), min(self.end(body) + 1, len(self.bare)), [word] if word == "async" else [])
                continue
            qualifier = re.sub(r"[\s?!]", "", chained).rstrip(".") or ("()" if member else None)
            yield self.shape("call", m[1].lstrip("#"), m.start(), min(stop, len(self.bare)), ["await"] if word == "await" else [], type=qualifier)

    def declared(self, m: re.Match, names: set[int], bodies: set[int]) -> Iterator[dict]:
        mods, kind, name, k = m[1].split(), m[2], m[3], m.end()
        begin = m.start()
        if kind == "function":
            k = self.angles(self.space(k))
            if not name or self.bare[k : k + 1] != "(":
                return
            names.add(m.start(3))
            yield self.callable("function", name, begin, k, mods, bodies, len(self.bare))
        elif name and kind == "type":
            k = self.space(k)
            after = self.space(self.angles(k))
            if self.bare[after : after + 1] == "=":
                stop = self.until(after + 1, ";", len(self.bare))
                yield self.shape("type", name, begin, stop, mods, body=_flat(self.text[after + 1 : stop]), others=_names(self.text[k + 1 : self.angles(k) - 1]) if self.angles(k) > k else [])
        elif name and kind == "enum" and self.bare[self.space(k) : self.space(k) + 1] == "{":
            opened = self.space(k)
            yield self.shape("enum", name, begin, self.end(opened) + 1, mods, body=self.text[opened + 1 : self.end(opened)], others=self.parts(opened))
        elif name and kind in ("class", "interface"):
            opened = self.until(self.angles(self.space(k)), "{;=", len(self.bare), lines=False, types=False)
            if self.bare[opened : opened + 1] != "{":
                return
            head = self.bare[self.angles(self.space(k)) : opened]
            extends, implements = (_names(x[1]) if (x := re.search(p, head, re.S)) else [] for p in (r"\bextends\b(.*?)(?:\bimplements\b|\Z)", r"\bimplements\b(.*)"))
            own = {"extends": extends[0] if extends else None, "others": implements} if kind == "class" else {"others": extends}
            yield self.shape(kind, name, begin, self.end(opened) + 1, mods, **own)
            yield from self.members(opened, kind, names, bodies)

    def parts(self, opened: int) -> list[str]:
        """What commas part in brackets."""
        out, k, stop = [], opened + 1, self.end(opened)
        while self.space(k) < stop:
            end = self.until(k, ",", stop, lines=False)
            out.append(" ".join(self.text[k:end].split()))
            k = end + 1
        return out

    def callable(self, kind: str, name: str | None, begin: int, opened: int, mods: Iterable[str], bodies: set[int], limit: int) -> dict:
        """A function whose parameters begin at opened: its result type, and its body if one follows."""
        params, n = self.parameters(opened)
        stop = self.end(opened) + 1
        k, typed = self.space(stop), None
        if self.bare[k : k + 1] == ":":
            stop = self.until(k + 1, "{;,", limit)
            typed, k = _flat(self.text[k + 1 : stop]), self.space(stop)
        if self.bare[k : k + 1] == "{":
            bodies.add(k)
            stop = self.end(k) + 1
        return self.shape(kind, name, begin, min(stop, len(self.bare)), mods, params=params, n_params=n, type=typed)

    def members(self, opened: int, kind: str, names: set[int], bodies: set[int]) -> Iterator[dict]:
        """What stands in a class's or an interface's body itself, not in its members'."""
        k, stop = opened + 1, self.end(opened)
        while (k := self.space(k)) < stop:
            begin = k
            while self.bare[k : k + 1] == "@":
                k = self.space(re.compile(r"@[\w$.]*").match(self.bare, k).end())
                k = self.space(self.end(k) + 1) if self.bare[k : k + 1] == "(" else k
            mods = _MODS.match(self.bare, k)
            k = mods.end() if mods else k
            said = mods[0].split() if mods else []
            named = _NAME.match(self.bare, k)
            if not named:
                # A static block, an index or computed name, a mark: passed over to its end.
                computed = self.bare[k : k + 1] == "["
                k = (self.end(k) + 1) if self.bare[k : k + 1] in _OPEN else k + 1
                if computed:
                    end = self.until(k, ";{", stop)
                    k = self.end(end) + 1 if self.bare[end : end + 1] == "{" else end + 1
                continue
            name = self.text[named.start(1) : named.end(1)].strip("'\"").lstrip("#")
            k = self.space(named.end())
            k = self.space(k + 1) if self.bare[k : k + 1] in ("?", "!") else k
            k = self.space(self.angles(k))
            if self.bare[k : k + 1] == "(":
                names.add(named.start(1))
                made = self.callable("method", name, begin, k, said, bodies, stop)
                yield made
                k = max(made["stop"], self.end(k) + 1)
                continue
            typed, function, end = None, False, named.end()
            value = k
            if self.bare[k : k + 1] == ":":
                value = end = self.until(k + 1, "=;,", stop)
                typed = _flat(self.text[k + 1 : value])
                function = bool(re.match(r"(?:new\s*)?[(<].*=>", typed or "", re.S))
            if self.bare[value : value + 1] == "=":
                end = self.until(value + 1, ";", stop)
                function = function or self.arrow(self.space(value + 1))
            if function:
                at = self.bare.find("(", k, end)
                params, n = self.parameters(at) if at >= 0 else ([], 0)
                yield self.shape("method", name, begin, end, [*said, "value"], params=params, n_params=n, type=_flat(typed.rpartition("=>")[2]) if typed else None)
            else:
                yield self.shape("property", name, begin, end, said, type=typed)
            k = end + (self.bare[end : end + 1] in (";", ","))

    def arrow(self, k: int) -> bool:
        k = re.compile(r"(?:async\s+)?").match(self.bare, k).end()
        k = self.space(self.angles(k))
        if self.bare[k : k + 1] == "(":
            return bool(re.compile(r"\s*(?::[^={};]*)?=>").match(self.bare, self.end(k) + 1))
        return bool(re.compile(r"[\w$]+\s*=>").match(self.bare, k))

    def unnamed(self, m: re.Match, bodies: set[int]) -> Iterator[dict]:
        """Arrow functions and function expressions, under the name that they are given to, if any."""
        if m[0] == "=>":
            k = self.space(m.end())
            begin = self.back(m.start())
            typed = re.search(r"\)(\s*:\s*[^(){};=]*)?\Z", self.bare[max(0, begin - 200) : begin])
            if typed:
                begin = self.openers.get(begin - len(typed[0]), begin)
            else:
                begin -= len(re.search(r"[\w$]*\Z", self.bare[max(0, begin - 80) : begin])[0])
            stop = self.end(k) + 1 if self.bare[k : k + 1] == "{" else self.until(k, ",;)]}", len(self.bare), types=False)
        else:
            opened = m.end() - 1
            k = self.until(self.end(opened) + 1, "{;", len(self.bare))
            begin, stop = m.start(), self.end(k) + 1 if self.bare[k : k + 1] == "{" else k
        if self.bare[k : k + 1] == "{" and k in bodies:
            return
        before = re.sub(r"async\s*\Z", "", self.bare[max(0, begin - 120) : begin])
        named = _NAMED.search(before)
        yield self.shape("closure", named[1].lstrip("#") if named else None, begin, min(stop, len(self.bare)), ["async"] if before != self.bare[max(0, begin - 120) : begin] else [])


def _flat(text: str | None) -> str | None:
    return " ".join(text.split()) or None if text is not None else None


def _names(listed: str) -> list[str]:
    """The names of a list with commas, without type arguments."""
    depth, bare = 0, []
    for k, c in enumerate(listed):
        depth += (c == "<") - (c == ">" and listed[k - 1 : k] != "=")
        if not depth and c != ">":
            bare.append(c)
    return [m[0] for part in "".join(bare).split(",") if (m := re.match(r"[\w$.]+", part.strip()))]


#: Rows of a batch that a scan hands on.
_BATCH = 2000


def _scan(batches: Iterable[pa.RecordBatch], schema: pa.Schema, kinds: frozenset[str]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)
        rows.clear()
        return made

    for given in batches:
        for module, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
            for found in Source(text or "").shapes(kinds):
                found["module_id"] = module
                rows.append(found)
                if len(rows) == _BATCH:
                    yield batch()
    if rows:
        yield batch()


def may_hold(text: Column, *kinds: str) -> Column:
    """Whether a text has the marks and words without which nothing of these kinds stands in it."""
    has = lambda *words: reduce(lambda a, b: a & b, (F.contains(text, F.lit(w)) for w in words))
    member = has("{") & (has("class") | has("interface"))
    needs = {
        "class": has("class", "{"), "interface": has("interface", "{"), "enum": has("enum", "{"), "type": has("type", "="), "function": has("function", "("), "method": member, "property": member,
        "call": has("("), "closure": has("=>") | has("(", "{") | has("function", "("),
    }
    return reduce(lambda a, b: a | b, (needs[k] for k in sorted(kinds)))


def shapes(modules: DataFrame, *kinds: str) -> DataFrame:
    """module_id and SHAPE of what stands in the texts of modules (id, text); a null text holds nothing.

    kind is class, interface, enum, type, function, method, property, closure
    (a function without a declaration) or call; if kinds are given, no others
    come, nor is the scan made for them. begin and stop are code points.
    mods are the words before a name; a method that is a property with a
    function as its value or type has "value" among them.
    """
    ship_code(modules.sparkSession)
    wanted = frozenset(kinds) or KINDS
    kind = modules.schema["id"].dataType.simpleString()
    schema = StructType.fromDDL(f"module_id {kind}, {SHAPE}")
    return modules.select("id", "text").filter(may_hold(F.col("text"), *wanted)).mapInArrow(partial(_scan, schema=to_arrow_schema(schema), kinds=wanted), schema)


def within(found: DataFrame, asked: Column, held: list[str], around: Column, columns: list[str] | dict[str, Column], prefix: str = "in_") -> DataFrame:
    """innermost over one frame (module_id, begin, stop and more), which is read once: the rows that are asked, with held, in those that are around."""
    columns = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    inner = F.struct(*(c.alias(f"{prefix}{n}") for n, c in columns.items()))
    row = F.struct("module_id", *held)
    types = found.select(inner.alias("i"), row.alias("r")).schema
    none, no_row = F.lit(None).cast(types["i"].dataType), F.lit(None).cast(types["r"].dataType)
    step = lambda at, turn, size, n, i, r: F.struct(F.col(at).cast("long").alias("at"), F.lit(turn).alias("turn"), size.cast("long").alias("size"), F.lit(n).alias("step"), i.alias("inner"), r.alias("held"))
    steps = F.array(F.when(around, step("begin", 1, -F.col("stop"), 1, inner, no_row)), F.when(around, step("stop", 0, F.lit(0), -1, none, no_row)), F.when(asked, step("begin", 2, F.lit(0), 0, none, row)))
    return _swept(found.select("module_id", F.explode(F.array_compact(steps)).alias("s")).select("module_id", "s.*"), list(columns), prefix)


def innermost(asked: DataFrame, around: DataFrame, columns: list[str], prefix: str = "in_") -> DataFrame:
    """asked (module_id, begin) with the columns, under prefix, of the innermost stretch of around (module_id, begin, stop) that holds it; null if none does.

    Stretches lie in each other or apart. A sweep over each module's places
    counts how many are open; the last one that opened at a depth is the one
    that is open there. No stretch is compared with every place.
    """
    inner = F.struct(*(F.col(c).alias(f"{prefix}{c}") for c in columns))
    held = F.struct(*asked.columns)
    none, no_row = F.lit(None).cast(around.select(inner.alias("s")).schema["s"].dataType), F.lit(None).cast(asked.select(held.alias("s")).schema["s"].dataType)
    # At one place a stretch that ends goes first, then those that begin, the longest first, then what is asked.
    opens = around.select("module_id", F.col("begin").alias("at"), F.lit(1).alias("turn"), (-F.col("stop")).alias("size"), F.lit(1).alias("step"), inner.alias("inner"), no_row.alias("held"))
    shuts = around.select("module_id", F.col("stop").alias("at"), F.lit(0), F.lit(0).cast("long"), F.lit(-1), none, no_row)
    places = asked.select("module_id", F.col("begin").alias("at"), F.lit(2), F.lit(0).cast("long"), F.lit(0), none, held)
    return _swept(opens.union(shuts).union(places), columns, prefix)


def _swept(steps: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """module_id, at, turn, size, step, inner and held of what opens (step 1), ends (-1) or is asked (0), swept in that order."""
    order = ["at", "turn", "size"]
    depth = F.sum("step").over(Window.partitionBy("module_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    swept = steps.withColumn("depth", depth).filter("step >= 0")
    last = F.last("inner", ignorenulls=True).over(Window.partitionBy("module_id", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = swept.withColumn("found", F.when(F.col("depth") > 0, last)).filter("step = 0")
    return found.select("held.*", *(F.col(f"found.{prefix}{c}").alias(f"{prefix}{c}") for c in columns))
