"""Structure of Java sources: what each line declares or does, where methods start, what they return and assign.

A tokenizer and one walk over the tokens, a file at a time, in Arrow batches. A file whose brackets don't match, or
that has no type, is not understood; its lines are then labelled by the regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Labels of the structural index and words of the language.
ANNOTATION, CONSTANT, VARIABLE, CONDITION, RETURN, CALL = "アノテーション", "定数定義", "変数代入", "条件判定", "return文", "メソッド引数"
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
NOT_TYPES = frozenset("return throw new else do if while for switch case try catch finally break continue assert package import instanceof this super yield goto null true false".split())
PRIMITIVES = frozenset("boolean byte char short int long float double void var".split())
_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[^\W\d][\w$]*|\d[\w.]*|->|::|[!=<>]=|&&|\|\||\+\+|--|\s+|.', re.S)

SCHEMA = "array<struct<lineno:int,usage:string,scope:string>>", "array<int>", "array<struct<method:string,member:string>>"

_MEMBERS = pa.list_(pa.struct([("method", pa.string()), ("member", pa.string())]))
_TYPES = {"understood": pa.bool_(), "index": pa.list_(pa.struct([("lineno", pa.int32()), ("usage", pa.string()), ("scope", pa.string())])), "starts": pa.list_(pa.int32()), "returns": _MEMBERS, "assigns": _MEMBERS}
#: Files that a Python worker holds as objects at once.
FILES = 64


def tokenize(source: str) -> list[tuple[str, int]]:
    out, line = [], 1
    for m in _TOKEN.finditer(source):
        t = m[0]
        if not t.isspace() and not t.startswith(("//", "/*")):
            out.append((t, line))
        line += t.count("\n")
    return out


def _is_word(t: str) -> bool:
    return t[0].isalpha() or t[0] == "_"


class Structure:
    """usage and scope by line (the first of each counts), method starts, (method, returned member), (method, assigned member)."""

    def __init__(self, source: str):
        self.usage: dict[int, str] = {}
        self.scope: dict[int, str] = {}
        self.starts: list[int] = []
        self.returns: set[tuple[str, str]] = set()
        self.assigns: set[tuple[str, str]] = set()
        self.t = tokenize(source)
        self.ok = self._balanced() and any(t in ("class", "interface", "enum", "record") for t, _ in self.t)
        if self.ok:
            self._body(0, len(self.t), "file", None)
            self.starts.sort()

    def _balanced(self) -> bool:
        stack, self.partner = [], {}
        for i, (t, _) in enumerate(self.t):
            if t in "([{" and len(t) == 1:
                stack.append((t, i))
            elif t in ")]}" and len(t) == 1:
                if not stack or stack[-1][0] + t not in ("()", "[]", "{}"):
                    return False
                j = stack.pop()[1]
                self.partner[j] = i
        return not stack

    def _say(self, line: int, usage: str | None, scope: str | None = None) -> None:
        if usage:
            self.usage.setdefault(line, usage)
        if scope:
            self.scope.setdefault(line, scope)

    def _type_end(self, i: int, end: int) -> int | None:
        """The token after a type that starts at i, or None."""
        t = self.t
        if i >= end or not _is_word(t[i][0]) or t[i][0] in NOT_TYPES or t[i][0] in MODIFIERS:
            return None
        i += 1
        while i < end:
            if t[i][0] == "." and i + 1 < end and _is_word(t[i + 1][0]):
                i += 2
            elif t[i][0] == "<":
                depth = 0
                while i < end:
                    x = t[i][0]
                    depth += x.count("<") - x.count(">") if x in ("<", ">") else 0
                    if x in ("(", ")", ";", "{", "}", "=") or x in ("&&", "||"):
                        return None
                    i += 1
                    if depth == 0:
                        break
            elif t[i][0] == "[" and i + 1 < end and t[i + 1][0] == "]":
                i += 2
            else:
                break
        return i

    def _body(self, i: int, end: int, kind: str, method: str | None) -> None:
        """kind: what the braces around are: file, class or code."""
        t = self.t
        while i < end:
            word, line = t[i]
            start = i
            modifiers = set()
            while i < end and (t[i][0] in MODIFIERS or t[i][0] == "@" and i + 1 < end and t[i + 1][0] != "interface"):
                if t[i][0] == "@":
                    self._say(t[i][1], ANNOTATION)
                    i += 2
                    while i + 1 < end and t[i][0] == ".":
                        i += 2
                    if i < end and t[i][0] == "(":
                        self._expression(i + 1, self.partner[i], method)
                        i = self.partner[i] + 1
                else:
                    modifiers.add(t[i][0])
                    i += 1
            if i >= end:
                return
            word = t[i][0]
            if word in ("class", "interface", "enum") or word == "@" or word == "record" and i + 2 < end and t[i + 2][0] in ("(", "<"):
                while i < end and t[i][0] != "{":
                    i = self.partner[i] + 1 if t[i][0] == "(" else i + 1
                if i < end:
                    self._body(i + 1, self.partner[i], "class", None)
                    i = self.partner[i] + 1
                continue
            if word == "{":
                self._body(i + 1, self.partner[i], "code", method)
                i = self.partner[i] + 1
                continue
            if kind in ("class", "file") and word not in ("package", "import", ";", "}"):
                i = self._member(start, i, end, modifiers, kind)
                continue
            if kind == "code":
                i = self._statement(start, i, end, modifiers, method)
                continue
            while i < end and t[i][0] != ";":
                i += 1
            i += 1

    def _member(self, start: int, i: int, end: int, modifiers: set[str], kind: str) -> int:
        t = self.t
        if t[i][0] == "<":
            depth = 0
            while i < end:
                depth += {"<": 1, ">": -1}.get(t[i][0], 0)
                i += 1
                if depth == 0:
                    break
        after = self._type_end(i, end)
        name = None
        if after is not None and after < end and _is_word(t[after][0]):
            name = after
        elif after is not None and after < end and t[after][0] == "(":
            name = i  # a constructor
        if name is None:
            if t[i][0] in ("{",):
                return i
            return i + 1
        if name + 1 < end and t[name + 1][0] == "(":
            constructor = name == i
            j = self.partner[name + 1] + 1
            while j < end and t[j][0] not in ("{", ";"):
                j += 1
            if not constructor and kind == "class":
                self.starts.append(t[start][1])
            if j < end and t[j][0] == "{":
                self._body(j + 1, self.partner[j], "code", None if constructor else t[name][0])
                return self.partner[j] + 1
            return j + 1
        self._say(t[start][1], CONSTANT if {"static", "final"} <= modifiers else VARIABLE, "class")
        j = name + 1
        while j < end and t[j][0] != ";":
            j = self.partner[j] + 1 if t[j][0] in ("(", "[", "{") and j in self.partner else j + 1
        self._expression(name + 1, min(j, end), None)
        return j + 1

    def _statement(self, start: int, i: int, end: int, modifiers: set[str], method: str | None) -> int:
        t = self.t
        word, line = t[i]
        if word in ("if", "while"):
            self._say(line, CONDITION)
            if i + 1 < end and t[i + 1][0] == "(":
                self._expression(i + 2, self.partner[i + 1], method)
                return self.partner[i + 1] + 1
            return i + 1
        if word in ("for", "switch", "catch", "synchronized", "try") and i + 1 < end and t[i + 1][0] == "(":
            j = self.partner[i + 1]
            self._body(i + 2, j, "code", method) if word in ("for", "try") else self._expression(i + 2, j, method)
            return j + 1
        if word in ("else", "do", "try", "finally", ";", "}"):
            return i + 1
        if word in ("case", "default"):
            while i < end and t[i][0] not in (":", "->"):
                i += 1
            return i + 1
        j = i
        while j < end and t[j][0] != ";":
            j = self.partner[j] + 1 if t[j][0] in ("(", "[", "{") and j in self.partner else j + 1
        j = min(j, end)
        if word == "return":
            self._say(line, RETURN)
            body = [x for x, _ in t[i + 1 : j]]
            member = body[2] if body[:2] == ["this", "."] and len(body) == 3 else body[-1] if body and all(_is_word(x) or x == "." for x in body) else None
            if method and member and _is_word(member) and member not in NOT_TYPES:
                self.returns.add((method, member))
            self._expression(i + 1, j, method)
            return j + 1
        after = self._type_end(i, j)
        if after is not None and after < j and _is_word(t[after][0]) and t[after][0] not in NOT_TYPES | {"instanceof"} and (after + 1 >= j or t[after + 1][0] in ("=", ",", ":", "[")):
            self._say(t[start][1], VARIABLE, "method")
            self._expression(after + 1, j, method)
            return j + 1
        for k in range(i, j):
            if t[k][0] == "=" and k > i:
                if method and _is_word(t[k - 1][0]):
                    self.assigns.add((method, t[k - 1][0]))
                break
            if t[k][0] in ("(", "{"):
                break
        self._expression(i, j, method)
        return j + 1

    def _expression(self, i: int, end: int, method: str | None) -> None:
        t = self.t
        while i < end:
            x, line = t[i]
            if x == "new" and i + 1 < end:
                self._say(line, CALL)
            elif x == "@" and i + 1 < end and _is_word(t[i + 1][0]):
                self._say(line, ANNOTATION)
            elif _is_word(x) and i + 1 < end and t[i + 1][0] == "(" and x not in NOT_TYPES | {"if", "while", "for", "switch", "catch"}:
                self._say(line, CALL)
            elif x == "{" and i in self.partner:
                before = t[i - 1][0] if i else ""
                if before == "->":
                    self._body(i + 1, self.partner[i], "code", method)
                    i = self.partner[i] + 1
                    continue
                if before == ")":
                    self._body(i + 1, self.partner[i], "class", None)
                    i = self.partner[i] + 1
                    continue
            i += 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most FILES rows at once: Spark's batches have 10,000, whose objects and results a worker would hold together and keep as its size."""
    pair = lambda x: [{"method": a, "member": b} for a, b in sorted(x)]
    for batch in batches:
        for at in range(0, batch.num_rows, FILES):
            part, out = batch.slice(at, FILES), {n: [] for n in _TYPES}
            for text in part.column("text"):
                try:
                    s = Structure(text.as_py() or "")
                except (IndexError, KeyError, RecursionError):
                    s = Structure("")
                index = [{"lineno": n, "usage": s.usage.get(n), "scope": s.scope.get(n)} for n in sorted(s.usage.keys() | s.scope.keys())] if s.ok else []
                for held, value in zip(out.values(), (s.ok, index, s.starts, pair(s.returns), pair(s.assigns))):
                    held.append(value)
            yield pa.RecordBatch.from_pydict({"filepath": part.column("filepath")} | {n: pa.array(out[n], t) for n, t in _TYPES.items()})


def structures(files: DataFrame) -> DataFrame:
    """filepath, understood, index, starts, returns, assigns for files (filepath, text)."""
    return files.select("filepath", "text").mapInArrow(_read, f"filepath string, understood boolean, index {SCHEMA[0]}, starts {SCHEMA[1]}, returns {SCHEMA[2]}, assigns {SCHEMA[2]}")
