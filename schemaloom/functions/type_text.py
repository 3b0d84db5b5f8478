"""Type texts such as ``STRUCT<a: INT, `b c`: ARRAY<STRUCT<d:date>>>``.

Nested types have no bounded depth, so the scan keeps its own stack of open types
instead of recursing.  It runs in Python, once per distinct text of a worker.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


_RECORDS = ("struct", "object", "row", "record")


class _Open:
    """A nested type whose end is not reached yet."""

    def __init__(self, record: bool, word: str):
        self.record, self.word, self.members, self.name, self.start = record, word, [], "", -1

    def take(self, member: Any, keep_nameless: bool) -> None:
        if not self.record:
            self.members.append(member)
        elif self.name or keep_nameless:
            self.members.append((self.name, member))


class _Scanner:
    def __init__(self, text: str, exact: bool = False):
        self.s, self.i, self.exact = text, 0, exact

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def blanks(self) -> None:
        while self.peek().isspace():
            self.i += 1

    def name(self) -> str:
        """A member's name; back quotes protect any character and are dropped."""
        self.blanks()
        out = []
        if self.peek() == "`":
            self.i += 1
            while self.i < len(self.s):
                if self.s[self.i] == "`":
                    if self.s[self.i + 1 : self.i + 2] != "`":
                        break
                    self.i += 1
                    if self.exact:
                        out.append("`")
                else:
                    out.append(self.s[self.i])
                self.i += 1
            self.i += 1
        else:
            while self.peek() and self.peek() not in ":,<>()" and not self.peek().isspace():
                out.append(self.s[self.i])
                self.i += 1
        return "".join(out)

    def rest(self) -> None:
        """Skip parameters, comments and constraints up to the ``,`` or ``>`` that ends a type."""
        while (c := self.peek()) and c not in ",>":
            self.i += 1
            if c == "(":
                while self.peek() and self.peek() != ")":
                    self.i += 1
            elif c in "'\"":
                while self.peek() and self.peek() != c:
                    self.i += 2 if self.peek() == "\\" else 1
                self.i += 1

    def word(self) -> str:
        """A type's name; leaves the scanner at what follows it."""
        self.blanks()
        start = self.i
        while self.peek() and self.peek() not in "<>(),:" and not self.peek().isspace():
            self.i += 1
        word = self.s[start : self.i]
        self.blanks()
        return word

    def type(self) -> Any:
        """``("struct", [(name, type)…])``, ``("nest", [type…])`` or the plain type's name."""
        open_types: list[_Open] = []
        while True:
            value: Any = self.word()
            opens = self.peek() == "<"
            if opens:
                self.i += 1
                open_types.append(_Open(value.lower() in _RECORDS, value.lower()))
            else:
                self.rest()
            while open_types:
                top = open_types[-1]
                if not opens:
                    top.take(value, self.exact)
                    if self.peek() == "," or self.i == top.start:
                        self.i += 1
                opens = False
                self.blanks()
                if self.peek() and self.peek() != ">":
                    top.start = self.i
                    if top.record:
                        top.name = self.name()
                        self.blanks()
                        if self.peek() == ":":
                            self.i += 1
                    break
                self.i += 1
                self.rest()
                open_types.pop()
                value = ("struct" if top.record else top.word, top.members)
            else:
                return value


def parse_type(text: str, *, exact: bool = False) -> Any:
    """The tree of a type text; unbalanced texts give the part that can be read.

    Back quotes in names are dropped and nameless members left out, unless ``exact``
    asks for all names as they are.
    """
    return _Scanner(text, exact).type()


def _paths(t: Any) -> list[str]:
    out: list[str] = []
    todo: list[tuple[str, Any, bool]] = [("", t, False)]
    while todo:
        path, t, named = todo.pop()
        if named:
            out.append(path)
        if isinstance(t, tuple):
            kind, members = t
            todo += [(f"{path}.{m[0]}" if path else m[0], m[1], True) if kind == "struct" else (path, m, False) for m in reversed(members)]
    return out


@lru_cache(maxsize=4096)
def member_paths(text: str) -> tuple[str, ...]:
    """Dotted paths of all struct members at any level; arrays and maps add no step."""
    if "<" not in text:
        return ()
    return tuple(_paths(parse_type(text)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def member_paths_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else list(member_paths(t)))
