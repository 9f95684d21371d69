"""Two further readers of s-expressions.

``Tokens`` reads a surface language: words become values by registered patterns, strings have escapes, and the result is
a syntax tree or a term. ``typed`` reads terms with numbers and strings as Python values, and ``typed_text`` writes them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions.scalar import debug
from ..terms import Term, TermError, Var, sym

_TOKEN = re.compile(r"""\s+|;[^\n]*|(?P<open>\()|(?P<close>\))|(?P<text>"(?:[^"\\]|\\.)*")|(?P<word>[^\s()";]+)""", re.DOTALL)
_ESCAPE = re.compile(r"""\\(?:x(?P<x>[0-9a-fA-F]{2})|u\{(?P<u>[0-9a-fA-F]{1,6})\}|(?P<c>.))""", re.DOTALL)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def unescaped(text: str) -> str:
    """The inside of a string: \\n, \\t, \\r, \\0, \\xHH and \\u{H…}; any other character stands for itself."""

    def one(m: re.Match) -> str:
        return chr(int(m["x"] or m["u"], 16)) if m["x"] or m["u"] else _PLAIN.get(m["c"], m["c"])

    return _ESCAPE.sub(one, text)


@dataclass
class Node:
    """A part of the syntax tree: its kind (list, word, variable, text), place in the source and content."""

    kind: str
    start: int
    end: int
    content: Any


@dataclass
class Tokens:
    """Patterns for words, tried last registered first; each makes a value of the word."""

    patterns: list[tuple[re.Pattern, Callable[[str], Any]]] = field(default_factory=list)

    def register(self, pattern: str, make: Callable[[str], Any]) -> None:
        self.patterns.append((re.compile(pattern), make))

    def tree(self, text: str) -> list[Node]:
        """Top-level nodes of a text."""
        stack: list[Node] = [Node("list", 0, len(text), [])]
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise TermError(f"a string does not end, at {at}")
            if m["open"]:
                stack.append(Node("list", at, at, []))
            elif m["close"]:
                if len(stack) == 1:
                    raise TermError(f"unexpected ) at {at}")
                done = stack.pop()
                done.end = m.end()
                stack[-1].content.append(done)
            elif m["text"]:
                stack[-1].content.append(Node("text", at, m.end(), unescaped(m["text"][1:-1])))
            elif m["word"]:
                kind = "variable" if m["word"][0] == "$" and len(m["word"]) > 1 else "word"
                stack[-1].content.append(Node(kind, at, m.end(), m["word"]))
            at = m.end()
        if len(stack) > 1:
            raise TermError(f"a ( isn't closed, at {stack[-1].start}")
        return stack[0].content

    def value(self, node: Node) -> Any:
        """Lists as tuples, variables as Var, words by the patterns or as they are."""
        if node.kind == "list":
            return tuple(self.value(x) for x in node.content)
        if node.kind == "variable":
            return Var(node.content[1:])
        if node.kind == "text":
            return node.content
        for pattern, make in reversed(self.patterns):
            if pattern.fullmatch(node.content):
                return make(node.content)
        return sym(node.content)

    def values(self, text: str) -> list[Any]:
        return [self.value(n) for n in self.tree(text)]


def typed(text: str) -> list[Any]:
    """Terms whose decimal numbers are floats and whose strings are str; all other words are symbols."""
    t = Tokens()
    t.register(r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", float)
    return t.values(text)


def typed_text(x: Any) -> str:
    """The text that ``typed`` reads back."""
    if isinstance(x, tuple):
        return "(" + " ".join(map(typed_text, x)) + ")"
    if isinstance(x, Var):
        return f"${x.name}"
    if isinstance(x, float):
        return debug(x)
    if isinstance(x, str):
        return '"' + re.sub(r'(["\\])', r"\\\1", x).replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r").replace("\0", "\\0") + '"'
    return x.decode()


def as_term(x: Any) -> Term:
    """A value as a term of symbols."""
    if isinstance(x, tuple):
        return tuple(as_term(y) for y in x)
    return x if isinstance(x, Var) else sym(debug(x) if isinstance(x, float) else x)
