"""Tokens, literals and parameters that the two query languages share."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from ..errors import InvalidQuery
from ..functions.values import parse_timestamp, parse_uuid

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>/\*.*?\*/)|(?P<line>--[^\n]*|//[^\n]*)
    |(?P<hex>[xX]'[0-9A-Fa-f]*')|(?P<str>'(?:[^']|'')*')|(?P<quoted>"[^"]*"|`[^`]*`)
    |(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<param>\?\d*|\$\w+|:[A-Za-z_]\w*)
    |(?P<name>[^\W\d]\w*)|(?P<op><>|!=|==|<=|>=|->|<-|\.\.|[-=<>()\[\]{},.*+;:|])""",
    re.S | re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


@dataclass(frozen=True)
class Param:
    key: int | str


class Cursor:
    """A token list with a place in it; comment is the mark that starts a line comment, -- or //."""

    def __init__(self, text: str, params: Any = None, comment: str = "--", named_colon: bool = True):
        self.source, self.params, self.i, self.seen = text, params, 0, 0
        self.tokens: list[Token] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m and m.lastgroup == "line" and not m[0].startswith(comment):
                m = re.compile(r"(?P<op><-|->|[-/])").match(text, at)
                if not m or m[0] == "/":
                    m = None
            if m and m.lastgroup == "param" and m[0][0] == ":" and not named_colon:
                m = re.compile(r"(?P<op>:)").match(text, at)
            if not m:
                self.fail(f"unexpected {text[at]!r}", at)
            if m.lastgroup not in ("space", "comment", "line"):
                self.tokens.append(Token(m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(Token("end", "", len(text)))

    def fail(self, what: str, at: int | None = None):
        at = self.peek().at if at is None else at
        line = self.source.count("\n", 0, at) + 1
        raise InvalidQuery(f"{what} at line {line}, column {at - (self.source.rfind(chr(10), 0, at) + 1) + 1}")

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.peek()
        self.i += 1
        return t

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "name" and t.text.upper() in words

    def word(self, *words: str) -> bool:
        """Takes the words in this order if they come next."""
        if all(self.is_word(w, ahead=i) for i, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.word(w):
                self.fail(f"expected {w}")

    def op(self, text: str) -> bool:
        if self.peek().kind == "op" and self.peek().text == text:
            self.i += 1
            return True
        return False

    def need_op(self, text: str) -> None:
        if not self.op(text):
            self.fail(f"expected {text!r}")

    def name(self) -> str:
        t = self.peek()
        if t.kind == "name":
            self.i += 1
            return t.text
        if t.kind == "quoted":
            self.i += 1
            return t.text[1:-1]
        self.fail("expected a name")

    def path(self) -> str:
        parts = [self.name()]
        while self.peek().text == "." and self.peek(1).kind in ("name", "quoted", "num"):
            self.next()
            parts.append(self.next().text if self.peek().kind == "num" else self.name())
        return ".".join(parts)

    def end(self) -> None:
        self.op(";")
        if self.peek().kind != "end":
            self.fail(f"unexpected {self.peek().text!r}")

    def bound(self, key: int | str):
        p = self.params
        try:
            if isinstance(key, str):
                return p[key]
            if isinstance(p, dict):
                return p[str(key)]
            return list(p or ())[key - 1] if key > 0 else self.fail("parameters count from 1")
        except (KeyError, IndexError, TypeError):
            raise InvalidQuery(f"no value for parameter {key!r}") from None

    def is_literal(self) -> bool:
        t = self.peek()
        return t.kind in ("num", "str", "hex", "param") or t.text in ("-", "[", "{") or self.is_word("TRUE", "FALSE", "NULL") or (self.is_word("TIMESTAMP", "UUID") and self.peek(1).kind == "str")

    def literal(self):
        """A literal or parameter as its Python value."""
        t = self.next()
        if t.kind == "num":
            return float(t.text) if re.search(r"[.eE]", t.text) else self._int(int(t.text))
        if t.text == "-" and self.peek().kind == "num":
            n = self.next().text
            return -float(n) if re.search(r"[.eE]", n) else self._int(-int(n))
        if t.kind == "str":
            return t.text[1:-1].replace("''", "'")
        if t.kind == "hex":
            if len(t.text) % 2 == 0:
                self.fail("odd number of hex digits", t.at)
            return bytes.fromhex(t.text[2:-1])
        if t.kind == "param":
            if t.text[0] == "?":
                self.seen += t.text == "?"
                return self.bound(int(t.text[1:]) if t.text[1:] else self.seen)
            return self.bound(int(t.text[1:]) if t.text[1:].isdigit() else t.text[1:])
        if t.text == "[":
            out = []
            while not self.op("]"):
                out.append(self.literal())
                if not self.op(","):
                    self.need_op("]")
                    break
            return out
        if t.text == "{":
            out = {}
            while not self.op("}"):
                key = self.peek()
                name = self.literal() if key.kind == "str" else self.name()
                self.need_op(":")
                out[name] = self.literal()
                if not self.op(","):
                    self.need_op("}")
                    break
            return out
        upper = t.text.upper()
        if t.kind == "name" and upper in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[upper]
        if t.kind == "name" and upper in ("TIMESTAMP", "UUID") and self.peek().kind == "str":
            return (parse_timestamp if upper == "TIMESTAMP" else parse_uuid)(self.literal())
        self.fail("expected a literal", t.at)

    def _int(self, v: int) -> int:
        if not -(1 << 63) <= v < 1 << 63:
            self.fail("integer out of range")
        return v
