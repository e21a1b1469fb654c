"""The query language: what kind a query is, and the parts of a boolean one."""

import re
from dataclasses import dataclass

_WS = r"[^\S\n\r]*"
_PHRASE = rf"'\w+(?:{_WS}\w+)*'"
_OPERAND = rf"(?:[\w*:]+|{_PHRASE})"
BOOLEAN = re.compile(rf"(?:{_OPERAND}{_WS}(?:NOT|OR|AND){_WS}{_OPERAND})+")
PHRASE = re.compile(rf"{_WS}{_PHRASE}{_WS}")
PREFIX = re.compile(rf"{_WS}\w+\*{_WS}")
OPERATORS = ("NOT", "AND", "OR")


class QueryError(ValueError):
    """A query that the language has no meaning for."""


@dataclass(frozen=True)
class Query:
    kind: str  # keyword, prefix, phrase, reply, boolean or error
    text: str
    operator: str | None = None
    operands: tuple[str, ...] = ()


def split_operators(text: str) -> list[str]:
    """Operands and operators in order. Operators are found as substrings, and none of them can overlap another."""
    return [x.strip() for x in re.split(f"({'|'.join(OPERATORS)})", text)]


def parse(text: str) -> Query:
    """Order matters: boolean, phrase, reply, prefix, then anything with an operator or * left is an error."""
    if BOOLEAN.fullmatch(text):
        items = split_operators(text)
        kinds = {x for x in items if x in OPERATORS}
        if len(kinds) != 1:
            return Query("error", text)
        return Query("boolean", text, kinds.pop(), tuple(x for x in items if x not in OPERATORS))
    if PHRASE.fullmatch(text):
        return Query("phrase", text)
    if text.startswith("ReplyTo:"):
        return Query("reply", text)
    if PREFIX.fullmatch(text):
        return Query("prefix", text)
    if any(x in text for x in (*OPERATORS, "*")):
        return Query("error", text)
    return Query("keyword", text)


def reply_target(text: str) -> int | None:
    """The comment of ReplyTo:N; None for more parts."""
    parts = text.split(":")
    if len(parts) != 2:
        return None
    try:
        return int(parts[1])
    except ValueError:
        raise QueryError(f"not a comment id: {parts[1]!r}") from None
