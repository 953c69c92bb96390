"""A small lexer for Java and JavaScript: enough to find declarations, bodies and calls."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)
    |(?P<word>[^\W\d]\w*|[$][\w$]*|[^\W\d]?[\w$]*[$][\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<symbol>=>|\.\.\.|::|[^\s\w])""",
    re.S | re.X,
)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: After these a slash begins a regular expression, not a division.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => return typeof case".split())
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int  # from 1


def lex(source: str, script: bool = False) -> list[Token]:
    """Tokens with comments; ``script``: tell regular expressions from divisions."""
    out: list[Token] = []
    at, before, lines = 0, "", Lines(source)
    while m := _TOKEN.search(source, at):
        if script and m[0] == "/" and (before in _BEFORE_REGEX or not before) and (r := _REGEX.match(source, m.start())):
            kind, text, end = "string", r[0], r.end()
        else:
            kind, text, end = m.lastgroup, m[0], m.end()
        out.append(Token(kind, text, m.start(), end, lines.at(m.start())))
        at = end
        if kind != "comment":
            before = text
    return out


def matching(tokens: list[Token], at: int) -> int:
    """Index of the token that closes the bracket at ``at``; -1 if nothing does."""
    opened, closed = tokens[at].text, _CLOSE[tokens[at].text]
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].kind == "symbol":
            if tokens[i].text == opened:
                depth += 1
            elif tokens[i].text == closed:
                depth -= 1
                if not depth:
                    return i
    return -1


class Lines:
    """Line numbers of offsets, from a table of the line breaks."""

    def __init__(self, source: str):
        self.breaks = [m.start() for m in re.finditer("\n", source)]

    def at(self, offset: int) -> int:
        return bisect_left(self.breaks, offset) + 1


def unit(**fields) -> dict:
    """A unit with all columns; those not given are empty."""
    blank = {"class_name": "", "calls": [], "comment": "", "param_names": [], "param_types": [], "return_type": "", "summary": "", "body_text": ""}
    return blank | fields


def camel(name: str) -> str:
    return re.sub(r"([A-Z])", r" \1", name).strip()
