"""JSP units: declarations and merged scriptlets; tags and expressions on request (SC6, EX14-EX19).

A page is read as a row of blocks between ``<%`` and ``%>``, found by position. What
stands in a block is Java and is read with the Java lexer: a method of a declaration
block is a name with brackets in front of a brace, at the block's own level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

from ..config import DEFAULT, Settings
from .lexer import Lines, Token, lex, matching, unit

_MARKS = ("--", "=", "@", "!")
_PREFIXED = re.compile(r"[a-zA-Z]+:[a-zA-Z]+")
_ATTRIBUTE = re.compile(r"""(\w+)=(?:"([^"]*)"|'([^']*)')""")


@dataclass
class Block:
    """One ``<% %>``: the mark behind its opening, where it begins and ends, and what is inside."""

    mark: str
    start: int
    end: int
    inside: int
    code: str


def blocks(content: str) -> Iterator[Block]:
    """Blocks in order; the reader stops at one that doesn't end."""
    at = content.find("<%")
    while at >= 0:
        mark = next((m for m in _MARKS if content.startswith(m, at + 2)), "")
        inside, closing = at + 2 + len(mark), "--%>" if mark == "--" else "%>"
        close = content.find(closing, inside)
        if close < 0:
            return
        yield Block(mark, at, close + len(closing), inside, content[inside:close])
        at = content.find("<%", close + len(closing))


def without_comments(content: str) -> str:
    """Comments out, their line breaks in place (EX14, Q25)."""
    kept, at = [], 0
    for b in blocks(content):
        if b.mark == "--":
            kept += [content[at : b.start], "\n" * b.code.count("\n")]
            at = b.end
    return "".join(kept) + content[at:]


def _methods(code: str) -> Iterator[tuple[Token, str, Token, Token]]:
    """First token, name, opening brace and last token of the methods at the top level of a block."""
    tokens = [t for t in lex(code) if t.kind != "comment"]
    at = begin = 0
    while at < len(tokens):
        if tokens[at].text in (";", "}"):
            begin = at + 1
        elif tokens[at].text == "{":
            close = matching(tokens, at)
            last = close if close >= 0 else len(tokens) - 1
            brackets = next((k for k in range(begin, at) if tokens[k].text == "("), at)
            if begin < brackets - 1 and tokens[brackets - 1].kind == "word" and all(t.text != "=" for t in tokens[begin:brackets]):
                yield tokens[begin], tokens[brackets - 1].text, tokens[at], tokens[last]
            at, begin = last, last + 1
        at += 1


def declarations(content: str, settings: Settings = DEFAULT) -> list[dict]:
    """Methods of declaration blocks (EX16)."""
    out, lines = [], Lines(content)
    for b in blocks(content):
        for first, name, brace, last in _methods(b.code) if b.mark == "!" else ():
            signature, body = b.code[first.start : brace.start].strip(), b.code[brace.start : last.end]
            line = lines.at(b.inside + first.start)
            out.append(
                unit(
                    language="jsp", unit_type="declaration", qualified_name=f"decl_{name}_{line}", name=name, signature=signature[:200], start_line=line, end_line=line + body.count("\n"),
                    body_text=body[: settings.body_chars], summary=f"[JSP] declaration: {signature[:80]} at line {line}",
                )
            )
    return out


def scriptlets(content: str, settings: Settings = DEFAULT, with_declarations: bool = True) -> list[dict]:
    """Scriptlets, neighbours merged while the gap is small, short groups left out (EX15).

    The rule is that of :func:`unitgraph.operators.service.merged_gaps`: a group ends where
    the next start lies more than the gap behind the furthest end so far.
    """
    lines, found = Lines(content), []
    for b in blocks(content):
        code = (b.mark + b.code if b.mark == "!" else b.code).strip()
        if code and (not b.mark or b.mark == "!" and with_declarations):
            start = lines.at(b.start)
            found.append((start, start + code.count("\n"), code))
    furthest = list(accumulate((end for _, end, _ in found), max))
    islands = accumulate((start - end > settings.scriptlet_gap for (start, _, _), end in zip(found[1:], furthest)), initial=0)
    out = []
    for k, group in groupby(zip(islands, found), key=lambda x: x[0]):
        own = [row for _, row in group]
        start, end, merged = own[0][0], max(row[1] for row in own), "\n".join(row[2] for row in own)
        if len([line for line in merged.splitlines() if line.strip()]) < settings.scriptlet_lines:
            continue
        out.append(
            unit(
                language="jsp", unit_type="scriptlet", qualified_name=f"scriptlet_{k}_{start}", name=f"scriptlet@line{start}", signature=f"<% ... %> at line {start}-{end}", start_line=start, end_line=end,
                body_text=merged[: settings.body_chars], summary=f"[JSP] scriptlet@line{start} | code: {merged[:80]}".replace("\n", " "),
            )
        )
    return out


def expressions(content: str) -> list[dict]:
    """Distinct expressions of a file at their first place (EX17)."""
    lines, first = Lines(content), {}
    at = content.find("${")
    while at >= 0 and (close := content.find("}", at)) >= 0:
        if close > at + 2:
            first.setdefault(content[at + 2 : close].strip(), lines.at(at))
        at = content.find("${", close)
    out = []
    for text, line in first.items():
        short = text[:40].translate(str.maketrans(". ", "__"))
        out.append(unit(language="jsp", unit_type="el_expression", qualified_name=f"el_{short}_{line}", name=f"${{{text}}}", signature=f"${{expr}} at line {line}", start_line=line, end_line=line, body_text=text, summary=f"[JSP] EL expression: ${{{text}}} at line {line}"))
    return out


def tags(content: str) -> list[dict]:
    """Distinct custom tags of a file, by name and 30 characters of attributes, at their first place (EX18)."""
    lines, first = Lines(content), {}
    at = content.find("<")
    while at >= 0:
        named, close = _PREFIXED.match(content, at + 1), content.find(">", at)
        if named and close >= named.end():
            raw = content[named.end() : close].removesuffix("/").strip()
            first.setdefault((named[0], raw[:30]), (raw, content[at : close + 1], lines.at(at)))
        at = content.find("<", at + 1)
    out = []
    for (name, _), (raw, whole, line) in first.items():
        values = {key: a or b for key, a, b in _ATTRIBUTE.findall(raw)}
        shown = ", ".join(f"{key}={value}" for key, value in [*values.items()][:4])
        out.append(
            unit(
                language="jsp", unit_type="custom_tag", qualified_name=f"tag_{name.replace(':', '_')}_{line}", name=f"<{name}>", signature=f"<{name} {raw[:60]}>", start_line=line, end_line=line,
                body_text=whole[:500], summary=f"[JSP] tag: <{name}> at line {line}" + (f" | attrs: {shown}" if shown else ""),
            )
        )
    return out


def numbered(units: list[dict]) -> list[dict]:
    """Repeated names of a file get a number (EX19)."""
    seen: dict[str, int] = {}
    for u in units:
        name = u["qualified_name"]
        again = seen[name] = seen.get(name, -1) + 1
        if again:
            u["qualified_name"] = f"{name}_{again}"
    return units


def parse(content: str, settings: Settings = DEFAULT, with_tags: bool = False) -> list[dict]:
    """Declarations, then scriptlets (S4); tags and expressions only ``with_tags``."""
    text = without_comments(content)
    units = declarations(text, settings) + scriptlets(text, settings)
    if with_tags:
        units += tags(text) + expressions(text)
    return numbered(units)
