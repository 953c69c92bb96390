"""JavaScript units: function declarations, class methods, functions bound by const or let (SC5, EX10-EX13)."""

from __future__ import annotations

from bisect import bisect_right

from ..config import DEFAULT, Settings
from .lexer import Lines, Token, camel, lex, matching, unit

#: Words of the language that no call is named by.
KEYWORDS = frozenset("if for while switch catch function return typeof await new delete void in of do else with super import yield case throw".split())
#: Before a function that is a statement of its own.
_STATEMENT = frozenset("; { } ) async export default".split())


def calls(source: str, tokens: list[Token]) -> list[dict]:
    """Called names and member expressions: their first line, 60 characters at most, each once a line (EX11)."""
    out, seen = [], set()
    for i, t in enumerate(tokens):
        if t.text != "(" or i == 0 or tokens[i - 1].kind != "word" or tokens[i - 1].text in KEYWORDS:
            continue
        first = i - 1
        while first >= 2 and tokens[first - 1].text == ".":
            first -= 2
            depth = 0
            while first >= 0 and (tokens[first].text in (")", "]") or depth):
                depth += tokens[first].text in (")", "]")
                depth -= tokens[first].text in ("(", "[")
                first -= 1
            first = max(first, 0)
        if first and tokens[first - 1].text in ("new", "function"):
            continue
        # a method's own head isn't a call
        close = matching(tokens, i)
        if close >= 0 and close + 1 < len(tokens) and tokens[close + 1].text == "{" and first == i - 1 and (first == 0 or tokens[first - 1].text in ("{", "}", ";")):
            continue
        name = source[tokens[first].start : tokens[i - 1].end].split("\n")[0][:60]
        key = (name, tokens[first].line)
        if key not in seen:
            seen.add(key)
            out.append({"name": name, "line": tokens[first].line})
    return out


def param_names(tokens: list[Token]) -> list[str]:
    """Plain, default and rest parameters (EX12)."""
    names, depth, fresh = [], 0, True
    for t in tokens:
        if fresh and t.kind == "word":
            names.append(t.text)
            fresh = False
        elif fresh and t.text != "...":
            fresh = False
        depth += t.text in "([{"
        depth -= t.text in ")]}"
        if t.text == "," and not depth:
            fresh = True
    return names


def parse(source: str, settings: Settings = DEFAULT) -> list[dict]:
    """Units of a script, in source order; repeated names get ``_L{line}`` (the line from 0)."""
    everything = lex(source, script=True)
    comments = [t for t in everything if t.kind == "comment"]
    tokens = [t for t in everything if t.kind != "comment"]
    units: list[dict] = []
    seen: set[str] = set()
    lines, ends = Lines(source), [c.end for c in comments]

    def comment_before(start: int) -> str:
        k = bisect_right(ends, start) - 1
        if k < 0 or source[ends[k] : start].strip():
            return ""
        return comments[k].text.lstrip("/").lstrip("*").strip()

    def add(name: str, parent: str, head: list[Token], shown: str, body: list[Token], first: Token, last: Token) -> None:
        qualified = f"{parent}.{name}" if parent else name
        names, found = param_names(head), calls(source, body)
        words, line = camel(name), first.line - 1
        text = f"[JS] {'class ' + camel(parent) + ' ' if parent else ''}method {words} | full: {qualified}{shown}"
        if names:
            text += f" | params: {', '.join(names)}"
        if found:
            text += f" | calls: {', '.join(c['name'] for c in found[:5])}"
        for prefixes, tag in ((("set",), f"setter for {name[3:]}"), (("get",), f"getter for {name[3:]}"), (("is", "has", "check"), f"boolean check: {words}")):
            if name.startswith(prefixes):
                text += f" | {tag}"
                break
        unique, n = qualified, 0
        while unique in seen:
            unique = f"{qualified}_L{line}" + (f"_{n}" if n else "")
            n += 1
        seen.add(unique)
        units.append(
            unit(
                language="javascript", unit_type="function", qualified_name=unique, name=name, class_name=parent, signature=f"function {name}{shown}", start_line=first.line,
                end_line=lines.at(last.end - 1), body_text=source[body[0].start : body[-1].end][: settings.body_chars] if body else "", calls=found, comment=comment_before(first.start), param_names=names, summary=text,
            )
        )

    def function_at(at: int, opened: int, name: str, parent: str, first: int) -> int:
        """Add the function whose parameters open at ``opened``; returns the place of its body, to go on inside."""
        close = matching(tokens, opened)
        if close < 0 or close + 1 >= len(tokens) or tokens[close + 1].text != "{":
            return at + 1
        end = matching(tokens, close + 1)
        end = end if end >= 0 else len(tokens) - 1
        add(name, parent, tokens[opened + 1 : close], source[tokens[opened].start : tokens[close].end], tokens[close + 1 : end + 1], tokens[first], tokens[end])
        return close + 1

    def walk(at: int, end: int, parent: str, in_class: bool) -> None:
        while at < end:
            t = tokens[at]
            before = tokens[at - 1].text if at else ";"
            if t.text == "class" and at + 1 < end and tokens[at + 1].kind == "word" and before != ".":
                name = tokens[at + 1].text
                opened = next((k for k in range(at, end) if tokens[k].text == "{"), -1)
                if opened < 0:
                    return
                close = matching(tokens, opened)
                close = close if close >= 0 else end
                walk(opened + 1, close, name, True)
                at = close + 1
            elif t.text == "function" and before in _STATEMENT and at + 2 < end and tokens[at + 1].kind == "word":
                first = at - 1 if before == "async" else at
                body = function_at(at, at + 2, tokens[at + 1].text, parent, first)
                at = body
            elif t.text in ("const", "let") and at + 3 < end and tokens[at + 1].kind == "word" and tokens[at + 2].text == "=":
                at = bound(at, end)
            elif in_class and t.kind == "word" and at + 1 < end and tokens[at + 1].text == "(" and t.text not in KEYWORDS:
                body = function_at(at, at + 1, t.text, parent, at - 1 if before in ("async", "static", "get", "set") else at)
                if tokens[body].text == "{":
                    close = matching(tokens, body)
                    close = close if close >= 0 else end
                    walk(body + 1, close, parent, False)
                    at = close + 1
                else:
                    at = body
            else:
                at += 1

    def bound(at: int, end: int) -> int:
        """``const name = function``, with or without arrow; the name is its own parent (Q26)."""
        name, k = tokens[at + 1].text, at + 3
        first = k
        if tokens[k].text == "async":
            k += 1
        if tokens[k].text == "function":
            k += 1
            if k < end and tokens[k].kind == "word":
                k += 1
            return function_at(at, k, name, name, first) if k < end and tokens[k].text == "(" else at + 3
        if tokens[k].text == "(":
            close = matching(tokens, k)
            head, shown, arrow = tokens[k + 1 : close], source[tokens[k].start : tokens[close].end], close + 1
        elif tokens[k].kind == "word":
            head, shown, arrow = [tokens[k]], "()", k + 1
        else:
            return at + 3
        if close_missing := (arrow <= 0 or arrow + 1 >= len(tokens) or tokens[arrow].text != "=>"):
            return at + 3 if close_missing else at
        if tokens[arrow + 1].text == "{":
            stop = matching(tokens, arrow + 1)
            stop = stop if stop >= 0 else len(tokens) - 1
            add(name, name, head, shown, tokens[arrow + 1 : stop + 1], tokens[first], tokens[stop])
            return arrow + 1
        depth, stop = 0, arrow + 1
        while stop < end and (depth or tokens[stop].text not in ";,)"):
            depth += tokens[stop].text in "([{"
            depth -= tokens[stop].text in ")]}"
            stop += 1
        add(name, name, head, shown, [], tokens[first], tokens[stop - 1])
        return arrow + 1

    walk(0, len(tokens), "", False)
    return units
