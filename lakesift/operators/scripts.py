"""Top-level declarations of JavaScript and TypeScript, found by reading strings, comments, patterns and brackets."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: What matters outside of template strings. A slash is looked at by hand: it may begin a pattern.
_CODE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|[\w$]+|[^\S\n]+|.", re.DOTALL)
_TEMPLATE = re.compile(r"(?:\\(?:.|\Z)|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.DOTALL)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words behind which a slash begins a pattern.
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new do else yield await instanceof".split())
_DECLARED = re.compile(r"(?P<type>class\b(?!\s*[:=(.,]))|(?P<function>(?:async[^\S\n]+)?function\b|export\b(?!\s*[:=(.,]))|(?P<module>import\b(?!\s*[.(:=,]))")
OPEN, CLOSED = "([{", ")]}"


def declarations(code: str) -> Iterator[tuple[int, str]]:
    """(place, type / function / module) of the beginning of each line on which a class, a function or an export, or an import begins outside of
    all brackets, strings, comments and patterns; a class below decorators begins with the first of them.

    Behind an operator a line goes on with an expression, which declares nothing. What isn't closed reaches to the end.
    """
    opened: list[str] = []
    at, line, last, decorated = 0, 0, "", None
    fresh = True  # nothing but blanks and comments on this line so far
    while at < len(code):
        if opened and opened[-1] == "`":
            m = _TEMPLATE.match(code, at)
            opened.pop() if m[1] == "`" else opened.append("${")
            at, last = m.end(), "`"
            continue
        m = _CODE.match(code, at)
        text = m[0]
        if text == "\n":
            at = line = m.end()
            fresh = True
            continue
        if text.isspace() or text.startswith(("//", "/*")):
            if "\n" in text:  # behind a long comment a line begins where it ends
                line, fresh = at + text.rindex("\n") + 1, True
            at = m.end()
            continue
        if fresh and not opened:
            found = _DECLARED.match(code, at)
            goes_on = bool(last) and last in "=,:?&|+-*/%<>!~^."
            if found and not goes_on:
                yield line if decorated is None else decorated, found.lastgroup
                decorated = None
            elif text == "@" and not goes_on:
                decorated = line if decorated is None else decorated
            elif decorated is not None and last != "@":
                decorated = None
        fresh = False
        if text == "/" and (not last or last in "=(,:;!&|?{}[+-*%<>~^" or last in _BEFORE_PATTERN):
            m = _PATTERN.match(code, at) or m
        elif text == "`":
            opened.append("`")
        elif text in OPEN:
            opened.append(text)
        elif text in CLOSED and opened:
            opened.pop()
        at, last = m.end(), "/x" if m.re is _PATTERN else text
