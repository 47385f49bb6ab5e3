"""Tokens of Kotlin and Java source: names, strings and signs with their places; comments are left out."""

from __future__ import annotations

import re
from typing import NamedTuple

PLAIN = re.compile(r"[ \t\r\n\f]+|[^\W\d]\w*|`[^`\n]+`|\d[\w.]*|'(?:\\.[^']*|[^'\\\n])'|->|\?\.|::|.", re.S)


class Token(NamedTuple):
    text: str
    at: int
    kind: str  # "name", "string" or "sign"


def _string_end(s: str, i: int, templates: bool) -> int:
    """The place behind the string that opens at i; `${...}` may hold strings of its own."""
    quote = '"""' if s.startswith('"""', i) else '"'
    j = i + len(quote)
    while j < len(s):
        if s.startswith(quote, j):
            j += len(quote)
            while quote == '"""' and s.startswith('"', j):
                j += 1
            return j
        if quote == '"' and s[j] == "\\":
            j += 2
        elif quote == '"' and s[j] == "\n":
            return j
        elif templates and s.startswith("${", j):
            depth, j = 1, j + 2
            while j < len(s) and depth:
                if s[j] == '"':
                    j = _string_end(s, j, templates)
                    continue
                depth += (s[j] == "{") - (s[j] == "}")
                j += 1
        else:
            j += 1
    return j


def _comment_end(s: str, i: int, nested: bool) -> int:
    depth, j = 1, i + 2
    while j < len(s) and depth:
        if s.startswith("*/", j):
            depth, j = depth - 1, j + 2
        elif nested and s.startswith("/*", j):
            depth, j = depth + 1, j + 2
        else:
            j += 1
    return j


def tokens(s: str, kotlin: bool = True) -> list[Token]:
    out, i = [], 0
    while i < len(s):
        if s.startswith("//", i):
            i = s.find("\n", i)
            if i < 0:
                break
        elif s.startswith("/*", i):
            i = _comment_end(s, i, kotlin)
        elif s[i] == '"':
            j = _string_end(s, i, kotlin)
            out.append(Token(s[i:j], i, "string"))
            i = j
        else:
            t = PLAIN.match(s, i)[0]
            if not t.isspace():
                name = t[0].isalpha() or t[0] in "_`"
                out.append(Token(t.strip("`"), i, "name" if name else "string" if t[0] == "'" and len(t) > 1 else "sign"))
            i += len(t)
    return out


def closers(ts: list[Token]) -> dict[int, int]:
    """Index of the bracket that closes each opening one."""
    pair, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
    for i, t in enumerate(ts):
        if t.kind != "sign":
            continue
        if t.text in "([{" and len(t.text) == 1:
            stack.append(i)
        elif t.text in pair:
            for k in range(len(stack) - 1, -1, -1):
                if ts[stack[k]].text == pair[t.text]:
                    out[stack[k]] = i
                    del stack[k:]
                    break
    return out
