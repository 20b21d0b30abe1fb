"""T-SQL tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass


class TSqlError(Exception):
    """A statement that is not accepted; number is the server's error number."""

    def __init__(self, message: str, number: int = 102, sqlstate: str = "42601"):
        super().__init__(message)
        self.number, self.sqlstate = number, sqlstate


@dataclass(frozen=True)
class Token:
    kind: str  # word, name (quoted), number, string, hex, param, op, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
      |(?P<string>[Nn]?'(?:[^']|'')*')
      |(?P<hex>0[xX][0-9A-Fa-f]*)
      |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<name>\[(?:[^\]]|\]\])*\]|"(?:[^"]|"")*")
      |(?P<param>@@?[A-Za-z_#$][\w$#]*)
      |(?P<word>[^\W\d][\w$#]*|\#\#?[\w$]+)
      |(?P<op><>|!=|<=|>=|!<|!>|\|\||::|[-+*/%&|^~=<>(),.;])""",
    re.X,
)


def tokens(text: str) -> list[Token]:
    out, i = [], 0
    while i < len(text):
        if text.startswith("/*", i):
            depth, j = 1, i + 2
            while depth:
                a, b = text.find("/*", j), text.find("*/", j)
                if b < 0:
                    raise TSqlError(f"unterminated comment at position {i}")
                depth, j = (depth + 1, a + 2) if 0 <= a < b else (depth - 1, b + 2)
            i = j
            continue
        m = _TOKEN.match(text, i)
        if not m:
            raise TSqlError(f"unexpected character {text[i]!r} at position {i}")
        kind, raw = m.lastgroup, m.group()
        if kind == "string":
            raw = raw[raw.index("'") + 1 : -1].replace("''", "'")
        elif kind == "name":
            raw = raw[1:-1].replace("]]", "]") if raw[0] == "[" else raw[1:-1].replace('""', '"')
        elif kind == "hex":
            raw = raw[2:]
        if kind != "space":
            out.append(Token(kind, raw, i))
        i = m.end()
    out.append(Token("end", "", len(text)))
    return out
