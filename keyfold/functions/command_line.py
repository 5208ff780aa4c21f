"""Typed command lines to arguments, and arguments to a frame."""

from __future__ import annotations

import re

#: What a backslash makes of the next character.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}
PART = re.compile(r"""\s*((?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\\.|[^\s"'\\])+)""", re.DOTALL)
PIECE = re.compile(r""""((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)'|(\\.|[^"'\\]+)""", re.DOTALL)


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text, flags=re.DOTALL)


def tokens(line: str) -> list[str]:
    """Arguments of a line: parted by white space, quotes hold parts together, escapes are undone."""
    at, out = 0, []
    line = line.rstrip()
    while at < len(line):
        part = PART.match(line, at)
        if part is None:
            raise ValueError("a quote is not closed")
        out.append("".join(_plain(next(g for g in m.groups() if g is not None)) for m in PIECE.finditer(part[1])))
        at = part.end()
    return out


def frame(args: list[str]) -> bytes:
    """A command as an array of bulk strings."""
    data = [a.encode() for a in args]
    return b"*%d\r\n" % len(data) + b"".join(b"$%d\r\n%s\r\n" % (len(a), a) for a in data)
