"""Reading code text without a parser: comments and strings, blocks, lists."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

_PARTS = re.compile(
    r"""(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\#[^\n]*)""",
    re.DOTALL,
)
_NO_HASH = re.compile(_PARTS.pattern.replace(r"|\#[^\n]*", ""), re.DOTALL)


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def without_comments(text: str, hash_comments: bool = True) -> str:
    """Comments become blanks of the same length; what stands in quotes is no comment."""
    return (_PARTS if hash_comments else _NO_HASH).sub(lambda m: _blank(m[0]) if m["comment"] else m[0], text)


def without_strings(text: str) -> str:
    """What stands in quotes becomes blanks of the same length, the quotes stay."""
    return _NO_HASH.sub(lambda m: m[0] if m["comment"] or len(m[0]) < 2 else m[0][0] + _blank(m[0][1:-1]) + m[0][-1], text)


class Strings:
    """Tells whether an offset lies inside a string literal."""

    def __init__(self, text: str) -> None:
        self.spans = [m.span() for m in _PARTS.finditer(text) if m["string"]]
        self.starts = [a for a, _ in self.spans]

    def holds(self, offset: int) -> bool:
        k = bisect_right(self.starts, offset) - 1
        return k >= 0 and self.spans[k][0] < offset < self.spans[k][1]


class Lines:
    """1-based line of an offset."""

    def __init__(self, text: str) -> None:
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def at(self, offset: int) -> int:
        return 1 + bisect_right(self.ends, offset - 1)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """Offset of the bracket that closes the one at this offset, brackets in double quotes aside; -1 if none does."""
    depth = 0
    for m in re.compile(r'"(?:\\.|[^"\\\n])*"|[' + re.escape(pair) + "]").finditer(text, at):
        depth += (m[0] == pair[0]) - (m[0] == pair[1])
        if not depth:
            return m.start()
    return -1


def folder(path: str) -> str:
    return path.rpartition("/")[0]


def joined(base: str, *more: str) -> str | None:
    """A normal repository path; None if it leaves the repository."""
    out: list[str] = []
    for part in "/".join((base, *more)).split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def above(path: str) -> Iterator[str]:
    """The folders over a file's own, the nearest first, '' last."""
    here = folder(path)
    while here:
        here = folder(here)
        yield here


_TOKEN = re.compile(r"""(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>:=|\S)""", re.DOTALL)


@dataclass(frozen=True)
class Token:
    """A quoted text (value: what stands between the quotes), a name, or a mark; and where it starts and ends."""

    sort: str
    value: str
    start: int
    end: int


def tokens(code: str) -> list[Token]:
    """Quoted texts, names and marks of code without comments, whatever the language."""
    out = []
    for m in _TOKEN.finditer(code):
        sort = m.lastgroup or "mark"
        out.append(Token(sort, m[0][1:-1] if sort == "text" else m[0], *m.span()))
    return out


_OPENERS, _CLOSERS = "([{", ")]}"


def partners(found: list[Token]) -> dict[int, int]:
    """Place of each opening bracket: that of the bracket that closes it; unclosed ones are left out."""
    out, open_ = {}, []
    for k, t in enumerate(found):
        if t.sort == "mark" and t.value in _OPENERS:
            open_.append(k)
        elif t.sort == "mark" and t.value in _CLOSERS and open_:
            out[open_.pop()] = k
    return out
