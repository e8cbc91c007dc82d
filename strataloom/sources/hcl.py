"""HCL as nested blocks: names, labels, attributes, and objects among the values."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from .lexical import without_comments

#: A quoted template may hold ${...}, and that other quoted text.
_PART = re.compile(r'(?P<text>"(?:\\.|\$\{(?:[^{}"]|"[^"]*"|\{[^{}]*\})*\}|[^"\\\n])*")|(?P<name>[^\W\d][\w-]*)|(?P<line>\n)|(?P<mark>[^\s])')
_OPEN, _CLOSE = "{[(", "}])"


@dataclass
class Block:
    """kind "label" ... { attributes and blocks }; an object value is a block without kind."""

    kind: str = ""
    labels: list[str] = field(default_factory=list)
    values: list[tuple[str, str]] = field(default_factory=list)
    objects: list[tuple[str, Block]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def of(self, kind: str) -> list[Block]:
        return [b for b in self.blocks if b.kind == kind]

    def everywhere(self, kind: str) -> Iterator[Block]:
        for b in self.blocks:
            if b.kind == kind:
                yield b
            yield from b.everywhere(kind)

    def expression(self, name: str) -> str:
        return next((v for n, v in self.values if n == name), "")

    def literal(self, name: str) -> str:
        """The attribute's text where it is one quoted text, else ''."""
        return unquoted(self.expression(name))

    def inner_literal(self, name: str) -> str:
        """The first of this name here, else in objects and blocks within."""
        return self.literal(name) or next(filter(None, (b.inner_literal(name) for b in [*(o for _, o in self.objects), *self.blocks])), "")

    def object(self, name: str) -> Block | None:
        return next((o for n, o in self.objects if n == name), None)


def unquoted(value: str) -> str:
    m = _PART.fullmatch(value)
    return value[1:-1] if m and m["text"] else ""


class _Reader:
    def __init__(self, code: str) -> None:
        self.code = code
        self.parts = list(_PART.finditer(code))
        self.at = 0

    def body(self, block: Block) -> Block:
        """Reads up to the brace that closes the block, or the end."""
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part["mark"] == "}":
                break
            if not part["name"] and not part["text"]:
                continue
            name, labels = part[0].strip('"'), []
            while self.at < len(self.parts) and (self.parts[self.at]["text"] or self.parts[self.at]["name"]):
                labels.append(self.parts[self.at][0].strip('"'))
                self.at += 1
            mark = self.parts[self.at]["mark"] if self.at < len(self.parts) else None
            if mark == "{" and part["name"]:
                self.at += 1
                block.blocks.append(self.body(Block(name, labels)))
            elif mark in ("=", ":") and not labels:
                self.at += 1
                self.value(block, name)
        return block

    def value(self, block: Block, name: str) -> None:
        """Up to the end of its line, or of the line where its last bracket closes; a comma ends it too, in an object."""
        first, depth = self.at, 0
        if self.at < len(self.parts) and self.parts[self.at]["mark"] == "{":
            self.at += 1
            block.objects.append((name, self.body(Block())))
            return
        while self.at < len(self.parts):
            mark = self.parts[self.at]["mark"] or ""
            if not depth and (self.parts[self.at]["line"] or mark == "," or mark and mark in _CLOSE):
                break
            if mark and mark in _OPEN:
                depth += 1
            elif mark and mark in _CLOSE:
                depth -= 1
            self.at += 1
        if self.at > first:
            block.values.append((name, self.code[self.parts[first].start() : self.parts[self.at - 1].end()]))


def read(text: str) -> Block:
    """The file as one block."""
    return _Reader(without_comments(text)).body(Block())


def parent_folder_file(expression: str) -> str | None:
    """The file name that find_in_parent_folders is asked for in an expression, '' for its default; None if it is not called."""
    inner = expression[1:-1].removeprefix("${") if expression.startswith('"') else expression
    parts = [m[0] for m in _PART.finditer(inner)]
    if "find_in_parent_folders" not in parts:
        return None
    k = parts.index("find_in_parent_folders") + 2
    return unquoted(parts[k]) if k < len(parts) else ""
