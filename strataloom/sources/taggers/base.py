"""What taggers collect about a file."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Definition:
    name: str
    kind: str
    start: int
    end: int
    recv: str = ""
    test: bool = False
    public: bool = False
    line_shift: int = 0
    qname: str = ""


@dataclass
class Reference:
    name: str
    start: int
    end: int
    recv: str = ""
    bare: bool = True
    caller: str = ""


@dataclass
class Import:
    alias: str
    target_name: str
    candidates: list[str]


@dataclass
class FileTags:
    path: str
    text: str
    definitions: list[Definition] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)

    def rows(self, lang: str) -> list[tuple]:
        """Numbers names, gives each reference its innermost definition and makes rows of the common schema."""
        ends = [k for k, c in enumerate(self.text) if c == "\n"]
        line_of = lambda at: bisect_right(ends, at - 1) + 1
        column = lambda at: len(self.text[(ends[line_of(at) - 2] + 1 if line_of(at) > 1 else 0) : at].encode())
        times: dict[str, int] = {}
        for d in self.definitions:
            base = f"{self.path}::{d.name}"
            if times.get(base):
                base += f"#{line_of(d.start)}"
                d.qname = base if not times.get(base) else f"{base}.{times[base] + 1}"
                times[f"{self.path}::{d.name}"] += 1
                times[base] = times.get(base, 0) + 1
            else:
                d.qname = base
                times[base] = 1
        out: list[tuple] = []
        for n, d in enumerate(self.definitions):
            out.append(("symbol", self.path, d.qname, d.name, d.kind, line_of(d.start), column(d.start), lang, d.recv, d.test, d.public, None, None, None, None, None, None, n))
        holders = self._holders()
        for n, r in enumerate(self.references):
            holder = holders.get(n, f"{self.path}::(top-level)")
            out.append(("ref", self.path, r.caller or holder, None, None, line_of(r.start), None, lang, None, None, None, r.name, r.recv, r.bare, None, None, None, n))
        for n, i in enumerate(self.imports):
            out.append(("import", self.path, None, None, None, None, None, lang, None, None, None, None, None, None, i.alias, i.target_name, i.candidates, n))
        return out

    def _holders(self) -> dict[int, str]:
        """Place of each reference within a definition: the qname of the smallest around it, the first listed of equals.

        One sweep over the text: definitions that have begun and not ended stay open, as many as nest.
        """
        begin = sorted(range(len(self.definitions)), key=lambda k: self.definitions[k].start)
        open_: list[int] = []
        out, at = {}, 0
        for n in sorted(range(len(self.references)), key=lambda n: self.references[n].start):
            r = self.references[n]
            while at < len(begin) and self.definitions[begin[at]].start <= r.start:
                open_.append(begin[at])
                at += 1
            open_ = [k for k in open_ if self.definitions[k].end >= r.start]
            around = [k for k in open_ if self.definitions[k].end >= r.end]
            if around:
                best = min(around, key=lambda k: (self.definitions[k].end - self.definitions[k].start, k))
                out[n] = self.definitions[best].qname
        return out
