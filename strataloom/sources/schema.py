"""CREATE TABLE statements as entities, columns and relationships."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import first_of, per_file
from .lexical import Token, partners, tokens

MAX_FILES = 200
# Words that start a table constraint; of the first two only with KEY behind them.
KEYED, CONSTRAINTS = ("primary", "foreign"), ("constraint", "key", "unique", "check", "index", "exclude")


def identifier(text: str) -> str:
    """The last part of a name, without quotes of any dialect."""
    return text.strip().translate(str.maketrans("", "", '`"[]')).rpartition(".")[2]


def _words(item: list[Token]) -> list[str]:
    return [t.value.lower() if t.sort == "name" else "" for t in item]


def _name_at(item: list[Token], k: int) -> tuple[str, int]:
    """The name that starts at place k, its parts joined by dots or within [ ], and the place behind it."""
    last = ""
    while k < len(item):
        if item[k].sort in ("name", "text"):
            last, k = item[k].value, k + 1
        elif item[k].value == "[" and k + 2 < len(item) and item[k + 2].value == "]":
            last, k = item[k + 1].value, k + 3
        else:
            break
        if k < len(item) and item[k].value == ".":
            k += 1
        else:
            break
    return identifier(last), k


def _parts(found: list[Token], close: dict[int, int], start: int, end: int) -> Iterator[list[Token]]:
    """Stretches between commas that no bracket encloses."""
    part, k = [], start
    while k < end:
        if found[k].value == "," and found[k].sort == "mark":
            yield part
            part, k = [], k + 1
            continue
        stop = min(close.get(k, k), end - 1)
        part += found[k : stop + 1]
        k = stop + 1
    yield part


def _inside(item: list[Token], word: int) -> list[str]:
    """Names in the brackets that follow this place."""
    close = partners(item)
    opened = next((k for k in range(word, len(item)) if item[k].value == "(" and k in close), None)
    return [] if opened is None else [_name_at(p, 0)[0] for p in _parts(item, close, opened + 1, close[opened]) if p]


def _statements(found: list[Token], close: dict[int, int]) -> Iterator[tuple[str, int, int]]:
    """(table, first place within its brackets, place of the closing one) of each CREATE TABLE."""
    words = _words(found)
    for k in range(len(found) - 1):
        if words[k] == "create" and words[k + 1] == "table":
            at = k + 5 if words[k + 2 : k + 5] == ["if", "not", "exists"] else k + 2
            name, at = _name_at(found, at)
            if name and at in close and found[at].value == "(":
                yield name, at + 1, close[at]


def tables(path: str, sql: str, strict: bool = False) -> list[tuple]:
    """(seq, entity, file, pos, column, type, pk, fk, target) a column and, with pos -1, a table or a relationship.

    strict: a definition that merely starts like KEY, INDEX, CHECK, ... is a constraint, as key_id is then.
    """
    out: list[tuple] = []
    found = tokens(sql)
    close = partners(found)
    for seq, (entity, start, end) in enumerate(_statements(found, close)):
        columns: list[dict] = []
        links: list[tuple[str, str]] = []
        for item in filter(None, _parts(found, close, start, end)):
            words = _words(item)
            refers = words.index("references") if "references" in words else -1
            first = words[0]
            limit = first in KEYED and words[1:2] == ["key"] or (first.startswith(CONSTRAINTS) if strict else first in CONSTRAINTS)
            if limit:
                if "foreign" in words and refers > 0:
                    local = (_inside(item, words.index("foreign")) or [""])[0]
                    links.append((local, _name_at(item, refers + 1)[0]))
                    for c in columns:
                        c["fk"] |= c["name"].lower() == local.lower()
                elif first == "primary":
                    own = {n.lower() for n in _inside(item, 0)}
                    for c in columns:
                        c["pk"] |= c["name"].lower() in own
                continue
            name, k = _name_at(item, 0)
            kind = sql[item[k].start : item[-1].end].split()[0] if k < len(item) else ""
            keyed = any(words[n : n + 2] == ["primary", "key"] for n in range(len(words)))
            columns.append({"name": name, "type": identifier(kind), "pk": keyed, "fk": refers > 0})
            if refers > 0:
                links.append((name, _name_at(item, refers + 1)[0]))
        out.append((seq, entity, path, -1, None, None, False, False, None))
        out += [(seq, entity, path, k, c["name"], c["type"], c["pk"], c["fk"], None) for k, c in enumerate(columns)]
        out += [(seq, entity, path, -1, local, None, False, True, target) for local, target in links]
    return out


_ROWS = "seq int, entity string, file string, pos int, name string, type string, pk boolean, fk boolean, target string"


def left_out(files: DataFrame, max_files: int = MAX_FILES) -> int:
    """How many files the cap keeps from being read."""
    return max(0, files.where(F.lower("path").endswith(".sql")).count() - max_files)


def entities(files: DataFrame, strict: bool = False, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities(name, file), columns(entity, pos, name, type, pk, fk), relationships(from, to, column)).

    Of the first max_files .sql files by path; the first file and statement wins for each name. Only
    relationships between known tables, each once.
    """
    sql = files.where(F.lower("path").endswith(".sql")).orderBy("path").limit(max_files)
    rows = per_file(sql, lambda p, c: tables(p, c, strict), _ROWS)
    known = first_of(rows.where("pos = -1 AND target IS NULL"), ["entity"], ["file", "seq"]).select("entity", "file", "seq")
    own = rows.join(known, ["entity", "file", "seq"], "left_semi")
    columns = own.where("pos >= 0").select("entity", "pos", "name", "type", "pk", "fk")
    links = own.where("target IS NOT NULL").select(F.col("entity").alias("from"), F.col("target").alias("to"), F.col("name").alias("column")).distinct()
    names = known.select("entity")
    links = links.join(names, links["to"] == names["entity"], "left_semi")
    return known.select(F.col("entity").alias("name"), "file"), columns, links
