"""The repository guide (a text with a stamped header) and the catalogue of skills."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import under_root

FILE = ".strataloom/guide.md"
_HEADER = re.compile(r"\A<!--\n(.*?)\n-->\n?", re.DOTALL)


@dataclass
class Guide:
    exists: bool
    sha: str = ""
    branch: str = ""
    mode: str = ""
    generated: str = ""
    body: str = ""

    def current(self, head: str) -> bool:
        return self.exists and bool(self.sha) and self.sha == head


def read_guide(root: str) -> Guide:
    """A missing file is no error; a text without header is all body."""
    try:
        with open(under_root(root, FILE), encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        return Guide(False)
    m = _HEADER.match(text)
    fields = dict(line.split(": ", 1) for line in m[1].split("\n") if ": " in line) if m else {}
    return Guide(True, fields.get("sha", ""), fields.get("branch", ""), fields.get("mode", ""), fields.get("generated", ""), text[m.end() :] if m else text)


def write_guide(root: str, body: str, sha: str, branch: str, mode: str = "full", now: datetime | None = None) -> str:
    """Its path; written beside and renamed, with UTC time."""
    if mode not in ("full", "delta"):
        raise ValueError("mode is full or delta")
    path = under_root(root, FILE)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    stamp = (now or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    with open(path + ".new", "w", encoding="utf-8") as f:
        f.write(f"<!--\nsha: {sha}\nbranch: {branch}\nmode: {mode}\ngenerated: {stamp}\n-->\n{body}")
    os.replace(path + ".new", path)
    return path


def write_text(root: str, relative: str, text: str) -> str:
    """A rendered map as a file under root; its path."""
    path = under_root(root, relative)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def front_matter(text: str) -> dict[str, str]:
    m = re.match(r"\A---\n(.*?)\n---\n", text, re.DOTALL)
    return {k.strip(): v.strip().strip("\"'") for k, v in (line.split(":", 1) for line in (m[1] if m else "").split("\n") if ":" in line)}


def catalogue(spark: SparkSession, skills: dict[str, dict[str, str]], order: list[str] | None = None) -> DataFrame:
    """(name, description, content, files) of skills(name: {file: text}), SKILL.md their main text; in the given order, then by name."""
    rank = {n: k for k, n in enumerate(order or [])}
    rows = [(rank.get(n, len(rank)), n, front_matter(f.get("SKILL.md", "")).get("description", ""), re.sub(r"\A---\n.*?\n---\n", "", f.get("SKILL.md", ""), flags=re.DOTALL), sorted(f)) for n, f in skills.items()]
    return spark.createDataFrame(rows, "position int, name string, description string, content string, files array<string>").orderBy("position", "name").drop("position")


def skill(found: DataFrame, name: str, aliases: dict[str, str] | None = None) -> DataFrame:
    return found.where(F.col("name") == (aliases or {}).get(name, name))
