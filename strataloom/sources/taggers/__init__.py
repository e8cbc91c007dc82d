"""Definitions, references and imports of source files: a tagger a language behind one registry.

Taggers read text with lexical rules (Python with its own parser); languages without one fall back to
files.pattern_symbols. Recall is lower than a grammar's: nested generics, macros' contents and
computed names are not seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..files import first_of, per_file
from . import code, hcl
from .base import FileTags

TAGGERS: dict[str, Callable[[str, str], FileTags]] = {
    "go": code.go,
    "python": code.python,
    "javascript": code.javascript,
    "typescript": code.javascript,
    "tsx": code.javascript,
    "rust": code.rust,
    "svelte": code.svelte,
    "html": code.html,
    "hcl": hcl.hcl,
}

_SCHEMA = (
    "row string, file string, qname string, name string, kind string, line int, col int, lang string, recv string, test boolean, public boolean, "
    "callee_name string, callee_recv string, allow_bare boolean, alias string, target_name string, candidates array<string>, nth int"
)


def tag_rows(path: str, lang: str, content: str) -> list[tuple]:
    """Rows of one file: its symbols, references and imports."""
    tagger = TAGGERS.get(lang)
    return tagger(path, content).rows(lang) if tagger else []


def tag(files: DataFrame) -> DataFrame:
    """Tag rows of files(path, lang, content), with hash where files have one; a file that breaks its tagger has one row 'error', with the message as name."""
    known = files.where(F.col("lang").isin(*TAGGERS))
    joint = known.withColumn("content", F.concat("lang", F.lit("\n"), "content"))

    def both(path: str, text: str) -> list[tuple]:
        lang, _, content = text.partition("\n")
        return tag_rows(path, lang, content)

    fields = [f.split()[0] for f in _SCHEMA.split(", ")]
    rows = per_file(joint, both, _SCHEMA, lambda path, message: [tuple({"row": "error", "file": path, "name": message}.get(f) for f in fields)])
    return rows.join(files.select(F.col("path").alias("file"), "hash"), "file").withColumn("path", F.col("file")) if "hash" in files.columns else rows


def symbols(tags: DataFrame) -> DataFrame:
    """The last symbol of each qname."""
    rows = tags.where("row = 'symbol'")
    return first_of(rows, ["qname"], [F.desc("nth")]).select("qname", "name", "kind", "file", "line", "col", "lang", "recv", "test", "public")


def errors(tags: DataFrame) -> DataFrame:
    """(file, error) of files that broke their tagger."""
    return tags.where("row = 'error'").select("file", F.col("name").alias("error"))


def references(tags: DataFrame) -> DataFrame:
    rows = tags.where("row = 'ref'")
    return rows.select(F.xxhash64("file", "nth").alias("ref_id"), F.col("qname").alias("caller_qname"), F.col("file").alias("caller_file"), "callee_name", "callee_recv", "allow_bare")


def path_prefixes(files: DataFrame) -> DataFrame:
    """(prefix, target) of tsconfig.json path patterns 'x/*' with one target 'y/*'; a bounded table of settings."""
    text = F.regexp_replace(F.regexp_replace("content", r"(?m)^\s*//.*$", ""), r",(\s*[}\]])", "$1")
    parsed = F.from_json(text, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")
    found = files.where(F.col("path").rlike(r"(?:^|/)tsconfig\.json$")).select(F.regexp_replace("path", "tsconfig.json$", "").alias("dir"), parsed.alias("c"))
    rows = found.select("dir", F.col("c.compilerOptions.baseUrl").alias("base"), F.explode("c.compilerOptions.paths").alias("prefix", "targets"))
    rows = rows.where(F.col("prefix").endswith("/*") & (F.size("targets") == 1) & F.get("targets", F.lit(0)).endswith("/*"))
    base = F.regexp_replace(F.concat_ws("/", F.coalesce("base", F.lit(".")), F.regexp_replace(F.get("targets", F.lit(0)), r"\*$", "")), r"(^|/)(?:\./)+", "$1")
    return rows.select(F.regexp_replace("prefix", r"\*$", "").alias("prefix"), F.regexp_replace(F.concat("dir", base), "//+", "/").alias("target"))


def imports(tags: DataFrame, files: DataFrame) -> DataFrame:
    """imports(file, alias, target_file, target_name): of each import's candidate paths the first that exists, a file or a folder; of an alias the last import.

    A source that is no path goes by the longest tsconfig prefix that it starts with: a join on the prefix
    with the settings broadcast, which are a few lines of a few files.
    """
    from ...functions.scalars import dirname

    rows = tags.where("row = 'import'").select("file", "alias", "target_name", "nth", "candidates")
    named = F.get("candidates", F.lit(0)).startswith("alias:")
    source = F.expr("substring(candidates[0], 7)")
    prefixes = F.broadcast(path_prefixes(files))
    by_prefix = rows.where(named).withColumn("source", source).join(prefixes, F.col("source").startswith(F.col("prefix")))
    by_prefix = first_of(by_prefix, ["file", "nth"], [F.desc(F.length("prefix")), "target"])
    base = F.concat("target", F.expr("substring(source, length(prefix) + 1)"))
    meant = F.array(*(F.concat(base, F.lit(v)) for v in code.variants("")))
    rows = rows.where(~named).unionByName(by_prefix.select("file", "alias", "target_name", "nth", meant.alias("candidates")))
    rows = rows.select("file", "alias", "target_name", "nth", F.posexplode("candidates").alias("choice", "target_file"))
    there = files.select(F.col("path").alias("target_file")).union(files.select(dirname(F.col("path")))).distinct()
    found = first_of(rows.join(there, "target_file", "left_semi"), ["file", "nth"], ["choice"])
    return first_of(found, ["file", "alias"], [F.desc("nth")]).select("file", "alias", "target_file", "target_name")
