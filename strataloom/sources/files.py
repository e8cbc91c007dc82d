"""Repositories as DataFrames of files; incremental reuse; the versioned index; definitions by pattern."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalars import basename, extension, line_at

MAX_BYTES = 4 << 20
INDEX_VERSION = 1

# Languages by extension, then by whole name.
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".rs": "rust", ".rb": "ruby", ".java": "java",
    ".hcl": "hcl", ".tf": "hcl", ".tfvars": "hcl", ".tofu": "hcl", ".tofuvars": "hcl", ".svelte": "svelte", ".html": "html", ".sql": "sql", ".json": "json", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cs": "c_sharp", ".php": "php", ".kt": "kotlin", ".swift": "swift", ".scala": "scala", ".sh": "bash", ".lua": "lua", ".ex": "elixir", ".exs": "elixir", ".dart": "dart", ".css": "css",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "make"}


def inside_root(path: str, allowed: list[str] | None = None) -> str:
    """The real path of an existing folder, under one of allowed if any are given; else an error."""
    real = os.path.realpath(path)
    if not os.path.isdir(real):
        raise NotADirectoryError(path)
    if allowed and not any(real == a or real.startswith(a.rstrip("/") + "/") for a in map(os.path.realpath, allowed)):
        raise PermissionError(f"{path} is outside of the allowed folders")
    return real


def under_root(root: str, relative: str) -> str:
    """root/relative after links are followed; an error if that is not under root."""
    base, real = os.path.realpath(root), os.path.realpath(os.path.join(root, relative))
    if real != base and not real.startswith(base + os.sep):
        raise PermissionError(f"{relative} leaves the repository")
    return real


def language(path: Column) -> Column:
    """null for unknown ones."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    named = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.try_element_at(named, F.lower(basename(path))))


def kept_folders(root: str, keep_github: bool = False) -> list[str]:
    """The folders of a local tree that are read: ignored and dotted ones are not entered. Names alone reach the driver."""
    out = []
    for here, below, names in os.walk(root):
        below[:] = sorted(f for f in below if f not in P.IGNORED_FOLDERS and (not f.startswith(".") or keep_github and f == ".github"))
        if names:
            out.append(here)
    return out


def walk(spark: SparkSession, root: str, keep_github: bool = False) -> DataFrame:
    """files(path, lang, size, hash, content): a repository without ignored and dotted folders; path relative to root, size in bytes.

    Spark reads in parallel; contents that a query does not select are not decoded. Of a local tree only
    kept folders are listed; of another file system all are, and ignored ones go by their path. Bytes
    that are no UTF-8 become U+FFFD, so one such file does not end a query.
    """
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile")
    if "://" in base:
        raw = reader.option("recursiveFileLookup", "true").load(base)
    else:
        raw = reader.load([_escaped(f) for f in kept_folders(base, keep_github)] or [_escaped(base)])
    full = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    rows = raw.select(F.substring_index(full, base + "/", -1).alias("path"), F.col("length").alias("size"), F.col("content").alias("bytes"))
    rows = rows.where(~P.is_ignored_path(F.col("path"), keep_github))
    return rows.select("path", language(F.col("path")).alias("lang"), "size", F.sha2("bytes", 256).alias("hash"), F.make_valid_utf8(F.col("bytes").cast("string")).alias("content"))


def _escaped(path: str) -> str:
    """A path as a pattern that fits itself alone."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def from_table(rows: DataFrame) -> DataFrame:
    """The same relation from rows(path, content), texts."""
    return rows.select("path", language(F.col("path")).alias("lang"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"), "content")


def from_rows(spark: SparkSession, rows: dict[str, str]) -> DataFrame:
    """The same relation from path: content."""
    return from_table(spark.createDataFrame(list(rows.items()), "path string, content string"))


def indexable(files: DataFrame) -> DataFrame:
    """Known languages, up to MAX_BYTES."""
    return files.where(F.col("lang").isNotNull() & (F.col("size") <= MAX_BYTES))


def oversize(files: DataFrame) -> DataFrame:
    return files.where(F.col("lang").isNotNull() & (F.col("size") > MAX_BYTES)).select("path", "size")


def split_changes(files: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to tag, to reuse): files whose path and hash the previous index lacks, and its rows that still hold; others drop out."""
    keys = ["path", "hash"]
    return files.join(previous.select(*keys).distinct(), keys, "left_anti"), previous.join(files.select(*keys), keys, "left_semi")


def refreshed(files: DataFrame, previous: DataFrame | None, tag: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tag rows of all files; those of unchanged files come from the previous index."""
    if previous is None:
        return tag(files)
    fresh, kept = split_changes(files, previous)
    return kept.unionByName(tag(fresh), allowMissingColumns=True)


def _pointers(spark: SparkSession, folder: str, version: int) -> tuple[object, list[tuple[int, str]]]:
    """(file system, (number, name of the folder) of this version's pointers, oldest first).

    A pointer is an empty file v<version>.<number>.<id>.current that names the folder v<version>-<id>.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return fs, []
    names = [f.getPath().getName().split(".") for f in fs.listStatus(at)]
    return fs, sorted((int(n[1]), n[2]) for n in names if len(n) == 4 and n[0] == f"v{version}" and n[3] == "current")


def save_index(tags: DataFrame, folder: str, version: int = INDEX_VERSION) -> None:
    """A new folder, then a new pointer to it, by one atomic creation of a file.

    Until the pointer is there, readers see the index before, whatever fails; nothing live is deleted.
    The one before stays for readers under way, older ones go.
    """
    spark = tags.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    own = uuid.uuid4().hex
    tags.write.parquet(f"{folder}/v{version}-{own}")
    fs, before = _pointers(spark, folder, version)
    number = before[-1][0] + 1 if before else 1
    _point(fs, path(f"{folder}/v{version}.{number:012d}.{own}.current"))
    for n, old in before[:-1]:
        fs.delete(path(f"{folder}/v{version}.{n:012d}.{old}.current"), False)
        fs.delete(path(f"{folder}/v{version}-{old}"), True)


def _point(fs, pointer) -> None:
    if not fs.createNewFile(pointer):
        raise OSError(f"{pointer.toString()} is there already: another writer was first")


def load_index(spark: SparkSession, folder: str, version: int = INDEX_VERSION) -> DataFrame | None:
    """None where no index of this version was ever saved: then all files are tagged anew. An index that is named but cannot be read is an error."""
    _, found = _pointers(spark, folder, version)
    return spark.read.parquet(f"{folder}/v{version}-{found[-1][1]}") if found else None


# What a definition looks like by extension; group 1 is its name.
DEFINITIONS = {
    ".go": [r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"(?m)^type\s+([A-Za-z_]\w*)"],
    ".py": [r"(?m)^[ \t]*(?:async\s+)?def\s+([A-Za-z_]\w*)", r"(?m)^[ \t]*class\s+([A-Za-z_]\w*)"],
    ".js": [r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)"],
    ".rs": [r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_]\w*)", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)"],
    ".rb": [r"(?m)^[ \t]*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", r"(?m)^[ \t]*(?:class|module)\s+([A-Z]\w*)"],
    ".java": [r"(?m)^[ \t]*(?:public|protected|private|abstract|final|static|\s)*\b(?:class|interface|enum)\s+([A-Za-z_]\w*)"],
}
DEFINITIONS[".ts"] = DEFINITIONS[".js"]


def pattern_symbols(files: DataFrame) -> DataFrame:
    """Symbols of kind 'symbol' by pattern alone, no edges: what is left where no tagger knows a repository. lang is the extension."""
    from ..operators.resolve import numbered_qnames

    found = []
    for ext, patterns in DEFINITIONS.items():
        own = files.where(extension(F.col("path")) == ext)
        for p in patterns:
            # The text before each match, for its line: split at matches keeps order and count.
            rows = own.select("path", "content", F.posexplode(F.regexp_extract_all("content", F.lit(p))).alias("nth", "name"), F.split("content", p).alias("between"), F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("whole"))
            before = F.concat(F.array_join(F.slice("between", F.lit(1), F.col("nth") + 1), ""), F.array_join(F.slice("whole", F.lit(1), F.col("nth")), ""))
            lead = F.regexp_extract(F.element_at("whole", F.col("nth") + 1), r"^(\s*)", 1)
            line = line_at(F.concat(before, lead), F.length(before) + F.length(lead))
            found.append(rows.select(F.col("path").alias("file"), "name", line.cast("int").alias("line"), F.lit(ext[1:]).alias("lang")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    named = numbered_qnames(out.withColumn("seq", F.struct("line", "name")))
    return named.select("qname", "name", F.lit("symbol").alias("kind"), "file", "line", "lang", F.lit("").alias("recv"), F.lit(False).alias("test"), F.lit(False).alias("public"))


#: What a parser raises on text that it cannot read; anything else is a fault of ours and ends the query.
_UNREADABLE = (ValueError, SyntaxError, KeyError, IndexError, TypeError, AttributeError, RecursionError)


#: Rows of parsed files that a worker holds, give or take one file's, before it hands them on.
ROWS_AT_ONCE = 2_000


def per_file(files: DataFrame, parse: Callable[[str, str], list[tuple]], schema: str, broken: Callable[[str, str], list[tuple]] | None = None) -> DataFrame:
    """Rows that parse(path, content) makes of each file. A batch of files is handed on in parts, so rows never pile up with its size.

    A file that breaks the parser gives the rows of broken(path, message), else none; unreadable() tells which.
    """
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    columns = kind.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += parse(path, content or "")
                except _UNREADABLE as e:
                    rows += broken(path, f"{type(e).__name__}: {e}") if broken else []
                if len(rows) >= ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, kind)


def unreadable(files: DataFrame, parse: Callable[[str, str], list[tuple]]) -> DataFrame:
    """(path, error) of the files that break a parser."""

    def only_errors(path: str, content: str) -> list[tuple]:
        parse(path, content)
        return []

    return per_file(files, only_errors, "path string, error string", lambda path, message: [(path, message)])


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row by order of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
