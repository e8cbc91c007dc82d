"""Version control: parsing what git prints, and running it."""

from __future__ import annotations

import io
import os
import re
import subprocess
import tarfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIMEOUT_S = 30
MAX_FILE, MAX_TREE = 100 << 20, 500 << 20
_HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"


class GitError(RuntimeError):
    pass


def run(root: str, *arguments: str) -> bytes:
    """Standard output of git in root: plain locale, no prompt, no locks, TIMEOUT_S seconds at most."""
    env = os.environ | {"LC_ALL": "C", "GIT_TERMINAL_PROMPT": "0", "GIT_OPTIONAL_LOCKS": "0"}
    try:
        return subprocess.run(["git", "-C", root, *arguments], env=env, capture_output=True, timeout=TIMEOUT_S, check=True, stdin=subprocess.DEVNULL).stdout
    except (subprocess.SubprocessError, OSError) as e:
        detail = getattr(e, "stderr", b"") or b""
        raise GitError(detail.decode(errors="replace").strip() or str(e)) from e


def _line(root: str, *arguments: str) -> str:
    return run(root, *arguments).decode().strip()


def available(root: str) -> bool:
    try:
        return _line(root, "rev-parse", "--is-inside-work-tree") == "true"
    except GitError:
        return False


def head_sha(root: str) -> str:
    return _line(root, "rev-parse", "HEAD")


def branch(root: str) -> str:
    return _line(root, "rev-parse", "--abbrev-ref", "HEAD")


def common_dir(root: str) -> str:
    return os.path.realpath(os.path.join(root, _line(root, "rev-parse", "--git-common-dir")))


def valid_ref(root: str, ref: str) -> str:
    if not ref or ref.startswith("-") or "\0" in ref:
        raise GitError(f"not a revision: {ref!r}")
    return _line(root, "rev-parse", "--verify", "--quiet", "--end-of-options", ref + "^{commit}")


def default_base(root: str) -> str:
    for name in ("origin/main", "main", "origin/master", "master"):
        try:
            return _line(root, "merge-base", "HEAD", valid_ref(root, name))
        except GitError:
            continue
    raise GitError("no base branch")


def numbered_lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, line string")


def parse_log(lines: DataFrame, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, numstat) of git log --numstat with \\x1fauthor\\x1fdate headers, newest first.

    lines(line_no, line), and where there are several logs a column log names: lines of one log are
    read in order, logs side by side.
    """
    part = [log] if log else []
    w = Window.partitionBy(*part).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith("\x1f")
    rows = lines.withColumn("commit_seq", (F.sum(head.cast("int")).over(w) - 1).cast("long"))
    fields = F.split("line", "\x1f")
    commits = rows.where(head).select(*part, "commit_seq", F.get(fields, F.lit(1)).alias("author"), F.coalesce(F.get(fields, F.lit(2)), F.lit("")).alias("date"))
    cells = F.split("line", "\t", 3)
    count = lambda k: F.coalesce(F.get(cells, F.lit(k)).try_cast("int"), F.lit(0))
    stats = rows.where(~head & (F.size(cells) == 3) & (F.col("commit_seq") >= 0)).select(*part, "commit_seq", F.get(cells, F.lit(2)).alias("path"), count(0).alias("adds"), count(1).alias("dels"))
    return commits, stats


def log_lines(spark: SparkSession, root: str, max_commits: int = 1000) -> DataFrame:
    limit = [] if max_commits < 0 else ["-n", str(max_commits or 1000)]
    return numbered_lines(spark, run(root, "log", "--no-merges", "--numstat", "--format=%x1f%an%x1f%aI", *limit).decode(errors="replace"))


def parse_diff(lines: DataFrame, diff: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(file_diffs(path, status), hunks(path, start, end)) of a unified diff without context; hunks on the new side.

    A deletion within a file is a hunk of one line; at line 0 it is none. A malformed hunk header is an error.
    """
    part = [diff] if diff else []
    w = Window.partitionBy(*part).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    header = line.startswith("diff --git ")
    rows = lines.withColumn("block", F.last_value(F.when(header, F.col("line_no")), ignoreNulls=True).over(w)).where("block IS NOT NULL")
    inside = F.max(F.when(line.startswith("@@"), F.col("line_no"))).over(Window.partitionBy(*part, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("in_hunk", inside.isNotNull())
    meta = ~F.col("in_hunk")
    say = lambda text: F.when(meta & line.startswith(text), F.substring_index(line, text, -1))
    new = F.max(say("+++ b/"))
    old = F.max(say("--- a/"))
    moved = F.max(say("rename to "))
    named = F.max(F.when(header, F.regexp_extract(line, r"^diff --git a/.* b/(.*)$", 1)))
    blocks = rows.groupBy(*part, "block").agg(
        F.regexp_replace(F.coalesce(moved, new, old, named), r"\t$", "").alias("path"),
        F.when(F.bool_or(meta & line.startswith("deleted file")), "D").when(F.bool_or(meta & line.startswith("new file")), "A").when(moved.isNotNull(), "R").otherwise("M").alias("status"),
    )
    number = lambda k: F.regexp_extract(line, _HUNK, k)
    checked = F.when(line.rlike(_HUNK), number(1)).otherwise(F.raise_error(F.concat(F.lit("malformed hunk header: "), line)))
    starts = rows.where(line.startswith("@@")).select(*part, "block", "line_no", checked.cast("int").alias("start"), F.when(number(2) == "", "1").otherwise(number(2)).alias("n"))
    hunks = starts.where("start > 0").withColumn("end", F.col("start") + F.greatest(F.col("n").cast("int") - 1, F.lit(0)))
    hunks = hunks.join(blocks.where("status <> 'D'"), [*part, "block"]).select(*part, "path", "start", "end")
    return blocks.select(*part, "path", "status"), hunks


def diff_lines(spark: SparkSession, root: str, base: str) -> DataFrame:
    return numbered_lines(spark, run(root, "diff", "--unified=0", "--find-renames", "--no-color", "--no-ext-diff", valid_ref(root, base), "--").decode(errors="replace"))


def name_status(raw: bytes) -> list[tuple[str, str, str]]:
    """(status, path, old path) of NUL-separated records; renames and copies carry two paths."""
    out, fields = [], iter(raw.decode(errors="replace").split("\0"))
    for status in fields:
        if not status:
            continue
        first = next(fields, "")
        out.append((status[0], next(fields, ""), first) if status[0] in "RC" else (status[0], first, ""))
    return out


def changed_since(root: str, base: str) -> list[tuple[str, str, str]]:
    return name_status(run(root, "diff", "--name-status", "-z", "--find-renames", valid_ref(root, base), "HEAD", "--"))


def tree_files(root: str, ref: str) -> dict[str, str]:
    """Text files of a revision; an error beyond MAX_FILE each or MAX_TREE in all; links and odd paths are left out."""
    out, total = {}, 0
    with tarfile.open(fileobj=io.BytesIO(run(root, "archive", "--format=tar", valid_ref(root, ref)))) as tar:
        for member in tar:
            if not member.isfile() or member.name.startswith("/") or ".." in member.name.split("/"):
                continue
            total += member.size
            if member.size > MAX_FILE or total > MAX_TREE:
                raise GitError("the tree is too large")
            out[member.name] = tar.extractfile(member).read().decode(errors="replace")
    return out


def is_valid_hunk(line: str) -> bool:
    return re.match(_HUNK, line) is not None
