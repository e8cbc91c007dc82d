"""File history from commits and their numbers of changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_day


def rename_target(path: Column) -> Column:
    """The new path of 'old => new' and of 'a/{old => new}/b'; doubled slashes of an empty part go."""
    inner = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    plain = F.regexp_replace(path, r"^.* => ", "")
    return F.when(path.rlike(r"\{[^{}]* => [^{}]*\}"), F.regexp_replace(inner, "//+", "/")).when(path.contains(" => "), plain).otherwise(path)


def file_history(commits: DataFrame, numstat: DataFrame, max_commits: int = 1000, tasks: int | None = None) -> DataFrame:
    """(path, commits, additions, deletions, last_date, authors) from commits(commit_seq, author, date), 0 the newest, each seq once, and numstat(commit_seq, path, adds, dels).

    Of the max_commits newest commits (negative: all; 0: 1000). last_date is the day of the newest
    commit in the list, whatever its date; authors counts distinct non-empty ones; null lines count 0.

    Summed up by commit, then by author, then by path: no distinct counts, which would double the rows, and
    numbers alone in the sums, which a text would turn into sorts. tasks: how many share a shuffle; Spark's own number if none.
    """
    limit = 1000 if max_commits == 0 else max_commits
    kept = commits if limit < 0 else commits.where(F.col("commit_seq") < limit)
    lines = numstat.select("commit_seq", rename_target(F.col("path")).alias("path"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("adds", "dels")))
    by = kept.select("commit_seq", "author")
    if tasks:
        lines, by = lines.repartition(tasks, "commit_seq"), by.repartition(tasks, "commit_seq").hint("merge")
    sums = [F.sum("adds").alias("adds"), F.sum("dels").alias("dels")]
    rows = lines.join(by, "commit_seq").groupBy("commit_seq", "path", "author").agg(*sums)
    rows = rows.repartition(tasks, "path", "author") if tasks else rows
    rows = rows.groupBy("path", "author").agg(F.count("*").alias("n"), F.min("commit_seq").alias("newest"), *sums)
    rows = rows.groupBy("path").agg(
        F.sum("n").alias("commits"),
        F.sum("adds").alias("additions"),
        F.sum("dels").alias("deletions"),
        F.min("newest").alias("newest"),
        F.count(F.when(F.col("author") != "", 1)).alias("authors"),
    )
    days = kept.select(F.col("commit_seq").alias("newest"), iso_day(F.col("date")).alias("last_date"))
    return rows.join(days, "newest").select("path", "commits", "additions", "deletions", "last_date", "authors")


def top_history(history: DataFrame, limit: int = 20) -> DataFrame:
    return history.orderBy(F.desc("commits"), "path").limit(limit if limit > 0 else 20)
