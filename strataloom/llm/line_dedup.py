"""Removal of lines that a large share of a site's pages carry, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_name, table, written

#: A line is boilerplate if more than RATIO of the host's pages, and at least MIN_PAGES of them, carry it.
RATIO, MIN_PAGES = 0.08, 3
#: Boilerplate lines up to which the table of them is broadcast; beyond, lines are joined by key.
BROADCAST_LINES = 200_000
_BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """128 bits that stand for the line without blanks at its ends; lines of one key count as equal."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.struct(F.xxhash64(bare).alias("x"), F.xxhash64(F.lit("line"), bare).alias("y"))


def boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, n_pages): each host's lines on more than ratio of its pages and on min_pages at least.

    Every row is a page, repeated rows too; a line counts once a page. Null host is a host of its own.
    Blank lines never are boilerplate. Counting sums up per task before anything is shuffled, and rows
    are keyed by host and line, so neither a large host nor a common line meets in one task.
    """
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    full = F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    keys = rows.select("host", F.explode(F.array_distinct(F.transform(full, _key))).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    named = totals.select(F.col("host").alias("of"), "pages")
    return counts.join(named, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_pages") > ratio * F.col("pages")).select("host", "key", "n_pages")


def without_boilerplate(
    pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, counted: bool = False
) -> DataFrame:
    """pages with the boilerplate lines of their host taken out of text; other lines keep their order.

    counted: adds n_lines and n_dropped. Null text stays null (no lines); a text all of whose lines go
    is empty and its row stays. A column n_chars is set to the new length where a line went. Other
    columns, of any name, stay as they are. Empty table: empty.

    A host has at most (mean lines a page) / ratio boilerplate lines. Up to broadcast_lines of them in
    all are broadcast, by host; more are found by joining (host, line) rows and regrouping by the
    text's hash, which a large host or common line cannot skew beyond what a skew join splits.
    """
    lines_of, named = fresh_name(pages, "boiler_lines"), fresh_name(pages, "boiler_host")
    bad = written(boilerplate(pages, text, host, ratio, min_pages), "boilerplate")
    if bad.limit(broadcast_lines + 1).count() <= broadcast_lines:
        by_host = bad.groupBy(F.col("host").alias(named)).agg(F.collect_set("key").alias(lines_of))
        marked = pages.join(F.broadcast(by_host), pages[host].eqNullSafe(F.col(named)), "left")
    else:
        mark = fresh_name(pages, "boiler_text")
        keyed = pages.withColumn(mark, F.xxhash64(text, F.lit(1)))
        rows = keyed.select(F.col(host).alias("h"), F.col(mark).alias("m"), F.explode(F.transform(_lines(F.col(text)), _key)).alias("k"))
        found = rows.join(bad, rows["h"].eqNullSafe(bad["host"]) & (rows["k"] == bad["key"]), "left_semi")
        by_text = found.groupBy(F.col("h").alias(named), F.col("m").alias(mark + "_t")).agg(F.collect_set("k").alias(lines_of))
        marked = keyed.join(by_text, keyed[host].eqNullSafe(F.col(named)) & (keyed[mark] == F.col(mark + "_t")), "left").drop(mark, mark + "_t")
    old = F.col(text)
    good = F.filter(_lines(old), lambda x: ~F.array_contains(F.col(lines_of), _key(x)))
    new = F.when(F.col(lines_of).isNull(), old).otherwise(F.array_join(good, "\n"))
    columns = {}
    if counted:
        columns["n_lines"] = F.when(old.isNull(), 0).otherwise(F.size(_lines(old))).cast("long")
        columns["n_dropped"] = F.when(F.col(lines_of).isNull() | old.isNull(), 0).otherwise(F.size(_lines(old)) - F.size(good)).cast("long")
    if "n_chars" in pages.columns:
        columns["n_chars"] = F.when(F.col(lines_of).isNull() | old.isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long"))
    return marked.withColumns(columns | {text: new}).drop(lines_of, named)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_boilerplate(table(spark, sf_dir, "documents"), counted=True).select("doc_id", "text", "n_lines", "n_dropped")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
lines AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM lines),
total AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
bad AS (
  SELECT c.source, c.k FROM (SELECT source, k, count(DISTINCT r) AS n FROM keyed WHERE k <> '' GROUP BY source, k) c
  JOIN total t ON c.source IS NOT DISTINCT FROM t.source WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * t.pages),
cut AS (
  SELECT x.r, count(*) AS n_lines, count(b.k) AS n_dropped, coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (WHERE b.k IS NULL), '') AS text
  FROM keyed x LEFT JOIN bad b ON x.source IS NOT DISTINCT FROM b.source AND x.k = b.k GROUP BY x.r)
SELECT d.doc_id, cut.text, coalesce(cut.n_lines, 0)::BIGINT AS n_lines, coalesce(cut.n_dropped, 0)::BIGINT AS n_dropped FROM d LEFT JOIN cut USING (r)
"""
