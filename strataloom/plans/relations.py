"""Code-graph relations derived from the sample tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import materialised, tasks_for


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


#: Rows up to which a table is broadcast to what is joined with it.
BROADCAST_ROWS = 200_000


def _met(left: DataFrame, key: str, right: DataFrame, other: str, rows: int, tasks: int, how: str = "inner") -> DataFrame:
    """left joined with right, of so many rows, where left's key is right's other."""
    on = F.col(key) == F.col(other)
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return left.repartition(tasks, key).join(right.repartition(tasks, other).hint("merge"), on, how)


def line_tasks(spark: SparkSession, d: str) -> int:
    """Tasks for every line of an order."""
    return tasks_for(spark, read(spark, d, "lineitem").count())


SUPPLY_PAIRS = [("orders", "c", "o_custkey", "o", "o_orderkey"), ("lineitem", "o", "l_orderkey", "p", "l_partkey"), ("lineitem", "p", "l_partkey", "s", "l_suppkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]


def supply_edges(spark: SparkSession, d: str, distinct: bool = True) -> DataFrame:
    """Acyclic: customer to order to part to supplier to nation to region. Not distinct: for what takes each node once anyway."""
    parts = []
    for t, a, x, b, y in SUPPLY_PAIRS:
        pairs = read(spark, d, t).select(x, y)
        if distinct:  # by number, before there are names
            pairs = pairs.repartition(tasks_for(spark, pairs.count()), x, y).distinct()
        parts.append(pairs.select(_id(a, x).alias("src"), _id(b, y).alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def supply_tasks(spark: SparkSession, d: str) -> int:
    """Tasks for both ends of every edge of supply_edges."""
    return tasks_for(spark, sum(2 * read(spark, d, t).count() for t, *_ in SUPPLY_PAIRS))


SUPPLY_EDGES = """supply_edges AS (
  SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL
  SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL
  SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION ALL
  SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL
  SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    """Cyclic: an event type and user group to the next one of the same session lane."""
    e = read(spark, d, "events").withColumn("node", F.concat("event_type", F.lit("#"), (F.col("user_id") % 50).cast("string")))
    w = Window.partitionBy(F.col("user_id") % 7).orderBy("ts", "event_id")
    return e.select(F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


EVENT_EDGES = """event_edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT event_type || '#' || (user_id % 50) AS src,
      lead(event_type || '#' || (user_id % 50)) OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL AND src <> dst)"""


def event_symbols(spark: SparkSession, d: str) -> DataFrame:
    """A symbol for each end of event_edges: name and file from its two parts; users 40 to 49 are tests."""
    e = event_edges(spark, d)
    q = e.select(F.col("src").alias("qname")).union(e.select("dst")).distinct()
    kind, user = F.substring_index("qname", "#", 1), F.substring_index("qname", "#", -1).cast("int")
    return q.select("qname", kind.alias("name"), F.when(user % 3 == 0, "method").otherwise("function").alias("kind"), F.concat(F.lit("g"), (user % 8).cast("string"), F.lit("/u"), user.cast("string"), F.lit(".go")).alias("file"), (user + 1).alias("line"), F.lit("go").alias("lang"), F.lit("").alias("recv"), (user >= 40).alias("test"), F.lit(False).alias("public"))


EVENT_SYMBOLS = """event_symbols AS (
  SELECT qname, split_part(qname, '#', 1) AS name, u, CASE WHEN u % 3 = 0 THEN 'method' ELSE 'function' END AS kind,
    'g' || (u % 8) || '/u' || u || '.go' AS file, (u + 1)::INTEGER AS line, u >= 40 AS test
  FROM (SELECT qname, split_part(qname, '#', 2)::INTEGER AS u FROM (SELECT src AS qname FROM event_edges UNION SELECT dst FROM event_edges)))"""


def commit_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as commits, newest first, and their lines as numstat of brand/type paths.

    The sequence number needs the whole order; it is made from counts a day and a number within the day.
    """
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("author"), F.col("o_orderdate").alias("at"))
    n, tasks = o.count(), line_tasks(spark, d)
    days = o.groupBy("at").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("at").orderBy("o_orderkey"))
    seq = o.repartition(tasks_for(spark, n), "at").join(days.select("at", "before"), "at").withColumn("commit_seq", (F.col("before") + inside - 1).cast("long"))
    seq = materialised(seq.select("o_orderkey", "commit_seq", "author", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("date")))
    p = read(spark, d, "part")
    part = p.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("path"))
    lines = _met(read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber"), "l_orderkey", seq.select("o_orderkey", "commit_seq"), "o_orderkey", n, tasks)
    lines = _met(lines, "l_partkey", part, "p_partkey", p.count(), tasks)
    return seq.select("commit_seq", "author", "date"), lines.select("commit_seq", "path", F.col("l_quantity").cast("int").alias("adds"), F.col("l_linenumber").cast("int").alias("dels"))


COMMITS = """commits AS (
  SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS commit_seq, o_orderkey, o_custkey::VARCHAR AS author, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
numstat AS (
  SELECT c.commit_seq, p_brand || '/' || p_type AS path, l_quantity::INTEGER AS adds, l_linenumber AS dels
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN commits c ON l_orderkey = c.o_orderkey)"""
HISTORY = """history AS (
  SELECT n.path, count(DISTINCT n.commit_seq)::BIGINT AS commits, sum(adds)::BIGINT AS additions, sum(dels)::BIGINT AS deletions, arg_min(c.day, n.commit_seq) AS last_date, count(DISTINCT author)::BIGINT AS authors
  FROM numstat n JOIN commits c USING (commit_seq) GROUP BY n.path)"""


def definitions(spark: SparkSession, d: str) -> DataFrame:
    """Events as definitions, three lines apart in a file a user; every fifth on the line of the one before."""
    e = read(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    line = (1 + 3 * (n - F.when(n % 5 == 0, 1).otherwise(0))).cast("int")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), _id("e", "event_id").alias("qname"), line.alias("line"), F.col("event_type").alias("kind"))


DEFINITIONS = """definitions AS (
  SELECT 'u' || user_id AS file, 'e' || event_id AS qname, (1 + 3 * (n - CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END))::INTEGER AS line, event_type AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))"""
HUNKS = "hunks AS (SELECT file AS path, line - 1 AS s, line + 2 AS e FROM definitions WHERE kind = 'error')"


def hunks(defs: DataFrame) -> DataFrame:
    return defs.where("kind = 'error'").select(F.col("file").alias("path"), (F.col("line") - 1).alias("start"), (F.col("line") + 2).alias("end"))


def part_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Parts, regions and nations as symbols: names repeat within and across files, so every scope has unique and ambiguous ones."""
    file = F.concat("p_brand", F.lit("/"), "p_type")
    parts = read(spark, d, "part").select(F.concat(file, F.lit("::"), F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("qname"), F.col("p_name").alias("name"), file.alias("file"))
    nations = read(spark, d, "nation").select(F.concat(F.lit("geo/nation::"), "n_name").alias("qname"), F.col("n_name").alias("name"), F.lit("geo/nation").alias("file"))
    return parts.unionByName(nations).withColumn("recv", F.lit(""))


def part_refs(spark: SparkSession, d: str) -> DataFrame:
    """Each line of an order refers, from its part, to the name of another part, or of a nation."""
    p = read(spark, d, "part")
    total = p.count()
    file = F.concat("p_brand", F.lit("/"), "p_type")
    caller = p.select(F.col("p_partkey").alias("k"), F.concat(file, F.lit("::"), F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("caller_qname"), file.alias("caller_file"))
    callee = p.select(F.col("p_partkey").alias("k2"), F.col("p_name").alias("part_name"))
    nation = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k3"), "n_name")
    li = read(spark, d, "lineitem")
    tasks = line_tasks(spark, d)
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % F.lit(total)).alias("to"), (F.col("l_orderkey") % 25).alias("at"))
    rows = _met(_met(rows, "to", callee, "k2", total, tasks, "left"), "l_partkey", caller, "k", total, tasks)
    rows = rows.join(F.broadcast(nation), F.col("at") == F.col("k3"), "left")  # 25 rows
    name = F.when(F.col("l_linenumber") == 3, F.col("n_name")).otherwise(F.coalesce("part_name", F.lit("missing")))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), "caller_qname", "caller_file", name.alias("callee_name"), F.lit("").alias("callee_recv"), (F.col("l_linenumber") != 5).alias("allow_bare"))


PART_SYMBOLS = """part_symbols AS (
  SELECT p_brand || '/' || p_type || '::' || p_name || '#' || p_partkey AS qname, p_name AS name, p_brand || '/' || p_type AS file, p_brand AS dir FROM part
  UNION ALL SELECT 'geo/nation::' || n_name, n_name, 'geo/nation', 'geo' FROM nation),
part_refs AS (
  SELECT l_orderkey * 10 + l_linenumber AS ref_id, c.p_brand || '/' || c.p_type || '::' || c.p_name || '#' || c.p_partkey AS caller_qname, c.p_brand || '/' || c.p_type AS caller_file, c.p_brand AS caller_dir,
    CASE WHEN l_linenumber = 3 THEN n_name ELSE coalesce(t.p_name, 'missing') END AS callee_name, l_linenumber <> 5 AS allow_bare
  FROM lineitem l JOIN part c ON l.l_partkey = c.p_partkey LEFT JOIN part t ON t.p_partkey = (l.l_partkey * 7 + l.l_linenumber) % (SELECT count(*) FROM part)
  LEFT JOIN nation ON n_nationkey = l.l_orderkey % 25),
u_file AS (SELECT file, name, min(qname) AS qname FROM part_symbols GROUP BY file, name HAVING count(*) = 1),
u_dir AS (SELECT dir, name, min(qname) AS qname FROM part_symbols GROUP BY dir, name HAVING count(*) = 1),
u_all AS (SELECT name, min(qname) AS qname FROM part_symbols GROUP BY name HAVING count(*) = 1),
resolved AS (
  SELECT r.ref_id, r.caller_qname, CASE WHEN r.allow_bare THEN coalesce(f.qname, d.qname, a.qname) END AS callee FROM part_refs r
  LEFT JOIN u_file f ON f.file = r.caller_file AND f.name = r.callee_name LEFT JOIN u_dir d ON d.dir = r.caller_dir AND d.name = r.callee_name LEFT JOIN u_all a ON a.name = r.callee_name)"""
