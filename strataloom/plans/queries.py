"""Registered queries of the code-graph operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..functions.storage import materialised
from ..operators import changes, graph, history, ranking, resolve
from ..sources import recon
from . import relations as R
from . import tools

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str = "", recursive: bool = False, *uses: str):
    """Registers a query. uses: the derived relations that its SQL reads; sql goes on with relations of its own or with SELECT."""

    def add(f):
        QUERIES[name] = f
        own = not sql.lstrip(", ").startswith("SELECT")
        if sql and (uses or own):
            ORACLES[name] = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([*uses, sql.lstrip(", ")] if own else uses) + ("" if own else f"\n{sql}")
        elif sql:
            ORACLES[name] = sql
        return f

    return add


def _seeds(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "seed string")


# ---- graph -----------------------------------------------------------------------------------------

_REACH = """reach(node, depth) AS (
  SELECT src, 1 FROM {edges} WHERE dst = '{seed}' UNION SELECT e.src, r.depth + 1 FROM reach r JOIN {edges} e ON e.dst = r.node WHERE r.depth < {most})
SELECT node AS qname, min(depth)::INTEGER AS depth FROM reach GROUP BY node"""


@query("g2_impact_supply", _REACH.format(edges="supply_edges", seed="r1", most=6), True, R.SUPPLY_EDGES)
def impact_supply(spark, d):
    return graph.impact(R.supply_edges(spark, d), _seeds(spark, "r1")).select(F.col("node").alias("qname"), "depth")


@query(
    "g2_impact_cyclic",
    "reach(node) AS (SELECT src FROM event_edges WHERE dst = 'click#0' UNION SELECT e.src FROM reach r JOIN event_edges e ON e.dst = r.node) SELECT node AS qname FROM reach",
    True,
    R.EVENT_EDGES,
)
def impact_cyclic(spark, d):
    return graph.impact(R.event_edges(spark, d), _seeds(spark, "click#0")).select(F.col("node").alias("qname"))


@query(
    "g3_impact_tool",
    """reach(node) AS (SELECT src FROM event_edges WHERE dst = 'click#0' UNION SELECT e.src FROM reach r JOIN event_edges e ON e.dst = r.node)
SELECT (SELECT count(DISTINCT src) FROM event_edges WHERE dst = 'click#0')::BIGINT AS direct_callers, count(*)::BIGINT AS impacted_count,
  count(*) FILTER (WHERE split_part(node, '#', 2)::INTEGER >= 40)::BIGINT AS at_risk_tests FROM reach""",
    True,
    R.EVENT_EDGES,
)
def impact_tool(spark, d):
    edges = R.event_edges(spark, d)
    symbols = R.event_symbols(spark, d)
    behind = graph.impact(edges, ranking.find_symbols(symbols, "click#0").select(F.col("qname").alias("seed")).limit(1))
    flags = symbols.select(F.col("qname").alias("node"), "test")
    rows = behind.join(flags, "node", "left")
    return rows.agg(F.count_if(F.col("depth") == 1).alias("direct_callers"), F.count("*").alias("impacted_count"), F.count_if(P.is_test_qname(F.col("node"), F.col("test"))).alias("at_risk_tests"))


def _pagerank_sql(edges: str, jump: str) -> str:
    return f"""nodes AS (SELECT src AS q FROM {edges} UNION SELECT dst FROM {edges}),
total AS (SELECT count(*)::DOUBLE AS n FROM nodes),
deg AS (SELECT src, count(*)::DOUBLE AS d FROM {edges} GROUP BY src),
jump AS (SELECT q, {jump} AS j FROM nodes),
pr(it, q, r) AS (
  SELECT 0, q, 1.0::DOUBLE / n FROM nodes, total
  UNION ALL
  SELECT it, q, r FROM (
    WITH cur AS (SELECT * FROM pr),
    lost AS (SELECT coalesce(sum(r), 0) AS x FROM cur WHERE q NOT IN (SELECT src FROM deg)),
    flow AS (SELECT e.dst AS q, sum(c.r / g.d) AS x FROM cur c JOIN {edges} e ON e.src = c.q JOIN deg g ON g.src = c.q GROUP BY e.dst)
    SELECT c.it + 1 AS it, c.q, 0.15 * j.j + 0.85 * (coalesce(f.x, 0) + l.x * j.j) AS r
    FROM cur c JOIN jump j USING (q) LEFT JOIN flow f USING (q), lost l WHERE c.it < 50))
SELECT q AS qname, round(r, 6) AS rank FROM pr WHERE it = 50"""


@query("g1_pagerank", _pagerank_sql("event_edges", "1.0 / (SELECT n FROM total)"), True, R.EVENT_EDGES)
def pagerank(spark, d):
    return graph.pagerank(R.event_edges(spark, d)).select("qname", F.round("rank", 6).alias("rank"))


_FOCUS = "CASE WHEN q LIKE 'click#%' THEN 1.0 / (SELECT count(*) FROM nodes WHERE q LIKE 'click#%') ELSE 0 END"


@query("g1_pagerank_focus", _pagerank_sql("event_edges", _FOCUS), True, R.EVENT_EDGES)
def pagerank_focus(spark, d):
    symbols = R.event_symbols(spark, d)
    focus = graph.expand_seeds(symbols, _seeds(spark, "click"))
    return graph.pagerank(R.event_edges(spark, d), seeds=focus).select("qname", F.round("rank", 6).alias("rank"))


@query("g1_pagerank_dangling", _pagerank_sql("supply_edges", "1.0 / (SELECT n FROM total)").replace("round(r, 6)", "round(r, 8)"), True, R.SUPPLY_EDGES)
def pagerank_dangling(spark, d):
    return graph.pagerank(R.supply_edges(spark, d)).select("qname", F.round("rank", 8).alias("rank"))


@query(
    "g5_neighborhood",
    """both_ways AS (SELECT src, dst FROM supply_edges UNION SELECT dst, src FROM supply_edges),
near(q, h) AS (SELECT 's1', 0 UNION SELECT b.dst, n.h + 1 FROM near n JOIN both_ways b ON b.src = n.q WHERE n.h < 2)
SELECT q AS qname, min(h)::INTEGER AS distance FROM near GROUP BY q""",
    True,
    R.SUPPLY_EDGES,
)
def neighborhood(spark, d):
    return graph.neighborhood(R.supply_edges(spark, d, distinct=False), _seeds(spark, "s1"))


@query(
    "g4_trace_flow",
    """lv(q, depth) AS (SELECT 'o1', 0 UNION SELECT e.dst, v.depth + 1 FROM lv v JOIN supply_edges e ON e.src = v.q WHERE v.depth < 4),
first_seen AS (SELECT q, min(depth) AS depth FROM lv GROUP BY q),
p1 AS (SELECT q, row_number() OVER (ORDER BY q) AS pos FROM first_seen WHERE depth = 1),
p2 AS (SELECT f.q, row_number() OVER (ORDER BY min(p.pos), f.q) AS pos FROM first_seen f JOIN supply_edges e ON e.dst = f.q JOIN p1 p ON p.q = e.src WHERE f.depth = 2 GROUP BY f.q),
p3 AS (SELECT f.q, row_number() OVER (ORDER BY min(p.pos), f.q) AS pos FROM first_seen f JOIN supply_edges e ON e.dst = f.q JOIN p2 p ON p.q = e.src WHERE f.depth = 3 GROUP BY f.q),
p4 AS (SELECT f.q, row_number() OVER (ORDER BY min(p.pos), f.q) AS pos FROM first_seen f JOIN supply_edges e ON e.dst = f.q JOIN p3 p ON p.q = e.src WHERE f.depth = 4 GROUP BY f.q),
ranked AS (SELECT 'o1' AS q, 0 AS depth, 0 AS pos UNION ALL SELECT q, 1, pos FROM p1 UNION ALL SELECT q, 2, pos FROM p2 UNION ALL SELECT q, 3, pos FROM p3 UNION ALL SELECT q, 4, pos FROM p4)
SELECT r.q AS qname, depth::INTEGER AS depth, row_number() OVER (ORDER BY depth, pos)::BIGINT AS position, (SELECT count(*) FROM supply_edges e WHERE e.src = r.q)::BIGINT AS n_callees
FROM ranked r QUALIFY position <= 250""",
    True,
    R.SUPPLY_EDGES,
)
def trace_flow(spark, d):
    rows, _ = graph.trace(R.supply_edges(spark, d), _seeds(spark, "o1"))
    return rows.select("qname", "depth", "position", F.size("callees").cast("long").alias("n_callees"))


@query("a2_callers", "SELECT dst AS qname, string_agg(src, ',' ORDER BY src) AS callers FROM event_edges GROUP BY dst", False, R.EVENT_EDGES)
def callers(spark, d):
    return graph.callers(R.event_edges(spark, d)).select("qname", F.array_join("callers", ",").alias("callers"))


@query("a2_callees", "SELECT src AS qname, string_agg(dst, ',' ORDER BY dst) AS callees FROM event_edges GROUP BY src", False, R.EVENT_EDGES)
def callees(spark, d):
    return graph.callees(R.event_edges(spark, d)).select("qname", F.array_join("callees", ",").alias("callees"))


@query("a3_caller_counts", "SELECT dst AS qname, count(DISTINCT src)::BIGINT AS callers FROM supply_edges GROUP BY dst", False, R.SUPPLY_EDGES)
def caller_counts(spark, d):
    return graph.caller_counts(R.supply_edges(spark, d))


@query("u1_node_set", "SELECT src AS qname FROM supply_edges UNION SELECT dst FROM supply_edges", False, R.SUPPLY_EDGES)
def node_set(spark, d):
    return graph.node_set(R.supply_edges(spark, d, distinct=False), tasks=R.supply_tasks(spark, d))


@query(
    "u6_precise_edges",
    """, precise AS (SELECT DISTINCT src, dst FROM event_edges WHERE src LIKE 'view%' UNION SELECT DISTINCT dst, src FROM event_edges WHERE src LIKE 'error%' AND src <> dst)
SELECT src, dst, bool_or(proven) AS proven FROM (SELECT src, dst, false AS proven FROM event_edges UNION ALL SELECT src, dst, true FROM precise) GROUP BY src, dst""",
    False,
    R.EVENT_EDGES,
)
def precise_edges(spark, d):
    edges = R.event_edges(spark, d)
    precise = edges.where("src LIKE 'view%'").union(graph.reverse(edges.where("src LIKE 'error%'")))
    return graph.with_precise(edges.withColumn("proven", F.lit(False)), precise)


@query(
    "j16_precise_mapping",
    """SELECT DISTINCT a.qname AS src, b.qname AS dst FROM event_edges e JOIN event_symbols a ON a.qname = e.src JOIN event_symbols b ON b.qname = e.dst""",
    False,
    R.EVENT_EDGES,
    R.EVENT_SYMBOLS,
)
def precise_mapping(spark, d):
    s, e = R.event_symbols(spark, d), R.event_edges(spark, d)
    side = lambda p: s.select(F.col("qname").alias(p), F.col("file").alias(f"{p}_file"), F.col("line").alias(f"{p}_line"), F.col("name").alias(f"{p}_name"))
    rows = e.select(F.col("src").alias("caller"), F.col("dst").alias("callee")).join(side("caller"), "caller").join(side("callee"), "callee").drop("caller", "callee")
    return graph.map_precise(s, rows, "name")


# ---- resolution -------------------------------------------------------------------------------------


def _resolved(spark, d):
    none = spark.createDataFrame([], "file string, alias string, target_file string, target_name string")
    return resolve.resolve(R.part_refs(spark, d), R.part_symbols(spark, d), none, R.line_tasks(spark, d))


@query("j0_resolution", "SELECT ref_id, caller_qname, callee FROM resolved", False, R.PART_SYMBOLS)
def resolution(spark, d):
    return _resolved(spark, d).select("ref_id", "caller_qname", "callee")


@query("g11_assembled_edges", "SELECT DISTINCT caller_qname AS src, callee AS dst FROM resolved WHERE callee IS NOT NULL AND callee <> caller_qname", False, R.PART_SYMBOLS)
def assembled_edges(spark, d):
    return resolve.edges_of(_resolved(spark, d)).select("src", "dst")


@query("a4_unresolved", "SELECT count(*) FILTER (WHERE callee IS NULL)::BIGINT AS unresolved FROM resolved", False, R.PART_SYMBOLS)
def unresolved(spark, d):
    return resolve.unresolved_count(_resolved(spark, d))


@query(
    "j9_unique_names",
    "SELECT 'file' AS scope, count(*)::BIGINT AS n FROM u_file UNION ALL SELECT 'dir', count(*) FROM u_dir UNION ALL SELECT 'all', count(*) FROM u_all",
    False,
    R.PART_SYMBOLS,
)
def unique_names(spark, d):
    s = R.part_symbols(spark, d).withColumn("dir", S.dirname(F.col("file")))
    counted = lambda scope, *keys: resolve.unique_by(s, list(keys), "q").agg(F.lit(scope).alias("scope"), F.count("*").alias("n"))
    return counted("file", "file", "name").unionByName(counted("dir", "dir", "name")).unionByName(counted("all", "name"))


@query(
    "w1_unique_qnames",
    """SELECT event_id, user_id || '::' || event_type || CASE WHEN nth = 1 THEN '' WHEN again = 1 THEN '#' || line ELSE '#' || line || '.' || again END AS qname FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type, line, nth > 1 ORDER BY event_id) AS again FROM (
    SELECT *, (extract(day FROM ts) % 9)::INTEGER AS line, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events))""",
)
def unique_qnames(spark, d):
    tags = R.read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("name"), (F.dayofmonth("ts") % 9).cast("int").alias("line"), F.col("event_id").alias("seq"))
    return resolve.numbered_qnames(tags).select("event_id", "qname")


@query(
    "j13_innermost",
    """, spans AS (SELECT file, qname, line AS s, line + 6 + length(qname) AS e, line AS seq FROM definitions WHERE kind <> 'view'),
refs AS (SELECT qname AS ref, file, line + 2 AS s, line + 3 AS e FROM definitions WHERE kind = 'view')
SELECT r.ref AS ref_id, coalesce(arg_min(p.qname, ((p.e - p.s) * 1000000 + p.seq) * 10000000 + substr(p.qname, 2)::BIGINT), r.file || '::(top-level)') AS qname
FROM refs r LEFT JOIN spans p ON p.file = r.file AND p.s <= r.s AND r.e <= p.e GROUP BY r.ref, r.file""",
    False,
    R.DEFINITIONS,
)
def innermost(spark, d):
    defs = R.definitions(spark, d)
    spans = defs.where("kind <> 'view'").select("file", "qname", F.col("line").alias("start"), (F.col("line") + 6 + F.length("qname")).alias("end"), F.struct("line", F.expr("cast(substring(qname, 2) as bigint)").alias("id")).alias("seq"))
    refs = defs.where("kind = 'view'").select(F.col("qname").alias("ref_id"), "file", (F.col("line") + 2).alias("start"), (F.col("line") + 3).alias("end"))
    return resolve.innermost(refs, spans).select("ref_id", "qname")


# ---- history, ranking, budgets ------------------------------------------------------------------------


def _history(spark, d):
    return history.file_history(*R.commit_tables(spark, d), max_commits=-1, tasks=R.line_tasks(spark, d))


@query("a1_history", "SELECT * FROM history", False, R.COMMITS, R.HISTORY)
def file_history(spark, d):
    return _history(spark, d)


@query("t5_history_top", "SELECT * FROM history ORDER BY commits DESC, path LIMIT 20", False, R.COMMITS, R.HISTORY)
def history_top(spark, d):
    return history.top_history(_history(spark, d))


def _scored(spark, d):
    """Part symbols by caller count (a stand-in for rank that SQL has too) and the churn of their file in all commits."""
    symbols = R.part_symbols(spark, d).withColumn("kind", F.lit("function")).withColumn("line", F.regexp_extract("qname", r"#(\d+)$", 1).try_cast("int")).withColumn("line", F.coalesce("line", F.lit(1)))
    counts = graph.caller_counts(resolve.edges_of(_resolved(spark, d)))
    ranks = counts.select("qname", F.col("callers").cast("double").alias("rank"))
    return ranking.scored_symbols(symbols, ranks, counts, _history(spark, d), 0.3)


_SCORED = """called AS (SELECT callee AS qname, count(DISTINCT caller_qname)::BIGINT AS callers FROM resolved WHERE callee IS NOT NULL AND callee <> caller_qname GROUP BY callee),
base AS (
  SELECT s.qname, s.name, s.file, coalesce(try_cast(regexp_extract(s.qname, '#([0-9]+)$', 1) AS INTEGER), 1) AS line, coalesce(c.callers, 0) AS callers, coalesce(h.commits, 0) AS churn
  FROM part_symbols s LEFT JOIN called c USING (qname) LEFT JOIN history h ON h.path = s.file),
scored AS (
  SELECT *, 0.7 * (CASE WHEN max(callers) OVER () > 0 THEN callers::DOUBLE / max(callers) OVER () ELSE 0 END)
    + 0.3 * (CASE WHEN max(churn) OVER () > 0 THEN ln(1 + churn::DOUBLE) / ln(1 + max(churn) OVER ()::DOUBLE) ELSE 0 END) AS score FROM base)"""


@query("f10_blended_scores", "SELECT qname, callers, churn, round(score, 6) AS score FROM scored", False, R.PART_SYMBOLS, R.COMMITS, R.HISTORY, _SCORED)
def blended_scores(spark, d):
    return _scored(spark, d).select("qname", "callers", "churn", F.round("score", 6).alias("score"))


_LINE = """'  :' || rpad(line::VARCHAR, greatest(5, length(line::VARCHAR))::INTEGER, ' ') || ' function ' || name
  || CASE WHEN callers > 0 AND churn > 0 THEN '  (callers: ' || callers || ', churn: ' || churn || ')' WHEN callers > 0 THEN '  (callers: ' || callers || ')' WHEN churn > 0 THEN '  (churn: ' || churn || ')' ELSE '' END || chr(10)"""
_CHOSEN = f"""lined AS (SELECT qname, file, line, round(score, 9) AS score, callers, {_LINE} AS text FROM scored),
costed AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, callers DESC, qname) AS position,
    greatest(1, strlen(text) // 4) + CASE WHEN row_number() OVER (PARTITION BY file ORDER BY score DESC, callers DESC, qname) = 1 THEN greatest(1, (strlen(file) + 1) // 4) ELSE 0 END AS cost FROM lined),
chosen AS (SELECT * FROM (SELECT *, sum(cost) OVER (ORDER BY position) AS total FROM costed) WHERE position = 1 OR total <= 1000)"""


def _chosen(spark, d):
    return ranking.repo_map(_scored(spark, d).withColumn("score", F.round("score", 9)), 1000)


@query("w5_repo_map", "SELECT qname, position::INTEGER AS position FROM chosen", False, R.PART_SYMBOLS, R.COMMITS, R.HISTORY, _SCORED, _CHOSEN)
def repo_map(spark, d):
    return _chosen(spark, d).select("qname", "position")


@query(
    "k6_repo_map_text",
    """SELECT string_agg(block, '' ORDER BY best) AS map FROM (SELECT min(position) AS best, file || chr(10) || string_agg(text, '' ORDER BY line, position) AS block FROM chosen GROUP BY file)""",
    False,
    R.PART_SYMBOLS,
    R.COMMITS,
    R.HISTORY,
    _SCORED,
    _CHOSEN,
)
def repo_map_text(spark, d):
    return ranking.repo_map_text(_chosen(spark, d))


@query(
    "w6_document_budget",
    """SELECT doc_id, position::INTEGER AS position FROM (
  SELECT doc_id, row_number() OVER w AS position, sum(greatest(1, strlen(text) // 4)) OVER w AS total FROM documents WINDOW w AS (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))
WHERE position = 1 OR total <= 40000""",
)
def document_budget(spark, d):
    return ranking.within_budget(R.read(spark, d, "documents"), [F.desc("n_chars"), F.asc("doc_id")], S.tokens_of(F.col("text")), 40_000).select("doc_id", "position")


@query("f9_token_estimates", "SELECT doc_id, greatest(1, strlen(text) // 4)::INTEGER AS tokens FROM documents")
def token_estimates(spark, d):
    return R.read(spark, d, "documents").select("doc_id", S.tokens_of(F.col("text")).alias("tokens"))


@query(
    "f11_pack_scores",
    """, both_ways AS (SELECT src, dst FROM event_edges UNION SELECT dst, src FROM event_edges),
near AS (SELECT 'click#0' AS q, 0 AS h UNION SELECT dst, 1 FROM both_ways WHERE src = 'click#0' UNION SELECT b2.dst, 2 FROM both_ways b1 JOIN both_ways b2 ON b1.dst = b2.src WHERE b1.src = 'click#0'),
hops AS (SELECT q, min(h) AS h FROM near GROUP BY q),
calls AS (SELECT dst AS q, count(DISTINCT src) AS c FROM event_edges GROUP BY dst)
SELECT hops.q AS qname, h::INTEGER AS distance, round(0.5 ** h * (1 + coalesce(c, 0)::DOUBLE / (SELECT max(c) FROM calls)), 6) AS score FROM hops LEFT JOIN calls USING (q)""",
    False,
    R.EVENT_EDGES,
)
def pack_scores(spark, d):
    edges, symbols = R.event_edges(spark, d), R.event_symbols(spark, d)
    counts = graph.caller_counts(edges)
    scored = ranking.scored_symbols(symbols, counts.select("qname", F.col("callers").cast("double").alias("rank")), counts, None)
    near = graph.neighborhood(edges, _seeds(spark, "click#0"))
    return ranking.pack_candidates(near, scored).select("qname", "distance", F.round("score", 6).alias("score"))


@query(
    "f17_snippets",
    """, marks AS (SELECT doc_id, unnest([1, 4, 9, 400]) AS line FROM documents),
ends AS (SELECT m.*, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM marks m),
cut AS (SELECT e.doc_id, line, nxt, string_split(text, chr(10)) AS ls FROM ends e JOIN documents USING (doc_id))
SELECT doc_id, line::INTEGER AS line, CASE WHEN line <= len(ls) THEN least(line + 39, coalesce(nxt - 1, 2147483647), len(ls)) ELSE line END::INTEGER AS end_line,
  md5(CASE WHEN line <= len(ls) THEN array_to_string(ls[line : least(line + 39, coalesce(nxt - 1, 2147483647), len(ls))], chr(10)) ELSE '' END) AS snippet_md5 FROM cut""",
    False,
)
def snippets(spark, d):
    docs = R.read(spark, d, "documents")
    marks = docs.select("doc_id", F.col("doc_id").cast("string").alias("file"), F.explode(F.array(*map(F.lit, (1, 4, 9, 400)))).alias("line"))
    files = docs.select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    return ranking.snippets(marks, marks, files).select("doc_id", "line", F.col("end_line").cast("int").alias("end_line"), F.md5("snippet").alias("snippet_md5"))


@query(
    "p1_find_symbols",
    """SELECT qname, CASE WHEN name = 'click' THEN 0 ELSE 1 END AS tier FROM event_symbols WHERE name = 'click' OR qname = 'click' OR contains(qname, 'click')""",
    False,
    R.EVENT_EDGES,
    R.EVENT_SYMBOLS,
)
def find_symbols(spark, d):
    return ranking.find_symbols(R.event_symbols(spark, d), "click").select("qname", "tier")


@query("p2_resolve_seed", "SELECT qname FROM event_symbols WHERE contains(file, 'g3/') OR contains(qname, 'g3/')", False, R.EVENT_EDGES, R.EVENT_SYMBOLS)
def resolve_seed(spark, d):
    return ranking.resolve_seed(R.event_symbols(spark, d), "g3/").select("qname")


@query("p3_expand_seeds", "SELECT qname FROM event_symbols WHERE qname IN ('click#0', 'g3/u3.go', 'view') OR file IN ('click#0', 'g3/u3.go', 'view') OR name IN ('click#0', 'g3/u3.go', 'view')", False, R.EVENT_EDGES, R.EVENT_SYMBOLS)
def expand_seeds(spark, d):
    return graph.expand_seeds(R.event_symbols(spark, d), _seeds(spark, "click#0", "g3/u3.go", "view"))


# ---- changes ------------------------------------------------------------------------------------------


@query(
    "j14_touched_symbols",
    """SELECT qname FROM (
  SELECT *, CASE WHEN nxt IS NOT NULL THEN greatest(nxt - 1, line) END AS last_line FROM (SELECT *, lead(line) OVER (PARTITION BY file ORDER BY line, qname) AS nxt FROM definitions)) d
WHERE EXISTS (SELECT 1 FROM hunks h WHERE h.path = d.file AND h.e >= d.line AND (d.last_line IS NULL OR h.s <= d.last_line))""",
    False,
    R.DEFINITIONS,
    R.HUNKS,
)
def touched(spark, d):
    defs = R.definitions(spark, d)
    return changes.touched(defs, R.hunks(defs)).select("qname")


@query("j15_next_definition", "SELECT file, line, lead(line) OVER (PARTITION BY file ORDER BY line) AS next_line FROM (SELECT DISTINCT file, line FROM definitions)", False, R.DEFINITIONS)
def next_definition(spark, d):
    return ranking.next_definition(R.definitions(spark, d))


@query("a12_hunk_counts", "SELECT path, count(*)::BIGINT AS hunks FROM hunks GROUP BY path", False, R.DEFINITIONS, R.HUNKS)
def hunk_counts(spark, d):
    found = R.hunks(R.definitions(spark, d))
    return tools.listed_changes(found.select("path", F.lit("M").alias("status")).distinct(), found).select("path", "hunks")


_LAYERS = """layers AS (SELECT DISTINCT src, dst FROM supply_edges),
layer_symbols AS (SELECT q AS qname, CASE q[1] WHEN 'c' THEN 'customers/f' || (substr(q, 2)::BIGINT % 3) WHEN 'o' THEN 'orders/f' || (substr(q, 2)::BIGINT % 11)
    WHEN 'p' THEN 'parts/f' || (substr(q, 2)::BIGINT % 7) WHEN 's' THEN 'suppliers/f' || (substr(q, 2)::BIGINT % 5) ELSE 'places/f' || q[1] END || '.go' AS file,
  substr(q, 2)::INTEGER AS line FROM (SELECT src AS q FROM layers UNION SELECT dst FROM layers))"""


def _layers(spark, d):
    edges = materialised(R.supply_edges(spark, d))
    q = graph.node_set(edges, tasks=R.supply_tasks(spark, d))
    first, number = F.substring("qname", 1, 1), F.expr("cast(substring(qname, 2) as bigint)")
    folder = F.when(first == "c", F.concat(F.lit("customers/f"), (number % 3).cast("string"))).when(first == "o", F.concat(F.lit("orders/f"), (number % 11).cast("string")))
    folder = folder.when(first == "p", F.concat(F.lit("parts/f"), (number % 7).cast("string"))).when(first == "s", F.concat(F.lit("suppliers/f"), (number % 5).cast("string"))).otherwise(F.concat(F.lit("places/f"), first))
    at = materialised(q.select("qname", F.concat(folder, F.lit(".go")).alias("file"), number.cast("int").alias("line")))
    symbols = at.select("qname", "file", "line", F.col("qname").alias("name"), F.lit("function").alias("kind"), F.lit("go").alias("lang"), F.lit("").alias("recv"), F.lit(False).alias("test"), F.lit(False).alias("public"))
    return edges, symbols


_CHANGED = """hunk(path, s, e) AS (SELECT 'suppliers/f2.go', 1, 40 UNION ALL SELECT 'places/fn.go', 3, 8),
ext AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN greatest(nxt - 1, line) END AS last_line FROM (SELECT *, lead(line) OVER (PARTITION BY file ORDER BY line, qname) AS nxt FROM layer_symbols)),
hit AS (SELECT qname, file, line FROM ext d WHERE EXISTS (SELECT 1 FROM hunk h WHERE h.path = d.file AND h.e >= d.line AND (d.last_line IS NULL OR h.s <= d.last_line))),
behind(seed, node, depth) AS (SELECT h.qname, l.src, 1 FROM hit h JOIN layers l ON l.dst = h.qname UNION SELECT b.seed, l.src, b.depth + 1 FROM behind b JOIN layers l ON l.dst = b.node WHERE b.depth < 6)
SELECT h.qname, h.file, h.line, count(DISTINCT b.node)::BIGINT AS impacted_count, count(DISTINCT CASE WHEN b.depth = 1 THEN b.node END)::BIGINT AS direct_callers
FROM hit h LEFT JOIN behind b ON b.seed = h.qname GROUP BY h.qname, h.file, h.line ORDER BY impacted_count DESC, h.file, h.line, h.qname LIMIT 50"""


def _changed(spark, edges, symbols):
    hunks = spark.createDataFrame([("suppliers/f2.go", 1, 40), ("places/fn.go", 3, 8)], "path string, start int, end int")
    rows, _ = changes.changed_symbols(symbols, edges, hunks)
    return rows.select("qname", "file", "line", "impacted_count", "direct_callers").orderBy(F.desc("impacted_count"), "file", "line", "qname").limit(50)


@query("g9_changed_symbols", _CHANGED, True, R.SUPPLY_EDGES, _LAYERS)
def changed_symbols(spark, d):
    return _changed(spark, *_layers(spark, d))


_ORPHANS = """SELECT qname, file, line, 'high' AS confidence FROM layer_symbols s WHERE NOT EXISTS (SELECT 1 FROM layers l WHERE l.dst = s.qname) ORDER BY file, line, qname LIMIT 50"""


@query("g8_dead_code", _ORPHANS, False, R.SUPPLY_EDGES, _LAYERS)
def dead_code(spark, d):
    edges, symbols = _layers(spark, d)
    return changes.ordered_orphans(changes.dead_code(symbols, edges, tasks=R.supply_tasks(spark, d))).select("qname", "file", "line", "confidence")


_DIRS = """dir_edges AS (
  SELECT regexp_extract(a.file, '^(.*)/', 1) AS from_dir, regexp_extract(b.file, '^(.*)/', 1) AS to_dir, count(*)::BIGINT AS calls
  FROM event_edges e JOIN event_symbols a ON a.qname = e.src JOIN event_symbols b ON b.qname = e.dst WHERE from_dir <> to_dir GROUP BY ALL)"""


@query("j27_directory_edges", "SELECT * FROM dir_edges", False, R.EVENT_EDGES, R.EVENT_SYMBOLS, _DIRS)
def directory_edges(spark, d):
    return changes.directory_edges(R.event_edges(spark, d), R.event_symbols(spark, d))


@query(
    "a8_directory_map",
    """, degree AS (SELECT dir, sum(calls)::BIGINT AS degree FROM (SELECT from_dir AS dir, calls FROM dir_edges UNION ALL SELECT to_dir, calls FROM dir_edges) GROUP BY dir)
SELECT dir, count(DISTINCT file)::BIGINT AS files, coalesce(any_value(degree), 0)::BIGINT AS degree FROM (SELECT regexp_extract(file, '^(.*)/', 1) AS dir, file FROM event_symbols) LEFT JOIN degree USING (dir)
GROUP BY dir ORDER BY 3 DESC, 1 LIMIT 5""",
    False,
    R.EVENT_EDGES,
    R.EVENT_SYMBOLS,
    _DIRS,
)
def directory_map(spark, d):
    return changes.directory_map(R.event_edges(spark, d), R.event_symbols(spark, d), 5)[0]


@query("j19_without_callers", "SELECT DISTINCT src AS qname FROM supply_edges WHERE src NOT IN (SELECT dst FROM supply_edges)", False, R.SUPPLY_EDGES)
def without_callers(spark, d):
    return graph.without_callers(R.supply_edges(spark, d, distinct=False), R.supply_tasks(spark, d))


# ---- texts and paths ----------------------------------------------------------------------------------


@query("f8_url_parts", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir FROM pages")
def url_parts(spark, d):
    return R.read(spark, d, "pages").select("page_id", S.basename(F.col("url")).alias("base"), S.dirname(F.col("url")).alias("dir"))


@query(
    "s21_template_refs",
    """SELECT page_id, attribute, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '([a-z-]+)="[^"]*"', 1)) AS attribute FROM pages) GROUP BY ALL""",
)
def template_refs(spark, d):
    p = R.read(spark, d, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('([a-z-]+)="[^"]*"'))).alias("attribute")).groupBy("page_id", "attribute").agg(F.count("*").alias("n"))


@query(
    "a9_extensions",
    """SELECT ext, count(*)::BIGINT AS n FROM (SELECT lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\\.[^.]*)$', 1)) AS ext FROM pages) WHERE ext <> '' GROUP BY ext ORDER BY n DESC, ext LIMIT 3""",
)
def extensions(spark, d):
    return recon.top_extensions(R.read(spark, d, "pages").select(F.col("url").alias("path")))


@query("f4_node_ids", "SELECT part.p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_]', '_', 'g') AS id FROM part")
def node_ids(spark, d):
    return R.read(spark, d, "part").select("p_partkey", S.node_id(F.concat("p_name", F.lit("/"), "p_brand")).alias("id"))


@query(
    "w7_carried_headers",
    """, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT doc_id, (pos - 1)::INTEGER AS pos, last_value(CASE WHEN line LIKE 'T%' THEN pos - 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::INTEGER AS header FROM lines""",
    False,
)
def carried_headers(spark, d):
    lines = R.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", "pos", F.last_value(F.when(F.col("line").startswith("T"), F.col("pos")), ignoreNulls=True).over(w).alias("header"))


@query(
    "w8_clamped_depth",
    """, s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN -2 ELSE 0 END AS step FROM events),
c AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM s)
SELECT event_id, (cum - least(0, min(cum) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS depth FROM c""",
    False,
)
def clamped_depth(spark, d):
    e = R.read(spark, d, "events").withColumn("step", F.when(F.col("event_type").isin("view", "signup"), 1).when(F.col("event_type") == "error", -2).otherwise(0))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = e.withColumn("cum", F.sum("step").over(w))
    return cum.select("event_id", (F.col("cum") - F.least(F.lit(0), F.min("cum").over(w))).alias("depth"))


# ---- predicates, statistics, route paths ----------------------------------------------------------------


@query(
    "a5_graph_stats",
    "SELECT count(DISTINCT file)::BIGINT AS files, count(*)::BIGINT AS definitions, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM event_symbols",
    False,
    R.EVENT_EDGES,
    R.EVENT_SYMBOLS,
)
def graph_stats(spark, d):
    return tools.symbol_totals(R.event_symbols(spark, d), "kind").select("files", "definitions", F.array_join("kinds", ",").alias("kinds"))


@query("t15_precise_candidates", """, calls AS (SELECT dst AS q, count(DISTINCT src) AS c FROM event_edges GROUP BY dst)
SELECT qname, coalesce(c, 0)::BIGINT AS callers FROM event_symbols LEFT JOIN calls ON q = qname ORDER BY coalesce(c, 0) DESC, qname LIMIT 30""", False, R.EVENT_EDGES, R.EVENT_SYMBOLS)  # fmt: skip
def precise_candidates(spark, d):
    counts = graph.caller_counts(R.event_edges(spark, d))
    scored = ranking.scored_symbols(R.event_symbols(spark, d), counts.select("qname", F.col("callers").cast("double").alias("rank")), counts, None)
    return ranking.precise_candidates(scored, counts.select("qname", F.col("callers").alias("impact")), 30).select("qname", "callers")


_PATHS = """paths AS (
  SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'src/x' || user_id || '_test.go' WHEN 1 THEN 'tests/u' || user_id || '.py' WHEN 2 THEN 'a/' || event_type || '.spec.ts' WHEN 3 THEN 'b/Test_' || user_id || '.js'
    WHEN 4 THEN 'benches/b' || user_id || '.rs' WHEN 5 THEN 'benches/b' || user_id || '.go' WHEN 6 THEN 'latest/' || event_type || '.py' WHEN 7 THEN 'e2e/' || event_type || '/x.ts' ELSE 'm/' || event_type || '.tftest.hcl' END AS path FROM events)"""


@query("p4_test_files", "SELECT event_id, event_id % 9 NOT IN (5, 6) AS test FROM paths", False, _PATHS)
def test_files(spark, d):
    e, user, kind = R.read(spark, d, "events"), F.col("user_id").cast("string"), F.col("event_type")
    forms = [
        F.concat(F.lit("src/x"), user, F.lit("_test.go")), F.concat(F.lit("tests/u"), user, F.lit(".py")), F.concat(F.lit("a/"), kind, F.lit(".spec.ts")), F.concat(F.lit("b/Test_"), user, F.lit(".js")), F.concat(F.lit("benches/b"), user, F.lit(".rs")),
        F.concat(F.lit("benches/b"), user, F.lit(".go")), F.concat(F.lit("latest/"), kind, F.lit(".py")), F.concat(F.lit("e2e/"), kind, F.lit("/x.ts")), F.concat(F.lit("m/"), kind, F.lit(".tftest.hcl")),
    ]
    path = F.get(F.array(*forms), (F.col("event_id") % 9).cast("int"))
    return e.select("event_id", P.is_test_file(path).alias("test"))


@query(
    "s47_route_paths",
    """SELECT p_partkey, '/' || CASE p_size % 5 WHEN 0 THEN ':k' || p_size WHEN 1 THEN ':k' || p_size || '*' WHEN 2 THEN 'blog' WHEN 3 THEN 'blog/:k' || p_size ELSE 'v' || p_size END AS path FROM part""",
)
def route_paths(spark, d):
    from ..sources.routes import next_app_path

    size = F.col("p_size").cast("string")
    forms = [F.concat(F.lit("["), F.lit("k"), size, F.lit("]")), F.concat(F.lit("[...k"), size, F.lit("]")), F.lit("(group)/blog"), F.concat(F.lit("blog/@slot/[k"), size, F.lit("=int]")), F.concat(F.lit("_private/v"), size)]
    path = F.concat(F.lit("src/app/"), F.get(F.array(*forms), (F.col("p_size") % 5).cast("int")), F.lit("/page.tsx"))
    return R.read(spark, d, "part").select("p_partkey", next_app_path(path).alias("path"))


@query(
    "f3_identifiers",
    """SELECT n_nationkey, n_name AS name FROM nation""",
)
def identifiers(spark, d):
    quoted = F.concat(F.lit('"public".['), "n_name", F.lit("]"))
    return R.read(spark, d, "nation").select("n_nationkey", S.clean_identifier(quoted).alias("name"))


@query(
    "f16_json_fields",
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
)
def json_fields(spark, d):
    return R.read(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("p10_confidence", """SELECT s.qname, CASE WHEN s.kind = 'method' THEN 'low' WHEN s.name < 'd' THEN 'high' ELSE 'medium' END AS confidence FROM event_symbols s""", False, R.EVENT_EDGES, R.EVENT_SYMBOLS)
def confidence(spark, d):
    s = R.event_symbols(spark, d)
    name = F.when(F.col("name") < "d", F.col("name")).otherwise(F.initcap("name"))
    exported = P.is_exported(F.col("lang"), name, F.col("public"))
    return s.select("qname", P.orphan_confidence(P.callable_kind(F.col("kind"), F.col("recv")), exported, False).alias("confidence"))
