"""Every registered code-graph query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from strataloom.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DIR)
    rel = sql.sql(ORACLES[name])
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    mine = sorted(tuple(map(repr, (r[c] for c in names))) for r in df.collect())
    theirs = sorted(tuple(map(repr, (r[rel.columns.index(c)] for c in names))) for r in rel.fetchall())
    assert mine == theirs


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_supply_graph(spark, sql):
    """The queries of the supply graph leave out no layer: every node is ranked, only customers are without callers, impacts reach customers."""
    nodes = {q for (q,) in sql.sql("SELECT 'c' || o_custkey FROM orders UNION SELECT 'o' || o_orderkey FROM orders UNION SELECT 'p' || l_partkey FROM lineitem UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'r' || n_regionkey FROM nation").fetchall()}
    ranks = {r.qname: r["rank"] for r in QUERIES["g1_pagerank_dangling"](spark, DIR).collect()}
    assert set(ranks) == nodes and sum(ranks.values()) == pytest.approx(1, abs=1e-4)
    assert {r.qname[0] for r in QUERIES["g8_dead_code"](spark, DIR).collect()} == {"c"}
    reach = "l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)"
    ((want,),) = sql.sql(f"SELECT (SELECT count(*) FROM supplier WHERE s_nationkey = 3) + count(DISTINCT l_partkey) + (SELECT count(DISTINCT l_orderkey) + count(DISTINCT o_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE {reach})) FROM lineitem WHERE {reach}").fetchall()
    assert {r.qname: r.impacted_count for r in QUERIES["g9_changed_symbols"](spark, DIR).collect()}["n3"] == want


def test_history_cap(spark, sql):
    from strataloom.operators.history import file_history

    commits = spark.createDataFrame([(k, "a", f"2024-01-{9 - k:02}T00:00:00") for k in range(4)], "commit_seq long, author string, date string")
    lines = spark.createDataFrame([(k, "f", 1, 0) for k in range(4)], "commit_seq long, path string, adds int, dels int")
    assert [file_history(commits, lines, n).first().commits for n in (3, -1)] == [3, 4]
    ((orders, additions),) = sql.sql("SELECT count(DISTINCT l_orderkey), sum(l_quantity::INTEGER) FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey").fetchall()
    assert orders > 1000 and sum(r.additions for r in QUERIES["a1_history"](spark, DIR).collect()) == additions


@pytest.fixture(scope="module")
def old_churn(tmp_path_factory):
    """1,200 orders, newest first: the newest 100 change part 1, the 200 oldest part 2; no line refers to a symbol."""
    d = tmp_path_factory.mktemp("old_churn")
    tables = {
        "orders": "SELECT k AS o_orderkey, k % 7 AS o_custkey, TIMESTAMP '2024-01-01' - to_days(k::INTEGER) AS o_orderdate FROM range(1200) t(k)",
        "lineitem": "SELECT k AS l_orderkey, CASE WHEN k < 100 THEN 1 ELSE 2 END::BIGINT AS l_partkey, 5 AS l_linenumber, 1.0::DOUBLE AS l_quantity FROM range(1200) t(k) WHERE k < 100 OR k >= 1000",
        "part": "SELECT k AS p_partkey, 'nut' AS p_name, 'B' || k AS p_brand, 'T' AS p_type FROM range(1, 3) t(k)",
        "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name",
    }
    for name, rows in tables.items():
        duckdb.sql(f"COPY ({rows}) TO '{d}/{name}.parquet'")
    return str(d)


def test_blended_scores_count_old_orders(spark, old_churn):
    got = {r.qname: (r.callers, r.churn, r.score) for r in QUERIES["f10_blended_scores"](spark, old_churn).collect()}
    assert got == {"B1/T::nut#1": (0, 100, round(0.3 * math.log(101) / math.log(201), 6)), "B2/T::nut#2": (0, 200, 0.3), "geo/nation::N": (0, 0, 0.0)}


def test_repo_map_ranks_by_old_orders(spark, old_churn):
    got = {r.position: r.qname for r in QUERIES["w5_repo_map"](spark, old_churn).collect()}
    assert got == {1: "B2/T::nut#2", 2: "B1/T::nut#1", 3: "geo/nation::N"}


def test_repo_map_text_shows_old_orders(spark, old_churn):
    want = "B2/T\n  :2     function nut  (churn: 200)\nB1/T\n  :1     function nut  (churn: 100)\ngeo/nation\n  :1     function N\n"
    assert QUERIES["k6_repo_map_text"](spark, old_churn).first().map == want
