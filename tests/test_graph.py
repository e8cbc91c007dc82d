import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import changes, graph, history, ranking, resolve

RANK4 = [("app.go::Run", "app.go::helper"), ("app.go::Main", "app.go::Run"), ("app_test.go::TestRun", "app.go::Run")]


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def seeds_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def symbols_of(spark, rows):
    """(qname, file, line[, kind, lang, recv, public])"""
    full = [(q, q.split("::")[-1].split("#")[0], (r[0] if len(r) > 0 else "function"), f, n, (r[1] if len(r) > 1 else "go"), (r[2] if len(r) > 2 else ""), False, (r[3] if len(r) > 3 else False)) for q, f, n, *r in rows]
    return spark.createDataFrame(full, "qname string, name string, kind string, file string, line int, lang string, recv string, test boolean, public boolean")


def test_pagerank_order_mass_and_focus(spark):
    e = edges_of(spark, RANK4)
    r = {x.qname: x["rank"] for x in graph.pagerank(e).collect()}
    assert r["app.go::helper"] > r["app.go::Run"] > r["app.go::Main"] == pytest.approx(r["app_test.go::TestRun"])
    assert sum(r.values()) == pytest.approx(1)
    seeds = spark.createDataFrame([("app_test.go::TestRun",)], "qname string")
    focused = {x.qname: x["rank"] for x in graph.pagerank(e, seeds=seeds).collect()}
    assert focused["app_test.go::TestRun"] > r["app_test.go::TestRun"]
    assert sum(focused.values()) == pytest.approx(1)


def test_pagerank_in_one_task_and_by_joins(spark):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)} | {("n1", "sink"), ("n2", "sink")})
    for rows in (pairs, [(a, b) for a, b in pairs if b != "sink"] + [(f"n{k}", f"n{(k + 1) % 40}") for k in range(40)]):
        e = spark.createDataFrame(sorted({(a, b) for a, b in rows if a != b}), "src string, dst string")
        for seeds in (None, spark.createDataFrame([("n3",), ("n4",)], "qname string")):
            one = {r.qname: r["rank"] for r in graph.pagerank(e, seeds=seeds, rounds=7).collect()}
            many = {r.qname: r["rank"] for r in graph.pagerank(e, seeds=seeds, rounds=7, every=3, one_task=0).collect()}
            assert one == pytest.approx(many) and sum(one.values()) == pytest.approx(1)


def test_pagerank_goes_on_after_the_rounds_kept_apart(spark):
    rng = random.Random(6)
    rows = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)} | {("n1", "sink")})
    e = spark.createDataFrame([(a, b) for a, b in rows if a != b], "src string, dst string")
    ring = spark.createDataFrame([(f"n{k}", f"n{(k + s) % 20}") for k in range(20) for s in (1, 3)], "src string, dst string")
    for edges in (e, ring):
        for seeds in (None, spark.createDataFrame([("n3",), ("n4",)], "qname string")):
            one = {r.qname: r["rank"] for r in graph.pagerank(edges, seeds=seeds, rounds=6).collect()}
            for apart in (0, 2, 6):
                many = {r.qname: r["rank"] for r in graph.pagerank(edges, seeds=seeds, rounds=6, every=2, one_task=0, apart=apart).collect()}
                assert one == pytest.approx(many) and sum(many.values()) == pytest.approx(1)


def test_pagerank_without_cycles_ends_with_the_longest_walk(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialised", lambda df, real=graph.materialised: written.append(1) or real(df))
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")])
    many = {r.qname: r["rank"] for r in graph.pagerank(e, one_task=0).collect()}
    assert len(written) <= 10  # not one for each of 50 rounds
    assert many == pytest.approx({r.qname: r["rank"] for r in graph.pagerank(e).collect()})


def test_pagerank_empty_and_unknown_seed(spark):
    none = edges_of(spark, [])
    assert graph.pagerank(none).count() == 0
    e = edges_of(spark, [("a", "b")])
    unknown = spark.createDataFrame([("x",)], "qname string")
    assert sorted(graph.pagerank(e, seeds=unknown, rounds=3).collect()) == sorted(graph.pagerank(e, rounds=3).collect())


def test_impact_equals_closure_on_random_graphs(spark):
    rng = random.Random(3)
    pairs = list({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(22)})
    pairs = [p for p in pairs if p[0] != p[1]]
    back = {}
    for a, b in pairs:
        back.setdefault(b, set()).add(a)
    want = set()
    for s in {x for p in pairs for x in p}:
        seen, todo = set(), list(back.get(s, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += back.get(x, ())
        want |= {(s, x) for x in seen}
    names = sorted({x for p in pairs for x in p})
    got = {(r.seed, r.node) for r in graph.impact(edges_of(spark, pairs), seeds_of(spark, *names)).collect()}
    assert got == want


def test_reached_follows_an_edge_once_for_all_seeds(spark):
    """130 seeds that all lead through one edge: three rows, one for each 63 of them, and the counts of each."""
    e = edges_of(spark, [(f"s{k}", "m") for k in range(130)] + [("m", "x"), ("x", "y"), ("y", "x"), ("s0", "z")])
    masks, ids = graph.reached_masks(e, seeds_of(spark, *(f"s{k}" for k in range(130))).coalesce(1))
    assert masks.where("node = 'y'").count() == ids.select((F.col("id") / 63).cast("long")).distinct().count() and ids.count() == 130
    counts = {r.seed: (r.impacted_count, r.direct_callers) for r in graph.counts_reached(masks, ids).collect()}
    assert counts == {f"s{k}": (3, 1) for k in range(1, 130)} | {"s0": (4, 2)}
    assert graph.each_reached(masks, ids).count() == 391
    one = graph.reached(e, seeds_of(spark, "x"))
    assert sorted(map(tuple, one.collect())) == [("x", "x", 2), ("x", "y", 1)]


def test_trace_order_and_cut(spark):
    e = edges_of(spark, [("a", "b"), ("a", "c"), ("b", "c")])
    rows, cut = graph.trace(e, seeds_of(spark, "a"), 1)
    assert [r.qname for r in rows.orderBy("position").collect()] == ["a", "b", "c"] and not cut
    chain = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    rows, cut = graph.trace(chain, seeds_of(spark, "a"), 1)
    assert rows.count() == 2 and cut
    rows, cut = graph.trace(edges_of(spark, [("a", f"x{k:02}") for k in range(20)]), seeds_of(spark, "a"), 4, most=10)
    assert rows.count() == 10 and cut


def test_clean_edges_and_precise(spark):
    e = edges_of(spark, [("a", "b"), ("a", "b"), ("a", "a"), ("", "b")])
    assert [tuple(r) for r in graph.clean_edges(e).collect()] == [("a", "b")]
    marked = graph.with_precise(graph.clean_edges(e).withColumn("proven", F.lit(False)), edges_of(spark, [("a", "b"), ("b", "c"), ("c", "c")]))
    assert sorted(map(tuple, marked.collect())) == [("a", "b", True), ("b", "c", True)]


def resolved(spark, symbols, refs, imports=()):
    s = spark.createDataFrame([(q, q.split("::")[1], q.split("::")[0], r) for q, r in symbols], "qname string, name string, file string, recv string")
    rows = spark.createDataFrame([(k, f"{f}::use", f, n, r, b) for k, (f, n, r, b) in enumerate(refs)], "ref_id long, caller_qname string, caller_file string, callee_name string, callee_recv string, allow_bare boolean")
    i = spark.createDataFrame(list(imports), "file string, alias string, target_file string, target_name string")
    return {x.ref_id: x.callee for x in resolve.resolve(rows, s, i).collect()}


def test_resolution_scopes(spark):
    symbols = [("a/a.go::New", ""), ("b/b.go::New", ""), ("p/x.go::Do", "A"), ("p/y.go::Do", "B"), ("q/one.go::Only", ""), ("m/same.go::T", ""), ("m/low.go::go", "Thing")]
    refs = [("a/use.go", "New", "", True), ("p/use.go", "Do", "", True), ("z/z.go", "Only", "", True), ("z/z.go", "Only", "", False), ("z/z.go", "New", "", True), ("p/use.go", "Do", "B", True), ("z/z.go", "go", "thing", True), ("z/z.go", "go", "Thing as Trait", True)]
    got = resolved(spark, symbols, refs)
    assert got == {0: "a/a.go::New", 1: None, 2: "q/one.go::Only", 3: None, 4: None, 5: "p/y.go::Do", 6: "m/low.go::go", 7: "m/low.go::go"}


def test_resolution_imports(spark):
    symbols = [("l.ts::default", ""), ("n.ts::n", ""), ("n.ts::other", ""), ("s.ts::sole", ""), ("two.ts::x", ""), ("two.ts::y", ""), ("c.ts::open", ""), ("ns.ts::f", "")]
    imports = [("u.ts", "L", "l.ts", "default"), ("u.ts", "n", "n.ts", "default"), ("u.ts", "S", "s.ts", "default"), ("u.ts", "Z", "two.ts", "default"), ("u.ts", "alias", "n.ts", "other"), ("u.ts", "ns", "ns.ts", "*")]
    refs = [("u.ts", "L", "", True), ("u.ts", "n", "", True), ("u.ts", "S", "", True), ("u.ts", "Z", "", True), ("u.ts", "alias", "", True), ("u.ts", "ns", "", True), ("u.ts", "f", "ns", False), ("c.html", "open", "", True)]
    got = resolved(spark, symbols, refs, imports)
    assert got == {0: "l.ts::default", 1: "n.ts::n", 2: "s.ts::sole", 3: None, 4: "n.ts::other", 5: None, 6: "ns.ts::f", 7: "c.ts::open"}


def test_resolution_hcl_stays_local(spark):
    symbols = [("m/v.tf::var.a", ""), ("n/v.tf::var.a", ""), ("m/o.tf::output.o", "")]
    refs = [("m/main.tf", "var.a", "", True), ("x/main.tf", "var.a", "", True), ("x/main.tf", "output.o", "hcl-module:m", True)]
    assert resolved(spark, symbols, refs, [("x/main.tf", "hcl-module:m", "m", "m")]) == {0: "m/v.tf::var.a", 1: None, 2: "m/o.tf::output.o"}


def test_resolution_in_tasks_equals_resolution(spark):
    """Symbols are spread before each becomes a row for each scope; references are read once more from what is written."""
    s = spark.createDataFrame([(f"d{k % 3}/f{k % 5}.go::n{k}", f"n{k % 11}", f"d{k % 3}/f{k % 5}.go", "") for k in range(40)], "qname string, name string, file string, recv string").coalesce(1)
    r = spark.createDataFrame([(k, "x", f"d{k % 3}/f{k % 7}.go", f"n{k % 13}", "", k % 4 > 0) for k in range(60)], "ref_id long, caller_qname string, caller_file string, callee_name string, callee_recv string, allow_bare boolean")
    i = spark.createDataFrame([], "file string, alias string, target_file string, target_name string")
    want = sorted(map(str, resolve.resolve(r, s, i).collect()))
    assert sorted(map(str, resolve.resolve(r, s, i, tasks=3).collect())) == want
    assert len(want) == 60


def test_history_sums_numbers_alone(spark):
    """No distinct counts that multiply rows, and no sums that sort."""
    commits = spark.createDataFrame([(k, f"a{k % 2}", "2024-01-01") for k in range(4)], "commit_seq long, author string, date string")
    lines = spark.createDataFrame([(k % 4, f"f{k % 3}", 1, 1) for k in range(24)], "commit_seq long, path string, adds int, dels int")
    for tasks in (None, 3):
        h = history.file_history(commits, lines, tasks=tasks)
        plan = h._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "Expand" not in plan
        assert {r.path: (r.commits, r.additions, r.authors) for r in h.collect()} == {f"f{k}": (4, 8, 2) for k in range(3)}


def test_ends_without_callers_and_tasks(spark):
    e = edges_of(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("d", "c")])
    for tasks in (None, 3):
        assert sorted(r.qname for r in graph.without_callers(e, tasks).collect()) == ["a", "d"]
        assert sorted(r.qname for r in graph.node_set(e, tasks=tasks).collect()) == ["a", "b", "c", "d"]
    assert sorted(map(tuple, graph.neighborhood(e, seeds_of(spark, "a")).collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_tasks_grow_with_rows(spark):
    from strataloom.functions.storage import tasks_for

    assert [tasks_for(spark, n) for n in (0, 1, 36_000_000, 216_000_000, 1_000_000_000)] == [1, 1, 90, 200, 500]


def test_history_and_renames(spark):
    commits = spark.createDataFrame([(0, "x", "2024-03-01T10:00:00Z"), (1, "x", "2024-05-01T10:00:00Z"), (2, "", "2024-01-01")], "commit_seq long, author string, date string")
    stats = spark.createDataFrame([(0, "a.txt", 1, None), (1, "a.txt", 2, 1), (2, "a.txt", 3, 0), (2, "src/{old => new}/file.go", 1, 1), (1, "pkg/{a/b => c}/x.go", 1, 1), (1, "old.go => new.go", 1, 1), (1, "lib/{x => }/f", 0, 0)], "commit_seq long, path string, adds int, dels int")
    rows = {r.path: r for r in history.file_history(commits, stats).collect()}
    assert tuple(rows["a.txt"])[1:] == (3, 6, 1, "2024-03-01", 1)
    assert set(rows) == {"a.txt", "src/new/file.go", "pkg/c/x.go", "new.go", "lib/f"}
    assert history.file_history(commits, stats, 1).count() == 1


@pytest.mark.parametrize(("hunks", "want"), [([(12, 12)], {"B"}), ([(5, 25)], {"A", "B", "C"}), ([(1, 1)], set()), ([(3, 3), (4, 4)], {"A"})])
def test_touched(spark, hunks, want):
    s = symbols_of(spark, [("f.go::A", "f.go", 3), ("f.go::B", "f.go", 10), ("f.go::C", "f.go", 20)])
    h = spark.createDataFrame([("f.go", a, b) for a, b in hunks], "path string, start int, end int")
    assert {r.name for r in changes.touched(s, h).collect()} == want


def test_dead_code_confidence(spark):
    s = symbols_of(spark, [("m.go::main", "m.go", 1), ("m.go::Use", "m.go", 2), ("m.go::used", "m.go", 3), ("m.go::orphan", "m.go", 4), ("m.go::Exported", "m.go", 5), ("m.go::Unused", "m.go", 6, "method", "go", "T"), ("m_test.go::helper", "m_test.go", 1), ("x.pb.go::gen", "x.pb.go", 1), ("C.tsx::View", "C.tsx", 1, "function", "tsx")])
    e = edges_of(spark, [("m.go::main", "m.go::Use"), ("m.go::Use", "m.go::used")])
    rows = changes.ordered_orphans(changes.dead_code(s, e)).collect()
    assert [(r.symbol, r.confidence) for r in rows] == [("orphan", "high"), ("Exported", "medium"), ("View", "low"), ("T.Unused", "low")]
    assert {r.symbol: r.confidence for r in changes.dead_code(s, e, precise=True).collect()}["T.Unused"] == "medium"


def test_dead_code_asks_patterns_of_orphans_alone(spark, monkeypatch):
    """Of 200 symbols three have no caller; only those are left when paths and names are matched."""
    written = []
    monkeypatch.setattr(changes, "materialised", lambda df, real=changes.materialised: written.append(real(df)) or written[-1])
    s = symbols_of(spark, [(f"m.go::f{k}", "m.go", k) for k in range(199)] + [("m_test.go::helper", "m_test.go", 1)])
    e = edges_of(spark, [("m.go::f0", f"m.go::f{k}") for k in range(2, 199)])
    for tasks in (None, 3):
        assert {r.qname for r in changes.dead_code(s, e, tasks=tasks).collect()} == {"m.go::f0", "m.go::f1"}
        assert written[-1].count() == 3


def test_budget_is_a_prefix_and_keeps_one(spark):
    df = spark.createDataFrame([(k, "x" * (4 * c)) for k, c in enumerate([3, 4, 9, 1])], "k int, t string")
    cost = F.length("t") / 4
    keep = lambda b: [r.k for r in ranking.within_budget(df, [F.asc("k")], cost.cast("int"), b).orderBy("k").collect()]
    assert keep(7) == [0, 1] and keep(1) == [0] and keep(15) == [0, 1] and keep(17) == [0, 1, 2, 3]


def test_churn_lifts_a_file(spark):
    s = symbols_of(spark, [("app.go::Run", "app.go", 1), ("util.go::Tweak", "util.go", 1)])
    ranks = spark.createDataFrame([("app.go::Run", 0.9), ("util.go::Tweak", 0.1)], "qname string, rank double")
    counts = graph.caller_counts(edges_of(spark, [("x", "app.go::Run")]))
    churn = spark.createDataFrame([("app.go", 1), ("util.go", 6)], "path string, commits long")
    best = lambda w: ranking.scored_symbols(s, ranks, counts, churn, w).orderBy(F.desc("score")).first()
    assert best(1.0).qname == "util.go::Tweak" and best(1.0).churn == 6 and best(0.0).qname == "app.go::Run"


def test_snippets_stop_before_the_next_definition(spark):
    s = symbols_of(spark, [("a.go::x", "a.go", 3), ("a.go::y", "a.go", 5), ("a.go::z", "a.go", 99)])
    files = spark.createDataFrame([("a.go", "1\n2\n3\n4\n5\n6")], "file string, content string")
    rows = {r.qname: (r.end_line, r.snippet) for r in ranking.snippets(s, s, files).collect()}
    assert rows == {"a.go::x": (4, "3\n4"), "a.go::y": (6, "5\n6"), "a.go::z": (99, "")}
