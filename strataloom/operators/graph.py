"""Graph operators over edges(src, dst): reachability, breadth-first orders, PageRank, degrees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.storage import discard, materialised, tasks_for

DAMPING, ROUNDS = 0.85, 50
#: Edges and nodes together up to which PageRank runs in one task.
ONE_TASK = 200_000
#: Rows of a frontier up to which it is broadcast to the edges.
BROADCAST_ROWS = 200_000
#: Rounds of a larger graph that are kept apart by the length of their walks.
APART = 8


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops and without empty ends."""
    return edges.select("src", "dst").where("src <> dst AND src <> '' AND dst <> ''").distinct()


def node_set(edges: DataFrame, symbols: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """qname of every symbol and every end of an edge. tasks: how many share the work; Spark's own number if none."""
    ends = edges.select(F.col("src").alias("qname")).union(edges.select("dst"))
    ends = ends if symbols is None else ends.union(symbols.select("qname"))
    return (ends.repartition(tasks, "qname") if tasks else ends).distinct()


def without_callers(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """qname of the ends of edges that no edge leads to: one sum over all ends."""
    ends = edges.select(F.col("src").alias("qname"), F.lit(False).alias("called")).union(edges.select("dst", F.col("dst").isNotNull()))
    return (ends.repartition(tasks, "qname") if tasks else ends).groupBy("qname").agg(F.max("called").alias("called")).where("NOT called").select("qname")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reached(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, node, depth >= 1) along edges from seeds(seed), all seeds in one loop of frontiers.

    A seed is among its own nodes iff it lies on a cycle. most: greatest depth.
    """
    return each_reached(*reached_masks(edges, seeds, most))


def reached_masks(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((block, node, mask, depth), (seed, id)): what reached() says, up to 63 seeds in a row, each the bit id % 63 of block id / 63.

    So an edge is followed once a round for all the seeds of a block that come to it at the same depth. Each round joins the
    frontier alone with the edges and takes out the bits that were seen; the driver asks whether rows are left.
    """
    edges = materialised(edges.select("src", "dst"))  # read anew each round
    tasks = tasks_for(edges.sparkSession, edges.count())
    ids = materialised(seeds.select("seed").distinct().withColumn("id", F.monotonically_increasing_id()))
    frontier = materialised(ids.select(_block().alias("block"), F.col("seed").alias("node"), F.expr("shiftleft(1L, cast(id % 63 as int))").alias("mask")))
    seen, depth, empty = None, 0, frontier.where("false").withColumn("depth", F.lit(0))
    while most is None or depth < most:
        depth += 1
        if frontier.count() <= BROADCAST_ROWS:
            step = F.broadcast(frontier).join(edges, F.col("node") == F.col("src"))
        else:
            step = frontier.repartition(tasks, "node").hint("merge").join(edges.repartition(tasks, "src"), F.col("node") == F.col("src"))
        step = step.select("block", F.col("dst").alias("node"), "mask").groupBy("block", "node").agg(F.bit_or("mask").alias("mask"))
        if seen is not None:
            before = seen.groupBy("block", "node").agg(F.bit_or("mask").alias("before"))
            step = step.join(before.withColumnRenamed("block", "b").withColumnRenamed("node", "n"), (F.col("block") == F.col("b")) & (F.col("node").eqNullSafe(F.col("n"))), "left")
            step = step.select("block", "node", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("before", F.lit(0).cast("long")))).alias("mask")).where("mask <> 0")
        step = materialised(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        seen = step if seen is None else materialised(seen.unionByName(step)) if depth % 8 == 0 else seen.unionByName(step)
        frontier = step.select("block", "node", "mask")
    return (seen if seen is not None else empty), ids


def _block():
    return F.expr("id div 63")


def each_reached(masks: DataFrame, ids: DataFrame) -> DataFrame:
    """(seed, node, depth) of reached_masks."""
    bits = F.expr("filter(sequence(0, 62), b -> (mask & shiftleft(1L, b)) <> 0)")
    rows = masks.select("node", "depth", "block", F.explode(bits).alias("bit")).select((F.col("block") * 63 + F.col("bit")).alias("id"), "node", "depth")
    return rows.join(ids, "id").select("seed", "node", "depth")


def counts_reached(masks: DataFrame, ids: DataFrame) -> DataFrame:
    """(seed, impacted_count, direct_callers) of reached_masks, without a row for each seed and node."""
    at = lambda b: F.col("mask").bitwiseAND(F.lit(1 << b).cast("long")) != 0
    sums = [F.array(*(F.count_if(at(b)) for b in range(63))).alias("all"), F.array(*(F.count_if(at(b) & (F.col("depth") == 1)) for b in range(63))).alias("near")]
    rows = masks.groupBy("block").agg(*sums).select("block", F.posexplode(F.arrays_zip("all", "near")).alias("bit", "n"))
    rows = rows.select((F.col("block") * 63 + F.col("bit")).alias("id"), F.col("n.all").alias("impacted_count"), F.col("n.near").alias("direct_callers"))
    return rows.where("impacted_count > 0").join(ids, "id").select("seed", "impacted_count", "direct_callers")


def impact(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, depth): all callers, direct or not, of each seed."""
    return reached(reverse(edges), seeds)


def neighborhood(edges: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """(qname, distance): least number of hops from any of seeds(seed) in either direction; seeds at 0."""
    edges = materialised(edges.select("src", "dst"))
    both = edges.union(reverse(edges))
    start = materialised(seeds.select(F.col("seed").alias("qname")).distinct().withColumn("distance", F.lit(0)))  # a file's size is known, so few seeds are broadcast
    out, frontier = start, start
    for depth in range(1, most + 1):
        step = frontier.join(both, frontier["qname"] == both["src"]).select(F.col("dst").alias("qname")).distinct()
        step = materialised(step.join(out.select("qname"), "qname", "left_anti").withColumn("distance", F.lit(depth)))
        if step.isEmpty():
            break
        out, frontier = out.unionByName(step), step
    return out


def trace(edges: DataFrame, entry: DataFrame, depth: int = 4, most: int = 250) -> tuple[DataFrame, bool]:
    """(qname, depth, position, callees) in breadth-first order from entry(seed), and whether it was cut.

    Position is that of a queue that takes callees by name: by depth, then the caller's position, then
    name. It is cut where a node at the last depth has a callee not yet seen, or at most nodes.
    """
    edges = materialised(edges.select("src", "dst"))
    level = materialised(entry.select(F.col("seed").alias("qname")).withColumn("depth", F.lit(0)).withColumn("position", F.lit(1).cast("long")))
    out, count = level, level.count()
    for d in range(1, depth + 1):
        step = level.join(edges, level["qname"] == edges["src"]).groupBy(F.col("dst").alias("qname")).agg(F.min("position").alias("caller"))
        step = step.join(out.select("qname"), "qname", "left_anti")
        place = F.row_number().over(Window.orderBy("caller", "qname"))  # at most a level of a trace: bounded below
        step = step.orderBy("caller", "qname").limit(max(0, most - count)).withColumn("position", (place + count).cast("long"))
        level = materialised(step.select("qname", F.lit(d).alias("depth"), "position"))
        n = level.count()
        if not n:
            break
        out, count = out.unionByName(level), count + n
    out = materialised(out)
    ends = out.where(F.col("depth") == depth).join(edges, F.col("qname") == F.col("src")).select("dst")
    cut = count >= most or not ends.join(out.select(F.col("qname").alias("dst")), "dst", "left_anti").isEmpty()
    callees = edges.groupBy(F.col("src").alias("qname")).agg(F.array_sort(F.collect_list("dst")).alias("callees"))
    out = out.join(callees, "qname", "left").withColumn("callees", F.coalesce("callees", F.array().cast("array<string>")))
    return out.select("qname", "depth", "position", "callees"), cut


def expand_seeds(symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """qname of symbols whose qname, file or name is one of seeds(seed)."""
    s = F.broadcast(seeds.select("seed").distinct())  # a person's short list
    return symbols.join(s, (symbols["qname"] == s["seed"]) | (symbols["file"] == s["seed"]) | (symbols["name"] == s["seed"]), "left_semi").select("qname").distinct()


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, seeds: DataFrame | None = None, rounds: int = ROUNDS, damping: float = DAMPING, every: int = 5, one_task: int = ONE_TASK, apart: int = APART) -> DataFrame:
    """(qname, rank) after rounds from a uniform start; ranks sum to 1.

    seeds(qname): the nodes that teleport leads to, evenly; all nodes if none is given or none is
    known. The mass of nodes without outgoing edges follows the teleport vector.

    A graph of up to one_task edges and nodes, counted first, takes all rounds in one task, by numpy: at
    that size a round of joins is nothing but planning. A larger one takes one join and one sum a
    round, no join with the node table: every edge carries 1 / out-degree, and each node one row of 0 to
    itself so that it stays. Links are partitioned and sorted by source once.

    A round is linear, so the first `apart` ones only pass on what walks from the start and from the
    teleport vector bring, each to the nodes that have some of it; the ranks are sums of these by weights that
    need no more than their totals. Where no walk is longer (no cycles), that is the whole job,
    whatever the rounds. Others go on from there, and every few rounds the ranks are
    materialised and those before deleted, so the disk holds two of them at most.
    """
    edges = materialised(edges.select("src", "dst"))
    spark, m = edges.sparkSession, edges.count()
    tasks = tasks_for(spark, m)
    out = materialised(edges.repartition(tasks, "src").groupBy("src").agg(F.count("*").alias("degree")))
    ends = out.select(F.col("src").alias("qname")).union(edges.select("dst"))
    ends = ends if nodes is None else ends.union(nodes.select("qname"))
    nodes = materialised(ends.repartition(tasks, "qname").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    targets = nodes.join(seeds.select("qname").distinct(), "qname", "left_semi") if seeds is not None else nodes
    t = targets.count()
    if not t:
        targets, t = nodes, n
    jump = nodes.select("qname", F.lit(1.0 / n).alias("jump")) if t == n else nodes.join(targets.select("qname", F.lit(1.0 / t).alias("jump")), "qname", "left").select("qname", F.coalesce("jump", F.lit(0.0)).alias("jump"))
    if n + min(m, one_task + 1) <= one_task:
        rows = jump.select("qname", F.lit(None).cast("string").alias("dst"), "jump").union(edges.select("src", "dst", F.lit(0.0)))
        return materialised(rows.coalesce(1).mapInArrow(_ranks_of(rounds, damping), "qname string, rank double"))
    loose = out.count() < n
    links = edges.repartition(tasks, "src").join(out.repartition(tasks, "src").hint("merge"), "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("share"))
    links = links.persist()
    walks, totals = [materialised(jump.select("qname", F.lit(1.0 / n).alias("start"), "jump"))], [(1.0, 1.0)]
    for _ in range(min(apart, rounds)):
        seen = Observation()
        came = lambda c: F.sum(F.col(c) * F.col("share")).alias(c)
        step = links.join(walks[-1].withColumnRenamed("qname", "src").repartition(tasks, "src"), "src").groupBy(F.col("dst").alias("qname")).agg(came("start"), came("jump"))
        walks.append(materialised(step.observe(seen, F.sum("start").alias("start"), F.sum("jump").alias("jump"))))
        totals.append((float(seen.get["start"] or 0.0), float(seen.get["jump"] or 0.0)))
        if walks[-1].isEmpty():
            break
    over = walks[-1].isEmpty()
    k = rounds if over else len(walks) - 1
    ranks = materialised(_sum_of_walks(walks, totals, k, damping, tasks))
    for done in walks:
        discard(done)
    if k < rounds:
        own = jump.select(F.col("qname").alias("src"), F.col("qname").alias("dst"), F.lit(0.0).alias("share"), "jump")
        full = links.withColumn("jump", F.lit(None).cast("double")).unionByName(own).repartition(tasks, "src").persist()
        last = ranks
        for k in range(k + 1, rounds + 1):
            seen = Observation()
            moved = full.join(ranks.select(F.col("qname").alias("src"), "rank").repartition(tasks, "src"), "src").groupBy(F.col("dst").alias("qname")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"), F.max("jump").alias("jump"))
            lost = 0.0
            if loose:  # what no edge passed on; the sum comes with the write that cuts the lineage
                moved = materialised(moved.observe(seen, F.sum("in").alias("in")))
                lost = 1.0 - float(seen.get["in"] or 0.0)
            ranks = moved.select("qname", ((1 - damping) * F.col("jump") + damping * (F.col("in") + lost * F.col("jump"))).alias("rank"))
            if loose or k % every == 0 or k == rounds:
                ranks = ranks if loose and k < rounds else materialised(ranks)
                discard(last)
                last = moved if loose else ranks
        full.unpersist()
        if loose:
            discard(last)
    links.unpersist()
    return ranks


def _sum_of_walks(walks: list[DataFrame], totals: list[tuple[float, float]], k: int, damping: float, tasks: int) -> DataFrame:
    """(qname, rank) after k rounds, from walks of 0, 1, ... steps (qname, start, jump) and their totals; longer ones bring nothing.

    rank(k) = d^k start(k) + sum over i < k of d^i back(k - i) jump(i), where back(j) is the share that teleports
    in round j: 1 - d, and d times what the ranks before had at nodes without outgoing edges. Of a walk's total, the next one lacks just that.
    """
    at = lambda i, side: totals[i][side] if i < len(totals) else 0.0
    ends = [tuple(at(i, side) - at(i + 1, side) for side in (0, 1)) for i in range(len(walks))]
    back = [0.0]
    for j in range(k):
        lost = (damping**j * ends[j][0] if j < len(ends) else 0.0) + sum(damping**i * back[j - i] * ends[i][1] for i in range(min(j, len(ends))))
        back.append((1 - damping) + damping * lost)
    parts = [w.select("qname", ((damping**k if i == k else 0.0) * F.col("start") + (damping**i * back[k - i] if i < k else 0.0) * F.col("jump")).alias("rank")) for i, w in enumerate(walks) if i <= k]
    return reduce(DataFrame.union, parts).repartition(tasks, "qname").groupBy("qname").agg(F.sum("rank").alias("rank"))


def _ranks_of(rounds: int, damping: float):
    """All rounds over rows (qname, null, jump) of nodes and (src, dst, 0) of edges, both distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).to_pandas()
        is_node = rows["dst"].isna().to_numpy()
        names = np.sort(rows["qname"].to_numpy()[is_node])
        place = {q: k for k, q in enumerate(names)}
        jump = np.zeros(len(names))
        jump[[place[q] for q in rows["qname"][is_node]]] = rows["jump"][is_node]
        ends = rows[~is_node]
        src, dst = (np.array([place[q] for q in ends[c]], np.int64) for c in ("qname", "dst"))
        order = np.lexsort((src, dst))  # sums go in one order, whatever that of the rows
        src, dst = src[order], dst[order]
        degree = np.bincount(src, minlength=len(names))
        share = 1.0 / degree[src]
        rank = np.full(len(names), 1.0 / len(names))
        for _ in range(rounds):
            moved = np.bincount(dst, weights=rank[src] * share, minlength=len(names))
            rank = (1 - damping) * jump + damping * (moved + rank[degree == 0].sum() * jump)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rank)], ["qname", "rank"])

    return run


def callees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("qname")).agg(F.array_sort(F.collect_set("dst")).alias("callees"))


def callers(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("qname")).agg(F.array_sort(F.collect_set("src")).alias("callers"))


def caller_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("qname")).agg(F.countDistinct("src").alias("callers"))


def with_precise(edges: DataFrame, precise: DataFrame) -> DataFrame:
    """edges(src, dst, proven) with further proven ones: an edge is proven if either side says so; none goes."""
    marked = precise.select("src", "dst", F.lit(True).alias("proven"))
    return edges.select("src", "dst", "proven").unionByName(marked).where("src <> dst").groupBy("src", "dst").agg(F.max("proven").alias("proven"))


def map_precise(symbols: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """Edges from an analyser's rows (caller_file, caller_line, caller_name, callee_...): file, line and name, else what is unique by (file, name) or (file, line)."""
    rest = "name" if by == "name" else "line"
    exact = symbols.groupBy("file", "line", "name").agg(F.first("qname").alias("q1"))
    loose = symbols.groupBy("file", rest).agg(F.count("*").alias("c"), F.first("qname").alias("q2")).where("c = 1").drop("c")
    out = found
    for side in ("caller", "callee"):
        keys = [F.col(f"{side}_{k}").alias(k) for k in ("file", "line", "name")]
        at = found.select(*keys).distinct().join(exact, ["file", "line", "name"], "left").join(loose, ["file", rest], "left")
        at = at.select(*(F.col(k).alias(f"{side}_{k}") for k in ("file", "line", "name")), F.coalesce("q1", "q2").alias(side))
        out = out.join(at, [f"{side}_{k}" for k in ("file", "line", "name")], "left")
    return out.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
