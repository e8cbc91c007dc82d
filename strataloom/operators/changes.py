"""Dead code, changed symbols and what they touch, and maps of directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalars import dirname, display
from ..functions.storage import materialised
from .graph import counts_reached, each_reached, reached_masks, reverse

HCL_LANGS = ("hcl", "terraform")


def hcl_orphans(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Variables that nothing in their own directory reads, locals and outputs that nothing reads; other kinds never."""
    hcl = symbols.where(F.col("lang").isin(*HCL_LANGS) & F.col("kind").isin("variable", "local", "output"))
    from_dir = dirname(F.substring_index("src", "::", 1))
    reads = edges.select(F.col("dst").alias("__dst"), from_dir.alias("__dir"))
    near = (F.col("qname") == F.col("__dst")) & ((F.col("kind") != "variable") | (F.col("__dir") == dirname(F.col("file"))))
    return hcl.join(reads, near, "left_anti").withColumn("confidence", F.when(F.col("kind") == "output", "medium").otherwise("high"))


def dead_code(symbols: DataFrame, edges: DataFrame, precise: bool = False, tasks: int | None = None) -> DataFrame:
    """(qname, symbol, file, line, kind, exported, confidence) of callables without callers.

    Functions and methods outside tests, not named like entries and not called by a framework; weak
    leads rank low. HCL symbols by their own rule. Callables without callers are written first: the
    patterns of paths and names are dear, and Spark would ask them of all symbols before that join.
    tasks: how many share the join; Spark's own number if none.
    """
    kind = P.callable_kind(F.col("kind"), F.col("recv"))
    callables = symbols.where(kind.isin("function", "method") & ~F.coalesce("lang", F.lit("")).isin(*HCL_LANGS))
    lang = F.coalesce("lang", F.lit(""))
    called = edges.select(F.col("dst").alias("qname"))
    if tasks:
        called = called.repartition(tasks, "qname").distinct().hint("merge")
    alone = materialised(callables.join(called, "qname", "left_anti").select("qname", "name", "kind", "file", "line", "lang", "recv", "test", "public"))
    live = P.is_test_file(F.col("file")) | F.coalesce("test", F.lit(False)) | P.is_entry_name(F.col("name")) | P.is_framework_entry(F.col("file"), F.col("name"), lang)
    exported = P.is_exported(lang, F.col("name"), F.col("public"))
    confidence = F.when(P.is_weak_lead(F.col("file"), F.col("name"), lang), "low").otherwise(P.orphan_confidence(kind, exported, precise))
    shown = display(F.col("lang"), F.col("recv"), F.col("name")).alias("symbol")
    out = alone.where(~live).select("qname", shown, "file", "line", kind.alias("kind"), exported.alias("exported"), confidence.alias("confidence"))
    hcl = hcl_orphans(symbols, edges).select("qname", F.col("name").alias("symbol"), "file", "line", "kind", F.lit(False).alias("exported"), "confidence")
    return out.unionByName(hcl)


def ordered_orphans(orphans: DataFrame, limit: int = 50) -> DataFrame:
    return orphans.orderBy(P.confidence_rank(F.col("confidence")), "file", "line", "qname").limit(limit if limit > 0 else 50)


def extents(symbols: DataFrame) -> DataFrame:
    """symbols with last_line: the line before the next definition of the file; that line if the next is on it; null after the last."""
    following = F.lead("line").over(Window.partitionBy("file").orderBy("line", "qname"))
    return symbols.withColumn("__next", following).withColumn("last_line", F.when(F.col("__next").isNotNull(), F.greatest(F.col("__next") - 1, F.col("line")))).drop("__next")


def touched(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """symbols whose extent overlaps a hunk(path, start, end) of their file, each once: an equi join on the file with the overlap as its residual."""
    h = hunks.select(F.col("path").alias("__p"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    s = extents(symbols.join(h.select("__p").distinct(), symbols["file"] == F.col("__p"), "left_semi"))  # of files with a hunk alone
    return s.join(h, (s["file"] == h["__p"]) & (h["__e"] >= s["line"]) & (s["last_line"].isNull() | (h["__s"] <= s["last_line"])), "left_semi")


def changed_symbols(symbols: DataFrame, edges: DataFrame, hunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, impacted): touched reviewable symbols with direct_callers and impacted_count; and (seed, node, depth) behind the counts.

    The closure is one loop over all seeds at once; the counts are made without its rows of a seed and a node.
    """
    changed = touched(symbols, hunks).where(P.is_reviewable(F.col("kind")))
    changed = materialised(changed)
    masks, ids = reached_masks(reverse(edges), changed.select(F.col("qname").alias("seed")))
    counts = counts_reached(masks, ids).withColumnRenamed("seed", "qname")
    rows = changed.join(counts, "qname", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("impacted_count", "direct_callers")})
    return rows, each_reached(masks, ids)


def at_risk_tests(impacted: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct tests among impacted(node)."""
    flags = symbols.select(F.col("qname").alias("node"), "test")
    rows = impacted.select("node").distinct().join(flags, "node", "left")
    return rows.where(P.is_test_qname(F.col("node"), F.col("test"))).select(F.col("node").alias("qname"))


def directory_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_dir, to_dir, calls) between different directories; an end without a symbol goes by its qname."""
    at = symbols.select(F.col("qname").alias("__q"), F.col("file").alias("__file"))
    out = edges
    for end, name in (("src", "from_dir"), ("dst", "to_dir")):
        out = out.join(at, F.col(end) == F.col("__q"), "left")
        out = out.withColumn(name, dirname(F.coalesce("__file", F.substring_index(end, "::", 1)), "(root)")).drop("__q", "__file")
    return out.where("from_dir <> to_dir").groupBy("from_dir", "to_dir").agg(F.count("*").alias("calls"))


def directory_map(edges: DataFrame, symbols: DataFrame, max_nodes: int = 12) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the max_nodes (12 if none is asked for, 40 at most) directories of most calls in and out, and the edges among them."""
    most = min(40, max_nodes if max_nodes > 0 else 12)
    links = directory_edges(edges, symbols)
    degree = links.select(F.col("from_dir").alias("dir"), "calls").union(links.select("to_dir", "calls")).groupBy("dir").agg(F.sum("calls").alias("degree"))
    files = symbols.select(dirname(F.col("file"), "(root)").alias("dir"), "file").distinct().groupBy("dir").agg(F.count("*").alias("files"))
    nodes = files.join(degree, "dir", "left").select("dir", "files", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "dir").limit(most)
    kept = nodes.select("dir")
    inside = links.join(kept.withColumnRenamed("dir", "from_dir"), "from_dir", "left_semi").join(kept.withColumnRenamed("dir", "to_dir"), "to_dir", "left_semi")
    return nodes, inside
