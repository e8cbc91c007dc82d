"""Scores, token budgets, snippets: the repository map and the context pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.storage import materialised

SNIPPET_LINES = 40


def within_budget(items: DataFrame, order: list[Column], cost: Column, budget: int, keep: str = "position") -> DataFrame:
    """items up to the first at which the running cost passes the budget, the first item always; with their position.

    Costs are 1 at least, so the running sum grows and what fits is a prefix: at most budget + 1 items.
    They are cut off before the running sum, which one task therefore makes over a bounded number of rows.
    """
    costed = items.withColumn("__cost", cost).orderBy(*order).limit(budget + 1)
    w = Window.orderBy(*order)
    run = costed.withColumn(keep, F.row_number().over(w)).withColumn("__sum", F.sum("__cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col(keep) == 1) | (F.col("__sum") <= budget)).drop("__cost", "__sum")


def scored_symbols(symbols: DataFrame, ranks: DataFrame, callers: DataFrame, churn: DataFrame | None, weight: float = 0.3) -> DataFrame:
    """symbols with rank, callers, churn, score: centrality blended with churn; misses count 0. No churn table, or weight 0: centrality alone."""
    weight = min(1.0, max(0.0, weight))
    use = churn is not None and weight > 0
    rows = symbols.join(ranks, "qname", "left").join(callers, "qname", "left")
    rows = rows.join(churn.select(F.col("path").alias("file"), F.col("commits").alias("churn")), "file", "left") if use else rows.withColumn("churn", F.lit(0).cast("long"))
    rows = rows.withColumns({"rank": F.coalesce("rank", F.lit(0.0)), "callers": F.coalesce("callers", F.lit(0)), "churn": F.coalesce("churn", F.lit(0))})
    rows = materialised(rows)  # the scores and their tops both read them
    tops = rows.agg(F.max("rank").alias("top_rank"), F.max(F.log1p(F.col("churn").cast("double"))).alias("top_log"))
    score = S.blended(F.col("rank"), F.col("top_rank"), F.col("churn"), F.col("top_log"), weight, use)
    return rows.crossJoin(F.broadcast(tops)).withColumn("score", score).drop("top_rank", "top_log")  # a single row


def symbol_line() -> Column:
    tags = F.array_join(F.array_compact(F.array(F.when(F.col("callers") > 0, F.format_string("callers: %d", "callers")), F.when(F.col("churn") > 0, F.format_string("churn: %d", "churn")))), ", ")
    kind = F.when(F.coalesce("kind", F.lit("")) == "", "def").otherwise(F.col("kind"))
    return F.concat(F.format_string("  :%-5d %-8s %s", "line", kind, "name"), F.when(tags != "", F.concat(F.lit("  ("), tags, F.lit(")"))).otherwise(""), F.lit("\n"))


def repo_map(scored: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """scored symbols that fit max_tokens, with position; a file's header costs at its first appearance."""
    budget = max_tokens if max_tokens > 0 else 1000
    order = [F.desc("score"), F.desc("callers"), F.asc("qname")]
    head = scored.orderBy(*order).limit(budget + 1)  # each costs a token at least
    first = F.row_number().over(Window.partitionBy("file").orderBy(*order)) == 1
    costed = head.withColumn("__own", S.tokens_of(symbol_line()) + F.when(first, S.tokens_of(F.concat("file", F.lit("\n")))).otherwise(0))
    return within_budget(costed, order, F.col("__own"), budget).drop("__own")


def repo_map_text(chosen: DataFrame) -> DataFrame:
    """map: files in order of their best symbol, symbols by line."""
    files = chosen.groupBy("file").agg(F.min("position").alias("best"), F.array_sort(F.collect_list(F.struct("line", "position", symbol_line().alias("text")))).alias("rows"))
    block = F.concat("file", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["text"]), ""))
    return files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("best", block.alias("block")))), lambda r: r["block"]), "").alias("map"))


def next_definition(symbols: DataFrame) -> DataFrame:
    """(file, line, next_line): each distinct definition line of a file and the next, null after the last."""
    lines = symbols.select("file", "line").distinct()
    return lines.withColumn("next_line", F.lead("line").over(Window.partitionBy("file").orderBy("line")))


def snippets(items: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """items(file, line) with end_line and snippet: to the next definition, SNIPPET_LINES or the file's end. files(file, content). An unknown file or line: ''."""
    rows = items.join(next_definition(symbols), ["file", "line"], "left").join(files.select("file", "content"), "file", "left")
    total = F.size(F.split(F.coalesce("content", F.lit("")), "\n"))
    known = F.col("content").isNotNull() & (F.col("line") >= 1) & (F.col("line") <= total)
    end = F.least(F.col("line") + SNIPPET_LINES - 1, F.coalesce(F.col("next_line") - 1, F.lit(2**31 - 1)), total)
    rows = rows.withColumn("end_line", F.when(known, F.greatest(end, F.col("line"))).otherwise(F.col("line")))
    return rows.withColumn("snippet", F.coalesce(F.when(known, S.snippet(F.col("content"), F.col("line"), F.col("end_line"))), F.lit(""))).drop("next_line", "content")


def resolve_seed(symbols: DataFrame, seed: str) -> DataFrame:
    """Symbols that the seed names exactly (name or qname); only without any, those whose file or qname contains it."""
    exact = (F.col("name") == seed) | (F.col("qname") == seed)
    best = symbols.where(exact)
    return best if not best.isEmpty() else symbols.where(F.col("file").contains(seed) | F.col("qname").contains(seed))


def find_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols by name, qname or display, exact ones first, then by part of qname, or of display for those with a receiver; each by qname."""
    shown = S.display(F.col("lang"), F.col("recv"), F.col("name"))
    exact = (F.col("name") == query) | (F.col("qname") == query) | (shown == query)
    part = F.col("qname").contains(query) | ((F.coalesce("recv", F.lit("")) != "") & shown.contains(query))
    return symbols.withColumn("tier", F.when(exact, 0).when(part, 1)).where("tier IS NOT NULL").orderBy("tier", "qname")


def pack_candidates(near: DataFrame, scored: DataFrame) -> DataFrame:
    """Symbols of a neighbourhood(qname, distance) scored for a context pack."""
    tops = scored.agg(F.max("rank").alias("top_rank"), F.max(F.log1p(F.col("churn").cast("double"))).alias("top_log"))
    rows = scored.drop("score").join(near, "qname").crossJoin(F.broadcast(tops))
    central = F.when(F.col("top_rank") > 0, F.col("rank") / F.col("top_rank")).otherwise(0.0)
    churn = F.when(F.col("top_log") > 0, F.log1p(F.col("churn").cast("double")) / F.col("top_log")).otherwise(0.0)
    return rows.withColumn("score", S.pack_score(F.col("distance"), central, churn)).drop("top_rank", "top_log")


def pack_block() -> Column:
    tags = F.array_join(F.array_compact(F.array(F.format_string("distance %d", "distance"), F.when(F.col("callers") > 0, F.format_string("callers %d", "callers")), F.when(F.col("churn") > 0, F.format_string("churn %d", "churn")))), ", ")
    return F.concat(F.format_string("// %s:%d  %s  (%s)\n", "file", "line", "qname", tags), F.col("snippet"), F.lit("\n\n"))


def context_pack(near: DataFrame, scored: DataFrame, symbols: DataFrame, files: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """Items that fit max_tokens by score, then distance, then qname, with snippet, end_line, position."""
    budget = max_tokens if max_tokens > 0 else 4000
    order = [F.desc("score"), F.asc("distance"), F.asc("qname")]
    head = pack_candidates(near, scored).orderBy(*order).limit(budget + 1)
    return within_budget(snippets(head, symbols, files), order, S.tokens_of(pack_block()), budget)


def joined_text(items: DataFrame, text: Column, name: str) -> DataFrame:
    """One row: the items' texts by position."""
    return items.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", text.alias("t")))), lambda r: r["t"]), "").alias(name))


def precise_candidates(scored: DataFrame, impacts: DataFrame, most: int = 300) -> DataFrame:
    """The callables that a costly analyser should look at first: by rank, impact, callers, then qname. impacts(qname, impact)."""
    rows = scored.where(F.col("kind").isin("function", "method", "macro")).join(impacts, "qname", "left").withColumn("impact", F.coalesce("impact", F.lit(0)))
    return rows.orderBy(F.desc("rank"), F.desc("impact"), F.desc("callers"), "qname").limit(most).select("qname", "rank", "impact", "callers")
