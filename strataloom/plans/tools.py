"""The questions that users ask of a repository, composed from the operators.

A Repository holds the relations of one source tree; every method is a tool: it takes the defaults
and limits of its report and returns a dict of plain values and DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalars import display
from ..operators import changes, graph, history, ranking, resolve
from ..sources import files as files_
from ..sources import gitlog, guide, manifests, recon, routes, schema, stacks, taggers
from . import render


@dataclass
class Graph:
    """symbols, edges(src, dst, proven), the references behind them, whether patterns alone made it, and files that broke their tagger."""

    symbols: DataFrame
    edges: DataFrame
    resolved: DataFrame | None
    by_pattern: bool = False
    errors: DataFrame | None = None


def build_graph(files: DataFrame, precise: DataFrame | None = None, tags: DataFrame | None = None) -> Graph:
    """Tag, resolve, assemble. Without a single tagged file: definitions by pattern and no edges.

    precise: an analyser's rows (caller_file, caller_line, caller_name, callee_file, ...), which add
    proven edges. tags: rows already made, e.g. by the incremental index.
    """
    rows = (taggers.tag(files_.indexable(files)) if tags is None else tags).persist()
    symbols = taggers.symbols(rows).persist()
    if symbols.isEmpty():
        found = files_.pattern_symbols(files)
        return Graph(found, files.sparkSession.createDataFrame([], "src string, dst string, proven boolean"), None, True)
    resolved = resolve.resolve(taggers.references(rows), symbols, taggers.imports(rows, files)).persist()
    edges = resolve.edges_of(resolved)
    if precise is not None:
        edges = graph.with_precise(edges, graph.map_precise(symbols, precise, "name"))
    return Graph(symbols, edges.persist(), resolved, errors=taggers.errors(rows))


def _listed(rows: DataFrame | None, most: int = 5) -> str:
    """The first few names of a table's first column, and how many more there are."""
    if rows is None:
        return ""
    name = rows.columns[0]
    found = [r[0] for r in rows.select(name).orderBy(name).limit(most + 1).collect()]
    more = rows.count() - most if len(found) > most else 0
    return ", ".join(found[:most]) + (f" and {more} more" if more else "")


def _unread(files: DataFrame, parse) -> str:
    broken = _listed(files_.unreadable(files, parse))
    return f"Not readable: {broken}." if broken else ""


def symbol_totals(symbols: DataFrame, by: str) -> DataFrame:
    """One row: files, the values of a column (named in the plural), definitions."""
    return symbols.agg(F.countDistinct("file").alias("files"), F.array_sort(F.collect_set(by)).alias(by + "s"), F.count("*").alias("definitions"))


def listed_changes(changed_files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, status, hunks) of the files of a diff."""
    per_file = hunks.groupBy("path").agg(F.count("*").alias("hunks"))
    return changed_files.join(per_file, "path", "left").select("path", "status", F.coalesce("hunks", F.lit(0)).alias("hunks"))


class Repository:
    def __init__(self, spark: SparkSession, root: str | None = None, files: DataFrame | None = None, allowed: list[str] | None = None, commits: DataFrame | None = None, numstat: DataFrame | None = None, precise: DataFrame | None = None) -> None:
        self.spark, self.precise = spark, precise
        self.root = files_.inside_root(root, allowed) if root else None
        self.files = files if files is not None else files_.walk(spark, self.root)
        self.scanned = files if files is not None else files_.walk(spark, self.root, keep_github=True)
        self._log = (commits, numstat) if commits is not None else None

    @cached_property
    def graph(self) -> Graph:
        return build_graph(self.files, self.precise)

    @cached_property
    def has_git(self) -> bool:
        return self._log is not None or bool(self.root and gitlog.available(self.root))

    def _history(self, max_commits: int = 1000) -> DataFrame | None:
        if not self.has_git:
            return None
        log = self._log or gitlog.parse_log(gitlog.log_lines(self.spark, self.root, max_commits))
        return history.file_history(*log, max_commits)

    def stats(self) -> dict:
        """Files read, their languages, definitions, edges, and references that no symbol answers."""
        g = self.graph
        row = symbol_totals(g.symbols, "lang").first()
        unresolved = resolve.unresolved_count(g.resolved).first()["unresolved"] if g.resolved is not None else 0
        return row.asDict() | {"edges": g.edges.count(), "unresolved": unresolved}

    def _notes(self) -> str:
        g = self.graph
        if g.by_pattern:
            return "No tagger knows this repository: definitions come from patterns, and there are no edges."
        notes = ["Edges are read from text: calls through values, reflection and dispatch may be missing."]
        big = [r["path"] for r in files_.oversize(self.files).orderBy("path").limit(5).collect()]
        if big:
            notes.append("Too large to read: " + ", ".join(big))
        if broken := _listed(g.errors):
            notes.append("Not read, as their tagger failed: " + broken)
        langs = {r["lang"] for r in g.symbols.select("lang").distinct().collect()}  # a few names
        if "hcl" in langs:
            notes.append("HCL edges follow addresses, module sources and includes; nothing is evaluated.")
        if langs & {"html", "svelte"}:
            notes.append("Template edges go by name.")
        if not g.edges.where("proven").isEmpty():
            notes.append("Edges marked proven come from a semantic analyser.")
        elif langs & {"go", "rust"}:
            notes.append("An analyser's edges for Go and Rust can be given as a table.")
        return " ".join(notes)

    def _matched(self, query: str) -> tuple[str | None, list[str]]:
        if not query:
            raise ValueError("name a symbol")
        found = [r["qname"] for r in ranking.find_symbols(self.graph.symbols, query).limit(50).collect()]
        return (found[0] if found else None), (found if len(found) > 1 else [])

    def _seed(self, qname: str) -> DataFrame:
        return self.spark.createDataFrame([(qname,)], "seed string")

    # ---- graph ------------------------------------------------------------------------------------

    def trace_flow(self, entry: str, depth: int = 4, form: str = "") -> dict:
        qname, candidates = self._matched(entry)
        if qname is None:
            return {"entry": entry, "matched_symbol": None, "candidates": [], "nodes": None, "truncated": False, "note": "no symbol matches"}
        g = self.graph
        rows, cut = graph.trace(g.edges, self._seed(qname), depth if depth > 0 else 4)
        shown = g.symbols.select("qname", display(F.col("lang"), F.col("recv"), F.col("name")).alias("symbol"), "file", "line")
        out = {"entry": entry, "matched_symbol": qname, "candidates": candidates, "nodes": rows.join(shown, "qname", "left").orderBy("position"), "truncated": cut, "note": self._notes()}
        return out | ({"mermaid": render.sequence(rows, g.symbols)} if form == "mermaid" else {})

    def impact(self, symbol: str) -> dict:
        qname, candidates = self._matched(symbol)
        if qname is None:
            return {"symbol": symbol, "matched_symbol": None, "candidates": [], "impacted_count": 0, "note": "no symbol matches"}
        behind = graph.impact(self.graph.edges, self._seed(qname))
        return {
            "symbol": symbol,
            "matched_symbol": qname,
            "candidates": candidates,
            "ambiguous": bool(candidates),
            "direct_callers": behind.where("depth = 1").select(F.col("node").alias("qname")).orderBy("qname"),
            "transitive_callers": behind.select(F.col("node").alias("qname"), "depth").orderBy("qname"),
            "at_risk_tests": changes.at_risk_tests(behind, self.graph.symbols).orderBy("qname"),
            "impacted_count": behind.count(),
            "note": self._notes(),
        }

    def _scored(self, focus: list[str], weight: float, max_commits: int = 1000) -> DataFrame:
        g = self.graph
        seeds = graph.expand_seeds(g.symbols, self.spark.createDataFrame([(f,) for f in focus], "seed string")) if focus else None
        churn = self._history(max_commits) if weight > 0 else None
        return ranking.scored_symbols(g.symbols, graph.pagerank(g.edges, g.symbols, seeds), graph.caller_counts(g.edges), churn, weight).persist()

    def repo_map(self, focus: list[str] | None = None, max_tokens: int = 1000, churn_weight: float | None = None) -> dict:
        scored = self._scored(focus or [], 0.3 if churn_weight is None else churn_weight)
        chosen = ranking.repo_map(scored, max_tokens)
        total, included = scored.count(), chosen.count()
        return {"map": ranking.repo_map_text(chosen).first()["map"], "symbols": chosen.orderBy("position"), "total_symbols": total, "included": included, "truncated": included < total, "note": self._notes()}

    def context_pack(self, seed: str, max_tokens: int = 4000, max_distance: int = 2) -> dict:
        if not seed:
            raise ValueError("name a symbol or file")
        g = self.graph
        start = ranking.resolve_seed(g.symbols, seed)
        near = graph.neighborhood(g.edges, start.select(F.col("qname").alias("seed")), max_distance if max_distance > 0 else 2)
        scored = self._scored([], 0.3)
        items = ranking.context_pack(near, scored, g.symbols, self.files.select(F.col("path").alias("file"), "content"), max_tokens)
        total, included = near.join(g.symbols, "qname", "left_semi").count(), items.count()
        return {"seed": seed, "matched": start.select("qname").orderBy("qname"), "pack": ranking.joined_text(items, ranking.pack_block(), "pack").first()["pack"], "items": items.orderBy("position"), "total_candidates": total, "included": included, "truncated": included < total, "note": self._notes()}

    def dead_code(self, limit: int = 50, precise: bool = False) -> dict:
        g = self.graph
        found = changes.dead_code(g.symbols, g.edges, precise)
        total = found.count()
        kind = P.callable_kind(F.col("kind"), F.col("recv"))
        return {"orphans": changes.ordered_orphans(found, limit), "scanned_callables": g.symbols.where(kind.isin("function", "method")).count(), "total_found": total, "truncated": total > (limit if limit > 0 else 50), "note": self._notes()}

    def explain_diff(self, base: str | None = None, limit: int = 50, diff: DataFrame | None = None, base_files: DataFrame | None = None) -> dict:
        """diff: lines of a unified diff; else git's against base. Deleted files count with the symbols and callers of the base tree."""
        if diff is None:
            base = base or gitlog.default_base(self.root)
            diff = gitlog.diff_lines(self.spark, self.root, base)
        changed_files, hunks = (x.persist() for x in gitlog.parse_diff(diff))
        listed = listed_changes(changed_files, hunks).orderBy("path")
        if changed_files.isEmpty():
            return {"base": base, "changed_files": listed, "changed_symbols": None, "impacted_count": 0, "truncated": False, "note": "no changes"}
        g = self.graph
        rows, behind = changes.changed_symbols(g.symbols, g.edges, hunks)
        gone = changed_files.where("status = 'D'")
        if not gone.isEmpty() and (base_files is not None or (self.root and base)):
            old = build_graph(base_files if base_files is not None else files_.from_rows(self.spark, gitlog.tree_files(self.root, base)))
            whole = gone.select("path", F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end"))
            more, behind_more = changes.changed_symbols(old.symbols, old.edges, whole)
            rows, behind = rows.unionByName(more), behind.unionByName(behind_more)
        count = rows.count()
        most = limit if limit > 0 else 50
        return {
            "base": base,
            "changed_files": listed,
            "changed_symbols": rows.orderBy(F.desc("impacted_count"), "file", "line", "qname").limit(most),
            "at_risk_tests": changes.at_risk_tests(behind, g.symbols).orderBy("qname"),
            "impacted_count": behind.select("node").distinct().count(),
            "truncated": count > most,
            "note": self._notes(),
        }

    def render_map(self, topic: str, form: str = "html", nodes: DataFrame | None = None, edges: DataFrame | None = None, max_nodes: int = 12, output_path: str | None = None) -> dict:
        """Given nodes(id, label, description, files) and edges(from, to, label), or a map of directories."""
        derived = nodes is None
        if derived:
            g = self.graph
            kept, links = changes.directory_map(g.edges, g.symbols, max_nodes)
            nodes, edges = render.map_graph(kept, links, g.symbols)
        else:
            nodes = nodes.orderBy("id").limit(min(40, max_nodes if max_nodes > 0 else 12))
            ids = nodes.select("id")
            edges = edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
        text = render.html_map(topic, nodes, edges) if form == "html" else render.flowchart(topic, nodes, edges)
        path = guide.write_text(self.root, output_path, text) if output_path else None
        return {"format": form, "content": None if path else text, "path": path, "node_count": nodes.count(), "derived": derived}

    # ---- history and scans --------------------------------------------------------------------------

    def history(self, limit: int = 20, max_commits: int = 1000) -> dict:
        found = self._history(max_commits)
        if found is None:
            return {"files": None, "total_files": 0, "note": "no version control here"}
        return {"files": history.top_history(found, limit), "total_files": found.count(), "note": ""}

    def deps(self, form: str = "", cargo_metadata: DataFrame | None = None) -> dict:
        most = manifests.MAX_MANIFESTS
        every = manifests.manifests(self.scanned, cargo_metadata, most + 1).persist()
        found = every.orderBy("manifest").limit(most)
        sums = manifests.totals(found).first()
        out = {"manifests": found, "total_direct": sums["total_direct"], "indirect": sums["indirect"], "truncated": every.count() > most, "note": _unread(self.scanned, manifests.parse)}
        if form == "mermaid":
            out["mermaid"], cut = manifests.mermaid(found)
            out["truncated"] |= cut
        return out

    def schema(self, strict: bool = False) -> dict:
        entities, columns, links = schema.entities(self.scanned, strict)
        unseen = schema.left_out(self.scanned)
        note = f"{unseen} SQL files beyond the first {schema.MAX_FILES} were not read." if unseen else ""
        return {"entities": entities, "columns": columns, "relationships": links, "mermaid": render.entity_diagram(entities, columns, links), "truncated": unseen > 0, "note": note}

    def routes(self) -> dict:
        most = routes.MAX_ROUTES
        every = routes.routes(self.scanned, max_routes=most + 1).persist()
        total, unseen = every.count(), routes.left_out(self.scanned)
        note = f"{unseen} files beyond the first {routes.MAX_FILES} were not read." if unseen else ""
        return {"routes": every.orderBy("path", "method", "file").limit(most), "total": min(total, most), "truncated": total > most or unseen > 0, "note": note}

    def stacks(self) -> dict:
        most = stacks.MAX_STACKS
        every = stacks.stacks(self.scanned, most + 1).persist()
        total = every.count()
        note = "" if total or self.scanned.where(F.col("path").rlike(r"\.(?:tf|tofu)$")).isEmpty() else "Terraform files without state configuration: a library of modules, or state comes from elsewhere."
        return {"stacks": every.orderBy("path").limit(most), "total": min(total, most), "truncated": total > most, "note": note}

    def recon(self, cargo_targets: DataFrame | None = None) -> dict:
        """cargo_targets: rows of manifests.TARGETS; their programs and libraries are entry points too."""
        files = self.scanned
        labels = {r["facet"]: r["labels"] for r in recon.summary(files).collect()}  # a row a facet
        entries = set(labels.get("entry_point", []))
        if cargo_targets is not None:
            built = cargo_targets.where(F.arrays_overlap("kind", F.array(F.lit("bin"), F.lit("lib"))))
            entries |= {r["src_path"] for r in built.select("src_path").distinct().collect()}  # a workspace's few targets
        churn = self._history()
        notes = []
        if not labels.get("ecosystem"):
            notes.append("No known manifest; most common extensions: " + ", ".join(r["ext"] for r in recon.top_extensions(files).collect()))
        if not labels.get("test_layout"):
            notes.append("No tests found.")
        return {
            "stack": labels.get("ecosystem", []),
            "manifests": labels.get("manifest", []),
            "frameworks": labels.get("framework", []),
            "entry_points": sorted(entries),
            "test_layout": labels.get("test_layout", []),
            "tooling": labels.get("tooling", []),
            "risk_hints": recon.risk_hints(files),
            "dir_tree": recon.folder_tree(files),
            "hotspots": None if churn is None else history.top_history(churn, 8),
            "file_count": files.count(),
            "note": " ".join(notes),
        }

    # ---- guide --------------------------------------------------------------------------------------

    def guide_read(self) -> guide.Guide:
        return guide.read_guide(self.root)

    def guide_write(self, body: str, mode: str = "full") -> str:
        return guide.write_guide(self.root, body, gitlog.head_sha(self.root), gitlog.branch(self.root), mode)

    def guide_delta(self) -> dict:
        """What changed since the guide's revision; current if nothing can have, absent without a guide."""
        known, head = guide.read_guide(self.root), gitlog.head_sha(self.root)
        state = "absent" if not known.exists or not known.sha else "current" if known.current(head) else "changed"
        changed = gitlog.changed_since(self.root, known.sha) if state == "changed" else []
        return {"cached_sha": known.sha, "head_sha": head, "current": state == "current", "state": state, "changed": changed}

    def list_skills(self, skills: dict[str, dict[str, str]], order: list[str] | None = None) -> DataFrame:
        return guide.catalogue(self.spark, skills, order).select("name", "description")

    def get_skill(self, skills: dict[str, dict[str, str]], name: str, aliases: dict[str, str] | None = None) -> DataFrame:
        return guide.skill(guide.catalogue(self.spark, skills), name, aliases).select("name", "content")
