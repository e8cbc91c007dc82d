"""Maps, sequences and entity diagrams as text. Inputs are bounded reports, collected row by row."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import escaped_html, label, node_id, participant_id


def with_ids(nodes: DataFrame, name: str = "dir") -> DataFrame:
    """nodes with an id fit for diagrams; ids that clash get _2, _3 ... by name."""
    from pyspark.sql import Window

    raw = nodes.withColumn("__id", node_id(F.col(name)))
    nth = F.row_number().over(Window.partitionBy("__id").orderBy(name))
    return raw.withColumn("id", F.when(nth == 1, F.col("__id")).otherwise(F.concat("__id", F.lit("_"), nth.cast("string")))).drop("__id")


def flowchart(topic: str, nodes: DataFrame, edges: DataFrame) -> str:
    """Mermaid: nodes(id, label, files) in order of id, edges(from, to, label), and which node stands for which files."""
    shown = nodes.select("id", label(F.col("label")).alias("text"), "files").orderBy("id").collect()
    links = edges.select("from", "to", label(F.coalesce("label", F.lit(""))).alias("text")).orderBy("from", "to").collect()
    lines = [f"%% {topic}", "flowchart LR", *(f'  {n["id"]}["{n["text"]}"]' for n in shown)]
    lines += [f'  {e["from"]} -->|"{e["text"]}"| {e["to"]}' if e["text"] else f"  {e['from']} --> {e['to']}" for e in links]
    lines += ["", "%% legend:", *(f"%%   {n['id']} = {', '.join(n['files'])}" for n in shown if n["files"])]
    return "\n".join(lines) + "\n"


def map_graph(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, label, description, files), edges(from, to, label)) for a renderer of a directory map."""
    from ..functions.scalars import dirname

    files = symbols.select(dirname(F.col("file"), "(root)").alias("dir"), "file").distinct().groupBy("dir").agg(F.array_sort(F.collect_list("file")).alias("names"))
    named = with_ids(nodes).join(files, "dir", "left")
    full = named.select("id", F.col("dir").alias("label"), F.format_string("%d file(s), %d call connection(s)", "files", "degree").alias("description"), F.coalesce("names", F.array().cast("array<string>")).alias("files"))
    a, b = named.select(F.col("dir").alias("from_dir"), F.col("id").alias("from")), named.select(F.col("dir").alias("to_dir"), F.col("id").alias("to"))
    links = edges.join(a, "from_dir").join(b, "to_dir").select("from", "to", F.when(F.col("calls") > 1, F.col("calls").cast("string")).otherwise("").alias("label"))
    return full, links


_PAGE = """<!doctype html>
<meta charset="utf-8"><title>{topic}</title>
<style>body{{font:14px system-ui;margin:0}}svg{{width:100vw;height:80vh;cursor:grab}}rect{{fill:#eef;stroke:#446;rx:6}}path{{stroke:#667;fill:none;marker-end:url(#a)}}#detail{{padding:8px;white-space:pre-wrap}}</style>
<h1>{topic}</h1><svg id="map"><defs><marker id="a" viewBox="0 0 8 8" refX="8" refY="4" markerWidth="7" markerHeight="7" orient="auto"><polygon points="0 0 8 4 0 8"/></marker></defs><g id="view"></g></svg><div id="detail"></div>
<script type="application/json" id="data">{data}</script>
<script>
const {{nodes, edges}} = JSON.parse(document.getElementById("data").textContent), NS = "http://www.w3.org/2000/svg";
const level = Object.fromEntries(nodes.map(n => [n.id, 0]));
for (let round = 0; round < nodes.length; round++)
  for (const e of edges) if (level[e.to] < level[e.from] + 1 && level[e.from] + 1 < nodes.length) level[e.to] = level[e.from] + 1;
const rows = {{}}, place = {{}}, view = document.getElementById("view");
for (const n of nodes) {{ const r = rows[level[n.id]] ??= []; place[n.id] = [40 + 240 * level[n.id], 40 + 70 * r.length]; r.push(n); }}
const draw = (tag, attributes, text) => {{ const x = document.createElementNS(NS, tag); for (const k in attributes) x.setAttribute(k, attributes[k]); if (text) x.textContent = text; view.append(x); return x; }};
for (const e of edges) {{ const [x, y] = place[e.from], [u, v] = place[e.to]; draw("path", {{d: `M${{x + 180}},${{y + 20}} C${{x + 220}},${{y + 20}} ${{u - 40}},${{v + 20}} ${{u}},${{v + 20}}`}}); if (e.label) draw("text", {{x: (x + 180 + u) / 2, y: (y + v) / 2 + 16}}, e.label); }}
for (const n of nodes) {{ const [x, y] = place[n.id], show = () => document.getElementById("detail").textContent = [n.label, n.description, ...n.files].join("\\n"); draw("rect", {{x, y, width: 180, height: 40}}).onclick = show; draw("text", {{x: x + 8, y: y + 25}}, n.label).onclick = show; }}
let box = [0, 0, 1000, 600], held = null; const svg = document.getElementById("map"), set = () => svg.setAttribute("viewBox", box.join(" ")); set();
svg.onwheel = e => {{ e.preventDefault(); const k = e.deltaY > 0 ? 1.1 : 0.9; box[2] *= k; box[3] *= k; set(); }};
svg.onmousedown = e => held = [e.clientX, e.clientY]; onmouseup = () => held = null;
svg.onmousemove = e => {{ if (held) {{ box[0] -= e.clientX - held[0]; box[1] -= e.clientY - held[1]; held = [e.clientX, e.clientY]; set(); }} }};
</script>
"""


def html_map(topic: str, nodes: DataFrame, edges: DataFrame) -> str:
    """A page of its own, without outside parts; data cannot close its script element."""
    data = {"nodes": [r.asDict() for r in nodes.orderBy("id").collect()], "edges": [r.asDict() for r in edges.orderBy("from", "to").collect()]}
    return _PAGE.format(topic=html.escape(topic), data=json.dumps(data, ensure_ascii=False).replace("<", "\\u003c"))


def sequence(trace: DataFrame, symbols: DataFrame) -> str:
    """Mermaid sequence: participants in trace order, a message for each call within the trace."""
    from ..functions.scalars import display

    shown = symbols.select("qname", display(F.col("lang"), F.col("recv"), F.col("name")).alias("shown"))
    rows = trace.join(shown, "qname", "left").select("qname", participant_id(F.col("qname")).alias("id"), F.coalesce("shown", F.substring_index("qname", "::", -1)).alias("shown"), "callees", "position").orderBy("position").collect()
    known = {r["qname"]: r for r in rows}
    lines = ["sequenceDiagram"]
    lines += dict.fromkeys(f"  participant {r['id']} as {r['shown']}" for r in rows)
    lines += [f"  {r['id']}->>{known[c]['id']}: {known[c]['shown']}" for r in rows for c in r["callees"] if c in known]
    return "\n".join(lines) + "\n"


def entity_diagram(entities: DataFrame, columns: DataFrame, links: DataFrame) -> str:
    """Mermaid entity-relationship diagram, entities by name."""
    token = lambda s: re.sub(r"[^A-Za-z0-9_]", "_", s) or "_"
    of: dict[str, list] = {}
    for c in columns.orderBy("entity", "pos").collect():
        of.setdefault(c["entity"], []).append(c)
    lines = ["erDiagram"]
    for e in entities.orderBy("name").collect():
        lines.append(f"  {token(e['name'])} {{")
        for c in of.get(e["name"], []):
            marks = ",".join(m for m, on in (("PK", c["pk"]), ("FK", c["fk"])) if on)
            lines.append(f"    {token(c['type'] or 'unknown')} {token(c['name'])}" + (f" {marks}" if marks else ""))
        lines.append("  }")
    lines += [f'  {token(r["to"])} ||--o{{ {token(r["from"])} : "{r["column"]}"' for r in links.orderBy("from", "to", "column").collect()]
    return "\n".join(lines) + "\n"


__all__ = ["entity_diagram", "escaped_html", "flowchart", "html_map", "map_graph", "sequence", "with_ids"]
