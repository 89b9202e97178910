"""Graphs as TikZ, DOT and HTML text. Lines are made in Spark and joined once, in key order."""

from __future__ import annotations

import json
from string import Template

from pyspark.sql import DataFrame, functions as F

from ..graph import PropertyGraph
from ..operators.forest import Forest

TIKZ_HEAD = "\\usetikzlibrary{graphs,graphdrawing}\n\\usegdlibrary{force,layered,trees}\n"


def _joined(lines: DataFrame, order: list[str], separator: str = "\n") -> str:
    """All lines in order: a single text by definition, so it is put together on the driver."""
    return separator.join(r.line for r in lines.orderBy(*order).select("line").toLocalIterator())


def edge_lines(g: PropertyGraph, arrow: str) -> DataFrame:
    """``(tail, line)``: one line for each tail with its heads."""
    heads = F.array_join(F.transform(F.array_sort(F.collect_list("head")), lambda h: h.cast("string")), ",")
    return g.edges.groupBy("tail").agg(F.format_string(f"%s {arrow} {{%s}};", F.first(F.col("tail").cast("string")), heads).alias("line"))


def tikz_graph(g: PropertyGraph) -> str:
    arrow = "->" if g.directed else "--"
    lone = g.vertices.join(g.edges.select(F.explode(F.array("tail", "head")).alias("key")), "key", "left_anti").select(F.col("key").alias("tail"), F.format_string("%s;", F.col("key").cast("string")).alias("line"))
    body = _joined(edge_lines(g, arrow).unionByName(lone), ["tail"])
    return "\\begin{tikzpicture}\n\\graph [spring layout, nodes={draw, circle}] {\n" + body + "\n};\n\\end{tikzpicture}\n"


def tikz_forest(f: Forest) -> str:
    """Nested text, one tree after the other from its root."""
    children: dict = {}
    roots = []
    for r in f.parents().orderBy("depth", "key").toLocalIterator():
        (roots if r.parent is None else children.setdefault(r.parent, [])).append(r.key)
    texts = []
    for root in roots:
        out, work = [], [(root, False)]
        while work:
            key, closing = work.pop()
            if closing:
                out.append("}")
                continue
            out.append(f"{key}" if not out or out[-1].endswith("{") else f", {key}")
            if key in children:
                out.append(" -- {")
                work.append((key, True))
                work += [(c, False) for c in reversed(children[key])]
        texts.append("".join(out) + ";")
    return "\\begin{tikzpicture}\n\\graph [tree layout, nodes={draw, circle}] {\n" + "\n".join(texts) + "\n};\n\\end{tikzpicture}\n"


def tikz_document(text: str) -> str:
    return TIKZ_HEAD + text


def dot(g: PropertyGraph, shape: str = "circle", attributes: tuple[str, ...] = (), weights: bool = False) -> str:
    """Graphviz text; ``attributes`` names labels that are passed on."""
    arrow = "->" if g.directed else "--"

    def extra(*fixed):
        named = [F.when(F.col("labels")[a].isNotNull(), F.format_string(f'{a}="%s"', F.col("labels")[a])) for a in attributes]
        return F.concat_ws(", ", *fixed, *named)

    v = g.vertices.select(F.lit(0).alias("kind"), F.col("key").cast("string").alias("a"), F.lit("").alias("b"), F.format_string('  "%s" [%s];', F.col("key").cast("string"), extra(F.lit(f"shape={shape}"))).alias("line"))
    label = [F.format_string('label="%s"', F.col("weight").cast("string"))] if weights else []
    e = g.edges.select(F.lit(1).alias("kind"), F.col("tail").cast("string").alias("a"), F.col("head").cast("string").alias("b"), F.format_string(f'  "%s" {arrow} "%s" [%s];', F.col("tail").cast("string"), F.col("head").cast("string"), extra(*label)).alias("line"))
    return f"{'digraph' if g.directed else 'graph'} {json.dumps(g.name)} {{\n{_joined(v.unionByName(e), ['kind', 'a', 'b', 'line'])}\n}}\n"


_PAGE = Template("""<!doctype html>
<meta charset="utf-8"><title>$title</title>
<svg id="view" width="960" height="720"></svg>
<script>
const data = $payload, directed = $directed, view = document.getElementById("view");
const at = new Map(data.nodes.map((n, i) => [n.id, [480 + 320 * Math.cos(6.2832 * i / data.nodes.length), 360 + 320 * Math.sin(6.2832 * i / data.nodes.length)]]));
const add = (kind, set, text) => { const x = document.createElementNS("http://www.w3.org/2000/svg", kind); for (const k in set) x.setAttribute(k, set[k]); if (text) x.textContent = text; view.append(x); };
for (const l of data.links) { const [a, b] = at.get(l.source), [c, d] = at.get(l.target); add("line", {x1: a, y1: b, x2: c, y2: d, stroke: "#888"}); if (directed) add("circle", {cx: c + (a - c) * .08, cy: d + (b - d) * .08, r: 3}); if ("weight" in l) add("text", {x: (a + c) / 2, y: (b + d) / 2}, l.weight); }
for (const n of data.nodes) { const [a, b] = at.get(n.id); add("circle", {cx: a, cy: b, r: 12, fill: "#fff", stroke: "#000"}); add("text", {x: a - 5, y: b + 4}, n.id); }
</script>
""")


def html(g: PropertyGraph, weights: bool = False) -> str:
    """A page of its own with the payload ``{nodes, links}``."""
    nodes = [{"id": str(r.key)} for r in g.vertices.select("key").orderBy("key").toLocalIterator()]
    links = [{"source": str(r.tail), "target": str(r.head)} | ({"weight": r.weight} if weights else {}) for r in g.edges.orderBy("key").toLocalIterator()]
    payload = json.dumps({"nodes": nodes, "links": links}).replace("</", "<\\/")
    return _PAGE.substitute(title=g.name.replace("<", "&lt;"), payload=payload, directed=json.dumps(g.directed))
