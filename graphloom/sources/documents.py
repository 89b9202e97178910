"""Graphs as files: parquet pairs (the scalable form), and single JSON or YAML documents
``{name, digraph, vertexes, edges}``."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import GraphError
from ..graph import PropertyGraph

VERTEX = "key {k}, value string, weight double, labels map<string,string>"
EDGE = "key {k}, head {k}, tail {k}, weight double, value string, labels map<string,string>"


def document_schema(key: str = "long") -> str:
    v, e = VERTEX.format(k=key), EDGE.format(k=key)
    return f"name string, digraph boolean, vertexes array<struct<{_struct(v)}>>, edges array<struct<{_struct(e)}>>"


def _struct(ddl: str) -> str:
    out = []
    for part in ddl.replace("map<string,string>", "map<string;string>").split(","):
        name, kind = part.split(maxsplit=1)
        out.append(f"{name}:{kind.replace(';', ',')}")
    return ",".join(out)


def to_json(g: PropertyGraph) -> DataFrame:
    """One row ``(value)`` with the document; keys in order. One document is one value: for graphs
    beyond one row's size use :func:`write_pair`."""
    v = g.vertices.select(F.struct("key", "value", "weight", "labels").alias("v")).agg(F.array_sort(F.collect_list("v"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)).alias("vertexes"))
    e = g.edges.select(F.struct("key", "head", "tail", "weight", "value", "labels").alias("e")).agg(F.array_sort(F.collect_list("e"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)).alias("edges"))
    doc = v.crossJoin(e)  # one row each
    return doc.select(F.to_json(F.struct(F.lit(g.name).alias("name"), F.lit(g.directed).alias("digraph"), "vertexes", "edges")).alias("value"))


def to_yaml(g: PropertyGraph) -> str:
    """The document as YAML, emitted row by row; every scalar is JSON, which YAML includes."""
    dump = lambda row: json.dumps(row.asDict(recursive=True), ensure_ascii=False)
    lines = [f"name: {json.dumps(g.name)}", f"digraph: {json.dumps(g.directed)}"]
    for title, rows in (("vertexes", g.vertices.select("key", "value", "weight", "labels")), ("edges", g.edges.select("key", "head", "tail", "weight", "value", "labels"))):
        items = [f"  - {dump(r)}" for r in rows.orderBy("key").toLocalIterator()]
        lines += [f"{title}:", *items] if items else [f"{title}: []"]
    return "\n".join(lines) + "\n"


def parse(text: str) -> dict:
    """A JSON document, or YAML of block mappings and lists with flow scalars."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError:
        return _block_yaml(text)
    return yaml.safe_load(text)


def _block_yaml(text: str) -> dict:
    """The YAML that documents of this kind use, where no YAML library is installed."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "---"))]

    def scalar(s: str):
        s = s.strip()
        try:
            return json.loads(s)
        except ValueError:
            low = s.lower()
            return {"true": True, "false": False, "null": None, "~": None, "": None}.get(low, s.strip("'\""))

    def block(at: int, indent: int):
        if at >= len(rows) or rows[at][0] < indent:
            return None, at
        indent = rows[at][0]
        if rows[at][1].startswith("- ") or rows[at][1] == "-":
            items = []
            while at < len(rows) and rows[at][0] == indent and rows[at][1].startswith("-"):
                rest = rows[at][1][1:].strip()
                if rest and not rest.startswith(("{", "[", '"')) and ": " in rest + " ":
                    rows[at] = (indent + 2, rest)
                    value, at = block(at, indent + 2)
                elif rest:
                    value, at = scalar(rest), at + 1
                else:
                    value, at = block(at + 1, indent + 1)
                items.append(value)
            return items, at
        out = {}
        while at < len(rows) and rows[at][0] == indent and not rows[at][1].startswith("- "):
            name, _, rest = rows[at][1].partition(":")
            if rest.strip():
                out[name.strip().strip("'\"")], at = scalar(rest), at + 1
            else:
                following = rows[at + 1] if at + 1 < len(rows) else (-1, "")
                same = following[0] == indent and following[1].startswith("-")
                out[name.strip().strip("'\"")], at = block(at + 1, indent if same else indent + 1)
        return out, at

    value, at = block(0, 0)
    if at != len(rows) or not isinstance(value, dict):
        raise GraphError("neither JSON nor the YAML of a graph document")
    return value


def from_document(spark: SparkSession, text: str, directed: bool | None = None, key: str | None = None) -> PropertyGraph:
    """A graph from JSON or YAML text, validated; ``directed`` overrides the document's flag."""
    doc = parse(text)
    vs, es = doc.get("vertexes") or [], doc.get("edges") or []
    key = key or ("string" if any(isinstance(v.get("key"), str) for v in vs) else "long")
    edge_key = "string" if any(isinstance(e.get("key"), str) for e in es) else "long"
    text_of = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    labels = lambda r: {str(k): str(v) for k, v in r["labels"].items()} if r.get("labels") else None
    v = spark.createDataFrame([(r["key"], text_of(r.get("value")), float(r.get("weight") or 0), labels(r)) for r in vs], VERTEX.format(k=key))
    e = spark.createDataFrame([(r["key"], r["head"], r["tail"], float(r.get("weight") or 0), text_of(r.get("value")), labels(r)) for r in es], EDGE.replace("key {k}", f"key {edge_key}").format(k=key))
    return PropertyGraph.of(v, e, bool(doc.get("digraph")) if directed is None else directed, doc.get("name") or "")


def read_document(spark: SparkSession, path: str, directed: bool | None = None) -> PropertyGraph:
    return from_document(spark, spark.read.text(path, wholetext=True).first()[0], directed)


def write_pair(g: PropertyGraph, folder: str, mode: str = "errorifexists") -> None:
    """Vertices and edges as two parquet tables, with the name and direction as a third of one row."""
    g.vertices.write.mode(mode).parquet(f"{folder}/vertices")
    g.edges.write.mode(mode).parquet(f"{folder}/edges")
    g.spark.createDataFrame([(g.name, g.directed)], "name string, directed boolean").write.mode(mode).parquet(f"{folder}/graph")


def read_pair(spark: SparkSession, folder: str) -> PropertyGraph:
    meta = spark.read.parquet(f"{folder}/graph").first()
    return PropertyGraph(spark.read.parquet(f"{folder}/vertices"), spark.read.parquet(f"{folder}/edges"), meta.directed, meta.name)


def rows_of(g: PropertyGraph) -> Iterator[str]:
    """JSON lines of the edges, streamed partition by partition."""
    for r in g.edges.select(F.to_json(F.struct("*")).alias("value")).toLocalIterator():
        yield r.value
