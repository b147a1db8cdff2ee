"""One object for the calls of an application: query, read, edit, and report."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import conflict, graph, vfs
from factloom.operators.search import Cascade, Result


class Engine:
    """Reads a graph (nodes, edges, provenance, source_records, conflicts) and answers calls.
    Unknown ids raise KeyError, bad arguments ValueError."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, provenance: DataFrame, records: DataFrame, conflicts: DataFrame, cascade: Cascade):
        self.nodes, self.edges, self.provenance, self.records, self.conflicts, self.cascade = nodes, edges, provenance, records, conflicts, cascade

    def query(self, text: str) -> Result:
        return self.cascade.run(text)

    def _one(self, df: DataFrame, what: str) -> dict:
        row = df.first()
        if row is None:
            raise KeyError(what)
        return row.asDict(recursive=True)

    def node(self, id: str) -> dict:
        out = self._one(self.nodes.where(F.col("id") == id), f"no node {id}")
        out["provenance"] = [r.asDict() for r in self.provenance.where(F.col("node_id") == id).collect()]
        return out

    def edge(self, id: str) -> dict:
        return self._one(self.edges.where(F.col("id") == id), f"no edge {id}")

    def source(self, file: str, record: str) -> dict:
        return self._one(self.records.where((F.col("source_file") == file) & (F.col("source_record_id") == record)), f"no record {file}/{record}")

    def listing(self, type_: str, limit: int = 50, offset: int = 0) -> dict:
        own = self.nodes.where(F.col("type") == type_)
        return {"total": own.count(), "items": [r.asDict(recursive=True) for r in graph.page(own, limit, offset, "id").collect()]}

    def neighbors(self, id: str, depth: int = 1, relation: str | None = None) -> list[str]:
        if not 1 <= depth <= 10:
            raise ValueError("depth must be from 1 to 10")
        self._one(self.nodes.where(F.col("id") == id).select("id"), f"no node {id}")
        seed = self.nodes.sparkSession.createDataFrame([(id,)], "id string")
        return [r["id"] for r in graph.neighbors(self.edges, seed, depth, relation).orderBy("id").collect()]

    def path(self, source: str, target: str, max_hops: int = 6) -> dict:
        found = graph.shortest_path(self.edges, source, target, max_hops)
        if found is None:
            raise KeyError(f"no path from {source} to {target}")
        return {"path": found, "length": len(found) - 1}

    def pattern(self, text: str, limit: int = 50, offset: int = 0) -> dict:
        found = graph.pattern_query(self.nodes, self.edges, text)
        return {"total": found.count(), "items": [r.asDict() for r in graph.page(found, limit, offset, "src", "dst", "edge_id").collect()]}

    def stats(self) -> list[dict]:
        return [r.asDict() for r in graph.stats(self.nodes, self.edges, self.provenance, self.records).orderBy("kind", "name").collect()]

    def open_conflicts(self, limit: int = 50, offset: int = 0, **by) -> dict:
        q = conflict.conflicts(self.conflicts, **by)
        return {"total": q.count(), "items": [r.asDict() for r in graph.page(q, limit, offset, "node_id", "attribute").collect()]}

    def ls(self, path: str = "/", limit: int = 100, offset: int = 0) -> list[dict]:
        return [r.asDict() for r in vfs.ls(self.nodes, path, limit, offset).collect()]


def resolved_fact(provenance: DataFrame, records: DataFrame) -> DataFrame:
    """Provenance rows with the raw value their field names: ingest paths and dotted names alike."""
    key = ["source_file", "source_record_id"]
    path = "concat('$.', regexp_replace(source_field, '^[$][.]?', ''))"
    return provenance.join(records.select(*key, "raw_record"), key).withColumn("traced", F.expr(f"get_json_object(raw_record, {path})"))


def eval_report(title: str, metrics: dict[str, float], path: str | None = None) -> str:
    """A Markdown table of metrics; written to `path` with a time stamp in its name if asked for."""
    now = datetime.now(timezone.utc)
    text = "\n".join([f"# {title}", "", f"{now:%Y-%m-%d %H:%M:%S} UTC", "", "| metric | value |", "|-|-|", *[f"| {k} | {v:.6g} |" for k, v in sorted(metrics.items())], ""])
    if path:
        with open(f"{path}/{now:%Y%m%dT%H%M%S}.md", "w") as f:
            f.write(text)
    return text


def sanitised_schema(schema: dict) -> dict:
    """A JSON schema without references: `$ref` is inlined, `anyOf` becomes its first alternative
    that is not null, keywords outside the common subset are dropped."""
    kept = {"type", "properties", "items", "required", "enum", "description", "nullable", "format", "minimum", "maximum"}
    shared = schema.get("$defs") or schema.get("definitions") or {}

    def clean(s):
        if not isinstance(s, dict):
            return s
        if "$ref" in s:
            return clean(shared[s["$ref"].rsplit("/", 1)[-1]])
        if "anyOf" in s:
            real = [x for x in s["anyOf"] if x.get("type") != "null"]
            return {**clean(real[0]), **({"nullable": True} if len(real) < len(s["anyOf"]) else {})}
        out = {k: v for k, v in s.items() if k in kept}
        if "properties" in out:
            out["properties"] = {k: clean(v) for k, v in out["properties"].items()}
        if "items" in out:
            out["items"] = clean(out["items"])
        return out

    return clean(schema)
