"""Workflows over the cascade, the agent loop and its tools, and model extraction.

Models are protocols: anything with the right methods can be attached; without one, deterministic
stand-ins are used. These run on the driver, over small results of the DataFrame operators.
"""

from __future__ import annotations

import inspect
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import CITED_NODE, MESSAGE_ID, preview
from factloom.operators import graph, search, vfs
from factloom.operators.search import Cascade, Result


class Extractor(Protocol):
    def extract(self, prompt: str, schema: dict) -> dict: ...


class Client(Protocol):
    def turn(self, messages: list[dict], tools: list[dict]) -> dict: ...


@dataclass
class CachedExtractor:
    """Answers by a cache first; answers that are not JSON objects are errors."""

    model: Extractor
    cache: dict[str, dict] = field(default_factory=dict)

    def extract(self, key: str, prompt: str, schema: dict) -> dict:
        if key not in self.cache:
            got = self.model.extract(prompt, schema)
            got = json.loads(got) if isinstance(got, str) else got
            if not isinstance(got, dict):
                raise ValueError("a model's answer must be a JSON object")
            self.cache[key] = got
        return self.cache[key]


def grounded(items: DataFrame, source: str = "source_text", surface: str = "surface") -> DataFrame:
    """Extracted items with their confidence: grounded where the source has the surface text
    (without regard to case), else inferred."""
    return items.withColumn("confidence", F.when(F.contains(F.lower(source), F.lower(surface)), F.lit("grounded")).otherwise(F.lit("inferred")))


def _parameter(p: inspect.Parameter) -> dict:
    kinds = {"int": "integer", "str": "string", "dict": "object", "float": "number"}
    return {"type": kinds[str(p.annotation).split(" ")[0]], **({} if p.default in (p.empty, None) else {"default": p.default})}


def _whole(value, least: int, most: int | None, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least or (most is not None and value > most):
        raise ValueError(f"{name} must be an integer from {least}{'' if most is None else f' to {most}'}")
    return value


@dataclass
class Toolbox:
    """The agent's tools over the graph. Arguments outside their bounds are errors: at most 25 hits,
    three hops; neighbours come 50 at most. Tools whose tables are missing (search: `index`, `vectors`
    and `embed`; sources and files: `provenance` and `records`) are not offered. What tools return is
    noted in `cited`, each node or source record once."""

    nodes: DataFrame
    edges: DataFrame
    cascade: Cascade
    provenance: DataFrame | None = None
    records: DataFrame | None = None
    index: search.TextIndex | None = None
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    cited: dict[tuple, None] = field(default_factory=dict)

    def tools(self) -> dict[str, Callable]:
        names = ["search", "get_node", "get_neighbors", "shortest_path", "pattern_query", "stats", "vfs_ls", "vfs_stat", "vfs_tree", "vfs_grep", "vfs_find"]
        names += ["fulltext_search"] if self.index is not None else []
        names += ["vector_search"] if self.vectors is not None and self.embed is not None else []
        names += ["get_source_record", "vfs_cat"] if self.provenance is not None and self.records is not None else []
        return {n: getattr(self, n) for n in names}

    def schemas(self) -> list[dict]:
        """Name, description and a JSON schema of the arguments of each tool."""
        out = []
        for n, f in self.tools().items():
            takes = inspect.signature(f).parameters
            must = [k for k, p in takes.items() if p.default is p.empty]
            out.append({"name": n, "description": inspect.getdoc(f) or n, "parameters": {"type": "object", "properties": {k: _parameter(p) for k, p in takes.items()}, "required": must}})
        return out

    def _cite(self, ids: list[str]) -> None:
        self.cited.update(dict.fromkeys(("node", i) for i in ids))

    def _shown(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.nodes.select("id", "type", preview(F.col("attributes")).alias("preview")), "id")

    def _rows(self, df: DataFrame, id_: str | None = "id") -> list[dict]:
        rows = [r.asDict(recursive=True) for r in df.collect()]
        if id_:
            self._cite([r[id_] for r in rows])
        return rows

    def _query(self, **columns) -> DataFrame:
        kinds = {"query": "string", "vector": "array<double>"}
        return self.nodes.sparkSession.createDataFrame([(0, *columns.values())], ", ".join(["qid int", *[f"{k} {kinds[k]}" for k in columns]]))

    def search(self, query: str, k: int = 10) -> list:
        """Nodes by the tiers of the cascade."""
        hits = self.cascade.run(query).hits[: _whole(k, 1, 25, "k")]
        self._cite([i for i, _ in hits])
        return hits

    def fulltext_search(self, query: str, k: int = 10) -> list[dict]:
        """Nodes by the words of a text, the best first."""
        hits = search.fulltext(self.index, self._query(query=query), _whole(k, 1, 25, "k"))
        return self._rows(self._shown(hits.select("id", "score", "rank")).orderBy("rank"))

    def vector_search(self, query: str, k: int = 10) -> list[dict]:
        """Nodes by the nearness of their vectors to a text's, the nearest first."""
        hits = search.vector_search(self.vectors, self._query(vector=[float(x) for x in self.embed(query)]), _whole(k, 1, 25, "k"))
        return self._rows(self._shown(hits.select("id", "score", "rank")).orderBy("rank"))

    def get_node(self, id: str) -> dict | None:
        """A node's type and preview."""
        rows = self._rows(self.nodes.where(F.col("id") == id).select("id", "type", preview(F.col("attributes")).alias("preview")).limit(1))
        return rows[0] if rows else None

    def get_neighbors(self, id: str, depth: int = 1, relation: str | None = None) -> list[str]:
        """Ids within some hops, over one relation if given."""
        seed = self.nodes.sparkSession.createDataFrame([(id,)], "id string")
        return [r["id"] for r in self._rows(graph.neighbors(self.edges, seed, _whole(depth, 1, 3, "depth"), relation).orderBy("id").limit(50))]

    def shortest_path(self, source: str, target: str, max_hops: int = 6) -> list[str] | None:
        """Ids of a shortest path."""
        found = graph.shortest_path(self.edges, source, target, _whole(max_hops, 1, 20, "max_hops"))
        self._cite(found or [])
        return found

    def pattern_query(self, pattern: str, limit: int = 25, offset: int = 0) -> dict:
        """Matches of (Type)-[RELATION]->(Type), and how many there are."""
        found = graph.pattern_query(self.nodes, self.edges, pattern)
        rows = self._rows(graph.page(found, _whole(limit, 1, 25, "limit"), _whole(offset, 0, None, "offset"), "src", "dst", "edge_id"), None)
        self._cite([r[e] for r in rows for e in ("src", "dst")])
        return {"matches": rows, "total": found.count()}

    def stats(self) -> list[dict]:
        """Counts by type and relation."""
        return self._rows(graph.stats(self.nodes, self.edges).orderBy("kind", "name"), None)

    def get_source_record(self, source_file: str, record_id: str) -> dict:
        """The raw record behind facts."""
        found = self.records.where((F.col("source_file") == source_file) & (F.col("source_record_id") == record_id)).select("source_file", "source_record_id", "raw_record").first()
        if found is None:
            raise KeyError(f"no record {source_file}/{record_id}")
        self.cited[("record", source_file, record_id)] = None
        return found.asDict()

    def vfs_ls(self, path: str = "/", limit: int = 25, offset: int = 0) -> list[dict]:
        """What a directory holds."""
        rows = self._rows(vfs.ls(self.nodes, path, _whole(limit, 1, 100, "limit"), _whole(offset, 0, None, "offset")), None)
        self._cite([r["name"] for r in rows if r["kind"] == "file"])
        return rows

    def vfs_cat(self, path: str) -> dict:
        """A file: the node, its relations, provenance and raw records."""
        out = {k: self._rows(d, None) for k, d in vfs.cat(self.nodes, self.edges, path, self.provenance, self.records).items()}
        if not out["node"]:
            raise KeyError(f"no file {path}")
        self._cite([r["id"] for r in out["node"]])
        self.cited.update(dict.fromkeys(("record", r["source_file"], r["source_record_id"]) for r in out["evidence"]))
        return out

    def vfs_stat(self, path: str) -> dict:
        """What a path names."""
        rows = self._rows(vfs.stat(self.nodes, path, self.provenance), None)
        if not rows:
            raise KeyError(f"nothing at {path}")
        self._cite([rows[0]["id"]] if "id" in rows[0] else [])
        return rows[0]

    def vfs_tree(self, path: str = "/", depth: int = 1) -> list[dict]:
        """Directories and files below a path, three levels at most."""
        return self._rows(vfs.tree(self.nodes, _whole(depth, 1, 3, "depth"), at=path).orderBy("path"), None)

    def vfs_grep(self, query: str, path: str = "/", limit: int = 20) -> list[dict]:
        """Files by the words of their attributes."""
        return self._rows(vfs.grep(self.nodes, query, path, _whole(limit, 1, 25, "limit")).orderBy("rank"))

    def vfs_find(self, type: str | None = None, where: dict | None = None, limit: int = 25) -> list[dict]:
        """The newest files with the given attribute values."""
        json_where = {k: None if v is None else json.dumps(v, ensure_ascii=False) for k, v in (where or {}).items()}
        found = vfs.find(self.nodes, type, json_where, limit=_whole(limit, 1, 25, "limit"))
        return self._rows(found.select("id", "type", "updated_at"))

    def call(self, name: str, arguments: dict) -> dict:
        """A tool's answer; its errors are answers too."""
        tool = self.tools().get(name)
        if tool is None:
            return {"error": f"unknown tool {name}"}
        try:
            return {"result": tool(**arguments)}
        except (TypeError, ValueError, KeyError) as e:
            return {"error": str(e)}


def agent(client: Client, box: Toolbox, query: str, iterations: int = 10, seconds: float = 30.0) -> Result:
    """Lets a client call tools until it answers; the client's own errors are raised. Relevance:
    0.7 for an answer with cited nodes, 0.3 without, 0 if it never answers."""
    messages, began = [{"role": "user", "content": query}], time.monotonic()
    for _ in range(iterations):
        if time.monotonic() - began > seconds:
            break
        reply = client.turn(messages, box.schemas())
        if "answer" in reply:
            cited = cited_ids(reply["answer"])
            extras = {"answer": reply["answer"], "messages": messages, "citations": list(box.cited)}
            return Result("agentic", 0.7 if cited else 0.3, [(i, 1.0) for i in cited], extras=extras)
        for c in reply.get("calls", []):
            messages.append({"role": "tool", "name": c["name"], "content": box.call(c["name"], c.get("arguments", {}))})
    return Result("agentic", 0.0, extras={"messages": messages})


def cited_ids(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(CITED_NODE, text)))


class Workflows:
    """A registry of workflows by unique name; arguments they do not take are left out."""

    def __init__(self):
        self._by: dict[str, Callable] = {}

    def register(self, name: str, make: Callable) -> None:
        if name in self._by:
            raise ValueError(f"workflow {name!r} is registered already")
        self._by[name] = make

    def names(self) -> list[str]:
        return sorted(self._by)

    def run(self, name: str, **kwargs):
        if name not in self._by:
            raise KeyError(f"unknown workflow {name!r}")
        takes = inspect.signature(self._by[name]).parameters
        return self._by[name](**{k: v for k, v in kwargs.items() if k in takes})


def customer_email(box: Toolbox, people: DataFrame, from_address: str, subject: str, body: str) -> dict:
    """The sender by address, their neighbours, what the mail's text finds, and a brief; an unknown
    sender ends it. `people`: id, email."""
    found = people.where(F.lower("email") == from_address.strip().lower()).orderBy("id").limit(1).collect()
    if not found:
        return {"sender": None, "hits": [], "brief": f"No one is known by {from_address}."}
    sender = found[0]["id"]
    near = [(i, 1.0) for i in box.get_neighbors(sender)[:25]]
    hits = box.cascade.run(f"{subject} {body}").hits[:5]
    lines = [f"From {sender}: {subject}", *[f"- {i} ({s:.2f})" for i, s in [*near[:5], *hits]]]
    return {"sender": sender, "neighbors": near, "hits": hits, "brief": "\n".join(lines)}


#: Inline ids of a thread, as `light_entities` finds them.
THREAD_TOKEN = re.compile(MESSAGE_ID)


def thread_summary(box: Toolbox, participants: list[str], messages: list[str], client: Client | None = None, calls: int = 6) -> dict:
    """What every participant and id-like token of a thread find by the hybrid tier, the best score
    of each node. A client may look further with tools, `calls` times at most, and write the brief;
    without one the brief is a list of the hits."""
    best: dict[str, float] = {}
    asked: dict[str, str] = {}
    for q in [*filter(None, map(str.strip, participants)), *(m for t in messages for m in THREAD_TOKEN.findall(t))]:
        asked.setdefault(q.lower(), q)
    for q in asked.values():
        for i, s in box.cascade.tiers.get("hybrid", box.cascade.run)(q).hits[:5]:
            if s > best.get(i, -1.0):
                best[i] = s
    hits = sorted(best.items())
    brief = "\n".join([f"{len(messages)} messages, {len(participants)} participants", *[f"- [node:{i}] {s:.2f}" for i, s in hits]])
    used, said = 0, [{"role": "user", "content": "\n".join([brief, *messages])}]
    while client is not None:
        reply = client.turn(said, box.schemas() if used < calls else [])
        asks = reply.get("calls", [])[: calls - used]
        if "answer" in reply or not asks:
            brief = reply.get("answer", brief)
            break
        for c in asks:
            said.append({"role": "tool", "name": c["name"], "content": box.call(c["name"], c.get("arguments", {}))})
        used += len(asks)
    return {"hits": hits, "brief": brief, "tool_calls": used}
