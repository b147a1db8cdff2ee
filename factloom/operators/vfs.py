"""A read-only file system over the graph: `/`, `/Type/` and `/Type/id`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import attributes_json, preview
from factloom.operators import graph, search
from factloom.registry import SCAN_CAP, check_type


def path(type_: Column, id_: Column) -> Column:
    return F.concat(F.lit("/"), type_, F.lit("/"), id_)


def parse(p: str) -> tuple[str | None, str | None]:
    """(type, id) of a path; None for what it does not reach."""
    if not isinstance(p, str) or not p.startswith("/"):
        raise ValueError(f"a path starts with '/': {p!r}")
    parts = [x for x in p.split("/") if x]
    if len(parts) > 2:
        raise ValueError(f"no path has three parts: {p!r}")
    return (check_type(parts[0]) if parts else None, parts[1] if len(parts) == 2 else None)


def ls(nodes: DataFrame, p: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """(name, kind, type, n) of a directory."""
    t, i = parse(p)
    if i is not None:
        raise ValueError(f"{p!r} is a file")
    if t is None:
        d = graph.type_directory(nodes)
        return d.select(F.col("type").alias("name"), F.lit("dir").alias("kind"), "type", "n").orderBy("name")
    page = graph.page(nodes.where(F.col("type") == t).select("id", "type"), limit, offset, "id")
    return page.select(F.col("id").alias("name"), F.lit("file").alias("kind"), "type", F.lit(None).cast("long").alias("n"))


def stat(nodes: DataFrame, p: str, provenance: DataFrame | None = None) -> DataFrame:
    t, i = parse(p)
    if i is None:
        d = graph.type_directory(nodes)
        return (d.where(F.col("type") == t) if t else d.agg(F.lit("/").alias("type"), F.sum("n").alias("n"))).select("type", "n")
    own = nodes.where((F.col("id") == i) & (F.col("type") == t)).select("id", "type", "created_at", "updated_at", "version")
    if provenance is None:
        return own
    p_ = provenance.where(F.col("node_id") == i).groupBy("node_id").agg(F.sort_array(F.collect_set("source_file")).alias("source_files"), F.count(F.lit(1)).alias("n_provenance"))
    return own.join(p_, own["id"] == p_["node_id"], "left").drop("node_id")


def tree(nodes: DataFrame, depth: int = 1, per_type: int = 100, at: str = "/") -> DataFrame:
    """(depth, path, name, kind, type, node_id, child_count) below the root, or below the directory
    `at`, whose files are its first level; of a file, that file. At most `per_type` files a directory."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be from 1 to 3")
    t, i = parse(at)
    own = nodes.select("id", "type")
    if t is not None:
        own = own.where(F.col("type") == t)
    if i is not None:
        own = own.where(F.col("id") == i)
    r = F.row_number().over(W.partitionBy("type").orderBy("id"))
    level = 2 if t is None else 1
    files = own.withColumn("_r", r).where(F.col("_r") <= per_type)
    files = files.select(F.lit(level).alias("depth"), path(F.col("type"), F.col("id")).alias("path"), F.col("id").alias("name"), F.lit("file").alias("kind"), "type", F.col("id").alias("node_id"), F.lit(0).cast("long").alias("child_count"))
    if t is not None:
        return files
    d = graph.type_directory(nodes)
    top = d.select(F.lit(1).alias("depth"), F.concat(F.lit("/"), "type", F.lit("/")).alias("path"), F.col("type").alias("name"), F.lit("dir").alias("kind"), "type", F.lit(None).cast("string").alias("node_id"), F.col("n").alias("child_count"))
    return top if depth == 1 else top.unionByName(files)


def cat(nodes: DataFrame, edges: DataFrame, p: str, provenance: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """The parts of a file: node, relations, provenance, and the raw records behind it (a record
    that is missing is an error)."""
    t, i = parse(p)
    if i is None:
        raise ValueError(f"{p!r} is a directory")
    node = nodes.where((F.col("id") == i) & (F.col("type") == t))
    own = provenance.where(F.col("node_id") == i)
    return {"node": node, "relations": graph.grouped_neighbors(nodes, edges, node.select("id")), "provenance": own, "evidence": evidence(own, records)}


def evidence(provenance: DataFrame, records: DataFrame) -> DataFrame:
    """The distinct raw records of provenance rows."""
    key = ["source_file", "source_record_id"]
    want = provenance.select(*key).distinct()
    j = want.join(records.select(*key, "raw_record"), key, "left")
    return j.withColumn("raw_record", F.coalesce("raw_record", F.raise_error(F.concat(F.lit("no raw record "), *[F.coalesce(c, F.lit("null")) for c in key]))))


def grep(nodes: DataFrame, query: str, p: str = "/", limit: int = 20) -> DataFrame:
    """(id, type, score, preview): BM25 over the scope's attributes, keys included."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    t, _ = parse(p)
    scope = nodes.where(F.col("type") == t) if t else nodes
    q = nodes.sparkSession.createDataFrame([(0, query)], "qid int, query string")
    hits = search.fulltext(search.text_index(scope.select("id", attributes_json(F.col("attributes")).alias("text"))), q, limit)
    return hits.join(scope.select("id", "type", preview(F.col("attributes")).alias("preview")), "id").select("id", "type", "score", "preview", "rank")


def where_equal(attributes: Column, where: dict[str, str | None]) -> Column:
    """All keys equal JSON texts; None matches missing and null."""
    ok = F.lit(True)
    for k, v in where.items():
        got = F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit("null"))
        ok = ok & (got.isNull() if v is None else got.eqNullSafe(F.lit(v)))
    return ok


def find(nodes: DataFrame, type_: str | None = None, where: dict[str, str | None] | None = None, modified_after=None, limit: int = 50, scan_cap: int | None = SCAN_CAP) -> DataFrame:
    """The newest `scan_cap` nodes, then filtered (None: all are)."""
    n = nodes.where(F.col("type") == check_type(type_)) if type_ else nodes
    if modified_after is not None and scan_cap is None:
        n = n.where(F.col("updated_at") >= modified_after)
    if scan_cap is not None:
        n = n.orderBy(F.desc_nulls_last("updated_at"), "id").limit(scan_cap)
        if modified_after is not None:
            n = n.where(F.col("updated_at") >= modified_after)
    return n.where(where_equal(F.col("attributes"), where or {})).orderBy(F.desc_nulls_last("updated_at"), "id").limit(limit)
