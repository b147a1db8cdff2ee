"""Pattern queries, statistics, pages and traversal over `nodes` and `edges`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import preview
from factloom.registry import FANOUT, HUB_DEGREE, NODE_TYPES, check_relation, check_type
from factloom.session import cut

#: Ids of a frontier that are broadcast; of larger ones, and of what was seen, nothing is sent to the driver.
FEW_IDS = 10_000

_PATTERN = re.compile(r"\(\s*(\w+)\s*\)\s*-\s*\[\s*(\w+)\s*\]\s*->\s*\(\s*(\w+)\s*\)")


def parse_pattern(text: str) -> tuple[str, str, str]:
    """`(Type)-[RELATION]->(Type)` as a checked triple."""
    m = _PATTERN.fullmatch(text.strip()) if isinstance(text, str) else None
    if m is None:
        raise ValueError(f"not a pattern of the form (Type)-[RELATION]->(Type): {text!r}")
    return check_type(m[1]), check_relation(m[2]), check_type(m[3])


def pattern_query(nodes: DataFrame, edges: DataFrame, pattern: str) -> DataFrame:
    """src, edge_id, dst of a pattern's matches. Both ends are looked up by semi-join on ids, so
    only edges of the relation move."""
    s, r, d = parse_pattern(pattern)
    e = edges.where(F.col("relation_type") == r).select("src", F.col("id").alias("edge_id"), "dst")
    left = nodes.where(F.col("type") == s).select(F.col("id").alias("src"))
    right = nodes.where(F.col("type") == d).select(F.col("id").alias("dst"))
    return e.join(left, "src", "left_semi").join(right, "dst", "left_semi").select("src", "edge_id", "dst")


def page(df: DataFrame, limit: int, offset: int = 0, *order: str, most: int = 100) -> DataFrame:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def stats_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def stats_by_relation(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


def stats(nodes: DataFrame, edges: DataFrame, provenance: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """kind, name, n: counts by node type and relation, and totals, which are sums of these counts
    (so that nodes and edges are read once)."""
    per = {"nodes": stats_by_type(nodes), "edges": stats_by_relation(edges)}
    out = per["nodes"].select(F.lit("node").alias("kind"), F.col("type").alias("name"), "n")
    out = out.unionByName(per["edges"].select(F.lit("edge").alias("kind"), F.col("relation_type").alias("name"), "n"))
    totals = {k: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")) for k, df in per.items()}
    totals |= {k: df.agg(F.count(F.lit(1)).alias("n")) for k, df in (("provenance", provenance), ("source_records", records)) if df is not None}
    for name, df in totals.items():
        out = out.unionByName(df.select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n"))
    return out


def type_directory(nodes: DataFrame) -> DataFrame:
    """All canonical types with their counts, zeros included."""
    types = nodes.sparkSession.createDataFrame([(t,) for t in NODE_TYPES], "type string")
    return F.broadcast(types).join(stats_by_type(nodes), "type", "left").select("type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def both_ways(edges: DataFrame) -> DataFrame:
    """at, other, relation_type, direction for both ends of each edge, from one scan of the edges."""
    way = lambda a, b, d: F.struct(F.col(a).alias("at"), F.col(b).alias("other"), F.lit(d).alias("direction"))
    out = edges.select("relation_type", F.explode(F.array(way("src", "dst", "out"), way("dst", "src", "in"))).alias("w"))
    return out.select("w.at", "w.other", "relation_type", "w.direction")


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int, relation: str | None = None) -> DataFrame:
    """(seed, id, hops): what each seed (column id) reaches in 1 to `depth` undirected hops."""
    if relation is not None:
        edges = edges.where(F.col("relation_type") == check_relation(relation))
    first = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops")).distinct()
    if depth < 1:
        return first.limit(0)
    # links that repeat are not made one: what is found is, and is much less
    step = both_ways(edges).select("at", "other")
    if depth > 1:
        step = cut(step)
    seen, front = first, first
    for k in range(1, depth + 1):
        new = front.join(step, front["id"] == step["at"]).select("seed", F.col("other").alias("id")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hops", F.lit(k))
        if depth > 1:
            new = cut(new)
            if k < depth and not new.limit(1).count():
                break
        seen, front = seen.unionByName(new), new
    return seen.where("hops > 0")


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int) -> list[str] | None:
    """One shortest undirected path as ids, the least parent at each step; None if there is none."""
    if not 1 <= max_hops <= 20:
        raise ValueError("max_hops must be from 1 to 20")
    if source == target:
        return [source]
    spark = edges.sparkSession
    step = cut(both_ways(edges).select("at", "other").where("at <> other").distinct())
    levels = [spark.createDataFrame([(source, None)], "id string, parent string")]
    seen, n = levels[0].select("id"), 1
    for _ in range(max_hops):
        front = levels[-1].select(F.col("id").alias("at")).hint("broadcast" if n <= FEW_IDS else "merge")
        new = cut(front.join(step, "at").groupBy(F.col("other").alias("id")).agg(F.min("at").alias("parent")).join(seen.hint("merge"), "id", "left_anti"))
        if new.where(F.col("id") == target).limit(1).count():
            path = [target]
            for level in [new, *levels[:0:-1]]:  # one row a step
                path.append(level.where(F.col("id") == path[-1]).first()["parent"])
            return path[::-1]
        n = new.count()
        if not n:
            return None
        seen = seen.unionByName(new.select("id"))
        levels.append(new)
    return None


def path_table(edges: DataFrame, source: str, target: str, max_hops: int) -> DataFrame:
    path = shortest_path(edges, source, target, max_hops) or []
    return edges.sparkSession.createDataFrame([(i, p) for i, p in enumerate(path)], "step int, id string")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): both ends count, a loop twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, least: int = HUB_DEGREE) -> DataFrame:
    people = nodes.where("type = 'Person'").select("id")
    return degree(edges).where(F.col("degree") >= least).join(people, "id", "left_semi")


def link_weights(edges: DataFrame) -> DataFrame:
    """Per edge the greater degree of its ends."""
    d = degree(edges)
    e = edges.select("id", "src", "dst")
    a, b = d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), d.select(F.col("id").alias("dst"), F.col("degree").alias("dd"))
    return e.join(a, "src").join(b, "dst").select("id", F.greatest("ds", "dd").alias("weight"))


def distinct_links(edges: DataFrame, order: str = "id", parts: int | None = None) -> DataFrame:
    """One edge for each (src, dst), whatever the relation: the first by `order`. Ids are sorted in
    memory; `parts` says how many tasks share them, where the session's number is too small."""
    if parts is not None:
        edges = edges.repartition(parts, "src", "dst")
    return edges.groupBy("src", "dst").agg(F.min(F.struct(F.col(order).alias("o"), "id", "relation_type")).alias("m")).select("src", "dst", F.col("m.id").alias("id"), F.col("m.relation_type").alias("relation_type"))


def grouped_neighbors(nodes: DataFrame, edges: DataFrame, ids: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(id, relation_type, direction, other, type): at most `fanout` neighbours for each relation."""
    n = both_ways(edges).join(ids.select(F.col("id").alias("at")), "at").distinct()
    r = F.row_number().over(W.partitionBy("at", "relation_type").orderBy("other", "direction"))
    n = n.withColumn("_r", r).where(F.col("_r") <= fanout).drop("_r")
    return n.join(nodes.select(F.col("id").alias("other"), "type"), "other").select(F.col("at").alias("id"), "relation_type", "direction", "other", "type")


def neighbor_previews(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1, most: int = 50) -> DataFrame:
    """(seed, id, type, preview, total): the first `most` of each seed's neighbours by id, and how many
    there are. A hub's neighbours are first cut to `most` in each of 16 parts, so none is ranked whole."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be from 1 to 3")
    found = neighbors(edges, seeds, depth).select("seed", "id")
    total = found.groupBy("seed").agg(F.count(F.lit(1)).alias("total"))
    dealt = W.partitionBy("seed", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy("id")
    some = found.withColumn("_r", F.row_number().over(dealt)).where(F.col("_r") <= most)
    first = some.withColumn("_r", F.row_number().over(W.partitionBy("seed").orderBy("id"))).where(F.col("_r") <= most)
    shown = nodes.select("id", "type", preview(F.col("attributes")).alias("preview"))
    return first.join(shown, "id").join(total, "seed").select("seed", "id", "type", "preview", "total")
