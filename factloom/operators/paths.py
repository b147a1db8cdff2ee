"""Shortest paths of many pairs at once: searches from both ends, all pairs in one frontier table. Joins are
sorted on both sides (hubs aside): of what grows with the pairs, nothing is sent to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import both_ways
from factloom.session import cut

#: Links of one node that are expanded together; those of a hub are dealt in several ways.
HUB_LINKS, BROADCAST_HUBS = 10_000, 100_000


def _dealt(step: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The links with the way that each is dealt by, and how many ways hubs have (None: no hubs)."""
    hubs = step.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > HUB_LINKS)
    hubs = cut(hubs.select("at", F.ceil(F.col("n") / HUB_LINKS).cast("int").alias("ways")))
    n = hubs.limit(BROADCAST_HUBS + 1).count()
    if not n:
        return step.withColumn("way", F.lit(0)), None
    hubs = F.broadcast(hubs) if n <= BROADCAST_HUBS else hubs
    way = F.pmod(F.xxhash64("other"), F.coalesce("ways", F.lit(1))).cast("int")
    return cut(step.join(hubs, "at", "left").select("at", "other", way.alias("way"))), hubs


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 20) -> DataFrame:
    """(pair, length, path) of pairs (pair, source, target) that an undirected path of at most
    `max_hops` joins; path holds the ids from source to target.

    The sides take turns, so each goes half the way. Where they meet first is half a shortest path from
    either end; of several such nodes the least is taken, and the least parent at each step back. A pair
    whose side finds nothing new has no path and is searched no further, nor is one that has met."""
    if not 1 <= max_hops <= 20:
        raise ValueError("max_hops must be from 1 to 20")
    step, hubs = _dealt(cut(both_ways(edges).select("at", "other").where("at <> other").distinct()))
    pairs = cut(pairs.where("pair is not null and source is not null and target is not null").select("pair", "source", "target").distinct())
    none = F.lit(None).cast("string").alias("parent")
    levels = [[pairs.select("pair", F.col(end).alias("id"), none)] for end in ("source", "target")]
    seen = [side[0].select("pair", "id") for side in levels]
    live = pairs.where("source <> target").select("pair")
    out = [pairs.where("source = target").select("pair", F.lit(0).alias("length"), F.array("source").alias("path"))]
    for hop in range(1, max_hops + 1):
        side = (hop - 1) % 2
        front = levels[side][-1].join(live.hint("merge"), "pair", "left_semi").select("pair", F.col("id").alias("at"))
        if hubs is None:
            front = front.withColumn("way", F.lit(0))
        else:
            front = front.join(hubs, "at", "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)))
        new = front.join(step.hint("merge"), ["at", "way"]).groupBy("pair", F.col("other").alias("id")).agg(F.min("at").alias("parent"))
        new = cut(new.join(seen[side].hint("merge"), ["pair", "id"], "left_anti"))
        levels[side].append(new)
        seen[side] = seen[side].unionByName(new.select("pair", "id"))
        met = cut(new.join(seen[1 - side].hint("merge"), ["pair", "id"]).groupBy("pair").agg(F.min("id").alias("id")))
        if met.limit(1).count():
            out.append(_traced(met, levels, hop))
        live = cut(new.select("pair").distinct().join(met.hint("merge"), "pair", "left_anti"))
        if not live.limit(1).count():
            break
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def _traced(met: DataFrame, levels: list[list[DataFrame]], length: int) -> DataFrame:
    """The paths of pairs that meet in (pair, id): back along both sides' parents, a join a step."""
    path = met.select("pair", F.col("id").alias("at"), F.col("id").alias("middle"), F.array("id").alias("path"))
    for side, whole in enumerate(levels):
        for level in whole[:0:-1]:
            before = level.select("pair", F.col("id").alias("at"), "parent")
            more = F.concat(F.array("parent"), "path") if side == 0 else F.concat("path", F.array("parent"))
            path = path.join(before.hint("merge"), ["pair", "at"]).select("pair", F.col("parent").alias("at"), "middle", more.alias("path"))
        path = path.withColumn("at", F.col("middle"))
    return cut(path.select("pair", F.lit(length).alias("length"), "path"))
