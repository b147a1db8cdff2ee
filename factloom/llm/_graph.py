"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before shuffling, so a vertex of very many edges is
cheap) and a join with it. Vertices of more than ``HUB`` edges, and of more than a
``HUBS``-th of all edges, are joined by broadcast: there are at most 2 * ``HUBS`` of those, and their edges stay
where they are. Nothing is gathered on the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, discard, release

HUB = 1000
HUBS = 50_000


def _joined(e: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """Edges (u, v) with the least neighbour m of u; `least` has u, m and n, the number of edges."""
    hubs = least.where(F.col("n") > most).select(F.col("u").alias("hu"), F.col("m").alias("hm"))
    e = e.join(F.broadcast(hubs), F.col("u") == F.col("hu"), "left")
    # a hub's edges are dealt out evenly, to where no vertex matches them
    hub = F.col("hu").isNotNull()
    e = e.select("u", "v", "hm", F.when(hub, F.xxhash64("v")).otherwise(F.col("u")).alias("k"), hub.alias("z"))
    rest = least.where(F.col("n") <= most).select(F.col("u").alias("k"), F.lit(False).alias("z"), "m")
    return e.join(rest, ["k", "z"], "left").select("u", "v", F.coalesce("hm", "m").alias("m"))


def _star(e: DataFrame, large: bool, most: int) -> DataFrame:
    """e: (u, v) with u > v. Large: greater neighbours of u point to its least; small: all that
    are not greater do."""
    if large:
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = e.unionByName(turned).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        out = _joined(turned, least, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        out = _joined(e, least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, component) for each vertex of `edges` (columns a and b, long): the least vertex it
    reaches. Loops and null ends are ignored; no edges give no rows."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = (e.count(), None)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        most = max(HUB, mark[0] // HUBS)
        before, e = e, cut(_star(_star(e, True, most), False, most))
        discard(before)
        release(edges.sparkSession)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(e.select("v", F.col("v").alias("component")).distinct())
