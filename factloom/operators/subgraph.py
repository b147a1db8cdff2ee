"""Sub-graph views: base filter, dimension filters, their three modes, facets, and organisations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import bare_edge_id, hash_bucket, org_id
from factloom.operators.graph import both_ways

#: Days of the time windows offered.
WINDOWS = (None, 1, 7, 30, 90)


@dataclass(frozen=True)
class View:
    """A saved view: which departments and locations (none: no constraint), and the mode."""

    departments: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    mode: str = "dim"


def base_filter(vertices: DataFrame, types: list[str] | None = None, min_degree: int = 0, sources: list[str] | None = None, since=None, name: str | None = None) -> DataFrame:
    """Vertices (id, type, name, degree, source, ts) that pass all conditions; a null time passes."""
    out = vertices
    if types:
        out = out.where(F.col("type").isin(types))
    if min_degree:
        out = out.where(F.col("degree") >= min_degree)
    if sources:
        out = out.where(F.col("source").isin(sources))
    if since is not None:
        out = out.where(F.col("ts").isNull() | (F.col("ts") >= since))
    if name:
        out = out.where(F.contains(F.lower("name"), F.lower(F.lit(name))))
    return out


def matched(view: View):
    """Only people are tested: and between dimensions, or within one."""
    ok = F.lit(True)
    if view.departments:
        ok = ok & F.coalesce(F.col("department").isin(list(view.departments)), F.lit(False))
    if view.locations:
        ok = ok & F.coalesce(F.col("location").isin(list(view.locations)), F.lit(False))
    return F.when(F.col("type") == "Person", ok).otherwise(F.lit(True))


def apply(base: DataFrame, all_vertices: DataFrame, edges: DataFrame, view: View) -> DataFrame:
    """(id, matched) of the visible vertices. dim: all of base with the flag; isolate: those
    matched and organisations next to them, in base or not; expand: those matched and their
    neighbours in base."""
    flagged = base.select("id", "type", matched(view).alias("matched"))
    if view.mode == "dim" or not (view.departments or view.locations):
        return flagged.select("id", "matched")
    seeds = flagged.where("matched").select("id")
    near = both_ways(edges).join(seeds.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("other").alias("id")).distinct()
    if view.mode == "isolate":
        more = all_vertices.where("type = 'Organization'").select("id").join(near, "id", "left_semi")
    elif view.mode == "expand":
        more = base.select("id").join(near, "id", "left_semi")
    else:
        raise ValueError(f"unknown mode {view.mode!r}")
    return seeds.withColumn("m", F.lit(1)).unionByName(more.withColumn("m", F.lit(0))).groupBy("id").agg((F.max("m") == 1).alias("matched"))


def induced_links(edges: DataFrame, visible: DataFrame) -> DataFrame:
    v = visible.select("id")
    return edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")


def facets(vertices: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): the distinct values of several columns in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return vertices.select(each.alias("f")).select("f.*").where("value is not null").distinct()


def bootstrap(people: DataFrame, locations: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From people (id, department): people with a location dealt by hash, the organisations of
    both dimensions, and MEMBER_OF edges with their dimension."""
    place = F.element_at(F.array(*map(F.lit, locations)), hash_bucket(F.col("id"), len(locations)) + 1)
    placed = people.withColumn("location", place)
    each = placed.select("id", F.explode(F.array(
        F.struct(F.lit("department").alias("dimension"), F.col("department").alias("name"), org_id("department", F.col("department")).alias("org")),
        F.struct(F.lit("location").alias("dimension"), F.col("location").alias("name"), org_id("location", F.col("location")).alias("org")),
    )).alias("o")).select("id", "o.*").where("name is not null")
    orgs = each.select(F.col("org").alias("id"), F.lit("Organization").alias("type"), "name", "dimension").distinct()
    links = each.select(bare_edge_id(F.col("id"), F.lit("MEMBER_OF"), F.col("org")).alias("edge_id"), F.col("id").alias("src"), F.col("org").alias("dst"), "dimension")
    return placed, orgs, links


def synthesised(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The display's own organisations: `org:dept:` and `org:loc:` vertices and their links."""
    each = people.select("id", F.explode(F.array(F.struct(F.lit("dept").alias("k"), F.col("department").alias("v")), F.struct(F.lit("loc").alias("k"), F.col("location").alias("v")))).alias("o")).where("o.v is not null")
    each = each.select("id", F.concat(F.lit("org:"), "o.k", F.lit(":"), "o.v").alias("org"), F.col("o.v").alias("name"))
    return each.select(F.col("org").alias("id"), F.lit("Organization").alias("type"), "name").distinct(), each.select(F.col("id").alias("src"), F.col("org").alias("dst"), F.lit("MEMBER_OF").alias("relation_type"))
