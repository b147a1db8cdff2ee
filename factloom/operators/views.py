"""What a view shows of nodes: labels, times, places, windows of time and unions of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.jsonpath import as_string
from factloom.operators import graph

#: Attributes a preview is taken from, in order.
PREVIEW_KEYS = ("name", "title", "subject", "summary", "description", "customer_name")
#: Attributes a node's time is taken from, in order.
TIME_KEYS = ("sent_at", "created_at", "timestamp", "date", "occurred_at")
#: The places of departments.
PLACES = {
    "Engineering": "San Francisco", "Information Technology": "Austin", "Finance": "New York", "Business Development": "London",
    "Sales": "Chicago", "BPO": "Manila", "HR": "Seattle", "Management": "Boston",
}
#: The windows offered, in days.
WINDOWS = (None, 1, 7, 30, 90)


def _text(attributes: Column, key: str) -> Column:
    """An attribute that is a JSON text, without its quotes; null for what is none."""
    value = F.try_element_at(attributes, F.lit(key))
    return F.when(value.startswith('"'), as_string(value))


def workflow_preview(type_: Column, attributes: Column) -> Column:
    """`Type: text` of the first of PREVIEW_KEYS that is not blank, cut to 180 characters."""
    found = F.coalesce(*[F.nullif(F.trim(_text(attributes, k)), F.lit("")) for k in PREVIEW_KEYS])
    return F.concat(type_, F.lit(": "), F.coalesce(F.substring(found, 1, 180), F.lit("<no preview>")))


def source_label(source_file: Column) -> Column:
    """The first part of a path with blanks for underscores; null for none."""
    return F.nullif(F.regexp_replace(F.split(source_file, "/")[0], "_", " "), F.lit(""))


def derived_time(attributes: Column) -> Column:
    """The first of TIME_KEYS that is a date text, or a number of milliseconds, as a timestamp."""
    tried = []
    for k in TIME_KEYS:
        value = F.try_element_at(attributes, F.lit(k))
        tried += [F.try_to_timestamp(_text(attributes, k)), F.when(value.rlike(r"^-?[0-9]+$"), F.timestamp_millis(value.cast("long")))]
    return F.coalesce(*tried)


def place(department: Column) -> Column:
    """The place of a department; null for one that is not listed."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv]), department)


def within(rows: DataFrame, days: int | None, as_of: Column, at: str = "updated_at") -> DataFrame:
    """Rows of the last `days` days before `as_of`; all rows for None. Rows without a time go with a window."""
    if days not in WINDOWS:
        raise ValueError(f"days must be one of {WINDOWS}")
    return rows if days is None else rows.where(F.col(at) >= as_of - F.make_dt_interval(days=F.lit(days)))


def provenance_of(provenance: DataFrame, attribute: str, exact: bool = False) -> DataFrame:
    """Provenance rows whose field contains the attribute's name, or that are of that attribute."""
    return provenance.where(F.col("attribute") == attribute if exact else F.col("source_field").contains(attribute))


def max_degree(edges: DataFrame) -> DataFrame:
    return graph.degree(edges).agg(F.coalesce(F.max("degree"), F.lit(0)).cast("long").alias("max_degree"))


def united(nodes: DataFrame, edges: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes and links of several patterns: each node once, and each (source, target) once,
    with the relation of the first pattern that has it (of one pattern, of the least edge id)."""
    found = None
    for k, p in enumerate(patterns):
        m = graph.pattern_query(nodes, edges, p).select("src", "dst", "edge_id", F.lit(k).alias("turn"), F.lit(graph.parse_pattern(p)[1]).alias("relation_type"))
        found = m if found is None else found.unionByName(m)
    links = found.groupBy("src", "dst").agg(F.min(F.struct("turn", "edge_id", "relation_type")).alias("m")).select("src", "dst", "m.edge_id", "m.relation_type")
    ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_semi"), links
