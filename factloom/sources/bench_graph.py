"""The driver's tables as a typed graph: `nodes` and `edges` DataFrames.

Every node type and relation is one branch of a union with its type as a literal, so a filter on
the type leaves one branch and one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import edge_id, json_text
from factloom.session import table

#: Order lines of one task, at most: their pairs are sorted or hashed in memory.
TASK_LINES = 500_000

DAY0 = "timestamp'2024-01-01 00:00:00'"


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[ #]+", "_")


def _node(df: DataFrame, type_: str, id_: Column, attributes: dict[str, Column], updated: Column | None = None) -> DataFrame:
    pairs = [x for k, v in attributes.items() for x in (F.lit(k), json_text(v))]
    at = F.expr(DAY0) if updated is None else updated.cast("timestamp")
    return df.select(id_.alias("id"), F.lit(type_).alias("type"), F.create_map(*pairs).alias("attributes"), F.expr(DAY0).alias("created_at"), at.alias("updated_at"), F.lit(1).cast("long").alias("version"))


def _days(c: Column) -> Column:
    return F.expr(DAY0) + F.make_dt_interval(days=(c % 30).cast("int"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, attributes (name -> JSON text), created_at, updated_at, version."""
    t = lambda n: table(spark, sf_dir, n)
    c, text = F.col, lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    parts = [
        _node(t("customer"), "Person", text("person:", c("c_custkey")), {"name": c("c_name"), "segment": c("c_mktsegment"), "balance": c("c_acctbal"), "nation": c("c_nationkey")}, _days(c("c_custkey"))),
        _node(t("region"), "Organization", text("org:region:", c("r_regionkey")), {"name": c("r_name")}),
        _node(t("nation"), "Organization", text("org:nation:", c("n_nationkey")), {"name": c("n_name")}),
        _node(t("supplier"), "Organization", text("org:supplier:", c("s_suppkey")), {"name": c("s_name"), "balance": c("s_acctbal")}, _days(c("s_suppkey"))),
        _node(t("customer").select("c_mktsegment").distinct(), "Organization", text("org:segment:", slug(c("c_mktsegment"))), {"name": c("c_mktsegment")}),
        _node(t("part"), "Asset", text("asset:", c("p_partkey")), {"name": c("p_name"), "brand": c("p_brand"), "kind": c("p_type"), "size": c("p_size")}, _days(c("p_partkey"))),
        _node(t("orders"), "Event", text("order:", c("o_orderkey")), {"status": c("o_orderstatus"), "priority": c("o_orderpriority"), "total": c("o_totalprice")}, c("o_orderdate")),
        _node(t("events"), "Event", text("event:", c("event_id")), {"kind": c("event_type"), "user": c("user_id"), "value": c("value")}, c("ts")),
        _node(t("conversations"), "Message", text("message:", c("conv_id"), ":", c("turn")), {"role": c("role"), "text": c("text")}),
        _node(t("documents"), "Document", text("doc:", c("doc_id")), {"lang": c("lang"), "source": c("source"), "n_chars": c("n_chars")}),
        _node(t("pages"), "Document", text("page:", c("page_id")), {"url": c("url")}),
        _node(t("part").select("p_brand").distinct(), "Topic", text("topic:brand:", slug(c("p_brand"))), {"name": c("p_brand")}),
        _node(t("documents").select("lang").where("lang is not null").distinct(), "Topic", text("topic:lang:", c("lang")), {"name": c("lang")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the edges are dealt to: by the order lines, which Parquet counts in its footers."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // TASK_LINES))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, dst, relation_type, attributes, version."""
    t = lambda n: table(spark, sf_dir, n)
    c = F.col
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])

    def edge(df: DataFrame, relation: str, src: Column, dst: Column, dimension: str | None = None) -> DataFrame:
        attributes = F.create_map(F.lit("dimension"), F.lit(f'"{dimension}"')) if dimension else F.create_map().cast("map<string,string>")
        return df.select(src.alias("src"), F.lit(relation).alias("relation_type"), dst.alias("dst"), attributes.alias("attributes"))

    n = parts(spark, sf_dir)
    pairs = t("lineitem").select("l_orderkey", "l_partkey").repartition(n, "l_orderkey").distinct()
    orders = t("orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    bought = pairs.join(orders, c("l_orderkey") == c("o_orderkey"))
    branches = [
        edge(t("customer"), "MEMBER_OF", text("person:", c("c_custkey")), text("org:nation:", c("c_nationkey")), "nation"),
        edge(t("nation"), "MEMBER_OF", text("org:nation:", c("n_nationkey")), text("org:region:", c("n_regionkey")), "region"),
        edge(t("supplier"), "MEMBER_OF", text("org:supplier:", c("s_suppkey")), text("org:nation:", c("s_nationkey")), "nation"),
        edge(t("customer"), "MEMBER_OF", text("person:", c("c_custkey")), text("org:segment:", slug(c("c_mktsegment"))), "segment"),
        edge(bought.select("o_custkey", "l_partkey").repartition(n, "o_custkey", "l_partkey").distinct(), "PURCHASED", text("person:", c("o_custkey")), text("asset:", c("l_partkey"))),
        edge(orders, "ASSIGNED_TO", text("order:", c("o_orderkey")), text("person:", c("o_custkey"))),
        edge(pairs, "RELATED_TO", text("order:", c("l_orderkey")), text("asset:", c("l_partkey"))),
        edge(t("part"), "PART_OF", text("asset:", c("p_partkey")), text("topic:brand:", slug(c("p_brand")))),
        edge(t("documents").where("lang is not null"), "TAGGED", text("doc:", c("doc_id")), text("topic:lang:", c("lang"))),
        edge(t("customer").where("c_custkey > 0"), "REPORTS_TO", text("person:", c("c_custkey")), text("person:", F.floor(c("c_custkey") / 4))),
    ]
    out = branches[0]
    for p in branches[1:]:
        out = out.unionByName(p)
    return out.select(edge_id(c("src"), c("relation_type"), c("dst")).alias("id"), "src", "dst", "relation_type", "attributes", F.lit(1).cast("long").alias("version"))
