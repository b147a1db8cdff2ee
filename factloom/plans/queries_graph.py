"""Queries over the graph of the driver's tables: patterns, pages, traversal, views, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import graph, store, subgraph, vfs
from factloom.plans.sql import GRAPH, TYPES, slug
from factloom.session import cut, table
from factloom.sources import bench_graph as g

#: Locations people are dealt to.
LOCATIONS = ["Bangalore", "Berlin", "London", "New York", "Singapore"]


def _pattern(p):
    return lambda s, d: graph.pattern_query(g.nodes(s, d), g.edges(s, d), p).select("src", "edge_id", "dst")


def _pattern_sql(a, r, b, tail=""):
    return f"{GRAPH} SELECT e.src, e.id AS edge_id, e.dst FROM edges e JOIN nodes a ON e.src = a.id AND a.type = '{a}' JOIN nodes b ON e.dst = b.id AND b.type = '{b}' WHERE e.rel = '{r}' {tail}"


def _people(s, d):
    """Vertices for sub-graph views: people, nations and segments with their facets."""
    e = g.edges(s, d).where("relation_type in ('MEMBER_OF', 'REPORTS_TO')")
    c = table(s, d, "customer")
    p = c.select(F.concat(F.lit("person:"), "c_custkey").alias("id"), F.lit("Person").alias("type"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("department"), F.element_at(F.array(*map(F.lit, LOCATIONS)), X.hash_bucket(F.concat(F.lit("person:"), "c_custkey"), 5) + 1).alias("location"))
    o = g.nodes(s, d).where("type = 'Organization'").select("id", "type", F.get_json_object(F.concat(F.lit('{"v":'), F.element_at("attributes", "name"), F.lit("}")), "$.v").alias("name"), F.lit(None).cast("string").alias("department"), F.lit(None).cast("string").alias("location"))
    v = p.unionByName(o).join(graph.degree(e), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    # a narrow table that every view reads several times
    return cut(v.withColumn("source", F.col("type")).withColumn("ts", F.lit(None).cast("timestamp"))), e


_PEOPLE = f"""{GRAPH}, e AS (SELECT * FROM edges WHERE rel IN ('MEMBER_OF', 'REPORTS_TO')),
digits AS (SELECT c_custkey, c_name, c_mktsegment, list_sum(list_transform(string_split(sha256('person:' || c_custkey), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS INTEGER))) % 5 AS b FROM customer),
v0 AS (
  SELECT 'person:' || c_custkey AS id, 'Person' AS type, c_name AS name, c_mktsegment AS department, ['Bangalore', 'Berlin', 'London', 'New York', 'Singapore'][CAST(b AS INTEGER) + 1] AS location FROM digits
  UNION ALL SELECT id, type, name, NULL, NULL FROM nodes WHERE type = 'Organization'
), deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
v AS (SELECT v0.*, coalesce(degree, 0) AS degree FROM v0 LEFT JOIN deg ON v0.id = deg.id),
base AS (SELECT * FROM v WHERE degree >= 2),
flagged AS (SELECT id, type, CASE WHEN type = 'Person' THEN coalesce(department IN ('BUILDING', 'MACHINERY') AND location IN ('Berlin', 'London'), FALSE) ELSE TRUE END AS m FROM base),
seeds AS (SELECT id FROM flagged WHERE m),
near AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM seeds) UNION SELECT DISTINCT src FROM e WHERE dst IN (SELECT id FROM seeds))"""
_VIEW = dict(departments=("BUILDING", "MACHINERY"), locations=("Berlin", "London"))


def _view(mode):
    def run(s, d):
        v, e = _people(s, d)
        return subgraph.apply(subgraph.base_filter(v, min_degree=2), v, e, subgraph.View(mode=mode, **_VIEW))

    return run


def _visible(s, d):
    v, e = _people(s, d)
    seen = cut(subgraph.apply(subgraph.base_filter(v, min_degree=2), v, e, subgraph.View(mode="isolate", **_VIEW)))
    return subgraph.induced_links(e, seen).select("id", "src", "dst")


def _near(depth, relation, seed):
    return lambda s, d: graph.neighbors(g.edges(s, d).where("relation_type in ('MEMBER_OF', 'REPORTS_TO', 'PURCHASED')"), s.createDataFrame([(seed,)], "id string"), depth, relation).select("id", F.col("hops").cast("long").alias("hops"))


def _near_sql(depth, relation, seed):
    only = f"rel = '{relation}'" if relation else "rel IN ('MEMBER_OF', 'REPORTS_TO', 'PURCHASED')"
    return f"""{GRAPH}, w AS (SELECT src AS a, dst AS b FROM edges WHERE {only} UNION SELECT dst, src FROM edges WHERE {only}),
walk(id, hops) AS (SELECT '{seed}', 0 UNION SELECT w.b, hops + 1 FROM walk JOIN w ON walk.id = w.a WHERE hops < {depth})
SELECT id, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY id HAVING min(hops) > 0"""


def _bootstrap(which):
    def run(s, d):
        p = table(s, d, "customer").select(F.concat(F.lit("person:"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("department"))
        _, orgs, links = subgraph.bootstrap(p, LOCATIONS)
        return orgs.select("id", "name", "dimension") if which == "orgs" else links

    return run


_BOOT = f"""WITH digits AS (SELECT 'person:' || c_custkey AS id, c_mktsegment AS department, list_sum(list_transform(string_split(sha256('person:' || c_custkey), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS INTEGER))) % 5 AS b FROM customer),
placed AS (SELECT id, department, ['Bangalore', 'Berlin', 'London', 'New York', 'Singapore'][CAST(b AS INTEGER) + 1] AS location, CAST(b AS INTEGER) AS bucket FROM digits),
orgs AS (SELECT id, 'org:department:' || replace(lower(department), ' ', '_') AS org, department AS name, 'department' AS dimension FROM placed UNION ALL SELECT id, 'org:location:' || replace(lower(location), ' ', '_'), location, 'location' FROM placed)"""


def _deleted(s, d):
    """What is left after deleting every tenth customer, by table."""
    n, e = g.nodes(s, d).where("type = 'Person'"), g.edges(s, d).where("relation_type in ('MEMBER_OF', 'REPORTS_TO')")
    prov = n.select(F.col("id").alias("node_id"), F.lit(None).cast("string").alias("edge_id")).unionByName(e.select(F.lit(None).cast("string").alias("node_id"), F.col("id").alias("edge_id")))
    gone = table(s, d, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("person:"), "c_custkey").alias("id"))
    a, b, c = store.delete_nodes(gone, n, e, prov)
    one = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n")
    return one(a, "nodes").unionByName(one(b, "edges")).unionByName(one(c, "provenance"))


def _preview(s, d):
    return g.nodes(s, d).where("type in ('Person', 'Organization', 'Topic')").select("id", X.preview(F.col("attributes")).alias("preview"), X.display_name(F.col("attributes"), F.col("id")).alias("display"))


def _embedding_text(s, d):
    return g.nodes(s, d).where("type = 'Person'").select("id", X.embedding_text(F.col("type"), F.map_filter("attributes", lambda k, v: k != "balance")).alias("text"))


def _find(s, d):
    n = g.nodes(s, d).where("type = 'Asset'")
    return vfs.find(n, "Asset", {"brand": '"Brand#1"'}, limit=100).select("id", F.col("updated_at").cast("string").alias("updated_at"))


_MEMBERS = " UNION ALL ".join([
    "SELECT 'person:' || c_custkey, 'org:nation:' || c_nationkey FROM customer",
    "SELECT 'org:nation:' || n_nationkey, 'org:region:' || n_regionkey FROM nation",
    "SELECT 'org:supplier:' || s_suppkey, 'org:nation:' || s_nationkey FROM supplier",
    f"SELECT 'person:' || c_custkey, 'org:segment:' || {slug('c_mktsegment')} FROM customer",
])


QUERIES = {
    "pattern_member_of": (_pattern("(Person)-[MEMBER_OF]->(Organization)"), _pattern_sql("Person", "MEMBER_OF", "Organization")),
    "pattern_purchased": (_pattern("(Person)-[PURCHASED]->(Asset)"), _pattern_sql("Person", "PURCHASED", "Asset")),
    "pattern_tagged": (_pattern("(Document)-[TAGGED]->(Topic)"), _pattern_sql("Document", "TAGGED", "Topic")),
    "pattern_page": (lambda s, d: graph.page(_pattern("(Event)-[ASSIGNED_TO]->(Person)")(s, d), 50, 100, "src", "dst", "edge_id"), _pattern_sql("Event", "ASSIGNED_TO", "Person", "ORDER BY e.src, e.dst, e.id LIMIT 50 OFFSET 100")),
    "pattern_total": (lambda s, d: _pattern("(Event)-[RELATED_TO]->(Asset)")(s, d).agg(F.count(F.lit(1)).alias("total")), f"SELECT count(*) AS total FROM ({_pattern_sql('Event', 'RELATED_TO', 'Asset')})"),
    "graph_stats": (lambda s, d: graph.stats(g.nodes(s, d), g.edges(s, d)), f"{GRAPH} SELECT 'node' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY rel UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges"),
    "nodes_page": (lambda s, d: graph.page(g.nodes(s, d).where("type = 'Person'").select("id", "type", "version"), 50, 25, "id"), f"{GRAPH} SELECT id, type, CAST(1 AS BIGINT) AS version FROM nodes WHERE type = 'Person' ORDER BY id LIMIT 50 OFFSET 25"),
    "vfs_ls_root": (lambda s, d: vfs.ls(g.nodes(s, d), "/"), f"{GRAPH} SELECT t.type AS name, 'dir' AS kind, t.type, count(n.id) AS n FROM {TYPES} LEFT JOIN nodes n ON n.type = t.type GROUP BY t.type"),
    "vfs_ls_type": (lambda s, d: vfs.ls(g.nodes(s, d), "/Asset/", 40, 10).select("name", "kind", "type"), f"{GRAPH} SELECT id AS name, 'file' AS kind, type FROM nodes WHERE type = 'Asset' ORDER BY id LIMIT 40 OFFSET 10"),
    "vfs_tree_root": (lambda s, d: vfs.tree(g.nodes(s, d), 2).select("path", "kind", F.col("child_count").alias("n")), f"{GRAPH} SELECT '/' || t.type || '/' AS path, 'dir' AS kind, count(n.id) AS n FROM {TYPES} LEFT JOIN nodes n ON n.type = t.type GROUP BY t.type UNION ALL SELECT '/' || type || '/' || id, 'file', 0 FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS r FROM nodes) WHERE r <= 100"),
    "vfs_stat_dir": (lambda s, d: vfs.stat(g.nodes(s, d), "/Event/"), f"{GRAPH} SELECT 'Event' AS type, count(*) AS n FROM nodes WHERE type = 'Event'"),
    "vfs_cat_relations": (
        lambda s, d: graph.grouped_neighbors(g.nodes(s, d), g.edges(s, d), g.nodes(s, d).where("type = 'Organization'").select("id")),
        # organisations have edges of one relation only, and these lead to persons and organisations
        f"""WITH e(src, dst) AS ({_MEMBERS}), b AS (SELECT dst AS at_id, src AS other, 'in' AS direction FROM e UNION SELECT src, dst, 'out' FROM e WHERE src LIKE 'org:%'),
r AS (SELECT *, row_number() OVER (PARTITION BY at_id ORDER BY other, direction) AS k FROM b)
SELECT at_id AS id, 'MEMBER_OF' AS relation_type, direction, other, CASE WHEN other LIKE 'person:%' THEN 'Person' ELSE 'Organization' END AS type FROM r WHERE k <= 25""",
    ),
    "vfs_find_where": (_find, "SELECT id, CAST(u AS VARCHAR) AS updated_at FROM (SELECT 'asset:' || p_partkey AS id, p_brand, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 30 AS INTEGER)) AS u FROM part ORDER BY u DESC, id LIMIT 400) WHERE p_brand = 'Brand#1' ORDER BY u DESC, id LIMIT 100"),
    "vfs_find_recent": (
        lambda s, d: vfs.find(g.nodes(s, d), "Event", modified_after=F.lit("2024-01-29").cast("timestamp"), limit=100).select("id"),
        "SELECT id FROM (SELECT * FROM (SELECT 'order:' || o_orderkey AS id, o_orderdate AS u FROM orders UNION ALL SELECT 'event:' || event_id, ts FROM events) ORDER BY u DESC, id LIMIT 400) WHERE u >= TIMESTAMP '2024-01-29' ORDER BY u DESC, id LIMIT 100",
    ),
    "neighbors_d1": (_near(1, None, "person:5"), _near_sql(1, None, "person:5")),
    "neighbors_d2_typed": (_near(2, "REPORTS_TO", "person:5"), _near_sql(2, "REPORTS_TO", "person:5")),
    "neighbors_d3": (_near(3, None, "person:5"), _near_sql(3, None, "person:5")),
    "shortest_path_ids": (
        lambda s, d: graph.path_table(g.edges(s, d).where("relation_type = 'REPORTS_TO'"), "person:37", "person:100", 12).select(F.col("step").cast("long").alias("step"), "id"),
        "WITH RECURSIVE up(k, n) AS (SELECT 37, 0 UNION ALL SELECT k // 4, n + 1 FROM up WHERE k > 0), up2(k, n) AS (SELECT 100, 0 UNION ALL SELECT k // 4, n + 1 FROM up2 WHERE k > 0), meet AS (SELECT up.k, up.n AS a, up2.n AS b FROM up JOIN up2 ON up.k = up2.k ORDER BY up.n LIMIT 1) SELECT CAST(n AS BIGINT) AS step, 'person:' || up.k AS id FROM up, meet WHERE n <= a UNION ALL SELECT CAST(a + b - n AS BIGINT), 'person:' || up2.k FROM up2, meet WHERE n < b",
    ),
    "degree": (lambda s, d: graph.degree(g.edges(s, d)), f"{GRAPH} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id"),
    "hubs": (lambda s, d: graph.hubs(g.nodes(s, d), g.edges(s, d)), f"{GRAPH} SELECT x.id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) x JOIN nodes n ON x.id = n.id AND n.type = 'Person' GROUP BY x.id HAVING count(*) >= 12"),
    "link_weight": (lambda s, d: graph.link_weights(g.edges(s, d).where("relation_type in ('MEMBER_OF', 'REPORTS_TO')")), f"{GRAPH}, e AS (SELECT * FROM edges WHERE rel IN ('MEMBER_OF', 'REPORTS_TO')), deg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT e.id, greatest(a.n, b.n) AS weight FROM e JOIN deg a ON e.src = a.id JOIN deg b ON e.dst = b.id"),
    "link_dedup": (lambda s, d: graph.distinct_links(g.edges(s, d), parts=2 * g.parts(s, d)), f"{GRAPH} SELECT src, dst, min(id) AS id, arg_min(rel, id) AS relation_type FROM edges GROUP BY src, dst"),
    "subgraph_dim": (_view("dim"), f"{_PEOPLE} SELECT id, m AS matched FROM flagged"),
    "subgraph_isolate": (_view("isolate"), f"{_PEOPLE} SELECT id, bool_or(m) AS matched FROM (SELECT id, TRUE AS m FROM seeds UNION ALL SELECT near.id, FALSE FROM near JOIN v ON near.id = v.id AND v.type = 'Organization') GROUP BY id"),
    "subgraph_expand": (_view("expand"), f"{_PEOPLE} SELECT id, bool_or(m) AS matched FROM (SELECT id, TRUE AS m FROM seeds UNION ALL SELECT near.id, FALSE FROM near JOIN base ON near.id = base.id) GROUP BY id"),
    "induced_links": (_visible, f"{_PEOPLE}, seen AS (SELECT id FROM seeds UNION SELECT near.id FROM near JOIN v ON near.id = v.id AND v.type = 'Organization') SELECT e.id, src, dst FROM e WHERE src IN (SELECT id FROM seen) AND dst IN (SELECT id FROM seen)"),
    "facets": (lambda s, d: subgraph.facets(_people(s, d)[0], ["source", "department", "location"]), f"{_PEOPLE} SELECT DISTINCT * FROM (SELECT 'source' AS facet, type AS value FROM v UNION ALL SELECT 'department', department FROM v UNION ALL SELECT 'location', location FROM v) WHERE value IS NOT NULL"),
    "org_bootstrap_nodes": (_bootstrap("orgs"), f"{_BOOT} SELECT DISTINCT org AS id, name, dimension FROM orgs"),
    "org_bootstrap_edges": (_bootstrap("links"), f"{_BOOT} SELECT 'edge_' || substring(sha256(id || '|MEMBER_OF|' || org), 1, 24) AS edge_id, id AS src, org AS dst, dimension FROM orgs"),
    "hash_bucket_location": (lambda s, d: table(s, d, "customer").select("c_custkey", X.hash_bucket(F.concat(F.lit("person:"), "c_custkey")).alias("bucket")), f"{_BOOT} SELECT CAST(substring(id, 8) AS BIGINT) AS c_custkey, bucket FROM placed"),
    "edge_ids": (lambda s, d: g.edges(s, d).where("relation_type = 'PART_OF'").select("id", "src", "dst"), f"{GRAPH} SELECT id, src, dst FROM edges WHERE rel = 'PART_OF'"),
    "node_delete_cascade": (_deleted, f"{GRAPH}, gone AS (SELECT 'person:' || c_custkey AS id FROM customer WHERE c_custkey % 10 = 0), n AS (SELECT id FROM nodes WHERE type = 'Person' AND id NOT IN (SELECT id FROM gone)), e AS (SELECT id FROM edges WHERE rel IN ('MEMBER_OF', 'REPORTS_TO') AND src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) SELECT 'nodes' AS name, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'provenance', (SELECT count(*) FROM n) + (SELECT count(*) FROM e)"),
    "preview": (_preview, f"{GRAPH} SELECT id, name AS preview, name AS display FROM nodes WHERE type IN ('Person', 'Organization', 'Topic')"),
    "embedding_text": (_embedding_text, "SELECT 'person:' || c_custkey AS id, 'Person | name: ' || c_name || ' | nation: ' || c_nationkey || ' | segment: ' || c_mktsegment AS text FROM customer"),
}
del slug
