"""Queries over the store, evaluation data and views, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import conflict, evals, ingest, store, views
from factloom.plans.sql import GRAPH
from factloom.session import table
from factloom.sources import bench_graph as g

_c = F.col
_s = lambda c: F.col(c).cast("string")


def _orders(s, d):
    return table(s, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("k"), F.concat(F.lit("person:"), "o_custkey").alias("person"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("at"))


def _node_merge(s, d):
    o = _orders(s, d).withColumn("type", F.lit("Event"))
    stored = o.where("k % 3 <> 0").select("id", "type", _c("at").alias("created_at"), _c("at").alias("updated_at"), F.lit(2).cast("long").alias("version"))
    coming = o.where("k % 2 = 0").withColumn("at", F.expr("at + interval 1 day"))
    coming = coming.unionByName(coming.where("k % 4 = 0")).select("id", "type", _c("at").alias("updated_at"))
    return store.merge_nodes(stored, coming).select("id", "type", _s("created_at").alias("created_at"), _s("updated_at").alias("updated_at"), "version")


_NODE_MERGE = """WITH o AS (SELECT 'order:' || o_orderkey AS id, o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders)
SELECT id, 'Event' AS type, CAST(CASE WHEN k % 3 <> 0 THEN day ELSE day + INTERVAL 1 DAY END AS VARCHAR) AS created_at, CAST(CASE WHEN k % 2 = 0 THEN day + INTERVAL 1 DAY ELSE day END AS VARCHAR) AS updated_at,
  CAST(CASE WHEN k % 3 <> 0 THEN 2 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 2 WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS version FROM o WHERE k % 3 <> 0 OR k % 2 = 0"""


def _edge_merge(s, d):
    o = _orders(s, d).select("k", _c("id").alias("src"), F.lit("ASSIGNED_TO").alias("relation_type"), _c("person").alias("dst"), F.create_map(F.lit("status"), "status").alias("attributes"), "at")
    o = o.withColumn("id", X.edge_id(_c("src"), _c("relation_type"), _c("dst")))
    stored = o.where("k % 3 <> 0").select("id", "src", "dst", "relation_type", "attributes", _c("at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(1).cast("long").alias("version"))
    coming = o.where("k % 2 = 0").select("id", "src", "dst", "relation_type", F.create_map(F.lit("status"), F.lit("new")).alias("attributes"), F.expr("at + interval 1 day").alias("valid_from"), _c("at").alias("valid_to"), _c("k").alias("seq"))
    return store.merge_edges(stored, coming).select("id", _c("attributes")["status"].alias("status"), _s("valid_from").alias("valid_from"), _s("valid_to").alias("valid_to"), "version")


_EDGE_MERGE = """WITH o AS (SELECT o_orderkey AS k, 'order:' || o_orderkey AS src, 'person:' || o_custkey AS dst, o_orderstatus AS status, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders)
SELECT 'edge_' || substring(sha256(src || '|ASSIGNED_TO|' || dst || '|'), 1, 24) AS id, CASE WHEN k % 2 = 0 THEN 'new' ELSE status END AS status, CAST(CASE WHEN k % 3 <> 0 THEN day ELSE day + INTERVAL 1 DAY END AS VARCHAR) AS valid_from,
  CAST(CASE WHEN k % 2 = 0 THEN day END AS VARCHAR) AS valid_to, CAST(CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS version FROM o WHERE k % 3 <> 0 OR k % 2 = 0"""


def _problems(s, d):
    """Provenance of orders with every kind of fault in turn."""
    o = _orders(s, d)
    n = _c("k") % 7
    p = o.select("k", F.when(n != 1, _c("id")).alias("node_id"), F.when(n == 2, F.lit("e")).alias("edge_id"), F.when(n == 3, F.lit("sure")).otherwise(F.lit("exact")).alias("confidence"),
                 F.when(n == 4, F.lit("guess")).otherwise(F.lit("direct_mapping")).alias("extraction_method"), F.lit("orders").alias("source_file"), _s("k").alias("source_record_id"))
    records = o.where("k % 7 <> 5").select(F.lit("orders").alias("source_file"), _s("k").alias("source_record_id"))
    return store.problems(p, records).select("k", "problem")


def _edges_deleted(s, d):
    e = g.edges(s, d).where("relation_type = 'REPORTS_TO'")
    p = e.select(_c("id").alias("edge_id"), F.lit("f").alias("source_file"))
    gone = e.where("dst = 'person:1' or src like '%7'").select("id")
    a, b = store.delete_edges(gone, e, p)
    return a.select("id").join(b.select(_c("edge_id").alias("id"), F.lit(True).alias("explained")), "id", "left").select("id", F.coalesce("explained", F.lit(False)).alias("explained"))


def _patched(s, d):
    n = g.nodes(s, d).where("type = 'Asset'")
    p = table(s, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("asset:"), "p_partkey").alias("id"), F.create_map(F.lit("kind"), F.lit('"patched"'), F.lit("extra"), F.lit("1")).alias("attributes"))
    return store.patch(n, p).select("id", "version", X.attributes_json(F.map_filter("attributes", lambda k, v: k.isin("kind", "extra"))).alias("attributes"))


def _migrated(s, d):
    m = F.element_at(F.array(*map(F.lit, ["direct_mapping", "rule_based", "synthetic", "human", "llm_extraction"])), (_c("k") % 5 + 1).cast("int"))
    p = _orders(s, d).select("k", m.alias("extraction_method"), ((_c("k") % 100) / 100.0).cast("string").alias("confidence"))
    return store.migrated(p).select("k", "confidence", F.round("model_self_score", 6).alias("score"))


def _specs(s, d):
    p = table(s, d, "part").select(_c("p_brand").alias("tenant"), _c("p_type").alias("file_pattern"), _c("p_partkey").alias("spec_version"), F.when(_c("p_size") % 2 == 0, "active").otherwise("draft").alias("status"))
    return store.active_specs(p).select("tenant", "file_pattern", "spec_version")


def _attached(s, d):
    n = g.nodes(s, d).where("type = 'Person'").select("id", "type")
    p = table(s, d, "orders").select(F.concat(F.lit("person:"), "o_custkey").alias("node_id"), F.concat(F.lit("orders/"), "o_orderpriority").alias("source_file"))
    return conflict.attach(n, p).select("id", F.array_join("source_files", ",").alias("files"), "n_provenance")


def _conflicts(s, d):
    q = _orders(s, d).select(_c("person").alias("node_id"), _c("status").alias("attribute"), F.when(_c("k") % 3 == 0, "resolved").otherwise("open").alias("status"), "k")
    return conflict.conflicts(q, "open", attribute="O").select("node_id", "k")


def _missing(s, d):
    e = g.edges(s, d).where("relation_type = 'REPORTS_TO'")
    n = g.nodes(s, d).where("type = 'Person' and id not like '%3'")
    return ingest.missing_ends(e, n).select("id", "src", "dst")


def _tasks(s, d):
    """A task record for each conversation: its user turns, blank ones first, and a call for each turn."""
    c = table(s, d, "conversations")
    call = F.struct(F.struct(F.struct(F.concat(F.lit("emp_"), _c("turn") % 2).alias("emp_id"), F.when(_c("turn") > 1, F.lit("p")).alias("product_id")).alias("arguments")).alias("function"))
    m = F.struct("turn", F.struct(_c("role"), F.when(_c("turn") == 0, F.concat(F.lit(" "), F.when(_c("conv_id") % 2 == 0, F.concat(F.lit("ask "), _s("conv_id"))).otherwise(F.lit("")), F.lit(" "))).otherwise(F.concat(F.lit("turn "), _s("turn"))).alias("content"), F.when(_c("role") == "assistant", F.array(call)).alias("tool_calls")).alias("m"))
    t = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("ms"))
    return t.select(_c("conv_id").alias("task_index"), F.to_json(F.struct(F.transform("ms", lambda x: x["m"]).alias("messages"))).alias("record"))


_TASKS = """c AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'ask ' || conv_id ELSE '' END ELSE 'turn ' || turn END AS content FROM conversations),
said AS (SELECT conv_id, arg_min(content, turn) AS query FROM c WHERE role = 'user' AND content <> '' GROUP BY conv_id),
ids AS (SELECT conv_id, 'emp_' || turn % 2 AS id FROM c WHERE role = 'assistant' UNION SELECT conv_id, 'p' FROM c WHERE role = 'assistant' AND turn > 1),
gold AS (SELECT s.conv_id AS task_index, query, string_agg(id, ',' ORDER BY id) AS expected, count(*) AS n FROM said s JOIN ids i ON s.conv_id = i.conv_id GROUP BY ALL)"""


def _golden(s, d):
    return evals.golden(_tasks(s, d)).select("task_index", "query", F.array_join("expected", ",").alias("expected"))


def _labelled(s, d):
    """Turns with their words of four and of six letters as two types of spans."""
    c = table(s, d, "conversations").select("conv_id", "turn", _c("role").alias("intent"), F.array_distinct(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"), F.coalesce("text", F.lit("")).alias("text"))
    return c.withColumn("entities", F.create_map(F.lit("four"), F.filter("w", lambda x: F.char_length(x) == 4), F.lit("six"), F.filter("w", lambda x: F.char_length(x) == 6)))


_WORDS = "w AS (SELECT conv_id, turn, role, u AS word FROM (SELECT conv_id, turn, role, unnest(list_distinct(string_split(coalesce(text, ''), ' '))) AS u FROM conversations))"


def _span_labels(s, d):
    x = evals.span_labels(_labelled(s, d)).select("text", F.explode("entities").alias("e"))
    return x.select(_c("e")[1].alias("type"), _c("e")[0].alias("span")).groupBy("type", "span").agg(F.count(F.lit(1)).alias("n"))


def _seeds(s, d):
    t = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("emp_"), _s("o_custkey"), F.lit(" CUST-"), _s("o_orderkey"), F.lit(" ticket-"), _s("o_custkey"), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" emp_1 emp_2 emp_3 emp_4")).alias("text"))
    return evals.seeds(t).select("o_orderkey", F.explode("entities").alias("type", "spans")).select("o_orderkey", "type", F.array_join("spans", ",").alias("spans"))


def _report(s, d):
    return evals.dataset_report(_labelled(s, d))


def _unseen(s, d):
    a = table(s, d, "part").select(_c("p_name").alias("query"))
    return evals.unseen(a, table(s, d, "part").where("p_partkey % 97 = 0").select(_c("p_name").alias("query"))).select("query")


def _macro(s, d):
    x = _labelled(s, d).select(_c("intent").alias("type"), "w")
    x = x.select("type", F.filter("w", lambda y: F.char_length(y) > 3).alias("gold"), F.filter("w", lambda y: F.char_length(y) < 7).alias("predicted"))
    return evals.macro_f1(evals.entity_scores(x)).select(F.round("macro_f1", 6).alias("macro_f1"))


def _units(s, d):
    e = table(s, d, "embeddings").where("embedding is not null").select("vec_id", _c("embedding").cast("array<double>").alias("v"))
    one = F.transform("v", lambda x: F.lit(1.0))
    return e.select("vec_id", F.round(F.aggregate(X.unit(_c("v")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(X.cosine(_c("v"), one), 5).alias("cosine"))


def _shown(s, d):
    """View columns of events: a time from one of several attributes, a source, a preview, a place."""
    e = table(s, d, "events")
    k = _c("event_id") % 4
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    names = list(views.PLACES)
    a = F.map_filter(F.create_map(F.lit("sent_at"), F.when(k == 0, F.concat(F.lit('"'), at, F.lit('"'))).when(k == 1, F.lit('"soon"')), F.lit("date"), F.when(k < 3, F.lit('"2024-05-06"')), F.lit("title"), F.when(k != 2, F.concat(F.lit('" '), "event_type", F.lit(' "')))), lambda _, v: v.isNotNull())
    dept = F.element_at(F.array(*map(F.lit, [*names, "Nowhere"])), (_c("event_id") % 9 + 1).cast("int"))
    return e.select("event_id", F.date_format(views.derived_time(a), "yyyy-MM-dd HH:mm:ss").alias("shown_at"), views.workflow_preview(F.lit("Event"), a).alias("preview"), views.source_label(F.concat(F.lit("my_"), "event_type", F.lit("/x_y.json"))).alias("source"), views.place(dept).alias("place"))


_PLACES = "[" + ", ".join(f"'{v}'" for v in views.PLACES.values()) + ", NULL]"


def _windows(s, d):
    n = g.nodes(s, d).where("type = 'Event' and id like 'event:%'")
    top = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    out = None
    for w in views.WINDOWS:
        x = views.within(n, w, top).agg(F.count(F.lit(1)).alias("n")).select(F.lit(w or 0).cast("long").alias("days"), "n")
        out = x if out is None else out.unionByName(x)
    return out


def _fields(s, d):
    p = table(s, d, "lineitem").select(_c("l_orderkey").alias("k"), F.concat(F.lit("$.q"), _s("l_linenumber"), F.lit("_price")).alias("source_field"), F.concat(F.lit("q"), _s("l_linenumber")).alias("attribute"))
    a = views.provenance_of(p, "q1").groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("contains").alias("how"), "n")
    return a.unionByName(views.provenance_of(p, "q2", exact=True).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("exact").alias("how"), "n"))


def _united(s, d):
    nodes, links = views.united(g.nodes(s, d), g.edges(s, d), ["(Event)-[ASSIGNED_TO]->(Person)", "(Event)-[RELATED_TO]->(Asset)"])
    a = links.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n")).select(_c("relation_type").alias("name"), "n")
    return a.unionByName(nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(_c("type").alias("name"), "n"))


_CASE = "CASE WHEN k % 7 IN (1, 2) THEN 'owner' WHEN k % 7 = 3 THEN 'confidence' WHEN k % 7 = 4 THEN 'method' WHEN k % 7 = 5 THEN 'record' END"

QUERIES = {
    "node_merge": (_node_merge, _NODE_MERGE),
    "edge_merge": (_edge_merge, _EDGE_MERGE),
    "provenance_problems": (_problems, f"SELECT * FROM (SELECT k, {_CASE} AS problem FROM (SELECT o_orderkey AS k FROM orders)) WHERE problem IS NOT NULL"),
    "edge_delete": (_edges_deleted, f"{GRAPH} SELECT id, TRUE AS explained FROM edges WHERE rel = 'REPORTS_TO' AND dst <> 'person:1' AND src NOT LIKE '%7'"),
    "node_patch": (_patched, """SELECT 'asset:' || p_partkey AS id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, CASE WHEN p_partkey % 3 = 0 THEN '{"extra":1,"kind":"patched"}' ELSE '{"kind":"' || p_type || '"}' END AS attributes FROM part"""),
    "provenance_migrated": (_migrated, "SELECT o_orderkey AS k, ['exact', 'exact', 'exact', 'human', 'inferred'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS confidence, CASE WHEN o_orderkey % 5 = 4 THEN round(o_orderkey % 100 / 100.0::DOUBLE, 6) END AS score FROM orders"),
    "specs_active": (_specs, "SELECT p_brand AS tenant, p_type AS file_pattern, max(p_partkey) AS spec_version FROM part WHERE p_size % 2 = 0 GROUP BY ALL"),
    "provenance_attached": (_attached, "SELECT 'person:' || c_custkey AS id, string_agg(DISTINCT 'orders/' || o_orderpriority, ',' ORDER BY 'orders/' || o_orderpriority) AS files, count(o_orderkey) AS n_provenance FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "conflicts_open": (_conflicts, "SELECT 'person:' || o_custkey AS node_id, o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0"),
    "missing_ends": (_missing, f"{GRAPH} SELECT id, src, dst FROM edges WHERE rel = 'REPORTS_TO' AND (src LIKE '%3' OR dst LIKE '%3')"),
    "golden_tasks": (_golden, f"WITH {_TASKS} SELECT task_index, query, expected FROM gold"),
    "golden_coverage": (lambda s, d: evals.coverage(evals.golden(_tasks(s, d))), f"WITH {_TASKS} SELECT count(*) AS items, CAST(coalesce(sum(n), 0) AS BIGINT) AS ids, CAST(coalesce(max(n), 0) AS BIGINT) AS most FROM gold"),
    "p95_exclusive": (lambda s, d: evals.p95_exclusive(table(s, d, "events"), "value").select(F.round("p95", 6).alias("p95")), "WITH v AS (SELECT value AS x, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), a AS (SELECT *, (n + 1) * 0.95::DOUBLE AS p FROM v) SELECT round(max(CASE WHEN r = floor(p) THEN x END) * (1 - (any_value(p) - floor(any_value(p)))) + max(CASE WHEN r = floor(p) + 1 THEN x END) * (any_value(p) - floor(any_value(p))), 6) AS p95 FROM a"),
    "macro_f1": (_macro, f"WITH {_WORDS}, t AS (SELECT role, count(CASE WHEN length(word) BETWEEN 4 AND 6 THEN 1 END) AS tp, count(CASE WHEN length(word) < 4 THEN 1 END) AS fp, count(CASE WHEN length(word) > 6 THEN 1 END) AS fn FROM w GROUP BY role) SELECT round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM t"),
    "unseen_queries": (_unseen, "SELECT DISTINCT p_name AS query FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 97 = 0)"),
    "span_labels": (_span_labels, f"WITH {_WORDS} SELECT CASE length(word) WHEN 4 THEN 'four' ELSE 'six' END AS type, word AS span, count(*) AS n FROM w WHERE length(word) IN (4, 6) GROUP BY ALL"),
    "entity_seeds": (_seeds, "SELECT o_orderkey, unnest(['emp_id', 'customer_id', 'ticket_id', 'date']) AS type, unnest([array_to_string(list_slice(list_filter(['emp_' || o_custkey, 'emp_1', 'emp_2', 'emp_3', 'emp_4'], lambda x, i: i = 1 OR x <> 'emp_' || o_custkey), 1, 3), ','), 'CUST-' || o_orderkey, 'ticket-' || o_custkey, strftime(o_orderdate, '%Y-%m-%d')]) AS spans FROM orders"),
    "dataset_report": (_report, f"WITH {_WORDS} SELECT 'intent' AS kind, role AS name, count(*) AS n FROM conversations GROUP BY role UNION ALL SELECT 'entity', CASE length(word) WHEN 4 THEN 'four' ELSE 'six' END, count(*) FROM w WHERE length(word) IN (4, 6) GROUP BY ALL"),
    "query_escaped": (lambda s, d: table(s, d, "pages").select("page_id", X.escape_query(F.concat(F.coalesce("url", F.lit("")), F.lit(" (a && b) || [c] ~ d*"))).alias("escaped")), r"""SELECT page_id, regexp_replace(coalesce(url, '') || ' (a && b) || [c] ~ d*', '(&&|\|\||[+\-!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped FROM pages"""),
    "extraction_cache_key": (lambda s, d: table(s, d, "customer").select("c_custkey", X.cache_key(F.lit("m"), F.lit("t"), F.concat(F.lit('{"b": "'), "c_name", F.lit('", "a": '), _s("c_custkey"), F.lit("}"))).alias("cache_key")), """SELECT c_custkey, sha256('m' || chr(0) || 't' || chr(0) || '{"a":' || c_custkey || ',"b":"' || c_name || '"}') AS cache_key FROM customer"""),
    "vector_units": (_units, "SELECT vec_id, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS total, round(list_sum(v) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(len(v))), 5) AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"),
    "view_columns": (_shown, f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN '2024-05-06 00:00:00' WHEN 2 THEN '2024-05-06 00:00:00' END AS shown_at, 'Event: ' || CASE WHEN event_id % 4 = 2 THEN '<no preview>' ELSE event_type END AS preview, 'my ' || replace(event_type, '_', ' ') AS source, {_PLACES}[CAST(event_id % 9 AS INTEGER) + 1] AS place FROM events"),
    "view_windows": (_windows, "SELECT CAST(days AS BIGINT) AS days, count(CASE WHEN days = 0 OR ts >= TIMESTAMP '2024-02-01' - to_days(days) THEN 1 END) AS n FROM events, (VALUES (0), (1), (7), (30), (90)) t(days) GROUP BY days"),
    "provenance_of_field": (_fields, "SELECT 'contains' AS how, count(*) AS n FROM lineitem WHERE contains('$.q' || l_linenumber || '_price', 'q1') UNION ALL SELECT 'exact', count(*) FROM lineitem WHERE l_linenumber = 2"),
    "max_degree": (lambda s, d: views.max_degree(g.edges(s, d)), f"{GRAPH} SELECT max(n) AS max_degree FROM (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"),
    "patterns_united": (_united, f"{GRAPH}, l AS (SELECT src, dst, min(rel) AS rel FROM edges WHERE rel IN ('ASSIGNED_TO', 'RELATED_TO') GROUP BY src, dst) SELECT rel AS name, count(*) AS n FROM l GROUP BY rel UNION ALL SELECT type, count(*) FROM nodes WHERE id IN (SELECT src FROM l UNION SELECT dst FROM l) GROUP BY type"),
}
