"""Queries over records and facts: transformers, ingestion, drift, conflicts, edits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import jsonpath
from factloom.functions import text as X
from factloom.operators import conflict, ingest, merge, store
from factloom.plans import spec as S
from factloom.session import cut, table

#: The mapping of the made-up staff records below.
SPEC = S.load({
    "tenant": "demo", "source": {"file_pattern": "staff.json", "format": "json"}, "canonical_aliases": {"Employee": "Person"},
    "nodes": [
        {"name": "employee", "canonical_type": "Employee", "id_template": "person:{emp_id}", "fields": [
            {"attribute": "emp_id", "source": "$.emp_id"}, {"attribute": "name", "source": "$.Name", "transform": ["strip"]},
            {"attribute": "email", "source": ["$.work.email", "$.email"], "transform": ["normalize_email"], "required": False}]},
        {"name": "manager", "canonical_type": "Person", "id_template": "person:{reports_to}", "when": {"not_null": "$.reports_to"}, "fields": []},
    ],
    "edges": [{"canonical_type": "REPORTS_TO", "source_node": "@employee", "target_node": "@manager"}],
})


def _body(name):
    return F.to_json(F.struct(
        F.concat(F.lit("emp_"), "c_custkey").alias("emp_id"), name.alias("Name"),
        F.when(F.col("c_custkey") % 2 == 0, F.struct(F.concat(F.lit(" "), "c_name", F.lit("@Example.ORG ")).alias("email"))).alias("work"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat("c_name", F.lit("@home.net"))).alias("email"),
        F.when(F.col("c_custkey") > 0, F.concat(F.lit("emp_"), F.floor(F.col("c_custkey") / 4))).alias("reports_to"),
    ))


def _records(s, d):
    """Staff records of customers: every 17th without a name, every 5th twice."""
    body = _body(F.when(F.col("c_custkey") % 17 != 0, F.concat(F.lit("  "), "c_name", F.lit(" "))))
    r = table(s, d, "customer").select(F.lit("staff.json").alias("source_file"), F.col("c_custkey").alias("ordinal"), body.alias("record"))
    again = r.where("ordinal % 5 = 0").withColumn("ordinal", F.col("ordinal") + 10_000_000)
    return r.unionByName(again)


def _run(s, d):
    return ingest.ingest(_records(s, d), SPEC, once=True)


_GOOD = """WITH r AS (SELECT c_custkey AS k, 'person:emp_' || c_custkey AS id, trim(c_name) AS name,
  lower(CASE WHEN c_custkey % 2 = 0 THEN c_name || '@Example.ORG' WHEN c_custkey % 3 <> 0 THEN c_name || '@home.net' END) AS email,
  CASE WHEN c_custkey > 0 THEN 'person:emp_' || (c_custkey // 4) END AS boss FROM customer), good AS (SELECT * FROM r WHERE k % 17 <> 0)"""


def _merged(s, d):
    """The staff records, and a second batch of every 5th with another name, half of it from
    another file: people by id with what they are called, their facts and open conflicts."""
    file = F.when(F.col("c_custkey") % 2 == 0, F.lit("crm.json")).otherwise(F.lit("staff.json"))
    later = table(s, d, "customer").where("c_custkey % 5 = 0").select(file.alias("source_file"), F.col("c_custkey").alias("ordinal"), _body(F.concat("c_name", F.lit(" Jr"))).alias("record"))
    one, at = ingest.ingest(_records(s, d), SPEC, once=True), F.lit("2024-01-01").cast("timestamp")
    two = ingest.ingest(later, SPEC, one.seen, once=True)
    a = {k: cut(v) for k, v in merge.merged(one, at).items()}  # what a store would hold in between
    b = merge.merged(two, at, a["nodes"], a["edges"], a["attributes"])
    b["attributes"] = cut(b["attributes"])
    state = merge.replaced(a["attributes"], b["attributes"], ["node_id", "attribute"])
    seen = state.groupBy(F.col("node_id").alias("id")).agg(F.sum("n_facts").alias("n_facts"), F.count("open").alias("n_open"))
    value = lambda k: jsonpath.as_string(F.try_element_at("attributes", F.lit(k))).alias(k)
    people = merge.graph_nodes(b["nodes"], state).join(seen, "id", "left")
    return people.select("id", "type", "version", value("name"), value("email"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_open", F.lit(0)).alias("n_open"))


_MERGED = _GOOD + """, fed AS (SELECT *, 1 AS batch FROM good UNION ALL SELECT *, 2 FROM r WHERE k % 5 = 0),
  v AS (SELECT id, count(*) AS version FROM (SELECT id FROM fed UNION ALL SELECT boss FROM fed WHERE boss IS NOT NULL) GROUP BY id),
  p AS (SELECT id, any_value(k) AS k, any_value(name) AS name, any_value(email) AS email, count(*) AS n, max(batch) AS last FROM fed GROUP BY id)
SELECT v.id, 'Person' AS type, v.version, CASE WHEN last = 2 AND (n = 1 OR k % 2 = 1) THEN name || ' Jr' ELSE name END AS name, email,
  coalesce(n * CASE WHEN email IS NULL THEN 2 ELSE 3 END, 0) AS n_facts, CASE WHEN n = 2 AND k % 2 = 0 THEN 1 ELSE 0 END AS n_open
FROM v LEFT JOIN p ON v.id = p.id"""


def _transforms(which):
    def run(s, d):
        c = table(s, d, "customer").withColumn("raw", F.concat(F.lit(" \t"), "c_name", F.lit(" X  ")))
        if which == "lower_strip":
            return c.select("c_custkey", X.transformed(F.col("raw"), ["lowercase", "strip"]).alias("value"))
        if which == "email":
            return c.select("c_custkey", X.transformed(F.concat(F.lit(" "), "c_name", F.lit("@EXAMPLE.com ")), ["normalize_email"]).alias("value"))
        e = table(s, d, "events")
        # in turn: junk after the time, no offset, an offset, a day, no date
        tail = F.element_at(F.array(*map(F.lit, [" IST", "", "+05:30", None, "x"])), (F.col("event_id") % 5 + 1).cast("int"))
        raw = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        raw = F.when(F.col("event_id") % 5 == 4, F.concat(F.lit("on "), raw)).when(F.col("event_id") % 5 == 3, F.substring(raw, 1, 10)).otherwise(F.concat(raw, tail))
        return e.select("event_id", X.iso_datetime(raw).alias("value"))

    return run


def _variant(s, d):
    return _records(s, d).where("ordinal < 10000000").select(F.col("ordinal").alias("k"), F.parse_json("record").alias("v"))


_PREDICATE = {"or": [{"and": [{"equals": ["$.reports_to", "emp_3"]}, {"not_null": "$.work"}]}, {"in": ["$.emp_id", ["emp_1", "emp_2", "emp_9999999"]]}]}


def _lines(s, d):
    """Facts of order lines that share their key: three sources, four confidences."""
    li = table(s, d, "lineitem")
    order = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    li = li.withColumn("seq", F.row_number().over(order))
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (F.col(c) % len(v) + 1).cast("int"))
    value = F.concat(F.lit("Q"), (F.col("l_quantity") % 4).cast("int").cast("string"))
    return li.select(
        F.concat(F.lit("line:"), "l_orderkey", F.lit(":"), "l_linenumber").alias("node_id"), F.lit("quantity").alias("attribute"), "seq", F.when(F.col("l_partkey") % 2 == 0, value).otherwise(F.lower(value)).alias("value"), F.lower(value).alias("norm"),
        pick("l_partkey", "exact", "grounded", "inferred", "inferred", "human", "exact", "exact").alias("confidence"), pick("l_suppkey", "hr.json", "crm.json", "erp.json").alias("source_file"), F.col("l_suppkey").cast("string").alias("source_record_id"))


_FACTS = """WITH RECURSIVE f AS (
  SELECT 'line:' || l_orderkey || ':' || l_linenumber AS node_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq,
    CASE WHEN l_partkey % 2 = 0 THEN 'Q' ELSE 'q' END || CAST(CAST(l_quantity % 4 AS INTEGER) AS VARCHAR) AS value, 'q' || CAST(CAST(l_quantity % 4 AS INTEGER) AS VARCHAR) AS norm,
    ['exact', 'grounded', 'inferred', 'inferred', 'human', 'exact', 'exact'][CAST(l_partkey % 7 AS INTEGER) + 1] AS conf, ['hr.json', 'crm.json', 'erp.json'][CAST(l_suppkey % 3 AS INTEGER) + 1] AS file, CAST(l_suppkey AS VARCHAR) AS rec FROM lineitem
), g AS (SELECT *, CASE conf WHEN 'human' THEN 3 WHEN 'exact' THEN 2 WHEN 'grounded' THEN 1 ELSE 0 END AS rung FROM f
), step(node_id, seq, value, norm, conf, rung, file, rec, ev, ec, iv, ic, verdict) AS (
  SELECT node_id, seq, value, norm, conf, rung, file, rec, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM g WHERE seq = 1
  UNION ALL
  SELECT node_id, seq, CASE WHEN w = 'in' THEN v2 ELSE value END, CASE WHEN w = 'in' THEN n2 ELSE norm END, c2, r2, f2, rec2,
    CASE WHEN w = 'q' THEN coalesce(ev, value) ELSE ev END, CASE WHEN w = 'q' THEN coalesce(ec, conf) ELSE ec END, CASE WHEN w = 'q' THEN v2 ELSE iv END, CASE WHEN w = 'q' THEN c2 ELSE ic END,
    CASE WHEN w = 'q' THEN CASE WHEN conf = 'inferred' THEN 'llm_triage' ELSE 'escalate' END ELSE verdict END
  FROM (SELECT s.node_id, g.seq, s.value, s.norm, s.conf, s.ev, s.ec, s.iv, s.ic, s.verdict, g.value AS v2, g.norm AS n2, g.conf AS c2, g.rung AS r2, g.file AS f2, g.rec AS rec2,
      CASE WHEN s.value = g.value OR s.norm = g.norm THEN 'keep' WHEN s.file = g.file AND s.rec = g.rec THEN 'in' WHEN s.conf = 'human' AND g.conf <> 'human' THEN 'keep' WHEN g.conf = 'human' AND s.conf <> 'human' THEN 'in'
        WHEN s.rung > g.rung THEN 'keep' WHEN g.rung > s.rung THEN 'in' ELSE 'q' END AS w
    FROM step s JOIN g ON s.node_id = g.node_id AND g.seq = s.seq + 1)
), last AS (SELECT * FROM (SELECT *, max(seq) OVER (PARTITION BY node_id) AS n FROM step) WHERE seq = n)"""


def _decisions(s, d):
    """What is decided between two sides made from each order's key: 4 confidences, 2 sources, 2 records and
    2 values each, so that orders of 1,024 consecutive keys are all pairs."""
    kinds = (("confidence", 1, ["human", "exact", "grounded", "inferred"]), ("source_file", 4, ["a.json", "<unattributed>"]), ("source_record_id", 8, ["1", "2"]), ("norm", 16, ["x", "y"]))
    side = lambda first: F.struct(*[F.element_at(F.array(*map(F.lit, v)), (F.floor(F.col("o_orderkey") / (first * k)) % len(v) + 1).cast("int")).alias(n) for n, k, v in kinds])
    o = table(s, d, "orders").select(side(1).alias("e"), side(32).alias("i"))
    return o.withColumn("d", conflict.decide(F.col("e"), F.col("i"))).groupBy("d.verdict", "d.winner", "d.reason").agg(F.count(F.lit(1)).alias("n"))


_DECIDE = """WITH o AS (SELECT o_orderkey % 32 AS e, o_orderkey // 32 % 32 AS i FROM orders),
side AS (SELECT i AS id, ['human', 'exact', 'grounded', 'inferred'][CAST(i % 4 AS INTEGER) + 1] AS c, [3, 2, 1, 0][CAST(i % 4 AS INTEGER) + 1] AS r, ['a.json', '<unattributed>'][CAST(i // 4 % 2 AS INTEGER) + 1] AS f, CAST(i // 8 % 2 AS VARCHAR) AS rec, i // 16 % 2 AS v FROM range(32) t(i))
SELECT verdict, nullif(winner, '') AS winner, reason, count(*) AS n FROM (SELECT unnest(CASE
  WHEN e.v = i.v THEN [{'verdict': 'auto_merge', 'winner': 'existing', 'reason': 'equal_after_normalize'}]
  WHEN e.f = i.f AND e.rec = i.rec AND e.f <> '<unattributed>' THEN [{'verdict': 'auto_pick', 'winner': 'incoming', 'reason': 'same_source_updated'}]
  WHEN e.c = 'human' AND i.c <> 'human' THEN [{'verdict': 'auto_pick', 'winner': 'existing', 'reason': 'human_overrides'}]
  WHEN i.c = 'human' AND e.c <> 'human' THEN [{'verdict': 'auto_pick', 'winner': 'incoming', 'reason': 'human_overrides'}]
  WHEN e.r > i.r THEN [{'verdict': 'auto_pick', 'winner': 'existing', 'reason': 'higher_confidence_wins'}]
  WHEN i.r > e.r THEN [{'verdict': 'auto_pick', 'winner': 'incoming', 'reason': 'higher_confidence_wins'}]
  WHEN e.c = 'inferred' THEN [{'verdict': 'llm_triage', 'winner': '', 'reason': 'both_inferred'}]
  ELSE [{'verdict': 'escalate', 'winner': '', 'reason': 'tied_at_confident_rung'}] END, recursive := true) FROM o JOIN side e ON e.id = o.e JOIN side i ON i.id = o.i) GROUP BY ALL"""


def _queue(s, d):
    return conflict.queue(conflict.reconcile(_lines(s, d))).select("node_id", "existing_value", "existing_confidence", "incoming_value", "incoming_confidence", "verdict")


def _edited(s, d):
    values = table(s, d, "customer").select(F.concat(F.lit("person:"), "c_custkey").alias("node_id"), F.lit("segment").alias("attribute"), F.col("c_mktsegment").alias("value"))
    edits = table(s, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("edit_id"), F.concat(F.lit("person:"), "o_custkey").alias("node_id"), F.lit("segment").alias("attribute"), F.col("o_orderpriority").alias("value"))
    return conflict.edit(values, edits)[0].select("node_id", "value", "edited")


def _resolved(s, d):
    q = conflict.queue(conflict.reconcile(_lines(s, d)))
    decisions = q.where("incoming_value like 'Q%'").select("node_id", "attribute", F.col("incoming_value").alias("value"))
    return conflict.resolve(q, decisions)[0].groupBy("status", "verdict").agg(F.count(F.lit(1)).alias("n"))


def _upsert(s, d):
    o = table(s, d, "orders").select(F.lit("orders.json").alias("source_file"), F.col("o_orderkey").cast("string").alias("source_record_id"), F.col("o_orderstatus").alias("raw_record"), "o_orderkey")
    h = o.withColumn("content_hash", F.sha2("raw_record", 256))
    old = h.where("o_orderkey % 3 <> 0").withColumn("ingested_at", F.lit(1)).drop("o_orderkey")
    new = h.where("o_orderkey % 2 = 0").withColumn("raw_record", F.when(F.col("o_orderkey") % 4 == 0, F.lit("new")).otherwise(F.col("raw_record"))).withColumn("content_hash", F.sha2("raw_record", 256)).withColumn("ingested_at", F.lit(2)).drop("o_orderkey")
    return store.raw_upsert(old, new).select("source_record_id", "raw_record", F.col("ingested_at").cast("long").alias("ingested_at"))


def _provenance(s, d):
    li = table(s, d, "lineitem")
    seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    return li.select(F.concat(F.lit("order:"), "l_orderkey").alias("node_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 2).alias("source_file"), F.concat(F.lit("$.q"), (F.col("l_quantity") % 3).cast("int")).alias("source_field"), F.col("l_linestatus").alias("raw_value"), F.col("l_returnflag").alias("confidence"), F.col("l_orderkey").cast("string").alias("source_record_id"), seq.cast("long").alias("seq"))


_PROV = "WITH p AS (SELECT 'order:' || l_orderkey AS node_id, 'f' || l_suppkey % 2 AS source_file, '$.q' || CAST(l_quantity % 3 AS INTEGER) AS source_field, l_linestatus AS raw_value, l_returnflag AS confidence, CAST(l_orderkey AS VARCHAR) AS source_record_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq FROM lineitem)"


def _leaf(s, d):
    e = table(s, d, "events").select(F.lit("events").alias("source_file"), F.col("event_id").alias("ordinal"), F.col("props").alias("record"))
    return ingest.type_fingerprint(e.unionByName(_records(s, d)))


def _diff(s, d):
    e = s.createDataFrame([("$.emp_id", "str"), ("$.Name", "int"), ("$.gone", "str")], "path string, tag string")
    return ingest.fingerprint_diff(e, ingest.type_fingerprint(_records(s, d).where("ordinal % 17 <> 0")))


QUERIES = {
    "transform_lower_strip": (_transforms("lower_strip"), "SELECT c_custkey, lower(c_name) || ' x' AS value FROM customer"),
    "transform_email": (_transforms("email"), "SELECT c_custkey, lower(c_name) || '@example.com' AS value FROM customer"),
    "transform_iso": (_transforms("iso"), "SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+05:30') WHEN 3 THEN strftime(ts, '%Y-%m-%dT00:00:00') END AS value FROM events"),
    "content_hash": (lambda s, d: table(s, d, "customer").select("c_custkey", X.content_hash(F.concat(F.lit('{"seg": "'), "c_mktsegment", F.lit('", "id": "'), "c_name", F.lit('"}'))).alias("hash")), """SELECT c_custkey, sha256('{"id":"' || c_name || '","seg":"' || c_mktsegment || '"}') AS hash FROM customer"""),
    "coalesce_path": (lambda s, d: (lambda v: v.select("k", jsonpath.as_string(jsonpath.coalesced(F.col("v"), ["$.work.email", "$.email"])[0]).alias("value"), jsonpath.coalesced(F.col("v"), ["$.work.email", "$.email"])[1].alias("path")))(_variant(s, d)), "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_name || '@Example.ORG ' WHEN c_custkey % 3 <> 0 THEN c_name || '@home.net' END AS value, CASE WHEN c_custkey % 2 = 0 THEN '$.work.email' WHEN c_custkey % 3 <> 0 THEN '$.email' END AS path FROM customer"),
    "predicate_and_or": (lambda s, d: _variant(s, d).where(S.predicate(_PREDICATE, F.col("v"))).select("k"), "SELECT c_custkey AS k FROM customer WHERE (c_custkey // 4 = 3 AND c_custkey % 2 = 0 AND c_custkey > 0) OR c_custkey IN (1, 2)"),
    "predicate_matches": (lambda s, d: _variant(s, d).where(S.predicate({"matches": ["$.emp_id", "_1[0-9]$"]}, F.col("v"))).select("k"), "SELECT c_custkey AS k FROM customer WHERE c_custkey BETWEEN 10 AND 19"),
    "ingest_nodes": (lambda s, d: ingest.merged_nodes(_run(s, d).nodes), f"{_GOOD} SELECT id, 'Person' AS type, count(*) AS version FROM (SELECT id FROM good UNION ALL SELECT boss FROM good WHERE boss IS NOT NULL) GROUP BY id"),
    "ingest_edges": (lambda s, d: ingest.merged_edges(_run(s, d).edges), f"{_GOOD} SELECT 'edge_' || substring(sha256(id || '|REPORTS_TO|' || boss || '|'), 1, 24) AS id, id AS src, boss AS dst, 'REPORTS_TO' AS relation_type, CAST(1 AS BIGINT) AS version FROM good WHERE boss IS NOT NULL"),
    "ingest_provenance": (lambda s, d: _run(s, d).provenance.select("node_id", "attribute", jsonpath.as_string(F.col("value")).alias("value"), "confidence", "source_field"), f"""{_GOOD} SELECT id AS node_id, 'emp_id' AS attribute, substring(id, 8) AS value, 'exact' AS confidence, '$.emp_id' AS source_field FROM good UNION ALL SELECT id, 'name', name, 'exact', '$.Name' FROM good UNION ALL SELECT id, 'email', email, 'exact', CASE WHEN k % 2 = 0 THEN '$.work.email' ELSE '$.email' END FROM good WHERE email IS NOT NULL"""),
    "ingest_dead_letters": (lambda s, d: _run(s, d).dead.select(F.col("ordinal").cast("long").alias("ordinal"), "error"), "SELECT c_custkey AS ordinal, 'name: required and missing' AS error FROM customer WHERE c_custkey % 17 = 0 UNION ALL SELECT c_custkey + 10000000, 'name: required and missing' FROM customer WHERE c_custkey % 17 = 0 AND c_custkey % 5 = 0"),
    "ingest_skip_seen": (lambda s, d: ingest.ingest(_records(s, d), SPEC, _run(s, d).seen.where("source_record_id like '%1'")).records.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 17 = 0 THEN 'dead' WHEN CAST(c_custkey AS VARCHAR) LIKE '%1' THEN 'skipped' ELSE 'out' END AS status FROM customer UNION ALL SELECT CASE WHEN c_custkey % 17 = 0 THEN 'dead' ELSE 'skipped' END FROM customer WHERE c_custkey % 5 = 0) GROUP BY status"),
    "ingest_run_report": (lambda s, d: ingest.report(_run(s, d)), f"{_GOOD} SELECT (SELECT count(*) FROM r) + (SELECT count(*) FROM r WHERE k % 5 = 0) AS records_in, (SELECT count(*) FROM good) AS records_out, (SELECT count(*) FROM good WHERE k % 5 = 0) AS skipped, (SELECT count(*) FROM r WHERE k % 17 = 0) + (SELECT count(*) FROM r WHERE k % 17 = 0 AND k % 5 = 0) AS dead, (SELECT count(*) FROM good) + (SELECT count(*) FROM good WHERE boss IS NOT NULL) AS nodes"),
    "type_fingerprint": (_leaf, "SELECT * FROM (VALUES ('$.k', 'int'), ('$.emp_id', 'str'), ('$.Name', 'str'), ('$.email', 'email_like'), ('$.reports_to', 'str'), ('$.work.email', 'str')) t(path, tag)"),
    "fingerprint_diff": (_diff, "SELECT * FROM (VALUES ('$.Name', 'changed int to str'), ('$.gone', 'missing')) t(path, problem)"),
    "decide_table": (_decisions, _DECIDE),
    "merged_graph": (_merged, _MERGED),
    "reconcile_orders": (lambda s, d: conflict.reconcile(_lines(s, d)).select("node_id", "value", "n_facts", F.col("open.verdict").alias("verdict")), f"{_FACTS} SELECT node_id, value, n AS n_facts, verdict FROM last"),
    "conflict_queue": (_queue, f"{_FACTS} SELECT node_id, ev AS existing_value, ec AS existing_confidence, iv AS incoming_value, ic AS incoming_confidence, verdict FROM last WHERE verdict IS NOT NULL"),
    "resolve_conflict": (_resolved, f"{_FACTS} SELECT CASE WHEN iv LIKE 'Q%' THEN 'resolved' ELSE 'open' END AS status, verdict, count(*) AS n FROM last WHERE verdict IS NOT NULL GROUP BY ALL"),
    "latest_fact": (lambda s, d: conflict.latest_facts(_lines(s, d)).select("node_id", F.col("seq").cast("long").alias("seq"), "value", "source_file"), f"{_FACTS} SELECT node_id, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(file, seq) AS source_file FROM f GROUP BY node_id"),
    "human_edit_overlay": (_edited, "WITH e AS (SELECT 'person:' || o_custkey AS node_id, arg_max(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1), c AS (SELECT 'person:' || c_custkey AS node_id, c_mktsegment AS v FROM customer) SELECT coalesce(c.node_id, e.node_id) AS node_id, coalesce(e.v, c.v) AS value, e.v IS NOT NULL AS edited FROM c FULL JOIN e ON c.node_id = e.node_id"),
    "raw_upsert": (_upsert, "WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS r FROM orders), a AS (SELECT * FROM o WHERE k % 3 <> 0), b AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'new' ELSE r END AS r FROM o WHERE k % 2 = 0) SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS source_record_id, CASE WHEN a.k IS NULL OR (b.k IS NOT NULL AND a.r <> b.r) THEN b.r ELSE a.r END AS raw_record, CAST(CASE WHEN a.k IS NULL OR (b.k IS NOT NULL AND a.r <> b.r) THEN 2 ELSE 1 END AS BIGINT) AS ingested_at FROM a FULL JOIN b ON a.k = b.k"),
    "same_as_pairs": (lambda s, d: ingest.identities(table(s, d, "customer").select(F.concat(F.lit("person:"), "c_custkey").alias("id"), F.concat(F.lit(" U"), (F.col("c_custkey") / 3).cast("long"), F.when(F.col("c_custkey") % 2 == 0, F.lit("@X.org")).otherwise(F.lit("@x.ORG "))).alias("email"))).select("a", "b", "email", "edge_id"), "WITH p AS (SELECT 'person:' || c_custkey AS id, 'u' || (c_custkey // 3) || '@x.org' AS email FROM customer) SELECT a.id AS a, b.id AS b, a.email, 'edge_' || substring(sha256(a.id || '|SAME_AS|' || b.id || '|'), 1, 24) AS edge_id FROM p a JOIN p b ON a.email = b.email AND a.id < b.id"),
    "provenance_dedup": (lambda s, d: conflict.shown_provenance(_provenance(s, d)), f"{_PROV} SELECT node_id, source_file, source_field, raw_value, min(seq) AS place, arg_max(confidence, seq) AS confidence, max(seq) AS seq FROM p GROUP BY ALL"),
    "citations_dedup": (lambda s, d: conflict.citations(_provenance(s, d)).select("node_id", "source_file", "source_field", "raw_value", "seq"), f"{_PROV} SELECT node_id, source_file, source_field, raw_value, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_file, source_record_id, source_field ORDER BY seq) AS k FROM p) WHERE k = 1"),
}
