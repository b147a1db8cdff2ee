"""Queries of records and their traces over the given tables: formats, paths, evidence, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import engine
from factloom.functions import jsonpath
from factloom.functions import text as X
from factloom.operators import evals, graph, ingest, vfs
from factloom.plans import spec as S
from factloom.plans.queries_facts import _GOOD, _records, _run
from factloom.plans.queries_scale import _scratch
from factloom.session import cut, remove, table
from factloom.sources import bench_graph, records

_BODY = ["c_custkey", "c_name", "c_mktsegment"]


def _record_formats(s, d):
    """Customers written as JSON arrays (a file for each nation), as JSON lines and as CSV, and read back."""
    c, root = table(s, d, "customer"), _scratch(s)
    body = F.to_json(F.struct(*_BODY))
    arrays = c.groupBy("c_nationkey").agg(F.concat(F.lit('{"rows": ['), F.array_join(F.collect_list(body), ","), F.lit("]}")).alias("value"))
    arrays.write.partitionBy("c_nationkey").text(f"{root}/json")
    c.select(body.alias("value")).withColumn("value", F.concat("value", F.when(F.col("value").endswith("7}"), "\n").otherwise(""))).write.text(f"{root}/jsonl")
    c.select(*_BODY).write.option("header", True).csv(f"{root}/csv")
    read = [records.read(s, f"{root}/json/*", "json", "$.rows[*]").withColumn("format", F.lit("json"))]
    read += [records.read(s, f"{root}/{f}", f).withColumn("format", F.lit(f)) for f in ("jsonl", "csv")]
    every = read[0].unionByName(read[1]).unionByName(read[2])
    get = lambda k: F.get_json_object("record", f"$.{k}").alias(k)
    out = cut(every.select("format", *map(get, _BODY)))
    remove(s, root)
    return out


_RECORD_FORMATS = """
SELECT format, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer, (VALUES ('json'), ('jsonl'), ('csv')) f(format)"""


def _path_all(s, d):
    """All matches of a path with a list in it: the parts of each order, in order."""
    line = F.struct("l_linenumber", F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).alias("x"))
    o = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    v = o.select("l_orderkey", F.parse_json(F.to_json(F.struct(F.col("lines.x").alias("lines")))).alias("v"))
    found = F.transform(jsonpath.matches(F.col("v"), jsonpath.parse("$.lines[*].part")), lambda x: F.to_json(x))
    return v.select("l_orderkey", F.array_join(found, ",").alias("parts"))


_PATH_ALL = """
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY l_orderkey"""


def _text_forms(s, d):
    """Blank values as none, and values in the form in which they are compared."""
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, "  \t").when(k % 5 == 1, F.concat(F.lit("  "), "c_name", F.lit(" STRASSE\n"))).when(k % 5 == 2, F.concat("c_name", F.lit(" Straße"))).when(k % 5 == 3, F.col("c_name"))
    c = table(s, d, "customer").select("c_custkey", raw.alias("raw"))
    return c.select("c_custkey", X.casefolded(F.col("raw")).alias("folded"), X.blank_to_null(F.col("raw")).isNull().alias("blank"))


_TEXT_FORMS = """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN lower(c_name) || ' strasse' WHEN 2 THEN lower(c_name) || ' strasse' WHEN 3 THEN lower(c_name) END AS folded,
  c_custkey % 5 IN (0, 4) AS blank
FROM customer"""


def _traced_facts(s, d):
    """Facts of the staff records with the raw value that their source field names."""
    got = _run(s, d)
    found = engine.resolved_fact(got.provenance.where("attribute <> 'name'"), got.raw.select("source_file", "source_record_id", "raw_record").distinct())
    return found.select("node_id", "attribute", "source_field", "traced")


_TRACED_FACTS = f"""{_GOOD}, twice AS (SELECT k, 1 AS n FROM good)
SELECT id AS node_id, 'emp_id' AS attribute, '$.emp_id' AS source_field, substring(id, 8) AS traced FROM good
UNION ALL SELECT g.id, 'email', CASE WHEN g.k % 2 = 0 THEN '$.work.email' ELSE '$.email' END,
  CASE WHEN g.k % 2 = 0 THEN ' ' || c_name || '@Example.ORG ' ELSE c_name || '@home.net' END
FROM good g JOIN customer ON g.k = c_custkey WHERE g.email IS NOT NULL"""


def _evidence(s, d):
    """The raw records behind the facts about every node, each once."""
    got = _run(s, d)
    rows = vfs.evidence(got.provenance.where("node_id is not null"), got.raw.select("source_file", "source_record_id", "raw_record").distinct())
    return rows.select("source_file", "source_record_id", F.get_json_object("raw_record", "$.emp_id").alias("emp_id"))


_EVIDENCE = f"{_GOOD} SELECT 'staff.json' AS source_file, id AS source_record_id, 'emp_' || k AS emp_id FROM good"


def _required_missing(s, d):
    """Required paths that records lack, by how many records."""
    spec = S.load({"tenant": "t", "source": {"file_pattern": "f", "format": "json"}, "nodes": [{"name": "n", "canonical_type": "Person", "id_template": "p:{emp_id}", "fields": [
        {"attribute": "emp_id", "source": "$.emp_id"}, {"attribute": "name", "source": "$.Name"}, {"attribute": "boss", "source": "$.reports_to"}]}]})
    wanted = [F.lit(p) for p in ingest.required_paths(spec)]
    r = _records(s, d).where("ordinal < 10000000").select("ordinal", "record", F.explode(F.array(*wanted)).alias("path"))
    have = ingest.leaf_paths(_records(s, d).where("ordinal < 10000000")).groupBy("path").agg(F.count("*").alias("n"))
    every = r.groupBy("path").agg(F.count("*").alias("all"))
    return every.join(have, "path", "left").select("path", (F.col("all") - F.coalesce("n", F.lit(0))).alias("missing"))


_REQUIRED_MISSING = """
SELECT '$.Name' AS path, count(*) FILTER (c_custkey % 17 = 0) AS missing FROM customer
UNION ALL SELECT '$.emp_id', count(*) FILTER (c_custkey IS NULL) FROM customer
UNION ALL SELECT '$.reports_to', count(*) FILTER (c_custkey = 0) FROM customer"""


def _entity_labels(s, d):
    """Labels in texts made of orders, of every type that is looked for."""
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    ids = F.array_join(F.transform(F.sequence(F.lit(0), (k % 8).cast("int")), lambda i: F.concat(F.lit("emp_"), i)), " ")
    text = F.concat_ws(" ", ids, F.concat(F.lit("CUST-"), "o_custkey"), F.when(k % 3 == 0, "Customer ID: koala, customer_id the"), F.concat(F.lit("about Ticket ID "), k, F.lit(" and ticket-7")), F.when(k % 4 == 0, "for Human Resources and IT"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.lit("B0BQ3K23Y1"))
    found = o.select("o_orderkey", F.explode(evals.labels(text)).alias("type", "v"))
    return found.select("o_orderkey", "type", F.array_join("v", ",").alias("found"))


_ENTITY_LABELS = """
WITH o AS (SELECT *, o_orderkey AS k FROM orders)
SELECT o_orderkey, 'emp_id' AS type, array_to_string(list_transform(range(0, least(k % 8, 5) + 1), lambda i: 'emp_' || i), ',') AS found FROM o
UNION ALL SELECT o_orderkey, 'customer_id', 'CUST-' || o_custkey || CASE WHEN k % 3 = 0 THEN ',koala' ELSE '' END FROM o
UNION ALL SELECT o_orderkey, 'ticket_id', k || ',ticket-7' FROM o
UNION ALL SELECT o_orderkey, 'department', 'Human Resources,IT' FROM o WHERE k % 4 = 0
UNION ALL SELECT o_orderkey, 'date', strftime(o_orderdate, '%Y-%m-%d') FROM o
UNION ALL SELECT o_orderkey, 'product', 'B0BQ3K23Y1' FROM o"""


def _neighbor_previews(s, d):
    """The first five reports or superiors of every person, by name, and how many there are."""
    edges = bench_graph.edges(s, d).where("relation_type = 'REPORTS_TO'")
    seeds = table(s, d, "customer").select(F.concat(F.lit("person:"), "c_custkey").alias("id"))
    nodes = bench_graph.nodes(s, d).where("type = 'Person'")
    return graph.neighbor_previews(nodes, edges, seeds, 1, 5)


_NEIGHBOR_PREVIEWS = """
WITH p AS (SELECT c_custkey AS k, c_name FROM customer), e AS (SELECT k AS a, k // 4 AS b FROM p WHERE k > 0 UNION SELECT k // 4, k FROM p WHERE k > 0),
r AS (SELECT 'person:' || a AS seed, 'person:' || b AS id, c_name, row_number() OVER (PARTITION BY a ORDER BY 'person:' || b) AS i, count(*) OVER (PARTITION BY a) AS total FROM e JOIN p ON b = k)
SELECT seed, id, 'Person' AS type, c_name AS preview, total FROM r WHERE i <= 5"""


QUERIES = {
    "record_formats": (_record_formats, _RECORD_FORMATS),
    "path_all": (_path_all, _PATH_ALL),
    "text_forms": (_text_forms, _TEXT_FORMS),
    "traced_facts": (_traced_facts, _TRACED_FACTS),
    "evidence_rows": (_evidence, _EVIDENCE),
    "required_missing": (_required_missing, _REQUIRED_MISSING),
    "entity_labels": (_entity_labels, _ENTITY_LABELS),
    "neighbor_previews": (_neighbor_previews, _NEIGHBOR_PREVIEWS),
}
