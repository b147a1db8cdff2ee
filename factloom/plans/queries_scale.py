"""Queries of what has to hold at scale: hot histories, stored indexes, deletes, edge attributes,
paths of many pairs, quantiles, identities, and vectors made once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import jsonpath
from factloom.operators import conflict, embedding, evals, identity, ingest, merge, paths, search
from factloom.operators.store import Store, delete_stored_nodes
from factloom.operators.text_store import TextStore
from factloom.operators.vector_store import VectorStore
from factloom.plans import spec as S
from factloom.plans.queries_facts import _GOOD, SPEC, _body, _records
from factloom.plans.queries_search import _runs
from factloom.session import cut, discard, remove, shared_dir, table
from factloom.sources import bench_graph


def _scratch(s):
    """A folder for what a query stores; it is removed when the query's rows are kept elsewhere."""
    return f"{shared_dir(s)}/stored-{uuid.uuid4().hex}"


def _pick(c, *v):
    return F.element_at(F.array(*map(F.lit, v)), (F.col(c) % len(v) + 1).cast("int"))


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def _hot_lines(s, d):
    """Facts of order lines: those of every third order are about one node."""
    li = table(s, d, "lineitem")
    value = F.concat(F.lit("Q"), (F.col("l_quantity") % 4).cast("int").cast("string"))
    cold = F.concat(F.lit("line:"), "l_orderkey", F.lit(":"), "l_linenumber")
    return li.select(
        F.when(F.col("l_orderkey") % 3 == 0, "line:hot").otherwise(cold).alias("node_id"),
        F.lit("quantity").alias("attribute"),
        F.struct(*_LINE).alias("seq"),
        F.when(F.col("l_partkey") % 2 == 0, value).otherwise(F.lower(value)).alias("value"),
        F.lower(value).alias("norm"),
        _pick("l_partkey", "exact", "grounded", "inferred", "inferred", "human", "exact", "exact").alias("confidence"),
        _pick("l_suppkey", "hr.json", "crm.json", "erp.json").alias("source_file"),
        F.col("l_suppkey").cast("string").alias("source_record_id"),
    )


def _reconcile_hot(s, d):
    folded = conflict.fold(_hot_lines(s, d))
    return folded.select(
        "node_id", "value", "n_facts", F.col("confidence").alias("last_confidence"),
        *[F.col(f"open.{side}.{c}").alias(f"{side}_{c}") for side in ("existing", "incoming") for c in ("value", "confidence")],
        F.col("open.verdict").alias("verdict"),
    )


#: The fold in closed form: only takers change a value, and only if it differs from the taker before.
_RECONCILE_HOT = f"""
WITH f AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'line:hot' ELSE 'line:' || l_orderkey || ':' || l_linenumber END AS node_id,
    row_number() OVER (ORDER BY {", ".join(_LINE)}) AS seq,
    CASE WHEN l_partkey % 2 = 0 THEN 'Q' ELSE 'q' END || CAST(CAST(l_quantity % 4 AS INTEGER) AS VARCHAR) AS value,
    'q' || CAST(CAST(l_quantity % 4 AS INTEGER) AS VARCHAR) AS norm,
    ['exact', 'grounded', 'inferred', 'inferred', 'human', 'exact', 'exact'][CAST(l_partkey % 7 AS INTEGER) + 1] AS conf,
    ['hr.json', 'crm.json', 'erp.json'][CAST(l_suppkey % 3 AS INTEGER) + 1] AS file, CAST(l_suppkey AS VARCHAR) AS rec
  FROM lineitem
), g AS (SELECT *, CASE conf WHEN 'human' THEN 3 WHEN 'exact' THEN 2 WHEN 'grounded' THEN 1 ELSE 0 END AS rung FROM f
), l AS (
  SELECT *, lag(conf) OVER w AS pconf, lag(rung) OVER w AS prung, lag(file) OVER w AS pfile, lag(rec) OVER w AS prec
  FROM g WINDOW w AS (PARTITION BY node_id ORDER BY seq)
), t AS (
  SELECT *, CASE WHEN pconf IS NULL THEN 'in' WHEN file = pfile AND rec = prec THEN 'in' WHEN pconf = 'human' AND conf <> 'human' THEN 'keep'
    WHEN conf = 'human' AND pconf <> 'human' THEN 'in' WHEN prung > rung THEN 'keep' WHEN rung > prung THEN 'in' ELSE 'q' END AS w FROM l
), u AS (
  SELECT *, last_value(CASE WHEN w = 'in' THEN norm END IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM t
), v AS (SELECT *, w = 'in' AND (held IS NULL OR held <> norm) AS start, w = 'q' AND held <> norm AS queued FROM u
), x AS (
  SELECT *, last_value(CASE WHEN start THEN value END IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now FROM v
)
SELECT node_id, arg_max(value, seq) FILTER (start) AS value, count(*) AS n_facts, arg_max(conf, seq) AS last_confidence,
  arg_min(now, seq) FILTER (queued) AS existing_value, arg_min(pconf, seq) FILTER (queued) AS existing_confidence,
  arg_max(value, seq) FILTER (queued) AS incoming_value, arg_max(conf, seq) FILTER (queued) AS incoming_confidence,
  arg_max(CASE WHEN pconf = 'inferred' THEN 'llm_triage' ELSE 'escalate' END, seq) FILTER (queued) AS verdict
FROM x GROUP BY node_id"""


def _bm25_indexed(s, d):
    """Documents indexed in two parts and one replaced text; every id divisible by 20 is a query."""
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("doc:"), "doc_id").alias("id"), "text")
    root = _scratch(s)
    index = TextStore(Store(s, root))
    old = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("an earlier text "), F.col("text"))).otherwise(F.col("text"))
    index.add(docs.where("doc_id % 3 <> 0").select("id", old.alias("text")))
    index.add(docs.where("doc_id % 3 = 0 or doc_id % 7 = 0").select("id", "text"))
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))
    found = cut(index.search(asked, 10, digits=6).select("qid", "id", "score", F.col("rank").cast("long").alias("rank")))
    remove(s, root)
    return found


_BM25_INDEXED = """
WITH d AS (SELECT doc_id, 'doc:' || doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
l AS (SELECT id, coalesce(len(w), 0) AS dl FROM d), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
qt AS (SELECT DISTINCT doc_id AS qid, unnest(w) AS term FROM d WHERE doc_id % 20 = 0),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN p USING (term) JOIN df USING (term) JOIN l USING (id), tot GROUP BY qid, id)
SELECT qid, id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm) WHERE r <= 10"""


def _indexed_vectors(s, d, root):
    """The embeddings filed in two parts, the second of which replaces some vectors of the first."""
    e = table(s, d, "embeddings").select("vec_id", F.concat(F.lit("doc:"), "vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    index = VectorStore(Store(s, root))
    index.train(e)
    old = F.when(F.col("vec_id") % 11 == 0, F.reverse("vector")).otherwise(F.col("vector"))
    index.add(e.where("vec_id % 4 <> 0").select("id", old.alias("vector")))
    index.add(e.where("vec_id % 4 = 0 or vec_id % 11 = 0"))
    return index, e.select("id", "vector"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "vector")


def _vector_indexed(s, d):
    """Exact top 10 of every row whose id is divisible by 20, by way of the index."""
    root = _scratch(s)
    index, _, asked = _indexed_vectors(s, d, root)
    found = cut(index.search(asked, 10, exact=True, digits=6).select("qid", "id", "score"))
    remove(s, root)
    return found


def _vector_probed(s, d):
    """By query, how many of its exact top 10 are found in its nearest lists."""
    root = _scratch(s)
    index, vectors, asked = _indexed_vectors(s, d, root)
    found = index.search(asked, 10, digits=6).select("qid", "id", F.lit(1).alias("hit"))
    exact = search.vector_search(vectors, asked, 10, digits=6)
    out = cut(exact.join(found, ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("hit").alias("n_found")))
    remove(s, root)
    return out


_VECTOR_INDEXED = """
WITH vec AS (
  SELECT b.vec_id AS qid, 'doc:' || a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0
)
SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM vec) WHERE r <= 10"""


def _store_delete_cascade(s, d):
    """The staff records in a store; every 7th person is deleted, and every 14th comes back with
    another name: people, what is known about them, and their edges."""
    root = _scratch(s)
    kept = Store(s, root)
    later = table(s, d, "customer").where("c_custkey % 14 = 0").select(F.lit("staff.json").alias("source_file"), F.col("c_custkey").alias("ordinal"), _body(F.concat("c_name", F.lit(" Jr"))).alias("record"))
    for records, gone in ((_records(s, d), 7), (later, None)):
        got = ingest.ingest(records, SPEC, once=True)
        merge.commit(kept, got)
        discard(got.records)
        if gone:
            delete_stored_nodes(kept, table(s, d, "customer").where(F.col("c_custkey") % gone == 0).select(F.concat(F.lit("person:emp_"), "c_custkey").alias("id")))
    state = kept.read("attributes")
    seen = state.groupBy(F.col("node_id").alias("id")).agg(F.sum("n_facts").alias("n_facts"))
    ends = kept.read("edges").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n_edges"))
    notes = kept.read("provenance").groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n_notes"))
    value = lambda k: jsonpath.as_string(F.try_element_at("attributes", F.lit(k))).alias(k)
    people = merge.graph_nodes(kept.read("nodes"), state)
    for more in (seen, ends, notes):
        people = people.join(more, "id", "left")
    out = cut(people.select("id", "version", value("name"), value("email"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_facts", "n_edges", "n_notes")]))
    remove(s, root)
    return out


_STORE_DELETE_CASCADE = f"""{_GOOD},
b2 AS (SELECT * FROM r WHERE k % 14 = 0),
v AS (SELECT id, count(*) AS version FROM (
  SELECT id FROM (SELECT id FROM good UNION ALL SELECT boss FROM good WHERE boss IS NOT NULL) WHERE CAST(substr(id, 12) AS BIGINT) % 7 <> 0
  UNION ALL SELECT id FROM b2 UNION ALL SELECT boss FROM b2 WHERE boss IS NOT NULL) GROUP BY id),
p AS (SELECT id, name, email FROM good WHERE k % 7 <> 0 UNION ALL SELECT id, name || ' Jr', email FROM b2),
e AS (SELECT id AS src, boss AS dst FROM good WHERE boss IS NOT NULL AND k % 7 <> 0 AND (k // 4) % 7 <> 0 UNION ALL SELECT id, boss FROM b2 WHERE boss IS NOT NULL),
g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)
SELECT v.id, version, name, email, CAST(CASE WHEN p.id IS NULL THEN 0 WHEN email IS NULL THEN 2 ELSE 3 END AS BIGINT) AS n_facts,
  coalesce(g.n, 0) AS n_edges, CAST(CASE WHEN p.id IS NULL THEN 0 WHEN email IS NULL THEN 2 ELSE 3 END AS BIGINT) AS n_notes
FROM v LEFT JOIN p ON v.id = p.id LEFT JOIN g ON v.id = g.id"""


_ORDERS = S.load({
    "tenant": "demo", "source": {"file_pattern": "a-orders.json", "format": "json"},
    "nodes": [
        {"name": "order", "canonical_type": "Event", "id_template": "order:{id}", "fields": []},
        {"name": "buyer", "canonical_type": "Person", "id_template": "person:{buyer}", "fields": []},
    ],
    "edges": [{"canonical_type": "ASSIGNED_TO", "source_node": "@order", "target_node": "@buyer", "fields": [
        {"attribute": "status", "source": "$.status", "transform": ["strip"]}, {"attribute": "total", "source": "$.total"},
        {"attribute": "note", "source": "$.note", "required": False}]}],
})


def _edge_attributes(s, d):
    """Orders whose edge to their buyer has a status and a total; every 4th is stated again: alike but for
    case, otherwise by another file, or otherwise by the same one."""
    o, key = table(s, d, "orders"), F.col("o_orderkey")
    text = lambda status: F.to_json(F.struct(key.alias("id"), F.col("o_custkey").alias("buyer"), status.alias("status"), F.floor("o_totalprice").alias("total")))
    status = F.col("o_orderstatus")
    first = o.select(F.lit("a-orders.json").alias("source_file"), key.alias("ordinal"), text(F.concat(F.lit(" "), status)).alias("record"))
    other = F.when(key % 8 == 0, F.lower(status)).otherwise("X")
    file = F.when((key % 8 != 0) & (key % 3 == 0), "a-orders.json").otherwise("b-erp.json")
    again = o.where(key % 4 == 0).select(file.alias("source_file"), (key + 10**9).alias("ordinal"), text(other).alias("record"))
    got = ingest.ingest(first.unionByName(again), _ORDERS, once=True)
    new = merge.merged(got, F.lit("2024-01-01").cast("timestamp"))
    state = cut(new["edge_attributes"])
    said = merge.statements(got.provenance).groupBy("edge_id").agg(F.count("*").alias("n_values"), F.max("last.ordinal").alias("last_ordinal"))
    about = state.groupBy("edge_id").agg(F.sum("n_facts").alias("n_facts"), F.max("open.verdict").alias("verdict"))
    edges = merge.graph_edges(new["edges"], state).join(said.join(about, "edge_id").withColumnRenamed("edge_id", "id"), "id")
    value = lambda k: jsonpath.as_string(F.try_element_at("attributes", F.lit(k))).alias(k)
    return edges.select("id", "src", "dst", value("status"), value("total"), "n_facts", "n_values", "last_ordinal", "verdict")


_EDGE_ATTRIBUTES = """
WITH o AS (SELECT *, o_orderkey AS k, 'order:' || o_orderkey AS src, 'person:' || o_custkey AS dst FROM orders)
SELECT 'edge_' || substring(sha256(src || '|ASSIGNED_TO|' || dst || '|'), 1, 24) AS id, src, dst,
  CASE WHEN k % 8 = 4 AND k % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS total,
  CAST(CASE WHEN k % 4 = 0 THEN 4 ELSE 2 END AS BIGINT) AS n_facts, CAST(CASE WHEN k % 4 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n_values,
  CASE WHEN k % 4 = 0 THEN k + 1000000000 ELSE k END AS last_ordinal, CASE WHEN k % 8 = 4 AND k % 3 <> 0 THEN 'escalate' END AS verdict
FROM o"""


def _paths_batch(s, d):
    """The chain from every 20th person up to the first, searched from both ends."""
    edges = bench_graph.edges(s, d).where("relation_type = 'REPORTS_TO'")
    person = F.concat(F.lit("person:"), "c_custkey")
    pairs = table(s, d, "customer").where("c_custkey % 20 = 0").select(person.alias("pair"), person.alias("source"), F.lit("person:0").alias("target"))
    found = paths.shortest_paths(edges, pairs)
    return found.select("pair", F.col("length").cast("long").alias("length"), F.array_join("path", ">").alias("path"))


_PATHS_BATCH = """
WITH RECURSIVE up(pair, k, length, path) AS (
  SELECT 'person:' || c_custkey, c_custkey, CAST(0 AS BIGINT), 'person:' || c_custkey FROM customer WHERE c_custkey % 20 = 0
  UNION ALL SELECT pair, k // 4, length + 1, path || '>person:' || (k // 4) FROM up WHERE k > 0
)
SELECT pair, length, path FROM up WHERE k = 0"""


def _latency_by_tier(s, d):
    runs = _runs(s, d)
    rounded = lambda c: F.round(c, 6).alias(c)
    return evals.latency(runs, by=["tier"]).join(evals.p95_exclusive(runs, "latency_ms", ["tier"]).withColumnRenamed("p95", "p95_exclusive"), "tier").select("tier", *map(rounded, ("p50", "p95", "p95_exclusive")))


_LATENCY_BY_TIER = """
WITH r AS (SELECT ['exact', 'router', 'hybrid'][CAST(user_id % 3 AS INTEGER) + 1] AS tier, value AS x FROM events),
v AS (SELECT tier, x, row_number() OVER (PARTITION BY tier ORDER BY x) AS i, count(*) OVER (PARTITION BY tier) AS n FROM r WHERE x IS NOT NULL),
w AS (SELECT *, least(greatest((n + 1) * 19 // 20, 1), n - 1) AS low FROM v)
SELECT tier, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95,
  round(sum(CASE WHEN i = low THEN x * (1 - ((n + 1) * 19 - low * 20) / 20.0::DOUBLE) WHEN i = low + 1 THEN x * ((n + 1) * 19 - low * 20) / 20.0::DOUBLE END), 6) AS p95_exclusive
FROM w GROUP BY tier"""


def _identity_groups(s, d):
    """Customers who share made-up addresses, phone numbers, or names and places."""
    k = F.col("c_custkey")
    people = table(s, d, "customer").select(
        F.concat(F.lit("person:"), k).alias("id"),
        F.when(k % 4 != 3, F.concat(F.lit(" U"), (k / 3).cast("long"), F.when(k % 2 == 0, "@X.org").otherwise("@x.ORG "))).alias("email"),
        F.when(k % 10 == 0, F.concat(F.lit("+1 "), F.lpad((k / 20).cast("long").cast("string"), identity.PHONE_DIGITS, "0"))).when(k % 10 == 5, "12-34").alias("phone"),
        F.when(k % 50 == 7, F.concat(F.lit(" Ann "), (k / 100).cast("long"), F.when(k % 100 == 7, " ").otherwise(""))).when(k % 2 == 0, "Bo").alias("name"),
        F.when(k % 50 == 7, "Oslo").when(k % 4 == 0, "").alias("place"),
    )
    return identity.groups(identity.keys_of(people)).select("id", "least", "n")


_IDENTITY_GROUPS = """
WITH RECURSIVE p AS (SELECT c_custkey AS k, 'person:' || c_custkey AS id FROM customer),
keys AS (
  SELECT id, 'u' || (k // 3) AS key FROM p WHERE k % 4 <> 3
  UNION ALL SELECT id, 'p' || (k // 20) FROM p WHERE k % 10 = 0
  UNION ALL SELECT id, 'n' || (k // 100) FROM p WHERE k % 50 = 7
), links AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keys x JOIN keys y ON x.key = y.key AND x.id <> y.id),
reach(id, other) AS (SELECT DISTINCT id, id FROM keys UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT id, min(other) AS least FROM reach GROUP BY id)
SELECT id, least, count(*) OVER (PARTITION BY least) AS n FROM least"""


def _embed_missing(s, d):
    """Turns embedded in three runs: those of users, then all, every 5th conversation's by new texts, then
    all again, which finds nothing to do. By turn the run that made its vector."""
    root = _scratch(s)
    kept = Store(s, root)
    c = table(s, d, "conversations")
    nodes = c.select(F.concat(F.lit("message:"), "conv_id", F.lit(":"), "turn").alias("id"), F.when(F.col("role") == "user", "Message").otherwise("Event").alias("type"), "text", "conv_id")
    new = nodes.withColumn("text", F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    model = embedding.HashEmbedder()
    n = [embedding.embed_missing(kept, nodes, model, types=["Message"], run="first"), embedding.embed_missing(kept, new, model, run="second"), embedding.embed_missing(kept, new, model, run="third")]
    v = kept.read("vectors")
    norm = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6)
    out = cut(v.select("id", "content_hash", "run", F.size("vector").cast("long").alias("n"), norm.alias("norm"), F.lit(n[2]).cast("long").alias("third")))
    remove(s, root)
    return out


_EMBED_MISSING = """
SELECT 'message:' || conv_id || ':' || turn AS id, sha256(CASE WHEN conv_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash,
  CASE WHEN role = 'user' AND conv_id % 5 <> 0 THEN 'first' ELSE 'second' END AS run, CAST(384 AS BIGINT) AS n, 1.0::DOUBLE AS norm, CAST(0 AS BIGINT) AS third
FROM conversations WHERE text IS NOT NULL"""


def _nested_fingerprint(s, d):
    """Records of orders with lists of several types, empty lists, and strings of several kinds."""
    k = F.col("o_orderkey")
    when = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    parts = [
        F.lit('{"id": '), k, F.lit(', "when": "'), F.when(k % 2 == 0, when).otherwise(F.substring(when, 1, 10)),
        F.lit('", "buyer": {"mail": '), F.when(k % 3 == 0, F.concat(F.lit('"c'), "o_custkey", F.lit('@home.net"'))).otherwise("null"),
        F.lit('}, "tags": '), F.when(k % 4 == 0, "[]").when(k % 4 == 1, '["a", 1]').when(k % 4 == 2, "[1.5, 2]").otherwise(F.concat(F.lit('[{"x": '), k, F.lit('}, "s", {"y": 1}]'))),
        F.lit(', "deep": [['), k, F.lit(", true]]"), F.when(k % 5 == 0, ', "seldom": {}').otherwise(""), F.lit("}"),
    ]
    return ingest.type_fingerprint(table(s, d, "orders").select(F.concat(*[p.cast("string") for p in parts]).alias("record")))


_NESTED_FINGERPRINT = """
WITH o AS (SELECT o_orderkey AS k FROM orders), leaf(path, tag) AS (
  SELECT '$.id', 'int' FROM o
  UNION ALL SELECT '$.when', CASE WHEN k % 2 = 0 THEN 'iso_datetime' ELSE 'str' END FROM o
  UNION ALL SELECT '$.buyer.mail', CASE WHEN k % 3 = 0 THEN 'email_like' ELSE 'null' END FROM o
  UNION ALL SELECT '$.tags[*]', CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'str' WHEN 2 THEN 'float' ELSE 'dict' END FROM o
  UNION ALL SELECT '$.tags[*].x', 'int' FROM o WHERE k % 4 = 3
  UNION ALL SELECT '$.deep[*][*]', 'int' FROM o
  UNION ALL SELECT '$.seldom', 'dict' FROM o WHERE k % 5 = 0
)
SELECT path, CASE WHEN min(tag) = max(tag) THEN min(tag) ELSE 'mixed' END AS tag FROM leaf GROUP BY path"""


QUERIES = {
    "nested_fingerprint": (_nested_fingerprint, _NESTED_FINGERPRINT),
    "store_delete_cascade": (_store_delete_cascade, _STORE_DELETE_CASCADE),
    "edge_attributes": (_edge_attributes, _EDGE_ATTRIBUTES),
    "paths_batch": (_paths_batch, _PATHS_BATCH),
    "latency_by_tier": (_latency_by_tier, _LATENCY_BY_TIER),
    "identity_groups": (_identity_groups, _IDENTITY_GROUPS),
    "embed_missing": (_embed_missing, _EMBED_MISSING),
    "reconcile_hot": (_reconcile_hot, _RECONCILE_HOT),
    "bm25_indexed": (_bm25_indexed, _BM25_INDEXED),
    "vector_indexed": (_vector_indexed, _VECTOR_INDEXED),
    "vector_probed": (_vector_probed, None),
}
