"""Queries over text and vectors: tokens, routing, BM25, kNN, fusion, the cascade; evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import evals, search
from factloom.session import table

#: Example queries.
ASKED = ["the of and", "retion de la", "how many of the", "emp_17 and ORDER-99", "doc:7", "find all things that were said about the ention", "product:x1 emp_17 emp_17", "B0BQ3K23Y1"]
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))


def _q(s):
    return s.createDataFrame(list(enumerate(ASKED)), "qid int, query string")


def _docs(s, d):
    return table(s, d, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), "text")


def _vectors(s, d):
    e = table(s, d, "embeddings")
    return e.select(F.concat(F.lit("doc:"), "vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def _asked(s, d):
    """The queries with vectors: every row whose id is divisible by 20, the example texts in turn."""
    v = table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector"))
    texts = F.broadcast(_q(s).withColumnRenamed("qid", "turn"))
    return v.join(texts, F.expr(f"pmod(qid div 20, {len(ASKED)})") == F.col("turn")).select("qid", "query", "vector")


_FEW = f"q(qid, query) AS (VALUES {_VALUES})"
#: Every row whose id is divisible by 20, the example texts in turn.
_ALL = f"q AS (SELECT vec_id AS qid, query FROM embeddings JOIN (VALUES {_VALUES}) t(turn, query) ON (vec_id // 20) % {len(ASKED)} = turn WHERE vec_id % 20 = 0)"
_BM25 = """qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+')) AS term FROM q),
d AS (SELECT 'doc:' || doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
l AS (SELECT id, len(w) AS dl FROM d), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qt JOIN p USING (term) JOIN df USING (term) JOIN l USING (id), tot GROUP BY qid, id)"""
_VEC = """vec AS (SELECT b.vec_id AS qid, 'doc:' || a.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0)"""
_RANK = "row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)"
_FUSED = f"""lx AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm), vx AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM vec),
fu AS (SELECT coalesce(v.qid, l.qid) AS qid, coalesce(v.id, l.id) AS id, (coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + l.r), 0)) / (2.0::DOUBLE / 61) AS score, v.r AS vr, l.r AS lr
  FROM (SELECT * FROM vx WHERE r <= 30) v FULL JOIN (SELECT * FROM lx WHERE r <= 30) l ON v.qid = l.qid AND v.id = l.id),
hy AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vr NULLS LAST, lr NULLS LAST) AS r FROM fu)"""
_round = lambda c: F.round(c, 6)


def _hybrid(s, d):
    return search.hybrid(search.text_index(_docs(s, d)), _vectors(s, d), _asked(s, d)).select(F.col("qid").cast("long").alias("qid"), "id", _round("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def _cascade(s, d):
    c = search.cascade_batch(_docs(s, d).select("id"), search.text_index(_docs(s, d)), _vectors(s, d), _asked(s, d))
    return c.select(F.col("qid").cast("long").alias("qid"), "tier", _round("relevance").alias("relevance"))


def _runs(s, d):
    """Runs made from events: tiers by user, latencies by value."""
    e = table(s, d, "events")
    return e.select("event_id", F.element_at(F.array(*map(F.lit, ["exact", "router", "hybrid"])), (F.col("user_id") % 3 + 1).cast("int")).alias("tier"), F.col("value").alias("latency_ms"))


def _spans(s, d):
    """Gold and predicted spans made from conversation turns."""
    c = table(s, d, "conversations")
    w = F.array_distinct(F.split("text", " "))
    return c.select(F.col("role").alias("type"), w.alias("gold"), F.filter(w, lambda x: F.length(x) > 3).alias("predicted"))


def _recall(s, d):
    items = _asked(s, d).select("qid", F.array(F.concat(F.lit("doc:"), F.col("qid") * 3), F.concat(F.lit("doc:"), F.col("qid") + 1)).alias("expected"))
    hits = search.vector_search(_vectors(s, d), _asked(s, d), 50)
    return evals.recall_at(items, hits, 50).select(_round("recall").alias("recall"))


def _texts(s, d, make):
    """What is found in whole turns, with made-up ids appended."""
    t = table(s, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" [node:person:"), F.col("conv_id"), F.lit("] emp_"), F.col("turn"), F.lit(" EMP_"), F.col("turn"), F.lit(" CUST-"), F.col("conv_id"), F.lit(" order-x"), F.col("turn"), F.lit(" sale_"), F.col("turn"), F.lit(" [node:person:"), F.col("conv_id"), F.lit("]")).alias("text"))
    return t.select("conv_id", "turn", F.array_join(make(F.col("text")), ",").alias("found"))


#: The same texts in SQL, and what a pattern finds in them.
_MADE = "(SELECT conv_id, turn, coalesce(text, '') || ' [node:person:' || conv_id || '] emp_' || turn || ' EMP_' || turn || ' CUST-' || conv_id || ' order-x' || turn || ' sale_' || turn || ' [node:person:' || conv_id || ']' AS text FROM conversations)"


def _extracted(pattern: str) -> str:
    return f"regexp_extract_all(text, '{pattern}', 0)"


#: What is put before and after a turn to ask about it, in turn: nothing, ids, words of analysis.
_ASKING = [("", ""), ("emp_17 and ORDER-99 ", ""), ("how many ", ""), ("product:x1 emp_17 emp_17 ", " CUST-5"), ("", " B0BQ3K23Y1"), ("the trend of ", "?")]


def _said(s, d):
    """Queries made of every turn, by kind: the whole text with what is asked, or at even turns of kind 0 its first three words."""
    turn = F.coalesce("turn", F.lit(0))
    c = table(s, d, "conversations").withColumn("kind", F.pmod(F.coalesce("conv_id", F.lit(0)) + turn, F.lit(len(_ASKING))).cast("long"))
    part = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in _ASKING]), (F.col("kind") + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    text = F.when((F.col("kind") == 0) & (turn % 2 == 0), F.array_join(F.slice(F.split(text, " "), 1, 3), " ")).otherwise(text)
    return c.select("conv_id", "turn", "kind", F.concat(part(0), text, part(1)).alias("query"))


_PARTS = [f"{list(p)}[CAST(kind AS INTEGER) + 1]" for p in zip(*_ASKING)]
_SAID = f"""(SELECT conv_id, turn, CAST(kind AS BIGINT) AS kind, {_PARTS[0]} || CASE WHEN kind = 0 AND coalesce(turn, 0) % 2 = 0 THEN array_to_string(string_split(coalesce(text, ''), ' ')[1:3], ' ') ELSE coalesce(text, '') END || {_PARTS[1]} AS query
  FROM (SELECT *, (coalesce(conv_id, 0) + coalesce(turn, 0)) % {len(_ASKING)} AS kind FROM conversations))"""


QUERIES = {
    "id_tokens": (
        lambda s, d: _texts(s, d, X.id_tokens),
        f"SELECT conv_id, turn, array_to_string(list_distinct_ordered, ',') AS found FROM (SELECT conv_id, turn, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM (SELECT conv_id, turn, {' || '.join(_extracted(p) for p in X.ID_PATTERNS)} AS t FROM {_MADE}))",
    ),
    "cited_nodes": (
        lambda s, d: _texts(s, d, X.cited_nodes),
        f"SELECT conv_id, turn, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS found FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\[node:([A-Za-z0-9_:./-]+)\\]', 1) AS t FROM {_MADE})",
    ),
    "light_ner": (
        lambda s, d: _texts(s, d, X.light_entities),
        f"SELECT conv_id, turn, array_to_string(list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i), ',') AS found FROM (SELECT conv_id, turn, {_extracted(X.MESSAGE_ID)} AS t FROM {_MADE})",
    ),
    "router_intent": (lambda s, d: search.routed(_said(s, d)).select("conv_id", "turn", "kind", "intent", "confidence", "route_to"), f"SELECT conv_id, turn, kind, intent, CASE intent WHEN 'lookup' THEN 1.0::DOUBLE WHEN 'analytical' THEN 0.8::DOUBLE WHEN 'ambiguous' THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS confidence, CASE intent WHEN 'lookup' THEN 'exact' WHEN 'analytical' THEN 'agentic' ELSE 'hybrid' END AS route_to FROM (SELECT conv_id, turn, kind, CASE WHEN regexp_matches(query, '\\bemp_\\d+\\b|\\b(CLNT|CUST|VEND|ORG)-\\d+\\b|\\b[A-Z][0-9A-Z]{{9}}\\b') OR regexp_matches(query, '\\b(ticket|conv|conversation|order|sale|product)[-_:][\\w-]+\\b', 'i') THEN 'lookup' WHEN regexp_matches(query, '\\b(how many|count|average|compare|trend|over (the )?(last|past))\\b', 'i') THEN 'analytical' WHEN len(string_split_regex(trim(query), '\\s+')) <= 4 THEN 'ambiguous' ELSE 'search' END AS intent FROM {_SAID})"),
    "router_entities": (
        lambda s, d: search.routed(_said(s, d)).select("conv_id", "turn", "kind", F.explode("entities").alias("e")).select("conv_id", "turn", "kind", "e.type", "e.span"),
        f"WITH t AS (SELECT DISTINCT conv_id, turn, kind, n, unnest({' || '.join(_extracted(p).replace('(text,', '(query,') for p in search._STUB_PATTERNS)}) AS span FROM (SELECT *, row_number() OVER () AS n FROM {_SAID})) SELECT conv_id, turn, kind, CASE WHEN starts_with(lower(span), 'emp_') THEN 'emp_id' WHEN regexp_matches(lower(span), '^(clnt|cust|vend|org)-') THEN 'customer_id' WHEN regexp_matches(lower(span), '^(ticket|conv|order|sale)') THEN 'ticket_id' ELSE 'product' END AS type, span FROM t",
    ),
    "bm25_topk": (lambda s, d: search.ranked(search.bm25(search.text_index(_docs(s, d)), _q(s)).withColumn("score", _round("score")), 10).select(F.col("qid").cast("long").alias("qid"), "id", "score", F.col("rank").cast("long").alias("rank")), f"WITH {_FEW}, {_BM25} SELECT CAST(qid AS BIGINT) AS qid, id, score, r AS rank FROM (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS r FROM bm) WHERE r <= 10"),
    "vector_topk": (lambda s, d: search.vector_search(_vectors(s, d), _asked(s, d), 10, digits=6).select(F.col("qid").cast("long").alias("qid"), "id", "score"), f"WITH {_VEC} SELECT qid, id, score FROM (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS r FROM vec) WHERE r <= 10"),
    "hybrid_topk": (_hybrid, f"WITH {_ALL}, {_BM25}, {_VEC}, {_FUSED} SELECT qid, id, round(score, 6) AS score, r AS rank FROM hy WHERE r <= 10"),
    "cascade_batch": (_cascade, f"WITH {_ALL}, {_BM25}, {_VEC}, {_FUSED}, ex AS (SELECT qid, max(score / (1 + score)) AS e FROM bm JOIN q USING (qid) WHERE len(string_split_regex(trim(query), '\\s+')) <= 4 AND NOT regexp_matches(query, '[*?]') GROUP BY qid), h AS (SELECT qid, max(score) AS h FROM hy GROUP BY qid) SELECT CAST(q.qid AS BIGINT) AS qid, CASE WHEN e >= 0.5 THEN 'exact' WHEN h >= 0.6 THEN 'hybrid' ELSE 'stub' END AS tier, CASE WHEN e >= 0.5 THEN round(e, 6) WHEN h >= 0.6 THEN round(h, 6) ELSE 0.0 END AS relevance FROM q LEFT JOIN ex ON q.qid = ex.qid LEFT JOIN h ON q.qid = h.qid"),
    "recall_at_k": (_recall, f"WITH {_VEC}, t AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM vec) SELECT round(avg(CAST(hit AS DOUBLE)), 6) AS recall FROM (SELECT q, max(CASE WHEN t.id IS NULL THEN 0 ELSE 1 END) AS hit FROM (SELECT vec_id AS q FROM embeddings WHERE vec_id % 20 = 0) x LEFT JOIN t ON t.qid = q AND r <= 50 AND t.id IN ('doc:' || q * 3, 'doc:' || (q + 1)) GROUP BY q)"),
    "latency_percentiles": (lambda s, d: evals.latency(_runs(s, d)).select(_round("p50").alias("p50"), _round("p95").alias("p95")), "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events"),
    "escalation_rate": (lambda s, d: evals.escalation(_runs(s, d), ["exact", "router", "hybrid", "stub"]).withColumn("escalation_rate", _round("escalation_rate")), "WITH r AS (SELECT ['exact', 'router', 'hybrid'][CAST(user_id % 3 AS INTEGER) + 1] AS tier FROM events), a AS (SELECT round(avg(CASE WHEN tier <> 'exact' THEN 1.0::DOUBLE ELSE 0 END), 6) AS escalation_rate FROM r) SELECT t.tier, count(r.tier) AS n, any_value(escalation_rate) AS escalation_rate FROM (VALUES ('exact'), ('router'), ('hybrid'), ('stub')) t(tier) LEFT JOIN r ON r.tier = t.tier, a GROUP BY t.tier"),
    "ner_f1": (lambda s, d: evals.entity_scores(_spans(s, d)).select("type", F.col("tp").cast("long").alias("tp"), F.col("fn").cast("long").alias("fn"), _round("f1").alias("f1")), "WITH w AS (SELECT role, list_distinct(string_split(text, ' ')) AS g FROM conversations), x AS (SELECT role, len(list_filter(g, lambda y: length(y) > 3)) AS tp, len(g) AS n FROM w) SELECT role AS type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n - tp) AS BIGINT) AS fn, round(2.0::DOUBLE * sum(tp) / (sum(tp) + sum(n)), 6) AS f1 FROM x GROUP BY role"),
    "intent_accuracy": (lambda s, d: evals.intent_accuracy(table(s, d, "labels").select(F.col("quality").alias("gold"), (1 - F.col("toxic")).alias("predicted"))).select(_round("accuracy").alias("accuracy")), "SELECT round(avg(CASE WHEN quality = 1 - toxic THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM labels"),
    "embed_pass": (lambda s, d: table(s, d, "conversations").select("conv_id", "turn", X.hash_embedded(F.col("text")).alias("v")).select("conv_id", "turn", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("norm")), None),
}
