"""Evaluation: golden items, recall, latency, escalation, router metrics, data set tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.quantiles import quantiles

#: Argument keys whose values name an entity.
ID_KEYS = ("emp_id", "sender_emp_id", "recipient_emp_id", "product_id", "conversation_id", "customer_id", "client_id", "repo_name", "vendor_id")


def golden(tasks: DataFrame) -> DataFrame:
    """(task_index, query, expected) of tasks (task_index, record): the first user message that
    is not blank, and the ids in tool-call arguments; tasks without either are left out."""
    v = F.parse_json("record")
    messages = F.try_variant_get(v, "$.messages", "array<variant>")
    t = tasks.select("task_index", F.coalesce(messages, F.raise_error(F.lit("messages missing"))).alias("m"))
    said = F.transform(F.col("m"), lambda m: F.struct(F.try_variant_get(m, "$.role", "string").alias("role"), F.trim(F.try_variant_get(m, "$.content", "string")).alias("content")))
    query = F.get(F.filter(said, lambda s: (s["role"] == "user") & (F.coalesce(s["content"], F.lit("")) != "")), 0)["content"]
    none = F.array().cast("array<string>")
    calls = F.flatten(F.transform(F.col("m"), lambda m: F.coalesce(F.try_variant_get(m, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>"))))
    ids = F.flatten(F.transform(calls, lambda c: F.array(*[F.try_variant_get(c, f"$.function.arguments.{k}", "string") for k in ID_KEYS])))
    t = t.select("task_index", query.alias("query"), F.array_sort(F.array_distinct(F.filter(F.coalesce(ids, none), lambda x: x != ""))).alias("expected"))
    return t.where(F.col("query").isNotNull() & (F.size("expected") > 0))


def coverage(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.size("expected")), F.lit(0)).cast("long").alias("ids"), F.coalesce(F.max(F.size("expected")), F.lit(0)).cast("long").alias("most"))


def recall_at(items: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The share of items (qid, expected) with an expected id among their first k hits (qid, id, rank)."""
    top = hits.where(F.col("rank") <= k).select("qid", "id").distinct()
    want = items.select("qid", F.explode("expected").alias("id"))
    found = want.join(top, ["qid", "id"], "left_semi").select("qid").distinct().withColumn("hit", F.lit(1.0))
    return items.select("qid").join(found, "qid", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def latency(rows: DataFrame, value: str = "latency_ms", by: list[str] | None = None) -> DataFrame:
    """p50 and p95 by linear interpolation, of each group of `by`; without groups one row, of nulls if
    there is no value. Ranks are found by counting (`quantiles`): no task holds all distinct values."""
    q = quantiles(rows, value, [0.5, 0.95], by)
    both = [F.max(F.when(F.col("q") == x, F.col("value"))).alias(n) for n, x in (("p50", 0.5), ("p95", 0.95))]
    return q.groupBy(*by).agg(*both) if by else q.agg(*both)


def p95_exclusive(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The 19th of 20 cut points by the exclusive method: between, or beyond, the two values next to
    position (n + 1) * 0.95 in the order. One value is its own cut point; without groups none gives null."""
    q = quantiles(rows, value, [0.95], by, exclusive=True)
    return q.select(*by, F.col("value").alias("p95")) if by else q.agg(F.max("value").alias("p95"))


def escalation(runs: DataFrame, tiers: list[str]) -> DataFrame:
    """(tier, n, escalation_rate): queries by final tier, zeros included, and the share that did not end in the first."""
    spark = runs.sparkSession
    rate = runs.agg(F.avg((F.col("tier") != tiers[0]).cast("double")).alias("escalation_rate"))
    n = runs.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(t,) for t in tiers], "tier string")
    return F.broadcast(every).join(n, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n")).crossJoin(F.broadcast(rate))


def entity_scores(rows: DataFrame) -> DataFrame:
    """(type, tp, fp, fn, f1) of rows (type, gold, predicted: arrays of spans)."""
    both = F.size(F.array_intersect("gold", "predicted"))
    g = rows.groupBy("type").agg(F.sum(both).alias("tp"), F.sum(F.size(F.array_except("predicted", "gold"))).alias("fp"), F.sum(F.size(F.array_except("gold", "predicted"))).alias("fn"))
    total = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return g.withColumn("f1", F.when(total > 0, 2.0 * F.col("tp") / total).otherwise(F.lit(0.0)))


def macro_f1(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("f1").alias("macro_f1"))


def intent_accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy"))


def unseen(candidates: DataFrame, known: DataFrame, key: str = "query") -> DataFrame:
    """Candidates whose query no known set has, each once."""
    return candidates.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")


def span_labels(rows: DataFrame) -> DataFrame:
    """(text, entities: array of [span, type]) of rows (text, entities: map type -> spans)."""
    pairs = F.flatten(F.transform(F.array_sort(F.map_entries("entities")), lambda e: F.transform(e["value"], lambda s: F.array(s, e["key"]))))
    return rows.select("text", pairs.alias("entities"))


#: Patterns that seed entity labels.
SEEDS = {"emp_id": r"\bemp_\d+\b", "customer_id": r"\b(?:CLNT|CUST|VEND)-\d+\b", "ticket_id": r"\b(?:ticket|conv)[-_:]\w+\b", "date": r"\b\d{4}-\d{2}-\d{2}\b", "product": r"\bB0[0-9A-Z]{8}\b"}


def seeds(rows: DataFrame, text: str = "text", most: int = 3) -> DataFrame:
    """Rows with the first spans of each type found by pattern."""
    found = [x for k, p in SEEDS.items() for x in (F.lit(k), F.slice(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))), 1, most))]
    return rows.withColumn("entities", F.map_filter(F.create_map(*found), lambda _, v: F.size(v) > 0))


#: Patterns of labels by type, each with the group that is the label, in the order in which
#: they are looked for; words that an inline customer id is not; and how many of a type are kept.
LABELS = {
    "emp_id": [(r"\bemp_\d+\b", 0)],
    "customer_id": [(r"\b(?:CLNT|CUST|VEND|ORG)-\d+\b", 0), (r"(?i)\bcustomer[ _]?id[\s:]+['\"]?([A-Za-z][A-Za-z0-9_]{2,15})['\"]?", 1)],
    "product": [(r"\b[A-Z][0-9A-Z]{9}\b", 0)],
    "ticket_id": [(r"(?i)\bTicket\s+id\s+(\d+)\b", 1), (r"(?i)\bticket[-_:]\d+\b", 0)],
    "department": [(r"\b(?:HR|Engineering|Sales|Finance|Marketing|Legal|Operations|Human Resources|IT|Product)\b", 0)],
    "date": [(r"\b\d{4}-\d{2}-\d{2}\b", 0)],
}
NO_CUSTOMER = ("key", "value", "details", "name", "the", "an", "id")
KEPT, KEPT_OF = 3, {"emp_id": 6}


def labels(text) -> Column:
    """Map of type to the first distinct labels found by pattern; types without any are left out."""
    pairs = []
    for kind, patterns in LABELS.items():
        found = [F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p, group in patterns]
        if kind == "customer_id":
            found[1] = F.filter(found[1], lambda x: ~F.lower(x).isin(list(NO_CUSTOMER)))
        pairs += [F.lit(kind), F.slice(F.array_distinct(F.concat(*found)), 1, KEPT_OF.get(kind, KEPT))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def dataset_report(rows: DataFrame) -> DataFrame:
    """(kind, name, n): queries by intent, spans by entity type."""
    a = rows.groupBy("intent").agg(F.count(F.lit(1)).alias("n")).select(F.lit("intent").alias("kind"), F.col("intent").alias("name"), "n")
    e = rows.select(F.explode("entities").alias("name", "spans")).groupBy("name").agg(F.sum(F.size("spans")).cast("long").alias("n"))
    return a.unionByName(e.select(F.lit("entity").alias("kind"), "name", "n"))
