"""The queries of this subpackage over the driver's tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, ego_join, katz, langid, minhash, mixing, prefix_tree, quality, repair, simhash, suffix, trie_tokens, url_filter
from factloom.session import cut, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 5, 0)
    model = langid.fit(docs.where(~held), sample_rows=4000)
    return langid.identified(docs.select("doc_id", "text", held.alias("held_out")), model, spans=True).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(simhash.edited(table(spark, sf_dir, "documents")))
    return simhash.searched(found).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats_removed(table(spark, sf_dir, "documents"), width=50)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return trie_tokens.tokens_counted(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.linked(table(spark, sf_dir, "embeddings"), least=0.98)


#: Dated host entries of an example list (pattern, kind, action, day).
HOST_ENTRIES = [
    ("example.net", "host", "add", "2024-02-01"), ("example.net", "host", "remove", "2024-05-01"), ("blog.tionble.example.com", "host", "add", "2024-03-15"),
    ("example.org", "host", "add", "2024-06-01"), ("example.org", "host", "remove", "2024-06-20"), ("example.org", "host", "add", "2024-09-10"),
    ("tionble.example.com", "host", "add", "2024-10-01"), ("tionble.example.com", "host", "remove", "2024-12-01"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures fetched on day page_id mod 366 of 2024, against the host entries above
    and prefix entries made from every 25th page: added on one day, removed 45 days later."""
    pages = table(spark, sf_dir, "pages").withColumn("fetched_on", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))"))
    hosts = spark.createDataFrame(HOST_ENTRIES, "pattern string, kind string, action string, at string").withColumn("at", F.col("at").cast("date"))
    top = F.concat(url_filter.host(F.col("url")), F.regexp_extract(url_filter.path(F.col("url")), r"^(/[^/]*/)", 1))
    made = pages.where("page_id % 25 = 0").select(top.alias("pattern"), F.expr("date_add(date'2024-01-01', cast(page_id * 7 % 366 as int))").alias("day")).where("pattern like '%/'")
    made = made.select("pattern", F.lit("prefix").alias("kind"), F.explode(F.array(F.struct(F.lit("add").alias("action"), F.col("day").alias("at")), F.struct(F.lit("remove").alias("action"), F.date_add("day", 45).alias("at")))).alias("e")).select("pattern", "kind", "e.action", "e.at")
    out = url_filter.filtered(pages, hosts.unionByName(made), "page_id", "url", "fetched_on")
    return out.select("page_id", F.col("fetched_on").cast("string").alias("fetched_on"), "host", F.col("n_matches").cast("long").alias("n_matches"), "matched", "blocked")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), [5, 2, 1], share=1.5, cap=2.0).select("doc_id", "size", "source", "source_size", "target", "taken")


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(table(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"), 7, 2), order=2, min_count=1)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.grouped(table(spark, sf_dir, "documents"), width=2, percent=80)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    return quality.scored(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.Repair(*repair.damaged(table(spark, sf_dir, "conversations"))).report()


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.nodes(*prefix_tree.rebuilt(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_language_id, op2_simhash, op3_byte_bpe, op4_suffix_dedup, op5_token_counts, op6_embedding_near_dedup, op7_url_filter, op8_source_mix, op9_katz_scores, op10_minhash, op11_quality, op12_conversation_repair, op13_prefix_trie)
    return {f.__name__: f for f in named}


_COMPONENTS = """
reach(id, other) AS (
  SELECT id, id FROM vertices
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
)"""

_ENTRIES = ", ".join(f"('{p}', '{k}', '{a}', DATE '{d}')" for p, k, a, d in HOST_ENTRIES)

ORACLES = {
    "op6_embedding_near_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), vertices AS (SELECT vec_id AS id FROM v), {_COMPONENTS},
comp AS (SELECT id, min(other) AS c FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN comp ON v.vec_id = comp.id LEFT JOIN degree ON v.vec_id = degree.a""",
    "op7_url_filter": f"""
WITH captures AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
    nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '') AS host,
    '/' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)', 1) AS path
  FROM pages
), made AS (
  SELECT host || regexp_extract(path, '^(/[^/]*/)', 1) AS pattern, DATE '2024-01-01' + CAST(page_id * 7 % 366 AS INTEGER) AS day
  FROM captures WHERE page_id % 25 = 0
), entries(pattern, kind, action, day) AS (
  SELECT * FROM (VALUES {_ENTRIES})
  UNION ALL SELECT pattern, 'prefix', 'add', day FROM made WHERE pattern LIKE '%/'
  UNION ALL SELECT pattern, 'prefix', 'remove', day + 45 FROM made WHERE pattern LIKE '%/'
), daily AS (SELECT pattern, kind, day AS began, max(action) AS action FROM entries GROUP BY ALL
), spans AS (SELECT *, lead(began) OVER (PARTITION BY kind, pattern ORDER BY began) AS until FROM daily
), hits AS (
  SELECT page_id, kind || ':' || pattern AS p FROM captures JOIN spans
  ON action = 'add' AND day >= began AND (until IS NULL OR day < until)
  AND CASE WHEN kind = 'host' THEN host = pattern OR ends_with(host, '.' || pattern) ELSE starts_with(host || path, pattern) END
)
SELECT c.page_id, CAST(day AS VARCHAR) AS fetched_on, host, count(p) AS n_matches, min(p) AS matched, count(p) > 0 AS blocked
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id GROUP BY c.page_id, day, host""",
    "op10_minhash": f"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), x AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS x
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM x WHERE 100 * x >= 80 * (na + nb - x)
), vertices AS (SELECT doc_id AS id FROM documents), {_COMPONENTS},
comp AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c AS component_id, s.doc_id = c AS kept FROM s JOIN comp ON s.doc_id = comp.id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
