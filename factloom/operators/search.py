"""Retrieval: exact ids, BM25, vectors, rank fusion, a rule router, and the cascade over them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import ID_PATTERNS, id_tokens, squash
from factloom.session import cut, ship

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}_]+"
RRF_K = 60
BLOCK_ROWS = 4096
BROADCAST_TERMS = 100_000
#: What a tier has to reach.
THRESHOLDS = {"exact": 0.5, "router": 0.5, "hybrid": 0.6, "agentic": 0.5, "stub": 0.0}


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


@dataclass(frozen=True)
class TextIndex:
    """An inverted index: postings (term, id, tf), documents (id, dl), and N and mean length."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame


def text_index(docs: DataFrame) -> TextIndex:
    """Of docs (id, text); tf is combined before it is shuffled."""
    t = docs.select("id", F.explode(terms(F.col("text"))).alias("term"))
    postings = t.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    lengths = cut(docs.select("id", F.size(terms(F.coalesce("text", F.lit("")))).cast("long").alias("dl")))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return TextIndex(postings, lengths, totals)


def bm25(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(qid, id, score) for queries (qid, query): any of the distinct terms matches. The query's
    terms restrict the postings before anything is joined to them; they are broadcast up to
    BROADCAST_TERMS, which is counted. The one row of totals is."""
    q = queries.select("qid", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    small = (lambda d: F.broadcast(d)) if q.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else lambda d: d
    hit = cut(index.postings.join(small(q.select("term").distinct()), "term", "left_semi"))  # texts are read once
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = hit.join(small(df), "term").join(small(q), "term").join(index.lengths, "id").crossJoin(F.broadcast(index.totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * 1.0 / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return x.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, k: int, place: str = "rank") -> DataFrame:
    """The k best of each query, by score and then id."""
    r = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scores.withColumn(place, r).where(F.col(place) <= k)


def fulltext(index: TextIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    return ranked(bm25(index, queries).select("qid", "id", squash(F.col("score")).alias("score")), k)


def rounded(score: np.ndarray, digits: int | None) -> np.ndarray:
    return score if digits is None else np.floor(score * 10.0**digits + 0.5) / 10.0**digits


def block_best(k: int, digits: int | None = None):
    """The k best of one block of queries (side 0) in one block of vectors (side 1), by score (rounded
    to `digits`, if given) and then id: k rows a query at most, however many vectors are equal.
    Products find candidates; their scores are added up from left to right, so that equal vectors
    score alike wherever they stand. Zero vectors have no direction and no score."""
    slack = 1e-9 + (0.0 if digits is None else 10.0**-digits)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        key = np.array(table.column("key").to_pylist(), dtype=object)
        v = table.column("vector").combine_chunks()
        v = v.flatten().to_numpy().reshape(len(v), -1)
        norm = np.sqrt(np.cumsum(v * v, axis=1)[:, -1])
        q, d = np.flatnonzero((side == 0) & (norm > 0)), np.flatnonzero((side == 1) & (norm > 0))
        if len(d):
            d = d[np.argsort([x.encode() for x in key[d]], kind="stable")]  # so that places order as ids do
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        unit = v / np.where(norm > 0, norm, 1)[:, None]
        for a in range(0, len(q), 256) if len(d) else ():
            part = q[a : a + 256]
            s = unit[part] @ unit[d].T
            n = min(k, len(d))
            least = np.partition(s, len(d) - n, axis=1)[:, len(d) - n]
            x, y = np.nonzero(s >= least[:, None] - slack)
            score = np.empty(len(x))
            for b in range(0, len(x), 1 << 16):
                i, j = part[x[b : b + (1 << 16)]], d[y[b : b + (1 << 16)]]
                score[b : b + (1 << 16)] = np.cumsum(v[j] * v[i], axis=1)[:, -1] / (norm[j] * norm[i])
            score = rounded(score, digits)
            best = np.lexsort((y, -score, x))
            start = np.searchsorted(x[best], np.arange(len(part)))
            best = best[np.arange(len(best)) - start[x[best]] < k]
            out.append((part[x[best]], d[y[best]], score[best]))
        pick = lambda t: np.concatenate([o[t] for o in out]) if out else np.zeros(0, np.int64)
        return pa.table({"qid": pa.array(key[pick(0)], pa.string()), "id": pa.array(key[pick(1)], pa.string()), "score": pa.array(pick(2), pa.float64())})

    return run


#: Vectors that have a score: some length, and no element that is null or no finite number.
WHOLE = "vector is not null and size(vector) > 0 and not exists(vector, x -> x is null or not abs(x) < double('Infinity'))"


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 30, digits: int | None = None) -> DataFrame:
    """Exact cosine top-k of queries (qid, vector) over vectors (id, vector), by score (rounded to
    `digits`, if given) and then id. Blocks of queries are compared with blocks of vectors, so both
    sides may grow; what is null or zero, has an element that is no finite number, or another length,
    has no score and is no hit."""
    spark = vectors.sparkSession
    ship(spark)
    as_doubles = F.col("vector").cast("array<double>").alias("vector")
    q, v = queries.select(F.col("qid").cast("string").alias("key"), as_doubles).where(WHOLE), vectors.select(F.col("id").alias("key"), as_doubles).where(WHOLE)
    blocks = [max(1, -(-x.count() // BLOCK_ROWS)) for x in (q, v)]
    place = [F.pmod(F.xxhash64("key"), F.lit(n)).cast("int") for n in blocks]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in blocks]
    both = q.select(F.lit(0).alias("side"), "key", "vector", place[0].alias("a"), every[1].alias("b"))
    both = both.unionByName(v.select(F.lit(1).alias("side"), "key", "vector", every[0].alias("a"), place[1].alias("b")))
    both = both.withColumn("width", F.size("vector"))
    found = both.groupBy("a", "b", "width").applyInArrow(block_best(k, digits), "qid string, id string, score double")
    return ranked(found.withColumn("qid", F.col("qid").cast(queries.schema["qid"].dataType)), k)


def rrf(vector: DataFrame, lexical: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two ranked arms (qid, id, rank), normalised to 1."""
    a, b = vector.select("qid", "id", F.col("rank").alias("vrank")), lexical.select("qid", "id", F.col("rank").alias("lrank"))
    f = a.join(b, ["qid", "id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    f = f.withColumn("score", (part("vrank") + part("lrank")) / (2.0 / (RRF_K + 1)))
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.col("vrank").asc_nulls_last(), F.col("lrank").asc_nulls_last())
    return f.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(ids: DataFrame, index: TextIndex, queries: DataFrame) -> DataFrame:
    """(qid, id, score, relevance): id tokens that are node ids score 1; else BM25 for queries of
    four words at most and without wild cards."""
    q = queries.withColumn("tokens", id_tokens(F.col("query")))
    found = q.select("qid", F.explode("tokens").alias("id")).join(ids.select("id"), "id", "left_semi").withColumn("score", F.lit(1.0))
    short = q.where((F.size(F.split(F.trim("query"), r"\s+")) <= 4) & ~F.col("query").rlike(r"[*?]")).join(found.select("qid").distinct(), "qid", "left_anti")
    hits = found.select("qid", "id", "score").unionByName(fulltext(index, short.select("qid", "query")).select("qid", "id", "score"))
    return hits.withColumn("relevance", F.max("score").over(W.partitionBy("qid")))


#: Words that hint at analysis.
ANALYTICAL = r"(?i)\b(?:how many|count|average|compare|trend|over (?:the )?(?:last|past))\b"
_STUB_PATTERNS = tuple(p for p in ID_PATTERNS if "0-9a-f]{8}" not in p)


def entity_type(token: Column) -> Column:
    t = F.lower(token)
    starts = lambda *x: F.lit(False) if not x else __import__("functools").reduce(lambda a, b: a | b, [t.startswith(p) for p in x])
    return F.when(t.startswith("emp_"), "emp_id").when(starts("clnt-", "cust-", "vend-", "org-"), "customer_id").when(starts("ticket", "conv", "order", "sale"), "ticket_id").otherwise("product")


def routed(queries: DataFrame) -> DataFrame:
    """The rule router over a table of queries: intent, confidence, entities (array of type, span)
    and the tier it sends to."""
    spans = id_tokens(F.col("query"), _STUB_PATTERNS)
    q = queries.withColumn("entities", F.transform(spans, lambda s: F.struct(entity_type(s).alias("type"), s.alias("span"))))
    words = F.size(F.split(F.trim("query"), r"\s+"))
    intent = F.when(F.size("entities") > 0, "lookup").when(F.col("query").rlike(ANALYTICAL), "analytical").when(words <= 4, "ambiguous").otherwise("search")
    q = q.withColumn("intent", intent)
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in {"lookup": 1.0, "analytical": 0.8, "ambiguous": 0.6, "search": 0.7}.items() for x in kv]), F.col("intent"))
    to = F.element_at(F.create_map(*[F.lit(x) for kv in {"lookup": "exact", "analytical": "agentic", "ambiguous": "hybrid", "search": "hybrid"}.items() for x in kv]), F.col("intent"))
    return q.withColumn("confidence", sure).withColumn("route_to", to)


def hybrid(index: TextIndex, vectors: DataFrame, queries: DataFrame, candidates: int = 30, k: int = 10) -> DataFrame:
    """queries: qid, query, vector."""
    texts = queries.groupBy("query").agg(F.min("qid").alias("text"))
    lexical = ranked(bm25(index, texts.select(F.col("text").alias("qid"), "query")), candidates).withColumnRenamed("qid", "text")
    asked = queries.join(texts, "query").select("qid", "text")
    return rrf(vector_search(vectors, queries, candidates), lexical.join(asked, "text").select("qid", "id", "rank"), k)


def cascade_batch(ids: DataFrame, index: TextIndex, vectors: DataFrame, queries: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Per query the tier that answers it and its relevance: exact if that reaches its threshold,
    else hybrid if it does, else the last (stub)."""
    texts = queries.groupBy("query").agg(F.min("qid").alias("text"))
    e = exact(ids, index, texts.select(F.col("text").alias("qid"), "query")).groupBy(F.col("qid").alias("text")).agg(F.max("relevance").alias("e"))
    e = queries.join(texts.join(e, "text"), "query").select("qid", "e")
    rest = queries.join(e.where(F.col("e") >= thresholds["exact"]), "qid", "left_anti")
    h = hybrid(index, vectors, rest).groupBy("qid").agg(F.max("score").alias("h"))
    out = queries.select("qid").join(e, "qid", "left").join(h, "qid", "left")
    tier = F.when(F.col("e") >= thresholds["exact"], "exact").when(F.col("h") >= thresholds["hybrid"], "hybrid").otherwise("stub")
    return out.withColumn("tier", tier).select("qid", "tier", F.when(F.col("tier") == "exact", F.col("e")).when(F.col("tier") == "hybrid", F.col("h")).otherwise(F.lit(0.0)).alias("relevance"))


# ---- the interactive cascade -------------------------------------------------------------


@dataclass
class Result:
    tier: str
    relevance: float
    hits: list = field(default_factory=list)
    route_to: str | None = None
    latency_ms: float = 0.0
    extras: dict = field(default_factory=dict)


Tier = Callable[[str], Result]


def stub(_: str) -> Result:
    return Result("stub", 0.0)


class Cascade:
    """Runs tiers in order until one reaches its threshold. One re-route at most is followed; a
    target that ran already, or is unknown, is ignored."""

    def __init__(self, tiers: dict[str, Tier], thresholds: dict[str, float] | None = None):
        if not tiers:
            raise ValueError("a cascade needs a tier")
        self.tiers, self.thresholds = dict(tiers), {**THRESHOLDS, **(thresholds or {})}

    def run(self, query: str, start: str | None = None) -> Result:
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query must not be blank")
        todo = list(self.tiers)
        if start is not None:
            if start not in self.tiers:
                raise ValueError(f"unknown tier {start!r}")
            todo = todo[todo.index(start) :]
        done, rerouted, last = set(), False, None
        while todo:
            name = todo.pop(0)
            if name in done:
                continue
            began = time.perf_counter()
            last = self.tiers[name](query)
            if last.tier != name:
                raise RuntimeError(f"tier {name} answered as {last.tier}")
            last.latency_ms = (time.perf_counter() - began) * 1000
            done.add(name)
            if last.relevance >= self.thresholds.get(name, 0.5):
                return last
            to = last.route_to
            if to and not rerouted and to in self.tiers and to not in done:
                rerouted = True
                todo = [to, *[t for t in todo if t != to]]
        return last


def spark_tiers(spark, nodes: DataFrame, index: TextIndex, vectors: DataFrame, embed: Callable[[str], list[float]]) -> dict[str, Tier]:
    """The exact, router and hybrid tiers over DataFrames, and the stub that ends the cascade."""

    def table(query: str, vector: bool = False) -> DataFrame:
        row = (0, query, embed(query)) if vector else (0, query)
        return spark.createDataFrame([row], "qid int, query string" + (", vector array<double>" if vector else ""))

    def exact_tier(query: str) -> Result:
        rows = exact(nodes, index, table(query)).orderBy(F.desc("score"), "id").limit(25).collect()
        return Result("exact", max((r["relevance"] for r in rows), default=0.0), [(r["id"], r["score"]) for r in rows])

    def router_tier(query: str) -> Result:
        r = routed(table(query)).first()
        if r["intent"] == "lookup":
            spans = [e["span"] for e in r["entities"]]
            got = exact_tier(" ".join(spans))
            return Result("router", got.relevance, got.hits, None if got.hits else "hybrid")
        return Result("router", 0.0, [], r["route_to"], extras={"intent": r["intent"]})

    def hybrid_tier(query: str) -> Result:
        rows = hybrid(index, vectors, table(query, True)).orderBy("rank").collect()
        return Result("hybrid", rows[0]["score"] if rows else 0.0, [(r["id"], r["score"]) for r in rows])

    return {"exact": exact_tier, "router": router_tier, "hybrid": hybrid_tier, "stub": stub}
