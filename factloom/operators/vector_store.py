"""A kept vector index: inverted lists around learned centroids, added to part by part.

Centroids are learned by spherical k-means from at most SAMPLE_ROWS vectors, the first by a hash of
their ids; every vector is then filed in the list of its nearest centroid. A query is compared with the
vectors of the lists nearest to it, all of them whole, so scores are exact and only a list may be
missed. How many lists are probed is measured when the centroids are learned: as many as find RECALL of
the ten nearest in that sample, in which they are farther apart than among all vectors (few where
vectors have clusters, half of all lists where they are spread evenly). With `exact` it is first compared with its nearest lists, which gives its k-th score, and then
with every other list that could hold a better one: none beyond its list's greatest angle from the
centroid can. Only probed lists are shuffled, in blocks, so that a list of a third of all vectors is
many tasks.

Vectors that are null or zero, or hold a null or an element that is no finite number, are not filed and
are no hits; those of another length than the centroids are refused. An id added again replaces its old
vector; of equal ids in one call the last by vector is taken.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.search import BLOCK_ROWS, WHOLE, block_best, ranked
from factloom.operators.store import Store
from factloom.session import cut, ship

#: Vectors that a task holds with their lists at a time: a query is repeated for each of its lists.
HELD = 1 << 15
SAMPLE_ROWS, ROUNDS, SEED = 20_000, 12, 5
#: What probed lists find of the ten nearest, and how many of the sample's vectors measure it.
RECALL, MEASURED = 0.93, 500
#: Lists, at most, so that centroids of any index fit into every task.
LISTS = 4096
_FILED = "list int, id string, vector array<double>, angle double"


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(1)), 1e-300)[:, None]


def centroids(sample: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Spherical k-means: unit rows; lists that stay empty take the sample's worst placed vectors."""
    x = _unit(sample.astype(np.float64))
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:n]]
    for _ in range(ROUNDS):
        s = x @ c.T
        at = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.bincount(at, minlength=len(c))
        far = np.argsort(s[np.arange(len(x)), at], kind="stable")[: int((size == 0).sum())]
        sums[size == 0] = x[far]
        c = _unit(sums)
    return c


def probes_for(sample: np.ndarray, c: np.ndarray, least: float = RECALL, k: int = 10) -> int:
    """The least number of nearest lists that hold, on average, a share `least` of the k nearest."""
    x = _unit(sample.astype(np.float64))
    asked = x[:: max(1, len(x) // MEASURED)]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    rank = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)
    at = (x @ c.T).argmax(1)
    place = rank[np.arange(len(asked))[:, None], at[near]].reshape(-1)
    return int(np.sort(place)[math.ceil(least * len(place)) - 1]) + 1


def _arrays(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy().reshape(len(col), -1)


def _slices(batches, lists: int):
    """Batches cut so that each vector may go to every list."""
    rows = max(1, HELD // lists)
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


class VectorStore:
    def __init__(self, store: Store):
        self.store = store

    def train(self, vectors: DataFrame, lists: int | None = None) -> int:
        """Learn the centroids from `vectors` (id, vector): about the square root of their number, or
        `lists`. Gives how many. The index has to be empty."""
        if self.store.has("vec_lists"):
            raise ValueError("the index holds vectors already")
        good = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where(WHOLE)
        n = good.count()
        if not n:
            raise ValueError("nothing to learn from")
        sample = np.array([r["vector"] for r in good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()])
        c = centroids(sample, min(lists or math.ceil(math.sqrt(n)), LISTS, len(sample)))
        probes = probes_for(sample, c)
        rows = [(k, x.tolist(), probes) for k, x in enumerate(c)]
        self.store.write(vec_centroids=self.store.spark.createDataFrame(rows, "list int, centroid array<double>, probes int"))
        return len(rows)

    def _centroids(self) -> np.ndarray:
        rows = self.store.read("vec_centroids").collect()  # LISTS at most
        return np.array([r["centroid"] for r in sorted(rows, key=lambda r: r["list"])])

    def add(self, vectors: DataFrame) -> None:
        """File vectors (id, vector) as one part."""
        spark = self.store.spark
        ship(spark)
        c = spark.sparkContext.broadcast(self._centroids())
        size = F.when(F.size("vector") == c.value.shape[1], F.col("vector")).otherwise(F.raise_error(F.lit("a vector of another length than the index's")).cast("array<double>"))
        rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where(WHOLE).groupBy("id").agg(F.max("vector").alias("vector")).select("id", size.alias("vector"))

        def file(batches):
            for batch in batches:
                v = _unit(_arrays(batch, "vector"))
                zero = ~(v * v).any(1)
                for a in range(0, len(v), 4096):
                    s = v[a : a + 4096] @ c.value.T
                    at = s.argmax(1)
                    part = batch.slice(a, 4096)
                    angle = np.arccos(np.clip(s[np.arange(len(at)), at], -1, 1))
                    out = pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), part.column(0), part.column(1), pa.array(angle)], names=["list", "id", "vector", "angle"])
                    yield out.filter(pa.array(~zero[a : a + 4096]))

        filed = cut(rows.mapInArrow(file, _FILED).withColumn("v", F.lit(uuid.uuid4().hex[:16])))
        old = self.store.read("vec_ids").join(filed.select("id"), "id", "left_semi") if self.store.has("vec_ids") else filed.limit(0)
        stats = filed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle"))
        self.store.add(vec_lists=filed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list"), vec_ids=filed.select("id", "v"), vec_stale=old.select("id", "v"), vec_stats=stats)

    def _found(self, asked: DataFrame, k: int, digits: int | None) -> DataFrame:
        """The k best of queries (key, vector, list) in the lists that are named with them."""
        asked = cut(asked)
        spark = self.store.spark
        stats = self.store.read("vec_stats").groupBy("list").agg(F.sum("n").alias("n"))
        many = asked.groupBy("list").agg(F.count("*").alias("m"))
        size = stats.join(many, "list").select("list", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("bs"), F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("qs")).collect()  # LISTS at most
        dealt = F.broadcast(spark.createDataFrame(size or [], "list int, bs int, qs int"))
        # lists that are not probed are not read further
        v = self.store.read("vec_lists").join(dealt, "list").join(self.store.read("vec_stale"), ["id", "v"], "left_anti")
        block = F.pmod(F.xxhash64("key"), F.col("bs")).cast("int")
        q = asked.join(dealt, "list")
        qblock = F.pmod(F.xxhash64("key"), F.col("qs")).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        v = v.select(F.lit(1).alias("side"), F.col("id").alias("key"), "vector", "list", "bs", "qs").select("side", "key", "vector", "list", block.alias("b"), every("qs").alias("a"))
        q = q.select(F.lit(0).alias("side"), "key", "vector", "list", "bs", qblock.alias("a")).select("side", "key", "vector", "list", "a", every("bs").alias("b"))
        return ranked(q.unionByName(v).groupBy("list", "a", "b").applyInArrow(block_best(k, digits), "qid string, id string, score double"), k)

    def _probes(self, q: DataFrame, n: int) -> DataFrame:
        """Queries (key, vector) with each of their n nearest lists."""
        c = self.store.spark.sparkContext.broadcast(self._centroids())

        def probe(batches):
            for batch in _slices(batches, max(len(c.value), 1)):
                s = _unit(_arrays(batch, "vector")) @ c.value.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :n]
                at = np.repeat(np.arange(len(s)), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(near.reshape(-1).astype(np.int32))], names=["key", "vector", "list"])

        return q.mapInArrow(probe, "key string, vector array<double>, list int")

    def _open(self, q: DataFrame, least: DataFrame, n: int, slack: float) -> DataFrame:
        """Queries with the lists beyond their n nearest that could hold a score of `least`."""
        spread = {r["list"]: r["angle"] for r in self.store.read("vec_stats").groupBy("list").agg(F.max("angle").alias("angle")).collect()}
        c = self._centroids()
        shared = self.store.spark.sparkContext.broadcast((c, np.array([spread.get(k, -4.0) for k in range(len(c))])))

        def probe(batches):
            centre, angle = shared.value
            for batch in _slices(batches, max(len(centre), 1)):
                s = _unit(_arrays(batch, "vector")) @ centre.T
                rank = np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1)
                best = np.cos(np.maximum(np.arccos(np.clip(s, -1, 1)) - angle - 1e-9, 0))
                at, lists = np.nonzero((rank >= n) & (best >= batch.column(2).to_numpy()[:, None] - slack) & (angle >= 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(lists.astype(np.int32))], names=["key", "vector", "list"])

        floor = q.join(least, "key", "left").select("key", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
        return floor.mapInArrow(probe, "key string, vector array<double>, list int")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, digits: int | None = None) -> DataFrame:
        """(qid, id, score, rank) of the k nearest of queries (qid, vector), by cosine (rounded to
        `digits`, if given) and then id. `probes`: lists of each query, else as many as were measured."""
        probes = probes or self.store.read("vec_centroids").first()["probes"]
        q = queries.select(F.col("qid").cast("string").alias("key"), F.col("vector").cast("array<double>").alias("vector")).where(WHOLE)
        q = cut(q.where((F.size("vector") == self._centroids().shape[1]) & F.exists("vector", lambda x: x != 0)))
        found = self._found(self._probes(q, probes), k, digits)
        if exact:
            found = cut(found.drop("rank"))
            last = found.groupBy(F.col("qid").alias("key")).agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
            more = self._found(self._open(q, last, probes, 1e-9 + (0.0 if digits is None else 10.0**-digits)), k, digits)
            found = ranked(found.unionByName(more.drop("rank")), k)
        return found.withColumn("qid", F.col("qid").cast(queries.schema["qid"].dataType))
