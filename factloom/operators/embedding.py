"""Vectors of texts, made once: only what has no vector of its present text is embedded."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import hash_embedding
from factloom.operators.store import Store
from factloom.registry import check_type
from factloom.session import cut, discard, ship

#: Texts given to an embedder at once, and bytes of them after which fewer are.
BATCH, BATCH_BYTES = 64, 1 << 20


class Embedder(Protocol):
    """A picklable model: its name (with its version) and size, and vectors of texts in their order."""

    name: str
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in for a model."""

    def __init__(self, size: int = 384):
        self.name, self.size = f"hash-{size}", size

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [hash_embedding(t, self.size) for t in texts]


def checked(model: Embedder, texts: list[str]) -> np.ndarray:
    """The model's vectors at length 1; ValueError unless they are as many and as long as they should
    be, finite and not zero."""
    v = np.asarray(model.embed(texts), dtype=np.float64)
    if v.shape != (len(texts), model.size):
        raise ValueError(f"{model.name}: {len(texts)} texts gave an array of {v.shape}, not vectors of {model.size}")
    n = np.sqrt((v * v).sum(1))
    if not np.isfinite(v).all() or not n.all():
        raise ValueError(f"{model.name}: a vector is zero or not finite")
    return v / n[:, None]


def _batches(ids: list, texts: list[str], hashes: list[str]):
    """Parts of a batch: BATCH texts at most, and about BATCH_BYTES."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and (k - start == BATCH or size + len(t) > BATCH_BYTES):
            yield ids[start:k], texts[start:k], hashes[start:k]
            start, size = k, 0
        size += len(t)
    if texts:
        yield ids[start:], texts[start:], hashes[start:]


def missing(store: Store, nodes: DataFrame, model: str, types: list[str] | None = None) -> DataFrame:
    """The nodes (id, text, content_hash) of (id, type, text) that have no vector of this model and
    text. Null texts have none. `types`: only those."""
    if types is not None:
        nodes = nodes.where(F.col("type").isin([check_type(t) for t in types]))
    want = nodes.where("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text")).withColumn("content_hash", F.sha2("text", 256))
    if not store.has("vectors"):
        return want
    held = store.read("vectors").where(F.col("model") == model).select("id", "content_hash")
    return want.join(held, ["id", "content_hash"], "left_anti")


def embed_missing(store: Store, nodes: DataFrame, model: Embedder, types: list[str] | None = None, limit: int | None = None, run: str | None = None) -> int:
    """Embed what is missing, the first `limit` by id if given, as one part of the store's `vectors`
    (id, model, content_hash, vector, run); gives how many. Nothing is written if nothing is missing."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    spark = nodes.sparkSession
    ship(spark)
    want = missing(store, nodes, model.name, types)
    want = cut(want if limit is None else want.orderBy("id").limit(limit))
    n = want.count()
    shared = spark.sparkContext.broadcast(model)

    def run_(batches):
        for batch in batches:
            for ids, texts, hashes in _batches(*(batch.column(i).to_pylist() for i in range(3))):
                v = checked(shared.value, texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "content_hash", "vector"])

    if n:
        made = want.select("id", "text", "content_hash").mapInArrow(run_, "id string, content_hash string, vector array<double>")
        store.add(vectors=made.select("id", F.lit(model.name).alias("model"), "content_hash", "vector", F.lit(run).alias("run")))
    discard(want)
    return n
