"""A quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

Every word has a sparse random index vector, two signed ones for its hash and two for its shape (case,
length, the signs it ends in). The context vector of a word is the sum of the index vectors of its
neighbours (two on each side, never across documents), over all documents; words share BUCKETS rows of
that table by their hash, so it has a fixed size. Sums are of integers: they don't depend on the order
of tasks. A document is the mean, the spread and the mean product of adjacent context vectors, weighted
against frequent words, and the mean of its words' own index vectors. A network of two layers is fitted
with numpy to the pooled vectors of at most `sample_rows` labelled documents, a fifth of which are kept
back to set the temperature of its probabilities.

Texts are read whole, in slices of a few MB; a null text is an empty one, which has a score as well (its
length is 0 words). Rows that repeat, or whose key is null, are scored each; a label for a key that
several rows have holds for all of them; of several labels of one key their mean is learned. Null labels are none. Without
labels every score is 0.5, with labels of one kind it is their mean. Empty tables give no rows. Columns
named like those made are replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._text import _BYTE, _SPACE, _Tables, give_back, mix, pieces, small_batches, utf8
from factloom.session import cut, ship

DIMENSIONS = 32
BUCKETS = 1 << 15
WINDOW = 2
#: Buckets in a row of partial sums, and in how many ways the tasks' rows of one block are dealt before they meet.
BLOCK, WAYS = 256, 64
SMOOTH = 1e-3
SAMPLE_ROWS = 20_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 600, 1024, 0.01, 2e-3
PIECE = 1 << 20
_SIGNS = np.array([1, -1], dtype=np.int16)
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 another sign (itself), 1 lower, 2 upper, 3 digit
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_KEY = np.where(_CLASS == 0, np.arange(256) + 4, _CLASS).astype(np.uint64)
_POWERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in order a hash (with case) and a hash of the shape, and the rows' offsets."""
    data, off = utf8(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = off[:-1][np.diff(off) > 0]
    first[starts] = ~space[starts]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    last = ~space
    last[:-1] &= space[1:]
    ends = off[1:][np.diff(off) > 0] - 1
    last[ends] = ~space[ends]
    end = np.flatnonzero(last)
    up, down = _Tables.of(len(data))
    kind = _CLASS[data]
    with np.errstate(over="ignore"):
        h = mix(np.add.reduceat(np.where(space, np.uint64(0), _BYTE[data]) * up[: len(data)], begin) * down[begin])
        upper = np.add.reduceat((kind == 2).astype(np.int32), begin)
        lower = np.add.reduceat((kind == 1).astype(np.int32), begin)
        size = np.minimum(np.log2(end - begin + 1).astype(np.uint64), np.uint64(6))
        case = (np.minimum(upper, 2) * 2 + (lower > 0)).astype(np.uint64)
        one, two = _KEY[data[end]], np.where(end > begin, _KEY[data[np.maximum(end - 1, 0)]], np.uint64(0))
        shape = mix(((size * np.uint64(8) + case) * np.uint64(512) + one) * np.uint64(512) + two + np.uint64(1))
    return h, shape, np.searchsorted(begin, off).astype(np.int64)


def _index(h: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs (4 of each) of the words' index vectors."""
    d = np.empty((4, len(h)), np.int64)
    s = np.empty((4, len(h)), np.int16)
    for k, x in enumerate((h, h >> np.uint64(20), shape, shape >> np.uint64(20))):
        d[k] = (x >> np.uint64(1)) % np.uint64(DIMENSIONS)
        s[k] = _SIGNS[(x & np.uint64(1)).astype(np.int64)]
    return d, s


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(45)).astype(np.int64) % BUCKETS


def add_contexts(column: pa.Array, sums: np.ndarray) -> None:
    """Adds the texts' words to `sums`: by bucket, the neighbours' index vectors and, last, the count."""
    h, shape, off = words(column)
    if not len(h):
        return
    d, s = _index(h, shape)
    # index vectors in a row, with zeros between documents
    at = np.arange(len(h)) + np.repeat(np.arange(len(off) - 1), np.diff(off)) * WINDOW + WINDOW
    own = np.zeros((int(at[-1]) + WINDOW + 1, DIMENSIONS), np.int16)
    for r in range(4):
        own[at, d[r]] += s[r]
    near = np.zeros_like(own)
    for k in range(1, WINDOW + 1):
        near[k:] += own[:-k]
        near[:-k] += own[k:]
    b = _bucket(h)
    order = np.argsort(b, kind="stable")
    start = np.concatenate([[0], np.flatnonzero(np.diff(b[order])) + 1])
    met = b[order[start]]
    sums[met, :DIMENSIONS] += np.add.reduceat(near[at[order]], start, axis=0, dtype=np.int32)
    sums[met, DIMENSIONS] += np.diff(np.append(start, len(b)))


@dataclass(frozen=True)
class Vectors:
    table: np.ndarray  # buckets x dimensions, float32
    weight: np.ndarray  # by bucket, float32


def vectors(sums: np.ndarray) -> Vectors:
    """Unit context vectors without their common part, and weights that fall with a word's share."""
    count = sums[:, -1].astype(np.float64)
    c = sums[:, :-1] / np.maximum(count, 1)[:, None]
    total = max(count.sum(), 1.0)
    c -= (sums[:, :-1].sum(0) / total)[None] * (count > 0)[:, None]
    norm = np.sqrt((c * c).sum(1))
    c /= np.where(norm > 0, norm, 1)[:, None]
    return Vectors(c.astype(np.float32), (SMOOTH / (SMOOTH + count / total)).astype(np.float32))


FEATURES = 4 * DIMENSIONS + 3


def pooled(column: pa.Array, model: Vectors) -> np.ndarray:
    """A row of FEATURES for each text."""
    h, shape, off = words(column)
    n = np.diff(off)
    out = np.zeros((len(n), FEATURES), np.float64)
    out[:, -1] = np.log1p(n)
    has = np.flatnonzero(n)
    if not len(has):
        return out
    start = off[:-1][has]
    b = _bucket(h)
    w = model.weight[b]
    v = model.table[b]
    total = np.maximum(np.add.reduceat(w, start), 1e-12)[:, None]
    weighted = v * w[:, None]
    mean = np.add.reduceat(weighted, start, axis=0) / total
    spread = np.sqrt(np.maximum(np.add.reduceat(weighted * v, start, axis=0) / total, 0))
    # the last word of a text is followed by none
    v[:-1] *= v[1:]
    v[off[1:][has] - 1] = 0
    pairs = np.add.reduceat(v, start, axis=0) / np.maximum(n[has] - 1, 1)[:, None]
    d, s = _index(h, shape)
    row = np.repeat(np.arange(len(has)), n[has]) * DIMENSIONS
    own = np.bincount((row[None] + d).reshape(-1), weights=s.reshape(-1), minlength=len(has) * DIMENSIONS).reshape(-1, DIMENSIONS) / n[has][:, None]
    out[has, : 4 * DIMENSIONS] = np.concatenate([mean, spread, pairs, own], axis=1)
    out[has, -3] = np.sqrt((mean * mean).sum(1))
    out[has, -2] = pairs.sum(1)
    return out


@dataclass(frozen=True)
class Network:
    """Standardised inputs, a tanh layer and a logistic output over a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(np.clip((x - self.centre) / self.scale, -6, 6) @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).mean())


def fit_network(x: np.ndarray, y: np.ndarray, order: np.ndarray, seed: int = 17) -> Network:
    """Adam on random batches, with weight decay; every fifth row by `order` is kept back, and the
    temperature is the one with the least loss on those."""
    kept = np.zeros(len(y), bool)
    kept[np.argsort(order, kind="stable")[::5]] = True
    if not len(y) or y.min() == y.max() or y[~kept].min(initial=1) == y[~kept].max(initial=0):
        z = np.zeros(0)
        return Network(z, z, (), 1.0, float(y.mean()) if len(y) else 0.5)
    fx, fy = x[~kept], y[~kept]
    centre, scale = fx.mean(0), fx.std(0)
    scale = np.where(scale > 1e-9, scale, 1)
    u = np.clip((fx - centre) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(fy.mean() / (1 - fy.mean())))]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, STEPS + 1):
        some = rng.permutation(len(u))[:BATCH]
        w = u[some]
        t = np.tanh(w @ layers[0] + layers[1])
        g = (1 / (1 + np.exp(-np.clip(t @ layers[2] + layers[3], -40, 40))) - fy[some]) / len(some)
        back = np.outer(g, layers[2]) * (1 - t * t)
        grads = [w.T @ back + DECAY * layers[0], back.sum(0), t.T @ g + DECAY * layers[2], g.sum()]
        for k, d in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            layers[k] = layers[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    made = Network(centre, scale, tuple(layers), 1.0)
    z = made.logits(x[kept])
    # probabilities may become softer or sharper, within a factor that few kept rows can support
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    return Network(centre, scale, tuple(layers), float(grid[np.argmin([_loss(z / t, y[kept]) for t in grid])]))


def contexts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The summed contexts of all words of `docs`: BUCKETS rows of DIMENSIONS sums and a count."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def count(batches):
        sums = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                add_contexts(part.column(0), sums)
        if sums[:, -1].any():
            yield from _blocks({k: sums[k * BLOCK : (k + 1) * BLOCK] for k in range(BUCKETS // BLOCK)})
        give_back()

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(x.as_buffer(), np.int64).reshape(BLOCK, -1)
                held[k] = held[k] + x if k in held else x.copy()
        yield from _blocks(held)

    schema = "block int, sums binary"
    partial = docs.select(F.col(text).alias("text")).mapInArrow(count, schema)
    # in two steps, each of which streams and holds one sum for each block: BUCKETS is fixed
    some = partial.withColumn("way", F.spark_partition_id() % WAYS).repartition("block", "way").drop("way").mapInArrow(add, schema)
    out = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64)
    for r in some.repartition("block").mapInArrow(add, schema).collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, np.int64).reshape(BLOCK, -1)
    return out


def _blocks(sums: dict[int, np.ndarray]):
    for k, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "sums"])


@dataclass(frozen=True)
class Model:
    vectors: Vectors
    network: Network


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Context vectors from all of `docs`; the network from the documents that `labels` (key, 0 or
    1) mark, at most `sample_rows` of them, the first by a hash of their key and text."""
    spark = docs.sparkSession
    made = vectors(contexts(docs, text))
    shared = spark.sparkContext.broadcast(made)
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    marks = cut(marks.orderBy(F.xxhash64("k"), "k").limit(sample_rows))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(marks), "k")  # sample_rows at most
    rows = rows.select(F.xxhash64("k", "text").alias("order"), "y", "text")

    def pool(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                x = pooled(part.column(2), shared.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["order", "y", "x"])
        give_back()

    found = rows.mapInArrow(pool, "order long, y double, x binary").orderBy("order", "y", "x").limit(sample_rows).collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in found], np.float64).reshape(len(found), FEATURES)
    return Model(made, fit_network(x, np.array([r.y for r in found]), np.array([r.order for r in found])))


def scored(docs: DataFrame, model: Model, text: str = "text", least: float = 0.7) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from a score of `least` on)."""
    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text, PIECE):
                s = shared.value.network.scores(pooled(part.column(text), shared.value.vectors))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= least).astype(np.int32))], names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)
