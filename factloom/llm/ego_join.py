"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c). Vectors are projected on their
leading principal dimensions (fitted on a bounded sample; that steers cost, not results), their
grid cells of width eps are put in lexicographic order, and the order is cut into intervals. Two
intervals are joined only if their cells come within one cell of each other on every leading
dimension; a joined pair is halved recursively, dropping halves that are provably distant, until
the leaves are small enough to compare as a matrix product in double precision.

Equal vectors of a label are one vertex with a count from the start, so a very common vector
costs one row. A pair of intervals gives per vector its number of links and one edge to the
least vertex it reaches there, never the pairs themselves.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
vectors without a label, link with nothing, as do vectors of different lengths; n_links counts
rows, copies included; a row with a null id links with nothing, its component is null and it is
kept; rows that repeat an id are one vertex of the components; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._graph import components
from factloom.session import cut, ship

BLOCK = 4096
LEAF = 256
LEADING = 6
SAMPLE = 20_000


def usable(vector: Column) -> Column:
    """Whether a vector has finite components only and is not zero."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def principal(vectors: DataFrame, leading: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each length of vectors a (length x leading) matrix of principal directions."""
    n = vectors.count()
    if not n:
        return {}
    million = 1_000_000
    some = vectors.where(F.pmod(F.xxhash64(F.lit(5), "v"), F.lit(million)) < min(million, -(-million * sample // n))).select("e").toArrow().column("e").to_pylist()
    out = {}
    by: dict[int, list] = {}
    for e in some:
        by.setdefault(len(e), []).append(e)
    for d, rows in by.items():
        x = _unit(np.array(rows))
        x -= x.mean(0)
        _, directions = np.linalg.eigh(x.T @ x)
        out[d] = directions[:, ::-1][:, : min(leading, d)]
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The components of all vectors of a list column without nulls, and the vectors' n+1 offsets."""
    off = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[off[0] : off[-1]], off - off[0]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision at length 1; scaled first, as squares of large ones overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(x: np.ndarray, directions: np.ndarray | None, eps: float, leading: int) -> np.ndarray:
    c = np.zeros((len(x), leading), dtype=np.int32)
    p = x @ directions if directions is not None else x[:, :leading]
    c[:, : p.shape[1]] = np.floor(p / eps)
    return c


def _distant(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no row of `a` can be within eps of one of `b`: their cells are two apart somewhere."""
    return bool(((a.min(0) > b.max(0) + 1) | (b.min(0) > a.max(0) + 1)).any())


def joined(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, least: float, same: bool, leaf: int = LEAF):
    """Index pairs (i of x, j of y) with cosine >= least; with `same`, i < j of one sequence."""
    found_i, found_j = [], []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or (same and d <= a) or _distant(cx[a:b], cy[c:d]):
            continue
        if b - a <= leaf and d - c <= leaf:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= least)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
            continue
        xs = [(a, b)] if b - a <= leaf else [(a, (a + b) // 2), ((a + b) // 2, b)]
        ys = [(c, d)] if d - c <= leaf else [(c, (c + d) // 2), ((c + d) // 2, d)]
        todo += [(*p, *q) for p in xs for q in ys if not (same and q[1] <= p[0])]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_i or none), np.concatenate(found_j or none)


def _least_reached(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each vertex the least id it reaches over the links (i, j)."""
    r = v.copy()
    while True:
        m = np.minimum(r[i], r[j])
        before = r.copy()
        np.minimum.at(r, i, m)
        np.minimum.at(r, j, m)
        if (before == r).all():
            return r


def linked(rows: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    spark = rows.sparkSession
    ship(spark)
    eps = math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9) + 1e-12
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e"), F.col(label).alias("l"))
    can = F.col("id").isNotNull() & F.col("l").isNotNull() & usable(F.col("e"))
    classes = cut(own.where(can).groupBy("l", "e").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")))
    axes = spark.sparkContext.broadcast(principal(classes, LEADING))
    cells = ", ".join(f"c{k} int" for k in range(LEADING))

    def place(batches):
        for batch in batches:
            values, off = _flat(batch.column(batch.schema.get_field_index("e")))
            lengths = np.diff(off)
            c = np.zeros((len(lengths), LEADING), dtype=np.int32)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                x = _unit(values[off[at][:, None] + np.arange(d)])
                c[at] = _cells(x, axes.value.get(int(d)), eps, LEADING)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), *[pa.array(c[:, k]) for k in range(LEADING)]], names=[*batch.schema.names, "d", *[f"c{k}" for k in range(LEADING)]])

    kind = classes.schema["l"].dataType.simpleString()
    order = ["l", "d", *[f"c{k}" for k in range(LEADING)], "v"]
    e_kind = classes.schema["e"].dataType.simpleString()
    placed = classes.mapInArrow(place, f"l {kind}, e {e_kind}, v long, n long, d int, {cells}").withColumn("part", F.lit(0))
    count = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), placed.sparkSession.sparkContext.defaultParallelism * 8))
    placed = placed.drop("part").repartitionByRange(count, *order).sortWithinPartitions(*order)

    def intervals(batches):
        held: list[pa.Table] = []

        def out(t: pa.Table) -> pa.RecordBatch:
            values, off = _flat(t.column("e").combine_chunks())
            c = np.stack([t.column(f"c{k}").to_numpy() for k in range(LEADING)], 1).astype(np.int32)
            v, n = (np.ascontiguousarray(t.column(x).to_numpy().astype(np.int64)) for x in ("v", "n"))
            row = {"block": int(v[0]), "l": t.column("l")[0].as_py(), "d": int(off[1]), "lo": c.min(0).tolist(), "hi": c.max(0).tolist(), "v": v.tobytes(), "n": n.tobytes(), "c": c.tobytes(), "x": values.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=kind_of)

        def closed(t: pa.Table, last: bool):
            """Full intervals of the rows, and what is left over."""
            while t.num_rows:
                one = np.ones(t.num_rows, dtype=bool)
                for x in ("l", "d"):
                    one &= pc.equal(t.column(x), t.column(x)[0]).to_numpy(zero_copy_only=False)
                size = min(block, int(np.argmin(one)) if not one.all() else t.num_rows)
                if size == t.num_rows and size < block and not last:
                    return t
                yield out(t.slice(0, size))
                t = t.slice(size)
            return t

        for batch in batches:
            t = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            held = [(yield from closed(t, False))]
        if held:
            yield from closed(held[0], True)

    from pyspark.sql.pandas.types import to_arrow_type

    component = to_arrow_type(classes.schema["e"].dataType.elementType).to_pandas_dtype()
    kind_of = pa.schema([("block", pa.int64()), ("l", to_arrow_type(classes.schema["l"].dataType)), ("d", pa.int32()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("v", pa.binary()), ("n", pa.binary()), ("c", pa.binary()), ("x", pa.binary())])
    blocks = cut(placed.mapInArrow(intervals, f"block long, l {kind}, d int, lo array<int>, hi array<int>, v binary, n binary, c binary, x binary"))

    # which intervals come within one cell of each other: by the leading cell, then all of them
    box = blocks.select("block", "l", "d", "lo", "hi")
    a = box.select(F.col("block").alias("a"), "l", "d", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(F.col("lo")[0] - 1, F.col("hi")[0] + 1)).alias("cell"))
    b = box.select(F.col("block").alias("b"), "l", "d", F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0])).alias("cell"))
    near = F.col("a") <= F.col("b")
    for k in range(LEADING):
        near = near & (F.col("alo")[k] <= F.col("bhi")[k] + 1) & (F.col("blo")[k] <= F.col("ahi")[k] + 1)
    near = near & (F.col("cell") == F.greatest(F.col("alo")[0] - 1, F.col("blo")[0]))  # each pair once
    pairs = a.join(b, ["l", "d", "cell"]).where(near).select("a", "b")
    load = lambda s: blocks.select(F.col("block").alias(s), *[F.col(x).alias(s + x) for x in ("d", "v", "n", "c", "x")])
    work = pairs.join(load("a"), "a").join(load("b").drop("bd"), "b").repartition(count, "a", "b")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                d = r["ad"]
                va, vb = np.frombuffer(r["av"], np.int64), np.frombuffer(r["bv"], np.int64)
                na, nb = np.frombuffer(r["an"], np.int64), np.frombuffer(r["bn"], np.int64)
                ca, cb = np.frombuffer(r["ac"], np.int32).reshape(-1, LEADING), np.frombuffer(r["bc"], np.int32).reshape(-1, LEADING)
                xa, xb = (_unit(np.frombuffer(r[x], component).reshape(-1, d)) for x in ("ax", "bx"))
                same = r["a"] == r["b"]
                i_, j_ = joined(xa, ca, xb, cb, least, same)
                if not len(i_):
                    continue
                if same:
                    v, n, links = va, na, np.zeros(len(va), np.int64)
                else:
                    v, n, links = np.concatenate([va, vb]), np.concatenate([na, nb]), np.zeros(len(va) + len(vb), np.int64)
                    j_ = j_ + len(va)
                np.add.at(links, i_, n[j_])
                np.add.at(links, j_, n[i_])
                got = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(v[got]), pa.array(links[got]), pa.array(_least_reached(v, i_, j_)[got])], names=["v", "links", "least"])

    found = cut(work.mapInArrow(compare, "v long, links long, least long"))
    comp = components(found.select(F.col("v").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    c = classes.select(F.col("l").alias("cl"), F.col("e").alias("ce"), "v", "n").join(links, "v", "left").join(comp, "v", "left")
    out = own.join(c, can & (F.col("l") == F.col("cl")) & (F.col("e") == F.col("ce")), "left")
    out = out.select(F.col("id").alias(key), F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "v", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
