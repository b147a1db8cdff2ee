"""The kept vector index, and exact search in blocks, against brute force."""

import numpy as np
import pytest

from factloom.operators import search, vector_store
from factloom.operators.store import Store
from factloom.operators.vector_store import VectorStore

SCHEMA = "id string, vector array<double>"


def brute(rows, queries, k, digits=6):
    out = set()
    for qid, q in queries:
        scored = []
        for i, v in rows:
            if v is None or len(v) != len(q) or not all(x is not None and np.isfinite(x) for x in v) or not any(v):
                continue
            s = sum(a * b for a, b in zip(v, q)) / (np.sqrt(sum(a * a for a in v)) * np.sqrt(sum(a * a for a in q)))
            scored.append((-np.floor(s * 10**digits + 0.5) / 10**digits, i))
        out |= {(qid, i, -s) for s, i in sorted(scored)[:k]}
    return out


def clustered(n=600, d=6, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, d)) * 3
    v = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.4
    v[: n // 3] = v[0]  # a third are equal
    return [(f"v{k:04}", x.round(3).tolist()) for k, x in enumerate(v)]


def found(df):
    return {(r.qid, r.id, r.score) for r in df.collect()}


def test_ties_are_cut_at_k_and_zero_vectors_have_no_score(spark):
    rows = [(f"v{k:04}", [1.0, 2.0]) for k in range(5000)] + [("zero", [0.0, 0.0]), ("near", [1.0, 2.1])]
    asked = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [2.0, 4.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = search.vector_search(df, spark.createDataFrame(asked, "qid int, vector array<double>"), 3, digits=6)
    assert found(got) == {(q, f"v{k:04}", 1.0) for q in (1, 3) for k in range(3)}
    run = search.block_best(3, 6)
    import pyarrow as pa

    block = pa.table({"side": [0] * 500 + [1] * 2000, "key": [f"{k:04}" for k in range(2500)], "vector": [[1.0, 2.0]] * 2500})
    assert run(block).num_rows == 3 * 500  # not one for each pair
    got = search.vector_search(df, spark.createDataFrame([(4, [1.0, 2.05])], "qid int, vector array<double>"), 2, digits=6)
    assert found(got) == brute(rows[:3] + rows[-2:], [(4, [1.0, 2.05])], 2)


def test_index_is_exact_where_asked_and_finds_most_else(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_store, "BLOCK_ROWS", 64)
    rows = clustered()
    odd = [("x1", None), ("x2", [0.0] * 6), ("x3", [float("nan")] + [1.0] * 5), ("x4", [None] + [1.0] * 5)]
    index = VectorStore(Store(spark, str(tmp_path)))
    df = spark.createDataFrame(rows + odd, SCHEMA)
    assert index.train(df) == 25
    index.add(spark.createDataFrame([(i, v[::-1] if i.endswith("7") else v) for i, v in rows[:400]] + odd, SCHEMA))
    index.add(spark.createDataFrame(rows[400:] + [x for x in rows[:400] if x[0].endswith("7")], SCHEMA))  # some replaced
    assert index.store.read("vec_lists").join(index.store.read("vec_stale"), ["id", "v"], "left_anti").count() == len(rows)  # every row is filed
    asked = [(k, rows[k][1]) for k in range(0, 600, 20)]
    q = spark.createDataFrame(asked + [(-1, [0.0] * 6), (-2, None), (-3, [1.0])], "qid int, vector array<double>")
    want = brute(rows, asked, 10)
    assert found(index.search(q, 10, exact=True, probes=1, digits=6).drop("rank")) == want
    few = found(index.search(q, 10, digits=6).drop("rank"))
    assert len({x[:2] for x in few} & {x[:2] for x in want}) >= 0.9 * len(want)
    with pytest.raises(Exception, match="another length"):
        index.add(spark.createDataFrame([("y", [1.0])], SCHEMA))
    with pytest.raises(ValueError):
        index.train(df)


def test_probes_are_as_few_as_clusters_allow():
    rng = np.random.default_rng(3)
    tight = np.repeat(rng.normal(size=(40, 16)), 50, axis=0) + rng.normal(size=(2000, 16)) * 0.05
    spread = rng.normal(size=(2000, 16))
    few, many = (vector_store.probes_for(x, vector_store.centroids(x, 40)) for x in (tight, spread))
    assert few <= 3 < many
