"""The quality classifier: sums and pooling against plain loops, held-out accuracy, odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from factloom.llm import quality  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["The cat sat on the mat.", None, "", " \n\t", "cat cat cat cat", "É über x ### $$$ a1", "x" * 5000 + " y", "The cat sat on the mat.", "one"]


def index(h, shape):
    v = np.zeros(quality.DIMENSIONS, int)
    d, s = quality._index(h, shape)
    np.add.at(v, d[:, 0], s[:, 0])
    return v


def plain(texts):
    """By text its words as (bucket, index vector)."""
    out = []
    for t in texts:
        found = []
        for w in WORD.findall(t or ""):
            h, shape, _ = quality.words(pa.array([w]))
            found.append((int(quality._bucket(h)[0]), index(h, shape)))
        out.append(found)
    return out


def plain_sums(texts):
    sums = np.zeros((quality.BUCKETS, quality.DIMENSIONS + 1), np.int64)
    for row in plain(texts):
        for i, (b, _) in enumerate(row):
            sums[b, -1] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(row), i + quality.WINDOW + 1)):
                if j != i:
                    sums[b, :-1] += row[j][1]
    return sums


def test_contexts_equal_a_plain_count(spark):
    sums = np.zeros((quality.BUCKETS, quality.DIMENSIONS + 1), np.int64)
    quality.add_contexts(pa.array(TEXTS), sums)
    assert (sums == plain_sums(TEXTS)).all()
    got = quality.contexts(spark.createDataFrame([(t, "x") for t in TEXTS], "text string, sums string").repartition(5))
    assert (got == sums).all()


def test_pooling_equals_a_plain_loop():
    made = quality.vectors(plain_sums(TEXTS))
    got = quality.pooled(pa.array(TEXTS), made)
    d = quality.DIMENSIONS
    for x, row in zip(got, plain(TEXTS)):
        assert x[-1] == pytest.approx(np.log1p(len(row)))
        if not row:
            assert not x[:-1].any()
            continue
        v = np.array([made.table[b] for b, _ in row], float)
        w = np.array([made.weight[b] for b, _ in row], float)[:, None]
        want = [(v * w).sum(0) / w.sum(), np.sqrt((v * v * w).sum(0) / w.sum()), (v[:-1] * v[1:]).sum(0) / max(len(row) - 1, 1), np.mean([i for _, i in row], axis=0)]
        assert np.allclose(x[: 4 * d], np.concatenate(want), atol=1e-5)


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice("the of and river stone light under away morning".split()) + rng.choice(["", "ing", "s"]) for _ in range(rng.randrange(8, 60))]
        good = k % 4 != 0
        if not good:
            words = [w + rng.choice(["***", "###"]) for w in words] if k % 8 else [w for w in words[:3] for _ in range(9)]
        rows.append((k, " ".join(words)))
        labels.append((k, int(good)))
    return rows, labels


def test_held_out_accuracy_and_reruns(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(k, t, 1.0, "s") for k, t in rows], "doc_id long, text string, score double, source string")
    seen = spark.createDataFrame([x for x in labels if x[0] % 5] + [(None, 0), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scored(docs, quality.fit(docs, seen)).collect()}
    again = {r.doc_id: r for r in quality.scored(docs, quality.fit(docs.repartition(7), seen)).collect()}
    assert got == again
    held = [(k, y) for k, y in labels if k % 5 == 0]
    assert np.mean([got[k].predicted == y for k, y in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.source == "s" for r in got.values())


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    order = rng.permutation(400)
    net = quality.fit_network(x, y, order)
    kept = np.argsort(order)[::5]
    z = net.logits(x[kept])
    assert all(quality._loss(z / net.temperature, y[kept]) <= quality._loss(z / t, y[kept]) + 1e-3 for t in np.linspace(0.3, 8, 50))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b c"), (2, " "), (3, "z " * 30_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.scored(docs, quality.fit(docs, none)).collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.scored(docs, quality.fit(docs, one)).collect()] == [1.0] * 5
    both = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, quality.fit(docs, both)).collect())
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), both)).collect() == []
