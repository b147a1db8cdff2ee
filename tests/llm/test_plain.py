"""Fingerprints and the mix, recomputed from their definitions without Spark."""

import math
import random
import re
import struct
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
xxhash = pytest.importorskip("xxhash")

from pyspark.sql import functions as F  # noqa: E402

from factloom.llm import mixing, simhash  # noqa: E402

TEXTS = [
    None, "", " \n", "one", "two words", "the river stone the river stone", "é über naïve 日本語 café", "a" * 700 + " b", "Word, word; WORD\tword\x0bword\x1fx", "x y " * 9000,
    *[" ".join(random.Random(k).choice("the of and river stone light under away morning".split()) for _ in range(k * 3)) for k in range(1, 40)],
]


def hashed(*parts, seed=42):
    """Spark's xxhash64: one part's hash seeds the next; ints and longs by their bytes."""
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64(p if isinstance(p, bytes) else p.encode(), seed=seed).intdigest()
    return seed


def fingerprint(text):
    words = re.split(r"[\x20\x09-\x0D]+", (text or "").strip(" \t\n\x0b\f\r"))
    votes, total = [0] * 128, 0
    for a, b in zip(words, [*words[1:], None]):
        w = 1 + (len(a.encode()) > 3) + (b is not None and len(b.encode()) > 3)
        h = hashed(a, b)
        low = hashed(struct.pack("<Q", h), struct.pack("<i", 7))
        total += w
        for k in range(64):
            votes[k] += w * (h >> k & 1)
            votes[64 + k] += w * (low >> k & 1)
    bits = sum((2 * v > total) << k for k, v in enumerate(votes))
    return f"{bits & (1 << 64) - 1:016X}{bits >> 64:016X}"


def test_fingerprints_are_weighted_votes(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.edited(df, ranges=3).collect()}
    for k, t in enumerate(TEXTS):
        t, after = t or "", TEXTS[(k + 1) % len(TEXTS)] or ""
        half = len(t) // 2
        assert got[k].fingerprint == fingerprint(t)
        assert got[k].edited_fingerprint == fingerprint(t[: len(t) - half] + after[:half])


@pytest.mark.parametrize("weighted", [False, True])
def test_mix_is_a_sorted_prefix(spark, weighted):
    rng = random.Random(8)
    odd = [0.0, -1.0, float("nan"), float("inf"), None]
    rows = []
    for k in range(400):
        t = rng.choice(TEXTS[1:9] + TEXTS[10:]) if k % 17 else None
        rows.append((k, t, rng.choice(["a", "b", "b", "b", None, "é"]), rng.choice([0.5, 2.0, 8.0, *odd])))
    rows += [(None, "a few words here", "b", 1.0), (7, "repeated id", "a", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    out = mixing.mixed(df, [5, 2, 1], weight=F.col("q") if weighted else None).select("doc_id", "size", "source", "target", "taken").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    seed = hashed(struct.pack("<i", 17))
    target = {r.source: r.target for r in out}
    by = defaultdict(list)
    for i, t, s, q in rows:
        w = q if weighted else None if t is None else 1 / (1 + abs(len(t) / max(size(t), 1) - 6) / 6)
        w = w if w is not None and math.isfinite(w) and w > 0 else 1.0
        u = ((hashed(None if i is None else str(i), seed=seed) >> 11) + 0.5) / (1 << 53)
        by[s].append((-math.log(u) / w, -1 if i is None else i, size(t)))
    want = []
    for s, docs in by.items():
        whole = sum(n for *_, n in docs)
        epochs = int(target[s] // whole)
        rest, upto, most = target[s] - epochs * whole, 0, -1.0
        for k, _, n in sorted(docs):
            upto += n
            if upto - n / 2 <= rest:
                most = k
        want += [(s or "", i, n, n * (epochs + (k <= most))) for k, i, n in docs]
    assert sorted((r.source or "", -1 if r.doc_id is None else r.doc_id, r.size, r.taken) for r in out) == sorted(want)
