"""Very long and uniform texts, each against a plain result and in seconds."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers as P  # noqa: E402
from factloom.llm import bpe, suffix, trie_tokens  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
UNIFORM = [" " * 5_000_000 + "x", "\n" * 2_000_000 + "ab", "a" * 2_000_000, "ab" * 1_000_000, "7" * 2_000_000, "x'" + "s" * 2_000_000, "! " * 1_000_000, "!" * 1_000_000 + "a"]


def test_bpe_spans_against_the_library():
    e, rng = bpe.encoding(PATH, P.PATTERN), random.Random(1)
    atoms = ["a", "b", "é", "中", "1", "٣", " ", "\n", "\t", " ", "'", "!", "?", "'s", "'ll", "'re", "s", "l", " a", "  "]
    for _ in range(20_000):
        sub = rng.sample(atoms, rng.randint(1, 5))
        text = "".join(rng.choice(sub) * rng.choice([1, 1, 1, 2, 5, 9]) for _ in range(rng.randint(1, 30)))
        got = []
        for part, single in bpe.spans(text, rng.choice([2, 3, 5, 8, 13])):
            got += e._core_bpe.encode_single_piece(part.encode()) if single else e.encode_ordinary(part)
        assert got == e.encode_ordinary(text), text


@pytest.mark.parametrize("text", UNIFORM, ids=lambda t: repr(t[-2:]))
def test_bpe_of_uniform_texts(text):
    ids = bpe.encode(text, PATH, P.PATTERN)
    assert bpe.decode(ids, PATH, P.PATTERN) == text.encode()
    if text.strip() == text:  # what the library itself can take
        assert ids == bpe.encoding(PATH, P.PATTERN).encode_ordinary(text)


def test_bpe_of_long_white_space(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000 + "x"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.digests(df, PATH, P.PATTERN).collect()}
    assert got[1]["decoded_sha256"] == hashlib.sha256(b" " * 1_000_000 + b"x").hexdigest() and got[2]["n_tokens"] == 0


def test_token_counts_of_a_long_pre_token():
    v = trie_tokens.vocabulary(PATH)
    rng = random.Random(2)
    for t in (b"a" * 3000, b"ab" * 2000, bytes(rng.choice(b"etaoins") for _ in range(3000))):
        n, s, _ = trie_tokens.counted([t], v)
        got = trie_tokens.counted_alone(t, v)
        assert got[0] == n[0] and abs(got[1] - s[0]) < 1e-6


def test_squeezed_segments_keep_their_windows():
    rng = random.Random(3)
    for _ in range(100):
        b = b"".join(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) * rng.randint(1, 60) + bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5)))
        c, steps = suffix.squeezed(b, 50, 27)
        place = suffix.unsqueezed(np.arange(len(c)), steps)
        assert len(place) == len(b) and all(c[place[i] : place[i] + 50] == b[i : i + 50] for i in range(len(b) - 49))


def test_suffix_dedup_of_uniform_texts(spark):
    rng = random.Random(5)
    noise = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = ["a" * 2_000_000, "ab" * 300_000 + noise, noise[:100] + "a" * 1_000_000 + noise[200:], "ba" * 500_000, noise]
    got = {r["doc_id"]: r for r in suffix.repeats_removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen = set()
    for i, t in enumerate(texts):
        b = t.encode()
        windows = {b[k : k + 50] for k in range(len(b) - 49)}
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k] += 1
                gone[k + 50] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        seen |= windows
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (int(gone.sum()), spans, kept)


def test_packs_of_a_task_are_sent_together(spark, monkeypatch):
    """each pack sent a row to nearly every shard, so rows grew with packs times shards."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(20)) + rng.choice(passages) + " ".join(rng.choice(words) for _ in range(9)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    key = lambda: sorted(map(tuple, suffix.repeats_removed(docs).collect()))
    want = key()
    assert sum(r[2] for r in want) > 40 * 80
    monkeypatch.setattr(suffix, "PACK_BYTES", 600)
    rows = [(i, suffix._zipped(t.encode()), len(t), suffix._pressed(np.arange(len(t), dtype=np.uint32))) for i, t in enumerate(texts)]
    made = suffix.packed(spark.createDataFrame(rows, "id long, text binary, size long, runs binary").coalesce(1), 5, 50, 24)
    assert made.where("kind = 2").count() == 5
    assert key() == want
    monkeypatch.setattr(suffix, "SENT_BYTES", 4000)
    assert key() == want
