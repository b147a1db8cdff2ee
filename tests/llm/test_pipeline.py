"""The pipeline's stages one by one against plain versions, on a small corpus."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as C  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random

    rng = random.Random(4)
    w = [f"{a}{b}" for a in ("the", "of", "and", "ing", "ess", "or") for b in ("", "ly", "er", "ed", "an", "is")]
    text = lambda n: " ".join(rng.choice(w) + rng.choice("abcdefgh") * rng.randrange(2) for _ in range(n))
    rows = [text(rng.randrange(60, 120)) for _ in range(40)]
    passage = text(60)
    rows += [f"{text(80)} {passage} {text(80)}" for _ in range(3)]
    near = rows[2].split()
    near[5] = "changed"
    rows += [rows[0], rows[1], " ".join(near), "", None, "123 456", "!!!"]
    data = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(data, SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    return str(d), data, passage


def test_stages(spark, corpus):
    d, data, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "source_mix", "byte_bpe"]
    text = {i: t for i, t, *_ in data}
    a = C.language(spark, docs, d).cache()
    assert a.columns == docs.columns
    assert {r["doc_id"] for r in a.collect()} == set(range(46))  # what has no letter goes
    b = C.near_duplicates(spark, a, d).cache()
    assert b.columns == docs.columns and {r["doc_id"] for r in b.collect()} == set(range(43))
    c = C.repeated_passages(spark, b, d).cache()
    assert c.columns == docs.columns
    left = {r["doc_id"]: r for r in c.collect()}
    assert all(left[i]["text"] == text[i] for i in range(41))
    assert all(passage[5:-5] not in left[i]["text"] and left[i]["n_chars"] == len(left[i]["text"]) for i in (41, 42))
    m = C.mixture(spark, c, d).cache()
    assert m.columns == docs.columns and {r["doc_id"] for r in m.collect()} <= set(left)
    t = C.tokens(spark, m, d).collect()
    assert len(t) == m.count() and all(r["exact"] and r["n_tokens"] == len(r["token_ids"]) for r in t)
    whole = C.run(spark, d).collect()
    assert sorted(r["doc_id"] for r in whole) == sorted(r["doc_id"] for r in t)


def test_odd_rows(spark, corpus, tmp_path):
    """Nulls in every column, repeated rows, no rows, very long texts and names of the operators' own."""
    d, data, _ = corpus
    base = spark.read.parquet(f"{d}/documents.parquet")
    rows = [tuple(r) for r in base.collect()]
    rows += [(3, rows[3][1], None, None, None), (None, rows[4][1], "en", None, 5), (None, None, None, None, None), (60, "the ofly " * 40_000, None, "src0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("lang_pred", "score", "spans", "id", "_id", "_kept", "k", "_row", "gone", "token_ids", "exact", "_n"):
        docs = docs.withColumn(c, docs["n_chars"].cast("string"))
    for k, stage in enumerate(f for _, f in C.STAGES):
        nothing = stage(spark, docs.limit(0), d)
        assert nothing.count() == 0
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
            got = out.collect()
            assert got and all(r["n_chars"] is None or k >= 2 or r["score"] == str(r["n_chars"]) for r in got)
            docs = out
        else:
            assert out.where("exact").count() == docs.count() == out.count()
        if k == 0:
            filled = {r["doc_id"]: r["lang"] for r in got}
            assert filled[60] == "en" and None not in filled.values()
            assert sum(r["doc_id"] == 3 for r in got) == 2 and all(r["text"] for r in got)
        if k == 1:
            assert sum(r["doc_id"] == 3 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
