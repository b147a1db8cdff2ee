"""Registered corpus queries against plain versions that leave nothing out."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline as C  # noqa: E402
from factloom.llm import katz, langid, queries, url_filter  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_katz_uses_bigrams_seen_once(spark, tmp_path):
    base = [f"w{i % 7} x{i % 5} y{i % 3} only{i} rare{i} w{i % 4}" for i in range(40)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    first = next(t for i, t in enumerate(base) if not held(i))
    texts = [first if held(i) else t for i, t in enumerate(base)]  # held-out texts repeat a training text
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.op9_katz_scores(spark, str(tmp_path)).collect()}
    one, two, starts, seen = Counter(), Counter(), 0, defaultdict(dict)
    for i, t in enumerate(texts):
        if not held(i):
            w = [*t.split(), "</s>"]
            one.update(w)
            two.update(zip(["<s>", *w], w))
            starts += 1
    n = sum(one.values())
    d1, d2 = (katz.discounts(Counter(c.values())) for c in (one, two))
    cut = lambda c, d: c * d[c] if c <= katz.LARGE else c
    for (a, b), c in two.items():
        seen[a][b] = c
    unigram = lambda w: cut(one[w], d1) / n if one[w] else 1 - sum(cut(c, d1) for c in one.values()) / n

    def p(a, w):
        total, kept = starts if a == "<s>" else one[a], sum(cut(c, d2) for c in seen[a].values())
        total += total - kept < 1e-9
        if w in seen[a]:
            return cut(seen[a][w], d2) / total
        return (1 - kept / total) / (1 - sum(map(unigram, seen[a]))) * unigram(w) if seen[a] else unigram(w)

    assert sum(map(held, range(40))) > 2 and sum(c == 1 for c in two.values()) > len(two) / 2
    for i, t in enumerate(texts):
        w = [*t.split(), "</s>"]
        assert abs(got[i] - sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w))) < 1e-6


def test_url_prefixes_end_anywhere(spark):
    urls = ["http://example.com/ads/x.js", "http://EXAMPLE.com/adserver?q", "http://example.com/ads", "http://example.com/Ads", "http://example.com/", "http://example.community/x", "http://example.com.evil.net/ads", "http://other.net/a/b/c", None, "nonsense"]
    patterns = ["example.com/ads", "EXAMPLE.com/ad", "Example.COM/ads/", "example.com/ads/x.js", "example.com", "other.net/a/b/c/d", "other.net/", "other.net/A"]
    p = spark.createDataFrame([(i, u, "2024-02-01") for i, u in enumerate(urls)], "page_id long, url string, at string")
    e = spark.createDataFrame([(x, "prefix", "add", "2024-01-01") for x in patterns], "pattern string, kind string, action string, at string")

    def blocking(u):
        if u is None or "://" not in u:
            return []
        host, _, rest = u.split("://")[1].partition("/")
        whole = host.lower() + "/" + rest.split("?")[0]
        folded = [x.partition("/")[0].lower() + "".join(x.partition("/")[1:]) for x in patterns]
        return sorted("prefix:" + x for x in set(folded) if whole.startswith(x))

    got = {r["page_id"]: r for r in url_filter.filtered(p, e, "page_id", "url", "at").collect()}
    for i, u in enumerate(urls):
        want = blocking(u)
        assert (got[i]["n_matches"], got[i]["matched"]) == (len(want), want[0] if want else None), u
    assert got[0]["n_matches"] == 5 and got[1]["n_matches"] == 3


def test_pipeline_keeps_mixed_and_short_texts(spark):
    words = {"en": "the of and house water green", "de": "der und nicht große über straße", "fr": "le les être garçon où même", "pl": "się jest że dzień być może"}
    data = [(i, " ".join(w.split() * 8), lang, "s", 0) for i, (lang, w) in enumerate([*words.items()] * 6)]
    mixed = " ".join(" ".join(words[k].split() * 20) for k in ("en", "de", "fr"))
    data += [(100, mixed, "en", "s", 0), (101, "house", None, "s", 0), (102, "123 !!!", None, "s", 0), (103, None, None, "s", 0), (104, "қазақ тілі", None, "s", 0)]
    docs = spark.createDataFrame(data, SCHEMA)
    assert langid.identified(docs.where("doc_id = 100"), langid.fit(docs)).first()["score"] < 0.5
    assert {r["doc_id"] for r in C.language(spark, docs, "").collect()} == {*range(24), 100, 101}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert C.language(spark, unlabelled, "").count() == len(data)


def test_every_language_is_learned(spark, monkeypatch):
    words = {f"l{k}": " ".join(f"{a}{b}{a}" for b in ("um", "or", "ist", "en")) for k, a in enumerate(("qu", "zy", "ph", "kw", "gh"))}
    docs = spark.createDataFrame([(i, " ".join([w] * 5), lang, "s", 0) for i, (lang, w) in enumerate([*words.items()] * 5)], SCHEMA)
    whole = langid.fit(docs)
    for name in ("MAX_LANGUAGES", "BLOCK_LANGUAGES"):
        monkeypatch.setattr(langid, name, 2, raising=False)
    model = langid.fit(docs)
    assert model.languages == whole.languages == sorted(words)
    assert abs(model.scores - whole.scores).max() < 1e-5 and (model.allowed == whole.allowed).all()
    assert all(r["lang_pred"] == r["lang"] for r in langid.identified(docs, model).collect())
