"""The operators against brute force on small tables that hold the odd cases: nulls, empty and long
texts, ties, repeated rows, empty tables, and extra columns whose names clash."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from factloom.llm import _graph, _sais, bpe, ego_join, katz, langid, minhash, mixing, simhash, suffix, trie_tokens, url_filter  # noqa: E402
from factloom.llm._text import shingles, word_hashes  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = {"en": "the of and to in that it with for was on are by this".split(), "de": "der die und das ist nicht mit von zu den für auf größe über".split()}
    out = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        out.append((lang, " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", "ing", "ung", "s"]) for _ in range(rng.randrange(1, 60)))))
    passage = " ".join(rng.choice(vocabulary["en"]) for _ in range(40))
    for i in range(6):
        out.append(("en", f"start {i} {passage} end {i * 7}"))
    near = [rng.choice(vocabulary["en"]) + str(rng.randrange(50)) for _ in range(80)]
    for i in range(5):
        copy = list(near)
        copy[i * 10] = f"edit{i}"
        out.append(("en", " ".join(copy)))
    out += [("en", out[0][1])] * 3  # exact copies
    out += [("en", None), ("en", ""), (None, "   \n\t "), ("de", "12345 !!! 67"), ("en", "Word"), ("en", "a" * 300), ("en", "日本語のテキスト " * 20), ("de", "x y " * 3000), ("en", "  é" * 9)]
    return [(i, t, lang, f"src{i % 4}" if i % 9 else None, len(t or "")) for i, (lang, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # extra columns whose names clash with the operators' own
    return spark.createDataFrame(texts, SCHEMA).repartition(3).withColumns({"id": F.lit(1), "v": F.lit("x"), "size": F.lit(2), "k": F.lit(3), "held": F.lit(4), "spans": F.lit(5), "h1": F.lit(6), "e": F.lit(7)}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_word_hashes_respect_rows_and_slices(monkeypatch):
    from factloom.llm import _text

    texts = ["Ab cd", None, "", "  x ", "AB", "cd" * 40 + " y", "é É"]
    whole = word_hashes(pa.array(texts))
    monkeypatch.setattr(_text, "SLICE_BYTES", 7)
    cut = word_hashes(pa.array(texts))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert np.diff(whole[1]).tolist() == [len(words(t)) for t in texts]
    assert whole[0][0] == whole[0][whole[1][4]]  # ab and AB
    assert len(shingles(*whole, 2)[0]) == sum(len(set(zip(w, w[1:]))) if len(w) > 1 else len(w) for w in map(words, texts))


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5)] + [(100, i) for i in range(101, 150)], "a long, b long")
    got = {r["v"]: r["component"] for r in _graph.components(e).collect()}
    assert got[3] == 1 and got[9] == 6 and got[149] == 100 and 5 not in got
    assert _graph.components(e.limit(0)).count() == 0


# ---- 1 ------------------------------------------------------------------------------------


def test_language_id(docs, texts, empty):
    held = langid.held_out(F.col("doc_id"), 5, 0)
    model = langid.fit(docs.where(~held))
    got = by_id(langid.identified(docs, model))
    for i, t, lang, _, _ in texts:
        assert 0 <= got[i]["score"] <= 1
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        elif lang and i < 60 and len(words(t)) > 6:
            assert got[i]["lang_pred"] == lang
    assert langid.identified(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identified(docs, nothing).collect()} == {"und"}


def test_language_spans(spark, docs):
    model = langid.fit(docs)
    en, de = " ".join(["the with that this"] * 12), " ".join(["nicht größe über auf"] * 9)
    got = spans = langid.identified(spark.createDataFrame([(1, f"{en} {de}")], "doc_id long, text string"), model).first()
    spans = [(s["lang"], s["start"], s["end"]) for s in got["spans"]]
    assert got["lang_pred"] == "en" and [s[0] for s in spans] == ["en", "de"] and abs(spans[0][2] - 48) <= 2 and spans[1][2] == 84


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(20):
        s = [np.log(rng.dirichlet(np.ones(3), n)) for n in (1, 4, 6)]
        for x, path in zip(s, langid.viterbi(s, 1.5)):
            value = lambda p: sum(x[i, c] for i, c in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            best = max(value(p) for p in np.ndindex(*[3] * len(x)))
            assert abs(value(path.tolist()) - best) < 1e-9


@pytest.mark.parametrize("text", ["3 × 4 = 12", "÷", "［＿］", "｛｜｝", "²³ ½", "£ € ¥", "１２３", "· — …"])
def test_no_letter_no_language(docs, text):
    model = langid.fit(docs)
    got = langid.label(pa.array([text, f"{text} nicht größe"]), model)
    assert got[0] == ("und", 0.0, []) and got[1][0] == "de"


def plain_grams(text):
    """(word, features) of a text: hashed 3- and 4-grams around each byte of a word."""
    b = b"  " + re.sub(rb"[\x09-\x0D]", b" ", text.translate(LOWER).encode()) + b"   "
    out, word = [], None
    for i in range(1, len(b) - 3):
        if b[i] == 32:
            word = None
            continue
        if word is None:
            word = []
            out.append((b[i : b.index(32, i)], word))
        three = b[i - 1] | b[i] << 8 | b[i + 1] << 16
        four = three | b[i + 2] << 24
        word += [(three * 2654435761 & 0xFFFFFFFF) >> 16, ((four ^ four >> 15) * 2246822519 & 0xFFFFFFFF) >> 16]
    return out


def test_predictions_against_a_plain_version(spark, docs, texts):
    """Texts of Latin letters: counts, posteriors by word and the best path, all recomputed."""
    rows = [(t, lang) for _, t, lang, _, _ in texts if t and lang]
    langs = sorted({lang for _, lang in rows})
    counts = {k: Counter(f for t, lang in rows if lang == k for _, w in plain_grams(t) for f in w) for k in langs}
    log = lambda k, f: math.log((counts[k][f] + 0.5) / (sum(counts[k].values()) + 0.5 * langid.FEATURES))
    model = langid.fit(docs)
    assert model.languages == langs
    asked = [t for t, _ in rows if len(t) < 400 and t.isascii() and re.search("[a-zA-Z]", t)] + ["the größe", "with the that das ist nicht auf große on are by"]
    for text, (lang, score, spans) in zip(asked, langid.label(pa.array(asked), model)):
        s = []
        for w, feats in plain_grams(text):
            x = np.array([sum(log(k, f) for f in feats) for k in langs])
            x = np.maximum(x - x.max() - math.log(np.exp(x - x.max()).sum()), langid.FLOOR)
            s.append(x if any(65 <= c < 123 or c > 127 for c in w) else 0 * x)
        best, back = s[0], []
        for x in s[1:]:
            step = best[None] - langid.PENALTY * (1 - np.eye(len(langs)))
            back.append(step.argmax(1))
            best = step.max(1) + x
        path = [int(best.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        path = path[::-1]
        if len(set(path)) == 1:
            total = sum(s)
            assert (lang, score) == (langs[path[0]], pytest.approx(np.exp(total.max() - total.max()) / np.exp(total - total.max()).sum(), abs=1e-3))
        assert [langs[p] for p in path] == [x for x, a, z in spans for _ in range(a, z)]


# ---- 2 ------------------------------------------------------------------------------------


def test_simhash(docs, texts, empty):
    got = by_id(simhash.edited(docs, ranges=5))
    assert len(got) == len(texts)
    prints = defaultdict(set)
    for k, (i, t, *_) in enumerate(texts):
        t, after = t or "", texts[(k + 1) % len(texts)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[t].add(r["fingerprint"])
        prints[edited].add(r["edited_fingerprint"])
        a, b = int(r["fingerprint"], 16), int(r["edited_fingerprint"], 16)
        assert r["near_edited"] == 1 - (a ^ b).bit_count() / 128
        assert r["near_next"] == 1 - (a ^ int(got[texts[(k + 1) % len(texts)][0]]["fingerprint"], 16)).bit_count() / 128
    assert all(len(x) == 1 for x in prints.values())
    assert simhash.edited(empty).count() == 0
    one = simhash.edited(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_simhash_null_and_repeated_ids(spark):
    d = spark.createDataFrame([(None, "a b c"), (1, "d e"), (1, "d f"), (2, None)], "doc_id long, text string")
    assert simhash.edited(d).count() == 4


def test_simhash_search_against_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(30)]
    every = base + [b ^ sum(1 << rng.randrange(128) for _ in range(k % 6)) for k, b in enumerate(base)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = sorted({(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in every})
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "f1 long, f2 long, n long")
    for radius, count in ((3, 5), (2, 4)):
        got = {(r["q1"], r["q2"], r["f1"], r["f2"]) for r in simhash.near_search(df, df, radius, count).collect()}
        bits = lambda p, q: sum((x ^ y & (1 << 64) - 1 if False else ((x ^ y) & (1 << 64) - 1)).bit_count() for x, y in zip(p, q))
        assert got == {(*p, *q) for p in rows for q in rows if 0 < bits(p, q) <= radius}


# ---- 3 ------------------------------------------------------------------------------------


def test_bpe(docs, texts, empty, monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.digests(docs, path, P.PATTERN))
    for i, t, *_ in texts:
        ids = e.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(docs, path, P.PATTERN), path, P.PATTERN).select("text", "decoded").collect()
    assert all(r["decoded"] == (r["text"] or "").encode() for r in back)
    assert bpe.digests(empty, path, P.PATTERN).count() == 0
    monkeypatch.setattr(bpe, "PART_CHARS", 5)
    hard = "don't stop   <|endoftext|> x1y2 'll we'll\n\n\n  end. 日本語 á " * 9
    assert bpe.encode(hard, path, P.PATTERN) == e.encode_ordinary(hard)
    assert "".join(bpe.safe_parts(hard, 5)) == hard and len(list(bpe.safe_parts(hard, 5))) > 20


# ---- 4 ------------------------------------------------------------------------------------


def test_suffix_array_against_sorting(monkeypatch):
    rng = np.random.default_rng(1)
    for alphabet in (2048, 4):
        monkeypatch.setattr(_sais, "ALPHABET", alphabet)
        for _ in range(150):
            t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)), 0)
            sa = _sais.suffix_array(t, int(t.max()) + 1).tolist()
            b = t.tolist()
            assert sa == sorted(range(len(b)), key=lambda i: b[i:])
            common = _sais.permuted_common_prefixes(t, np.array(sa))
            for x, y in zip(sa, sa[1:]):
                k = 0
                while max(x, y) + k < len(b) and b[x + k] == b[y + k]:
                    k += 1
                assert common[y] == k


def removed(rows, width=50):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - width + 1):
            if first.setdefault(b[j : j + width], i) < i:
                gone[j : j + width] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum())), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, texts, empty):
    got = by_id(suffix.repeats_removed(docs))
    want = removed([(i, t) for i, t, *_ in texts])
    assert sum(w[1] for w in want.values()) > 1000
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    assert suffix.repeats_removed(empty).count() == 0
    left = by_id(suffix.without_repeats(docs.select("doc_id", "text"), width=50))
    for i, t, *_ in texts:
        if want[i][1] == 0:
            assert left[i]["text"] == t
        elif i in left:
            assert len(left[i]["text"].encode()) >= want[i][0] - want[i][1]
        else:
            assert want[i][1] == want[i][0]


def test_suffix_dedup_odd_ids(spark):
    long = "this is a passage of well over fifty bytes that several rows share, word for word"
    d = spark.createDataFrame([(5, long), (5, long + "!"), (None, long), (7, "x" + long)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix.repeats_removed(d).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (7, len(long))]


# ---- 5 ------------------------------------------------------------------------------------


def test_trie_counts_against_viterbi(docs, texts, empty):
    import regex

    path = P.path("byte_bpe_50k.tiktoken")
    v = trie_tokens.vocabulary(path)

    def best(token: bytes):
        s, n = [0.0], [0]
        for k in range(1, len(token) + 1):
            top = min((-(s[j] + v.scores[token[j:k]]), n[j] + 1) for j in range(max(0, k - v.longest), k) if token[j:k] in v.scores)
            s.append(-top[0])
            n.append(top[1])
        return n[-1], s[-1]

    got = by_id(trie_tokens.tokens_counted(docs, path, P.PATTERN))
    for i, t, *_ in texts:
        want = [best(x.encode()) for x in regex.findall(P.PATTERN, t or "")]
        assert got[i]["n_tokens"] == sum(n for n, _ in want) and abs(got[i]["token_score"] - sum(s for _, s in want)) < 1e-6
    assert trie_tokens.tokens_counted(empty, path, P.PATTERN).count() == 0
    tokens = sorted({b"there", b"the", b"then", b"these", b"a"})
    assert trie_tokens.counted(tokens, v)[2] == len({t[:k] for t in tokens for k in range(1, len(t) + 1)})


# ---- 6 ------------------------------------------------------------------------------------


def test_embedding_join(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(140):
        x = rng.normal(size=16)
        if i % 3 and rows and rows[-1][1] is not None:
            x = np.array(rows[-1][1]) + rng.normal(size=16) * 0.04
        rows.append((i, x.tolist(), i % 2))
    rows += [(200, rows[3][1], rows[3][2]), (201, rows[3][1], rows[3][2]), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] + [1.0] * 15, 1), (205, rows[3][1], None), (206, [], 1), (207, [1.0, None], 1), (208, [1.0] * 4, 1)]
    rows += [(None, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).repartition(3)
    got = by_id(ego_join.linked(df, block=16), "vec_id")
    own = {i: (np.array(e, np.float32).astype(float), lab) for i, e, lab in rows if i is not None and lab is not None and e and None not in e and np.isfinite(e).all() and any(e)}
    near = {i: {j for j, (y, m) in own.items() if j != i and m == lab and len(y) == len(x) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98} for i, (x, lab) in own.items()}
    for i, *_ in rows:
        if i is None:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        r = got[i]
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(near.get(i, ())), min(seen), min(seen) == i)
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None and got[None]["kept"]
    assert sum(map(len, near.values())) > 60
    assert ego_join.linked(df.limit(0)).count() == 0


# ---- 7 ------------------------------------------------------------------------------------


def test_url_filter(spark, monkeypatch):
    pages = [(1, "http://a.example.com:80/x/y?q", "2024-01-05"), (2, "https://user@B.example.com/", "2024-01-05"), (3, "http://example.com/x/z", "2024-02-05"), (4, None, "2024-01-05"), (5, "nonsense", "2024-01-05"), (6, "http://notexample.com/", "2024-01-05"), (7, "http://example.com/x", None), (1, "http://a.example.com/x/y", "2024-01-01")]
    entries = [("example.com", "host", "add", "2024-01-02"), ("example.com", "host", "remove", "2024-02-01"), ("example.com/x/", "prefix", "add", "2024-02-05"), (None, "host", "add", "2024-01-01"), ("notexample.com", "host", "add", None), ("b.example.com", "host", "add", "2024-01-05"), ("b.example.com", "host", "remove", "2024-01-05")]
    p = spark.createDataFrame(pages, "page_id long, url string, at string").withColumn("row", F.lit(1))
    e = spark.createDataFrame(entries, "pattern string, kind string, action string, at string")
    want = sorted([(1, 1), (1, 0), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0), (7, 0)])
    for small in (100_000, 0):
        monkeypatch.setattr(url_filter, "SMALL", small)
        got = url_filter.filtered(p, e, "page_id", "url", "at").collect()
        assert sorted((r["page_id"], r["n_matches"]) for r in got) == want
        assert all(r["blocked"] == (r["n_matches"] > 0) for r in got)
    assert url_filter.filtered(p.limit(0), e, "page_id", "url", "at").count() == 0
    assert not any(r["blocked"] for r in url_filter.filtered(p, e.limit(0), "page_id", "url", "at").collect())


# ---- 8 ------------------------------------------------------------------------------------


def test_mixing(docs, texts, empty):
    got = by_id(mixing.mixed(docs, [5, 2, 1]))
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in texts}
    per = Counter()
    for i, _, _, s, _ in texts:
        per[s] += size[i]
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(per.values()), set(per), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * per[s]}
        for s in full or open_:
            target[s] = 2.0 * per[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    took = Counter()
    for i, _, _, s, _ in texts:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[i], per[s]) and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] in (0, size[i], 2 * size[i])
        took[s] += r["taken"]
    longest = max(size.values())
    assert all(abs(took[s] - target[s]) <= longest for s in per)
    again = by_id(mixing.mixed(docs.repartition(5), [5, 2, 1]))
    assert all(again[i]["taken"] == got[i]["taken"] for i in got)
    rows = Counter(r["doc_id"] for r in mixing.mixture(docs, [5, 2, 1]).select("doc_id").collect())
    assert all(rows[i] * size[i] == got[i]["taken"] for i in got if size[i])
    assert mixing.mixed(empty, [5, 2, 1]).count() == 0 and mixing.mixture(empty, [5, 2, 1]).count() == 0


# ---- 9 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(docs, texts, empty, order):
    got = by_id(katz.scored(docs, langid.held_out(F.col("doc_id"), 7, 2), order=order))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in texts}
    tokens = {i: [*words(t), "</s>"] for i, t, *_ in texts}
    grams = [Counter() for _ in range(order + 1)]
    starts = sum(not h for h in held.values())
    padded = lambda t: ["<s>"] * (order - 1) + t
    for i, t in tokens.items():
        if not held[i]:
            for j in range(len(t)):
                for k in range(1, order + 1):
                    grams[k][tuple(padded(t)[j + order - k : j + order])] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    d = [None] + [katz.discounts(Counter(g.values())) for g in grams[1:]]
    cut = lambda c, k: c * d[k][c] if c <= katz.LARGE else c
    unknown = (n - sum(cut(c, 1) for c in grams[1].values())) / n
    context = lambda c: starts if set(c) == {"<s>"} else grams[len(c)][c]
    seen = [defaultdict(list) for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            if c >= 2:
                seen[k][g[:-1]].append((g[-1], c))

    def p(c, w):
        if not c:
            return cut(grams[1][(w,)], 1) / n if (w,) in grams[1] else unknown
        k = len(c) + 1
        kept = sum(cut(x, k) for _, x in seen[k][c])
        total = context(c) + (context(c) - kept < 1e-9)
        got = dict(seen[k][c])
        if w in got:
            return cut(got[w], k) / total
        if not got:
            return p(c[1:], w)
        return (1 - kept / total) / (1 - sum(p(c[1:], x) for x in got)) * p(c[1:], w)

    for i, t in tokens.items():
        if len(t) > 400:
            continue
        r = got[i]
        s = sum(math.log10(p(tuple(padded(t)[j : j + order - 1]), w)) for j, w in enumerate(t))
        base = sum(math.log10((grams[1][(w,)] + 1) / (n + v + 1)) for w in t)
        assert abs(r["score"] - s) < 1e-6 * max(1, abs(s)) and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum((w,) in grams[1] for w in t), n)
    for c in [("<s>",) * (order - 1), ("the",) * (order - 1)]:
        if not c or context(c):
            assert abs(sum(p(c, w) for (w,) in grams[1]) + p(c, "never seen") - 1) < 1e-9
    assert katz.scored(empty, F.lit(False), order=order).count() == 0


# ---- 10 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(docs, texts, empty, width):
    got = by_id(minhash.grouped(docs, width=width))
    sets = {}
    for i, t, *_ in texts:
        w = words(t)
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    near = {i: {j for j, b in sets.items() if a and b and 100 * len(a & b) >= 80 * len(a | b)} for i, a in sets.items()}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), min(seen), min(seen) == i)
    assert minhash.grouped(empty).count() == 0
    kept = {r["doc_id"] for r in minhash.deduplicated(docs, width=width).collect()}
    assert kept == {i for i in got if got[i]["kept"]}


def test_minhash_null_and_repeated_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "q r s t u v"), (6, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.grouped(d).collect()), key=str)
    assert got == [(4, 4, True), (4, 4, True), (6, 4, False), (None, None, True)]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))
    s = minhash.sketch(np.concatenate([x, y, x[:1]]), np.array([0, len(x), len(x) + len(y), len(x) + len(y) + 1]))
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()  # every coordinate fills, of one element too
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.06
    assert minhash.band_shape(0.8) == 8
