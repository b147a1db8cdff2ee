"""Language identification of mixed-language texts.

Each word gets a score for every learned language from hashed byte 3- and 4-grams (word ends
included). The word's script first narrows the candidates: languages in whose training words
that script is next to absent are set to a floor. Viterbi decoding over a text's words, with a
penalty for every switch of language, then labels spans; a text's language is the one whose
spans hold most of its words, and its score the share they hold.

Most texts have one language. That is proved in vector form first: if no run of words gains
more than one penalty over the best single language, that language's path is the optimum. Only
the other texts are decoded step by step, all of a batch side by side.

Learning takes about ``sample_rows`` labelled rows per language (whole texts, chosen by a hash
of the id). Every label is learned, ``BLOCK_LANGUAGES`` at a time, so what reaches the driver at
once is bounded; the model itself takes 256 KiB for each language (at most 32,767). Prediction
covers every row.

Defined results: null texts and texts without any letter are ``und`` with score 0; words without
letters are neutral and take the language around them; a script seen in no language is neutral;
equal scores go to the language first in code point order; with nothing to learn from all is
``und``. Rows that repeat are labelled each, and alike: what stands beside a text does not matter.
Empty tables give no rows. Extra columns are carried through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._text import _SPACE, pieces, small_batches, utf8
from factloom.session import ship

FEATURES = 1 << 16
FLOOR = -8.0
PENALTY = 12.0
PIECE = 1 << 20
BLOCK_LANGUAGES = 500
UNDETERMINED = "und"

#: First code points of script ranges and the script that starts there.
SCRIPTS = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x00AB, "none"),
    (0x00C0, "latin"), (0x00D7, "none"), (0x00D8, "latin"), (0x00F7, "none"), (0x00F8, "latin"), (0x0250, "latin"), (0x02B0, "none"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other_indic"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF00, "none"), (0xFF21, "latin"), (0xFF3B, "none"), (0xFF41, "latin"), (0xFF5B, "none"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "none"), (0x10000, "other"), (0x20000, "han"),
]
_NAMES = sorted({s for _, s in SCRIPTS} - {"none"})
_STARTS = np.array([c for c, _ in SCRIPTS], dtype=np.uint32)
_SCRIPT_AT = np.array([_NAMES.index(s) if s != "none" else -1 for _, s in SCRIPTS], dtype=np.int8)
_LATIN = _NAMES.index("latin")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 32
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # features x languages, float32
    allowed: np.ndarray  # scripts x languages, bool


def _words(column: pa.Array):
    """The padded lower-cased bytes of a column, the words' starts in them, the row offsets in
    the words, and the words' scripts (-1: no letter)."""
    data, off = utf8(column)
    padded = np.insert(_LOWER[data], np.repeat(off[:-1], 2), 32)  # two, so that no 4-gram reaches the next text
    padded = np.concatenate([padded, np.full(3, 32, np.uint8)])
    space = padded == 32
    start = np.flatnonzero(~space[1:] & space[:-1]) + 1
    rows = np.searchsorted(start, off + 2 * np.arange(len(off))).astype(np.int64)
    script = np.full(len(start), -1, dtype=np.int8)
    if len(start):
        ascii_letter = _ASCII_LETTER[padded]
        latin = np.add.reduceat(ascii_letter, start, dtype=np.int32) > 0
        script[latin] = _LATIN
        rest = np.flatnonzero(~latin)
        if len(rest):
            # the first code point above ASCII that is a letter of some script
            ends = np.append(start[1:], len(padded))
            lead = np.flatnonzero(padded >= 0xC2)
            lead = lead[np.isin(np.searchsorted(start, lead, "right") - 1, rest)]
            b = padded[np.minimum(lead[:, None] + np.arange(4), len(padded) - 1)].astype(np.uint32)
            point = np.where(b[:, 0] < 0xE0, (b[:, 0] & 31) << 6 | b[:, 1] & 63, np.where(b[:, 0] < 0xF0, (b[:, 0] & 15) << 12 | (b[:, 1] & 63) << 6 | b[:, 2] & 63, (b[:, 0] & 7) << 18 | (b[:, 1] & 63) << 12 | (b[:, 2] & 63) << 6 | b[:, 3] & 63))
            kind = _SCRIPT_AT[np.searchsorted(_STARTS, point, "right") - 1]
            word = np.searchsorted(start, lead, "right") - 1
            word, kind = word[kind >= 0][::-1], kind[kind >= 0][::-1]
            script[word] = kind  # written from the end, so the first one stays
            del ends
    return padded, start, rows, script


def _features(padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-grams and 4-grams centred on each byte but the last three; white space has none."""
    p = padded.astype(np.uint32)
    three = p[:-3] | p[1:-2] << np.uint32(8) | p[2:-1] << np.uint32(16)
    four = three | p[3:] << np.uint32(24)
    with np.errstate(over="ignore"):
        a = (three * np.uint32(2654435761)) >> np.uint32(16)
        b = ((four ^ (four >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(16)
    return a, b


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = 4000, seed: int = 11) -> Model:
    """Learn from about `sample_rows` rows per language of `labelled` (null lang or text skipped)."""
    spark = labelled.sparkSession
    small_batches(spark)
    ship(spark)
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    languages = sorted(counts, key=lambda s: s.encode())
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    if len(languages) > np.iinfo(np.int16).max:
        raise ValueError("more languages than a path can number")
    million = 1_000_000
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(million, -(-million * sample_rows // counts[k]))))])
    sample = labelled.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(million)) < F.element_at(share, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                label = np.array(part.column(0).to_pylist(), dtype=object)
                for k in sorted(set(label)):
                    padded, start, _, script = _words(part.column(1).filter(pa.array(label == k)))
                    if not len(start):
                        continue
                    a, b = _features(padded)
                    inside = padded[1:-2] != 32
                    n = np.bincount(a[inside], minlength=FEATURES) + np.bincount(b[inside], minlength=FEATURES)
                    f = np.flatnonzero(n)
                    s = np.bincount(script[script >= 0], minlength=len(_NAMES))
                    g = np.flatnonzero(s)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * (len(f) + len(g)), pa.string()), pa.array(np.concatenate([f, -1 - g])), pa.array(np.concatenate([n[f], s[g]]))], names=["lang", "f", "n"])

    # what reaches the driver at once are the counts of one block of languages
    scores = np.zeros((FEATURES, len(languages)), np.float32)
    total = np.zeros((FEATURES, 1))
    allowed = np.zeros((len(_NAMES), len(languages)), bool)
    for first in range(0, len(languages), BLOCK_LANGUAGES):
        block = languages[first : first + BLOCK_LANGUAGES]
        here = slice(first, first + len(block))
        some = sample if len(block) == len(languages) else sample.where(F.col("lang").isin(block))
        got = some.mapInArrow(count, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros((FEATURES, len(block)))
        scripts = np.zeros((len(_NAMES), len(block)))
        at = got["lang"].map({k: i for i, k in enumerate(block)}).to_numpy()
        f, v = got["f"].to_numpy(), got["n"].to_numpy()
        n[f[f >= 0], at[f >= 0]] = v[f >= 0]
        scripts[-1 - f[f < 0], at[f < 0]] = v[f < 0]
        p = np.log((n + 0.5) / (n.sum(0) + 0.5 * FEATURES))
        if len(block) == len(languages):
            p -= p.mean(1, keepdims=True)
        else:
            total += p.sum(1, keepdims=True)
        scores[:, here] = p
        allowed[:, here] = scripts > 0.001 * np.maximum(scripts.sum(0), 1)
    if total.any():
        scores -= (total / len(languages)).astype(np.float32)
    return Model(languages, scores, allowed)


def word_scores(padded: np.ndarray, start: np.ndarray, script: np.ndarray, model: Model) -> np.ndarray:
    """Log posteriors (words x languages, not below FLOOR); 0 for neutral words."""
    a, b = _features(padded)
    s = model.scores[a]
    s += model.scores[b]
    # the 3-gram at i covers bytes i..i+2; it belongs to the word that holds byte i+1
    s[padded[1:-2] == 32] = 0
    t = np.add.reduceat(s, start - 1, axis=0).astype(np.float64)
    usable = model.allowed[np.maximum(script, 0)]
    neutral = (script < 0) | ~usable.any(1)
    t[~usable] = -1e9
    t -= t.max(1, keepdims=True)
    t -= np.log(np.exp(t).sum(1, keepdims=True))
    np.maximum(t, FLOOR, out=t)
    t[neutral] = 0
    return t


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best language of each word of each text, decoding the texts side by side."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    length = np.array([len(scores[i]) for i in order])
    flat = np.concatenate([scores[i] for i in order])
    base = np.cumsum(length) - length
    k = flat.shape[1]
    best = flat[base].copy()
    back = np.zeros(flat.shape, dtype=np.int16)
    live = len(order)
    for t in range(1, int(length[0])):
        while live and length[live - 1] <= t:
            live -= 1
        b = best[:live]
        top = b.argmax(1)
        change = b[np.arange(live), top] - penalty
        stay = b >= change[:, None]
        at = base[:live] + t
        back[at] = np.where(stay, np.arange(k), top[:, None])
        best[:live] = np.where(stay, b, change[:, None]) + flat[at]
    out: list = [None] * len(order)
    for j, i in enumerate(order):
        path = np.empty(length[j], dtype=np.int16)
        c = int(best[j].argmax())
        steps = back[base[j] : base[j] + length[j]]
        for t in range(length[j] - 1, -1, -1):
            path[t] = c
            c = steps[t, c]
        out[i] = path
    return out


def label(column: pa.Array, model: Model, penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """Per text: language, score and spans (language, first word, word after the last)."""
    padded, start, rows, script = _words(column)
    n = len(rows) - 1
    und = (UNDETERMINED, 0.0, [])
    if not model.languages or not len(start):
        return [und] * n
    s = word_scores(padded, start, script, model)
    lengths = np.diff(rows)
    has = np.flatnonzero(lengths)
    total = np.add.reduceat(s, rows[:-1][has], axis=0)
    best = total.argmax(1)
    per_word = np.repeat(best, lengths[has])
    own = s[np.arange(len(s)), per_word]
    other = s.copy()
    other[np.arange(len(s)), per_word] = -np.inf
    gain = np.maximum(other.max(1), -1e3) - own if s.shape[1] > 1 else np.full(len(s), -1.0)
    most = np.zeros(len(has))
    run = np.cumsum(gain)
    for j, i in enumerate(has):  # the largest sum of a run of words, by text
        a, b = rows[i], rows[i + 1]
        before = run[a - 1] if a else 0.0
        r = np.concatenate([[before], run[a:b]])
        most[j] = (r - np.minimum.accumulate(r)).max()
    hard = np.flatnonzero(most > penalty)
    paths = dict(zip(hard.tolist(), viterbi([s[rows[has[j]] : rows[has[j] + 1]] for j in hard], penalty)))
    texts = None
    plain = np.add.reduceat(_ASCII_LETTER[padded], start[rows[:-1][has]], dtype=np.int64) > 0
    out = [und] * n
    for j, i in enumerate(has.tolist()):
        if not plain[j]:  # script ranges also hold signs and marks
            texts = column if texts is None else texts
            if not _LETTER.search(texts[i].as_py() or ""):
                continue
        size = int(lengths[i])
        if j not in paths:
            out[i] = (model.languages[best[j]], _confidence(1.0, total[j], size), [(model.languages[best[j]], 0, size)])
            continue
        path = paths[j]
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), size]
        held = np.bincount(path, minlength=len(model.languages))
        top = int(held.argmax())
        out[i] = (model.languages[top], float(held[top] / size), [(model.languages[path[a]], a, b) for a, b in zip(cuts, cuts[1:])])
    return out


def _confidence(share: float, total: np.ndarray, size: int) -> float:
    """The share, lowered where a short text's scores leave other languages likely."""
    t = np.exp(total - total.max())
    return float(share * t.max() / t.sum())


def identified(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """`docs` with lang_pred, score and, if asked for, spans (array of lang, first word, end
    word); columns of those names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    docs = docs.drop("lang_pred", "score", *(["spans"] if spans else []))
    span = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("spans", span)] if spans else [])])
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text, PIECE):
                got = label(part.column(text), shared.value, penalty)
                more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                if spans:
                    more.append(pa.array([[{"lang": a, "start": b, "end": c} for a, b, c in g[2]] for g in got], kind))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(key: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
