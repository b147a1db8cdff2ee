"""SimHash fingerprints in DataFrame functions only.

A text's terms are its pairs of neighbouring words (the last word alone); each term's hash votes
on 128 signed bits with a weight from its words' lengths. Votes are counted in packed lanes:
sixteen sums of four 16-bit counters hold the votes for 64 bits, so whole-stage code generation
adds up a term's 128 votes in 32 additions. Counters are summed for every ``CHUNK`` terms and then
in 32-bit lanes, so no length of text overflows them.

``near_search`` finds all fingerprints within a Hamming radius through permuted block tables:
the bits are cut into blocks, every choice of (blocks - radius) blocks is one table keyed by
those blocks' bits, and two fingerprints within the radius agree on the key of one table at
least. Equal fingerprints are one row with a count throughout.

Defined results: a null text equals an empty one, whose only term is the empty word; ids may be
null (first in order) or repeat (then ordered by text); the document after the last is the first,
so a lone document follows itself; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BITS = 128
CHUNK = 8192
_ONES = 0x0001000100010001
_PAIRS = 0x0000FFFF0000FFFF
_FIRST = -(1 << 63)
BREAK = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\f\r"


def _or(columns: list[Column]) -> Column:
    """A balanced tree of bitwise ors."""
    while len(columns) > 1:
        columns = [reduce(lambda a, b: a.bitwiseOR(b), columns[i : i + 2]) for i in range(0, len(columns), 2)]
    return columns[0]


def words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(BLANK)), BREAK)


def terms(words: Column) -> Column:
    """array<struct<h, w>> of a column of words: each word with the one after it."""
    heavy = lambda w: F.coalesce((F.octet_length(w) > 3).cast("long"), F.lit(0).cast("long"))
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), (F.lit(1).cast("long") + heavy(a) + heavy(b)).alias("w")))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per distinct `keys` with f1 and f2, the two longs of the 128 bits. Rows must be
    unique in `keys`; where `texts` is already distributed by some of them nothing is shuffled."""
    # a column of its own, so that a text is split once
    t = texts.select(*keys, words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    t = t.select(*keys, F.posexplode(terms(F.col("_words")))).select(*keys, (F.col("pos") / CHUNK).cast("int").alias("_chunk"), F.col("col.h").alias("_h1"), F.col("col.w").alias("_w"))
    t = t.withColumn("_h2", F.xxhash64("_h1", F.lit(7)))
    lanes = [F.sum((F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_ONES))) * F.col("_w")).alias(f"{h}_{k}") for h in ("_h1", "_h2") for k in range(16)]
    t = t.groupBy(*keys, "_chunk").agg(*lanes, F.sum("_w").alias("_w"))
    wide = [F.sum((F.col(f"{h}_{k}") if p == 0 else F.shiftrightunsigned(f"{h}_{k}", 16)).bitwiseAND(F.lit(_PAIRS))).alias(f"{h}_{k}_{p}") for h in ("_h1", "_h2") for k in range(16) for p in (0, 1)]
    t = t.groupBy(*keys).agg(*wide, F.sum("_w").alias("_w"))
    low = F.lit(0xFFFFFFFF)

    def packed(h: str) -> Column:
        bits = []
        for k in range(16):
            for p in (0, 1):
                for q in (0, 1):
                    lane = (F.col(f"{h}_{k}_{p}") if q == 0 else F.shiftrightunsigned(f"{h}_{k}_{p}", 32)).bitwiseAND(low)
                    at = k + 16 * p + 32 * q
                    bits.append(F.when(lane * 2 > F.col("_w"), F.lit((1 << at) - (1 << 64 if at == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
        return _or(bits)

    return t.select(*keys, packed("_h1").alias("f1"), packed("_h2").alias("f2"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def shown(f1: Column, f2: Column) -> Column:
    return F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0"))


def in_order(docs: DataFrame, key: str, ranges: int) -> tuple[DataFrame, int]:
    """`docs` with _range, a number of about even ranges of `key` (nulls first), and _copy: the
    first documents of every range stand once more, flagged, at the end of the range before
    (the last range for the very first), so that each document's next one is in its range."""
    ident = F.coalesce(F.col(key).cast("long"), F.lit(_FIRST).cast("long"))
    ids = docs.select(ident.alias("i"))
    shares = [k / ranges for k in range(1, ranges)]
    row = ids.agg(F.min("i"), F.percentile_approx("i", F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * ranges))) if shares else F.lit(None)).collect()[0]
    if row[0] is None:
        return docs.withColumn("_range", F.lit(0)).withColumn("_copy", F.lit(0)), 1
    edges = sorted({row[0], *(row[1] or [])})

    def number(edges: list[int]) -> Column:
        step = max(1, int(len(edges) ** 0.5))
        every = F.array(*map(F.lit, edges)).cast("array<bigint>")
        coarse = F.array(*map(F.lit, edges[::step])).cast("array<bigint>")
        c = F.greatest(F.size(F.filter(coarse, lambda x: x <= ident)) - 1, F.lit(0)) * step
        return (c + F.size(F.filter(F.slice(every, c + 1, step), lambda x: x <= ident)) - 1).cast("int")

    # the ranges' true first ids: what the sketch of quantiles gives need not be one
    firsts = sorted(r[1] for r in ids_of(docs, ident, number(edges)).collect())
    n = len(firsts)
    at = number(firsts)
    first = F.element_at(F.array(*map(F.lit, firsts)).cast("array<bigint>"), at + 1) == ident
    where = F.when(first, F.array(F.struct(at.alias("r"), F.lit(0).alias("c")), F.struct(F.pmod(at - 1, F.lit(n)).alias("r"), F.lit(1).alias("c")))).otherwise(F.array(F.struct(at.alias("r"), F.lit(0).alias("c"))))
    return docs.withColumn("_at", F.explode(where)).select(*docs.columns, F.col("_at.r").alias("_range"), F.col("_at.c").alias("_copy")), n


def ids_of(docs: DataFrame, ident: Column, number: Column) -> DataFrame:
    return docs.select(number.alias("r"), ident.alias("i")).groupBy("r").agg(F.min("i").alias("i"))


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next, with f1 and f2. The edited text ends in the start of the next document's."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, _ = in_order(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "id", ranges)
    order = W.partitionBy("_range").orderBy("_copy", F.col("id").asc_nulls_first(), "text")
    rows = rows.select("_range", "_copy", "id", "text", F.row_number().over(order).alias("_n"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select("_range", "_copy", "_n", "id", "text", n.cast("long").alias("n_chars"), changed.alias("changed"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("changed").cast("binary"), 256))
    keys = ["_range", "_n", "_copy", "id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("changed").alias("t")))).alias("v"))
    both = both.select(*keys, F.col("v.k").alias("_k"), F.col("v.t").alias("t"))
    f = fingerprints(both, [*keys, "_k"], "t")
    pick = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    f = f.groupBy(*keys).agg(pick("f1", 0).alias("f1"), pick("f2", 0).alias("f2"), pick("f1", 1).alias("e1"), pick("f2", 1).alias("e2"))
    place = W.partitionBy("_range").orderBy("_n")
    f = f.withColumns({"x1": F.lead("f1").over(place), "x2": F.lead("f2").over(place)}).where("_copy = 0")
    own = (F.col("f1"), F.col("f2"))
    return f.select(F.col("id").alias(key), "n_chars", "edited_sha256", shown(*own).alias("fingerprint"), shown(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
                    likeness(own, (F.col("e1"), F.col("e2"))).alias("near_edited"), likeness(own, (F.col("x1"), F.col("x2"))).alias("near_next"), "f1", "f2")


def blocks(count: int) -> list[list[tuple[int, int, int]]]:
    """`count` blocks of the bits, each as (word, shift, width) parts."""
    out = []
    for b in range(count):
        lo, hi = BITS * b // count, BITS * (b + 1) // count
        parts = []
        while lo < hi:
            end = min(hi, (lo // 64 + 1) * 64)
            parts.append((lo // 64, lo % 64, end - lo))
            lo = end
        out.append(parts)
    return out


def tables(f1: Column, f2: Column, radius: int, count: int) -> Column:
    """array<struct<t, k>>: the key of a fingerprint in each permuted table."""
    cut = blocks(count)
    words = (f1, f2)
    part = lambda w, s, n: F.shiftrightunsigned(words[w], s).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1))
    return F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(*[part(*p) for b in chosen for p in cut[b]]).alias("k")) for t, chosen in enumerate(combinations(range(count), count - radius))])


def near_search(queries: DataFrame, rows: DataFrame, radius: int = 3, count: int = 5) -> DataFrame:
    """All pairs of a fingerprint in `queries` and another one in `rows` (both f1, f2, `rows`
    with the number n of its documents) at most `radius` bits apart: q1, q2, f1, f2, n, bits."""
    if not 0 <= radius < count:
        raise ValueError("radius must be below the number of blocks")
    q = queries.select("f1", "f2").distinct().select(F.col("f1").alias("q1"), F.col("f2").alias("q2"), F.explode(tables(F.col("f1"), F.col("f2"), radius, count)).alias("x")).select("q1", "q2", F.col("x.t").alias("qt"), F.col("x.k").alias("qk"))
    r = rows.select("f1", "f2", "n", F.explode(tables(F.col("f1"), F.col("f2"), radius, count)).alias("x")).select("f1", "f2", "n", F.col("x.t").alias("t"), F.col("x.k").alias("k"))
    bits = distance((F.col("q1"), F.col("q2")), (F.col("f1"), F.col("f2")))
    # a pair counts in the first table whose key it shares
    seen = F.arrays_zip(tables(F.col("q1"), F.col("q2"), radius, count).alias("a"), tables(F.col("f1"), F.col("f2"), radius, count).alias("b"))
    first = F.array_min(F.transform(F.filter(seen, lambda z: z["a"]["k"] == z["b"]["k"]), lambda z: z["a"]["t"]))
    on = (F.col("qt") == F.col("t")) & (F.col("qk") == F.col("k")) & (bits <= radius) & (bits > 0)
    return q.join(r, on).where(first == F.col("t")).select("q1", "q2", "f1", "f2", "n", bits.alias("bits"))


def searched(found: DataFrame, key: str = "doc_id", every: int = 20, radius: int = 3, count: int = 5) -> DataFrame:
    """`found` (what `edited` gives) with n_near: for documents whose id `every` divides, the
    number of other documents within `radius` bits; null for the rest."""
    sizes = found.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.max((F.col(key) % every == 0).cast("int")).alias("q"))
    near = near_search(sizes.where("q = 1"), sizes, radius, count).groupBy("q1", "q2").agg(F.sum("n").alias("m"))
    s = sizes.where("q = 1").join(near, (F.col("f1") == F.col("q1")) & (F.col("f2") == F.col("q2")), "left").select(F.col("f1").alias("s1"), F.col("f2").alias("s2"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("near"))
    # only the queries' rows are joined: equal fingerprints of all other rows never meet in a task
    asks = F.coalesce(F.col(key) % every == 0, F.lit(False))
    own = found.where(asks).join(s, (F.col("f1") == F.col("s1")) & (F.col("f2") == F.col("s2")), "left").select(*found.columns, F.col("near").alias("n_near"))
    return own.unionByName(found.where(~asks).withColumn("n_near", F.lit(None).cast("long")))
