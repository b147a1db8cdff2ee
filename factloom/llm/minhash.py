"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles of ``width`` words. The sketch has t coordinates,
filled in rounds: in round i < t every element of the set falls into one bin, chosen by that
round's hash, and the least hash fills a bin that no earlier round filled; round t + j throws all
elements into bin j. So each coordinate fills for every set that is not empty, mostly in the
first few rounds, and coordinates agree with the sets' Jaccard similarity as probability, with
the concentration of independent draws. Sketches are cut into bands; at similarity 0.8, 64 bands
of 8 miss a pair with probability 8e-6.

Equal sets are one vertex from the start. Each bucket of a band links its members to its least
vertex, so candidates grow with the rows and not with the square of a bucket. Candidates are
verified on the full sets for the likeliest one of each vertex. Vertices that share buckets,
directly or through others, and are in different components after that, are compared exactly, in
blocks and as matrix products, so no link that any bucket holds is lost and no pairs are listed.

Defined results: null texts and texts without words have an empty set and link with nothing; with
fewer words than ``width`` the whole sequence is the one shingle; rows that repeat an id are one
vertex; a row with a null id links with nothing, and its component is null (kept is true); an
empty table gives no rows. Extra columns are carried through by ``deduplicated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._graph import components
from factloom.llm.ego_join import _least_reached
from factloom.llm._text import give_back, mix, pieces, shingles, small_batches, word_hashes
from factloom.session import cut, discard, release, ship

COORDINATES = 512
#: So many ids are broadcast at most; beyond, their join is shuffled.
SMALL = 1_000_000
BLOCK = 512
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(elements: np.ndarray, off: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The n x t sketches of n sets of hashes (each not empty)."""
    n = len(off) - 1
    out = np.full(n * t, _MOST, dtype=np.uint64)
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    h = elements
    live = np.arange(n)
    for i in range(2 * t):
        if not len(live):
            break
        with np.errstate(over="ignore"):
            x = mix(h + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        bin_ = ((x >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else np.full(len(x), i - t)
        at = row * t + bin_
        if i:
            free = out[at] == _MOST
            at, x = at[free], x[free]
        # the low bits, which did not choose the bin, lead; what an earlier round filled is not free
        np.minimum.at(out, at, np.minimum((x << np.uint64(40)) | (x >> np.uint64(24)), _MOST - np.uint64(1)))
        full = (out.reshape(n, t)[live] != _MOST).all(1)
        if full.any():
            keep = np.zeros(n, dtype=bool)
            live = live[~full]
            keep[live] = True
            k = keep[row]
            row, h = row[k], h[k]
    return out.reshape(n, t)


def band_shape(similarity: float, t: int = COORDINATES, miss: float = 1e-5) -> int:
    """The most rows a band may have so that a pair at `similarity` is missed at most so often."""
    best = 1
    for r in range(1, t + 1):
        if (1 - similarity**r) ** (t // r) <= miss:
            best = r
    return best


def _band_keys(s: np.ndarray, rows: int) -> np.ndarray:
    n, t = s.shape
    b = t // rows
    k = s[:, : b * rows].reshape(n, b, rows)
    h = np.broadcast_to(mix(np.arange(b, dtype=np.uint64) + np.uint64(77)), (n, b)).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            h = mix(h * np.uint64(0xCA9B0C7EBA1DA115) + k[:, :, j])
    return h


def _digests(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    out = []
    for salt in (0x1234567, 0x89ABCDEF):
        with np.errstate(over="ignore"):
            c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
            out.append(c[off[1:]] - c[off[:-1]])
    return out[0].view(np.int64), out[1].view(np.int64)


def sketched(docs: DataFrame, key: str, text: str, width: int, rows: int, t: int) -> DataFrame:
    """(id, n_shingles, c1, c2, bands): the set's size, its digests and its bands' keys (null if empty)."""
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                h, off = shingles(*word_hashes(part.column(1)), width)
                c1, c2 = _digests(h, off)
                size = np.diff(off)
                # one sketch for each set that differs within the part
                _, first, same = np.unique(np.stack([c1, c2], 1), axis=0, return_index=True, return_inverse=True)
                use = first[size[first] > 0]
                inside = np.concatenate([np.arange(off[i], off[i + 1]) for i in use]) if len(use) else np.zeros(0, np.int64)
                s = sketch(h[inside], np.concatenate([[0], np.cumsum(size[use])]), t)
                keys = _band_keys(s, rows).view(np.int64)
                at = np.full(len(first), -1)
                at[np.flatnonzero(size[first] > 0)] = np.arange(len(use))
                mine = at[same.reshape(-1)]
                b = keys.shape[1]
                values = pa.array(keys[mine[mine >= 0]].reshape(-1))
                ends = np.concatenate([[0], np.cumsum(np.where(mine >= 0, b, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(mine < 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array(c1), pa.array(c2), bands], names=["id", "n_shingles", "c1", "c2", "bands"])
        give_back()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_shingles long, c1 long, c2 long, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, s): the full set of each row of (id, text)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                h, off = shingles(*word_hashes(part.column(1)), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))], names=["id", "s"])
        give_back()

    return docs.select("id", "text").mapInArrow(run, "id long, s array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    p = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    p = p.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.when(F.least(F.size("sa"), F.size("sb")) * 100 >= percent * F.greatest(F.size("sa"), F.size("sb")), F.size(F.array_intersect("sa", "sb"))).otherwise(0).alias("x"))
    return p.where(F.col("x") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("x"))).select("a", "b").distinct()


def block_links(rest: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components c within groups g of (g, v, c, s: the full set).
    A group is cut into blocks of about BLOCK sets of like size; blocks whose sizes allow the
    similarity are compared as matrix products of their shared shingles, and a pair of blocks
    gives an edge to the least vertex it reaches, not its pairs."""
    spark = rest.sparkSession
    # sets that can be so similar are at most two size classes apart
    step = (100 / percent) ** 0.5075 if percent < 100 else 1.01
    rest = rest.withColumn("z", F.floor(F.log(F.size("s").cast("double")) / F.log(F.lit(step))).cast("int"))
    n = rest.groupBy("g", "z").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    n = cut(n)
    if n.count() <= SMALL:  # a large group's rows stay where they are
        n = F.broadcast(n)
    rest = rest.join(n, ["g", "z"]).withColumn("h", F.pmod(F.xxhash64("v"), F.col("n")).cast("int"))

    def packed(t: pa.Table) -> pa.Table:
        s = t.column("s").combine_chunks()
        off = np.asarray(s.offsets, dtype=np.int64)
        el = np.asarray(s.values)[off[0] : off[-1]]
        get = lambda c: np.asarray(t.column(c)).astype(np.int64).tobytes()
        one = lambda c: [t.column(c)[0].as_py()]
        return pa.table({"g": pa.array(one("g"), pa.int64()), "z": pa.array(one("z"), pa.int32()), "h": pa.array(one("h"), pa.int32()), "vs": pa.array([get("v")]), "cs": pa.array([get("c")]), "n": pa.array([np.diff(off).tobytes()]), "s": pa.array([el.tobytes()])})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut(rest.select("g", "z", "h", "v", "c", "s").repartition(parts, "g", "z", "h").groupBy("g", "z", "h").applyInArrow(packed, "g long, z int, h int, vs binary, cs binary, n binary, s binary"))
    box = blocks.select("g", "z", "h")
    near = F.col("g") == F.col("g2")
    near = near & ((F.col("z") < F.col("z2")) | ((F.col("z") == F.col("z2")) & (F.col("h") <= F.col("h2")))) & (F.col("z2") - F.col("z") <= 2)
    pairs = box.join(box.select(*[F.col(c).alias(f"{c}2") for c in box.columns]), near)
    other = blocks.select(*[F.col(c).alias(f"{c}2") for c in blocks.columns])
    work = pairs.join(blocks, ["g", "z", "h"]).join(other, ["g2", "z2", "h2"]).repartition(parts, "g", "z", "h", "z2", "h2")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                va, ca, na, sa = (np.frombuffer(r[c], np.int64) for c in ("vs", "cs", "n", "s"))
                vb, cb, nb, sb = (np.frombuffer(r[c + "2"], np.int64) for c in ("vs", "cs", "n", "s"))
                if len(np.unique(np.concatenate([ca, cb]))) < 2:
                    continue
                common = np.intersect1d(sa, sb)
                m = np.zeros((len(va), len(vb)), dtype=np.float32)
                place = [(x, np.repeat(np.arange(len(k)), k), np.searchsorted(common, x)) for x, k in ((sa, na), (sb, nb))]
                hit = [(row[ok], at[ok]) for x, row, at in place for ok in [(at < len(common)) & (common[np.minimum(at, max(len(common) - 1, 0))] == x)]] if len(common) else []
                for lo in range(0, len(common), 4096):
                    inc = []
                    for (row, at), k in zip(hit, (len(va), len(vb))):
                        use = (at >= lo) & (at < lo + 4096)
                        x = np.zeros((k, 4096), dtype=np.float32)
                        x[row[use], at[use] - lo] = 1
                        inc.append(x)
                    m += inc[0] @ inc[1].T
                x = m.astype(np.int64)
                i_, j_ = np.nonzero((100 * x >= percent * (na[:, None] + nb[None, :] - x)) & (ca[:, None] != cb[None, :]))
                if not len(i_):
                    continue
                v = np.concatenate([va, vb])
                least = _least_reached(v, i_, j_ + len(va))
                got = np.flatnonzero(least != v)
                yield pa.RecordBatch.from_arrays([pa.array(v[got]), pa.array(least[got])], names=["a", "b"])

    return work.mapInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, t: int = COORDINATES) -> DataFrame:
    """Per row of `docs`: key, n_shingles, component_id and kept."""
    spark = docs.sparkSession
    rows = band_shape(percent / 100, t)
    a = cut(sketched(docs, key, text, width, rows, t))
    own = a.where("n_shingles > 0 and id is not null")
    b = own.groupBy("c1", "c2").agg(F.min(F.struct("id", "bands")).alias("m")).select(F.col("m.id").alias("v"), F.explode("m.bands").alias("k"))
    shared = b.groupBy("k").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "m")
    b = cut(b.join(shared, "k"))  # members of buckets of two and more
    classes = cut(own.groupBy("c1", "c2").agg(F.min("id").alias("v")))
    narrow = cut(a.select("id", "n_shingles", "c1", "c2"))
    discard(a)
    release(spark)
    members = cut(b.select("v").distinct())
    vertices = members.count()
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    some = F.broadcast(members) if vertices <= SMALL else members
    sets = cut(full_sets(texts.join(some, texts["id"] == members["v"], "left_semi"), width))
    release(spark)
    stars = cut(b.where("v <> m").groupBy(F.col("m").alias("a"), F.col("v").alias("b")).agg(F.count(F.lit(1)).alias("c")))
    discard(b)
    likely = stars.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    links = cut(verified(likely, sets, percent))
    release(spark)
    comp = cut(components(links))
    discard(links)
    # components that share buckets but no verified link yet, and the groups of them
    ends = stars.select("a", "b")
    for end in ("a", "b"):
        c = comp.select(F.col("v").alias("_v"), "component")
        ends = ends.join(c, ends[end] == c["_v"], "left").select(*[x for x in ends.columns if x != end], F.coalesce("component", end).alias(end))
    groups = components(ends)
    if groups.limit(1).count():
        g = cut(groups.select(F.col("v").alias("c"), F.col("component").alias("g")))
        x = members.join(comp, "v", "left").select("v", F.coalesce("component", "v").alias("c"))
        found = cut(block_links(x.join(g, "c").join(sets.withColumnRenamed("id", "v"), "v").select("g", "v", "c", "s"), percent))
        # what they link are components as a whole
        for end in ("a", "b"):
            c = x.select(F.col("v").alias("_v"), "c")
            found = found.join(c, found[end] == c["_v"]).select(*[y for y in found.columns if y != end], F.col("c").alias(end))
        more = cut(components(found).select(F.col("v").alias("component"), F.col("component").alias("top")))
        comp = cut(x.join(more, x["c"] == more["component"], "left").select("v", F.coalesce("top", "c").alias("component")))
    discard(sets)
    discard(stars)
    discard(members)
    release(spark)
    out = narrow.join(classes, ["c1", "c2"], "left").join(comp, "v", "left")
    out = out.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "v", "id")).otherwise(F.col("id")).alias("component_id"))
    # a null id has a class only through others' ids: it stays by itself
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", key)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the documents whose group has one of a smaller id."""
    gone = grouped(docs, key, text, width, percent).where("not kept").select(F.col(key).alias("gone"))
    return docs.join(gone, docs[key] == gone["gone"], "left_anti")
