"""Scoring texts with a Katz backoff language model counted from a corpus.

Tokens are lower-cased words and one end mark for each text. The probability of a token after
the ``order`` - 1 tokens before it is its n-gram's discounted relative frequency if that n-gram
was seen ``min_count`` times at least, else a weight of the context times the probability after
the shorter context; at the bottom stand discounted unigrams and one class of unknown words that
has the mass they leave. Discounts are Good-Turing's for counts up to ``LARGE`` (absolute ones
where the counts of counts do not allow that); backoff weights are normalised exactly: for each
context the probabilities of all known words and the unknown class sum to 1.

Counts are kept in tables partitioned by the n-gram's hash. Texts are packed; a pack asks each
partition for its own distinct n-grams once and gets their counts back, so a frequent word costs
a pack one entry. One pack, named by the partition, reports an n-gram to its context's
partition, where the weights come from; then each pack evaluates its texts token by token.
A pack meets its replies by one shuffle keyed by the pack; what a step no longer needs is
deleted, so the disk holds one step's exchange beside packs and replies.

Defined results: a null text is an empty one (its end mark only); a row with a null id is not held
out, so it is learned from; rows repeat as they come and count each; with nothing to learn from,
every token is unknown with probability 1; an empty table gives no rows. N-grams are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._text import give_back, pair, pieces, small_batches, word_hashes
from factloom.session import cut, release, ship

LARGE = 5
PACK_BYTES = 14 << 20
BUCKET_TOKENS = 2_000_000
END = 0x5851F42D4C957F2D
BEGIN = [0, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x4A39B70D5C9C9A5B, 0x5B5E0D1C3A7F9E11]  # of contexts of 1, 2, … tokens


def _press(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a)
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(raw) else b"")


def _press_sorted(a: np.ndarray) -> bytes:
    return _press(np.diff(a, prepend=np.uint64(0)))


def _unpress(b: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def _unpress_sorted(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(_unpress(b, np.uint64), dtype=np.uint64)


def _bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where in sorted keys each bucket starts: buckets are equal ranges of the hash."""
    b = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(b, np.arange(buckets + 1))


class Pack:
    """The distinct n-grams of some texts, and each token's."""

    def __init__(self, texts: pa.Array, order: int):
        words, off = word_hashes(texts)
        n = len(off) - 1
        self.tokens = np.insert(words, off[1:], np.uint64(END))
        self.off = off + np.arange(n + 1)
        first = self.off[:-1]
        self.keys: list[np.ndarray] = []  # level k at k - 1: its distinct n-grams, sorted, with the next level's BEGIN
        self.gram: list[np.ndarray] = []  # each token's n-gram in them
        self.context: list[np.ndarray] = []  # level k >= 2: each token's context in the keys of level k - 1
        self.begin: list[int] = []
        g = self.tokens
        for k in range(1, order + 1):
            if k > 1:
                c = np.empty_like(g)
                c[1:] = g[:-1]
                c[first] = np.uint64(BEGIN[k - 1])
                at = np.empty(len(g), dtype=np.int64)
                at[1:] = self.gram[-1][:-1]
                at[first] = self.begin[-1]
                self.context.append(at)
                g = pair(c, self.tokens)
            u, inverse = np.unique(np.append(g, np.uint64(BEGIN[k])), return_inverse=True)
            self.keys.append(u)
            self.gram.append(inverse[:-1])
            self.begin.append(int(inverse[-1]))

    def counts(self, level: int, learned: np.ndarray) -> np.ndarray:
        use = np.repeat(learned, np.diff(self.off))
        n = np.bincount(self.gram[level - 1][use], minlength=len(self.keys[level - 1]))
        n[self.begin[level - 1]] = int(learned.sum())
        return n


def discounts(n: dict[int, int]) -> list[float]:
    """d[r] for r = 0 … LARGE from counts of counts n[1 … LARGE + 1]."""
    d = [0.0]
    n1 = n.get(1, 0)
    a = (LARGE + 1) * n.get(LARGE + 1, 0) / n1 if n1 else 1.0
    for r in range(1, LARGE + 1):
        nr, more = n.get(r, 0), n.get(r + 1, 0)
        x = ((r + 1) * more / nr / r - a) / (1 - a) if nr and more and a < 1 else -1.0
        d.append(x if 0 < x < 1 else (r - 0.5) / r)
    return d


def _discounted(count: np.ndarray, d: list[float]) -> np.ndarray:
    return count * np.where(count <= LARGE, np.array(d)[np.minimum(count, LARGE)], 1.0)


class Model:
    """The model's few global numbers: by level tokens, distinct n-grams and discounts."""

    def __init__(self, min_count: int):
        self.min_count, self.tokens, self.distinct, self.d = min_count, 0, 0, {}
        self.unknown, self.divisor = 1.0, 1

    def unigram(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.full(len(count), self.unknown)
        return np.where(count > 0, _discounted(count, self.d[1]) / self.divisor, self.unknown)


def _probabilities(p: Pack, model: Model, counts: list[np.ndarray], weights: list[np.ndarray], upto: int) -> np.ndarray:
    """log10 of each token's probability after up to `upto` - 1 tokens, from level to level."""
    lp = np.log10(model.unigram(counts[0]))[p.gram[0]]
    for k in range(2, upto + 1):
        c = counts[k - 1][p.gram[k - 1]]
        at = p.context[k - 2]
        w = weights[k - 2]  # log10 weight and the divisor of each context
        own = np.log10(np.maximum(_discounted(c, model.d[k]), 1e-300)) - np.log10(np.maximum(w[1][at], 1))
        lp = np.where(c >= model.min_count, own, w[0][at] + lp)
    return lp


TEXTS, ASK, COUNTS, MINE, TOTALS, REPORT, WEIGHTS = range(7)
_MESSAGE = {"pack": ("string", pa.string()), "level": ("int", pa.int32()), "bucket": ("int", pa.int32()), "what": ("int", pa.int32()), "a": ("binary", pa.binary()), "b": ("binary", pa.binary())}
_PACK = _MESSAGE | {"ids": ("binary", pa.binary()), "flags": ("binary", pa.binary()), "sizes": ("long", pa.int64())}


def _ddl(columns: dict) -> str:
    return ", ".join(f"{k} {v[0]}" for k, v in columns.items())


def _message(rows: list[tuple], columns: dict = _MESSAGE) -> pa.Table:
    """Rows of what packs and buckets tell each other."""
    values = zip(*rows) if rows else [[] for _ in columns]
    return pa.table({k: pa.array(v, t) for (k, (_, t)), v in zip(columns.items(), values)})


def packed(docs: DataFrame) -> DataFrame:
    """(id, text, held) as packs of compressed texts."""

    def close(parts):
        t = pa.concat_tables([pa.Table.from_batches([x]) for x in parts]).combine_chunks()
        texts = t.column("text").combine_chunks().cast(pa.large_binary()).fill_null(b"")
        data = b"".join(texts.to_pylist())
        ids = pa.RecordBatch.from_arrays([t.column("id").combine_chunks()], names=["id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema) as w:
            w.write_batch(ids)
        lengths = pa.compute.binary_length(texts).to_numpy().astype(np.int64)
        held = t.column("held").to_numpy().astype(np.uint8)
        name = uuid.uuid4().hex  # the rows are checkpointed before anything refers to it
        return _message([(name, 0, 0, TEXTS, pa.Codec("zstd", 9).compress(data, asbytes=True), _press(lengths), sink.getvalue().to_pybytes(), _press(held), len(data))], _PACK).to_batches()[0]

    def collect(batches):
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                held.append(part)
                size += int(pa.compute.sum(pa.compute.binary_length(part.column(part.schema.get_field_index("text")))).as_py() or 0) + part.num_rows
                if size >= PACK_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)
        give_back()

    return docs.mapInArrow(collect, _ddl(_PACK))


def _asking(level: int, buckets: int):
    """What packs ask each bucket for: their n-grams of the level (a) and how often texts to learn
    from have them (b)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table = pa.Table.from_batches([batch.slice(i, 1)])
                _, held, p = _opened(table, level)
                pack, keys, n = _cell(table, "pack", 0), p.keys[level - 1], p.counts(level, ~held).astype(np.uint32)
                del p, table
                edges = _bucket_edges(keys, buckets)
                rows = [(pack, level, b, ASK, _press_sorted(keys[edges[b] : edges[b + 1]]), _press(n[edges[b] : edges[b + 1]])) for b in np.flatnonzero(np.diff(edges)).tolist()]
                yield from _message(rows).to_batches()
        give_back()

    return run


def _counted(table: pa.Table) -> pa.Table:
    """One bucket of one level: replies to its packs (counts, and which n-grams the pack reports)
    and its share of the global numbers."""
    level, bucket = _cell(table, "level", 0), _cell(table, "bucket", 0)
    packs = table.column("pack").to_pylist()
    order = np.argsort(np.array(packs, dtype=object), kind="stable").tolist()
    keys = [_unpress_sorted(_cell(table, "a", i)) for i in order]
    every = np.concatenate(keys)
    u, first, inverse = np.unique(every, return_index=True, return_inverse=True)
    del every
    counts = np.concatenate([_unpress(_cell(table, "b", i), np.uint32) for i in order])
    del table
    total = np.bincount(inverse, weights=counts.astype(np.float64)).astype(np.int64)
    mine = np.zeros(len(counts), dtype=bool)
    mine[first] = True
    del counts, first
    rows, at = [], 0
    for i, k in zip(order, keys):
        part = slice(at, at + len(k))
        at += len(k)
        rows.append((packs[i], level, bucket, COUNTS, _press(total[inverse[part]]), None))
        rows.append((packs[i], level, bucket, MINE, pa.compress(np.packbits(mine[part]).tobytes(), codec="zstd", asbytes=True), None))
    real = total[(u != np.uint64(BEGIN[level])) & (total > 0)]
    stats = np.array([real.sum(), len(real), *[(real == r).sum() for r in range(1, LARGE + 2)]], dtype=np.int64)
    rows.append((None, level, bucket, TOTALS, stats.tobytes(), None))
    give_back()
    return _message(rows)


def _weighed(table: pa.Table) -> pa.Table:
    """One bucket of contexts: from what packs report the weights, for packs that ask."""
    what = np.asarray(table.column("what"))
    level, bucket = _cell(table, "level", 0), _cell(table, "bucket", 0)
    told = np.flatnonzero(what == REPORT).tolist()
    keys = [_unpress_sorted(_cell(table, "a", i)) for i in told]
    sums = [_unpress(_cell(table, "b", i), np.float64).reshape(3, -1) for i in told]
    u, first, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_index=True, return_inverse=True)
    kept, lower, divisor = np.concatenate([np.zeros((3, 0)), *sums], axis=1)
    del keys, sums
    kept = np.bincount(inverse, weights=kept, minlength=len(u))
    lower = np.bincount(inverse, weights=lower, minlength=len(u))
    divisor = divisor[first]
    # a context all of whose mass is taken gets one more count, so that something is left
    extra = divisor - kept < 1e-9
    divisor = divisor + extra
    weight = np.log10(np.maximum(1 - kept / divisor, 1e-12)) - np.log10(np.maximum(1 - lower, 1e-12))
    rows = []
    for i in np.flatnonzero(what == ASK).tolist():
        k = _unpress_sorted(_cell(table, "a", i))
        at = np.searchsorted(u, k)
        hit = np.flatnonzero(u[np.minimum(at, len(u) - 1)] == k) if len(u) else np.zeros(0, np.int64)
        if len(hit):
            rows.append((_cell(table, "pack", i), level, bucket, WEIGHTS, _press(weight[at[hit]]), _press((hit.astype(np.int32) << 1) | extra[at[hit]])))
    give_back()
    return _message(rows)


def _cell(table: pa.Table, name: str, i: int):
    return table.column(name)[i].as_py()


def _place(table: pa.Table) -> int:
    return int(np.flatnonzero(np.asarray(table.column("what")) == TEXTS)[0])


def _opened(table: pa.Table, order: int) -> tuple[pa.Array, np.ndarray, Pack]:
    """The pack that stands among the table's rows, cut into n-grams."""
    i = _place(table)
    ids = pa.ipc.open_stream(_cell(table, "ids", i)).read_all().column(0).combine_chunks()
    held = _unpress(_cell(table, "flags", i), np.uint8).astype(bool)
    size = _cell(table, "sizes", i)
    data = pa.decompress(table.column("a")[i].as_buffer(), decompressed_size=size, codec="zstd") if size else pa.py_buffer(b"")
    lengths = _unpress(_cell(table, "b", i), np.int64)
    off = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int64())
    texts = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, off.buffers()[1], data])
    return ids, held, Pack(texts, order)


def _answered(p: Pack, table: pa.Table, levels: int, buckets: int, flags: bool):
    """Counts, reported flags (of level `levels`, if asked for) and weights of the pack's n-grams
    by level, from the replies."""
    counts = [np.zeros(len(p.keys[k]), np.int64) for k in range(levels)]
    mine = np.zeros(len(p.keys[levels - 1]), bool) if flags else None
    weights = [np.stack([np.zeros(len(p.keys[k])), np.ones(len(p.keys[k]))]) for k in range(levels - 1)]
    edges = [_bucket_edges(p.keys[k], buckets) for k in range(levels)]
    level, bucket, what = (table.column(c).to_pylist() for c in ("level", "bucket", "what"))
    # counts before weights: a weight's place is among the contexts with a count
    for i in np.argsort(np.array(what), kind="stable").tolist():
        k, b = level[i], bucket[i]
        if what[i] == TEXTS or k > levels:
            continue
        data = _cell(table, "a", i)
        if what[i] == WEIGHTS:  # weights of level k belong to contexts, n-grams of level k - 1
            # places among the asked contexts, those with a count, and whether it is one more
            asked = np.flatnonzero(counts[k - 2][edges[k - 2][b] : edges[k - 2][b + 1]] > 0)
            place = _unpress(_cell(table, "b", i), np.int32)
            at = asked[place >> 1] + edges[k - 2][b]
            weights[k - 2][0, at] = _unpress(data, np.float64)
            weights[k - 2][1, at] = counts[k - 2][at] + (place & 1)
            continue
        part = slice(edges[k - 1][b], edges[k - 1][b + 1])
        if what[i] == COUNTS:
            counts[k - 1][part] = _unpress(data, np.int64)
        elif flags and k == levels:
            n = part.stop - part.start
            mine[part] = np.unpackbits(np.frombuffer(pa.decompress(data, decompressed_size=(n + 7) // 8, codec="zstd", asbytes=True), np.uint8), count=n).astype(bool)
    return counts, mine, weights


def _reporting(level: int, buckets: int, model: Model):
    """A pack with its replies: what it reports of the n-grams of `level` to their contexts'
    buckets, and which contexts it asks for."""

    def run(table: pa.Table) -> pa.Table:
        _, _, p = _opened(table, level)
        counts, mine, weights = _answered(p, table, level, buckets, True)
        pack = _cell(table, "pack", 0)
        del table
        rows = []
        use = mine & (counts[level - 1] >= model.min_count)
        use[p.begin[level - 1]] = False
        if use.any():
            lower = 10.0 ** _probabilities(p, model, counts, weights, level - 1)
            # a token that shows each n-gram
            token = np.zeros(len(use), dtype=np.int64)
            token[p.gram[level - 1]] = np.arange(len(p.tokens))
            at = token[use]
            u, inverse = np.unique(p.context[level - 2][at], return_inverse=True)
            sums = np.stack([np.bincount(inverse, weights=_discounted(counts[level - 1][use], model.d[level])), np.bincount(inverse, weights=lower[at]), counts[level - 2][u]])
            keys = p.keys[level - 2][u]
            edges = _bucket_edges(keys, buckets)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[b], edges[b + 1])
                rows.append((pack, level, b, REPORT, _press_sorted(keys[part]), _press(sums[:, part].reshape(-1))))
        # a context that training never saw has no weight
        keys = p.keys[level - 2][counts[level - 2] > 0]
        edges = _bucket_edges(keys, buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            rows.append((pack, level, b, ASK, _press_sorted(keys[edges[b] : edges[b + 1]]), None))
        give_back()
        return _message(rows)

    return run


def _scoring(order: int, buckets: int, model: Model, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        ids, held, p = _opened(table, order)
        counts, _, weights = _answered(p, table, order, buckets, False)
        del table
        # contexts nobody reported keep weight 1
        lp = _probabilities(p, model, counts, weights, order)
        c = counts[0][p.gram[0]]
        base = np.log10((c + 1.0) / (model.tokens + 1.0 * (model.distinct + 1)))
        start = p.off[:-1]
        out = pa.Table.from_arrays([
            ids, pa.array(held), pa.array(np.diff(p.off)), pa.array(np.add.reduceat((c > 0).astype(np.int64), start)),
            pa.array(np.full(len(start), model.tokens, np.int64)), pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(lp, start)),
        ], names=names)
        give_back()
        return out

    return run


def scored(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", order: int = 2, min_count: int = 2) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score, log10 probabilities of the whole text; the model learns from rows that are not `held`."""
    if not 1 <= order < len(BEGIN):
        raise ValueError(f"order must be from 1 to {len(BEGIN) - 1}")
    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = int(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // BUCKET_TOKENS))
    packs = cut(packed(rows))
    stats: dict[int, np.ndarray] = {}
    replies: list[DataFrame] = []
    for k in range(1, order + 1):
        asked = packs.mapInArrow(_asking(k, buckets), _ddl(_MESSAGE))
        replies.append(cut(asked.groupBy("level", "bucket").applyInArrow(_counted, _ddl(_MESSAGE))))
        release(spark)
        # one small row for each bucket, summed into one for the level
        for r in replies[-1].where(F.col("what") == TOTALS).select("level", "a").groupBy("level").applyInArrow(_summed, "level int, a binary").collect():
            stats[r["level"]] = np.frombuffer(r["a"], np.int64)
    model = Model(min_count)
    for k in range(1, order + 1):
        model.d[k] = discounts({i: int(stats[k][1 + i]) for i in range(1, LARGE + 2)} if k in stats else {})
    if 1 in stats and stats[1][0] > 0:
        x = stats[1]
        model.tokens, model.distinct = int(x[0]), int(x[1])
        left = sum((1 - model.d[1][r]) * r * int(x[1 + r]) for r in range(1, LARGE + 1))
        # where nothing was discounted the unknown class counts as one token more
        model.divisor = model.tokens if left > 0 else model.tokens + 1
        model.unknown = (left or 1) / model.divisor
    for k in range(2, order + 1):
        told = _with_replies(packs, replies, F.when(F.col("what") == MINE, F.col("level") == k).otherwise((F.col("what") != TOTALS) & (F.col("level") <= k)))
        told = told.groupBy("pack").applyInArrow(_reporting(k, buckets, model), _ddl(_MESSAGE))
        replies.append(cut(told.groupBy("bucket").applyInArrow(_weighed, _ddl(_MESSAGE))))
        del told
        release(spark)
    final = _with_replies(packs, replies, ~F.col("what").isin(MINE, TOTALS))
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [rows.schema["id"].dataType.simpleString(), "boolean", "long", "long", "long", "double", "double"]
    out = final.groupBy("pack").applyInArrow(_scoring(order, buckets, model, names), ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))
    return out.withColumnRenamed("id", key)


def _with_replies(packs: DataFrame, replies: list[DataFrame], wanted: Column) -> DataFrame:
    """The packs' rows and those of their replies that are wanted, to be grouped by pack."""
    out = packs
    for r in replies:
        out = out.unionByName(r.where(wanted), allowMissingColumns=True)
    return out


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("a").to_pylist())
    return pa.table({"level": pa.array([table.column("level")[0].as_py()], pa.int32()), "a": pa.array([total.tobytes()], pa.binary())})
