"""Removal of byte strings that an earlier document holds, by sharded suffix arrays.

A byte is removed if a string of ``width`` bytes covers it that also starts in a document with a
smaller id. Strings that may repeat have to meet in one shard, so each string (window) gets a key
that its content alone decides: the least hash of its ``GRAM``-byte grams. Neighbouring windows
mostly share their key; such a run of windows is one segment of text.

0. Copies: rows whose whole text an earlier row has lose all of it and go no further.
1. Keys: each task sends the short hashes of its runs' keys, once each; a bucket finds those that
   occur in more than one document. Keys that repeat inside a task are known to at once.
   (Hash collisions here only add candidates.)
2. Segments: documents with repeated keys are packed, and packs of one task are put together; these
   send each distinct segment once, with the least id of its documents, to the shard of its key. A
   passage that a third of all documents share so costs them one segment. Nearly every shard gets
   a row from each, so they are made as large as memory allows.
3. Shards: the distinct segments of a shard are concatenated, their suffix array is induced
   (`_sais.suffix_array`), permuted common prefixes tell which neighbours share ``width`` bytes,
   and each group of equal windows has its least document. Windows with an earlier document are
   sent back to the packs, as intervals. Long stretches of one short period, which would be
   induced one character at a time, are cut to what holds all their windows before that.
4. Packs mark the windows of all their documents, and cut.

Defined results: null texts are empty; texts shorter than ``width`` lose nothing; strings are
compared on the input, so what is removed elsewhere still counts; rows that repeat an id count as
one document (a string in both stays in both); rows with a null id neither lose nor cause a loss; an
empty table gives no rows. Overlapping removed strings form one span, as do adjacent ones.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._sais import permuted_common_prefixes, suffix_array
from factloom.llm._text import give_back, mix, pieces, small_batches, utf8
from factloom.session import cut, discard, release, ship

WIDTH = 50
GRAM = 24
PACK_BYTES = 4 << 20
#: Distinct segments, and texts, that the packs put together hold.
SENT_BYTES, HELD_BYTES = 24 << 20, 64 << 20
SHARD_BYTES = 2 << 20
BUCKET_BYTES = 24 << 20
STRETCH = 1 << 15
#: Segments of so many widths hold a short period.
LONG = 8
#: So many ids are broadcast at most; beyond, their join is shuffled.
SMALL = 1_000_000
_NONE = np.iinfo(np.int64).max


def _zipped(data: bytes) -> bytes:
    return pa.Codec("zstd", 5).compress(data, asbytes=True)


def _pressed(a: np.ndarray) -> bytes:
    """An integer array as compressed planes of its bytes."""
    raw = np.ascontiguousarray(a)
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True) if len(raw) else b"\0" * 8


def _unpressed(b: bytes, kind) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def runs(data: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows of equal key: key, first window and window after the last, as
    positions in `data`; no window crosses an offset."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return np.zeros(0, np.uint64), none, none
    m = _window_keys(data, width, gram)
    # m[j] is the key of the window at j; those that cross an offset do not count
    start, end = off[:-1], off[1:]
    long = end - start >= width
    start, last = start[long], end[long] - width + 1
    if not len(start):
        return np.zeros(0, np.uint64), none, none
    new = np.zeros(n - width + 2, dtype=bool)
    new[1 : len(m)] = m[1:] != m[:-1]
    new[start] = True
    new[last] = True  # ends the last run, or starts the next document's first
    cuts = np.flatnonzero(new)
    a, b = cuts[:-1], cuts[1:]
    doc = np.searchsorted(start, a, "right") - 1
    inside = (doc >= 0) & (a < last[doc])
    a, b = a[inside], b[inside]
    return m[a], a, b


def _window_keys(data: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The least gram hash of each window, computed in stretches that fit a processor's cache."""
    n = len(data) - width + 1
    out = np.empty(n, dtype=np.uint64)
    span = width - gram + 1
    for a in range(0, n, STRETCH):
        m, step = _gram_hashes(data[a : a + STRETCH + width - 1], gram), 1
        while step * 2 <= span:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < span:
            m = np.minimum(m[: len(m) - (span - step)], m[span - step :])
        out[a : a + STRETCH] = m
    return out


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    size = (len(data) + 8) // 8 * 8
    padded = np.zeros(size + 8, np.uint8)
    padded[: len(data)] = data
    w = np.empty(size, np.uint64)
    for k in range(8):
        w[k::8] = padded[k : k + size].view(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, gram, 8):
            at = min(k, gram - 8)
            h ^= w[at : at + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return mix(h)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _short(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _split(group: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(group, kind="stable")
    g = group[order]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return [(int(g[a]), order[a:b]) for a, b in zip(at, np.append(at[1:], len(g)))]


def repeated_runs(texts: DataFrame, buckets: int, width: int, gram: int) -> DataFrame:
    """(id, n, runs): for documents, the ordinals of their runs whose key other documents have too."""

    def emit(held):
        """Rows of one task: a row for each bucket, and what is known to repeat."""
        key, doc, run = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, key))
        k, d = key[order], doc[order]
        first = np.append(True, k[1:] != k[:-1])
        group = np.cumsum(first) - 1
        many = np.zeros(group[-1] + 1, dtype=bool)
        many[group[1:][(d[1:] != d[:-1]) & ~first[1:]]] = True
        multi = np.zeros(len(key), dtype=bool)
        multi[order] = many[group]
        lead = order[first]  # one occurrence of each key stands for the task
        known = np.flatnonzero(multi)
        for b, at in _split(_bucket(key[lead], buckets)):
            i = np.sort(lead[at])
            yield (b, 0, _pressed(_short(key[i])), _pressed(np.diff(doc[i], prepend=0)), _pressed(run[i]), b"")
        del order, k, d, group
        if len(known):
            for b, at in _split(doc[known] // 64 % buckets):
                i = known[at]
                i = i[np.lexsort((run[i], doc[i]))]
                yield (b, 1, b"", _pressed(np.diff(doc[i], prepend=0)), _pressed(run[i]), b"")
        # other occurrences of a key in the same document as its lead repeat if it does
        rest = np.ones(len(key), dtype=bool)
        rest[lead] = False
        rest &= ~multi
        for b, at in _split(_bucket(key[rest], buckets)):
            i = np.flatnonzero(rest)[at]
            yield (b, 2, _pressed(_short(key[i])), _pressed(np.diff(doc[i], prepend=0)), _pressed(run[i]), b"")

    names = ["bucket", "kind", "keys", "docs", "runs", "none"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), *[pa.binary()] * 4])], names=names)

    def collect(batches):
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                ids = part.column(0)
                data, off = utf8(part.column(1))
                key, a, _ = runs(data, off, width, gram)
                if not len(key):
                    continue
                doc = np.searchsorted(off, a, "right") - 1
                run = (np.arange(len(a)) - np.searchsorted(doc, doc, "left")).astype(np.uint32)
                held.append((key, ids.to_numpy(zero_copy_only=False).astype(np.int64)[doc], run))
                size += len(key)
                if size > 3_000_000:
                    yield batch_of(list(emit(held)))
                    held, size = [], 0
        if held:
            yield batch_of(list(emit(held)))
        give_back()

    def find(table: pa.Table) -> pa.Table:
        """Of one bucket: the runs whose key more than one task has, and those known before."""
        key, doc, run, lead, found = [], [], [], [], []
        for r in table.to_pylist():
            d, u = np.cumsum(_unpressed(r["docs"], np.int64)), _unpressed(r["runs"], np.uint32)
            if r["kind"] == 1:
                found.append((d, u))
                continue
            key.append(_unpressed(r["keys"], np.uint32))
            doc.append(d)
            run.append(u)
            lead.append(np.full(len(d), r["kind"] == 0))
        if key:
            key, doc, run, lead = (np.concatenate(x) for x in (key, doc, run, lead))
            order = np.lexsort((doc, key))
            k, d = key[order], doc[order]
            first = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            many = np.zeros(int(first.sum()), dtype=bool)
            # documents differ, or it is one document in rows of several tasks: a candidate either way
            same = ~first[1:] & ((d[1:] != d[:-1]) | (lead[order][1:] & lead[order][:-1]))
            many[group[1:][same]] = True
            at = order[many[group]] if len(k) else order
            found.append((doc[at], run[at]))
        parts, a, b = [], [], []
        if found:
            doc, run = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            for part, at in _split(doc // 64 % buckets):
                at = at[np.lexsort((run[at], doc[at]))]
                parts.append(part)
                a.append(_pressed(np.diff(doc[at], prepend=0)))
                b.append(_pressed(run[at]))
        return pa.table({"part": pa.array(parts, pa.int32()), "docs": pa.array(a, pa.binary()), "runs": pa.array(b, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        """What all buckets found for some documents, a row for each of these."""
        doc = np.concatenate([np.cumsum(_unpressed(x, np.int64)) for x in table.column("docs").to_pylist()])
        run = np.concatenate([_unpressed(x, np.uint32) for x in table.column("runs").to_pylist()])
        ids, sizes, lists = [], [], []
        for i, at in _split_ids(doc):
            own = np.unique(run[at])
            ids.append(i)
            sizes.append(len(own))
            lists.append(_pressed(own))
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "runs": pa.array(lists, pa.binary())})

    sent = texts.where("id is not null").select("id", "text").mapInArrow(collect, "bucket int, kind int, keys binary, docs binary, runs binary, none binary")
    found = sent.groupBy("bucket").applyInArrow(find, "part int, docs binary, runs binary")
    return found.groupBy("part").applyInArrow(gather, "id long, n long, runs binary")


def _split_ids(doc: np.ndarray):
    order = np.argsort(doc, kind="stable")
    g = doc[order]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    for a, b in zip(at, np.append(at[1:], len(g))):
        yield int(g[a]), order[a:b]


def packed(rows: DataFrame, shards: int, width: int, gram: int) -> DataFrame:
    """From (id, compressed text, its size, runs): finished rows of documents without repeated keys (kind 0),
    packs of the others put together (kind 1), and their segments by shard (kind 2)."""
    names = ["kind", "pack", "shard", "id", "n_bytes", "sha", "text", "a", "b", "c"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    class Together:
        """Packs and their distinct segments."""

        def __init__(self):
            self.number: dict[bytes, int] = {}
            self.least: list[int] = []
            self.keys: list[int] = []
            self.packs: list[tuple] = []
            self.sent = self.held = 0
            self.name = hashlib.blake2b(digest_size=16)

        def add(self, ids, texts, flags):
            raw = b"".join(texts)
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            key, a, b = runs(np.frombuffer(raw, np.uint8), off, width, gram)
            doc = np.searchsorted(off, a, "right") - 1
            begin = np.searchsorted(doc, np.arange(len(ids)), "left")
            use = np.zeros(len(key), dtype=bool)
            for i, f in enumerate(flags):
                end = begin[i + 1] if i + 1 < len(begin) else len(key)
                f = begin[i] + f.astype(np.int64)
                use[f[f < end]] = True
            at = np.flatnonzero(use)
            self.name.update(b"".join(map(str.encode, map(str, ids))) + hashlib.sha256(raw).digest())
            # segments of equal content are one, with the least document
            seg = np.empty(len(at), dtype=np.int32)
            number, least = self.number, self.least
            for k, (i, j, d, h) in enumerate(zip(a[at].tolist(), b[at].tolist(), doc[at].tolist(), key[at].tolist())):
                content = raw[i : j + width - 1]
                x = number.get(content)
                if x is None:
                    x = number[content] = len(number)
                    least.append(ids[d])
                    self.keys.append(h)
                    self.sent += len(content)
                elif ids[d] < least[x]:
                    least[x] = ids[d]
                seg[k] = x
            self.held += len(raw)
            self.packs.append((_zipped(raw), _pressed(np.array(ids, dtype=np.int64)), _pressed(np.diff(off)), _pressed(a[at].astype(np.int64)), _pressed((b[at] - a[at]).astype(np.int32)), seg))

        def rows(self):
            name, least = uuid.UUID(bytes=self.name.digest()).hex, np.array(self.least, np.int64)
            contents = list(self.number)
            if contents:
                shard = (mix(np.array(self.keys, np.uint64)) % np.uint64(shards)).astype(np.int64)
                rows = []
                for s, j in _split(shard):
                    blob = b"".join(contents[x] for x in j.tolist())
                    sizes = np.array([len(contents[x]) for x in j.tolist()], np.int32)
                    rows.append((2, name, s, None, len(blob), None, _zipped(blob), _pressed(sizes), _pressed(least[j]), _pressed(j.astype(np.int32))))
                    if len(rows) == 1000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)
            texts, ids, lengths, first, count, seg = zip(*self.packs)
            more = [_joined_bytes([f, n, _pressed(x), _pressed(least[x])]) for f, n, x in zip(first, count, seg)]
            yield out([(1, name, None, None, self.held, None, *map(_joined_bytes, (texts, ids, lengths, more)))])

    def collect(batches):
        ids, texts, flags, size, packs = [], [], [], 0, Together()
        for batch in batches:
            done = []
            for part in pieces(batch, "text", 1 << 20):
                for r in part.to_pylist():
                    text = pa.decompress(r["text"], decompressed_size=r["size"], codec="zstd", asbytes=True) if r["size"] else b""
                    if not r["runs"]:
                        done.append((0, None, None, r["id"], len(text), hashlib.sha256(text).hexdigest(), None, None, None, None))
                        continue
                    ids.append(r["id"])
                    texts.append(text)
                    flags.append(_unpressed(r["runs"], np.uint32))
                    size += len(text)
                    if size >= PACK_BYTES:
                        packs.add(ids, texts, flags)
                        ids, texts, flags, size = [], [], [], 0
                        if packs.sent >= SENT_BYTES or packs.held >= HELD_BYTES:
                            yield from packs.rows()
                            packs = Together()
            if done:
                yield out(done)
        if ids:
            packs.add(ids, texts, flags)
        if packs.packs:
            yield from packs.rows()
        give_back()

    return rows.select("id", "text", "size", "runs").mapInArrow(collect, "kind int, pack string, shard int, id long, n_bytes long, sha string, text binary, a binary, b binary, c binary")


def _joined_bytes(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 8], "little")
        out.append(b[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def least_holders(segments: np.ndarray, sizes: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """For concatenated segments, at each position the least document of the segments that hold
    the window that starts there (a large number where none does)."""
    n = len(segments)
    t = np.ones(n + len(sizes) + 1, dtype=np.uint16)
    moved = np.arange(n, dtype=np.int32) + np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    t[moved] = segments.astype(np.uint16) + 2
    t[-1] = 0
    sa = suffix_array(t, 258)
    new = permuted_common_prefixes(t, sa)[sa] < width
    new[0] = True
    doc = np.full(len(t), _NONE)
    doc[moved] = np.repeat(least, sizes)
    first = np.minimum.reduceat(doc[sa], np.flatnonzero(new))
    found = np.empty(len(t), dtype=np.int64)
    found[sa] = first[np.cumsum(new) - 1]
    ends = np.cumsum(sizes)
    return np.where(np.repeat(ends - width, sizes) >= np.arange(n), found[moved], _NONE)


def squeezed(segment: bytes, width: int, most: int) -> tuple[bytes, list[list[tuple[int, int, int]]]]:
    """The segment with long stretches of a period of 1 to `most` bytes cut, keeping each of its
    windows of `width` bytes; and per step the cuts (c, p, k): k periods of p bytes gone at c."""
    d, steps = np.frombuffer(segment, np.uint8), []
    for p in range(1, most + 1):
        if len(d) < LONG * width:
            break
        edge = np.flatnonzero(np.diff(np.concatenate([[False], d[p:] == d[:-p], [False]]).astype(np.int8)))
        a, size = edge[::2], edge[1::2] - edge[::2] + p
        k = (size - 2 * width - p) // p
        cuts = [(a_ + width + p, p, k_) for a_, k_ in zip(a[k > 0].tolist(), k[k > 0].tolist())]
        if not cuts:
            continue
        kept, at, gone, step = [], 0, 0, []
        for c, p_, k_ in cuts:
            kept.append(d[at:c])
            at = c + k_ * p_
            step.append((c - gone, p_, k_))
            gone += k_ * p_
        d = np.concatenate([*kept, d[at:]])
        steps.append(step)
    return d.tobytes(), steps


def unsqueezed(flags: np.ndarray, steps: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Flags of a squeezed segment's positions as flags of the segment's own."""
    for step in reversed(steps):
        parts, at = [], 0
        for c, p, k in step:
            parts += [flags[at:c], np.tile(flags[c - p : c], k)]
            at = c
        flags = np.concatenate([*parts, flags[at:]])
    return flags


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _shard(width: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        # segments of equal content are one, with the least document of all packs
        number: dict[bytes, int] = {}
        packs = []
        for i in range(table.num_rows):
            p, x, n, s, m, j = (table.column(c)[i].as_py() for c in ("pack", "text", "n_bytes", "a", "b", "c"))
            blob = pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True)
            ends = np.cumsum(_unpressed(s, np.int32)).tolist()
            own = np.fromiter((number.setdefault(blob[a:b], len(number)) for a, b in zip([0, *ends], ends)), np.int64, len(ends))
            packs.append((p, own, _unpressed(m, np.int64), _unpressed(j, np.int32)))
        least = np.full(len(number), _NONE)
        for _, own, m, _ in packs:
            np.minimum.at(least, own, m)
        contents, steps = [], {}
        for i, c in enumerate(number):
            if len(c) >= LONG * width:
                c, steps[i] = squeezed(c, width, width - gram + 1)
            contents.append(c)
        del number
        sizes = np.fromiter(map(len, contents), np.int64, len(contents))
        holder = least_holders(np.frombuffer(b"".join(contents), np.uint8), sizes, least, width)
        del contents
        start = np.cumsum(sizes) - sizes
        out_pack, out_at = [], []
        for p, own, m, index in packs:
            size = sizes[own]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            seg = np.repeat(np.arange(len(own)), size)
            hit = np.flatnonzero(holder[start[own][seg] + at] < m[seg])
            long_ = np.array([o in steps for o in own.tolist()], dtype=bool)
            usual = hit[~long_[seg[hit]]]
            which, first, count = [], [], []
            if len(usual):
                lead = np.flatnonzero(np.append(True, (np.diff(usual) != 1) | (np.diff(seg[usual]) != 0)))
                which.append(seg[usual[lead]])
                first.append(at[usual[lead]])
                count.append(np.diff(np.append(lead, len(usual))))
            for k in np.unique(seg[hit[long_[seg[hit]]]]).tolist():
                o = own[k]
                flags = unsqueezed(holder[start[o] : start[o] + sizes[o]] < m[k], steps[o])
                a, n = _intervals(flags)
                which.append(np.full(len(a), k))
                first.append(a)
                count.append(n)
            if which:
                which = np.concatenate(which)
                out_pack.append(p)
                out_at.append(_joined_bytes([_pressed(index[which]), _pressed(np.concatenate(first).astype(np.int32)), _pressed(np.concatenate(count).astype(np.int32))]))
        give_back()
        return pa.table({"pack": pa.array(out_pack, pa.string()), "hits": pa.array(out_at, pa.binary())})

    return run


def _whole(gone: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The removed bytes but for those of characters that are not removed whole."""
    if not len(data):
        return gone
    start = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(np.logical_and.reduceat(gone, start), np.diff(np.append(start, len(data))))


def _marked(width: int, keep_text: bool):
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["crc", "kept"] if keep_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.int64(), pa.string()] if keep_text else [])]

    def mark(text, ids, lengths, more, hits):
        """The rows of one pack; hits are segments of the packs with it, and windows in them."""
        ids, lengths = _unpressed(ids, np.int64), _unpressed(lengths, np.int64)
        first, count, seg, least = (_unpressed(p, k) for p, k in zip(_parts(more), (np.int64, np.int32, np.int32, np.int64)))
        off = np.concatenate([[0], np.cumsum(lengths)])
        raw = pa.decompress(text, decompressed_size=int(off[-1]), codec="zstd", asbytes=True) if off[-1] else b""
        doc = np.searchsorted(off, first, "right") - 1
        # windows of a segment that an earlier document of these packs holds too
        sure = ids[doc] > least
        window = np.zeros(len(raw) + 1, dtype=np.int32)
        np.add.at(window, first[sure], 1)
        np.add.at(window, first[sure] + count[sure], -1)
        window = np.cumsum(window)[:-1] > 0 if len(raw) else np.zeros(0, bool)
        if hits:
            s, at, size = hits
            lo, hi = np.searchsorted(s, seg), np.searchsorted(s, seg, "right")
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = np.repeat(first, n) + at[which]
            found = np.zeros(len(raw) + 1, dtype=np.int32)
            np.add.at(found, begin, 1)
            np.add.at(found, begin + size[which], -1)
            window |= np.cumsum(found)[:-1] > 0
        cover = np.zeros(len(raw) + 1, dtype=np.int32)
        w = np.flatnonzero(window)
        cover[w] += 1
        np.add.at(cover, w + width, -1)
        gone = np.cumsum(cover)[:-1] > 0
        data = np.frombuffer(raw, np.uint8)
        rows = []
        for i, d in enumerate(ids.tolist()):
            g = gone[off[i] : off[i + 1]]
            kept = data[off[i] : off[i + 1]][~g].tobytes()
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (1 if len(g) and g[0] else 0))
            more = []
            if keep_text:
                own = data[off[i] : off[i + 1]]
                more = [zlib.crc32(own.tobytes()), own[~_whole(g, own)].tobytes().decode()]
            rows.append((d, len(g), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), *more))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                hits = [_parts(h) for h in r["hits"] or []]
                if hits:
                    hits = [np.concatenate([_unpressed(h[k], np.int32) for h in hits]) for k in range(3)]
                    order = np.argsort(hits[0], kind="stable")
                    hits = [h[order] for h in hits]
                for pack in zip(*map(_parts, (r["text"], r["a"], r["b"], r["c"]))):
                    yield mark(*pack, hits)
        give_back()

    return run


def _smaller(batches):
    """Texts compressed, to be shuffled."""
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_zipped(t) if t else b"" for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "text", "size"])


def _copies(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose whole text an earlier document has (all of it goes), and the other rows."""
    h = lambda salt: F.xxhash64(F.lit(salt), "text")
    own = texts.where(F.col("id").isNotNull() & (F.octet_length("text") >= width)).select("id", h(1).alias("h1"), h(2).alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    own = cut(own)
    several = own.groupBy("h1", "h2").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m <> x").select("h1", "h2", "m")
    several = cut(several)
    if several.count() <= SMALL:  # a very common text is then no task's alone
        several = F.broadcast(several)
    copies = cut(own.join(several, ["h1", "h2"]).where("id <> m").select("id", "h1", "n_bytes", "crc"))
    discard(own)
    ids = copies.select(F.col("id").alias("_i"), F.col("h1").alias("_h")).distinct()
    if copies.count() <= SMALL:
        ids = F.broadcast(ids)
    return copies, texts.join(ids, (F.col("id") == F.col("_i")) & (h(1) == F.col("_h")), "left_anti")


def repeats_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256. With `keep_text` also, for rows that
    lose something, the text's crc32 (crc) and what is left of it (kept): there a character
    that is not removed whole stays."""
    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    copies, texts = _copies(texts, width)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = max(parts, total // BUCKET_BYTES)
    flags = cut(repeated_runs(texts, buckets, width, gram))
    release(spark)
    n = flags.agg(F.sum("n")).collect()[0][0] or 0
    shards = int(max(parts, n * (width + 13) // 2 // SHARD_BYTES))
    f = flags.select(F.col("id").alias("_id"), "runs")
    small = texts.mapInArrow(_smaller, "id long, text binary, size long")
    rows = small.join(f, small["id"] == f["_id"], "left")
    made = cut(packed(rows, shards, width, gram))
    discard(flags)
    release(spark)
    hits = made.where("kind = 2").select("shard", "pack", "text", "n_bytes", "a", "b", "c").groupBy("shard").applyInArrow(_shard(width, gram), "pack string, hits binary")
    hits = cut(hits.groupBy("pack").agg(F.collect_list("hits").alias("hits")))
    packs = made.where("kind = 1").select("pack", "text", "n_bytes", "a", "b", "c").join(hits, "pack", "left")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", crc long, kept string" if keep_text else "")
    done = made.where("kind = 0").select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), *([F.lit(None).cast("long").alias("crc"), F.lit(None).cast("string").alias("kept")] if keep_text else []))
    empty = hashlib.sha256(b"").hexdigest()
    done = done.unionByName(copies.select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), *([F.col("crc"), F.lit("").alias("kept")] if keep_text else [])))
    return done.unionByName(packs.mapInArrow(_marked(width, keep_text), schema)).withColumnRenamed("id", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """`docs` with its texts less the strings that an earlier document holds (in whole
    characters); rows of which nothing is left go."""
    lost = repeats_removed(docs, key, text, width, gram, keep_text=True).where("n_removed > 0")
    lost = lost.groupBy(F.col(key).alias("id"), "crc", "n_bytes").agg(F.first("kept").alias("kept"))
    # the rows travel as one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    mine = F.col("row").getField(text)
    own = (F.col("row").getField(key).cast("long") == F.col("id")) & (F.crc32(mine.cast("binary")) == F.col("crc")) & (F.octet_length(mine) == F.col("n_bytes"))
    out = rows.join(lost, own, "left").where("kept is null or kept <> ''")
    return out.select(*[(F.coalesce("kept", mine) if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
