"""Prefix trees of conversations, level by level.

At every depth the live conversations are grouped by (parent node, next turn), and the least conv_id
of a group names its node: a join and a grouping with partial sums on light rows (ids, 16-byte digests
of turns, byte counts), however large a group is. A conversation that is alone in its node is settled:
the rest of its path is a chain. A node below which few turns are left is finished in one task, many of
them at once, by the same steps on arrays; larger ones go on to the next level. Then joins from the
deepest level back to the root roll up children, leaves and savings.

Nulls: rows with a null conv_id belong to no conversation; a null turn comes first; a null role or
text is empty. Turns of one number are ordered as `_turns.tie_keys` says; rows that repeat are turns
of their own. Conversations may be of any length and texts are digested whole. An empty table has no
nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._text import give_back, utf8
from factloom.llm._turns import chains, ordered, partition
from factloom.session import cut, release, ship

#: Turns below a node up to which it is finished in one task: at depth 8 or above it, and doubled by
#: each depth beyond, to 1,024,000 at most. So the wide levels near the root are always dealt out,
#: and long shared paths don't take a job for each of their turns.
LOCAL_ROWS, LOCAL_DEPTH, DOUBLINGS = 500, 8, 11
#: Rows that a task works on at once where its nodes are small.
PACK_ROWS = 200_000
#: Nodes of a settled chain made from one row, and bytes of joined ids that are one.
CHAIN, PIECE = 4096, 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "kind int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ARROW = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def positions(turns: DataFrame) -> DataFrame:
    """Of each turn conv_id, pos (from 0, within its conversation), key (digest of role and text) and
    n_bytes of the text. Conversations may cross partitions: rows before a border are counted."""
    spark = turns.sparkSession
    ship(spark)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    key = F.unhex(F.md5(F.concat_ws("\u0000", F.length("role").cast("string"), "role", "text").cast("binary")))
    rows = ordered(rows, F.lit(64), ["conv_id", key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes")])

    def borders(batches):
        ends, runs = [], 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1, [len(conv)]])
            for a, b in zip(cuts, cuts[1:]) if len(cuts) < 4 else ((0, cuts[1]), (cuts[1], cuts[-2]), (cuts[-2], cuts[-1])):
                if ends and ends[-1][0] == conv[a]:
                    ends[-1][1] += int(b - a)
                else:
                    ends = [*ends[:1], [int(conv[a]), int(b - a)]]
                    runs += 1
        if ends:
            yield pa.RecordBatch.from_pydict({"part": [partition()] * len(ends), "conv_id": [e[0] for e in ends], "n": [e[1] for e in ends]})

    # two rows a partition at most, the first before the last
    found = [r for _, r in sorted(enumerate(rows.select("conv_id").mapInArrow(borders, "part long, conv_id long, n long").collect()), key=lambda r: (r[1].part, r[0]))]
    before: dict[int, int] = {}
    for chain in chains(found):
        n = 0
        for seg in chain:
            before[seg.part] = n if n else before.get(seg.part, 0)
            n += seg.n
    shared = spark.sparkContext.broadcast(before)

    def placed(batches):
        last, at = None, shared.value.get(partition(), 0)
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            index = np.arange(len(conv))
            first = np.concatenate([[last is not None and conv[0] != last], np.diff(conv) != 0])
            start = np.maximum.accumulate(np.where(first, index, -1))
            pos = np.where(start < 0, index + at, index - start)
            last, at = conv[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos, pa.int64()), *batch.columns[1:]], names=["conv_id", "pos", "key", "n_bytes"])

    return rows.mapInArrow(placed, "conv_id long, pos long, key binary, n_bytes long")


def tree(turns: DataFrame) -> DataFrame:
    """The nodes of the conversations as they stand."""
    rows = cut(positions(turns))
    return nodes(rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "n_bytes"), rows.groupBy("conv_id").agg(F.count("*").alias("length")))


def rebuilt(turns: DataFrame, lead: int = 9, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the last conversation before (or at) them whose
    id is divisible by `every`; h is the checksum of the id modulo `lead`. What `nodes` takes."""
    rows = cut(positions(turns))
    lengths = rows.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % lead
    lengths = cut(lengths.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    led = F.least("h", F.coalesce("there", F.lit(0)))
    members = cut(lengths.join(bases, "base", "left").select("conv_id", "base", "h", led.alias("led"), (led + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    first = rows.where((F.col("pos") < lead) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    first = first.join(members.where("led > 0"), "base").where("pos < led").select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "n_bytes")
    rest = rows.join(members.select("conv_id", "h", "led"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("led") + 1).alias("depth"), "key", "n_bytes")
    return cut(rest.unionByName(first)), members.select("conv_id", "length")


def _limit(depth: int) -> int:
    return LOCAL_ROWS << min(max(depth - LOCAL_DEPTH, 0), DOUBLINGS)


def nodes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """All nodes, from turns (conv_id, depth from 1, key, n_bytes) and conversations (conv_id, length):
    conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (of
    the subtree) and ends_sha256, of the ids of those that end there. Both tables are read many times."""
    spark = rows.sparkSession
    ship(spark)
    root = members.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).first()
    if not root.n:
        return spark.createDataFrame([], _NODE).select(*COLUMNS)
    live = members.select("conv_id", F.lit(root.node).alias("parent"), "length")
    levels, local, ends = [], [], [live.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.col("parent").alias("node"), "conv_id")]
    left, size, depth = rows, None, 0
    while True:  # down, a depth at a time
        depth += 1
        turn = cut(left.where(F.col("depth") == depth).join(live, "conv_id").select("parent", "key", "n_bytes", "conv_id", "length"))
        group = turn.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.sum(F.col("length") - depth).alias("below"))
        group = cut(group.withColumn("live", (F.col("n_convs") > 1) & (F.col("below") > _limit(depth))))
        n = group.agg(F.count("*").alias("all"), F.count_if("live").alias("live"), F.sum(F.when(F.col("live"), F.col("below")).otherwise(0)).alias("below"), F.sum("below").alias("size")).first()
        if not n.all:
            break
        levels.append(group)
        joined = cut(turn.join(group.where("n_convs > 1").select("parent", "key", "node", "live"), ["parent", "key"]).select("conv_id", "node", "length", "live"))
        ends.append(joined.where(F.col("length") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        local.append(joined.where(~F.col("live") & (F.col("length") > depth)).select("conv_id", F.lit(depth).cast("long").alias("top"), "node"))
        if not n.live:
            break
        live = joined.where(F.col("live") & (F.col("length") > depth)).select("conv_id", F.col("node").alias("parent"), "length")
        size = n.size if size is None else size
        if 2 * n.below < size:  # settled turns are not read again
            left, size = cut(left.where(F.col("depth") > depth).join(live.select("conv_id"), "conv_id", "left_semi")), n.below
        release(spark)
    inner = _local(rows, local)
    return _rolled_up(spark, root, levels, inner, ends)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _local(rows: DataFrame, tops: list[DataFrame]) -> DataFrame | None:
    """Everything below nodes with few turns: nodes (kind 0), and for the tops (kind 1) what is below."""
    if not tops:
        return None
    below = rows.join(_union(tops), "conv_id").where(F.col("depth") > F.col("top")).select("top", "node", "depth", "conv_id", "key", "n_bytes")
    below = below.repartition("top", "node").sortWithinPartitions("top", "node")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACK_ROWS:
                table = pa.Table.from_batches(held)
                top, node = (table.column(i).to_numpy() for i in range(2))
                change = np.flatnonzero((np.diff(top) != 0) | (np.diff(node) != 0))
                if len(change):
                    end = int(change[-1]) + 1
                    yield from _grown(table.slice(0, end))
                    held, size = table.slice(end).to_batches(), table.num_rows - end
        if size:
            yield from _grown(pa.Table.from_batches(held))
        give_back()

    return cut(below.mapInArrow(run, _NODE))


def _grown(table: pa.Table):
    """The subtrees of a table's tops, grown depth by depth for all of them at once."""
    top, of, depth, conv = (table.column(i).to_numpy() for i in range(4))
    keys = utf8(table.column(4))[0].view(np.uint64).reshape(-1, 2)
    size = table.column(5).to_numpy()
    tops = np.concatenate([[0], np.flatnonzero((np.diff(top) != 0) | (np.diff(of) != 0)) + 1])
    group = np.zeros(len(top), np.int64)
    group[tops[1:]] = 1
    group = np.cumsum(group)
    order = np.lexsort((conv, group))
    first = np.concatenate([[True], (np.diff(conv[order]) != 0) | (np.diff(group[order]) != 0)])
    member = np.empty(len(top), np.int64)
    member[order] = np.cumsum(first) - 1
    at = group[order][first].copy()  # by conversation, its node: first the top
    n = len(tops)
    made = [(top[tops], of[tops], np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64))]
    by_depth = np.argsort(depth - top, kind="stable")
    cuts = np.searchsorted((depth - top)[by_depth], np.arange(1, int((depth - top).max()) + 2))
    spans = [(0, n)]
    for a, b in zip(cuts, cuts[1:]):
        rows = by_depth[a:b]
        parent = at[member[rows]]
        o = np.lexsort((conv[rows], keys[rows, 1], keys[rows, 0], parent))
        rows, parent = rows[o], parent[o]
        new = np.concatenate([[True], (np.diff(parent) != 0) | (keys[rows][1:] != keys[rows][:-1]).any(1)])
        start = np.flatnonzero(new)
        at[member[rows]] = n + np.cumsum(new) - 1
        made.append((depth[rows[start]], conv[rows[start]], parent[start], np.diff(np.append(start, len(rows))), size[rows[start]]))
        spans.append((n, n + len(start)))
        n += len(start)
    deep, least, parent, count, last = (np.concatenate(x) for x in zip(*made))
    children, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), (count - 1) * last
    saved[: len(tops)] = 0  # the tops' own savings are added with their turn
    for a, b in spans[:0:-1]:
        leaves[a:b] += children[a:b] == 0
        np.add.at(children, parent[a:b], 1)
        np.add.at(leaves, parent[a:b], leaves[a:b])
        np.add.at(saved, parent[a:b], saved[a:b])
    ids = conv[order][first]
    end = np.lexsort((ids, at))
    sha = np.full(n, EMPTY, dtype=object)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(at[end])) + 1, [len(end)]])
    for a, b in zip(edges, edges[1:]):
        sha[at[end[a]]] = hashlib.sha256(",".join(map(str, ids[end[a:b]].tolist())).encode()).hexdigest()
    kind = (np.arange(n) < len(tops)).astype(np.int32)
    up = pa.array(np.where(parent < 0, 0, least[parent]), mask=parent < 0)
    out = pa.RecordBatch.from_arrays([pa.array(kind), pa.array(deep), pa.array(least), up, *map(pa.array, (count, children, leaves, saved)), pa.array(sha, pa.string())], schema=_ARROW)
    for a in range(0, n, 10_000):
        yield out.slice(a, 10_000)


def _digests(ends: DataFrame) -> DataFrame:
    """The SHA-256 of the ids that end in each node, ascending: joined in ranges first, so that a
    node in which a third of all conversations end comes to its last task in few long pieces."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["depth", "node", "conv_id"]
    ranges = ends.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def joined(batches):
        now, held, size = None, [], 0
        for batch in batches:
            for depth, node, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now is None or now[:2] != (depth, node) or size > PIECE:
                    if held:
                        yield _row(now, held)
                    now, held, size = (depth, node, conv), [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield _row(now, held)

    def _row(now, held):
        return pa.RecordBatch.from_pydict({"depth": [now[0]], "node": [now[1]], "first": [now[2]], "piece": [",".join(held)]})

    def digested(batches):
        now, sha = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if now != (r["depth"], r["node"]):
                    if now:
                        yield pa.RecordBatch.from_pydict({"depth": [now[0]], "node": [now[1]], "sha": [sha.hexdigest()]})
                    now, sha = (r["depth"], r["node"]), hashlib.sha256(r["piece"].encode())
                else:
                    sha.update(b"," + r["piece"].encode())
        if now:
            yield pa.RecordBatch.from_pydict({"depth": [now[0]], "node": [now[1]], "sha": [sha.hexdigest()]})

    pieces = ranges.mapInArrow(joined, "depth long, node long, first long, piece string").repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return pieces.mapInArrow(digested, "depth long, node long, sha string")


def _rolled_up(spark, root, levels: list[DataFrame], inner: DataFrame | None, ends: list[DataFrame]) -> DataFrame:
    """Back up, a depth at a time: children, leaves and savings of every node dealt by Spark."""
    below, done = None, []
    for depth in range(len(levels), 0, -1):
        tops = inner.where((F.col("kind") == 1) & (F.col("depth") == depth)).select(F.col("conv_id").alias("node"), F.col("n_children").alias("k"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
        # a node is live or finished in a task, so it is in one of the two
        sums = tops if below is None else tops.unionByName(below)
        alone = F.col("n_convs") == 1
        level = levels[depth - 1].join(sums, "node", "left").select(
            F.lit(depth).cast("long").alias("depth"), "node", "parent", "n_convs", "below",
            F.when(alone, (F.col("below") > 0).cast("long")).otherwise(F.coalesce("k", F.lit(0))).alias("k"), F.coalesce("l", F.lit(1)).alias("l"),
            ((F.col("n_convs") - 1) * F.col("n_bytes") + F.coalesce("s", F.lit(0))).alias("s"),
        )
        done.append(cut(level))
        below = done[-1].groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k"), F.sum("l").alias("l"), F.sum("s").alias("s"))
    top = spark.createDataFrame([(0, root.node, root.n)], "depth long, node long, n_convs long")
    none = spark.createDataFrame([], "node long, k long, l long, s long")
    top = top.join(below if below is not None else none, "node", "left").select("depth", "node", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(1).cast("long").alias("below"), F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("l", F.lit(1)).alias("l"), F.coalesce("s", F.lit(0)).alias("s"))
    dealt = _union([top, *done])
    shared = dealt.where("n_convs > 1 or depth = 0").join(_digests(_union(ends)), ["depth", "node"], "left")
    shared = shared.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("k").alias("n_children"), F.col("l").alias("n_leaves"), F.col("s").alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))
    # settled paths, in two steps so that no row holds a whole long one
    chain = dealt.where("n_convs = 1 and depth > 0").select("node", "parent", "depth", (F.col("depth") + F.col("below")).alias("end"))
    chain = chain.withColumn("a", F.explode(F.sequence("depth", "end", F.lit(CHAIN).cast("long")))).withColumn("d", F.explode(F.sequence("a", F.least(F.col("a") + CHAIN - 1, "end"))))
    last = F.col("d") == F.col("end")
    one = F.lit(1).cast("long")
    chain = chain.select(
        F.col("node").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("depth"), F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("node").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    out = shared.unionByName(chain)
    return out if inner is None else out.unionByName(inner.where("kind = 0").select(*COLUMNS))
