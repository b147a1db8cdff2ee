"""Conversation structure repair: the cheapest edits that make roles alternate, by a dynamic
program over macro edits whose audit strings are never built while it runs.

A macro edit is a run of inserts and then what becomes of one turn: `I`* followed by K(eep),
R(erole) or D(elete). These codes are prefix-free, so strings of equally many of them compare like
the sequences of their ranks. A layer holds, for each of the four states of `(s?(ua)+)?` that a
prefix of the conversation can be in (nothing, s, u, a), the least cost and the *rank* of its
audit among the layer's; the audit is found afterwards through parent pointers. Costs less their
least and ranks are few in kind, so layers are looked up and not computed, row by row.

Conversations may be longer than a partition. A segment of one is a map from the state it is
entered in to the layer it is left with; such maps are put together in order (cost by sum, audits
by the rank before and then the rank within), two for each partition, on the driver. Then every
segment knows its first and last state and is retraced where it lies.

Nulls: a null conv_id is a conversation, a null turn comes first, a null role or text is one space.
Rows of one turn are ordered as `_turns.tie_keys` says. Rows that repeat are duplicates. Empty
tables give no rows; columns besides those named are not read. Texts are handled whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._text import give_back, small_batches
from factloom.llm._turns import chains, ordered, partition
from factloom.session import cut, ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NOTHING, S, U, A = range(4)
_CODES = sorted("I" * k + e for k in range(3) for e in "KRD")
_INSERTED = {NOTHING: U, S: U, U: A, A: U}
_ROLE = {U: "user", A: "assistant"}
#: From a state to the end: cost and inserts.
_FINISH = {NOTHING: (0, ""), S: (2 * INSERT, "II"), U: (INSERT, "I"), A: (0, "")}
_INITIALS = "sua"
_GONE, _BLANK, _DUPLICATE, _CUT, _GOOD = range(5)
_SPACES = " \t\n\x0b\x0c\r"
#: (conversation, role and text) pairs that come in several turns are broadcast up to so many.
BROADCAST_REPEATS = 1_000_000
CHUNK = 1 << 20


def _after(state: int, initial: str) -> int | None:
    """The state after a turn whose role begins with `initial`, or None if that is not allowed."""
    if initial == "s":
        return S if state == NOTHING else None
    if initial == "u":
        return U if state != U else None
    return A if initial == "a" and state == U else None


def _moves(forced: bool, truncated: bool, initial: str) -> list[tuple[int, int, int, int]]:
    """(state before, state after, cost, code) of all macro edits of a turn. More than two inserts in
    a row come back to a state already left, at a higher cost."""
    out = []
    for first in range(4):
        state, code, cost = first, "", 0
        for _ in range(3):
            ends = [("D", state, DELETE)]
            if not forced:
                more = TRUNCATED if truncated else 0
                ends += [("K", _after(state, initial), KEEP + more), ("R", A if state == U else U, REROLE + more)]
            out += [(first, to, cost + c, _CODES.index(code + e)) for e, to, c in ends if to is not None]
            state, code, cost = _INSERTED[state], code + "I", cost + INSERT
    return out


#: A turn's class: 0 must go; else 1 + 4 * truncated + place of its initial in "sua" (3: another).
_MOVES = [_moves(True, False, ""), *[_moves(False, t, i) for t in (False, True) for i in (*_INITIALS, "?")]]


def _class(fault: int, initial: str) -> int:
    return 0 if fault in (_BLANK, _DUPLICATE) else 1 + 4 * (fault == _CUT) + (_INITIALS.index(initial) if initial and initial in _INITIALS else 3)


class Layers:
    """Layers by number: what follows layer `k` after a turn of class `c` is found once."""

    def __init__(self):
        self.known: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.next: dict[int, tuple] = {}

    def of(self, layer: tuple) -> int:
        if layer not in self.number:
            self.number[layer] = len(self.known)
            self.known.append(layer)
        return self.number[layer]

    def start(self, state: int = NOTHING) -> int:
        return self.of(tuple((0, 0) if s == state else None for s in range(4)))

    def step(self, k: int, c: int) -> tuple[int, int, tuple]:
        """The next layer's number, what its costs were lowered by, and by state (state before, code)."""
        key = k * 9 + c
        if key not in self.next:
            layer, best = self.known[k], [None] * 4
            for before, to, cost, code in _MOVES[c]:
                if layer[before] is not None:
                    found = (layer[before][0] + cost, layer[before][1], code, before)
                    best[to] = found if best[to] is None else min(best[to], found)
            least = min(b[0] for b in best if b)
            ranks = sorted((b[1], b[2]) for b in best if b)
            made = tuple(b and (b[0] - least, ranks.index((b[1], b[2]))) for b in best)
            self.next[key] = (self.of(made), least, tuple(b and (b[3], b[2]) for b in best))
        return self.next[key]

    def run(self, classes: list[int], state: int = NOTHING) -> tuple[tuple, int, list[tuple]]:
        """The last layer, what was taken off its costs, and the parents by turn."""
        k, cost, parents, step, known = self.start(state), 0, [], self.step, self.next
        for c in classes:
            k, least, back = known.get(k * 9 + c) or step(k, c)
            cost += least
            parents.append(back)
        return self.known[k], cost, parents


def _end(layer: tuple) -> int:
    """The state of the cheapest way to the end; among equals, of the least audit."""
    return min((s for s in range(4) if layer[s]), key=lambda s: (layer[s][0] + _FINISH[s][0], layer[s][1]))


def _codes(parents: list[tuple], state: int) -> list[int]:
    out = []
    for back in reversed(parents):
        state, code = back[state]
        out.append(code)
    return out[::-1]


def solve(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of (role initial, fault) rows: the program as a plain function."""
    layers = Layers()
    layer, cost, parents = layers.run([_class(f, i) for i, f in rows])
    end = _end(layer)
    return cost + layer[end][0] + _FINISH[end][0], "".join(_CODES[c] for c in _codes(parents, end)) + _FINISH[end][1]


def _faulty(turns: DataFrame, copies: Column) -> DataFrame:
    """conv_id, turn, role, text, copies and `fault`, that of the first copy: blank, seen in an
    earlier turn, or cut off. Rows of one turn that are equal are found in their order."""
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACES))
    text = F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), copies.cast("int").alias("copies"))
    fault = F.when(F.col("copies") <= 0, _GONE).when(trimmed == "", _BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), _CUT).otherwise(_GOOD)
    rows = rows.withColumn("fault", fault).withColumn("same", F.md5(F.concat_ws("\u0000", F.length("role").cast("string"), "role", "text").cast("binary")))
    there = rows.where(F.col("fault") >= _CUT).groupBy("conv_id", "same")
    # the first turn of what comes in several; pre-aggregated, so that a hot conversation is not one group
    seen = there.agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.max(F.col("turn").isNull()).alias("nulls"))
    seen = seen.where((F.col("first") < F.col("last")) | (F.col("nulls") & F.col("first").isNotNull()))
    seen = cut(seen.select("conv_id", "same", F.when(~F.col("nulls"), F.col("first")).alias("first"), F.lit(True).alias("twice")))
    small = seen.limit(BROADCAST_REPEATS + 1).count() <= BROADCAST_REPEATS
    seen = (F.broadcast(seen) if small else seen).withColumnsRenamed({"conv_id": "_conv", "same": "_same"})
    rows = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left")
    later = F.col("twice") & ~F.col("turn").eqNullSafe(F.col("first"))
    return rows.withColumn("fault", F.when((F.col("fault") >= _CUT) & F.coalesce(later, F.lit(False)), _DUPLICATE).otherwise(F.col("fault")))


def _listed(conv, initial, fault, copies, same, last: tuple | None):
    """Faults of all copies of a batch's rows in order: [(row, fault)], and what the last row was. A
    row equal to the one before it in the same turn, or a further copy, is a duplicate."""
    out = []
    for k, row in enumerate(zip(conv, same)):
        f, n = fault[k], copies[k]
        if f == _GONE:
            continue
        if f >= _CUT and row == last:
            f = _DUPLICATE
        out.append((k, f))
        out += [(k, _BLANK if f == _BLANK else _DUPLICATE)] * (n - 1)
        last = row
    return out, last


def _lasts(batches):
    """(part, conv_id, digest) of the last row there is in a partition."""
    last = None
    for batch in batches:
        conv, fault, same = (batch.column(i).to_pylist() for i in range(3))
        last = next(((c, s) for c, f, s in zip(conv[::-1], fault[::-1], same[::-1]) if f != _GONE), last)
    if last is not None:
        yield (partition(), *last)


def _before(lasts: dict[int, tuple]) -> tuple | None:
    """The row before this partition's first: equal rows may be dealt to several partitions."""
    return lasts.get(max((p for p in lasts if p < partition()), default=-1))


def _borders(batches, layers: Layers, last: tuple | None):
    """(part, which, conv_id, costs, ranks) of a partition's first and last conversation, as
    maps from the state before to the layer after."""
    held: list[list] = []  # first and last conversation: id and classes
    count, begun = 0, False
    for batch in batches:
        conv, initial, fault, copies, same = (batch.column(i).to_pylist() for i in range(5))
        listed, last = _listed(conv, initial, fault, copies, same, last)
        at = 0
        for k, c in enumerate(conv):
            if not begun or c != held[-1][0]:
                held = [*held[:1], [c, []]]
                count, begun = count + 1, True
            while at < len(listed) and listed[at][0] == k:
                held[-1][1].append(_class(listed[at][1], initial[k]))
                at += 1
    for which, (conv, classes) in enumerate(held[: 1 if count == 1 else 2]):
        costs, ranks = [], []
        for state in range(4):
            layer, cost, _ = layers.run(classes, state)
            costs += [cost + x[0] if x else -1 for x in layer]
            ranks += [x[1] if x else -1 for x in layer]
        yield (partition(), which, conv, costs, ranks)


def _routes(borders: list) -> dict[tuple[int, int], tuple[int, int, bool, bool]]:
    """By (part, which), for segments of conversations that cross borders: the states they are
    entered and left in, and whether they are the first and the last of theirs."""
    out = {}
    for chain in chains(borders):
        layer, steps = {NOTHING: (0, 0)}, []
        for seg in chain:
            best: dict[int, tuple] = {}
            for before, (cost, rank) in layer.items():
                for to in range(4):
                    if (c := seg.costs[4 * before + to]) >= 0:
                        found = (cost + c, rank, seg.ranks[4 * before + to], before)
                        best[to] = min(best.get(to, found), found)
            order = sorted((b[1], b[2]) for b in best.values())
            steps.append({to: b[3] for to, b in best.items()})
            layer = {to: (b[0], order.index((b[1], b[2]))) for to, b in best.items()}
        state = _end(tuple(layer.get(s) for s in range(4)))
        for k in range(len(chain) - 1, -1, -1):
            before = steps[k][state]
            out[chain[k].part, chain[k].which] = (before, state, k == 0, k == len(chain) - 1)
            state = before
    return out


class _Segment:
    """The rows of one conversation in one partition; their number is that of the partition's."""

    def __init__(self, conv):
        self.conv, self.rows = conv, []  # (turn, role, text, fault)

    def classes(self) -> list[int]:
        return [_class(f, role[:1]) for _, role, _, f in self.rows]

    def edits(self, layers: Layers, route) -> tuple[int, list[str]]:
        """Cost, and by row the macro edit; the last item is what is inserted at the end."""
        entry = route[0] if route else NOTHING
        layer, cost, parents = layers.run(self.classes(), entry)
        end = route[1] if route else _end(layer)
        finish = _FINISH[end] if not route or route[3] else (0, "")
        return cost + layer[end][0] + finish[0], [*(_CODES[c] for c in _codes(parents, end)), finish[1]]

    def repaired(self, edits: list[str], route):
        """(turn, role, text, edit) of the turns that the edits leave or insert, in order."""
        state = route[0] if route else NOTHING
        for (turn, role, text, _), edit in zip([*self.rows, (None, "", "", 0)], edits):
            for e in edit:
                if e == "I":
                    state = _INSERTED[state]
                    yield None, _ROLE[state], "", "I"
                elif e == "K":
                    state = _after(state, role[:1])
                    yield turn, role, text, "K"
                elif e == "R":
                    state = A if state == U else U
                    yield turn, _ROLE[state], text, "R"


def _streamed(batches, routes: dict, last: tuple | None):
    """The partition's segments in order, each with its route if its conversation crosses a border.
    No more than one segment is held, which PART_BYTES bounds."""
    part, held, n = partition(), None, 0
    for batch in batches:
        conv, initial, fault, copies, same, turn, role, text = (batch.column(i).to_pylist() for i in range(8))
        listed, last = _listed(conv, initial, fault, copies, same, last)
        at = 0
        for k, c in enumerate(conv):
            if held is None or c != held.conv:
                if held is not None:
                    yield held, routes.get((part, 0)) if n == 1 else None
                held, n = _Segment(c), n + 1
            while at < len(listed) and listed[at][0] == k:
                held.rows.append((turn[k], role[k], text[k], listed[at][1]))
                at += 1
    if held is not None:
        yield held, routes.get((part, 0 if n == 1 else 1))
    give_back()


class Repair:
    """The program over a table of turns (conv_id, turn, role, text), worked out up to the states
    at partitions' borders. `copies` says how often each row stands there (0: not at all, but its
    conversation is reported)."""

    def __init__(self, turns: DataFrame, copies: Column | None = None):
        spark = turns.sparkSession
        small_batches(spark)
        ship(spark)
        rows = _faulty(turns, F.lit(1) if copies is None else copies)
        self.kind = turns.schema["conv_id"].dataType
        self.turn = turns.schema["turn"].dataType
        keep = ["conv_id", F.substring("role", 1, 1).alias("initial"), "fault", "copies", "same", "turn", "role", "text"]
        self.rows = ordered(rows, F.octet_length("text") + F.lit(64), keep)
        schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("which", T.IntegerType()), T.StructField("conv_id", self.kind), T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("ranks", T.ArrayType(T.LongType()))])
        kind = pa.schema([("part", pa.int32()), ("which", pa.int32()), ("conv_id", _arrow(self.kind)), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])

        ends = T.StructType([schema["part"], schema["conv_id"], T.StructField("same", T.StringType())])
        end = pa.schema([kind.field("part"), kind.field("conv_id"), ("same", pa.string())])
        found = self.rows.select("conv_id", "fault", "same").mapInArrow(lambda batches: _batched(_lasts(batches), end), ends).collect()
        self.lasts = lasts = spark.sparkContext.broadcast({r.part: (r.conv_id, r.same) for r in found})

        def borders(batches):
            yield from _batched(_borders(batches, Layers(), _before(lasts.value)), kind)

        # two rows a partition at most
        found = self.rows.select("conv_id", "initial", "fault", "copies", "same").mapInArrow(borders, schema).collect()
        self.routes = spark.sparkContext.broadcast(_routes(sorted(found, key=lambda r: (r.part, r.which))))

    def turns(self) -> DataFrame:
        """The repaired turns: conv_id, place (ordered, unique within a conversation), turn (null if
        inserted), role, text, edit (K, R or I)."""
        schema = T.StructType([T.StructField("conv_id", self.kind), T.StructField("place", T.LongType()), T.StructField("turn", self.turn), *(T.StructField(c, T.StringType()) for c in ("role", "text", "edit"))])
        kind = pa.schema([("conv_id", _arrow(self.kind)), ("place", pa.int64()), ("turn", _arrow(self.turn)), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        routes, lasts = self.routes, self.lasts

        def run(batches):
            def rows():
                layers, place = Layers(), partition() << 40
                for seg, route in _streamed(batches, routes.value, _before(lasts.value)):
                    for r in seg.repaired(seg.edits(layers, route)[1], route):
                        yield (seg.conv, place, *r)
                        place += 1

            yield from _batched(rows(), kind, CHUNK)

        return self.rows.mapInArrow(run, schema)

    def report(self) -> DataFrame:
        """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the
        SHA-256 of the repaired `role:text`, joined by newlines. A hash runs through its text in
        order, so of a conversation that crosses borders the pieces are streamed through one task;
        the counts and edits in them are made where they lie."""
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        fields = [("part", T.LongType()), ("chunk", T.IntegerType()), ("alone", T.BooleanType()), ("first", T.LongType()), ("last", T.LongType()), ("turns", T.LongType()), *((n, T.LongType()) for n in names[1:]), ("heads", T.StringType()), ("audit", T.StringType()), ("sha", T.StringType()), ("piece", T.BinaryType())]
        schema = T.StructType([T.StructField("conv_id", self.kind), *(T.StructField(n, t) for n, t in fields)])
        kind = pa.schema([("conv_id", _arrow(self.kind)), *((n, _arrow(t)) for n, t in fields)])
        routes, lasts = self.routes, self.lasts

        def pieces(batches):
            yield from _batched(_summed(_streamed(batches, routes.value, _before(lasts.value))), kind, CHUNK)

        made = cut(self.rows.mapInArrow(pieces, schema))
        out = T.StructType([T.StructField("conv_id", self.kind), *(T.StructField(n, T.LongType()) for n in names), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
        final = pa.schema([("conv_id", _arrow(self.kind)), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def joined(batches):
            yield from _batched(_joined(batches), final)

        alone = made.where("alone").select("conv_id", F.coalesce(F.col("last") - F.col("first") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), *names[1:], "audit", F.col("sha").alias("repaired_sha256"))
        split = made.where("not alone").drop("alone", "sha").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
        return alone.unionByName(split.mapInArrow(joined, out))


def _summed(segments):
    """One row for each whole conversation; of others, rows of up to CHUNK bytes of repaired text,
    the first of which has the counts. heads: the initials at both ends and whether it is their first."""
    layers = Layers()
    for k, (seg, route) in enumerate(segments):
        cost, edits = seg.edits(layers, route)
        numbers = [t for t, *_ in seg.rows if t is not None]
        distinct = len(set(numbers))
        faults = [f for *_, f in seg.rows]
        initials = [role[:1] for _, role, _, _ in seg.rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [faults.count(f) for f in (_BLANK, _DUPLICATE, _CUT)]
        stats = (min(numbers, default=None), max(numbers, default=None), distinct, *counts, illegal, cost)
        text = (f"\n{role}:{text}".encode() for _, role, text, _ in seg.repaired(edits, route))
        audit = "".join(edits)
        at = (partition() << 32) + k
        if not route:
            sha = hashlib.sha256()
            for j, t in enumerate(text):
                sha.update(t if j else t[1:])
            yield (seg.conv, at, 0, True, *stats, "", audit, sha.hexdigest(), b"")
            continue
        heads = f"{initials[0]:1}{initials[-1]:1}" if initials else ""
        chunk, held, size = 0, [], 0
        for t in text:
            if size and size + len(t) > CHUNK:
                yield (seg.conv, at, chunk, False, *(stats if not chunk else [None] * 8), heads if not chunk else None, audit if not chunk else "", None, b"".join(held))
                chunk, held, size = chunk + 1, [], 0
            held.append(t)
            size += len(t)
        yield (seg.conv, at, chunk, False, *(stats if not chunk else [None] * 8), heads if not chunk else None, audit if not chunk else "", None, b"".join(held))


def _joined(batches):
    """Segments of conversations in order, put together one row at a time."""
    now, begun = None, False

    def finished():
        gaps = 0 if now["first"] is None else now["last"] - now["first"] + 1 - now["turns"]
        return (now["conv"], gaps, *now["sums"], "".join(now["audit"]), now["sha"].hexdigest())

    for batch in batches:
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != now["conv"]:
                if begun:
                    yield finished()
                begun = True
                now = {"conv": r["conv_id"], "first": None, "last": None, "turns": 0, "sums": [0] * 5, "head": "", "audit": [], "sha": hashlib.sha256(), "any": False}
            if r["chunk"] == 0:
                if r["first"] is not None:
                    now["turns"] += r["turns"] - (r["first"] == now["last"])  # a turn may lie on both sides
                    now["first"] = r["first"] if now["first"] is None else now["first"]
                    now["last"] = r["last"]
                now["sums"] = [a + r[n] for a, n in zip(now["sums"], ("blank", "duplicate", "truncated", "illegal", "cost"))]
                if r["heads"]:
                    now["sums"][3] += bool(now["head"]) and now["head"] + r["heads"][0] not in ("su", "ua", "au")
                    now["head"] = r["heads"][1]
                now["audit"].append(r["audit"])
            if r["piece"]:
                now["sha"].update(r["piece"] if now["any"] else r["piece"][1:])
                now["any"] = True
    if begun:
        yield finished()


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batched(rows, kind: pa.Schema, limit: int = 1 << 30):
    """Batches of 1,000 rows, or of fewer that hold about `limit` bytes of texts."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, (str, bytes)))
        if len(held) == 1000 or size > limit:
            yield _batch(held, kind)
            held, size = [], 0
    if held:
        yield _batch(held, kind)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Faults by the checksum of `conv_id:turn`, modulo 20 (nulls are one space): 0 drops a row, 1
    empties it, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's. The rows and how often each stands."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(one("role"))
    n = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    out = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), n.alias("n"))
    return out, F.col("n")
