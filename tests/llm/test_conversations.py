"""Repair and prefix trees of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")

from factloom.llm import prefix_tree, repair  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def order(row):
    """Of rows of one conversation (turn, role, text): nulls first."""
    return (row[0] is not None, row[0] or 0, row[1][:64], row[2][:64])


def damaged(rows):
    out = defaultdict(list)
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        out[conv] += []
        f = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if f == 1 else text.replace(".", "").replace("!", "").replace("?", "") if f == 2 else text
        out[conv] += [(turn, "user" if f == 4 else role, text)] * {0: 0, 3: 2}.get(f, 1)
    return {c: sorted(r, key=order) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def ways(rows, flaws):
    """The cheapest (cost, audit, texts) by a search over single edits that carries whole audits."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def insert(b):
        for _ in range(3):
            for q, (c, w, o) in list(b.items()):
                for r in step[q].replace("s", ""):
                    put(b, r, (c + 3, w + "I", (*o, {"u": "user:", "a": "assistant:"}[r])))

    def put(b, q, x):
        if q not in b or x[:2] < b[q][:2]:
            b[q] = x

    for (_, role, text), flaw in zip(rows, flaws):
        insert(best)
        new = {}
        for q, (c, w, o) in best.items():
            put(new, q, (c + 4, w + "D", o))
            if flaw not in ("blank", "duplicate"):
                more = 3 * (flaw == "truncated")
                if role[:1] and role[:1] in step[q]:
                    put(new, role[:1], (c + more, w + "K", (*o, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in step[q]:
                        put(new, r, (c + 3 + more, w + "R", (*o, f"{name}:{text}")))
        best = new
    insert(best)
    return min((best[q][:2], best[q][2]) for q in ("", "a") if q in best)


def reported(rows):
    out = {}
    for conv, r in damaged(rows).items():
        f = faults(r)
        turns = {t for t, *_ in r if t is not None}
        roles = [x[1][:1] for x in r]
        (cost, audit), texts = ways(r, f)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(f.count(x) for x in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def conversations(seed=5, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Yes.", "No!", "Why?", "so", "", None, " \n", "é?\n", "long " * 300 + "."])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    rows += [(None, t, "user", "Who?") for t in (0, 1, None)]
    return rows + rows[3:9]


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_layers_equal_whole_audits():
    rng = random.Random(1)
    kinds = {repair._BLANK: "blank", repair._DUPLICATE: "duplicate", repair._CUT: "truncated", repair._GOOD: ""}
    for _ in range(400):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice(list(kinds))) for _ in range(rng.randrange(0, 12))]
        (cost, audit), _ = ways([(0, i, "t") for i, _ in rows], [kinds[f] for _, f in rows])
        assert repair.solve(rows) == (cost, audit)


@pytest.mark.parametrize("limit", [repair.BROADCAST_REPEATS, 0])
def test_repair_of_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(repair, "BROADCAST_REPEATS", limit)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", fault string, same int")
    assert got(repair.Repair(*repair.damaged(df)).report()) == reported(rows)


def test_repair_across_partitions(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", "so", f"It is {t}.", "No!"])) for t in range(900)]
    rows += [(8, 1, "user", "Again?")] * 300 + [(8, None, "assistant", "x" * 40_000 + ".")] * 3 + [(9, t, "user", None) for t in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        done = repair.Repair(*repair.damaged(df))
        assert len(done.routes.value) > 10
        assert got(done.report()) == reported(rows)
        turns = sorted(done.turns().collect(), key=lambda r: (r.conv_id, r.place))
        want = {c: ways(r, faults(r)) for c, r in damaged(rows).items()}
        for c, ((_, audit), texts) in want.items():
            assert tuple(f"{r.role}:{r.text}" for r in turns if r.conv_id == c) == texts
            assert "".join(r.edit for r in turns if r.conv_id == c) == audit.replace("D", "")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_repair_of_no_rows(spark):
    assert repair.Repair(*repair.damaged(spark.createDataFrame([], SCHEMA))).report().collect() == []


def paths(rows, led=True):
    """By conversation its (rebuilt) turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(r, key=order)] for c, r in own.items()}
    if not led:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + r[h[c] :] for c, r in own.items()}


def plain_tree(made):
    members = defaultdict(list)
    for c, r in made.items():
        for d in range(len(r) + 1):
            members[tuple(r[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        below = [total[c] for c in children[p]]
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        total[p] = (sum(x for x, _ in below) or 1, own + sum(y for _, y in below))
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p))))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), *total[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def grown(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*prefix_tree.COLUMNS).collect())


@pytest.mark.parametrize("limit", [0, 6, prefix_tree.LOCAL_ROWS])
def test_tree_of_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(prefix_tree, "LOCAL_ROWS", limit)
    monkeypatch.setattr(prefix_tree, "PACK_ROWS", 16)
    rng = random.Random(4)
    rows = conversations(6, 60)
    start = [("user", "Hi."), ("assistant", "Yes?"), ("user", "é")]
    for c in range(60, 160):  # snapshots of one conversation, and copies
        n = rng.randrange(1, 9)
        rows += [(c, t, *(start + [("user", f"{t % 3}")] * 9)[t]) for t in range(n)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, depth int")
    assert grown(prefix_tree.nodes(*prefix_tree.rebuilt(df))) == plain_tree(paths(rows))
    assert grown(prefix_tree.tree(df)) == plain_tree(paths(rows, led=False))


def test_tree_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_tree, "CHAIN", 7)
    monkeypatch.setattr(prefix_tree, "PIECE", 20)
    rows = [(c, t, "user", f"{t}") for c in (3, 4, 10) for t in range(400)] + [(c, 0, "user", "same") for c in range(20, 300)]
    rows += [(11, 0, "user", "same")] * 50
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert grown(prefix_tree.tree(df)) == plain_tree(paths(rows, led=False))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_tree_of_few_rows(spark):
    assert prefix_tree.nodes(*prefix_tree.rebuilt(spark.createDataFrame([], SCHEMA))).collect() == []
    for rows in ([(None, 0, "user", "x")], [(6, 0, "user", "x")], [(c, 0, "user", None) for c in (1, 2)]):
        df = spark.createDataFrame(rows, SCHEMA)
        made = paths(rows)
        assert grown(prefix_tree.nodes(*prefix_tree.rebuilt(df))) == (plain_tree(made) if made else [])
