"""Fingerprints of records against a plain walk over each."""

import json
import random
import re

from factloom.operators import fingerprint


def _tag(value) -> str:
    if isinstance(value, str):
        return "iso_datetime" if re.match(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}", value) else "email_like" if re.match(r"[^@\s]+@[^@\s]+\.[^@\s]+$", value) else "str"
    return {type(None): "null", bool: "bool", int: "int", float: "float", list: "list", dict: "dict"}.get(type(value), "other")


def leaves(record) -> list[tuple[str, str]]:
    """(path, tag) of a record's leaves. Lists are entered once for each type of element;
    a leaf's tag is that of the first value on its path."""
    out: dict[str, None] = {}
    todo = [("$", record)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict) and v:
            todo += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            todo += [(f"{path}[*]", x) for x in {type(x): x for x in reversed(v)}.values()]
        else:
            out[f"{path}[*]" if isinstance(v, list) else path] = None

    def first(path: str):
        at = record
        for step in path[1:].replace("[*]", ".[*]").split(".")[1:]:
            if step == "[*]":
                if not (isinstance(at, list) and at):
                    return None
                at = at[0]
            elif isinstance(at, dict) and step in at:
                at = at[step]
            else:
                return None
        return at

    return [(p, _tag(first(p))) for p in sorted(out)]



def records(seed, n=150):
    rng = random.Random(seed)

    def value(depth):
        if depth and rng.random() < 0.5:
            if rng.random() < 0.5:
                return {rng.choice("abc"): value(depth - 1) for _ in range(rng.randrange(4))}
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return rng.choice([None, True, 1, -7, 2.5, "x", "", "a@b.org", "2024-01-02 03:04", "2024-01-02", "é@ü.de"])

    return [{k: value(rng.choice([0, 1, 3, 6])) for k in rng.sample("abcde", rng.randrange(1, 5))} for _ in range(n)]


def test_leaves_equal_a_plain_walk(spark):
    rows = [*records(1), {}, [], 5, "x", None, [[]], [{"a": []}, 1, {"b": 2}], {"a": {}, "b": [{"c": 1}, {"c": "x"}, 2]}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)] + [(-1, "no json"), (-2, None), (-3, "")], "k long, record string")
    for k in range(0, len(rows), 20):
        got = sorted(tuple(r) for r in fingerprint.leaf_paths(df.where(f"k between {k} and {k + 19}")).collect())
        assert got == sorted(x for r in rows[k : k + 20] for x in leaves(r))
    assert fingerprint.leaf_paths(df.where("k < 0")).count() == 0 and fingerprint.type_fingerprint(df.limit(0)).count() == 0
    tags = {}
    for r in rows:
        for p, t in leaves(r):
            tags.setdefault(p, set()).add(t)
    assert {r.path: r.tag for r in fingerprint.type_fingerprint(df).collect()} == {p: t.pop() if len(t) == 1 else "mixed" for p, t in tags.items()}


def test_deep_records(spark):
    deep = "[" * 30 + '{"a": 1}' + "]" * 30
    got = fingerprint.leaf_paths(spark.createDataFrame([(deep,)], "record string")).collect()
    assert [tuple(r) for r in got] == [("$" + "[*]" * 30 + ".a", "int")]
