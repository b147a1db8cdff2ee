"""Paths of many pairs, exact quantiles, identities, embedding passes, edge attributes and streams
against plain versions."""

import json
import random
import statistics
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from factloom.operators import embedding, evals, identity, ingest, merge, paths, quantiles, store
from factloom.operators.store import Store
from factloom.plans import spec as S
from factloom.streaming import push

# ---- paths --------------------------------------------------------------------------------


@pytest.mark.parametrize("links", [paths.HUB_LINKS, 3])
@pytest.mark.parametrize("hubs", [paths.BROADCAST_HUBS, 0])
def test_paths_equal_a_search_of_each_pair(spark, monkeypatch, links, hubs):
    if links == paths.HUB_LINKS and not hubs:
        return
    monkeypatch.setattr(paths, "HUB_LINKS", links)
    monkeypatch.setattr(paths, "BROADCAST_HUBS", hubs)
    rng = random.Random(7)
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)} | {("n0", f"n{k}") for k in range(1, 12)} | {("x", "y")}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def lengths(start):
        out, todo = {start: 0}, deque([start])
        while todo:
            at = todo.popleft()
            for o in near[at]:
                if o not in out:
                    out[o] = out[at] + 1
                    todo.append(o)
        return out

    pairs = [(k, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for k in range(40)] + [(50, "x", "y"), (51, "x", "n0"), (52, "n3", "n3"), (53, "nobody", "n1"), (54, None, "n1")]
    e = spark.createDataFrame([(a, b, "KNOWS") for a, b in edges], "src string, dst string, relation_type string")
    rows = paths.shortest_paths(e, spark.createDataFrame(pairs + pairs[:2], "pair int, source string, target string"), 6).collect()
    got = {r["pair"]: r for r in rows}
    assert len(got) == len(rows)
    for k, a, b in pairs:
        d = lengths(a).get(b) if a else None
        if d is None or d > 6:
            assert k not in got
            continue
        p = got[k]["path"]
        assert got[k]["length"] == d == len(p) - 1 and (p[0], p[-1]) == (a, b) and all(y in near[x] for x, y in zip(p, p[1:]))
    with pytest.raises(ValueError):
        paths.shortest_paths(e, spark.createDataFrame(pairs, "pair int, source string, target string"), 0)


# ---- quantiles ----------------------------------------------------------------------------


def test_quantiles_equal_sorted_lists(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 3)
    monkeypatch.setattr(quantiles, "BINS", 4)
    rng = random.Random(2)
    groups = {
        "spread": [rng.uniform(-5, 5) for _ in range(200)], "same": [7.0] * 90, "steps": [float(rng.randrange(4)) for _ in range(150)], "one": [3.0], "two": [1.0, 4.0],
        "wide": [-1.7e308, 1.7e308, float("inf"), -float("inf"), 0.0, 1e-300] * 3, "near": [1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 5, None: [2.0, 8.0, 5.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    top = 1.7976931348623157e308
    flat = {g: sorted(max(-top, min(top, v)) for v in vs) for g, vs in groups.items()}
    for exclusive in (False, True):
        got = {(r["g"], r["q"]): r["value"] for r in quantiles.quantiles(df, "v", [0.0, 0.5, 0.95], ["g"], exclusive).collect()}
        assert {g for g, _ in got} == set(groups)
        for g, v in flat.items():
            for q in (0.0, 0.5, 0.95):
                at = (len(v) + 1) * q if exclusive else 1 + (len(v) - 1) * q
                low = max(min(int(at // 1), len(v) - 1), 1)
                want = v[0] if len(v) == 1 else v[low - 1] * (1 - (at - low)) + v[low] * (at - low)
                assert got[g, q] == pytest.approx(want, rel=1e-12)
    p95 = evals.p95_exclusive(df.where("g = 'spread'"), "v").first()[0]
    assert p95 == pytest.approx(statistics.quantiles(groups["spread"], n=20)[18])
    assert evals.latency(df.limit(0), "v").collect()[0]["p50"] is None and quantiles.quantiles(df.limit(0), "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles.quantiles(df, "v", [1.5])


# ---- identities ---------------------------------------------------------------------------


def grouped(pairs):
    """(id, key) rows: the least id of each one's group."""
    at = {}
    for i, _ in pairs:
        at[i] = i
    changed = True
    while changed:
        changed = False
        by = defaultdict(list)
        for i, k in pairs:
            by[k].append(i)
        for ids in by.values():
            least = min(at[i] for i in ids)
            for i in ids:
                if at[i] != least:
                    at[i], changed = least, True
    return at


@pytest.mark.parametrize("seed", [1])
def test_groups_equal_a_plain_closure(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"p{rng.randrange(80):02}", f"k{rng.randrange(60)}") for _ in range(110)]
    pairs += [(f"c{k:03}", f"chain{j}") for k in range(16) for j in (k, k + 1)]  # a long chain
    pairs += [(f"h{k:03}", "hot") for k in range(60)]
    got = identity.groups(spark.createDataFrame(pairs + pairs[:9], "id string, key string"))
    want = grouped(pairs)
    n = defaultdict(int)
    for v in want.values():
        n[v] += 1
    assert {r.id: (r.least, r.n) for r in got.collect()} == {i: (v, n[v]) for i, v in want.items()}
    edges = identity.same_as(got).collect()
    assert len(edges) == sum(i != v for i, v in want.items()) and all(r.a < r.b for r in edges)


def test_keys_of_people(spark):
    rows = [("a", " X@y.Org", "+1 (555) 010-9999", " Ann", "Oslo "), ("b", "x@Y.org", "555", None, "Oslo"), ("c", "no address", "15550109999", "ann", "oslo"), (None, "x@y.org", None, "", ""), ("d", None, None, " ", "Rome")]
    df = spark.createDataFrame(rows, "id string, email string, phone string, name string, place string")
    assert {r.id: r.least for r in identity.groups(identity.keys_of(df)).collect()} == {"a": "a", "b": "a", "c": "a"}
    assert identity.groups(identity.keys_of(df.limit(0))).count() == 0


# ---- vectors made once --------------------------------------------------------------------


class Counting(embedding.HashEmbedder):
    def embed(self, texts):
        if any("broken" in t for t in texts):
            return [[0.0] * self.size for _ in texts]
        return super().embed(texts)


def test_only_what_is_missing_is_embedded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedding, "BATCH", 2)
    kept, model = Store(spark, str(tmp_path)), Counting(8)
    nodes = lambda *rows: spark.createDataFrame(list(rows), "id string, type string, text string")
    rows = [("a", "Person", "one"), ("b", "Event", "two"), ("c", "Person", None), (None, "Person", "x"), ("d", "Person", ""), ("e", "Person", "five")]
    assert embedding.embed_missing(kept, nodes(*rows), model, types=["Person"], limit=2, run="1") == 2
    assert {r.id for r in kept.read("vectors").collect()} == {"a", "d"}
    assert embedding.embed_missing(kept, nodes(*rows), model, run="2") == 2
    parts = kept._current()["vectors"]
    assert embedding.embed_missing(kept, nodes(*rows), model, run="3") == 0 and kept._current()["vectors"] == parts
    assert embedding.embed_missing(kept, nodes(("a", "Person", "another")), model, run="4") == 1
    got = {r.id: (r.run, [round(x, 9) for x in r.vector]) for r in kept.read("vectors").collect()}
    want = {"a": ("4", "another"), "b": ("2", "two"), "d": ("1", ""), "e": ("2", "five")}
    assert got == {i: (run, [round(x, 9) for x in embedding.hash_embedding(t, 8)]) for i, (run, t) in want.items()}
    assert embedding.embed_missing(kept, nodes(*rows[:2]), embedding.HashEmbedder(4)) == 2 and kept.read("vectors").count() == 6
    with pytest.raises(Exception, match="zero or not finite"):
        embedding.embed_missing(kept, nodes(("z", "Person", "broken")), model)
    for bad in ({"limit": -1}, {"types": ["Nonsense"]}):
        with pytest.raises(ValueError):
            embedding.embed_missing(kept, nodes(*rows), model, **bad)


# ---- edge attributes ----------------------------------------------------------------------

FIELD = lambda a, required=True: {"attribute": a, "source": f"$.{a}", "required": required}
SPEC = S.load({
    "tenant": "t", "source": {"file_pattern": "f.json", "format": "json"},
    "nodes": [{"name": "a", "canonical_type": "Person", "id_template": "p:{a}", "fields": [FIELD("name", False)]}, {"name": "b", "canonical_type": "Organization", "id_template": "o:{b}", "when": {"exists": "$.b"}, "fields": []}],
    "edges": [{"canonical_type": "MEMBER_OF", "source_node": "@a", "target_node": "@b", "fields": [FIELD("role"), FIELD("since", False)]}],
})


def records(spark, *rows):
    return spark.createDataFrame([(f, k, json.dumps(r)) for f, k, r in rows], "source_file string, ordinal long, record string")


def test_edge_attributes_are_folded_and_kept(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    first = records(spark, ("f.json", 0, {"a": 1, "b": 1, "role": "Lead", "since": 2001}), ("f.json", 1, {"a": 2, "b": 1}), ("f.json", 2, {"a": 3}))
    assert merge.run(s, SPEC, first)["dead"] == 1  # an edge without a field it needs
    merge.run(s, SPEC, records(spark, ("g.json", 0, {"a": 1, "b": 1, "role": "lead"}), ("h.json", 0, {"a": 1, "b": 1, "role": "Boss"})))
    state = {r.attribute: r for r in s.read("edge_attributes").collect()}
    assert {k: (r.value, r.n_facts, r.open is not None) for k, r in state.items()} == {"role": ('"Lead"', 3, True), "since": ("2001", 1, False)}
    edge = merge.graph_edges(s.read("edges"), s.read("edge_attributes")).first()
    assert edge["attributes"] == {"role": '"Lead"', "since": "2001"} and edge["version"] == 3 and edge["valid_from"] <= edge["valid_to"]
    said = {(r.attribute, r.value): (r.first.source_file, r.last.source_file) for r in merge.statements(s.read("provenance")).collect()}
    assert said[("role", '"Boss"')] == ("h.json", "h.json") and len(said) == 4
    store.delete_stored_edges(s, s.read("edges"))
    assert s.read("edge_attributes").count() == 0 and s.read("provenance").where("edge_id is not null").count() == 0


def test_writes_refuse_what_breaks_the_rules(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    got = ingest.ingest(records(spark, ("f.json", 0, {"a": 1, "b": 1, "role": "x"})), SPEC)
    import dataclasses

    with pytest.raises(merge.Refused, match="loose edge"):
        merge.commit(s, dataclasses.replace(got, nodes=got.nodes.where("type = 'Person'")))
    with pytest.raises(merge.Refused, match="confidence"):
        merge.commit(s, dataclasses.replace(got, provenance=got.provenance.withColumn("confidence", F.lit("sure"))))
    assert not s.has("nodes")
    merge.commit(s, got)
    merge.commit(s, dataclasses.replace(got, nodes=got.nodes.where("type = 'Person'")))  # the other end is stored
    assert s.read("nodes").count() == 2


# ---- streams ------------------------------------------------------------------------------


def test_stream_in_any_order_equals_one_batch(spark, tmp_path):
    """Records late, repeated and out of order, a file a micro-batch: the attributes and conflicts of one
    batch of all, and a state that forgets."""
    rng = random.Random(3)
    rows = [("a.json" if rng.random() < 0.5 else "b.json", k, {"a": rng.randrange(4), "name": rng.choice(["Ann", "ann", "Bo", "Cy"]), "n": k}) for k in range(40)]
    arrival = rows[:]
    rng.shuffle(arrival)
    arrival += rng.sample(arrival, 10)
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "source_file string, ordinal long, record string"
    for k in range(0, len(arrival), 17):
        (folder / f"{k:03}.json").write_text("".join(json.dumps({"source_file": f, "ordinal": o, "record": json.dumps(r)}) + "\n" for f, o, r in arrival[k : k + 17]))
    s = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = push.start(stream, s, SPEC, str(tmp_path / "ck"), within="1 second", ordered=True)
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = ingest.ingest(records(spark, *rows), SPEC)
    want = merge.merged(got, F.current_timestamp())["attributes"]
    cols = ["node_id", "attribute", "value", "norm", "confidence", "source_file", "source_record_id", "n_facts", "open"]
    read = lambda d: sorted(map(repr, d.select(*cols).collect()))
    assert read(s.read("attributes")) == read(want)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held and held[-1] < len(rows)
    assert s.read("seen").count() == len(rows)


# ---- small rules --------------------------------------------------------------------------


def test_citations_have_a_known_method(spark):
    from factloom.operators import conflict

    rows = lambda *m: spark.createDataFrame([("f", str(k), "$.a", k, x) for k, x in enumerate(m)], "source_file string, source_record_id string, source_field string, seq int, extraction_method string")
    assert conflict.cited(rows("direct_mapping", "human")).count() == 2
    for bad in ("guess", None):
        with pytest.raises(Exception, match="no method of citations"):
            conflict.cited(rows("human", bad)).collect()


def test_a_pattern_has_one_tenant(spark):
    specs = lambda *r: spark.createDataFrame(list(r), "tenant string, file_pattern string, spec_version int, status string")
    one = [("t", "a.json", 1, "active"), ("t", "a.json", 2, "active"), ("u", "b.json", 1, "active"), ("u", "a.json", 9, "draft")]
    assert {(r.file_pattern, r.tenant, r.spec_version) for r in store.sole_specs(specs(*one)).collect()} == {("a.json", "t", 2), ("b.json", "u", 1)}
    with pytest.raises(Exception, match="several tenants have an active spec for a.json: t, u"):
        store.sole_specs(specs(*one, ("u", "a.json", 1, "active"))).collect()
