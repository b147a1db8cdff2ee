"""Queries and operators against plain versions that read everything."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import ingest, search, store, views, workflows
from factloom.plans import queries_search
from factloom.plans import spec as S


def test_texts_are_read_to_the_end(spark, tmp_path):
    filler = "some words of a turn that go on for well over forty characters "
    data = [(0, 0, "user", filler + "emp_901 [node:doc:77] ticket-z9 customer_1 cust_2 CUST_2"), (0, 1, "user", filler * 3 + "CUST-55 Ab"), (1, 0, "assistant", "short emp_3")]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: queries_search.QUERIES[name][0](spark, str(tmp_path)).collect()
    found = lambda name: {(r["conv_id"], r["turn"]): r["found"].split(",") for r in run(name)}
    made = lambda c, t: [f"emp_{t}", f"CUST-{c}", f"order-x{t}", f"sale_{t}"]
    ids, cited, light = found("id_tokens"), found("cited_nodes"), found("light_ner")
    assert ids[0, 0] == ["emp_901", "emp_0", "CUST-0", "ticket-z9", "order-x0", "sale_0"] and set(ids[0, 1]) == {"CUST-55", *made(0, 1)}
    assert cited == {(0, 0): ["doc:77", "person:0"], (0, 1): ["person:0"], (1, 0): ["person:1"]}
    assert light[0, 0] == ["emp_901", "customer_1", "cust_2", "emp_0", "sale_0"] and light[0, 1] == ["emp_1", "sale_1"]
    tp, n = Counter(), Counter()
    for _, _, role, text in data:
        words = set(text.split(" "))
        tp[role] += sum(len(w) > 3 for w in words)
        n[role] += len(words)
    assert {r["type"]: (r["tp"], r["fn"], r["f1"]) for r in run("ner_f1")} == {k: (tp[k], n[k] - tp[k], round(2 * tp[k] / (tp[k] + n[k]), 6)) for k in n}


def test_vector_queries_are_all_rows_divisible_by_20(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(200)]
    vectors[150:170] = [list(vectors[20])] * 20  # equal scores beyond the 10 best
    spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"the of and {i}") for i in range(30)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    v = [[float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").orderBy("vec_id").collect()]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    scores = {q: {f"doc:{i}": dot(v[q], x) / (dot(v[q], v[q]) * dot(x, x)) ** 0.5 for i, x in enumerate(v)} for q in range(0, 200, 20)}
    best = {(q, i) for q, s in scores.items() for i in sorted(s, key=lambda i: (-round(s[i], 6), i))[:10]}
    top50 = {q: sorted(s, key=lambda i: (-round(s[i], 12), i))[:50] for q, s in scores.items()}
    recall = sum(f"doc:{q * 3}" in t or f"doc:{q + 1}" in t for q, t in top50.items()) / len(top50)
    run = lambda name: queries_search.QUERIES[name][0](spark, str(tmp_path)).collect()
    for rows in (4096, 16):
        monkeypatch.setattr(search, "BLOCK_ROWS", rows)
        got = run("vector_topk")
        assert {(r["qid"], r["id"]) for r in got} == best and len(got) == len(best)
        assert all(abs(r["score"] - scores[r["qid"]][r["id"]]) < 1e-6 for r in got)
    assert run("recall_at_k")[0]["recall"] == round(recall, 6)
    fused, tiers = run("hybrid_topk"), run("cascade_batch")
    assert {r["qid"] for r in fused} == set(scores) and sorted(r["qid"] for r in tiers) == sorted(scores)
    assert all(r["id"] in sorted(scores[r["qid"]], key=lambda i: (-scores[r["qid"]][i], i))[:30] or int(r["id"][4:]) < 30 for r in fused)


def test_thread_asks_for_every_participant_and_token():
    asked = []

    def hybrid(q):
        asked.append(q)
        return search.Result("hybrid", 1.0, [(f"node-{q.lower()}", 0.5), ("shared", 0.1 * len(asked))])

    box = workflows.Toolbox(None, None, search.Cascade({"exact": search.stub, "hybrid": hybrid}))
    people = [f"person {i}" for i in range(8)]
    got = workflows.thread_summary(box, [*people, " ", people[0].upper()], ["see ticket_a1 and order_7, order_7", "prod_3 product_x9 emp_12 CUST-5 customer_5 sale_4"])
    want = [*people, "ticket_a1", "order_7", "prod_3", "product_x9", "emp_12", "customer_5", "sale_4"]
    assert asked == want and {i for i, _ in got["hits"]} == {f"node-{q.lower()}" for q in want} | {"shared"}
    assert dict(got["hits"])["shared"] == pytest.approx(0.1 * len(want))

    class Greedy:  # asks for ten calls at once and answers when no tool is offered
        def turn(self, messages, tools):
            return {"calls": [{"name": "nope"}] * 10} if tools else {"answer": f"after {sum(m['role'] == 'tool' for m in messages)}"}

    got = workflows.thread_summary(box, people, [], Greedy())
    assert got["tool_calls"] == 6 and got["brief"] == "after 6"


class Names:
    """Finds capitalised words; one that is not there is added, and a marked text breaks it."""

    def extract(self, prompt, schema):
        text = prompt.split("INPUT:\n")[1]
        if "broken" in text:
            return ["no object"]
        return {"items": [{"name": w, "surface_form": w, "confidence": 0.9} for w in [*re.findall(r"\b[A-Z][a-z]+\b", text), "Ghost"]]}


@pytest.mark.parametrize("grounding", [True, False])
def test_ingest_materialises_model_blocks(spark, grounding):
    field = lambda a, p: {"attribute": a, "source": p}
    data = {
        "tenant": "t", "source": {"file_pattern": "f.json", "format": "json"},
        "nodes": [{"name": "doc", "canonical_type": "Document", "id_template": "doc:{id}", "fields": [field("body", "$.body")]}, {"name": "who", "canonical_type": "Person", "id_template": "person:{name}", "when": {"exists": "$.name"}, "fields": [field("name", "$.name")]}],
        "edges": [{"canonical_type": "MENTIONS", "source_node": "@doc", "target_node": "@who"}],
        "llm_blocks": [{"name": "names", "input_source": "$.body", "prompt_template": "Names?", "output_schema": {"type": "object"}, "cache_key": ["$.body"], "output_node_rule": "who", "output_edge_rule": "MENTIONS", "require_grounding": grounding, "max_extractions_per_record": 3}],
    }
    spec = S.load(data)
    long = "x " * 5000 + "Zoe"  # the name stands past any prefix
    bodies = ["met Ann", "broken Bob", "Ann Bo Cy Di", long, "met Ann"]
    records = spark.createDataFrame([("f.json", i, f'{{"id": "{i}", "body": "{b}"}}') for i, b in enumerate(bodies)], "source_file string, ordinal long, record string")
    with pytest.raises(ValueError, match="extractor"):
        ingest.ingest(records, spec)
    got = ingest.ingest(records, spec, extractor=Names())
    ghost = [] if grounding else ["Ghost"]
    found = {0: ["Ann", *ghost], 2: ["Ann", "Bo", "Cy"], 3: ["Zoe", *ghost], 4: ["Ann", *ghost]}
    assert {(r["src"], r["dst"]) for r in got.edges.collect()} == {(f"doc:{i}", f"person:{w}") for i, ws in found.items() for w in ws}
    people = got.nodes.where("type = 'Person'").collect()
    assert sorted((r["ordinal"], r["id"]) for r in people) == sorted((i, f"person:{w}") for i, ws in found.items() for w in ws)
    facts = got.provenance.where("extraction_method = 'llm_extraction' and node_id is not null").collect()
    assert {(r["node_id"], r["confidence"]) for r in facts} == {(f"person:{w}", "inferred" if w == "Ghost" else "grounded") for ws in found.values() for w in ws}
    assert got.answers.count() == 4 and got.answers.where("error is not null").count() == 1  # equal inputs are asked once
    again = ingest.ingest(records.where("ordinal <> 1"), spec, extractor=Silent(), cache=got.answers)
    assert again.edges.count() == got.edges.count()


class Silent:
    def extract(self, prompt, schema):
        raise RuntimeError("the cache holds every answer")


def test_store_pointers(spark, tmp_path):
    """An unfinished pointer is ignored, and one that is there is never overwritten."""
    s = store.Store(spark, str(tmp_path / "s"))
    s.write(nodes=spark.range(3))
    (tmp_path / "s" / "CURRENT-000000000002").write_text("nodes\tnodes/none\n")
    assert s.read("nodes").count() == 3
    s.write(nodes=spark.range(5))
    assert s.read("nodes").count() == 5
    other = store.Store(spark, str(tmp_path / "s"))
    other._pointers = lambda: ["CURRENT-000000000001"]  # has not seen the last writes
    with pytest.raises(Exception, match="(?i)exist"):
        other.write(nodes=spark.range(1))
    assert s.read("nodes").count() == 5


def test_views(spark):
    rows = spark.createDataFrame([(1, {"date": "1700000000000", "name": '" A "'}), (2, {"sent_at": '"x"', "title": "5"}), (3, None)], "id int, a map<string,string>")
    got = {r["id"]: r for r in rows.select("id", views.derived_time(F.col("a")).alias("t"), views.workflow_preview(F.lit("T"), F.col("a")).alias("p")).collect()}
    assert str(got[1]["t"]) == "2023-11-14 22:13:20" and got[1]["p"] == "T: A" and got[2]["t"] is None and got[2]["p"] == got[3]["p"] == "T: <no preview>"
    with pytest.raises(ValueError):
        views.within(rows, 5, F.current_timestamp())
