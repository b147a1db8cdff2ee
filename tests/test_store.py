"""The store: pruned lookups, deletes, writers at once, cleaning."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import store as st
from factloom.operators.store import Store


def many_files(spark, root, n=1000):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = Store(spark, root)
        s.write(nodes=spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("Person").alias("type"), F.lit(1).alias("version")))
        return s
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_few_keys_open_few_files(spark, tmp_path):
    s = many_files(spark, str(tmp_path))
    assert len(s.read("nodes").inputFiles()) > 500
    keys = spark.range(7, 20_000, 2_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id")).unionByName(spark.createDataFrame([("nobody",), (None,)], "id string"))
    got = s.touched("nodes", keys)
    assert got.count() == 10 and len(got.inputFiles()) <= 11
    s.add(nodes=keys.where("id is not null").withColumns({"type": F.lit("Person"), "version": F.lit(2)}))
    assert {r.version for r in s.touched("nodes", keys).collect()} == {2}
    assert s.touched("nodes", keys.limit(0)).count() == 0


def test_many_keys_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FEW_KEYS", 3)
    s = Store(spark, str(tmp_path))
    s.write(nodes=spark.range(50).selectExpr("cast(id as string) id", "id * 2 as x"))
    assert {r.x for r in s.touched("nodes", spark.range(9).selectExpr("cast(id as string) id")).collect()} == {2 * k for k in range(9)}


def test_deletes_hold_for_what_was_there(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    node = lambda *x, v=1: spark.createDataFrame([(i, v) for i in x], "id string, version int")
    edge = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "c")], "id string, src string, dst string")
    facts = lambda *x: spark.createDataFrame([(i, "name", f"{i}{v}") for i, v in x], "node_id string, attribute string, value string")
    notes = spark.createDataFrame([("a", None), ("b", None), (None, "e1"), (None, "e3"), (None, None)], "node_id string, edge_id string")
    s.write(nodes=node("a", "b", "c"), edges=edge, attributes=facts(("a", 1), ("b", 1)), provenance=notes)
    st.delete_stored_nodes(s, ids("a", "a", "nobody"))
    assert {r.id for r in s.read("nodes").collect()} == {"b", "c"} and {r.id for r in s.read("edges").collect()} == {"e2", "e3"}
    assert {tuple(r) for r in s.read("provenance").collect()} == {("b", None), (None, "e3"), (None, None)}
    s.add(nodes=node("a", v=2), provenance=spark.createDataFrame([("a", None)], "node_id string, edge_id string"))
    assert {(r.id, r.version) for r in s.read("nodes").collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert {r.node_id for r in s.read("attributes").collect()} == {"b"}  # its old facts stay gone
    assert s.touched("attributes", facts(("a", 0))).count() == 0 and s.read("provenance").where("node_id = 'a'").count() == 1
    st.delete_stored_edges(s, ids("e3"))
    assert {r.id for r in s.read("edges").collect()} == {"e2"} and s.read("provenance").where("edge_id is not null").count() == 0
    monkeypatch.setattr(st, "PARTS", 2)
    s.add(attributes=facts(("b", 2), ("a", 3)))
    assert {(r.node_id, r.value) for r in s.read("attributes").collect()} == {("b", "b2"), ("a", "a3")}
    assert len(s._current()["attributes"].split(",")) == 1  # written as one, without what is gone
    s.delete(nodes=ids("a"), runs=ids("x"))
    assert s.read("nodes").count() == 2
    with pytest.raises(ValueError):
        s.write(nonsense=ids("a"))


def test_one_row_a_key_is_checked(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    with pytest.raises(Exception, match="several rows of one key"):
        s.write(nodes=spark.createDataFrame([("a", 1), ("a", 2)], "id string, version int"))
    assert not s.has("nodes")


def test_writers_at_once(spark, tmp_path):
    """Tables of a faster writer are taken over; one that both changed is an error."""
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.write(nodes=spark.range(1), runs=spark.range(1))
    stale = two._pointers(), two._current()
    one.add(runs=spark.range(2))
    two._pointers = lambda: stale[0]
    two._current = lambda: dict(stale[1])
    two.write(nodes=spark.range(7))
    assert one.read("nodes").count() == 7 and one.read("runs").count() == 3
    with pytest.raises(FileExistsError, match="runs"):
        two.add(runs=spark.range(1))


def test_cleaning_keeps_what_is_named(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for k in range(3):
        s.write(nodes=spark.range(k + 1).selectExpr("cast(id as string) id"), runs=spark.range(k))
    assert len(s.cleaned()) == 4 and s.read("nodes").count() == 3 and s.read("runs").count() == 2
    assert sorted(os.listdir(tmp_path / "nodes"))[0].split(".")[0] in s._current()["nodes"] and s.cleaned() == []
    s.write(runs=spark.range(1))
    assert s.read("runs").count() == 1
