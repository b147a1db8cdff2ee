"""Queries over tables whose keys, orders and rows are those of larger inputs, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.sources import bench_graph

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "region", "nation", "documents", "embeddings", "pages", "labels", "conversations")


def _tables(root, **changed):
    """A folder of the smallest tables, some of them by a query over `t`."""
    for name in TABLES:
        rows = changed.get(name, "SELECT * FROM t").replace("FROM t", f"FROM '{SF}/{name}.parquet'")
        duckdb.sql(f"COPY ({rows}) TO '{root}/{name}.parquet' (FORMAT parquet)")
    return str(root)


def _same(spark, name, d):
    found = sorted(map(tuple, entry.queries()[name](spark, d).collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    expected = sorted(con.sql(entry.oracle_sql()[name]).fetchall(), key=repr)
    assert found == expected
    return found


def test_phone_numbers_of_large_keys_differ(spark, tmp_path):
    # a number cut to four digits made one of 20,000 / 20 and of 200,000 / 20
    d = _tables(tmp_path, customer="SELECT * REPLACE (k AS c_custkey) FROM (SELECT *, unnest([20000, 20010, 200000, 200010]) AS k FROM t LIMIT 4)")
    assert {r[2] for r in _same(spark, "identity_groups", d)} == {2}


@pytest.mark.parametrize("name", ["decide_table", "router_entities", "router_intent"])
def test_what_was_made_up_is_read(spark, name, tmp_path):
    # results grow with the table: half of its rows give fewer
    whole = _same(spark, name, _tables(tmp_path))
    half = "SELECT * FROM t WHERE o_orderkey % 2 = 0" if name == "decide_table" else "SELECT * FROM t WHERE conv_id % 2 = 0"
    (other := tmp_path / "half").mkdir()
    assert _same(spark, name, _tables(other, **{"orders" if name == "decide_table" else "conversations": half})) != whole
    if name == "router_intent":
        assert {r[3] for r in whole} == {"lookup", "analytical", "ambiguous", "search"}


def test_records_of_one_file_are_parsed_in_many_tasks(spark):
    from factloom.operators import ingest
    from factloom.plans.queries_facts import SPEC, _records

    got = ingest.ingest(_records(spark, SF).coalesce(1), SPEC)
    plan = got.nodes._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan or "Repartition" in plan


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    from factloom.operators import graph
    from factloom.sources import bench_graph

    monkeypatch.setattr(bench_graph, "TASK_LINES", 100)
    parts = bench_graph.parts(spark, SF)
    assert parts > 40
    assert graph.distinct_links(bench_graph.edges(spark, SF), parts=parts).rdd.getNumPartitions() >= parts


def test_facts_are_dealt_by_their_number(spark, monkeypatch):
    from factloom.operators import conflict
    from factloom.plans.queries_scale import _hot_lines

    facts = _hot_lines(spark, SF)
    usual = sorted(map(str, conflict.fold(facts).collect()))
    monkeypatch.setattr(conflict, "TASK_FACTS", 50)
    dealt = conflict.fold(facts)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, dealt.collect())) == usual


def test_probes_hold_few_vectors_at_a_time():
    import pyarrow as pa

    from factloom.operators.vector_store import HELD, _slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["key"])
    cut = list(_slices([batch], 1000))
    assert sum(b.num_rows for b in cut) == 10_000 and max(b.num_rows for b in cut) * 1000 <= HELD


def test_joins_of_paths_send_nothing_to_the_driver(spark):
    from factloom.operators import paths

    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "src string, dst string").withColumn("relation_type", __import__("pyspark").sql.functions.lit("R"))
    found = paths.shortest_paths(edges, spark.createDataFrame([("p", "0", "9")], "pair string, source string, target string"))
    assert found.first()["path"] == [str(i) for i in range(10)]


def test_hash_vectors_are_arrays():
    import numpy as np
    import pandas as pd

    from factloom.functions.text import hash_embedded, hash_embedding

    made = hash_embedded.func(pd.Series(["a", None]))
    assert isinstance(made[0], np.ndarray) and made[0].tolist() == hash_embedding("a") and made[1] is None


def test_orders_are_dealt_like_their_lines(spark, monkeypatch):
    # the ends of edges are counted by hash in the task that reads them, and one task read a file's orders
    monkeypatch.setattr(bench_graph, "TASK_LINES", 300)
    e = bench_graph.edges(spark, SF).where("relation_type = 'ASSIGNED_TO'").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in e) == 1500 and max(r["count"] for r in e) <= 300
