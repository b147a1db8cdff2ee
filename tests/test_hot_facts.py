"""The conflict fold in pieces against the fold of whole rows."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import conflict, fold_pieces

SCHEMA = "node_id string, attribute string, seq long, value string, norm string, confidence string, source_file string, source_record_id string"


def history(rng, node, n):
    out = []
    for k in range(n):
        value = rng.choice(["A", "a", "B", "b", "c", None])
        out.append((node, "x", k, value, value and value.lower(), rng.choice(["human", "exact", "exact", "grounded", "inferred", "inferred", None]), rng.choice(["f", "g", None]), rng.choice(["1", "2", "3"])))
    return out


def rows(df):
    return sorted(map(repr, df.select("node_id", "attribute", "value", "norm", "confidence", "source_file", "source_record_id", F.to_json("open").alias("open"), "n_facts").collect()))


@pytest.mark.parametrize("seed", range(6))
def test_pieces_equal_whole_rows(spark, seed):
    rng = random.Random(seed)
    all_ = [f for k in range(40) for f in history(rng, f"n{k}", rng.choice([1, 2, 3, 7, 30, 120]))]
    df = spark.createDataFrame(all_, SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert fold_pieces.maps(df).count() > 50  # histories are cut
        assert rows(fold_pieces.fold(df)) == rows(conflict._fold_rows(df, None, "reference"))
        early, late = df.where("seq % 3 <> 2 and seq < 20"), df.where("seq >= 20")
        state = conflict._fold_rows(early, None, "reference")
        assert rows(fold_pieces.fold(late, state)) == rows(conflict._fold_rows(late, state, "reference"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("most", [0, 100_000])
def test_hot_keys_are_folded_in_pieces(spark, monkeypatch, most):
    rng = random.Random(9)
    df = spark.createDataFrame(history(rng, "hot", 90) + history(rng, "cold", 5), SCHEMA)
    want = rows(conflict.fold(df))
    monkeypatch.setattr(conflict, "HOT_FACTS", 20)
    monkeypatch.setattr(conflict, "BROADCAST_KEYS", most)
    got = conflict.fold(df)
    assert rows(got) == want and "Window" in got._jdf.queryExecution().toString()
    assert conflict.fold(df.limit(0)).count() == 0
