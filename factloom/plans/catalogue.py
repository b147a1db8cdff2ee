"""Named queries over the driver's tables and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import queries_facts, queries_graph, queries_more, queries_records, queries_scale, queries_search
from factloom.session import ship

_ALL = {**queries_graph.QUERIES, **queries_facts.QUERIES, **queries_search.QUERIES, **queries_more.QUERIES, **queries_scale.QUERIES, **queries_records.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and what they purchased: a typed pattern over the graph of the tables."""
    return queries()["pattern_purchased"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return make(spark, sf_dir)

        return run

    return {name: shipped(make) for name, (make, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
