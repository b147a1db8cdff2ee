"""Turns of conversations in order, over range partitions: a conversation of any length is split
over as many of them as it fills, and what crosses their borders is two rows a partition."""

from __future__ import annotations

import math

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

#: Bytes of turns that a range partition is meant to hold.
PART_BYTES = 32 << 20
#: Characters of role and text that turns of one number are ordered by, before a hash.
TIE_CHARS = 64


def tie_keys(role: Column, text: Column) -> list[Column]:
    """The order of rows of one turn: by the first 64 characters of role, then of text, then by a
    hash of both. Rows that agree in all are equal, and may be dealt to several partitions."""
    return [F.substring(role, 1, TIE_CHARS), F.substring(text, 1, TIE_CHARS), F.xxhash64(role, text)]


def ordered(turns: DataFrame, n_bytes: Column, keep: list[Column], conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`keep` of all turns, sorted by conversation and turn (nulls first) over range partitions,
    with the lineage cut: partition k of what is returned is the k-th range, row after row."""
    spark = turns.sparkSession
    total = turns.agg(F.sum(n_bytes)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES))
    made = turns.select(*keep, F.col(turn).alias("_turn"), *[k.alias(f"_k{i}") for i, k in enumerate(tie_keys(F.col(role), F.col(text)))], F.monotonically_increasing_id().alias("_any"))
    keys = [F.col(c).asc_nulls_first() for c in (conv, "_turn", "_k0", "_k1", "_k2")]
    # equal rows are told apart by their place, so that a third of all rows may be equal
    return cut(made.repartitionByRange(n, *keys, F.col("_any")).sortWithinPartitions(*keys).drop("_turn", "_k0", "_k1", "_k2", "_any"))


def partition() -> int:
    """The number of the partition that the running task reads."""
    return TaskContext.get().partitionId()


def chains(borders: list) -> list[list]:
    """Rows about the first and (if it is another) the last conversation of each partition, in order
    (part, conv_id), grouped by conversation: those that cross a border."""
    out: list[list] = []
    for row in borders:
        joins = out and out[-1][-1].conv_id == row.conv_id and out[-1][-1].part != row.part
        if joins:
            out[-1].append(row)
        else:
            out.append([row])
    return [c for c in out if len(c) > 1]
