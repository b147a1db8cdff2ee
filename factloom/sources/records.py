"""Record scans: JSON, JSONL and CSV files as (source_file, ordinal, record JSON text).

Ordinals follow the place in the file: (byte block of the scan, row in it) for line formats, the
position in the array for JSON. The texts are kept as they stand; VARIANT is parsed from them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import jsonpath

#: Formats by suffix.
FORMATS = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv"}


def guess_format(path: str) -> str:
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown format {suffix!r} of {path}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[suffix]


def _name():
    return F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)


def read(spark: SparkSession, path: str, fmt: str | None = None, record_path: str = "$[*]", name: str | None = None) -> DataFrame:
    fmt = {"ndjson": "jsonl"}.get(fmt or guess_format(path), fmt or guess_format(path))
    file = F.lit(name) if name else _name()
    if fmt == "json":
        whole = spark.read.text(path, wholetext=True).select(file.alias("source_file"), F.parse_json("value").alias("v"))
        found = whole.select("source_file", F.posexplode(jsonpath.matches(F.col("v"), jsonpath.parse(record_path))).alias("ordinal", "r"))
        return found.select("source_file", F.col("ordinal").cast("long").alias("ordinal"), F.to_json("r").alias("record"))
    if fmt == "jsonl":
        lines = spark.read.text(path).select(file.alias("source_file"), F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("record"))
        return lines.where(F.trim("record") != "")
    if fmt == "csv":
        rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue=None, emptyValue="")
        return rows.select(file.alias("source_file"), F.monotonically_increasing_id().alias("ordinal"), F.to_json(F.struct(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])).alias("record"))
    raise ValueError(f"unknown format {fmt!r}")


def sample(records: DataFrame, n: int) -> DataFrame:
    """The first n records."""
    return records.orderBy("source_file", "ordinal").limit(n)
