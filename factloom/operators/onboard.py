"""A first mapping spec for an unknown source, drafted from a sample of its records.

The draft is deterministic: leaf paths become attributes, the path most like an id (named so, one
value a record, never missing) the template. A draft is checked, stamped with the sample's
drift signals, and saved with status draft until it is promoted.
"""

from __future__ import annotations

import dataclasses
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import ingest
from factloom.plans import spec as S
from factloom.sources.records import guess_format, read, sample


def draft(records: DataFrame, tenant: str, file_pattern: str, fmt: str, canonical_type: str = "Document", n: int = 50) -> S.MappingSpec:
    some = sample(records, n).cache()
    total = some.count()
    if not total:
        raise ValueError("no records to draft a spec from")
    seen = ingest.leaf_paths(some).groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()
    tags = {r["path"]: r["tag"] for r in ingest.type_fingerprint(some).collect()}
    some.unpersist()
    flat = {r["path"]: r["n"] for r in seen if "[*]" not in r["path"] and r["path"] != "$"}
    always = sorted(p for p, k in flat.items() if k == total and "null" not in tags.get(p, ""))
    if not always:
        raise ValueError("no path that every record has: no id can be drafted")
    key = min(always, key=lambda p: (not re.search(r"(^|[._])id$|_id$|Id$|^\$\.id", p), len(p), p))
    name = lambda p: re.sub(r"\W+", "_", p[2:])
    fields = [{"attribute": name(p), "source": p, "required": p == key, "transform": ["normalize_email"] if tags[p] == "email_like" else []} for p in sorted(flat)]
    made = S.load({"tenant": tenant, "source": {"file_pattern": file_pattern, "format": fmt}, "nodes": [{"name": "record", "canonical_type": canonical_type, "id_template": canonical_type.lower() + ":{" + name(key) + "}", "fields": fields}]})
    return dataclasses.replace(made, required_paths_hash=ingest.required_paths_hash(ingest.required_paths(made)), type_fingerprint={p: tags[p] for p in sorted(flat)})


def onboard(spark, path: str, tenant: str, canonical_type: str = "Document") -> S.MappingSpec:
    fmt = guess_format(path)
    return draft(read(spark, path, fmt), tenant, path.rsplit("/", 1)[-1], fmt, canonical_type)


def saved(specs: DataFrame | None, spark, spec: S.MappingSpec, status: str = "draft") -> DataFrame:
    """The table of specs with one inserted or replaced (key: tenant, file pattern, version)."""
    row = spark.createDataFrame([(spec.tenant, spec.source.file_pattern, spec.spec_version, status, json.dumps(dataclasses.asdict(spec)))], "tenant string, file_pattern string, spec_version int, status string, body string")
    key = ["tenant", "file_pattern", "spec_version"]
    return row if specs is None else specs.join(row.select(*key), key, "left_anti").unionByName(row)


def promoted(specs: DataFrame, tenant: str, version: int) -> DataFrame:
    return specs.withColumn("status", F.when((F.col("tenant") == tenant) & (F.col("spec_version") == version), F.lit("active")).otherwise(F.col("status")))
