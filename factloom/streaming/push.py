"""Records pushed as a stream: the batch plan for each micro-batch, over the versioned store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import ingest, merge
from factloom.operators.store import Store
from factloom.plans.spec import MappingSpec
from factloom.session import discard


def without_repeats(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """The stream's records, each once in `within` of its arrival. The watermark runs on arrival, so no
    record is late, whatever its place or its own times say, and the state holds what came within
    that time. What is repeated later is known to the ledger and skipped there."""
    marked = stream.withColumn("_arrived", F.current_timestamp()).withColumn("_same", F.sha2("record", 256))
    once = marked.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["source_file", "_same"])
    return once.drop("_arrived", "_same")


def apply_batch(store: Store, spec: MappingSpec, mark_seen: bool = True, extractor=None, cache: DataFrame | None = None, ordered: bool = False) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: ingests (source_file, ordinal, record), merges what it touches and
    commits all tables of the batch at once. With `mark_seen`, a batch that is run again changes nothing.
    With `ordered`, records may come in any order: attributes are what one batch of all would give."""

    def run(batch: DataFrame, _: int) -> None:
        seen = store.read("seen") if mark_seen and store.has("seen") else None
        known = cache if cache is not None else merge.cached_answers(store)
        got = ingest.ingest(batch, spec, seen, extractor, known, once=True)
        try:
            if got.records.where("status <> 'skipped'").limit(1).count():
                merge.commit(store, got, mark_seen, ordered=ordered)
        finally:
            discard(got.records)

    return run


def start(stream: DataFrame, store: Store, spec: MappingSpec, checkpoint: str, mark_seen: bool = True, extractor=None, within: str | None = None, ordered: bool = False, **trigger) -> StreamingQuery:
    """`within`: leave out what is repeated within that time of its arrival, before it is ingested."""
    stream = stream if within is None else without_repeats(stream, within)
    return stream.writeStream.foreachBatch(apply_batch(store, spec, mark_seen, extractor, ordered=ordered)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def apply_record(spark, store: Store, spec: MappingSpec, source_file: str, record: str, expect_id: str | None = None, mark_seen: bool = False, extractor=None) -> list[str]:
    """One record pushed: fails fast on a bad one; gives the ids of the nodes it touched."""
    one = spark.createDataFrame([(source_file, 0, record)], "source_file string, ordinal long, record string")
    got = ingest.ingest(one, spec, extractor=extractor)
    row = got.records.select("status", "error", "source_record_id").first()
    if row["status"] == "dead":
        raise ValueError(row["error"])
    if expect_id is not None and row["source_record_id"] != expect_id:
        raise ValueError(f"the record's id is {row['source_record_id']}, not {expect_id}")
    apply_batch(store, spec, mark_seen, extractor, got.answers)(one, 0)
    return [r["id"] for r in got.nodes.select("id").distinct().orderBy("id").collect()]


def push(spark, store: Store, spec: MappingSpec, source_file: str, record: str, expect_id: str | None = None, extractor=None) -> dict:
    """One record pushed: the ids it touched, and the conflicts that are open on them."""
    ids = apply_record(spark, store, spec, source_file, record, expect_id, extractor=extractor)
    own = merge.open_conflicts(store, spark.createDataFrame([(i,) for i in ids], "id string")) if store.has("attributes") else None
    return {"nodes": ids, "conflicts": [] if own is None else [r.asDict() for r in own.orderBy("node_id", "attribute").collect()]}


def spec_for(specs: list[MappingSpec], source_file: str, tenant: str | None = None) -> MappingSpec:
    """The newest spec of a file: KeyError if there is none, ValueError if several tenants have one."""
    fits = [s for s in specs if s.source.file_pattern == source_file and tenant in (None, s.tenant)]
    if not fits:
        raise KeyError(f"no spec for {source_file}")
    if len({s.tenant for s in fits}) > 1:
        raise ValueError(f"several tenants have a spec for {source_file}: name one")
    return max(fits, key=lambda s: s.spec_version)
