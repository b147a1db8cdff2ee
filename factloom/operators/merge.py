"""Ingested rows merged into a stored graph: nodes, edges, attribute values, conflicts, run ledger.

A batch is merged at the cost of what it touches: the stored rows of its ids are looked up, folded
with its own, and added to the store as one part. Attribute values are a table of their own, the
state of the conflict fold; a node's attributes are a view of it (`graph_nodes`). All facts are
kept as provenance, those that lose too. Empty batches change nothing; a null attribute value is no
fact; one id with two types fails the batch, and the store stays as it was.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import jsonpath
from factloom.functions.text import casefolded, content_hash, json_text, stripped
from factloom.operators import conflict, ingest
from factloom.operators.store import Store, merge_edges, merge_nodes, problems
from factloom.plans.spec import MappingSpec
from factloom.registry import HUMAN_EDITS
from factloom.session import discard

RUN = "run_id string, tenant string, source_pattern string, spec_version int, source_path string, status string, records_in long, records_out long, records_skipped long, records_dead long, error string, started_at timestamp, ended_at timestamp"
PLACE = ["source_file", "source_record_id"]


def compared(value):
    """JSON text in the form in which values are compared: strings stripped and case-folded."""
    text = jsonpath.as_string(value)
    plain = F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(stripped(text))).otherwise(casefolded(text))
    return F.when(value.startswith('"'), F.concat(F.lit('"'), plain)).otherwise(value)


def facts(provenance: DataFrame) -> DataFrame:
    """The facts of an ingestion's provenance, in the order of its records and rules."""
    own = provenance.where("node_id is not null and attribute is not null and value is not null")
    return own.select("node_id", "attribute", F.struct("source_file", "ordinal", "rule").alias("seq"), "value", compared(F.col("value")).alias("norm"), "confidence", *PLACE)


def edge_facts(provenance: DataFrame) -> DataFrame:
    """The facts about edges, as `conflict.fold` takes them: node_id is the edge's id."""
    own = provenance.where("edge_id is not null and attribute is not null and value is not null")
    return own.select(F.col("edge_id").alias("node_id"), "attribute", F.struct("source_file", "ordinal", "attribute").alias("seq"), "value", compared(F.col("value")).alias("norm"), "confidence", *PLACE)


def _of_edges(state: DataFrame, back: bool = False) -> DataFrame:
    return state.withColumnRenamed("node_id", "edge_id") if not back else state.withColumnRenamed("edge_id", "node_id")


def merged(got: ingest.Ingested, at, nodes: DataFrame | None = None, edges: DataFrame | None = None, attributes: DataFrame | None = None, edge_attributes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The new rows of all nodes, edges and attributes of both that an ingestion touches. `nodes`,
    `edges`, `attributes` and `edge_attributes` are the stored rows of the same keys (more do no harm
    to attributes), `at` the time of the merge (a Column): an edge is valid from when it was first
    stated, and last stated at valid_to."""
    n = got.nodes.select("id", "type", at.alias("updated_at"))
    e = got.edges.select("id", "src", "dst", "relation_type", F.create_map().cast("map<string,string>").alias("attributes"), at.alias("valid_from"), at.alias("valid_to"), F.struct("source_file", "ordinal").alias("seq"))
    if nodes is None:
        nodes = n.select("id", "type", F.col("updated_at").alias("created_at"), "updated_at", F.lit(0).cast("long").alias("version")).limit(0)
    if edges is None:
        edges = e.drop("seq").withColumn("version", F.lit(0).cast("long")).limit(0)
    out = {"nodes": merge_nodes(nodes, n), "edges": merge_edges(edges, e), "attributes": conflict.fold(facts(got.provenance), attributes)}
    if got.edge_fields:
        held = None if edge_attributes is None else _of_edges(edge_attributes, back=True)
        out["edge_attributes"] = _of_edges(conflict.fold(edge_facts(got.provenance), held))
    return out


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of `new`, and those of `old` with other keys."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def graph_nodes(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Nodes with their attribute map (name to JSON text)."""
    maps = attributes.groupBy(F.col("node_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias("attributes"))
    return nodes.join(maps, "id", "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def graph_edges(edges: DataFrame, edge_attributes: DataFrame) -> DataFrame:
    """Edges with their attribute map (name to JSON text); what an edge itself holds comes first."""
    maps = edge_attributes.groupBy(F.col("edge_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias("_own"))
    both = F.map_zip_with(F.coalesce("attributes", F.create_map().cast("map<string,string>")), F.coalesce("_own", F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(a, b))
    return edges.join(maps, "id", "left").withColumn("attributes", both).drop("_own")


def statements(provenance: DataFrame) -> DataFrame:
    """By edge and attribute, and each value it was given, the first and the last record that says so."""
    said = provenance.where("edge_id is not null and attribute is not null and value is not null")
    at = F.struct("source_file", "ordinal", "source_record_id")
    return said.groupBy("edge_id", "attribute", "value").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


class Refused(ValueError):
    """Rows that the rules of a store forbid."""


def _checked(store: Store, got: ingest.Ingested) -> None:
    """Refuses provenance that `store.problems` names, and edges an end of which is neither stored nor
    new. Only ends that are not new are looked up."""
    bad = problems(got.provenance, got.raw).select(F.concat(F.lit("provenance: "), "problem").alias("why"))
    loose = ingest.missing_ends(got.edges.select("id", "src", "dst"), got.nodes)
    ends = loose.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    held = store.touched("nodes", ends)
    if held is not None:
        loose = ingest.missing_ends(loose, got.nodes.select("id").union(held.select("id")))
    row = bad.unionByName(loose.select(F.concat(F.lit("loose edge "), "id").alias("why"))).first()
    if row is not None:
        raise Refused(row["why"])


def commit(store: Store, got: ingest.Ingested, mark_seen: bool = True, also: dict[str, DataFrame] | None = None, ordered: bool = False) -> None:
    """Everything of one ingestion becomes visible at once, or is refused. With `ordered` the facts of
    all ingestions count in the order of their files and places, whenever they come: the attributes
    that this one touches are folded again from all that is kept about them, but for those that a
    person has given a value."""
    _checked(store, got)
    raw = got.raw.groupBy(*PLACE).agg(F.max_by(F.struct("raw_record", "content_hash"), "ordinal").alias("r")).select(*PLACE, "r.*").withColumn("ingested_at", F.current_timestamp())
    held = store.touched("source_records", raw)
    if held is not None:  # a record that is the same stays as it is
        raw = raw.join(held.select(*PLACE, "content_hash"), [*PLACE, "content_hash"], "left_anti")
    new = merged(
        got, F.current_timestamp(), store.touched("nodes", got.nodes), store.touched("edges", got.edges),
        store.touched("attributes", got.provenance.where("node_id is not null and attribute is not null")),
        store.touched("edge_attributes", got.provenance.where("edge_id is not null and attribute is not null")) if got.edge_fields else None,
    )
    if ordered and store.has("provenance"):
        new["attributes"] = _ordered(store, got, new["attributes"])
    new |= {"provenance": got.provenance, "dead_letters": got.dead, "source_records": raw, **(also or {})}
    if mark_seen:
        new["seen"] = got.seen
    if got.answers is not None:
        new["extraction_cache"] = got.answers.where("error is null").dropDuplicates(["block", "key"])
    store.add(**new)


def _ordered(store: Store, got: ingest.Ingested, folded: DataFrame) -> DataFrame:
    """`folded`, with the keys that no person has set folded anew from all their facts."""
    key = ["node_id", "attribute"]
    own = got.provenance.where("node_id is not null and attribute is not null").select(*key).distinct()
    old = store.matching("provenance", own.select("node_id").distinct()).join(own, key, "left_semi")
    set_ = old.where(F.col("source_file") == HUMAN_EDITS).select(*key).distinct()
    every = old.select(*got.provenance.columns).unionByName(got.provenance).join(set_, key, "left_anti")
    return conflict.fold(facts(every)).unionByName(folded.join(set_, key, "left_semi"))


def cached_answers(store: Store) -> DataFrame | None:
    return store.read("extraction_cache") if store.has("extraction_cache") else None


def run(store: Store, spec: MappingSpec, records: DataFrame, source_path: str = "", limit: int | None = None, dry_run: bool = False, extractor=None) -> dict:
    """One ingestion run: drift check, the first `limit` records if asked for, one row in the ledger.
    A dry run writes nothing; a run that fails leaves a row that says so, and raises."""
    if diffs := ingest.check_drift(records, spec):
        raise ingest.DriftError(f"records do not fit version {spec.spec_version} of the spec: {diffs}")
    if limit is not None:
        if limit < 0:
            raise ValueError("limit must not be negative")
        records = records.orderBy("source_file", "ordinal").limit(limit)
    spark, id_, began = records.sparkSession, uuid.uuid4().hex, datetime.now(timezone.utc)

    def row(status: str, n: dict, error: str | None) -> DataFrame:
        counts = [n.get(k, 0) for k in ("records_in", "records_out", "skipped", "dead")]
        return spark.createDataFrame([(id_, spec.tenant, spec.source.file_pattern, spec.spec_version, source_path, status, *counts, error, began, datetime.now(timezone.utc))], RUN)

    counts: dict = {}
    try:
        seen = store.read("seen") if store.has("seen") else None
        got = ingest.ingest(records, spec, seen, extractor, cached_answers(store), once=True)
        try:
            counts = ingest.report(got).first().asDict()
            if not dry_run:
                commit(store, got, also={"runs": row("completed", counts, None)})
        finally:
            discard(got.records)
    except Exception as e:
        if not dry_run:
            store.add(runs=row("failed", counts, str(e)[:1000]))
        raise
    return {"run_id": None if dry_run else id_, "dry_run": dry_run, **counts}


def bulk(store: Store, jobs: list[tuple[MappingSpec, DataFrame]], first: tuple[str, ...] = (), email: str | None = "email", extractor=None) -> list[dict]:
    """Runs in a fixed order, as merging depends on it: the file patterns of `first`, then the rest
    by file pattern; at last people with equal addresses are linked (`email`: their attribute)."""
    rank = {p: k for k, p in enumerate(first)}
    order = sorted(jobs, key=lambda j: (rank.get(j[0].source.file_pattern, len(rank)), j[0].source.file_pattern))
    out = [run(store, spec, records, spec.source.file_pattern, extractor=extractor) for spec, records in order]
    if email and store.has("attributes"):
        link_identities(store, email)
    return out


def link_identities(store: Store, email: str = "email", source: str = "identity_resolution") -> int:
    """SAME_AS edges between people with equal addresses, each with a provenance row and a stub raw
    record; how many are new."""
    people = store.read("nodes").where("type = 'Person'").select("id")
    named = store.read("attributes").where(F.col("attribute") == email).select(F.col("node_id").alias("id"), jsonpath.as_string(F.col("value")).alias("email"))
    pairs = ingest.identities(people.join(named, "id"))
    if store.has("edges"):
        pairs = pairs.join(store.read("edges").select(F.col("id").alias("edge_id")), "edge_id", "left_anti")
    n = pairs.count()
    if not n:
        return 0
    none = lambda kind: F.lit(None).cast(kind)
    body = F.to_json(F.struct("a", "b", "email"))
    edges = pairs.select(F.col("edge_id").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SAME_AS").alias("relation_type"), F.create_map(F.lit("email"), json_text(F.col("email"))).alias("attributes"), none("timestamp").alias("valid_to"), none("timestamp").alias("valid_from"), F.lit(1).cast("long").alias("version"))
    provenance = pairs.select(none("string").alias("node_id"), "edge_id", none("string").alias("attribute"), none("string").alias("value"), F.col("email").alias("raw_value"), F.lit("exact").alias("confidence"), F.lit("rule_based").alias("extraction_method"), F.lit(source).alias("source_file"), F.col("edge_id").alias("source_record_id"), F.lit("email").alias("source_field"), F.lit(0).cast("long").alias("ordinal"), none("int").alias("rule"))
    raw = pairs.select(F.lit(source).alias("source_file"), F.col("edge_id").alias("source_record_id"), body.alias("raw_record"), content_hash(body).alias("content_hash"), F.current_timestamp().alias("ingested_at"))
    store.add(edges=edges, provenance=provenance, source_records=raw)
    return n


# ---- people's edits and conflicts --------------------------------------------------------


def open_conflicts(store: Store, ids: DataFrame | None = None) -> DataFrame:
    """The open conflicts, of the nodes `ids` (id) only if given."""
    state = store.read("attributes").where("open is not null")
    if ids is not None:
        state = state.join(ids.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
    return conflict.queue(state)


def edit(store: Store, node_id: str, attributes: dict[str, str], closes: bool = False) -> str:
    """A person's values (JSON texts) overlaid on a node, with provenance and a raw record of the
    edit; gives the edit's id. KeyError for an unknown node. `closes` ends the attributes' conflicts."""
    spark = store.spark
    held = store.touched("nodes", spark.createDataFrame([(node_id,)], "id string"))
    node = held.first() if held is not None else None
    if node is None:
        raise KeyError(f"no node {node_id}")
    if not attributes:
        raise ValueError("an edit needs a value")
    id_ = uuid.uuid4().hex
    e = spark.createDataFrame([(node_id, k, v) for k, v in attributes.items()], "node_id string, attribute string, value string")
    by = {"confidence": F.lit("human"), "source_file": F.lit(HUMAN_EDITS), "source_record_id": F.lit(id_)}
    now = store.touched("attributes", e)
    old = F.lit(None).cast(conflict.OPEN)
    if now is None:
        e = e.withColumns({"open": old, "n_facts": F.lit(0).cast("long")})
    else:
        e = e.join(now.select("node_id", "attribute", "open", "n_facts"), ["node_id", "attribute"], "left")
    state = e.select("node_id", "attribute", "value", compared(F.col("value")).alias("norm"), *[c.alias(k) for k, c in by.items()], (old if closes else F.col("open")).alias("open"), (F.coalesce("n_facts", F.lit(0)) + 1).cast("long").alias("n_facts"))
    note = e.select("node_id", F.lit(None).cast("string").alias("edge_id"), "attribute", "value", jsonpath.as_string(F.col("value")).alias("raw_value"), by["confidence"].alias("confidence"), F.lit("human").alias("extraction_method"), by["source_file"].alias("source_file"), by["source_record_id"].alias("source_record_id"), F.col("attribute").alias("source_field"), F.lit(0).cast("long").alias("ordinal"), F.lit(None).cast("int").alias("rule"))
    body = F.lit("{" + ",".join(f"{ingest.json.dumps(k)}:{v}" for k, v in sorted(attributes.items())) + "}")
    raw = spark.range(1).select(by["source_file"].alias("source_file"), by["source_record_id"].alias("source_record_id"), body.alias("raw_record"), content_hash(body).alias("content_hash"), F.current_timestamp().alias("ingested_at"))
    again = held.withColumns({"version": F.col("version") + 1, "updated_at": F.current_timestamp()})
    store.add(attributes=state, provenance=note, source_records=raw, nodes=again)
    return id_


def resolve(store: Store, node_id: str, attribute: str, value: str) -> str:
    """Closes a conflict by a person's value (JSON text): KeyError if there is none, ValueError if it
    is closed already."""
    key = store.spark.createDataFrame([(node_id, attribute)], "node_id string, attribute string")
    found = store.touched("attributes", key) if store.has("attributes") else None
    row = found.select("open", "source_file").first() if found is not None else None
    if row is None or (row["open"] is None and row["source_file"] != HUMAN_EDITS):
        raise KeyError(f"no conflict about {attribute} of {node_id}")
    if row["open"] is None:
        raise ValueError(f"the conflict about {attribute} of {node_id} is closed")
    return edit(store, node_id, {attribute: value}, closes=True)
