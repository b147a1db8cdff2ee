"""Ingestion: records and a spec to nodes, edges, provenance, raw records and dead letters.

One pass parses each record and evaluates every rule as columns; nodes, edges and provenance are
explosions of it. Records seen before (same spec version, file, id and content) are skipped,
also when they repeat within the run; bad ones become dead letters.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import jsonpath
from factloom.functions.text import NULLING, cache_key, content_hash, edge_id, get_transformer
from factloom.operators.fingerprint import leaf_paths, type_fingerprint  # noqa: F401
from factloom.operators.workflows import CachedExtractor, grounded
from factloom.plans.spec import FieldMap, MappingSpec, ModelBlock, NodeRule, predicate
from factloom.session import cut, ship, spread

SEEN = ["spec_version", "source_file", "source_record_id", "content_hash"]
ANSWERS = "block string, key string, items array<string>, error string"
FACTS = "array<struct<attribute:string,value:string,raw_value:string,source_field:string>>"


@dataclass(frozen=True)
class Ingested:
    records: DataFrame  # every record with its status: out, skipped or dead
    nodes: DataFrame
    edges: DataFrame
    provenance: DataFrame
    raw: DataFrame
    dead: DataFrame
    seen: DataFrame
    items: DataFrame | None = None  # of model blocks: every item kept, with its grade and what became of it
    answers: DataFrame | None = None  # of model blocks: block, key, items, error; those without error serve as `cache`
    edge_fields: bool = False  # whether the spec gives edges attributes; they are in `provenance`, by edge_id


def _field(variant: Column, f: FieldMap) -> tuple[Column, Column, Column, Column]:
    """JSON value after transforms, raw text, path used, error (null if fine)."""
    raw, which = jsonpath.coalesced(variant, f.paths)
    value, error = raw, F.when(raw.isNull() & F.lit(f.required), F.lit(f"{f.attribute}: required and missing"))
    text = jsonpath.as_string(raw)
    if f.transform:
        out, is_string = text, raw.startswith('"')
        for name in f.transform:
            made = get_transformer(name)(out)
            if name not in NULLING:
                error = F.coalesce(error, F.when(out.isNotNull() & made.isNull() & is_string, F.lit(f"{f.attribute}: {name} failed")))
            out = made
        quoted = F.when(out.isNotNull(), F.substring(F.to_json(F.struct(out.alias("v"))), F.lit(6), F.char_length(F.to_json(F.struct(out.alias("v")))) - 6))
        value = F.when(is_string, F.coalesce(quoted, F.when(raw.isNotNull(), F.lit("null")))).otherwise(raw)
    return value, text, which, error


def _facts(fields: list[FieldMap], values: list[tuple[Column, ...]]) -> Column:
    """The attributes that a rule's fields make, those without a value left out."""
    each = [F.struct(F.lit(f.attribute).alias("attribute"), x[0].alias("value"), x[1].alias("raw_value"), x[2].alias("source_field")) for f, x in zip(fields, values)]
    return F.filter(F.array(*each) if each else F.array().cast(FACTS), lambda a: a["value"].isNotNull())


def node_id(variant: Column, rule: NodeRule) -> Column:
    """The rule's id, null where a variable is missing, null or empty."""
    parts: list[Column] = []
    own = {f.attribute: f for f in rule.fields}
    rest = rule.id_template
    for name in rule.variables:
        before, _, rest = rest.partition("{" + name + "}")
        value = jsonpath.as_string(_field(variant, own[name])[0]) if name in own else jsonpath.as_string(F.nullif(jsonpath.first(variant, f"$.{name}"), F.lit("null")))
        parts += [F.lit(before), F.nullif(value, F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def _answered(asked: DataFrame, block: ModelBlock, extractor) -> DataFrame:
    """(block, key, items, error) of (key, prompt): the model is asked once for each key. An answer
    is an object whose `items` are objects with a numeric confidence; others are errors."""
    schema = {"type": "object", "properties": {"items": {"type": "array", "items": block.output_schema, "maxItems": block.max_extractions_per_record}}}

    def checked(answer: dict) -> list[str]:
        items = answer.get("items")
        if not isinstance(items, list):
            raise ValueError("a model's answer must hold a list of items")
        for x in items:
            if not isinstance(x, dict) or isinstance(x.get("confidence"), bool) or not isinstance(x.get("confidence"), (int, float)):
                raise ValueError("an item must be an object with a numeric confidence")
        return [json.dumps(x, ensure_ascii=False) for x in items]

    def run(batches):
        model = CachedExtractor(extractor)
        for d in batches:
            out = []
            for key, prompt in zip(d["key"], d["prompt"]):
                try:
                    out.append((block.name, key, checked(model.extract(key, prompt, schema)), None))
                except ValueError as e:
                    out.append((block.name, key, [], str(e)))
            yield pd.DataFrame(out, columns=["block", "key", "items", "error"])

    ship(asked.sparkSession)
    return asked.groupBy("key").agg(F.min("prompt").alias("prompt")).mapInPandas(run, ANSWERS)


def _materialised(out: DataFrame, spec: MappingSpec, block: ModelBlock, extractor, cache: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, provenance, items and answers of one model block over good records. What a model
    is not asked again: keys in `cache`. Items whose surface text is not in the input are inferred,
    or left out where the block requires grounding."""
    place = ["source_file", "source_record_id", "ordinal"]
    number = {n.name: k for k, n in enumerate(spec.nodes)}
    v = F.col("v")
    given = jsonpath.first(v, block.input_source)
    pairs = [F.concat(F.lit(json.dumps(p) + ":"), F.coalesce(jsonpath.first(v, p), F.lit("null"))) for p in block.cache_key]
    inputs = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    r = out.withColumn("v", F.parse_json("record")).where(given.isNotNull() & ~given.isin("null", '""')).withColumn("source_text", jsonpath.as_string(given))
    r = r.withColumn("key", cache_key(F.lit(block.model), F.lit(block.prompt_template), inputs)).drop("v")
    asked = r.select("key", F.concat(F.lit(block.prompt_template + "\n\nINPUT:\n"), "source_text").alias("prompt"))
    old = None if cache is None else cache.where((F.col("block") == block.name) & F.col("error").isNull()).select("block", "key", "items", "error").dropDuplicates(["key"])
    answers = _answered(asked if old is None else asked.join(old, "key", "left_anti"), block, extractor)
    answers = cut(answers if old is None else answers.unionByName(old.join(asked.select("key").distinct(), "key", "left_semi")))
    x = r.join(answers.select("key", "items"), "key").withColumn("item", F.explode(F.slice("items", 1, block.max_extractions_per_record))).withColumn("v", F.parse_json("item")).drop("items")
    texts = [jsonpath.first(v, f"$.{k}") for k in ("surface_form", "text", "name")]
    x = x.withColumn("surface", F.coalesce(*[F.when(t.startswith('"'), F.nullif(F.trim(jsonpath.as_string(t)), F.lit(""))) for t in texts]))
    x = grounded(x).withColumn("model_self_score", jsonpath.first(v, "$.confidence").cast("double"))
    if block.require_grounding:
        x = x.where("confidence = 'grounded'")
    name = block.output_node_rule.lstrip("@") if block.output_node_rule else None
    id_, error, fields = F.lit(None).cast("string"), F.lit(None).cast("string"), []
    if name:
        rule = spec.nodes[number[name]]
        fields = [_field(v, f) for f in rule.fields]
        id_ = node_id(v, rule)
        error = F.coalesce(F.when(id_.isNull(), F.lit(f"{name}: no id")), *[f[3] for f in fields])
    x = x.withColumns({"error": error, "id": F.when(error.isNull(), id_), "attributes": _facts(rule.fields if name else [], fields)})
    items = x.select(F.lit(block.name).alias("block"), F.lit(block.model).alias("model"), *place, "key", "item", "surface", "confidence", "model_self_score", F.col("id").alias("node_id"), "error")
    made = x.where("id is not null")
    nodes = made.select(*place, F.lit(number.get(name)).cast("int").alias("rule"), F.lit(spec.type_of(rule) if name else None).cast("string").alias("type"), "id", "attributes")
    note = lambda d, node, edge, rule: d.select(node.alias("node_id"), edge.alias("edge_id"), "attribute", "value", "raw_value", "confidence", F.lit("llm_extraction").alias("extraction_method"), "source_file", "source_record_id", "source_field", "ordinal", rule.alias("rule"))
    none = F.lit(None).cast("string")
    facts = note(made.select(*place, "id", "confidence", F.explode("attributes").alias("a")).select(*place, "id", "confidence", "a.*"), F.col("id"), none, F.lit(number.get(name)).cast("int"))
    edges = made.select(none.alias("id"), none.alias("src"), none.alias("dst"), none.alias("relation_type"), *place, "confidence", "surface").limit(0)
    wanted = block.output_edge_rule.lstrip("@") if block.output_edge_rule else None
    if wanted and name:
        edge = next((e for e in spec.edges if e.canonical_type == wanted), None)
        if edge is None:
            raise ValueError(f"block {block.name} refers to {wanted}, no such edge rule")
        end = lambda ref: F.col("id") if ref[1:] == name else F.col(f"n{number[ref[1:]]}.id")
        edges = made.withColumns({"src": end(edge.source_node), "dst": end(edge.target_node)}).where("src is not null and dst is not null")
        edges = edges.select(edge_id(F.col("src"), F.lit(wanted), F.col("dst")).alias("id"), "src", "dst", F.lit(wanted).alias("relation_type"), *place, "confidence", "surface")
        said = edges.withColumns({"attribute": none, "value": none, "raw_value": F.col("surface"), "source_field": F.lit(block.input_source)})
        facts = facts.unionByName(note(said, none, F.col("id"), F.lit(None).cast("int")))
    return nodes, edges.drop("confidence", "surface"), facts, items, answers


def ingest(records: DataFrame, spec: MappingSpec, ledger: DataFrame | None = None, extractor=None, cache: DataFrame | None = None, once: bool = False) -> Ingested:
    """`records`: source_file, ordinal, record. `ledger`: what earlier runs have seen. Specs with
    model blocks need an `extractor` (a picklable Extractor); `cache`: the answers of earlier runs.
    With `once` the evaluated records are cut (a checkpoint the caller discards), for callers that
    use several of the outputs."""
    if spec.llm_blocks and extractor is None:
        raise ValueError(f"spec {spec.tenant!r} has llm_blocks, but there is no extractor")
    v = F.col("v")
    r = spread(records).withColumn("v", F.try_parse_json("record")).withColumn("spec_version", F.lit(spec.spec_version))
    r = r.withColumn("content_hash", F.when(F.col("v").isNotNull(), content_hash(F.col("record"))))
    primary = spec.nodes[0]
    columns = {}
    for k, rule in enumerate(spec.nodes):
        applies = predicate(rule.when, v)
        fields = [_field(v, f) for f in rule.fields]
        required = [F.when(F.coalesce(jsonpath.first(v, f"$.{x}" if not x.startswith("$") else x), F.lit("null")).isin("null", '""'), F.lit(f"{x}: required for the id")) for x in rule.id_required_fields]
        errors = F.coalesce(*[f[3] for f in fields], *required, F.lit(None).cast("string"))
        columns[f"n{k}"] = F.when(applies, F.struct(node_id(v, rule).alias("id"), errors.alias("error"), _facts(rule.fields, fields).alias("attributes")))
    number = {n.name: k for k, n in enumerate(spec.nodes)}
    r = r.withColumn("source_record_id", node_id(v, primary)).withColumns(columns)
    links_of = {}
    for k, rule in enumerate(spec.edges):
        a, b = F.col(f"n{number[rule.source_node[1:]]}.id"), F.col(f"n{number[rule.target_node[1:]]}.id")
        fields = [_field(v, f) for f in rule.fields]
        errors = F.coalesce(*[f[3] for f in fields], F.lit(None).cast("string"))
        made = F.struct(edge_id(a, F.lit(rule.canonical_type), b).alias("id"), a.alias("src"), b.alias("dst"), F.lit(rule.canonical_type).alias("relation_type"), errors.alias("error"), _facts(rule.fields, fields).alias("attributes"))
        links_of[f"e{k}"] = F.when(predicate(rule.when, v) & a.isNotNull() & b.isNotNull(), made)
    r = r.withColumns(links_of)
    bad = [F.when(F.col("v").isNull(), F.lit("not JSON")), F.when(F.col("source_record_id").isNull(), F.lit(f"{primary.name}: no id"))]
    bad += [F.when(F.col(f"n{k}.id").isNotNull(), F.col(f"n{k}.error")) for k in range(len(spec.nodes))]
    bad += [F.col(f"{e}.error") for e in links_of]
    r = r.withColumn("error", F.coalesce(*bad, F.lit(None).cast("string"))).drop("v")
    if ledger is not None:
        r = r.join(ledger.select(*SEEN).distinct().withColumn("_old", F.lit(True)), SEEN, "left")
    else:
        r = r.withColumn("_old", F.lit(None).cast("boolean"))
    turn = F.row_number().over(W.partitionBy(*SEEN, F.col("error").isNull()).orderBy("ordinal"))
    r = r.withColumn("status", F.when(F.col("source_record_id").isNotNull() & F.coalesce("_old", F.lit(False)), F.lit("skipped")).when(F.col("error").isNotNull(), F.lit("dead")).when(turn > 1, F.lit("skipped")).otherwise(F.lit("out"))).drop("_old")
    if once:
        r = cut(r)
    out = r.where("status = 'out'")
    place = ["source_file", "source_record_id", "ordinal"]
    each = [out.where(F.col(f"n{k}.id").isNotNull()).select(*place, F.lit(k).alias("rule"), F.lit(spec.type_of(rule)).alias("type"), f"n{k}.id", f"n{k}.attributes") for k, rule in enumerate(spec.nodes)]
    nodes = each[0]
    for e in each[1:]:
        nodes = nodes.unionByName(e)
    facts = nodes.select(*place, "rule", F.col("id").alias("node_id"), F.explode("attributes").alias("a")).select(*place, "rule", "node_id", "a.*")
    provenance = facts.select("node_id", F.lit(None).cast("string").alias("edge_id"), "attribute", "value", "raw_value", F.lit("exact").alias("confidence"), F.lit("direct_mapping").alias("extraction_method"), "source_file", "source_record_id", "source_field", "ordinal", "rule")
    none = F.lit(None).cast("string")
    links = out.select(*[none.alias(c) for c in ("id", "src", "dst", "relation_type")], *place).limit(0)
    if links_of:
        said = out.select(*place, F.explode(F.filter(F.array(*links_of), lambda e: e.isNotNull())).alias("e"))
        links = said.select("e.id", "e.src", "e.dst", "e.relation_type", *place)
        if any(rule.fields for rule in spec.edges):
            about = said.select(*place, F.col("e.id").alias("edge_id"), F.explode("e.attributes").alias("a")).select(*place, "edge_id", "a.*")
            provenance = provenance.unionByName(about.select(none.alias("node_id"), "edge_id", "attribute", "value", "raw_value", F.lit("exact").alias("confidence"), F.lit("direct_mapping").alias("extraction_method"), "source_file", "source_record_id", "source_field", "ordinal", F.lit(None).cast("int").alias("rule")))
    raw = r.where("status <> 'skipped' and source_record_id is not null").select("source_file", "source_record_id", F.col("record").alias("raw_record"), "content_hash", "ordinal")
    dead = r.where("status = 'dead'").select("source_file", "ordinal", F.lit(None).cast("string").alias("source_record_id"), "error", F.col("record").alias("raw_record"))
    items = answers = None
    for block in spec.llm_blocks:
        n, e, p, i, a = _materialised(out, spec, block, extractor, cache)
        nodes, links, provenance = nodes.unionByName(n), links.unionByName(e), provenance.unionByName(p)
        items, answers = (i, a) if items is None else (items.unionByName(i), answers.unionByName(a))
    return Ingested(r, nodes, links, provenance, raw, dead, out.select(*SEEN).distinct(), items, answers, any(rule.fields for rule in spec.edges))


def report(run: Ingested) -> DataFrame:
    s = lambda x: F.coalesce(F.sum((F.col("status") == x).cast("long")), F.lit(0)).cast("long")
    a = run.records.agg(F.count(F.lit(1)).alias("records_in"), s("out").alias("records_out"), s("skipped").alias("skipped"), s("dead").alias("dead"))
    return a.join(F.broadcast(run.nodes.agg(F.count(F.lit(1)).alias("nodes"))))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: its type (ids of two types fail the job) and version."""
    g = nodes.groupBy("id").agg(F.min("type").alias("type"), F.max("type").alias("_t"), F.count(F.lit(1)).alias("version"))
    ok = F.when(F.col("type") == F.col("_t"), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("one id, two types: "), F.col("id"))))
    return g.select("id", ok.alias("type"), "version")


def merged_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("id", "src", "dst", "relation_type").agg(F.count(F.lit(1)).alias("version"))


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is no node."""
    ids = nodes.select("id").distinct()
    ok = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.join(ok.select("id"), "id", "left_anti")


# ---- drift -------------------------------------------------------------------------------


def fingerprint_diff(expected: DataFrame, observed: DataFrame, ignore_extra: bool = True) -> DataFrame:
    """(path, problem): declared paths that are missing or changed, and new ones if asked for."""
    e, o = expected.select("path", F.col("tag").alias("was")), observed.select("path", F.col("tag").alias("now"))
    d = e.join(o, "path", "full_outer")
    d = d.withColumn("problem", F.when(F.col("now").isNull(), F.lit("missing")).when(F.col("was").isNull(), F.lit("new")).when(F.col("was") != F.col("now"), F.concat(F.lit("changed "), "was", F.lit(" to "), "now")))
    return d.where("problem is not null" + (" and problem <> 'new'" if ignore_extra else "")).select("path", "problem")


def required_paths_hash(paths: list[str]) -> str:
    return hashlib.sha256(json.dumps(sorted(set(paths)), separators=(",", ":")).encode()).hexdigest()


def required_paths(spec: MappingSpec) -> list[str]:
    return sorted({jsonpath.parse(p).dotted for n in spec.nodes for f in n.fields if f.required for p in f.paths})


class DriftError(RuntimeError):
    pass


def check_drift(records: DataFrame, spec: MappingSpec, sample: int = 30) -> list[str]:
    """Problems of the first records against the spec's stamps; no stamps, no check."""
    if spec.type_fingerprint is None and spec.required_paths_hash is None:
        return []
    some = records.orderBy("source_file", "ordinal").limit(sample)
    seen = {r["path"]: r["tag"] for r in type_fingerprint(some).collect()}
    out = [f"{p}: missing" for p in required_paths(spec) if spec.required_paths_hash is not None and p not in seen and not any(s.startswith((p + ".", p + "[")) for s in seen)]
    for p, t in (spec.type_fingerprint or {}).items():
        if seen.get(p) != t:
            out.append(f"{p}: {t} became {seen.get(p, 'missing')}")
    return out


def identities(people: DataFrame) -> DataFrame:
    """SAME_AS pairs (a < b) of people (id, email) whose normalised addresses are equal."""
    from factloom.functions.text import normalized_email

    p = people.where(F.contains("email", F.lit("@"))).select("id", normalized_email(F.col("email")).alias("email")).distinct()
    q = p.select(F.col("id").alias("b"), "email")
    return p.select(F.col("id").alias("a"), "email").join(q, "email").where("a < b").select("a", "b", "email", edge_id(F.col("a"), F.lit("SAME_AS"), F.col("b")).alias("edge_id"))
