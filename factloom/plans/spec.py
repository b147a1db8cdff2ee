"""Mapping specs: how records of a source become nodes and edges.

A spec is checked when it is made (unknown keys, types, transformers, predicates and references
are errors) and compiles to Column expressions, so a whole source is one DataFrame plan.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import jsonpath
from factloom.functions.text import TRANSFORMERS
from factloom.registry import check_relation, check_type

MAX_DEPTH = 4
_TEMPLATE = re.compile(r"\{([^{}]+)\}")


def _made(kind, data: dict, **convert):
    known = {f.name for f in fields(kind)}
    if extra := set(data) - known:
        raise ValueError(f"{kind.__name__}: unknown keys {sorted(extra)}")
    return kind(**{k: convert[k](v) if k in convert and v is not None else v for k, v in data.items()})


@dataclass(frozen=True)
class FieldMap:
    attribute: str
    source: str | list[str]
    transform: list[str] = field(default_factory=list)
    required: bool = True
    pii: bool = False

    def __post_init__(self):
        if unknown := set(self.transform) - set(TRANSFORMERS):
            raise ValueError(f"unknown transformers {sorted(unknown)}; known: {sorted(TRANSFORMERS)}")
        for p in self.paths:
            jsonpath.parse(p)

    @property
    def paths(self) -> list[str]:
        return [self.source] if isinstance(self.source, str) else list(self.source)


@dataclass(frozen=True)
class NodeRule:
    name: str
    canonical_type: str
    id_template: str
    id_required_fields: list[str] = field(default_factory=list)
    when: dict | None = None
    fields: list[FieldMap] = field(default_factory=list)

    def __post_init__(self):
        if self.when is not None:
            check_predicate(self.when)

    @property
    def variables(self) -> list[str]:
        return _TEMPLATE.findall(self.id_template)


@dataclass(frozen=True)
class EdgeRule:
    canonical_type: str
    source_node: str
    target_node: str
    when: dict | None = None
    fields: list[FieldMap] = field(default_factory=list)

    def __post_init__(self):
        for ref in (self.source_node, self.target_node):
            if not ref.startswith("@") or len(ref) < 2:
                raise ValueError(f"node reference {ref!r} must be '@' and a rule's name")
        if self.when is not None:
            check_predicate(self.when)


@dataclass(frozen=True)
class ModelBlock:
    name: str
    input_source: str
    prompt_template: str
    output_schema: dict
    cache_key: list[str]
    output_node_rule: str | None = None
    output_edge_rule: str | None = None
    require_grounding: bool = True
    max_extractions_per_record: int = 50
    model: str = "none"


@dataclass(frozen=True)
class SourceSelector:
    file_pattern: str
    format: str
    record_path: str = "$[*]"

    def __post_init__(self):
        if self.format not in ("json", "jsonl", "ndjson", "csv"):
            raise ValueError(f"unknown format {self.format!r}")


@dataclass(frozen=True)
class MappingSpec:
    tenant: str
    source: SourceSelector
    nodes: list[NodeRule]
    edges: list[EdgeRule] = field(default_factory=list)
    canonical_aliases: dict[str, str] = field(default_factory=dict)
    llm_blocks: list[ModelBlock] = field(default_factory=list)
    spec_version: int = 1
    required_paths_hash: str | None = None
    type_fingerprint: dict[str, str] | None = None

    def __post_init__(self):
        names = [n.name for n in self.nodes]
        if not names:
            raise ValueError("a spec needs a node rule")
        if len(set(names)) < len(names):
            raise ValueError("node rules need distinct names")
        for n in self.nodes:
            check_type(n.canonical_type, self.canonical_aliases)
        for e in self.edges:
            check_relation(e.canonical_type)
            for ref in (e.source_node, e.target_node):
                if ref[1:] not in names:
                    raise ValueError(f"edge refers to {ref}, no such node rule")
        for b in self.llm_blocks:
            if b.output_node_rule and b.output_node_rule.lstrip("@") not in names:
                raise ValueError(f"block {b.name} refers to {b.output_node_rule}, no such node rule")

    def type_of(self, rule: NodeRule) -> str:
        return check_type(rule.canonical_type, self.canonical_aliases)


def load(data: dict | str) -> MappingSpec:
    """A spec from a dict or YAML text."""
    if isinstance(data, str):
        import yaml

        data = yaml.safe_load(data)
    maps = lambda v: [_made(FieldMap, x) for x in v]
    return _made(MappingSpec, data, source=lambda v: _made(SourceSelector, v), nodes=lambda v: [_made(NodeRule, x, fields=maps) for x in v],
                 edges=lambda v: [_made(EdgeRule, x, fields=maps) for x in v], llm_blocks=lambda v: [_made(ModelBlock, x) for x in v])


def dump(spec: MappingSpec) -> str:
    import yaml

    return yaml.safe_dump(asdict(spec), sort_keys=False)


def check_predicate(p: Any, depth: int = 1) -> None:
    if depth > MAX_DEPTH:
        raise ValueError(f"predicate deeper than {MAX_DEPTH}")
    if not isinstance(p, dict) or len(p) != 1:
        raise ValueError(f"a predicate is a mapping of one key, not {p!r}")
    (op, arg), = p.items()
    if op in ("and", "or"):
        if not isinstance(arg, list) or not arg:
            raise ValueError(f"{op} needs a list of predicates")
        for x in arg:
            check_predicate(x, depth + 1)
    elif op in ("not_null", "exists"):
        if not isinstance(arg, str):
            raise ValueError(f"{op} needs a path")
    elif op in ("equals", "in", "matches"):
        if not isinstance(arg, list) or len(arg) != 2 or not isinstance(arg[0], str):
            raise ValueError(f"{op} needs a path and a value")
        if op == "in" and not isinstance(arg[1], list):
            raise ValueError("in needs a list of values")
        if op == "matches":
            if not isinstance(arg[1], str):
                raise ValueError("matches needs a pattern")
            re.compile(arg[1])
    else:
        raise ValueError(f"unknown predicate {op!r}")


def _equal(json: Column, value: Any) -> Column:
    """Whether JSON text equals a literal; numbers and booleans compare as numbers."""
    if isinstance(value, str):
        return json.startswith('"') & (jsonpath.as_string(json) == value)
    if value is None:
        return json == "null"
    if isinstance(value, (bool, int, float)):
        number = F.when(json == "true", 1.0).when(json == "false", 0.0).when(json.rlike(r"^-?\d"), json.try_cast("double"))
        return number == float(value)
    raise ValueError(f"cannot compare with {value!r}")


def predicate(p: dict | None, variant: Column) -> Column:
    """A predicate as a boolean Column that is never null."""
    if p is None:
        return F.lit(True)
    (op, arg), = p.items()
    if op in ("and", "or"):
        out = predicate(arg[0], variant)
        for x in arg[1:]:
            out = out & predicate(x, variant) if op == "and" else out | predicate(x, variant)
        return out
    json = jsonpath.first(variant, arg if isinstance(arg, str) else arg[0])
    if op == "exists":
        return json.isNotNull()
    if op == "not_null":
        return json.isNotNull() & (json != "null")
    if op == "equals":
        cond = _equal(json, arg[1])
    elif op == "in":
        cond = F.lit(False)
        for v in arg[1]:
            cond = cond | F.coalesce(_equal(json, v), F.lit(False))
    else:
        cond = json.startswith('"') & jsonpath.as_string(json).rlike(arg[1])
    return F.coalesce(cond, F.lit(False))
